"""Accepted cards into knowledge tables, chunk annotations and rendered Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules


def flatten(cards: DataFrame) -> dict[str, DataFrame]:
    """claims, concepts, questions, objections and applications of all accepted cards, with pos in the card."""
    parsed = rules.parse(cards, "card", rules.CARD)
    keys = ["book_id", "chapter_id"]
    out = {}
    for name, field in (("claims", "claims"), ("concepts", "concetti")):
        out[name] = parsed.select(*keys, F.posexplode(f"c.{field}").alias("pos", "x")).select(*keys, "pos", "x.*")
    for name, field in (("questions", "domande"), ("objections", "obiezioni"), ("applications", "applicazioni")):
        out[name] = parsed.select(*keys, F.posexplode(f"c.{field}").alias("pos", "text"))
    return out


def keywords_by_chunk(cards: DataFrame) -> DataFrame:
    """(book_id, id, keywords): names of the concepts that cite a chunk, in the card's order, each once."""
    concepts = flatten(cards)["concepts"].select("book_id", "chapter_id", "pos", "name", F.explode("chunk_ids").alias("id"))
    once = concepts.groupBy("book_id", "id", "name").agg(F.min(F.struct("chapter_id", "pos")).alias("at"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"])
    return once.groupBy("book_id", "id").agg(names.alias("keywords"))


def summaries_by_chunk(cards: DataFrame) -> DataFrame:
    """(book_id, id, summary): the last that a card gives."""
    parsed = rules.parse(cards, "card", rules.CARD)
    rows = parsed.select("book_id", "chapter_id", F.posexplode("c.chunk_summaries").alias("pos", "x"))
    return rows.groupBy("book_id", F.col("x.chunk_id").alias("id")).agg(F.max_by("x.summary", F.struct("chapter_id", "pos")).alias("summary"))


def annotate(chunks: DataFrame, cards: DataFrame) -> DataFrame:
    """Chunks with the summaries and keywords of accepted cards; what no card cites stays."""
    s = summaries_by_chunk(cards).withColumnRenamed("summary", "_summary")
    k = keywords_by_chunk(cards).withColumnRenamed("keywords", "_keywords")
    rows = chunks.join(s, ["book_id", "id"], "left").join(k, ["book_id", "id"], "left")
    return rows.withColumns({"summary": F.coalesce("_summary", "summary"), "keywords": F.coalesce("_keywords", "keywords")}).select(*chunks.columns)


def _list(items: Column, show=lambda x: x) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), show(x))), "\n")
    return F.when(F.size(F.coalesce(items, F.array())) > 0, lines).otherwise(F.lit("- (vuoto)"))


def _sections(title: Column, parts: list[tuple[str, Column]]) -> Column:
    return F.concat(title, *[x for head, body in parts for x in (F.lit(f"\n\n## {head}\n\n"), body)], F.lit("\n"))


def _cited(ids: Column) -> Column:
    return F.concat(F.lit(" ["), F.array_join(ids, ", "), F.lit("]"))


def render_cards(cards: DataFrame) -> DataFrame:
    """(book_id, chapter_id, markdown). Headings are fixed values of the format."""
    c = F.col("c")
    title = F.concat(F.lit("# "), c["chapter_id"], F.lit(" — "), c["title"], F.lit("\n\nCoverage: "), c["coverage"]["parts_read"].cast("string"), F.lit("/"), c["coverage"]["parts_total"].cast("string"), F.lit(" parti lette."))
    body = _sections(title, [
        ("Funzione nel libro", c["funzione"]), ("Riassunto", c["riassunto"]), ("Tesi", c["tesi"]),
        ("Concetti", _list(c["concetti"], lambda x: F.concat(F.lit("**"), x["name"], F.lit("**: "), x["definition"], _cited(x["chunk_ids"])))),
        ("Claims", _list(c["claims"], lambda x: F.concat(F.lit("["), x["tipo"], F.lit("] "), x["claim"], _cited(x["chunk_ids"])))),
        ("Passaggi decisivi", _list(c["passaggi"], lambda x: F.concat(F.lit("“"), x["testo"], F.lit("” ["), x["chunk_id"], F.lit("]")))),
        ("Domande", _list(c["domande"])), ("Obiezioni", _list(c["obiezioni"])), ("Applicazioni", _list(c["applicazioni"])), ("Cosa memorizzare", c["cosa_memorizzare"]),
    ])
    return rules.parse(cards, "card", rules.CARD).select("book_id", "chapter_id", body.alias("markdown"))


def render_syntheses(syntheses: DataFrame) -> DataFrame:
    """(book_id, markdown). Headings are fixed values of the format."""
    c = F.col("c")
    body = _sections(F.lit("# Sintesi del libro"), [
        ("Tesi centrale", c["tesi_centrale"]), ("Formula", c["formula"]), ("Mappa", _list(c["mappa"])), ("Argomentazione", c["argomentazione"]),
        ("Concetti globali", _list(c["concetti_globali"], lambda x: F.concat(F.lit("**"), x["name"], F.lit("**: "), x["definition"], _cited(x["chapter_ids"])))),
        ("Domande profonde", _list(c["domande_profonde"])), ("Limiti", _list(c["limiti"])),
        ("Collegamenti esterni (speculativi)", F.concat(F.lit("I collegamenti seguenti vanno oltre il testo: trattali come [speculazione].\n\n"), _list(c["collegamenti_esterni"]))),
    ])
    return rules.parse(syntheses, "synthesis", rules.SYNTHESIS).select("book_id", body.alias("markdown"))


def render_book(cards: DataFrame, syntheses: DataFrame) -> DataFrame:
    """(book_id, markdown): a book's rendered cards by chapter, and its synthesis last. cards and syntheses are rendered."""
    rows = cards.select("book_id", F.lit(0).alias("last"), F.length("chapter_id").alias("size"), "chapter_id", "markdown")
    rows = rows.unionByName(syntheses.select("book_id", F.lit(1).alias("last"), F.lit(0).alias("size"), F.lit("").alias("chapter_id"), "markdown"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("last", "size", "chapter_id", "markdown"))), lambda s: s["markdown"])
    return rows.groupBy("book_id").agg(F.array_join(ordered, "\n").alias("markdown"))


#: Names by which an analysis's parts are asked for: fixed values.
SECTIONS = {"00": "tesi_centrale", "tesi": "tesi_centrale", "01": "mappa", "02": "formula", "riassunto": "formula", "03": "argomentazione", "04": "concetti_globali", "concetti": "concetti_globali", "05": "concetti_globali", "glossario": "concetti_globali", "06": "domande_profonde", "domande": "domande_profonde", "07": "limiti", "critiche": "limiti", "08": "collegamenti_esterni", "collegamenti": "collegamenti_esterni"}


def analysis(syntheses: DataFrame, section: str) -> DataFrame:
    """(book_id, section, value as JSON) of a synthesis by its name, a number or a part of its name."""
    low = section.strip().lower()
    name = SECTIONS.get(low) or next((f for f in rules.SYNTHESIS.names if low and low in f), None)
    value = F.get_json_object("synthesis", f"$.{name}") if name else F.lit(None).cast("string")
    return syntheses.select("book_id", F.lit(name).alias("section"), F.coalesce(value, F.lit("")).alias("value"))
