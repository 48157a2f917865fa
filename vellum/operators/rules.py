"""Rules for chapter cards and syntheses: form, references and textual evidence, as one table of violations.

All rules are computed for all cards at once; the first by (rule, item) is a card's error. Cards are JSON strings:
(book_id, chapter_id, card).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

CHAPTER_ID, CHUNK_ID = "^ch\\d{3,}$", "^chunk_ch\\d{3,}_\\d{4,}$"
MIN_SUMMARY, MIN_WORDS = 300, 3
KINDS = ("testo", "inferenza")



def _struct(**fields: S.DataType) -> S.StructType:
    return S.StructType([S.StructField(k, v) for k, v in fields.items()])


def _list(**fields: S.DataType) -> S.ArrayType:
    return S.ArrayType(_struct(**fields))


_S, _N, _L = S.StringType(), S.IntegerType(), S.ArrayType(S.StringType())
CARD = _struct(
    chapter_id=_S, title=_S, coverage=_struct(parts_read=_N, parts_total=_N), funzione=_S, riassunto=_S, tesi=_S,
    concetti=_list(name=_S, definition=_S, chunk_ids=_L), claims=_list(claim=_S, tipo=_S, chunk_ids=_L, anchors=_L), passaggi=_list(testo=_S, chunk_id=_S),
    domande=_L, obiezioni=_L, applicazioni=_L, cosa_memorizzare=_S, chunk_summaries=_list(chunk_id=_S, summary=_S),
)
SYNTHESIS = _struct(
    tesi_centrale=_S, formula=_S, mappa=_L, argomentazione=_S, concetti_globali=_list(name=_S, definition=_S, chapter_ids=_L),
    domande_profonde=_L, limiti=_L, collegamenti_esterni=_L,
)
_BAD = "struct<rule:int,item:int,message:string>"


def parse(rows: DataFrame, column: str, schema: S.StructType) -> DataFrame:
    """Adds ``c``, null where the JSON can't be parsed; the JSON string stays, with keys that the schema doesn't know."""
    tagged = S.StructType([*schema.fields, S.StructField("_corrupt", S.StringType())])
    c = F.from_json(column, tagged, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # a generator of one row, so that the rules read the parsed card and don't parse it again
    rows = rows.select("*", F.explode(F.array(c)).alias("_c"))
    good = F.when(F.col("_c._corrupt").isNull() & F.col(column).isNotNull(), F.col("_c"))
    return rows.select("*", F.explode(F.array(good)).alias("c")).drop("_c")


def _if(bad: Column, rule: int, message, item=0) -> Column:
    made = F.array(F.struct(F.lit(rule).alias("rule"), (item if isinstance(item, Column) else F.lit(item)).cast("int").alias("item"), (message if isinstance(message, Column) else F.lit(message)).alias("message")).cast(_BAD))
    return F.when(F.coalesce(bad, F.lit(True)), made).otherwise(F.array().cast(f"array<{_BAD}>"))


def _text(name: str, least: int = 1) -> Column:
    return _if(F.length(f"c.{name}") < least, 1, f"{name}: a text of {least} characters at least is needed")


def _each(name: str, checks, least: int = 0, optional: bool = False) -> Column:
    """A list of ``least`` items at least whose items pass the checks: (condition that must hold of an item, message)."""
    items = F.coalesce(F.col(f"c.{name}"), F.array().cast(CARD_TYPES[name])) if optional else F.col(f"c.{name}")
    whole = _if(items.isNull() | (F.size(items) < least), 1, f"{name}: a list of {least} items at least is needed")

    def inspect(ok, message):
        return F.flatten(F.transform(items, lambda x, i: _if(~F.coalesce(ok(x), F.lit(False)), 1, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"]: {message}")), i)))

    inner = [inspect(ok, message) for ok, message in checks]
    return F.concat(whole, *[F.coalesce(x, F.array().cast(f"array<{_BAD}>")) for x in inner])


CARD_TYPES = {f.name: f.dataType for f in [*CARD.fields, *SYNTHESIS.fields] if isinstance(f.dataType, S.ArrayType)}
_full = lambda x: F.length(x) > 0
_ids = lambda field, pattern: lambda x: (F.size(x[field]) > 0) & F.forall(x[field], lambda i: i.rlike(pattern))
_has = lambda field: lambda x: F.length(x[field]) > 0


def card_form() -> Column:
    """Violations of a parsed card's form."""
    return F.concat(
        _if(~F.col("c.chapter_id").rlike(CHAPTER_ID), 1, "chapter_id: it isn't a chapter's id"),
        *[_text(n) for n in ("title", "funzione", "tesi", "cosa_memorizzare")],
        _text("riassunto", MIN_SUMMARY),
        _if(~((F.col("c.coverage.parts_read") >= 0) & (F.col("c.coverage.parts_total") >= 1)), 1, "coverage: parts_read and parts_total are needed"),
        _each("concetti", [(_has("name"), "name is missing"), (_has("definition"), "definition is missing"), (_ids("chunk_ids", CHUNK_ID), "chunk_ids aren't ids of chunks")], 1),
        _each("claims", [(_has("claim"), "claim is missing"), (lambda x: x["tipo"].isin(*KINDS), "tipo isn't known"), (_ids("chunk_ids", CHUNK_ID), "chunk_ids aren't ids of chunks"), (lambda x: F.forall(F.coalesce(x["anchors"], F.array().cast("array<string>")), _full), "an anchor is empty")], 1),
        _each("passaggi", [(_has("testo"), "testo is missing"), (lambda x: x["chunk_id"].rlike(CHUNK_ID), "chunk_id isn't a chunk's id")]),
        *[_each(n, [(_full, "it is empty")]) for n in ("domande", "obiezioni", "applicazioni")],
        _each("chunk_summaries", [(lambda x: x["chunk_id"].rlike(CHUNK_ID), "chunk_id isn't a chunk's id"), (_has("summary"), "summary is missing")], optional=True),
    )


def synthesis_form() -> Column:
    return F.concat(
        *[_text(n) for n in ("tesi_centrale", "formula", "argomentazione")],
        *[_each(n, [(_full, "it is empty")], 1) for n in ("mappa", "domande_profonde", "limiti")],
        _each("concetti_globali", [(_has("name"), "name is missing"), (_has("definition"), "definition is missing"), (_ids("chapter_ids", CHAPTER_ID), "chapter_ids aren't ids of chapters")], 1),
        _each("collegamenti_esterni", [(_full, "it is empty")]),
    )


_CITED = "array<struct<rule:int,item:int,what:string,cited:array<string>,anchors:array<string>>>"


def citations() -> Column:
    """What each item of a parsed card cites, and its quotations: structs of rule, item, what, cited, anchors."""
    none = F.array().cast("array<string>")

    def of(field: str, rule: int, cited, anchors) -> Column:
        items = F.transform(f"c.{field}", lambda x, i: F.struct(F.lit(rule).alias("rule"), i.alias("item"), F.lit(field).alias("what"), cited(x).alias("cited"), anchors(x).alias("anchors")))
        return F.coalesce(items.cast(_CITED), F.array().cast(_CITED))

    return F.concat(
        of("concetti", 5, lambda x: x["chunk_ids"], lambda x: none),
        of("claims", 6, lambda x: x["chunk_ids"], lambda x: F.coalesce(x["anchors"], none)),
        of("passaggi", 7, lambda x: F.array(x["chunk_id"]), lambda x: F.array(x["testo"])),
        of("chunk_summaries", 8, lambda x: F.array(x["chunk_id"]), lambda x: none),
    )


def anchor_violations(cited: DataFrame, chunks: DataFrame, few: bool = True) -> DataFrame:
    """Quotations of under three words, or in none of the chunks that their item cites.

    Joined on the cited chunk's id; texts are put into the comparable form once a chunk. few: only cited ones, for which
    the citations are computed twice. What is quoted is shuffled to the cited chunks and, if it isn't there, back.
    """
    rows = cited.select("book_id", "chapter_id", "rule", "item", "what", "cited", F.posexplode("anchors").alias("a", "anchor")).withColumn("norm", T.norm_anchor("anchor"))
    pairs = rows.select("*", F.explode_outer("cited").alias("id"))
    used = chunks.join(pairs.select("book_id", "id").distinct(), ["book_id", "id"], "left_semi") if few else chunks
    used = used.select("book_id", "id", T.norm_anchor("text").alias("norm_text"))
    short = F.size(F.filter(F.split("norm", " "), lambda w: w != "")) < MIN_WORDS
    met = pairs.join(used, ["book_id", "id"], "left").withColumn("found", F.coalesce(F.contains("norm_text", "norm"), F.lit(False))).withColumn("short", short)
    left = F.when(F.col("short") | ~F.col("found"), F.col("anchor")).alias("anchor")
    met = met.select("book_id", "chapter_id", "rule", "item", "what", "a", F.xxhash64("anchor").alias("h"), "found", "short", left)
    key = ["book_id", "chapter_id", "rule", "item", "what", "a", "h"]
    found = met.groupBy(*key).agg(F.bool_or("found").alias("found"), F.bool_or("short").alias("short"), F.max("anchor").alias("anchor"))
    why = F.when(F.col("short"), F.lit("a quotation has three words at least: ")).when(~F.col("found"), F.lit("a quotation isn't in the cited chunks: "))
    rows = found.withColumn("why", why).where("why is not null")
    return rows.select("book_id", "chapter_id", "rule", "item", F.concat("what", F.lit("["), F.col("item").cast("string"), F.lit("]: "), "why", "anchor").alias("message"))


def _formal(cards: DataFrame) -> DataFrame:
    """(book_id, chapter_id, c, bad): the parsed card, and what is wrong with its form."""
    parsed = parse(cards, "card", CARD).select("book_id", "chapter_id", "c")
    return parsed.select("*", F.explode(F.array(F.when(F.col("c").isNull(), _if(F.lit(True), 0, "it isn't JSON")).otherwise(card_form()))).alias("bad"))


#: A violation (v), or what decides of one by the status of a chapter (s) or by a chunk (c), named by id.
_EVENT = "struct<kind:string,id:string,rule:int,item:int,message:string,total:int,read:int>"


def _event(kind: str, id, rule=None, item=None, message=None, total=None, read=None) -> Column:
    values = {"kind": F.lit(kind), "id": id, "rule": rule, "item": item, "message": message, "total": total, "read": read}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()]).cast(_EVENT)


def _covers() -> Column:
    return F.array(_event("s", F.col("chapter_id"), total=F.col("c.coverage.parts_total"), read=F.col("c.coverage.parts_read")))


def _judge_cover() -> Column:
    """Rules 2 and 3 of an event s that met a chapter's status."""
    return F.concat(
        _if(F.col("_parts").isNull(), 2, "the chapter isn't known"),
        _if(F.coalesce(F.col("e.total") != F.col("_parts"), F.lit(False)), 3, "coverage: the chapter has another number of parts"),
        _if(F.coalesce(F.col("e.read") != F.col("_parts"), F.lit(False)), 3, "coverage: not all parts were read"),
    )


def coverage_violations(cards: DataFrame, status: DataFrame) -> DataFrame:
    """``card_violations`` of the chapter's status only: that it is known (rule 2) and read as a whole (rule 3)."""
    rows = _formal(cards).where(F.size("bad") == 0).select("book_id", "chapter_id", F.explode(_covers()).alias("e"))
    rows = rows.join(status.select("book_id", "chapter_id", F.col("parts_total").alias("_parts")), ["book_id", "chapter_id"], "left")
    return rows.select("book_id", "chapter_id", F.inline(_judge_cover()))


def card_violations(cards: DataFrame, chunks: DataFrame, status: DataFrame) -> DataFrame:
    """(book_id, chapter_id, rule, item, message) of all cards (book_id, chapter_id, card).

    status: (book_id, chapter_id, parts_total). Rules: 0 JSON, 1 form, 2 chapter, 3 coverage, 4 thesis, 5 to 8 the
    lists in their order. A card that isn't JSON or of the right form has no further violations.

    Cards are parsed where they are, once for all rules and once for quotations. They give short rows, of which those
    that a status or a chunk decides meet both in one join; no card is shuffled, and no text but quotations.
    """
    formal = _formal(cards)
    claims = F.transform("c.claims", lambda x, i: _if((x["tipo"] == "testo") & (F.size(F.coalesce(x["anchors"], F.array().cast("array<string>"))) == 0), 6, F.concat(F.lit("claims["), i.cast("string"), F.lit("]: a claim on the text needs a quotation")), i))
    more = F.concat(
        _if(F.col("c.chapter_id") != F.col("chapter_id"), 2, "the card is of another chapter"),
        _if(T.norm_anchor("c.tesi") == T.norm_anchor("c.riassunto"), 4, "the thesis equals the summary"),
        F.flatten(claims),
    )
    own = F.when(F.size("bad") == 0, more).otherwise(F.col("bad"))
    label = lambda x: F.concat(x["what"], F.lit("["), x["item"].cast("string"), F.lit("]: chunk "))
    cited = F.flatten(F.transform(citations(), lambda x: F.transform(x["cited"], lambda i: _event("c", i, x["rule"], x["item"], label(x)))))
    told = F.transform(own, lambda b: _event("v", F.col("chapter_id"), b["rule"], b["item"], b["message"]))
    events = F.concat(told, F.when(F.size("bad") == 0, F.concat(_covers(), cited)).otherwise(F.array().cast(f"array<{_EVENT}>")))
    rows = formal.select("book_id", "chapter_id", F.explode(events).alias("e")).select("*", F.col("e.kind").alias("kind"), F.col("e.id").alias("id"))
    none = F.lit(None)
    known = status.select("book_id", F.lit("s").alias("kind"), F.col("chapter_id").alias("id"), F.col("parts_total").cast("int").alias("_parts"), none.cast("string").alias("owner"))
    known = known.unionByName(chunks.select("book_id", F.lit("c").alias("kind"), "id", none.cast("int").alias("_parts"), F.col("chapter_id").alias("owner")))
    rows = rows.join(known, ["book_id", "kind", "id"], "left")
    why = F.when(F.col("owner").isNull(), F.lit(" doesn't exist")).otherwise(F.concat(F.lit(" belongs to "), F.col("owner")))
    message = F.when(F.col("kind") == "c", F.concat("e.message", "id", why)).otherwise(F.col("e.message"))
    itself = F.array(F.struct("e.rule", "e.item", message.alias("message")).cast(_BAD))
    bad = F.when(F.col("kind") == "v", itself).when(F.col("kind") == "s", _judge_cover()).when(~F.col("owner").eqNullSafe(F.col("chapter_id")), itself)
    found = rows.select("book_id", "chapter_id", F.inline(bad))
    quoted = formal.where(F.size("bad") == 0).select("book_id", "chapter_id", F.inline(F.filter(citations(), lambda x: F.size(x["anchors"]) > 0)))
    return found.unionByName(anchor_violations(quoted, chunks, few=False))


def first_errors(violations: DataFrame) -> DataFrame:
    """(book_id, chapter_id, message): the first violation of each card, cut for the log at 200 characters."""
    first = F.min(F.struct("rule", "item", "message"))["message"]
    rows = violations.groupBy("book_id", "chapter_id").agg(first.alias("message"))
    return rows.withColumn("message", F.when(F.length("message") > 200, F.concat(F.left("message", F.lit(200)), F.lit("…"))).otherwise(F.col("message")))


def accepted(cards: DataFrame, violations: DataFrame) -> DataFrame:
    return cards.join(violations.select("book_id", "chapter_id").distinct(), ["book_id", "chapter_id"], "left_anti")


def synthesis_violations(syntheses: DataFrame, status: DataFrame) -> DataFrame:
    """(book_id, rule, item, message) of syntheses (book_id, synthesis); status: (book_id, chapter_id, status)."""
    parsed = parse(syntheses, "synthesis", SYNTHESIS)
    pending = status.where("status <> 'committed'").groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list("chapter_id")), ", ").alias("ids"))
    early = parsed.join(pending, "book_id").select("book_id", F.lit(0).alias("rule"), F.lit(0).alias("item"), F.concat(F.lit("chapters aren't committed yet: "), "ids").alias("message"))
    bad = F.when(F.col("c").isNull(), _if(F.lit(True), 1, "it isn't JSON")).otherwise(synthesis_form())
    formal = parsed.select("book_id", F.inline(bad))
    cited = parsed.select("book_id", F.posexplode("c.concetti_globali").alias("item", "x")).select("book_id", "item", F.explode("x.chapter_ids").alias("chapter_id"))
    unknown = cited.join(status.select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_anti")
    refs = unknown.select("book_id", F.lit(2).alias("rule"), "item", F.concat(F.lit("concetti_globali["), F.col("item").cast("string"), F.lit("]: chapter "), "chapter_id", F.lit(" doesn't exist")).alias("message"))
    return early.unionByName(formal).unionByName(refs)
