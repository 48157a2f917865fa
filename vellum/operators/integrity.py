"""Integrity of a corpus: checks in three gates; a later gate counts only for books that passed the ones before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rules


def orphans(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_id, n): chapters that chunks name and the book doesn't have."""
    return chunks.join(chapters.select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_anti").groupBy("book_id", "chapter_id").agg(F.count(F.lit(1)).alias("n"))


def stale(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, id): chunks whose chapter hash isn't the chapter's."""
    have = chapters.select("book_id", "chapter_id", F.col("hash").alias("_hash"))
    return chunks.join(have, ["book_id", "chapter_id"], "left").where(~F.col("chapter_hash").eqNullSafe(F.col("_hash"))).select("book_id", "id")


def first_ids(rows: DataFrame, column: str, n: int = 8) -> DataFrame:
    """(book_id, ids): the first n ids in order, for a report's notes."""
    w = Window.partitionBy("book_id").orderBy(column)
    few = rows.select("book_id", column).distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return few.groupBy("book_id").agg(F.array_sort(F.collect_list(column)).alias("ids"))


def check(books: DataFrame, chapters: DataFrame, chunks: DataFrame, status: DataFrame, cards: DataFrame, syntheses: DataFrame, synthesized: DataFrame) -> DataFrame:
    """(book_id, gate, label, passed, note) of all books.

    Gate 1: a book has text, and chapters. Gate 2: every chapter has a state, a hash and a number of parts. Gate 3:
    chunks exist, none is an orphan or stale, committed chapters have a card of the right form, and a committed
    synthesis is there and of the right form. Files and folders of a book are rows of tables here.
    """
    ids = books.select("book_id")

    def label(found: DataFrame, gate: int, name: str, bad: bool = True) -> DataFrame:
        """found: (book_id, ids) of what is wrong, or with bad=False of what must be there."""
        rows = ids.join(found, "book_id", "left")
        passed = F.col("ids").isNull() if bad else F.col("ids").isNotNull()
        return rows.select("book_id", F.lit(gate).alias("gate"), F.lit(name).alias("label"), passed.alias("passed"), F.when(~passed, F.array_join(F.coalesce("ids", F.array()), ", ")).alias("note"))

    empty = books.where(F.coalesce(F.length("text"), F.lit(0)) == 0).withColumn("id", F.lit("text"))
    broken = chapters.select("book_id", "chapter_id", "hash").join(status.select("book_id", "chapter_id", "status", "parts_total"), ["book_id", "chapter_id"], "left").where("status is null or hash is null or parts_total is null")
    parsed = rules.parse(cards, "card", rules.CARD)
    good = parsed.where(F.col("c").isNotNull() & (F.size(rules.card_form()) == 0)).select("book_id", "chapter_id")
    committed = status.where("status = 'committed'").select("book_id", "chapter_id")
    syn = rules.parse(syntheses, "synthesis", rules.SYNTHESIS)
    syn_good = syn.where(F.col("c").isNotNull() & (F.size(rules.synthesis_form()) == 0)).select("book_id")
    no_syn = synthesized.join(syn_good, "book_id", "left_anti").withColumn("id", F.lit("synthesis"))
    rows = [
        label(first_ids(empty, "id"), 1, "text is there"),
        label(first_ids(chapters, "chapter_id"), 1, "chapters are there", bad=False),
        label(first_ids(broken, "chapter_id"), 2, "chapters have states"),
        label(first_ids(chunks, "id"), 3, "chunks are there", bad=False),
        label(first_ids(orphans(chunks, chapters), "chapter_id"), 3, "no orphan chunks"),
        label(first_ids(stale(chunks, chapters), "id"), 3, "chapter hashes agree"),
        label(first_ids(committed.join(cards.select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_anti"), "chapter_id"), 3, "committed cards are there"),
        label(first_ids(committed.join(cards.select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_semi").join(good, ["book_id", "chapter_id"], "left_anti"), "chapter_id"), 3, "committed cards are of the right form"),
        label(first_ids(no_syn, "id"), 3, "a committed synthesis is there and of the right form"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    failed = out.where("not passed").groupBy("book_id").agg(F.min("gate").alias("_first"))
    return out.join(failed, "book_id", "left").where("_first is null or gate <= _first").drop("_first")


def report(checks: DataFrame) -> DataFrame:
    """(book_id, ok, report)."""
    line = F.struct("gate", "label", F.concat(F.when(F.col("passed"), "[PASS] ").otherwise("[FAIL] "), "label", F.coalesce(F.concat(F.lit(": "), F.nullif("note", F.lit(""))), F.lit(""))).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "\n")
    return checks.groupBy("book_id").agg(F.bool_and("passed").alias("ok"), text.alias("report"))
