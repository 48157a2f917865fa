"""State of books: an append-only table of events folded into phases, chapter states and next actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHASES = ("ingested", "analyzing", "synthesized", "author_modeled", "verified", "packed")


def now():
    """UTC at second precision, as text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def event(books: DataFrame, kind: str, chapter_id: str | None = None, message: str = "") -> DataFrame:
    """Rows to append to the events: (book_id, at, kind, chapter_id, message)."""
    return books.select("book_id", now().alias("at"), F.lit(kind).alias("kind"), F.lit(chapter_id).cast("string").alias("chapter_id"), F.lit(message).alias("message"))


def chapter_status(chapters: DataFrame, events: DataFrame) -> DataFrame:
    """(book_id, chapter_id, title, file, hash, parts_total, status, committed_at): pending until a commit event."""
    done = events.where("kind = 'commit-chapter'").groupBy("book_id", "chapter_id").agg(F.max("at").alias("committed_at"))
    rows = chapters.join(done, ["book_id", "chapter_id"], "left")
    return rows.select("book_id", "chapter_id", "title", "file", "hash", "parts_total", F.when(F.col("committed_at").isNotNull(), "committed").otherwise("pending").alias("status"), "committed_at")


def phases(books: DataFrame, events: DataFrame) -> DataFrame:
    """(book_id, phase): the furthest phase that the events reach; a commit after the synthesis takes nothing back."""
    step = F.when(F.col("kind") == "commit-chapter", 1).when(F.col("kind") == "commit-synthesis", 2).when(F.col("kind") == "commit-author-model", 3).when(F.col("kind") == "verify", 4).when(F.col("kind") == "pack", 5).otherwise(0)
    far = events.groupBy("book_id").agg(F.max(step).alias("step"))
    names = F.array(*[F.lit(p) for p in PHASES])
    return books.join(far, "book_id", "left").select("book_id", F.element_at(names, F.coalesce("step", F.lit(0)) + 1).alias("phase"))


def progress(status: DataFrame, synthesized: DataFrame) -> DataFrame:
    """(book_id, committed, total, next_pending, complete, next_action); synthesized: books with a committed synthesis."""
    # ids of more digits come after those of fewer: ch1000 after ch999
    pending = F.min(F.when(F.col("status") != "committed", F.struct(F.length("chapter_id"), "chapter_id", "parts_total")))
    rows = status.groupBy("book_id").agg(F.count_if(F.col("status") == "committed").alias("committed"), F.count(F.lit(1)).alias("total"), pending.alias("p"))
    rows = rows.join(synthesized.select("book_id", F.lit(True).alias("s")).distinct(), "book_id", "left").withColumn("s", F.coalesce("s", F.lit(False)))
    part = F.when(F.col("p.parts_total") > 1, F.format_string(" --part 1/%d", F.col("p.parts_total"))).otherwise("")
    action = F.when(F.col("p").isNotNull(), F.concat(F.lit("read chapter "), F.col("p.chapter_id"), part, F.lit(", then commit its card"))).when(~F.col("s"), F.lit("commit the synthesis")).otherwise(F.lit("render and pack"))
    return rows.select("book_id", "committed", "total", F.col("p.chapter_id").alias("next_pending"), (F.col("p").isNull() & F.col("s")).alias("complete"), action.alias("next_action"))


def render(status: DataFrame, phase: DataFrame, done: DataFrame) -> DataFrame:
    """(book_id, report)."""
    line = F.concat(F.lit("  ["), F.when(F.col("status") == "committed", "x").otherwise(" "), F.lit("] "), "chapter_id", F.lit("  "), F.col("parts_total").cast("string"), F.lit(" parts  "), "title")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.length("chapter_id").alias("size"), F.col("chapter_id"), line.alias("line")))), lambda s: s["line"])
    rows = status.groupBy("book_id").agg(F.array_join(ordered, "\n").alias("chapters"))
    rows = rows.join(phase, "book_id").join(done, "book_id")
    return rows.select("book_id", F.concat(F.lit("Phase: "), "phase", F.lit("\nChapters: "), F.col("committed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit("\n"), "chapters", F.lit("\nNext: "), "next_action").alias("report"))
