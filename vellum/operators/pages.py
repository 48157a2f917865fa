"""Pages of a printed source: running lines, page numbers, hyphens, offsets and as-of page lookup.

Input: (book_id, page_number, text). A page's lines are exploded; a book's are never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

EDGE, MIN_REPEATS, MAX_LEN = 2, 4, 60


def page_lines(pages: DataFrame, edge: int = EDGE) -> DataFrame:
    """(book_id, page_number, pos, line, trimmed, is_edge): is_edge for the first and last lines that aren't blank."""
    rows = pages.select("book_id", "page_number", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("pos", "line")).withColumn("trimmed", T.strip("line"))
    w = Window.partitionBy("book_id", "page_number")
    full = F.when(F.col("trimmed") != "", 1).otherwise(0)
    up = F.sum(full).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_up": up, "_all": F.sum(full).over(w)})
    is_edge = (F.col("trimmed") != "") & ((F.col("_up") <= edge) | (F.col("_up") > F.col("_all") - edge))
    return rows.withColumn("is_edge", is_edge).drop("_up", "_all")


def running_lines(lines: DataFrame, min_repeats: int = MIN_REPEATS, max_len: int = MAX_LEN) -> DataFrame:
    """(book_id, line, n_pages): short edge lines on min_repeats pages or more."""
    once = lines.where(F.col("is_edge") & (F.length("trimmed") <= max_len)).select("book_id", "page_number", F.col("trimmed").alias("line")).distinct()
    return once.groupBy("book_id", "line").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_repeats)


def clean_lines(lines: DataFrame, running: DataFrame) -> DataFrame:
    """Lines without page numbers anywhere and without running lines at the edges."""
    kept = lines.where((F.col("trimmed") == "") | ~T.is_page_number("trimmed"))
    run = running.select("book_id", F.col("line").alias("trimmed"), F.lit(True).alias("is_edge"))
    return kept.join(run, ["book_id", "trimmed", "is_edge"], "left_anti")


def clean_pages(pages: DataFrame) -> DataFrame:
    """(book_id, page_number, text): cleaned, joined and normalized; blank pages stay, with empty text."""
    lines = page_lines(pages)
    kept = clean_lines(lines, running_lines(lines))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")
    joined = kept.groupBy("book_id", "page_number").agg(text.alias("text"))
    out = pages.select("book_id", "page_number").join(joined, ["book_id", "page_number"], "left")
    return out.withColumn("text", F.coalesce(T.normalize_whitespace(T.dehyphenate("text")), F.lit("")))


def page_offsets(cleaned: DataFrame) -> DataFrame:
    """(book_id, offset, page): where each page that isn't blank starts in the book's text, pages joined by a blank line."""
    before = Window.partitionBy("book_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = cleaned.where("text <> ''")
    return rows.select("book_id", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("long").alias("offset"), F.col("page_number").alias("page"))


def book_text(cleaned: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda s: s["text"]), "\n\n")
    return cleaned.where("text <> ''").groupBy("book_id").agg(text.alias("text"))


def page_at(points: DataFrame, offsets: DataFrame, point: str = "offset", out: str = "page") -> DataFrame:
    """Adds the page in force at each point: the last whose offset isn't past it, else null. One sort of both by book.

    A union and a running last value, so no range join and no array of a book's pages.
    """
    cols = points.columns
    events = points.select("book_id", F.col(point).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(offsets.schema["page"].dataType).alias("_page"), F.struct(*cols).alias("_row"))
    marks = offsets.select("book_id", F.col("offset").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("page").alias("_page"), F.lit(None).cast(events.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("book_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.unionByName(marks).withColumn(out, F.last("_page", ignorenulls=True).over(w))
    found = F.when(F.col("_at").isNotNull(), F.col(out))
    return rows.where("_kind = 1").select("_row.*", found.alias(out))


def chunk_pages(chunks: DataFrame, chapters: DataFrame, books: DataFrame, offsets: DataFrame) -> DataFrame:
    """Chunks with page_start and page_end: placed in the book's text by their first and last 60 characters.

    The search begins where the chapter's first 80 characters are. What isn't found keeps nulls.
    """
    place = chapters.select("book_id", "chapter_id", F.col("text").alias("_chapter")).join(books.select("book_id", F.col("text").alias("_full")), "book_id")
    place = place.select("book_id", "chapter_id", "_full", F.expr("locate(left(_chapter, 80), _full)").alias("_base"))
    rows = chunks.drop("page_start", "page_end").join(place, ["book_id", "chapter_id"], "left")
    start = F.expr("locate(left(text, 60), _full, greatest(_base, 1))")
    rows = rows.withColumn("_start", start).withColumn("_probe", F.expr("locate(right(text, 60), _full, _start)"))
    end = F.when(F.col("_probe") > 0, F.col("_probe") + 59).otherwise(F.col("_start") - 1 + F.length("text"))
    rows = rows.withColumns({"_from": F.when(F.col("_start") > 0, F.col("_start") - 1), "_to": F.when(F.col("_start") > 0, end)}).drop("_full", "_base", "_start", "_probe")
    rows = page_at(rows, offsets, "_from", "page_start")
    return page_at(rows, offsets, "_to", "page_end").drop("_from", "_to")
