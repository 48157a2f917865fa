"""Chapters into overlapping chunks and reading parts: folds over a chapter's paragraphs in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TARGET, OVERLAP, PART = 2200, 250, 20_000
_STATE = "struct<buf:string,out:array<string>>"


def paragraphs(text):
    """Stretches between blank lines, stripped; blank ones don't count."""
    return F.filter(F.transform(F.split(text, "(?U)\\n\\s*\\n"), T.strip), lambda p: p != "")


def chunk_texts(text, target: int = TARGET, overlap: int = OVERLAP):
    """The chunks of a chapter's text.

    Paragraphs are joined while they fit. One that doesn't fit closes the chunk and opens the next after the last
    ``overlap`` characters of the closed one; it is cut to size only if no chunk is open.
    """
    empty = F.array().cast("array<string>")

    def state(buf, out):
        return F.struct(buf.alias("buf"), out.alias("out")).cast(_STATE)

    def step(s, p):
        buf, out = s["buf"], s["out"]
        joined = F.when(buf == "", p).otherwise(F.concat(buf, F.lit("\n\n"), p))
        tail = T.strip(F.concat(F.right(buf, F.lit(overlap)) if overlap else F.lit(""), F.lit("\n\n"), p))
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / target).cast("int")), lambda i: F.substring(p, i * target + 1, F.lit(target)))
        return F.when(F.length(buf) + F.length(p) + 2 <= target, state(joined, out)).when(buf != "", state(tail, F.concat(out, F.array(buf)))).otherwise(state(F.lit(""), F.concat(out, cuts)))

    def finish(s):
        return F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"])))

    return F.aggregate(paragraphs(text), state(F.lit(""), empty), step, finish)


def chunks(chapters: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(book_id, id, chapter_id, chapter_title, ord, text, summary, keywords, chapter_hash).

    Ids count within the chapter; ord counts within the book, by (chapter ord, position). The fold runs on each
    chapter where it is; only chunk counts are summed over a book.
    """
    cut = chapters.withColumn("_texts", chunk_texts(F.col("text"), target, overlap))
    before = F.coalesce(F.sum(F.size("_texts")).over(Window.partitionBy("book_id").orderBy("ord", "chapter_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cut.withColumn("_before", before).select("book_id", "chapter_id", F.col("title").alias("chapter_title"), F.col("hash").alias("chapter_hash"), "_before", F.posexplode("_texts").alias("_pos", "text"))
    name = F.format_string("chunk_%s_%04d", F.col("chapter_id"), F.col("_pos") + 1)
    return rows.select("book_id", name.alias("id"), "chapter_id", "chapter_title", (F.col("_before") + F.col("_pos") + 1).cast("int").alias("ord"), "text", F.lit("").alias("summary"), F.array().cast("array<string>").alias("keywords"), F.coalesce("chapter_hash", F.lit("")).alias("chapter_hash"))


def part_texts(text, size: int = PART):
    """A chapter's reading parts: cut at blank lines where possible, hard where a paragraph is longer than a part."""
    pieces = F.regexp_extract_all(text, F.lit("(?U)(?s)\\n\\s*\\n|(?:(?!\\n\\s*\\n).)+"), F.lit(0))
    empty = F.array().cast("array<string>")

    def state(buf, out):
        return F.struct(buf.alias("buf"), out.alias("out")).cast(_STATE)

    def step(s, p):
        full = (s["buf"] != "") & (F.length(s["buf"]) + F.length(p) > size)
        buf = F.when(full, F.regexp_replace(p, "^\\n+", "")).otherwise(F.concat(s["buf"], p))
        out = F.when(full, F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"])
        n = F.when(F.length(buf) > size, F.floor((F.length(buf) - 1) / size).cast("int")).otherwise(F.lit(0))
        cuts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(buf, i * size + 1, F.lit(size)))).otherwise(empty)
        return state(F.substring(buf, n * size + 1, F.lit(size)), F.concat(out, cuts))

    def finish(s):
        return F.when(T.strip(s["buf"]) == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"])))

    parts = F.aggregate(pieces, state(F.lit(""), empty), step, finish)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.when(F.size(parts) == 0, F.array(text)).otherwise(parts))


def parts(chapters: DataFrame, size: int = PART) -> DataFrame:
    """(book_id, chapter_id, part, parts_total, text)."""
    rows = chapters.withColumn("_parts", part_texts(F.col("text"), size))
    return rows.select("book_id", "chapter_id", F.size("_parts").alias("parts_total"), F.posexplode("_parts").alias("_pos", "text")).select("book_id", "chapter_id", (F.col("_pos") + 1).alias("part"), "parts_total", "text")


def read_part(parts_df: DataFrame, chapter_id: str, part: str | None = None) -> DataFrame:
    """A chapter's part named "i/k" (all parts without a name); k must be the chapter's number of parts and 1 <= i <= k."""
    rows = parts_df.where(F.col("chapter_id") == chapter_id)
    if part is None:
        return rows
    i, slash, k = part.partition("/")
    if not (slash and i.isdigit() and k.isdigit() and 1 <= int(i) <= int(k)):
        raise ValueError(f"a part is named i/k, not {part}")
    return rows.where((F.col("part") == int(i)) & (F.col("parts_total") == int(k)))
