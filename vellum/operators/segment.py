"""Books into chapters: headings, level choice, front matter, dividers and numbering.

Input: (book_id, text). Each strategy (headings, spelled-out chapters) yields candidates; a gate accepts or passes on.
"""

from __future__ import annotations

import re
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

# The titles and patterns below are part of the data format.
PREFACE = "Materiale introduttivo"
WHOLE_BOOK = "Libro completo"
HEADING = "(?U)^\\s{0,3}(#{1,6})\\s+(.+?)\\s*$"
SPELLED = "(?iU)^\\s*(capitolo|chapter|parte|part)\\s+([0-9]+|[ivxlcdm]+|[a-zàèéìòù]+)\\b.*$"
FRONT_MATTER = (
    "(?iU)^\\s*(indice|sommario|copyright|frontespizio|il libro|l['’]autore|colophon|"
    "bibliografia|ringraziamenti|nota dell['’]autore|indice dei nomi|note|"
    "contents|landmarks|table of contents|index|"
    "letture di approfondimento|per approfondire|approfondimenti|"
    "indice analitico|indice delle figure|indice delle tavole|"
    "elenco delle abbreviazioni|abbreviazioni|glossario|crediti|"
    "fonti delle illustrazioni|riferimenti bibliografici|"
    "bibliography|further reading|acknowledg(e)?ments|glossary)\\b"
)
TITLE_LEN, PREFACE_LEN, DIVIDER_LEN, BODY_LINE = 160, 300, 200, 80
MIN_SEGMENTS, MAX_SEGMENTS, MIN_MEDIAN = 2, 80, 700


def book_lines(books: DataFrame) -> DataFrame:
    """(book_id, pos, line, start, total): start is the line's offset, total the book's characters, both with line ends."""
    rows = books.select("book_id", F.posexplode(T.lines(T.normalize_whitespace(F.coalesce("text", F.lit(""))))).alias("pos", "line"))
    w = Window.partitionBy("book_id")
    size = F.length("line") + 1
    return rows.withColumns({"start": F.coalesce(F.sum(size).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum(size).over(w)})


def headings(lines: DataFrame) -> DataFrame:
    """(book_id, pos, level, title, start, total) of Markdown headings with a title of up to 160 characters."""
    rows = lines.where(F.col("line").rlike(HEADING))
    rows = rows.select("book_id", "pos", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), T.strip(F.regexp_extract("line", HEADING, 2)).alias("title"), "start", "total")
    return rows.where(F.length("title").between(1, TITLE_LEN))


def level_stats(heads: DataFrame) -> DataFrame:
    """(book_id, level, n, median_len): segments that a heading level would cut, and their median length."""
    after = F.lead("start").over(Window.partitionBy("book_id", "level").orderBy("pos"))
    sized = heads.withColumn("len", F.coalesce(after, F.col("total")) - F.col("start") - 1)
    return sized.groupBy("book_id", "level").agg(F.count(F.lit(1)).alias("n"), F.median("len").alias("median_len"))


def choose_level(heads: DataFrame) -> DataFrame:
    """(book_id, level): the shallowest with a fit count and median length, else the shallowest with a fit count."""
    fit = level_stats(heads).where(F.col("n").between(MIN_SEGMENTS, MAX_SEGMENTS))
    strict = F.min(F.when(F.col("median_len") >= MIN_MEDIAN, F.col("level")))
    return fit.groupBy("book_id").agg(F.coalesce(strict, F.min("level")).alias("level"))


def renumber(chapters: DataFrame) -> DataFrame:
    """Adds ord: 1 and up by seq; what the flag is_preface marks is 0, whatever its title."""
    intro = F.col("is_preface")
    n = F.sum(F.when(intro, 0).otherwise(1)).over(Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return chapters.withColumn("ord", F.when(intro, F.lit(0)).otherwise(n).cast("int"))


def with_ids(chapters: DataFrame) -> DataFrame:
    """Adds chapter_id, file and hash."""
    return chapters.withColumns({"chapter_id": F.format_string("ch%03d", F.col("ord")), "file": T.chapter_file_name("ord", "title"), "hash": T.sha256_tag("text")})


_BLANK = "[ \\xa0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]"  # as HEADING's white space within a line of a normalized text
_HEADING = re.compile(f"{_BLANK}{{0,3}}#{{1,6}}{_BLANK}+.+")
_ENDS = "[\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
_FOUND = S.StructType([
    S.StructField("dropped", S.BooleanType()), S.StructField("seq", S.IntegerType()), S.StructField("title", S.StringType()), S.StructField("text", S.StringType()),
    S.StructField("is_preface", S.BooleanType()), S.StructField("n_merged", S.IntegerType()), S.StructField("ord", S.IntegerType()),
])


def _divides(text: str) -> bool:
    """Under 200 characters and no body line over 80."""
    return len(text) < DIVIDER_LEN and not any(len(x) > BODY_LINE and not _HEADING.match(l) for l in text.splitlines() if (x := l.strip()))


def _level(heads: list[dict], total: int) -> int | None:
    """``choose_level`` of one book."""
    starts: dict[int, list[int]] = {}
    for h in heads:
        starts.setdefault(h["level"], []).append(h["start"])
    fit = {}
    for level, at in starts.items():
        if MIN_SEGMENTS <= len(at) <= MAX_SEGMENTS:
            fit[level] = median(b - a - 1 for a, b in zip(at, [*at[1:], total]))
    return min((k for k, m in fit.items() if m >= MIN_MEDIAN), default=min(fit, default=None))


def _parts(lines: list[str], bounds: list[tuple[int, str, bool]]) -> list[tuple[int, str, str, bool, bool]]:
    """The stretches of one book that bounds (pos, title, is front matter) open: (seq, title, text, is_preface, is front matter).

    What is before the first bound has seq 0.
    """
    out = [(0, PREFACE, "\n".join(lines[: bounds[0][0]]).strip(), True, False)] if bounds[0][0] else []
    for i, (pos, title, front) in enumerate(bounds):
        end = bounds[i + 1][0] if i + 1 < len(bounds) else len(lines)
        out.append((i + 2, title, "\n".join(lines[pos:end]).strip(), False, front))
    return out


def _merged(parts: list[tuple[int, str, str, bool, bool]]) -> list[tuple[int, str, str, bool, int]]:
    """(seq, title, text, is_preface, n_merged): dividers go to the part before them; leading ones to the part after.

    A part that is no divider opens a group; leading dividers go to the group after them if they are a divider as a
    whole and there is such a group.
    """
    groups: list[list[tuple]] = []
    lead = False
    for p in parts:
        opens = not _divides(p[2])
        if opens or not groups:
            lead = lead or not opens
            groups.append([])
        groups[-1].append(p)
    texts = ["\n\n".join(p[2] for p in g).strip() for g in groups]
    if lead and len(groups) > 1 and _divides(texts[0]):
        texts[:2] = ["\n\n".join(texts[:2])]
        groups[:2] = [[*groups[1], *groups[0]]]
    return [(g[0][0], g[0][1], t.strip(), g[0][3], len(g) - 1) for g, t in zip(groups, texts)]


def _split_book(text: str, marks: list[dict], drop_front_matter: bool) -> tuple[list[tuple], list[tuple]] | None:
    """(chapters, dropped) of one book by the first strategy that passes its gate; None if neither does."""
    lines = text.split("\n") if text else []
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    heads = [m | {"start": starts[m["pos"]]} for m in marks if m["level"] and 1 <= len(m["title"]) <= TITLE_LEN]
    level = _level(heads, at)
    spelled = [(m["pos"], m["spelled"], m["spelled_front"]) for m in marks if m["spelled"] is not None]
    ways = (("headings", [(h["pos"], h["title"], h["front"]) for h in heads if h["level"] == level]), ("spelled", spelled if len(spelled) >= 2 else []))
    for way, bounds in ways:
        if not bounds:
            continue
        parts = _parts(lines, bounds)
        front = [p for p in parts if drop_front_matter and p[4]]
        merged = _merged([p for p in parts if not (drop_front_matter and p[4]) and (not p[3] or len(p[2]) > PREFACE_LEN)])
        if len(merged) >= 2 or (way == "headings" and any(len(m[2]) >= DIVIDER_LEN for m in merged)):
            return merged, front
    return None


def split_chapters(books: DataFrame, drop_front_matter: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chapters, dropped): chapters have book_id, seq, ord, chapter_id, title, text, file, hash, n_merged and is_preface.

    Headings win if they leave two chapters, or one of 200 characters; else lines such as "Chapter 2" if they leave
    two; else the book is one chapter. A book is cut where its row is, in one pass and without a shuffle: the JVM marks
    the lines that may open a chapter, a worker chooses the level, cuts and merges.
    """
    books.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # books may be long
    text = T.normalize_whitespace(F.coalesce("text", F.lit("")))
    rows = books.select("book_id", text.alias("text")).select("book_id", "text", F.regexp_replace("text", _ENDS, "\n").alias("plain"))
    maybe = "^[\\s\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]*+(?:#|(?iu:[cp]))"
    found = F.filter(F.transform(F.split("plain", "\n"), lambda l, i: F.struct(i.alias("pos"), l.alias("line"))), lambda m: m["line"].rlike(maybe) & (m["line"].rlike(HEADING) | m["line"].rlike(SPELLED)))

    def mark(m):
        line = m["line"]
        title, spelled = T.strip(F.regexp_extract(line, HEADING, 2)), F.when(line.rlike(SPELLED), T.strip(line))
        return F.struct(m["pos"].alias("pos"), F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), title.alias("title"), title.rlike(FRONT_MATTER).alias("front"), spelled.alias("spelled"), spelled.rlike(FRONT_MATTER).alias("spelled_front"))

    rows = rows.select("book_id", "text", F.when(F.col("plain") != F.col("text"), F.col("plain")).alias("plain"), F.transform(found, mark).alias("marks"))

    def run(batches):
        for batch in batches:
            out, cols = [], batch.select(["text", "plain", "marks"]).to_pydict()
            at = []
            for i in range(batch.num_rows):
                whole = cols["text"][i]
                split = _split_book(whole if cols["plain"][i] is None else cols["plain"][i], cols["marks"][i], drop_front_matter)
                chapters, front = split or ([(1, WHOLE_BOOK, whole, False, 0)], [])
                ord_ = 0
                for seq, title, text, is_preface, n_merged in chapters:
                    ord_ += not is_preface
                    out.append((False, seq, title, text, is_preface, n_merged, 0 if is_preface else ord_))
                out += [(True, seq, title, text, is_preface, 0, 0) for seq, title, text, is_preface, _ in front]
                at += [i] * (len(out) - len(at))
            ids = batch.column("book_id").take(pa.array(at, pa.int64()))
            step = 256  # rows of a batch that is sent back, so that it stays small
            names = [f.name for f in _FOUND.fields]
            types = [pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
            for i in range(0, len(out), step):
                columns = list(zip(*out[i : i + step]))
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(columns[0])), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["book_id", *names])

    cut_up = rows.mapInArrow(run, S.StructType([rows.schema["book_id"], *_FOUND.fields]))
    kept = cut_up.where(~F.col("dropped")).select("book_id", "seq", "title", "text", "is_preface", "n_merged", "ord")
    return with_ids(kept), cut_up.where("dropped").select("book_id", "title", "text", "seq")
