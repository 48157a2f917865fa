"""Text functions, Column to Column. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the separators that only Python's strip() takes.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ODD = "[\\t-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_SPACE = f"[ {_ODD[1:]}"
#: Line ends as str.splitlines() has them.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: What a full-text query reads as syntax.
_SYNTAX = '["():^*\\\\]'


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.btrim(col(x), F.lit(SPACES))


def normalize_whitespace(x: Column | str) -> Column:
    """Line ends to LF, runs of blanks and tabs to one blank, four or more LF to three, ends stripped."""
    x = F.replace(F.replace(F.replace(col(x), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(x, "  +", " "), "\n\n\n\n+", "\n\n\n"))


def decompose(x: Column | str, compatible: bool) -> Column:
    """Unicode NFKD (compatible) or NFD, by the ICU that Spark ships. Select it into a column before joining on it."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(col(x), F.lit("")), F.lit(compatible))


def to_ascii(x: Column | str) -> Column:
    """NFKD without what isn't ASCII."""
    return F.regexp_replace(decompose(x, True), "[^\\x00-\\x7F]", "")


def slugify(x: Column | str, max_len: int = 80) -> Column:
    # as many letters and digits as the result may have and one more, so that not all of a long text is rewritten
    x = F.regexp_extract(to_ascii(x), f"\\A[^a-zA-Z0-9]*+((?:[a-zA-Z0-9][^a-zA-Z0-9]*+){{0,{max_len + 1}}}+)", 1)
    x = F.lower(F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.regexp_replace(F.regexp_replace(F.left(x, F.lit(max_len)), "^_+|_+$", ""), "\\A\\z", "untitled")


def chapter_file_name(order: Column | str, title: Column | str) -> Column:
    return F.format_string("%03d_%s.md", col(order).cast("int"), slugify(title, 60))


def lines(x: Column | str) -> Column:
    """The text's lines; an empty text has none, and a line end at its end opens no line."""
    x = col(x)
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, f"(?:{LINE_END})\\z", ""), LINE_END, -1))


def first_line(x: Column | str, fallback: str) -> Column:
    """The first line that isn't blank or only number signs, at most 120 characters."""
    ends = LINE_END.partition("[")[2][:-1]
    blank = f"[{_SPACE}&&[^{ends}]]"
    line = strip(F.regexp_extract(col(x), f"(?:\\A|[{ends}]){blank}*+#*+{blank}*+([^{ends}]++)", 1))
    return F.coalesce(F.left(F.nullif(line, F.lit("")), F.lit(120)), F.lit(fallback))


def norm_anchor(x: Column | str) -> Column:
    """The form in which quotations are compared: ASCII, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(to_ascii(x)), "[\\t-\\r\\x1c-\\x1f]", " "), "  +", " "))


def dehyphenate(x: Column | str) -> Column:
    """Joins a word parted at a line's end if both parts are in lower case."""
    return F.regexp_replace(col(x), "(?U)([a-zà-ÿ])-\\n\\s*([a-zà-ÿ])", "$1$2")


def is_page_number(x: Column | str) -> Column:
    return col(x).rlike("(?U)^\\s*[\\divxlcdmIVXLCDM]{1,6}\\s*$")


def is_numeral(x: Column | str) -> Column:
    """A block that is only a short number or Roman numeral."""
    return col(x).rlike("(?U)^[\\divxlcdmIVXLCDM]{1,4}[.\\):]?$")


def query_tokens(x: Column | str) -> Column:
    """A question's words, without what a full-text query would read as syntax."""
    x = F.regexp_replace(F.coalesce(col(x), F.lit("")), _SYNTAX, " ")
    return F.filter(F.split(x, f"{_SPACE}+"), lambda t: t != "")


def sanitize_query(x: Column | str) -> Column:
    x = F.regexp_replace(F.coalesce(col(x), F.lit("")), f"{_SYNTAX}|{_ODD}", " ")
    quoted = F.concat(F.lit('"'), F.replace(F.trim(F.regexp_replace(x, "  +", " ")), F.lit(" "), F.lit('" OR "')), F.lit('"'))
    return F.regexp_replace(quoted, '\\A""\\z', "")


def excerpt(x: Column | str, size: int = 220) -> Column:
    x = col(x)
    head = F.translate(F.left(x, F.lit(size)), "\n", " ")
    return F.when(F.length(x) > size, F.concat(head, F.lit("..."))).otherwise(head)


def sha256_tag(x: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(x).cast("binary"), 256))


def search_terms(x: Column | str) -> Column:
    """The index's terms: letters and digits of the accent-free text in lower case."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(decompose(x, False), "\\p{Mn}", "")), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def words(x: Column | str) -> Column:
    """Letters, digits and underscores of the text in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("(?U)\\w+"), F.lit(0))


def register(spark) -> None:
    """Makes the functions that SQL users need callable as norm_anchor, slugify, html_to_md and stem_it."""
    from . import html, italian

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION to_ascii(x STRING) RETURN regexp_replace(reflect('com.ibm.icu.text.Normalizer', 'decompose', coalesce(x, ''), true), '[^\\\\x00-\\\\x7F]', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm_anchor(x STRING) RETURN trim(regexp_replace(lower(to_ascii(x)), '[\\\\s\\\\x0b\\\\x1c-\\\\x1f]+', ' '))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION slugify(x STRING) RETURN coalesce(nullif(regexp_replace(left(lower(regexp_replace(regexp_replace(to_ascii(x), '[^a-zA-Z0-9]+', '_'), '^_+|_+$', '')), 80), '^_+|_+$', ''), ''), 'untitled')")
    spark.udf.register("stem_it", italian.stem_udf)
    spark.udf.register("html_to_md", html.markdown_udf)
