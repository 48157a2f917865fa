"""Text functions against Python's own string methods."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.functions import html, italian
from vellum.functions import text as T

SAMPLES = ["", " ", "Il Dialogo: prima parte!", "a\r\nb\rc\n\n\n\n\nd", "\t x  y  ", "perché Città ﬁ ²", "### Titolo\ntesto", "\x1c a\x85b c", "ÀÈ" * 60, "æ ß ø", "a-\nb A-\nb é-\n  à", '"l\'autore" (x) NEAR:^*\\', "\n\n\n", "# \n##\n x", "😀 x"]


def ascii_of(s):
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def normalized(s):
    s = re.sub(r"[ \t]+", " ", s.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{4,}", "\n\n\n", s).strip()


def slug(s, n=80):
    return re.sub(r"_+", "_", re.sub(r"[^a-zA-Z0-9]+", "_", ascii_of(s)).strip("_").lower())[:n].strip("_") or "untitled"


def first(s):
    return next((x[:120] for x in (y.strip().lstrip("#").strip() for y in s.splitlines()) if x), "none")


@pytest.mark.parametrize(("column", "want"), [
    (lambda c: T.normalize_whitespace(c), normalized),
    (lambda c: T.slugify(c), slug),
    (lambda c: T.first_line(c, "none"), first),
    (lambda c: T.norm_anchor(c), lambda s: re.sub(r"\s+", " ", ascii_of(s).lower()).strip()),
    (lambda c: T.dehyphenate(c), lambda s: re.sub(r"([a-zà-ÿ])-\n\s*([a-zà-ÿ])", r"\1\2", s)),
    (lambda c: T.lines(c), lambda s: s.splitlines()),
    (lambda c: T.query_tokens(c), lambda s: re.sub(r'["():^*\\]', " ", s).split()),
    (lambda c: T.strip(c), str.strip),
])
def test_like_python(spark, column, want):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string").select("s", column(F.col("s")).alias("got")).collect()
    for r in rows:
        assert r["got"] == want(r["s"]), repr(r["s"])


def test_small_ones(spark):
    df = spark.createDataFrame([("iv.", " 12 ", "x" * 300, "a \"b\" NOT c")], "a string, b string, c string, d string")
    r = df.select(T.is_numeral("a"), T.is_page_number("b"), T.excerpt("c"), T.sanitize_query("d"), T.chapter_file_name(F.lit(3), F.lit("Il dialogo")), T.search_terms(F.lit("L'Autore_è x-1"))).first()
    assert list(r) == [True, True, "x" * 220 + "...", '"a" OR "b" OR "NOT" OR "c"', "003_il_dialogo.md", ["l", "autore", "e", "x", "1"]]


def test_sql_functions(spark):
    T.register(spark)
    r = spark.sql("SELECT norm_anchor('  Però  SÌ '), slugify('Città — prima'), stem_it('dialoghi'), html_to_md('<h1>A</h1><p>b')").first()
    assert list(r) == ["pero si", "citta_prima", "dialog", "# A\n\nb"]


def test_stems():
    for a, b in (("dialogo", "dialoghi"), ("libro", "libri"), ("parlando", "parlare"), ("pensatore", "pensatori"), ("velocemente", "veloce"), ("perche", "perche")):
        assert italian.stem(a) == italian.stem(b)
    assert italian.stem("pronunciamento") == "pronunc" and italian.stem("abbandonata") == "abbandon"


def test_html():
    table = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr><tr><td> </td></tr></table>"
    assert html.markdown(f"<p>alfa</p>{table}")[0] == "alfa\n\n| A | B |\n|---|---|\n| 1 | |"
    assert html.markdown("<p>10<sup>2</sup> m</p>")[0] == "10^2 m"
    text, notes = html.markdown('<p>Fine<sup><a href="#n">12</a></sup>.</p><div id="n">La nota</div>')
    assert text == "Fine [n.12] ." and notes == [{"ref": "12", "text": "La nota"}]
    assert html.markdown("<blockquote><p>q</p></blockquote><ul><li>uno</li></ul><p>iv</p><h3>t</h3><script>x</script>")[0] == "q\n\n- uno\n\n### t"
    assert html.markdown("plain <b>text</b>")[0] == "plain \ntext"
    assert html.markdown("")[0] == ""


def test_html_writes_each_text_once():
    assert html.markdown("<li>a<ul><li>b</li></ul> tail</li><li><p>end</p></li>")[0] == "- a tail\n\n- b\n\n- end"
    assert html.markdown("<blockquote>o<blockquote><p>i</p></blockquote></blockquote><h2><p>t</p></h2>")[0] == "o i\n\n## t"
    assert html.markdown("<p>one<p>two</p>three")[0] == "one three\n\ntwo"
    assert html.markdown("<table><tr><td>a<table><tr><td>b</td></tr></table></td><td></td></tr></table>")[0] == "| a b | |\n|---|---|"
    text, notes = html.markdown('<p>x<a class="FN" href="#f">1</a> y<a class="fn" href="#">2</a><a class="fn">z</a><sup></sup></p><p id="f">see <sup>a</sup></p><style>p</style>')
    assert text == "x [n.1] y [n.2] z" and notes == [{"ref": "1", "text": "see ^a"}, {"ref": "2", "text": ""}]
    text, notes = html.markdown('<p>x<sup><a href="#me">1</a></sup></p><div id="me"><p>note<sup><a href="#no">9</a></sup></p></div>')
    assert text == "x [n.1]" and [n["ref"] for n in notes] == ["1"]


def test_long_texts(spark):
    """Long runs of blanks, marks and blank lines, whose cost must not grow with their square."""
    texts = [" " * 200_000 + "x" + " \t\n" * 70_000 + "y", "-" * 100_000 + "é a" * 70 + "!" * 100_000, "\n# \n" * 50_000 + "##  last \x1f" + "z" * 130, "\u2003" * 100_000, "a" * 81 + "-b", 'a"b (c)\u3000\x85d^' * 3]
    rows = spark.createDataFrame([(s,) for s in texts], "s string")
    got = rows.select("s", T.strip("s"), T.normalize_whitespace("s"), T.slugify("s"), T.first_line("s", "none"), T.norm_anchor("s"), T.sanitize_query("s"), T.excerpt("s")).collect()
    for r in got:
        s = r["s"]
        quoted = " OR ".join(f'"{w}"' for w in re.sub(r'["():^*\\]', " ", s).split())
        cut = s.replace("\n", " ")
        assert list(r)[1:] == [s.strip(), normalized(s), slug(s), first(s), re.sub(r"\s+", " ", ascii_of(s).lower()).strip(), quoted, cut if len(cut) <= 220 else cut[:220] + "..."]
