"""The published Snowball stemming algorithm for Italian, and its pandas UDF over distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

_V = "aeiouàèìòù"
# The suffixes of the algorithm.
_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_DELETE_R2 = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo "
    "erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo "
    "Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero "
    "ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()
_AFTER_CONSONANT = re.compile(f"[{_V}][^{_V}]")


def _longest(word: str, suffixes: list[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(w: str) -> tuple[int, int, int]:
    n = len(w)
    rv = n
    if n >= 2:
        vowel = [c in _V for c in w]
        if not vowel[1]:
            rv = next((i + 1 for i in range(2, n) if vowel[i]), n)
        elif vowel[0]:
            rv = next((i + 1 for i in range(2, n) if not vowel[i]), n)
        else:
            rv = min(3, n)
    m = _AFTER_CONSONANT.search(w)
    r1 = m.end() if m else n
    m = _AFTER_CONSONANT.search(w, r1)
    return rv, r1, m.end() if m else n


def stem(word: str) -> str:
    w = word.translate(str.maketrans("áéíóú", "àèìòù"))
    w = re.sub("qu", "qU", w)
    w = re.sub(f"(?<=[{_V}])[ui](?=[{_V}])", lambda m: m[0].upper(), w)
    rv, r1, r2 = _regions(w)

    def within(suffix: str, region: int) -> bool:
        return len(w) - len(suffix) >= region

    p = _longest(w, _PRONOUNS)
    if p:
        rest = w[: -len(p)]
        for ends, put in ((("ando", "endo"), ""), (("ar", "er", "ir"), "e")):
            hit = next((e for e in ends if rest.endswith(e)), "")
            if hit and len(rest) - len(hit) >= rv:
                w = rest + put
                break

    def drop(suffix: str, region: int) -> bool:
        nonlocal w
        if suffix and w.endswith(suffix) and within(suffix, region):
            w = w[: -len(suffix)]
            return True
        return False

    before = w
    groups = {
        **dict.fromkeys(_DELETE_R2, "r2"), **dict.fromkeys("azione azioni atore atori".split(), "az"), **dict.fromkeys(("logia", "logie"), "log"),
        **dict.fromkeys("uzione uzioni usione usioni".split(), "u"), **dict.fromkeys(("enza", "enze"), "ente"),
        **dict.fromkeys("amento amenti imento imenti".split(), "rv"), "amente": "amente", "ità": "ità", **dict.fromkeys("ivo ivi iva ive".split(), "iv"),
    }
    s = _longest(w, list(groups))
    kind = groups.get(s)
    if kind == "r2":
        drop(s, r2)
    elif kind == "az":
        if drop(s, r2):
            drop("ic", r2)
    elif kind in ("log", "u", "ente"):
        if within(s, r2):
            w = w[: -len(s)] + kind
    elif kind == "rv":
        drop(s, rv)
    elif kind == "amente":
        if drop(s, r1):
            if drop("iv", r2):
                drop("at", r2)
            else:
                drop(_longest(w, ["os", "ic", "abil"]), r2)
    elif kind == "ità":
        if drop(s, r2):
            drop(_longest(w, ["abil", "ic", "iv"]), r2)
    elif kind == "iv":
        if drop(s, r2) and drop("at", r2):
            drop("ic", r2)
    if w == before:
        drop(_longest(w[rv:], _VERBS), rv)
    if w and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")


@F.pandas_udf(StringType())
def stem_udf(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else stem(t))


def is_italian(language: Column | str) -> Column:
    """Whether a language's first two letters are those of Italian."""
    return F.lower(F.left(F.trim(T.col(language)), F.lit(2))) == "it"


def stemmed_terms(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, pos, term): accent-free stems of the text's words. Each distinct word is stemmed once."""
    found = rows.select(*keys, F.posexplode(T.words(text)).alias("pos", "word"))
    words = found.select("word").distinct().withColumn("_ascii", T.to_ascii("word")).where("_ascii <> ''")
    stems = words.withColumn("term", stem_udf("_ascii")).select("word", "term")
    return found.join(stems, "word").select(*keys, "pos", "term")
