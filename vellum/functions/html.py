"""HTML to Markdown in one pass over the standard library's parser events, in a pandas UDF.

No tree is built. Each run of text is recorded with the elements it is in, as numbers; a superscript or a link also
leaves an empty run where it begins, to be filled if it turns out to be a note. What a note hides is a set of element
numbers, and a block is all runs that name it as theirs, so each text is written once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

NOTES = ArrayType(StructType([StructField("ref", StringType()), StructField("text", StringType())]))
MARKDOWN = StructType([StructField("text", StringType()), StructField("notes", NOTES)])
# Elements without content, the marks of blocks, and what a block of only a numeral looks like.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARK = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "### ", "li": "- ", "p": "", "blockquote": "", "figcaption": ""}
_NUMERAL = re.compile(r"^[\divxlcdmIVXLCDM]{1,4}[.\):]?$")


@dataclass
class Element:
    name: str
    attrs: dict[str, str]
    above: tuple[int, ...]  # the numbers of the elements it is in, its own last


@dataclass
class Run:
    text: str
    above: tuple[int, ...]
    opens: int | None = None  # the superscript or link that this run stands before


@dataclass
class Page(HTMLParser):
    """A page's runs of text, its blocks and its notes. An end tag closes the nearest open element of its name, and nothing else is implied."""

    source: str
    elements: list[Element] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)
    notes: list[dict] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self._open: list[int] = []
        self._hidden: set[int] = set()
        self.feed(self.source)
        self.close()
        self._resolve_notes()

    # --- events ---

    def handle_starttag(self, tag, attrs):
        number = len(self.elements)
        self.elements.append(Element(tag, {k: v or "" for k, v in attrs}, (*self._open, number)))
        if tag in ("sup", "a"):
            self.runs.append(Run("", tuple(self._open), number))
        if tag in ("script", "style"):
            self._hidden.add(number)
        if tag not in _VOID:
            self._open.append(number)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        names = [self.elements[n].name for n in self._open]
        if tag in names:
            del self._open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.runs.append(Run(data, tuple(self._open)))

    # --- notes ---

    def _shown(self, above: tuple[int, ...]) -> bool:
        return self._hidden.isdisjoint(above)

    def _within(self, number: int) -> list[str]:
        """The stripped texts in an element."""
        return [t for r in self.runs if number in r.above and self._shown(r.above) and (t := r.text.strip())]

    def _note(self, ref: str, href: str) -> None:
        """Keeps a note; the element it is written in goes from the text."""
        named = (n for n, e in enumerate(self.elements) if e.attrs.get("id") == href[1:] and self._shown(e.above))
        target = next(named, None) if re.match("#.", href, re.DOTALL) else None
        self.notes.append({"ref": ref, "text": "" if target is None else one_line(" ".join(self._within(target)))})
        if target is not None:
            self._hidden.add(target)

    def _resolve_notes(self) -> None:
        """Superscripts first: with a link they are notes, [n.REF], else ^TEXT; then links of a note's class whose text is a number."""
        marks = [r for r in self.runs if r.opens is not None]
        for mark in marks:
            if self.elements[mark.opens].name == "sup" and self._shown(self.elements[mark.opens].above):
                text = "".join(self._within(mark.opens))
                link = next((e for e in self.elements if e.name == "a" and mark.opens in e.above and self._shown(e.above)), None)
                if link:
                    self._note(text or "?", link.attrs.get("href", ""))
                    text = f"[n.{text or '?'}]"
                elif text:
                    text = f"^{text}"
                self._hidden.add(mark.opens)
                mark.text = text
        for mark in marks:
            link = self.elements[mark.opens]
            kind = link.attrs.get("class", "").lower()
            if link.name == "a" and ("note" in kind or "fn" in kind) and self._shown(link.above):
                text = "".join(self._within(mark.opens))
                if text.isdigit():
                    self._note(text, link.attrs.get("href", ""))
                    self._hidden.add(mark.opens)
                    mark.text = f"[n.{text}]"

    # --- blocks ---

    def _block_of(self, above: tuple[int, ...]) -> int | None:
        """The block that writes a run: the outermost table or quotation, else the nearest heading, else the nearest list item, the caption or the nearest paragraph."""
        for n in above:
            if self.elements[n].name in ("table", "blockquote"):
                return n
        for names in (("h1", "h2", "h3", "h4"), ("li",), ("figcaption",), ("p",)):
            for n in reversed(above):
                if self.elements[n].name in names:
                    return n
        return None

    def blocks(self, keep_numerals: bool = False) -> list[str]:
        """Markdown of each block, in the order in which they begin."""
        found: dict[int, list[Run]] = {}
        for r in self.runs:
            if r.text.strip() and self._shown(r.above) and (block := self._block_of(r.above)) is not None:
                found.setdefault(block, []).append(r)
        out = []
        for block, runs in sorted(found.items()):
            name = self.elements[block].name
            if name == "table":
                out.append(self._table(block, runs))
                continue
            text = re.sub(r"\s+\^", "^", one_line(" ".join(r.text.strip() for r in runs)))
            if keep_numerals or not _NUMERAL.match(text):
                out.append(text and _MARK[name] + text)
        return [b for b in out if b]

    def _table(self, table: int, runs: list[Run]) -> str:
        """Rows with any text, as wide as the widest; the first is the head."""
        cells: dict[int, list[str]] = {}
        for r in runs:
            inner = r.above[r.above.index(table) + 1 :]
            cell = next((n for n in inner if self.elements[n].name in ("th", "td")), None)
            if cell is not None:
                cells.setdefault(cell, []).append(r.text.strip())
        rows: dict[int, list[str]] = {}
        for n, e in enumerate(self.elements):
            if e.name in ("th", "td") and table in e.above:
                inner = [x for x in e.above[e.above.index(table) + 1 : -1]]
                row = next((x for x in inner if self.elements[x].name == "tr"), None)
                if row is not None and not any(self.elements[x].name in ("th", "td") for x in inner) and self._shown(e.above):
                    rows.setdefault(row, []).append(one_line(" ".join(cells.get(n, []))))
        full = [r for r in rows.values() if any(r)]
        wide = max(map(len, full), default=0)
        lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in full]
        return "\n".join([*lines[:1], *(["|" + "---|" * wide] if lines else []), *lines[1:]])

    def loose(self) -> str:
        """All text, a line a run."""
        return "\n".join(r.text for r in self.runs if r.text and self._shown(r.above))


def one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def normalize(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{4,}", "\n\n\n", text).strip()


def markdown(html: str) -> tuple[str, list[dict]]:
    """(Markdown, notes). Without any block, all text, a line a string."""
    page = Page(html)
    found = page.blocks()
    return normalize("\n\n".join(found) if found else page.loose()), page.notes


@F.pandas_udf(StringType())
def markdown_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else markdown(h)[0])


@F.pandas_udf(MARKDOWN)
def markdown_notes_udf(html: pd.Series) -> pd.DataFrame:
    got = [markdown(h or "") for h in html]
    return pd.DataFrame({"text": [g[0] for g in got], "notes": [g[1] for g in got]})
