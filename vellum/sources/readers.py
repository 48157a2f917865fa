"""Sources: documents of any supported format, by any path that Spark reads, as (path, text, notes, title, author, error).

Text formats stay in the JVM; containers and markup are parsed in pandas UDFs over their bytes.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import html
from ..operators import pages

PLAIN, MARKUP = ("txt", "md", "markdown"), ("html", "htm")
SCHEMA = StructType([StructField("text", StringType()), StructField("notes", html.NOTES), *[StructField(n, StringType()) for n in ("title", "author", "error")]])
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class ConversionError(RuntimeError):
    """A document that can't be read."""


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank; styles named "heading N" or "titolo N" (1 to 3) become headings. Tables are passed over."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = (name.get(f"{_W}val") if name is not None else "").lower()
    out = []
    for p in body.findall(f"{_W}p"):
        text = "".join("\t" if t.tag == f"{_W}tab" else "\n" if t.tag in (f"{_W}br", f"{_W}cr") else t.text or "" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")).strip()
        if text:
            style = p.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            m = re.search(r"(?:heading|titolo) ([123])", names.get(key, key.lower()))
            out.append("#" * int(m[1]) + " " + text if m else text)
    return html.normalize("\n\n".join(out))


def epub_text(data: bytes) -> tuple[str, list[dict], str | None, str | None]:
    """(text, notes, title, author): documents in the order of the spine; notes are resolved within a document."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in root.iter() if local(e) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        first = lambda name: next((e.text for e in package.iter() if local(e) == name and e.text), None)
        items = {e.get("id"): e.get("href") for e in package.iter() if local(e) == "item"}
        parts, notes = [], []
        for ref in (e.get("idref") for e in package.iter() if local(e) == "itemref"):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(items.get(ref) or "")))
            if name in z.namelist():
                page = html.Page(z.read(name).decode("utf-8", "ignore"))
                notes += page.notes
                if found := page.blocks():
                    parts.append("\n\n".join(found))
        return html.normalize("\n\n".join(parts)), notes, first("title"), first("creator")


def convert(suffix: str, data: bytes) -> dict:
    """A document's fields; error says why there is no text."""
    out = {"text": None, "notes": [], "title": None, "author": None, "error": None}
    try:
        if suffix in PLAIN:
            out["text"] = html.normalize(data.decode("utf-8", "ignore"))
        elif suffix in MARKUP:
            out["text"], out["notes"] = html.markdown(data.decode("utf-8", "ignore"))
        elif suffix == "docx":
            out["text"] = docx_text(data)
        elif suffix == "epub":
            out["text"], out["notes"], out["title"], out["author"] = epub_text(data)
        elif suffix in ("mobi", "azw3"):
            raise ConversionError("convert it to epub first")
        else:
            raise ConversionError(f"format {suffix} isn't supported")
    except Exception as e:  # one broken document must not end the others' job
        out["error"] = f"{type(e).__name__}: {e}"[:1000]
    return out


def pdf_pages(data: bytes) -> list[str]:
    """Raw text of each page, by a reader that may not be installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ConversionError("no reader of PDF is installed") from None
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


@F.pandas_udf(SCHEMA)
def convert_udf(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([convert(s, bytes(c)) for s, c in zip(suffix, content, strict=True)], columns=["text", "notes", "title", "author", "error"])


_NAME = "([^/]+?)(\\.[^./]+)?$"


def read_documents(spark: SparkSession, path: str, strict: bool = False, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """(path, book_id, text, notes, title, author, error) of all files below path. strict: a document in error fails the job.

    A PDF's text is that of its cleaned pages (see ``read_pdf``).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(~F.lower("path").rlike(METADATA)).withColumn("suffix", F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)))
    rows = files.where("suffix <> 'pdf'").select("path", F.regexp_extract("path", _NAME, 1).alias("book_id"), convert_udf("suffix", "content").alias("d")).select("path", "book_id", "d.*")
    raw = read_pdf_pages(spark, path, pdf)
    texts = pages.book_text(pages.clean_pages(raw.where("error is null").select("book_id", "page_number", "text")))
    found = raw.groupBy("path", "book_id").agg(F.max("error").alias("error")).join(texts, "book_id", "left")
    error = F.coalesce("error", F.when(F.col("text").isNull(), "ConversionError: the PDF has no text and needs OCR"))
    rows = rows.unionByName(found.select("path", "book_id", "text", F.array().cast(html.NOTES).alias("notes"), *[F.lit(None).cast("string").alias(c) for c in ("title", "author")], error.alias("error")))
    if strict:
        rows = rows.withColumn("text", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error"))).otherwise(F.col("text")))
    return rows


def read_pdf_pages(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """(path, book_id, page_number, text, error) of raw PDF pages, for the page operators; a file that can't be read is one row with its error."""

    @F.pandas_udf("struct<pages:array<string>,error:string>")
    def run(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            try:
                out.append((pdf(bytes(c)) or [""], None))
            except Exception as e:  # one broken document must not end the others' job
                out.append(([""], f"{type(e).__name__}: {e}"[:1000]))
        return pd.DataFrame(out, columns=["pages", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".pdf"))
    rows = files.select("path", F.regexp_extract("path", _NAME, 1).alias("book_id"), run("content").alias("d"))
    rows = rows.select("path", "book_id", F.posexplode("d.pages").alias("pos", "text"), F.col("d.error").alias("error"))
    return rows.select("path", "book_id", (F.col("pos") + 1).alias("page_number"), "text", "error")


def read_pdf_offsets(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """(book_id, offset, page): where each page of the PDFs below path begins in the text that ``read_documents`` gives."""
    raw = read_pdf_pages(spark, path, pdf).where("error is null")
    return pages.page_offsets(pages.clean_pages(raw.select("book_id", "page_number", "text")))


#: Files beside a document that say what its book is: NAME.meta.yaml or .json.
METADATA = "\\.meta\\.(ya?ml|json)$"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, title, author, language) of the metadata files below path: JSON objects, or lines "key: value". What can't be read is null."""

    @F.pandas_udf("struct<title:string,author:string,language:string>")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metadata(bytes(c)) for c in content], columns=["title", "author", "language"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(METADATA))
    return files.select(F.regexp_extract("path", "([^/]+?)\\.meta\\.[^./]+$", 1).alias("book_id"), run("content").alias("d")).select("book_id", "d.*")


def metadata(data: bytes) -> dict[str, str | None]:
    text = data.decode("utf-8", "ignore")
    try:
        found = json.loads(text)
    except ValueError:
        found = dict(m.groups() for m in re.finditer(r"(?m)^(\w+)\s*:[ \t]*[\"']?(.*?)[\"']?\s*$", text))
    found = found if isinstance(found, dict) else {}
    return {k: str(found[k]) if found.get(k) not in (None, "") else None for k in ("title", "author", "language")}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files; bytes that aren't UTF-8 are left out."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda c: bytes(c).decode("utf-8", "ignore"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", run("content").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are passed over, and a path that isn't there has no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
