"""The full-text and dense index as ordinary tables: postings, chunk lengths, book statistics and unit vectors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import italian
from ..functions import text as T

SURFACE = ("chapter_title", "text", "summary", "keywords")
STEMMED = ("text", "summary")


def flat_keywords(keywords: Column | str = "keywords") -> Column:
    return F.array_join(T.col(keywords), ", ")


def postings(chunks: DataFrame, columns: tuple[str, ...] = SURFACE) -> DataFrame:
    """(book_id, chunk_id, col, pos, term): each chunk is tokenized where it is; nothing is shuffled."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), terms.alias("terms")) for c, terms in _cells(chunks, columns).items()])
    rows = chunks.select("book_id", F.col("id").alias("chunk_id"), F.explode(cells).alias("c"))
    return rows.select("book_id", "chunk_id", F.col("c.col").alias("col"), F.posexplode("c.terms").alias("pos", "term"))


def stem_postings(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Postings of the columns text_stem and summary_stem, of books in a language that can be stemmed."""
    mine = chunks.join(books.where(italian.is_italian("language")).select("book_id"), "book_id", "left_semi")
    found = [italian.stemmed_terms(mine.select("book_id", F.col("id").alias("chunk_id"), c), c, ["book_id", "chunk_id"]).withColumn("col", F.lit(f"{c}_stem")) for c in STEMMED if c in chunks.columns]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("book_id", "chunk_id", "col", "pos", "term")


def _cells(chunks: DataFrame, columns: tuple[str, ...]) -> dict[str, Column]:
    """The terms of each column that the chunks have."""
    value = lambda c: flat_keywords(c) if chunks.schema[c].dataType.typeName() == "array" else F.col(c)
    return {c: T.search_terms(value(c)) for c in columns if c in chunks.columns}


def lengths(chunks: DataFrame, columns: tuple[str, ...] = SURFACE, stems: DataFrame | None = None) -> DataFrame:
    """(book_id, chunk_id, n_tokens) over all columns; chunks without a term have 0. Only stems are counted by a shuffle."""
    own = sum((F.size(terms) for terms in _cells(chunks, columns).values()), F.lit(0)).cast("long")
    rows = chunks.select("book_id", F.col("id").alias("chunk_id"), own.alias("n_tokens"))
    if stems is None:
        return rows
    more = stems.groupBy("book_id", "chunk_id").agg(F.count(F.lit(1)).alias("more"))
    return rows.join(more, ["book_id", "chunk_id"], "left").select("book_id", "chunk_id", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def book_stats(lens: DataFrame) -> DataFrame:
    """(book_id, n_chunks, avg_tokens)."""
    return lens.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chunks"), (F.sum("n_tokens") / F.count(F.lit(1))).alias("avg_tokens"))


def embed_input(summary: Column | str = "summary", keywords: Column | str = "keywords", text: Column | str = "text") -> Column:
    return F.concat_ws("\n", F.nullif(T.col(summary), F.lit("")), F.nullif(flat_keywords(keywords), F.lit("")), F.nullif(T.col(text), F.lit("")))


def unit(vector: Column | str) -> Column:
    """The vector at length 1; one of length 0 stays."""
    v = F.transform(T.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def embeddings(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]] | None) -> DataFrame | None:
    """(book_id, chunk_id, vector) by any encoder of texts, which each worker gets once; without an encoder, None."""
    if encode is None:
        return None

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in encode(texts.tolist())])

    raw = chunks.select("book_id", F.col("id").alias("chunk_id"), run(embed_input()).alias("raw"))
    return raw.select("book_id", "chunk_id", unit("raw").alias("vector"))


class Index:
    """The tables that a search reads."""

    def __init__(self, chunks: DataFrame, postings: DataFrame, lens: DataFrame, stats: DataFrame, vectors: DataFrame | None = None, stemmed: bool = False):
        self.chunks, self.postings, self.lens, self.stats, self.vectors, self.stemmed = chunks, postings, lens, stats, vectors, stemmed


def build(chunks: DataFrame, books: DataFrame | None = None, encode=None, columns: tuple[str, ...] = SURFACE) -> Index:
    """An index of chunks (book_id, id, ...). books (book_id, language): adds stems. encode: adds vectors."""
    found, stems = postings(chunks, columns), None
    if books is not None:
        stems = stem_postings(chunks, books)
        found = found.unionByName(stems)
    lens = lengths(chunks, columns, stems)
    return Index(chunks, found, lens, book_stats(lens), embeddings(chunks, encode), books is not None)


def write(index: Index, path: str) -> None:
    """Tables below ``path``. Postings are sorted by term in files by ranges of terms, so that a query's terms skip most row groups."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    for name in ("chunks", "lens", "stats", "vectors"):
        if (table := getattr(index, name)) is not None:
            table = table.withColumn("stemmed", F.lit(index.stemmed)) if name == "stats" else table
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark, path: str) -> Index:
    from pyspark.errors import AnalysisException

    try:
        vectors = spark.read.parquet(f"{path}/vectors")
    except AnalysisException:
        vectors = None
    found, stats = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")
    if "stemmed" in stats.columns:
        row = stats.select("stemmed").first()
        stemmed = bool(row and row[0])
    else:  # an index of before the flag was stored
        stemmed = bool(found.where("col like '%_stem'").take(1))
    return Index(spark.read.parquet(f"{path}/chunks"), found, spark.read.parquet(f"{path}/lens"), stats.drop("stemmed"), vectors, stemmed)
