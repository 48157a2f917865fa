"""Manifests: a hash of every artefact of a book, and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import text as T


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, hash) of files by any path that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))


def artefacts(chapters: DataFrame, chunks: DataFrame, cards: DataFrame) -> DataFrame:
    """(book_id, path, hash): hashes are of texts as they are stored; a book's chunks are one artefact, hashed by their own hashes in order."""
    a = chapters.select("book_id", F.concat(F.lit("canonical/chapters/"), "file").alias("path"), T.sha256_tag("text").alias("hash"))
    own = F.struct("ord", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    b = chunks.select("book_id", own.alias("s")).groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["h"]), "\n").alias("all"))
    c = cards.select("book_id", F.concat(F.lit("analysis/chapters/"), "chapter_id", F.lit(".json")).alias("path"), T.sha256_tag("card").alias("hash"))
    return a.unionByName(b.select("book_id", F.lit("knowledge/chunks").alias("path"), T.sha256_tag("all").alias("hash"))).unionByName(c)


def manifest(books: DataFrame, found: DataFrame, progress: DataFrame) -> DataFrame:
    """(book_id, engine_version, book_hash, status, chapters_total, chapters_committed, files): one row a book."""
    files = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "hash"))))
    rows = found.groupBy("book_id").agg(files.alias("files"))
    rows = books.select("book_id", T.sha256_tag("text").alias("book_hash")).join(rows, "book_id", "left").join(progress.select("book_id", "committed", "total", "complete"), "book_id", "left")
    return rows.select("book_id", F.lit(__version__).alias("engine_version"), "book_hash", F.when(F.col("complete"), "packed").otherwise("partial").alias("status"), F.col("total").alias("chapters_total"), F.col("committed").alias("chapters_committed"), "files")


def verify(manifests: DataFrame, found: DataFrame) -> DataFrame:
    """(book_id, path, problem): artefacts that are missing, changed or not in the manifest."""
    said = manifests.select("book_id", F.explode("files").alias("path", "said"))
    both = said.join(found, ["book_id", "path"], "full")
    why = F.when(F.col("hash").isNull(), "missing").when(F.col("said").isNull(), "not in the manifest").when(F.col("said") != F.col("hash"), "changed")
    return both.withColumn("problem", why).where("problem is not null").select("book_id", "path", "problem")
