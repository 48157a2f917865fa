"""From documents to packed training sequences, in stages that each call one operator of ``vellum.llm``.

A stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. docs is a
stored table, so what the stage before stored on the way is deleted when the next begins. Nulls, empty texts, repeated
rows and empty tables are treated as each operator's docstring says. Columns beyond doc_id, text, lang and source may
have any name and type: they travel in one column that no operator knows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, exact_dedup, mixing, ngram_join, packing, quality

#: Columns that the operators read.
KNOWN = ("doc_id", "text", "lang", "source")


#: Blocks of the classifier: smaller than its own, as its rows carry their texts here and later stages share its executors.
BLOCK_BYTES = 12 << 20
#: Paths of what the last stage stored on the way.
_stored: list[str] = []


def _call(docs: DataFrame, run: Callable[[], DataFrame]) -> DataFrame:
    common.release(_stored, keep=docs)
    before = set(common.written())
    out = run()
    _stored[:] = [p for p in common.written() if p not in before]
    return out


def _through(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` of the rows that ``run`` returns."""
    rest = [c for c in docs.columns if c not in KNOWN]
    known = [c for c in docs.columns if c in KNOWN]
    packed = docs.select(*known, *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_vl_rest")] if rest else []))
    out = _call(docs, lambda: run(packed))
    return out.select(*[F.col("_vl_rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _through(docs, lambda d: quality.classify(d, labels, block_bytes=BLOCK_BYTES).where("keep"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; null counts as empty, and of repeated rows one stays."""
    return _through(docs, exact_dedup.drop_duplicates)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; documents without words or with a null id stay."""
    return _through(docs, ngram_join.drop_near_duplicates)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, and documents without words aren't taken."""
    return _through(docs, lambda d: mixing.emit(mixing.mix(d)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a document that is there twice is packed twice."""
    return _call(docs, lambda: packing.pack_documents(docs.select("doc_id", "text"), keep_ids=False))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram jaccard join", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Most stages are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = set(common.written()), common.materialize(docs, f"stage-{k}")
            common.release(last)
            last = [p for p in common.written() if p not in before]
    return docs
