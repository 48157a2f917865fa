"""Exact dedup by progressive refinement: group by length, then prefix hash, then full hash.

Each level reads only what it needs and passes on only rows whose key repeats. What passes is told to the next scan
by a bitmap of bounded size, so texts aren't shuffled to be refined; a wrong yes of the bitmap is undone by the full
hash. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, most_bits: int = C.MOST_BITS, digest: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with keep_id, group_size and kept; of equal texts the row with the largest id stays.

    Null text equals empty text. Null ids are smallest. Among rows that share text and largest id (repeated rows), one
    stays. Input columns with the names of output columns are replaced. Empty tables give empty results.
    digest: also text_sha256 of every row (reads all content, which the refinement itself doesn't).
    """
    outputs = ["keep_id", "group_size", "kept"] + ["text_sha256"] * digest
    docs = C.without(docs, *outputs)
    text = C.text_of(text_col)
    length, prefix = F.octet_length(text), F.xxhash64(F.octet_length(text), F.left(text, F.lit(prefix_chars)))

    def repeated(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        keys = C.materialize(rows.groupBy("_vl_k").count().where("count > 1").select("_vl_k"), name)
        bits = C.bits_for(keys.count(), most_bits)
        return C.bitmap(keys, "_vl_k", bits), bits

    by_len, n_len = repeated(docs.select(F.xxhash64(length).alias("_vl_k")), "exact-lengths")
    rows = C.in_bitmap(docs.select(F.xxhash64(length).alias("_vl_l"), prefix.alias("_vl_k")), "_vl_l", by_len, n_len, "_vl_in").where("_vl_in")
    by_prefix, n_prefix = repeated(rows, "exact-prefixes")

    flagged = C.in_bitmap(docs.withColumn("_vl_k", prefix), "_vl_k", by_prefix, n_prefix, "_vl_in").drop("_vl_k")
    cand = flagged.where("_vl_in").drop("_vl_in").withColumn("_vl_sha", F.sha2(text.cast("binary"), 256))
    key = F.col(f"`{id_col}`")
    per_id = cand.groupBy("_vl_sha", key.alias("_vl_id")).agg(F.count(F.lit(1)).alias("_vl_c"))
    top = F.max(F.struct("_vl_id", "_vl_c"))
    groups = per_id.groupBy("_vl_sha").agg(F.sum("_vl_c").alias("_vl_n"), top.alias("_vl_top")).where("_vl_n > 1")
    groups = C.materialize(groups.select("_vl_sha", "_vl_n", F.col("_vl_top._vl_id").alias("_vl_keep"), F.col("_vl_top._vl_c").alias("_vl_ties")), "exact-groups")

    joined = C.attach(cand, groups, ["_vl_sha"], "_vl_n", key.cast("string"))
    grouped = F.col("_vl_n").isNotNull()
    keep = F.when(grouped, F.col("_vl_keep")).otherwise(key)
    top_row = ~grouped | key.eqNullSafe(F.col("_vl_keep"))
    multi = joined.withColumn("kept", top_row)
    if not groups.where("_vl_ties > 1").isEmpty():
        tied = grouped & top_row & (F.col("_vl_ties") > 1)
        multi = multi.where(~tied).unionByName(_one_of_ties(joined.where(tied), docs))
    multi = multi.withColumns({"keep_id": keep, "group_size": F.coalesce(F.col("_vl_n"), F.lit(1)).cast("long")})
    single = flagged.where("not _vl_in").withColumns({"keep_id": key, "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    if digest:
        multi, single = multi.withColumn("text_sha256", F.col("_vl_sha")), single.withColumn("text_sha256", F.sha2(text.cast("binary"), 256))
    cols = [f"`{c}`" for c in docs.columns] + outputs
    return single.select(*cols).unionByName(multi.select(*cols))


def _one_of_ties(tied: DataFrame, docs: DataFrame) -> DataFrame:
    """Marks one of the rows that share a text and its largest id: the first by a hash of all columns without maps, then by place.

    The rows are stored, so that each has a place that stays; the first of a group is an aggregate, not a sort of it.
    """
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]
    place = F.struct(F.xxhash64(*plain).alias("hash"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = C.materialize(tied, "exact-ties").withColumn("_vl_place", place)
    first = C.materialize(rows.groupBy("_vl_sha").agg(F.min("_vl_place").alias("_vl_first"), F.count(F.lit(1)).alias("_vl_rows")), "exact-first")
    found = C.attach(rows, first, ["_vl_sha"], "_vl_rows", F.col("_vl_place.row").cast("string"))
    return found.withColumn("kept", F.col("_vl_place") == F.col("_vl_first")).drop("_vl_place", "_vl_first", "_vl_rows")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their own columns."""
    return exact_dedup(docs, id_col, text_col).where("kept").drop("keep_id", "group_size", "kept")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
}
