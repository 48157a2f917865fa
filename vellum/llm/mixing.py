"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each document's expected copies are prefix-summed within its source, one random offset is added, and the document is
emitted once for each integer boundary that its stretch of the sum crosses. The order in a source is by size class,
then by hash, then by size, so that each stretch of the sum holds a fair share of short and long documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: No document is taken more often than this.
MAX_COPIES = 3


def targets(sources: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """For (source, source_size) rows: weights by code point of the source, null last, and the targets.

    Targets share the total by weight; one that would pass max_copies times its source's size stops there and the
    excess goes to the others by weight until none passes. That is the level L with sum(min(weight L, cap)) = total:
    sorted by cap / weight, the sources before the first that L doesn't fill are capped. One row a source goes through
    one task here; the corpus doesn't.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", pick).withColumn("cap", F.col("source_size") * max_copies)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "caps": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weights": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    level = (F.col("total") - F.col("caps")).cast("double") / (F.col("all_weight") - F.col("weights")).cast("double")
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("cap") == 0, F.lit(0.0)).otherwise(F.least(F.coalesce(level * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target and copies (0 to max_copies: how often the mix takes it).

    Size: words of the text (null: 0). A null source is a source of its own, the last. Sources without words get no
    copies. Rows that repeat are drawn each by itself; equal reruns give equal copies. Input columns named as an
    output are replaced. An empty table gives an empty result.
    """
    docs = C.without(docs, "size", "source_size", "target", "copies")
    src = F.col(f"`{source_col}`").cast("string")
    key = F.coalesce(F.concat(F.lit("s"), src), F.lit("n"))
    rows = docs.withColumn("size", C.n_words(C.text_of(text_col)))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = rows.withColumns({"_vl_src": key, "_vl_class": F.length(F.bin("size")), "_vl_hash": F.substring(F.md5(name), 1, 2)})
    blocks = C.materialize(rows.groupBy("_vl_src", "_vl_class", "_vl_hash").agg(F.count(F.lit(1)).alias("_vl_n"), F.sum("size").alias("_vl_s")), "mix-blocks")

    sources = blocks.groupBy("_vl_src").agg(F.sum("_vl_s").alias("source_size"))
    sources = sources.withColumn("source", F.when(F.col("_vl_src") != "n", F.substring("_vl_src", 2, 1 << 30)))
    plan = targets(sources.select("source", "source_size"), weights, max_copies)
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.lit(":"), F.coalesce("source", F.lit(""))), 256), 1, 5), 16, 10).cast("long") / F.lit(1048576.0)
    plan = plan.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_vl_src"), "source_size", "target", u.alias("_vl_u"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_vl_r"))

    before = Window.partitionBy("_vl_src").orderBy("_vl_class", "_vl_hash").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_vl_src", "_vl_class", "_vl_hash", F.coalesce(F.sum("_vl_n").over(before), F.lit(0)).alias("_vl_start")).join(plan, "_vl_src")
    inside = Window.partitionBy("_vl_src", "_vl_class", "_vl_hash").orderBy("size", F.col(f"`{id_col}`").asc_nulls_first())
    rows = rows.withColumn("_vl_rn", F.row_number().over(inside).cast("long")).join(starts, ["_vl_src", "_vl_class", "_vl_hash"])
    k = F.col("_vl_start") + F.col("_vl_rn")
    copies = F.floor(F.col("_vl_r") * k + F.col("_vl_u")) - F.floor(F.col("_vl_r") * (k - 1) + F.col("_vl_u"))
    return rows.withColumn("copies", copies.cast("long")).select(*[f"`{c}`" for c in docs.columns], "size", "source_size", "target", "copies")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its copies, without the columns that ``mix`` added."""
    out = mixed.where("copies > 0").withColumn("_vl_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.drop("_vl_copy", "size", "source_size", "target", "copies")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = {
    "op3_mix": """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS h FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight, 3 * source_size AS cap FROM s0
), s2 AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER b, 0) AS caps, coalesce(sum(weight) OVER b, 0) AS weights
  FROM s1 WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, CAST(total - caps AS DOUBLE) / CAST(all_weight - weights AS DOUBLE) AS lev FROM s2
), s4 AS (
  SELECT *, (SELECT arg_min(lev, CAST(cap AS DOUBLE) / weight) FROM s3 WHERE lev * weight < cap) AS l FROM s3
), s5 AS (
  SELECT source, source_size, CASE WHEN cap = 0 THEN 0.0::DOUBLE ELSE least(coalesce(l * weight, cap::DOUBLE), cap::DOUBLE) END AS target,
         CAST('0x' || substr(sha256('mix:' || coalesce(source, '')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u FROM s4
), r AS (
  SELECT d.doc_id, d.size, s5.source_size, s5.target, s5.u, CASE WHEN s5.source_size > 0 THEN s5.target / s5.source_size ELSE 0.0::DOUBLE END AS r,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), h, size, doc_id) AS k
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source
)
SELECT doc_id, size, source_size, target, CAST((floor(r * k + u) - floor(r * (k - 1) + u)) * size AS BIGINT) AS taken FROM r"""
}
