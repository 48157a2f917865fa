"""Sharding by vector bin packing over bytes, tokens and rows jointly.

Rows with equal texts are one group. A group larger than a lot is placed by itself, whole if it fits a shard (one larger
than FITS of a shard's share is split by a hash of the id first, into as few parts as fit, so that a text with a third
of all rows does); the others are dealt into LOTS lots by a hash of the text and placed lot by lot. So what the driver
packs is bounded whatever the corpus holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Lots of small groups; fewer than twice as many groups are placed by themselves, and few are split.
LOTS = 6144
#: Percent of a shard's share of bytes, tokens or rows that a group may hold and still isn't split.
FITS = 90
#: Blocks that a shard's rows are numbered in: as many as hold about BLOCK_ROWS of all rows each, this many at least.
BLOCKS, BLOCK_ROWS = 1024, 1 << 22


def pack(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each vector: largest first, where its dot product with the residual capacity is highest.

    Capacity is an equal share in each dimension. Shards whose residual capacity holds the vector in all dimensions go
    first, then those that hold its bytes (the first dimension); if none does, the one with the most residual bytes
    takes it.
    """
    total = vectors.sum(axis=0, dtype=float)
    share = np.divide(vectors, total, out=np.zeros(vectors.shape), where=total > 0) * n_shards
    left, out = np.ones((n_shards, vectors.shape[1])), np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        v = share[i]
        fits = (left >= v).all(axis=1)
        fits = fits if fits.any() else left[:, 0] >= v[0]
        best = int(np.where(fits, left @ v, -np.inf).argmax()) if fits.any() else int(left[:, 0].argmax())
        left[best] -= v
        out[i] = best
    return out


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", lots: int = LOTS) -> DataFrame:
    """All rows and columns of ``docs`` with size, shard and slot (gapless from 0 in the shard).

    Size: UTF-8 bytes of the text (null: none) plus 8. Equal texts share a shard unless together they pass FITS
    percent of its share, when hashes of their ids split them. Shards' sizes are near equal. Slots follow the id in
    blocks of its hash; rows that share an id take neighbouring slots in any order. Input columns named as an output
    are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = C.without(docs, "size", "shard", "slot")
    text = C.text_of(text_col)
    name: Column = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.withColumns({"size": F.octet_length(text).cast("long") + 8, "_vl_h": F.xxhash64(text)})
    sized = rows.select("_vl_h", "size", C.n_words(text).alias("_vl_words"))
    groups = C.materialize(sized.groupBy("_vl_h").agg(F.sum("size").alias("bytes"), F.sum("_vl_words").alias("tokens"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    total = groups.agg(F.sum("bytes"), F.sum("rows"), F.sum("tokens")).first()
    if not total[0]:
        return docs.limit(0).withColumns({"size": F.lit(0).cast("long"), "shard": F.lit(0), "slot": F.lit(0).cast("long")})

    # groups above a lot's share of bytes or rows: fewer than 2 * lots of them
    big = (F.col("bytes") * lots > F.lit(total[0])) | (F.col("rows") * lots > F.lit(total[1]))
    fits = lambda c, of: F.ceil(F.col(c) * (100 * n_shards) / F.lit(FITS * max(1, of)))
    parts = F.greatest(F.lit(1), fits("bytes", total[0]), fits("rows", total[1]), fits("tokens", total[2]))
    alone = groups.where(big).select("_vl_h", parts.cast("long").alias("_vl_parts"))
    rows = rows.join(F.broadcast(alone), "_vl_h", "left")
    # an item is a lot (hash below lots, part -1), or a part of a group by itself
    rows = rows.withColumns({"_vl_part": F.coalesce(F.pmod(F.xxhash64(name), F.col("_vl_parts")), F.lit(-1).cast("long")), "_vl_item": F.when(F.col("_vl_parts").isNull(), F.pmod("_vl_h", F.lit(lots))).otherwise(F.col("_vl_h"))}).drop("_vl_parts")
    small = groups.where(~big).groupBy(F.pmod("_vl_h", F.lit(lots)).alias("_vl_item"), F.lit(-1).cast("long").alias("_vl_part")).agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
    per_row = groups.select("_vl_h", (F.col("tokens") / F.col("rows")).cast("long").alias("_vl_words"))
    split = rows.where("_vl_part >= 0").groupBy("_vl_h", "_vl_part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    split = split.join(per_row, "_vl_h").select(F.col("_vl_h").alias("_vl_item"), "_vl_part", "bytes", (F.col("_vl_words") * F.col("rows")).alias("tokens"), "rows")
    items = small.unionByName(split).toPandas().sort_values(["_vl_item", "_vl_part"], ignore_index=True)
    placed = items[["_vl_item", "_vl_part"]].assign(shard=pack(items[["bytes", "tokens", "rows"]].to_numpy(), n_shards).astype("int32"))
    placed = spark.createDataFrame(placed, "_vl_item long, _vl_part long, shard int")

    rows = rows.join(F.broadcast(placed), ["_vl_item", "_vl_part"]).withColumn("_vl_block", F.pmod(F.xxhash64(name, F.lit(1)), F.lit(max(BLOCKS, total[1] // BLOCK_ROWS))))
    rows = C.positions(rows, ["shard"], ["_vl_block"], [F.col(f"`{id_col}`").asc_nulls_first()], "slot")
    return rows.select(*[f"`{c}`" for c in docs.columns], "size", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard into its own folder ``shard=N`` below ``path``; several tasks write a shard, ordered by slot in each."""
    sharded.repartition("shard", F.shiftright("slot", 18)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(C.text_of("text").cast("binary")))
    out = shard_documents(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
