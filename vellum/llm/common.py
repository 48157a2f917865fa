"""Helpers that the operators share: shared-folder tables, skew-safe joins, distributed positions, bounded bitmaps."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A group is hot when it holds more than one row in HOT_SHARE; there are fewer than HOT_SHARE such groups.
HOT_SHARE = 1024
#: ``[^\x20\x09-\x0D]+``: the words that sizes are counted in.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Options that keep row groups small where a row may be megabytes.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}

_written: list[tuple[SparkSession, str]] = []
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder if Spark runs in this one process (tests), else an error: a folder of one
    machine can't be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _local_dirs:
            _local_dirs[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        found = _local_dirs[context.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends or on ``release``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, large_rows: bool = False, compression: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again. large_rows: rows of up to megabytes."""
    path = new_path(df.sparkSession, name)
    df.write.options(**(SMALL_GROUPS if large_rows else {}), **({"compression": compression} if compression else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The paths of the tables that ``materialize`` wrote and nothing has deleted."""
    return [path for _, path in _written]


def release(paths: list[str] | None = None, keep: DataFrame | None = None) -> None:
    """Delete tables that ``materialize`` wrote, all of them or those at ``paths``, but for what ``keep`` reads.

    Call it once no other result that reads them is needed.
    """
    read = {f"/{f.split('/')[-2]}/" for f in (keep.inputFiles() if keep is not None else [])}
    gone = [x for x in _written if (paths is None or x[1] in paths) and not any(r in f"{x[1]}/" for r in read)]
    for spark, path in gone:
        _written.remove((spark, path))
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the application has ended already
            return


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the machine; workers idle between stages and would hold it.

    The first call in a worker also makes large arrays, numpy's and Arrow's, blocks of their own, which go back as soon
    as they are freed; else the allocators keep them for later.
    """
    global _libc, _pools
    import pyarrow as pa

    if _libc is None:
        _pools = [pa.default_memory_pool(), pa.system_memory_pool()]
        pa.set_memory_pool(_pools[1])
        try:
            _libc = ctypes.CDLL("libc.so.6")
            _libc.mallopt(M_MMAP_THRESHOLD, 1 << 22)
        except (OSError, AttributeError):  # another C library
            _libc = False
    for pool in _pools:
        pool.release_unused()
    if _libc:
        _libc.malloc_trim(0)


M_MMAP_THRESHOLD = -3
_libc, _pools = None, []


atexit.register(release)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of one Arrow batch, so that very long rows don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that clash with an output's name (in any case of letters): the output's column takes their place."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def text_of(column: str) -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: Column) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row a key, ``size``: its number of rows), safe when one key holds most rows.

    Keys with more than one row in HOT_SHARE are fewer than HOT_SHARE: they are broadcast. The rest is a shuffle join,
    in which rows of hot keys are spread by a salt. Keys must not be null.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    cols = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total)).select(*keys, *[F.col(c).alias(f"_vl_h_{c}") for c in cols], F.lit(True).alias("_vl_hot"))
    out = rows.join(F.broadcast(hot), keys, "left")
    out = out.withColumn("_vl_salt", F.when(F.col("_vl_hot"), 1 + F.pmod(F.xxhash64(spread), F.lit(4096))).otherwise(F.lit(0).cast("long")))
    cold = groups.withColumn("_vl_salt", F.lit(0).cast("long"))
    out = out.join(cold, [*keys, "_vl_salt"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_vl_h_{c}")) for c in cols}).drop("_vl_salt", "_vl_hot", *[f"_vl_h_{c}" for c in cols])


def positions(rows: DataFrame, group: list[str], block: list[str], order: list[Column], out: str, counts: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the 0-based gapless position of a row in its group, by (block, order). No group is sorted in one task.

    Blocks split a group evenly; rows are numbered in their block, and a prefix sum over the few block counts gives
    each block's start. Columns of group and block must not be null.
    """
    counts = rows.groupBy(*group, *block).agg(F.count(F.lit(1)).alias("_vl_n")) if counts is None else counts
    before = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, *block, F.coalesce(F.sum("_vl_n").over(before), F.lit(0)).alias("_vl_start"))
    inside = F.row_number().over(Window.partitionBy(*group, *block).orderBy(*order)).cast("long") - 1
    return rows.withColumn("_vl_rn", inside).join(starts, [*group, *block]).withColumn(out, F.col("_vl_start") + F.col("_vl_rn")).drop("_vl_start", "_vl_rn")


#: Bits of a bitmap: 16 a key, up to 128 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30


def bits_for(keys: int, most: int = MOST_BITS) -> int:
    return min(most, max(LEAST_BITS, 1 << (16 * keys).bit_length()))


def bitmap(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """A bitmap of ``bits`` bits in rows of 4 KiB: at most bits / 8 bytes whatever the input holds, so it can be broadcast."""
    b = F.pmod(F.col(column), F.lit(bits))
    return hashes.select(F.shiftright(b, 15).alias("_vl_row"), b.bitwiseAND(F.lit(32767)).alias("_vl_bit")).groupBy("_vl_row").agg(F.bitmap_construct_agg("_vl_bit").alias("_vl_bits"))


def in_bitmap(rows: DataFrame, column: str, bits: DataFrame, n_bits: int, out: str) -> DataFrame:
    """Adds ``out``: whether the hash may be in the bitmap. A wrong yes only costs time; there is no wrong no."""
    b = F.pmod(F.col(column), F.lit(n_bits))
    at = b.bitwiseAND(F.lit(32767))
    rows = rows.withColumn("_vl_row", F.shiftright(b, 15)).withColumn("_vl_at", at.cast("int"))
    rows = rows.join(F.broadcast(bits), "_vl_row", "left")
    byte = F.conv(F.hex(F.substring(F.col("_vl_bits"), F.shiftright(F.col("_vl_at"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.col("_vl_at").bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    return rows.withColumn(out, F.coalesce(bit == 1, F.lit(False))).drop("_vl_row", "_vl_at", "_vl_bits")


def not_among(rows: DataFrame, key: Column, gone: DataFrame, column: str) -> DataFrame:
    """The rows whose key isn't in ``gone`` (a stored table); a null key never is. Rows that a bitmap rules out aren't shuffled."""
    n = bits_for(gone.count())
    bits = bitmap(gone.select(F.xxhash64(column).alias("_vl_k")), "_vl_k", n)
    flagged = in_bitmap(rows.withColumn("_vl_k", F.xxhash64(key)), "_vl_k", bits, n, "_vl_in").drop("_vl_k")
    maybe = flagged.where("_vl_in").join(gone, key == F.col(column), "left_anti")
    return flagged.where("not _vl_in").unionByName(maybe).drop("_vl_in")
