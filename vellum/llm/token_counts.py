"""Token counts by separator scan over flat, unindexed token files.

A token file is a flat run of fixed-width ids in which every document ends with a separator id; nothing says where.
Files are held in blocks (file, block, ids); a document may run over any number of blocks. Each block is searched for
separators at once; what a block leaves open is one number, so block summaries are stitched by a prefix scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens

#: <|endoftext|> of the word-level vocabulary; texts can't hold it, as special strings are encoded as plain text.
SEPARATOR = 49407
BLOCK_IDS = 1 << 18
#: Blocks whose summaries are scanned together before the scan over their sums.
RUN = 1024


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Writes all texts (null: empty) as flat token files of unsigned 16-bit ids in blocks, and a manifest of what went where.

    Returns (file, block, ids) and (file, ordinal, id). One file a task; the manifest is kept apart from the files,
    which hold ids only. Other columns are ignored; repeated rows are written each, rows with a null id too. A
    vocabulary with an id over 65535 ends in an error, as such ids would wrap.
    """
    spark, path = docs.sparkSession, path or tokens.default_path()
    C.bounded_batches(spark, "2m")
    kind = docs.select(id_col).schema[0].dataType
    if separator > 0xFFFF:
        raise ValueError("ids over 65535 don't fit into 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(path, special_as_text=True)
        name, held, block, ordinal = f"tokens-{TaskContext.get().partitionId():06d}", b"", 0, 0
        width = 2 * block_ids

        def batch_of(block, ids, ordinals, keys):
            n = max(len(ids), len(ordinals))
            pad = lambda x: [*x, *[None] * (n - len(x))]
            return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(pad(block), pa.int64()), pa.array(pad(ids), pa.binary()), pa.array(pad(ordinals), pa.int64()), pa.concat_arrays([keys, pa.nulls(n - len(keys), keys.type)])], ["file", "block", "ids", "ordinal", "id"])

        for b in batches:
            ids = enc.encode(b.column(1), separator)[0]
            if len(ids) and int(ids.max()) > 0xFFFF:
                raise ValueError("the vocabulary has ids that don't fit into 16 bits")
            parts = [held, ids.astype("<u2").tobytes()]
            flat = b"".join(parts)
            full = len(flat) // width
            out = [flat[i * width : (i + 1) * width] for i in range(full)]
            held = flat[full * width :]
            yield batch_of(range(block, block + full), out, range(ordinal, ordinal + b.num_rows), b.column(0))
            block, ordinal = block + full, ordinal + b.num_rows
        if held:
            yield batch_of([block], [held], [], pa.array([], pa.null()).cast(b.column(0).type))
        C.trim()

    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("file", StringType()), StructField("block", LongType()), StructField("ids", BinaryType()), StructField("ordinal", LongType()), StructField("id", kind)])
    stored = C.materialize(docs.select(F.col(f"`{id_col}`"), C.text_of(text_col)).mapInArrow(run, schema), "token-files")
    return stored.where("ids is not null").select("file", "block", "ids"), stored.where("ordinal is not null").select("file", "ordinal", "id")


def read_token_files(spark: SparkSession, path: str, dtype_bytes: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, ids) of flat binary files of up to 2 GB each, by any path that Spark reads."""
    files = spark.read.format("binaryFile").load(path)
    n, width = F.length("content"), block_ids * dtype_bytes
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / width))).otherwise(F.array().cast("array<bigint>")))
    return files.select(F.col("path").alias("file"), "content", at.alias("block")).select("file", "block", F.expr(f"substring(content, cast(block * {width} + 1 as int), {width})").alias("ids"))


def count_tokens(files: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document of (file, block, ids) rows; separators aren't counted.

    Ids after a file's last separator are its last document, unended. A document without ids counts 0. Empty files
    have no documents. Blocks must be numbered from 0 in each file without gaps; null ids count as none, and rows with a
    null file or block must not occur. Other columns are ignored.
    """
    C.bounded_batches(files.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, count, last, size = [], [], [], []
            for cell in b.column("ids"):
                ids = np.frombuffer(cell.as_buffer() or b"", dtype)
                at = np.flatnonzero(ids == separator)
                found.append(at.astype("<u4").tobytes())
                count.append(len(at))
                last.append(int(at[-1]) if len(at) else None)
                size.append(len(ids))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(found, pa.binary()), pa.array(count, pa.int64()), pa.array(last, pa.int64()), pa.array(size, pa.int64())], ["file", "block", "at", "n_seps", "last", "n_ids"])

    found = C.materialize(files.select("file", "block", "ids").mapInArrow(scan, "file string, block long, at binary, n_seps long, last long, n_ids long"), "token-scan")
    # The prefix scan: sums of ids and separators, and the greatest separator position so far; within runs of blocks, then over runs.
    run = Window.partitionBy("file", "run").orderBy("block")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = found.withColumn("run", F.shiftright("block", RUN.bit_length() - 1)).withColumns({"i_ids": total("n_ids", before), "i_seps": total("n_seps", before), "ends": F.lead("block").over(run).isNull()})
    rows = rows.withColumn("i_last", F.max(F.col("i_ids") + F.col("last")).over(before))
    runs = rows.groupBy("file", "run").agg(F.sum("n_ids").alias("s_ids"), F.sum("n_seps").alias("s_seps"), F.max(F.col("i_ids") + F.col("last")).alias("s_last"))
    file = Window.partitionBy("file").orderBy("run")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"r_ids": total("s_ids", before), "r_seps": total("s_seps", before), "r_ends": F.lead("run").over(file).isNull()})
    runs = runs.withColumn("r_last", F.max(F.col("r_ids") + F.col("s_last")).over(before)).drop("s_ids", "s_seps", "s_last")
    begin = F.coalesce(F.col("r_ids") + F.col("i_last"), F.col("r_last"), F.lit(-1)) + 1
    rows = rows.join(runs, ["file", "run"]).select("file", "at", "n_ids", (F.col("r_seps") + F.col("i_seps")).alias("ordinal"), (F.col("r_ids") + F.col("i_ids")).alias("base"), begin.alias("begin"), (F.col("ends") & F.col("r_ends")).alias("final"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at, n, ordinal, base, begin, final in zip(*(b.column(i) for i in range(b.num_columns)), strict=True):
                end = np.frombuffer(at.as_buffer() or b"", "<u4").astype(np.int64) + base.as_py()
                if final.as_py() and (end[-1] + 1 if len(end) else begin.as_py()) < base.as_py() + n.as_py():
                    end = np.append(end, base.as_py() + n.as_py())
                start = np.concatenate([[begin.as_py()], end[:-1] + 1])[: len(end)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(end), pa.string()), pa.array(ordinal.as_py() + np.arange(len(end))), pa.array(start), pa.array(end - start)], ["file", "ordinal", "start", "n_tokens"])

    return rows.mapInArrow(lengths, "file string, ordinal long, start long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = count_tokens(files)
    return manifest.join(counts, ["file", "ordinal"]).select(F.col("id").alias("doc_id"), "file", "ordinal", "start", "n_tokens")
