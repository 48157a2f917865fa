"""Sinks: corpora as partitioned tables, JSON lines, small files and archives."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with nulls, in one ordered file if an order is given; only small tables are meant to be ordered so."""
    out = df.orderBy(*order).coalesce(1) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, force: bool = False) -> None:
    """A table partitioned by book_id, a file or few a book. Without force a book that is there already is an error; with it, only the books in df are replaced."""
    spark = df.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        if not force:
            from pyspark.errors import AnalysisException

            try:
                have = spark.read.schema(df.schema).parquet(path).select("book_id").distinct()
            except AnalysisException:
                have = None
            if have is not None and (clash := df.select("book_id").distinct().join(have, "book_id", "left_semi").take(1)):
                raise FileExistsError(f"book {clash[0][0]} is in {path}")
        df.repartition("book_id").write.mode("overwrite" if force else "append").partitionBy("book_id").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file by any path that Spark writes; folders are made."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(data)
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_json(spark: SparkSession, path: str, data) -> None:
    write_text(spark, path, json.dumps(data, ensure_ascii=False, indent=2))


def pack(files: dict[str, str], manifest: dict) -> bytes:
    """One book's files and its manifest as a ZIP archive; empty folders (names that end in /) get a marker."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in sorted(files.items()):
            z.writestr(f"{name}.gitkeep" if name.endswith("/") else name, text)
        z.writestr("MANIFEST.json", json.dumps(manifest, ensure_ascii=False, indent=2))
    return out.getvalue()
