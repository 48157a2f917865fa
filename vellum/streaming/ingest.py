"""Beyond the batch engine: documents as a stream of files, indexed incrementally, and a running state of books."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunk, segment
from ..sources import readers, sinks


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, book_id, text, notes, title, author, error) of files as they arrive below path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    book = F.regexp_extract("path", "([^/]+?)(\\.[^./]+)?$", 1).alias("book_id")
    return files.select("path", book, readers.convert_udf(suffix, "content").alias("d")).select("path", "book_id", "d.*")


def ingest(stream: DataFrame, tables: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Writes chapters and chunks of each batch's books, replacing only those books' partitions, so that a batch may run again."""

    def run(batch: DataFrame, _: int) -> None:
        books = batch.where("error is null").select("book_id", "text").persist()
        chapters, _dropped = segment.split_chapters(books)
        sinks.write_table(chapters, f"{tables}/chapters", force=True)
        sinks.write_table(chunk.chunks(chapters), f"{tables}/chunks", force=True)
        if then:
            then(books)
        books.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, kind, n) of state events in windows, with a bound on late events."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
