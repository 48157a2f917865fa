"""Packing documents into sequences by cutting-stock column generation.

Documents are cut into pieces of a whole sequence and a remainder. Remainders are counted in length classes; a linear
program over patterns (how many of each class a sequence holds; short pieces go in bundles) is solved by column generation, a knapsack dynamic
program pricing the next pattern. Rounded patterns are dealt to the remainders by their rank in their class. The
program's size is the number of classes, whatever the corpus holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common as C
from . import tokens

SEQUENCE = 4096
#: Lengths are rounded up to multiples of this for the patterns: at most so many ids less one are padded per item.
CLASS = 16
#: Pieces of up to SHORT ids are bundled, those of one length to at most BUNDLE ids; a bundle is an item as a longer piece is.
SHORT, BUNDLE = 64, 256
#: End of a document, and of its token ids.
END = 2
#: Blocks that a class's pieces are ranked in: as many as hold about BLOCK_ROWS of all pieces each, this many at least.
BLOCKS, BLOCK_ROWS = 1024, 1 << 18
PIECE_SCHEMA = "doc_id long, piece long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def knapsack(values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The best value and the counts of items 1..size (item i weighs i) that fit into ``size``."""
    best, pick = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        got = best[c - 1 :: -1][:c] + values[:c]  # item i (weight i + 1) on top of capacity c - i - 1
        i = int(got.argmax())
        best[c], pick[c] = (got[i], i + 1) if got[i] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    counts, c = np.zeros(size, np.int64), size
    while c > 0:
        if pick[c]:
            counts[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[size]), counts


def cutting_stock(demand: np.ndarray, max_rounds: int = 4000, gap: float = 1e-3) -> list[tuple[int, np.ndarray]]:
    """Patterns with multiplicities that cover ``demand`` (of items 1..len(demand) in bins of len(demand)).

    Column generation by the revised simplex method until the bound from the dual prices is within ``gap``. Rounded
    down; what remains, at most a bin per class, is packed first-fit decreasing.
    """
    size, rows = len(demand), np.flatnonzero(demand)
    if not len(rows):
        return []
    d, k = demand[rows].astype(float), len(rows)
    columns = [np.zeros(k, np.int64) for _ in range(k)]
    for i, r in enumerate(rows):
        columns[i][i] = size // (r + 1)
    inverse = np.diag([1 / columns[i][i] for i in range(k)])
    x = inverse @ d
    for _ in range(max_rounds):
        y = inverse.sum(axis=0)
        prices = np.full(size, -1.0)
        prices[rows] = y
        value, counts = knapsack(prices, size)
        if value <= 1 + 1e-9 or x.sum() <= (1 + gap) * (y @ d) / value:
            break
        column = counts[rows]
        step = inverse @ column
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * step
        x[out] = ratio[out]
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        columns[out] = column
    x = np.maximum(x, 0)
    left, patterns = demand.astype(np.int64).copy(), []
    for m, column in sorted(((int(v + 1e-9), c) for v, c in zip(x, columns, strict=True)), key=lambda p: -p[0]):
        if m and column.any():
            m = min(m, int((left[rows][column > 0] // column[column > 0]).min()))
            if m > 0:
                full = np.zeros(size, np.int64)
                full[rows] = column
                patterns.append((m, full))
                left -= m * full
    while left.any():  # largest first, as many as fit; the same pattern as often as it can be had
        pattern, room = np.zeros(size, np.int64), size
        for i in np.flatnonzero(left)[::-1]:
            n = min(int(left[i]), room // (i + 1))
            pattern[i], room = n, room - n * (i + 1)
        m = int((left[pattern > 0] // pattern[pattern > 0]).min())
        patterns.append((m, pattern))
        left -= m * pattern
    return patterns


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, keep_ids: bool = True, end: int = END) -> DataFrame:
    """Every text's ids with ``end``, cut into pieces of ``sequence`` ids and a remainder.

    Null text is empty and has the one id ``end``. Rows that repeat give pieces each. keep_ids: the ids as
    little-endian unsigned 32-bit integers, else null.
    """
    path = path or tokens.default_path()
    C.bounded_batches(docs.sparkSession, "2m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            ids, offsets = enc.encode(b.column(1), end)
            n = np.diff(offsets)
            pieces = -(-n // sequence)
            doc = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(sequence, n[doc] - k * sequence)
            first = offsets[doc] + k * sequence
            cells = [ids[a : a + m].tobytes() for a, m in zip(first.tolist(), length.tolist(), strict=True)]
            rows = [b.column(0).take(pa.array(doc)), k, k * sequence, length, [zlib.crc32(x) for x in cells], n[doc], cells if keep_ids else [None] * len(cells)]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [x.split()[0] for x in PIECE_SCHEMA.split(", ")])
        C.trim()

    return docs.select(F.col(f"`{id_col}`").cast("long"), C.text_of(text_col)).mapInArrow(run, PIECE_SCHEMA)


class Places:
    """Where the pieces of each class go: by a piece's class and rank, its sequence, the slot there, and the place in the slot.

    Classes 1 to SHORT are lengths; class SHORT + c holds longer pieces of up to c * width ids. Items are longer pieces and
    bundles of short ones, counted by their length in widths.
    """

    def __init__(self, counts: dict[int, int], sequence: int, width: int):
        top = sequence // width
        demand = np.zeros(top, np.int64)
        for k, n in counts.items():
            if k > SHORT:
                demand[k - SHORT - 1] += n
        self.per, self.bundles = np.ones(SHORT + 1, np.int64), {}
        for k in sorted(k for k in counts if k <= SHORT):
            per = self.per[k] = max(1, min(BUNDLE, sequence) // k)
            full, rest = divmod(counts[k], per)
            whole, part = -(-per * k // width), -(-rest * k // width)
            # bundles follow the items that are there already: (item class, first item) of full bundles and of the last one
            self.bundles[k] = (full, whole, int(demand[whole - 1]), part, 0)
            demand[whole - 1] += full
            if rest:
                self.bundles[k] = (*self.bundles[k][:4], int(demand[part - 1]))
                demand[part - 1] += 1
        one_each, demand[top - 1] = int(demand[top - 1]), 0
        # runs of items of a class that go to one pattern: (first item, first sequence, items a sequence, slot)
        runs: dict[int, list[tuple[int, int, int, int]]] = {top: [(0, 0, 1, 0)]} if one_each else {}
        used, sequences = np.zeros(top, np.int64), one_each
        for m, pattern in cutting_stock(demand):
            slot = 0
            for i in np.flatnonzero(pattern)[::-1]:
                runs.setdefault(int(i) + 1, []).append((int(used[i]), sequences, int(pattern[i]), slot))
                used[i] += m * pattern[i]
                slot += int(pattern[i])
            sequences += m
        self.runs = {c: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for c, r in runs.items()}

    def of(self, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k > SHORT:
            return *self._item(k - SHORT, rank), np.zeros(len(rank), np.int64)
        full, whole, first, part, last = self.bundles[k]
        item, inside = np.divmod(rank, self.per[k])
        seq, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for c, at, mine in ((whole, first + item, item < full), (part, np.full(len(rank), last), item >= full)):
            if mine.any():
                seq[mine], slot[mine] = self._item(c, at[mine])
        return seq, slot, inside

    def _item(self, c: int, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, begin, per, at = self.runs[c]
        j = np.searchsorted(first, item, side="right") - 1
        inside = item - first[j]
        return begin[j] + inside // per[j], at[j] + inside % per[j]


def pack(pieces: DataFrame, sequence: int = SEQUENCE, width: int = CLASS) -> DataFrame:
    """All rows and columns of ``pieces`` (a table that reads the same each time) with sequence_id and offset.

    pieces: doc_id, start, length (1 to ``sequence``) and ids_crc32. Whole pieces have sequences of their own. Rows that
    repeat are placed each. Input columns named as an output are replaced. An empty table gives an empty result.
    """
    pieces = C.without(pieces, "sequence_id", "offset")
    short = F.col("length") <= SHORT
    pieces = pieces.withColumn("_vl_class", F.when(short, F.col("length")).otherwise(SHORT + F.ceil(F.col("length") / width)).cast("int"))
    blocks = max(BLOCKS, pieces.count() // BLOCK_ROWS)
    rows = pieces.withColumn("_vl_block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    counts = C.materialize(rows.groupBy("_vl_class", "_vl_block").agg(F.count(F.lit(1)).alias("_vl_n")), "pack-counts")
    by_class = counts.groupBy("_vl_class").agg(F.sum("_vl_n").alias("n")).collect()  # at most a row per class
    places = Places({r[0]: r["n"] for r in by_class}, sequence, width)
    ranked = C.positions(rows, ["_vl_class"], ["_vl_block"], [F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32")], "_vl_rank", counts)
    names = [c for c in ranked.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, rank = (np.asarray(b.column(names.index(x))) for x in ("_vl_class", "_vl_rank"))
            out = np.zeros((3, len(c)), np.int64)
            for k in np.unique(c):
                mine = np.flatnonzero(c == k)
                out[:, mine] = places.of(int(k), rank[mine])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out)], [*names, "sequence_id", "_vl_slot", "_vl_inside"])

    out = ranked.mapInArrow(run, StructType([*ranked.schema.fields, *[StructField(n, LongType()) for n in ("sequence_id", "_vl_slot", "_vl_inside")]]))
    before = Window.partitionBy("sequence_id").orderBy("_vl_slot", "_vl_inside").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return out.drop("_vl_class", "_vl_block", "_vl_rank", "_vl_slot", "_vl_inside")


def pack_documents(docs: DataFrame, keep_ids: bool = True, **options) -> DataFrame:
    """Pieces of all ``docs`` (columns doc_id and text) with their place in sequences of at most SEQUENCE ids."""
    out = pack(C.materialize(tokenize_pieces(docs, keep_ids=keep_ids, **options), "pack-pieces"))
    return out if keep_ids else out.drop("ids")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, keep_ids=False).drop("piece")
