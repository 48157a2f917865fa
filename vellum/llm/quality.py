"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, by sharded count joins.

The model is over bytes, so that it serves every language and its n-grams are integers; its ORDER passes the length of
common words, so its table grows with the corpus. It counts the text of all trusted documents but one in FOLDS, which
are held out for the thresholds. Counts are sharded by the three bytes before the last, so that a shard holds all that
the orders 4 to ORDER need of its n-grams, and a key has at most 256 ** (ORDER - 3) of them; orders 1 to 3 have at most
256 ** 3 entries and go to every shard. Blocks of documents send each shard their distinct n-grams and get log
probabilities back. A document is rejected when its perplexity passes a quantile of its language's held-out trusted
documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import blocks as B
from . import common as C

ORDER = 6
#: The highest order that goes to every shard.
LOW = 3
PAD = 2
#: Bytes of text in a block; it is worked through CHUNK by CHUNK.
BLOCK_BYTES, CHUNK = 32 << 20, 1 << 20
#: Distinct n-grams of chunks that are held before they are merged.
HELD = 4_000_000
#: Shards of the model: as many as its text needs, up to MOST_SHARDS, as there are only so many n-grams.
SHARD_BYTES, MOST_SHARDS = 96 << 20, 4096
#: Blocks whose requests a shard answers in one task.
ANSWERED = 4096
#: The quantile of held-out trusted documents' perplexities that a document of the language may reach.
QUANTILE = 0.98
#: One in FOLDS trusted documents isn't trained on; the quantiles are theirs, as the model knows its own text too well.
FOLDS = 5
#: Answers are -log2 of a probability in steps of 1 / FINE bits, as 16-bit integers: a byte counts 65535 / FINE bits at most.
FINE = 1024
#: Perplexities are counted in steps of 1 / STEPS bits.
STEPS = 1000
#: Trusted ids up to this number are broadcast, more are joined by a shuffle.
FEW = 1_000_000


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER bytes up to each byte as an integer; a text begins after ORDER - 1 pads."""
    n, k = len(offsets) - 1, ORDER - 1
    at = np.arange(len(data)) + k * (np.repeat(np.arange(n), np.diff(offsets)) + 1)
    padded = np.full(len(data) + k * n, PAD, np.uint64)
    padded[at] = data
    key = padded[at]
    for i in range(1, ORDER):
        key = key | (padded[at - i] << np.uint64(8 * i))
    return key


def chunks(texts):
    """(bytes, offsets, first text, past last text) of about CHUNK bytes each."""
    data, offsets = B.buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1))
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at, to
        at = to


def counted(texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of all texts, and how often each occurs."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for data, offsets, _, _ in chunks(texts):
        k, c = np.unique(ngrams(data, offsets), return_counts=True)
        keys, counts = merged(np.concatenate([keys, k]), np.concatenate([counts, c]))
    return keys, counts


def distinct(arrays: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct keys of all arrays."""
    keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *arrays]))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def found(texts) -> np.ndarray:
    """Sorted distinct n-grams of all texts."""
    keys, held = np.zeros(0, np.uint64), []
    for data, offsets, _, _ in chunks(texts):
        held.append(distinct([ngrams(data, offsets)]))
        if sum(map(len, held)) > HELD:
            keys, held = distinct([keys, *held]), []
    return distinct([keys, *held])


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the LOW bytes before the last."""
    return (B.mix((keys >> np.uint64(8)) & np.uint64((1 << 8 * LOW) - 1)) % np.uint64(shards)).astype(np.int64)


def by_shard(keys: np.ndarray, shards: int, extra: np.ndarray | None = None):
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if cut[s] < cut[s + 1]:
            part = order[cut[s] : cut[s + 1]]
            yield s, keys[part], None if extra is None else extra[part]


def all_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows, and their counts."""
    keys = [B.unsqueeze(x) for x in table.column("keys")]
    counts = [B.unsqueeze(x, ascending=False) for x in table.column("counts")]
    return np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)



def discounts(of_counts: dict[int, int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = (of_counts.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1, d2, d3 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 0.9
    return min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.9), min(max(d3, 0.05), 2.9)


def interpolated(counts: np.ndarray, context: np.ndarray, contexts: int, off: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Of n-grams with counts and numbers of their contexts: their own share of probability, and what each context leaves to the lower order (1 where it is unseen)."""
    cut = np.array([0.0, *off])[np.minimum(counts, 3)]
    total = np.bincount(context, counts, contexts)
    left = np.bincount(context, cut, contexts)
    return np.maximum(counts - cut, 0) / total[context], np.where(total > 0, left / np.maximum(total, 1), 1.0)


class Lower:
    """Orders 1 to LOW of the model from its distinct trigrams and how many bytes come before each, and the discounts of all orders."""

    def __init__(self, trigrams: np.ndarray, counts: np.ndarray, off: dict[int, tuple[float, float, float]]):
        order = np.argsort(trigrams)
        self.keys, counts = trigrams[order].astype(np.uint64), counts[order]
        two, n2 = np.unique(self.keys & np.uint64(0xFFFF), return_counts=True)
        one, n1 = np.unique(two & np.uint64(0xFF), return_counts=True)
        self.off = off | {LOW: discounts(of_counts(counts)), 2: discounts(of_counts(n2)), 1: discounts(of_counts(n1))}
        own, left = interpolated(n1, np.zeros(len(n1), np.int64), 1, self.off[1])
        p1 = np.full(256, left[0] / 256)
        p1[one.astype(np.int64)] += own
        own, left = interpolated(n2, (two >> np.uint64(8)).astype(np.int64), 256, self.off[2])
        self.p2 = np.repeat(left, 256) * np.tile(p1, 256)
        self.p2[two.astype(np.int64)] += own
        self.own, self.left = interpolated(counts, (self.keys >> np.uint64(8)).astype(np.int64), 1 << 16, self.off[LOW])

    def p(self, keys: np.ndarray) -> np.ndarray:
        """The probability of each n-gram's last byte after the two before it."""
        keys = keys & np.uint64((1 << 8 * LOW) - 1)
        return _find(keys, self.keys, self.own) + self.left[(keys >> np.uint64(8)).astype(np.int64)] * self.p2[(keys & np.uint64(0xFFFF)).astype(np.int64)]


def of_counts(counts: np.ndarray) -> dict[int, int]:
    return {i: int((counts == i).sum()) for i in (1, 2, 3, 4)}


def _find(keys: np.ndarray, table: np.ndarray, values: np.ndarray, other: float = 0.0) -> np.ndarray:
    """The value of each key in the sorted table, or ``other``."""
    if not len(table):
        return np.full(len(keys), other)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], other)


def log2_p(keys: np.ndarray, model: np.ndarray, counts: np.ndarray, lower: Lower) -> np.ndarray:
    """log2 of each n-gram's last byte given the bytes before; model: sorted n-grams of the shard with their counts."""
    levels, k, c = [], model, counts
    for order in range(ORDER, LOW, -1):
        levels.append((order, k, c))
        k, c = np.unique(k & np.uint64((1 << 8 * (order - 1)) - 1), return_counts=True)
    p = lower.p(keys)
    for order, k, c in reversed(levels):
        context = k >> np.uint64(8)
        names, at = np.unique(context, return_inverse=True)
        own, left = interpolated(c, at, len(names), lower.off[order]) if len(k) else (np.zeros(0), np.zeros(0))
        key = keys & np.uint64((1 << 8 * order) - 1)
        p = _find(key, k, own) + _find(key >> np.uint64(8), names, left, 1.0) * p
    return np.log2(p)


def train(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, shards: int) -> tuple[DataFrame, Lower]:
    """The sharded n-gram counts (shard, keys, counts) of all trusted documents, and the lower orders."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("_vl_id")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_vl_id"), C.text_of(text_col).alias("_vl_text"))
    if ids.limit(FEW + 1).count() <= FEW:
        rows = rows.join(F.broadcast(ids), "_vl_id", "left_semi")
    else:  # a bitmap of bounded size drops most of the other documents before texts are shuffled
        bits = C.bitmap(ids.select(F.xxhash64("_vl_id").alias("_vl_k")), "_vl_k", 1 << 28)
        rows = C.in_bitmap(rows.withColumn("_vl_k", F.xxhash64("_vl_id")), "_vl_k", bits, 1 << 28, "_vl_in").where("_vl_in").join(ids, "_vl_id", "left_semi")

    def count(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out():
            for s, k, c in by_shard(keys, shards, counts):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([B.squeeze(k)], pa.binary()), pa.array([B.squeeze(c, ascending=False)], pa.binary())], ["shard", "keys", "counts"])

        for b in batches:
            k, c = counted(b.column(0))
            keys, counts = merged(np.concatenate([keys, k]), np.concatenate([counts, c]))
            if len(keys) > 2_000_000:
                yield from out()
                keys, counts = keys[:0], counts[:0]
        yield from out()
        C.trim()

    def total(key, table):
        k, c = merged(*all_counts(table))
        orders, level, n = [], k, c
        for order in range(ORDER, LOW, -1):  # how many n-grams of each order have counts 1 to 4, as one row's array
            orders += of_counts(n).values()
            level, n = np.unique(level & np.uint64((1 << 8 * (order - 1)) - 1), return_counts=True)
        C.trim()
        return pa.table({"shard": pa.array([key[0].as_py()]), "keys": pa.array([B.squeeze(k)], pa.binary()), "counts": pa.array([B.squeeze(c, ascending=False)], pa.binary()), "of_counts": pa.array([orders], pa.list_(pa.int64())), "trigrams": pa.array([level.astype("<i8").tobytes()], pa.binary()), "before": pa.array([n.astype("<i8").tobytes()], pa.binary())})

    parts = rows.select("_vl_text").mapInArrow(count, "shard long, keys binary, counts binary")
    model = C.materialize(parts.groupBy("shard").applyInArrow(total, "shard long, keys binary, counts binary, of_counts array<bigint>, trigrams binary, before binary"), "ngram-counts", large_rows=True)
    # sums over shards: 4 numbers an order, and at most 256 ** 3 trigrams (a trigram is in as many shards as bytes come before it)
    sums = model.select([F.sum(F.col("of_counts")[i]).alias(f"n{i}") for i in range(4 * (ORDER - LOW))]).first()

    def trigrams(batches):
        for b in batches:
            for k, n in zip(B.cells(b, "trigrams", "<i8"), B.cells(b, "before", "<i8"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    three = model.select("trigrams", "before").mapInArrow(trigrams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    off = {order: discounts({i + 1: int(sums[4 * j + i] or 0) for i in range(4)}) for j, order in enumerate(range(ORDER, LOW, -1))}
    return model.select("shard", "keys", "counts"), Lower(three["k"].to_numpy(np.int64), three["n"].to_numpy(np.int64), off)


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with bits_per_byte (null for null and empty texts): log2 of the perplexity.

    Each byte's log is rounded to 1 / FINE bits. trusted: a table with the doc_id of every trusted document. An input column named as the output is replaced.
    block_bytes: smaller blocks take less memory and ask for more n-grams.
    """
    docs = C.without(docs, "bits_per_byte")
    blocks = B.sized(B.into_blocks(docs, text_col, block_bytes, name="quality-blocks"), SHARD_BYTES, MOST_SHARDS)
    shards = min(blocks.shards, MOST_SHARDS)
    model, lower = train(docs, trusted, id_col, text_col, shards)

    def ask(batches):
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(s, B.squeeze(k)) for s, k, _ in by_shard(found(B.rows_of(body).column("_vl_text")), shards)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "shard", "keys"])
        C.trim()

    def answer(counts, requests):
        keys = [B.unsqueeze(x) for x in requests.column("keys")]
        if not keys:
            return pa.table({"block": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "logs": pa.array([], pa.binary())})
        every = distinct(keys)
        logs = log2_p(every, *all_counts(counts), lower)
        logs = np.minimum(np.rint(-logs * FINE), 65535).astype("<u2")
        logs = [logs[np.searchsorted(every, k)].tobytes() for k in keys]
        C.trim()
        return pa.table({"block": requests.column("block"), "shard": requests.column("shard"), "logs": pa.array(logs, pa.binary())})

    # a shard's requests are answered by groups of blocks, each of which gets the shard's part of the model
    groups = max(1, -(-blocks.table.count() // ANSWERED))
    requests = blocks.table.select("block", "body").mapInArrow(ask, "block long, shard long, keys binary").withColumn("_vl_group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    model = model.withColumn("_vl_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    answers = model.groupBy("shard", "_vl_group").cogroup(requests.groupBy("shard", "_vl_group")).applyInArrow(answer, "block long, shard long, logs binary")
    rest = [c for c in docs.columns if c != text_col]
    kept = [docs.schema[c] for c in [*rest, *[text_col] * keep_text]]

    def finish(rows, answers):
        texts = rows.column("_vl_text")
        keys = found(texts)
        logs = np.zeros(len(keys))  # in steps
        by = dict(zip(answers.column("shard").to_pylist(), B.cells(answers, "logs", "<u2"), strict=True))
        order = np.argsort(shard_of(keys, shards), kind="stable")
        logs[order] = np.concatenate([by[s] for s in sorted(by)]) if by else 0
        out = np.zeros(len(rows))
        for data, offsets, a, b in chunks(texts):
            own, at = np.unique(ngrams(data, offsets), return_inverse=True)
            total = np.concatenate([[0], np.cumsum(logs[np.searchsorted(keys, own)][at])])
            out[a:b] = (total[offsets[1:]] - total[offsets[:-1]]) / FINE / np.maximum(np.diff(offsets), 1)
        empty = B.text_bytes(rows.column("_vl_text")) == 0
        cols = {c: rows.column(c) for c in rest}
        if keep_text:
            cols[text_col] = rows.column("_vl_text")
        return pa.table(cols | {"bits_per_byte": pa.array(out, pa.float64(), mask=empty)})

    return B.with_answers(blocks, answers, finish, StructType([*kept, StructField("bits_per_byte", DoubleType())]))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of documents labelled good and not toxic; a null label trusts nothing, and repeated labels count once."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(1)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def lang_key(lang_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("l"), F.col(f"`{lang_col}`").cast("string")), F.lit("n"))


def thresholds(scored: DataFrame, trusted: DataFrame, id_col: str, lang_col: str, quantile: float) -> DataFrame:
    """(_vl_lang, limit): the quantile of held-out trusted documents' perplexities in bits, by language.

    trusted: (doc_id, held_out). A language whose trusted documents were all trained on takes the quantile over all
    languages' held-out documents. Perplexities are counted in steps, so that a language is a few thousand counts
    however many documents it has.
    """
    rows = scored.where("bits_per_byte is not null").select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), lang_key(lang_col).alias("_vl_lang"), F.round(F.col("bits_per_byte") * STEPS).cast("long").alias("step"))
    counts = rows.join(trusted, "doc_id").groupBy("_vl_lang", "step").agg(F.count_if("held_out").alias("n"))
    counts = C.materialize(counts, "perplexities")

    def at_quantile(of: DataFrame) -> DataFrame:
        w = Window.partitionBy("_vl_lang")
        at = of.where("n > 0").withColumns({"below": F.sum("n").over(w.orderBy("step")), "every": F.sum("n").over(w)}).where(F.col("below") >= F.col("every") * quantile)
        return at.groupBy("_vl_lang").agg((F.min("step") / STEPS).alias("limit"))

    own = at_quantile(counts)
    pooled = at_quantile(counts.groupBy("step").agg(F.sum("n").alias("n")).withColumn("_vl_lang", F.lit("all"))).first()
    pooled = F.lit(pooled["limit"] if pooled else None).cast("double")
    return counts.select("_vl_lang").distinct().join(own, "_vl_lang", "left").select("_vl_lang", F.coalesce("limit", pooled).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, keep_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with bits_per_byte, perplexity, limit (of the language, in bits) and keep.

    labels: doc_id, quality, toxic. Rows over their language's limit are rejected. Null and empty texts have no
    perplexity and are kept, as are rows of languages (null is one) that no trusted document has; a language whose
    trusted documents were all trained on takes the limit over all languages; without held-out documents everything
    is kept. Repeated rows get equal values. Input columns named as an output are replaced. An empty table gives an
    empty result.
    """
    docs = C.without(docs, "bits_per_byte", "perplexity", "limit", "keep")
    trusted = trusted_ids(labels).withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0)
    trusted = C.materialize(trusted, "trusted")
    scored = C.materialize(score(docs, trusted.where("not held_out"), id_col, text_col, keep_text, block_bytes), "scored", compression="zstd")
    limits = C.materialize(thresholds(scored, trusted, id_col, lang_col, quantile), "limits").withColumn("_vl_n", F.lit(1))
    out = C.attach(scored.withColumn("_vl_lang", lang_key(lang_col)), limits, ["_vl_lang"], "_vl_n", F.col(f"`{id_col}`").cast("string"))
    keep = F.coalesce(F.col("bits_per_byte") <= F.col("limit"), F.lit(True))
    return out.withColumns({"perplexity": F.pow(F.lit(2.0), "bits_per_byte"), "keep": keep}).drop("_vl_lang", "_vl_n")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_text=False)
    return out.select("doc_id", "lang", "bits_per_byte", "perplexity", "limit", "keep")
