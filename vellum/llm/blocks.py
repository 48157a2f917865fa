"""Blocks of documents that ask sharded tables about their keys.

Documents are packed where they are read into blocks: rows that hold the compressed columns of some megabytes of text.
A block sends each shard of the key space its distinct keys, once each however often they occur; the shard answers for
the keys of all blocks. A key that a third of all documents share is one entry a block, so no shard is skewed, and no
pair of documents is formed.

Blocks and shards both grow with the corpus. Beyond FAN shards a block therefore sends to FAN ranges of shards only;
relays, each for one range and about FAN blocks, merge what they get and send it on to the shards, and answers come
back the same way. A block and a relay have a bounded number of rows, whatever the corpus holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: UTF-8 bytes of text in a block; numpy holds about 15 times that in a worker for a while.
BLOCK_BYTES = 6 << 20
#: How hard a block is compressed; it is stored once and shuffled once or more.
LEVEL = 7
#: What a row counts in a block besides its text.
ROW_BYTES = 64
#: UTF-8 bytes of text whose keys go to one shard.
SHARD_BYTES = 96 << 20
LEAST_SHARDS = 48
#: Shards that blocks send to themselves; beyond, relays stand between.
FAN = 1024
#: Block ids are partition << SEQ | number in the partition.
SEQ = 20
BLOCK = "block long, n_rows long, n_bytes long, body binary"
#: Keys are squeezed.
REQUEST = "block long, shard long, keys binary, extra binary"
ANSWER = "block long, keys binary, extra binary"
RELAYED = "relay long, shard long, keys binary, extra binary, owner binary"


@dataclass
class Blocks:
    """A table of BLOCK rows, and how many shards its keys go to."""

    table: DataFrame
    shards: int
    fan: int
    relays: int  # groups of blocks that share relays; 0: no relays

    def ranges(self) -> int:
        """How many shards, or ranges of them, a block sends to."""
        return self.fan if self.relays else self.shards


def pack_rows(batches: list[pa.RecordBatch]) -> bytes:
    """Rows as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def rows_of(body) -> pa.Table:
    """The rows of a block, and the text column ``_vl_text`` among them."""
    return pa.ipc.open_stream(body.as_buffer() if isinstance(body, pa.Scalar) else body).read_all().combine_chunks()


def text_bytes(column: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of each text."""
    return np.diff(buffers(column)[1])


def into_blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES, each: Callable[[pa.Table], dict] | None = None, more: str = "", name: str = "blocks") -> DataFrame:
    """A stored table of blocks (BLOCK) of all rows of ``docs``, with ``_vl_text`` in place of the text.

    Nothing is shuffled. each: further columns ``more`` of a block, one value each, from its rows.
    """
    C.bounded_batches(docs.sparkSession, "4m")
    rows = docs.withColumn("_vl_text", F.col(f"`{text_col}`").cast("string")).drop(text_col)
    at = rows.columns.index("_vl_text")
    names = [x.split()[0] for x in f"{BLOCK}{more and ', '}{more}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            made = {"block": (part << SEQ) + seq, "n_rows": sum(b.num_rows for b in held), "n_bytes": size, "body": pack_rows(held)}
            made |= each(pa.Table.from_batches(held)) if each else {}
            return pa.RecordBatch.from_arrays([pa.array([made[n]]) for n in names], names)

        for batch in batches:
            sizes = text_bytes(batch.column(at)) + ROW_BYTES
            start = 0
            while start < batch.num_rows:
                room = np.searchsorted(np.cumsum(sizes[start:]), max(0, block_bytes - size), side="right")
                stop = min(batch.num_rows, start + max(int(room), 0 if held else 1))
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(sizes[start:stop].sum())
                if stop < batch.num_rows:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
                start = stop
        if held:
            yield flush()
        C.trim()

    return C.materialize(rows.mapInArrow(run, f"{BLOCK}{more and ', '}{more}"), name, large_rows=True)


def sized(table: DataFrame, shard_bytes: int = SHARD_BYTES, fan: int | None = None) -> Blocks:
    """The blocks with as many shards as their bytes need."""
    fan = fan or FAN
    total, n, last = table.agg(F.sum("n_bytes"), F.count(F.lit(1)), F.max(F.shiftright("block", SEQ))).first()
    shards = max(LEAST_SHARDS, math.ceil((total or 0) / shard_bytes))
    if shards <= fan:
        return Blocks(table, shards, fan, 0)
    # partitions are dealt to groups of about ``fan`` blocks; a block's number in its group has 32 bits
    groups = max(math.ceil(n / fan), math.ceil((last + 1) / (1 << (32 - SEQ))))
    return Blocks(table, -(-shards // fan) * fan, fan, groups)


def squeeze(values: np.ndarray, ascending: bool = True) -> bytes:
    """64-bit integers as bytes: the differences of ascending ones, byte planes apart, compressed."""
    values = np.diff(values, prepend=np.uint64(0)) if ascending else values
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unsqueeze(cell: pa.Scalar, ascending: bool = True) -> np.ndarray:
    data = cell.as_py()
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def keys_of(table: pa.Table) -> list[np.ndarray]:
    """The keys of each row."""
    return [unsqueeze(x) for x in table.column("keys")]


def all_keys(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *keys_of(table)])


def _requests(block: int, found) -> pa.Table:
    rows = [(s, squeeze(k), None if e is None else e.tobytes()) for s, k, e in found]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "shard": pa.array(cols[0], pa.int64()), "keys": pa.array(cols[1], pa.binary()), "extra": pa.array(cols[2], pa.binary())})


def ask(blocks: Blocks, run: Callable[[pa.Table], Iterator[tuple[int, np.ndarray, np.ndarray | None]]]) -> DataFrame:
    """Requests of each block. run: gives (shard, keys, extra) of a block's rows, by ``by_shard``."""

    def each(batches):
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _requests(block, run(rows_of(body))).to_batches()
        C.trim()

    return blocks.table.select("block", "body").mapInArrow(each, REQUEST)


def with_answers(blocks: Blocks, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """A block's rows with all answers to it; blocks meet their answers, and nothing else is held. run: gives rows of ``schema``."""

    def each(key, table, answer):
        if not len(table):  # answers to no block
            raise ValueError(f"block {key[0]} isn't there")
        out = run(rows_of(table.column("body")[0]), answer)
        C.trim()
        return out

    return blocks.table.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each, schema)


def ask_again(blocks: Blocks, answers: DataFrame, run: Callable[[pa.Table, pa.Table], Iterator]) -> DataFrame:
    """Requests of each block that build on earlier answers to it."""

    def each(key, table, answer):
        out = _requests(key[0].as_py(), run(rows_of(table.column("body")[0]), answer))
        C.trim()
        return out

    return blocks.table.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each, REQUEST)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the 64-bit key space, so they ascend with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def by_range(shard: np.ndarray, keys: np.ndarray, extra: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """The parts of keys whose shards, which ascend, are the same; shards without keys cost nothing."""
    if len(keys):
        cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(shard[a]), keys[a:b], None if extra is None else extra[a:b]


def by_shard(keys: np.ndarray, ranges: int, extra: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Parts of sorted 64-bit keys, a shard or range of shards each."""
    return by_range(shard_of(keys, ranges), keys, extra)


#: keys and extras of a shard's requests in; which of each one's keys are answered, and with what extra, out.
Answer = Callable[[list[np.ndarray], list[np.ndarray]], list[tuple[np.ndarray, np.ndarray | None]]]


def answered(blocks: Blocks, requests: DataFrame, extra: str, answer: Answer) -> DataFrame:
    """ANSWER rows to REQUEST rows. extra: the type of the requests' extra. answer works on all keys of a shard, two or more requests may share."""
    relays = blocks.relays  # the table itself must not be in what goes to the workers
    if relays:
        requests = _relayed(requests, blocks.shards, relays, np.dtype(extra).itemsize)

    def each(table):
        keys, extras = keys_of(table), cells(table, "extra", extra)
        at, got, more, owner = [], [], [], []
        for i, (which, value) in enumerate(answer(keys, extras)):
            if len(k := keys[i][which]):
                at.append(i)
                got.append(squeeze(k))
                more.append(None if value is None else value.tobytes())
                if relays:
                    owner.append(np.frombuffer(table.column("owner")[i].as_buffer(), "<u4")[which].tobytes())
        name = "relay" if relays else "block"
        out = {name: table.column(name).combine_chunks().take(pa.array(at, pa.int64())), "keys": pa.array(got, pa.binary()), "extra": pa.array(more, pa.binary())}
        C.trim()
        return pa.table(out | ({"owner": pa.array(owner, pa.binary())} if relays else {}))

    found = requests.groupBy("shard").applyInArrow(each, f"{ANSWER}, owner binary".replace("block", "relay") if relays else ANSWER)
    return _returned(found, relays) if relays else found


def _relayed(requests: DataFrame, shards: int, groups: int, width: int) -> DataFrame:
    """Requests to ranges of shards, merged a relay and sent on to the shards."""
    part = F.shiftright("block", SEQ)
    relay = F.col("shard") * groups + F.pmod(part, F.lit(groups))

    def each(key, table):
        keys = keys_of(table)
        blocks = table.column("block").to_numpy()
        owner = np.repeat((((blocks >> SEQ) // groups) << SEQ) + (blocks & ((1 << SEQ) - 1)), [len(k) for k in keys]).astype("<u4")
        every = np.concatenate(keys)
        extra = np.frombuffer(b"".join(x.as_py() or b"" for x in table.column("extra")), f"V{width}") if width else None
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        rows = {"shard": [], "keys": [], "extra": [], "owner": []}
        shard, at = shard_of(every, shards), 0
        for s, k, e in by_range(shard, every, None if extra is None or not len(extra) else extra[order]):
            rows["shard"].append(s)
            rows["keys"].append(squeeze(k))
            rows["extra"].append(None if e is None else e.tobytes())
            rows["owner"].append(owner[at : at + len(k)].tobytes())
            at += len(k)
        kinds = {"shard": pa.int64(), "keys": pa.binary(), "extra": pa.binary(), "owner": pa.binary()}
        C.trim()
        return pa.table({"relay": pa.array([key[0].as_py()] * len(rows["shard"]), pa.int64())} | {n: pa.array(v, kinds[n]) for n, v in rows.items()})

    return requests.withColumn("relay", relay).groupBy("relay").applyInArrow(each, RELAYED)


def _returned(found: DataFrame, groups: int) -> DataFrame:
    """Answers to relays, parted by the blocks that asked."""

    def each(key, table):
        group = key[0].as_py() % groups
        every, owner = all_keys(table), gather(table, "owner", "<u4").astype(np.int64)
        order = np.argsort(owner, kind="stable")
        raw = b"".join(x.as_py() or b"" for x in table.column("extra"))
        extra = np.frombuffer(raw, f"V{len(raw) // len(every)}")[order] if raw else None
        rows = list(by_range(owner[order], every[order], extra))
        number = np.array([r[0] for r in rows], np.int64)
        block = ((((number >> SEQ) * groups) + group) << SEQ) + (number & ((1 << SEQ) - 1))
        C.trim()
        return pa.table({"block": pa.array(block), "keys": pa.array([squeeze(r[1]) for r in rows], pa.binary()), "extra": pa.array([None if r[2] is None else r[2].tobytes() for r in rows], pa.binary())})

    return found.groupBy("relay").applyInArrow(each, ANSWER)


def cells(table: pa.Table, column: str, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.zeros(0, dtype) for x in table.column(column)]


def gather(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    found = cells(table, column, dtype)
    return np.concatenate(found) if found else np.zeros(0, dtype)


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(of, keys)
    at[at == len(of)] = 0
    return of[at] == keys


def member_pair(high: np.ndarray, low: np.ndarray, of_high: np.ndarray, of_low: np.ndarray) -> np.ndarray:
    """Whether each 128-bit key is among the others."""
    out = np.zeros(len(high), bool)
    if len(of_high):
        order = np.argsort(of_high, kind="stable")
        of_high, of_low = of_high[order], of_low[order]
        at = np.searchsorted(of_high, high)
        todo = np.arange(len(high))
        while len(todo):  # once more for each further key with the same high half
            todo = todo[at[todo] < len(of_high)]
            todo = todo[of_high[at[todo]] == high[todo]]
            out[todo] |= of_low[at[todo]] == low[todo]
            at[todo] += 1
    return out


def repeated(blocks: Blocks, requests: DataFrame) -> DataFrame:
    """Answers each request with those of its keys that occur twice or more in all blocks; extra: bool, twice in the block itself."""

    def answer(keys, multi):
        everything = np.sort(np.concatenate(keys))
        twice = everything[1:][everything[1:] == everything[:-1]]
        twice = np.unique(np.concatenate([twice, *[k[m] for k, m in zip(keys, multi, strict=True)]]))
        return [(member(k, twice), None) for k in keys]

    return answered(blocks, requests, "?", answer)


def repeated_pairs(blocks: Blocks, requests: DataFrame) -> DataFrame:
    """As ``repeated``, for keys of 127 bits; extra: the low half, whose last bit says whether the block itself has the key twice."""
    one = np.uint64(1)

    def answer(keys, low):
        high, lows = np.concatenate(keys), np.concatenate(low)
        order = np.lexsort((lows >> one, high))
        a, b = high[order], lows[order]
        same = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] >> one == b[:-1] >> one)])
        hit = np.zeros(len(a), bool)
        hit[order] = same | np.append(same[1:], False) | (b & one == one)
        out, at = [], 0
        for k, x in zip(keys, low, strict=True):
            which = hit[at : at + len(k)]
            out.append((which, x[which] & ~one))
            at += len(k)
        return out

    return answered(blocks, requests, "<u8", answer)


# --- words of many texts at once ---

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of more bytes are hashed one by one: sums of powers modulo 2 ** 64 collide on long words that are made for it.
LONG_WORD = 64
#: Bytes, and words, that are hashed at a time.
CHUNK, WORDS = 1 << 18, 1 << 17
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n; n is bounded, and so is what is remembered."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        got = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (base, inverse))
        _powers[int(base)] = got
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class WordTable:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: start and end bytes, hashes, and each text's range of words."""

    def __init__(self, texts, lower: bool = False):
        self.data, self.offsets = buffers(texts)
        size = len(self.data)
        word = ~_SPACE[self.data]
        first = self.offsets[:-1][self.offsets[:-1] < size]
        before = np.concatenate([[False], word[:-1]]) if size else word.copy()
        before[first] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.concatenate([word[1:], [False]]) if size else word.copy()
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        del word, before, after
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = np.empty(len(self.start), np.uint64)
        up, down = powers(_P, CHUNK + LONG_WORD + 1)
        long = np.flatnonzero(self.end - self.start > LONG_WORD)
        at = 0
        while at < len(self.start):  # the words that start within CHUNK bytes
            origin = int(self.start[at])
            to = int(np.searchsorted(self.start, origin + CHUNK))
            data = self.data[origin : min(size, origin + CHUNK + LONG_WORD)]
            data = _LOWER[data] if lower else data
            total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)])])
            a, b = self.start[at:to] - origin, np.minimum(self.end[at:to] - origin, len(data))
            self.hash[at:to] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            at = to
        for i in long.tolist():
            data = self.data[self.start[i] : self.end[i]]
            self.hash[i] = xxhash.xxh3_64_intdigest((_LOWER[data] if lower else data).tobytes())

    def ends(self) -> np.ndarray:
        """For each word, the index after its text's last word."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def windows(self, size: int, second: bool = False) -> np.ndarray:
        """The hash of the ``size`` words from each word on; it means nothing where the text ends earlier. second: another hash."""
        n, out = len(self.hash), np.empty(len(self.hash), np.uint64)
        up, down = powers(_P if second else _Q, WORDS + size + 1)
        for at in range(0, n, WORDS):
            h = self.hash[at : at + WORDS + size]
            h = mix(h ^ _Q) if second else h
            total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
            here = np.arange(min(WORDS, n - at))
            stop = np.minimum(here + size, len(h))
            out[at : at + WORDS] = mix((total[stop] - total[here]) * down[here] + np.uint64(size))
        return out
