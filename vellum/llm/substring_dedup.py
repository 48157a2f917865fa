"""Substring dedup by difference-cover anchors.

Short windows are hashed only where their word position modulo PERIOD is in a difference cover: for any two positions
some shift below PERIOD brings both into the cover, so two equal windows of PERIOD - 1 + anchor words share an aligned
anchor. Anchors that repeat anywhere tell where a long match may be; there the full windows around them are hashed,
to 127 bits, and the ones that repeat are the matches; a match extends as far as windows that repeat cover one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import blocks as B
from . import common as C

WINDOW = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)


def _in_cover(words: B.WordTable, anchor: int) -> np.ndarray:
    """The words at which an anchor starts."""
    at = np.arange(len(words.hash)) - np.repeat(words.first[:-1], np.diff(words.first))
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    return np.flatnonzero(cover[at % PERIOD] & (np.arange(len(words.hash)) + anchor <= words.ends()))


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and whether each occurs twice or more."""
    keys = np.sort(keys)
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))) > 1


def _candidates(words: B.WordTable, answer: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes, of 127 bits in two halves, of windows that hold a repeated anchor."""
    anchor, n = window - PERIOD + 1, len(words.hash)
    at = _in_cover(words, anchor)
    hit = at[B.member(words.windows(anchor)[at], np.sort(B.all_keys(answer)))]
    marks = np.zeros(n + 1, np.int64)
    marks[hit + 1] = 1
    marks = np.cumsum(marks)
    start = np.arange(n)
    found = np.flatnonzero((marks[np.minimum(start + PERIOD, n)] > marks[:-1]) & (start + window <= words.ends()))
    return found, words.windows(window)[found], words.windows(window, second=True)[found] & ~np.uint64(1)


def _unique_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys; the last bit of the low half says whether a key occurs twice or more."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return high[at], low[at] | (np.diff(np.append(at, len(high))) > 1).astype(np.uint64)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed, kept_sha256, and the text with its repeated words removed.

    A word goes if it is in a window of ``window`` words whose sequence also starts elsewhere, in the same text or
    another; windows are judged on the input. What stays is joined by one space. Null text has no words and comes back
    empty. Shorter texts lose nothing. Repeated rows repeat each other and lose all windows. Input columns named as an
    output are replaced; an empty table gives an empty result. keep_text: false leaves the text column out.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has {PERIOD + 1} words at least")
    docs = C.without(docs, "n_words", "n_removed", "kept_sha256")
    blocks = B.sized(B.into_blocks(docs, text_col, name="substring-blocks"))
    ranges = blocks.ranges()
    rest = [c for c in docs.columns if c != text_col]
    anchor = window - PERIOD + 1

    def anchors(rows: pa.Table) -> Iterator:
        words = B.WordTable(rows.column("_vl_text"))
        keys, multi = _unique(words.windows(anchor)[_in_cover(words, anchor)])
        yield from B.by_shard(keys, ranges, multi)

    def windows(rows: pa.Table, answer: pa.Table) -> Iterator:
        keys, low = _unique_pairs(*_candidates(B.WordTable(rows.column("_vl_text")), answer, window)[1:])
        yield from B.by_shard(keys, ranges, low)

    def remove(rows: pa.Table, anchors: pa.Table, answer: pa.Table) -> pa.Table:
        words = B.WordTable(rows.column("_vl_text"))
        n = len(words.hash)
        found, high, low = _candidates(words, anchors, window)
        found = found[B.member_pair(high, low, B.all_keys(answer), B.gather(answer, "extra", "<u8"))]
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, found, 1)
        np.add.at(depth, found + window, -1)
        gone = np.cumsum(depth)[:-1] > 0
        kept = np.flatnonzero(~gone)
        data, size = words.data.copy(), len(words.data)
        # each kept word, and the one byte of white space after it if the text has one
        edge = words.end[kept]
        text_end = np.repeat(words.offsets[1:], np.diff(words.first))[kept]
        spaced = edge < text_end
        data[edge[spaced]] = 32
        depth = np.zeros(size + 1, np.int64)
        np.add.at(depth, words.start[kept], 1)
        np.add.at(depth, edge + spaced, -1)
        mask = np.cumsum(depth)[:-1] > 0
        at = np.concatenate([[0], np.cumsum(mask)])[words.offsets]
        data = data[mask].tobytes()
        out = [data[a:b].removesuffix(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        lost = np.concatenate([[0], np.cumsum(gone)])[words.first]
        cols = {c: rows.column(c) for c in rest}
        if keep_text:
            cols[text_col] = pa.array(out, pa.binary()).cast(pa.string())
        cols |= {"n_words": pa.array(np.diff(words.first)), "n_removed": pa.array(np.diff(lost)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())}
        return pa.table(cols)

    first = B.repeated(blocks, B.ask(blocks, anchors))
    second = B.repeated_pairs(blocks, B.ask_again(blocks, first, windows))
    kept = [docs.schema[c] for c in [*rest, *[text_col] * keep_text]]
    schema = StructType([*kept, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])

    def last(rows, answer):
        is_window = answer.column("extra").is_valid()  # both kinds of answers come in one table
        return remove(rows, answer.filter(pc.invert(is_window)), answer.filter(is_window))

    return B.with_answers(blocks, first.unionByName(second), last, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, keep_text=False)


SQL = {
    "op4_substring_dedup": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35
), m AS (
  SELECT doc_id, list(i) AS at FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1 GROUP BY doc_id
), g AS (
  SELECT m.doc_id, list_distinct(flatten(list_transform(m.at, lambda i: range(i, i + 35)))) AS gone FROM m
), k AS (
  SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(CASE WHEN len(gone) = 0 THEN array_to_string(w, ' ')
              ELSE coalesce((SELECT string_agg(w[i], ' ' ORDER BY i) FROM unnest(range(1, len(w) + 1)) AS t(i) WHERE NOT list_contains(gone, i)), '') END) AS kept_sha256
FROM k"""
}
