"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets that link share at least 80% of either. Under any order of the shingles, the prefix of n - T + l of a set of
n that must share T holds l of the shared ones, so a longer prefix may ask for more matches.

1. Sets that are equal are one class; only its first document goes on.
2. Short multi-match prefixes in hash order: a document goes on only if as many of its prefix shingles as a partner
   would have to share occur in other documents' prefixes. This estimates which documents have candidates at all.
3. Those lengthen their prefix to the whole set, and go on only if enough of it occurs in other documents.
4. The rest orders its shingles from rare to frequent and lengthens its prefix by its estimated candidates. Documents
   whose prefixes share a shingle meet in groups of bounded size (blocks of larger groups meet pair by pair); there,
   pairs with enough prefix matches are verified on all shingles. A pair may meet in several groups: its link is counted
   where its smallest common group meets, which each meeting tells from the groups its documents are in.

Steps 2 and 3 ask sharded tables of shingles by blocks, so frequent shingles form no pairs and no skew.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C
from .components import components

SHINGLE = 5
#: Similarity in percent.
SIMILAR = 80
#: Extra matches asked of the first prefixes, in percent of the set.
FIRST = 10
#: Bytes of text whose words are hashed at a time.
HASHED = 1 << 19
#: Documents of a group, and shingles that they have, that meet in one task (of two parts of that size).
MEET, MEET_SHINGLES = 256, 1 << 20


def shingle_sets(texts, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text with fewer words has its whole sequence as one.

    About HASHED bytes of text are worked through at a time.
    """
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts
    offsets, out, at = B.buffers(texts)[1], [], 0
    while at < len(offsets) - 1:
        to = min(len(offsets) - 1, max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASHED, side="right")) - 1))
        words = B.WordTable(texts.slice(at, to - at), lower=True)
        h, first, short = words.windows(size), words.first.tolist(), {}
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a < size and b > a and b - a not in short:
                short[b - a] = words.windows(b - a)
            out.append(_set(h[a : b - size + 1]) if b - a >= size else short[b - a][a : a + 1] if b > a else h[:0])
        at = to
    return out


def _set(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def _must_share(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _first_prefix(n: int, percent: int) -> tuple[int, int]:
    """Length of a set's first prefix, and how many of it any partner shares (partners have percent of n at least)."""
    return n - _must_share(n, percent) + 1 + n * FIRST // 100, 1 + _must_share(n, percent) * FIRST // 100


def _counted(blocks: B.Blocks, requests: DataFrame) -> DataFrame:
    """Answers each request with those of its keys that two documents or more have, and with their number."""

    def answer(keys, counts):
        every, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        every, n = every[new], np.add.reduceat(n.astype(np.int64), new)
        every, n = every[n > 1], np.minimum(n[n > 1], 0xFFFFFFFF).astype("<u4")
        which = [B.member(k, every) for k in keys]
        return [(w, n[np.searchsorted(every, k[w])]) for k, w in zip(keys, which, strict=True)]

    return B.answered(blocks, requests, "<u4", answer)


def _sent(sets: list[np.ndarray], ranges: int) -> Iterator:
    """The distinct shingles of a block with the number of its documents that have each."""
    if sets:
        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        yield from B.by_shard(keys, ranges, counts.astype("<u4"))


CAND = "rep long, n long, n_shared long, ell long, n_prefix long, tokens binary"


def _candidates(table: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Steps 2 to 4 up to the groups: CAND rows; tokens are those that others have too, rare ones first. reps: (block, rep)."""
    blocks = B.sized(table)
    ranges = blocks.ranges()
    firsts = reps.groupBy("block").agg(F.collect_list("rep").alias("ids"))

    def sets_of(rows: pa.Table, ids: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        want = ids.column("ids").combine_chunks().flatten() if len(ids) else pa.array([], pa.int64())
        rows = rows.filter(pc.is_in(rows.column("_vl_id"), value_set=want))
        return rows.column("_vl_id").to_numpy(), shingle_sets(rows.column("_vl_text"), size)

    def passed_first(sets: list[np.ndarray], answer: pa.Table) -> np.ndarray:
        known = np.sort(B.all_keys(answer))
        out = np.zeros(len(sets), bool)
        for i, x in enumerate(sets):
            length, need = _first_prefix(len(x), percent)
            out[i] = len(x) > 0 and B.member(x[:length], known).sum() >= need
        return out

    def first(rows, ids):
        sets = sets_of(rows, ids)[1]
        return _sent([x[: _first_prefix(len(x), percent)[0]] for x in sets], ranges)

    def second(rows, answer):
        ids, answer = _split(answer)
        sets = sets_of(rows, ids)[1]
        return _sent([x for x, ok in zip(sets, passed_first(sets, answer), strict=True) if ok], ranges)

    def last(rows, answer):
        ids, one, two = _split3(answer)
        names, sets = sets_of(rows, ids)
        known, df = B.all_keys(two), B.gather(two, "extra", "<u4")
        order = np.argsort(known)
        known, df = known[order], df[order].astype(np.int64)
        out = []
        for name, x, ok in zip(names.tolist(), sets, passed_first(sets, one), strict=True):
            if not ok:
                continue
            n, shared = len(x), x[B.member(x, known)]
            must = _must_share(n, percent)
            if len(shared) < must:
                continue
            d = df[np.searchsorted(known, shared)]
            shared = shared[o := np.lexsort((shared, d))]
            d, own = d[o], n - len(shared)  # what no other document has comes first in the order
            base = max(0, n - must + 1 - own)
            ell = 1 + min(8, int(math.log2(1 + int((d[:base] - 1).sum()) / 32)), must - 1)
            out.append((name, n, len(shared), ell, max(0, n - must + ell - own), shared.tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table({k.split()[0]: pa.array(c, pa.binary() if k.endswith("binary") else pa.int64()) for k, c in zip(CAND.split(", "), cols, strict=True)})

    none = F.lit(None).cast("binary")
    ids = firsts.select("block", F.lit(0).alias("step"), "ids", none.alias("keys"), none.alias("extra"))

    def answers(found: DataFrame, step: int) -> DataFrame:
        return found.select("block", F.lit(step).alias("step"), F.lit(None).cast("array<bigint>").alias("ids"), "keys", "extra")

    one = answers(_counted(blocks, B.ask_again(blocks, ids, first)), 1)
    two = answers(_counted(blocks, B.ask_again(blocks, ids.unionByName(one), second)), 2)
    return B.with_answers(blocks, ids.unionByName(one).unionByName(two), last, CAND)


def _split(answer: pa.Table) -> tuple[pa.Table, pa.Table]:
    step = answer.column("step")
    return answer.filter(pc.equal(step, 0)), answer.filter(pc.equal(step, 1))


def _split3(answer: pa.Table) -> tuple[pa.Table, pa.Table, pa.Table]:
    return (*_split(answer), answer.filter(pc.equal(answer.column("step"), 2)))


def verify(n: np.ndarray, ell: np.ndarray, tokens: list[np.ndarray], prefix: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents with links between ``left`` and ``right`` (which may be the same), and the symmetric matrix of all their links."""
    two = (len(left) + len(right)) > 0 and not np.array_equal(left, right)
    rows = np.union1d(left, right)
    heads = _overlaps([tokens[i][: prefix[i]] for i in rows])
    maybe = heads >= np.minimum.outer(ell[rows], ell[rows])
    length = np.minimum.outer(n[rows], n[rows]) * 100 >= np.maximum.outer(n[rows], n[rows]) * percent
    shared = np.array([len(tokens[i]) for i in rows])
    enough = np.minimum.outer(shared, shared) * (100 + percent) >= np.add.outer(n[rows], n[rows]) * percent
    maybe &= length & enough
    np.fill_diagonal(maybe, False)
    if two:
        side = np.isin(rows, left)
        maybe &= side[:, None] != side[None, :]
    take = np.flatnonzero(maybe.any(axis=1))
    if not len(take):
        return rows[take], np.zeros((0, 0), bool)
    whole = _overlaps([tokens[rows[i]] for i in take])
    size = np.add.outer(n[rows[take]], n[rows[take]])
    return rows[take], maybe[np.ix_(take, take)] & (100 * whole >= percent * (size - whole))


def _forest(link: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of the matrix that connect what all of them connect."""
    parent = list(range(len(link)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            parent[a] = b
            yield int(i), int(j)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share: a product of 0/1 matrices, some columns at a time."""
    m = len(sets)
    keys = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    column = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    often = np.bincount(column)[column] > 1 if len(keys) else np.zeros(0, bool)
    row, column = row[often], column[often]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    total, width = np.zeros((m, m), np.float32), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((m, width), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _links(cand: DataFrame, percent: int, give: str) -> DataFrame:
    """(a, b, links) of candidates with their number of copies.

    give "forest": links that connect what all links connect. "counts": these, and rows with a = b that hold how many
    documents a links with by the links counted in one meeting. "pairs": every link once, the smaller document first.
    """
    def explode(batches):
        for b in batches:
            for rep, shared, k, cell in zip(*(b.column(c).to_pylist() for c in ("rep", "n_shared", "n_prefix")), b.column("tokens"), strict=True):
                got = np.frombuffer(cell.as_buffer(), "<i8")[:k]
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.full(len(got), rep)), pa.array(np.full(len(got), shared))], ["token", "rep", "shared"])
        C.trim()

    rows = cand.select("rep", "n_shared", "n_prefix", "tokens").mapInArrow(explode, "token long, rep long, shared long")
    rows = C.materialize(rows, "prefix-tokens")
    groups = C.materialize(rows.groupBy("token").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "prefix-groups")
    met = C.attach(rows, groups, ["token"], "n", F.col("rep")).where("pivot is not null").select("pivot", "rep", "shared").distinct()
    met = C.materialize(met, "prefix-met")
    sizes = C.materialize(met.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.sum("shared").alias("all_shared")).where("size > 1"), "prefix-sizes")
    parts = F.greatest(F.ceil(F.col("size") / MEET), F.ceil(F.col("all_shared") / MEET_SHINGLES)).cast("long")
    met = C.attach(met, sizes, ["pivot"], "size", F.col("rep")).where("size is not null").withColumn("parts", parts).drop("shared")
    met = met.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tasks = met.withColumn("other", other).select("pivot", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep")
    cand = cand.drop("n_shared")
    if give != "forest":
        cand = cand.join(met.groupBy("rep").agg(F.collect_list("pivot").alias("pivots")), "rep")

    def meet(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        ids, part = table.column("rep").to_numpy(), table.column("part").to_numpy()
        tokens = B.cells(table, "tokens", "<u8")
        take = lambda c: table.column(c).to_numpy()
        at, link = verify(take("n"), take("ell"), tokens, take("n_prefix"), np.flatnonzero(part == i), np.flatnonzero(part == j), percent)
        ids, a, b, links = ids[at], [], [], []
        if give != "pairs":
            for x, y in _forest(link):
                a.append(ids[x])
                b.append(ids[y])
                links.append(0)
        if give != "forest" and len(ids):
            before = [np.asarray(x.values, np.int64) for x in table.column("before").take(pa.array(at))]
            link &= _overlaps(before) == 0
            if give == "pairs":
                x, y = np.nonzero(np.triu(link, 1))
                a, b, links = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), np.ones(len(x), np.int64)
            else:
                degree = link @ take("copies")[at]
                a, b, links = [*a, *ids[degree > 0]], [*b, *ids[degree > 0]], [*links, *degree[degree > 0]]
        C.trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    rows = tasks.join(cand, "rep")
    if give != "forest":
        rows = rows.withColumn("before", F.filter("pivots", lambda x: x < F.col("pivot"))).drop("pivots")
    return rows.groupBy("pivot", "i", "j").applyInArrow(meet, "a long, b long, links long")


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Step 1: the blocks, (block, doc_id, n_shingles, sig) of all rows, and (sig, rep, block, copies) of the classes that have shingles."""

    def signs(rows: pa.Table) -> dict:
        sets = shingle_sets(rows.column("_vl_text"), size)
        return {"ids": rows.column("_vl_id").to_pylist(), "sizes": [len(x) for x in sets], "signs": b"".join(hashlib.sha256(x.tobytes()).digest()[:16] for x in sets)}

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("_vl_id"), F.col(f"`{text_col}`").alias("_vl_t"))
    table = B.into_blocks(named, "_vl_t", each=signs, more="ids array<bigint>, sizes array<bigint>, signs binary", name="shingle-blocks")
    rows = table.select("block", "signs", F.posexplode(F.arrays_zip("ids", "sizes")).alias("at", "x"))
    signed = rows.select("block", F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("n_shingles"), F.substring("signs", F.col("at") * 16 + 1, F.lit(16)).alias("sig"))
    signed = C.materialize(signed, "shingle-signs")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "block"))).alias("first")
    classes = signed.where("n_shingles > 0").groupBy("sig").agg(first, F.count(F.lit(1)).alias("copies"))
    classes = classes.select("sig", F.col("first.doc_id").alias("rep"), F.col("first.block").alias("block"), "copies")
    return table, signed.drop("block"), C.materialize(classes, "shingle-classes")


def _met(table: DataFrame, classes: DataFrame, size: int, percent: int, give: str) -> DataFrame:
    """Steps 2 to 4: see ``_links``."""
    reps = classes.where("rep is not null").select("block", "rep")
    cand = C.materialize(_candidates(table, reps, size, percent), "shingle-candidates", large_rows=True)
    if give == "counts":
        cand = cand.join(classes.where("rep is not null").select("rep", "copies"), "rep")
    return _links(cand, percent, give)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = SIMILAR, links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, links), one row a row of ``docs``; without the last if not ``links``.

    Two rows link when their shingle sets have a Jaccard similarity of ``percent`` or more; component_id is the smallest
    id that links reach, the own included, and links is the number of other rows the row itself links with. Null and
    wordless texts have no shingles, are linked with nothing and are components of their own. Ids should be unique:
    rows that share an id are one node. A row with a null id belongs to its copies' component and to no other. An
    empty table gives an empty result; other columns are ignored.
    """
    table, signed, classes = _classes(docs, id_col, text_col, size)
    classes, met = classes.drop("block"), _met(table, classes, size, percent, "counts" if links else "forest")
    if links:
        met = C.materialize(met, "shingle-links")
    found = components(met.where("a <> b")).select(F.col("node").alias("rep"), "component")
    labels = classes.join(found, "rep", "left").select("sig", "copies", F.coalesce("component", "rep").alias("component_id"), "rep")
    if links:
        counts = met.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
        labels = labels.join(counts, "rep", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("others", F.lit(0))).drop("others")
    labels = C.materialize(labels.drop("rep"), "shingle-labels")
    out = ["doc_id", "n_shingles", "component_id", *(["links"] if links else [])]
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("links"))
    full = C.attach(signed.where("n_shingles > 0"), labels, ["sig"], "copies", F.col("doc_id")).select(*out)
    return full.unionByName(empty.select(*out))


def linked_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Every link: (a, b) of first documents of different classes of equal sets, each pair once with a < b; and (doc_id, rep).

    The rows of a class link with one another and with all rows of the classes that theirs is paired with. A family of
    n different texts that all link has n²/2 pairs; ``near_duplicates`` counts them without a row for each.
    """
    table, signed, classes = _classes(docs, id_col, text_col, size)
    pairs = _met(table, classes, size, percent, "pairs").select("a", "b")
    member = C.attach(signed.where("n_shingles > 0"), classes.drop("block"), ["sig"], "copies", F.col("doc_id")).select("doc_id", "rep")
    return pairs, member.unionByName(signed.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("rep")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first (smallest id) of their component; rows with a null id stay."""
    found = C.materialize(near_duplicates(docs, id_col, text_col, links=False), "near-duplicates")
    gone = C.materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_vl_gone")).distinct(), "near-gone")
    return C.not_among(docs, F.col(f"`{id_col}`").cast("long"), gone, "_vl_gone")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_ngram_join with the number of links, which that query's SQL doesn't have."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op2_ngram_join": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n AS a ON x = a.doc_id JOIN n AS b ON y = b.doc_id WHERE 100 * i >= 80 * (a.n + b.n - i)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x
)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""
}
SQL["op2_ngram_links"] = f"""
SELECT j.doc_id, j.n_shingles, j.component_id, coalesce(k.links, 0) AS links FROM ({SQL["op2_ngram_join"]}) AS j LEFT JOIN (
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
)
SELECT x, count(*) AS links FROM p JOIN n AS a ON x = a.doc_id JOIN n AS b ON y = b.doc_id WHERE 100 * i >= 80 * (a.n + b.n - i) GROUP BY x
) AS k ON k.x = j.doc_id"""
