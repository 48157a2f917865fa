"""Retrieval for any number of questions at once: BM25 with phrases, dense ranking, fusion and budgeted contexts."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import italian
from ..functions import text as T
from .index import STEMMED, SURFACE, Index

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF, TOP_K, FETCH, CONTEXT = 60, 8, 3, 14_000
#: Words of questions are broadcast up to so many rows, counted first; beyond, they are shuffled.
ASKED = 100_000
#: Scores of a task, and parts of them at most.
SCORES, MOST_PARTS = 1 << 20, 20_000
#: Question vectors of a block, and blocks of them that are broadcast; vectors of a block, and those that are multiplied at once.
BLOCK, BLOCKS, ROWS, STEP = 1024, 64, 4096, 256
#: Bytes of a block's vectors.
BODY = 4 << 20
#: Scores are ranked at this many decimals, so that the order of a sum doesn't decide.
DECIMALS = 10


def phrases(questions: DataFrame, stemmed: bool = False, columns: tuple[str, ...] = SURFACE) -> DataFrame:
    """(query_id, phrase_no, terms, cols): a phrase a word of the question, for the surface columns; with stems, their own for theirs.

    A word that the index reads as several terms is a phrase of them in sequence; one without a term matches nothing.
    A repeated word is a phrase each time.
    """
    rows = questions.select("query_id", F.posexplode(T.query_tokens("question")).alias("phrase_no", "word"))
    out = rows.select("query_id", "phrase_no", T.search_terms("word").alias("terms"), F.array(*[F.lit(c) for c in columns]).alias("cols"))
    if stemmed:
        stems = italian.stemmed_terms(questions.select("query_id", "question"), "question", ["query_id"])
        out = out.unionByName(stems.select("query_id", (F.col("pos") + 1_000_000).alias("phrase_no"), F.array("term").alias("terms"), F.array(*[F.lit(f"{c}_stem") for c in STEMMED]).alias("cols")))
    return out.where(F.size("terms") > 0)


def small(table: DataFrame, rows: int = ASKED) -> DataFrame:
    """The table, to be broadcast if a count shows that it has at most ``rows`` rows; Spark can't size it where it came from memory."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def matches(index: Index, found: DataFrame, keys: tuple[str, ...] = ("query_id", "phrase_no")) -> DataFrame:
    """(keys, book_id, chunk_id, f): how often each phrase (keys, terms, cols) occurs in a chunk's columns.

    A phrase's terms join the postings one by one; they make an occurrence when all start at the same place.
    """
    terms = found.select(*keys, "cols", F.size("terms").alias("k"), F.posexplode("terms").alias("i", "term"))
    hits = index.postings.join(small(terms), "term").where(F.array_contains("cols", F.col("col")))
    where = [*keys, "book_id", "chunk_id"]
    one = hits.where("k = 1").groupBy(*where).agg(F.count(F.lit(1)).alias("f"))
    if found.where(F.size("terms") > 1).isEmpty():
        return one
    many = hits.where("k > 1").withColumn("at", F.col("pos") - F.col("i")).groupBy(*where, "col", "at").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k"))
    return one.unionByName(many.where("n = k").groupBy(*where).agg(F.count(F.lit(1)).alias("f")))


def bm25(index: Index, questions: DataFrame, columns: tuple[str, ...] = SURFACE) -> DataFrame:
    """(query_id, book_id, chunk_id, bm25): higher is better; statistics are each book's own.

    A phrase that many questions have, or one has often, is looked up and weighed once; questions take it as often as they have it.
    """
    asked = phrases(questions, index.stemmed, columns)
    asked = asked.withColumn("phrase", F.concat_ws("|", F.array_join("terms", " "), F.array_join("cols", " ")))
    f = matches(index, asked.dropDuplicates(["phrase"]).select("phrase", "terms", "cols"), ("phrase",))
    n = f.groupBy("phrase", "book_id").agg(F.count(F.lit(1)).alias("n")).join(index.stats, "book_id")
    idf = F.ln((F.col("n_chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    n = n.select("phrase", "book_id", "avg_tokens", F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf).alias("idf"))
    rows = f.join(n, ["phrase", "book_id"])
    scores = index.chunks.count() * questions.count()
    if scores > SCORES:
        # chunks meet their lengths and questions in parts of bounded size, so that a task neither sums nor ranks more
        least = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(min(MOST_PARTS, max(least, -(-scores // SCORES))), "book_id", "chunk_id")
    rows = rows.join(index.lens, ["book_id", "chunk_id"])
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_tokens")))
    rows = rows.select("phrase", "book_id", "chunk_id", part.alias("part"))
    uses = asked.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(small(uses), "phrase").groupBy("query_id", "book_id", "chunk_id").agg(F.sum(F.col("times") * F.col("part")).alias("bm25"))


def ranked(scores: DataFrame, score: str, k: int, by: list[str] = ("query_id",), ties: list[str] = ("book_id", "chunk_id")) -> DataFrame:
    """The k best a question with rank from 0; equal scores by id."""
    w = Window.partitionBy(*by).orderBy(F.round(score, DECIMALS).desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def _packed(vectors: DataFrame, ids: list[str], rows: int) -> DataFrame:
    """(ids, dims, body): up to ``rows`` vectors of one length as doubles; those that are or hold null have dims -1."""
    fields = S.StructType([vectors.schema[c] for c in ids])
    out = S.StructType([S.StructField("ids", S.ArrayType(fields)), S.StructField("dims", S.IntegerType()), S.StructField("body", S.BinaryType())])

    def blocks(batches):
        for batch in batches:
            names = pa.StructArray.from_arrays([batch.column(c) for c in ids], names=ids)
            lists = batch.column("v")
            size = pc.fill_null(lists.value_lengths(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            if flat.null_count:
                owner = np.repeat(np.arange(len(size)), np.maximum(size, 0))
                whole, size = size, size.copy()
                size[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
            else:
                whole = size
            values = flat.to_numpy(zero_copy_only=False).astype("<f8", copy=False)
            ends = np.cumsum(np.maximum(whole, 0))
            for dims in np.unique(size):
                at = np.flatnonzero(size == dims)
                fit = max(1, min(rows, BODY // (8 * max(dims, 1))))
                for i in range(0, len(at), fit):
                    some = at[i : i + fit]
                    body = b"" if dims < 1 else values[(ends[some] - dims)[:, None] + np.arange(dims)].tobytes()
                    named = names.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), named), pa.array([int(dims)], pa.int32()), pa.array([body], pa.binary())], names=["ids", "dims", "body"])

    return vectors.select(*ids, F.transform("vector", lambda x: x.cast("double")).alias("v")).mapInArrow(blocks, out)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of a and b, each summed in the order of its places, so that equal vectors have equal ones."""
    sums, right = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    part = np.empty_like(sums)
    for j in range(a.shape[1]):
        np.multiply(a[:, j, None], right[j], out=part)
        sums += part
    return sums


def _rounded(x: np.ndarray) -> np.ndarray:
    """Spark's round at DECIMALS, half up by the decimal form."""
    step = Decimal(1).scaleb(-DECIMALS)
    return np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) if np.isfinite(v) else v for v in x.tolist()])


def _leaders(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best rows of each column, equal ones at DECIMALS by row; NaN is best, what is under ``least`` is left out.

    least becomes the k-th best of the column, if that is greater.
    """
    keys = np.where(np.isnan(scores), np.inf, scores)
    slack = 10.0**-DECIMALS
    if len(keys) > k:
        np.maximum(least, np.partition(keys, len(keys) - k, axis=0)[len(keys) - k], out=least)
    elif len(keys) == k:
        np.maximum(least, keys.min(axis=0), out=least)
    row, column = np.nonzero(keys >= np.where(np.isinf(least), least, least - 2 * slack))
    values, where = np.unique(keys[row, column], return_inverse=True)
    order = np.lexsort((row, -_rounded(values)[where], column))
    row, column = row[order], column[order]
    first = np.searchsorted(column, column)
    kept = np.arange(len(column)) - first < k
    return row[kept], column[kept]


def dense(vectors: DataFrame, question_vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, book_id, chunk_id, cosine, rank) of unit vectors, each against all questions.

    Vectors and questions are packed into blocks of ROWS and BLOCK where they are read. Blocks meet in pairs, as products
    of matrices; of each meeting a question's k best at most go on, so no pair of vectors is a row. Blocks of questions
    are broadcast if there are BLOCKS of them at most.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # a pair of blocks is a row
    n = -(-question_vectors.count() // BLOCK)
    asked = _packed(question_vectors.repartition(max(1, n)), ["query_id"], BLOCK).select(F.col("ids").alias("qids"), F.col("dims").alias("qdims"), F.col("body").alias("qbody"), F.monotonically_increasing_id().alias("qno"))
    pairs = _packed(vectors, ["book_id", "chunk_id"], ROWS).crossJoin(F.broadcast(asked) if n <= BLOCKS else asked)
    out = S.StructType([question_vectors.schema["query_id"], vectors.schema["book_id"], vectors.schema["chunk_id"], S.StructField("cosine", S.DoubleType())])

    def meet(batches):
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, qids = batch.column("ids")[i].values, batch.column("qids")[i].values
                dims, qno = batch.column("dims")[i].as_py(), batch.column("qno")[i].as_py()
                order = pc.sort_indices(pa.Table.from_arrays([ids.field("book_id"), ids.field("chunk_id")], names=["a", "b"]), sort_keys=[("a", "ascending"), ("b", "ascending")]).to_numpy()
                same = dims == batch.column("qdims")[i].as_py() and dims >= 0
                if same:
                    a = np.frombuffer(batch.column("body")[i].as_py(), "<f8").reshape(len(ids), dims)[order]
                    b = np.frombuffer(batch.column("qbody")[i].as_py(), "<f8").reshape(len(qids), dims)
                least = best.setdefault(qno, np.full(len(qids), -np.inf))
                for j in range(0, len(ids), STEP):
                    some = order[j : j + STEP]
                    if same:
                        scores = _products(a[j : j + STEP], b)
                        row, column = _leaders(scores, k, least)
                        cosine = pa.array(scores[row, column])
                    else:  # no cosine: these come after all others
                        row, column = np.repeat(np.arange(min(k, len(some))), len(qids)), np.tile(np.arange(len(qids)), min(k, len(some)))
                        cosine = pa.nulls(len(row), pa.float64())
                    named = ids.take(pa.array(some[row]))
                    yield pa.RecordBatch.from_arrays([qids.field("query_id").take(pa.array(column)), named.field("book_id"), named.field("chunk_id"), cosine], names=["query_id", "book_id", "chunk_id", "cosine"])

    return ranked(pairs.mapInArrow(meet, out), "cosine", k)


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """(query_id, book_id, chunk_id, rrf, rank): reciprocal ranks summed over lists; ties go to the earlier list, then the better rank."""
    parts = [t.select("query_id", "book_id", "chunk_id", "rank", F.lit(i).alias("list_no")) for i, t in enumerate(lists)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    summed = rows.groupBy("query_id", "book_id", "chunk_id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), F.min(F.struct("list_no", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "first", "book_id", "chunk_id")
    return summed.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).drop("first")


def search(index: Index, questions: DataFrame, k: int = TOP_K, hybrid: bool = True, question_vectors: DataFrame | None = None, columns: tuple[str, ...] = SURFACE) -> DataFrame:
    """(query_id, rank, book_id, id, chapter_id, chapter_title, ord, text, bm25, rrf) of the k best chunks a question.

    hybrid needs the index's vectors and question_vectors (query_id, vector); without either the ranking is BM25's.
    A question without a term finds nothing. Hits that the chunks table lacks are left out.
    """
    both = hybrid and index.vectors is not None and question_vectors is not None
    lexical = ranked(bm25(index, questions, columns), "bm25", max(FETCH * k, k) if both else k)
    if both:
        asked = question_vectors.join(questions.where(F.size(T.query_tokens("question")) > 0), "query_id", "left_semi")
        hits = fuse([lexical, dense(index.vectors, asked, max(FETCH * k, k))], k).join(lexical.select("query_id", "book_id", "chunk_id", "bm25"), ["query_id", "book_id", "chunk_id"], "left")
    else:
        hits = lexical.withColumn("rrf", F.lit(None).cast("double"))
    cols = [c for c in ("chapter_id", "chapter_title", "ord", "text") if c in index.chunks.columns]
    texts = index.chunks.select("book_id", F.col("id").alias("chunk_id"), *cols)
    return hits.join(texts, ["book_id", "chunk_id"]).select("query_id", "rank", "book_id", F.col("chunk_id").alias("id"), *cols, "bm25", "rrf")


def federated(index: Index, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, book_id, chunk_id, rrf, rank): every book's ceil(k / books) best and the global best, fused."""
    scores = bm25(index, questions)
    every = ranked(scores, "bm25", k)
    books = index.stats.agg(F.count(F.lit(1)).alias("books"))
    own = scores.withColumn("in_book", F.row_number().over(Window.partitionBy("query_id", "book_id").orderBy(F.round("bm25", DECIMALS).desc(), "chunk_id")))
    own = own.join(F.broadcast(books)).where(F.col("in_book") <= F.ceil(F.lit(k) / F.col("books"))).drop("books")
    w = Window.partitionBy("query_id").orderBy("in_book", F.round("bm25", DECIMALS).desc(), "book_id", "chunk_id")
    return fuse([own.withColumn("rank", F.row_number().over(w) - 1), every], k)


def contexts(hits: DataFrame, max_chars: int = CONTEXT) -> DataFrame:
    """(query_id, n_blocks, context): blocks in rank order, up to the first that would pass max_chars."""
    block = F.concat(F.lit("["), F.col("id"), F.lit(" | "), F.coalesce("chapter_title", F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    rows = hits.withColumn("block", block)
    upto = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("upto", upto).where(F.col("upto") <= max_chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "\n\n---\n\n")
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_blocks"), joined.alias("context"))


def list_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.select("book_id", "ord", "chapter_id", "file", F.coalesce(F.nullif(T.first_line("text", ""), F.lit("")), F.col("title")).alias("title"))


def read_chapter(chapters: DataFrame, ref: str, max_chars: int = 50_000) -> DataFrame:
    """(book_id, text) of the chapter that a number, a part of its file's name, or a part of its first 200 characters names, in this order."""
    low = ref.strip().lower()
    number = F.lit(low.isdigit()) & F.col("file").startswith(low.zfill(3))
    prio = F.when(number, 0).when(F.contains(F.lower("file"), F.lit(low)), 1).when(F.contains(F.lower(F.left("text", F.lit(200))), F.lit(low)), 2)
    rows = chapters.withColumn("prio", prio if low else F.lit(None).cast("int")).where("prio is not null")
    return rows.groupBy("book_id").agg(F.left(F.min_by("text", F.struct("prio", "ord")), F.lit(max_chars)).alias("text"))
