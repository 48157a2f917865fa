"""The pipeline: columns between stages, and each stage's decisions against brute force."""

from __future__ import annotations

import corpus_pipeline
from vellum.llm import common


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, data), "test")
        rows = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
            assert before is None or set(rows["doc_id"]) <= set(before["doc_id"])
        if name == "exact dedup":
            assert rows["text"].fillna("").is_unique
            assert set(rows["text"].fillna("")) == set(before["text"].fillna(""))
        if name == "n-gram jaccard join":
            from test_edges import brute_components

            old = before.sort_values("doc_id")
            ids = old["doc_id"].tolist()
            want = {ids[c] for _, c in brute_components(old["text"].tolist())}
            assert set(rows["doc_id"]) == want
        if name == "mixing":
            assert rows.groupby("doc_id").size().max() <= 3
            words = lambda t: t["text"].fillna("").str.split().str.len().sum()
            assert abs(words(rows) - words(before)) < 0.1 * words(before)
        if name == "packing":
            assert rows.groupby("sequence_id")["length"].sum().max() <= 4096
            assert set(rows["doc_id"]) == set(before["doc_id"])
            assert (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["doc_tokens"].first() * before.groupby("doc_id").size()).all()
        before = rows


def test_stages_take_odd_tables(spark, tmp_path):
    """Columns named as the operators' own, nulls, repeated rows and an empty table."""
    names = "kept string, size string, keep int, limit int, perplexity int, bits_per_byte int, source_size int, copies int, keep_id int, component_id int, sequence_id int, offset int, extra map<string,int>"
    schema = f"doc_id long, text string, lang string, source string, {names}"
    more = ("k", "s", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, {"a": 1})
    text = "some words that are said once and again in a text of this kind"
    rows = [(1, text, "en", "a", *more), (1, text, "en", "a", *more), (2, None, None, None, *[None] * 13), (3, "", "en", "b", *more), (None, text + " more", "en", "a", *more), (4, "x y z", "it", None, *more)]
    (tmp_path / "labels.parquet").mkdir()
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
    for given in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = common.materialize(given, "test")
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = common.materialize(stage(spark, docs, f"file://{tmp_path}"), "test")
            if name == "packing":
                assert docs.count() >= before.count()
                continue
            assert docs.dtypes == before.dtypes
            got, had = ({str(r) for r in x.collect()} for x in (docs, before))
            assert got <= had  # no column was touched
            if name == "quality classifier":
                assert docs.count() == n
            if name == "exact dedup":
                assert docs.count() == (4 if n else 0)
