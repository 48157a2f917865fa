"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import blocks, exact_dedup, media, mixing, ngram_join, packing, quality, sharding, substring_dedup, token_counts, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, shard int, component_id string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "a b c d e f", "en", "s", 1, "x", "y", 9, "z"),
        (2, "a b c d e f", None, None, None, None, None, None, None),
        (3, None, "en", "s", 0, "x", "y", 9, "z"),
        (4, "", "en", "", 0, "x", "y", 9, "z"),
        (5, " \t\n ", "en", "s", 0, "x", "y", 9, "z"),
        (None, "a b c d e f", "en", "s", 0, "x", "y", 9, "z"),
        (6, LONG, "fr", "t", 0, "x", "y", 9, "z"),
        (7, "ü é 日本 🙂 \x00 z", "ja", "t", 0, "x", "y", 9, "z"),
        (8, "rep", "en", "t", 0, "x", "y", 9, "z"),
        (8, "rep", "en", "t", 0, "x", "y", 9, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_dedup(odd, digest=True).collect()
    assert len(got) == 10
    by = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got]
    assert (1, 2, 3, False) in by and (2, 2, 3, True) in by and (None, 2, 3, False) in by
    assert (3, 4, 2, False) in by and (4, 4, 2, True) in by
    assert sorted(x for x in by if x[0] == 8) == [(8, 8, 2, False), (8, 8, 2, True)]
    assert all(r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in got)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_duplicates(odd).count() == 6


def test_exact_dedup_survives_a_full_bitmap(odd):
    a = exact_dedup.exact_dedup(odd, most_bits=1).select("doc_id", "keep_id", "group_size", "kept")
    b = exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_exact_dedup_of_repeated_rows(spark):
    """Many rows share the text and the largest id, null among them; some differ in a map only, alone or in a struct."""
    rows = [(None, "x", {"a": i % 2}, (i % 3, {"b": i % 2})) for i in range(200)] + [(7, "y", None, None)] * 50 + [(6, "y", None, None), (1, "z", {"q": 1}, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, s struct<i:int,m:map<string,int>>").repartition(4)
    for got in (exact_dedup.exact_dedup(df), exact_dedup.exact_dedup(df, digest=True)):
        got = got.collect()
        assert len(got) == len(rows) and sorted(r["text"] for r in got if r["kept"]) == ["x", "y", "z"]
        assert {(r["text"], r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {("x", None, None, 200), ("y", 7, 7, 51), ("y", 6, 7, 51), ("z", 1, 1, 1)}
    assert exact_dedup.drop_duplicates(df).columns == df.columns


def test_mixing(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and all(0 <= r["copies"] <= 3 for r in got)
    assert mixing.mix(none).count() == 0
    assert mixing.emit(mixing.mix(odd)).columns == [c for c in odd.columns if c != "size"]
    again = mixing.mix(odd).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def brute_substrings(texts, window):
    words = [re_words(t or "") for t in texts]
    seen: dict = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in words]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    return [(len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for w, g in zip(words, gone, strict=True)]


def re_words(t):
    import re

    return re.findall("[^\x20\x09-\x0d]+", t)


@pytest.mark.parametrize("seed", [0, 1])
def test_substrings(spark, odd, none, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([34, 35, 36, 80]))] for _ in range(6)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.random()}" for _ in range(rng.randint(1, 40))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(t) + rng.choice(["", " "]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(df).collect()}
    assert [got[i] for i in range(60)] == brute_substrings(texts, 35)
    if seed == 0:
        assert substring_dedup.dedup_substrings(odd).count() == 10
        assert substring_dedup.dedup_substrings(none).count() == 0


def test_cover_meets_every_pair():
    cover = set(substring_dedup.COVER)
    for i in range(substring_dedup.PERIOD):
        for j in range(substring_dedup.PERIOD):
            assert any((i + d) % substring_dedup.PERIOD in cover and (j + d) % substring_dedup.PERIOD in cover for d in range(substring_dedup.PERIOD))


def brute_components(texts):
    def shingles(t):
        w = re_words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("meet", [256, 3])
def test_near_duplicates(spark, odd, none, meet, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEET", meet)
    rng = random.Random(5)
    bases = [[f"{rng.choice('abcdef')}{rng.randint(0, 60)}" for _ in range(rng.choice([5, 12, 60, 200]))] for _ in range(8)]
    texts = []
    for _ in range(90):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 5)}"
        texts.append(rng.choice([" ", "\n"]).join(w[: rng.choice([len(w), len(w), max(1, len(w) - 7)])]))
    texts += ["", None, "one", "ONE", "two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    if meet == 256:
        assert ngram_join.near_duplicates(odd).count() == 10
        assert ngram_join.near_duplicates(none).count() == 0
        assert ngram_join.drop_near_duplicates(odd).columns == odd.columns


@pytest.mark.parametrize("meet", [256, 3])
def test_every_link_is_counted_once(spark, odd, none, meet, monkeypatch):
    """A chain, copies, and families that meet by many shared shingles: links and pairs against all pairs of sets."""
    monkeypatch.setattr(ngram_join, "MEET", meet)
    rng = random.Random(8)
    texts = [" ".join(f"c{i}" for i in range(a, a + 60)) for a in (0, 0, 5, 10, 15)]  # only neighbours link
    for base in ([f"f{k}x{i}" for i in range(n)] for k, n in enumerate((40, 90, 200))):
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 5)}"
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(re_words, texts)]
    link = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(a & b) >= 80 * len(a | b)}
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["links"] for r in ngram_join.near_duplicates(df).collect()}
    assert got == {i: sum(x == i for x, _ in link) for i in [*range(len(texts)), 900, 901]}
    assert [got[i] for i in range(5)] == [2, 2, 3, 2, 1]
    pairs, member = (x.collect() for x in ngram_join.linked_pairs(df))
    rep = {r["doc_id"]: r["rep"] for r in member}
    assert len(rep) == len(texts) + 2 and len({tuple(r) for r in pairs}) == len(pairs)
    assert {tuple(r) for r in pairs} == {(rep[i], rep[j]) for i, j in link if rep[i] < rep[j]}
    if meet == 256:
        assert sorted(r["links"] for r in ngram_join.near_duplicates(odd).collect()) == [0, 0, 0, 0, 0, 1, 1, 2, 2, 2]
        assert ngram_join.near_duplicates(none).columns == ["doc_id", "n_shingles", "component_id", "links"]
        assert ngram_join.near_duplicates(none).count() == 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, None), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == 10 and all(r["keep"] for r in got if not r["text"])
    assert all(r["bits_per_byte"] is None for r in got if not r["text"])
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).where("keep").count() == 10


def model_of(texts):
    """n-grams with counts of all texts, and the lower orders, as one shard."""
    import pyarrow as pa

    keys, counts = quality.counted(pa.array(texts))
    off, k, c = {}, keys, counts
    for order in range(quality.ORDER, quality.LOW, -1):
        off[order] = quality.discounts(quality.of_counts(c))
        k, c = np.unique(k & np.uint64((1 << 8 * (order - 1)) - 1), return_counts=True)
    return keys, counts, quality.Lower(k.astype(np.int64), c, off)


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    keys, counts, lower = model_of(["".join(map(chr, rng.integers(97, 101, 2000))) for _ in range(2)])
    for context in (keys[10] >> np.uint64(8), np.uint64(0x6161626364), np.uint64(0x0101020304)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (2 ** quality.log2_p(every, keys, counts, lower)).sum() == pytest.approx(1)


def brute_kneser_ney(train, texts):
    """Bits a byte by dictionaries of tuples: interpolated modified Kneser-Ney as published, of order ORDER down to a uniform distribution."""
    n = quality.ORDER
    pad = lambda t: (quality.PAD,) * (n - 1) + tuple(t.encode())
    grams: dict = {n: {}}
    for t in train:
        s = pad(t)
        for i in range(n - 1, len(s)):
            g = s[i - n + 1 : i + 1]
            grams[n][g] = grams[n].get(g, 0) + 1
    for m in range(n - 1, 0, -1):
        grams[m] = {}
        for g in grams[m + 1]:
            grams[m][g[1:]] = grams[m].get(g[1:], 0) + 1
    off, total, left = {}, {}, {}
    for m, table in grams.items():
        of = {i: sum(v == i for v in table.values()) for i in (1, 2, 3, 4)}
        off[m] = quality.discounts(of)
        for g, v in table.items():
            total[g[:-1]] = total.get(g[:-1], 0) + v
            left[g[:-1]] = left.get(g[:-1], 0) + off[m][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        context, below = g[:-1], p(g[1:])
        if context not in total:
            return below
        v = grams[len(g)].get(g, 0)
        return (max(v - off[len(g)][min(v, 3) - 1], 0) if v else 0) / total[context] + left[context] / total[context] * below

    out = []
    for t in texts:
        s = pad(t)
        bits = [-np.log2(p(s[i - n + 1 : i + 1])) for i in range(n - 1, len(s))]
        out.append(np.mean(bits) if bits else None)
    return out


def test_scores_match_brute_force(spark, monkeypatch):
    """Through shards and blocks, of trusted and other texts, against dictionaries."""
    monkeypatch.setattr(quality, "ANSWERED", 2)
    rng = random.Random(2)
    words = ["uno", "due", "tre", "perché", "anno", "mare", "日本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["", "x", "qqqq zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")
    got = {r["doc_id"]: r["bits_per_byte"] for r in quality.score(df, trusted).collect()}
    for i, want in enumerate(brute_kneser_ney([texts[i] for i in range(0, 40, 2)], texts)):
        assert got[i] == (None if want is None else pytest.approx(want, abs=0.6 / quality.FINE))
    monkeypatch.setattr(quality, "FEW", 3)  # ids joined by a shuffle
    again = {r["doc_id"]: r["bits_per_byte"] for r in quality.score(df, trusted).collect()}
    assert all((got[i] is None) == (again[i] is None) and (got[i] is None or got[i] == pytest.approx(again[i])) for i in got)


def test_limits_are_quantiles(spark):
    """Of held-out documents by language; a language without one takes that of all languages."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b"]), rng.random()) for i in range(400)] + [(900 + i, "c", 0.5) for i in range(3)] + [(950, "d", 0.1)]
    held = {i: rng.random() < 0.5 for i in range(400)} | {900 + i: False for i in range(3)}
    scored = spark.createDataFrame(rows, "doc_id long, lang string, bits_per_byte double")
    trusted = spark.createDataFrame(list(held.items()), "doc_id long, held_out boolean")
    got = {r["_vl_lang"]: r["limit"] for r in quality.thresholds(scored, trusted, "doc_id", "lang", 0.9).collect()}

    def quantile(langs):
        x = sorted(round(v * quality.STEPS) for i, lang, v in rows if lang in langs and held.get(i))
        return x[-(-9 * len(x) // 10) - 1] / quality.STEPS

    assert got == {"la": quantile("a"), "lb": quantile("b"), "lc": quantile("ab")}


def test_shards(odd, none):
    got = sharding.shard_documents(odd, 3).toPandas()
    assert len(got) == 10 and set(got["shard"]) <= {0, 1, 2}
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.shard_documents(none).count() == 0


def test_a_text_with_most_rows_is_split(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = sharding.shard_documents(rows, 8).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 0.02 * sizes.mean()


def test_copies_share_a_shard(spark):
    """20 copies with 1 % of the rows, pairs, and a text with 3 % of the rows (of a shard's 4.2 %) stay together."""
    copies = F.when(F.col("id") < 20, "twenty").when(F.col("id") < 80, "sixty").when(F.col("id") < 280, F.concat(F.lit("pair"), F.floor(F.col("id") / 2)))
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.coalesce(copies, F.concat(F.lit("t"), "id")).alias("text"))
    got = sharding.shard_documents(rows, 24).toPandas()
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() <= 1.02 * sizes.mean()


def test_packing(odd, none):
    got = packing.pack_documents(odd).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= packing.SEQUENCE
    for p in got.itertuples():
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    assert (got["doc_id"] == 8).sum() == 2
    assert packing.pack_documents(none).count() == 0


def packs_well(got, padding):
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= packing.SEQUENCE
    least = -(-got["length"].sum() // packing.SEQUENCE)
    assert got["sequence_id"].nunique() <= least * (1 + padding) + 1


@pytest.mark.parametrize("lengths", ["ones", "short", "mixed", "edges"])
def test_packing_of_short_pieces(spark, lengths):
    rng = random.Random(1)
    sizes = {"ones": [1] * 9000, "short": [rng.randint(1, 70) for _ in range(9000)], "mixed": [rng.choice([1, 2, 5, 64, 65, 700, 4096, rng.randint(1, 4096)]) for _ in range(3000)], "edges": [64] * 63 + [65, 4096, 4081, 1]}[lengths]
    df = spark.createDataFrame([(i, 0, n, i, 9, 8) for i, n in enumerate(sizes)], "doc_id long, start long, length long, ids_crc32 long, sequence_id int, Offset int")
    got = packing.pack(df).toPandas()
    assert sorted(got.columns) == ["doc_id", "ids_crc32", "length", "offset", "sequence_id", "start"]
    assert sorted(got["length"]) == sorted(sizes)
    packs_well(got, 0.04)


def test_words_give_the_tokenizers_ids(monkeypatch):
    enc, rng = tokens.Words(tokens.default_path()), random.Random(3)
    texts = ["", "a\x1cb", "Don't it's we'LL", "ΑΣ ΣΑΣ.", "İstanbul I", "<|endoftext|> <|ENDOFTEXT|>", "a..., b!? ...", "é ́e", "a b", "ß. ẞ ŉ ǰ. ﬁ.", "'S 'T. 's."]
    texts += ["".join(rng.choice("aAbÉß.,!?;:'’<|>_-0٣ \n\t\x1d ́İΣσǅ日🙂") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    texts += [" ".join(rng.choice(["the", "Eau", "été", "A$$$", "x-y_z", "a<|b", "(no)", "l'eau"]) for _ in range(9)) for _ in range(60)]
    for known in (10, 1_000_000):  # with a memory that is emptied again and again, and with one that isn't
        monkeypatch.setattr(tokens, "KNOWN", known)
        for part in (texts[:7], texts, [], texts[100:]):
            ids, at = enc.encode(part)
            for t, a, b in zip(part, at[:-1], at[1:], strict=True):
                assert ids[a:b].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    ids, at = enc.encode([None, "a b", ""], end=7)
    assert ids[[at[1] - 1, at[2] - 1, at[3] - 1]].tolist() == [7, 7, 7] and at.tolist() == [0, 1, 4, 5] and at[-1] == len(ids)


def test_wide_vocabularies_are_refused(spark, monkeypatch):
    with pytest.raises(ValueError):
        token_counts.write_token_files(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), separator=70_000)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_separator_scan(spark, block, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN", 2)
    rng, want, rows = random.Random(block), [], []
    for f in range(4):
        docs = [[rng.randint(0, 9) for _ in range(rng.choice([0, 0, 1, 5, 40]))] for _ in range(rng.choice([0, 3, 12]))]
        flat = [x for d in docs for x in [*d, 99]] + ([7, 7] if f == 2 else [])
        want += [(f"f{f}", i, len(d)) for i, d in enumerate(docs)] + ([("f2", len(docs), 2)] if f == 2 else [])
        rows += [(f"f{f}", i, np.array(flat[i * block : (i + 1) * block], "<u2").tobytes()) for i in range(-(-len(flat) // block))]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "file string, block long, ids binary"), separator=99).collect()
    assert sorted((r["file"], r["ordinal"], r["n_tokens"]) for r in got) == sorted(want)


def test_token_files(odd, none):
    files, manifest = token_counts.write_token_files(odd)
    counts = manifest.join(token_counts.count_tokens(files), ["file", "ordinal"]).collect()
    assert len(counts) == 10 and {r["id"] for r in counts if r["n_tokens"] == 0} == {3, 4, 5}
    files, manifest = token_counts.write_token_files(none)
    assert token_counts.count_tokens(files).count() == manifest.count() == 0


def test_token_files_from_disk(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 9, 9, 3, 9], "<u2").tobytes())
    got = token_counts.count_tokens(token_counts.read_token_files(spark, f"file://{tmp_path}", block_ids=2), separator=9).orderBy("ordinal").collect()
    assert [(r["start"], r["n_tokens"]) for r in got] == [(0, 2), (3, 0), (4, 1)]


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/ b", "<p>x</p>", "n"), (2, None, "<p>x</p>", None), (3, "", None, "n"), (4, "u", "", "n"), (5, "u\r\nX: y", "ü" * 90_000, "n"), (None, "u", "<p>x</p>", "n"), (5, "u", "other", "n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_warc(spark, pages):
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == 7 and all(r["error"] is None for r in got)
    by = {(warc.page_of(r["record_id"]), r["record_type"], warc.page_of(r["refers_to"])) for r in got}
    assert {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2)} == by
    assert any(r["payload"] == "ü".encode() * 0 + ("ü" * 90_000).encode() for r in got)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_errors(spark, tmp_path):
    good = warc.record(1, "u", b"hello", None)
    raw = zlib.decompress(good, 31)
    bad = [raw.replace(b"hello", b"jello"), raw[:-5], b"junk\r\n\r\n", raw.replace(b"sha1:" + warc.sha1_base32(b"hello").encode(), b"sha1:" + b"A" * 32)]
    pack = lambda x: (lambda c: c.compress(x) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    (tmp_path / "a.warc.gz").write_bytes(good + b"".join(map(pack, bad)) + good[:-3])
    got = warc.read_files(spark, f"file://{tmp_path}").orderBy("position").collect()
    assert [r["error"] for r in got] == [None, "block digest", "content-length", "header", "payload digest", "gzip"]
    assert got[0]["payload"] == b"hello"


def test_warc_goes_on_after_a_gap(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 37)
    good = [warc.record(i, "u", b"hello %d" % i, None) for i in range(4)]
    broken = good[1][:40] + b"\x00" * 9 + good[1][49:]
    data = good[0] + b"garbage\x1f\x8b\x08more" + good[1] + broken + good[2] + b"\x1f\x8b\x08" + good[3] + b"end"
    got = list(warc.members(data))
    assert [c is None for _, c in got] == [False, True, False, True, False, True, False, True]
    assert [warc.page_of(warc.parse(c)["record_id"]) for _, c in got if c] == [0, 1, 2, 3]
    assert [at for at, c in got if c is None] == [len(good[0]), data.index(broken), data.index(good[3]) - 3, len(data) - 3]
    assert list(warc.members(b"")) == [] and list(warc.members(b"\x1f\x8b\x08")) == [(0, None)]


def png():
    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b";"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04cd\xff\xda\x00\x04ef\x12\xff\x00\x34\xff\xd9"
MP4 = struct.pack(">I", 16) + b"ftypisom" + b"\0\0\0\0" + struct.pack(">I", 8) + b"moov"


def test_sniff():
    p = png()
    for data, kind in ((p, "image/png"), (GIF, "image/gif"), (BMP, "image/bmp"), (JPEG, "image/jpeg"), (MP4, "video/mp4")):
        assert media.sniff(data) == [(0, len(data), kind)]
        assert media.sniff(b"abc" + data + b"tail") == [(3, len(data), kind)]
        assert media.sniff(data[:-1]) == []
    assert media.sniff(p.replace(b"IDAT", b"IDAX")) == []
    assert media.sniff(b"BM RIFF GIF89a OggS ftyp \xff\xd8\xff") == media.sniff(b"") == []


def test_sniff_column(spark):
    p = png()
    rows = [(1, p, "image/jpeg", 5), (2, b"text" + p, "text/plain", 5), (3, None, "x", 5), (4, b"", None, 5)]
    got = media.sniff_column(spark.createDataFrame(rows, "id long, body binary, said string, corrected int"), "body", "said").orderBy("id").collect()
    assert [(r["detected_type"], r["is_valid"], r["corrected"], len(r["embedded"])) for r in got] == [("image/png", True, True, 0), ("text/plain", False, False, 1), (None, None, None, 0), (None, False, False, 0)]
    assert got[1]["embedded"][0]["offset"] == 4


def test_carved_bytes(spark):
    p = png()
    rows = [(1, b"text" + p + b"--" + GIF, "a"), (2, p, "b"), (3, None, "c"), (4, b"", None)]
    df = spark.createDataFrame(rows, "id long, body binary, media string")
    got = media.carve(df, "body").orderBy("media_offset").collect()
    assert [(r["id"], r["media_offset"], r["media_type"], bytes(r["media"])) for r in got] == [(1, 4, "image/png", p), (1, 6 + len(p), "image/gif", GIF)]
    assert media.carve(df.select("body"), "body").count() == 2 and media.carve(df.limit(0), "body").count() == 0


def ogg_page(body, flags):
    head = b"OggS\0" + bytes([flags]) + b"\0" * 8 + struct.pack("<II", 1, 0)
    table = bytes([1, len(body)])
    crc = 0
    for b in head + b"\0" * 4 + table + body:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return head + struct.pack("<I", crc) + table + body


def test_sniff_ogg():
    data = ogg_page(b"first", 2) + ogg_page(b"last", 4)
    assert media.sniff(data) == [(0, len(data), "audio/ogg")]
    assert media.sniff(data[:-1] + b"!") == []


def test_wav_round_trip(spark):
    payload = bytes(range(256)) * 9
    df = spark.createDataFrame([(payload,)], "p binary").select(media.wav(F.col("p"), F.octet_length("p").cast("long")).alias("w"))
    data = bytes(df.first()["w"])
    assert media.sniff(data)[0] == (0, len(payload) + 44, "audio/wav") and bytes(media.wav_samples(data)) == payload


def relayed(monkeypatch):
    """Two ranges of shards, and relays between."""
    monkeypatch.setattr(blocks, "FAN", 2)
    monkeypatch.setattr(blocks, "LEAST_SHARDS", 6)


def test_relays_give_the_same(spark, odd, monkeypatch):
    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(120)) for _ in range(9)]
    df = spark.createDataFrame([(i, base[rng.randrange(9)] + (f" x{i}" if i % 3 else "")) for i in range(60)] + [(99, None)], "doc_id long, text string").repartition(7)
    near = ngram_join.near_duplicates(df).toPandas().sort_values("doc_id", ignore_index=True)
    kept = substring_dedup.dedup_substrings(df).toPandas().sort_values("doc_id", ignore_index=True)
    relayed(monkeypatch)
    assert blocks.sized(blocks.into_blocks(df, "text")).relays > 1
    assert ngram_join.near_duplicates(df).toPandas().sort_values("doc_id", ignore_index=True).equals(near)
    assert substring_dedup.dedup_substrings(df).toPandas().sort_values("doc_id", ignore_index=True).equals(kept)
    assert substring_dedup.dedup_substrings(odd).count() == 10


def test_requests_of_a_block_are_bounded(spark):
    """100 TB: a million shards, yet at most FAN rows a block and about FAN blocks a relay."""
    n = 10_000
    table = spark.range(n).select((F.col("id") * 1664 * (1 << blocks.SEQ)).alias("block"), F.lit(100 * 10**12 // n).alias("n_bytes"))
    got = blocks.sized(table)
    assert got.shards > 990_000 and got.relays >= n // blocks.FAN and got.ranges() == blocks.FAN
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 400_000, dtype=np.uint64) * np.uint64(2))
    rows = list(blocks.by_shard(keys, got.ranges()))
    assert len(rows) <= blocks.FAN and sum(len(k) for _, k, _ in rows) == len(keys)
    fine = blocks.shard_of(keys, got.shards)
    assert (fine // np.uint64(got.shards // got.fan) == blocks.shard_of(keys, got.fan)).all()


def test_pairs_of_halves():
    high, low = np.array([1, 1, 2, 3], np.uint64), np.array([4, 6, 8, 2], np.uint64)
    of_high, of_low = np.array([1, 3, 1], np.uint64), np.array([6, 8, 2], np.uint64)
    assert blocks.member_pair(high, low, of_high, of_low).tolist() == [False, True, False, False]


def test_words_that_are_long_or_across_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(blocks, "CHUNK", 100)
    monkeypatch.setattr(blocks, "WORDS", 7)
    monkeypatch.setattr(blocks, "_powers", {})
    rng = random.Random(9)
    words = ["a", "bb", "x" * 64, "x" * 65, "y" * 500, "é" * 40]
    text = [rng.choice(words) for _ in range(200)]
    w = blocks.WordTable(pa.array([" ".join(text[:90]), " ".join(text[90:])]))
    for i, a in enumerate(text):
        for j, b in enumerate(text):
            assert (w.hash[i] == w.hash[j]) == (a == b)
    for second in (False, True):
        h = w.windows(3, second)
        for i in range(87):
            for j in range(i):
                assert (h[i] == h[j]) == (text[i : i + 3] == text[j : j + 3])
    assert not (w.windows(3) == w.windows(3, True)).any()
    assert (blocks.WordTable(pa.array(["AB" * 50 + " Ab"]), lower=True).hash == blocks.WordTable(pa.array(["ab" * 50 + " ab"])).hash).all()


def test_word_table_matches_re():
    import pyarrow as pa

    texts = ["", " ", "a", " a  b\n", "é\x0bü x", "\x1fa b", "a b"]
    w = blocks.WordTable(pa.array(texts))
    data = bytes(w.data)
    got = [[data[w.start[i] : w.end[i]].decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [re_words(t) for t in texts]
