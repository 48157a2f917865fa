"""Books from files to answers: segmentation, overrides, chunks, pages, search, rules, knowledge, state and packing."""

from __future__ import annotations

import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.operators import chunk, index, integrity, knowledge, manifest, overrides, pages, rules, search, segment, status
from vellum.sources import readers, sinks
from vellum.streaming import ingest

BODY = "Una frase abbastanza lunga da contare come corpo del capitolo, con parole vere. "


def split(spark, text, **kw):
    chapters, dropped = segment.split_chapters(spark.createDataFrame([("b", text)], "book_id string, text string"), **kw)
    return chapters.orderBy("ord", "seq").collect(), dropped.orderBy("seq").collect()


def part(title, n=20):
    return f"{title}\n\n{BODY * n}\n\n"


def test_headings_keep_sub_headings_inside(spark):
    got, _ = split(spark, part("# Uno") + part("## dettaglio") + part("# Due"))
    assert [(c["ord"], c["chapter_id"], c["title"]) for c in got] == [(1, "ch001", "Uno"), (2, "ch002", "Due")]
    assert "## dettaglio" in got[0]["text"] and got[0]["hash"].startswith("sha256:") and got[1]["file"] == "002_due.md"


def test_front_matter_is_dropped_and_kept_apart(spark):
    text = part("# Indice", 5) + part("# Uno") + part("# Ringraziamenti", 5) + part("# Due")
    got, dropped = split(spark, text)
    assert [c["title"] for c in got] == ["Uno", "Due"] and [d["title"] for d in dropped] == ["Indice", "Ringraziamenti"]
    assert len(split(spark, text, drop_front_matter=False)[0]) == 4


def test_dividers_join_neighbours(spark):
    got, _ = split(spark, "# Parte prima\n\n" + part("# Uno") + "# Parte seconda\n\n" + part("# Due") + "# Breve\n\n" + BODY + BODY.strip() * 2)
    assert [c["title"] for c in got] == ["Uno", "Due", "Breve"]
    assert got[0]["text"].startswith("# Parte prima") and got[0]["text"].endswith("# Parte seconda") and got[0]["n_merged"] == 2


def test_preface_and_fallbacks(spark):
    got, _ = split(spark, BODY * 6 + "\n\n" + part("# Uno") + part("# Due"))
    assert [(c["ord"], c["title"]) for c in got] == [(0, segment.PREFACE), (1, "Uno"), (2, "Due")]
    got, _ = split(spark, part("Capitolo 1") + part("Chapter two"))
    assert [c["title"] for c in got] == ["Capitolo 1", "Chapter two"]
    for text in ("niente titoli", "", None):
        got, _ = split(spark, text)
        assert [(c["ord"], c["title"], c["text"]) for c in got] == [(1, segment.WHOLE_BOOK, text or "")]


BOOK = overrides.Book(tuple(overrides.Part(t, f"{t} text, second half", i + 2, t == "intro") for i, t in enumerate(["intro", "a", "b", "c"])), (overrides.Part("Index", "x", 1), overrides.Part("Notes", "y", 9)))


def after(*actions):
    book = BOOK
    for a in actions:
        book = overrides.step(book, a)
    return [(n, c.title) for n, c in zip(book.numbers(), book.chapters, strict=True)], book


def test_edits_of_a_book():
    """Each kind, and numbers that follow the action before; a preface keeps 0 under any title, and an equal title isn't a preface."""
    assert after()[0] == [(0, "intro"), (1, "a"), (2, "b"), (3, "c")]
    titles, book = after({"action": " Merge ", "chapters": [3, 1]})
    assert titles == [(0, "intro"), (1, "b"), (2, "c")] and book.chapters[2].text == "c text, second half\n\na text, second half"
    titles, book = after({"action": "split_at", "chapter": 2, "at": ", second"}, {"action": "rename", "chapter": 3, "title": "B2"}, {"action": "split_at", "chapter": 1, "at": "second", "title": "A2"})
    assert titles == [(0, "intro"), (1, "a"), (2, "A2"), (3, "b"), (4, "B2"), (5, "c")] and book.chapters[3].text == "b text" and book.chapters[4].text == ", second half"
    assert after({"action": "rename", "chapter": 0, "title": "Start"}, {"action": "rename", "chapter": 1, "title": segment.PREFACE})[0][:2] == [(0, "Start"), (1, segment.PREFACE)]
    assert after({"action": "rename", "chapter": 1})[0] == after()[0]
    titles, book = after({"action": "drop", "chapter": 0}, {"action": "drop", "chapter": 1}, {"action": "undrop", "title": "INTRO"}, {"action": "undrop", "title": "dex"})
    assert titles == [(1, "Index"), (0, "intro"), (2, "b"), (3, "c")] and [p.title for p in book.shelf] == ["Notes", "a"]
    made = {"action": "split_at", "chapter": 1, "at": "second", "title": "new"}
    assert after(made, {"action": "drop", "chapter": 2}, {"action": "undrop", "title": "new"})[0][-1] == (4, "new")


@pytest.mark.parametrize("action", [{"action": "merge", "chapters": [1]}, {"action": "merge", "chapters": [1, 8]}, {"action": "split_at", "chapter": 1, "at": "a text"}, {"action": "split_at", "chapter": 1}, {"action": "split_at", "at": "x"}, {"action": "drop", "chapter": "one"}, {"action": "undrop", "title": " "}, {"action": "undrop", "title": "zzz"}, {"action": "turn"}, {}])
def test_wrong_edits(action):
    with pytest.raises(overrides.OverrideError):
        overrides.step(BOOK, action)


def test_edits_of_many_books(spark):
    texts = [(b, part("# Indice", 3) + part(f"# {b} one") + part("# Two")) for b in "xyz"]
    chapters, dropped = segment.split_chapters(spark.createDataFrame(texts, "book_id string, text string"))
    got = overrides.apply_overrides(chapters, dropped, {"x": [{"action": "undrop", "title": "indice"}], "y": [{"action": "merge", "chapters": [1, 2]}]})
    assert sorted((c["book_id"], c["chapter_id"], c["title"]) for c in got.collect()) == [("x", "ch001", "Indice"), ("x", "ch002", "x one"), ("x", "ch003", "Two"), ("y", "ch001", "y one"), ("z", "ch001", "z one"), ("z", "ch002", "Two")]
    with pytest.raises(Exception, match="OverrideError"):
        overrides.apply_overrides(chapters, dropped, {"z": [{"action": "drop", "chapter": 7}]}).collect()


def fold(text, target, overlap):
    out, buf = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(buf) + len(p) + 2 <= target:
            buf = (buf + "\n\n" + p).strip()
        elif buf:
            out.append(buf)
            buf = (buf[-overlap:] + "\n\n" + p).strip()
        else:
            out += [p[i : i + target] for i in range(0, len(p), target)]
    return out + [buf] * bool(buf)


def test_chunks_by_a_plain_loop(spark):
    rng = random.Random(2)
    texts = ["\n \n".join("".join(rng.choice("ab \n😀") for _ in range(rng.choice([0, 3, 20, 60, 130]))) for _ in range(rng.randint(0, 8))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", chunk.chunk_texts(F.col("text"), 50, 10).alias("c"))
    for r in df.collect():
        assert r["c"] == fold(texts[r["i"]], 50, 10), repr(texts[r["i"]])


def test_chunk_ids_and_parts(spark):
    rows = [("b", 1, "ch001", "t", "x " * 3000, "h1"), ("b", 2, "ch002", "u", "y\n\nz", "h2")]
    df = spark.createDataFrame(rows, "book_id string, ord int, chapter_id string, title string, text string, hash string")
    got = chunk.chunks(df).orderBy("ord").collect()
    assert [(c["id"], c["ord"]) for c in got] == [("chunk_ch001_0001", 1), ("chunk_ch001_0002", 2), ("chunk_ch001_0003", 3), ("chunk_ch002_0001", 4)]
    parts = chunk.parts(df, 1000)
    assert parts.where("chapter_id = 'ch002'").first()["parts_total"] == 1
    mine = parts.where("chapter_id = 'ch001'").orderBy("part").collect()
    assert "".join(p["text"] for p in mine) == rows[0][4] and all(len(p["text"]) <= 1000 for p in mine)
    assert chunk.read_part(parts, "ch001", f"2/{len(mine)}").first()["text"] == mine[1]["text"]
    with pytest.raises(ValueError, match="i/k"):
        chunk.read_part(parts, "ch001", "3/2")


def test_pages(spark):
    raw = [f"IL TITOLO DEL LIBRO\nprima riga della pagina {i}\nparola spez-\nzata e altro\nultima riga {i}\n{i}" for i in range(1, 5)] + ["", "7"]
    df = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(raw)], "book_id string, page_number int, text string")
    lines = pages.page_lines(df)
    assert [r["line"] for r in pages.running_lines(lines).collect()] == ["IL TITOLO DEL LIBRO"]
    clean = pages.clean_pages(df)
    texts = [r["text"] for r in clean.orderBy("page_number").collect()]
    assert texts[0] == "prima riga della pagina 1\nparola spezzata e altro\nultima riga 1" and texts[4:] == ["", ""]
    offsets = pages.page_offsets(clean)
    full = pages.book_text(clean).first()["text"]
    at = {r["page"]: r["offset"] for r in offsets.collect()}
    assert len(at) == 4 and all(full[at[p] :].startswith(f"prima riga della pagina {p}") for p in at)
    points = spark.createDataFrame([("b", at[3]), ("b", at[3] - 1), ("b", -1), ("c", 0)], "book_id string, offset long")
    assert sorted((r["book_id"], r["offset"], r["page"]) for r in pages.page_at(points, offsets.unionByName(offsets.limit(0))).collect() if r["page"]) == [("b", at[3] - 1, 2), ("b", at[3], 3)]
    chapters = spark.createDataFrame([("b", "ch001", full)], "book_id string, chapter_id string, text string")
    piece = spark.createDataFrame([("b", "c1", "ch001", full[at[2] : at[3] + 20]), ("b", "c2", "ch001", "manca")], "book_id string, id string, chapter_id string, text string")
    got = {r["id"]: (r["page_start"], r["page_end"]) for r in pages.chunk_pages(piece, chapters, pages.book_text(clean), offsets).collect()}
    assert got["c1"][0] == 2 and got["c1"][1] == 3 and got["c2"] == (None, None)


@pytest.fixture(scope="module")
def library(spark):
    text = "# Il metodo\n\n" + "Perché il dialogo richiede ascolto. " * 60 + "\n\n# La scelta\n\n" + "Ogni scelta nasce da un dialogo interiore e dalle scelte di altri. " * 40
    books = spark.createDataFrame([("b", text, "it")], "book_id string, text string, language string")
    chapters, _ = segment.split_chapters(books)
    chunks = chunk.chunks(chapters).persist()
    return books, chapters.persist(), chunks


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")


def test_search(spark, library, tmp_path):
    books, _, chunks = library
    built = index.build(chunks, books)
    hits = search.search(built, ask(spark, "dialoghi", "perche", "", '"?" AND (', "zzz")).collect()
    found = {q: [h["chapter_title"] for h in hits if h["query_id"] == q] for q in range(5)}
    assert len(found[0]) == 2 and found[1] and set(found[1]) == {"Il metodo"} and not found[2] and not found[3] and not found[4]
    index.write(built, str(tmp_path / "ix"))
    again = search.search(index.read(spark, str(tmp_path / "ix")), ask(spark, "dialoghi")).collect()
    assert [(h["id"], round(h["bm25"], 9)) for h in sorted(again, key=lambda h: h["rank"])] == [(h["id"], round(h["bm25"], 9)) for h in sorted((h for h in hits if h["query_id"] == 0), key=lambda h: h["rank"])]
    assert not search.search(index.build(chunks, books.withColumn("language", F.lit("de"))), ask(spark, "dialoghi")).count()


def encoder():
    """A bag of words hashed to 64 numbers; made in a function, so that it travels to workers by value."""
    import re
    import zlib

    def encode(texts):
        out = []
        for t in texts:
            v = [0.0] * 64
            for w in re.findall(r"\w+", t.lower()):
                v[zlib.crc32(w.encode()) % 64] += 1.0
            out.append(v)
        return out

    return encode


def test_hybrid_and_context(spark, library):
    _, _, chunks = library
    encode = encoder()
    built = index.build(chunks, encode=encode)
    asked = spark.createDataFrame([(0, encode(["dialogo ascolto"])[0])], "query_id long, vector array<double>").withColumn("vector", index.unit("vector"))
    hits = search.search(built, ask(spark, "dialogo ascolto"), 3, True, asked)
    got = hits.orderBy("rank").collect()
    assert [h["rank"] for h in got] == [0, 1, 2][: len(got)] and all(h["rrf"] > 0 for h in got) and got[0]["chapter_title"] == "Il metodo"
    assert all(h["rrf"] is None for h in search.search(built, ask(spark, "dialogo"), 3, False, asked).collect())
    one = search.contexts(hits, len(got[0]["text"]) + 60).first()
    assert one["n_blocks"] == 1 and one["context"].startswith(f"[{got[0]['id']} | ")


def test_reading(spark, library):
    _, chapters, _ = library
    assert [c["title"] for c in search.list_chapters(chapters).orderBy("ord").collect()] == ["Il metodo", "La scelta"]
    assert search.read_chapter(chapters, "2").first()["text"].startswith("# La scelta")
    assert search.read_chapter(chapters, "METODO").first()["text"].startswith("# Il metodo")
    assert search.read_chapter(chapters, "manca").count() == 0


CARD = {
    "chapter_id": "ch001", "title": "Il metodo", "coverage": {"parts_read": 1, "parts_total": 1}, "funzione": "apre", "riassunto": "r" * 300, "tesi": "ascolto",
    "concetti": [{"name": "ascolto", "definition": "d", "chunk_ids": ["chunk_ch001_0001"]}, {"name": "dialogo", "definition": "d", "chunk_ids": ["chunk_ch001_0001"]}],
    "claims": [{"claim": "c", "tipo": "testo", "chunk_ids": ["chunk_ch001_0001"], "anchors": ["PERCHE il  dialogo"]}, {"claim": "i", "tipo": "inferenza", "chunk_ids": ["chunk_ch001_0001"]}],
    "passaggi": [{"testo": "dialogo richiede ascolto", "chunk_id": "chunk_ch001_0001"}], "domande": ["q"], "obiezioni": [], "applicazioni": ["a"], "cosa_memorizzare": "m",
    "chunk_summaries": [{"chunk_id": "chunk_ch001_0001", "summary": "s"}], "extra": 1,
}
SYNTHESIS = {"tesi_centrale": "t", "formula": "f", "mappa": ["m"], "argomentazione": "a", "concetti_globali": [{"name": "n", "definition": "d", "chapter_ids": ["ch001"]}], "domande_profonde": ["d"], "limiti": ["l"], "collegamenti_esterni": []}


def changed(**kw):
    return json.dumps(CARD | kw)


def claim(**kw):
    return [CARD["claims"][0] | kw]


def test_rules(spark, library):
    _, chapters, chunks = library
    state = chapters.select("book_id", "chapter_id", F.lit(1).alias("parts_total"))
    cases = {
        json.dumps(CARD): None, "{": (0, "JSON"), changed(riassunto="corto"): (1, "riassunto"), changed(title=""): (1, "title"), changed(concetti=[]): (1, "concetti"),
        changed(claims=claim(tipo="x")): (1, "tipo"), changed(chapter_id="ch002"): (2, "another chapter"), changed(coverage={"parts_read": 0, "parts_total": 1}): (3, "not all parts"),
        changed(coverage={"parts_read": 2, "parts_total": 2}): (3, "another number"), changed(tesi="R" * 300): (4, "thesis"), changed(claims=claim(chunk_ids=["chunk_ch001_0099"])): (6, "doesn't exist"),
        changed(claims=claim(chunk_ids=["chunk_ch002_0001"])): (6, "belongs to"), changed(claims=claim(anchors=[])): (6, "needs a quotation"), changed(claims=claim(anchors=["due parole"])): (6, "three words"),
        changed(claims=claim(anchors=["parole che mancano qui"])): (6, "isn't in"), changed(passaggi=[{"testo": "non è scritto qui", "chunk_id": "chunk_ch001_0001"}]): (7, "isn't in"),
        changed(chunk_summaries=[{"chunk_id": "chunk_ch009_0001", "summary": "s"}]): (8, "doesn't exist"),
    }
    for_book = spark.createDataFrame([(f"b{i}", "ch001", c) for i, c in enumerate(cases)], "book_id string, chapter_id string, card string")
    many = spark.range(len(cases)).select(F.concat(F.lit("b"), "id").alias("n"))
    spread = lambda df: many.crossJoin(df.drop("book_id")).withColumnRenamed("n", "book_id")
    bad = rules.card_violations(for_book, spread(chunks), spread(state)).persist()
    first = {r["book_id"]: (r["rule"], r["message"]) for r in bad.groupBy("book_id").agg(F.min_by("rule", F.struct("rule", "item")).alias("rule"), F.concat_ws("; ", F.collect_list("message")).alias("message")).collect()}
    for i, want in enumerate(cases.values()):
        got = first.get(f"b{i}")
        assert (got is None) == (want is None), (i, got, want)
        if want:
            assert got[0] == want[0] and want[1] in got[1], (got, want)
    assert [r["book_id"] for r in rules.accepted(for_book, bad).collect()] == ["b0"]
    assert rules.first_errors(bad).count() == len(cases) - 1


def test_synthesis_rules(spark, library):
    _, chapters, _ = library
    done = chapters.select("book_id", "chapter_id", F.lit("committed").alias("status"))

    def bad(data, state=done):
        return [r["message"] for r in rules.synthesis_violations(spark.createDataFrame([("b", json.dumps(data))], "book_id string, synthesis string"), state).collect()]

    assert bad(SYNTHESIS) == []
    assert "aren't committed" in bad(SYNTHESIS, done.withColumn("status", F.lit("pending")))[0]
    assert "doesn't exist" in bad(SYNTHESIS | {"concetti_globali": [{"name": "n", "definition": "d", "chapter_ids": ["ch077"]}]})[0]
    assert bad(SYNTHESIS | {"mappa": []}) and bad({k: v for k, v in SYNTHESIS.items() if k != "limiti"})


def test_knowledge(spark, library):
    _, _, chunks = library
    cards = spark.createDataFrame([("b", "ch001", json.dumps(CARD))], "book_id string, chapter_id string, card string")
    tables = knowledge.flatten(cards)
    assert {k: v.count() for k, v in tables.items()} == {"claims": 2, "concepts": 2, "questions": 1, "objections": 0, "applications": 1}
    one = knowledge.annotate(chunks, cards).where("id = 'chunk_ch001_0001'").first()
    assert one["summary"] == "s" and one["keywords"] == ["ascolto", "dialogo"]
    text = knowledge.render_cards(cards).first()["markdown"]
    assert "- **ascolto**: d [chunk_ch001_0001]" in text and "## Obiezioni\n\n- (vuoto)" in text
    syn = spark.createDataFrame([("b", json.dumps(SYNTHESIS))], "book_id string, synthesis string")
    assert "## Limiti\n\n- l" in knowledge.render_syntheses(syn).first()["markdown"]
    assert knowledge.analysis(syn, "07").first()["value"] == '["l"]' and knowledge.analysis(syn, "zzz").first()["value"] == ""


def test_status_integrity_and_manifest(spark, library, tmp_path):
    books, chapters, chunks = library
    chapters = chapters.withColumn("parts_total", F.lit(1))
    log = status.event(books, "ingest").unionByName(status.event(books, "commit-chapter", "ch001"))
    state = status.chapter_status(chapters, log)
    none = books.select("book_id").limit(0)
    done = status.progress(state, none).first()
    assert (done["committed"], done["total"], done["next_pending"], done["complete"]) == (1, 2, "ch002", False)
    assert status.phases(books.select("book_id"), log).first()["phase"] == "analyzing"
    assert "[x] ch001" in status.render(state, status.phases(books.select("book_id"), log), status.progress(state, none)).first()["report"]
    cards = spark.createDataFrame([("b", "ch001", json.dumps(CARD))], "book_id string, chapter_id string, card string")
    syn = spark.createDataFrame([], "book_id string, synthesis string")

    def failed(chunks=chunks, cards=cards):
        return [r["label"] for r in integrity.check(books, chapters, chunks, state, cards, syn, none).where("not passed").collect()]

    assert failed() == []
    assert "[PASS]" in integrity.report(integrity.check(books, chapters, chunks, state, cards, syn, none)).first()["report"]
    assert failed(chunks.withColumn("chapter_id", F.when(F.col("ord") == 1, "ch099").otherwise(F.col("chapter_id")))) == ["no orphan chunks", "chapter hashes agree"]
    assert failed(cards=cards.limit(0)) == ["committed cards are there"]
    found = manifest.artefacts(chapters, chunks, cards)
    made = manifest.manifest(books, found, status.progress(state, none))
    assert made.first()["status"] == "partial" and len(made.first()["files"]) == 4
    assert manifest.verify(made, found).count() == 0
    assert {r["problem"] for r in manifest.verify(made, found.withColumn("hash", F.lit("x"))).collect()} == {"changed"}
    z = zipfile.ZipFile(io.BytesIO(sinks.pack({"a.md": "x", "notes/": ""}, {"status": "partial"})))
    assert set(z.namelist()) == {"a.md", "notes/.gitkeep", "MANIFEST.json"}


def test_tables(spark, library, tmp_path):
    _, chapters, _ = library
    path = str(tmp_path / "chapters")
    sinks.write_table(chapters, path)
    with pytest.raises(FileExistsError):
        sinks.write_table(chapters, path)
    sinks.write_table(chapters, path, force=True)
    assert spark.read.parquet(path).count() == 2
    sinks.write_jsonl(chapters.select("ord", F.lit(None).cast("string").alias("n")), str(tmp_path / "j"), ["ord"])
    assert readers.read_jsonl(spark, str(tmp_path / "j"), "ord int, n string").count() == 2
    assert readers.read_jsonl(spark, str(tmp_path / "missing"), "ord int").count() == 0
    sinks.write_json(spark, str(tmp_path / "d" / "x.json"), {"a": "è"})
    assert json.loads((tmp_path / "d" / "x.json").read_text()) == {"a": "è"}
    assert manifest.file_hashes(spark, str(tmp_path / "d")).first()["hash"].startswith("sha256:")


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="T1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="T1"/></w:pPr><w:r><w:t>Titolo</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>testo </w:t><w:t>qui</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="p" xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="2" href="b.html"/><item id="1" href="a.html"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>')
        z.writestr("o/a.html", "<h1>Uno</h1><p>testo</p>")
        z.writestr("o/b.html", "<h1>Due</h1>")
    return out.getvalue()


def test_readers_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name, data in (("a.txt", b"x\xff\r\n  y"), ("b.html", b"<h1>T</h1><p>p</p>"), ("c.docx", docx()), ("d.epub", epub()), ("e.xyz", b"?"), ("f.docx", b"broken"), ("g.mobi", b"m")):
        (src / name).write_bytes(data)
    got = {r["book_id"]: r for r in readers.read_documents(spark, str(src)).collect()}
    assert got["a"]["text"] == "x\n y" and got["b"]["text"] == "# T\n\np" and got["c"]["text"] == "# Titolo\n\ntesto qui"
    assert (got["d"]["text"], got["d"]["title"], got["d"]["author"]) == ("# Uno\n\ntesto\n\n# Due", "T", "A")
    assert all(got[k]["error"] and got[k]["text"] is None for k in "efg")
    with pytest.raises(Exception, match="isn't supported"):
        readers.read_documents(spark, str(src / "e.xyz"), strict=True).collect()
    out = str(tmp_path / "tables")
    for _ in range(2):
        ingest.ingest(ingest.document_stream(spark, str(src)), out, str(tmp_path / "ck")).awaitTermination()
        assert {r["book_id"] for r in spark.read.parquet(f"{out}/chapters").collect()} == {"a", "b", "c", "d"}


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "bm25_topk" in entry.queries()


def test_books_are_cut_in_one_pass(spark):
    """No shuffle, and the text is marked and cut once, however many columns are read."""
    books = spark.createDataFrame([(f"b{i}", f"# A {i}\n\n{'x ' * 200}\n\n# B\x85Chapter 1\n{'y ' * 200}\n# Index\nz") for i in range(20)] + [("none", None), ("one", "a\x0bb")], "book_id string, text string")
    found, dropped = segment.split_chapters(books)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    got = sorted((r["book_id"], r["ord"], r["title"], r["n_merged"]) for r in found.collect())
    assert got == sorted([(f"b{i}", n, t, 0) for i in range(20) for n, t in ((1, f"A {i}"), (2, "B"))] + [("none", 1, "Libro completo", 0), ("one", 1, "Libro completo", 0)])
    assert sorted(r["book_id"] for r in dropped.collect()) == sorted(f"b{i}" for i in range(20))
    assert {r["text"] for r in found.where("book_id in ('none', 'one')").collect()} == {"", "a\x0bb"}


def test_dense_sends_few_rows(spark):
    """Only a question's best rows of a meeting of blocks leave it; equal, missing and odd vectors keep their order."""
    from vellum.operators import search

    vectors = [("b", f"{i:04d}", [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(1000)] + [("b", "null", None), ("b", "gap", [1.0, None]), ("b", "long", [1.0, 0.0, 0.0]), ("b", "nan", [float("nan"), 0.0])]
    table = spark.createDataFrame(vectors, "book_id string, chunk_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id long, vector array<double>")
    found = search.dense(table, asked, 4)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["cosine"]) for r in found.collect()}
    assert len(got) == 12 and [got[1, i][0] for i in range(4)] == ["nan", "0001", "0002", "0004"] and [got[1, i][1] for i in (1, 2, 3)] == [1.0] * 3
    assert [got[2, i] for i in (1, 2, 3)] == [("0000", 0.8), ("0003", 0.8), ("0006", 0.8)]
    assert [got[3, i] for i in range(4)] == [(f"{i:04d}", None) for i in range(4)]
    few = search.dense(table, asked, 1004)
    assert few.count() == 3012
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # a pair of vectors was a row


def test_cards_are_parsed_once_for_all_rules(spark, data):
    """And once for quotations; neither cards nor chunks' texts are shuffled to find what the status or an id decides."""
    from vellum.plans import registry

    cards = registry.as_rule_cards(spark, data).drop("doc_id")
    chunks = registry.table(spark, data, "documents").select(F.lit("b").alias("book_id"), F.format_string("chunk_ch%03d_0001", "doc_id").alias("id"), F.format_string("ch%03d", "doc_id").alias("chapter_id"), "text")
    status = cards.select("book_id", "chapter_id", F.lit(2).alias("parts_total"))
    plan = rules.card_violations(cards, chunks, status)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 2
    plan = rules.coverage_violations(cards, status)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_quotations_in_any_of_the_cited_chunks(spark):
    """One in the second of two chunks, one in neither, a short one, one of a chunk that doesn't exist, the same one twice."""
    cited = spark.createDataFrame([("b", "ch001", 6, 0, "claims", ["x", "y"], ["alfa beta gamma", "not in there", "two words"]), ("b", "ch001", 7, 1, "passaggi", ["z"], ["alfa beta gamma"]), ("b", "ch001", 7, 2, "passaggi", ["x"], ["one two three", "one two three"])], "book_id string, chapter_id string, rule int, item int, what string, cited array<string>, anchors array<string>")
    chunks = spark.createDataFrame([("b", "x", "one two three"), ("b", "y", "Alfa\nBETA gamma")], "book_id string, id string, text string")
    want = [(6, 0, "claims[0]: a quotation has three words at least: two words"), (6, 0, "claims[0]: a quotation isn't in the cited chunks: not in there"), (7, 1, "passaggi[1]: a quotation isn't in the cited chunks: alfa beta gamma")]
    for few in (True, False):
        assert sorted((r["rule"], r["item"], r["message"]) for r in rules.anchor_violations(cited, chunks, few=few).collect()) == want


def test_scores_are_summed_in_bounded_parts(spark, monkeypatch):
    """Many questions with a frequent word: the same scores in more parts, each chunk's in one of them."""
    from vellum.operators import search

    docs = spark.createDataFrame([("b", f"{i:03d}", f"the word{i % 7} of the text {i}") for i in range(200)], "book_id string, id string, text string")
    asked = spark.createDataFrame([(q, f"the word{q % 7} {q}") for q in range(20)], "query_id long, question string")
    built = index.build(docs, columns=("text",))
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["bm25"], 9)) for r in df.collect())
    want = rows(search.bm25(built, asked, ("text",)))
    monkeypatch.setattr(search, "SCORES", 100)
    found = search.bm25(built, asked, ("text",))
    assert rows(found) == want and len(want) == 4000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 40), REPARTITION_BY_NUM" in plan
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, book_id", plan)  # scores aren't shuffled
