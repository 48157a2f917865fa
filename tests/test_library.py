from __future__ import annotations

import io
import json
import zipfile

import pytest
from test_books import CARD, SYNTHESIS, changed
from vellum import __main__ as cli
from vellum.library import CommitError, Library


def test_a_library_from_end_to_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "007.md").write_text("# Il metodo\n\n" + "Perché il dialogo richiede ascolto. " * 60 + "\n\n# La scelta\n\n" + "Ogni scelta nasce da un dialogo interiore. " * 40)
    (source / "007.meta.yaml").write_text("title: 'Dialoghi'\nauthor:\n- broken")
    (source / "rotto.docx").write_bytes(b"x")
    lib, out = Library(spark, str(tmp_path / "lib")), io.StringIO()

    def run(*argv):
        out.truncate(out.seek(0))
        return cli.run(lib, cli.parser().parse_args([lib.path, *map(str, argv)]), out), out.getvalue()

    assert run("ingest", source)[0] == 1  # one document is broken, the other is in
    assert [(r["book_id"], r["chapter_id"]) for r in lib.table("chapters").orderBy("ord").collect()] == [("007", "ch001"), ("007", "ch002")]
    card = tmp_path / "card.json"
    card.write_text(changed(riassunto="corto"))
    assert run("commit-chapter", "007", "ch001", card)[0] == 1 and lib.cards().isEmpty()
    card.write_text(json.dumps(CARD))
    assert run("commit-chapter", "007", "ch001", card)[0] == 0 and lib.cards().count() == 1
    assert "[x] ch001" in run("status")[1]
    syn = tmp_path / "syn.json"
    syn.write_text(json.dumps(SYNTHESIS))
    assert run("commit-synthesis", "007", syn)[0] == 1  # ch002 isn't committed
    run("index")
    assert run("search", "dialoghi")[1].startswith("1. 007 chunk_ch001_0001 Il metodo")
    assert "dialogo" in run("context", "dialogo")[1]
    assert "**ascolto**" in run("render", "007")[1] and "dialogo" in run("chapter", "007", "ch002")[1]
    assert json.loads(run("pack", "007", tmp_path / "a.zip")[1])["status"] == "partial"
    names = zipfile.ZipFile(tmp_path / "a.zip").namelist()
    assert {"analysis/chapters/ch001.json", "knowledge/claims.jsonl", "knowledge/chunks.jsonl", "render/twin.md"} <= set(names)
    assert {(r["title"], r["author"], r["language"]) for r in lib.table("books").where("error is null").collect()} == {("Dialoghi", None, "it")}
    cli.serve(lib, ['{"tool": "list_chapters", "args": {"book": "007"}}', '{"tool": "x"}'], reply := io.StringIO())
    first, second = map(json.loads, reply.getvalue().splitlines())
    assert [c["title"] for c in first["result"]] == ["Il metodo", "La scelta"] and "error" in second
    with pytest.raises(CommitError, match="committed"):
        lib.restructure({"007": [{"action": "merge", "chapters": [1, 2]}]})
    lib.restructure(force=True, actions={"007": [{"action": "rename", "chapter": 1, "title": "Altro"}, {"action": "merge", "chapters": [1, 2]}]})
    assert [r["title"] for r in lib.chapters("007").collect()] == ["Altro"] and lib.cards().isEmpty()


def test_pages_of_a_printed_book_reach_its_chunks(spark, tmp_path):
    """Running heads, page numbers and hyphens go, and chapters and chunks know their pages. The reader of PDF is one of our own."""
    source = tmp_path / "in"
    source.mkdir()
    body = [f"Riga {{p}}.{i} del capitolo, lunga quanto basta per essere corpo del testo e non un titolo, pagina {{p}}." for i in range(12)]
    pages = ["\n".join(["IL TITOLO", *([f"# Capitolo {p // 3 + 1}"] if p % 3 == 1 else []), *(x.format(p=p) for x in body[:4]), "una paro-\nla spezzata", *(x.format(p=p) for x in body[4:]), str(p)]) for p in range(1, 7)]
    (source / "libro.pdf").write_text("\f".join(pages))
    (source / "vuoto.PDF").write_text(" \f ")
    (source / "rotto.pdf").write_bytes(b"\xff")

    lib = Library(spark, str(tmp_path / "lib"))
    bad = {r["book_id"]: r["error"] for r in lib.ingest(str(source), pdf=lambda data: data.decode().split("\f")).collect()}
    assert "OCR" in bad["vuoto"] and "UnicodeDecodeError" in bad["rotto"] and len(bad) == 2
    text = lib.table("books").where("book_id = 'libro'").first()["text"]
    assert "IL TITOLO" not in text and "una parola spezzata" in text and "\n3\n" not in text
    assert [(r["title"], r["page_start"]) for r in lib.chapters("libro").orderBy("ord").collect()] == [("Capitolo 1", 1), ("Capitolo 2", 4)]
    for r in lib.table("chunks").collect():
        first = next(p for p in range(1, 7) if f"pagina {p}." in r["text"])
        assert r["page_start"] <= first <= r["page_end"]
    assert lib.table("page_map").count() == 6


def test_prompts():
    assert cli.prompt("Answer", question="{why}?", context="c").endswith("Question: {why}?\n\nc") and "{book}" in cli.prompt("stud", chapter="ch001") and cli.prompt("zzz") == cli.prompt("") == ""
