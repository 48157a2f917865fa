"""The command line: python -m vellum LIBRARY COMMAND ..."""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .library import CommitError, Library
from .operators import knowledge, overrides, search


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellum")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("library", help="path of the tables")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", **({"action": "store_true"} if v is True else {"default": v, "type": type(v)} if v is not None else {}))

    command("ingest", "source", force=True, keep_front_matter=True, language="it")
    command("restructure", "book", "override", force=True)
    command("status")
    command("chapter", "book", "chapter", part=None)
    command("commit-chapter", "book", "chapter", "card")
    command("commit-synthesis", "book", "synthesis")
    command("index")
    command("search", "question", k=search.TOP_K)
    command("context", "question", k=search.TOP_K, max_chars=search.CONTEXT)
    command("render", "book")
    command("pack", "book", "archive")
    command("validate")
    command("serve")
    return p


#: Questions that a client may ask with; what stands in braces is filled from the arguments.
PROMPTS = {
    "study": "Read chapter {chapter} of {book} part by part. Write its card: what it does in the book, a summary, its thesis, its concepts and claims with the chunks they rest on, and quotations word by word.",
    "answer": "Answer from the passages below only, and name the chunk that each statement rests on. Say so if they don't hold the answer.\n\nQuestion: {question}\n\n{context}",
}


def prompt(name: str, **values) -> str:
    """A prompt by its name or a part of it, filled as far as values are given; one that isn't known is empty."""
    low = name.strip().lower()
    found = PROMPTS.get(low) or next((text for key, text in PROMPTS.items() if low and low in key), "")
    return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), found)


def tools(lib: Library) -> dict:
    """What the query server answers: each takes named arguments and returns what JSON can hold."""

    def rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def hits(question: str, k: int = search.TOP_K) -> list[dict]:
        return rows(lib.search(lib.questions(question), int(k)).orderBy("rank"))

    def about(book: str) -> dict | None:
        found = rows(lib.table("books").where(F.col("book_id") == book).select("book_id", "title", "author", "language"))
        return found[0] if found else None

    return {
        "search": hits,
        "context": lambda question, k=search.TOP_K, max_chars=search.CONTEXT: "".join(r["context"] for r in rows(lib.context(lib.questions(question), int(k), int(max_chars)))),
        "list_chapters": lambda book: rows(search.list_chapters(lib.chapters(book)).orderBy("ord")),
        "read_chapter": lambda book, chapter: next((r["text"] for r in rows(search.read_chapter(lib.chapters(book), str(chapter)))), ""),
        "analysis": lambda book, section: next((r["value"] for r in rows(knowledge.analysis(lib.syntheses().where(F.col("book_id") == book), section))), ""),
        "concepts": lambda book: rows(lib.knowledge()["concepts"].where(F.col("book_id") == book).orderBy("chapter_id", "pos")),
        "claims": lambda book: rows(lib.knowledge()["claims"].where(F.col("book_id") == book).orderBy("chapter_id", "pos")),
        "status": lambda: rows(lib.status()),
        "book": about,
        "prompts": lambda: sorted(PROMPTS),
        "prompt": prompt,
    }


def serve(lib: Library, lines, out) -> None:
    """Answers JSON lines {"tool": name, "args": {...}} by lines {"result": ...} or {"error": message}."""
    known = tools(lib)
    for line in lines:
        if line.strip():
            try:
                asked = json.loads(line)
                reply = {"result": known[asked["tool"]](**asked.get("args", {}))}
            except Exception as e:  # a wrong question must not end the server
                reply = {"error": f"{type(e).__name__}: {e}"[:1000]}
            print(json.dumps(reply, ensure_ascii=False, default=str), file=out, flush=True)


def run(lib: Library, a: argparse.Namespace, out=sys.stdout) -> int:
    say = lambda *x: print(*x, file=out)
    read = lambda path: "\n".join(r[0] for r in lib.spark.read.text(path, wholetext=True).collect())
    bad: list = []
    if a.command == "ingest":
        bad = lib.ingest(a.source, a.force, a.language, not a.keep_front_matter).collect()
    elif a.command == "restructure":
        lib.restructure({a.book: overrides.load_override(lib.spark, a.override)}, force=a.force)
    elif a.command == "status":
        for r in lib.status().orderBy("book_id").toLocalIterator():
            say(f"{r['book_id']}\n{r['report']}\n")
    elif a.command == "chapter":
        found = lib.read_part(a.book, a.chapter, a.part).orderBy("part").collect()
        if not found:
            raise CommitError(f"there is no such chapter or part: {a.chapter} {a.part or ''}")
        say("\n".join(r["text"] for r in found))
    elif a.command == "commit-chapter":
        bad = lib.commit_chapters(lib.spark.createDataFrame([(a.book, a.chapter, read(a.card))], "book_id string, chapter_id string, card string")).collect()
    elif a.command == "commit-synthesis":
        bad = lib.commit_syntheses(lib.spark.createDataFrame([(a.book, read(a.synthesis))], "book_id string, synthesis string")).collect()
    elif a.command == "index":
        lib.index()
    elif a.command == "search":
        for r in lib.search(lib.questions(a.question), a.k).orderBy("rank").collect():
            say(f"{r['rank'] + 1}. {r['book_id']} {r['id']} {r['chapter_title']} ({r['bm25']:.4f})")
    elif a.command == "context":
        say("".join(r["context"] for r in lib.context(lib.questions(a.question), a.k, a.max_chars).collect()))
    elif a.command == "render":
        for df in lib.render():
            for r in df.where(F.col("book_id") == a.book).toLocalIterator():
                say(r["markdown"])
    elif a.command == "pack":
        say(json.dumps(lib.pack(a.book, a.archive), ensure_ascii=False, indent=2))
    elif a.command == "validate":
        found = lib.validate().orderBy("book_id").collect()
        for r in found:
            say(f"{r['book_id']}\n{r['report']}\n")
        bad = [r for r in found if not r["ok"]]
        return 1 if bad else 0
    elif a.command == "serve":
        serve(lib, sys.stdin, out)
    for r in bad:
        print(*r, sep="\t", file=sys.stderr)
    return 1 if bad else 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("vellum").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    try:
        return run(Library(spark, a.library), a)
    except (CommitError, FileExistsError, overrides.OverrideError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
