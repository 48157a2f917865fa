"""A library of books as tables below one path: ingest, commit, index, ask, check, render and pack.

Every step works on all books that it is given at once. Cards and syntheses are only appended; a card holds for its
chapter while the chapter's text is the one it was committed for, and the last one counts.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import chunk, index, integrity, knowledge, manifest, overrides, pages, rules, search, segment, status
from .operators.search import CONTEXT, TOP_K
from .sources import readers, sinks

TABLES = {
    "books": "book_id string, path string, text string, title string, author string, error string, language string",
    "chapters": "book_id string, seq int, ord int, chapter_id string, title string, text string, file string, hash string, parts_total int, page_start int, page_end int",
    "chunks": "book_id string, id string, chapter_id string, chapter_title string, ord int, text string, summary string, keywords array<string>, chapter_hash string, page_start int, page_end int",
    "page_map": "book_id string, offset long, page int",
    "cards": "book_id string, chapter_id string, hash string, card string, at string, no long",
    "syntheses": "book_id string, synthesis string, at string, no long",
    "events": "book_id string, at string, kind string, chapter_id string, message string",
}


class CommitError(ValueError):
    """A card or synthesis that breaks a rule."""


class Library:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table as it is stored; one that isn't there has no rows."""
        p, fs = sinks._path(self.spark, f"{self.path}/{name}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def _write(self, name: str, df: DataFrame, force: bool = True) -> None:
        cols = [part.split()[0] for part in TABLES[name].split(", ")]
        sinks.write_table(df.select(*cols), f"{self.path}/{name}", force)

    def _append(self, name: str, df: DataFrame) -> None:
        cols = [part.split()[0] for part in TABLES[name].split(", ")]
        sinks.append_events(df.select(*cols), f"{self.path}/{name}")

    def ingest(self, source: str, force: bool = False, language: str = "it", drop_front_matter: bool = True, actions: dict[str, list[dict]] | None = None, pdf=readers.pdf_pages) -> DataFrame:
        """Reads all documents below ``source`` into books, chapters and chunks; returns (book_id, error) of those that can't be read.

        What a metadata file beside a document says of its book counts before the document itself and ``language``.
        """
        said = readers.read_metadata(self.spark, source).select("book_id", *[F.col(c).alias(f"_{c}") for c in ("title", "author", "language")])
        docs = readers.read_documents(self.spark, source, pdf=pdf).withColumn("language", F.lit(language)).join(said.dropDuplicates(["book_id"]), "book_id", "left")
        docs = docs.withColumns({c: F.coalesce(f"_{c}", c) for c in ("title", "author", "language")})
        self._write("books", docs, force)
        self._write("page_map", readers.read_pdf_offsets(self.spark, source, pdf))
        ids = docs.select("book_id").distinct()
        books = self.table("books").join(ids, "book_id", "left_semi")
        self._derive(books.where("error is null"), drop_front_matter, actions or {})
        self._append("events", status.event(ids, "ingest"))
        return books.where("error is not null").select("book_id", "error")

    def _derive(self, books: DataFrame, drop_front_matter: bool, actions: dict[str, list[dict]]) -> None:
        found, dropped = segment.split_chapters(books.select("book_id", "text"), drop_front_matter)
        if actions:
            found = overrides.apply_overrides(found, dropped, actions)
        found = found.withColumns({"parts_total": F.size(chunk.part_texts(F.col("text"))), "page_start": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int")})
        self._write("chapters", self._paged(found.withColumn("id", F.col("chapter_id")), found, books))
        now = self.table("chapters").join(books.select("book_id"), "book_id", "left_semi")
        self._write("chunks", self._paged(chunk.chunks(now).withColumns({c: F.lit(None).cast("int") for c in ("page_start", "page_end")}), now, books))

    def _paged(self, rows: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
        """Rows with the pages that they begin and end on, for books that have pages."""
        paged = self.table("page_map").select("book_id").distinct()
        mine = lambda df: df.join(paged, "book_id", "left_semi")
        found = pages.chunk_pages(mine(rows), mine(chapters).select("book_id", "chapter_id", "text"), mine(books).select("book_id", "text"), self.table("page_map"))
        return rows.join(paged, "book_id", "left_anti").unionByName(found.select(*rows.columns))

    def restructure(self, actions: dict[str, list[dict]], drop_front_matter: bool = True, force: bool = False) -> None:
        """Cuts the named books anew and applies each one's actions.

        Refused while a chapter of theirs is committed; with force, cards of chapters that change no longer hold.
        """
        books = self.table("books").where(F.col("book_id").isin(*actions) & F.col("error").isNull())
        if not force and (done := self.cards().join(books.select("book_id"), "book_id", "left_semi").first()):
            raise CommitError(f"book {done['book_id']} has committed chapters, such as {done['chapter_id']}")
        self._derive(books, drop_front_matter, actions)
        self._append("events", status.event(books, "restructure"))

    def cards(self) -> DataFrame:
        """(book_id, chapter_id, card, at): the last card of each chapter, for its present text."""
        last = Window.partitionBy("book_id", "chapter_id").orderBy(F.col("no").desc(), "card")
        held = self.table("cards").join(self.table("chapters").select("book_id", "chapter_id", "hash"), ["book_id", "chapter_id", "hash"], "left_semi")
        return held.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select("book_id", "chapter_id", "card", "at")

    def syntheses(self) -> DataFrame:
        return self.table("syntheses").groupBy("book_id").agg(F.max_by("synthesis", F.struct("no", "synthesis")).alias("synthesis"))

    def chapter_status(self) -> DataFrame:
        done = self.cards().select("book_id", "at", F.lit("commit-chapter").alias("kind"), "chapter_id", F.lit("").alias("message"))
        return status.chapter_status(self.table("chapters"), done)

    def progress(self) -> DataFrame:
        return status.progress(self.chapter_status(), self.table("syntheses").select("book_id").distinct())

    def status(self) -> DataFrame:
        """(book_id, report)."""
        return status.render(self.chapter_status(), status.phases(self.table("books").select("book_id"), self.table("events")), self.progress())

    def commit_chapters(self, cards: DataFrame) -> DataFrame:
        """Keeps the cards (book_id, chapter_id, card) that break no rule; returns (book_id, chapter_id, message) of the others."""
        chapters = self.table("chapters")
        bad = rules.first_errors(rules.card_violations(cards, self.table("chunks"), chapters)).persist()
        good = rules.accepted(cards, bad).join(chapters.select("book_id", "chapter_id", "hash"), ["book_id", "chapter_id"])
        self._append("cards", good.withColumns({"at": status.now(), "no": F.unix_micros(F.current_timestamp())}))
        done = good.select("book_id", status.now().alias("at"), F.lit("commit-chapter").alias("kind"), "chapter_id", F.lit("").alias("message"))
        refused = bad.select("book_id", status.now().alias("at"), F.lit("refused").alias("kind"), "chapter_id", "message")
        self._append("events", done.unionByName(refused))
        return bad

    def commit_syntheses(self, syntheses: DataFrame) -> DataFrame:
        """Keeps the syntheses (book_id, synthesis) that break no rule; returns (book_id, message) of the others."""
        bad = rules.synthesis_violations(syntheses, self.chapter_status())
        bad = bad.groupBy("book_id").agg(F.min(F.struct("rule", "item", "message"))["message"].alias("message")).persist()
        good = syntheses.join(bad.select("book_id"), "book_id", "left_anti").join(self.table("books").select("book_id"), "book_id", "left_semi")
        self._append("syntheses", good.withColumns({"at": status.now(), "no": F.unix_micros(F.current_timestamp())}))
        self._append("events", status.event(good, "commit-synthesis"))
        return bad

    def index(self, encode=None) -> None:
        """Builds the index of all chunks with what accepted cards say of them."""
        annotated = knowledge.annotate(self.table("chunks"), self.cards())
        index.write(index.build(annotated, self.table("books").select("book_id", "language"), encode), f"{self.path}/index")

    def questions(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")

    def search(self, questions: DataFrame, k: int = TOP_K, question_vectors: DataFrame | None = None) -> DataFrame:
        return search.search(index.read(self.spark, f"{self.path}/index"), questions, k, question_vectors is not None, question_vectors)

    def context(self, questions: DataFrame, k: int = TOP_K, max_chars: int = CONTEXT) -> DataFrame:
        return search.contexts(self.search(questions, k), max_chars)

    def chapters(self, book_id: str) -> DataFrame:
        return self.table("chapters").where(F.col("book_id") == book_id)

    def read_part(self, book_id: str, chapter_id: str, part: str | None = None) -> DataFrame:
        return chunk.read_part(chunk.parts(self.chapters(book_id)), chapter_id, part)

    def knowledge(self) -> dict[str, DataFrame]:
        """claims, concepts, questions, objections and applications of all accepted cards."""
        return knowledge.flatten(self.cards())

    def render(self) -> tuple[DataFrame, DataFrame]:
        """Markdown of all cards (book_id, chapter_id, markdown) and of all syntheses (book_id, markdown)."""
        return knowledge.render_cards(self.cards()), knowledge.render_syntheses(self.syntheses())

    def validate(self) -> DataFrame:
        """(book_id, ok, report)."""
        books = self.table("books").select("book_id", "text")
        checks = integrity.check(books, self.table("chapters"), self.table("chunks"), self.chapter_status(), self.cards(), self.syntheses(), self.table("syntheses").select("book_id").distinct())
        return integrity.report(checks)

    def manifests(self) -> DataFrame:
        found = manifest.artefacts(self.table("chapters"), self.table("chunks"), self.cards())
        return manifest.manifest(self.table("books").select("book_id", "text"), found, self.progress())

    def pack(self, book_id: str, path: str) -> dict:
        """One book's archive, written to ``path``; returns its manifest. A book that isn't in order is a CommitError."""
        mine = F.col("book_id") == book_id
        checked = self.validate().where(mine).first()
        if checked is None or not checked["ok"]:
            raise CommitError(checked["report"] if checked else f"there is no book {book_id}")
        made = self.manifests().where(mine).first().asDict(recursive=True)
        files = {f"canonical/chapters/{r['file']}": r["text"] for r in self.chapters(book_id).select("file", "text").toLocalIterator()}
        files |= {f"analysis/chapters/{r['chapter_id']}.json": r["card"] for r in self.cards().where(mine).toLocalIterator()}
        cards, syntheses = self.render()
        files |= {f"render/{r['chapter_id']}.md": r["markdown"] for r in cards.where(mine).toLocalIterator()}
        files |= {"render/synthesis.md": r["markdown"] for r in syntheses.where(mine).toLocalIterator()}
        files |= {"render/twin.md": r["markdown"] for r in knowledge.render_book(cards, syntheses).where(mine).toLocalIterator()}
        files |= {"analysis/synthesis.json": r["synthesis"] for r in self.syntheses().where(mine).toLocalIterator()}
        lines = lambda df, *by: "".join(json.dumps(json.loads(r[0]), ensure_ascii=False) + "\n" for r in df.where(mine).orderBy(*by).select(F.to_json(F.struct("*"))).toLocalIterator())
        files |= {f"knowledge/{name}.jsonl": lines(df, "chapter_id", "pos") for name, df in self.knowledge().items()}
        files["knowledge/chunks.jsonl"] = lines(self.table("chunks"), "ord")
        sinks.write_bytes(self.spark, path, sinks.pack(files | {"render/": ""}, made))
        if made["status"] == "packed":
            self._append("events", status.event(self.table("books").where(mine), "pack"))
        return made
