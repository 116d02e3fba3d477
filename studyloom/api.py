"""A document library on published tables: index, replace, remove, search, contexts, summaries, reviews and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.functions.embed import Embedder, hashed_words, with_embedding
from studyloom.operators.answers import evaluate_answers, record_answers, record_review
from studyloom.operators.chunking import MAX_CHARS, OVERLAP_CHARS, chunk_pages
from studyloom.operators.generation import Provider, misses
from studyloom.operators.progress import progress_report
from studyloom.operators.questions import draft_banks, trusted
from studyloom.operators.review import due
from studyloom.operators.search import NOTHING_FOUND, check_vectors, ground, top_k
from studyloom.operators.store import Snapshots, replace_by_key, without
from studyloom.operators.summaries import summarize
from studyloom.plans.lineage import cut

__all__ = ["NOTHING_FOUND", "Library"]
_CITED = "struct<number: int, source: string, page_number: int, chunk_index: int, excerpt: string>"
_TABLES = {
    "documents": "document_id string, source string, content_sha256 string, page_count bigint, chunk_count bigint",
    "chunks": "chunk_id bigint, document_id string, source string, page_number int, chunk_index int, text string, embedding array<float>",
    "summary_batches": "document_id string, identity string, batch_number int, first_number int, last_number int, text string, citation_numbers array<bigint>, prompt_names array<string>",
    "summaries": f"document_id string, identity string, summary string, citations array<{_CITED}>, n_batches bigint, prompt_names array<string>, fell_back boolean",
    "banks": f"document_id string, identity string, questions array<struct<number: int, text: string, expected_answer: string, citations: array<{_CITED}>>>, prompt_names array<string>",
    "attempts": "id string, document_id string, identity string, question_number int, rating string, answered_at timestamp, verdict string, missing_concepts array<string>",
    "progress": "document_id string, identity string, question_number int, repetition_count int, interval_days int, ease_factor double, due_at timestamp, last_reviewed_at timestamp",
}
_QUESTION = ["document_id", "identity", "question_number"]


class Library:
    """Tables under one root. Every change is a job that writes new folders and shows them together; what only adds rows reads
    and rewrites none of the old ones.

    pages everywhere: document_id, source, content_sha256, page_number, text. model and revision name the embedder: vectors of
    another one are refused."""

    def __init__(
        self, spark: SparkSession, root: str, make_embedder: Callable[[], Embedder] = hashed_words, prefixes: tuple[str, str] = ("passage: ", "query: "), model: str = "hashed words", revision: str = "1"
    ) -> None:
        self.spark, self.tables, self.make, self.prefixes = spark, Snapshots(spark, root), make_embedder, prefixes
        self.tables.guard("chunks", model=model, revision=revision)

    def table(self, name: str) -> DataFrame:
        return self.tables.read(name) if self.tables.has(name) else self.spark.createDataFrame([], _TABLES[name])

    # ---- documents

    def _prepared(self, pages: DataFrame, most: int, overlap: int) -> tuple[DataFrame, DataFrame]:
        ids = pages.groupBy("document_id").agg(F.first("source").alias("source"), F.first("content_sha256").alias("content_sha256"), F.count_distinct("page_number").alias("page_count"))
        parts = chunk_pages(pages, "document_id", "page_number", "text", most, overlap).select(F.col("document").alias("document_id"), F.col("page").cast("int").alias("page_number"), "chunk_index", F.col("chunk_text").alias("text"))
        parts = parts.join(ids.select("document_id", "source"), "document_id").withColumn("chunk_id", F.xxhash64("document_id", "chunk_index"))
        chunks = cut(with_embedding(parts, F.col("text"), self.make, self.prefixes[0]).select(*self.table("chunks").columns))
        size = check_vectors(chunks, "embedding", self.tables.identity("chunks").get("dimension"))
        if size is not None:
            self.tables.guard("chunks", dimension=size)
        counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
        return cut(ids.join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).select(*self.table("documents").columns)), chunks

    def index(self, pages: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
        """Adds the documents whose content isn't stored; document_id, status ('added' or 'skipped') of each. Hashes are asked
        before any text is chunked or embedded."""
        known = self.table("documents").select("content_sha256").distinct()
        first = pages.groupBy("content_sha256").agg(F.min("document_id").alias("_first"))
        fresh = pages.join(first, "content_sha256").filter(F.col("document_id") == F.col("_first")).drop("_first").join(known, "content_sha256", "left_anti")
        documents, chunks = self._prepared(fresh, most, overlap)
        added = documents.select("document_id", F.lit("added").alias("status"))
        status = cut(pages.select("document_id").distinct().join(added, "document_id", "left").withColumn("status", F.coalesce("status", F.lit("skipped"))))
        self.tables.append(documents=documents, chunks=chunks)
        return status

    def replace(self, pages: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> None:
        """The documents of pages in place of those of the same ids; what was derived from the old text is removed."""
        documents, chunks = self._prepared(pages, most, overlap)
        derived = {t: without(self.table(t), documents, "document_id") for t in _TABLES if t not in ("documents", "chunks")}
        self.tables.publish(documents=replace_by_key(self.table("documents"), documents, "document_id"), chunks=replace_by_key(self.table("chunks"), chunks, "document_id"), **derived)

    def remove(self, ids: DataFrame) -> int:
        """Removes the documents of ids (document_id) from every table; how many there were."""
        n = self.table("documents").join(ids.select("document_id").distinct(), "document_id", "left_semi").count()
        self.tables.publish(**{t: without(self.table(t), ids, "document_id") for t in _TABLES})
        return n

    def documents(self) -> DataFrame:
        return self.table("documents").orderBy("source", "document_id")

    def chunks_of(self, document_id: str) -> DataFrame:
        return self.table("chunks").filter(F.col("document_id") == document_id).drop("embedding").orderBy("chunk_index")

    # ---- answers

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """queries (query_id, text): query_id, rank, score and the chunk of each of the k best hits."""
        asked = with_embedding(queries.select(F.col("query_id").cast("bigint").alias("chunk_id"), "text"), F.col("text"), self.make, self.prefixes[1])
        hits = top_k(self.table("chunks"), asked, k, "chunk_id", "embedding")
        return hits.join(self.table("chunks").drop("embedding"), F.col("id") == F.col("chunk_id")).drop("id")

    def ask(self, queries: DataFrame, make_provider: Callable[[], Provider], k: int = 5) -> DataFrame:
        """Grounded answers: the hits as numbered contexts, the provider's answer, and the stored chunks it cites.

        A query without hits gets a fixed answer: no model is asked. An answer that cites a context it wasn't given has is_valid false."""
        hits = cut(self.search(queries, k).withColumnRenamed("chunk_id", "id"))
        return ground(hits, queries.select("query_id", F.col("text").alias("question")), "text", make_provider).withColumnRenamed("cited_ids", "cited_chunk_ids")

    def citations(self, answers: DataFrame) -> DataFrame:
        """The citations of answers (query_id, cited_chunk_ids): query_id, number and the stored chunk with its whole text as excerpt."""
        cited = answers.select("query_id", F.posexplode("cited_chunk_ids").alias("at", "chunk_id"))
        return cited.join(self.table("chunks"), "chunk_id").select("query_id", (F.col("at") + 1).alias("number"), "source", "page_number", "chunk_index", F.col("text").alias("excerpt"))

    def summarize(self, identity: str, make_provider: Callable[[], Provider], budget: int = 12_000, force: bool = False) -> DataFrame:
        """Summaries under an identity (model and prompts) of the documents that have none yet, or of all if forced; all of that
        identity. Batches that a broken run has left are taken over; a document whose batches fail gets no summary."""
        wanted = self.table("documents").select("document_id").withColumn("identity", F.lit(identity))
        todo = cut(wanted if force else misses(wanted, self.table("summaries"), ["document_id", "identity"]))
        chunks = self.table("chunks").join(todo.select("document_id"), "document_id", "left_semi")
        stored = self.table("summary_batches").withColumnRenamed("document_id", "document")
        done, keep = summarize(chunks, "document_id", "chunk_index", "text", budget, make_provider, identity, stored, force)
        kept = keep.withColumnRenamed("document", "document_id").select(*self.table("summary_batches").columns)
        by_number = chunks.withColumn("number", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")))
        cited = done.filter(F.col("problem").isNull()).select(F.col("document").alias("document_id"), F.posexplode("citation_numbers").alias("at", "number"))
        of = F.struct("number", "source", "page_number", "chunk_index", F.col("text").alias("excerpt"))
        cited = cited.withColumn("number", F.col("number").cast("int")).join(by_number, ["document_id", "number"]).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("at", of.alias("c")))).alias("c"))
        fresh = done.filter(F.col("problem").isNull()).select(F.col("document").alias("document_id"), F.lit(identity).alias("identity"), "summary", "n_batches", "prompt_names", "fell_back").join(cited, "document_id")
        fresh = cut(fresh.withColumn("citations", F.transform("c", lambda x: x["c"])).select(*self.table("summaries").columns))
        if force:
            old = self.table("summaries").join(fresh.select("document_id", "identity"), ["document_id", "identity"], "left_anti")
            self.tables.publish(summaries=old.unionByName(fresh))
        else:
            self.tables.append(summaries=fresh, summary_batches=kept)
        return self.table("summaries").filter(F.col("identity") == identity)

    def draft_questions(self, identity: str, summaries: str, make_provider: Callable[[], Provider], count: int, batch: int = 2) -> DataFrame:
        """Banks under an identity from the summaries of another, for the documents that have none yet; all of that identity."""
        s = self.table("summaries").filter(F.col("identity") == summaries)
        todo = misses(s.withColumn("identity", F.lit(identity)), self.table("banks"), ["document_id", "identity"])
        asked = cut(todo.select(F.col("document_id").alias("document"), F.col("summary").alias("text"), "citations", F.transform("citations", lambda c: c["number"]).alias("numbers")))
        done = draft_banks(asked, make_provider, count, batch).filter(F.col("problem").isNull()).join(asked.select("document", "citations"), "document")
        question = lambda q: F.struct(q["number"].alias("number"), q["text"].alias("text"), q["expected_answer"].alias("expected_answer"), trusted(q["citation_numbers"], F.col("citations")).alias("citations"))
        fresh = done.select(F.col("document").alias("document_id"), F.lit(identity).alias("identity"), F.transform("questions", question).alias("questions"), "prompt_names")
        self.tables.append(banks=fresh.select(*self.table("banks").columns))
        return self.table("banks").filter(F.col("identity") == identity)

    # ---- reviews

    def evaluate(self, answers: DataFrame, make_provider: Callable[[], Provider]) -> DataFrame:
        """Attempts of answers (id, document_id, identity, question_number, answer_text, answered_at) to questions of the stored banks:
        rated by the provider, with verdict, missing concepts and the problem of those that could not be evaluated."""
        q = self.table("banks").select("document_id", "identity", F.explode("questions").alias("q")).select("document_id", "identity", F.col("q.number").alias("question_number"), F.col("q.text").alias("question_text"), F.col("q.expected_answer").alias("expected_answer"))
        done = evaluate_answers(answers.join(q, _QUESTION), "question_text", "expected_answer", "answer_text", make_provider)
        return done.select("id", *_QUESTION, "rating", "answered_at", F.col("evaluation.verdict").alias("verdict"), F.col("evaluation.missing_concepts").alias("missing_concepts"), "problem")

    def record(self, attempts: DataFrame) -> DataFrame:
        """Appends attempts whose id isn't stored and the states of their questions, shown together; the outcome of each id. A stored
        id with other content is a conflict and stays."""
        stored = self.table("attempts")
        fresh, states, outcome = record_answers(stored, attempts.select(*stored.columns), _QUESTION)
        progress = self.table("progress")
        self.tables.change({"progress": progress.join(states.select(*_QUESTION), _QUESTION, "left_anti").unionByName(states.select(*progress.columns))}, {"attempts": fresh})
        return outcome

    def review(self, reviews: DataFrame) -> None:
        """Takes ratings (document_id, identity, question_number, rating, reviewed_at) into the states, without attempts."""
        self.tables.publish(progress=record_review(self.table("progress"), reviews, _QUESTION))

    def progress_states(self) -> DataFrame:
        """The review state of every question that was reviewed."""
        return self.table("progress")

    def due(self, questions: DataFrame, as_of: Column) -> DataFrame:
        """Those of questions (document_id, identity, question_number) that are due at as_of or new."""
        return due(questions, self.progress_states(), _QUESTION, as_of)

    def progress(self, questions: DataFrame, as_of: Column) -> DataFrame:
        """The progress report of every bank of questions."""
        attempts = self.table("attempts").withColumn("evaluation", F.when(F.col("verdict").isNotNull(), F.struct("verdict", "missing_concepts")))
        return progress_report(questions, attempts, self.progress_states(), _QUESTION[:2], "question_number", as_of)
