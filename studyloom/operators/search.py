"""Exact vector search: blocks of queries against blocks of vectors, the best of each block first, then of all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.operators.generation import TEXT, Provider, generate, is_cited_text

#: The answer to a query without hits.
NOTHING_FOUND = "No stored passage answers this question."
#: Vectors and queries of one block.
VECTORS_A_BLOCK, QUERIES_A_BLOCK = 4096, 512


def vector_report(vectors: DataFrame, vec: str, by: str) -> DataFrame:
    """Per group: vectors, null or empty ones, zero ones, other dimensions than most, and those of unit length."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    usual = vectors.agg(F.mode(F.size(vec)).alias("usual"))
    empty = F.col(vec).isNull() | (F.size(vec) == 0)
    return vectors.join(F.broadcast(usual)).groupBy(by).agg(
        F.count("*").alias("n_vectors"), F.count_if(empty).alias("n_empty"), F.count_if(~empty & (norm == 0)).alias("n_zero"),
        F.count_if(~empty & (F.size(vec) != F.col("usual"))).alias("n_other_dimension"), F.count_if(F.abs(norm - 1) < 1e-4).alias("n_unit"),
    )


def check_vectors(entries: DataFrame, vec: str, dimension: int | None = None) -> int | None:
    """The dimension of a whole batch of vectors; ValueError if any is null, empty or zero, or if the dimensions differ from one
    another or from the given one. An empty batch is in order and has none."""
    r = entries.agg(
        F.count("*").alias("n"), F.count_if(F.col(vec).isNull() | (F.size(vec) == 0) | ~F.exists(vec, lambda x: x != 0)).alias("bad"), F.min(F.size(vec)).alias("low"), F.max(F.size(vec)).alias("high")
    ).first()
    if not r["n"]:
        return None
    if r["bad"]:
        raise ValueError(f"{r['bad']} of {r['n']} vectors are null, empty or zero")
    if r["low"] != r["high"] or dimension not in (None, r["low"]):
        raise ValueError(f"vectors need one dimension, but have {r['low']} to {r['high']}, stored ones {dimension}")
    return r["low"]


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct("id", "tag", "vec")).alias(name))


def _unit(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list]:
    m = np.array([r["vec"] for r in rows], dtype=np.float64)
    return np.array([r["id"] for r in rows], dtype=np.int64), m / np.linalg.norm(m, axis=1, keepdims=True), [r["tag"] for r in rows]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str, tag: str | None = None, digits: int = 6) -> DataFrame:
    """query_id, rank (from 1), id, score: the k vectors of highest cosine with each query, ties to the lower id.

    queries has the columns of vectors and is a stated set. With tag only vectors of the query's tag are searched. Null, empty,
    zero vectors and vectors of another dimension than most take no part (append_vectors refuses them earlier). Scores are ranked as
    they are and rounded to `digits` in the result.
    Every pair of blocks is one row of work and leaves at most k rows a query."""
    if k < 1:
        raise ValueError("k must be at least 1")
    clean = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), (F.col(tag).cast("string") if tag else F.lit("")).alias("tag"), F.col(vec).alias("vec")).filter(
        F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0) & F.col("tag").isNotNull()
    )
    usual = clean(vectors).agg(F.mode(F.size("vec")).alias("n")).first()["n"] or 0
    of = lambda d: clean(d).filter(F.size("vec") == usual)
    pairs = _blocks(of(vectors), VECTORS_A_BLOCK, "held").join(_blocks(of(queries), QUERIES_A_BLOCK, "asked")).repartition("held_block", "asked_block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, asked in zip(batch.column(0), batch.column(1), strict=True):
                ids, m, tags = _unit(held.as_py())
                q_ids, q, q_tags = _unit(asked.as_py())
                scores = q @ m.T
                if tag:
                    scores[np.array(q_tags, dtype=object)[:, None] != np.array(tags, dtype=object)[None, :]] = -np.inf
                for i, row in enumerate(scores):
                    best = np.lexsort((ids, -row))[:k]
                    best = best[np.isfinite(row[best])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q_ids[i])), pa.array(ids[best]), pa.array(row[best])], names=["query_id", "id", "score"])

    found = pairs.select("held", "asked").mapInArrow(search, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", digits).alias("score"))


def ground(hits: DataFrame, queries: DataFrame, text: str, make_provider: Callable[[], Provider]) -> DataFrame:
    """Grounded answers: hits (query_id, rank, id and a text) as numbered contexts, the provider's answer, and the ids it cites.

    Result: query_id, answer, is_valid (the answer cites contexts that it was given), cited_ids, problem, prompt_names. A query (query_id,
    question) without hits gets a fixed answer: no model is asked."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col(text))
    prompts = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "id"))).alias("h"))
    prompts = prompts.join(queries.select("query_id", "question"), "query_id").select(
        "query_id", F.concat(F.array_join(F.transform("h", lambda x: x["line"]), "\n\n"), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit(""))).alias("prompt"), F.transform("h", lambda x: x["id"]).alias("ids")
    )
    done = generate(prompts, "prompt", make_provider, TEXT, is_cited_text, "answer")
    numbers = F.col("answer.citation_numbers")
    valid = F.coalesce(F.col("problem").isNull() & F.forall(numbers, lambda n: n <= F.size("ids")), F.lit(False))
    cited = F.when(valid, F.transform(numbers, lambda n: F.element_at("ids", n.cast("int"))))
    found = done.select("query_id", F.col("answer.text").alias("answer"), valid.alias("is_valid"), cited.alias("cited_ids"), "problem", "prompt_names")
    none = queries.select("query_id").distinct().join(hits.select("query_id").distinct(), "query_id", "left_anti")
    fixed = [F.lit(NOTHING_FOUND).alias("answer"), F.lit(True).alias("is_valid"), F.array().cast("array<bigint>").alias("cited_ids"), F.lit(None).cast("string").alias("problem"), F.array().cast("array<string>").alias("prompt_names")]
    return found.unionByName(none.select("query_id", *fixed))
