"""Map/reduce summaries: batches are summarised, their summaries combined, and what the combination cites is checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.operators.citations import is_subset
from studyloom.operators.generation import TEXT, Provider, accept_batches, generate, is_cited_text, map_batches
from studyloom.plans.lineage import cut

#: A stored batch: what resume() compares and takes.
STORED = "document string, identity string, batch_number int, first_number int, last_number int, text string, citation_numbers array<bigint>, prompt_names array<string>"


def resume(plan: DataFrame, stored: DataFrame, identity: str) -> DataFrame:
    """plan (map_batches) with the stored batches of this identity: text, citation_numbers and prompt_names, null where there is
    none, and problem where a stored one covers other contexts than the plan says."""
    own = stored.filter(F.col("identity") == identity).dropDuplicates(["document", "batch_number"])
    own = own.select("document", "batch_number", F.col("first_number").alias("_first"), F.col("last_number").alias("_last"), "text", "citation_numbers", "prompt_names")
    joined = plan.join(own, ["document", "batch_number"], "left")
    other = F.col("_first").isNotNull() & ((F.col("_first") != F.col("first_number")) | (F.col("_last") != F.col("last_number")))
    return joined.withColumn("problem", F.when(other, "the stored batch does not match the plan")).drop("_first", "_last")


def map_step(plan: DataFrame, make_provider: Callable[[], Provider], identity: str, stored: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The summary of every batch, and the batches to be stored for a later resume.

    Stored batches aren't asked again unless forced; forced ones aren't stored either. A batch that cites other contexts than its
    own has a problem and isn't stored. Result: document, batch_number, first_number, last_number, text, citation_numbers,
    prompt_names, problem."""
    columns = ["document", "batch_number", "first_number", "last_number", "text", "citation_numbers", "prompt_names", "problem"]
    if stored is None or force:
        known, todo = None, plan
    else:
        resumed = cut(resume(plan, stored, identity))
        fresh = F.col("text").isNull() & F.col("problem").isNull()
        known, todo = resumed.filter(~fresh).select(*columns), resumed.filter(fresh).select(*plan.columns)
    done = accept_batches(generate(todo, "prompt", make_provider, TEXT, is_cited_text, "map"))
    problem = F.coalesce("problem", F.when(~F.col("is_valid"), "a citation lies outside the batch"))
    new = cut(done.withColumn("problem", problem).select(*columns[:4], F.col("answer.text").alias("text"), F.col("answer.citation_numbers").alias("citation_numbers"), "prompt_names", "problem"))
    keep = new.filter(F.col("problem").isNull() & F.lit(not force)).select("document", F.lit(identity).alias("identity"), *columns[1:7])
    return (new if known is None else known.unionByName(new)), keep


def reduce_step(mapped: DataFrame, make_provider: Callable[[], Provider]) -> DataFrame:
    """One row a document: summary, citation_numbers, n_batches, prompt_names (in order of first use), fell_back, problem.

    A single batch is the summary. Several are combined by the provider, whose citations must all be among those of the batches (else a
    problem) and touch every batch; if they don't, one repair is asked for, and if that doesn't either, the batches' texts in order
    are the summary and fell_back is true. The citations are always the batches' in order. A document with any failed batch has a
    problem and no summary."""
    section = F.struct("batch_number", "text", "citation_numbers", "prompt_names")
    docs = mapped.groupBy("document").agg(
        F.array_sort(F.collect_list(section)).alias("sections"), F.count("*").alias("n_batches"), F.min_by(F.when(F.col("problem").isNotNull(), F.concat(F.lit("batch "), F.col("batch_number"), F.lit(": "), F.col("problem"))), F.when(F.col("problem").isNotNull(), F.col("batch_number"))).alias("map_problem")
    )
    every = F.array_distinct(F.flatten(F.transform("sections", lambda s: s["citation_numbers"])))
    names = F.flatten(F.transform("sections", lambda s: s["prompt_names"]))
    docs = cut(docs.withColumns({"supported": every, "map_names": names}))
    line = lambda s: F.concat(F.lit("Section "), s["batch_number"], F.lit(" ["), F.array_join(F.transform(s["citation_numbers"], lambda n: n.cast("string")), ", "), F.lit("]: "), s["text"])
    body = F.array_join(F.transform("sections", line), "\n\n")
    many = docs.filter(F.col("map_problem").isNull() & (F.col("n_batches") > 1))
    numbers = F.col("answer.citation_numbers")
    covered = F.forall("sections", lambda s: F.arrays_overlap(s["citation_numbers"], numbers))
    supported = is_subset(numbers, F.col("supported"))
    problem = F.coalesce(F.col("problem"), F.when(~supported, "the combination cites what no section does"))

    def ask(rows: DataFrame, head: str, name: str) -> DataFrame:
        done = generate(rows.withColumn("prompt", F.concat(F.lit(head + "\n\n"), body)), "prompt", make_provider, TEXT, is_cited_text, name)
        return cut(done.withColumns({"problem": problem, "covered": F.coalesce(covered, F.lit(False)), "reduced": F.col("answer.text"), "names": F.col("prompt_names")}).drop("answer", "prompt", "prompt_names"))

    once = ask(many, "Combine these sections into one summary.", "reduce")
    poor = F.col("problem").isNull() & ~F.col("covered")
    twice = ask(once.filter(poor).select(*docs.columns, F.col("names").alias("before")), "Combine these sections again and cite every one of them.", "reduce_repair")
    twice = twice.withColumn("names", F.concat("before", "names")).drop("before")
    reduced = once.filter(~poor).withColumn("fell_back", F.lit(False)).unionByName(twice.withColumn("fell_back", F.col("problem").isNull() & ~F.col("covered")))
    texts = F.array_join(F.transform("sections", lambda s: s["text"]), "\n\n")
    out = reduced.select("document", F.when(F.col("problem").isNull(), F.when(F.col("fell_back"), texts).otherwise(F.col("reduced"))).alias("summary"), "supported", "n_batches", F.array_distinct(F.concat("map_names", "names")).alias("prompt_names"), "fell_back", "problem")
    rest = docs.filter(F.col("map_problem").isNotNull() | (F.col("n_batches") == 1)).select(
        "document", F.when(F.col("map_problem").isNull(), F.col("sections")[0]["text"]).alias("summary"), "supported", "n_batches", F.array_distinct("map_names").alias("prompt_names"), F.lit(False).alias("fell_back"), F.col("map_problem").alias("problem")
    )
    both = out.unionByName(rest)
    return both.withColumn("citation_numbers", F.when(F.col("problem").isNull(), F.col("supported"))).drop("supported")


def summarize(chunks: DataFrame, document: str, order: str, text: str, budget: int, make_provider: Callable[[], Provider], identity: str, stored: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The summary of every document (reduce_step) and the batches to be stored (map_step)."""
    mapped, keep = map_step(map_batches(chunks, document, order, text, budget), make_provider, identity, stored, force)
    return reduce_step(cut(mapped), make_provider), keep
