"""Reading documents into page rows: text files, binary files through an extractor, JSON evaluation cases."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.functions.text import tidy_page
from studyloom.operators.chunking import split_pages
from studyloom.plans.lineage import path_of

PAGES = "path string, source string, content_sha256 string, page_number int, text string, problem string, diagnostics array<string>"


def checked_files(spark: SparkSession, paths: list[str], suffix: str) -> list[str]:
    """paths as they are, if each is an existing file of that suffix (in any letter case); ValueError names the others. The paths
    are those a user has typed, not the files of a folder."""
    wrong = []
    for path in paths:
        fs, at = path_of(spark, path)
        if not fs.exists(at):
            wrong.append(f"{path} does not exist")
        elif not fs.getFileStatus(at).isFile():
            wrong.append(f"{path} is no file")
        elif not path.lower().endswith(suffix.lower()):
            wrong.append(f"{path} is no {suffix} file")
    if wrong:
        raise ValueError("; ".join(wrong))
    return paths


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def read_text_pages(spark: SparkSession, path: str, marker: str, glob: str = "*") -> DataFrame:
    """Whole text files as pages between markers: source, content_sha256, page_number, text (tidied; empty pages are kept)."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    known = files.select(file_name(F.col("_metadata.file_path")).alias("source"), F.sha2("value", 256).alias("content_sha256"), "value")
    pages = split_pages(known.select(F.struct("source", "content_sha256").alias("of"), "value"), "of", "value", marker)
    return pages.select("document.source", "document.content_sha256", F.col("page").alias("page_number"), tidy_page("page_text").alias("text"))


def read_binary_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """Files through an extractor (bytes to the texts of the pages), in tasks: path, source, content_sha256, page_number, text,
    problem, diagnostics (what the extractor warned of, on every row of the file). A file that the extractor fails on is one row
    with the problem and no page; the others aren't touched by it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    known = files.select("path", file_name(F.col("path")).alias("source"), F.sha2("content", 256).alias("content_sha256"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                with warnings.catch_warnings(record=True) as seen:
                    warnings.simplefilter("always")
                    try:
                        pages, problem = extract(bytes(f.content)), None
                    except Exception as e:  # noqa: BLE001
                        pages, problem = [], f"{type(e).__name__}: {e}"
                said = [str(w.message) for w in seen]
                if problem:
                    rows.append((f.path, f.source, f.content_sha256, None, None, problem, said))
                rows += [(f.path, f.source, f.content_sha256, n, text, None, said) for n, text in enumerate(pages, 1)]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")])
            out["page_number"] = out["page_number"].astype("Int32")
            yield out

    return known.mapInPandas(run, PAGES).withColumn("text", tidy_page("text"))


CASES = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("cases", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("question", T.StringType()),
        T.StructField("expected_citations", T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("page_number", T.IntegerType())]))),
        T.StructField("expected_concepts", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("accepted_phrases", T.ArrayType(T.StringType()))]))),
    ]))),
])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of JSON files of schema version 1, one row a case; a file that doesn't fit is an error."""
    files = spark.read.schema(CASES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = files.withColumn("cases", F.when(F.assert_true(F.col("schema_version") == 1, F.lit("cases need schema_version 1")).isNull(), F.col("cases")))
    rows = checked.select(F.explode("cases").alias("c")).select(F.col("c.id").alias("case_id"), "c.question", "c.expected_citations", "c.expected_concepts")
    whole = F.col("case_id").isNotNull() & F.col("question").isNotNull() & (F.size("expected_citations") > 0)
    rows = rows.filter(F.assert_true(whole, F.lit("a case needs id, question and expected citations")).isNull())
    same = F.count("*").over(Window.partitionBy("case_id"))
    return rows.withColumn("_n", same).filter(F.assert_true(F.col("_n") == 1, F.lit("case ids must be unique")).isNull()).drop("_n")


def skip_known(files: DataFrame, stored: DataFrame, order: str = "path") -> DataFrame:
    """files (content_sha256) with status 'added' or 'skipped': known content, or a copy of a file that comes before."""
    first = files.groupBy("content_sha256").agg(F.min(order).alias("_first"))
    known = stored.select("content_sha256").distinct().withColumn("_known", F.lit(True))
    joined = files.join(first, "content_sha256").join(known, "content_sha256", "left")
    new = F.col("_known").isNull() & (F.col(order) == F.col("_first"))
    return joined.withColumn("status", F.when(new, "added").otherwise("skipped")).drop("_first", "_known")
