"""The queries of the numbered text problems over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import canonical as p1
from studyloom.llm import containers as p6
from studyloom.llm import mixing as p7
from studyloom.llm import pair_defects as p5
from studyloom.llm import prose as p8
from studyloom.llm import repeated_lines as p2
from studyloom.llm import truncation as p4
from studyloom.llm.oracles import ORACLES as _ORACLES
from studyloom.plans.lineage import cut


def _read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{table}.parquet")


def _both_tables(spark: SparkSession, at: str) -> DataFrame:
    """Texts of chunks and summaries under ids of their own (twice the id, odd for summaries)."""
    c = _read(spark, at, "chunks").select((F.col("chunk_id") * 2).alias("text_id"), "text")
    s = _read(spark, at, "document_summaries").select((F.col("summary_id") * 2 + 1).alias("text_id"), "text")
    return c.unionByName(s)


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    pairs = p1.same_look(_both_tables(spark, at), "text_id")
    of = lambda i: F.col(i) % 2
    table = F.when(of("id_a") == 0, "chunks").otherwise("document_summaries").alias("table_name")
    half = lambda i: F.shiftright(F.col(i), 1).alias(i)
    return pairs.filter(of("id_a") == of("id_b")).select(table, half("id_a"), half("id_b"))


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    return p2.repeated_lines(_read(spark, at, "chunks")).select("chunk_id", "line_no").distinct()


def p2_cleaned(spark: SparkSession, at: str) -> DataFrame:
    chunks = _read(spark, at, "chunks").select("chunk_id", "document_id", "source", "text")
    clean = p2.without_lines(chunks, p2.repeated_lines(chunks))
    return clean.select("chunk_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _questions(spark: SparkSession, at: str) -> DataFrame:
    """Every StudyQuestion once: record_key, source, text, expected_answer."""
    banks = _read(spark, at, "question_banks").select("document_id", "identity_fingerprint", "source", F.explode("questions").alias("q"))
    key = F.concat_ws("|", "document_id", "identity_fingerprint", F.col("q.number"))
    rows = banks.select(key.alias("record_key"), "source", "q.text", "q.expected_answer")
    return rows.groupBy("record_key").agg(*(F.first(c).alias(c) for c in ("source", "text", "expected_answer")))


def _values(spark: SparkSession, at: str) -> DataFrame:
    s = _read(spark, at, "document_summaries").select(F.lit("document_summaries.text").alias("field_name"), F.col("summary_id").cast("string").alias("record_key"), "source", "text")
    q = _questions(spark, at).select(F.lit("question_banks.expected_answer").alias("field_name"), "record_key", "source", F.col("expected_answer").alias("text"))
    return s.unionByName(q)


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return p4.truncated(_values(spark, at)).filter("is_truncated").select("field_name", "record_key")


def p4_rates(spark: SparkSession, at: str) -> DataFrame:
    return p4.truncation_rates(p4.truncated(_values(spark, at)))


def _pairs(spark: SparkSession, at: str) -> DataFrame:
    """Every pair once: record_kind, record_key, question, answer, row."""
    q = _questions(spark, at).select(F.lit("question").alias("record_kind"), "record_key", F.col("text").alias("question"), F.col("expected_answer").alias("answer"))
    a = _read(spark, at, "study_attempts").groupBy(F.col("id").alias("record_key")).agg(F.first("question_text").alias("question"), F.first("answer_text").alias("answer"))
    both = q.unionByName(a.withColumn("record_kind", F.lit("attempt")))
    return both.withColumn("row", F.xxhash64("record_kind", "record_key"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    pairs = cut(_pairs(spark, at))
    found = p5.defects(pairs, stored=True).filter(F.size("labels") > 0)
    return found.join(pairs, "row").select("record_kind", "record_key", F.col("labels")[0].alias("defect"))


def p6_containers(spark: SparkSession, at: str) -> DataFrame:
    return p6.fill_containers(_read(spark, at, "documents"), _read(spark, at, "container_specs"))


def p6_fill(spark: SparkSession, at: str) -> DataFrame:
    specs = _read(spark, at, "container_specs")
    return p6.fill_rates(p6.fill_containers(_read(spark, at, "documents"), specs), specs)


def p7_copies(spark: SparkSession, at: str) -> DataFrame:
    return p7.mix(_read(spark, at, "documents"), _read(spark, at, "mix_targets"))


def p7_shares(spark: SparkSession, at: str) -> DataFrame:
    targets = _read(spark, at, "mix_targets")
    return p7.shares(p7.mix(_read(spark, at, "documents"), targets), targets)


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    return p8.spam_pages(_read(spark, at, "documents")).filter("is_spam").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_cleaned": p2_cleaned,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_copies": p7_copies,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}
ORACLES = dict(_ORACLES)
