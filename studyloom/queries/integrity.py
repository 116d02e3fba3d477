"""Problem 3: references to records that do not exist. Queries over the library's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.operators.orphans import orphan_report, orphans, references


def _key(*cols: str):
    return F.concat_ws("|", *cols)


def library_references(spark: SparkSession, at: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{at}/{t}.parquet")
    parts = [
        references(read("chunks"), "chunks", "document_id", F.col("chunk_id"), "indexed_at"),
        references(read("question_banks"), "question_banks", "document_id", _key("document_id", "identity_fingerprint"), "created_at"),
        references(read("question_progress"), "question_progress", "document_id", _key("document_id", "question_bank_identity_fingerprint", "question_number"), "created_at"),
        references(read("learning_packages"), "learning_packages", "document_id", F.col("id"), "created_at"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    hits = orphans(library_references(spark, at), spark.read.parquet(f"{at}/library_documents.parquet"))
    return hits.groupBy("table_name", "record_key").agg(F.min("reason").alias("reason"))


def p3_report(spark: SparkSession, at: str) -> DataFrame:
    refs = library_references(spark, at)
    return orphan_report(orphans(refs, spark.read.parquet(f"{at}/library_documents.parquet")), refs)


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_UUID = "case when length(regexp_replace(lower({c}), 'urn:uuid:|[^0-9a-f]', '', 'g')) = 32 then regexp_replace(lower({c}), 'urn:uuid:|[^0-9a-f]', '', 'g') else '!' || trim(lower({c})) end"
_REFS = f"""
refs as (
  select 'chunks' as table_name, chunk_id::varchar as record_key, document_id as d, indexed_at as own from chunks where document_id is not null
  union all select 'question_banks', document_id || '|' || identity_fingerprint, document_id, created_at from question_banks where document_id is not null
  union all select 'question_progress', document_id || '|' || question_bank_identity_fingerprint || '|' || question_number, document_id, created_at from question_progress where document_id is not null
  union all select 'learning_packages', id, document_id, created_at from learning_packages where document_id is not null),
parents as (
  select {_UUID.format(c="id")} as k, min(added_at) as earliest, bool_or(removed_at is null) as active from library_documents where id is not null group by 1),
hits as (
  select r.*, case when p.k is null then 'missing' when not p.active then 'deleted' when r.own < p.earliest then 'late' end as reason
  from refs r left join parents p on p.k = {_UUID.format(c="r.d")})
"""
ORACLES = {
    "p3_found": f"with {_REFS} select table_name, record_key, min(reason) as reason from hits where reason is not null group by 1, 2",
    "p3_report": f"""with {_REFS} select table_name, strftime(own at time zone 'UTC', '%Y-%m') as month, count(*) as n_references, count(*) filter (reason = 'missing') as n_missing,
      count(*) filter (reason = 'deleted') as n_deleted, count(*) filter (reason = 'late') as n_late from hits group by 1, 2""",
}
