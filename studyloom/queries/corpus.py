"""Queries over documents and chunks: normalisation, duplicates, chunking, batching, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.functions.text import collapse, tidy_page, uuid_key
from studyloom.operators.batching import budget_batches, fixed_batches
from studyloom.operators.chunking import MAX_CHARS, OVERLAP_CHARS, chunk_pages, chunk_words, split_pages

BUDGET, MOST, OVERLAP = 2000, 200, 40


def _read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{table}.parquet")


def text_normalise(spark: SparkSession, at: str) -> DataFrame:
    t = tidy_page("text")
    return _read(spark, at, "documents").select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("text_md5"), F.length(collapse("text")).alias("n_collapsed"))


def doc_hash_dedupe(spark: SparkSession, at: str) -> DataFrame:
    docs = _read(spark, at, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    first = docs.groupBy("content_sha256").agg(F.min("doc_id").alias("kept_id"))
    return docs.join(first, "content_sha256").select("doc_id", "content_sha256", "kept_id", F.when(F.col("doc_id") == F.col("kept_id"), "added").otherwise("skipped").alias("status"))


def import_summary(spark: SparkSession, at: str) -> DataFrame:
    """Per source what an import makes of its documents: blank ones fail, copies of others are skipped."""
    docs = doc_hash_dedupe(spark, at).join(_read(spark, at, "documents").select("doc_id", "source", "text"), "doc_id")
    status = F.when(collapse("text") == "", "failed").otherwise(F.col("status"))
    return docs.withColumn("status", status).groupBy("source").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("added", "skipped", "failed")), F.count("*").alias("n_documents"))


def page_split(spark: SparkSession, at: str) -> DataFrame:
    pages = split_pages(_read(spark, at, "documents"), "doc_id", "text", "\n\n")
    return pages.select(F.col("document").alias("doc_id"), "page", F.length("page_text").alias("n_chars"), F.md5("page_text").alias("page_md5"))


def chunk_documents(spark: SparkSession, at: str) -> DataFrame:
    """The chunks of every document, each of whose lines is a page, numbered over the pages."""
    pages = split_pages(_read(spark, at, "documents"), "doc_id", "text", "\n")
    chunks = chunk_pages(pages, "document", "page", "page_text")
    return chunks.select(F.col("document").alias("doc_id"), "page", "chunk_index", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("chunk_md5"))


def chunk_words_200(spark: SparkSession, at: str) -> DataFrame:
    chunks = chunk_words(_read(spark, at, "documents"), "doc_id", "text", MOST, OVERLAP)
    return chunks.select(F.col("document").alias("doc_id"), "chunk_index", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("chunk_md5"))


def chunk_stats(spark: SparkSession, at: str) -> DataFrame:
    chunks = chunk_words_200(spark, at).join(_read(spark, at, "documents").select("doc_id", "source"), "doc_id")
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks"), F.max("n_chars").alias("most_chars"), F.sum("n_chars").alias("n_chars"), F.count_distinct("doc_id").alias("n_documents"))


def _library_chunks(spark: SparkSession, at: str) -> DataFrame:
    """Chunks of known documents, each (document, index) once: the first chunk_id."""
    c = _read(spark, at, "chunks").filter(F.col("document_id").isNotNull()).withColumn("document", uuid_key("document_id"))
    keep = c.groupBy("document", "chunk_index").agg(F.min("chunk_id").alias("chunk_id"))
    return c.drop("document", "chunk_index").join(keep, "chunk_id")


def budget_batches_2000(spark: SparkSession, at: str) -> DataFrame:
    chunks = _library_chunks(spark, at).select("document", "chunk_index", "chunk_id", F.length("text").alias("n_chars"))
    out = budget_batches(chunks, "document", ["chunk_index"], "n_chars", BUDGET)
    return out.select("chunk_id", "document", "context_number", "batch_number", "batch_size")


def fixed_batches_2(spark: SparkSession, at: str) -> DataFrame:
    banks = _read(spark, at, "question_banks").select("document_id", "identity_fingerprint", F.size("questions").alias("n_questions")).distinct()
    return fixed_batches(banks, "n_questions", 2).select("document_id", "identity_fingerprint", "n_questions", "batch_number", "first_number", "last_number")


def prompt_contexts(spark: SparkSession, at: str) -> DataFrame:
    c = _library_chunks(spark, at)
    n = F.row_number().over(Window.partitionBy("document").orderBy("chunk_index"))
    line = F.concat(F.lit("["), F.col("n"), F.lit("] "), "source", F.lit(", page "), "page_number", F.lit(": "), "text")
    return c.withColumn("n", n).select("chunk_id", F.col("n").alias("context_number"), F.length(line).alias("n_chars"), F.md5(line).alias("context_md5"))


def document_totals(spark: SparkSession, at: str) -> DataFrame:
    """Pages and chunks of each document of the library."""
    return _library_chunks(spark, at).groupBy("document").agg(F.count_distinct("page_number").alias("n_pages"), F.count("*").alias("n_chunks"), F.max("chunk_index").alias("last_index"))


def count_reconcile(spark: SparkSession, at: str) -> DataFrame:
    """Catalog entries that aren't removed against the chunks stored for them."""
    catalog = _read(spark, at, "library_documents").filter(F.col("removed_at").isNull()).groupBy(uuid_key("id").alias("document")).agg(F.max("chunk_count").alias("expected"))
    return catalog.join(document_totals(spark, at), "document", "left").select("document", "expected", F.coalesce("n_chunks", F.lit(0)).alias("stored"), (F.col("expected") == F.coalesce("n_chunks", F.lit(0))).alias("is_equal"))


QUERIES = {
    "text_normalise": text_normalise, "doc_hash_dedupe": doc_hash_dedupe, "import_summary": import_summary, "page_split": page_split, "chunk_documents": chunk_documents,
    "chunk_words_200": chunk_words_200, "chunk_stats": chunk_stats, "budget_batches_2000": budget_batches_2000, "fixed_batches_2": fixed_batches_2, "prompt_contexts": prompt_contexts,
    "document_totals": document_totals, "count_reconcile": count_reconcile,
}

# what Java's (?U)\s takes as white space
_WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TIDY = "regexp_replace(" + (r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')") + f", '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_COLLAPSE = f"trim(regexp_replace(text, '[{_WS}]+', ' ', 'g'))"
_KEY = "case when length(regexp_replace(lower({c}), 'urn:uuid:|[^0-9a-f]', '', 'g')) = 32 then regexp_replace(lower({c}), 'urn:uuid:|[^0-9a-f]', '', 'g') else '!' || trim(lower({c})) end"
_DEDUPE = "select doc_id, sha256(text) as content_sha256, min(doc_id) over (partition by sha256(text)) as kept_id, case when doc_id = min(doc_id) over (partition by sha256(text)) then 'added' else 'skipped' end as status from documents where text is not null"
_LIBRARY = f"""lib as (
  select c.* exclude (r) from (select *, {_KEY.format(c="document_id")} as document, row_number() over (partition by {_KEY.format(c="document_id")}, chunk_index order by chunk_id) as r
  from chunks where document_id is not null) c where r = 1)"""


def _runs(texts: str, most: int, overlap: int) -> str:
    """SQL: chunk (doc_id, chunk_index, t), the overlapping word runs of every text of a query (doc_id unique, text)."""
    return f"""with recursive w as (
  select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from (
    select doc_id, flatten(list_transform(list_filter(regexp_split_to_array(text, '[{_WS}\\x1C-\\x1F]+'), lambda x: x <> ''), lambda x: regexp_extract_all(x, '(?s).{{1,{most}}}'))) as words from ({texts}) where text is not null)),
q as (
  select doc_id, word, i, sum(length(word) + 1) over (partition by doc_id order by i) as e from w),
p as (
  select doc_id, list(word order by i) as words, count(*) as n, list_prepend(0::bigint, list(e::bigint order by i)) as ends from q group by doc_id),
c as (
  select doc_id, 0 as chunk_index, 0::bigint as s, (len(list_filter(ends, lambda v: v <= {most} + 1)) - 1)::bigint as e, n from p
  union all
  select c.doc_id, c.chunk_index + 1, t.s, (len(list_filter(p.ends, lambda v: v <= p.ends[t.s + 1] + {most} + 1)) - 1)::bigint, c.n
  from c join p using (doc_id), lateral (select case when greatest(c.s, least(c.e, len(list_filter(p.ends, lambda v: v < p.ends[c.e + 1] - 1 - {overlap})))) = c.s then c.e
    else greatest(c.s, least(c.e, len(list_filter(p.ends, lambda v: v < p.ends[c.e + 1] - 1 - {overlap})))) end as s) t
  where c.e < c.n),
chunk as (
  select doc_id, chunk_index, array_to_string(p.words[c.s + 1 : c.e], ' ') as t from c join p using (doc_id))
"""


_CHUNKS = _runs("select doc_id, text from documents", MOST, OVERLAP)
# a page of one line is one paragraph: cut into runs if it is too long, else one run
_PAGES = "select doc_id * 100000 + generate_subscripts(string_split(text, chr(10)), 1) as doc_id, unnest(string_split(text, chr(10))) as text from documents where text is not null"
ORACLES = {
    "text_normalise": f"select doc_id, length({_TIDY}) as n_chars, md5({_TIDY}) as text_md5, length({_COLLAPSE}) as n_collapsed from documents",
    "doc_hash_dedupe": _DEDUPE,
    "import_summary": f"with d as (select d.source, case when {_COLLAPSE.replace('(text', '(d.text')} = '' then 'failed' else status end as status from ({_DEDUPE}) x join documents d using (doc_id)) select source, count(*) filter (status = 'added') as n_added, count(*) filter (status = 'skipped') as n_skipped, count(*) filter (status = 'failed') as n_failed, count(*) as n_documents from d group by 1",
    "page_split": "select doc_id, generate_subscripts(parts, 1)::int as page, length(unnest(parts)) as n_chars, md5(unnest(parts)) as page_md5 from (select doc_id, string_split(text, chr(10) || chr(10)) as parts from documents where text is not null)",
    "chunk_documents": f"{_runs(_PAGES, MAX_CHARS, OVERLAP_CHARS)} select doc_id // 100000 as doc_id, (doc_id % 100000)::int as page, (row_number() over (partition by doc_id // 100000 order by doc_id, chunk_index) - 1)::int as chunk_index, length(t) as n_chars, md5(t) as chunk_md5 from chunk",
    "chunk_words_200": f"{_CHUNKS} select doc_id, chunk_index, length(t) as n_chars, md5(t) as chunk_md5 from chunk",
    "chunk_stats": f"{_CHUNKS} select source, count(*) as n_chunks, max(length(t)) as most_chars, sum(length(t))::bigint as n_chars, count(distinct doc_id) as n_documents from chunk join documents using (doc_id) group by 1",
    "budget_batches_2000": f"""with recursive {_LIBRARY},
      o as (select chunk_id, document, row_number() over (partition by document order by chunk_index) as i, length(text) as l from lib),
      f as (select chunk_id, document, i, 1 as b, l::bigint as held from o where i = 1
        union all select o.chunk_id, o.document, o.i, case when f.held + o.l > {BUDGET} then f.b + 1 else f.b end, case when f.held + o.l > {BUDGET} then o.l else f.held + o.l end from f join o on o.document = f.document and o.i = f.i + 1)
      select chunk_id, document, i::int as context_number, b as batch_number, held as batch_size from f""",
    "fixed_batches_2": """select document_id, identity_fingerprint, n::int as n_questions, (b + 1)::int as batch_number, (2 * b + 1)::int as first_number, least(2 * b + 2, n)::int as last_number
      from (select distinct document_id, identity_fingerprint, len(questions) as n from question_banks), lateral (select unnest(range(0, (n + 1) // 2)) as b)""",
    "prompt_contexts": f"""with {_LIBRARY}, o as (select chunk_id, row_number() over (partition by document order by chunk_index) as n, source, page_number, text from lib),
      l as (select chunk_id, n, '[' || n || '] ' || source || ', page ' || page_number || ': ' || text as line from o)
      select chunk_id, n::int as context_number, length(line) as n_chars, md5(line) as context_md5 from l""",
    "document_totals": f"with {_LIBRARY} select document, count(distinct page_number) as n_pages, count(*) as n_chunks, max(chunk_index) as last_index from lib group by 1",
    "count_reconcile": f"""with {_LIBRARY}, cat as (select {_KEY.format(c="id")} as document, max(chunk_count) as expected from library_documents where removed_at is null group by 1),
      n as (select document, count(*) as stored from lib group by 1)
      select document, expected, coalesce(stored, 0) as stored, expected = coalesce(stored, 0) as is_equal from cat left join n using (document)""",
}
