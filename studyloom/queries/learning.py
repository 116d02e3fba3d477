"""Queries over vectors, reviews, progress, citations and write semantics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.functions.json_strict import fingerprint, strict_value
from studyloom.functions.text import ascii_lower, casefold, strip, uuid_key
from studyloom.operators.citations import exploded, is_subset, is_unique, resolve
from studyloom.operators.evaluate import citation_match, has_concept, micro_average
from studyloom.operators.progress import difficult_concepts, progress_report
from studyloom.operators.review import due, latest, review_fold
from studyloom.operators.search import top_k, vector_report
from studyloom.operators.store import add_column, put, replace_by_key, without

#: The time at which what is due is asked.
AS_OF = "2024-09-01 00:00:00"
BANK = ["document_id", "question_bank_identity_fingerprint"]
QUESTION = [*BANK, "question_number"]


def _read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{table}.parquet")


def _as_of():  # noqa: ANN202
    return F.lit(AS_OF).cast("timestamp")


# ---- vectors

def _hits(spark: SparkSession, at: str, tag: str | None = None) -> DataFrame:
    v = _read(spark, at, "embeddings")
    return top_k(v, v.filter(F.col("vec_id") % 50 == 0), 5, "vec_id", "embedding", tag)


def vec_topk(spark: SparkSession, at: str) -> DataFrame:
    return _hits(spark, at).withColumnRenamed("id", "vec_id")


def vec_topk_filtered(spark: SparkSession, at: str) -> DataFrame:
    return _hits(spark, at, "label").withColumnRenamed("id", "vec_id")


def vec_validate(spark: SparkSession, at: str) -> DataFrame:
    return vector_report(_read(spark, at, "embeddings"), "embedding", "label")


def vec_join_metadata(spark: SparkSession, at: str) -> DataFrame:
    labels = _read(spark, at, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return _hits(spark, at).join(labels, "id").groupBy("query_id", "label").agg(F.count("*").alias("n_hits"), F.max("score").alias("best_score"), F.min("rank").alias("best_rank"))


# ---- reviews

def _attempts(spark: SparkSession, at: str) -> DataFrame:
    """Each delivered attempt once."""
    return latest(_read(spark, at, "study_attempts"), ["id"], "received_at")


def _folded(spark: SparkSession, at: str) -> DataFrame:
    rows = _attempts(spark, at).select("id", *QUESTION, "rating", "answered_at")
    return review_fold(rows, QUESTION, "answered_at", "rating", "id")


def review_history(spark: SparkSession, at: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*QUESTION).orderBy("answered_at", "id"))
    return _attempts(spark, at).select("id", *QUESTION, number.alias("attempt_number"), F.date_format("answered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("answered"))


def review_states(spark: SparkSession, at: str) -> DataFrame:
    return _folded(spark, at).select("id", "repetition_count", "interval_days", F.round("ease_factor", 6).alias("ease_factor"), F.coalesce(F.unix_micros("due_at").cast("string"), F.lit("beyond")).alias("due_us"))


def review_final(spark: SparkSession, at: str) -> DataFrame:
    last = latest(_folded(spark, at), QUESTION, "answered_at", "id")
    return last.select(*QUESTION, "repetition_count", "interval_days", F.round("ease_factor", 6).alias("ease_factor"), F.coalesce(F.unix_micros("due_at").cast("string"), F.lit("beyond")).alias("due_us"))


def _bank_questions(spark: SparkSession, at: str) -> DataFrame:
    banks = _read(spark, at, "question_banks").select("document_id", F.col("identity_fingerprint").alias(BANK[1]), F.explode("questions.number").alias("question_number"))
    return banks.distinct()


def _progress(spark: SparkSession, at: str) -> DataFrame:
    return latest(_read(spark, at, "question_progress"), QUESTION, "created_at", "due_at", "repetition_count")


def review_due(spark: SparkSession, at: str) -> DataFrame:
    """The first ten due questions of every bank: overdue by time, then new ones."""
    asked = due(_bank_questions(spark, at), _progress(spark, at), QUESTION, _as_of())
    place = F.row_number().over(Window.partitionBy(*BANK).orderBy(F.col("due_at").isNull(), "due_at", "question_number"))
    return asked.withColumn("place", place).filter("place <= 10").select(*QUESTION, "place", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("due"))


def progress_by_bank(spark: SparkSession, at: str) -> DataFrame:
    out = progress_report(_bank_questions(spark, at), _attempts(spark, at), _progress(spark, at), BANK, "question_number", _as_of())
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.withColumns({"next_due_at": stamp("next_due_at"), "last_studied_at": stamp("last_studied_at")})


def concepts_missed(spark: SparkSession, at: str) -> DataFrame:
    """Every concept that was missing, with how often over all banks."""
    return difficult_concepts(_attempts(spark, at)).select("concept", "folded", "n_missing")


def concepts_missed_by_bank(spark: SparkSession, at: str) -> DataFrame:
    """Of every bank all concepts that were missing, in order."""
    place = F.row_number().over(Window.partitionBy(*BANK).orderBy(F.desc("n_missing"), "folded", "concept"))
    return difficult_concepts(_attempts(spark, at), *BANK).withColumn("place", place).select(*BANK, "place", "concept", "n_missing")


# ---- citations

def _summaries(spark: SparkSession, at: str) -> DataFrame:
    return _read(spark, at, "document_summaries").withColumn("document", uuid_key("document_id"))


def _banks(spark: SparkSession, at: str) -> DataFrame:
    return _read(spark, at, "question_banks").withColumn("document", uuid_key("document_id"))


def citation_resolve(spark: SparkSession, at: str) -> DataFrame:
    c = _read(spark, at, "chunks").filter(F.col("document_id").isNotNull()).withColumn("document", uuid_key("document_id"))
    first = c.groupBy("document", "chunk_index").agg(F.min_by(F.struct("chunk_id", "text", "page_number"), "chunk_id").alias("x")).select("document", "chunk_index", "x.chunk_id", "x.text", F.col("x.page_number").alias("stored_page"))
    cited = exploded(_summaries(spark, at), ["summary_id", "document"])
    found = resolve(cited, first.select("document", "chunk_index", "chunk_id", "text"), ["document", "chunk_index"])
    return found.select("summary_id", "place", "number", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), F.coalesce(F.startswith("chunk_text", "excerpt"), F.lit(False)).alias("excerpt_matches"))


def _expected(spark: SparkSession, at: str) -> DataFrame:
    return exploded(_summaries(spark, at), ["document"]).select("document", "source", "page_number")


def _actual(spark: SparkSession, at: str) -> DataFrame:
    q = _banks(spark, at).select("document", F.explode("questions").alias("q")).select("document", F.col("q.citations").alias("citations"))
    return exploded(q, ["document"]).select("document", "source", "page_number")


def eval_citations(spark: SparkSession, at: str) -> DataFrame:
    return citation_match(_expected(spark, at), _actual(spark, at), ["document"], ["source", "page_number"])


def eval_report(spark: SparkSession, at: str) -> DataFrame:
    sources = _expected(spark, at).groupBy("document").agg(F.min("source").alias("source"))
    return micro_average(eval_citations(spark, at).join(sources, "document"), "source")


def eval_concepts(spark: SparkSession, at: str) -> DataFrame:
    """Of every classified attempt the missing concepts that its expected answer or its answer holds after all."""
    a = _attempts(spark, at).filter(F.col("evaluation").isNotNull()).select("id", "answer_text", "expected_answer", F.explode("evaluation.missing_concepts").alias("concept"))
    one = F.array("concept")
    return a.select("id", "concept", F.coalesce(has_concept(F.col("answer_text"), one), F.lit(False)).alias("in_answer"), F.coalesce(has_concept(F.col("expected_answer"), one), F.lit(False)).alias("in_expected")).distinct()


def citation_coverage(spark: SparkSession, at: str) -> DataFrame:
    """Per question: whether its pages are among those its document's summaries cite, and whether its numbers are unique."""
    known = exploded(_summaries(spark, at), ["document"]).groupBy("document").agg(F.collect_set("chunk_index").alias("known"))
    q = _banks(spark, at).select("document", "document_id", "identity_fingerprint", F.explode("questions").alias("q")).select("document", "document_id", "identity_fingerprint", F.col("q.number").alias("number"), F.col("q.citations.chunk_index").alias("used"), F.col("q.citations.number").alias("numbers")).distinct()
    return q.join(known, "document", "left").select(
        "document_id", "identity_fingerprint", "number", F.coalesce(is_subset(F.col("used"), F.col("known")), F.lit(False)).alias("is_covered"), F.coalesce(F.arrays_overlap("used", "known"), F.lit(False)).alias("is_touched"), is_unique(F.col("numbers")).alias("is_unique")
    )


def question_dedupe(spark: SparkSession, at: str) -> DataFrame:
    """Of each document the questions that came first with their folded text, and those that only repeat one."""
    q = _banks(spark, at).select("document", "identity_fingerprint", "created_at", F.explode("questions").alias("q")).select("document", "identity_fingerprint", "created_at", "q.number", F.md5(casefold(strip("q.text"))).alias("folded")).distinct()
    place = F.row_number().over(Window.partitionBy("document", "folded").orderBy("created_at", "identity_fingerprint", "number"))
    return q.select("document", "identity_fingerprint", "number", "folded", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created"), (place == 1).alias("is_first"))


# ---- catalog, identities

def catalog_membership(spark: SparkSession, at: str) -> DataFrame:
    known = _read(spark, at, "library_documents").select(uuid_key("id").alias("document")).distinct()
    s = _summaries(spark, at)
    inside = s.join(known, "document", "left_semi").groupBy("source").agg(F.count("*").alias("n"))
    outside = s.join(known, "document", "left_anti").groupBy("source").agg(F.count("*").alias("n"))
    return inside.withColumn("in_catalog", F.lit(True)).unionByName(outside.withColumn("in_catalog", F.lit(False))).select("source", "in_catalog", F.col("n").alias("n_summaries"))


def package_lookup(spark: SparkSession, at: str) -> DataFrame:
    """Packages by name without regard to ASCII case, in order, and the other packages of that name."""
    p = _read(spark, at, "learning_packages").select("id", "name").distinct().withColumn("folded", ascii_lower("name"))
    same = Window.partitionBy("folded")
    return p.select("id", "name", F.count("*").over(same).alias("n_same_name"), F.row_number().over(same.orderBy("name", "id")).alias("place"))


def prompt_fingerprints(spark: SparkSession, at: str) -> DataFrame:
    p = _read(spark, at, "document_summaries").select("summary_id", "document_id", "identity_fingerprint", F.size("citations").alias("n"))
    return p.select("summary_id", fingerprint(document_id=F.col("document_id"), identity=F.col("identity_fingerprint"), n_citations=F.col("n")).alias("sha256"))


def cache_misses(spark: SparkSession, at: str) -> DataFrame:
    """Of the summaries and banks that packages name by identity: how many are stored and how many must be made again."""
    p = _read(spark, at, "learning_packages").select("id", uuid_key("document_id").alias("document"), "summary_identity_fingerprint", "question_bank_identity_fingerprint").distinct()
    out = None
    for kind, column, stored in (("summary", "summary_identity_fingerprint", _summaries(spark, at)), ("bank", "question_bank_identity_fingerprint", _banks(spark, at))):
        asked = p.select("id", "document", F.col(column).alias("identity_fingerprint")).filter(F.col("identity_fingerprint").isNotNull())
        missing = asked.join(stored.select("document", "identity_fingerprint").distinct(), ["document", "identity_fingerprint"], "left_anti")
        counts = asked.agg(F.count("*").alias("n_asked")).join(missing.agg(F.count("*").alias("n_missing"))).withColumn("kind", F.lit(kind))
        out = counts if out is None else out.unionByName(counts)
    return out.select("kind", "n_asked", "n_missing")


def json_strict(spark: SparkSession, at: str) -> DataFrame:
    e = _read(spark, at, "events").select("event_id", "event_type", strict_value(F.col("props"), "k", "int").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n_events"), F.count("k").alias("n_strict"), F.sum(F.col("k").cast("bigint")).alias("sum_k"))


# ---- write semantics

def upsert_latest(spark: SparkSession, at: str) -> DataFrame:
    last = latest(_read(spark, at, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id")
    return last.select("user_id", "event_type", "event_id", "value")


def idempotent_put(spark: SparkSession, at: str) -> DataFrame:
    """The progress rows put onto those that were never reviewed: what is new, what is there already and what differs."""
    p = _read(spark, at, "question_progress").select(*QUESTION, "repetition_count", "interval_days", "ease_factor")
    stored = p.withColumn("interval_days", F.col("interval_days") % 7).filter(F.col("repetition_count") < 3)
    return put(stored, p, QUESTION)


def replace_document(spark: SparkSession, at: str) -> DataFrame:
    """The chunks after those documents are indexed anew that were indexed twice (some index with two chunks)."""
    c = _read(spark, at, "chunks").select("chunk_id", "document_id", "chunk_index", "source")
    known = c.filter(F.col("document_id").isNotNull())
    twice = known.groupBy("document_id", "chunk_index").agg(F.count("*").alias("n"), F.max("chunk_id").alias("chunk_id")).withColumn("any", F.max("n").over(Window.partitionBy("document_id"))).filter("any > 1")
    fresh = twice.select("chunk_id", "document_id", "chunk_index")
    return replace_by_key(c, fresh, "document_id")


def remove_cascade(spark: SparkSession, at: str) -> DataFrame:
    """What is left of each table without the documents that the catalog has as removed."""
    catalog = _read(spark, at, "library_documents").groupBy(uuid_key("id").alias("document")).agg(F.max(F.col("removed_at").isNull()).alias("active"))
    gone = catalog.filter(~F.col("active"))
    out = None
    for t in ("chunks", "document_summaries", "question_banks", "question_progress", "study_attempts", "learning_packages"):
        rows = _read(spark, at, t).select(uuid_key("document_id").alias("document"))
        n = rows.withColumn("kept", F.lit(0)).unionByName(without(rows, gone, "document").withColumn("kept", F.lit(1)))
        counts = n.agg(F.count_if(F.col("kept") == 0).alias("n_before"), F.count_if(F.col("kept") == 1).alias("n_after")).withColumn("table_name", F.lit(t))
        out = counts if out is None else out.unionByName(counts)
    return out.select("table_name", "n_before", "n_after")


def schema_evolution(spark: SparkSession, at: str) -> DataFrame:
    """Older progress rows, without the column for the last review, beside newer ones."""
    p = _read(spark, at, "question_progress").select(*QUESTION, "repetition_count", "last_reviewed_at")
    old = add_column(p.filter("repetition_count = 0").drop("last_reviewed_at"), "last_reviewed_at", "timestamp")
    both = old.unionByName(p.filter("repetition_count > 0"))
    return both.groupBy("repetition_count").agg(F.count("*").alias("n_rows"), F.count("last_reviewed_at").alias("n_reviewed"))


QUERIES = {
    f.__name__: f
    for f in (
        vec_topk, vec_topk_filtered, vec_validate, vec_join_metadata, review_history, review_states, review_final, review_due, progress_by_bank, concepts_missed, concepts_missed_by_bank, citation_resolve, eval_citations, eval_report,
        eval_concepts, citation_coverage, question_dedupe, catalog_membership, package_lookup, prompt_fingerprints, cache_misses, json_strict, upsert_latest, idempotent_put, replace_document, remove_cascade, schema_evolution,
    )
}

_KEY = "case when length(regexp_replace(lower({c}), 'urn:uuid:|[^0-9a-f]', '', 'g')) = 32 then regexp_replace(lower({c}), 'urn:uuid:|[^0-9a-f]', '', 'g') else '!' || trim(lower({c})) end"
_DOC = _KEY.format(c="document_id")
_STAMP = "strftime({c} at time zone 'UTC', '%Y-%m-%d %H:%M:%S.%f')"
_Q = "document_id, question_bank_identity_fingerprint, question_number"
_TOP = """with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
  s as (select q.vec_id as query_id, v.vec_id, v.label, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) as score
    from v q, v where q.vec_id % 50 = 0 {where}),
  t as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score, label from s qualify rank <= 5)
"""
_ATT = "a as (select * from study_attempts qualify row_number() over (partition by id order by received_at desc) = 1)"
_FOLD = f"""with recursive {_ATT},
  ev as (select id, {_Q}, rating as g, answered_at as ts, row_number() over (partition by {_Q} order by answered_at, id) as n from a),
  st as (
    select id, {_Q}, n, case g when 'again' then 0 else 1 end as r, case g when 'again' then 0 when 'easy' then 4 else 1 end as i,
      case g when 'again' then 2.5::double - 0.2::double when 'hard' then 2.5::double - 0.15::double when 'easy' then 2.5::double + 0.15::double else 2.5::double end as e, ts, g from ev where n = 1
    union all
    select ev.id, ev.document_id, ev.question_bank_identity_fingerprint, ev.question_number, ev.n, case ev.g when 'again' then 0 else st.r + 1 end,
      case ev.g when 'again' then 0 when 'hard' then case when st.i = 0 then 1 else greatest(1, least(2147483647::double, round_even(st.i * 1.2::double, 0))::int) end
        when 'good' then case st.r when 0 then 1 when 1 then 6 else greatest(1, least(2147483647::double, round_even(st.i * st.e, 0))::int) end
        else case when st.i = 0 then 4 else greatest(4, least(2147483647::double, round_even(st.i * st.e * 1.3::double, 0))::int) end end,
      case ev.g when 'again' then greatest(1.3::double, st.e - 0.2::double) when 'hard' then greatest(1.3::double, st.e - 0.15::double) when 'easy' then st.e + 0.15::double else st.e end, ev.ts, ev.g
    from st join ev on ev.document_id = st.document_id and ev.question_bank_identity_fingerprint = st.question_bank_identity_fingerprint and ev.question_number = st.question_number and ev.n = st.n + 1),
  d as (select *, case g when 'again' then epoch_us(ts)::hugeint + 600000000 else epoch_us(ts)::hugeint + i::hugeint * 86400000000 end as due from st),
  f as (select *, case when due <= 9223372036854775807 then due::bigint end as due_us from d)
"""
_PROG = f"p as (select * from question_progress qualify row_number() over (partition by {_Q} order by created_at desc, due_at desc, repetition_count desc) = 1)"
_BQ = "bq as (select distinct document_id, identity_fingerprint as question_bank_identity_fingerprint, unnest(list_transform(questions, lambda q: q.number)) as question_number from question_banks)"
_AS_OF = f"(timestamp '{AS_OF}' at time zone 'UTC')"
_FOLDED = "replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ')"
_EXPECTED = f"ex as (select distinct document, c.source, c.page_number from (select {_DOC} as document, unnest(citations) as c from document_summaries))"
_ACTUAL = f"ac as (select distinct document, c.source, c.page_number from (select document, unnest(q.citations) as c from (select {_DOC} as document, unnest(questions) as q from question_banks)))"
_CASES = f"""{_EXPECTED}, {_ACTUAL}, j as (select coalesce(ex.document, ac.document) as document, ex.document is not null as e, ac.document is not null as a from ex full join (select * from ac where document in (select document from ex)) ac
    on ex.document = ac.document and ex.source = ac.source and ex.page_number = ac.page_number),
  k as (select document, count(*) filter (e and a) as n_matched, count(*) filter (not a) as n_missing, count(*) filter (not e) as n_unexpected from j group by 1),
  cases as (select *, case when n_matched + n_missing = 0 then 0.0 else n_matched / (n_matched + n_missing) end as recall, case when n_matched + n_unexpected = 0 then 0.0 else n_matched / (n_matched + n_unexpected) end as precision,
    n_missing = 0 and n_unexpected = 0 as passed from k)"""
_GONE = f"gone as (select {_KEY.format(c='id')} as document from library_documents group by 1 having not bool_or(removed_at is null))"
ORACLES = {
    "vec_topk": _TOP.format(where="") + "select query_id, rank, vec_id, score from t",
    "vec_topk_filtered": _TOP.format(where="and q.label = v.label") + "select query_id, rank, vec_id, score from t",
    "vec_validate": """with v as (select label, embedding as e, sqrt(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double))) as norm from embeddings), u as (select mode(len(e)) as usual from v)
      select label, count(*) as n_vectors, count(*) filter (e is null or len(e) = 0) as n_empty, count(*) filter (norm = 0) as n_zero, count(*) filter (len(e) <> usual) as n_other_dimension, count(*) filter (abs(norm - 1) < 1e-4) as n_unit from v, u group by 1""",
    "vec_join_metadata": _TOP.format(where="") + "select query_id, label, count(*) as n_hits, max(score) as best_score, min(rank) as best_rank from t group by 1, 2",
    "review_history": f"with {_ATT} select id, {_Q}, (row_number() over (partition by {_Q} order by answered_at, id))::int as attempt_number, {_STAMP.format(c='answered_at')} as answered from a",
    "review_states": f"{_FOLD} select id, r::int as repetition_count, i::int as interval_days, round(e, 6) as ease_factor, coalesce(due_us::varchar, 'beyond') as due_us from f",
    "review_final": f"{_FOLD} select {_Q}, r::int as repetition_count, i::int as interval_days, round(e, 6) as ease_factor, coalesce(due_us::varchar, 'beyond') as due_us from f qualify row_number() over (partition by {_Q} order by n desc) = 1",
    "review_due": f"""with {_PROG}, {_BQ}, d as (select bq.*, p.due_at from bq left join p using ({_Q}) where p.due_at is null or p.due_at <= {_AS_OF})
      select {_Q}, (row_number() over (partition by document_id, question_bank_identity_fingerprint order by due_at is null, due_at, question_number))::int as place, {_STAMP.format(c='due_at')} as due from d qualify place <= 10""",
    "progress_by_bank": f"""with {_ATT}, {_PROG}, {_BQ},
      x as (select {_Q}, count(*) as n, count(*) filter (evaluation.verdict = 'incorrect') as i, count(*) filter (evaluation.verdict = 'partially_correct') as pc, count(*) filter (evaluation.verdict = 'correct') as c,
        count(*) filter (evaluation.verdict is null) as u, max(answered_at) as l from a group by all),
      j as (select bq.*, p.due_at, x.n, x.i, x.pc, x.c, x.u, x.l from bq left join p using ({_Q}) left join x using ({_Q})),
      g as (select document_id, question_bank_identity_fingerprint, count(*) as n_questions, count(n) as n_answered, coalesce(sum(n), 0)::bigint as n_attempts, coalesce(sum(i), 0)::bigint as n_incorrect, coalesce(sum(pc), 0)::bigint as n_partially_correct,
        coalesce(sum(c), 0)::bigint as n_correct, coalesce(sum(u), 0)::bigint as n_unclassified, count(*) filter (due_at is null or due_at <= {_AS_OF}) as n_due, min(coalesce(due_at, {_AS_OF})) as nd, max(l) as ls from j group by 1, 2)
      select document_id, question_bank_identity_fingerprint, n_questions, n_answered, n_attempts, n_incorrect, n_partially_correct, n_correct, n_unclassified, n_due, {_STAMP.format(c='nd')} as next_due_at, {_STAMP.format(c='ls')} as last_studied_at,
        n_answered / n_questions as answered_rate, case when n_attempts = 0 then 0.0 else n_correct / n_attempts end as correct_rate from g""",
    "concepts_missed": f"with {_ATT}, m as (select unnest(evaluation.missing_concepts) as concept from a) select concept, {_FOLDED.format(c='concept')} as folded, count(*) as n_missing from m group by all",
    "concepts_missed_by_bank": f"with {_ATT}, m as (select document_id, question_bank_identity_fingerprint, unnest(evaluation.missing_concepts) as concept from a), c as (select document_id, question_bank_identity_fingerprint, concept, count(*) as n_missing from m group by all) select document_id, question_bank_identity_fingerprint, (row_number() over (partition by document_id, question_bank_identity_fingerprint order by n_missing desc, {_FOLDED.format(c='concept')}, concept))::int as place, concept, n_missing from c",
    "citation_resolve": f"""with c as (select {_DOC} as document, chunk_index, chunk_id, text from chunks where document_id is not null qualify row_number() over (partition by document, chunk_index order by chunk_id) = 1),
      s as (select summary_id, {_DOC} as document, unnest(citations) as x, generate_subscripts(citations, 1) as place from document_summaries)
      select summary_id, place::int as place, x.number as number, coalesce(chunk_id, -1) as chunk_id, coalesce(starts_with(c.text, x.excerpt), false) as excerpt_matches from s left join c on c.document = s.document and c.chunk_index = x.chunk_index""",
    "eval_citations": f"with {_CASES} select * from cases",
    "eval_report": f"""with {_CASES}, src as (select document, min(source) as source from ex group by 1)
      select source, count(*) as n_cases, count(*) filter (passed) as n_passed, count(*) filter (passed) / count(*) as pass_rate, case when sum(n_matched + n_missing) = 0 then 0.0 else (sum(n_matched) / sum(n_matched + n_missing))::double end as recall,
        case when sum(n_matched + n_unexpected) = 0 then 0.0 else (sum(n_matched) / sum(n_matched + n_unexpected))::double end as precision from cases join src using (document) group by 1""",
    "eval_concepts": f"with {_ATT}, m as (select id, answer_text, expected_answer, unnest(evaluation.missing_concepts) as concept from a where evaluation is not null) select distinct id, concept, coalesce(contains({_FOLDED.format(c='answer_text')}, {_FOLDED.format(c='concept')}), false) as in_answer, coalesce(contains({_FOLDED.format(c='expected_answer')}, {_FOLDED.format(c='concept')}), false) as in_expected from m",
    "citation_coverage": f"""with k as (select document, list(distinct ci) as known from (select {_DOC} as document, unnest(list_transform(citations, lambda c: c.chunk_index)) as ci from document_summaries) group by 1),
      q as (select distinct {_DOC} as document, document_id, identity_fingerprint, unnest(questions) as q from question_banks),
      u as (select document, document_id, identity_fingerprint, q.number as number, list_transform(q.citations, lambda c: c.chunk_index) as used, list_transform(q.citations, lambda c: c.number) as numbers from q)
      select distinct document_id, identity_fingerprint, number, coalesce(list_has_all(known, used), false) as is_covered, coalesce(list_has_any(known, used), false) as is_touched, len(list_distinct(numbers)) = len(numbers) as is_unique from u left join k using (document)""",
    "question_dedupe": f"""with q as (select distinct {_DOC} as document, identity_fingerprint, created_at, unnest(questions) as q from question_banks),
      f as (select distinct document, identity_fingerprint, created_at, q.number as number, md5({_FOLDED.format(c="regexp_replace(q.text, '^[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r" + chr(92) + "x{A0}]+|[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r" + chr(92) + "x{A0}]+$', '', 'g')")}) as folded from q)
      select document, identity_fingerprint, number, folded, {_STAMP.format(c='created_at')} as created, row_number() over (partition by document, folded order by created_at, identity_fingerprint, number) = 1 as is_first from f""",
    "catalog_membership": f"with k as (select distinct {_KEY.format(c='id')} as document from library_documents) select source, {_DOC} in (select document from k) as in_catalog, count(*) as n_summaries from document_summaries group by 1, 2",
    "package_lookup": """with p as (select distinct id, name, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as folded from learning_packages)
      select id, name, count(*) over (partition by folded) as n_same_name, (row_number() over (partition by folded order by name, id))::int as place from p""",
    "prompt_fingerprints": """select summary_id, sha256('{"document_id":"' || document_id || '","identity":"' || identity_fingerprint || '","n_citations":' || len(citations) || '}') as sha256 from document_summaries""",
    "cache_misses": f"""with p as (select distinct id, {_DOC} as document, summary_identity_fingerprint as s, question_bank_identity_fingerprint as b from learning_packages)
      select 'summary' as kind, count(s) as n_asked, count(s) filter ((document, s) not in (select ({_DOC}, identity_fingerprint) from document_summaries)) as n_missing from p
      union all select 'bank', count(b), count(b) filter ((document, b) not in (select ({_DOC}, identity_fingerprint) from question_banks)) from p""",
    "json_strict": r"""with e as (select event_type, case when regexp_full_match(props, '\s*\{\s*"k"\s*:\s*(-?(?:0|[1-9]\d*))\s*\}\s*') then json_extract_string(props, '$.k')::bigint end as k from events)
      select event_type, count(*) as n_events, count(k) as n_strict, sum(k)::bigint as sum_k from e group by 1""",
    "upsert_latest": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "idempotent_put": f"""with p as (select {_Q}, repetition_count as r, interval_days as i, ease_factor as e from question_progress), s as (select {_Q}, r, i % 7 as i, e from p where r < 3),
      n as (select {_Q}, count(distinct (r, i, e)) as k, min((r, i, e)) as v from p group by all), o as (select {_Q}, count(distinct (r, i, e)) as k, min((r, i, e)) as v from s group by all)
      select {_Q}, case when o.k is null then case when n.k = 1 then 'inserted' else 'conflict' end when n.k = 1 and o.k = 1 and n.v = o.v then 'unchanged' else 'conflict' end as outcome from n left join o using ({_Q})""",
    "replace_document": """with t as (select document_id, chunk_index, count(*) as n, max(chunk_id) as chunk_id from chunks where document_id is not null group by 1, 2),
      f as (select *, max(n) over (partition by document_id) as m from t qualify m > 1)
      select chunk_id, document_id, chunk_index, source from chunks where document_id is null or document_id not in (select document_id from f) union all select chunk_id, document_id, chunk_index, null from f""",
    "remove_cascade": f"with {_GONE} " + " union all ".join(f"select '{t}' as table_name, count(*) as n_before, count(*) filter (document_id is null or {_DOC} not in (select document from gone)) as n_after from {t}" for t in ("chunks", "document_summaries", "question_banks", "question_progress", "study_attempts", "learning_packages")),
    "schema_evolution": "select repetition_count, count(*) as n_rows, count(case when repetition_count > 0 then last_reviewed_at end) as n_reviewed from question_progress group by 1",
}
