"""Queries of the model-backed steps with deterministic providers: grounded answers, map/reduce summaries, question banks, evaluated
answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.functions.json_strict import strict_object
from studyloom.functions.providers import OUTLINE, drafting, marking, outlining
from studyloom.operators.answers import evaluate_answers, record_answers
from studyloom.operators.generation import first_sentences, map_batches
from studyloom.operators.questions import draft_banks, trusted
from studyloom.operators.search import ground
from studyloom.operators.summaries import map_step, resume, summarize
from studyloom.plans.lineage import cut
from studyloom.queries.corpus import _LIBRARY, _WS, BUDGET, _library_chunks
from studyloom.queries.learning import _ATT, _FOLD, _TOP, QUESTION, _attempts, _hits, _Q, _read
from studyloom.sources.reports import nested_as_json, nested_from_json

#: Questions of a drafted bank, and of one batch.
QUESTIONS, BATCH = 5, 2


def grounded_answer(spark: SparkSession, at: str) -> DataFrame:
    """Each query vector's answer: the labels of its hits in order as contexts, the best score, and the cited ids."""
    labels = _read(spark, at, "embeddings").select(F.col("vec_id").alias("id"), "label")
    rows = _hits(spark, at).join(labels, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "label"))).alias("h"), F.max("score").alias("best_score"))
    line = lambda x: F.concat(F.lit("["), x["rank"], F.lit("] label "), x["label"])
    return rows.select("query_id", "best_score", F.array_join(F.transform("h", line), "; ").alias("contexts"), F.array_join(F.transform("h", lambda x: x["id"].cast("string")), ",").alias("cited_ids"))


def grounded_answers(spark: SparkSession, at: str) -> DataFrame:
    """Each query vector's answer by the provider from its hits (their labels), with the vectors it cites."""
    labels = _read(spark, at, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("label "), "label").alias("text"))
    queries = _read(spark, at, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("what is "), "vec_id").alias("question"))
    out = ground(_hits(spark, at).join(labels, "id"), queries, "text", outlining)
    return out.select("query_id", "answer", "is_valid", F.array_join("cited_ids", ",").alias("cited_ids"), F.array_join("prompt_names", ",").alias("prompts"))


def citations_as_json(spark: SparkSession, at: str) -> DataFrame:
    """Every summary's citations written as JSON text and read back."""
    s = _read(spark, at, "document_summaries").select("summary_id", "citations", "prompt_references")
    back = nested_from_json(nested_as_json(s), s.schema)
    return back.select("summary_id", F.size("citations").alias("n_citations"), F.md5(F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["number"], c["source"], c["page_number"], c["chunk_index"], c["excerpt"])), ";")).alias("citations_md5"), F.size("prompt_references").alias("n_prompts"))


def summary_batches(spark: SparkSession, at: str) -> DataFrame:
    """The map prompts of every document of the library, by size and hash."""
    b = map_batches(_library_chunks(spark, at), "document", "chunk_index", "text", BUDGET)
    return b.select("document", "batch_number", "first_number", "last_number", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def summaries_reduced(spark: SparkSession, at: str) -> DataFrame:
    """The summary of every document of the library: batches, their combination, repair and fallback."""
    out, _ = summarize(_library_chunks(spark, at), "document", "chunk_index", "text", BUDGET, outlining, "v1")
    return out.select("document", "n_batches", F.md5("summary").alias("summary_md5"), F.array_join("citation_numbers", ",").alias("citations"), F.array_join("prompt_names", ",").alias("prompts"), "fell_back", F.coalesce("problem", F.lit("")).alias("problem"))


def summaries_resumed(spark: SparkSession, at: str) -> DataFrame:
    """Batches by what a resume does with them, where the even ones are stored and every third of these covers another range."""
    plan = cut(map_batches(_library_chunks(spark, at), "document", "chunk_index", "text", BUDGET))
    stored = plan.filter("batch_number % 2 = 0").select("document", F.lit("v1").alias("identity"), "batch_number", "first_number", (F.col("last_number") + (F.col("first_number") % 3 == 0).cast("int")).alias("last_number"), F.lit("stored").alias("text"), F.array(F.col("first_number").cast("bigint")).alias("citation_numbers"), F.array(F.lit("map")).alias("prompt_names"))
    known = resume(plan, stored, "v1").select("document", "batch_number", F.when(F.col("problem").isNotNull(), "mismatched").when(F.col("text").isNotNull(), "cached").otherwise("asked").alias("what"))
    done, keep = map_step(plan, outlining, "v1", stored)
    counts = known.groupBy("what").agg(F.count("*").alias("n_batches"), F.count_distinct("document").alias("n_documents"))
    made = done.filter(F.col("problem").isNull()).agg(F.lit("usable").alias("what"), F.count("*").alias("n_batches"), F.count_distinct("document").alias("n_documents"))
    return counts.unionByName(made).unionByName(keep.agg(F.lit("to store").alias("what"), F.count("*").alias("n_batches"), F.count_distinct("document").alias("n_documents")))


def summary_first_sentences(spark: SparkSession, at: str) -> DataFrame:
    """The extractive summary of each chunk (its first sentence), as the deterministic provider gives it."""
    return _library_chunks(spark, at).select("chunk_id", F.md5(first_sentences(F.col("text"))).alias("sentence_md5"))


def question_banks_drafted(spark: SparkSession, at: str) -> DataFrame:
    """The questions drafted from every summary, with the source and chunk of the stored citation each stands for."""
    s = _read(spark, at, "document_summaries").select(F.col("summary_id").cast("string").alias("document"), "text", F.array_distinct("citations.number").alias("numbers"), "citations")
    banks = draft_banks(s, drafting, QUESTIONS, BATCH).filter(F.col("problem").isNull())
    q = banks.select("document", F.explode("questions").alias("q")).join(s.select("document", "citations"), "document").select("document", "q.*", trusted(F.col("q.citation_numbers"), F.col("citations"))[0].alias("c"))
    return q.select(F.col("document").cast("bigint").alias("summary_id"), "number", F.col("text").alias("question"), "expected_answer", F.col("c.source").alias("source"), F.col("c.chunk_index").alias("chunk_index"))


def _evaluated(spark: SparkSession, at: str) -> DataFrame:
    a = _attempts(spark, at).select("id", *QUESTION, "question_text", "answer_text", "expected_answer", "answered_at")
    return evaluate_answers(a, "question_text", "expected_answer", "answer_text", marking)


def answers_evaluated(spark: SparkSession, at: str) -> DataFrame:
    """Every attempt as the provider marks it."""
    e = F.col("evaluation")
    return _evaluated(spark, at).select("id", e["verdict"].alias("verdict"), e["score"].alias("score"), e["feedback"].alias("feedback"), F.array_join(e["missing_concepts"], ",").alias("missing"), "rating", F.coalesce("problem", F.lit("")).alias("problem"))


def answers_recorded(spark: SparkSession, at: str) -> DataFrame:
    """The review state of every question after all evaluated answers are recorded, a third of which were stored before."""
    a = cut(_evaluated(spark, at).select("id", *QUESTION, "rating", "answered_at").filter(F.col("rating").isNotNull()))
    _, state, _ = record_answers(a.filter(F.col("id") < "5"), a, QUESTION)
    return state.select(*QUESTION, "repetition_count", "interval_days", F.round("ease_factor", 6).alias("ease_factor"), F.coalesce(F.unix_micros("due_at").cast("string"), F.lit("beyond")).alias("due_us"))


def answers_parsed(spark: SparkSession, at: str) -> DataFrame:
    """JSON of every question draft, some with a key more, a decimal, a truth value or no number, read strictly."""
    q = _read(spark, at, "question_banks").select("document_id", "identity_fingerprint", F.explode("questions").alias("q")).distinct()
    n = F.col("q.number")
    numbers = F.when(n % 5 == 1, F.lit("[1.0]")).when(n % 5 == 2, F.lit("[true]")).when(n % 5 == 3, F.lit("[]")).otherwise(F.to_json("q.citations.number"))
    text = F.concat(F.lit('{"text":'), F.concat(F.lit('"'), F.md5("q.text"), F.lit('"')), F.lit(',"citation_numbers":'), numbers, F.when(n % 7 == 0, ',"more":1}').otherwise("}"))
    got = strict_object(text, text="string", citation_numbers="array<bigint>")
    return q.select("document_id", "identity_fingerprint", n.alias("number"), got["text"].alias("text_md5"), F.coalesce(F.size(got["citation_numbers"]), F.lit(-1)).alias("n_citations"))


QUERIES = {
    f.__name__: f
    for f in (grounded_answer, grounded_answers, citations_as_json, summary_batches, summaries_reduced, summaries_resumed, summary_first_sentences, question_banks_drafted, answers_evaluated, answers_recorded, answers_parsed)
}

_BATCHED = f"""{_LIBRARY},
      o as (select document, row_number() over (partition by document order by chunk_index) as i, length(text) as l, text from lib),
      f as (select document, i, 1 as b, l::bigint as held from o where i = 1
        union all select o.document, o.i, case when f.held + o.l > {BUDGET} then f.b + 1 else f.b end, case when f.held + o.l > {BUDGET} then o.l else f.held + o.l end from f join o on o.document = f.document and o.i = f.i + 1),
      p as (select f.document, f.b, min(f.i) as a, max(f.i) as z, string_agg('[' || f.i || '] ' || o.text, chr(10) || chr(10) order by f.i) as t from f join o on o.document = f.document and o.i = f.i group by 1, 2)"""
_MARK = "case when {a} = {e} then 'correct' when 2 * length({a}) >= length({e}) then 'partially_correct' else 'incorrect' end".format(a="answer_text", e="coalesce(expected_answer, '')")
_BLANK = f"regexp_replace(coalesce(answer_text, ''), '[{_WS}]+', '', 'g') = ''"
_EVALUATED = f"""a as (select * replace (case {_MARK} when 'correct' then 'good' when 'partially_correct' then 'hard' else 'again' end as rating) from
  (select * from study_attempts qualify row_number() over (partition by id order by received_at desc) = 1) where not ({_BLANK}))"""
ORACLES = {
    "grounded_answer": _TOP.format(where="") + "select query_id, max(score) as best_score, string_agg('[' || rank || '] label ' || label, '; ' order by rank) as contexts, string_agg(vec_id::varchar, ',' order by rank) as cited_ids from t group by 1",
    "grounded_answers": _TOP.format(where="").rstrip() + f""", a as (select query_id, string_agg('[' || rank || '] label ' || label, chr(10) || chr(10) order by rank) || chr(10) || chr(10) || 'Question: what is ' || query_id as p, min_by(vec_id, rank) as first from t group by query_id)
      select query_id, left(p, {OUTLINE}) as answer, true as is_valid, first::varchar as cited_ids, 'answer' as prompts from a""",
    "citations_as_json": """select summary_id, len(citations)::int as n_citations, md5(array_to_string(list_transform(citations, lambda c: concat_ws('|', c.number, c.source, c.page_number, c.chunk_index, c.excerpt)), ';')) as citations_md5, len(prompt_references)::int as n_prompts from document_summaries""",
    "summary_batches": f"with recursive {_BATCHED} select document, b as batch_number, a::int as first_number, z::int as last_number, length(t) as n_chars, md5(t) as prompt_md5 from p",
    "summaries_reduced": f"""with recursive {_BATCHED},
      s as (select document, count(*) as n_batches, string_agg(left(t, {OUTLINE}), chr(10) || chr(10) order by b) as texts, string_agg(a::varchar, ',' order by b) as citations, bool_or(a % 7 = 3) as odd from p group by 1)
      select document, n_batches, md5(case when n_batches = 1 or n_batches % 2 = 1 then texts else n_batches || ' sections' end) as summary_md5, citations,
        'map' || case when odd then ',format_repair' else '' end || case when n_batches > 1 then ',reduce,reduce_repair' else '' end as prompts, n_batches > 1 and n_batches % 2 = 1 as fell_back, '' as problem from s""",
    "summaries_resumed": f"""with recursive {_BATCHED}, w as (select document, case when b % 2 = 0 and a % 3 = 0 then 'mismatched' when b % 2 = 0 then 'cached' else 'asked' end as what from p)
      select what, count(*) as n_batches, count(distinct document) as n_documents from w group by 1
      union all select 'usable', count(*), count(distinct document) from w where what <> 'mismatched' union all select 'to store', count(*), count(distinct document) from w where what = 'asked'""",
    "summary_first_sentences": f"with {_LIBRARY} select chunk_id, md5(coalesce(regexp_extract(text, '(?s)[^.!?]+(?:[.!?]+|$)', 0), '')) as sentence_md5 from lib",
    "question_banks_drafted": f"""with s as (select summary_id, citations, list_transform(citations, lambda c: c.number) as all_n from document_summaries where text <> '' and len(citations) > 0),
      d as (select summary_id, citations, list_filter(all_n, lambda x, i: list_position(all_n, x) = i) as n from s),
      j as (select summary_id, citations, n, unnest(range(1, {QUESTIONS} + 1)) as j from d), k as (select *, n[((j - 1) % len(n)) + 1] as c from j)
      select summary_id, j::int as number,
        case when j <= len(n) then 'What is said in [' || c || ']?' when len(n) = 1 and j < 4 then 'What more is said in [' || c || ']? (' || (2 * j - 2) || ')' else 'What else is said in [' || c || ']? (' || j || ')' end as question, 'See [' || c || '].' as expected_answer,
        list_filter(citations, lambda x: x.number = c)[1].source as source, list_filter(citations, lambda x: x.number = c)[1].chunk_index as chunk_index from k""",
    "answers_evaluated": f"""with {_ATT}, e as (select id, {_BLANK} as blank, {_MARK} as v, length(answer_text) as n from a)
      select id, case when not blank then v end as verdict, case when not blank then case v when 'correct' then 1.0 when 'partially_correct' then 0.5 else 0.0 end end::double as score, case when not blank then n || ' characters' end as feedback,
        case when not blank then case v when 'correct' then '' when 'partially_correct' then 'details' else 'everything' end end as missing, case when not blank then case v when 'correct' then 'good' when 'partially_correct' then 'hard' else 'again' end end as rating, case when blank then 'the answer is blank' else '' end as problem from e""",
    "answers_recorded": f"{_FOLD.replace(_ATT, _EVALUATED)} select {_Q}, r::int as repetition_count, i::int as interval_days, round(e, 6) as ease_factor, coalesce(due_us::varchar, 'beyond') as due_us from f qualify row_number() over (partition by {_Q} order by n desc) = 1",
    "answers_parsed": """with q as (select distinct document_id, identity_fingerprint, unnest(questions) as q from question_banks)
      select document_id, identity_fingerprint, q.number as number, case when q.number % 5 not in (1, 2) and q.number % 7 <> 0 then md5(q.text) end as text_md5,
        case when q.number % 5 in (1, 2) or q.number % 7 = 0 then -1 when q.number % 5 = 3 then 0 else len(q.citations) end::int as n_citations from q""",
}
