"""Queries that list and check what is stored: packages and their questions, banks, rules that rows must keep, batches of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.functions.text import casefold, strip, uuid_key
from studyloom.operators.progress import rate
from studyloom.operators.review import due
from studyloom.queries.learning import _AS_OF, _BQ, _DOC, _FOLDED, _PROG, BANK, QUESTION, _actual, _as_of, _attempts, _bank_questions, _expected, _progress, _read



def _rules() -> dict[str, dict[str, Column]]:
    verdict, concepts, score = F.col("evaluation.verdict"), F.col("evaluation.missing_concepts"), F.col("evaluation.score")
    numbers = F.col("questions.number")
    return {
        "document_summaries": {"cites something": F.size("citations") == 0, "citation numbers are unique": F.size(F.array_distinct("citations.number")) < F.size("citations"), "has text": F.coalesce(strip("text"), F.lit("")) == ""},
        "question_banks": {
            "numbers are consecutive from 1": numbers != F.sequence(F.lit(1), F.size("questions")),
            "question texts are unique": F.size(F.array_distinct(F.transform("questions", lambda q: casefold(strip(q["text"]))))) < F.size("questions"),
            "citations are of the bank's source": F.exists("questions", lambda q: F.exists(q["citations"], lambda c: c["source"] != F.col("source"))),
            "every question cites something": F.exists("questions", lambda q: F.size(q["citations"]) == 0),
        },
        "question_progress": {"ease is 1.3 or more": F.col("ease_factor") < 1.3, "counts aren't negative": (F.col("repetition_count") < 0) | (F.col("interval_days") < 0), "due is not before the last review": F.col("due_at") < F.col("last_reviewed_at")},
        "study_attempts": {
            "score is between 0 and 1": ~score.between(0.0, 1.0), "only correct answers miss no concept": (verdict == "correct") != (F.size(concepts) == 0), "state is of the attempt's question": (F.col("resulting_progress.document_id") != F.col("document_id")) | (F.col("resulting_progress.question_number") != F.col("question_number")),
            "state was last reviewed at the attempt": F.col("resulting_progress.last_reviewed_at") != F.col("answered_at"),
        },
        "learning_packages": {
            "status fits its identities": F.when(F.col("status") == "indexed", F.coalesce("summary_identity_fingerprint", "question_bank_identity_fingerprint").isNotNull())
            .when(F.col("status") == "summarized", F.col("summary_identity_fingerprint").isNull() | F.col("question_bank_identity_fingerprint").isNotNull())
            .when(F.col("status") == "ready", F.col("summary_identity_fingerprint").isNull() | F.col("question_bank_identity_fingerprint").isNull()).otherwise(True),
        },
    }


def rule_violations(rows: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """table_name, rule, n_rows, n_violations: one pass over rows, a null condition is no violation."""
    counts = rows.agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())))
    each = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("n_violations")) for i, rule in enumerate(rules)))
    return counts.select(F.lit(table).alias("table_name"), "n", F.explode(each).alias("x")).select("table_name", "x.rule", F.col("n").alias("n_rows"), "x.n_violations")


def constraint_violations(spark: SparkSession, at: str) -> DataFrame:
    out = None
    for table, rules in _rules().items():
        found = rule_violations(_read(spark, at, table), table, rules)
        out = found if out is None else out.unionByName(found)
    return out


def _packages(spark: SparkSession, at: str) -> DataFrame:
    return _read(spark, at, "learning_packages").select("id", "status", uuid_key("document_id").alias("document"), F.col("question_bank_identity_fingerprint").alias("identity")).distinct()


def package_questions(spark: SparkSession, at: str) -> DataFrame:
    """Every package with the questions of its bank, or why it cannot be studied."""
    sizes = _read(spark, at, "question_banks").select(uuid_key("document_id").alias("document"), F.col("identity_fingerprint").alias("identity"), F.size("questions").alias("n")).groupBy("document", "identity").agg(F.max("n").alias("n_questions"))
    problem = F.when(F.col("status") != "ready", "not ready").when(F.col("identity").isNull(), "no bank named").when(F.col("n_questions").isNull(), "bank missing").otherwise("")
    return _packages(spark, at).join(sizes, ["document", "identity"], "left").select("id", "status", F.coalesce("n_questions", F.lit(0)).alias("n_questions"), problem.alias("problem"))


def package_next_due(spark: SparkSession, at: str) -> DataFrame:
    """Of every package that can be studied the question that is due first: by due time, then new ones by number."""
    asked = due(_bank_questions(spark, at), _progress(spark, at), QUESTION, _as_of())
    first = asked.groupBy(uuid_key("document_id").alias("document"), F.col(BANK[1]).alias("identity")).agg(F.min(F.struct(F.col("due_at").isNull().alias("is_new"), "due_at", "question_number")).alias("f"))
    ready = _packages(spark, at).filter("status = 'ready'")
    return ready.join(first, ["document", "identity"]).select("id", F.col("f.question_number").alias("question_number"), F.col("f.is_new").alias("is_new"), F.date_format("f.due_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("due"))


def bank_listing(spark: SparkSession, at: str) -> DataFrame:
    """The banks of every document by identity, with their questions and citations."""
    b = _read(spark, at, "question_banks").select(uuid_key("document_id").alias("document"), "identity_fingerprint", F.size("questions").alias("n_questions"), F.aggregate("questions", F.lit(0), lambda a, q: a + F.size(q["citations"])).alias("n_citations"))
    one = b.groupBy("document", "identity_fingerprint").agg(F.max("n_questions").alias("n_questions"), F.max("n_citations").alias("n_citations"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("document").orderBy("identity_fingerprint")))


def citations_unexpected(spark: SparkSession, at: str) -> DataFrame:
    """Of every document with expected citations those of its questions that weren't expected, by source and page."""
    e = _expected(spark, at).distinct()
    a = _actual(spark, at).distinct().join(e.select("document").distinct(), "document", "left_semi")
    place = F.row_number().over(Window.partitionBy("document").orderBy("source", "page_number"))
    return a.join(e, ["document", "source", "page_number"], "left_anti").withColumn("place", place)


def concept_recall(spark: SparkSession, at: str) -> DataFrame:
    """Of every attempt the share of its missing concepts that its expected answer names; 1 where none is missing."""
    named = F.filter("evaluation.missing_concepts", lambda c: F.contains(casefold("expected_answer"), casefold(c)))
    all_ = F.coalesce(F.size("evaluation.missing_concepts"), F.lit(0))
    n = F.when(F.col("evaluation").isNull() | F.col("expected_answer").isNull(), 0).otherwise(F.size(named))
    return _attempts(spark, at).select("id", all_.alias("n_concepts"), n.alias("n_named"), F.when(all_ == 0, 1.0).otherwise(rate(n, all_)).alias("recall"))


def vector_batches(spark: SparkSession, at: str) -> DataFrame:
    """Every label's vectors as one batch to be appended, the second of two with a zero vector among them: taken whole or not at all."""
    v = _read(spark, at, "embeddings").select("label", F.when((F.col("vec_id") % 1000 == 7) & (F.col("label") % 2 == 1), F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("vec"))
    bad = F.count_if(F.col("vec").isNull() | ~F.exists("vec", lambda x: x != 0))
    g = v.groupBy("label").agg(F.count("*").alias("n_vectors"), bad.alias("n_bad"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"))
    return g.select("label", "n_vectors", "n_bad", F.when((F.col("n_bad") == 0) & (F.col("low") == F.col("high")), F.col("n_vectors")).otherwise(0).alias("n_appended"))


QUERIES = {f.__name__: f for f in (constraint_violations, package_questions, package_next_due, bank_listing, citations_unexpected, concept_recall, vector_batches)}

_PK = f"pk as (select distinct id, status, {_DOC} as document, question_bank_identity_fingerprint as identity from learning_packages)"
_RULES = {
    "document_summaries": {"cites something": "len(citations) = 0", "citation numbers are unique": "len(list_distinct(list_transform(citations, lambda c: c.number))) < len(citations)", "has text": "trim(coalesce(text, '')) = ''"},
    "question_banks": {
        "numbers are consecutive from 1": "list_transform(questions, lambda q: q.number) <> range(1, len(questions) + 1)",
        "question texts are unique": f"len(list_distinct(list_transform(questions, lambda q: {_FOLDED.format(c='trim(q.text)')}))) < len(questions)",
        "citations are of the bank's source": "len(list_filter(flatten(list_transform(questions, lambda q: list_transform(q.citations, lambda c: c.source))), lambda x: x <> source)) > 0",
        "every question cites something": "len(list_filter(questions, lambda q: len(q.citations) = 0)) > 0",
    },
    "question_progress": {"ease is 1.3 or more": "ease_factor < 1.3", "counts aren't negative": "repetition_count < 0 or interval_days < 0", "due is not before the last review": "due_at < last_reviewed_at"},
    "study_attempts": {
        "score is between 0 and 1": "not (evaluation.score between 0 and 1)", "only correct answers miss no concept": "(evaluation.verdict = 'correct') <> (len(evaluation.missing_concepts) = 0)",
        "state is of the attempt's question": "resulting_progress.document_id <> document_id or resulting_progress.question_number <> question_number", "state was last reviewed at the attempt": "resulting_progress.last_reviewed_at <> answered_at",
    },
    "learning_packages": {
        "status fits its identities": "case status when 'indexed' then coalesce(summary_identity_fingerprint, question_bank_identity_fingerprint) is not null when 'summarized' then summary_identity_fingerprint is null or question_bank_identity_fingerprint is not null when 'ready' then summary_identity_fingerprint is null or question_bank_identity_fingerprint is null else true end",
    },
}
ORACLES = {
    "constraint_violations": " union all ".join(
        f"select '{t}' as table_name, '{r.replace(chr(39), chr(39) * 2)}' as rule, count(*) as n_rows, count(*) filter ({c}) as n_violations from {t}" for t, rules in _RULES.items() for r, c in rules.items()
    ),
    "package_questions": f"""with {_PK}, b as (select {_DOC} as document, identity_fingerprint as identity, max(len(questions)) as n from question_banks group by 1, 2)
      select id, status, coalesce(n, 0)::int as n_questions, case when status <> 'ready' then 'not ready' when identity is null then 'no bank named' when n is null then 'bank missing' else '' end as problem from pk left join b using (document, identity)""",
    "package_next_due": f"""with {_PK}, {_PROG}, {_BQ}, d as (select {_DOC} as document, question_bank_identity_fingerprint as identity, question_number, p.due_at from bq left join p using (document_id, question_bank_identity_fingerprint, question_number) where p.due_at is null or p.due_at <= {_AS_OF}),
      f as (select * from d qualify row_number() over (partition by document, identity order by due_at is null, due_at, question_number) = 1)
      select id, question_number, due_at is null as is_new, strftime(due_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S.%f') as due from pk join f using (document, identity) where status = 'ready'""",
    "bank_listing": f"""with b as (select {_DOC} as document, identity_fingerprint, max(len(questions)) as n_questions, max(list_sum(list_transform(questions, lambda q: len(q.citations)))) as n_citations from question_banks group by 1, 2)
      select document, identity_fingerprint, n_questions::int as n_questions, coalesce(n_citations, 0)::int as n_citations, (row_number() over (partition by document order by identity_fingerprint))::int as place from b""",
    "citations_unexpected": f"""with e as (select distinct document, c.source as source, c.page_number as page_number from (select {_DOC} as document, unnest(citations) as c from document_summaries)),
      a as (select distinct document, c.source as source, c.page_number as page_number from (select document, unnest(q.citations) as c from (select {_DOC} as document, unnest(questions) as q from question_banks))),
      u as (select * from a where document in (select document from e) except select * from e)
      select document, source, page_number, (row_number() over (partition by document order by source, page_number))::int as place from u""",
    "concept_recall": f"""with a as (select * from study_attempts qualify row_number() over (partition by id order by received_at desc) = 1),
      n as (select id, coalesce(len(evaluation.missing_concepts), 0)::int as n_concepts, coalesce(len(list_filter(evaluation.missing_concepts, lambda c: contains({_FOLDED.format(c='expected_answer')}, {_FOLDED.format(c='c')}))), 0)::int as n_named from a)
      select *, case when n_concepts = 0 then 1.0 else n_named / n_concepts end as recall from n""",
    "vector_batches": """with g as (select label, count(*) as n_vectors, count(*) filter (vec_id % 1000 = 7 and label % 2 = 1) as n_bad from embeddings group by 1)
      select label, n_vectors, n_bad, case when n_bad = 0 then n_vectors else 0 end as n_appended from g""",
}
