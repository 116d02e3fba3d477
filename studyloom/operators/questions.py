"""Question banks: drafts by a provider in batches that know the questions before them, without repetitions, with trusted citations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.operators.generation import Provider

_QUESTION = pa.struct([("number", pa.int32()), ("text", pa.string()), ("expected_answer", pa.string()), ("citation_numbers", pa.list_(pa.int64()))])
_BATCH = pa.struct([("batch_number", pa.int32()), ("first_number", pa.int32()), ("last_number", pa.int32()), ("questions", pa.list_(_QUESTION))])
_Q = "array<struct<number: int, text: string, expected_answer: string, citation_numbers: array<bigint>>>"
_B = f"array<struct<batch_number: int, first_number: int, last_number: int, questions: {_Q}>>"


class Rejected(ValueError):
    """What a provider gave is no usable set of drafts."""


def drafts_of(raw: str) -> list[dict]:
    """The drafts of a raw answer {"questions": [{"text", "expected_answer", "citation_numbers"}, ...]} of exactly this shape:
    texts and answers stripped and not blank, citation numbers positive integers, each once and at least one, texts all different."""
    try:
        payload = json.loads(raw)
    except (TypeError, ValueError) as e:
        raise Rejected("no JSON") from e
    if not isinstance(payload, dict) or set(payload) != {"questions"} or not isinstance(payload["questions"], list) or not payload["questions"]:
        raise Rejected("no list of questions")
    out = []
    for item in payload["questions"]:
        if not isinstance(item, dict) or set(item) != {"text", "expected_answer", "citation_numbers"}:
            raise Rejected("a question has other keys")
        text, answer, numbers = item["text"], item["expected_answer"], item["citation_numbers"]
        if not isinstance(text, str) or not isinstance(answer, str) or not text.strip() or not answer.strip():
            raise Rejected("a question or its answer is blank")
        if not isinstance(numbers, list) or not numbers or any(type(n) is not int or n < 1 for n in numbers) or len(set(numbers)) != len(numbers):
            raise Rejected("citation numbers must be positive integers, each once")
        out.append({"text": text.strip(), "expected_answer": answer.strip(), "citation_numbers": numbers})
    if len({d["text"].casefold() for d in out}) != len(out):
        raise Rejected("questions repeat within one answer")
    return out


def _ask(provider: Provider, prompt: str, wanted: int, available: set[int], used: list[str], name: str) -> list[dict]:
    """`wanted` drafts for a prompt; one more try, with a note on the shape, where the answer isn't a set of drafts."""
    used.append(name)
    try:
        drafts = drafts_of(provider(prompt))
    except Rejected:
        used.append("format_repair")
        drafts = drafts_of(provider(prompt + '\n\nAnswer with {"questions": [{"text": ..., "expected_answer": ..., "citation_numbers": [...]}]} only'))
    if len(drafts) != wanted:
        raise Rejected(f"{len(drafts)} questions instead of {wanted}")
    for d in drafts:
        if not available.issuperset(d["citation_numbers"]):
            raise Rejected("a citation is not available in the summary")
    return drafts


def build_bank(provider: Provider, text: str, available: list[int], count: int, batch: int, stored: dict[int, dict], used: list[str]) -> tuple[list[dict], list[dict]]:
    """All questions of a bank and the new batches. Stored batches are taken as they are if they cover what the plan says."""
    questions: list[dict] = []
    fresh = []
    key = lambda t: t.strip().casefold()
    listed = lambda texts: "".join(f"\n- {t}" for t in texts)
    for n, first in enumerate(range(1, count + 1, batch), 1):
        last = min(first + batch - 1, count)
        if n in stored:
            if (stored[n]["first_number"], stored[n]["last_number"]) != (first, last):
                raise Rejected("the stored batch does not match the plan")
            questions += stored[n]["questions"]
            continue
        seen = {key(q["text"]) for q in questions}
        head = f"Write {last - first + 1} questions.\n\nCitations: {', '.join(map(str, available))}\n\n{text}\n\nAsked before:{listed(q['text'] for q in questions)}"
        accepted, rejected = [], []
        for d in _ask(provider, head, last - first + 1, set(available), used, "questions"):
            (rejected if key(d["text"]) in seen else accepted).append(d)
            seen.add(key(d["text"]))
        if rejected:  # a repetition costs only the missing questions, not the batch
            before = [q["text"] for q in (*questions, *accepted)]
            more = f"Write {len(rejected)} other questions.\n\nCitations: {', '.join(map(str, available))}\n\n{text}\n\nAsked before:{listed(before)}\n\nRejected:{listed(d['text'] for d in rejected)}"
            for d in _ask(provider, more, len(rejected), set(available), used, "questions_repair"):
                if key(d["text"]) in seen:
                    raise Rejected("questions repeat")
                seen.add(key(d["text"]))
                accepted.append(d)
        numbered = [{"number": first + k, **d} for k, d in enumerate(accepted)]
        fresh.append({"batch_number": n, "first_number": first, "last_number": last, "questions": numbered})
        questions += numbered
    return questions, fresh


def draft_banks(summaries: DataFrame, make_provider: Callable[[], Provider], count: int, batch: int = 2, stored: DataFrame | None = None, force: bool = False) -> DataFrame:
    """summaries: document, text, numbers (the citation numbers of the summary). Result: document, questions (in order, numbered
    from 1), new_batches (to be stored for a later resume; none if forced), prompt_names (those used, each once), problem.

    A bank is written batch by batch, as every prompt lists the questions before; banks are independent rows, so the work is spread
    over them. stored: document, batch_number, first_number, last_number, questions. Null text or numbers, or no numbers: a problem."""
    base = summaries.select(F.col("document").cast("string").alias("document"), "text", F.transform("numbers", lambda n: n.cast("bigint")).alias("numbers"))
    if stored is None or force:
        base = base.withColumn("batches", F.array().cast(_B))
    else:
        own = stored.groupBy("document").agg(F.collect_list(F.struct("batch_number", "first_number", "last_number", "questions")).cast(_B).alias("batches"))  # at most count / batch of a document
        base = base.join(own, "document", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make_provider()
        for rows in batches:
            out = []
            for r in rows.to_pylist():
                used: list[str] = []
                try:
                    if not r["text"] or not r["numbers"]:
                        raise Rejected("the summary has no text or no citations")
                    done, fresh = build_bank(provider, r["text"], r["numbers"], count, batch, {b["batch_number"]: b for b in r["batches"] or ()}, used)
                    out.append((r["document"], done, [] if force else fresh, list(dict.fromkeys(used)), None))
                except Exception as e:  # noqa: BLE001 - one bank's failure is its own
                    out.append((r["document"], None, [], list(dict.fromkeys(used)), str(e) if isinstance(e, Rejected) else f"{type(e).__name__}: {e}"))
            types = [pa.string(), pa.list_(_QUESTION), pa.list_(_BATCH), pa.list_(pa.string()), pa.string()]
            cols = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["document", "questions", "new_batches", "prompt_names", "problem"])

    return base.mapInArrow(run, f"document string, questions {_Q}, new_batches {_B}, prompt_names array<string>, problem string")


def trusted(numbers: Column, citations: Column) -> Column:
    """The stored citations (structs with number) of these numbers in their order; null if one isn't stored."""
    found = F.transform(numbers, lambda n: F.get(F.filter(citations, lambda c: c["number"] == n), F.lit(0)))
    return F.when(F.forall(found, lambda c: c.isNotNull()), found)
