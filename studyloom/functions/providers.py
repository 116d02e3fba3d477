"""Deterministic providers without a model, for tests and for the registered queries: what they say follows from the prompt alone."""

from __future__ import annotations

import json
import re

from studyloom.operators.generation import Provider

_SECTION = re.compile(r"^Section \d+ \[([\d, ]+)\]: ", re.MULTILINE)
_FIRST = re.compile(r"\[(\d+)\] ")
#: Characters that an outline takes of a batch.
OUTLINE = 60


def outlining() -> Provider:
    """Summaries: the first characters of a batch with its first number; of sections how many there are, with the number of the
    first only, or of all when asked again about an even number of them. Every seventh batch gets another shape at first."""

    def outline(prompt: str) -> str:
        if sections := _SECTION.findall(prompt):
            firsts = list(dict.fromkeys(int(s.split(",")[0]) for s in sections))
            whole = prompt.startswith("Combine these sections again") and len(sections) % 2 == 0
            return json.dumps({"text": f"{len(sections)} sections", "citation_numbers": firsts if whole else firsts[:1]})
        number = int(_FIRST.match(prompt).group(1))
        out = {"text": prompt.split("\n\nAnswer with one JSON object")[0][:OUTLINE], "citation_numbers": [number]}
        return json.dumps(out if number % 7 != 3 or "\n\nAnswer with one JSON object" in prompt else out | {"note": ""})

    return outline


def drafting() -> Provider:
    """Questions: one for each available citation in turn, so that they repeat when the citations are used up; other ones when
    asked for those."""

    def draft(prompt: str) -> str:
        head, wanted = re.match(r"Write (\d+) (other )?questions\.\n\nCitations: ([\d, ]+)\n", prompt), prompt.split("\n\nRejected:")[0]
        available = [int(n) for n in head.group(3).split(",")]
        before = wanted.rsplit("Asked before:", 1)[1].count("\n- ")
        out = []
        for k in range(int(head.group(1))):
            c = available[(before + k) % len(available)]
            text = f"What else is said in [{c}]? ({before + k + 1})" if head.group(2) else f"What is said in [{c}]?"
            out.append({"text": text, "expected_answer": f"See [{c}].", "citation_numbers": [c]})
        for k, q in enumerate(out):  # one answer must not repeat itself
            if q["text"] in [x["text"] for x in out[:k]]:
                q["text"] = f"What more is said in {q['citation_numbers']}? ({before + k + 1})"
        return json.dumps({"questions": out})

    return draft


def marking() -> Provider:
    """Evaluations: correct if the answer is the expected one, partly correct if it is at least half as long, else incorrect."""

    def mark(prompt: str) -> str:
        rest, answer = prompt.split("\n\nAnswer with one JSON object")[0].rsplit("\n\nAnswer: ", 1)
        expected = rest.rsplit("\n\nExpected: ", 1)[1]
        if answer == expected:
            out = ("correct", 1.0, [])
        elif 2 * len(answer) >= len(expected):
            out = ("partially_correct", 0.5, ["details"])
        else:
            out = ("incorrect", 0, ["everything"])
        return json.dumps({"verdict": out[0], "score": out[1], "feedback": f"{len(answer)} characters", "missing_concepts": out[2]})

    return mark
