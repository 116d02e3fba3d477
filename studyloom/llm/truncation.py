"""Problem 4: text cut off by field limits.

Per source the lengths are fitted by a right-censored log-normal distribution; the excess of values at a candidate limit over
the fit is their posterior of having been censored there. It is combined with the evidence of the ending: how often text like
that ends or goes on, and whether the last word is a whole one, both counted over all values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.lookalikes import skeleton
from studyloom.llm.wordlists import FRAME
from studyloom.plans.lineage import broadcast_if_small, cut, spread

#: A context must have been passed so often to be trusted; shorter ones step in.
TRUSTED = 8
#: Share of contexts with ways of ending of their own: inside a text, for a single phrase or a list item, on a closed-class word.
OWN, OWN_ALONE, OWN_FRAME = 0.001, 0.3, 1e-7
#: Items that a phrase has at most, the last of them a word that is not closed-class.
PHRASE = 5
#: How many words' worth of evidence the average stands for in a word's rate of ending sentences.
AVERAGE = 2.0

_ITEM = re.compile(r"https?://\S+|[^\W\d_]+(?:-[^\W\d_]+)*'?|\d+|[^\w\s]")
_MARK = re.compile(r"(?:\s*\[\s*(?:\.{2,}|…)\s*\]|\s*(?:\.{2,}|…))\s*$")
_LAST_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*$")
# Phrases that end a list on purpose, as far as they stand before a mark of omission or at the end.
_AND_SO_ON = ("and so on", "and so forth", "et cetera", "etc", "und so weiter", "usw", "et ainsi de suite", "y así sucesivamente", "y demás", "и так далее", "и тому подобное")
_AND_SO_ON = tuple(f" {skeleton(x)}" for x in _AND_SO_ON)
_FRAME = frozenset(map(skeleton, FRAME))
_CLOSING = "\"'”’»“„«)]}*_ \n"
_STOPS, _ENDS = ".!?", ".!?;"


#: What stands for every closed-class word, with an apostrophe or without.
_CLOSED = {form: w for w in _FRAME if w[0].isalpha() for form in (w, f"{w}'")}


def items(text: str) -> tuple[list[str], list[str], list[int], list[str]]:
    """The frame of text: closed-class words, '#', 'URL', punctuation and 'X' for a run of other words; its words; the characters
    of each item with the blank before it; and the words that stand before the end of a sentence or list item."""
    out, seen, width, closing = [], [], [], []
    is_word = False
    for tok in _ITEM.findall(text.replace("’", "'") if "’" in text else text):
        shown = _CLOSED.get(tok)
        if shown is None:
            first = tok[0]
            if not first.isalpha():
                if first.isnumeric():
                    out.append("#")
                    width.append(len(tok) + 1)
                else:
                    if is_word and tok in _ENDS:
                        closing.append(seen[-1])
                    out.append(tok)
                    width.append(1)
                is_word = False
                continue
            if first == "h" and tok.startswith(("http://", "https://")):
                is_word = False
                out.append("URL")
                width.append(len(tok) + 1)
                continue
            shown = "X"
        is_word = True
        seen.append(tok)
        if shown == "X" and out and out[-1] == "X":
            width[-1] += len(tok) + 1
            continue
        out.append(shown)
        width.append(len(tok) + 1)
    return out, seen, width, closing


def contexts(frame: list[str], start: int, end: int) -> list[int]:
    """Hashes of what leads up to item end: the whole sentence from start, the last four, two and one items."""
    where = "V" if start == 0 else "L" if frame[start - 1] == ";" else "S"
    whole = frame[start:end]
    tails = [whole[-n:] if len(whole) >= n else [where, *whole] for n in (4, 2, 1)]
    return [xxhash.xxh64_intdigest(f"{k} {' '.join(x)}") - (1 << 63) for k, x in enumerate([[where, *whole], *tails])]


def _without_mark(body: str) -> str:
    """A text that ends with no blank, without a mark of omission at its end."""
    return _MARK.sub("", body) if body.endswith(("..", "…", "]")) else body


def ending(text: str) -> tuple[str, bool, bool]:
    """A folded text without a mark of omission at its end, whether it had one, and whether it ends with a full stop."""
    body = text.rstrip()
    bare = _without_mark(body)
    marked = bare != body
    core = bare.rstrip(_CLOSING)
    stopped = bool(core) and core[-1] in _STOPS
    return bare, marked, stopped or f" {core}".endswith(_AND_SO_ON)


def _sentences(frame: list[str]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, stopped) of each sentence or list item; end excludes the stop or semicolon."""
    start = 0
    for i, x in enumerate(frame):
        if x in _ENDS:
            if i > start:
                yield start, i, True
            start = i + 1
    if start < len(frame) and any(x.isalnum() for x in frame[start:]):
        yield start, len(frame), False


def _way(frame: list[str], start: int, end: int) -> int:
    """1 for a value that is one short phrase, -1 for an end on a closed-class word, else 0."""
    if not frame or frame[-1] not in _FRAME:
        return int(start == 0 and end <= PHRASE and frame[-1:] == ["X"])
    return -1


def _partial_word(text: str) -> str:
    if not text[-1:].isalpha():
        return ""
    m = _LAST_WORD.search(text.rsplit(None, 1)[-1])
    return m.group() if m else ""


_FOLDED = "row bigint, n_chars int, bare_chars int, blank_end boolean, folded string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every value with its lengths as stored and its folded text, which is the same for all values that look the same."""
    for batch in batches:
        raw = batch.column(1).to_pylist()
        lengths = [len(x) for x in raw], [len(_without_mark(x.rstrip())) for x in raw]
        cols = [batch.column(0), *(pa.array(x, pa.int32()) for x in lengths), pa.array([x[-1:].isspace() for x in raw]), pa.array([skeleton(x.lower()) for x in raw], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _FOLDED.split(", ")])


_SCAN = "kind string, row bigint, items boolean, marked boolean, open boolean, word string, ctx array<bigint>, level bigint, passed bigint, chars bigint, stopped bigint, opened bigint"
_SCAN_TYPES = [pa.string(), pa.int64(), *[pa.bool_()] * 3, pa.string(), pa.list_(pa.int64()), *[pa.int64()] * 5]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the distinct folded texts: 'tail' rows with the ending of each, 'ctx' rows counting what is passed and how it ends,
    'word' rows counting the words that aren't last and how many of them end a sentence. Sentences of one frame are counted together before they are taken apart."""
    for batch in batches:
        rows, words, closing, frames = [], Counter(), Counter(), {}
        for row, folded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bare, marked, done = ending(folded)
            frame, seen, width, ends = items(bare)
            words.update(seen if ends and ends[-1] is seen[-1] else seen[:-1])
            closing.update(ends)
            start, end = 0, len(frame)
            for start, end, stop in _sentences(frame):
                key = ("" if start == 0 else ";" if frame[start - 1] == ";" else ".", stop or done, *frame[start:end])
                if key in frames:
                    have = frames[key]
                    have[0] += 1
                    for k in range(start, end):
                        have[1 + k - start] += width[k]
                else:
                    frames[key] = [1, *width[start:end]]
            tail = ("", []) if done else (_partial_word(bare), contexts(frame, start, end))
            way = _way(frame, start, end)
            item = int(way == 1 or start > 0 and frame[start - 1] == ";")
            way = way or item
            rows.append(("tail", row, any(map(str.isalnum, bare)), marked, not done, *tail, way, item, None, None, None))
        counts: dict[int, list[int]] = {}
        for (first, stop, *frame), (n, *width) in frames.items():
            pad = 1 if first else 0
            for i in range(1, len(frame) + 1):
                for level, c in enumerate(contexts([first] * pad + frame, pad, pad + i)):
                    have = counts.setdefault(c, [level, 0, 0, 0, 0])
                    have[1] += n
                    have[2] += width[i - 1]
                    if i == len(frame):
                        have[3 if stop else 4] += n
        rows += [("ctx", None, None, None, None, None, [c], *v) for c, v in counts.items()]
        rows += [("word", None, None, None, None, w, None, None, n, None, closing[w], None) for w, n in words.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 12, _SCAN_TYPES, strict=True)], names=[x.split()[0] for x in _SCAN.split(", ")])


def endings(values: DataFrame) -> DataFrame:
    """values (row, text; row unique): row, digest (of its look), n_chars, bare_chars, marked, open (no full stop), phrase (a single phrase
    or a list item at its end), goes_on (odds that the text goes
    on after its last item, from what leads up to it), word_odds (how much likelier the last word is that of a cut text).

    Null texts are left out. Texts without any item have odds of 1 and bare_chars 0. Texts that look the same count
    once, whatever they are: copies of a cut text are no evidence that it is whole."""
    copies = cut(spread(values.filter(F.col("text").isNotNull()).select("row", "text")).mapInArrow(_fold, _FOLDED))
    texts = cut(copies.groupBy("folded").agg(F.min("row").alias("row")))
    scan = cut(spread(texts.select("row", "folded")).mapInArrow(_scan, _SCAN))
    stats = scan.filter("kind = 'ctx'").groupBy(F.col("ctx")[0].alias("ctx"), "level").agg(*(F.sum(c).alias(c) for c in ("passed", "chars", "stopped", "opened")))
    stats = cut(stats)
    tails = scan.filter("kind = 'tail'").select("row", "items", "marked", "open", "word", "ctx", F.col("level").alias("alone"), (F.col("passed") == 1).alias("phrase"))
    words = cut(scan.filter("kind = 'word'").groupBy("word").agg(F.sum("passed").alias("n"), F.sum("stopped").alias("ends")))

    # --- the last word
    asked = tails.filter(F.col("word") != "").select("word").distinct()
    longer = words.filter(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("word"), "n")
    longer = longer.join(asked, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("longer"))
    # a cut leaves a word for every letter of the longer ones, or lies in the blank behind it; a whole text ends with a word that
    # ends sentences
    all_ = words.agg((F.sum(F.col("n") * (F.length("word") + 1)) / F.sum("n")).alias("chars"), (F.sum("ends") / F.sum("n")).alias("ending")).first()
    a_word, ending_ = all_["chars"] or 1.0, max(all_["ending"] or 0.0, 1e-3)
    known = asked.join(words, "word", "left").join(longer, "word", "left")
    n_ = F.coalesce("n", F.lit(0))
    rate = (F.coalesce("ends", F.lit(0)) + AVERAGE * ending_) / (n_ + AVERAGE) / ending_
    rate = F.when(F.col("phrase"), F.greatest(F.lit(1.0), rate)).otherwise(rate)  # phrases and list items end with any word
    odds = ((F.coalesce("longer", F.lit(0)) + 2 * n_ + 1) / F.lit(float(a_word))) / ((n_ + 0.5) * rate)
    odds = F.when(F.col("phrase") & (F.col("ends") > 0), F.least(odds, F.lit(1.0))).otherwise(odds)  # the more so with one that ends others
    worded = tails.filter(F.col("word") != "").select("row", "word", "phrase").join(known, "word").select("row", odds.alias("word_odds"))

    # --- what leads up to the end: the longest trusted context
    each = tails.filter(F.col("open") & (F.size("ctx") > 0)).select("row", "alone", F.posexplode("ctx").alias("level", "ctx"))
    best = each.join(stats.drop("level"), "ctx").filter((F.col("passed") >= TRUSTED) | (F.col("level") == 3)).groupBy("row").agg(F.min_by(F.struct("chars", "stopped", "opened", "alone"), "level").alias("s"))
    best = best.select("row", "s.*")
    hazard, lost = _rates(stats)
    cuts, stops = hazard * F.col("chars"), lost * F.col("stopped")
    # contexts with ways of ending of their own (lists, references, phrases) have more open ends than a Poisson number of
    # cuts and lost stops explains; a value of one fragment is such a phrase more often
    n, e = F.greatest(F.col("opened").cast("double"), F.lit(1.0)), F.greatest(cuts + stops, F.lit(1e-4))
    chance = n * F.log(e) - e - (n * F.log(n) - n + F.log(2 * math.pi * n) / 2)
    own = F.log(F.when(F.col("alone") == 1, OWN_ALONE).when(F.col("alone") == -1, OWN_FRAME).otherwise(OWN)) - F.log(n + 1) - chance
    p_own = 1 / (1 + F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), -own))))
    is_cut = (1 - p_own) * cuts / (cuts + stops + 1e-9) + p_own * F.least(F.lit(1.0), cuts / n)
    is_cut = F.least(F.lit(0.999), F.greatest(F.lit(0.001), is_cut))
    scored = best.select("row", (is_cut / (1 - is_cut)).alias("goes_on"))
    out = tails.join(worded, "row", "left").join(scored, "row", "left")
    one = lambda c: F.coalesce(c, F.lit(1.0)).alias(c)
    # a blank at the end: a cut lies behind one once a word, a text with a full stop hardly ever has one
    whole = copies.join(out.filter(~F.col("open")).select(F.col("row").alias("whole_row")), F.col("row") == F.col("whole_row")).agg(F.avg(F.col("blank_end").cast("double")).alias("p")).first()["p"]
    after_blank = (1 / float(a_word)) / max(whole or 0.0, 1e-3)
    # back to every value, by a digest of the text it shares
    digest = F.md5("folded").alias("digest")
    out = out.join(texts.select("row", digest), "row").select("digest", "items", "marked", "open", "phrase", one("word_odds"), one("goes_on"))
    bare = F.when(F.col("items"), F.col("bare_chars")).otherwise(0).alias("bare_chars")
    blank = F.when(F.col("blank_end") & F.col("open") & ~F.col("marked"), F.col("word_odds") * max(1.0, after_blank)).otherwise(F.col("word_odds")).alias("word_odds")
    return copies.select("row", "n_chars", "bare_chars", "blank_end", digest).join(out, "digest").select("row", "digest", "n_chars", bare, "marked", "open", "phrase", blank, "goes_on")


def _rates(stats: DataFrame) -> tuple[float, float]:
    """Cuts per character, from contexts of four items that are hardly ever followed by a full stop, without those that are
    open ends far more often than the rest; and the share of full stops left out, from contexts that mostly have one."""
    four = stats.filter("level = 1")
    inside = four.filter(F.col("stopped") <= F.col("passed") / 50)
    rate = lambda d: (lambda r: (r["o"] or 0) / max(1, r["c"] or 0))(d.agg(F.sum("opened").alias("o"), F.sum("chars").alias("c")).first())
    hazard = max(rate(inside), 1e-7)
    for _ in range(8):
        fresh = max(rate(inside.filter(F.col("opened") <= 3 * hazard * F.col("chars") + 3)), 1e-7)
        if abs(fresh - hazard) < 0.01 * hazard:
            break
        hazard = fresh
    ends = four.filter(F.col("stopped") > F.col("passed") / 2).agg(F.sum(F.greatest(F.lit(0.0), F.col("opened") - hazard * F.col("chars"))).alias("o"), F.sum("stopped").alias("s")).first()
    return hazard, max(1e-4, (ends["o"] or 0) / max(1, (ends["o"] or 0) + (ends["s"] or 0)))


# ---- lengths

def censored_fit(lengths: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> tuple[float, float]:
    """Maximum likelihood of a log-normal length distribution in which values at a limit may be longer in truth.

    Every value at a limit counts as right-censored there with the weight of its excess; the weights and the fit are
    repeated until they settle (expectation and maximisation)."""
    x, w = np.log(lengths + 0.5), counts.astype(float)
    mean, sd = np.average(x, weights=w), max(0.05, math.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w)))
    at = np.isin(lengths, limits)
    for _ in range(30):
        expect = w.sum() * _density(lengths, mean, sd)
        cens = np.where(at, np.clip(1 - expect / np.maximum(w, 1e-9), 0, 1), 0.0)
        z = (x - mean) / sd
        tail = np.maximum(0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in z]), 1e-12)
        mills = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        first = x + cens * (mean + sd * mills - x)
        second = (1 - cens) * x * x + cens * (mean * mean + sd * sd + sd * (x + mean) * mills)
        new = np.average(first, weights=w)
        spread = max(0.05, math.sqrt(max(1e-4, np.average(second, weights=w) - new * new)))
        done = abs(new - mean) + abs(spread - sd) < 1e-6
        mean, sd = new, spread
        if done:
            break
    return float(mean), float(sd)


def _density(lengths: np.ndarray, mean: float, sd: float) -> np.ndarray:
    lo, hi = (np.log(np.maximum(lengths - 0.5, 0.25) + 0.5) - mean) / sd, (np.log(lengths + 1.0) - mean) / sd
    phi = lambda v: np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in v])
    return np.maximum(phi(hi) - phi(lo), 1e-12)


def _around(lengths: np.ndarray, counts: np.ndarray, reach: int = 8) -> np.ndarray:
    """The mean count of the lengths within reach, without the length itself."""
    total = np.concatenate([[0], np.cumsum(counts)])
    return (total[np.searchsorted(lengths, lengths + reach, "right")] - total[np.searchsorted(lengths, lengths - reach, "left")] - counts) / (2 * reach)


def _censoring(table: pa.Table) -> pa.Table:
    field, source = table.column("field_name")[0].as_py(), table.column("source")[0].as_py()
    length, n, opened = (table.column(c).to_numpy().astype(int) for c in ("length", "n", "n_open"))
    order = np.argsort(length)
    length, n, opened = length[order], n[order], opened[order]
    total = n.sum()
    mean, sd = censored_fit(length, n, np.array([]))
    expect = np.maximum(total * _density(length, mean, sd), _around(length, n))
    limits = length[(opened >= 3) & (n > expect + 4 * np.sqrt(expect + 0.25))]  # a limit leaves open ends
    mean, sd = censored_fit(length, n, limits)
    expect = np.maximum(total * _density(length, mean, sd), _around(length, n))
    post = np.where(np.isin(length, limits), np.clip(1 - expect / n, 0, 0.99), 0.0)
    keep = post > 0
    return pa.table({"field_name": pa.array([field] * int(keep.sum()), pa.string()), "source": pa.array([source] * int(keep.sum()), pa.string()), "length": pa.array(length[keep], pa.int32()), "censored": post[keep]})


def truncated(values: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """values: field_name, record_key (unique in a field), source, text. Result: field_name, record_key, source, length,
    limit_posterior, posterior, is_truncated, one row per value.

    Null and blank texts: never truncated, posterior 0. A text with a full stop at its end is whole. Texts of any length are
    read whole; texts that look the same count once for the word and ending statistics, but every value gets its row. Null source: a source of its own. Other columns aren't read."""
    base = cut(values.select("field_name", F.col("record_key").cast("string").alias("record_key"), "source", "text", F.xxhash64("field_name", "record_key").alias("row")))
    ends = cut(endings(base.filter(F.col("text").isNotNull())))
    lens = base.select("field_name", "source", "record_key", "row").join(ends, "row", "left")
    histogram = lens.filter(F.col("n_chars") > 0).select("field_name", "source", "digest", F.explode(F.array_distinct(F.array("n_chars", "bare_chars"))).alias("length"), (F.col("open") & ~F.col("phrase")).alias("open")).distinct()
    limits = cut(histogram.groupBy("field_name", "source", "length").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open")).groupBy("field_name", "source").applyInArrow(_censoring, "field_name string, source string, length int, censored double"))
    few = broadcast_if_small(limits, limits.count(), 200)
    v, a, b = lens.alias("v"), few.alias("a"), few.alias("b")
    at = lambda side, col: (F.col("v.field_name") == F.col(f"{side}.field_name")) & F.col("v.source").eqNullSafe(F.col(f"{side}.source")) & (F.col(f"v.{col}") == F.col(f"{side}.length"))
    both = v.join(a, at("a", "n_chars"), "left").join(b, at("b", "bare_chars"), "left")
    cens = F.when(F.col("v.open") & ~F.col("v.phrase"), F.coalesce(F.greatest("a.censored", "b.censored"), F.lit(0.0))).otherwise(0.0)
    both = cut(both.select("v.*", cens.alias("limit_posterior"), F.when(F.col("a.censored") >= F.coalesce("b.censored", F.lit(0.0)), F.col("n_chars")).otherwise(F.col("bare_chars")).alias("limit")))
    # a value at a limit: the odds of being censored there stand in for the odds of any other value (1 where unknown)
    lift = F.greatest(F.lit(1.0), 1 + F.col("limit_posterior") / (1 - F.col("limit_posterior")))
    odds = F.col("goes_on") * F.col("word_odds") * lift
    blank = F.col("n_chars").isNull() | (F.col("bare_chars") == 0)
    alone = both.withColumn("alone", F.when(blank | ~F.col("open"), 0.0).otherwise(odds / (1 + odds)))
    # the open values at one limit are judged together: their share of cut ones against that of all open values is evidence on each
    of = F.col("alone") > 0
    usual = alone.filter(of).agg(F.avg("alone").alias("p")).first()["p"] or 0.5
    usual = min(max(usual, 0.01), 0.99)
    at_limit = alone.filter(of & (F.col("limit_posterior") > 0)).groupBy("field_name", "source", "limit").agg(((F.sum("alone") + usual) / (F.count("*") + 1)).alias("share"))
    at_limit = cut(at_limit)
    at_limit = broadcast_if_small(at_limit, at_limit.count(), 200).alias("l")
    v = alone.alias("v")
    joined = v.join(at_limit, (F.col("v.field_name") == F.col("l.field_name")) & F.col("v.source").eqNullSafe(F.col("l.source")) & (F.col("v.limit") == F.col("l.limit")) & (F.col("v.limit_posterior") > 0), "left")
    together = F.coalesce(F.col("l.share") / (1 - F.col("l.share")) / (usual / (1 - usual)), F.lit(1.0))
    final = F.col("v.alone") / (1 - F.col("v.alone")) * together
    posterior = F.when(F.col("v.alone") == 0, 0.0).otherwise(final / (1 + final))
    return joined.select("v.field_name", "v.record_key", "v.source", F.col("v.n_chars").alias("length"), "v.limit_posterior", posterior.alias("posterior"), (posterior >= cutoff).alias("is_truncated"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """Per field and source: values, truncated values, their rate and the most frequent length of truncated values."""
    return found.groupBy("field_name", "source").agg(
        F.count("*").alias("n_values"), F.count_if("is_truncated").alias("n_truncated"),
        (F.count_if("is_truncated") / F.count("*")).alias("rate"), F.mode(F.when(F.col("is_truncated"), F.col("length")), True).alias("usual_length"),
    )
