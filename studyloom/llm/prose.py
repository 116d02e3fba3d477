"""Problem 8: keyword-stuffed and link-list pages, by an n-gram model of function words and word classes trained on prose.

Every page becomes a sequence of classes: closed-class words stand for themselves, signs too; other words stand for their class, which
tells how much of the page's words so far they make up and how many such words precede them without a break; links, tags, amounts
and numbers have classes of their own. A trigram model with back-off is trained on the pages that read like prose. A page is spam
if its perplexity under the model is abnormally high or low: the median over its windows, so that half of the page must be, against
what prose pages of its length have. Nothing but the perplexity decides, with one exception: the lines of lists of contents (see
without_contents) aren't read."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.lookalikes import skeleton
from studyloom.llm.wordlists import FRAME
from studyloom.plans.lineage import cut, spread

#: Trigrams that make up a smaller share of all are left to the back-off: the model has at most 1 / LEAST of them.
LEAST = 1e-6
#: A context that makes up this share of all is trusted by half, so that a few pages of another kind don't make theirs likely.
RARE = 2e-4
#: Bits of the least likely class: a few odd ones don't make a page abnormal.
MOST = 10
#: Rounds of training: each leaves out what the round before found abnormal.
ROUNDS = 2
#: Classes of one window of a page, and the least share of closed-class words in a window that is trained on.
WINDOW, FRAMED = 32, 0.1
#: A page further from the middle of prose pages than so many deviations is abnormal; a window further than TRIM isn't trained on.
ABNORMAL, TRIM = 3.9, 4.0
#: Classes as in the middle of prose pages that every page is taken to have besides its own, as a few tell little.
FEW = 8
#: Shares of a page's words so far (SOFTEN words more) that divide the classes of repeated words.
AGAIN, SOFTEN = (0.03, 0.06, 0.12, 0.25), 16
#: Words since the last closed-class word, number or full stop are told apart up to so many past the third.
LONG = 5
#: Characters that are taken apart at once, and tokens that a worker remembers.
SLICE, REMEMBERED = 1 << 20, 1 << 20

_TOKEN = re.compile(r"https?://[^\s\"<>)\]]+|www\.[^\s\"<>)\]]+|#[^\W_]+|[^\W\d_]+|\d+(?:[.,]\d+)*|\.\.+|[^\s\w]|_|\n+")
# Characters that cannot be seen.
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20}
_MARKS = re.compile("[\u0300-\u036f]")
_IS_WIDE = re.compile("[！-～　]")

# Signs with a class of their own.
_SIGNS = ".,;:!?()[]\"'«»„“”‘’–—-/|·•*→=+&@%_~<>"
_WORDS = {w: k for k, w in enumerate(sorted({skeleton(x) for x in FRAME}))}
_NAMED = {name: len(_WORDS) + k for k, name in enumerate(("line", "url", "tag", "number", "amount", "dots", "sign", *_SIGNS))}
#: First class of the words that aren't closed-class; a new word, a new capitalised one, and one for each share in AGAIN.
OPEN = len(_WORDS) + len(_NAMED)
_A_RUN = 3 + len(AGAIN)
#: How many classes there are.
KINDS = OPEN + _A_RUN * (LONG + 1)
_LINE, _STOPS, _FRESH = _NAMED["line"], [_NAMED[x] for x in ".!?"], [_NAMED[x] for x in (*".!?:;", "number")]


class Classes(dict):
    """The class of each token; of a word that isn't closed-class -1 - (2 * number of the word + whether it is capitalised)."""

    def __init__(self) -> None:
        super().__init__()
        self.words: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first.isalpha():
            if token.startswith(("http://", "https://", "www.")):
                k = _NAMED["url"]
            else:
                low = skeleton(skeleton(token).lower())
                k = _WORDS.get(low)
                if k is None:
                    k = -1 - 2 * self.words.setdefault(low, len(self.words)) - first.isupper()
        elif first == "\n":
            k = _LINE
        elif first.isnumeric():
            k = _NAMED["number"]
        elif len(token) > 1:
            k = _NAMED["tag" if first == "#" else "dots"]
        else:
            k = _NAMED["amount"] if unicodedata.category(first) == "Sc" else _NAMED.get(token, _NAMED["sign"])
        self[token] = k
        return k


def fold(text: str) -> str:
    """text composed, without invisible characters and widths, with one kind of line end."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if _IS_WIDE.search(text):
            text = text.translate(_WIDE)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if _MARKS.search(text):  # accents on look-alikes, which only compose with the letters that these stand for
            text = skeleton(text)
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


_PAGE_NUMBER = re.compile(r"(?:[^\S\n]|\.\.[^\S\n]?)(\d{1,4})[^\S\n]*$", re.MULTILINE)


def without_contents(text: str) -> str:
    """text without lists of contents: three lines or more on end that each end in a page number not below the one before."""
    if len(_PAGE_NUMBER.findall(text)) < 3:
        return text
    out: list[str] = []
    held: list[str] = []
    last = -1
    for line in text.split("\n"):
        found = _PAGE_NUMBER.search(line)
        n = int(found.group(1)) if found else -1
        if n < 0 or n < last:
            out += held if len(held) < 3 else []
            held = []
        if n < 0:
            out.append(line)
        else:
            held.append(line)
        last = n
    return "\n".join(out + (held if len(held) < 3 else []))


def _open_classes(codes: np.ndarray, page: np.ndarray) -> np.ndarray:
    """codes with the words that aren't closed-class by their share of the page's words so far and how many came without a break."""
    at = np.flatnonzero(codes < 0)
    if not len(at):
        return codes
    word, of = -1 - codes[at], page[at]
    upper, word = word & 1, word >> 1
    key = of * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    nth = lambda fresh: np.arange(len(fresh)) - np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
    times = np.empty(len(at), np.int64)
    times[order] = nth(np.r_[True, np.diff(key[order]) != 0])
    before = nth(np.r_[True, np.diff(of) != 0])
    share = np.searchsorted(AGAIN, times / (before + SOFTEN), side="right")
    fresh = (codes >= 0) & ((codes < len(_WORDS)) | np.isin(codes, _FRESH))  # what a row of such words ends at
    so_far = np.cumsum(codes < 0)
    starts = np.flatnonzero(np.diff(page, prepend=-1))
    since = np.where(fresh, so_far, 0)
    since[starts] = so_far[starts] - (codes[starts] < 0)
    run = np.clip((so_far - np.maximum.accumulate(since))[at] - 3, 0, LONG)
    out = codes.copy()
    out[at] = OPEN + np.where(times == 0, upper, 2 + share) + _A_RUN * run
    return out


def classify(texts: list[str], known: Classes) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all pages in a row, and how many each page has."""
    codes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        mine = list(map(known.__getitem__, _TOKEN.findall(without_contents(fold(text)))))
        sizes[i] = len(mine)
        codes += mine
    return _open_classes(np.array(codes, np.int64), np.repeat(np.arange(len(texts)), sizes)).astype(np.int16), sizes


def reads_like_prose(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pages seed the model: enough words, many of them closed-class, in sentences, hardly links, tags or repetitions."""
    page = np.repeat(np.arange(len(sizes)), sizes)
    count = lambda what: np.bincount(page, what, len(sizes))
    closed, open_ = count(classes < len(_WORDS)), count(classes >= OPEN)
    again = count((classes >= OPEN) & ((classes - OPEN) % _A_RUN >= 4))
    odd, stops = count(np.isin(classes, [_NAMED[x] for x in ("url", "tag", "amount")])), count(np.isin(classes, _STOPS))
    return (closed + open_ >= 20) & (closed >= 0.12 * sizes) & (stops * 40 >= closed + open_) & (again <= 0.25 * open_) & (odd * 10 <= sizes)


_PAGE = "doc_id bigint, prose boolean, classes binary"


def _slices(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Classes()
    for batch in batches:
        docs, texts = batch.column(0), batch.column(1).to_pylist()
        for part in _slices(texts):
            if len(known) > REMEMBERED:
                known = Classes()
            classes, sizes = classify(texts[part], known)
            prose, ends = reads_like_prose(classes, sizes), np.cumsum(sizes)
            packed = [classes[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([docs[part], pa.array(prose), pa.array(packed, pa.binary())], names=["doc_id", "prose", "classes"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), np.int16).astype(np.int64), np.array([len(x) >> 1 for x in packed], np.int64)


# ---- the model

def _grams(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each class's trigram and bigram; a page begins after line ends."""
    one, two = np.full(len(classes), _LINE), np.full(len(classes), _LINE)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    one[starts], two[starts] = _LINE, _LINE
    two[starts[sizes[sizes > 0] > 1] + 1] = _LINE
    bi = one * KINDS + classes
    return two * KINDS**2 + bi, bi


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many windows each page has (the last one takes the rest), and the window of every class."""
    of = np.maximum(1, sizes // WINDOW)
    page = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(page)) - (np.cumsum(sizes) - sizes)[page]
    return of, (np.cumsum(of) - of)[page] + np.minimum(within // WINDOW, of[page] - 1)


class Model:
    """Interpolated trigrams over classes, and how prose pages do under them.

    middle and spread: the median page and the deviation between long pages; noise: the variance of one class."""

    def __init__(self, trigrams: np.ndarray, tri_counts: np.ndarray, bigrams: np.ndarray, bi_counts: np.ndarray) -> None:
        self.trigrams, self.tri = trigrams, np.append(tri_counts, 0).astype(np.float32)  # the last for all others
        self.bi = np.zeros(KINDS * KINDS, np.float32)
        self.bi[bigrams] = bi_counts
        pairs = self.bi.reshape(KINDS, KINDS).astype(np.float64)
        self.first, self.uni, self.total = pairs.sum(1), pairs.sum(0), max(1.0, pairs.sum())
        self.middle, self.spread, self.noise = 0.0, 1.0, 0.0
        self.index: pd.Index | None = None

    def bits(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bits of every class."""
        if self.index is None:
            self.index = pd.Index(self.trigrams)
        tri, bi = _grams(classes, sizes)
        trust = 2 + RARE * self.total
        p = (self.uni[classes] + 0.1) / (self.total + 0.1 * KINDS)
        p = (self.bi[bi] + trust * p) / (self.first[bi // KINDS] + trust)
        p = (self.tri[self.index.get_indexer(tri)] + trust * p) / (self.bi[tri // KINDS] + trust)
        return -np.log2(np.clip(p, 2.0**-MOST, 1.0))

    def windows(self, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The window of every class, the mean bits of each window, the bits of every class, and how many windows a page has."""
        of, window = _windows(sizes)
        bits = self.bits(classes, sizes)
        return window, np.bincount(window, bits, int(of.sum())) / np.maximum(1, np.bincount(window, minlength=int(of.sum()))), bits, of

    def pages(self, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The median bits a class over the windows of each page (0 for an empty page), and the sum of squares within windows."""
        window, mean, bits, of = self.windows(classes, sizes)
        first = np.cumsum(of) - of
        ranked = mean[np.lexsort((mean, np.repeat(np.arange(len(sizes)), of)))]
        square = np.bincount(np.repeat(np.arange(len(sizes)), sizes), (bits - mean[window]) ** 2, len(sizes))
        return (ranked[first + (of - 1) // 2] + ranked[first + of // 2]) / 2, square

    def deviation(self, bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How far pages are from the middle of prose pages of their length, in deviations."""
        return np.where(sizes > 0, (bits - self.middle) * sizes / (sizes + FEW) / np.sqrt(self.spread**2 + self.noise / np.maximum(1, sizes)), 0.0)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _training(model: Model | None):  # noqa: ANN202
    """The trigrams of the prose pages' windows that have closed-class words and aren't far out under the model before, counted
    once a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            classes, sizes = _unpacked(batch.column(0))
            of, window = _windows(sizes)
            long = np.bincount(window, minlength=int(of.sum()))
            kept = np.bincount(window, classes < len(_WORDS), int(of.sum())) >= FRAMED * long
            if model is not None:
                kept &= np.abs(model.deviation(model.windows(classes, sizes)[1], long)) < TRIM
            parts.append(np.unique(_grams(classes, sizes)[0][kept[window]], return_counts=True))
            held += len(parts[-1][0])
            if held > SLICE:
                parts = [_summed(parts)]
                held = 0
        keys, n = _summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["tri", "n"])

    return count


def _measuring(model: Model):  # noqa: ANN202
    """A histogram of the pages by hundredths of a bit, with their squares and classes, once a task."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[float]] = {}
        for batch in batches:
            classes, sizes = _unpacked(batch.column(0))
            bits, square = model.pages(classes, sizes)
            for k, s, n in zip(np.rint(100 * bits).astype(int).tolist(), square.tolist(), sizes.tolist(), strict=True):
                have = seen.setdefault(k, [0, 0.0, 0])
                have[0], have[1], have[2] = have[0] + 1, have[1] + s, have[2] + n
        cols = list(zip(*seen.values(), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], names=["k", "n", "squares", "classes"])

    return measure


def train(parsed: DataFrame) -> Model | None:
    """The prose model of all parsed pages; None if no page reads like prose."""
    prose = parsed.filter("prose").select("classes")
    model = None
    for _ in range(ROUNDS):
        counts = cut(prose.mapInArrow(_training(model), "tri bigint, n bigint").groupBy("tri").agg(F.sum("n").alias("n")))
        pairs = counts.groupBy((F.col("tri") % KINDS**2).alias("bi")).agg(F.sum("n").alias("n")).toArrow()  # at most KINDS ** 2 rows
        if not pairs.num_rows:
            return model
        least = LEAST * pc.sum(pairs.column("n")).as_py()
        common = counts.filter(F.col("n") >= least).toArrow()  # at most 1 / LEAST rows
        model = Model(*(t.column(c).to_numpy() for t, c in ((common, "tri"), (common, "n"), (pairs, "bi"), (pairs, "n"))))
        rows = prose.mapInArrow(_measuring(model), "k int, n bigint, squares double, classes bigint").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "squares", "classes"))).collect()  # at most 4,000 rows
        rows.sort(key=lambda r: r["k"])
        k, n = np.array([r["k"] for r in rows]) / 100, np.cumsum([r["n"] for r in rows])
        low, model.middle, high, far = (float(k[np.searchsorted(n, q * n[-1])]) for q in (0.25, 0.5, 0.75, 0.95))
        model.spread = max(0.1, (high - low) / 1.35, (far - model.middle) / 1.64)
        model.noise = math.fsum(r["squares"] for r in rows) / max(1, sum(r["classes"] for r in rows))
    return model


_SCORE = "doc_id bigint, n_classes bigint, bits double, deviation double"


def _scoring(model: Model | None):  # noqa: ANN202
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes = _unpacked(batch.column(1))
            bits = model.pages(classes, sizes)[0] if model else np.zeros(len(sizes))
            away = model.deviation(bits, sizes) if model else np.zeros(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(bits), pa.array(away)], names=["doc_id", "n_classes", "bits", "deviation"])

    return score


def page_scores(pages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every page: doc_id, n_classes, bits (a class, the median over its windows) and deviation from prose of its length."""
    base = pages.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    parsed = cut(spread(base).mapInArrow(_parsed, _PAGE))
    return parsed.select("doc_id", "classes").mapInArrow(_scoring(train(parsed)), _SCORE)


def spam_pages(pages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """page_scores() with is_spam: the deviation is beyond ABNORMAL on either side.

    Null texts are left out; empty pages and pages of blanks only are no spam. Pages of any length are read whole. Repeated
    rows get equal results. Without any page that reads like prose there is no model, and no page is spam. An empty table gives
    none. Other columns aren't read."""
    return page_scores(pages, doc_id, text).withColumn("is_spam", F.abs("deviation") > ABNORMAL)
