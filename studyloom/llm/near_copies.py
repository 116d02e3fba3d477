"""Classes of documents that are copies or near copies of each other, whose members containers keep apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.plans.lineage import broadcast_if_small, cut, spread

#: Words of a shingle, and the share of shingles that near copies have in common.
WORDS, ALIKE = 5, 0.8
#: Two texts of this similarity share at least this part of the sum of their shingles.
SHARED = ALIKE / (1 + ALIKE)
#: Shingles of so many texts stand last in the order of shingles, the most frequent at the end; at most so many of them, a
#: matter of speed only, as every order gives the same pairs.
COMMON, MOST_COMMON = 16, 1 << 17
#: All pairs of texts that share a shingle are made at once if there are no more of them; of more, those not yet linked.
FEW = 64
#: Texts of one shingle that a task compares with all others.
SALTED = 2048
#: Words of 64 parities of a text's shingles.
PARITIES = 4
#: Texts that are hashed at a time.
SLICE = 512

_ODD = np.random.default_rng(7).integers(0, 1 << 63, WORDS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(texts: list[str]) -> list[np.ndarray]:
    out = []
    for text in texts:
        w = np.array([xxhash.xxh64_intdigest(x) for x in text.split(" ")], np.uint64)
        n = max(1, len(w) - WORDS + 1)
        own = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(w))):
            own += w[k : k + n] * _ODD[k]
        for k in (WORDS, WORDS + 1):
            own = (own ^ (own >> np.uint64(31))) * _ODD[k]
        out.append(np.unique(own ^ (own >> np.uint64(32))))
    return out


def shingles(words: str) -> np.ndarray:
    """The hashes of every run of WORDS words, each once, in order; of all words if there are fewer."""
    return _shingles([words])[0]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            own = _shingles(batch.column(1).to_pylist())
            n = np.array([len(x) for x in own], np.int32)
            bit = np.concatenate(own) % np.uint64(64 * PARITIES) + np.repeat(np.arange(len(own), dtype=np.uint64) * np.uint64(64 * PARITIES), n)
            odd = (np.bincount(bit.astype(np.int64), minlength=64 * PARITIES * len(own)) & 1).astype(np.uint8)
            parities = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(odd).view(np.int64)), PARITIES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), parities, pa.array([x.tobytes() for x in own], pa.binary())], names=["key", "n", "parities", "shingles"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[n > 1]), pa.array(n[n > 1])], names=["token", "n"])


def common(signed: DataFrame) -> np.ndarray:
    """The shingles that most texts have, the most frequent last: at most MOST_COMMON. Counted where a batch has them more than
    once."""
    counts = cut(signed.select("shingles").mapInArrow(_repeated, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON))
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect()  # at most 64 rows
    least, total = 64, 0
    for r in by_size:
        total += r["count"]
        if total > MOST_COMMON:
            break
        least = r["power"]
    found = counts.filter(F.col("n") >= F.lit(2.0) ** int(least)).toArrow()
    token, n = (found.column(c).to_numpy() for c in ("token", "n"))
    return token[np.lexsort((token, n))].astype(np.int64)


def _prefixes(last: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of every text the first shingles, of which near copies have one in common: all but ALIKE of them, and one more."""
    order = np.argsort(last)
    known, rank = last[order], order + 1

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                n = batch.column(1).to_numpy()
                token = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
                row = np.repeat(np.arange(len(n)), n)
                place = np.zeros(len(token), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    place = np.where(known[at] == token, rank[at], 0)
                by = np.argsort(row * (len(known) + 1) + place, kind="stable")  # otherwise the shingles are in order already
                at = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
                first = at <= (n - np.ceil(ALIKE * n - 1e-9))[row]
                row, at, token = row[first], at[first], token[by[first]]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(batch.column(0).to_numpy()[row]), pa.array(n[row]), pa.array(at.astype(np.int32))], names=["token", "key", "n", "at"])

    return prefix


_PAIRED = "token bigint, key bigint, n int, at int, texts bigint, other bigint"


def _pairing(few: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows in order of their shingle, with the number of its texts: pairs (key > other) of texts of one shingle that may
    share enough, where it has at most few texts; of more the rows themselves, other being null."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the rows of a shingle of which more are to come
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            is_few = cols[4] <= few
            if not is_few.all():
                many = batch.filter(pa.array(~is_few))
                yield pa.RecordBatch.from_arrays([*many.columns, pa.nulls(many.num_rows, pa.int64())], names=[x.split()[0] for x in _PAIRED.split(", ")])
            cols = [c[is_few] for c in cols]
            cols = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]) if len(cols[0]) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(cols[0])])
            whole = sizes == cols[4][starts]
            if not whole[:-1].all():
                raise RuntimeError("rows are not in the order of their shingles")
            end = len(cols[0]) if not len(starts) or whole[-1] else starts[-1]
            kept = [c[end:] for c in cols]
            token, key, n, at = (c[:end] for c in cols[:4])
            x, step, found = np.arange(end), 0, []
            while len(x):
                step += 1
                x = x[x + step < end]
                x = x[token[x] == token[x + step]]
                y = x + step
                of = np.minimum(n[x] - at[x], n[y] - at[y]) >= (n[x] + n[y]) * SHARED - 1e-9
                found.append((np.maximum(key[x[of]], key[y[of]]), np.minimum(key[x[of]], key[y[of]])))
            a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([none[0], pa.array(a, pa.int64()), *none[1:], pa.array(b, pa.int64())], names=[x.split()[0] for x in _PAIRED.split(", ")])
        if kept is not None and len(kept[0]):
            raise RuntimeError("rows are not in the order of their shingles")

    return pair


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(p, q, assume_unique=True))
        return both / (len(p) + len(q) - both)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _may_share() -> Column:
    """Whether x and y, whose first common shingle is at these places, have enough of them left."""
    return F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= (F.col("x.n") + F.col("y.n")) * SHARED - 1e-9


def _may_be_alike() -> Column:
    """Whether no more parities of x and y differ than near copies have shingles of their own."""
    differ = sum((F.bit_count(F.col("x.parities")[k].bitwiseXOR(F.col("y.parities")[k])) for k in range(PARITIES)), F.lit(0))
    return differ <= (F.col("x.n") + F.col("y.n")) * (1 - 2 * SHARED) + 1e-9


def _alike(signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are near copies: parities are compared before shingles are moved."""
    brief = signed.select("key", "n", "parities")
    pairs = pairs.join(brief.alias("x"), F.col("a") == F.col("x.key")).join(brief.alias("y"), F.col("b") == F.col("y.key")).filter(_may_be_alike()).select("a", "b")
    pairs = cut(pairs)
    n = pairs.count()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    own = signed.select("key", "shingles").join(broadcast_if_small(asked, 2 * n, 16), "key", "left_semi")  # few texts have a near copy
    both = pairs.join(own.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return both.filter(_similarity("x", "y") >= ALIKE).select("a", "b")


def links(texts: DataFrame) -> DataFrame:
    """texts (key unique, words): pairs (a > b) of similarity ALIKE or more that link all keys that any such pairs link.

    Exact: near copies have one of their first shingles in common, in whatever order of shingles. Pairs with a shingle of at most
    FEW texts are all compared. Of a shingle of more texts each is compared with the first and the last one, then with all that
    aren't linked with it so far, so that n copies of a text give 2 n pairs."""
    signed = cut(spread(texts).mapInArrow(_signed, "key bigint, n int, parities array<bigint>, shingles binary"))
    held = signed.select("key", "n", "shingles").mapInArrow(_prefixes(common(signed)), "token bigint, key bigint, n int, at int")
    shared = held.withColumn("texts", F.count("*").over(Window.partitionBy("token"))).filter("texts > 1")  # in order of the shingles
    made = cut(shared.mapInArrow(_pairing(FEW), _PAIRED))
    pairs, many = made.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")), made.filter("other is null").drop("other")
    n_many = many.count()
    if not n_many:
        return _alike(signed, pairs.distinct())
    ends = many.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    starred = many.join(ends, "token").select("key", F.explode(F.array("low", "high")).alias("other")).filter("key <> other")
    starred = starred.select(F.greatest("key", "other").alias("a"), F.least("key", "other").alias("b"))
    found = cut(_alike(signed, pairs.unionByName(starred).distinct()))
    known = components(found)
    parts = F.ceil(F.col("texts") / SALTED).cast("int")
    left = many.join(known, "key", "left").withColumn("class", F.coalesce("class", "key")).join(signed.select("key", "parities"), "key")
    left = cut(left.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("key"), parts).cast("int")}))
    right = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part"))
    rest = left.alias("x").join(right.alias("y"), same & (F.col("x.key") > F.col("y.key")) & (F.col("x.class") != F.col("y.class")) & _may_share() & _may_be_alike())
    return found.unionByName(_alike(signed, rest.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()))


def components(pairs: DataFrame) -> DataFrame:
    """key and class (the least key that it is linked with through any number of pairs) of every key of pairs (a, b).

    Each round every key takes the least label among its own and its neighbours', and that label's own; the rounds end when none
    changes."""
    edges = cut(pairs.select(F.col("a").alias("key"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("to"))))
    labels = cut(edges.groupBy("key").agg(F.least(F.min("to"), F.min("key")).alias("class")))
    while True:
        seen = edges.join(labels.select(F.col("key").alias("to"), "class"), "to").groupBy("key").agg(F.min("class").alias("near"))
        jump = labels.select(F.col("key").alias("class"), F.col("class").alias("far"))
        new = labels.join(seen, "key").join(jump, "class", "left").select("key", F.least("class", "near", "far").alias("class"), F.col("class").alias("was"))
        new = cut(new)
        labels = new.select("key", "class")
        if not new.filter(F.col("class") != F.col("was")).limit(1).count():
            return labels


def copy_classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id and cluster, equal for texts of the same words (case, punctuation, white space and digits aside)
    and for near copies. Texts without letters are in a class with their exact copies only; null and empty texts in none."""
    words = F.trim(F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}]+", " "))
    key = F.when(words == "", F.xxhash64(F.lit(0), "text")).otherwise(F.xxhash64(words))
    keyed = cut(docs.filter(F.col("text") != "").select("doc_id", key.alias("key"), words.alias("words")))
    texts = keyed.filter(F.col("words") != "").groupBy("key").agg(F.first("words").alias("words"))
    same = components(links(texts))
    return keyed.select("doc_id", "key").join(same, "key", "left").select("doc_id", F.coalesce("class", "key").alias("cluster"))
