"""Problem 7: mixing sources to target weights by entropy balancing.

Per mix and source the document rates nearest (in entropy) to one use each are wanted whose tokens make up the source's share:
exponentially tilted rates exp(lambda * tokens), at most the source's cap. The dual is convex and falls into one lambda per
source, for which Newton steps run over the histogram of document sizes, every mix and source in a task of its own. Rates are
rounded into whole copies: documents with a fraction get a copy more in the order of hash / fraction until the target is met."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.tokens import VOCABULARY, token_counts
from studyloom.plans.lineage import broadcast_if_small, cut

#: The relative error of a source's tokens at which Newton's steps end, and the largest tilt.
ENOUGH, MOST = 1e-9, 60.0
#: Bins of one pass of the rounding; two passes tell 2 ** 22 places apart.
BINS = 1 << 11
#: So many documents' worth of tokens of every source are left open at first, and made up among so many of the next documents.
OPEN, BEHIND = 16, 64

_PLAN = "mix_id int, source string, cap int, target_tokens double, mean_tokens double, full boolean, lam double"


def newton(tokens: np.ndarray, n: np.ndarray, target: float, cap: float, mean: float) -> float:
    """The tilt at which n documents of each size, at rates min(cap, exp(tilt * tokens / mean)), have `target` tokens: Newton steps
    on the dual, and a bisection where one would leave the bracket."""
    low, high, lam = -MOST, MOST, 0.0
    while high - low > 1e-12:
        rate = np.minimum(cap, np.exp(np.minimum(MOST, lam * tokens / mean)))
        miss = float((n * tokens * rate).sum()) - target
        if abs(miss) <= ENOUGH * target:
            break
        low, high = (low, lam) if miss > 0 else (lam, high)
        slope = float((n * tokens * np.where(rate < cap, rate, 0.0) * tokens / mean).sum())
        step = lam - miss / slope if slope > 0 else np.inf
        lam = step if low < step < high else (low + high) / 2
    return lam


def balance(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes: source, n_tokens, n (documents of that size). targets: mix_id, source, target_share, cap. Result per mix and
    source: target_tokens, lam (the tilt by tokens / mean tokens), mean_tokens, full (all documents at the cap).

    A mix is as large as its caps allow: the least of cap * tokens / share over its sources that have tokens. A group is a
    histogram: one row for each size that documents of a source have, however many they are."""
    own = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("docs"))
    per = targets.join(own, "source").filter((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("cap") > 0))
    total = F.min(F.col("cap") * F.col("tokens") / F.col("target_share")).over(Window.partitionBy("mix_id"))
    plan = per.withColumn("total", total).select("mix_id", "source", "cap", (F.col("total") * F.col("target_share")).alias("target_tokens"), F.col("tokens").cast("double").alias("tokens"), (F.col("tokens") / F.col("docs")).alias("mean_tokens"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        full = r.target_tokens >= r.cap * r.tokens * (1 - 1e-9)
        lam = 0.0 if full else newton(rows.n_tokens.to_numpy(float), rows.n.to_numpy(float), r.target_tokens, float(r.cap), r.mean_tokens)
        return pd.DataFrame([(r.mix_id, r.source, r.cap, r.target_tokens, r.mean_tokens, full, lam)], columns=[x.split()[0] for x in _PLAN.split(", ")])

    return sizes.join(plan, "source").groupBy("mix_id", "source").applyInPandas(solve, _PLAN)


def _edge(rows: DataFrame, bin_: Column, missing: str, name: str) -> DataFrame:
    """Per mix and source the bin in which the tokens of rows reach what is missing (BINS if they don't), and what is missing then."""
    bins = rows.groupBy("mix_id", "source", bin_.alias("bin")).agg(F.max(missing).alias("missing"), F.sum("n_tokens").alias("tokens"))  # at most BINS for each row of targets
    order = Window.partitionBy("mix_id", "source").orderBy("bin")
    upto = bins.withColumn("upto", F.sum("tokens").over(order))
    inside = F.col("upto") <= F.col("missing")
    return upto.groupBy("mix_id", "source").agg(
        F.coalesce(F.min(F.when(~inside, F.col("bin"))), F.lit(BINS)).alias(name), (F.max("missing") - F.coalesce(F.max(F.when(inside, F.col("upto"))), F.lit(0))).alias(f"{name}_missing")
    )


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each mix and source the rows of the lowest places, at most BEHIND in a task."""
    held: dict[tuple, list] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            heap = held.setdefault(row[:2], [])
            item = (-row[2], -row[3], row)
            if len(heap) < BEHIND:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
    rows = [x[2] for heap in held.values() for x in heap]
    if schema is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def fill_up(tokens: list[int], missing: float) -> list[int]:
    """Places of the documents (in order) whose tokens together come nearest to what is missing, the first ones where it is
    the same: every sum that the documents up to one can have is a bit of a number."""
    most = (1 << (int(2 * missing) + 2)) - 1
    sums = [1]
    for n in tokens:
        sums.append((sums[-1] | sums[-1] << n) & most)
    goal = round(missing)
    low = (sums[-1] & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = sums[-1] >> (goal + 1)
    high = goal + 1 + (above & -above).bit_length() - 1 if above else None
    left = low if high is None or missing - low <= high - missing else high
    taken = []
    for k in range(len(tokens), 0, -1):
        if not sums[k - 1] >> left & 1:
            taken.append(k - 1)
            left -= tokens[k - 1]
    return taken[::-1]


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["place", "doc_id"]).head(BEHIND)
    return rows.iloc[fill_up(rows.n_tokens.tolist(), float(rows.missing.iloc[0]))][["mix_id", "source", "doc_id"]]


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """mix_id, doc_id, source, n_tokens, rate, copies (0 to max_repeats) of every document of the sources of each mix.

    targets: mix_id, source, target_share, max_repeats, a stated set with each source once in a mix. Sources without tokens
    supply none, and the mix goes without them. Null texts and null sources take no part; empty texts get no copies. Repeated
    documents are documents of their own. Other columns aren't read; an empty table gives none. No source is gathered in one
    task: sizes are counted in a histogram first, copies are decided by hash places counted in bins, and the last few documents
    among BEHIND of every source."""
    targets = targets.select("mix_id", "source", "target_share", F.col("max_repeats").alias("cap")).filter(F.col("source").isNotNull())
    n_targets = targets.count()
    small = lambda df: broadcast_if_small(df, n_targets, 400)  # one row for each row of targets
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).join(small(targets.select("source").distinct()), "source", "left_semi")
    sized = cut(token_counts(own, "text", "doc_id", "source", vocabulary=vocabulary))
    sizes = sized.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    plan = cut(balance(sizes, targets))

    cap = F.col("cap").cast("double")
    rate = F.when(F.col("n_tokens") == 0, 0.0).when(F.col("full"), cap).otherwise(F.least(cap, F.exp(F.least(F.lit(MOST), F.col("lam") * F.col("n_tokens") / F.col("mean_tokens")))))
    rated = sized.join(small(plan), "source").withColumn("rate", rate).withColumn("base", F.floor("rate").cast("int"))
    fraction = F.when((F.col("rate") > F.col("base")) & (F.col("base") < F.col("cap")), F.col("rate") - F.col("base"))
    # of the documents with a fraction those with the lowest hash / fraction get a copy more, up to the missing tokens
    place = F.shiftrightunsigned(F.xxhash64("mix_id", "doc_id"), 11) / F.lit(float(1 << 53)) / fraction
    rated = rated.withColumn("place", place).select("mix_id", "doc_id", "source", "n_tokens", "rate", "base", "target_tokens", "place")
    first = F.floor(F.least(F.col("place") * (BINS / 4), F.lit(BINS - 1.0))).cast("int")
    inner = F.floor(F.least((F.col("place") * (BINS / 4) - first) * BINS, F.lit(BINS - 1.0))).cast("int")
    lack = F.max("target_tokens") - F.sum(F.col("base") * F.col("n_tokens"))
    lacking = cut(rated.groupBy("mix_id", "source").agg(lack.alias("lack"), F.greatest(F.lit(0.0), lack - OPEN * F.avg(F.when(F.col("place").isNotNull(), F.col("n_tokens")))).alias("missing")))
    open_ = rated.filter(F.col("place").isNotNull())
    edge = cut(_edge(open_.join(small(lacking), ["mix_id", "source"]), first, "missing", "edge"))
    within = open_.join(small(edge), ["mix_id", "source"]).filter(first == F.col("edge"))
    fine = edge.join(_edge(within, inner, "edge_missing", "fine"), ["mix_id", "source"], "left")
    fine = fine.select("mix_id", "source", "edge", F.coalesce("fine", F.lit(0)).alias("fine"), F.coalesce("fine_missing", "edge_missing").alias("left"))
    fine = cut(fine.join(lacking, ["mix_id", "source"]).select("mix_id", "source", "edge", "fine", (F.col("left") + F.col("lack") - F.col("missing")).alias("missing")))
    placed = rated.join(small(fine), ["mix_id", "source"], "left")
    before = F.coalesce((first < F.col("edge")) | (first == F.col("edge")) & (inner < F.col("fine")), F.lit(False))
    # what the next document is too large for is made up by those behind it
    behind = placed.filter(F.col("place").isNotNull() & ~before & (F.col("missing") > 0)).select("mix_id", "source", "place", "doc_id", "n_tokens", "missing")
    behind = behind.mapInArrow(_first, "mix_id int, source string, place double, doc_id bigint, n_tokens int, missing double")
    extra = cut(behind.groupBy("mix_id", "source").applyInPandas(_fill, "mix_id int, source string, doc_id bigint").withColumn("one", F.lit(1)))
    extra = broadcast_if_small(extra, n_targets * BEHIND, 100)
    copies = F.col("base") + before.cast("int") + F.coalesce("one", F.lit(0))
    return placed.join(extra, ["mix_id", "source", "doc_id"], "left").select("mix_id", "doc_id", "source", "n_tokens", "rate", copies.cast("int").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share of all tokens, tokens, copies and the most copies of one document."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("copies").cast("bigint") * F.col("n_tokens")).alias("tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    all_ = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = targets.join(got, ["mix_id", "source"], "left").join(all_, "mix_id", "left")
    return joined.select("mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("n_copies"), zero("most_copies"))
