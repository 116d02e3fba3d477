"""Problem 6: filling containers of fixed capacity by conflict-constrained best fit.

The pieces of each capacity are dealt by hash into shards of a bounded number of containers; within a shard they are placed by
falling size into the tightest container that is compatible. A container carries bitmaps of the sources and duplicate clusters
it holds; the search goes on to the next larger residual until a compatible one is found."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.near_copies import copy_classes
from studyloom.llm.tokens import VOCABULARY, token_counts
from studyloom.plans.lineage import broadcast_if_small, cut

#: Containers that one task fills at a time.
BINS_A_SHARD = 2048
#: A cluster with at least this many members for each container needed is placed first.
WIDE = 0.05

_PLACED = "spec_id int, container_id string, doc_id bigint, piece_no int, n_tokens int"


class Limits:
    """Bits of a kind of group (source or cluster): a group that comes n times gets as many bits as it may have members in
    one container; groups of a single item need none."""

    def __init__(self, groups: list, bins: int, slack: int, spare: int) -> None:
        self.mask, at = {}, 0
        for g, n in Counter(groups).items():
            if g is not None and n > 1:
                allowed = min(n, slack * -(-n // bins) + spare)
                self.mask[g] = ((1 << allowed) - 1) << at
                at += allowed

    def take(self, held: int, group) -> int | None:  # noqa: ANN001
        """held with one more member of group, None if it has as many as it may."""
        mask = self.mask.get(group, 0)
        if not mask:
            return held
        free = mask & ~held
        return held | (free & -free) if free else None


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, share: int = 3) -> list[int]:
    """The container of each item (no item larger than capacity).

    Copies of one cluster share a container only if there are more of them than containers. A source has at most `share` times
    its even share of a container, and one more. Both limits hold in every container: where no open one is compatible a new one
    is opened. Large clusters are placed first, as they need many containers, then items by falling size."""
    need = max(1, -(-sum(sizes) // capacity))
    by_source, by_cluster = Limits(sources, need, share, 1), Limits(clusters, need, 1, 0)
    copies = Counter(c for c in clusters if c is not None)
    wide = {c: n for c, n in copies.items() if n > 1 and n >= WIDE * need}
    order = sorted(range(len(sizes)), key=lambda i: (-wide.get(clusters[i], 0), -sizes[i], i))
    open_: list[tuple[int, int]] = []  # (residual, container), ascending
    held: list[tuple[int, int]] = []
    out = [0] * len(sizes)
    for i in order:
        size = sizes[i]
        for at in range(bisect_left(open_, (size, -1)), len(open_)):
            in_sources, in_clusters = held[open_[at][1]]
            c = by_cluster.take(in_clusters, clusters[i])
            if c is None:
                continue
            s = by_source.take(in_sources, sources[i])
            if s is not None:
                break
        else:
            at, s, c = len(open_), by_source.take(0, sources[i]), by_cluster.take(0, clusters[i])
            open_.append((capacity, len(held)))
            held.append((0, 0))
        residual, b = open_.pop(at)
        held[b] = (s, c)
        out[i] = b
        if residual > size:
            insort(open_, (residual - size, b))
    return out


def _pack(key: tuple, table: pa.Table, share: int) -> pa.Table:
    spec, shard = (k.as_py() for k in key)
    table = table.sort_by([("doc_id", "ascending"), ("piece_no", "ascending")])  # the same result however rows arrive
    sizes = table.column("n_tokens").to_pylist()
    bins = best_fit(sizes, table.column("source").to_pylist(), table.column("cluster").to_pylist(), table.column("capacity")[0].as_py(), share)
    return pa.table({
        "spec_id": pa.array([spec] * len(bins), pa.int32()), "container_id": pa.array([f"s{shard}.{b}" for b in bins], pa.string()),
        "doc_id": table.column("doc_id"), "piece_no": table.column("piece_no"), "n_tokens": table.column("n_tokens"),
    })


def fill_containers(docs: DataFrame, specs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, share: int = 3) -> DataFrame:
    """Every piece of every document for every spec: spec_id, container_id, doc_id, piece_no, n_tokens.

    doc_id is unique. A text is split only if it exceeds the capacity, into full pieces, each a container of its own, and a
    rest. Null and empty texts have nothing to place. Duplicates are the classes of copy_classes(): texts of the same words and near
    copies. A source has at most `share` times its even share of a container, and one more. Null source: no source conflict. Specs of null or non-positive capacity are left out. Other columns
    aren't read; an empty table gives none. A group with a third of all rows is dealt over all shards like any other."""
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    items = token_counts(base, "text", "doc_id", "source", vocabulary=vocabulary).join(copy_classes(base.select("doc_id", "text")), "doc_id", "left")
    items = cut(items.filter(F.col("n_tokens") > 0))
    wanted = specs.filter(F.col("capacity_tokens") > 0).select("spec_id", F.col("capacity_tokens").alias("capacity"))
    # the specs are a stated set: every document is placed once for each
    n_specs = specs.count()
    each = items.join(broadcast_if_small(wanted, n_specs, 32)).withColumns({"full": F.floor(F.col("n_tokens") / F.col("capacity")), "rest": F.col("n_tokens") % F.col("capacity")})
    full = each.filter("full > 0").select("spec_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(1), F.col("full").cast("int"))).alias("piece_no"))
    full = full.select("spec_id", F.concat(F.lit("d"), "doc_id", F.lit("."), "piece_no").alias("container_id"), "doc_id", "piece_no", F.col("capacity").cast("int").alias("n_tokens"))
    rest = each.filter("rest > 0").select("spec_id", "capacity", "doc_id", (F.col("full") + 1).cast("int").alias("piece_no"), F.col("rest").cast("int").alias("n_tokens"), "source", "cluster")
    total = rest.groupBy("spec_id", "capacity").agg(F.sum("n_tokens").alias("tokens"))
    shards = total.select("spec_id", F.greatest(F.lit(1), F.ceil(F.col("tokens") / (F.col("capacity") * BINS_A_SHARD))).cast("int").alias("shards"))
    dealt = rest.join(broadcast_if_small(shards, n_specs, 32), "spec_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "spec_id"), "shards").cast("int")).drop("shards")
    packed = dealt.groupBy("spec_id", "shard").applyInArrow(lambda key, table: _pack(key, table, share), _PLACED)
    return full.unionByName(packed)


def fill_rates(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, pieces, tokens, the share of capacity in use and the least number of containers possible."""
    by = placed.groupBy("spec_id").agg(F.count_distinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return by.join(specs.select("spec_id", "capacity_tokens"), "spec_id").select(
        "spec_id", "n_containers", "n_pieces", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers")
    )
