"""References to records that do not exist: sorted parent arrays per key range, probed by binary search."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.functions.text import uuid_key
from studyloom.plans.lineage import broadcast_if_small, cut

#: Parents held as one sorted array, and references probed by one task's group.
PARENTS_A_RANGE = 50_000
PROBES_A_GROUP = 100_000

_HIT = "table_name string, record_key string, own_time timestamp, reason string"


def references(df: DataFrame, table: str, document_id: str, record_key: Column, own_time: str) -> DataFrame:
    """The references of one table as (table_name, record_key, parent_key, own_time); null ids are no references."""
    return df.filter(F.col(document_id).isNotNull()).select(
        F.lit(table).alias("table_name"), record_key.cast("string").alias("record_key"), uuid_key(document_id).alias("parent_key"), F.col(own_time).cast("timestamp").alias("own_time")
    )


def _rank(key: Column) -> Column:
    """The place of a key as a number: the first 15 digits, or a hash of what is no UUID."""
    return F.when(key.startswith("!"), F.shiftrightunsigned(F.xxhash64(key), 4)).otherwise(F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint"))


def _range_of(bounds: np.ndarray):
    @F.pandas_udf(T.IntegerType())
    def place(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, rank.to_numpy(np.int64), side="right").astype(np.int32))

    return place


def _fixed(keys: pa.ChunkedArray) -> np.ndarray:
    """Keys as 16 bytes each: the UUID value, or 128 bits of hash with a mark for what is no UUID, however long it is."""
    raw = [bytes.fromhex(k) if k[0] != "!" else b"!" + hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys.to_pylist()]
    return np.array(raw, dtype="S17")


def _probe(key: tuple, refs: pa.Table, parents: pa.Table) -> pa.Table:
    n = refs.num_rows
    found, active, earliest = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
    asked = _fixed(refs.column("parent_key"))
    own = refs.column("own_time").cast(pa.int64())
    times, timed = own.fill_null(0).to_numpy(), ~own.is_null().to_numpy()
    if parents.num_rows and n:
        held = parents.column("held").combine_chunks().flatten()
        keys = _fixed(pa.chunked_array([held.field("parent_key")]))
        order = np.argsort(keys, kind="stable")  # sorted already but for keys that are no UUIDs
        keys, held = keys[order], held.take(pa.array(order))
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        found = keys[at] == asked
        active = np.asarray(held.field("active").to_numpy(zero_copy_only=False), bool)[at]
        first = held.field("earliest").cast(pa.int64())
        timed &= ~first.is_null().to_numpy(zero_copy_only=False)[at]
        earliest = first.fill_null(0).to_numpy(zero_copy_only=False)[at]
    reason = np.select([~found, ~active, timed & (times < earliest)], ["missing", "deleted", "late"], "")
    hits = refs.select(["table_name", "record_key", "own_time"]).append_column("reason", pa.array(reason.tolist(), pa.string()))
    return hits.filter(pa.array(reason != ""))


def orphans(refs: DataFrame, catalog: DataFrame, id_col: str = "id", added: str = "added_at", removed: str = "removed_at") -> DataFrame:
    """Every reference whose parent is missing, only held as removed, or added after the reference's own time.

    refs: table_name, record_key, parent_key (a UUID value), own_time. Parents are ranged by key, at most PARENTS_A_RANGE
    of them as one sorted array; the references of a range come in salted groups of about PROBES_A_GROUP and search that
    array at once, so one key with a third of all references is spread over many tasks. Null parent_key: no reference.
    Null own_time or null added_at: never late. An empty catalog leaves every reference missing. Columns of the same name
    in refs and catalog don't clash, as only the named ones are read. Repeated rows give repeated hits.
    Result: table_name, record_key, own_time, reason."""
    refs = refs.filter(F.col("parent_key").isNotNull()).select("table_name", "record_key", "parent_key", "own_time")
    parents = (
        catalog.filter(F.col(id_col).isNotNull())
        .groupBy(uuid_key(id_col).alias("parent_key"))
        .agg(F.min(F.col(added).cast("timestamp")).alias("earliest"), F.max(F.col(removed).isNull()).alias("active"))
        .withColumn("rank", _rank(F.col("parent_key")))
    )
    parents = cut(parents)
    ranges = max(1, math.ceil(parents.count() / PARENTS_A_RANGE))
    cuts = parents.stat.approxQuantile("rank", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    place = _range_of(np.unique(np.array(cuts, dtype=np.int64)))

    held = parents.withColumn("range", place("rank")).groupBy("range").agg(F.array_sort(F.collect_list(F.struct("parent_key", "earliest", "active"))).alias("held"))
    placed = refs.withColumn("range", place(_rank(F.col("parent_key"))))
    salts = placed.groupBy("range").agg(F.ceil(F.count("*") / PROBES_A_GROUP).cast("int").alias("salts"))
    salts = broadcast_if_small(cut(salts), ranges, 32)
    probes = placed.join(salts, "range").withColumn("salt", F.pmod(F.xxhash64("record_key", "own_time"), "salts").cast("int")).drop("salts")
    arrays = held.join(salts, "range").select("range", "held", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return probes.groupBy("range", "salt").cogroup(arrays.groupBy("range", "salt")).applyInArrow(_probe, _HIT)


def orphan_report(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """Orphans and references per table and month of the record (null month: no own time)."""
    month = F.date_format("own_time", "yyyy-MM").alias("month")
    total = refs.groupBy("table_name", month).agg(F.count("*").alias("n_references"))
    by = hits.groupBy("table_name", month).agg(*(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "deleted", "late")))
    t, b = total.alias("t"), by.alias("b")
    counts = [F.coalesce(F.col(f"b.n_{r}"), F.lit(0)).alias(f"n_{r}") for r in ("missing", "deleted", "late")]
    return t.join(b, (F.col("t.table_name") == F.col("b.table_name")) & F.col("t.month").eqNullSafe(F.col("b.month")), "left").select("t.table_name", "t.month", "t.n_references", *counts)
