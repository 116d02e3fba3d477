"""Write semantics on tables without MERGE: each verb gives the new table; Snapshots publishes several tables at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.plans.lineage import path_of


def put(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Immutable, idempotent put: every key of new with outcome 'inserted', 'unchanged' (equal rows) or 'conflict'.

    Repeated equal rows of new count once; a key with different rows in new is a conflict. Nulls are equal to nulls, in keys
    and in values."""
    body = [c for c in new.columns if c not in keys]
    sign = lambda d, n: d.groupBy(*keys).agg(F.min(F.xxhash64(*body)).alias(f"{n}_lo"), F.max(F.xxhash64(*body)).alias(f"{n}_hi"), F.count("*").alias(f"{n}_n"))
    a, b = sign(new, "new").alias("a"), sign(stored, "old").alias("b")
    same = (F.col("new_lo") == F.col("new_hi")) & (F.col("old_lo") == F.col("old_hi")) & (F.col("new_lo") == F.col("old_lo"))
    outcome = F.when(F.col("old_n").isNull(), F.when(F.col("new_lo") == F.col("new_hi"), "inserted").otherwise("conflict")).when(same, "unchanged").otherwise("conflict")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left").select(*(F.col(f"a.{k}").alias(k) for k in keys), outcome.alias("outcome"))


def insert_unique(stored: DataFrame, new: DataFrame, keys: list[str], unique: str) -> DataFrame:
    """The rows of new with problem: 'key exists', 'value exists' (another row, stored or new, has the same `unique`), else null.
    Null values of `unique` are no conflict."""
    own, value = Window.partitionBy(*keys), Window.partitionBy(unique)
    a = new.withColumns({"_key": F.count("*").over(own), "_value": F.count(unique).over(value)})
    known_keys = stored.select(*keys).distinct().withColumn("_has_key", F.lit(True))
    known_values = stored.select(unique).distinct().withColumn("_has_value", F.lit(True))
    joined = a.join(known_keys, keys, "left").join(known_values, unique, "left")
    problem = F.when(F.col("_has_key").isNotNull() | (F.col("_key") > 1), "key exists").when(F.col("_has_value").isNotNull() | (F.col("_value") > 1), "value exists")
    return joined.withColumn("problem", problem).select(*new.columns, "problem")


def update_existing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new with problem: 'missing' where no stored row has the key, 'repeated' where several stored or new ones do."""
    known = stored.groupBy(*keys).agg(F.count("*").alias("_n"))
    a = new.withColumn("_own", F.count("*").over(Window.partitionBy(*keys)))
    problem = F.when(F.col("_n").isNull(), "missing").when((F.col("_n") > 1) | (F.col("_own") > 1), "repeated")
    return a.join(known, keys, "left").withColumn("problem", problem).select(*new.columns, "problem")


def replace_by_key(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored without the rows of new's keys, and new; columns that one side lacks are null."""
    return without(stored, new, key).unionByName(new, allowMissingColumns=True)


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """stored without the rows whose key is in gone; rows of null key stay."""
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def add_column(stored: DataFrame, name: str, kind: str) -> DataFrame:
    """stored with a nullable column more, as it is if it has one of that name."""
    return stored if name in stored.columns else stored.withColumn(name, F.lit(None).cast(kind))


class Snapshots:
    """Tables under one root of any Hadoop file system, as lists of data folders; a manifest names those of each table.

    Manifests are numbered. A change writes its data first and the next manifest last, which fails if another writer was
    faster: so several tables are shown at once, and a failure before leaves the old ones. Appending writes new folders only."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, at = path_of(spark, self.root)
        self.fs.mkdirs(at)

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self.fs.listStatus(self._path("")) if f.isFile())
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self) -> tuple[int, dict]:
        known = self._numbers()
        if not known:
            return 0, {"tables": {}, "identity": {}}
        text = self.spark.read.text(f"{self.root}/manifest-{known[-1]}.json", wholetext=True).first()[0]
        return known[-1], json.loads(text)

    def read(self, table: str) -> DataFrame:
        """The published rows; KeyError if there are none."""
        folders = self._manifest()[1]["tables"][table]
        frames = [self.spark.read.parquet(f"{self.root}/{f}") for f in folders]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def has(self, table: str) -> bool:
        return table in self._manifest()[1]["tables"]

    def identity(self, table: str) -> dict:
        """What guard() has stored for a table."""
        return self._manifest()[1]["identity"].get(table, {})

    def guard(self, table: str, **identity: str | int) -> None:
        """The first call stores what a table's rows are made with (a model, its revision, a dimension); a later call with
        another value is an error."""
        number, known = self._manifest()
        have = known["identity"].get(table, {})
        for key, value in identity.items():
            if key in have and have[key] != value:
                raise ValueError(f"{table} was made with {key} {have[key]!r}, not {value!r}")
        if have != have | identity:
            known["identity"][table] = have | identity
            self._show(number, known)

    def publish(self, **tables: DataFrame) -> None:
        """All tables written as new folders in place of their old ones, then shown at once."""
        self._change(tables, set(tables))

    def append(self, **tables: DataFrame) -> None:
        """All rows written as folders beside those of their tables, then shown at once; nothing stored is read or rewritten."""
        self._change(tables, set())

    def change(self, replaced: dict[str, DataFrame], appended: dict[str, DataFrame]) -> None:
        """Some tables replaced and others appended to, shown at once."""
        self._change(replaced | appended, set(replaced))

    def _change(self, tables: dict[str, DataFrame], replaced: set[str]) -> None:
        number, known = self._manifest()
        for name, df in tables.items():
            folder = f"{name}/v-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            known["tables"][name] = ([] if name in replaced else known["tables"].get(name, [])) + [folder]
        self._show(number, known)

    def _show(self, number: int, known: dict) -> None:
        try:
            out = self.fs.create(self._path(f"manifest-{number + 1}.json"), False)
        except Exception as e:
            raise RuntimeError("another writer has published since this change began") from e
        out.write(bytearray(json.dumps(known, sort_keys=True).encode()))
        out.close()

    def clean(self, keep: int = 1) -> int:
        """Deletes the manifests before the last `keep` and the folders that no kept manifest names; how many folders went.
        For a time when nobody reads the old versions."""
        numbers = self._numbers()
        kept: set[str] = set()
        for n in numbers[-keep:]:
            text = self.spark.read.text(f"{self.root}/manifest-{n}.json", wholetext=True).first()[0]
            kept |= {f for folders in json.loads(text)["tables"].values() for f in folders}
        gone = 0
        for table in self.fs.listStatus(self._path("")):
            if table.isDirectory():
                for folder in self.fs.listStatus(table.getPath()):
                    if f"{table.getPath().getName()}/{folder.getPath().getName()}" not in kept:
                        self.fs.delete(folder.getPath(), True)
                        gone += 1
        for n in numbers[:-keep]:
            self.fs.delete(self._path(f"manifest-{n}.json"), False)
        return gone
