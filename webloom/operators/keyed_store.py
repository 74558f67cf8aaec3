"""Tables with a key that slices of changes move on: changes are added as a log and merged when rows are read.

A store lies as Parquet in <path>/gen=<g>/slice=<n>/bucket=<b>: slice 0 is the base, the others hold changed rows only, the newest of a
key counts. The bucket is a hash of the key, so rows of asked keys are in known folders; rows lie in the key's order within files.
A slice counts once Spark's committer has marked it, so one that breaks off changes nothing and is written again.

* `apply` writes the changed rows and reads, only where old values matter, the buckets that the changes fall in.
* `read` leaves the base where it lies: rows that the log replaces go by an anti join, so the base is not shuffled while the log is small.
* `lookup` reads the buckets of its keys.
* `compact` makes the next generation's base of what `read` gives; `due` tells by bytes when that pays.

One writer at a time; who reads while `compact` removes the older generation keeps it with `keep=True`. Null is a key like any other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

GONE = "_gone"


class KeyedStore:
    """A store that `create` made and `open` finds again."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int, schema: StructType) -> None:
        self.spark, self.path, self.keys, self.buckets, self.schema = spark, path.rstrip("/"), list(keys), buckets, schema

    # --- folders -----------------------------------------------------------------------------------------------------------
    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 256) -> KeyedStore:
        """A new store of rows, of one row a key; its path must not hold one yet."""
        spark = rows.sparkSession
        if taken := {GONE, "bucket", "slice"} & set(rows.columns):
            raise ValueError(f"columns of the store itself: {sorted(taken)}")
        store = cls(spark, path, keys, buckets, rows.schema)
        meta = spark.createDataFrame([(list(keys), buckets, rows.schema.json())], "keys array<string>, buckets int, schema string")
        meta.coalesce(1).write.mode("error").parquet(f"{store.path}/meta")
        store._write(rows.withColumn(GONE, F.lit(False)), 0, 0)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedStore:
        meta = spark.read.parquet(f"{path.rstrip('/')}/meta").first()
        return cls(spark, path, meta["keys"], meta["buckets"], StructType.fromJson(json.loads(meta["schema"])))

    def _folder(self, path: str):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def _named(self, path: str, name: str) -> list[int]:
        """Numbers n of the folders <name>=<n> below a path that exist."""
        files, there = self._folder(path)
        found = [s.getPath().getName() for s in files.listStatus(there)] if files.exists(there) else []
        return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}="))

    def _whole(self, gen: int, n: int) -> bool:
        files, there = self._folder(f"{self.path}/gen={gen}/slice={n}/_SUCCESS")
        return files.exists(there)

    def version(self) -> tuple[int, list[int]]:
        """The newest generation with a whole base, and its whole slices."""
        for gen in reversed(self._named(self.path, "gen")):
            if self._whole(gen, 0):
                return gen, [n for n in self._named(f"{self.path}/gen={gen}", "slice") if self._whole(gen, n)]
        raise ValueError(f"no store in {self.path}")

    def _bytes(self, gen: int, n: int) -> int:
        files, there = self._folder(f"{self.path}/gen={gen}/slice={n}")
        return files.getContentSummary(there).getLength()

    # --- rows --------------------------------------------------------------------------------------------------------------
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in self.keys])

    def _write(self, rows: DataFrame, gen: int, n: int) -> None:
        placed = rows.select(*self.schema.names, GONE, self.bucket().alias("bucket"))
        sorted_rows = placed.repartition("bucket").sortWithinPartitions("bucket", *self.keys)
        sorted_rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/gen={gen}/slice={n}")

    def _slices(self, gen: int, numbers: Sequence[int], buckets: Sequence[int] | None) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(GONE, BooleanType()), StructField("slice", IntegerType()), StructField("bucket", IntegerType())])
        base = f"{self.path}/gen={gen}"
        if numbers:
            rows = self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/slice={n}" for n in numbers))
        else:
            rows = self.spark.createDataFrame([], schema)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(list(buckets)))

    def _merged(self, buckets: Sequence[int] | None = None) -> DataFrame:
        gen, numbers = self.version()
        base = self._slices(gen, [0], buckets)
        if numbers == [0]:
            return base.select(*self.schema.names)
        log = self._slices(gen, [n for n in numbers if n], buckets)
        newest = log.withColumn("_n", F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("slice")))).filter("_n = 1")
        touched = log.select(*self.keys).distinct()
        kept = base.join(touched, self._same(base, touched), "left_anti")
        return kept.select(*self.schema.names).unionByName(newest.filter(~F.col(GONE)).select(*self.schema.names))

    def read(self) -> DataFrame:
        """The rows as of all slices so far."""
        return self._merged()

    def buckets_of(self, wanted: DataFrame) -> list[int]:
        """Buckets of some keys; at most the store's number of buckets reaches the driver."""
        return sorted(r[0] for r in wanted.select(self.bucket().alias("b")).distinct().collect())

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of wanted (keys), read from the keys' buckets only."""
        rows = self._merged(self.buckets_of(wanted))
        asked = wanted.select(*self.keys).distinct()
        return rows.join(asked, self._same(rows, asked), "left_semi")

    # --- changes -----------------------------------------------------------------------------------------------------------
    def apply(self, changes: DataFrame, merge: dict[str, Callable[[Column, Column, Column], Column]] | None = None, gone: Column | None = None) -> int:
        """Adds a slice of changes, one row a key, and returns its number.

        Without `merge` a change replaces the row and nothing is read. `merge` maps columns to functions of (known, old, new), where
        known tells whether the key has a row; other columns take the new value. `gone`, over the changes' columns, removes the key.
        A key with several changes in a slice is an error, as their order is the caller's to settle.
        """
        gen, numbers = self.version()
        marked = changes.withColumn(GONE, F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        twice = F.count(F.lit(1)).over(Window.partitionBy(*self.keys))
        told = F.concat_ws(", ", *(F.col(k).cast("string") for k in self.keys))
        checked = marked.withColumn(GONE, F.when(twice > 1, F.raise_error(F.concat(F.lit("several changes of one key: "), told)).cast("boolean")).otherwise(F.col(GONE)))
        if merge:
            old = self.lookup(changes)
            values = [c for c in self.schema.names if c not in self.keys]
            held = old.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)), F.struct(F.lit(1).alias("_there"), *values).alias("_old"))
            same = reduce(lambda x, y: x & y, [checked[k].eqNullSafe(held[f"_k{i}"]) for i, k in enumerate(self.keys)])
            joined = checked.join(held, same, "left")
            known = F.col("_old").isNotNull()
            checked = joined.select(*self.keys, *((merge[c](known, F.col("_old")[c], F.col(c)) if c in merge else F.col(c)).alias(c) for c in values), GONE)
        n = numbers[-1] + 1
        self._write(checked, gen, n)
        return n

    def due(self, share: float = 0.5) -> bool:
        """The log holds more than this share of the base's bytes."""
        gen, numbers = self.version()
        return sum(self._bytes(gen, n) for n in numbers if n) > share * self._bytes(gen, 0)

    def compact(self, keep: bool = False) -> int:
        """Makes the next generation of all slices so far and returns its number; the older ones go unless kept."""
        gen, _ = self.version()
        self._write(self.read().withColumn(GONE, F.lit(False)), gen + 1, 0)
        if not keep:
            for old in self._named(self.path, "gen"):
                if old <= gen:
                    files, there = self._folder(f"{self.path}/gen={old}")
                    files.delete(there, True)
        return gen + 1
