"""Shared helpers: shared-folder checkpoints, byte-bounded Arrow slices and
vectorised word hashing over Arrow's own UTF-8 buffers."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step holds at a time.
SLICE_BYTES = 1 << 19

U = np.uint64
#: Fixed odd multipliers of the hash functions below.
K0, K1, K2, K3, K4 = (U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where none is set, which only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _temporary()


@lru_cache(1)
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="webloom-checkpoint-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's folder below the shared one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot from this share of the rows on, so at most as many keys are.
HOT_SHARE = 1000


def hot_keys(sizes: DataFrame, n: str = "n") -> DataFrame:
    """The rows of `sizes` (one a key, with its row count) of hot keys: at most HOT_SHARE of them."""
    total = sizes.agg(F.sum(n)).first()[0] or 0
    return sizes.filter(F.col(n) > max(1, total // HOT_SHARE))


def join_spread(rows: DataFrame, values: DataFrame, hot: DataFrame, key: str, value: str, spread: Column) -> DataFrame:
    """rows left-joined to values (one row a binary key) without one task for a hot key.

    `hot`, the values of hot_keys, goes to all workers; its rows are dealt by key and `spread` (binary), which no value has as its key.
    """
    first = rows.join(F.broadcast(hot.select(key, F.col(value).alias("_hot"))), key, "left")
    dealt = first.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.col(key), spread)))
    found = dealt.join(values.select(F.col(key).alias("_key"), value), "_key", "left")
    return found.withColumn(value, F.coalesce("_hot", value)).drop("_hot", "_key")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_TRIM = _trim()


def give_back() -> None:
    """Returns freed memory to the system; idle workers stay alive and would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose `column` holds at most `limit` bytes, or a single row."""
    n = batch.num_rows
    if not n:
        return
    offsets = _offsets(batch.column(column))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end
    give_back()


def _offsets(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; a null is an empty text."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    offsets = _offsets(array)
    body = array.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(array) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * K4
    x = (x ^ (x >> U(29))) * K1
    return x ^ (x >> U(32))


class ByteHash:
    """Position-independent polynomial hashes of byte runs: one multiply and one running sum a byte.

    `member` says which bytes belong to a run, `fold` maps bytes before hashing
    (for example A-Z to a-z).
    """

    def __init__(self, member: np.ndarray, fold: np.ndarray | None = None) -> None:
        self.member = member
        self.codes = mix(np.arange(1, 257, dtype=np.uint64) * K0)
        if fold is not None:
            self.codes = self.codes[fold]
        self._grow(SLICE_BYTES + 1)

    def _grow(self, n: int) -> None:
        powers = np.full(n, _BASE, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        powers[1:] = U(_INVERSE)
        self.inverses = np.cumprod(powers, dtype=np.uint64)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash, first) of maximal runs; runs first[d]:first[d+1] belong to document d."""
        n = len(data)
        if not n:
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        inside = self.member[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return start, end, self.spans(data, start, end), np.searchsorted(start, offsets)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ascending spans that do not overlap."""
        hashes = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):  # one round unless a text is longer than a slice
            origin = int(start[at])
            to = max(at + 1, int(np.searchsorted(end, origin + SLICE_BYTES, "right")))
            stop = int(end[to - 1])
            if stop - origin > len(self.powers):
                self._grow(stop - origin + 1)
            sums = np.zeros(stop - origin + 1, np.uint64)
            np.cumsum(self.codes[data[origin:stop]] * self.powers[: stop - origin], out=sums[1:])
            s, e = start[at:to] - origin, end[at:to] - origin
            hashes[at:to] = (sums[e] - sums[s]) * self.inverses[s]
            at = to
        return mix(hashes + (end - start).astype(np.uint64) * K3)


def members(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


SPACE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes of words `[^\x20\x09-\x0D]+`.
WORD_BYTES = members(lambda b: b not in SPACE)
#: A-Z to a-z, all else unchanged.
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each run."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every n-word window inside one document."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = hashes[: len(hashes) - n + 1] * K0
    factor = int(K0)
    for k in range(1, n):
        factor = (factor * int(K1) + 2) & ((1 << 64) - 1) | 1
        total = total + hashes[k : len(hashes) - n + 1 + k] * U(factor)
    at = np.flatnonzero(docs[: len(docs) - n + 1] == docs[n - 1 :])
    return at, mix(total[at])


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `flags` between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
