"""Exact top-k search by inner product: tiles of queries and shards, and a tree of merges.

Vectors are scaled to whole numbers and packed into shards of at most
SHARD_ROWS rows, ordered by id, each one binary row of a table in the shared
folder. The queries of a shard, a stated part of the rows, are packed beside it.
Each packed block of queries goes to every shard (a stated query set against all
rows, in blocks); a task holds one shard and lets the blocks pass by, multiplies
them tile by tile, and keeps of each tile the best k of each query. So memory is
bounded by a shard, a block and a tile, whatever the number of rows. The lists of
a query, one a shard, are merged MERGE at a time until one is left; no task ever
holds more than MERGE lists of a query.

Products are exact: of components up to 16 bits in 32-bit floating point while no
sum can reach 2**24, in 64-bit below 2**53, and in whole numbers of any size
beyond. A score beyond 63 bits counts as the largest (or smallest) 63-bit one.

Edge cases: a vector that is null, or that holds a null, an infinity or NaN,
takes no part, nor does a row without an id. Vectors of different lengths meet as
if the shorter one ended in zeros; an empty one scores 0. Ties go to the smaller
id. A row is no candidate of itself only: of rows that repeat an id each is a
query and a candidate of the others, and has its own list. A query with fewer
than k candidates has all of them, and no rows if there are none. An empty table
gives an empty result. Other columns of the table do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back

SHARD_ROWS, MERGE = 1 << 16, 16
MOST_TASKS = 20_000
#: Rows and columns of a tile.
TILE_QUERIES, TILE_ROWS = 256, 1 << 13
MOST = (1 << 63) - 1
PACKED = "ids binary, vectors binary, dims int, wide boolean, q_ids binary, q_places binary, q_vectors binary"
TOPS = "q_shard long, q_place long, query_id long, shard long, top array<struct<worse: long, vec_id: long>>"


def _matrix(rows: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their scaled components as whole numbers in 64-bit floating point, padded with zeros)."""
    rows = rows.cast(pa.list_(pa.float64()))
    sizes = np.asarray(rows.value_lengths().fill_null(0), np.int64)
    values = rows.flatten()
    whole = np.floor(scale * np.asarray(values.fill_null(np.nan), np.float64))
    first = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
    fine = np.asarray(rows.is_valid()) & (bad[first[1:]] == bad[first[:-1]])
    matrix = np.zeros((len(rows), int(sizes.max(initial=0))))
    matrix[np.repeat(np.arange(len(rows)), sizes), np.arange(len(whole)) - np.repeat(first[:-1], sizes)] = whole
    return np.flatnonzero(fine), matrix[fine]


def _pack(divisor: int, scale: float, most: int):
    def blocks(ids: np.ndarray, vectors: np.ndarray, wide: bool) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order].astype("<f8" if wide else "<i2")
        asks = np.flatnonzero(ids % divisor == 0)
        sent = [ids.tobytes(), vectors.tobytes(), vectors.shape[1], wide, ids[asks].tobytes(), asks.tobytes(), vectors[asks].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x]) if not isinstance(x, int) or isinstance(x, bool) else pa.array([x], pa.int32()) for x in sent], names=[c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            batch = batch.filter(batch.column("vec_id").is_valid())
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                fine, matrix = _matrix(part.column("vector"), scale)
                ids = np.asarray(part.column("vec_id"), np.int64)[fine]
                large = np.abs(matrix).max(axis=1, initial=0) > 32767
                for wide in (False, True):
                    mine = large == wide
                    if mine.any():
                        held[wide].append((ids[mine], matrix[mine] if wide else matrix[mine].astype(np.int16)))
                    while sum(len(x[0]) for x in held[wide]) >= most:
                        ids_, vectors = _joined(held[wide])
                        yield blocks(ids_[:most], vectors[:most], wide)
                        held[wide] = [(ids_[most:], vectors[most:])]
        for wide, rest in held.items():
            ids_, vectors = _joined(rest)
            if len(ids_):
                yield blocks(ids_, vectors, wide)
        give_back()

    return run


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    dims = max((v.shape[1] for _, v in parts), default=0)
    wide = [np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for _, v in parts]
    return (np.concatenate([i for i, _ in parts]), np.concatenate(wide)) if parts else (np.zeros(0, np.int64), np.zeros((0, 0)))


def _read(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}vectors"], "<f8" if row["wide"] else "<i2").reshape(len(ids), row["dims"])


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors as 64-bit numbers."""
    dims = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :dims], rows[:, :dims]
    reach = dims * float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0))
    if reach < 1 << 53:
        kind = np.float32 if reach < 1 << 24 else np.float64
        return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(rows).T, -MOST, MOST).astype(np.int64)


def best(values: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest values, ties by place: all that are above the k-th, and the first of its equals."""
    n, width = values.shape
    if width <= k:
        return np.argsort(~values, axis=1, kind="stable")
    kth = np.partition(values, width - k, axis=1)[:, width - k, None]
    above, equal = values > kth, values == kth
    equal &= np.cumsum(equal, axis=1) <= k - above.sum(axis=1)[:, None]
    places = np.nonzero(above | equal)[1].reshape(n, k)
    order = np.argsort(-np.take_along_axis(values, places, 1), axis=1, kind="stable")
    return np.take_along_axis(places, order, 1)


def _tile_tops(k: int):
    """Over rows sorted so that a shard comes before the blocks of queries that go to it."""

    def against(shard: int, ids: np.ndarray, vectors: np.ndarray, row: dict) -> Iterator[pa.RecordBatch]:
        q_ids, q_vectors = _read(row, "q_")
        q_places = np.frombuffer(row["q_places"], np.int64)
        for a in range(0, len(q_ids), TILE_QUERIES):
            some = q_vectors[a : a + TILE_QUERIES]
            kept, held = np.zeros((len(some), 0), np.int64), np.zeros((len(some), 0), np.int64)
            for b in range(0, len(ids), TILE_ROWS):
                tile = scores(some, vectors[b : b + TILE_ROWS])
                if row["shard"] == shard:  # a query's own row is below all others, and goes at the end
                    own = q_places[a : a + TILE_QUERIES] - b
                    here = np.flatnonzero((own >= 0) & (own < tile.shape[1]))
                    tile[here, own[here]] = -MOST - 1
                places = best(tile, k)
                kept = np.concatenate([kept, np.take_along_axis(tile, places, 1)], 1)
                held = np.concatenate([held, ids[b + places]], 1)
                places = best(kept, k)
                kept, held = np.take_along_axis(kept, places, 1), np.take_along_axis(held, places, 1)
            real = kept > -MOST - 1
            offsets = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(-kept[real]), pa.array(held[real])], ["worse", "vec_id"])
            n = len(some)
            columns = [pa.array([row["shard"]] * n, pa.int64()), pa.array(q_places[a : a + n]), pa.array(q_ids[a : a + n]), pa.array([shard] * n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), entries)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TOPS.split(", ")[:4]] + ["top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k_ in range(batch.num_rows):
                row = batch.slice(k_, 1).to_pylist()[0]
                if row["asks"]:
                    yield from against(row["to"], *held, row)
                else:
                    held = _read(row)
        give_back()

    return run


def top_k(table: DataFrame, k: int = 20, divisor: int = 20, scale: float = 64.0, vector: str = "embedding", shard_rows: int = SHARD_ROWS, merge: int = MERGE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by `divisor`, by inner product of floor(scale * x)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    packed = cut(rows.mapInArrow(_pack(divisor, scale, shard_rows), PACKED).withColumn("own", F.monotonically_increasing_id()))
    # shards get consecutive numbers: one short row for each shard
    numbered = packed.select("own").withColumn("shard", (F.row_number().over(Window.orderBy("own")) - 1).cast("long"))
    shards = packed.join(numbered, "own").drop("own")
    n = packed.count()
    empty = [F.lit(b"").alias(c) for c in ("q_ids", "q_places", "q_vectors")]
    kept = shards.select(F.col("shard").alias("to"), F.lit(False).alias("asks"), "shard", "dims", "wide", "ids", "vectors", *empty)
    nothing = [F.lit(b"").alias(c) for c in ("ids", "vectors")]
    asked = shards.filter(F.length("q_ids") > 0).select(F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)).cast("long"))).alias("to"), F.lit(True).alias("asks"), "shard", "dims", "wide", *nothing, "q_ids", "q_places", "q_vectors")
    tasks = max(1, min(n, MOST_TASKS))
    dealt = kept.unionByName(asked).repartitionById(tasks, (F.col("to") % tasks).cast("int")).sortWithinPartitions("to", "asks")
    lists = dealt.mapInArrow(_tile_tops(k), TOPS)
    while n > 1:
        merged = F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        lists = lists.groupBy("q_shard", "q_place", "query_id", F.floor(F.col("shard") / merge).alias("shard")).agg(merged)
        n = -(-n // merge)
    ranked = lists.select("query_id", F.posexplode("top").alias("rank", "entry"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("entry.vec_id").alias("vec_id"), (-F.col("entry.worse")).alias("score"))
