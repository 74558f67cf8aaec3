"""Exact n-gram Jaccard self-join: size-banded tiles, bitmap bounds, then sorted-array intersection.

1. Shingle sets as sorted 64-bit numbers whose order puts rare shingles first;
   the order comes from counts of 65,536 hash buckets over the whole corpus.
   Two sets over the threshold share an element of their prefixes of
   n - ceil(t n) + 1, which are the keys of the tiles.
2. Equal sets become one class, which stands for all its copies.
3. In every tile, each class meets the tile's smallest id only; pairs whose
   places in the order, sizes or parity bitmaps (of a power of two of bits that
   grows with the set) cannot reach the threshold go, as differing bits are at
   most the symmetric difference. The others are checked exactly and give
   components.
4. Of tiles with classes of different components, those with the same members
   are one. Inside them, banded by size, classes of different components meet
   where their places in the order, their sizes and their bit counts allow the
   threshold: all of that is tested inside the join, so that only such pairs
   become rows. They are checked exactly too. So each link between different
   sets is found or lies inside a component already, and a group of near copies
   never makes all its pairs.

`near_components` needs no more than that. `all_links` has every link between
classes and `link_counts` the number of links of every document: the same tiles
without the components, as many rows as there are links.

Edge cases: null, empty or blank texts have an empty set, link with nothing and
are their own component. Texts with fewer words than `size` are one shingle; a
text of any length is one set. Repeated rows give one row each; different texts
under one id each have their own component, and keep_one drops the id if one of
them reaches a smaller id. Rows without an id never link to other texts: their
component is that of an equal text with an id, else null, and keep_one keeps
them. Ties (equal sizes, equal counts) are broken
by id and hash, which changes no result. An empty table gives an empty result;
other columns do not matter. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, K1, K2, K3, U, WORD_BYTES, ByteHash, cut, grams, mix, owner, slices, utf8
from .components import components

BUCKETS = 1 << 16
#: Up to this number of ids, texts to verify are picked by a broadcast of 8 bytes an id; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Pairs of one class that a task verifies together.
FAN = 64


def _shingles(words: ByteHash, part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all shingles, repeats included."""
    data, offsets = utf8(part.column("text"))
    _, _, hashes, first = words.runs(data, offsets)
    docs = owner(first)
    at, found = grams(hashes, docs, size)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return docs[at], found
    whole = []
    for d in short:
        total = 0
        for h in hashes[first[d] : first[d + 1]].tolist():
            total = (total * int(K1) + h) & ((1 << 64) - 1)
        whole.append(total)
    order = np.argsort(np.concatenate([docs[at], short]), kind="stable")
    return np.concatenate([docs[at], short])[order], np.concatenate([found, mix(np.array(whole, np.uint64) + K3)])[order]


def _bucket_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = ByteHash(WORD_BYTES, ASCII_LOWER), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                counts += np.bincount((_shingles(words, part, size)[1] >> U(48)).astype(np.int64), minlength=BUCKETS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full])], names=["bucket", "n"])

    return run


def _sets(words: ByteHash, part: pa.RecordBatch, size: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first): sorted distinct elements, those of document d at first[d]:first[d + 1]."""
    docs, hashes = _shingles(words, part, size)
    elements = (order[(hashes >> U(48)).astype(np.int64)] << U(48)) | (hashes & U((1 << 48) - 1))
    by = np.lexsort((elements, docs))
    docs, elements = docs[by], elements[by]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (elements[1:] != elements[:-1])
    docs, elements = docs[new], elements[new]
    return elements, np.searchsorted(docs, np.arange(part.num_rows + 1))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def bitmap(mixed: np.ndarray, percent: int) -> np.ndarray:
    """Parities of the elements in a power of two of bits, 64 at least: so many that of two unlike sets twice as many bits differ as may for a link."""
    bits = 64
    while bits * (100 + percent) < 8 * (100 - percent) * len(mixed):
        bits *= 2
    odd = np.bincount((mixed >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64) if len(mixed) else np.zeros(0, np.int64)


def _signatures(size: int, percent: int, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteHash(WORD_BYTES, ASCII_LOWER)
        for batch in batches:
            for part in slices(batch):
                elements, first = _sets(words, part, size, order)
                n = np.diff(first)
                full = np.flatnonzero(n)
                mixed = mix(elements + K2)

                def fold(op, values, full=full, first=first, n=n):
                    out = np.zeros(len(n), np.uint64)
                    if len(full):
                        out[full] = op.reduceat(values, first[full])
                    return out

                length = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                ends = np.concatenate([[0], np.cumsum(length)])
                at = np.arange(ends[-1]) - np.repeat(ends[:-1], length) + np.repeat(first[:-1], length)
                bits = [bitmap(mixed[a:b], percent) for a, b in zip(first, first[1:])]
                bit_ends = np.concatenate([[0], np.cumsum([len(x) for x in bits])])
                columns = [n, fold(np.add, mixed), fold(np.bitwise_xor, mix(mixed ^ K1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c.view(np.int64)) for c in columns), _lists(np.concatenate([np.zeros(0, np.int64), *bits]), bit_ends), _lists(elements[at], ends)],
                    names=["doc_id", "n", "s0", "s1", "bits", "keys"],
                )

    return run


def _elements(size: int, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteHash(WORD_BYTES, ASCII_LOWER)
        for batch in batches:
            for part in slices(batch):
                elements, first = _sets(words, part, size, order)
                body = [elements[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(body, pa.binary())], names=["doc_id", "elements"])

    return run


def _verified(percent: int):
    """Rows sorted by (a, salt, b), first the set of a itself (b is null), then the sets that it may link to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []
        for batch in batches:
            good = []
            for a, salt, b, body in zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist(), batch.column("elements"), strict=True):
                y = np.frombuffer(body.as_py(), np.uint64)
                if b is None:
                    held = [*held, y] if head == (a, salt) else [y]
                    head = (a, salt)
                elif any(linked(x, y, percent) for x in held):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in good], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact intersection of sorted arrays against the threshold."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def differing_bits(x: Column, y: Column, percent: int) -> Column:
    """Of two bitmaps whose sizes are in the same band: the longer one is folded onto the shorter."""

    def halved(c: Column) -> Column:
        half = F.size(c).cast("int") / 2
        return F.zip_with(F.slice(c, F.lit(1), half.cast("int")), F.slice(c, half.cast("int") + 1, half.cast("int")), lambda p, q: p.bitwiseXOR(q))

    for _ in range(1 + math.ceil(math.log2(100 / percent))):
        x, y = F.when(F.size(x) > F.size(y), halved(x)).otherwise(x), F.when(F.size(y) > F.size(x), halved(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)


def possible(x: str, y: str, percent: int) -> Column:
    """Sizes and bit counts of x.* and y.* allow the threshold."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    sizes = (100 * nx >= percent * ny) & (100 * ny >= percent * nx)
    return F.when(sizes, (100 + percent) * differing_bits(F.col(f"{x}.bits"), F.col(f"{y}.bits"), percent) <= (100 - percent) * (nx + ny)).otherwise(False)


class JaccardJoin:
    """The join over one table of (doc_id, text); see `result`, `all_links` and `link_counts`."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 80) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        self.size, self.percent = size, percent
        counted = self.docs.select("text").mapInArrow(_bucket_counts(size), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        counts = np.zeros(BUCKETS, np.int64)
        for row in counted.collect():  # at most BUCKETS rows
            counts[row["bucket"]] = row["n"]
        self.order = np.empty(BUCKETS, np.uint64)
        self.order[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)

    @cached_property
    def signatures(self) -> DataFrame:
        schema = "doc_id long, n long, s0 long, s1 long, bits array<long>, keys array<long>"
        return cut(self.docs.mapInArrow(_signatures(self.size, self.percent, self.order), schema))

    @cached_property
    def classes(self) -> DataFrame:
        """(s0, s1, n, node, copies): sets, the smallest id that has each, and the number of rows."""
        return self.signatures.filter("n > 0").groupBy("s0", "s1", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))

    @cached_property
    def _tiles(self) -> tuple[DataFrame, DataFrame]:
        """(sizes and bitmaps of classes, (key, hub, doc_id, place) of keys that at least two classes have).

        place holds the size of a set and the position of the key in it, hub is (doc_id, place) of the tile's smallest id.
        """
        named = self.classes.select("s0", "s1", "n", F.col("node").alias("doc_id"))
        reps = self.signatures.join(named, ["doc_id", "s0", "s1", "n"], "left_semi")
        bits = cut(reps.select("doc_id", "n", "bits").distinct())
        rows = reps.select("doc_id", "n", F.posexplode("keys").alias("pos", "key")).select("key", "doc_id", (F.shiftleft("n", 32) + F.col("pos")).alias("place"))
        tiles = rows.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("hub"), F.max("doc_id").alias("most")).filter("hub.doc_id < most").select("key", "hub")
        return bits, cut(rows.join(tiles, "key"))

    def _room(self, x: str, y: str) -> Column:
        """Sizes and positions in a tile allow the threshold at the first key that two sets share: what comes before it is in one of them only."""
        t = self.percent
        nx, ny = (F.shiftright(f"{s}.place", 32) for s in (x, y))
        px, py = (F.col(f"{s}.place").bitwiseAND(F.lit((1 << 32) - 1)) for s in (x, y))
        return (100 * nx >= t * ny) & (100 * ny >= t * nx) & ((100 + t) * F.least(nx - px, ny - py) >= t * (nx + ny))

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) over the threshold. Sets of b go where the set of a goes once for FAN of them."""
        fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fan"))
        heads = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
        members = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("salt"), "b")
        roles = heads.unionByName(members).withColumn("doc_id", F.coalesce("b", "a"))
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        texts = self.docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
        sets = texts.mapInArrow(_elements(self.size, self.order), "doc_id long, elements binary")
        ready = roles.join(sets, "doc_id").select("a", "salt", "b", "elements").repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
        return ready.mapInArrow(_verified(self.percent), "a long, b long")

    def _meet(self, rows: DataFrame, bits: DataFrame, apart: bool) -> DataFrame:
        """Distinct pairs inside tiles that places, sizes and bit counts allow; `apart`: of different components only.

        A tile is parted into bands of sizes that grow by four; sets that link to smaller ones of the band below are guests in it.
        """
        band = F.floor(F.log2(F.col("n").cast("double")) / 2).cast("int")
        near = F.floor(F.log2(F.col("n") * (self.percent / 100 - 1e-9)) / 2).cast("int")
        lowest = F.greatest(near, F.lit(0))
        placed = rows.join(bits, "doc_id").withColumn("own", band).withColumn("band", F.explode(F.sequence(F.least(lowest, band), band)))
        x, y = placed.alias("x"), placed.alias("y")
        nx, ny = F.col("x.n"), F.col("y.n")
        # once: in the band of the smaller one
        fits = (F.col("x.own") == F.col("x.band")) & ((nx < ny) | ((nx == ny) & (F.col("x.doc_id") < F.col("y.doc_id"))))
        if apart:
            fits = fits & (F.col("x.component") != F.col("y.component"))
        fits = fits & self._room("x", "y") & possible("x", "y", self.percent)
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & fits)
        ids = (F.col("x.doc_id"), F.col("y.doc_id"))
        return met.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b")).distinct()

    def _components(self) -> DataFrame:
        """(node, component) of the class representatives that link."""
        bits, shared = self._tiles
        small = lambda name: bits.select(F.col("doc_id").alias(name), F.struct("n", "bits").alias(f"{name}_s"))
        met = shared.select("hub", F.struct("doc_id", "place").alias("own")).filter("own.doc_id <> hub.doc_id").filter(self._room("hub", "own"))
        pairs = met.select(F.col("hub.doc_id").alias("a"), F.col("own.doc_id").alias("b")).distinct()
        first = cut(pairs.join(small("a"), "a").join(small("b"), "b").filter(possible("a_s", "b_s", self.percent)).select("a", "b").distinct())
        links = cut(self._verify(first))
        groups = components(links)
        # what is still apart meets inside the tiles
        tagged = shared.drop("hub").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        apart = cut(self._with_partners(tagged.join(self._distinct_tiles(tagged, F.col("component")), "key", "left_semi")))
        more = cut(self._meet(apart, bits, True).join(first, ["a", "b"], "left_anti"))
        added = cut(self._verify(more))
        return components(links.union(added)) if added.limit(1).count() else groups

    def _distinct_tiles(self, rows: DataFrame, label: Column) -> DataFrame:
        """(key): of the tiles with different labels, the first key of those with the same members."""
        members = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"h{k}") for k in range(2)]
        tiles = rows.groupBy("key").agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count(F.lit(1)).alias("size"), *members)
        return tiles.filter("low < high").groupBy("size", "h0", "h1").agg(F.min("key").alias("key")).select("key")

    def _with_partners(self, rows: DataFrame) -> DataFrame:
        """Without sets for which no other size in their tile allows a link; the nearest sizes tell. Bitmaps need not go to these."""
        n, w = F.shiftright("place", 32), Window.partitionBy("key").orderBy("place")
        sized = rows.withColumn("below", F.lag(n).over(w)).withColumn("above", F.lead(n).over(w))
        near = (100 * F.col("below") >= self.percent * n) | (100 * n >= self.percent * F.col("above"))
        return sized.filter(near).drop("below", "above")

    def all_links(self) -> DataFrame:
        """(a, b) of every link between class representatives, a < b."""
        bits, shared = self._tiles
        rows = cut(self._with_partners(shared.drop("hub").join(self._distinct_tiles(shared, F.col("doc_id")), "key", "left_semi")))
        return self._verify(cut(self._meet(rows, bits, False)))

    def link_counts(self) -> DataFrame:
        """(doc_id, n_links) for every row: how many other rows it links to, equal sets included."""
        links = self.all_links().distinct()
        both = links.union(links.select("b", "a")).toDF("node", "other")
        sizes = self.classes.select(F.col("node").alias("other"), "copies")
        near = both.join(sizes, "other").groupBy("node").agg(F.sum("copies").alias("near"))
        counted = self.classes.join(near, "node", "left").select("s0", "s1", "n", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        return self.signatures.select("doc_id", "n", "s0", "s1").join(counted, ["s0", "s1", "n"], "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row."""
        named = self.classes.join(self._components(), "node", "left").select("s0", "s1", "n", F.coalesce("component", "node").alias("component"))
        return self.signatures.select("doc_id", "n", "s0", "s1").join(named, ["s0", "s1", "n"], "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
        )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that reach a smaller doc_id by links; repeated rows of a kept id stay."""
    gone = near_components(docs, size, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def near_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    return JaccardJoin(docs, size, percent).result()
