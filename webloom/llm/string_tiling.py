"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become lower-case word tokens. Documents that share a
seed (a window of `min_match` tokens) with an item are joined to it; inside the
stretches that shared seeds cover, running Karp-Rabin marks the longest
non-overlapping matches again and again, down to `min_match` tokens. A pair is
contaminated when the tiles cover `coverage` of the item's tokens, in whatever
order they stand.

Items with fewer tokens than `min_match` are one seed as a whole. Edge cases:
null or empty texts and items match nothing, a text of any length is one text.
Repeated rows give repeated rows; rows without an id give rows without one, and
keep_clean judges each row by its own text, whatever its id (with items too many
to go to every worker: each different text once, by its digest).
Items without an id match nothing. Of equally long matches the first in the item
is marked first. Empty tables give an empty result; other columns do not matter.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHash, grams, members, owner, slices, utf8

#: Bytes of words: letters and digits, and everything beyond ASCII.
TOKEN_BYTES = members(lambda b: b >= 128 or chr(b).isalnum())
#: Seeds up to this number go to every worker (16 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000
PAIRS = "doc_id long, item_id long, item_tokens long, covered long"


def _lower(array: pa.Array) -> pa.Array:
    return pc.utf8_lower(array.fill_null(""))


def _tokens(words: ByteHash, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, first = words.runs(*utf8(_lower(array)))
    return hashes, first


def seeds_of(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, hash) of every window of n tokens."""
    docs = owner(first)
    at, found = grams(hashes, docs, n)
    return docs[at], at - first[docs[at]], found


#: Modulus (a Mersenne prime) and base of the running hash.
PRIME, BASE = (1 << 61) - 1, 0x1B873593


def windows(values: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(position, hash) of every window of s unmarked tokens; each hash follows from the one before (Karp-Rabin)."""
    out, h, run = pow(BASE, s - 1, PRIME), 0, 0
    for k, x in enumerate(values):
        if not free[k]:
            h, run = 0, 0
            continue
        if run == s:
            h = (h - values[k - s] * out) % PRIME
            run -= 1
        h, run = (h * BASE + x) % PRIME, run + 1
        if run == s:
            yield k - s + 1, h


def tiles(pattern: list[int], text: list[int], least: int, start: int = 20) -> list[tuple[int, int, int]]:
    """(pattern position, text position, length) by running Karp-Rabin greedy string tiling; -1 in text matches nothing.

    Windows of the text are found by running hashes; a hit is verified token by token as it is extended.
    """
    free_p, free_t = [True] * len(pattern), [x != -1 for x in text]
    found: list[tuple[int, int, int]] = []
    s = max(least, min(start, len(pattern)))
    while s >= least:
        table: dict[int, list[int]] = defaultdict(list)
        for t, h in windows(text, free_t, s):
            table[h].append(t)
        matches: dict[int, list[tuple[int, int]]] = defaultdict(list)
        longest = 0
        for p, h in windows(pattern, free_p, s):
            for t in table.get(h, ()):
                if p and t and free_p[p - 1] and free_t[t - 1] and pattern[p - 1] == text[t - 1]:
                    continue  # part of a match that begins before
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and free_p[p + k] and free_t[t + k]:
                    k += 1
                if k >= s:
                    matches[k].append((p, t))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        for k in sorted(matches, reverse=True):
            for p, t in matches[k]:
                if all(free_p[p : p + k]) and all(free_t[t : t + k]):  # else what is left of it, in a later round
                    free_p[p : p + k] = free_t[t : t + k] = [False] * k
                    found.append((p, t, k))
        if s > least:
            s = max(least, s // 2)
        elif not matches:
            break
    return found


def covered(pattern: np.ndarray, text: np.ndarray, positions: np.ndarray, least: int) -> int:
    """Pattern tokens under tiles; only the stretches of text under the seeds at `positions` can match."""
    inside = np.zeros(len(text) + 1, bool)
    for k in range(least):
        inside[np.minimum(positions + k, len(text))] = True
    at = np.flatnonzero(inside[: len(text)])
    stretch: list[int] = []
    for a, b in zip(at, [*at[1:], -1], strict=True):
        stretch.append(int(text[a]))
        if b != a + 1:
            stretch.append(-1)
    return sum(k for _, _, k in tiles(pattern.tolist(), stretch, least))


class _Items:
    """Benchmark items with their seeds, sorted by hash."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, min_match: int) -> None:
        self.ids, self.hashes, self.first = ids, hashes, first
        self.sizes = np.diff(first)
        parts = []
        for n in range(1, min_match + 1):
            which, at, found = seeds_of(hashes, first, n)
            fits = self.sizes[which] >= n if n == min_match else self.sizes[which] == n
            parts.append((np.full(fits.sum(), n), which[fits], at[fits], found[fits]))
        self.length, self.item, self.at, self.seed = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(self.seed, kind="stable")
        self.length, self.item, self.at, self.seed = self.length[order], self.item[order], self.at[order], self.seed[order]


class _Scanner:
    """Looks for the items in slices of texts."""

    def __init__(self, items: _Items, min_match: int, coverage: float) -> None:
        self.items, self.min_match, self.coverage = items, min_match, coverage
        self.lengths = sorted(set(items.length.tolist()))
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(items.seed >> np.uint64(44)).astype(np.int64)] = True
        self.words = ByteHash(TOKEN_BYTES)

    def found(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, tokens of the item, those under tiles) of the pairs over the coverage."""
        items = self.items
        hashes, first = _tokens(self.words, texts)
        hits: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for n in self.lengths:
            docs, at, seeds = seeds_of(hashes, first, n)
            near = np.flatnonzero(self.quick[(seeds >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(items.seed, seeds[near]), np.searchsorted(items.seed, seeds[near], "right")
            for k in np.flatnonzero(high > low):
                for j in range(low[k], high[k]):
                    if items.length[j] == n:
                        hits[docs[near[k]], items.item[j]].append((at[near[k]], items.at[j]))
        rows = []
        for (d, i), pairs in hits.items():
            size = int(items.sizes[i])
            least = min(self.min_match, size)
            positions, own = np.array(pairs).T
            under = np.zeros(size + least, bool)
            for k in range(least):
                under[own + k] = True
            if under[:size].sum() < self.coverage * size:
                continue
            total = covered(items.hashes[items.first[i] : items.first[i + 1]], hashes[first[d] : first[d + 1]], np.unique(positions), least)
            if total >= self.coverage * size:
                rows.append((int(d), int(items.ids[i]), size, total))
        return rows


def _pairs(ids: pa.Array, rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    own = ids.take(pa.array(columns[0], pa.int64()))
    return pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in columns[1:])], names=[c.split()[0] for c in PAIRS.split(", ")])


def _scan(items: _Items, min_match: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(items, min_match, coverage)
        for batch in batches:
            for part in slices(batch):
                yield _pairs(part.column("doc_id"), scanner.found(part.column("text")))

    return run


def _without(items: _Items, min_match: int, coverage: float):
    """The rows of each batch in which no item is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(items, min_match, coverage)
        for batch in batches:
            for part in slices(batch):
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, *_ in scanner.found(part.column("text"))]] = False
                yield part.filter(pa.array(keep))

    return run


def _seed_rows(id_column: str, min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteHash(TOKEN_BYTES)
        for batch in batches:
            for part in slices(batch):
                hashes, first = _tokens(words, part.column("text"))
                for n in range(1, min_match + 1):
                    docs, _, found = seeds_of(hashes, first, n)
                    if id_column == "item_id" and n < min_match:
                        fits = np.diff(first)[docs] == n
                        docs, found = docs[fits], found[fits]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(id_column).take(pa.array(docs)), pa.array(np.full(len(docs), n, np.int32)), pa.array(found.view(np.int64))], names=[id_column, "n", "seed"]
                    )

    return run


def _scan_pairs(min_match: int, coverage: float):
    """Pairs (doc_id, text, item_id, item), those of one item one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, scanner = ByteHash(TOKEN_BYTES), None, None
        for batch in batches:
            ids, texts = batch.column("item_id").to_pylist(), batch.column("item")
            for k in range(batch.num_rows):
                if (ids[k], texts[k]) != held:
                    held = (ids[k], texts[k])
                    hashes, first = _tokens(words, texts.slice(k, 1))
                    scanner = _Scanner(_Items(np.array([ids[k]]), hashes, first, min_match), min_match, coverage)
                row = batch.slice(k, 1)
                yield _pairs(row.column("doc_id"), scanner.found(row.column("text")))

    return run


def _items(benchmark: DataFrame, broadcast_seeds: int, min_match: int) -> tuple[DataFrame, _Items | None]:
    """(items with a text, the same with their seeds if these are few enough to go to every worker)."""
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    # a token takes two characters at least, and begins one seed at most
    if items.agg(F.coalesce(F.sum(F.char_length("text") + 1), F.lit(0)).alias("n")).collect()[0]["n"] > 2 * broadcast_seeds:
        return items, None
    rows = items.filter("item_id IS NOT NULL").toArrow().combine_chunks()
    texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    hashes, first = _tokens(ByteHash(TOKEN_BYTES), texts.cast(pa.string()))
    return items, _Items(rows.column("item_id").to_numpy(), hashes, first, min_match)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.6, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, coverage) of the pairs whose tiles cover enough of the item."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, few = _items(benchmark, broadcast_seeds, min_match)
    found = own.mapInArrow(_scan(few, min_match, coverage), PAIRS) if few is not None else _joined(own, items, min_match, coverage)
    return found.withColumn("coverage", F.col("covered") / F.col("item_tokens"))


def _joined(own: DataFrame, items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """The pairs of own (doc_id, text) and items, by a join on seeds; a doc_id of any type."""
    kind = own.schema["doc_id"].dataType.simpleString()
    item_seeds = items.mapInArrow(_seed_rows("item_id", min_match), "item_id long, n int, seed long").distinct()
    doc_seeds = own.mapInArrow(_seed_rows("doc_id", min_match), f"doc_id {kind}, n int, seed long").distinct()
    pairs = doc_seeds.join(item_seeds, ["n", "seed"]).select(F.col("doc_id").alias("own_id"), "item_id").distinct()
    both = pairs.join(items.withColumnRenamed("text", "item"), "item_id").join(own, F.col("own_id").eqNullSafe(F.col("doc_id")))
    return both.select("item_id", "item", "doc_id", "text").sortWithinPartitions("item_id").mapInArrow(_scan_pairs(min_match, coverage), PAIRS.replace("doc_id long", f"doc_id {kind}"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.6, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """docs without the rows in which an item is found; a filter without shuffle unless the items are too many to go to every worker."""
    items, few = _items(benchmark, broadcast_seeds, min_match)
    if few is not None:
        return docs.mapInArrow(_without(few, min_match, coverage), docs.schema)
    digest = F.unhex(F.sha2("text", 256))
    texts = docs.filter("text IS NOT NULL").groupBy(digest.alias("doc_id")).agg(F.first("text").alias("text"))
    name = "gone"
    while name in docs.columns:
        name = f"_{name}"
    gone = _joined(texts, items, min_match, coverage).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, digest == F.col(name), "left_anti")
