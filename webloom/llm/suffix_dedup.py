"""Exact removal of repeated byte strings by a distributed merge sort of sampled suffixes.

1. Positions are sampled by content: the least hash of a `GRAM`-byte gram in
   every window of `length` bytes, so equal windows hold equal samples. Grams
   that occur once in the corpus cannot lie in a repeated window and go.
2. Each task sorts its suffixes (what follows the sampled position, then what
   precedes it, reversed). Suffixes equal over the whole reach of any window
   keep their earliest place only; the later ones are repeats already. The
   sorted run goes, front-coded, to the bucket of its grams.
   A gram at very many places (a line shorter than a window in most documents)
   would fill one bucket: its suffixes go to several, by longer keys that equal
   windows share too, one for each part of the positions that the gram can have
   in a window.
3. Each bucket merges its runs with a loser tree that carries the common
   prefix lengths and never compares known prefixes again. The merged order
   and its common prefixes name equal windows without looking at bytes; all
   but the earliest of each are removed.

Documents equal to an earlier one need no suffixes: they go as a whole. Edge
cases: a null text is empty; texts shorter than `length` bytes keep all; a long
text is read whole, in overlapping pieces. Rows that repeat an id and its text
are one document at one place, and do not count as earlier than each other; so
are rows without an id and with the same text, which come last. An empty table gives an empty result; other
columns do not matter. Grams are told apart by 64-bit hashes, windows byte by
byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import K0, K1, U, cut, hot_keys, join_spread, mix, slices, utf8

GRAM = 32
#: Ids from here on stand for missing ones, so that such rows come last; each text has its own.
NO_ID = 1 << 62
#: Suffixes that a task sorts at a time; a gram at more places than these is hot.
RUN = 100_000
#: Hot grams that are told to all workers (8 bytes each), the most frequent ones; of others all suffixes go to one bucket.
MOST_HOT = 10_000
#: Parts of the positions of a hot gram in a window; its suffixes go once for each part to a key of nearly the whole window.
PARTS = 4


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes along the last axis."""
    h = mix(np.arange(1, 257, dtype=np.uint64) * K0)[data]
    factor, width = int(K1), 1
    while width < GRAM:
        h = h[..., :-width] * U(factor) + h[..., width:]
        factor, width = factor * factor & (2**64 - 1), 2 * width
    return mix(h) | U(1)


def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = op(values[:-done], values[done:])
        done *= 2
    return op(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def samples(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the sampled positions; windows never cross documents."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(data)
    reach = length - GRAM + 1
    least = _slide(h, reach, np.minimum)
    change = np.zeros(len(least) + 1, np.int64)
    np.add.at(change, np.clip(offsets[1:] - length + 1, np.minimum(offsets[:-1], len(least)), len(least)), 1)
    np.add.at(change, np.minimum(offsets[1:], len(least)), -1)
    least = np.where(np.cumsum(change[:-1]) > 0, U(0), least)
    edge = np.zeros(reach - 1, np.uint64)
    best = _slide(np.concatenate([edge, least, edge]), reach, np.maximum)
    at = np.flatnonzero((best == h) & (best > 0))
    return at, h[at]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, limit: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, data, offsets): all at once, or a long text in overlapping pieces."""
    if len(data) <= limit:
        yield 0, data, offsets
        return
    for d in range(len(offsets) - 1):
        for a in range(int(offsets[d]), max(int(offsets[d]) + 1, int(offsets[d + 1]) - length + 1), limit):
            b = min(int(offsets[d + 1]), a + limit + length - 1)
            yield a, data[a:b], np.array([0, b - a])


def _sampled(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                found = [(a + p, h) for a, x, o in _pieces(data, offsets, length) for p, h in [samples(x, o, length)]]
                at, h = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                at, once = np.unique(at, return_index=True)
                docs = np.searchsorted(offsets, at, "right") - 1
                ids, h = part.column("doc_id").to_numpy(), h[once]
                _, lead, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                again = lead[which] != np.arange(len(h))
                # of a gram that repeats here, one place meets other tasks; the rest is dealt out at random
                h = np.where(again, mix(h + (ids[docs] + at).astype(np.uint64) * K0), h)
                places = np.where(again, -1, times[which])  # here, told by the one place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ids[docs]), pa.array((at - offsets[docs]).astype(np.int32)), pa.array(places.astype(np.int32))], names=["h", "doc_id", "at", "places"]
                )

    return run


def _repeated(hot: int):
    """Of rows sorted by h, those that repeat in their slice or whose h occurs more than once, and (h, places) of grams at over `hot` places.

    One row and one sum are held between batches.
    """

    def out(doc_id: np.ndarray, at: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = lambda k, kind: pa.nulls(k, kind)
        columns = [
            pa.concat_arrays([pa.array(doc_id, pa.int64()), none(len(h), pa.int64())]), pa.concat_arrays([pa.array(at, pa.int32()), none(len(h), pa.int32())]),
            pa.concat_arrays([none(len(at), pa.int64()), pa.array(h, pa.int64())]), pa.concat_arrays([none(len(at), pa.int64()), pa.array(n, pa.int64())]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None
        nothing, total = np.zeros(0, np.int64), 0  # of the last h
        for batch in batches:
            if not batch.num_rows:
                continue
            h, doc_id, at, places = (batch.column(x).to_numpy() for x in ("h", "doc_id", "at", "places"))
            good = (places != 1)
            if kept is not None:
                h, doc_id, at, good = (np.concatenate([a, b]) for a, b in zip(kept, (h, doc_id, at, good), strict=True))
                places = np.concatenate([[0], places])
            same = h[1:] == h[:-1]
            good[1:] |= same
            good[:-1] |= same
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            sums = np.add.reduceat(np.maximum(places, 0).astype(np.int64), first)
            sums[0] += total
            total = int(sums[-1])
            many = np.flatnonzero(sums[:-1] > hot)
            kept = (h[-1:], doc_id[-1:], at[-1:], good[-1:].copy())
            good[-1] = False
            yield out(doc_id[good], at[good], h[first[many]], sums[many])
        if kept is not None:
            good, many = kept[3], total > hot
            yield out(kept[1][good], kept[2][good], kept[0] if many else nothing, np.array([total]) if many else nothing)

    return run


def front_code(records: np.ndarray, places: np.ndarray) -> bytes:
    """Sorted fixed-width records as common prefix lengths and remainders, with their (document, position)."""
    n, width = records.shape
    shared = common_prefixes(records)
    rest = records[np.arange(width)[None, :] >= shared[:, None]]
    body = b"".join([shared.astype("<u2").tobytes(), np.ascontiguousarray(places.T).astype("<i8").tobytes(), rest.tobytes()])
    return np.array([n, width], "<i8").tobytes() + zstandard.compress(body, 3)


def common_prefixes(records: np.ndarray) -> np.ndarray:
    """Common prefix length of each record with the one before; 0 first."""
    n, width = records.shape
    shared = np.zeros(n, np.int64)
    if n > 1:
        differs = records[1:] != records[:-1]
        shared[1:] = np.where(differs.any(1), differs.argmax(1), width)
    return shared


def front_decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(records, common prefix lengths, places)."""
    n, width = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    body = zstandard.decompress(blob[16:])
    shared = np.frombuffer(body, "<u2", n).astype(np.int64)
    places = np.ascontiguousarray(np.frombuffer(body, "<i8", 2 * n, 2 * n).reshape(2, n).T)
    rest = np.frombuffer(body, np.uint8, offset=18 * n)
    records = np.zeros((n, width), np.uint8)
    records[np.arange(width)[None, :] >= shared[:, None]] = rest
    rows = np.arange(n)
    for c in range(width):
        own = np.maximum.accumulate(np.where(shared <= c, rows, 0))
        records[:, c] = records[own, c]
    return records, shared, places


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """((run, index) in sorted order, common prefix length of each with the one before).

    A loser tree over sorted runs of equal-length records. Each record waits
    with its common prefix length to the last winner; of two, the longer one
    wins unseen, and only at equal lengths bytes beyond it are compared.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    heads: list[bytes | None] = [runs[r][0][0] if r < len(runs) and runs[r][0] else None for r in range(k)]
    index = [0] * k
    prefix = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is then that to the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if prefix[x] != prefix[y]:
            return (x, y) if prefix[x] > prefix[y] else (y, x)
        known = prefix[x]
        p, q = a[known:], b[known:]
        if p == q:
            win, lose, more = min(x, y), max(x, y), len(p)
        else:
            win, lose = (x, y) if p < q else (y, x)
            more = (8 * len(p) - (int.from_bytes(p) ^ int.from_bytes(q)).bit_length()) // 8
        prefix[lose] = known + more
        return win, lose

    losers = [0] * k
    level = list(range(k))
    base = k
    while len(level) > 1:
        base //= 2
        above = []
        for i in range(0, len(level), 2):
            win, lose = play(level[i], level[i + 1])
            losers[base + i // 2] = lose
            above.append(win)
        level = above
    winner = level[0]
    order, lengths = [], []
    while heads[winner] is not None:
        order.append((winner, index[winner]))
        lengths.append(prefix[winner])
        index[winner] += 1
        records, shared = runs[winner]
        if index[winner] < len(records):
            heads[winner], prefix[winner] = records[index[winner]], shared[index[winner]]
        else:
            heads[winner] = None
        node = (winner + k) // 2
        while node:
            win, lose = play(winner, losers[node])
            losers[node], winner = lose, win
            node //= 2
    return order, lengths


class _Suffixes:
    """Layout of a record: `length` bytes from the position on, the bytes before it reversed, and how many of both exist."""

    def __init__(self, length: int, buckets: int) -> None:
        self.length, self.before, self.buckets = length, length - GRAM, buckets
        self.width = length + self.before + 4

    def records(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Records at byte positions `at` of documents data[low:high]."""
        n = len(at)
        out = np.zeros((n, self.width), np.uint8)
        after, before = np.minimum(high - at, self.length), np.minimum(at - low, self.before)
        step = np.arange(self.length)[None, :]
        inside = step < after[:, None]
        out[:, : self.length] = np.where(inside, data[np.where(inside, at[:, None] + step, 0)], 0)
        step = np.arange(self.before)[None, :]
        inside = step < before[:, None]
        out[:, self.length : self.length + self.before] = np.where(inside, data[np.where(inside, at[:, None] - 1 - step, 0)], 0)
        for k, x in enumerate((after, before)):
            out[:, self.width - 4 + 2 * k] = x >> 8
            out[:, self.width - 3 + 2 * k] = x & 255
        return out

    def reach(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that exist from the position on and before it."""
        tail = records[:, self.width - 4 :].astype(np.int64)
        return tail[:, 0] << 8 | tail[:, 1], tail[:, 2] << 8 | tail[:, 3]

    def bucket(self, records: np.ndarray, columns: Iterable[int] = range(GRAM), salt: int = 0) -> np.ndarray:
        h = np.full(len(records), salt, np.uint64)
        for k in columns:
            h = h * K1 + records[:, k]
        return (mix(h) % U(self.buckets)).astype(np.int64)

    def dealt(self, records: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(record, bucket) pairs: one of each record, but some of each that begins with a hot gram.

        A window that begins l bytes before a gram has l bytes before it and length - l from it on. With l between low and
        high, equal windows share at least `low` bytes before and length - high from the gram on, which make the key.
        """
        bucket, every = self.bucket(records), np.arange(len(records))
        if not len(hot) or not len(records):
            return every, bucket
        gram = _gram_hashes(np.ascontiguousarray(records[:, :GRAM]))[:, 0].view(np.int64)
        is_hot = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
        found = [(every[~is_hot], bucket[~is_hot])]
        after, before = self.reach(records)
        edges = [k * (self.before + 1) // PARTS for k in range(PARTS + 1)]
        for low, end in zip(edges, edges[1:]):
            ahead = self.length - (end - 1)
            own = np.flatnonzero(is_hot & (after >= ahead) & (before >= low))
            found.append((own, self.bucket(records[own], [*range(ahead), *range(self.length, self.length + low)], low + 1)))
        which, where = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((which, where))
        return which[order], where[order]


def _ordered(records: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(records).view(f"S{records.shape[1]}").ravel(), kind="stable")


EXCHANGE = "bucket int, run binary, doc_id long, start long, stop long"


def _runs(layout: _Suffixes, hot: np.ndarray):
    """Sorted front-coded runs by bucket, and spans that repeat an earlier place of the same task."""
    names = [c.split()[0] for c in EXCHANGE.split(", ")]

    def sort(records: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        first = np.lexsort((places[:, 1], places[:, 0]))
        records, places = records[first], places[first]
        order = _ordered(records)
        records, places = records[order], places[order]
        again = np.zeros(len(records), bool)
        again[1:] = (records[1:] == records[:-1]).all(1)
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(records))))
        again &= (places != places[lead]).any(1)
        after, before = layout.reach(records)
        start = places[:, 1] - before
        stop = places[:, 1] + after
        spans = again & (stop - start >= layout.length)
        keep = np.flatnonzero(lead == np.arange(len(records)))
        records_kept, places_kept = records[keep], places[keep]
        which, bucket = layout.dealt(records_kept, hot)
        if not len(hot):
            by = np.argsort(bucket, kind="stable")
            which, bucket = which[by], bucket[by]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        runs = [front_code(records_kept[g], places_kept[g]) for g in np.split(which, cuts)] if len(which) else []
        done = merge_spans(np.stack([places[spans, 0], start[spans], stop[spans]], 1))
        ids, n = bucket[np.concatenate([[0], cuts])] if len(which) else bucket, len(done)
        salt = (mix(done[:, 0].astype(np.uint64)) % U(layout.buckets)).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([ids, salt]).astype(np.int32)), pa.array([*runs, *[None] * n], pa.binary()),
            *(pa.array(np.concatenate([np.zeros(len(runs), np.int64), done[:, k]])) for k in range(3)),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                anchors = part.column("anchors")
                at = anchors.flatten().to_numpy().astype(np.int64)
                docs = np.repeat(np.arange(part.num_rows), anchors.value_lengths().fill_null(0).to_numpy())
                ids = part.column("doc_id").to_numpy()
                for k in range(0, len(at), RUN // 4):
                    d, a = docs[k : k + RUN // 4], at[k : k + RUN // 4]
                    fits = a + GRAM <= offsets[d + 1] - offsets[d]
                    d, a = d[fits], a[fits]
                    held.append((layout.records(data, offsets[d], offsets[d + 1], offsets[d] + a), np.stack([ids[d], a], 1)))
                    if sum(len(x) for x, _ in held) >= RUN:
                        yield sort(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                        held = []
        if held:
            yield sort(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return run


def repeats(records: np.ndarray, lengths: np.ndarray, places: np.ndarray, layout: _Suffixes) -> np.ndarray:
    """(document, start, stop) rows under windows that start earlier elsewhere.

    records are sorted, `lengths` their common prefixes. A window that begins l
    bytes before a position is named by the class of its length - l following
    bytes and the class of its l preceding ones.
    """
    n, length = len(records), layout.length
    if n < 2:
        return np.zeros((0, 3), np.int64)
    after, before = layout.reach(records)
    left = records[:, length : length + layout.before]
    by_left = _ordered(left)
    left_shared = common_prefixes(left[by_left])
    rank = np.lexsort((places[:, 1], places[:, 0]))
    mask = np.zeros((n, layout.before + 1), bool)
    for l in range(layout.before + 1):  # noqa: E741
        equal = lengths >= length - l
        equal[0] = False
        paired = equal.copy()
        paired[:-1] |= equal[1:]
        paired &= (before >= l) & (after >= length - l)
        if paired.sum() < 2:
            continue
        right_class = np.cumsum(~equal)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.cumsum(left_shared < l)
        own = rank[paired[rank]]  # by place
        _, first, which = np.unique(right_class[own] * (n + 1) + left_class[own], return_index=True, return_inverse=True)
        lead = own[first[which]]
        mask[own, l] = (places[own] != places[lead]).any(1)
    edge = np.zeros((n, 1), np.int8)
    step = np.diff(np.concatenate([edge, mask.astype(np.int8), edge], 1), axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    at = places[row, 1]
    return merge_spans(np.stack([places[row, 0], at - (high - 1), at - low + length], 1))


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """(document, start, stop) rows with those that touch or overlap joined."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] != spans[:-1, 0]
    # running maxima of `stop` that start anew with each document
    group = np.cumsum(new)
    lift = group * (int(spans[:, 2].max()) + 1)
    stop = np.maximum.accumulate(spans[:, 2] + lift) - lift
    new[1:] |= spans[1:, 1] > stop[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(spans) - 1)
    return np.stack([spans[first, 0], spans[first, 1], stop[last]], 1)


def _merged(layout: _Suffixes):
    def spans(blobs: list[bytes]) -> np.ndarray:
        runs = [front_decode(x) for x in blobs]
        width = layout.width
        plain = []
        for records, shared, _ in runs:
            body = records.tobytes()
            plain.append(([body[i : i + width] for i in range(0, len(body), width)], shared.tolist()))
        order, lengths = merge_runs(plain)
        starts = np.cumsum([0, *(len(x) for x, _, _ in runs)])
        at = np.array([starts[r] + i for r, i in order], np.int64)
        records, places = np.concatenate([x for x, _, _ in runs])[at], np.concatenate([x for _, _, x in runs])[at]
        return repeats(records, np.array(lengths, np.int64), places, layout)

    def out(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)], names=["doc_id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            ready = batch.filter(batch.column("run").is_null())
            if ready.num_rows:
                yield ready.select(["doc_id", "start", "stop"])
            rest = batch.filter(batch.column("run").is_valid())
            for b, blob in zip(rest.column("bucket").to_pylist(), rest.column("run"), strict=True):
                if b != bucket and blobs:
                    yield out(spans(blobs))
                    blobs = []
                bucket = b
                blobs.append(blob.as_py())
        if blobs:
            yield out(spans(blobs))

    return run


def union_spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Maximal covered runs as (start, stop) rows."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return np.stack([start[new], stop[last]], 1)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows = []
            for text, spans in zip(part.column("text"), part.column("spans"), strict=True):
                body = text.as_py().encode()
                found = np.array([(x["start"], x["stop"]) for x in spans.as_py() or ()], np.int64).reshape(-1, 2)
                found = union_spans(found[:, 0], np.minimum(found[:, 1], len(body)))
                kept, at = [], 0
                for a, b in found.tolist():
                    kept.append(body[at:a])
                    at = b
                kept.append(body[at:])
                rest = b"".join(kept)
                rows.append((len(body), len(body) - len(rest), len(found), rest))
            n_bytes, removed, n_spans, rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut_texts(batches):
        digest = pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column("kept")], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], digest], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 100, hot: int = RUN) -> DataFrame:
    """(doc_id, start, stop): byte ranges under strings of `length` bytes that start earlier; they may overlap."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = _Suffixes(length, buckets)
    keyed = docs.select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n")).filter(F.col("n") >= length)
    sizes = keyed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("size"))
    firsts = cut(sizes.filter("least < most").drop("most"))
    copies = join_spread(keyed, firsts, hot_keys(firsts, "size"), "digest", "least", F.unhex(F.hex("doc_id"))).filter("doc_id > least").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))
    sampled = docs.mapInArrow(_sampled(length), "h long, doc_id long, at int, places int")
    shared = sampled.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated(hot), "doc_id long, at int, h long, n long")
    by_doc = cut(shared.groupBy("doc_id").agg(F.collect_set("at").alias("anchors"), F.collect_set(F.when(F.col("h").isNotNull(), F.struct("n", "h"))).alias("hot")))
    # at most one gram a hundred thousand places, cut to MOST_HOT before it leaves the executors; which ones changes no result
    told = by_doc.filter("doc_id IS NULL").select(F.slice(F.sort_array("hot", False), 1, MOST_HOT).alias("hot")).first()
    grams = np.sort(np.array([x["h"] for x in told["hot"]] if told else [], np.int64))
    anchors = by_doc.filter("doc_id IS NOT NULL").select("doc_id", "anchors").join(copies, "doc_id", "left_anti")
    # a left join like that in _with_spans, so that the texts are dealt by doc_id once
    runs = docs.join(anchors.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "anchors").mapInArrow(_runs(layout, grams), EXCHANGE)
    merged = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged(layout), "doc_id long, start long, stop long")
    return merged.unionByName(copies)


def _with_spans(docs: DataFrame, length: int, hot: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    missing = F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), missing).alias("doc_id"), text.alias("text"))
    spans = repeated_spans(own, length, hot).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return own.join(spans.hint("shuffle_hash"), "doc_id", "left").select(F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "text", "spans")


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = RUN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the remaining bytes."""
    return _with_spans(docs, length, hot).mapInArrow(_cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def summarize_repeats(docs: DataFrame, length: int = 100, hot: int = RUN) -> DataFrame:
    """As remove_repeats, with the digest of the remaining bytes."""
    return _with_spans(docs, length, hot).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
