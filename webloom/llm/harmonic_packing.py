"""Harmonic packing of token sequences.

A document's ids are cut into pieces of length floor(capacity / k): the classes
of reciprocal capacity. A bin of class k takes exactly k pieces. What remains
below capacity / 32 goes, uncut, into the class k = capacity // length, whose
bins also take k pieces and waste less than 1 / (k + 1). Each worker fills its
own bins, so there is no shuffle; at its end the pieces of its unfinished bins
are cut on into full sequences, and only the last of these is padded.

Edge cases: a null or empty text is the closing id alone. Rows with repeated or
null ids are packed each. Pieces of the same length go into bins in the order in
which they come. An empty table gives an empty result. Other columns of `docs`
do not matter. A very long text is cut like any other; a worker holds one text
and its unfinished bins at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .piece_tokens import PieceTokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: From this class on, pieces keep their lengths.
FREE_CLASS = 32


def cut_lengths(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(class, length) of consecutive pieces of n ids."""
    while n:
        if n >= capacity:
            yield 1, capacity
            n -= capacity
            continue
        k = -(-capacity // n)
        if k > FREE_CLASS:
            yield capacity // n, n
            return
        yield k, capacity // k
        n -= capacity // k


class Bins:
    """The bins of one worker. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // 4
            yield doc, start, length, zlib.crc32(ids), total, self.next_id, offset
            offset += length
        self.next_id += 1

    def add(self, doc: int, ids: bytes) -> Iterator[tuple]:
        at, total = 0, len(ids) // 4
        for k, length in cut_lengths(total, self.capacity):
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, at, ids[4 * at : 4 * (at + length)], total))
            at += length
            if len(pieces) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """Cuts what is left, at most FREE_CLASS + capacity / FREE_CLASS unfinished bins, into full sequences."""
        room, now = self.capacity, []
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while ids:
                    part = ids[: 4 * room]
                    now.append((doc, start, part, total))
                    start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
                    if not room:
                        yield from self._close(now)
                        room, now = self.capacity, []
        if now:
            yield from self._close(now)
        self.open = {}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, closing_id: int = 1) -> DataFrame:
    """One row per piece; sequence ids are unique over all workers, offsets gapless in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PieceTokenizer(tokenizer_path)
        bins = Bins(capacity, TaskContext.get().partitionId() << 32)
        closing = closing_id.to_bytes(4, "little")
        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], schema=schema)

        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    rows += bins.add(doc, tokenizer.encode(text.as_py() or "") + closing)
                yield out(rows)
        yield out(list(bins.finish()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
