"""What five filters take from each part of a corpus, alone, together and in every order.

Each document has a mask of the filters that it fails. Per part, the counts of
masks are the values of a game on sets of filters: v(S), the documents that the
filters of S remove together. Its multilinear extension, the removal polynomial

    f(x) = sum over masks m of n[m] * (1 - product over i in m of (1 - x[i]))
         = sum over sets T of c[T] * product over i in T of x[i]

is formed from these counts. Its values at corners (x of 0 and 1) tell how many
documents a sequence of filters has removed so far, so a step's removals are the
difference of two corners. The Shapley value of filter i is the integral of the
partial derivative df/dx[i] along the diagonal x = (t, .., t): each monomial of
T with i in it gives c[T] * t**(|T| - 1), so c[T] / |T|, in exact rationals.
Times 120 it is the filter's removals summed over all orders of the five.

Texts are read once, without a shuffle; what is shuffled is a digest, an id and a
mask a document, to find equal texts, and at most 32 counts a part and task.
Digests of over a thousandth of all rows are joined by broadcast.

Edge cases: a null text is an empty one, a null source the part ''. A row without
an id is later than none, so it never fails E, is nobody's earlier copy, and has
no label. Rows that repeat an id and a text do not remove each other (neither id
is smaller). Of several labels of an id, one that says 1 counts. An empty table
gives an empty result; every part of a table has all its 600 rows, zeros
included. A text of any length is judged whole; its words are compared by 64-bit
hashes. Other columns of `docs` do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import K2, WORD_BYTES, ByteHash, cut, hot_keys, join_spread, members, mix, owner, per_document, slices, utf8

#: The filters in the order of their mask bits, and the fixed values of their conditions.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
SETS = 1 << len(FILTERS)
COUNTS = ("n", "good", "toxic")
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, digest, mask) with the bits of A to D, which need nothing but the text itself."""
    words = ByteHash(WORD_BYTES)
    upper, mark, lead = members(lambda b: 65 <= b <= 90), members(lambda b: b in MARKS), members(lambda b: b & 0xC0 != 0x80)
    for batch in batches:
        for part in slices(batch):
            data, offsets = utf8(part.column("text"))
            _, _, hashes, first = words.runs(data, offsets)
            docs, n_words = owner(first), np.diff(first)
            _, at = np.unique(mix(hashes + docs.astype(np.uint64) * K2), return_index=True)
            n_distinct = np.bincount(docs[at], minlength=part.num_rows)
            mask = (n_words < MIN_WORDS).astype(np.int32)
            mask |= (100 * n_distinct < DISTINCT_PERCENT * n_words).astype(np.int32) << 1
            mask |= (100 * per_document(upper[data], offsets) > UPPER_PERCENT * per_document(lead[data], offsets)).astype(np.int32) << 2
            mask |= (per_document(mark[data], offsets) > 0).astype(np.int32) << 3
            view = memoryview(data)
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(digests, pa.binary()), pa.array(mask, pa.int32())], names=["doc_id", "part", "digest", "mask"])


def failed(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): the filters that each row fails, A in the lowest bit."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    slim = cut(slim.mapInArrow(_masks, "doc_id long, part string, digest binary, mask int"))
    sizes = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copied = cut(sizes)
    rows = join_spread(slim, copied, hot_keys(copied), "digest", "first", F.unhex(F.hex("doc_id")))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of (doc_id, part, mask): all documents, and those that a label calls good or toxic."""
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic")).filter("quality = 1 or toxic = 1")
    everyone = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # rows without an id leave before the exchange; what is hot is split by adaptive execution, as nothing above needs a key's rows together
    marked = masks.join(told, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    return everyone.unionByName(marked).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


class RemovalPolynomial:
    """f(x) of the module's docstring, by its monomials' coefficients c[T]."""

    def __init__(self, counts: list[int]) -> None:
        # 1 - prod(1 - x[i], i in m) has the monomials T within m, not empty, with sign (-1)**(|T| + 1)
        self.coefficients = [0] * SETS
        for mask, n in enumerate(counts):
            part = mask if n else 0
            while part:
                self.coefficients[part] += n if part.bit_count() % 2 else -n
                part = (part - 1) & mask

    def corner(self, filters: int) -> int:
        """f where x is 1 for the filters of this set and 0 elsewhere: the documents that they remove together."""
        total, part = 0, filters
        while part:
            total += self.coefficients[part]
            part = (part - 1) & filters
        return total

    def shapley(self, i: int) -> Fraction:
        """Integral over t from 0 to 1 of df/dx[i] at (t, .., t)."""
        return sum((Fraction(c, part.bit_count()) for part, c in enumerate(self.coefficients) if part >> i & 1 and c), Fraction(0))


def audit_part(total: int, counts: dict[str, list[int]]) -> list[tuple]:
    """The rows of one part, without its name: 120 orders of 5 steps, from its counts by mask."""
    removed, good, toxic = ([RemovalPolynomial(counts[c]).corner(s) for s in range(SETS)] for c in COUNTS)
    scaled = [RemovalPolynomial(counts["n"]).shapley(i) * 120 for i in range(len(FILTERS))]
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now, alone, others = before | 1 << i, removed[1 << i], removed[(SETS - 1) ^ 1 << i]
            here = removed[now] - removed[before]
            rows.append((name, step, total - removed[now], here, alone - here, removed[SETS - 1] - others, good[now] - good[before], toxic[now] - toxic[before], int(scaled[i])))
            before = now
    return rows


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c.split()[0], pa.int64()) for c in OUT.split(", ")[3:])])
    for batch in batches:
        for row in batch.to_pylist():
            counts = {c: [0] * SETS for c in COUNTS}
            for x in row["masks"]:
                for c in COUNTS:
                    counts[c][x["mask"]] = x[c]
            columns = zip(*audit_part(sum(counts["n"]), counts), strict=True)
            rows = [pa.array(values, f.type) for f, values in zip(list(schema)[1:], columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(rows[0]), pa.string()), *rows], schema=schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: see OUT; `unique_fails` counts what fails this step's filter alone, whatever the order."""
    counts = mask_counts(failed(docs), labels)
    # at most 32 masks a part
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks")).mapInArrow(_audits, OUT)
