"""Two tokenizers' tokens of the same text, aligned by bytes; equal segments are tokenised and aligned once.

A is a byte-level BPE file of `tokenizers`, B a SentencePiece BPE model that adds
a space in front, so both read space + text. Texts are split before runs of white
space. That is safe where the vocabularies show it (`separable`): A's pattern
starts a new piece there, and no piece of B (nor token of A) has white space
after anything else, so no merge can cross the place; then the tokens of a text
are those of its segments in order, and each place ends a token of both. A split
needs an ASCII space behind a character that no one takes for white space, since
B then adds to a segment, in front, just the space that the split took away.
Files that do not show this are used without splits.

One task reads a run of texts of up to BLOCK_BYTES, a block, and asks for each
of its distinct segments once, dealt by hash to buckets; what one bucket is asked
by all blocks is at most about BUCKET_BYTES of text, as the number of buckets
follows the bytes of the corpus. A bucket tokenises and aligns each of its
distinct segments once and answers each block in the order asked. Answers join
their block's texts, documents are composed of them, and each block tells how
many of its documents hold which linked pair of ids. These sums, added up over
the corpus, go back to the blocks that hold the pair. No task holds
more than a block, or what a bucket is asked.

A text with a segment whose tokens do not spell it is tokenised and compared
whole. Both plans of a block read the same rows, so `docs` should be a table or a
checkpoint; a block whose answers were made for other rows raises an error
instead of giving wrong rows. Segments of one block are told apart by 64-bit
hashes, those of a bucket by their bytes.

Edge cases: null and empty texts, and texts whose tokens do not spell space +
text, have no tokens: zeros and ''. A row without an id stays; repeated rows and
ids keep one result row each and count as documents each. A text longer than a
block is a block of its own; one without spaces is one segment. An empty table
gives an empty result. Other columns of `docs` do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import K0, SLICE_BYTES, ByteHash, cut, give_back, members, mix, slices, utf8

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
#: (Document, link) entries that a block sorts at a time.
ENTRIES = 1 << 19
#: B's stand-in for a space.
SPACE_MARK = "▁"
#: ASCII that some library takes for white space.
BLANK = members(lambda b: 9 <= b <= 13 or 28 <= b <= 32)
#: UTF-8 of other white space, of what was or may count as such, and of B's mark: fixed values.
WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x2581, 0x3000, 0xFEFF)]
SENT = "block long, bucket int, sign long, payload binary"
#: Ids of a segment, and its links in order: 1 where a token of A ends behind one, 2 for B, 3 for both. Without links, its tokens do not spell it.
ANSWER = pa.schema([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("links", pa.list_(pa.int8()))])
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
COMPOSED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def packed(batch: pa.RecordBatch) -> bytes:
    raw = batch.serialize()
    return raw.size.to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), schema)


class Tokenizers:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        from .piece_tokens import _byte_of_character

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of_character()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.b_space = self.b.piece_to_id(SPACE_MARK)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode(self, segments: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments that start with the added space or the space of a split."""
        texts = [s.decode() for s in segments]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [x if len(t) > 1 else [self.b_space] for x, t in zip(b, texts, strict=True)]

    def aligned(self, segments: list[bytes]) -> pa.RecordBatch:
        """One row of ANSWER for each segment."""
        a, b = self.encode(segments)
        spelled = [b"".join([self.a_bytes[i] for i in x]) == s == b"".join([self.b_bytes[i] for i in y]) for x, y, s in zip(a, b, segments, strict=True)]
        n_a, n_b = (np.array([len(x) if ok else 0 for x, ok in zip(t, spelled, strict=True)], np.int64) for t in (a, b))
        flat_a, flat_b = (np.array([i for x, ok in zip(t, spelled, strict=True) if ok for i in x], np.int64) for t in (a, b))
        # all segments end to end: each stretch between neighbouring ends lies in one token of each, and each overlap is one stretch
        end_a, end_b = np.cumsum(self.a_sizes[flat_a]), np.cumsum(self.b_sizes[flat_b])
        ends = np.union1d(end_a, end_b)
        links = np.isin(ends, end_a).astype(np.int8) + 2 * np.isin(ends, end_b).astype(np.int8)
        last = np.cumsum([len(s) if ok else 0 for s, ok in zip(segments, spelled, strict=True)])
        lists = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets]), pa.int32()), pa.array(values, kind))
        columns = [lists(np.cumsum(n_a), flat_a, pa.int32()), lists(np.cumsum(n_b), flat_b, pa.int32()), lists(np.searchsorted(ends, last, "right"), links, pa.int8())]
        return pa.RecordBatch.from_arrays(columns, schema=ANSWER)


class Alignments:
    """Counts, pairs and texts of rows of ANSWER."""

    def __init__(self, answers: pa.Table) -> None:
        (a, a_at), (b, b_at), (links, self.at) = (_flat(answers.column(c).combine_chunks() if answers.num_rows else pa.array([], ANSWER.field(c).type)) for c in ("a", "b", "links"))
        self.n_a, self.n_b, self.n_links = np.diff(a_at), np.diff(b_at), np.diff(self.at)
        ends_a, ends_b = np.cumsum(links & 1, dtype=np.int64), np.cumsum(links >> 1, dtype=np.int64)
        self.codes, self.code = np.unique(a[ends_a - (links & 1)].astype(np.int64) << 32 | b[ends_b - (links >> 1)], return_inverse=True)
        both = np.flatnonzero(links == 3)
        self.group_at = np.searchsorted(both, self.at)
        self.n_groups = np.diff(self.group_at)
        name = list(map(str, range(1 + max(int(a.max(initial=0)), int(b.max(initial=0))))))
        name_a, name_b = ([name[k] for k in x.tolist()] for x in (a, b))
        groups, i, j = [], 0, 0
        for p, q in zip(ends_a[both].tolist(), ends_b[both].tolist(), strict=True):
            groups.append(name_a[i] + "|" + name_b[j] if p - i == q - j == 1 else ",".join(name_a[i:p]) + "|" + ",".join(name_b[j:q]))
            i, j = p, q
        at = self.group_at.tolist()
        self.texts = [";".join(groups[x:y]) for x, y in zip(at, at[1:], strict=False)]


@lru_cache(1)
def loaded(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def separable(a_path: str, b_path: str) -> bool:
    """Whether no merge of either file can cross a place before white space: see the module's docstring."""
    t = loaded(a_path, b_path)
    described = json.loads(Path(a_path).read_text())
    pre = described.get("pre_tokenizer") or {}
    by_pattern = described.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
    crosses = lambda token: re.search(r"\S ", token.decode(errors="replace"))
    probe = "a  b \n c \t"  # neither strips nor folds white space, and puts one space in front
    kept = b"".join(t.b_bytes[i] for i in t.b.encode(probe)) == b" " + probe.encode()
    return by_pattern and kept and t.b_space != t.b.unk_id() and not any(map(crosses, t.a_bytes)) and not any(map(crosses, t.b_bytes))


class Segments:
    """Where segments of space + text start, and their hashes."""

    def __init__(self, split: bool) -> None:
        self.split, self.hash = split, ByteHash(members(lambda b: True))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of space + text, starts, ends, hashes, first segment of each text); null and empty texts have none."""
        texts = texts.fill_null("")
        data, offsets = utf8(pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")))
        some = np.diff(offsets) > 1
        at = np.zeros(0, np.int64)
        if self.split and len(data) > 1:
            at = np.flatnonzero((data[1:] == 32) & ~BLANK[data[:-1]]) + 1
            inner = np.ones(len(data) + 1, bool)
            inner[offsets] = False  # the added space
            inner[offsets[1:] - 1] = False  # a last space alone would leave B nothing to read
            at = at[inner[at]]
            wide = np.flatnonzero(data[at - 1] >= 128)
            for blank in WIDE_BLANKS:
                end = at[wide]
                same = np.ones(len(end), bool)
                for back, byte in enumerate(reversed(blank), 1):
                    same &= data[np.maximum(end - back, 0)] == byte
                wide = wide[~same] if same.any() else wide
            keep = data[at - 1] < 128
            keep[wide] = True
            at = at[keep]
        starts = np.sort(np.concatenate([offsets[:-1][some], at]))
        ends = _ends(starts, offsets)
        return data, starts, ends, self.hash.spans(data, starts, ends), np.searchsorted(starts, offsets)


def _ends(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The end of each segment: the next start, or the end of its text if that comes first."""
    text_end = offsets[np.searchsorted(offsets, starts, "right")] if len(starts) else starts
    return np.minimum(np.append(starts[1:], np.iinfo(np.int64).max), text_end) if len(starts) else starts


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number, rows) of runs of rows with up to `most` bytes of text, or a single row; a number holds the partition's."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for part in slices(batch, limit=min(most, SLICE_BYTES)):
            n = part.column("text").nbytes
            if held and size + n > most:
                yield number, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                number, held, size = number + 1, [], 0
            held.append(part)
            size += n
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    give_back()


def _questions(unique: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of a block's distinct segments by bucket, then hash; where each bucket's begin)."""
    bucket = (mix(unique * K0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _sign(unique: np.ndarray) -> int:
    """Tells a block's set of segments from that of other rows under the same number."""
    return int(np.bitwise_xor.reduce(mix(unique), initial=np.uint64(len(unique))).astype(np.int64))


def _ask(split: bool, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(split)
        for number, rows in _blocks(batches, most):
            data, starts, ends, hashes, _ = segments.find(rows.column("text"))
            unique, where = np.unique(hashes, return_index=True)
            order, begin = _questions(unique, buckets)
            sign, body = _sign(unique), memoryview(data)
            for k in np.flatnonzero(np.diff(begin)).tolist():
                asked = where[order[begin[k] : begin[k + 1]]]
                texts = pa.array([body[s:e].tobytes() for s, e in zip(starts[asked].tolist(), ends[asked].tolist(), strict=True)], pa.binary())
                payload = packed(pa.RecordBatch.from_arrays([texts], names=["segment"]))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([k], pa.int32()), pa.array([sign]), pa.array([payload], pa.binary())], names=["block", "bucket", "sign", "payload"])

    return run


def _answer(a_path: str, b_path: str):
    asked_schema = pa.schema([("segment", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        t = loaded(a_path, b_path)
        asked = [unpacked(x.as_py(), asked_schema).column(0) for x in table.column("payload")]
        whole = pa.chunked_array(asked).combine_chunks().dictionary_encode()
        parts, known = [], whole.dictionary.to_pylist()
        for at in range(0, len(known), 20_000):
            parts.append(t.aligned(known[at : at + 20_000]))
        answers = pa.Table.from_batches(parts, ANSWER).combine_chunks().to_batches()[0]
        at, payloads = 0, []
        for x in asked:
            payloads.append(packed(answers.take(whole.indices.slice(at, len(x)))))
            at += len(x)
        give_back()
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(payloads, pa.binary()))

    return run


def _texts(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _blocks(batches, most):
            rows = rows.select(["doc_id", "text"]).cast(DOCUMENTS)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(rows)], pa.binary())], names=["block", "texts"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), np.int64))])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start .. start + size - 1, in order."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _compose(a_path: str, b_path: str, split: bool, buckets: int):
    """A block's texts and answers to one row: its documents and, for each linked pair of ids, how many of them hold it."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        loaded.cache_clear()  # of an earlier stage in this process; few blocks need them
        give_back()
        rows = unpacked(left.column("texts")[0].as_py(), DOCUMENTS)
        data, starts, ends, hashes, first = Segments(split).find(rows.column("text"))
        unique, kind = np.unique(hashes, return_inverse=True)
        order, begin = _questions(unique, buckets)
        got = sorted(zip(right.column("bucket").to_pylist(), right.column("sign").to_pylist(), right.column("payload").to_pylist(), strict=True), key=lambda x: x[0])
        answers = pa.Table.from_batches([unpacked(x[2], ANSWER) for x in got], ANSWER).combine_chunks()
        if answers.num_rows != len(unique) or any(x[1] != _sign(unique) for x in got):
            raise ValueError(f"block {key[0]}: the answers are not for these rows; docs should give the same rows whenever it is read")
        # answers come by bucket, then hash; from here on a segment's number is its answer's
        seat = np.empty(len(unique), np.int64)
        seat[order] = np.arange(len(unique))
        kind = seat[kind]
        del seat, unique, order
        n_docs, docs = rows.num_rows, np.repeat(np.arange(rows.num_rows), np.diff(first))
        # a text with a segment that is not spelled is read whole, and its segments are put aside for that one
        whole = np.unique(docs[(np.asarray(pc.list_value_length(answers.column("links"))) == 0)[kind]]) if len(kind) else docs
        if len(whole):
            extra = loaded(a_path, b_path).aligned([b" " + rows.column("text")[int(d)].as_py().encode() for d in whole])
            stays = ~np.isin(docs, whole)
            kind, docs = np.concatenate([kind[stays], answers.num_rows + np.arange(len(whole))]), np.concatenate([docs[stays], whole])
            back = np.argsort(docs, kind="stable")
            kind, docs = kind[back], docs[back]
            first = np.searchsorted(docs, np.arange(n_docs + 1))
            answers = pa.Table.from_batches([*answers.to_batches(), extra], ANSWER)
        known = Alignments(answers)
        del answers, got, data, starts, ends, hashes
        total = lambda per: np.bincount(docs, per[kind], n_docs).astype(np.int64)
        totals = [total(x) for x in (known.n_a, known.n_b, known.n_groups, known.n_links)]
        digests = [_digest([known.texts[i] for i in kind[a:b].tolist()]) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
        held = np.zeros(len(known.codes), np.int64)
        lists, sizes = [], []
        so_far = np.concatenate([[0], np.cumsum(totals[3])])
        d = 0
        while d < n_docs:
            to = max(d + 1, int(np.searchsorted(so_far, so_far[d] + ENTRIES, "right")) - 1)
            which, times, n = _document_pairs(known, docs[first[d] : first[to]] - d, kind[first[d] : first[to]], to - d)
            held += np.bincount(which, minlength=len(held))
            lists.append((which.astype(np.int32), times.astype(np.int32)))
            sizes.append(n)
            d = to
        offsets = pa.array(np.concatenate([[0], *sizes]).cumsum(), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *(x[k] for x in lists)]))) for k in (0, 1)]
        made = [rows.column("doc_id"), *map(pa.array, totals), pa.array(digests, pa.string()), *lists]
        pairs = pa.RecordBatch.from_arrays([pa.array(known.codes, pa.int64()), pa.array(held)], names=["pair", "n"])
        give_back()
        return pa.table({"block": [key[0].as_py()], "documents": pa.array([packed(pa.RecordBatch.from_arrays(made, schema=COMPOSED))], pa.binary()), "pairs": pa.array([packed(pairs)], pa.binary())})

    return run


def _document_pairs(known: Alignments, docs: np.ndarray, kind: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in `codes`, how often) of the linked pairs of each document, one document after another, and how many each has."""
    n_kinds, n_codes = max(1, len(known.n_links)), max(1, len(known.codes))
    seen, times = np.unique(docs * n_kinds + kind, return_counts=True)
    doc, segment = np.divmod(seen, n_kinds)
    sizes = known.n_links[segment]
    code = known.code[_ranges(known.at[segment], sizes)] if len(segment) else segment
    entries, place = np.unique(np.repeat(doc, sizes) * n_codes + code, return_inverse=True)
    owner, which = np.divmod(entries, n_codes)
    return which, np.bincount(place, np.repeat(times, sizes), len(entries)), np.bincount(owner, minlength=n_docs)


def _digest(groups: list[str]) -> str:
    said = ";".join(x for x in groups if x)
    return hashlib.sha256(said.encode()).hexdigest() if said else ""


_PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pair, n) of each block's pairs."""
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("pairs"), strict=True):
            pairs = unpacked(payload.as_py(), _PAIRS)
            for at in range(0, pairs.num_rows, 1 << 16):
                part = pairs.slice(at, 1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array([block] * part.num_rows, pa.int64()), *part.columns], names=["block", "pair", "n"])


def _score(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of their pairs."""
    rows = unpacked(left.column("documents")[0].as_py(), COMPOSED)
    codes = np.asarray(unpacked(left.column("pairs")[0].as_py(), _PAIRS).column("pair"))
    order = np.argsort(np.asarray(right.column("pair")))
    if right.num_rows != len(codes):
        raise ValueError(f"block {key[0]}: {right.num_rows} counts for {len(codes)} pairs")
    n, best = np.asarray(right.column("n"))[order], np.asarray(right.column("best"))[order].astype(np.int64)
    which, at = _flat(rows.column("pairs"))
    times = np.asarray(rows.column("times").flatten(), np.int64)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[which] * times)])[at])
    keep = {f.name: rows.column(f.name) for f in COMPOSED if f.name not in ("pairs", "times")}
    return pa.table({**keep, "n_best": pa.array(total(best)), "count_sum": pa.array(total(n))}).select([c.split()[0] for c in OUT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: see OUT."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    split = separable(a_path, b_path)
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-n_bytes // bucket_bytes))
    asked = rows.mapInArrow(_ask(split, buckets, block_bytes), SENT)
    answered = asked.groupBy("bucket").applyInArrow(_answer(a_path, b_path), SENT)
    texts = rows.mapInArrow(_texts(block_bytes), "block long, texts binary")
    composed = cut(texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_compose(a_path, b_path, split, buckets), "block long, documents binary, pairs binary"))
    held = composed.select("block", "pairs").mapInArrow(_pair_rows, "block long, pair long, n long")
    counts = held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = held.select("block", "pair").join(known, "pair")
    return composed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score, OUT)
