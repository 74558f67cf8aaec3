"""Secret scan: known shapes, and strings that a token vocabulary compresses badly.

Natural text and identifiers take many characters a token; random strings
take few. Candidates are all runs of 8 or more URL- and base64-safe characters,
with or without digits; '=' parts them, but belongs to one as trailing padding.
A run below `max_ratio` letters and digits a token is a secret; so is, if the
whole run is not, each path segment or part between separators of 8 or more
characters that is. Below 20 letters and digits the threshold falls in
proportion, to 0.75 of it at 8, and to 0.65 for words of one case: short words
vary more. Those count as they stand in prose, after a space and in lower case;
random letters of one case look so much like words that 31 % of them were found
at 8, 49 % at 12, 92 % at 16 and 99 % at 20 (of mixed letters and digits 98 % at
8), with 229 spans in 10,000 documents of invented prose.

Never secrets by this rule: UUIDs, dates with times, hex strings of the usual
digest lengths, runs of which over a quarter are separators, and runs without
letters (the vocabulary compresses random numbers as well as dates and counts).

Edge cases: a null text is empty and gives no spans. Rows with repeated or null
ids give one row each. Spans that start together come in the order of their
kinds; a ratio equal to the threshold is no secret. An empty table gives an
empty result; other columns do not matter. Offsets are code points; a text of
any length is scanned whole, in time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
#: Strings of which one is in every text that ASSIGN matches, in lower case.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Pieces of a run, tried in this order: the whole, its path segments, its parts between separators.
PIECES = (re.compile(".+"), re.compile("[^/]{8,}"), re.compile("[A-Za-z0-9]{8,}"))
PART = re.compile("[A-Za-z0-9]+")
ONE_CASE = re.compile("[A-Z]?[a-z]+|[A-Z]+")
DIGEST = re.compile("[0-9a-f]+|[0-9A-F]+")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
IDENTIFIER = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9+/_=-]+|[0-9]{8}T[0-9]{4}([0-9]{2})?Z?|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}")
#: Letters and digits from which on max_ratio is the threshold, and how slowly it falls below, for all words and for those of one case.
FULL, FALL = 20, (48, 34)
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes, by start and kind."""
    found = []
    lower = text.encode().lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"akia" in lower:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def vocabulary(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(word: str, tokens, max_ratio: float) -> bool:
    if IDENTIFIER.fullmatch(word) or len(word) in DIGEST_LENGTHS and DIGEST.fullmatch(word):
        return False
    parts = PART.findall(word)
    n = sum(map(len, parts))
    if 4 * n < 3 * len(word.rstrip("=")):
        return False
    count = sum(tokens(f" {x.lower()}" if ONE_CASE.fullmatch(x) else x) for x in parts)
    return n < max_ratio * (1 - max(0, FULL - n) / FALL[ONE_CASE.fullmatch(word) is not None]) * count


def random_spans(text: str, tokens, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of candidates with few characters a token; tokens(word) counts tokens."""
    found = []
    for m in CANDIDATE.finditer(text):
        for piece in PIECES:
            spans = [(m.start() + p.start(), m.start() + p.end()) for p in piece.finditer(m[0]) if is_random(p[0], tokens, max_ratio)]
            if spans:
                found += spans
                break
            if m[0].isalnum():
                break
    return found


def scan(docs: DataFrame, vocabulary_path: str, max_ratio: float = 2.2) -> DataFrame:
    """One row per document with counts, the digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_path)
        short = lru_cache(50_000)(lambda word: len(encoding.encode_ordinary(word)))
        tokens = lambda word: short(word) if len(word) <= 64 else len(encoding.encode_ordinary(word))
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    more = [(s, 3, e) for s, e in random_spans(text, tokens, max_ratio)]
                    names = (*KINDS, "random")
                    said = [",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans) for spans in (base, sorted(base + more))]
                    rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(said[0].encode()).hexdigest() if base else empty, said[1]))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)
