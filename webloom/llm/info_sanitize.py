"""Personal data by shape, and terms that give it away.

Base shapes (e-mail, IP, card, phone) are protected entities. For every term
near an entity, corpus counts say how strongly it reveals it; an entity is a
value (this address) or a kind (any address). Terms are all word runs of letters
and digits of any length, joined by inner underscores; scripts without spaces
are not divided further. With n(t, e) documents where t is one of the `window`
words before or after e, whatever stands between them, or a word of the name in
an e-mail address, n(t) documents with t and n(e) with e among N, the disclosure
is log2(n(t, e) * N / (n(t) * n(e))) bits at a probability
P(e | t) = n(t, e) / n(t). Terms above both thresholds, seen with the entity in
at least `support` different contexts (so that copies of a text prove nothing),
are spans of kind `term`, wherever they occur. A kind that over a sixty-fourth
of all documents hold can give no 6 bits, so that words like "mail" stay.

Edge cases: a null text is empty. Rows with null or repeated ids give one row
each. Ties in the counts change nothing, as thresholds are met or not. An empty
table gives an empty result; other columns, whatever their names, do not matter.
Offsets are code points; a text of any length is scanned whole, in time in
proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: As `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`, which can begin at the first digit of a run only; no run is read again from its middle.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W_]++(?:_++[^\W_]++)*+")
#: Terms up to this number go to every worker; more are joined instead.
BROADCAST_TERMS = 200_000
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer, in time proportional to the text: each @ has one run of characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            done = m.end()
            yield m.span()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [(0, s, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def _lower_words(text: str | None) -> set[str]:
    return {x.lower() for x in WORD.findall(text or "")}


def _contexts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    spans = base_spans(text) if text else []
                    near: dict[str, tuple[set[str], list[str]]] = {}
                    at = [m.span() for m in WORD.finditer(text)] if spans else []
                    starts, ends = [x for x, _ in at], [x for _, x in at]
                    for k, s, e in spans:
                        value = text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e])
                        before, after = bisect_right(ends, s), bisect_left(starts, e)
                        left, right = ([text[x:y].lower() for x, y in side] for side in (at[max(0, before - window) : before], at[after : after + window]))
                        name = _lower_words(value.split("@")[0]) if k == 0 else ()
                        for entity, inner in ((f"{k}:{value}", name), (f"any {k}", ())):
                            terms, around = near.setdefault(entity, (set(), []))
                            around += [*left, "|", *right]
                            terms.update(left, right, inner)
                    for entity, (terms, around) in near.items():
                        context = hashlib.blake2b(" ".join(around).encode(), digest_size=8).digest()
                        rows.append((hashlib.blake2b(entity.encode(), digest_size=8).digest(), context, sorted(terms)))
                columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.string()))], names=["entity", "context", "terms"])

    return run


def _term_counts(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column("text"):
                for term in wanted & _lower_words(text.as_py()):
                    counts[term] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = [sorted(_lower_words(x)) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "words"])


def revealing_terms(docs: DataFrame, window: int = 8, support: int = 3, bits: float = 6.0, probability: float = 0.5, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(term) whose corpus co-occurrence with some protected entity exceeds the thresholds."""
    near = cut(docs.select("text").mapInArrow(_contexts(window), "entity binary, context binary, terms array<string>"))
    pairs = near.withColumn("term", F.explode("terms")).groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = cut(pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("contexts")).filter(F.col("contexts") >= support))
    terms = pairs.select("term").distinct()
    n_terms = terms.count()
    if not n_terms:
        return terms
    if n_terms <= broadcast_terms:
        wanted = frozenset(r["term"] for r in terms.collect())
        counted = docs.select("text").mapInArrow(_term_counts(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    else:
        exploded = docs.select("doc_id", "text").mapInArrow(_words, "doc_id long, words array<string>").select(F.explode("words").alias("term"))
        counted = exploded.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")
    entities = near.groupBy("entity").agg(F.count("*").alias("n_e"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).collect()[0]["n"]
    told = pairs.join(entities, "entity").join(counted, "term")
    disclosure = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    return cut(told.filter((disclosure >= bits) & (F.col("n_te") >= probability * F.col("n_t"))).select("term").distinct())


def all_spans(text: str, terms: frozenset[str]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and term spans); a term inside a base span is none of its own."""
    base = base_spans(text)
    if not terms:
        return base, base
    starts, ends, furthest = [], [], 0
    for s, e in sorted((s, e) for _, s, e in base):
        furthest = max(furthest, e)
        starts.append(s)
        ends.append(furthest)
    more = []
    for m in WORD.finditer(text):
        if m[0].lower() in terms:
            before = bisect_left(starts, m.end())  # base spans that begin before the word ends
            if not before or ends[before - 1] <= m.start():
                more.append((len(KINDS), m.start(), m.end()))
    return base, base + more


def _apply(docs: DataFrame, terms: DataFrame, build: Callable, schema: str, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Runs build(batch, terms of each text) over docs; terms go to every worker, or by a join if there are many."""
    n_terms = terms.count()
    if n_terms <= broadcast_terms:
        wanted = frozenset(r["term"] for r in terms.collect())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    yield build(part, [wanted] * part.num_rows)

        return docs.mapInArrow(run, schema)
    free = "_"  # ends no column's name, so that none clashes
    while any(x.endswith(free) for x in docs.columns):
        free += "_"
    own = docs.select("doc_id", "text").mapInArrow(_words, "doc_id long, words array<string>").select("doc_id", F.explode("words").alias("term"))
    # rows that share an id, or have none, share their terms too: a term counts where it stands only
    own = own.join(terms, "term", "left_semi").groupBy(F.col("doc_id").alias(f"id{free}")).agg(F.collect_set("term").alias(f"terms{free}"))

    columns = docs.columns

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield build(part.select(columns), [frozenset(x or ()) for x in part.column(f"terms{free}").to_pylist()])

    return docs.join(own, F.col("doc_id").eqNullSafe(F.col(f"id{free}")), "left").drop(f"id{free}").mapInArrow(joined, schema)


def find(docs: DataFrame, broadcast_terms: int = BROADCAST_TERMS, **thresholds: float) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    names = (*KINDS, "term")

    def build(part: pa.RecordBatch, terms: list[frozenset[str]]) -> pa.RecordBatch:
        rows = []
        for text, own in zip(part.column("text").to_pylist(), terms, strict=True):
            base, spans = all_spans(text or "", own)
            said = [",".join(f"{names[k]}:{s}:{e}" for k, s, e in x) for x in (base, spans)]
            rows.append((*(sum(k == i for k, _, _ in base) for i in range(4)), hashlib.sha256(said[0].encode()).hexdigest(), said[1]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[c.split()[0] for c in SPANS.split(", ")])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _apply(own, revealing_terms(own, broadcast_terms=broadcast_terms, **thresholds), build, SPANS, broadcast_terms)


def sanitize(docs: DataFrame, broadcast_terms: int = BROADCAST_TERMS, **thresholds: float) -> DataFrame:
    """docs with every span of `text` replaced by its kind in brackets; other columns stay."""
    masks = tuple(f"[{k.upper()}]" for k in (*KINDS, "term"))

    def masked(text: str | None, terms: frozenset[str]) -> str | None:
        out, at = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in all_spans(text, terms)[1]) if text else ():
            if s >= at:
                out += [text[at:s], masks[k]]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    def build(part: pa.RecordBatch, terms: list[frozenset[str]]) -> pa.RecordBatch:
        texts = [masked(text, own) for text, own in zip(part.column("text").to_pylist(), terms, strict=True)]
        names = part.schema.names
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == "text" else part.column(x) for x in names], names=names)

    return _apply(docs, revealing_terms(docs, broadcast_terms=broadcast_terms, **thresholds), build, docs.schema, broadcast_terms)
