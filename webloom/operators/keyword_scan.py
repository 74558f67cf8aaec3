"""Keyword rule sets of any size: automata of all words, read once a text.

The words of many rules are put into Aho-Corasick automata, one for each pair of position and case; a text is read once by each
that has words, and only regular expressions of rules before the first failing one are tried. No row carries rules. What an earlier
rule of the scope decides alike goes before anything is sent (`decisive`). The rest travels in parts of at most PART_CHARS
characters, each a broadcast of a checked size. One part takes one pass as the texts are read; more parts take passes of their
own over a checkpoint of the texts, never two in one task, so a larger table takes more passes and never a larger task.

rules: as in keyword_rules; `regex` is Python's here, and one that cannot be compiled never matches. A text meets the enabled
rules of its domain by name, then the global ones by name; the first that fails gives the reason.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.lineage import cut

#: Characters of rules that one broadcast holds at most, each string counting as STRING more (a single rule may be longer).
#: A worker's automata take some 30 bytes for each.
PART_CHARS, STRING = 2_000_000, 16
GLOBAL, NONE = 1 << 62, (1 << 63) - 1


class Rule(NamedTuple):
    rank: int
    scope: str
    name: str
    include: tuple
    exclude: tuple
    regex: tuple
    exact: bool
    position: str


def target(text: str, position: str) -> str:
    if position == "title":
        return text.split("\n", 1)[0].lstrip("#").strip()
    return text.partition("\n")[2] if position == "body" else text


class Words:
    """What the words found in a target say of each scope's rules."""

    def __init__(self) -> None:
        #: word -> scope -> (rank, place) of the first rule that excludes it, and ranks of the rules that include it
        self.excludes: dict[str, dict[str, tuple[int, int]]] = defaultdict(dict)
        self.includes: dict[str, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))

    def add(self, rule: Rule, fold) -> None:
        for place, word in enumerate(map(fold, rule.exclude)):
            self.excludes[word].setdefault(rule.scope, (rule.rank, place))
        for word in map(fold, rule.include):
            self.includes[word][rule.scope].add(rule.rank)

    def build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for word in {*self.excludes, *self.includes} - {""}:
            self.automaton.add_word(word, word)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> set[str]:
        hits = {word for _, word in self.automaton.iter(text)} if len(self.automaton) else set()
        return hits | {""}


class Scanner:
    """A part of the rules, in order; its automata are built where it is used."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules, self.words = rules, None

    def __getstate__(self) -> dict:
        return {"rules": self.rules, "words": None}

    def _build(self) -> None:
        self.words = defaultdict(Words)
        self.including, self.matching = defaultdict(list), defaultdict(list)
        self.by_rank = {r.rank: r for r in self.rules}
        for r in self.rules:
            self.words[r.position, r.exact].add(r, str if r.exact else str.lower)
            if r.include:
                self.including[r.scope].append(r.rank)
            if r.regex:
                self.matching[r.scope].append(r.rank)
        for w in self.words.values():
            w.build()
        self.patterns: dict[int, list] = {}

    def _matches(self, rule: Rule, text: str) -> bool:
        if rule.rank not in self.patterns:
            self.patterns[rule.rank] = []
            for x in rule.regex:
                try:
                    self.patterns[rule.rank].append(re.compile(x, 0 if rule.exact else re.IGNORECASE))
                except re.error:
                    continue
        return any(p.search(text) for p in self.patterns[rule.rank])

    def first_failure(self, text: str, scopes: list[str]) -> tuple[int, str] | None:
        """(rank, reason) of the first rule of the first scope that rejects the text."""
        if self.words is None:
            self._build()
        targets = {p: target(text, p) for p in {p for p, _ in self.words}}
        hits = [(w, w.found(targets[p] if exact else targets[p].lower())) for (p, exact), w in self.words.items()]
        for scope in scopes:
            excluded, included = (NONE, 0), set()
            for w, words in hits:
                for word in words:
                    if word in w.excludes:
                        excluded = min(excluded, w.excludes[word].get(scope, excluded))
                    if word in w.includes:
                        included |= w.includes[word].get(scope, set())
            missing = next((r for r in self.including.get(scope, ()) if r not in included), NONE)
            bound = min(excluded[0], missing)
            ranks = self.matching.get(scope, [])
            for rank in ranks[: bisect_left(ranks, bound)]:
                rule = self.by_rank[rank]
                if not self._matches(rule, targets[rule.position]):
                    return rank, f"regex_not_matched (rule={rule.name})"
            if bound < NONE:
                rule = self.by_rank[bound]
                if excluded[0] == bound:
                    return bound, f"excluded_keyword: {rule.exclude[excluded[1]]!r} (rule={rule.name})"
                return bound, f"include_not_matched (rule={rule.name})"
        return None


def decisive(rules: DataFrame) -> DataFrame:
    """The enabled rules without what an earlier rule of the scope decides alike, in up to three rows each: by `step` words that exclude, words to include, expressions."""
    same = ["scope", "match_position", "case_sensitive"]
    own = [F.col("scope"), F.coalesce("match_position", F.lit("any")).alias("match_position"), F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"), F.col("name")]
    r = rules.filter("enabled AND scope IS NOT NULL").select(*own, *(F.array_compact(c).alias(c) if c != "exclude" else F.col(c) for c in ("include", "exclude", "regex")))
    none = F.array().cast("array<string>")

    first = r.select(*same, "name", F.posexplode("exclude").alias("place", "word")).filter("word IS NOT NULL").groupBy(*same, "word").agg(F.min(F.struct("name", "place")).alias("first"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("first.place", "word"))), lambda x: x["word"])
    rows = first.groupBy(*same, F.col("first.name").alias("name")).agg(words.alias("exclude")).select(*same, "name", F.lit(0).alias("step"), none.alias("include"), "exclude", none.alias("regex"))
    for step, c in ((1, "include"), (2, "regex")):
        got = r.filter(F.size(c) > 0).groupBy(*same, F.array_sort(F.array_distinct(c)).alias("_all")).agg(F.min("name").alias("name"))
        rows = rows.unionByName(got.select(*same, "name", F.lit(step).alias("step"), *((F.col("_all") if k == c else none).alias(k) for k in ("include", "exclude", "regex"))))
    return rows


def parts(rules: DataFrame, chars: int = PART_CHARS) -> Iterator[list[Rule]]:
    """The decisive rules by scope and name, in lists of at most so many characters."""
    some, size = [], 0
    ordered = decisive(rules).orderBy("scope", "name", "step")
    for rank, r in enumerate(ordered.toLocalIterator(prefetchPartitions=True)):
        rule = Rule(rank, sys.intern(r.scope), r.name, *map(tuple, (r.include, r.exclude, r.regex)), r.case_sensitive, sys.intern(r.match_position))
        n = sum(len(x or "") + STRING for x in (*rule.include, *rule.exclude, *rule.regex, rule.name))
        if some and size + n > chars:
            yield some
            some, size = [], 0
        some.append(rule)
        size += n
    if some:
        yield some


def filtered(docs: DataFrame, rules: DataFrame, text: str = "text", chars: int = PART_CHARS) -> DataFrame:
    """docs (domain, text, ...) with `reason`, null for those that pass the rules of their domain and the global ones; an empty text passes."""
    held = [docs.sparkSession.sparkContext.broadcast(Scanner(some)) for some in parts(rules, chars)]
    if not held:
        return docs.withColumn("reason", F.lit(None).cast("string"))
    if len(held) == 1:
        return docs.mapInArrow(_reasons(held[0], text), StructType([*docs.schema.fields, StructField("reason", StringType())]))
    kept = cut(docs.withColumn("_id", F.monotonically_increasing_id()))
    asked = kept.select("_id", text, "domain")
    found = reduce(DataFrame.unionAll, (asked.mapInArrow(_failures(part, text), "_id long, rank long, reason string") for part in held))
    first = found.groupBy("_id").agg(F.min_by("reason", "rank").alias("reason"))
    return kept.join(first, "_id", "left").select(*docs.columns, "reason")


def _told(scanner: Scanner, batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, str] | None]:
    """(rank, reason) of each text of a batch; the rules of its domain come before the global ones."""
    for said, domain in zip(batch.column(text).to_pylist(), batch.column("domain").to_pylist(), strict=True):
        own = f"domain:{domain}"
        found = scanner.first_failure(said, [own, "global"]) if said else None
        yield found and (found[0] if scanner.by_rank[found[0]].scope == own else GLOBAL + found[0], found[1])


def _reasons(held, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [found and found[1] for found in _told(held.value, batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reasons, pa.string())], names=[*batch.schema.names, "reason"])

    return run


def _failures(held, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = [(i, *found) for i, found in zip(batch.column("_id").to_pylist(), _told(held.value, batch, text), strict=True) if found]
            ids, ranks, reasons = zip(*failed, strict=True) if failed else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ranks, pa.int64()), pa.array(reasons, pa.string())], names=["_id", "rank", "reason"])

    return run
