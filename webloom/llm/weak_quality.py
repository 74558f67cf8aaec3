"""Quality filtering by weak supervision.

Rules look at surface statistics of a text and vote good (1), bad (0) or
abstain (-1). Only the counts of distinct vote patterns leave the executors
(at most 3**len(RULES) of them, whatever the corpus size); expectation
maximisation over these counts estimates, for each rule, how often it votes
what on good and on bad documents, and each document is kept when its
posterior probability of being good reaches `threshold`. So one bad vote of a
rule that often objects to what all others approve of does not reject a
document, and weak bad votes that come together do.

Edge cases: a null text is an empty one; it has no words, so it fails the base
test and is not kept. Rows with null or repeated ids give one result row each,
and all rows count in the fit. Ties (a posterior equal to the threshold) are
kept. An empty table gives an empty result. Columns of `docs` other than the
named two do not matter. A text of any length is counted whole, and every rule
is a ratio that means the same at every length. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import K2, WORD_BYTES, ByteHash, cut, grams, members, mix, owner, per_document, slices, utf8

#: Fixed values of the base test.
SYMBOLS = b"#*$%&|<>"
#: Marks that belong to words of prose.
PROSE = b".,;:!?'\"()-"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_lower long, n_bangs long, n_distinct long, n_stops long, n_digits long, n_alnum long, n_odd long"
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch with one more column, a struct of counts."""
    words = ByteHash(WORD_BYTES)
    lines = ByteHash(members(lambda b: b != 10))
    symbol = members(lambda b: b in SYMBOLS)
    lead = members(lambda b: b & 0xC0 != 0x80)
    upper, lower = members(lambda b: 65 <= b <= 90), members(lambda b: 97 <= b <= 122)
    # letters of other scripts count by their first byte
    alnum, plain = members(lambda b: b >= 0xC0 or b < 128 and chr(b).isalnum()), members(lambda b: b >= 128 or chr(b).isalnum() or b in PROSE)
    bang, stop, digit = members(lambda b: b == 33), members(lambda b: b in b".?!"), members(lambda b: 48 <= b <= 57)
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def distinct(hashes: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        keys = mix(hashes + docs.astype(np.uint64) * K2)
        _, at = np.unique(keys, return_index=True)
        return np.bincount(docs[at], minlength=n)

    for batch in batches:
        for part in slices(batch):
            data, offsets = utf8(part.column("text"))
            n = part.num_rows
            start, end, hashes, first = words.runs(data, offsets)
            docs = owner(first)
            n_words = np.diff(first)
            at, three = grams(hashes, docs, 3)
            keys = mix(three + docs[at].astype(np.uint64) * K2)
            _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
            repeated = at[times[which] > 1]
            marked = np.zeros(len(hashes) + 2, bool)
            for k in range(3):
                marked[repeated + k] = True
            line_start, line_end, line_hash, line_first = lines.runs(data, offsets)
            inside = np.zeros(len(data) + 1, np.int64)
            np.cumsum(WORD_BYTES[data], out=inside[1:])
            full = inside[line_end] > inside[line_start]
            odd = np.zeros(len(data) + 1, np.int64)
            np.cumsum(~plain[data], out=odd[1:])
            line_docs = owner(line_first)[full]
            n_lines = np.bincount(line_docs, minlength=n)
            columns = [
                n_words,
                per_document(WORD_BYTES[data] & lead[data], offsets),
                per_document(symbol[data], offsets),
                n_lines - distinct(line_hash[full], line_docs, n),
                per_document(marked[: len(hashes)], first),
                n_lines,
                per_document(upper[data], offsets),
                per_document(lower[data], offsets),
                per_document(bang[data], offsets),
                distinct(hashes, docs, n),
                per_document(stop[data[end - 1]] if len(end) else np.zeros(0, bool), first),
                per_document(digit[data], offsets),
                per_document(alnum[data], offsets),
                per_document(odd[end] > odd[start], first),
            ]
            counts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            yield pa.RecordBatch.from_arrays([*part.columns, counts], names=[*part.schema.names, "counts"])


def text_features(docs: DataFrame, name: str = "features") -> DataFrame:
    """docs with a struct of counts as column `name`; no shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(FEATURES))])
    return docs.mapInArrow(_features, schema)


def _vote(bad, good):
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules(name: str = "features") -> dict[str, F.Column]:
    """Named votes over `text_features`; a rule that cannot judge abstains."""
    c = lambda x: F.col(name)[x]
    n = c("n_words")
    letters, root = c("n_upper") + c("n_lower"), F.sqrt(n.cast("double"))
    # of order n**0.5 up to 20,000 words, n**0.4 beyond: the slowest growth of vocabularies in Heaps' law
    few = root * F.pow(F.lit(20000.0) / F.greatest(n, F.lit(20000)), F.lit(0.1))
    enough = lambda vote: F.when(n >= 30, vote).otherwise(-1)
    return {
        "markup": _vote(10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        "capitals": _vote(10 * c("n_upper") > 4 * letters, 10 * c("n_upper") <= 2 * letters),
        "exclamations": _vote(5 * c("n_bangs") > n, 20 * c("n_bangs") <= n),
        "windows": _vote(10 * c("n_repeat_words") > 3 * n, 20 * c("n_repeat_words") <= 3 * n),
        "lines": F.when(c("n_lines") >= 4, _vote(10 * c("n_dup_lines") > 3 * c("n_lines"), 20 * c("n_dup_lines") <= 3 * c("n_lines"))).otherwise(-1),
        "vocabulary": enough(_vote(2 * c("n_distinct") < 5 * few, c("n_distinct") >= 4 * few)),
        "sentences": enough(_vote((100 * c("n_stops") < n) | (2 * c("n_stops") > n), (50 * c("n_stops") >= n) & (3 * c("n_stops") <= n))),
        "words": enough(_vote((c("word_chars") < 2 * n) | (c("word_chars") > 15 * n), (c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n))),
        "letters": _vote(10 * c("n_alnum") < 9 * c("word_chars"), 100 * c("n_alnum") >= 94 * c("word_chars")),
        "odd words": _vote(10 * c("n_odd") > n, 50 * c("n_odd") <= n),
        "digits": _vote(10 * c("n_digits") > 3 * c("word_chars"), 10 * c("n_digits") <= c("word_chars")),
    }


#: Documents' worth of votes that the prior of each rule weighs, and its shares of bad votes on bad and on good documents.
PRIOR_WEIGHT, PRIOR_BAD = 100.0, (0.3, 0.01)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, weight: float = PRIOR_WEIGHT, prior_bad: tuple[float, float] = PRIOR_BAD) -> np.ndarray:
    """Posterior probability of good for each vote pattern.

    `patterns` (p, r) holds votes -1/0/1, `counts` (p,) how many documents voted
    so. Two classes, rules independent given the class, an abstention says
    nothing. Expectation maximisation starts from the rules' own votes; the prior
    (a fixed number of documents, whatever the corpus) says that a rule votes
    bad on more of the bad documents, so that class 1 stays the good one.
    """
    if not len(patterns):
        return np.zeros(0)
    votes = patterns + 1
    bad, good = (patterns == 0).sum(1), (patterns == 1).sum(1)
    posterior = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5)).astype(float)
    held = weight * np.array([[p, 1 - p] for p in prior_bad])
    for _ in range(rounds):
        share = np.stack([counts * (1 - posterior), counts * posterior])
        prior = (share.sum(1) + weight / 2) / (share.sum() + weight)
        log = np.tile(np.log(prior)[:, None], (1, len(patterns)))
        for r in range(patterns.shape[1]):
            table = np.stack([np.bincount(votes[:, r], share[k], 3)[1:] for k in (0, 1)]) + held
            said = np.log(table / table.sum(1, keepdims=True))
            log += np.concatenate([np.zeros((2, 1)), said], 1)[:, votes[:, r]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior


def base_failed(name: str = "features") -> F.Column:
    n = F.col(name)["n_words"]
    return (n < MIN_WORDS) | (100 * F.col(name)["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def with_quality(featured: DataFrame, name: str = "features", quality: str = "quality") -> DataFrame:
    """featured with the probability of good; the rules are fitted to all its rows that pass the base test."""
    named = rules(name)
    pattern = sum(((vote + 1) * 3**k for k, vote in enumerate(named.values())), F.lit(0)).cast("int")
    counted = featured.select(pattern.alias("pattern"), F.when(base_failed(name), 0).otherwise(1).alias("one")).groupBy("pattern").agg(F.sum("one").alias("count"))
    # at most 3**len(rules) rows, and so small enough for the driver and every worker at any corpus size
    seen = counted.orderBy("pattern").collect()
    codes = np.array([r["pattern"] for r in seen], np.int64)
    votes = np.stack([codes // 3**k % 3 - 1 for k in range(len(named))], 1)
    good = np.round(fit(votes, np.array([r["count"] for r in seen], float)), 12)
    table = featured.sparkSession.createDataFrame(list(zip(codes.tolist(), good.tolist(), strict=True)), f"`{quality}_pattern` int, `{quality}` double")
    return featured.withColumn(f"{quality}_pattern", pattern).join(F.broadcast(table), f"{quality}_pattern").drop(f"{quality}_pattern")


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality)."""
    # the counts are small beside the texts: written once, for the fit and for the verdicts
    featured = cut(text_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "features"))
    scored = with_quality(featured)
    counts = [F.col("features")[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return scored.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & (F.col("quality") >= threshold)).alias("kept"), "quality")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rejected ones; all columns stay, whatever their names."""
    name = "features"
    while any(x.startswith(name) for x in docs.columns):
        name = f"_{name}"
    scored = with_quality(text_features(docs, name), name, f"{name}_quality")
    return scored.filter(~base_failed(name) & (F.col(f"{name}_quality") >= threshold)).select(docs.columns)
