"""Links and components of the n-gram Jaccard join against brute force, and its awkward rows."""

import random
import re

import pytest

from webloom.llm import jaccard_join
from webloom.llm.jaccard_join import JaccardJoin, bitmap

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def family(seed: int, size: int = 40) -> list[str]:
    """Texts that share passages and differ in a few words, so that pairs lie on both sides of the threshold."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = [r.choice(words) for _ in range(120)]
    texts = []
    for k in range(size):
        own = passage[: r.randint(60, 120)] + [r.choice(words) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    return texts + texts[:3]


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append(set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set())
    near = {d: set() for d in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                near[a].add(b)
                near[b].add(a)
    return near


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_links(spark, size, percent):
    texts = family(size) + ["", None, "one", "one", "two words", "ONE"]
    near = brute(texts, size, percent)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    join = JaccardJoin(table, size, percent)
    assert {r.doc_id: r.n_links for r in join.link_counts().collect()} == {d: len(x) for d, x in near.items()}
    label = {}
    for d in sorted(near):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = d
                todo += near[x]
    assert {r.doc_id: r.component_id for r in join.result().collect()} == label


def test_rows_without_id_and_repeated_ids(spark):
    same = " ".join(f"w{k}" for k in range(30))
    rows = [(None, same), (7, same), (8, f"{same} x"), (None, "nothing like it at all here"), (9, None), (10, "other text of nine"), (10, same), (11, "x y z"), (11, "x y z")]
    table = spark.createDataFrame([(d, t, "n", 3) for d, t in rows], "doc_id long, text string, node string, component long")
    got = sorted(((r.doc_id or -1, r.component_id) for r in jaccard_join.near_components(table, 3, 80).collect()), key=str)
    assert got == sorted([(-1, 7), (7, 7), (8, 7), (-1, None), (9, 9), (10, 10), (10, 7), (11, 11), (11, 11)], key=str)
    kept = jaccard_join.keep_one(table, 3, 80)
    assert kept.columns == table.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 7, 9, 11, 11]


def test_bitmap_bounds_the_difference(spark):
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(1)
    for n, extra in ((10, 3), (300, 280), (700, 0), (1000, 60)):
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - 5], r.integers(0, 2**63, extra, dtype=np.uint64)])
        row = spark.createDataFrame([(bitmap(x, 80).tolist(), bitmap(y, 80).tolist())], "x array<long>, y array<long>")
        assert row.select(jaccard_join.differing_bits(F.col("x"), F.col("y"), 80).alias("d")).first().d <= 5 + extra
