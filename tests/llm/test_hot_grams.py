"""Repeats around grams at very many places: the split of their suffixes changes no result."""

import hashlib
import random
import re

import numpy as np
import pytest

from webloom.llm import suffix_dedup


def texts(seed):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line = "a line of some sixty bytes, which stands in most of the documents"
    long = say(400)
    made = []
    for k in range(50):
        at = r.randrange(250)
        made.append(r.choice([say(r.randint(0, 160)) + line + say(r.randint(0, 160)), say(20) + line + long[at : at + r.randint(90, 140)], long[at : at + 120] + line + say(r.randint(0, 40)), line * r.randint(1, 4), say(150)]))
    return made + made[:3]


@pytest.mark.parametrize("hot", [2, 10, 10**6])
@pytest.mark.parametrize("parts", [1, 4])
def test_exact_whatever_is_hot(spark, hot, parts):
    made = texts(3)
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.summarize_repeats(table, hot=hot).collect()}
    seen, want = set(), {}
    for d, t in enumerate(made):
        body = t.encode()
        under = bytearray(len(body))
        for i in range(len(body) - 99):
            w = body[i : i + 100]
            if w in seen:
                under[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, u in zip(body, under) if not u)
        want[d] = (len(body), sum(under), len(re.findall(b"\1+", bytes(under))), hashlib.sha256(kept).hexdigest())
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


def test_suffixes_of_a_hot_gram_go_apart():
    r = random.Random(5)
    line = b"a line of some sixty bytes, which stands in most of the documents"
    layout = suffix_dedup._Suffixes(100, 64)
    data = b"".join(bytes(r.choice(b"abcdefgh") for _ in range(80)) + line + bytes(r.choice(b"abcdefgh") for _ in range(80)) for _ in range(2000))
    width = 160 + len(line)
    at = np.arange(2000) * width + 80
    records = layout.records(np.frombuffer(data, np.uint8), at - 80, at - 80 + width, at)
    gram = suffix_dedup._gram_hashes(np.frombuffer(line[:32], np.uint8))
    which, bucket = layout.dealt(records, gram.view(np.int64))
    assert len(np.unique(layout.bucket(records))) == 1 and np.bincount(bucket, minlength=64).max() < 4 * len(which) / 64
    assert (np.bincount(which, minlength=2000) == suffix_dedup.PARTS).all()
