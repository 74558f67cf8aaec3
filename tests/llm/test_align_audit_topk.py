"""Cross-tokenizer alignment, filter audit and exact top-k against brute-force versions on small fixtures with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import entry, exact_topk, filter_audit, token_alignment

A, B = entry.tokenizer_path("byte_bpe_50k.json"), entry.tokenizer_path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = ["\x85", "\xa0", " ", "᠎", *map(chr, range(0x2000, 0x2010)), " ", " ", " ", " ", "⁠", "　", "﻿"]


def texts():
    r = random.Random(11)
    words = ["".join(r.choice("abdeghiklmnorstué") for _ in range(r.randint(1, 9))) for _ in range(200)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    got = [say(r.randint(1, 90)) for _ in range(30)]
    got += [None, "", " ", "  ", "\n", "x", "x ", "x  ", " x", "  x", "x \n", "x\n y", "a\tb  c \t d\n\n e", "<|endoftext|> and<|endoftext|>", "<s> </s> <unk> <0x41> <pad>"]
    got += ["a▁b c", "▁", "one ▁ two three", "日本語 テキスト", "naïve café 🙂 🙂🙂 x", "it's we'll 'tis 's", "1 234 5.6", "a\x00b c\x00 d", "x" * 3000, "ab " * 2000, say(9000), got[0], got[0]]
    got += [f"one{s} two {s}three{s}{s} {s} four" for s in SPACES] + [f"end {s}" for s in SPACES[:4]] + ["\x1c a\x1f b c\x1d"]
    return got


def alignment(all_texts):
    """What the contract says, from whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    found = []
    for t in all_texts:
        links, groups = collections.Counter(), []
        n_a = n_b = 0
        if t:
            want = (" " + t).encode()
            a = a_tok.encode(" " + t, add_special_tokens=False).ids
            b = b_tok.encode(t)
            a_bytes = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a]
            pieces = [b_tok.id_to_piece(i) for i in b]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(a_bytes) == want == b"".join(b_bytes):
                n_a, n_b = len(a), len(b)
                ends = lambda parts: list(itertools.accumulate(map(len, parts)))
                e_a, e_b = ends(a_bytes), ends(b_bytes)
                i = j = 0
                for cut in sorted(set(e_a) & set(e_b)):
                    p, q = e_a.index(cut, i) + 1, e_b.index(cut, j) + 1
                    groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                    for x in range(i, p):
                        for y in range(j, q):
                            if e_a[x] - len(a_bytes[x]) < e_b[y] and e_b[y] - len(b_bytes[y]) < e_a[x]:
                                links[a[x], b[y]] += 1
                    i, j = p, q
        found.append((n_a, n_b, groups, links))
    holds = collections.Counter(k for f in found for k in f[3])
    most = collections.Counter()
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for n_a, n_b, groups, links in found:
        best = sum(n for k, n in links.items() if holds[k] == most[k[0]])
        out.append((n_a, n_b, len(groups), links.total(), best, sum(n * holds[k] for k, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("parts", "block", "bucket"), [(1, 1 << 24, 1 << 25), (3, 2000, 5000)])
def test_alignment(spark, parts, block, bucket):
    given = texts()
    table = spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(given)], "doc_id long, text string, block string, n_a int").repartition(parts).cache()
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in token_alignment.align(table, A, B, block, bucket).collect()}
    want = alignment(given)
    assert len(got) == len(given)
    for i, row in enumerate(want):
        assert got[i] == row, (i, given[i])


def test_alignment_null_and_repeated_ids_and_nothing(spark):
    given = [(None, "one two"), (None, "one two"), (5, "one three"), (5, "one three"), (5, None)]
    table = spark.createDataFrame(given, "doc_id long, text string").coalesce(1).cache()
    got = sorted(((r.doc_id, *(r[c] for c in FIELDS)) for r in token_alignment.align(table, A, B).collect()), key=str)
    assert got == sorted(((i, *row) for (i, _), row in zip(given, alignment([t for _, t in given]))), key=str)
    assert token_alignment.align(table.limit(0), A, B).collect() == []


def test_files_are_separable_and_segments_are_those_of_whole_texts():
    assert token_alignment.separable(A, B)
    import pyarrow as pa

    data, starts, ends, _, first = token_alignment.Segments(True).find(pa.array(["a b  c", None, "", " x ", "é \xa0 y"]))
    body = data.tobytes()
    assert [body[s:e].decode() for s, e in zip(starts, ends)] == [" a", " b", "  c", "  x ", " é", " \xa0 y"]
    assert first.tolist() == [0, 3, 3, 3, 4, 6]


def audit(docs, labels):
    """Every order, one filter after another."""
    said = collections.defaultdict(lambda: [False, False])
    for d, q, t in labels:
        if d is not None:
            said[d] = [said[d][0] or q == 1, said[d][1] or t == 1]
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, source in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and least[t] < d}
        fails.append((source or "", {k for k, v in f.items() if v}, *said.get(d, [False, False])))
    rows = {}
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[0]]
                left = [f for f in left if c not in f[0]]
                total[c] += len(gone)
                failing = [f for f in mine if c in f[0]]
                rows[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(f[0] == {c} for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(total[order[step - 1]])
    return rows


def test_filter_audit(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs = []
    for d in range(150):
        t = " ".join(r.choice(words[: r.choice([8, 300])]) for _ in range(r.choice([10, 49, 50, 80])))
        t = t.upper() if r.random() < 0.2 else t
        docs.append((d, t + r.choice(["", " #", " |\n", "\x0b"]), r.choice(["s0", "s0", "s1", "", None])))
    docs += [(150 + k, docs[k % 7][1], "s0") for k in range(40)] + [(3, docs[3][1], "s1"), (None, docs[0][1], "s1"), (None, None, "s2"), (400, "", "s2"), (401, None, "s2"), (402, "É" * 200 + " Ab", "s2"), (403, "w " * 100_000, "s3")]
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 0, 1])) for d in range(0, 190, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, source string, mask int, n int").repartition(3)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in filter_audit.audit(table, labelled).collect()}
    assert got == audit(docs, labels)
    assert filter_audit.audit(table.limit(0), labelled).count() == 0
    assert filter_audit.audit(table, labelled.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_filter_audit_hot_copies(spark):
    table = spark.range(6000).select((F.col("id") + 1).alias("doc_id"), F.when(F.col("id") % 3 == 0, "copied again").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(table, labels).filter("filter_order = 'EABCD' and step <= 2").orderBy("step").collect()
    assert [(x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost) for x in got] == [(4001, 1999, 0, 0, 1, 1), (0, 4001, 1999, 4001, 1, 0)]


def test_removal_polynomial_is_the_multilinear_extension():
    r = random.Random(1)
    counts = [r.randrange(50) for _ in range(32)]
    f = filter_audit.RemovalPolynomial(counts)
    for chosen in range(32):
        assert f.corner(chosen) == sum(n for m, n in enumerate(counts) if m & chosen)
    assert sum(f.shapley(i) for i in range(5)) == f.corner(31)
    assert all((f.shapley(i) * 120).denominator == 1 for i in range(5))


def vectors():
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(60)] + [(20, [0.5] * 6), (20, [0.5] * 6)]
    rows += [(400, None), (420, [None] * 6), (440, [1.0, None, 0.0]), (460, [math.nan] * 6), (480, [math.inf] * 6), (None, [9.0] * 6)]
    rows += [(500, []), (520, [1.0, -1.0]), (540, [0.25] * 9), (560, [1e300] * 6), (561, [-1e300] * 6), (562, [2.0**40] * 6), (580, [2.0**14, 0.0])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("parts", "shard", "merge"), [(1, 1 << 16, 16), (3, 20, 2)])
def test_topk(spark, parts, shard, merge):
    rows = vectors()
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(parts)
    got = collections.Counter(map(tuple, exact_topk.top_k(table, shard_rows=shard, merge=merge).select("query_id", "rank", "vec_id", "score").collect()))
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = collections.Counter()
    for n, (i, v) in enumerate(fine):
        if i % 20 == 0:
            scored = sorted((-max(-exact_topk.MOST, min(exact_topk.MOST, sum(a * b for a, b in zip(v, w)))), j) for m, (j, w) in enumerate(fine) if m != n)
            want.update((i, k, j, -s) for k, (s, j) in enumerate(scored[:20], 1))
    assert got == want


def test_topk_few_rows(spark):
    table = spark.createDataFrame([(20, [1.0]), (3, [2.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk.top_k(table).collect()] == [(20, 1, 3, 64 * 128)]
    assert exact_topk.top_k(table.filter("vec_id = 20")).count() == exact_topk.top_k(table.limit(0)).count() == 0


def test_best_keeps_the_first_of_equals():
    r = np.random.default_rng(2)
    values = r.integers(-3, 3, (50, 90))
    for k in (1, 7, 90, 200):
        assert exact_topk.best(values, k).tolist() == [sorted(range(90), key=lambda i, v=v: (-v[i], i))[:k] for v in values.tolist()]
