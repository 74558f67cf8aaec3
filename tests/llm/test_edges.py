"""Nulls in any column, repeated ids and rows, clashing columns and very long texts, for the operators on documents."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import chat_format, entry, harmonic_packing, info_sanitize, secret_scan, string_tiling, suffix_dedup, token_counts, weak_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PACK, COUNT, VOCABULARY = (entry.tokenizer_path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
LINE = "a line of more than a hundred bytes that is said again and again, word for word, by many of the documents here\n"
#: Null and repeated ids, null and empty texts, repeated rows.
ROWS = [(None, LINE * 2), (1, LINE), (1, LINE), (2, None), (2, ""), (None, None), (3, "x"), (4, f"{LINE}password: abcdefgh12 a.b@example.com"), (None, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    """ROWS with columns named like those that the operators make."""
    rows = [(d, t, 7, "s", 1.5, d, [1]) for d, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, spans string, quality double, doc_tokens long, features array<int>").repartition(2)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_packing(odd):
    got = harmonic_packing.pack(odd, PACK).collect()
    tokens = collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert sum(tokens.values()) == len(ROWS) and tokens[(2, 1)] == 2 and tokens[(None, 1)] == 1
    assert sum(r.length for r in got) == sum(k[1] * v for k, v in tokens.items())


def test_quality(odd):
    same([(r.doc_id, r.n_words) for r in weak_quality.judge(odd).collect()], [(d, len(WORD.findall(t or ""))) for d, t in ROWS])
    assert weak_quality.keep_good(odd).columns == odd.columns


def test_repeats(odd):
    got = suffix_dedup.summarize_repeats(odd).collect()
    line = len(LINE.encode())
    removed = collections.defaultdict(list)
    for r in got:
        removed[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans))
    assert len(got) == len(ROWS) and removed[1] == [(line, 0, 0)] * 2 and removed[4] == [(len(ROWS[7][1]), line, 1)]
    same(removed[None], [(2 * line, 2 * line, 1), (0, 0, 0), (1, 0, 0)])


def test_counts(odd, tmp_path):
    got = token_counts.count_tokens(odd, COUNT, str(tmp_path / "cache")).collect()
    same([(r.doc_id, r.n_bytes) for r in got], [(d, len(t or "")) for d, t in ROWS])


def test_tiling(spark, odd):
    items = spark.createDataFrame([(0, LINE, 1), (0, LINE, 1), (None, LINE, 1), (9, None, 1)], "item_id long, text string, n int")
    for limit in (10**6, 0):
        got = string_tiling.contaminated(odd, items, broadcast_seeds=limit).collect()
        same(set((r.doc_id, r.item_id) for r in got), {(None, 0), (1, 0), (4, 0)})
        kept = string_tiling.keep_clean(odd, items, broadcast_seeds=limit)
        assert kept.columns == odd.columns
        ids = [r.doc_id for r in kept.collect()]
        same(ids, [2, 2, 3, None, None])


def test_personal_data(odd):
    for limit in (10**6, -1):
        got = info_sanitize.find(odd, broadcast_terms=limit).collect()
        same([(r.doc_id, r.n_email) for r in got], [(d, int(d == 4)) for d, t in ROWS])
        clean = info_sanitize.sanitize(odd, broadcast_terms=limit)
        assert clean.columns == odd.columns
        same([(r.doc_id, r.text) for r in clean.collect()], [(d, t and t.replace("a.b@example.com", "[EMAIL]")) for d, t in ROWS])


def test_secrets(odd):
    same([(r.doc_id, r.n_assign) for r in secret_scan.scan(odd, VOCABULARY).collect()], [(d, int(d == 4)) for d, t in ROWS])


def test_chat(spark):
    rows = [(1, 0, "user", "a", "x", 3), (1, 0, "user", "a", "x", 3), (1, None, None, None, "x", 3), (None, None, "assistant", "b", None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, example long")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.expand(table)).collect()}
    assert [tuple(x) for x in back[1].turns] == [("", ""), ("user", "a"), ("user", "a")] and back[1].trained == ""
    assert back[None].trained == "b"
    assert chat_format.read_back(chat_format.expand(table.limit(0))).count() == 0


def test_base_spans_as_the_patterns_give_them():
    """The scanners against the patterns as they are written, on texts made of their characters."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(digits):
        doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
        return sum(doubled) % 10 == 0

    def brute(text):
        out = [(0, *m.span()) for m in email.finditer(text)]
        out += [(1, *m.span()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(2, *m.span()) for m in card.finditer(text) if 16 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d)]
        return out + [(3, *m.span()) for m in phone.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    r = random.Random(11)
    found = collections.Counter()
    for alphabet in ("0123.", "ab1.@-", "4111 -", "+17 ().-", "a@.+1 -"):
        for _ in range(4000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            want = brute(text)
            assert info_sanitize.base_spans(text) == want, text
            found.update(k for k, _, _ in want)
    assert all(found[k] > 20 for k in range(4)), found


def test_secret_spans_as_the_patterns_give_them():
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
    access, hexes = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")

    def brute(text):
        out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        out += [(m.start(), 1, m.end()) for m in access.finditer(text) if len(m[0]) >= 16]
        return sorted(out + [(m.start(), 2, m.end()) for m in hexes.finditer(text) if len(m[0]) >= 32])

    r, found = random.Random(12), collections.Counter()
    parts = ["password", "Passwd", "SECRET", "token", "apikey", "api_key", "=", ": ", '"', "'", " ", "AKIA", "akia", "ABCD1234", "deadbeef00", "0123456789abcdef", "é", "x", "long-enough-value", "İ", "ſecret"]
    for k in range(5000):
        some = parts if k % 2 else r.sample(parts, 3)
        text = "".join(r.choice(some) for _ in range(r.randint(0, 14)))
        want = brute(text)
        assert secret_scan.base_spans(text) == want, text
        found.update(k for _, k, _ in want)
    assert all(found[k] > 20 for k in range(3)), found


def tile_by_definition(pattern, text, least):
    """Greedy string tiling without hashes: the longest unmarked common run again and again."""
    free_p, free_t = [True] * len(pattern), [x != -1 for x in text]
    total = 0
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and free_p[p + k] and free_t[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return total
        total += k
        free_p[p : p + k] = free_t[t : t + k] = [False] * k


def test_tiles_are_common_and_do_not_overlap():
    r = random.Random(4)
    for _ in range(300):
        letters = r.choice([3, 6, 30])
        pattern = [r.randrange(letters) for _ in range(r.randint(1, 40))]
        text = [r.choice([*range(letters), -1]) for _ in range(r.randint(0, 60))]
        at = r.randrange(len(text) + 1)
        text[at:at] = pattern[r.randrange(len(pattern)) :]
        least = r.randint(2, 5)
        found = string_tiling.tiles(pattern, text, least)
        assert all(pattern[p : p + k] == text[t : t + k] and k >= least for p, t, k in found)
        for side in (0, 1):
            used = [i for tile in found for i in range(tile[side], tile[side] + tile[2])]
            assert len(used) == len(set(used))
        if letters == 30:  # without many ties both mark the same
            assert sum(k for *_, k in found) == tile_by_definition(pattern, text, least)


def test_running_hash():
    r = random.Random(9)
    values = [r.randrange(5) for _ in range(200)]
    free = [r.random() < 0.95 for _ in values]
    got = dict(string_tiling.windows(values, free, 6))
    want = [k for k in range(195) if all(free[k : k + 6])]
    assert sorted(got) == want
    for a in want:
        for b in want:
            assert (got[a] == got[b]) == (values[a : a + 6] == values[b : b + 6])


def test_contamination_by_definition(spark):
    r = random.Random(21)
    words = [f"t{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(3, 30)))) for k in range(12)]
    texts = []
    for k in range(60):
        own = [r.choice(words) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            said = r.choice(items)[1].split()
            cut = r.randrange(len(said))
            said = r.choice([said, said[cut:] + ["zz"] + said[:cut], said[:cut]])
            at = r.randrange(len(own) + 1)
            own[at:at] = said
        texts.append((k, " ".join(own).upper() if k % 5 == 0 else " ".join(own)))
    want = set()
    for d, t in texts:
        for i, item in items:
            pattern = item.split()
            if tile_by_definition(pattern, t.lower().split(), min(5, len(pattern))) >= 0.6 * len(pattern):
                want.add((d, i))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for limit in (10**6, 0):
        got = string_tiling.contaminated(table, spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10


def test_fit_overrules_an_inaccurate_rule():
    """One of five rules votes bad on a third of what is good, whatever the others say; its vote alone rejects nothing."""
    r = np.random.default_rng(2)
    truth = r.random(20_000) < 0.85
    votes = np.where(truth[:, None], r.random((20_000, 5)) >= 0.02, r.random((20_000, 5)) >= 0.8).astype(int)
    votes[:, 4] = np.where(r.random(20_000) < 0.33, 0, 1)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good = weak_quality.fit(patterns, counts.astype(float))[which.ravel()] >= 0.5
    alone = (votes[:, 4] == 0) & (votes[:, :4] == 1).all(1)
    assert good[alone].all() and alone.sum() > 3000
    assert (good == truth).mean() > 0.98 > 0.75 > (truth == (votes == 1).all(1)).mean()


def test_kept_by_definition(spark):
    """`kept` against expectation maximisation over single documents, written out with plain loops."""
    from math import prod

    r = random.Random(8)
    say = lambda n, w: " ".join(r.choice(w) + ("." if k % 9 == 8 else "") for k in range(n))
    words = ["".join(r.choice("abdeghiklmnorstu") for _ in range(r.randint(2, 9))) for _ in range(900)]
    texts = [say(r.randint(60, 300), words) for _ in range(60)] + [say(120, words).upper() for _ in range(6)] + [say(200, words[:9]) for _ in range(6)]
    texts += [re.sub(" ", " | # ", say(80, words)) for _ in range(6)] + [say(100, [w + "!" for w in words]) for _ in range(4)] + [say(90, [str(k) for k in range(5000)]) for _ in range(4)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    featured = weak_quality.text_features(table)
    named = weak_quality.rules()
    votes = {x.doc_id: [x[k] for k in named] for x in featured.select("doc_id", *(v.alias(k) for k, v in named.items())).collect()}
    got = {x.doc_id: x for x in weak_quality.judge(table).collect()}
    seen = [d for d in votes if not got[d].base_failed]
    good = {d: 0.1 if 0 in v else 0.9 if 1 in v else 0.5 for d, v in votes.items()}
    for _ in range(500):
        class_weight = [50 + sum(1 - good[d] for d in seen), 50 + sum(good[d] for d in seen)]
        bad_share = []
        for k in range(len(named)):
            of = []
            for c, p in enumerate((0.3, 0.01)):
                weight = {d: good[d] if c else 1 - good[d] for d in seen}
                bad, fine = (sum(w for d, w in weight.items() if votes[d][k] == v) for v in (0, 1))
                of.append((bad + 100 * p) / (bad + fine + 100))
            bad_share.append(of)
        for d, v in votes.items():
            likely = [class_weight[c] * prod(bad_share[k][c] if x == 0 else 1 - bad_share[k][c] for k, x in enumerate(v) if x >= 0) for c in (0, 1)]
            good[d] = likely[1] / sum(likely)
    for d in votes:
        assert abs(got[d].quality - good[d]) < 1e-6
        assert got[d].kept == (not got[d].base_failed and good[d] >= 0.5)


LONG = {
    "letters then digits": "a" * 500_000 + "1x" + "b1" * 250_000,
    "digits": "1" * 1_000_000,
    "dots": "1." * 500_000,
    "at signs": "a@" * 500_000,
    "mails": "a.b@c.d " * 120_000,
    "pluses": "+1 " * 300_000,
    "keys": "token " * 150_000,
    "equals": "token=" * 150_000,
    "underscores": "a_" * 500_000,
    "hyphens": "A-" * 500_000,
}


@pytest.mark.parametrize("name", LONG)
def test_time_grows_with_the_text(name):
    text, began = LONG[name], time.perf_counter()
    info_sanitize.all_spans(text, frozenset(("c", "a")))
    assert time.perf_counter() - began < 15
    began = time.perf_counter()
    encoding = secret_scan.vocabulary(VOCABULARY)
    secret_scan.base_spans(text)
    secret_scan.random_spans(text, lambda w: len(encoding.encode_ordinary(w)), 2.2)
    assert time.perf_counter() - began < 15


def test_terms_of_a_name_and_of_a_kind(spark):
    """A name inside an address tells of it elsewhere; a word beside addresses of all kinds of people tells of the kind."""
    texts = [f"{w} to zanzibarov@mail.example.com {w} end" for w in ("red", "blue", "green", "black")]
    texts += [f"{w} kurier {w}.{k}@example.org here {w}" for k, w in enumerate(("one", "two", "three", "four", "five"))]
    texts += ["Zanzibarov alone", "der kurier kam"] + [f"filler text number {k} about nothing to end here" for k in range(900)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r.term for r in info_sanitize.revealing_terms(table).collect()}
    assert {"zanzibarov", "kurier"} <= terms and not {"to", "end", "here", "example", "org", "com", "mail"} & terms


def test_pipeline_on_awkward_tables(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(0, LINE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (odd.limit(0), odd):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path))
            assert after.columns == odd.columns, name
            now = spark.createDataFrame(after.collect(), odd.schema)
        assert stage is not corpus_pipeline.STAGES[-1][1]
        corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()


def test_digests_of_equal_texts(odd):
    got = suffix_dedup.remove_repeats(odd).filter("doc_id = 1").collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == hashlib.sha256(LINE.encode()).hexdigest() for r in got)


def test_cache_encodes_nothing_twice(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame([(k, f"text {k % 5}") for k in range(20)], "doc_id long, text string")
    path = str(tmp_path / "cache")
    first = token_counts.count_tokens(table, COUNT, path).collect()
    files = sorted(x.name for x in tmp_path.rglob("*.parquet"))
    rows = spark.read.parquet(path).count()
    same(token_counts.count_tokens(table, COUNT, path).collect(), first)
    assert rows == 5 and spark.read.parquet(path).count() == 5 and files
    assert [x.name for x in (tmp_path / "cache").iterdir() if x.is_dir()] == [f"tokenizer={token_counts.tokenizer_digest(COUNT)}"]
    assert token_counts.count_tokens(table, PACK, path).count() == 20 and spark.read.parquet(path).select(F.count_distinct("tokenizer").alias("n")).first().n == 2


@pytest.mark.parametrize("limit", [10**6, 0])
def test_tiling_judges_rows_by_their_texts(spark, limit):
    said = "one two three four five six seven eight nine ten"
    given = [(None, said), (None, "clean"), (1, f"so {said}"), (1, "clean too"), (2, None), (2, said), (2, said), (3, "")]
    table = spark.createDataFrame([(*x, 5) for x in given], "doc_id long, text string, gone int")
    kept = string_tiling.keep_clean(table, spark.createDataFrame([(7, said)], "item_id long, text string"), broadcast_seeds=limit)
    assert kept.columns == table.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(None, "clean"), (1, "clean too"), (2, None), (3, "")])
