"""Rules by automata against one rule after another in plain Python."""

import random
import re

import pytest

from webloom.operators import keyword_scan

FIELDS = "name string, include array<string>, exclude array<string>, regex array<string>, case_sensitive boolean, match_position string, enabled boolean, scope string"


def plain(text, domain, rules):
    for scope in (f"domain:{domain}", "global"):
        for name, include, exclude, regex, exact, position, enabled, of in sorted(rules):
            if of != scope or not enabled or not text:
                continue
            flags = 0 if exact else re.IGNORECASE
            said = text if position == "any" else text.split("\n", 1)[0].lstrip("#").strip() if position == "title" else (text.split("\n", 1) + [""])[1]
            bad = next((w for w in exclude or () if re.search(re.escape(w), said, flags)), None)
            if bad is not None:
                return f"excluded_keyword: {bad!r} (rule={name})"
            if include and not any(re.search(re.escape(w), said, flags) for w in include):
                return f"include_not_matched (rule={name})"
            hit = False
            for x in regex or ():
                try:
                    hit = hit or bool(re.search(x, said, flags))
                except re.error:
                    pass
            if regex and not hit:
                return f"regex_not_matched (rule={name})"
    return None


def story(r):
    word = lambda: "".join(r.choice("abAB'") for _ in range(r.randint(1, 3)))
    some = lambda n: r.choice([None, [], [word() for _ in range(r.randint(1, n))]])
    rules = [
        (f"n{i:03d}", some(6), r.choice([None, [word() + word() + word()]]), r.choice([None, None, ["a.b", "("], ["^#? *b"], ["("]]), r.random() < 0.5, r.choice(["any", "title", "body"]), r.random() < 0.9, r.choice(["global", "domain:x", "domain:y"]))
        for i in range(r.randint(1, 25))
    ]
    texts = ["".join(r.choice("abAB' #\n") for _ in range(r.choice([0, 3, 30, 80]))) for _ in range(40)]
    return rules, texts


def test_first_failure_is_that_of_rule_after_rule():
    r = random.Random(6)
    for _ in range(150):
        rules, texts = story(r)
        made = [keyword_scan.Rule(k, x[7], x[0], tuple(x[1] or ()), tuple(x[2] or ()), tuple(x[3] or ()), x[4], x[5]) for k, x in enumerate(sorted((x for x in rules if x[6]), key=lambda x: (x[7], x[0])))]
        scanner = keyword_scan.Scanner(made)
        for text in texts:
            for domain in "xz":
                got = scanner.first_failure(text, [f"domain:{domain}", "global"]) if text else None
                assert (got and got[1]) == plain(text, domain, rules), (text, rules)


@pytest.mark.parametrize("chars", [1, 40, keyword_scan.PART_CHARS])
def test_parts_give_the_same(spark, chars):
    r = random.Random(3)
    rules, texts = story(r)
    rules.append(("empty", None, None, None, True, None, True, "global"))
    rows = [(i, r.choice("xyz"), t) for i, t in enumerate([*texts, None, "a\n\nb"])]
    table = spark.createDataFrame(rules[:6] + rules[-1:] if chars == 1 else rules, FIELDS)
    used = [tuple(x) for x in table.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, text string").repartition(2)
    got = {x.doc_id: x.reason for x in keyword_scan.filtered(docs, table, chars=chars).collect()}
    assert got == {i: plain(t, d, [x for x in used if x[0] != "empty"]) for i, d, t in rows}


def test_words_without_rules_and_no_rules(spark):
    docs = spark.createDataFrame([(1, "x", "text")], "doc_id long, domain string, text string")
    none = spark.createDataFrame([], FIELDS)
    assert [tuple(x) for x in keyword_scan.filtered(docs, none).collect()] == [(1, "x", "text", None)]
    always = spark.createDataFrame([("a", None, [""], None, True, "any", True, "global")], FIELDS)
    assert keyword_scan.filtered(docs, always).first().reason == "excluded_keyword: '' (rule=a)"


def test_rules_that_repeat_words_make_one_part(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abAB'") for _ in range(r.randint(1, 2)))
    rules = [
        (f"n{r.random()}", [word()] if i % 3 == 0 else None, [word()], [r.choice(["a.b", "(", "^b"])] if i % 5 == 0 else None, r.random() < 0.5, r.choice(["any", "title"]), True, r.choice(["global", "domain:x", "domain:y"]))
        for i in range(2000)
    ]
    table = spark.createDataFrame([*rules, ("nulls", None, [None], None, None, None, True, None)], FIELDS)
    assert len(list(keyword_scan.parts(table, 40_000))) == 1
    rows = [(i, r.choice("xyz"), "".join(r.choice("abAB' #\n") for _ in range(r.choice([1, 2, 4])))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, text string")
    few = [x for x in rules if len(x[2][0]) == 2 and x[2][0][0] in "aB"]
    for some, chars in ((rules, 40_000), (few, 40_000), (few, 1_000)):
        got = {x.doc_id: x.reason for x in keyword_scan.filtered(docs, spark.createDataFrame(some, FIELDS), chars=chars).collect()}
        assert got == {i: plain(t, d, some) for i, d, t in rows}


def test_no_task_holds_two_parts(spark):
    """Each part runs in tasks of its own, so no two scanners are held at once by a task."""
    rules = spark.createDataFrame([(f"n{i}", None, [f"w{i}"], None, True, "any", True, "global") for i in range(6)], FIELDS)
    docs = spark.createDataFrame([(i, "x", f"w{i % 8} w{i % 5}") for i in range(40)], "doc_id long, domain string, text string")
    out = keyword_scan.filtered(docs, rules, chars=1)
    assert {x.doc_id: x.reason for x in out.collect()} == {i: plain(f"w{i % 8} w{i % 5}", "x", [tuple(x) for x in rules.collect()]) for i in range(40)}
    depth = [len(line) - len(line.lstrip(" :+-|*0123456789()")) for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert len(depth) == 6 and len(set(depth)) == 1
