"""Rules carried in rows: few are sent to every task, many are joined without gathering a domain's rows in one task."""

import pytest
from pyspark.sql import functions as F

from webloom.operators import keyword_rules

FIELDS = "name string, include array<string>, exclude array<string>, regex array<string>, case_sensitive boolean, match_position string, enabled boolean, scope string"
RULES = [("b", [], ["two"], [], False, "any", True, "domain:x"), ("a", [], ["one"], [], False, "any", True, "domain:x"), ("g", None, ["three"], None, True, "any", True, "global"), ("off", [], ["t"], [], False, "any", False, "global")]
TEXTS = [("x", "one two"), ("x", "TWO three"), ("y", "one three"), (None, "three"), ("y", "two"), ("x", None)]


def docs(spark, n=300):
    return spark.createDataFrame([(i, *TEXTS[i % 6]) for i in range(n)], "doc_id long, domain string, text string").withColumn("more", F.map_from_arrays(F.array(F.lit("k")), F.array("text")))


@pytest.mark.parametrize("small", [0, keyword_rules.SMALL_CHARS])
def test_few_and_many_rules_give_the_same(spark, monkeypatch, small):
    monkeypatch.setattr(keyword_rules, "SMALL_CHARS", small, raising=False)
    out = keyword_rules.filtered(docs(spark), spark.createDataFrame(RULES, FIELDS))
    assert out.columns == ["doc_id", "domain", "text", "more", "reason"]
    want = ["excluded_keyword: 'one' (rule=a)", "excluded_keyword: 'two' (rule=b)", "excluded_keyword: 'three' (rule=g)", "excluded_keyword: 'three' (rule=g)", None, None]
    assert {r.doc_id: r.reason for r in out.collect()} == {i: want[i % 6] for i in range(300)}
    none = keyword_rules.filtered(docs(spark, 6), spark.createDataFrame([], FIELDS))
    assert [r.reason for r in none.collect()] == [None] * 6


def test_rows_stay_where_they_are_with_few_rules(spark):
    plan = keyword_rules.filtered(docs(spark), spark.createDataFrame(RULES, FIELDS))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastExchange") >= 2


def test_rows_of_a_domain_are_dealt_with_many_rules(spark, monkeypatch):
    monkeypatch.setattr(keyword_rules, "SMALL_CHARS", 0, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = docs(spark, 2000).withColumn("domain", F.lit("x").substr(1, 1))
        sizes = [r["count"] for r in keyword_rules.for_domains(one, spark.createDataFrame(RULES, FIELDS)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 2000 and max(sizes) < 1000
