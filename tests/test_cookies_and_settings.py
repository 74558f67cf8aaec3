"""Cookie jars of several shapes, listed profiles and settings."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.functions import cookies
from webloom.operators import access, rules


def jar_of(spark, old, new="[]", now=1000.0):
    texts = spark.createDataFrame([(old, new)], "old string, new string")
    home = F.lit("home.example")
    merged = cookies.merged_cookies(cookies.cookies_of_json(F.col("old"), home), cookies.cookies_of_json(F.col("new"), home), F.lit(now))
    return json.loads(texts.select(cookies.cookies_json(merged)).first()[0])


HOME = {"domain": "home.example", "path": "/"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("{", []), ("7", []), ("null", []), ("[]", []), ("{}", []), ("[null, 3, \"x\", []]", []),
        ('[{"name":"a","value":""}]', [{"name": "a", "value": "", **HOME}]),
        ('[{"name":"a","value":null},{"value":"v"},{"name":"","value":"v"}]', []),
        ('[{"name":"a","value":5,"path":"/p","sameSite":null,"httpOnly":false,"other":1}]', [{"name": "a", "value": "5", "domain": "home.example", "path": "/p", "httpOnly": False, "sameSite": None}]),
        ('{"a":"v","b":5,"c":null}', [{"name": "a", "value": "v", **HOME}]),
        ('[{"name":"é\\"","value":"\\n"}]', [{"name": 'é"', "value": "\n", **HOME}]),
    ],
)
def test_jars_of_any_shape(spark, text, want):
    assert jar_of(spark, "[]", text) == want


@pytest.mark.parametrize(("expires", "stays"), [("999", False), ("1001", True), ("-1", True), ("null", True), ('""', True), ('"999"', False), ('"1001.5"', True), ('"soon"', True), ("999.9", False), ("1e9", True), ("0", False)])
def test_expired_cookies_go(spark, expires, stays):
    assert bool(jar_of(spark, f'[{{"name":"a","value":"v","expires":{expires}}}]')) == stays
    assert len(jar_of(spark, "[]", f'[{{"name":"a","value":"v","expires":{expires}}}]')) == 1  # new ones are kept as they come


def test_new_cookies_take_the_place_of_old_ones(spark):
    old = [{"name": n, "value": "old", "path": p} for n, p in (("a", "/"), ("b", "/"), ("a", "/x"))]
    new = [{"name": "c", "value": "1"}, {"name": "a", "value": "new"}, {"name": "a", "value": "newer", "domain": ""}]
    got = jar_of(spark, json.dumps(old), json.dumps(new))
    assert [(c["name"], c["path"], c["value"]) for c in got] == [("a", "/", "newer"), ("b", "/", "old"), ("a", "/x", "old"), ("c", "/", "1")]


def test_listed_profiles(spark):
    rows = [("b.example", "x", False, 9.0), ("a.example", "old", False, 1.0), ("a.example", "main", True, 0.0), ("a.example", "new", False, 5.0), ("a.example", "aa", False, 1.0)]
    profiles = spark.createDataFrame(rows, "domain string, account_id string, is_default boolean, updated_at double")
    assert [r.account_id for r in access.listed_profiles(profiles).collect()] == ["main", "new", "aa", "old", "x"]
    assert [r.account_id for r in access.listed_profiles(profiles, "b.example").collect()] == ["x"]


def test_settings():
    assert [rules.env_bool(v, False) for v in (None, "1", " TRUE ", "yes", "On", "0", "", "maybe")] == [False, True, True, True, True, False, False, False]
    assert rules.env_bool(None, True) and not rules.env_bool("no", True)
    assert rules.configured_proxies("http://A:1, http://b:2", "", "http://b:2;http://c:3\n") == ("http://A:1", "http://b:2", "http://c:3")
    assert rules.csv_values(" A.com;b.com\n,,C ") == ("a.com", "b.com", "c")
