"""Pages by cursor against slices of the sorted rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from webloom.operators import paging

ORDER = ["at", "url"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = spark.range(950).select(F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 7) * 60).alias("at"), F.concat(F.lit("u"), F.col("id") * 7919 % 950).alias("url"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, "u", 1)], "at timestamp, url string, id long")).repartition(5)
    return paging.laid_out(rows, ORDER, str(tmp_path_factory.mktemp("pages") / "t"))


@pytest.mark.parametrize("descending", [False, True])
def test_all_pages(table, descending):
    want = sorted(((r["at"], r.url) for r in table.collect()), reverse=descending)
    assert len(want) == 950
    got, cursor, n = [], None, 0
    while True:
        rows = paging.page(table, ORDER, cursor, 100, descending=descending)
        got += [(r["at"], r.url) for r in rows.collect()]
        cursor, n = paging.cursor_of(rows), n + 1
        if cursor is None:
            break
    assert got == want and n == 10
    assert [(r["at"], r.url) for r in paging.page_number(table, ORDER, 3, 100, descending=descending).collect()] == want[200:300]
    assert paging.page_number(table, ORDER, 11, 100, descending=descending).count() == 0


def test_limits_and_ends(table):
    assert paging.page(table, ORDER, None, 0).count() == 1 and paging.page(table, ORDER, None, 1000).count() == 100
    late = (datetime.datetime(2100, 1, 1), "")
    assert paging.page(table, ORDER, late).count() == 0 and paging.cursor_of(paging.page(table, ORDER, late)) is None
    assert paging.cursor_of(paging.page(table, ORDER, None, 50)) is not None


def test_plan_reads_behind_the_cursor_without_a_global_sort(table):
    plan = paging.page(table, ORDER, (datetime.datetime(2023, 11, 15), "u5"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(at" in plan and "rangepartitioning" not in plan
