"""Pages by cursor: what comes after a key, from a table that lies in the order of that key.

`laid_out` writes rows once, dealt by ranges of the order and sorted within files, so the bounds of files and row groups tell
which of them a page needs. A page filters by its cursor, which reaches the scan, and takes the least rows of what is left;
page 10,000 costs what page 1 does, and nothing before it is sorted or skipped row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def laid_out(rows: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """rows, written to `path` in ranges of `order` and read again; rows with a null in the order have no place in it and go."""
    placed = rows.dropna(subset=list(order))
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def beyond(order: Sequence[str], cursor: Sequence, descending: bool = False) -> Column:
    """order > cursor, column by column; the first column's bound stands alone as well, so that a scan can use it."""
    past = (lambda c, v: F.col(c) < v) if descending else (lambda c, v: F.col(c) > v)
    values = [F.lit(v) for v in cursor]
    steps = [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(order[:k], values[:k], strict=True)], past(order[k], values[k])) for k in range(len(order))]
    first = F.col(order[0]) <= values[0] if descending else F.col(order[0]) >= values[0]
    return first & reduce(lambda a, b: a | b, steps)


def page(table: DataFrame, order: Sequence[str], cursor: Sequence | None = None, limit: int = 20, most: int = 100, descending: bool = False) -> DataFrame:
    """The next `limit` (1 to `most`) rows behind the cursor in order, with `next_cursor`: the last row's key on every row of a full page, else null.

    `order` must tell any two rows apart; None begins at the first row.
    """
    limit = max(1, min(limit, most))
    left = table if cursor is None else table.filter(beyond(order, cursor, descending))
    some = left.orderBy(*(F.desc(c) if descending else F.asc(c) for c in order)).limit(limit)
    w = Window.partitionBy()  # of `limit` rows
    key = F.struct(*order)
    last = F.min(key).over(w) if descending else F.max(key).over(w)
    return some.withColumn("next_cursor", F.when(F.count(F.lit(1)).over(w) == limit, last))


def cursor_of(rows: DataFrame) -> tuple | None:
    """The next page's cursor, null at the end; one row reaches the driver."""
    got = rows.select("next_cursor").first()
    return None if got is None or got[0] is None else tuple(got[0])


def page_number(table: DataFrame, order: Sequence[str], pages: int, limit: int, **how) -> DataFrame:
    """The so-many-th page (from 1), reached page by page as a reader does; empty behind the last."""
    now = page(table, order, None, limit, **how)
    for _ in range(pages - 1):
        cursor = cursor_of(now)
        if cursor is None:
            return now.limit(0)
        now = page(table, order, cursor, limit, **how)
    return now
