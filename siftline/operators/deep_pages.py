"""Deep pages: any page of a list in canonical order, without sorting up to it in one task.

``offset`` with ``limit`` sorts everything up to the page's end and brings it to one task.  Here rows are dealt into ranges
of the order and counted by range; the counts say which ranges hold the page, and only those are ranked, each in the task
that sorts it.  Reading far pages costs what reading near ones does: two scans of the key columns, one of them sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paging import cut
from .listing import Page, order

#: Rows of a range, about.
RANGE = 100_000
MOST_RANGES = 2000


def ranges_for(rows: int) -> int:
    return max(1, min(MOST_RANGES, -(-rows // RANGE)))


def ranked_between(rows: DataFrame, first: int, last: int, key: str = "job_id", ranges: int | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """``posted_at``, the key and ``columns`` of the rows at places ``first`` to ``last`` (from 1) of the order, with ``place``.

    Keys should be unlike, as the order ends with them; rows that tie in the whole order stand in any order.
    """
    narrow = rows.select(key, "posted_at", *columns)
    n = ranges or ranges_for(narrow.count())
    dealt = cut(narrow.repartitionByRange(n, *order(key)).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()  # a number for each range
    before, ahead = 0, {}
    for r in counts:
        if before < last and before + r["n"] >= first:
            ahead[r["_range"]] = before
        before += r["n"]
    if not ahead:
        return dealt.where("false").drop("_range").withColumn("place", F.lit(0).cast("bigint"))
    own = dealt.where(F.col("_range").isin(*ahead))
    start = F.lit(0).cast("bigint")
    for name, count in ahead.items():
        start = F.when(F.col("_range") == name, count).otherwise(start)
    place = start + F.row_number().over(Window.partitionBy("_range").orderBy(*order(key)))
    return own.withColumn("place", place).drop("_range").where(F.col("place").between(first, last))


def deep_page(rows: DataFrame, at: Page, key: str = "job_id", ranges: int | None = None) -> DataFrame:
    """The page's rows, whole, with ``place``; the other columns are fetched for the page's keys only (TOP-02 to TOP-05)."""
    found = ranked_between(rows, at.offset + 1, at.offset + at.limit, key, ranges).select(key, "place")
    return rows.join(F.broadcast(found), key)  # a page has at most so many rows as its limit
