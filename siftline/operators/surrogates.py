"""Surrogate ids of many new rows at once, without gaps, by ranges of their order.

``monotonically_increasing_id`` leaves gaps and a window over all rows is one task.  Here the rows are cut into ranges of
their order; counts of the ranges tell where each range starts, and rows are numbered inside their ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paging import cut
from .deep_pages import ranges_for


def numbered(new: DataFrame, order: list[Column], after: int = 0, name: str = "id", ranges: int | None = None) -> DataFrame:
    """``new`` with ids ``after + 1``, ``after + 2`` and so on in the given order (SNK-11).

    Rows that tie in the whole order get ids in any order.  A later read of the result gives the same ids, because the
    ranges are written once; so an ingest that is repeated must number its rows before its first write.
    """
    dealt = cut(new.repartitionByRange(ranges or ranges_for(new.count()), *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, 2,000 at most
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut(dealt.join(F.broadcast(starts), "_range").withColumn(name, F.lit(after) + F.col("_start") + inside).drop("_range", "_start"))
