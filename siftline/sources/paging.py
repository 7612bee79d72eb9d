"""Ordered reads of captured pages: which pages a paged read gets to, and which cards it keeps.

A board is read page by page until a rule ends the read: the board says so, a page brings nothing new, enough cards are
there, or enough pages were read.  A capture holds pages of many reads (column ``read``), also pages that a read would
never have asked for.  Here the rules are prefix scans over all reads at once:

* the first sight of each card is an aggregation by URL, so a card that is on very many pages is merged before it is
  shuffled;
* running totals take two levels, sums of blocks of pages and sums inside a block, so that no read, however long, has to
  be sorted in one task: a task holds one block of pages, or one number for each block of a read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pages of a block.
BLOCK = 4096


@dataclass(frozen=True)
class Stop:
    """What ends a read, beside the board's own sign.

    ``cap``: so many cards; ``pages``: so many pages; ``nothing_new``: a page after the first that brings no new card.
    """

    cap: int | None = None
    pages: int | None = None
    nothing_new: bool = False


def limited(asked: int | None, default: int, most: int) -> int:
    """A limit as the boards take it: the default where none is asked for, and never above the most."""
    return min(asked, most) if asked and asked > 0 else default


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors see; where none is set, local runs take a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(table: DataFrame) -> DataFrame:
    """The table written once to the shared folder for checkpoints, for plans that read it more than once."""
    shared_folder(table.sparkSession)
    return table.checkpoint()


def with_totals_before(pages: DataFrame, by: Sequence[str], place: str, *values: str) -> DataFrame:
    """Adds ``<value>_before``, the sum over earlier places of the same read, for each value."""
    block = F.floor(F.col(place) / BLOCK)
    earlier = (Window.unboundedPreceding, -1)
    sums = pages.groupBy(*by, block.alias("_block")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    ahead = Window.partitionBy(*by).orderBy("_block").rowsBetween(*earlier)
    starts = sums.select(*by, "_block", *(F.coalesce(F.sum(f"_{v}").over(ahead), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy(*by, "_block").orderBy(place).rowsBetween(*earlier)
    met = pages.withColumn("_block", block).withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    met = met.join(starts, [*by, "_block"])
    return met.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values}).drop("_block", *(f"_{v}" for v in values))


def pages_read(pages: DataFrame, stop: Stop, by: Sequence[str] = ("read",)) -> DataFrame:
    """``(by, page, before)`` of the pages that their reads get to; ``before`` counts the cards of earlier pages.

    ``pages`` has a row for each page: ``page``, ``new`` (its new cards) and ``ended`` (the board's sign; null is none),
    and may have ``total``, the number of cards at which the board says that a read is whole.  The page that ends a read
    is the last one read.
    """
    counted = with_totals_before(pages.withColumn("one", F.lit(1)), by, "page", "new", "one")
    ends = F.coalesce(F.col("ended"), F.lit(False))
    if stop.nothing_new:
        ends |= (F.col("new") == 0) & (F.col("one_before") > 0)
    if "total" in pages.columns:
        ends |= F.coalesce(F.col("new_before") + F.col("new") >= F.col("total"), F.lit(False))
    if stop.cap is not None:
        ends |= F.col("new_before") + F.col("new") >= stop.cap
    if stop.pages is not None:
        ends |= F.col("one_before") + 1 >= stop.pages
    last = counted.where(ends).groupBy(*by).agg(F.min("page").alias("_last"))
    read = counted.join(last, list(by), "left").where(F.col("_last").isNull() | (F.col("page") <= F.col("_last")))
    return read.select(*by, "page", F.col("new_before").alias("before"))


def until(cards: DataFrame, pages: DataFrame, stop: Stop, by: Sequence[str] = ("read",)) -> DataFrame:
    """Cards that ordered reads keep, each URL once where it is first seen; ``nth`` numbers them from 1.

    ``cards`` has ``page``, ``place``, ``url`` and whatever else describes a card; ``pages`` has ``page`` and ``ended``.
    Both should be tables that were written: they are read more than once.  A null URL is a URL like any other.
    """
    rest = [c for c in cards.columns if c not in (*by, "url")]
    seen = cards.groupBy(*by, "url").agg(F.min_by(F.struct(*rest), F.struct("page", "place")).alias("_card"))
    first = seen.select(*by, "url", "_card.*")
    new = first.groupBy(*by, "page").agg(F.count(F.lit(1)).alias("new"))
    counted = pages.select(*by, "page", "ended").join(new, [*by, "page"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    kept = first.join(pages_read(counted, stop, by), [*by, "page"])
    nth = F.col("before") + F.row_number().over(Window.partitionBy(*by, "page").orderBy("place"))
    kept = kept.withColumn("nth", nth).drop("before")
    return kept if stop.cap is None else kept.where(F.col("nth") <= stop.cap)


def of_one_read(pages: DataFrame) -> DataFrame:
    """Pages with a column ``read``: a capture without one is a single read."""
    return pages if "read" in pages.columns else pages.withColumn("read", F.lit(0))


def ended_by_total(page: Column, limit: Column, total: Column) -> Column:
    """Whether a search that counts its pages from 1 has no page after this one: it has ``ceil(total / limit)``."""
    return F.coalesce((total > 0) & (limit > 0) & (page + 1 > F.ceil(total / limit)), F.lit(False))
