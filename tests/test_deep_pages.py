"""Deep pages against offset and limit."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftline.operators import deep_pages, listing
from siftline.operators.listing import Page


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    days = [None, *(datetime(2024, 1, d) for d in range(1, 6))]
    return spark.createDataFrame([(i, rng.choice(days), f"t{i}") for i in rng.sample(range(1000), 300)], "job_id int, posted_at timestamp, title string").repartition(7)


@pytest.mark.parametrize("ranges", [1, 4, 50, None])
@pytest.mark.parametrize("page", [Page(1, 7), Page(21, 7), Page(43, 7), Page(44, 7), Page(3, 100)])
def test_pages(rows, ranges, page):
    wanted = [tuple(r) for r in listing.page(rows, page).collect()]
    found = deep_pages.deep_page(rows, page, ranges=ranges).orderBy("place").collect()
    assert [(r["job_id"], r["posted_at"], r["title"]) for r in found] == wanted
    assert [r["place"] for r in found] == list(range(page.offset + 1, page.offset + 1 + len(wanted)))


def test_no_single_partition_sort(rows, spark):
    plan = deep_pages.ranked_between(rows, 100, 120, ranges=8)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan
    assert deep_pages.ranked_between(rows.where(F.lit(False)), 1, 5).count() == 0
