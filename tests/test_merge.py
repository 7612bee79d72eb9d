"""Merges by digest against the upsert of whole tables, and what they leave alone."""

from __future__ import annotations

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftline import schema
from siftline.operators import merge, store
from siftline.operators.merge import Layout

THEN, NOW = datetime(2024, 1, 1), datetime(2024, 1, 31)


def jobs(spark, rows):
    names = [f.split() for f in schema.JOB_FIELDS.split(", ")]
    made = spark.createDataFrame(rows, "id string, title string, description string, tags array<string>, timezone_offsets array<double>, apply_url string, stage1_status string")
    return made.select(*[F.col(n) if n in made.columns else F.lit(None).cast(k).alias(n) for n, k in names])


def random_rows(seed, ids):
    """Rows by id, half of them changed in one field by the seed."""
    out = []
    for i in ids:
        own, rng = random.Random(i), random.Random(1000 * seed + i)
        choices = [["a", "b"], [None, "", "x", "y"], [None, [], ["p", "q"], ["q", "p"]], [None, [0.0], [-0.0]], [None, "", "u"]]
        row = [own.choice(c) for c in choices]
        if rng.random() < 0.5:
            field = rng.choice([0, 1, 1, 2, 3, 4])
            row[field] = rng.choice(choices[field])
        out.append((f"j{i}", *row, schema.PASSED_1))
    return out


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_merge_is_the_upsert(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(merge, "BROADCAST_LIMIT", limit)
    layout = Layout(str(tmp_path / "jobs"), 8)
    at = F.lit(THEN).cast("timestamp")
    old = store.encoded(jobs(spark, random_rows(1, range(60)))).withColumns({"created_at": at, "updated_at": at})
    new = jobs(spark, random_rows(2, range(30, 90)))
    merge.create(layout, old)
    wanted = {r["id"]: r for r in store.upsert(old, new, NOW).collect()}
    acts = {r["id"]: r["action"] for r in merge.merge(spark, layout, new, NOW).collect()}
    found = {r["id"]: r for r in merge.stored(spark, layout).select(*old.columns).collect()}
    assert found == wanted and set(acts) == {f"j{i}" for i in range(30, 90)} and set(acts.values()) == {store.INSERT, store.FULL, store.DESCRIPTION, store.SKIP}
    again = merge.merge(spark, layout, new, datetime(2024, 2, 1))
    assert {r["action"] for r in again.collect()} == {store.SKIP}
    assert {r["id"]: r for r in merge.stored(spark, layout).select(*old.columns).collect()} == wanted


def test_other_buckets_are_left_alone(spark, tmp_path):
    layout = Layout(str(tmp_path / "jobs"), 8)
    at = F.lit(THEN).cast("timestamp")
    merge.create(layout, store.encoded(jobs(spark, random_rows(3, range(60)))).withColumns({"created_at": at, "updated_at": at}))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in Path(layout.path).glob("bucket=*/*.parquet")}
    before = files()
    one = jobs(spark, [("j7", "new title", "x", None, None, None, None)])
    own = one.select(layout.bucket().alias("b")).first()["b"]
    assert [tuple(r) for r in merge.merge(spark, layout, one, NOW).collect()] == [("j7", store.FULL)]
    after = files()
    assert {f for f in before if f"bucket={own}/" not in f} == {f for f in after if f"bucket={own}/" not in f and before.get(f) == after[f]}
    assert not {f for f in before if f"bucket={own}/" in f} & set(after)
    with pytest.raises(ValueError):
        merge.merge(spark, layout, one.unionByName(one), NOW)


def test_stored_side_is_a_narrow_scan_without_a_shuffle(spark, tmp_path):
    layout = Layout(str(tmp_path / "jobs"), 4)
    at = F.lit(THEN).cast("timestamp")
    merge.create(layout, store.encoded(jobs(spark, random_rows(4, range(20)))).withColumns({"created_at": at, "updated_at": at}))
    new = merge.arriving(layout, jobs(spark, random_rows(5, range(5))))
    plan = merge.actions(merge.stored(spark, layout), new)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "description" not in scan.split("ReadSchema")[1] and "BroadcastHashJoin" in plan
    assert not any(" Exchange hashpartitioning(old_id" in line or " Exchange hashpartitioning(old_bucket" in line for line in plan.splitlines())
