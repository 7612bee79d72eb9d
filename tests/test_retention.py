"""Retention by days against a filter of all rows, and the files that it leaves alone."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from siftline.operators import retention

JOBS, ROWS = "id string, created_at timestamp, title string", "job_id string, pipeline_run_id int"
NOON = datetime(2024, 1, 10, 12)


def stored(spark, root):
    rng = random.Random(1)
    jobs = [(f"j{i}", None if i % 20 == 0 else datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 24 * 15)), "t") for i in range(200)]
    rows = [(f"j{rng.randint(0, 210)}", i % 3) for i in range(400)]
    made, children = spark.createDataFrame(jobs, JOBS), spark.createDataFrame(rows, ROWS)
    retention.write_by_day(made, f"{root}/jobs")
    retention.write_children(children, made, f"{root}/rows")
    return jobs, rows


@pytest.mark.parametrize("before", [NOON, datetime(2024, 1, 10), datetime(2024, 1, 10, 23, 59, 59), datetime(2023, 1, 1), datetime(2025, 1, 1)])
def test_retention(spark, tmp_path, before):
    jobs, rows = stored(spark, tmp_path)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in Path(tmp_path).glob("*/created_day=*/*.parquet")}
    old = files()
    for _ in range(2):  # a second time changes nothing
        retention.retain(spark, f"{tmp_path}/jobs", JOBS, before, {f"{tmp_path}/rows": ROWS})
    kept = {j for j, at, _ in jobs if at and at >= before}
    found = {r["id"] for r in retention._read(spark, f"{tmp_path}/jobs", JOBS).collect()}
    left = sorted((r["job_id"], r["pipeline_run_id"]) for r in retention._read(spark, f"{tmp_path}/rows", ROWS).collect())
    assert found == kept and left == sorted(r for r in rows if r[0] in kept)
    later = {f: at for f, at in old.items() if f"created_day={before.date() + timedelta(days=1)}" <= f.split("/")[-2] < "created_day=_"}
    assert {f: at for f, at in files().items() if f in later} == later
