"""Ordered status writes against one write after the other."""

from __future__ import annotations

import random

import pytest

from siftline import schema
from siftline.operators import status_fold, store

WRITES = "pipeline_run_id int, job_id string, status string, seq int"


def one_by_one(state, writes):
    two, three = state
    for seq, status in sorted(writes):
        if status in schema.STAGE_2:
            two = two if three else status
        elif status in schema.STAGE_3 and two == schema.PASSED_2 and three in (None, status):
            three = status
        else:
            return two, three, seq
    return two, three, None


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_writes_in_order(spark, monkeypatch, block):
    monkeypatch.setattr(status_fold, "BLOCK", block)
    rng = random.Random(block)
    names = [*schema.STAGE_2, *schema.STAGE_2, *schema.STAGE_3, schema.PASSED_3, "x"]
    states = {f"j{i}": rng.choice([(None, None), *(status_fold._STATES[3:])]) for i in range(80)}
    writes = {j: [(s, rng.choice(names[:-1] if rng.random() < 0.97 else names)) for s in rng.sample(range(20), rng.randint(0, 9))] for j in states}
    writes["j3"] = [(4, schema.PASSED_2), (5, None)]
    current = spark.createDataFrame([(1, j, *s, "why") for j, s in states.items() if s[0]], "pipeline_run_id int, job_id string, stage2_status string, stage3_status string, stage3_rationale string")
    asked = spark.createDataFrame([(1, j, w, s) for j, ws in writes.items() for s, w in ws], WRITES).repartition(5)
    found = {r["job_id"]: tuple(r)[2:] for r in status_fold.folded(current, asked).collect()}
    assert found == {j: one_by_one(states[j], ws) for j, ws in writes.items() if ws}


def test_tables_after_writes(spark):
    current = spark.createDataFrame([(1, "a", schema.PASSED_2, None, "why")], schema.RUN_JOBS)
    good = spark.createDataFrame([(1, "a", schema.PASSED_3, 2), (1, "a", schema.PASSED_3, 3), (1, "b", schema.REJECTED_2, 1), (1, "b", schema.PASSED_2, 2)], WRITES.replace("id int", "id bigint"))
    told = {r["job_id"]: tuple(r)[2:] for r in status_fold.with_writes(current, good).collect()}
    assert told == {"a": (schema.PASSED_2, schema.PASSED_3, "why"), "b": (schema.PASSED_2, None, None)}
    one = spark.createDataFrame([(1, "a", schema.PASSED_3)], "pipeline_run_id bigint, job_id string, status string")
    assert store.with_status(current, one).collect() == status_fold.with_writes(current, good.where("job_id = 'a'")).collect()
    for job, status in ((" ", schema.PASSED_2), ("c", schema.PASSED_3)):
        with pytest.raises(ValueError, match="illegal"):
            status_fold.with_writes(current, spark.createDataFrame([(1, job, status, 1)], WRITES))
