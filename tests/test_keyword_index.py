"""Keyword rules of all slots against asking every job for every word."""

from __future__ import annotations

import random

import pytest

from siftline import schema
from siftline.operators import keyword_index

RULES = "slot_id string, kind string, word string"
JOBS = "job_id int, title string, description string"


def asked(jobs, members, rules):
    out = set()
    for slot, job in members:
        title, body = jobs[job]
        hay = f"{title or ''} {body or ''}".lower()
        words = {k: {w.strip().lower() for s, kind, w in rules if s == slot and kind == k and w.strip()} for k in ("include", "exclude")}
        ok = (not words["include"] or any(w in hay for w in words["include"])) and not any(w in hay for w in words["exclude"])
        out.add((slot, job, schema.PASSED_2 if ok else schema.REJECTED_2))
    return out


@pytest.mark.parametrize("limit", [1 << 25, 400])
def test_all_slots(spark, monkeypatch, limit):
    monkeypatch.setattr(keyword_index, "BROADCAST_LIMIT", limit)  # the smaller one: shards, and slots joined by salt
    rng = random.Random(limit)
    letters = "abcé \n😀"
    said = lambda n: "".join(rng.choices(letters, k=n))
    jobs = {i: (rng.choice([None, said(5).upper()]), rng.choice([None, "", said(40)])) for i in range(120)}
    rules = [(f"s{rng.randint(0, 5)}", rng.choice(["include", "exclude"]), rng.choice([said(rng.randint(1, 5)), said(3).upper(), " ", "x😀y"])) for _ in range(40)]
    members = [(f"s{s}", j) for s in range(8) for j in jobs if rng.random() < 0.5]
    found = keyword_index.stage_2_of_slots(spark.createDataFrame([(i, *t) for i, t in jobs.items()], JOBS), spark.createDataFrame(members, "slot_id string, job_id int"), spark.createDataFrame(rules, RULES))
    assert {tuple(r) for r in found.collect()} == asked(jobs, members, rules)


def test_no_rules_and_no_jobs(spark):
    jobs = spark.createDataFrame([(1, "a", "b")], JOBS)
    members = spark.createDataFrame([("s", 1)], "slot_id string, job_id int")
    none = spark.createDataFrame([], RULES)
    assert [r["stage2_status"] for r in keyword_index.stage_2_of_slots(jobs, members, none).collect()] == [schema.PASSED_2]
    assert keyword_index.stage_2_of_slots(jobs.where("false"), members.where("false"), none).count() == 0


def test_texts_are_not_shuffled(spark):
    jobs = spark.createDataFrame([(1, "a", "b")], JOBS)
    words = spark.createDataFrame([("s", "include", "word")], RULES)
    plan = keyword_index.found(jobs, words)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BroadcastHashJoin" in plan
    assert not any("_hay" in line for line in plan.splitlines() if "Exchange" in line)
    assert sorted(r["gram"] for r in keyword_index.index(words).collect()) == ["ord"]
