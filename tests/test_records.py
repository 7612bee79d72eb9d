"""Surrogate ids, cursors of many sources, and the record queries against their SQL."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftline import record_queries  # noqa: F401  (registers its queries)
from siftline.operators import store, surrogates
from siftline.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_ids_without_gaps(spark, ranges):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(9)]), "x") for i in rng.sample(range(5000), 400)]
    new = spark.createDataFrame(rows, "key int, at int, _n string").repartition(6)
    out = surrogates.numbered(new, [F.asc_nulls_last("at"), F.asc("key")], 70, ranges=ranges)
    wanted = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    assert [(r["key"], r["id"], r["_n"]) for r in out.orderBy("id").collect()] == [(k, 71 + i, "x") for i, k in enumerate(wanted)]


def test_ids_of_ties_and_of_nothing(spark):
    same = spark.createDataFrame([(1,)] * 50, "at int")
    out = surrogates.numbered(same, [F.asc("at")], ranges=7)
    assert sorted(r["id"] for r in out.collect()) == list(range(1, 51)) == sorted(r["id"] for r in out.collect())
    assert surrogates.numbered(same.where("false"), [F.asc("at")]).count() == 0


def test_cursors(spark):
    known = spark.createDataFrame([("s", "dou_ua", "c1"), ("s", "djinni", None)], "slot_id string, source_id string, cursor string")
    asked = spark.createDataFrame([("s", " DOU_ua "), ("s", "djinni"), ("t", "dou_ua"), ("s", None), (None, "dou_ua"), ("s", "dou_ua")], "slot_id string, source_id string")
    found = sorted((r["slot_id"] or "", r["source_id"] or "", r["cursor"]) for r in store.cursors(known, asked).collect())
    assert found == [("", "dou_ua", ""), ("s", "", ""), ("s", " DOU_ua ", "c1"), ("s", "djinni", ""), ("s", "dou_ua", "c1"), ("t", "dou_ua", "")]
    assert [store.cursor(known, "s", "DOU_UA"), store.cursor(known, "t", "dou_ua")] == ["c1", ""]


NAMES = [n for n, q in QUERIES.items() if q.__module__ == record_queries.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_record_queries_agree_with_their_sql(spark, name):
    import duckdb

    told = duckdb.connect()
    for t in ("documents", "events", "labels", "pages"):
        told.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = QUERIES[name](spark, SF)
    wanted = told.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, wanted)) and wanted


def test_filter_keys_of_rows_are_those_of_one(spark):
    from datetime import UTC, datetime

    from siftline.functions.identity import FilterKey, canonical_filter

    rng = random.Random(3)
    odd = ["Go", " go ", "a<b>&c", 'say "x"', "back\\slash", "tab\there", "\x01\x1f\b\f", "  ", "é Ü 你", "", "  ", "\x7f"]
    slot = "0000000A-0000-0000-0000-00000000000b"
    rows = []
    for i in range(80):
        some = [rng.choices(odd, k=rng.randint(0, 4)) for _ in range(3)]
        window = tuple(datetime(2024, 3, 31, rng.randrange(24), 5, 7, rng.choice([0, 500_000, 123_456, 10]), tzinfo=UTC) for _ in range(2)) if i % 3 else None
        rows.append((i, slot, rng.choice([None, " ", "Me"]), some[0], *(window or (None, None)), some[1], i % 2 == 0, some[2]))
    rows += [(100, "x", None, ["a"], None, None, None, None, None), (101, slot, None, None, datetime(2024, 1, 1, tzinfo=UTC), None, None, None, None), (102, "0" * 8 + "-0000-0000-0000-" + "0" * 12, None, ["a"], None, None, None, None, None)]
    names = ["slot_id", "user_id", "synonyms", "start", "stop", "sources", "remote_only", "countries"]
    table = spark.createDataFrame(rows, "i int, slot_id string, user_id string, synonyms array<string>, start timestamp, stop timestamp, sources array<string>, remote_only boolean, countries array<string>")
    found = {r["i"]: r["key"] for r in table.select("i", canonical_filter(*map(F.col, names)).alias("key")).collect()}
    assert found[100] is found[101] is found[102] is None
    for i, own, user, synonyms, start, stop, sources, remote, countries in rows[:80]:
        one = FilterKey(own, synonyms, (start, stop) if start else None, sources, remote, countries, user)
        try:
            wanted = one.canonical()
        except ValueError:
            wanted = None
        assert found[i] == wanted, i
