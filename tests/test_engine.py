"""Readers, stages, stores and runs end to end on small tables."""

from __future__ import annotations

import json
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftline import schema
from siftline.functions.places import Countries
from siftline.operators import listing, stages, store
from siftline.operators.stages import BroadRules, KeywordRules
from siftline.plans import ledger
from siftline.plans.runs import Engine, Kind, Request
from siftline.plans.slots import Conflict, Slots
from siftline.sources import boards

NOW = datetime(2026, 4, 10)
PAGE = "page int, url string, body string"


def some_jobs(spark, n=22):
    rows = [(f"j{i:02}", "s", f"Go dev {i}", "C", f"https://x.y/{i}", "backend work", datetime(2026, 4, 5, i)) for i in range(n)]
    jobs = spark.createDataFrame(rows, "id string, source string, title string, company string, url string, description string, posted_at timestamp")
    names = [f.split() for f in schema.JOB_FIELDS.split(", ")]
    return jobs.select(*[F.col(n) if n in jobs.columns else F.lit(None).cast(k).alias(n) for n, k in names])


@pytest.fixture
def engine(spark):
    return Engine(spark, tempfile.mkdtemp(prefix="engine-"), lambda: NOW)


def test_stage_3_takes_20_of_22(spark, engine):
    engine.ingest("slot", "s", some_jobs(spark), BroadRules())
    request = Request(Kind.PIPELINE_STAGE2_THEN_STAGE3, "slot", profile="p", keywords=KeywordRules(include=("backend",)))
    out = engine.run(request, scorer=lambda *_: '{"score": 80, "rationale": "fits"}')
    assert (out["stage2_passed"], out["stage3_passed"], out["stage3_scored"]) == (22, 20, 20)
    assert schema.broken_run_jobs(engine.run_jobs()).isEmpty()
    assert listing.eligible(engine.listed(), engine.run_jobs(), out["run_id"]).count() == 2


def test_ingest_twice_skips(spark, engine):
    assert engine.ingest("slot", "s", some_jobs(spark, 3), BroadRules()) == {"written": 3, "skipped": 0, "filtered": 0}
    with pytest.raises(ledger.Cooling):
        engine.ingest("slot", "s", some_jobs(spark, 3), BroadRules())
    changed = some_jobs(spark, 4).withColumn("description", F.when(F.col("id") == "j01", "new").otherwise(F.col("description")))
    assert engine.ingest("slot", "s", changed, BroadRules(), refresh=True) == {"written": 2, "skipped": 2, "filtered": 0}
    assert engine.slot_jobs().count() == 4


def test_repeated_rows_of_an_ingest(spark, engine):
    rows = some_jobs(spark, 3)
    last = rows.where("id = 'j01'").withColumn("title", F.lit("Last"))
    old = rows.where("id = 'j02'").withColumn("posted_at", F.lit(datetime(2020, 1, 1)))
    told = engine.ingest("slot", "s", rows.unionByName(last).unionByName(old).coalesce(1), BroadRules())
    assert told == {"written": 3, "skipped": 1, "filtered": 1}
    assert {r["id"]: r["title"] for r in engine.jobs().collect()}["j01"] == "Last"


def test_runs_keep_the_hash_of_their_rules(spark, engine):
    slot = "00000000-0000-0000-0000-000000000001"
    request = Request(Kind.PIPELINE_STAGE2, slot, broad=BroadRules(synonyms=("Go",)))
    run = engine.run(request)["run_id"]
    engine.run(Request(Kind.PIPELINE_STAGE2, "slot"))
    assert [r["broad_filter_key_hash"] for r in engine.runs().orderBy("id").collect()] == [request.key().digest(), None] and run == 1


def test_a_model_scores(spark):
    jobs = spark.createDataFrame([("T", None, "D")], "title string, company string, description string")
    reply = lambda answer: lambda prompt: json.dumps({"content": [{"type": "text", "text": answer}, {"type": "x", "text": "no"}]})
    row = stages.scored_by_model(jobs, "p", reply(' {"score": 7, "rationale": "r"} ')).first()
    assert (row["score"], row["reason"]) == (7, "r")
    with pytest.raises(Exception, match="bad answer"):
        stages.scored_by_model(jobs, "p", reply('{"score": 101, "rationale": "r"}')).collect()


def test_bad_status_changes_are_errors(spark):
    rows = spark.createDataFrame([(1, "a", schema.PASSED_2, schema.PASSED_3, None), (1, "b", schema.REJECTED_2, None, None)], schema.RUN_JOBS)
    for job, status in (("a", schema.REJECTED_3), ("b", schema.PASSED_3), ("c", schema.PASSED_3), ("b", "x"), (" ", schema.PASSED_2)):
        with pytest.raises(ValueError):
            store.with_status(rows, spark.createDataFrame([(1, job, status)], "pipeline_run_id bigint, job_id string, status string"))
    told = store.with_status(rows, spark.createDataFrame([(1, "b", schema.PASSED_2), (1, "a", schema.REJECTED_2)], "pipeline_run_id bigint, job_id string, status string"))
    assert {r["job_id"]: r["stage2_status"] for r in told.collect()} == {"a": schema.PASSED_2, "b": schema.PASSED_2}


def test_slots_are_idempotent_and_limited(engine):
    slots = Slots(engine)
    keys = [f"00000000-0000-0000-0000-00000000000{i}" for i in range(1, 5)]
    first, new = slots.create(keys[0], "a")
    assert new and slots.create(keys[0], "a") == (first, False)
    with pytest.raises(Conflict):
        slots.create(keys[0], "b")
    slots.create(keys[1], "b")
    slots.create(keys[2], "c")
    with pytest.raises(Conflict):
        slots.create(keys[3], "d")
    slots.delete(first)
    assert slots.list().count() == 2


def test_rules_are_checked():
    with pytest.raises(ValueError):
        BroadRules(start=NOW)
    with pytest.raises(ValueError):
        Request(Kind.INGEST_SOURCES, "slot")
    with pytest.raises(ValueError):
        listing.Page(0)
    assert stages.cap(request=5) == 5 and stages.cap(request=500) == 20


def test_himalayas(spark):
    job = {"title": "Welder", "companyName": "Ore & Co", "guid": "https://ore.example/w/77", "locationRestrictions": ["Peru"], "timezoneRestrictions": [-5.0], "description": "<p>Remote</p>", "pubDate": 1700000000, "minSalary": 4321.0}
    pages = spark.createDataFrame([(1, "", json.dumps({"jobs": [job], "offset": 0, "limit": 20, "totalCount": 1}))], PAGE)
    row = boards.himalayas(pages, Countries({"Peru": "PE"})).first()
    assert (row["country_code"], row["timezone_offsets"], row["is_remote"], row["posted_at"].timestamp(), row["salary_raw"]) == ("PE", [-5.0], True, 1700000000, "4321+ ")


def test_himalayas_without_a_total_reads_on(spark):
    def page(n, ids, total):
        made = [{"title": "T", "companyName": "C", "guid": f"https://h.example/{i}"} for i in ids]
        return n, "", json.dumps({"jobs": made, "offset": 2 * (n - 1), "limit": 2, "totalCount": total})

    read = lambda total: boards.himalayas(spark.createDataFrame([page(1, [1, 2], total), page(2, [3, 4], total), page(3, [5], total), page(4, [6, 7], total)], PAGE), Countries({})).count()
    assert (read(0), read(4)) == (5, 4)


def test_bad_items_fail_whatever_is_read(spark):
    pages = spark.createDataFrame([(1, "", json.dumps({"jobs": [{"title": "T", "companyName": " ", "guid": "https://h.example/1"}], "offset": 0, "limit": 20}))], PAGE)
    with pytest.raises(Exception, match="no company"):
        boards.himalayas(pages, Countries({})).select("is_remote", "title").collect()
    card = spark.createDataFrame([(1, "https://d.co/jobs/", '<li><a href="/jobs/7-dev/"><h2 class="job-item__position">Dev</h2></a></li>')], PAGE)
    with pytest.raises(Exception, match="without a posting"):
        boards.djinni(card, card.where("false"), Countries({})).select("title").collect()


@pytest.mark.parametrize(
    ("page", "token"),
    [
        ("var X = {nonce:'aa'}; var ERJ = {url:'u',nonce:'b-7'}; var Y = {nonce:'cc'};", "b-7"),
        ("var ERJ = {i18n: {a: 'b'},\n nonce : 'n1'}", "n1"),
        ("var ERJ={nonce:'n1'}; var ERJ = {nonce:'n2'};", "n1"),
        ("""var ERJ = {"nonce":"q", nonce: "d", nonce: 's'}""", "s"),
        ("var X = {nonce:'aa'};", None),
        ("var ERJ = {nonce:''}", None),
    ],
)
def test_feed_token(spark, page, token):
    told = spark.range(1).select(boards.feed_token(F.lit(page)).alias("t"))
    if token is None:
        with pytest.raises(Exception, match="no feed token"):
            told.first()
    else:
        assert told.first()["t"] == token


def test_snapshots_outlive_a_write_that_stops(spark, tmp_path):
    tables = store.Snapshots(spark, str(tmp_path))
    for n in (1, 2, 3):
        tables.write("t", spark.range(n))
    assert sorted(x.name for x in (tmp_path / "t").iterdir()) == ["v2", "v3"]
    (tmp_path / "t" / "v4").mkdir()  # a write that never ended
    assert (tables.version("t"), tables.read("t", "id bigint").count()) == (3, 3)
    tables.write("t", spark.range(5))
    assert tables.read("t", "id bigint").count() == 5 and tables.read("none", "id bigint").count() == 0


def test_djinni(spark):
    card = '<li><a href="/jobs/7-dev/"><h2 class="job-item__position">Dev</h2></a><div class="job-item__tags"><span class="badge">React</span></div></li>'
    posting = {"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "C"}, "category": "Fullstack", "datePosted": "2026-04-01T10:00:00.5", "jobLocationType": "TELECOMMUTE", "applicantLocationRequirements": {"address": {"addressCountry": "ua"}}}
    detail = f'<script type="application/ld+json">{json.dumps(posting)}</script>'
    pages = spark.createDataFrame([(1, "https://d.co/jobs/", card)], PAGE)
    row = boards.djinni(pages, spark.createDataFrame([(1, "https://d.co/jobs/7-dev", detail)], PAGE), Countries({})).first()
    assert (row["id"], row["tags"], row["country_code"], row["is_remote"], row["position"]) == ("djinni\u001ehttps://d.co/jobs/7-dev", ["Fullstack", "React"], "UA", True, "full-stack")


def test_failed_sources_are_isolated(spark):
    def broken():
        raise OSError("down")

    found = boards.union(spark, {"a": lambda: some_jobs(spark, 2), "b": broken})
    assert found.jobs.count() == 2 and found.errors == {"b": "down"}
    with pytest.raises(RuntimeError):
        boards.union(spark, {"b": broken})


@pytest.mark.parametrize("board", ["working_nomads", "himalayas", "europe_remotely", "dou", "djinni", "builtin"])
def test_board_queries_agree_with_their_sql(spark, board):
    import duckdb

    from siftline import board_queries  # noqa: F401
    from siftline.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    found = QUERIES[f"board_{board}"](spark, folder)
    told = duckdb.connect()
    told.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ", ".join(found.columns)
    wanted = told.execute(f"SELECT {names} FROM ({ORACLE_SQL[f'board_{board}']})").fetchall()
    assert wanted and sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
