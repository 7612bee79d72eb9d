"""Registered queries of the engine and the SQL that gives the same rows.

The reference tables don't hold listings, so views make them from the given ones: documents are jobs, events give their
dates, labels their scores.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import dates, identity, lists, pay, places, text
from .operators import listing, stages, store
from .operators.listing import Page
from .operators.stages import BroadRules, KeywordRules
from .sources import boards

CLOCK = datetime(2024, 1, 31)
SYNONYMS = ("the", "que")
COUNTRIES = ("gb", " FR ")
KEYWORDS = KeywordRules(include=("ing", "tion"), exclude=("license", "zz"))

# ---- views ---------------------------------------------------------------------------------------------------------

_JOBS = """
    SELECT d.doc_id AS job_id, d.source, substring(d.text, 1, 40) AS title, d.text AS description,
           CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE e.ts END AS posted_at,
           CASE WHEN d.doc_id % 3 = 0 THEN NULL WHEN d.doc_id % 3 = 1 THEN true ELSE false END AS is_remote,
           CASE d.lang WHEN 'en' THEN 'GB' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' ELSE '' END AS country_code,
           d.doc_id % 4 AS slot_no
    FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id * 10"""
_HAY = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"
_WINDOW = "posted_at BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"
_ROLE = f"(contains({_HAY}, 'the') OR contains({_HAY}, 'que'))"
_COUNTRY = "upper(trim(country_code)) IN ('FR', 'GB')"
_INCLUDE = f"(contains({_HAY}, 'ing') OR contains({_HAY}, 'tion'))"
_EXCLUDE = f"(contains({_HAY}, 'license') OR contains({_HAY}, 'zz'))"
_PASS = f"({_INCLUDE} AND NOT {_EXCLUDE})"
_WITH = f"""WITH jobs AS ({_JOBS}),
    slot_jobs AS (SELECT slot_no AS slot_id, job_id, TIMESTAMP '2024-01-01 00:00:00' AS first_seen_at FROM jobs),
    runs AS (SELECT slot_no * 10 + n AS id, slot_no AS slot_id FROM (SELECT DISTINCT slot_no FROM jobs) s CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) t),
    run_jobs AS (
        SELECT j.slot_no * 10 + 2 AS pipeline_run_id, j.job_id,
               CASE WHEN {_PASS} THEN 'PASSED_STAGE_2' ELSE 'REJECTED_STAGE_2' END AS stage2_status,
               CASE WHEN {_PASS} AND l.quality IS NOT NULL THEN CASE WHEN 40 + 40 * l.quality >= 60 THEN 'PASSED_STAGE_3' ELSE 'REJECTED_STAGE_3' END END AS stage3_status,
               CASE WHEN {_PASS} AND l.quality IS NOT NULL THEN 'score ' || CAST(40 + 40 * l.quality AS VARCHAR(10)) END AS stage3_rationale
        FROM jobs j LEFT JOIN labels l ON l.doc_id = j.job_id)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as jobs."""
    d = table(spark, sf_dir, "documents").alias("d")
    e = table(spark, sf_dir, "events").select("event_id", "ts").alias("e")
    third, code = F.col("doc_id") % 3, F.col("lang")
    return d.join(e, F.col("e.event_id") == F.col("d.doc_id") * 10, "left").select(
        F.col("doc_id").alias("job_id"),
        "source",
        F.substring("text", 1, 40).alias("title"),
        F.col("text").alias("description"),
        F.when(F.col("doc_id") % 17 != 0, F.col("ts")).alias("posted_at"),
        F.when(third == 1, True).when(third == 2, False).alias("is_remote"),
        F.when(code == "en", "GB").when(code == "fr", "FR").when(code == "de", "DE").otherwise("").alias("country_code"),
        (F.col("doc_id") % 4).alias("slot_no"),
    )


def slot_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return ids.select((F.col("doc_id") % 4).alias("slot_id"), F.col("doc_id").alias("job_id"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("first_seen_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("slot_id")).distinct()
    return slots.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select((F.col("slot_id") * 10 + F.col("n")).alias("id"), "slot_id")


def run_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), (40 + 40 * F.col("quality")).alias("score"))
    told = stages.stage_2(jobs(spark, sf_dir), KEYWORDS).join(labels, "job_id", "left")
    final = (F.col("stage2_status") == schema.PASSED_2) & F.col("score").isNotNull()
    return told.select(
        (F.col("slot_no") * 10 + 2).alias("pipeline_run_id"),
        "job_id",
        "stage2_status",
        F.when(final, stages.status_of(F.col("score"))).alias("stage3_status"),
        F.when(final, F.concat(F.lit("score "), F.col("score").cast("string"))).alias("stage3_rationale"),
    )


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# ---- stages --------------------------------------------------------------------------------------------------------

_SHOWN = ["job_id", "source", "posted_at", "is_remote", "country_code"]


def _broad(spark, sf_dir, **rules) -> DataFrame:
    return stages.broad(jobs(spark, sf_dir), BroadRules(**rules), CLOCK).select(*_SHOWN)


def _broad_sql(*more: str) -> str:
    return f"{_WITH} SELECT {', '.join(_SHOWN)} FROM jobs WHERE {' AND '.join((_WINDOW, *more))}"


@query(_broad_sql())
def stage1_window(spark, sf_dir):
    return _broad(spark, sf_dir)


@query(_broad_sql(_ROLE))
def stage1_role(spark, sf_dir):
    return _broad(spark, sf_dir, synonyms=SYNONYMS)


@query(_broad_sql("is_remote"))
def stage1_remote(spark, sf_dir):
    return _broad(spark, sf_dir, remote_only=True)


@query(_broad_sql(_COUNTRY))
def stage1_country(spark, sf_dir):
    return _broad(spark, sf_dir, countries=COUNTRIES)


@query(_broad_sql(_ROLE, "is_remote", _COUNTRY))
def stage1_full(spark, sf_dir):
    return _broad(spark, sf_dir, synonyms=SYNONYMS, remote_only=True, countries=COUNTRIES)


@query(f"{_WITH} SELECT job_id, CASE WHEN {_PASS} THEN 'PASSED_STAGE_2' ELSE 'REJECTED_STAGE_2' END AS stage2_status FROM jobs")
def stage2_partition(spark, sf_dir):
    return stages.stage_2(jobs(spark, sf_dir), KEYWORDS).select("job_id", "stage2_status")


@query(f"{_WITH} SELECT job_id, source FROM jobs WHERE {_INCLUDE}")
def stage2_include_only(spark, sf_dir):
    return jobs(spark, sf_dir).where(stages.keywords(KeywordRules(include=KEYWORDS.include))).select("job_id", "source")


@query(f"{_WITH} SELECT job_id, source FROM jobs WHERE NOT {_EXCLUDE}")
def stage2_exclude_only(spark, sf_dir):
    return jobs(spark, sf_dir).where(stages.keywords(KeywordRules(exclude=KEYWORDS.exclude))).select("job_id", "source")


@query(f"{_WITH} SELECT source, CASE WHEN {_PASS} THEN 'PASSED_STAGE_2' ELSE 'REJECTED_STAGE_2' END AS stage2_status, count(*) AS n FROM jobs GROUP BY 1, 2")
def stage2_counts(spark, sf_dir):
    return stages.stage_2(jobs(spark, sf_dir), KEYWORDS).groupBy("source", "stage2_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{_WITH}, e AS (SELECT j.job_id, j.posted_at FROM jobs j JOIN run_jobs r USING (job_id) WHERE pipeline_run_id = 12 AND stage2_status = 'PASSED_STAGE_2' AND stage3_status IS NULL) "
    "SELECT job_id, posted_at FROM e WHERE job_id % 5 <> 0 ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 20"
)
def stage3_batch(spark, sf_dir):
    waiting = listing.eligible(jobs(spark, sf_dir), run_jobs(spark, sf_dir), 12)
    sent = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("job_id"))
    return stages.batch(waiting, sent, stages.cap(request=50)).select("job_id", "posted_at")


@query("SELECT doc_id AS job_id, 40 + 40 * quality AS score, CASE WHEN 40 + 40 * quality >= 60 THEN 'PASSED_STAGE_3' ELSE 'REJECTED_STAGE_3' END AS status FROM labels")
def stage3_status(spark, sf_dir):
    score = 40 + 40 * F.col("quality")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), score.alias("score"), stages.status_of(score).alias("status"))


@query("SELECT doc_id AS job_id, 20 * (quality + toxic) AS score, 'label ' || CAST(quality AS VARCHAR) AS reason FROM labels")
def stage3_answers(spark, sf_dir):
    answer = F.to_json(F.struct((20 * (F.col("quality") + F.col("toxic"))).alias("score"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("rationale")))
    parsed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), stages.parsed_answer(answer).alias("p"))
    return parsed.select("job_id", "p.score", "p.reason")


# ---- lists ---------------------------------------------------------------------------------------------------------


@query(f"{_WITH} SELECT j.job_id, j.source, j.posted_at FROM jobs j JOIN slot_jobs s USING (job_id) WHERE s.slot_id = 1 AND posted_at IS NOT NULL")
def slot_pool_join(spark, sf_dir):
    passed = jobs(spark, sf_dir).withColumn("stage1_status", F.when(F.col("posted_at").isNotNull(), schema.PASSED_1))
    return listing.passed_stage_1(passed, slot_jobs(spark, sf_dir), 1).select("job_id", "source", "posted_at")


@query(f"{_WITH} SELECT j.job_id, j.source, j.posted_at FROM jobs j JOIN slot_jobs s USING (job_id) WHERE s.slot_id = 2 ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 20 OFFSET 40")
def stage1_page(spark, sf_dir):
    return listing.page(listing.pool(jobs(spark, sf_dir), slot_jobs(spark, sf_dir), 2), Page(3, 20)).select("job_id", "source", "posted_at")


_LIST = f"{_WITH} SELECT j.job_id, j.posted_at, r.stage2_status, r.stage3_status FROM jobs j JOIN slot_jobs s USING (job_id) JOIN run_jobs r USING (job_id) WHERE s.slot_id = 1 AND r.pipeline_run_id = 12"


@query(f"{_LIST} AND stage2_status = 'PASSED_STAGE_2' ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 50 OFFSET 50")
def run_stage2_page(spark, sf_dir):
    rows = listing.stage_2_list(jobs(spark, sf_dir), slot_jobs(spark, sf_dir), run_jobs(spark, sf_dir), 1, 12, schema.PASSED_2)
    return listing.page(rows, Page(2)).select("job_id", "posted_at", "stage2_status", "stage3_status")


@query(f"{_LIST} AND stage3_status IN ('PASSED_STAGE_3', 'REJECTED_STAGE_3') ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 30")
def run_stage3_page(spark, sf_dir):
    rows = listing.stage_3_list(jobs(spark, sf_dir), slot_jobs(spark, sf_dir), run_jobs(spark, sf_dir), 1, 12)
    return listing.page(rows, Page(1, 30)).select("job_id", "posted_at", "stage2_status", "stage3_status")


@query(f"WITH x AS ({_LIST}) SELECT count(*) AS total FROM x")
def list_total(spark, sf_dir):
    return listing.total(listing.stage_2_list(jobs(spark, sf_dir), slot_jobs(spark, sf_dir), run_jobs(spark, sf_dir), 1, 12))


@query(f"{_WITH} SELECT j.job_id, j.posted_at FROM jobs j JOIN run_jobs r USING (job_id) WHERE pipeline_run_id = 22 AND stage2_status = 'PASSED_STAGE_2'")
def passed_stage2_jobs(spark, sf_dir):
    return listing.passed_stage_2(jobs(spark, sf_dir), run_jobs(spark, sf_dir), 22).select("job_id", "posted_at")


@query(f"{_WITH} SELECT j.job_id, j.posted_at FROM jobs j JOIN run_jobs r USING (job_id) WHERE pipeline_run_id = 12 AND stage2_status = 'PASSED_STAGE_2' AND stage3_status IS NULL")
def eligible_ids(spark, sf_dir):
    return listing.eligible(jobs(spark, sf_dir), run_jobs(spark, sf_dir), 12)


@query(f"{_WITH} SELECT job_id, coalesce(nullif(stage3_status, ''), stage2_status) AS status FROM run_jobs")
def effective_status(spark, sf_dir):
    return run_jobs(spark, sf_dir).select("job_id", listing.effective_status().alias("status"))


@query(
    f"{_WITH} SELECT pipeline_run_id, count(*) FILTER (WHERE stage2_status = 'PASSED_STAGE_2') AS stage2_passed, count(*) FILTER (WHERE stage2_status = 'REJECTED_STAGE_2') AS stage2_rejected, "
    "count(stage3_status) AS stage3_scored, count(*) FILTER (WHERE stage3_status = 'PASSED_STAGE_3') AS stage3_passed, count(*) FILTER (WHERE stage3_status = 'REJECTED_STAGE_3') AS stage3_rejected "
    "FROM run_jobs GROUP BY 1"
)
def stage3_aggregate(spark, sf_dir):
    return listing.aggregate(run_jobs(spark, sf_dir))


@query(f"{_WITH} SELECT slot_id, max(id) AS run_id FROM runs GROUP BY 1")
def latest_run(spark, sf_dir):
    return listing.latest_run(runs(spark, sf_dir))


# ---- writes --------------------------------------------------------------------------------------------------------

_OLD = """o AS (SELECT doc_id AS id, source, substring(text, 1, 40) AS title, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS description,
        CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'PASSED_STAGE_1' END AS stage1_status FROM documents WHERE doc_id % 3 <> 0),
    n AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 11 = 0 THEN substring(text, 1, 40) || '?' ELSE substring(text, 1, 40) END AS title, text AS description FROM documents WHERE doc_id % 4 <> 0)"""
_ACTION = """CASE WHEN n.id IS NULL THEN NULL WHEN o.id IS NULL THEN 'INSERT' WHEN o.title <> n.title OR o.stage1_status IS NULL THEN 'FULL_UPDATE'
        WHEN o.description = n.description THEN 'SKIP' ELSE 'DESCRIPTION_ONLY' END"""


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A job table from before, and rows that come in."""
    d = table(spark, sf_dir, "documents")
    names = [f.split() for f in schema.JOB_FIELDS.split(", ")]

    def full(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(n).alias(n) if n in rows.columns else F.lit(None).cast(kind).alias(n) for n, kind in names])

    title = F.substring("text", 1, 40)
    old = full(
        d.where("doc_id % 3 <> 0").select(
            F.col("doc_id").alias("id"), "source", title.alias("title"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("description"),
            F.array(F.lit("b"), F.lit("a")).alias("tags"), F.when(F.col("doc_id") % 5 != 0, schema.PASSED_1).alias("stage1_status"),
        )
    )
    new = full(
        d.where("doc_id % 4 <> 0").select(
            F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 11 == 0, F.concat(title, F.lit("?"))).otherwise(title).alias("title"), F.col("text").alias("description"), F.array(F.lit("a"), F.lit("b")).alias("tags"),
        )
    )
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    return old.withColumn("created_at", at).withColumn("updated_at", at), new


@query(f"WITH {_OLD} SELECT n.id, {_ACTION} AS action FROM n LEFT JOIN o ON o.id = n.id")
def ingest_action(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    return store.classified(old, new).where("action is not null").select("n.id", "action")


@query(
    f"""WITH {_OLD}, m AS (SELECT o.id AS oid, n.id AS nid, o.title AS ot, n.title AS nt, o.description AS od, n.description AS nd, o.stage1_status AS os, {_ACTION} AS action FROM o FULL JOIN n ON o.id = n.id)
    SELECT coalesce(nid, oid) AS id, CASE WHEN action IN ('INSERT', 'FULL_UPDATE') THEN nt ELSE ot END AS title,
           CASE WHEN action IN ('INSERT', 'FULL_UPDATE', 'DESCRIPTION_ONLY') THEN nd ELSE od END AS description,
           CASE WHEN action IN ('INSERT', 'FULL_UPDATE') THEN 'PASSED_STAGE_1' ELSE os END AS stage1_status,
           CASE WHEN action = 'INSERT' THEN 31 ELSE 1 END AS created_day, CASE WHEN action IN ('INSERT', 'FULL_UPDATE', 'DESCRIPTION_ONLY') THEN 31 ELSE 1 END AS updated_day FROM m"""
)
def ingest_upsert(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    out = store.upsert(old, new, CLOCK)
    return out.select("id", "title", "description", "stage1_status", F.dayofmonth("created_at").alias("created_day"), F.dayofmonth("updated_at").alias("updated_day"))


@query(
    f"""WITH {_OLD} SELECT coalesce(n.source, d.source) AS source, count(*) FILTER (WHERE {_ACTION} IN ('INSERT', 'FULL_UPDATE', 'DESCRIPTION_ONLY')) AS written,
        count(*) FILTER (WHERE {_ACTION} = 'SKIP') AS skipped, count(*) FILTER (WHERE n.id IS NULL) AS filtered
    FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN o ON o.id = d.doc_id GROUP BY 1"""
)
def ingest_counters(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    acts = store.classified(old, new).where("action is not null").select(F.col("n.id").alias("doc_id"), "action")
    return stages.Counters().of(table(spark, sf_dir, "documents").select("doc_id", "source").join(acts, "doc_id", "left"))


@query(
    f"""{_WITH}, c AS (SELECT source, count(*) AS written, count(*) FILTER (WHERE is_remote) AS skipped FROM jobs GROUP BY 1)
    SELECT string_agg(source || '=' || CAST(written AS VARCHAR) || '/' || CAST(skipped AS VARCHAR), ',' ORDER BY source) AS outputs FROM c"""
)
def ingest_outputs(spark, sf_dir):
    counts = jobs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("written"), F.count_if("is_remote").alias("skipped"))
    told = listing.by_source(counts.withColumns({"filtered": F.lit(0), "error": F.lit(None).cast("string")}))
    spelled = F.transform(F.map_entries("outputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["written"].cast("string"), F.lit("/"), e["value"]["skipped"].cast("string")))
    return told.select(F.array_join(spelled, ",").alias("outputs"))


@query(f"{_WITH} SELECT slot_id, job_id, CASE WHEN job_id % 2 = 0 THEN 1 ELSE 31 END AS first_seen_day FROM slot_jobs")
def slot_membership_upsert(spark, sf_dir):
    every = slot_jobs(spark, sf_dir)
    new = every.withColumn("first_seen_at", F.lit(CLOCK).cast("timestamp_ntz"))
    out = store.kept_first(every.where("job_id % 2 = 0"), new.unionByName(new), "slot_id", "job_id")
    return out.select("slot_id", "job_id", F.dayofmonth("first_seen_at").alias("first_seen_day"))


@query(f"{_WITH} SELECT job_id, stage2_status, CASE WHEN pipeline_run_id <> 12 THEN stage3_status END AS stage3_status, CASE WHEN pipeline_run_id <> 12 THEN stage3_rationale END AS stage3_rationale FROM run_jobs")
def invalidate_stage3(spark, sf_dir):
    return store.without_stage_3(run_jobs(spark, sf_dir), runs(spark, sf_dir), 1).select("job_id", "stage2_status", "stage3_status", "stage3_rationale")


@query(f"{_WITH} SELECT count(*) AS affected FROM run_jobs WHERE pipeline_run_id = 12 AND stage3_status IS NOT NULL")
def invalidate_stage3_count(spark, sf_dir):
    return store.affected_by_stage_3(run_jobs(spark, sf_dir), runs(spark, sf_dir), 1)


@query(f"{_WITH} SELECT pipeline_run_id, job_id, stage2_status FROM run_jobs WHERE pipeline_run_id <> 12")
def invalidate_stage23(spark, sf_dir):
    return store.without_runs(runs(spark, sf_dir), run_jobs(spark, sf_dir), 1)[1].select("pipeline_run_id", "job_id", "stage2_status")


@query(
    f"""{_WITH} SELECT job_id, CASE WHEN job_id = 1 THEN 'REJECTED_STAGE_2' ELSE stage2_status END AS stage2_status, CASE WHEN job_id <> 1 THEN stage3_status END AS stage3_status,
        CASE WHEN job_id <> 1 THEN stage3_rationale END AS stage3_rationale FROM run_jobs"""
)
def patch_stage2(spark, sf_dir):
    return store.patched(run_jobs(spark, sf_dir), 12, 1, 2, False).select("job_id", "stage2_status", "stage3_status", "stage3_rationale")


_FIRST_FINAL = "(SELECT min(job_id) FROM run_jobs WHERE pipeline_run_id = 12 AND stage3_status IS NOT NULL)"


@query(
    f"""{_WITH} SELECT job_id, stage2_status, CASE WHEN job_id = {_FIRST_FINAL} THEN 'REJECTED_STAGE_3' ELSE stage3_status END AS stage3_status,
        CASE WHEN job_id <> {_FIRST_FINAL} THEN stage3_rationale END AS stage3_rationale FROM run_jobs"""
)
def patch_stage3(spark, sf_dir):
    rows = run_jobs(spark, sf_dir)
    first = rows.where("pipeline_run_id = 12 and stage3_status is not null").agg(F.min("job_id")).first()[0]
    return store.patched(rows, 12, first, 3, False).select("job_id", "stage2_status", "stage3_status", "stage3_rationale")


@query(
    f"""{_WITH} SELECT job_id, CASE WHEN job_id % 2 = 0 THEN CASE WHEN stage3_status IS NOT NULL OR stage2_status = 'PASSED_STAGE_2' THEN 'NONE' ELSE 'SET_2' END
        WHEN stage2_status <> 'PASSED_STAGE_2' THEN 'ILLEGAL' WHEN stage3_status IS NULL THEN 'SET_3' WHEN stage3_status = 'PASSED_STAGE_3' THEN 'NONE' ELSE 'ILLEGAL' END AS change FROM run_jobs"""
)
def status_transitions(spark, sf_dir):
    rows = run_jobs(spark, sf_dir)
    wanted = rows.select("pipeline_run_id", "job_id", F.when(F.col("job_id") % 2 == 0, schema.PASSED_2).otherwise(schema.PASSED_3).alias("status"))
    return store.proposed(rows, wanted).select("job_id", "change")


@query(f"{_WITH} SELECT job_id, source FROM jobs WHERE posted_at >= TIMESTAMP '2024-01-24 00:00:00'")
def retention_keep(spark, sf_dir):
    stamped = jobs(spark, sf_dir).withColumn("created_at", F.col("posted_at"))
    return store.retained(stamped, store.cutoff(CLOCK)).select("job_id", "source")


@query(f"{_WITH} SELECT pipeline_run_id, job_id, stage2_status FROM run_jobs WHERE job_id IN (SELECT job_id FROM jobs WHERE posted_at >= TIMESTAMP '2024-01-24 00:00:00')")
def retention_cascade(spark, sf_dir):
    kept = store.retained(jobs(spark, sf_dir).withColumn("created_at", F.col("posted_at")), store.cutoff(CLOCK))
    return store.cascaded(run_jobs(spark, sf_dir), kept, "job_id", "job_id").select("pipeline_run_id", "job_id", "stage2_status")


@query(f"{_WITH} SELECT job_id, source FROM jobs WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = job_id)")
def not_sent_antijoin(spark, sf_dir):
    sent = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"))
    return jobs(spark, sf_dir).join(sent, "job_id", "left_anti").select("job_id", "source")


@query("SELECT user_id, event_type, max(ts) AS last_at FROM events WHERE ts + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2")
def cooldown_active(spark, sf_dir):
    from .plans import ledger

    held = table(spark, sf_dir, "events").withColumn("expires_at", F.col("ts") + F.expr(f"INTERVAL {schema.COOLDOWN_SECONDS} SECONDS"))
    return ledger.active(held, datetime(2024, 1, 30)).groupBy("user_id", "event_type").agg(F.max("ts").alias("last_at"))


@query("SELECT user_id, event_type, max(event_id) AS cursor FROM events GROUP BY 1, 2")
def watermark_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    keys = ("user_id", "event_type")
    old = events.where("event_id % 2 = 0").groupBy(*keys).agg(F.max("event_id").alias("cursor"))
    new = events.groupBy(*keys).agg(F.max("event_id").alias("cursor"))
    return store.replaced(old, new, *keys)


@query("SELECT doc_id, source FROM documents")
def union_sources(spark, sf_dir):
    """All documents as two sources, beside a third that fails."""
    given = {"id": F.col("doc_id"), "source": F.col("source")}
    fields = [f.split() for f in schema.JOB_FIELDS.split(", ")]
    docs = table(spark, sf_dir, "documents").select(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields))
    even = F.pmod(F.length("source"), F.lit(2)) == 0

    def broken():
        raise OSError("this source can't be read")

    found = boards.union(spark, {"even": lambda: docs.where(even), "odd": lambda: docs.where(~F.coalesce(even, F.lit(False))), "broken": broken})
    assert list(found.errors) == ["broken"]
    return found.jobs.select(F.col("id").cast("bigint").alias("doc_id"), "source")


# ---- scalar rules --------------------------------------------------------------------------------------------------

_URL_SQL = """regexp_extract(trim(url), '^(?i)(https?)://([^/?#]+)([^?#]*)', {})"""
_CANONICAL = (
    f"lower({_URL_SQL.format(1)}) || '://' || lower({_URL_SQL.format(2)}) || CASE WHEN {_URL_SQL.format(3)} = '/' THEN '/' ELSE regexp_replace({_URL_SQL.format(3)}, '/$', '') END"
)


@query(f"SELECT page_id, {_CANONICAL} AS canonical FROM pages WHERE regexp_matches(trim(url), '^(?i)https?://[^/?#]+')")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.canonical_url(F.col("url")).alias("canonical")).where("canonical is not null")


@query(f"SELECT page_id, 'board' || chr(30) || {_CANONICAL} AS id FROM pages WHERE regexp_matches(trim(url), '^(?i)https?://[^/?#]+')")
def stable_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.stable_id(F.lit(" Board "), F.col("url")).alias("id")).where("id is not null")


@query(f"WITH c AS (SELECT page_id, {_CANONICAL} AS canonical FROM pages WHERE regexp_matches(trim(url), '^(?i)https?://[^/?#]+')) SELECT canonical, min(page_id) AS page_id FROM c GROUP BY 1")
def url_dedupe_first(spark, sf_dir):
    from .sources.boards import first_of_each

    pages = table(spark, sf_dir, "pages").select("page_id", "url").where(identity.canonical_url(F.col("url")).isNotNull())
    return first_of_each(pages, F.col("url"), F.col("page_id")).select(F.col("_url").alias("canonical"), "page_id")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')) AS plain FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query()
def strip_html(spark, sf_dir):
    from .functions import markup

    return table(spark, sf_dir, "pages").select("page_id", markup.plain(F.col("html")).alias("plain"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM documents")
def collapse_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.col("text")).alias("collapsed"))


_TITLES = "CASE doc_id % 6 WHEN 0 THEN 'Front-End lead' WHEN 1 THEN 'Senior Backend' WHEN 2 THEN 'full stack, backend' WHEN 3 THEN ' FRONTEND ' WHEN 4 THEN 'Remote analyst' ELSE '' END"


def _titled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_TITLES).alias("title"), F.col("text").alias("body"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("Back End"), F.lit("Віддалено"))).alias("tags"))


_PARTS = f"lower(trim({_TITLES})) || ' ' || lower(trim(text)) || ' ' || CASE WHEN doc_id % 7 = 0 THEN 'back end віддалено ' ELSE '' END"


@query(
    f"""WITH h AS (SELECT doc_id, {_PARTS} AS h FROM documents) SELECT doc_id, CASE WHEN contains(h, 'full-stack') OR contains(h, 'full stack') OR contains(h, 'fullstack') THEN 'full-stack'
        WHEN contains(h, 'frontend') OR contains(h, 'front-end') OR contains(h, 'front end') THEN 'frontend' WHEN contains(h, 'backend') OR contains(h, 'back-end') OR contains(h, 'back end') THEN 'backend' END AS position FROM h"""
)
def infer_position(spark, sf_dir):
    return _titled(spark, sf_dir).select("doc_id", text.position(F.col("title"), F.col("body"), F.col("tags")).alias("position"))


@query(f"WITH h AS (SELECT doc_id, {_PARTS} AS h FROM documents) SELECT doc_id, contains(h, 'remote') OR contains(h, 'віддалено') AS is_remote FROM h")
def remote_rule(spark, sf_dir):
    return _titled(spark, sf_dir).select("doc_id", text.remote(F.col("title"), F.col("body"), F.col("tags")).alias("is_remote"))


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' WHEN 'UNITED STATES' THEN 'US' WHEN 'JAPAN' THEN 'JP' ELSE '' END AS code FROM nation")
def country_lookup(spark, sf_dir):
    known = places.Countries({"France": "fr", " Germany": "DE", "Japan": "jp"})
    return table(spark, sf_dir, "nation").select("n_nationkey", known.first(F.array(F.concat(F.lit("Remote, "), F.col("n_name"))), F.array(F.lit("worldwide"))).alias("code"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'En,src,b' ELSE lang || ',src,EN,b' END AS tags FROM documents")
def tags_dedupe(spark, sf_dir):
    first = F.when(F.col("lang") == "en", F.array(F.lit(" En"), F.lit(""))).otherwise(F.array("lang"))
    merged = lists.merged(first, F.array(F.lit("src"), F.lit("EN ")), F.array(F.lit("SRC"), F.lit("b")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(merged, ",").alias("tags"))


@query("SELECT doc_id, true AS unordered, doc_id % 2 <> 0 AS numbers FROM documents")
def lists_equal(spark, sf_dir):
    tags = lists.same_unordered(F.array("lang", "source"), F.array("source", "lang"))
    numbers = lists.same_numbers(F.array(F.lit(0.0), F.lit(5.5)), F.array((F.col("doc_id") % 2 - 1) * 0.0, F.lit(5.5)))
    return table(spark, sf_dir, "documents").select("doc_id", tags.alias("unordered"), numbers.alias("numbers"))


@query(
    """WITH b AS (SELECT doc_id, doc_id % 500 * 1000 AS a, doc_id % 700 * 1000 + 250 AS z FROM documents)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(a AS VARCHAR) || '-' || CAST(z AS VARCHAR) || '.5 EUR' WHEN 1 THEN CAST(a AS VARCHAR) || '+ EUR' ELSE 'up to ' || CAST(z AS VARCHAR) || '.5 EUR' END AS salary FROM b"""
)
def salary_text(spark, sf_dir):
    least = F.when(F.col("doc_id") % 3 != 2, (F.col("doc_id") % 500 * 1000).cast("double"))
    most = F.when(F.col("doc_id") % 3 != 1, F.col("doc_id") % 700 * 1000 + 250.5)
    return table(spark, sf_dir, "documents").select("doc_id", pay.from_bounds(least, most, F.lit(" EUR ")).alias("salary"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(doc_id % 50 + 1 AS INTEGER)) WHEN 1 THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(30 * CAST(doc_id % 50 + 1 AS INTEGER))
        WHEN 2 THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(doc_id % 50 + 1 AS INTEGER)) END AS posted_at FROM documents"""
)
def relative_date(spark, sf_dir):
    n = (F.col("doc_id") % 50 + 1).cast("string")
    shown = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Posted "), n, F.lit(" days ago"))).when(F.col("doc_id") % 4 == 1, F.concat(n, F.lit(" month ago"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("posted "), n, F.lit(" Hours ago"))).otherwise("yesterday")
    return table(spark, sf_dir, "documents").select("doc_id", dates.relative(shown, F.lit(CLOCK)).cast("timestamp_ntz").alias("posted_at"))


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN make_timestamp(2022, 4, doc_id % 28 + 1, 0, 0, 0) WHEN 1 THEN make_timestamp(2024, 1, doc_id % 28 + 1, 0, 0, 0)
        ELSE make_timestamp(2023, 12, doc_id % 28 + 1, 0, 0, 0) END AS posted_at FROM documents"""
)
def ukrainian_date(spark, sf_dir):
    day = (F.col("doc_id") % 28 + 1).cast("string")
    shown = F.when(F.col("doc_id") % 3 == 0, F.concat(day, F.lit(" квітня 2022"))).when(F.col("doc_id") % 3 == 1, F.concat(day, F.lit(" Січня"))).otherwise(F.concat(F.lit(" "), day, F.lit(" грудня. ")))
    return table(spark, sf_dir, "documents").select("doc_id", dates.ukrainian(shown, F.lit(CLOCK)).cast("timestamp_ntz").alias("posted_at"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id > 0 THEN make_timestamp(CAST(doc_id * 1000000 * 60 AS BIGINT)) END AS posted_at FROM documents")
def epoch_date(spark, sf_dir):
    seconds = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") * 60).cast("double")).when(F.col("doc_id") % 3 == 1, F.col("doc_id") + 0.5).otherwise(-F.col("doc_id").cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", dates.epoch(seconds).cast("timestamp_ntz").alias("posted_at"))


@query(
    """SELECT doc_id, sha256('{"slot_id":"00000000-0000-0000-0000-000000000001","role":"' || CASE lang WHEN 'de' THEN 'de dev' ELSE 'dev ' || lang END || '","sources":["' || lower(source) || '"],"keywords":["__remote_only__","country:' || lang || '"]}') AS key FROM documents"""
)
def filter_key_hash(spark, sf_dir):
    key = identity.filter_key(
        F.lit("00000000-0000-0000-0000-000000000001"), F.array(F.lit(" Dev"), F.upper("lang"), F.lit("dev"), F.lit("")), F.array(F.upper("source"), F.col("source")), F.array(F.concat(F.lit("country:"), F.upper("lang")), F.lit("__remote_only__"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))
