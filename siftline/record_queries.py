"""Registered queries of how rows are stored, compared and shown, over all rows, with SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import dates, identity, text
from .operators import listing, store, surrogates
from .queries import _WITH, jobs, query, run_jobs, runs, table


def _job_rows(documents: DataFrame, **fields: Column) -> DataFrame:
    """Documents as rows of the job schema; fields that are not given are null."""
    named = {"id": F.col("doc_id").cast("string")} | fields
    return documents.select(*[named.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in (f.split() for f in schema.JOBS.split(", "))])


# ---- the row codec -------------------------------------------------------------------------------------------------


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS source, CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(substring(text, 1, 40), '') END AS title, '' AS company,
        CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/' || doc_id END AS apply_url, CASE WHEN doc_id % 3 <> 0 THEN 'u' END AS user_id,
        CASE WHEN doc_id % 4 = 1 THEN 'PASSED_STAGE_1' END AS stage1_status, coalesce(text, '') AS description, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS n_tags, 0 AS n_offsets FROM documents"""
)
def stored_codec(spark, sf_dir):
    """Rows as they are stored: defaults for texts and lists, null for blank options."""
    n = F.col("doc_id")
    fifth = n % 5 != 0
    rows = _job_rows(
        table(spark, sf_dir, "documents"),
        source=F.col("source"),
        title=F.when(fifth, F.substring("text", 1, 40)),
        apply_url=F.when(n % 2 == 0, F.concat(F.lit("https://a.example/"), n.cast("string"))).otherwise(""),
        user_id=F.when(n % 3 == 0, "").otherwise("u"),
        stage1_status=F.when(n % 4 == 0, " \t").when(n % 4 == 1, " PASSED_STAGE_1 ").when(n % 4 == 2, ""),
        description=F.col("text"),
        tags=F.when(fifth, F.array(F.lit("a"), F.lit("b"))),
    )
    shown = ["id", "source", "title", "company", "apply_url", "user_id", "stage1_status", "description"]
    return store.encoded(rows).select(*shown, F.size("tags").alias("n_tags"), F.size("timezone_offsets").alias("n_offsets"))


_CASES = 20


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % {_CASES} IN (0, 12, 17, 19) THEN 'SKIP' WHEN doc_id % {_CASES} = 16 THEN 'DESCRIPTION_ONLY' ELSE 'FULL_UPDATE' END AS action FROM documents"""
)
def equivalence_of_fields(spark, sf_dir):
    """What an ingest does with rows that differ from the stored ones in one field, each field in turn.

    Cases 1 to 11 change one plain or optional field each, 12 reorders the tags, 13 repeats one, 14 changes and 15
    reorders the offsets, 16 changes the description, 17 has null for an empty text, 18 loses a date, 19 lists and
    status with defaults.
    """
    docs, case = table(spark, sf_dir, "documents"), F.col("doc_id") % _CASES
    old = {
        "source": F.col("source"),
        "title": F.substring("text", 1, 40),
        "company": F.lit(""),
        "url": F.lit("https://a.example"),
        "country_code": F.col("lang"),
        "salary_raw": F.lit("1"),
        "apply_url": F.lit("https://b.example"),
        "posted_at": F.lit(datetime(2024, 1, 2)),
        "is_remote": F.lit(False),
        "position": F.lit("p"),
        "user_id": F.lit("u"),
        "tags": F.array(F.lit("a"), F.lit("b")),
        "timezone_offsets": F.when(case != 19, F.array(F.lit(1.0), F.lit(2.5))),
        "description": F.col("text"),
        "stage1_status": F.lit(schema.PASSED_1),
    }
    changed = {
        1: ("source", F.lit("other")), 2: ("title", F.lit("other title")), 3: ("company", F.lit("c")), 4: ("url", F.lit("https://a.example/2")), 5: ("country_code", F.lit("ZZ")),
        6: ("salary_raw", F.lit("2")), 7: ("apply_url", F.lit(None)), 8: ("posted_at", F.lit(datetime(2024, 1, 3))), 9: ("is_remote", F.lit(True)), 10: ("position", F.lit("q")),
        11: ("user_id", F.lit("v")), 12: ("tags", F.array(F.lit("b"), F.lit("a"))), 13: ("tags", F.array(F.lit("a"), F.lit("b"), F.lit("a"))),
        14: ("timezone_offsets", F.array(F.lit(1.0), F.lit(3.0))), 15: ("timezone_offsets", F.array(F.lit(2.5), F.lit(1.0))), 16: ("description", F.concat(text.text(F.col("text")), F.lit("!"))),
        17: ("company", F.lit(None)), 18: ("posted_at", F.lit(None)), 19: ("timezone_offsets", F.array()),
    }
    new = dict(old)
    for k, (name, value) in changed.items():
        new[name] = F.when(case == k, value.cast(dict(f.split() for f in schema.JOBS.split(", "))[name])).otherwise(new[name])
    met = store.classified(_job_rows(docs, **old), _job_rows(docs, **new))
    return met.select(F.col("n.id").cast("bigint").alias("doc_id"), "action")


# ---- runs, rationales, cursors -------------------------------------------------------------------------------------


@query(
    f"""{_WITH} SELECT event_id, user_id, (SELECT max(id) FROM runs) + row_number() OVER (ORDER BY ts, event_id) AS id FROM events"""
)
def run_ids(spark, sf_dir):
    """A new run for each event, numbered in order of time behind the runs that there are."""
    asked = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    after = store.next_id(runs(spark, sf_dir)) - 1
    return surrogates.numbered(asked, [F.asc("ts"), F.asc("event_id")], after, ranges=16).select("event_id", "user_id", "id")


@query(
    f"""{_WITH} SELECT job_id, stage3_status, CASE job_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'seen ' || job_id ELSE stage3_rationale END AS stage3_rationale FROM run_jobs"""
)
def rationales_written(spark, sf_dir):
    """Rationales of all run rows: blank ones clear, new ones are trimmed, the others stay."""
    rows, n = run_jobs(spark, sf_dir), F.col("job_id")
    reason = F.when(n % 4 == 0, " \n\t").when(n % 4 == 1, F.concat(F.lit("  seen "), n.cast("string"), F.lit("\n")))
    given = rows.where(n % 4 < 3).select("pipeline_run_id", "job_id", reason.alias("reason"))
    return store.with_rationales(rows, given).select("job_id", "stage3_status", "stage3_rationale")


@query(
    """SELECT d.doc_id, coalesce(w.cursor, '') AS cursor FROM documents d LEFT JOIN
        (SELECT doc_id % 4 AS slot_id, lower(source) AS source_id, CASE WHEN doc_id % 4 <> 2 THEN CAST(max(doc_id) AS VARCHAR) END AS cursor FROM documents GROUP BY doc_id % 4, lower(source)) w
        ON w.slot_id = d.doc_id % 8 AND w.source_id = lower(d.source)"""
)
def cursors_of_sources(spark, sf_dir):
    """Each document asks for the cursor of its slot and source; half of the slots have none, one has nulls."""
    docs = table(spark, sf_dir, "documents")
    slot = F.col("doc_id") % 4
    known = docs.groupBy(slot.alias("slot_id"), F.lower("source").alias("source_id")).agg(F.max("doc_id").cast("string").alias("cursor"))
    known = known.withColumn("cursor", F.when(F.col("slot_id") != 2, F.col("cursor")))
    asked = docs.select("doc_id", (F.col("doc_id") % 8).alias("slot_id"), F.concat(F.lit(" "), F.upper("source"), F.lit("\n")).alias("source_id"))
    return store.cursors(known, asked).select("doc_id", "cursor")


# ---- what lists show, states and pages -----------------------------------------------------------------------------


@query(
    f"""{_WITH} SELECT j.job_id, source, title, posted_at, is_remote, country_code, coalesce(stage3_status, stage2_status) AS status, stage3_rationale
    FROM jobs j JOIN run_jobs r USING (job_id)"""
)
def list_items(spark, sf_dir):
    """What the lists of all runs show of their jobs."""
    return listing.item(jobs(spark, sf_dir).join(run_jobs(spark, sf_dir), "job_id"), 2)


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in (*schema.STAGE_2, *schema.STAGE_3, schema.PASSED_1, "passed_stage_2", "")))
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(n.alias("job_id"), F.get(names, (n % 8).cast("int")).alias("stage2_status"), F.get(names, (F.floor(n / 8) % 8).cast("int")).alias("stage3_status"))


_STATUSES_SQL = """WITH s AS (SELECT doc_id AS job_id, ['PASSED_STAGE_2', 'REJECTED_STAGE_2', 'PASSED_STAGE_3', 'REJECTED_STAGE_3', 'PASSED_STAGE_1', 'passed_stage_2', ''] AS names,
    doc_id % 8 + 1 AS i, (doc_id // 8) % 8 + 1 AS k FROM documents), t AS (SELECT job_id, names[i] AS two, names[k] AS three FROM s)"""


@query(f"{_STATUSES_SQL} SELECT job_id, two IS NOT NULL AND two LIKE '%\\_STAGE\\__' ESCAPE '\\' AND two <> 'PASSED_STAGE_1' AS valid FROM t")
def valid_statuses(spark, sf_dir):
    return _statuses(spark, sf_dir).select("job_id", schema.is_run_status(F.col("stage2_status")).alias("valid"))


@query(
    f"""{_STATUSES_SQL} SELECT job_id, two AS stage2_status, three AS stage3_status FROM t WHERE NOT coalesce(
        two IN ('PASSED_STAGE_2', 'REJECTED_STAGE_2') AND (three IS NULL OR (two = 'PASSED_STAGE_2' AND three IN ('PASSED_STAGE_3', 'REJECTED_STAGE_3'))), false)"""
)
def broken_run_rows(spark, sf_dir):
    return schema.broken_run_jobs(_statuses(spark, sf_dir))


_HEAD = 98_304


@query(
    f"""WITH p AS (SELECT page_id, lower(CASE page_id % 5 WHEN 0 THEN '<script src="/CDN-cgi/challenge-platform/x">' WHEN 1 THEN '<p>Just a moment...</p>' WHEN 2 THEN '<p>Just a Moment</p><a href="/cdn-cgi/l">'
        WHEN 3 THEN repeat('x', {_HEAD}) ELSE '' END || coalesce(html, '') || CASE page_id % 5 WHEN 3 THEN 'cf-browser-verification' WHEN 4 THEN '<i id="cf-browser-verification">' ELSE '' END) AS html FROM pages)
    SELECT page_id, contains(substring(html, 1, {_HEAD}), 'cdn-cgi/challenge-platform') OR contains(substring(html, 1, {_HEAD}), 'cf-browser-verification')
        OR (contains(substring(html, 1, {_HEAD}), 'just a moment') AND contains(substring(html, 1, {_HEAD}), 'cdn-cgi')) AS challenge FROM p"""
)
def challenge_pages(spark, sf_dir):
    """All pages with a challenge's marks before or behind them, or too far behind."""
    n = F.col("page_id")
    before = F.when(n % 5 == 0, '<script src="/CDN-cgi/challenge-platform/x">').when(n % 5 == 1, "<p>Just a moment...</p>").when(n % 5 == 2, '<p>Just a Moment</p><a href="/cdn-cgi/l">')
    before = before.when(n % 5 == 3, F.repeat(F.lit("x"), F.lit(_HEAD))).otherwise("")
    behind = F.when(n % 5 == 3, "cf-browser-verification").when(n % 5 == 4, '<i id="cf-browser-verification">').otherwise("")
    html = F.concat(before, text.text(F.col("html")), behind)
    return table(spark, sf_dir, "pages").select("page_id", text.challenge_page(html).alias("challenge"))


@query("SELECT page_id, regexp_replace(coalesce(url, '') || ' é_-', '[^A-Za-z0-9_-]', '_', 'g') AS segment FROM pages")
def workflow_segments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.workflow_segment(F.concat(text.text(F.col("url")), F.lit(" é_-"))).alias("segment"))


# ---- dates of all layouts, keys of searches ------------------------------------------------------------------------

_LAYOUTS = 9


@query(
    f"""WITH d AS (SELECT doc_id, doc_id % {_LAYOUTS} AS k, make_date(2020 + doc_id % 5, 1 + doc_id % 12, 1 + doc_id % 28) AS day, to_hours(doc_id % 24) + to_minutes(doc_id % 60) AS clock FROM documents),
    t AS (SELECT doc_id, k, CAST(day AS TIMESTAMP) AS day, CASE k WHEN 1 THEN day + clock + INTERVAL 250 MILLISECONDS - INTERVAL 2 HOURS ELSE day + clock END AS instant FROM d)
    SELECT doc_id, CASE WHEN k < 2 THEN instant END AS exact, CASE WHEN k < 3 THEN instant WHEN k = 3 THEN day END AS lenient, CASE WHEN k < 2 THEN instant WHEN k = 3 THEN day END AS offset_or_date,
        CASE WHEN k < 2 THEN instant WHEN k IN (3, 4, 5) THEN day END AS absolute FROM t"""
)
def date_layouts(spark, sf_dir):
    """Dates in every layout that boards write, beside some in none, by each of the four rules."""
    n = F.col("doc_id")
    day = F.make_date(n.cast("int") % 5 + 2020, n.cast("int") % 12 + 1, n.cast("int") % 28 + 1)
    iso = F.concat(day.cast("string"), F.lit("T"), F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(":00"))
    shapes = [F.concat(iso, F.lit("Z")), F.concat(iso, F.lit(".25+02:00")), iso, F.concat(F.lit(" "), day.cast("string"), F.lit("\n")), F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "d MMMM yyyy"), F.lit("soon"), F.lit(None), F.lit("2024-13-40")]
    raw = F.get(F.array(*shapes), (n % _LAYOUTS).cast("int"))
    rules = {"exact": dates.with_offset, "lenient": dates.lenient, "offset_or_date": dates.offset_or_date, "absolute": dates.absolute}
    return text.held(table(spark, sf_dir, "documents").select("doc_id"), raw=raw).select("doc_id", *(rule(F.col("raw")).cast("timestamp_ntz").alias(name) for name, rule in rules.items()))


@query(
    """WITH d AS (SELECT doc_id, lower(source) AS source, lang, printf('%08x-0000-0000-0000-000000000000', doc_id) AS slot, doc_id % 2 = 0 AS u, doc_id % 3 = 0 AS r, doc_id % 4 = 0 AS w, doc_id % 5 <> 0 AS s, doc_id % 7 = 0 AS k,
        strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S') AS instant FROM documents),
    p AS (SELECT doc_id, slot, u, array_to_string(list_filter([
            CASE WHEN r THEN '"role":"dev \\"' || lang || '\\" r\\u0026d"' END, CASE WHEN w THEN '"time_window":{"from":"' || instant || 'Z","to":"' || instant || '.5Z"}' END,
            CASE WHEN s THEN '"sources":["\\u003cb\\u003e\\\\","' || source || '"]' END, CASE WHEN k THEN '"keywords":["__remote_only__","country:' || lang || '"]' END], lambda x: x IS NOT NULL), ',') AS parts FROM d)
    SELECT doc_id, CASE WHEN doc_id > 0 AND parts <> '' THEN sha256('{"slot_id":"' || slot || '"' || CASE WHEN u THEN ',"user_id":"ann\\t1"' ELSE '' END || ',' || parts || '}') END AS key FROM p"""
)
def filter_keys_of_rows(spark, sf_dir):
    """Keys of as many searches as there are documents, with and without each field, some with signs that are escaped."""
    n = F.col("doc_id")
    at = F.timestamp_seconds(n + 1_704_067_200)
    canonical = identity.canonical_filter(
        F.concat(F.lpad(F.lower(F.hex(n)), 8, "0"), F.lit("-0000-0000-0000-000000000000")),
        F.when(n % 2 == 0, " Ann\t1 "),
        F.when(n % 3 == 0, F.array(F.lit("r&D"), F.concat(F.lit('DEV "'), F.col("lang"), F.lit('"')), F.lit(" "))),
        F.when(n % 4 == 0, at),
        F.when(n % 4 == 0, at + F.expr("INTERVAL 500 MILLISECONDS")),
        F.when(n % 5 != 0, F.array(F.upper("source"), F.lit("<b>\\"), F.col("source"))),
        n % 7 == 0,
        F.when(n % 7 == 0, F.array(F.col("lang"), F.upper("lang"))),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(canonical, 256).alias("key"))
