"""Registered queries of what is done for all slots, pages and writes at once, with SQL.

Slots are the remainders of document ids by four; their words come from the test items.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import identity, places
from .operators import deep_pages, keyword_index, listing, merge, retention, stages, status_fold
from .operators.listing import Page
from .queries import _WITH, CLOCK, ORACLE_SQL, jobs, query, run_jobs, slot_jobs, table
from .queries import _stored as stored_and_incoming
from .sources.paging import shared_folder

# ---- keyword rules of all slots ------------------------------------------------------------------------------------

_WORDS = 50
_RULES_SQL = f"""WITH each AS (SELECT DISTINCT item_id % 4 AS slot_id, lower(unnest(string_split(text, ' '))) AS word FROM benchmark),
    ranked AS (SELECT slot_id, word, row_number() OVER (PARTITION BY slot_id ORDER BY md5(word), word) AS n FROM each WHERE word <> ''),
    rules AS (SELECT slot_id, word, CASE WHEN n % 5 = 0 THEN 'exclude' ELSE 'include' END AS kind FROM ranked WHERE n <= {_WORDS} AND slot_id <> 3),
    jobs AS (SELECT doc_id AS job_id, doc_id % 4 AS slot_id, lower(substring(coalesce(text, ''), 1, 40) || ' ' || coalesce(text, '')) AS hay FROM documents),
    told AS (SELECT j.slot_id, j.job_id, count(*) FILTER (WHERE kind = 'include') AS wanted,
        count(*) FILTER (WHERE kind = 'include' AND contains(hay, word)) AS included, count(*) FILTER (WHERE kind = 'exclude' AND contains(hay, word)) AS excluded
        FROM jobs j LEFT JOIN rules r ON r.slot_id = j.slot_id GROUP BY 1, 2)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty words for each slot, every fifth to exclude; the last slot has none."""
    each = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("slot_id"), F.explode(F.split("text", " ")).alias("word"))
    each = each.where("word <> ''").withColumn("word", F.lower("word")).distinct()
    first = F.array_sort(F.collect_set(F.struct(F.md5("word").alias("h"), "word")))  # test items are few
    ranked = each.where("slot_id <> 3").groupBy("slot_id").agg(F.slice(first, 1, _WORDS).alias("words")).select("slot_id", F.posexplode("words").alias("n", "w"))
    return ranked.select("slot_id", F.when((F.col("n") + 1) % 5 == 0, "exclude").otherwise("include").alias("kind"), F.concat(F.lit(" "), F.upper("w.word")).alias("word"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("description"))


@query(f"{_RULES_SQL} SELECT slot_id, job_id, CASE WHEN (wanted = 0 OR included > 0) AND excluded = 0 THEN 'PASSED_STAGE_2' ELSE 'REJECTED_STAGE_2' END AS stage2_status FROM told")
def stage2_of_all_slots(spark, sf_dir):
    return keyword_index.stage_2_of_slots(_texts(spark, sf_dir), slot_jobs(spark, sf_dir), _rules(spark, sf_dir))


@query(f"{_RULES_SQL} SELECT slot_id, job_id FROM told WHERE wanted = 0 OR included > 0")
def stage1_roles_of_all_slots(spark, sf_dir):
    words = _rules(spark, sf_dir).where("kind = 'include'").select("slot_id", "word")
    return keyword_index.with_role_of_slots(_texts(spark, sf_dir), slot_jobs(spark, sf_dir), words)


# ---- merges --------------------------------------------------------------------------------------------------------


@query(ORACLE_SQL["ingest_upsert"])
def ingest_merge(spark, sf_dir):
    """The upsert on a stored table: only buckets with a change are written."""
    old, new = stored_and_incoming(spark, sf_dir)
    old, new = (rows.withColumn("id", F.col("id").cast("string")) for rows in (old, new))
    layout = merge.Layout(f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}", 16)
    merge.create(layout, old)
    merge.merge(spark, layout, new, CLOCK)
    out = merge.stored(spark, layout)
    return out.select(F.col("id").cast("bigint").alias("id"), "title", "description", "stage1_status", F.dayofmonth("created_at").alias("created_day"), F.dayofmonth("updated_at").alias("updated_day"))


# ---- deep pages ----------------------------------------------------------------------------------------------------

_PER_PAGE = 10


def _paged_sql(page: str) -> str:
    return f"""WITH listed AS (SELECT event_id AS job_id, CASE WHEN event_id % 17 <> 0 THEN date_trunc('hour', ts) END AS posted_at, user_id, event_type FROM events),
        ranked AS (SELECT *, row_number() OVER (ORDER BY posted_at DESC NULLS LAST, job_id) AS place FROM listed)
        SELECT job_id, posted_at, user_id, event_type, place FROM ranked WHERE place BETWEEN ({page} - 1) * {_PER_PAGE} + 1 AND {page} * {_PER_PAGE}"""


def _listed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a list with many equal dates, and some without one."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 17 != 0, hour).alias("posted_at"), "user_id", "event_type")


@query(_paged_sql("(SELECT count(*) // 20 FROM events)"))
def deep_page(spark, sf_dir):
    """The page in the middle of all events: page 10,000 and more of larger tables."""
    rows = _listed_events(spark, sf_dir)
    return deep_pages.deep_page(rows, Page(max(1, rows.count() // 20), _PER_PAGE), ranges=16)


@query(_paged_sql("((SELECT count(*) FROM events) + 9) // 10"))
def last_page(spark, sf_dir):
    rows = _listed_events(spark, sf_dir)
    return deep_pages.deep_page(rows, Page(-(-rows.count() // _PER_PAGE), _PER_PAGE), ranges=16)


# ---- several status writes of a job --------------------------------------------------------------------------------

_WRITTEN = "CASE (job_id // 3 + seq * (job_id % 3 + 1)) % 4 WHEN 0 THEN 'PASSED_STAGE_2' WHEN 1 THEN 'REJECTED_STAGE_2' WHEN 2 THEN 'PASSED_STAGE_3' ELSE 'REJECTED_STAGE_3' END"
_SECOND = "w.status IN ('PASSED_STAGE_2', 'REJECTED_STAGE_2')"


@query(
    f"""WITH RECURSIVE jobs AS (SELECT doc_id AS job_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'REJECTED_STAGE_2' ELSE 'PASSED_STAGE_2' END AS two,
            CASE WHEN doc_id % 5 = 4 THEN 'PASSED_STAGE_3' END AS three FROM documents),
        writes AS (SELECT job_id, seq, {_WRITTEN} AS status FROM jobs, (SELECT unnest(range(1, 6)) AS seq)),
        steps AS (
            SELECT job_id, 0 AS seq, two, three, CAST(NULL AS BIGINT) AS bad FROM jobs
            UNION ALL
            SELECT s.job_id, s.seq + 1,
                CASE WHEN bad IS NULL AND {_SECOND} AND three IS NULL THEN w.status ELSE two END,
                CASE WHEN bad IS NULL AND NOT {_SECOND} AND two = 'PASSED_STAGE_2' AND three IS NULL THEN w.status ELSE three END,
                CASE WHEN bad IS NULL AND NOT {_SECOND} AND (two IS NULL OR two <> 'PASSED_STAGE_2' OR (three IS NOT NULL AND three <> w.status)) THEN s.seq + 1 ELSE bad END
            FROM steps s JOIN writes w ON w.job_id = s.job_id AND w.seq = s.seq + 1)
        SELECT job_id, two AS stage2_status, three AS stage3_status, bad AS first_illegal FROM steps WHERE seq = 5"""
)
def status_fold_of_writes(spark, sf_dir):
    """Five writes for each job, in order."""
    n = F.col("job_id")
    two = F.when(n % 5 == 1, schema.REJECTED_2).when(n % 5 != 0, schema.PASSED_2)
    every = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"))
    current = every.where(n % 5 != 0).select(F.lit(1).alias("pipeline_run_id"), "job_id", two.alias("stage2_status"), F.when(n % 5 == 4, schema.PASSED_3).alias("stage3_status"), F.lit(None).cast("string").alias("stage3_rationale"))
    each = every.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(5))))
    names = F.array(*(F.lit(x) for x in (*schema.STAGE_2, *schema.STAGE_3)))
    status = F.get(names, ((F.floor(n / 3) + F.col("seq") * (n % 3 + 1)) % 4).cast("int"))
    return status_fold.folded(current, each.select(F.lit(1).alias("pipeline_run_id"), "job_id", "seq", status.alias("status"))).drop("pipeline_run_id")


# ---- retention by days ---------------------------------------------------------------------------------------------


def _retained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Jobs and run rows after a retention run over stored tables, cut within a day."""
    made = jobs(spark, sf_dir).withColumn("created_at", F.col("posted_at")).select("job_id", "source", "created_at")
    rows = run_jobs(spark, sf_dir).select("pipeline_run_id", "job_id", "stage2_status")
    root = f"{shared_folder(spark)}/retained-{uuid.uuid4().hex}"
    retention.write_by_day(made, f"{root}/jobs")
    retention.write_children(rows, made, f"{root}/run_jobs", parent_key="job_id")
    own, kids = "job_id bigint, source string, created_at timestamp_ntz", "pipeline_run_id bigint, job_id bigint, stage2_status string"
    retention.retain(spark, f"{root}/jobs", own, datetime(2024, 1, 24, 9, 30), {f"{root}/run_jobs": kids}, parent_key="job_id")
    return spark.read.schema(own).parquet(f"{root}/jobs"), spark.read.schema(kids).parquet(f"{root}/run_jobs")


_KEPT = "posted_at >= TIMESTAMP '2024-01-24 09:30:00'"


@query(f"{_WITH} SELECT job_id, source FROM jobs WHERE {_KEPT}")
def retention_of_days(spark, sf_dir):
    return _retained(spark, sf_dir)[0].select("job_id", "source")


@query(f"{_WITH} SELECT pipeline_run_id, job_id, stage2_status FROM run_jobs WHERE job_id IN (SELECT job_id FROM jobs WHERE {_KEPT})")
def retention_of_days_cascade(spark, sf_dir):
    return _retained(spark, sf_dir)[1].select("pipeline_run_id", "job_id", "stage2_status")


# ---- guards, debug lists, a model's scores -------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https://[^/?#]+') THEN 'https' || substring(trim(url), 6) END AS url FROM pages")
def https_guard(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.https_url(F.col("url")).alias("url"))


@query(f"{_WITH} SELECT job_id, posted_at FROM jobs ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 200")
def debug_listing(spark, sf_dir):
    return listing.debug_list(jobs(spark, sf_dir).select("job_id", "posted_at"))


def _stand_in(prompt: str) -> str:
    """A model for the query below: the score is the length of the description."""
    said = prompt.split("Description:\n", 1)[1]
    answer = {"score": len(said) % 101, "rationale": f"{len(said)} characters"}
    return json.dumps({"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": json.dumps(answer)}]})


@query("SELECT doc_id, CAST(length(coalesce(text, '')) % 101 AS INTEGER) AS score, length(coalesce(text, '')) || ' characters' AS reason FROM documents")
def model_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.lit("C").alias("company"), F.col("text").alias("description"))
    return stages.scored_by_model(docs, "p", _stand_in).select("doc_id", "score", "reason")


# ---- the country file ----------------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'GB' WHEN 1 THEN '' ELSE chr(CAST(65 + c_nationkey // 5 AS INTEGER)) || chr(CAST(65 + c_nationkey % 5 AS INTEGER)) END AS code FROM customer"""
)
def country_file(spark, sf_dir):
    """Customers' places against a country file made of all nations; aliases are known beside it, some places are nowhere."""
    key = F.col("n_nationkey").cast("int")
    code = F.concat(F.char(F.floor(key / 5) + 65), F.char(key % 5 + 65))
    entries = table(spark, sf_dir, "nation").select(F.to_json(F.struct(code.alias("alpha_2"), F.col("n_name").alias("name"))).alias("entry"))  # a dimension
    path = f"{shared_folder(spark)}/countries-{uuid.uuid4().hex}"
    entries.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("entry")), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    known = places.Countries.read(spark, path)
    n = F.col("c_custkey")
    own = F.concat(F.lit("Worldwide, nation_"), F.col("c_nationkey").cast("string"))
    where = F.when(n % 4 == 0, " U.K. ").when(n % 4 == 1, "Remote, Atlantis").otherwise(own)
    return table(spark, sf_dir, "customer").select("c_custkey", known.first(F.array(where), F.array(F.lit("NATION_1x"))).alias("code"))
