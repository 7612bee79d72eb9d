"""Schemas of the engine's tables, status values and their invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB_FIELDS = (
    "id string, source string, title string, company string, url string, apply_url string, description string, "
    "posted_at timestamp, is_remote boolean, country_code string, salary_raw string, tags array<string>, "
    "timezone_offsets array<double>, position string, user_id string, stage1_status string"
)
JOBS = f"{JOB_FIELDS}, created_at timestamp, updated_at timestamp"
SLOTS = "id string, name string, created_at timestamp"
SLOT_KEYS = "key string, slot_id string, created_at timestamp"
SLOT_JOBS = "slot_id string, job_id string, first_seen_at timestamp"
RUNS = "id bigint, created_at timestamp, broad_filter_key_hash string, slot_id string"
RUN_JOBS = "pipeline_run_id bigint, job_id string, stage2_status string, stage3_status string, stage3_rationale string"
WATERMARKS = "slot_id string, source_id string, cursor string, updated_at timestamp"
PROFILE = "id smallint, text string, updated_at timestamp"
LEDGER = "kind string, slot_id string, source_id string, expires_at timestamp"

# Statuses, pass mark, limits.
PASSED_1 = "PASSED_STAGE_1"
PASSED_2, REJECTED_2 = "PASSED_STAGE_2", "REJECTED_STAGE_2"
PASSED_3, REJECTED_3 = "PASSED_STAGE_3", "REJECTED_STAGE_3"
STAGE_2, STAGE_3 = (PASSED_2, REJECTED_2), (PASSED_3, REJECTED_3)
PASS_SCORE = 60
STAGE_3_BATCH = 20
STAGE_3_BATCH_MOST = 10_000
SLOT_LIMIT = 3
PAGE, PAGE_MOST = 50, 100
RETENTION_DAYS = 7
WINDOW_DAYS = 7
LOCK_SECONDS, COOLDOWN_SECONDS = 600, 3600


def is_run_status(status: Column) -> Column:
    """Whether a status may stand on a run's row (FLT-13)."""
    return F.coalesce(status.isin(*STAGE_2, *STAGE_3), F.lit(False))


def broken_run_jobs(run_jobs: DataFrame) -> DataFrame:
    """Rows that break the rule that a final status needs a pass in stage 2; empty for a sound table."""
    two = F.coalesce(F.col("stage2_status").isin(*STAGE_2), F.lit(False))
    three = F.col("stage3_status").isNull() | (F.col("stage3_status").isin(*STAGE_3) & (F.col("stage2_status") == PASSED_2))
    return run_jobs.where(~(two & three))
