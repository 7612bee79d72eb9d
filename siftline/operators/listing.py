"""Canonical order, pages and totals of job lists."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema


def order(key: str = "job_id") -> list[Column]:
    """Newest first, without a date last, then by id (TOP-01)."""
    return [F.desc_nulls_last("posted_at"), F.asc(key)]


def canonical(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    return jobs.orderBy(*order(key))


@dataclass(frozen=True)
class Page:
    """Which page of which size, from 1 (TOP-08)."""

    page: int = 1
    limit: int = schema.PAGE
    status: str = ""

    def __post_init__(self):
        if self.page < 1 or not 1 <= self.limit <= schema.PAGE_MOST:
            raise ValueError(f"bad page: {self}")

    @classmethod
    def parse(cls, query: Mapping[str, list[str]]) -> Page:
        def number(name: str, default: int) -> int:
            raw = next((v.strip() for v in query.get(name, []) if v.strip()), "")
            return int(raw) if raw else default

        return cls(number("page", 1), number("limit", schema.PAGE), next(iter(query.get("status", [])), "").strip())

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit


def page(jobs: DataFrame, at: Page, key: str = "job_id") -> DataFrame:
    """A page in canonical order: a sort with a limit, so no full sort is kept (TOP-02)."""
    return canonical(jobs, key).offset(at.offset).limit(at.limit)


def total(jobs: DataFrame) -> DataFrame:
    """Number of rows of the whole list (AGG-01, AGG-02)."""
    return jobs.agg(F.count(F.lit(1)).alias("total"))


def status_filter(stage: int, raw: str) -> str | None:
    """The status that a list is narrowed to, by stage (FLT-12)."""
    allowed = {1: {}, 2: {"": None, "passed": schema.PASSED_2, "failed": schema.REJECTED_2}, 3: {"": None, "passed": schema.PASSED_3, "failed": schema.REJECTED_3}}
    wanted = raw.strip()
    statuses = {2: schema.STAGE_2, 3: schema.STAGE_3}.get(stage, ())
    if wanted in statuses:
        return wanted
    if stage not in allowed or wanted.lower() not in (allowed[stage] or {"": None}):
        raise ValueError(f"bad status for stage {stage}: {raw!r}")
    return (allowed[stage] or {"": None})[wanted.lower()]


def pool(jobs: DataFrame, slot_jobs: DataFrame, slot_id: str) -> DataFrame:
    """Jobs of a slot (JON-03)."""
    return jobs.join(slot_jobs.where(F.col("slot_id") == slot_id).select("job_id"), "job_id")


def passed_stage_1(jobs: DataFrame, slot_jobs: DataFrame, slot_id: str) -> DataFrame:
    """The slot's jobs that passed stage 1: stage 2's input (JON-01)."""
    return pool(jobs.where(F.col("stage1_status") == schema.PASSED_1), slot_jobs, slot_id)


def stage_2_list(jobs: DataFrame, slot_jobs: DataFrame, run_jobs: DataFrame, slot_id: str, run_id: int, status: str | None = None) -> DataFrame:
    """Jobs of a slot with their rows in a run (JON-04)."""
    rows = run_jobs.where(F.col("pipeline_run_id") == run_id)
    rows = rows.where(F.col("stage2_status") == status) if status else rows
    return pool(jobs, slot_jobs, slot_id).join(rows, "job_id")


def stage_3_list(jobs: DataFrame, slot_jobs: DataFrame, run_jobs: DataFrame, slot_id: str, run_id: int, status: str | None = None) -> DataFrame:
    """As ``stage_2_list`` for final statuses only (JON-05)."""
    final = F.col("stage3_status") == status if status else F.col("stage3_status").isin(*schema.STAGE_3)
    return pool(jobs, slot_jobs, slot_id).join(run_jobs.where((F.col("pipeline_run_id") == run_id) & final), "job_id")


def passed_stage_2(jobs: DataFrame, run_jobs: DataFrame, run_id: int) -> DataFrame:
    """Jobs of a run that passed stage 2, scored or not, in order (JON-02)."""
    return canonical(jobs.join(run_jobs.where((F.col("pipeline_run_id") == run_id) & (F.col("stage2_status") == schema.PASSED_2)), "job_id"))


def eligible(jobs: DataFrame, run_jobs: DataFrame, run_id: int) -> DataFrame:
    """Ids of a run's jobs that wait for stage 3, in order (JON-06)."""
    return passed_stage_2(jobs, run_jobs.where(F.col("stage3_status").isNull()), run_id).select("job_id", "posted_at")


def effective_status() -> Column:
    """Final status if there is one, else stage 2's (PRJ-44)."""
    return F.coalesce(F.nullif(F.col("stage3_status"), F.lit("")), F.col("stage2_status"))


def latest_run(runs: DataFrame) -> DataFrame:
    """Latest run of each slot (AGG-03)."""
    return runs.where("slot_id is not null").groupBy("slot_id").agg(F.max("id").alias("run_id"))


def slots_in_order(slots: DataFrame) -> DataFrame:
    """Slots by age, then id (TOP-11)."""
    return slots.orderBy("created_at", "id")


def debug_limit(limit: int | None) -> int | None:
    """Rows that a debug listing shows: 200 by default, none for 0, 10,000 at most (TOP-12)."""
    limit = 200 if limit is None else limit
    if not 0 <= limit <= 10_000:
        raise ValueError(f"bad limit: {limit}")
    return limit or None


def debug_list(jobs: DataFrame, limit: int | None = None, key: str = "job_id") -> DataFrame:
    """A debug listing in canonical order, as many rows as ``debug_limit`` allows (TOP-12)."""
    most = debug_limit(limit)
    return canonical(jobs, key) if most is None else canonical(jobs, key).limit(most)


def item(jobs: DataFrame, stage: int) -> DataFrame:
    """What a list shows of a job; statuses from stage 2 on (PRJ-40, PRJ-41)."""
    shown = ["job_id", "source", "title", "company", "url", "apply_url", "posted_at", "is_remote", "country_code", "salary_raw", "tags", "position"]
    extra = [effective_status().alias("status"), "stage3_rationale"] if stage in (2, 3) else []
    return jobs.select(*[c for c in shown if c in jobs.columns], *extra)


def aggregate(run_jobs: DataFrame) -> DataFrame:
    """Outcome counts of each run (AGG-04, AGG-07, AGG-08)."""
    return run_jobs.groupBy("pipeline_run_id").agg(
        F.count_if(F.col("stage2_status") == schema.PASSED_2).alias("stage2_passed"),
        F.count_if(F.col("stage2_status") == schema.REJECTED_2).alias("stage2_rejected"),
        F.count_if(F.col("stage3_status").isNotNull()).alias("stage3_scored"),
        F.count_if(F.col("stage3_status") == schema.PASSED_3).alias("stage3_passed"),
        F.count_if(F.col("stage3_status") == schema.REJECTED_3).alias("stage3_rejected"),
    )


def by_source(outcomes: DataFrame) -> DataFrame:
    """Ingest results of a run as a map by source, and a summary of errors (AGG-06)."""
    return outcomes.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.struct("written", "skipped", "filtered"))))).alias("outputs"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "source", "error"))), "; ").alias("errors"),
    )
