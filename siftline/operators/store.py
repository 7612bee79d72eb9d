"""Keyed writes as transformations of whole tables: upserts, status changes, invalidation and retention.

Plain files have no MERGE: each function takes the current table and gives the next one; ``Snapshots`` writes it beside
the current one and only then moves the pointer, so no plan ever overwrites what it reads.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import lists, text

INSERT, FULL, DESCRIPTION, SKIP = "INSERT", "FULL_UPDATE", "DESCRIPTION_ONLY", "SKIP"
_PLAIN = ("source", "title", "company", "url", "country_code", "salary_raw")
_NULLABLE = ("apply_url", "posted_at", "is_remote", "position", "user_id")


class Snapshots:
    """Tables in numbered folders; the highest one that was written to its end is the current one.

    Spark marks a finished write, so a run that stops between leaves the table as it was.  The version before the
    current one stays for readers that still hold it; older ones are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        path, files = self._folder(name)
        if not files.exists(path):
            return []
        found = [s.getPath().getName() for s in files.listStatus(path)]
        numbers = [int(x[1:]) for x in found if x[:1] == "v" and x[1:].isdigit()]
        return sorted(n for n in numbers if files.exists(self._folder(f"{name}/v{n}/_SUCCESS")[0]))

    def version(self, name: str) -> int:
        return max(self._versions(name), default=0)

    def read(self, name: str, ddl: str) -> DataFrame:
        version = self.version(name)
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}/v{version}") if version else self.spark.createDataFrame([], ddl)

    def write(self, name: str, table: DataFrame, *partition_by: str) -> None:
        versions = self._versions(name)
        version = max(versions, default=0) + 1
        writer = table.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/v{version}")
        for old in versions[:-1]:
            path, files = self._folder(f"{name}/v{old}")
            files.delete(path, True)


def _field(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def same_but_description(old: str = "o", new: str = "n") -> Column:
    """Whether all fields but the description are equal, null and empty text alike where a field has a default (SNK-04)."""
    pairs = [text.text(_field(old, c)).eqNullSafe(text.text(_field(new, c))) for c in _PLAIN]
    pairs += [_field(old, c).eqNullSafe(_field(new, c)) for c in _NULLABLE]
    pairs += [
        text.blank_to_null(_field(old, "stage1_status")).eqNullSafe(text.blank_to_null(_field(new, "stage1_status"))),
        lists.same_unordered(_field(old, "tags"), _field(new, "tags")),
        lists.same_numbers(_field(old, "timezone_offsets"), _field(new, "timezone_offsets")),
    ]
    return reduce(and_, pairs)


def action(old: str = "o", new: str = "n") -> Column:
    """INSERT, FULL_UPDATE, DESCRIPTION_ONLY or SKIP for a pair of rows (SNK-02)."""
    described = text.text(_field(old, "description")) == text.text(_field(new, "description"))
    return F.when(_field(old, "id").isNull(), INSERT).when(~same_but_description(old, new), FULL).when(described, SKIP).otherwise(DESCRIPTION)


def encoded(jobs: DataFrame) -> DataFrame:
    """Rows as they are stored: no-value texts and lists have their defaults, optional texts are null (SNK-07, SNK-28, SNK-29)."""
    defaults = {c: text.text(F.col(c)) for c in (*_PLAIN, "description")}
    optional = {c: F.nullif(F.col(c), F.lit("")) for c in ("apply_url", "user_id")}
    return jobs.withColumns(defaults | optional | {"tags": lists.strings(F.col("tags")), "timezone_offsets": F.coalesce("timezone_offsets", F.array().cast("array<double>")), "stage1_status": text.blank_to_null(F.col("stage1_status"))})


def classified(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Current and incoming rows of each id side by side with what is to be done; incoming ones carry the stage-1 pass."""
    passed = encoded(incoming.withColumn("stage1_status", F.lit(schema.PASSED_1)))
    met = current.alias("o").join(passed.alias("n"), F.col("o.id") == F.col("n.id"), "full")
    return met.withColumn("action", F.when(F.col("n.id").isNotNull(), action()))


def upsert(current: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    """The job table after an ingest: creation times stay, update times move only with a write (SNK-02, SNK-03)."""
    names = [f.name for f in current.schema.fields if f.name not in ("created_at", "updated_at")]
    act, at = F.col("action"), F.lit(now).cast("timestamp")
    whole = act.isin(INSERT, FULL)
    out = [F.when(whole | ((act == DESCRIPTION) & F.lit(n == "description")), F.col(f"n.{n}")).otherwise(F.col(f"o.{n}")).alias(n) for n in names]
    created = F.coalesce("o.created_at", at).alias("created_at")
    updated = F.when(act.isin(INSERT, FULL, DESCRIPTION), at).otherwise(F.col("o.updated_at")).alias("updated_at")
    return classified(current, incoming).select(*out, created, updated)


def replaced(current: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Unconditional upsert by key: incoming rows replace those of equal key (SNK-01, SNK-09, SNK-26)."""
    return current.join(incoming.select(*keys), list(keys), "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns))


def kept_first(current: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Insert where absent: rows that are there stay as they are (SNK-08, SNK-23)."""
    new = incoming.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti")
    return current.unionByName(new.select(*current.columns))


def with_cursor(watermarks: DataFrame, slot_id: str, source_id: str, cursor: str, now: datetime) -> DataFrame:
    """Watermarks with a new cursor; a blank one is null (SNK-09)."""
    row = watermarks.sparkSession.createDataFrame([(slot_id, source_id.strip().lower(), cursor.strip() or None, now)], schema.WATERMARKS)
    return replaced(watermarks, row, "slot_id", "source_id")


def cursor(watermarks: DataFrame, slot_id: str, source_id: str) -> str:
    """A source's cursor, empty where there is none (SNK-10)."""
    row = watermarks.where((F.col("slot_id") == slot_id) & (F.col("source_id") == source_id.strip().lower())).select("cursor").first()
    return (row and row[0]) or ""


def cursors(watermarks: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(slot_id, source_id, ...)`` with each row's cursor, empty where there is none (SNK-10).

    Source ids are trimmed and lower-cased on the way; there is at most one watermark for each pair.
    """
    known = watermarks.select("slot_id", F.col("source_id").alias("_source"), "cursor")
    named = asked.withColumn("_source", F.lower(text.trim(F.col("source_id"))))
    return named.join(known, ["slot_id", "_source"], "left").withColumn("cursor", text.text(F.col("cursor"))).drop("_source")


def by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    """The row of an id; none is an error (SRC-29)."""
    found = jobs.where(F.col("id") == job_id).limit(1)
    if found.isEmpty():
        raise KeyError(job_id)
    return found


ILLEGAL = "ILLEGAL"


def transition(current_2: Column, current_3: Column, wanted: Column) -> Column:
    """What a status write does: SET_2, SET_3, NONE or ILLEGAL (SNK-13)."""
    to_2, to_3 = wanted.isin(*schema.STAGE_2), wanted.isin(*schema.STAGE_3)
    second = F.when(current_3.isNotNull() | current_2.eqNullSafe(wanted), "NONE").otherwise("SET_2")
    third = (
        F.when(current_2.isNull() | (current_2 != schema.PASSED_2), ILLEGAL)
        .when(current_3.isNull(), "SET_3")
        .when(current_3 == wanted, "NONE")
        .otherwise(ILLEGAL)
    )
    return F.when(F.coalesce(to_2, F.lit(False)), second).when(F.coalesce(to_3, F.lit(False)), third).otherwise(ILLEGAL)


def proposed(run_jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Writes ``(pipeline_run_id, job_id, status)`` beside the current rows, with what each does."""
    keys = ["pipeline_run_id", "job_id"]
    met = wanted.join(run_jobs, keys, "left")
    change = F.when(text.trim(F.col("job_id")) == "", ILLEGAL).otherwise(transition(F.col("stage2_status"), F.col("stage3_status"), F.col("status")))
    return met.withColumn("change", change)


def with_status(run_jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Run rows after status writes, one a job; illegal ones are errors before anything is planned to be written (SNK-13)."""
    changes = proposed(run_jobs, wanted)
    bad = changes.where(F.col("change") == ILLEGAL).select("job_id", "status").head(1)
    if bad:
        raise ValueError(f"illegal status change: {bad[0].asDict()}")
    set_2 = changes.where("change = 'SET_2'").select("pipeline_run_id", "job_id", F.col("status").alias("stage2_status"), "stage3_status", "stage3_rationale")
    set_3 = changes.where("change = 'SET_3'").select("pipeline_run_id", "job_id", "stage2_status", F.col("status").alias("stage3_status"), "stage3_rationale")
    return replaced(run_jobs, set_2.unionByName(set_3), "pipeline_run_id", "job_id")


def with_rationales(run_jobs: DataFrame, reasons: DataFrame) -> DataFrame:
    """Run rows with rationales ``(pipeline_run_id, job_id, reason)``; blank is null (SNK-14)."""
    met = run_jobs.join(reasons, ["pipeline_run_id", "job_id"], "left")
    new = F.when(F.col("reason").isNotNull(), text.blank_to_null(F.col("reason"))).otherwise(F.col("stage3_rationale"))
    return met.withColumn("stage3_rationale", new).select(*run_jobs.columns)


def _of_slot(runs: DataFrame, slot_id: str | None) -> DataFrame:
    own = runs.where(F.col("slot_id") == slot_id) if slot_id else runs
    return own.select(F.col("id").alias("pipeline_run_id"))


def without_stage_3(run_jobs: DataFrame, runs: DataFrame, slot_id: str | None) -> DataFrame:
    """Run rows with the slot's stage-3 results cleared; no slot means every slot (SNK-15, SNK-27, JON-07)."""
    flagged = run_jobs.join(_of_slot(runs, slot_id).withColumn("_own", F.lit(True)), "pipeline_run_id", "left")
    cleared = {c: F.when(F.col("_own").isNull(), F.col(c)) for c in ("stage3_status", "stage3_rationale")}
    return flagged.withColumns(cleared).select(*run_jobs.columns)


def affected_by_stage_3(run_jobs: DataFrame, runs: DataFrame, slot_id: str | None) -> DataFrame:
    """How many rows ``without_stage_3`` changes."""
    some = F.col("stage3_status").isNotNull() | F.col("stage3_rationale").isNotNull()
    return run_jobs.where(some).join(_of_slot(runs, slot_id), "pipeline_run_id", "left_semi").agg(F.count(F.lit(1)).alias("affected"))


def without_runs(runs: DataFrame, run_jobs: DataFrame, slot_id: str) -> tuple[DataFrame, DataFrame]:
    """Runs and run rows without those of a slot (SNK-16)."""
    return runs.where(~F.col("slot_id").eqNullSafe(slot_id)), run_jobs.join(_of_slot(runs, slot_id), "pipeline_run_id", "left_anti").select(*run_jobs.columns)


def patched(run_jobs: DataFrame, run_id: int, job_id: str, stage: int, passed: bool) -> DataFrame:
    """Run rows after a manual decision; a row out of scope is an error (SNK-17, SNK-18)."""
    own = (F.col("pipeline_run_id") == run_id) & (F.col("job_id") == job_id)
    own = own & F.col("stage3_status").isin(*schema.STAGE_3) if stage == 3 else own
    if run_jobs.where(own).isEmpty():
        raise KeyError((run_id, job_id))
    two = F.lit(schema.STAGE_2[not passed]) if stage == 2 else F.col("stage2_status")
    three = F.lit(None).cast("string") if stage == 2 else F.lit(schema.STAGE_3[not passed])
    new = {"stage2_status": two, "stage3_status": three, "stage3_rationale": F.lit(None).cast("string")}
    return run_jobs.withColumns({k: F.when(own, v).otherwise(F.col(k)) for k, v in new.items()})


def cutoff(now: datetime) -> datetime:
    """Jobs created before this are dropped (SNK-20)."""
    return now - timedelta(days=schema.RETENTION_DAYS)


def retained(jobs: DataFrame, before: datetime) -> DataFrame:
    """Jobs created at the cutoff or later (SNK-19)."""
    return jobs.where(F.col("created_at") >= F.lit(before).cast(jobs.schema["created_at"].dataType))


def cascaded(table: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is still there: stands in for a foreign key that deletes (SNK-19, SNK-24)."""
    return table.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi").select(*table.columns)


def next_id(table: DataFrame) -> int:
    """One more than the largest id (SNK-11)."""
    return (table.agg(F.max("id")).first()[0] or 0) + 1
