"""Upserts that touch only what changes: jobs laid out by buckets of ids, compared by digests.

The job table is a folder with a partition for each bucket of ids.  Each row carries two digests, of its description and of
everything else that an upsert compares, so what an ingest does to a row is known from a narrow scan: id and digests, no
texts.  Incoming rows are few beside the stored ones; their ids and digests are measured and broadcast, so the stored side
isn't shuffled.  Only buckets with a row to be written are read whole and written anew (dynamic partition overwrite); all
other files stay as they are.

A merge that is repeated, or that died midway, ends with the same table: rows that were written are then skipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import lists, text
from ..sources.paging import cut
from .store import DESCRIPTION, FULL, INSERT, SKIP, encoded

#: Bytes of incoming ids and digests, or of rows to be written, that may be broadcast.
BROADCAST_LIMIT = 32 * 1024 * 1024
_PLAIN = ("source", "title", "company", "url", "country_code", "salary_raw")
_NULLABLE = ("apply_url", "posted_at", "is_remote", "position", "user_id")
_DIGESTS = ("rest_digest", "body_digest")


@dataclass(frozen=True)
class Layout:
    """Where the job table lies, and into how many buckets its ids are dealt; the number stays for the table's life."""

    path: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(self.buckets)).cast("int")

    def schema(self, jobs: str = schema.JOBS) -> str:
        return f"{jobs}, rest_digest string, body_digest string, bucket int"


def with_digests(jobs: DataFrame) -> DataFrame:
    """Adds the digests of what an upsert compares: lists whatever their order, blank and missing text alike (SNK-04 to SNK-06)."""
    compared = [text.text(F.col(c)).alias(c) for c in _PLAIN] + [F.col(c) for c in _NULLABLE]
    compared += [
        text.blank_to_null(F.col("stage1_status")).alias("stage1_status"),
        F.array_sort(lists.strings(F.col("tags"))).alias("tags"),
        F.transform(F.coalesce("timezone_offsets", F.array().cast("array<double>")), lambda v: v.cast("string")).alias("timezone_offsets"),
    ]
    return jobs.withColumns({"rest_digest": F.sha2(F.to_json(F.struct(*compared)), 256), "body_digest": F.sha2(text.text(F.col("description")), 256)})


def create(layout: Layout, jobs: DataFrame) -> None:
    """Writes the table as a whole, one file a bucket."""
    rows = with_digests(jobs).withColumn("bucket", layout.bucket())
    rows.repartition(layout.buckets, "bucket").write.partitionBy("bucket").parquet(layout.path)


def stored(spark: SparkSession, layout: Layout, jobs: str = schema.JOBS) -> DataFrame:
    return spark.read.schema(layout.schema(jobs)).parquet(layout.path)


def _small(rows: DataFrame, row_bytes: int) -> bool:
    return rows.count() * row_bytes <= BROADCAST_LIMIT


def arriving(layout: Layout, incoming: DataFrame) -> DataFrame:
    """Incoming rows as they are stored, with digests, bucket and the pass of stage 1."""
    passed = encoded(incoming.withColumn("stage1_status", F.lit(schema.PASSED_1)))
    return with_digests(passed).withColumn("bucket", layout.bucket())


def actions(table: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, bucket, action)`` for each row of ``new`` against the stored ``table``: both with digests (SNK-02).

    The stored side is scanned for ids and digests, and is met by broadcast where the new ids are few enough.
    """
    narrow = new.select("id", "bucket", *_DIGESTS)
    held = table.select(F.col("id").alias("old_id"), F.col("bucket").alias("old_bucket"), *(F.col(c).alias(f"old_{c}") for c in _DIGESTS))
    ids = narrow.select("id", "bucket")
    met = held.join(F.broadcast(ids) if _small(ids, 256) else ids, (F.col("old_bucket") == F.col("bucket")) & (F.col("old_id") == F.col("id")))
    known = met.select("id", *(f"old_{c}" for c in _DIGESTS))
    act = F.when(F.col("old_rest_digest").isNull(), INSERT).when(F.col("old_rest_digest") != F.col("rest_digest"), FULL).when(F.col("old_body_digest") == F.col("body_digest"), SKIP).otherwise(DESCRIPTION)
    return narrow.join(known, "id", "left").select("id", "bucket", act.alias("action"))


def merge(spark: SparkSession, layout: Layout, incoming: DataFrame, now: datetime, jobs: str = schema.JOBS) -> DataFrame:
    """Upserts ``incoming``, whose ids must be unlike, and gives ``(id, action)`` of all its rows (SNK-02, SNK-03, SNK-08).

    Creation times stay, update times move with a write, and a new description alone leaves the other fields as they are.
    """
    new = cut(arriving(layout, incoming))
    if new.select("id").distinct().count() < new.count():
        raise ValueError("an id comes twice: an upsert needs to know which row is the last")
    own = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
    table = stored(spark, layout, jobs)
    acts = cut(actions(table.where(F.col("bucket").isin(own)), new))
    writes = acts.where(F.col("action") != SKIP)
    touched = [r["bucket"] for r in writes.select("bucket").distinct().collect()]
    if touched:
        _rewritten(table.where(F.col("bucket").isin(touched)), new.join(writes.select("id", "action"), "id"), now).write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(layout.path)
    return acts.select("id", "action")


def _rewritten(old: DataFrame, changed: DataFrame, now: datetime) -> DataFrame:
    """All rows of the touched buckets as they will be."""
    at, names = F.lit(now).cast("timestamp"), [c for c in old.columns if c not in ("id", "bucket", "created_at", "updated_at")]
    size = changed.agg(F.coalesce(F.sum(F.octet_length("description") + 1024), F.lit(0)).alias("bytes")).first()["bytes"]
    n = changed.select(F.col("id").alias("new_id"), "action", *(F.col(c).alias(f"new_{c}") for c in names))
    met = old.join(F.broadcast(n) if size <= BROADCAST_LIMIT else n, F.col("id") == F.col("new_id"), "left")
    whole = F.coalesce(F.col("action") == FULL, F.lit(False))
    described = F.coalesce(F.col("action") == DESCRIPTION, F.lit(False))
    out = [F.when(whole | (described & F.lit(c in ("description", "body_digest"))), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in names]
    updated = F.when(whole | described, at).otherwise(F.col("updated_at")).alias("updated_at")
    kept = met.select("id", *out, "created_at", updated, "bucket")
    inserted = changed.where(F.col("action") == INSERT).withColumns({"created_at": at, "updated_at": at})
    return kept.unionByName(inserted.select(*kept.columns))
