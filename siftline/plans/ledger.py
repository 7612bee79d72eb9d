"""Locks and cooldowns of ingest as rows with an expiry (ORC-01, ORC-02).  One writer on the driver is assumed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema


class Busy(RuntimeError):
    """Another ingest of the slot and source holds the lock."""


class Cooling(RuntimeError):
    """The slot and source were ingested a short time ago."""


def active(ledger: DataFrame, now: datetime) -> DataFrame:
    """Locks and cooldowns that have not run out."""
    return ledger.where(F.col("expires_at") > F.lit(now).cast(ledger.schema["expires_at"].dataType))


def _held(ledger: DataFrame, kind: str, slot_id: str, source_id: str, now: datetime) -> bool:
    return not active(ledger, now).where((F.col("kind") == kind) & (F.col("slot_id") == slot_id) & (F.col("source_id") == source_id)).isEmpty()


def _added(ledger: DataFrame, kind: str, slot_id: str, source_id: str, until: datetime, now: datetime) -> DataFrame:
    return active(ledger, now).unionByName(ledger.sparkSession.createDataFrame([(kind, slot_id, source_id, until)], schema.LEDGER))


def begun(ledger: DataFrame, slot_id: str, source_id: str, now: datetime, refresh: bool = False) -> DataFrame:
    """The ledger with the lock taken; an explicit refresh passes a cooldown but not a lock."""
    if not refresh and _held(ledger, "cooldown", slot_id, source_id, now):
        raise Cooling(f"{slot_id}/{source_id}")
    if _held(ledger, "lock", slot_id, source_id, now):
        raise Busy(f"{slot_id}/{source_id}")
    return _added(ledger, "lock", slot_id, source_id, now + timedelta(seconds=schema.LOCK_SECONDS), now)


def released(ledger: DataFrame, slot_id: str, source_id: str) -> DataFrame:
    return ledger.where(~((F.col("kind") == "lock") & (F.col("slot_id") == slot_id) & (F.col("source_id") == source_id)))


def cooled(ledger: DataFrame, slot_id: str, source_id: str, now: datetime) -> DataFrame:
    """The ledger after a successful ingest."""
    return _added(released(ledger, slot_id, source_id), "cooldown", slot_id, source_id, now + timedelta(seconds=schema.COOLDOWN_SECONDS), now)
