"""Slots, profile and stage requests: the engine's surface as functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators import listing, stages, store
from ..operators.listing import Page
from ..operators.stages import BroadRules, KeywordRules
from .runs import Engine, Kind, Request


class Conflict(RuntimeError):
    """The request contradicts what is stored or what is running."""


class Slots:
    """Saved searches over an engine (SNK-22 to SNK-27, ORC-16 to ORC-25)."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self._log: dict[tuple[str, int], dict] = {}

    def _slots(self) -> DataFrame:
        return self.engine.tables.read("slots", schema.SLOTS)

    def _keys(self) -> DataFrame:
        return self.engine.tables.read("slot_keys", schema.SLOT_KEYS)

    def create(self, key: str, name: str) -> tuple[str, bool]:
        """A slot's id and whether it is new: the same key gives the same slot, with another name it is a conflict, and a
        fourth slot is one (SNK-22)."""
        key, name = str(uuid.UUID(key)), name.strip()
        if not name:
            raise ValueError("a slot needs a name")
        slots = {r["id"]: r["name"] for r in self._slots().collect()}  # SLOT_LIMIT rows at most
        known = self._keys().where(F.col("key") == key).first()
        if known:
            if slots.get(known["slot_id"]) != name:
                raise Conflict("the key belongs to another name")
            return known["slot_id"], False
        if len(slots) >= schema.SLOT_LIMIT:
            raise Conflict(f"there are {schema.SLOT_LIMIT} slots already")
        slot_id, now = str(uuid.uuid4()), self.engine.clock()
        spark = self.engine.spark
        self.engine.tables.write("slots", self._slots().unionByName(spark.createDataFrame([(slot_id, name, now)], schema.SLOTS)))
        self.engine.tables.write("slot_keys", self._keys().unionByName(spark.createDataFrame([(key, slot_id, now)], schema.SLOT_KEYS)))
        return slot_id, True

    def create_and_ingest(self, key: str, name: str, sources: dict[str, Callable[[str], DataFrame]]) -> str:
        """A slot with its first ingest; if that can't start, the slot goes again (ORC-20)."""
        slot_id, new = self.create(key, name)
        if new:
            try:
                self._log[slot_id, 1] = self.engine.run(Request(Kind.INGEST_SOURCES, slot_id, tuple(sources), search=name), sources)
            except Exception:
                self.delete(slot_id)
                raise
        return slot_id

    def list(self) -> DataFrame:
        return listing.slots_in_order(self._slots())

    def delete(self, slot_id: str) -> None:
        """Drops a slot and what belongs to it (SNK-24, ORC-21)."""
        if self._slots().where(F.col("id") == slot_id).isEmpty():
            raise KeyError(slot_id)
        tables = self.engine.tables
        self.engine.invalidate(slot_id, 2)
        tables.write("slots", self._slots().where(F.col("id") != slot_id))
        for name, ddl in (("slot_keys", schema.SLOT_KEYS), ("slot_jobs", schema.SLOT_JOBS), ("watermarks", schema.WATERMARKS)):
            tables.write(name, store.cascaded(tables.read(name, ddl), self._slots(), "slot_id"))

    def profile(self) -> str:
        """The profile's text, empty at first (SNK-25)."""
        row = self.engine.tables.read("profile", schema.PROFILE).first()
        return row["text"] if row else ""

    def set_profile(self, words: str) -> None:
        """A new profile; every slot's scores are out of date (SNK-26, SNK-27)."""
        spark = self.engine.spark
        self.engine.tables.write("profile", spark.createDataFrame([(1, words, self.engine.clock())], schema.PROFILE))
        self.engine.invalidate(None, 3)

    def latest_run(self, slot_id: str) -> int | None:
        row = listing.latest_run(self.engine.runs().where(F.col("slot_id") == slot_id)).first()
        return row["run_id"] if row else None

    def run_stage_2(self, slot_id: str, keywords: KeywordRules) -> dict:
        """Drops the slot's runs and makes a new one, over the default window (ORC-16)."""
        self.engine.invalidate(slot_id, 2)
        return self._ran(slot_id, 2, Request(Kind.PIPELINE_STAGE2, slot_id, broad=BroadRules(), keywords=keywords), stages.zero_scorer)

    def run_stage_3(self, slot_id: str, scorer: stages.Scorer, max_jobs: int | None = None) -> dict:
        """Clears and scores the latest run; needs a run and a profile (ORC-17)."""
        run_id, profile = self.latest_run(slot_id), self.profile()
        if run_id is None or not profile.strip():
            raise Conflict("stage 3 needs a run and a profile")
        self.engine.invalidate(slot_id, 3)
        return self._ran(slot_id, 3, Request(Kind.PIPELINE_STAGE3, slot_id, profile=profile, run_id=run_id, max_jobs=max_jobs), scorer)

    def _ran(self, slot_id: str, stage: int, request: Request, scorer: stages.Scorer) -> dict:
        if self._log.get((slot_id, stage), {}).get("state") == "running":
            raise Conflict("the stage is running")
        self._log[slot_id, stage] = {"state": "running", "request": request}
        try:
            out = self.engine.run(request, scorer=scorer)
        except Exception as error:
            self._log[slot_id, stage] |= {"state": "failed", "error": str(error)}
            raise
        self._log[slot_id, stage] |= {"state": "succeeded"} | out
        return out

    def state(self, slot_id: str, stage: int) -> dict:
        """What a stage last did: idle, running, succeeded or failed, with its request (ORC-24, ORC-25)."""
        return self._log.get((slot_id, stage), {"state": "idle"})

    def jobs(self, slot_id: str, stage: int, at: Page = Page()) -> tuple[DataFrame, int]:
        """A page of a stage's list and the whole list's size; without a run stages 2 and 3 are empty (ORC-18, TOP-03 to TOP-05)."""
        status, e = listing.status_filter(stage, at.status), self.engine
        run_id = self.latest_run(slot_id) if stage > 1 else None
        if stage == 1:
            rows = listing.passed_stage_1(e.listed(), e.slot_jobs(), slot_id)
        else:
            make = listing.stage_2_list if stage == 2 else listing.stage_3_list
            rows = make(e.listed(), e.slot_jobs(), e.run_jobs(), slot_id, run_id or 0, status)
        return listing.item(listing.page(rows, at), stage), rows.count()

    def patch(self, slot_id: str, stage: int, job_id: str, bucket: str) -> None:
        """A manual decision on the latest run (ORC-19)."""
        run_id = self.latest_run(slot_id)
        if run_id is None or bucket not in ("passed", "failed") or stage not in (2, 3):
            raise ValueError("no run, or not a stage and bucket that can be set")
        self.engine.tables.write("run_jobs", store.patched(self.engine.run_jobs(), run_id, job_id, stage, bucket == "passed"))
