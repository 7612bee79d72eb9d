"""Runs: ingest, stage 2 and stage 3 over stored tables, and the kinds of runs that combine them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.identity import FilterKey
from ..operators import listing, stages, store
from ..operators.stages import BroadRules, KeywordRules
from ..sources.paging import cut
from . import ledger


class Kind(StrEnum):
    """Kinds of runs (ORC-05, ORC-08, ORC-09)."""

    INGEST_SOURCES = "INGEST_SOURCES"
    PIPELINE_STAGE2 = "PIPELINE_STAGE2"
    PIPELINE_STAGE3 = "PIPELINE_STAGE3"
    PIPELINE_STAGE2_THEN_STAGE3 = "PIPELINE_STAGE2_THEN_STAGE3"
    INGEST_THEN_PIPELINE = "INGEST_THEN_PIPELINE"
    DELTA_INGEST_THEN_PIPELINE = "DELTA_INGEST_THEN_PIPELINE"

    @property
    def ingests(self) -> bool:
        return "INGEST" in self.value

    @property
    def stage_2(self) -> bool:
        return self in (Kind.PIPELINE_STAGE2, Kind.PIPELINE_STAGE2_THEN_STAGE3) or self.value.endswith("THEN_PIPELINE")

    @property
    def stage_3(self) -> bool:
        return self.stage_2 and self is not Kind.PIPELINE_STAGE2 or self is Kind.PIPELINE_STAGE3


@dataclass(frozen=True)
class Request:
    """What a run is asked to do; checked as it is made (ORC-07)."""

    kind: Kind
    slot_id: str
    sources: tuple[str, ...] = ()
    broad: BroadRules = field(default_factory=BroadRules)
    keywords: KeywordRules = field(default_factory=KeywordRules)
    profile: str = ""
    run_id: int | None = None
    max_jobs: int | None = None
    refresh: bool = False
    search: str = ""

    def __post_init__(self):
        if not self.slot_id.strip():
            raise ValueError("a run needs a slot")
        if self.kind.ingests and not any(s.strip() for s in self.sources):
            raise ValueError("an ingest needs a source")
        if self.kind.stage_3 and not self.profile.strip():
            raise ValueError("stage 3 needs a profile")
        if self.kind is Kind.PIPELINE_STAGE3 and not (self.run_id or 0) > 0:
            raise ValueError("stage 3 alone needs a run")

    @classmethod
    def parse(cls, body: str) -> Request:
        """From a JSON body of 1 MiB at most, without unknown fields (ORC-26, ORC-27, DAT-10)."""
        if len(body.encode()) > 1 << 20:
            raise ValueError("the body is too large")
        raw = json.loads(body)
        if not isinstance(raw, dict) or (unknown := set(raw) - {"kind", "slot_id", "sources", "broad", "keywords", "profile", "run_id", "max_jobs", "refresh", "search"}):
            raise ValueError(f"unknown fields: {sorted(unknown) if isinstance(raw, dict) else raw}")

        def instant(value: str | None) -> datetime | None:
            return datetime.fromisoformat(value) if value and value.strip() else None

        broad, words = dict(raw.pop("broad", None) or {}), dict(raw.pop("keywords", None) or {})
        rules = BroadRules(instant(broad.pop("from", None)), instant(broad.pop("to", None)), tuple(broad.pop("role_synonyms", ())), bool(broad.pop("remote_only", False)), tuple(broad.pop("countries", ())))
        wanted = KeywordRules(tuple(words.pop("include", ())), tuple(words.pop("exclude", ())))
        if broad or words:
            raise ValueError(f"unknown fields: {sorted({**broad, **words})}")
        return cls(kind=Kind(raw.pop("kind")), broad=rules, keywords=wanted, sources=tuple(raw.pop("sources", ())), **raw)

    def key(self) -> FilterKey:
        window = (self.broad.start, self.broad.end) if self.broad.start else None
        return FilterKey(self.slot_id, list(self.broad.synonyms), window, list(self.sources), self.broad.remote_only, list(self.broad.countries))

    def key_hash(self) -> str:
        """The hash by which runs with equal rules are known; blank where the rules make no key (SNK-12)."""
        try:
            return self.key().digest()
        except ValueError:
            return ""


class Engine:
    """Stored tables of one deployment, and what is done with them.  One writer at a time is assumed."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime]):
        self.spark, self.tables, self.clock = spark, store.Snapshots(spark, root), clock

    def jobs(self) -> DataFrame:
        return self.tables.read("jobs", schema.JOBS)

    def listed(self) -> DataFrame:
        return self.jobs().withColumnRenamed("id", "job_id")

    def slot_jobs(self) -> DataFrame:
        return self.tables.read("slot_jobs", schema.SLOT_JOBS)

    def runs(self) -> DataFrame:
        return self.tables.read("runs", schema.RUNS)

    def run_jobs(self) -> DataFrame:
        return self.tables.read("run_jobs", schema.RUN_JOBS)

    def _ledger(self) -> DataFrame:
        return self.tables.read("ledger", schema.LEDGER)

    def ingest(self, slot_id: str, source_id: str, fetched: DataFrame, rules: BroadRules, cursor: str | None = None, refresh: bool = False) -> dict[str, int]:
        """One source's rows into the tables: lock, stage 1, upsert, membership, cursor, cooldown (ORC-03).

        Membership is written for skipped rows too; a failure leaves the lock to be released and no cooldown.
        """
        now, source_id = self.clock(), source_id.strip().lower()
        self.tables.write("ledger", ledger.begun(self._ledger(), slot_id, source_id, now, refresh))
        try:
            numbered = stages.broad(fetched.withColumn("_nth", F.monotonically_increasing_id()), rules, now)
            counted = numbered.groupBy("id").agg(F.max_by(F.struct(*fetched.columns), "_nth").alias("last"), F.count(F.lit(1)).alias("times"))
            passed = cut(counted).select("last.*", "times")  # of several rows with an id the last one counts
            repeated = passed.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("ids")).first()
            passed = passed.drop("times")
            met = store.classified(self.jobs(), passed)
            counts = {r["action"]: r["count"] for r in met.where("action is not null").groupBy("action").count().collect()}
            self.tables.write("jobs", store.upsert(self.jobs(), passed, now))
            members = passed.select(F.lit(slot_id).alias("slot_id"), F.col("id").alias("job_id"), F.lit(now).cast("timestamp").alias("first_seen_at"))
            self.tables.write("slot_jobs", store.kept_first(self.slot_jobs(), members, "slot_id", "job_id"), "slot_id")
            if cursor is not None:
                self.tables.write("watermarks", store.with_cursor(self.tables.read("watermarks", schema.WATERMARKS), slot_id, source_id, cursor, now))
            self.tables.write("ledger", ledger.cooled(self._ledger(), slot_id, source_id, now))
        finally:
            self.tables.write("ledger", ledger.released(self._ledger(), slot_id, source_id))
        written = sum(n for act, n in counts.items() if act != store.SKIP)
        return {"written": written, "skipped": repeated["rows"] - written, "filtered": fetched.count() - repeated["rows"]}

    def create_run(self, slot_id: str | None, key_hash: str = "") -> int:
        """A new run; a blank key is null (SNK-11, SNK-12)."""
        run_id = store.next_id(self.runs())
        row = self.spark.createDataFrame([(run_id, self.clock(), key_hash.strip().lower() or None, slot_id)], schema.RUNS)
        self.tables.write("runs", self.runs().unionByName(row))
        return run_id

    def stage_2(self, slot_id: str, run_id: int, broad: BroadRules, keywords: KeywordRules) -> None:
        """Stage 2 over the slot's pool: stage 1 again, keywords, statuses (ORC-11, JON-09)."""
        pool = listing.passed_stage_1(self.listed(), self.slot_jobs(), slot_id)
        told = stages.stage_2(stages.broad(pool, broad, self.clock()), keywords)
        wanted = told.select(F.lit(run_id).cast("bigint").alias("pipeline_run_id"), "job_id", F.col("stage2_status").alias("status"))
        self.tables.write("run_jobs", store.with_status(self.run_jobs(), wanted))

    def stage_3(self, run_id: int, profile: str, scorer: stages.Scorer, request: int | None = None, policy: int = schema.STAGE_3_BATCH) -> None:
        """The next batch in canonical order, scored and stored (ORC-12).  Scores are written before statuses depend on them."""
        waiting = listing.passed_stage_2(self.listed(), self.run_jobs().where(F.col("stage3_status").isNull()), run_id)
        batch = stages.batch(waiting, None, stages.cap(policy, request))
        self.tables.write("scores", stages.scored(batch, profile, scorer).select(F.lit(run_id).cast("bigint").alias("pipeline_run_id"), "job_id", "score", "reason"))
        scores = self.tables.read("scores", "pipeline_run_id bigint, job_id string, score int, reason string")
        wanted = scores.select("pipeline_run_id", "job_id", stages.status_of(F.col("score")).alias("status"))
        told = store.with_status(self.run_jobs(), wanted)
        self.tables.write("run_jobs", store.with_rationales(told, scores.select("pipeline_run_id", "job_id", "reason")))

    def aggregate(self, run_id: int) -> DataFrame:
        return listing.aggregate(self.run_jobs().where(F.col("pipeline_run_id") == run_id))

    def run(self, request: Request, sources: dict[str, Callable[[str], DataFrame]] | None = None, scorer: stages.Scorer = stages.zero_scorer) -> dict:
        """Ingest, then a new run's stage 2, then stage 3, as the kind asks; failed sources are told, not fatal (ORC-04 to ORC-06)."""
        out: dict = {"ingest": {}, "errors": {}, "run_id": request.run_id}
        if request.kind.ingests:
            refresh = request.refresh and request.kind is not Kind.DELTA_INGEST_THEN_PIPELINE
            for source in (s.strip().lower() for s in request.sources):
                try:
                    out["ingest"][source] = self.ingest(request.slot_id, source, (sources or {})[source](request.search), request.broad, refresh=refresh)
                except Exception as error:  # a source is outside input: any failure of it is isolated
                    out["errors"][source] = str(error).splitlines()[0] if str(error) else repr(error)
        if request.kind.stage_2:
            out["run_id"] = self.create_run(request.slot_id, request.key_hash())
            self.stage_2(request.slot_id, out["run_id"], request.broad, request.keywords)
        if request.kind.stage_3:
            self.stage_3(out["run_id"], request.profile, scorer, request.max_jobs)
        if out["run_id"]:
            out |= next((r.asDict() for r in self.aggregate(out["run_id"]).collect()), {})
        return out

    def invalidate(self, slot_id: str | None, stage: int) -> None:
        """Clears stage 3 of a slot's runs, or drops the runs (SNK-15, SNK-16)."""
        if stage == 3:
            self.tables.write("run_jobs", store.without_stage_3(self.run_jobs(), self.runs(), slot_id))
        else:
            runs, rows = store.without_runs(self.runs(), self.run_jobs(), slot_id)
            self.tables.write("run_jobs", rows)
            self.tables.write("runs", runs)

    def retain(self) -> int:
        """Drops old jobs and what refers to them; how many jobs went (SNK-21, ORC-14, ORC-15)."""
        before = self.jobs().count()
        kept = store.retained(self.jobs(), store.cutoff(self.clock()))
        self.tables.write("jobs", kept)
        for name, rows in (("slot_jobs", self.slot_jobs()), ("run_jobs", self.run_jobs())):
            self.tables.write(name, store.cascaded(rows, self.jobs(), "job_id"))
        return before - self.jobs().count()

    def one_shot(self, fetched: DataFrame, broad: BroadRules, keywords: KeywordRules, profile: str, scorer: stages.Scorer, sent: DataFrame, send: Callable[[DataFrame], None]) -> DataFrame:
        """Collect, stages 1 to 3, drop what was sent, send, mark as sent: at least once (ORC-13, JON-08)."""
        _, _, scored = stages.in_memory(fetched, broad, keywords, profile, scorer, self.clock())
        self.tables.write("to_send", scored.join(sent.select("id"), "id", "left_anti"))
        fresh = self.tables.read("to_send", f"{schema.JOB_FIELDS}, score int, reason string")
        send(fresh)
        return sent.select("id").unionByName(fresh.select("id"))
