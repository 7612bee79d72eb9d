"""The three stages: broad filter, keywords, and a capped batch for scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from .listing import canonical


@dataclass(frozen=True)
class BroadRules:
    """Stage 1: a window of dates (both ends or neither), role words, remote only, countries (FLT-02)."""

    start: datetime | None = None
    end: datetime | None = None
    synonyms: tuple[str, ...] = ()
    remote_only: bool = False
    countries: tuple[str, ...] = ()

    def __post_init__(self):
        if (self.start is None) != (self.end is None):
            raise ValueError("a window needs both ends or neither")
        if self.start and self.start > self.end:
            raise ValueError("a window must not end before it starts")

    def window(self, now: datetime) -> tuple[datetime, datetime]:
        return (self.start, self.end) if self.start else (now - timedelta(days=schema.WINDOW_DAYS), now)


@dataclass(frozen=True)
class KeywordRules:
    """Stage 2: any of ``include`` (if there are any) and none of ``exclude``."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def in_window(jobs: DataFrame, start: datetime, end: datetime) -> Column:
    """Posted within both ends, which count; without a date never (FLT-03).  The bounds take the column's own type, so
    that the scan can use its statistics."""
    kind = jobs.schema["posted_at"].dataType
    return F.col("posted_at").between(F.lit(start).cast(kind), F.lit(end).cast(kind))


def in_countries(countries: tuple[str, ...]) -> Column:
    """In the list, whatever case or spaces; no country is in no list (FLT-06)."""
    wanted = sorted({c.strip().upper() for c in countries if c.strip()})
    return F.upper(text.trim(F.col("country_code"))).isin(*wanted) if wanted else F.lit(True)


def broad(jobs: DataFrame, rules: BroadRules, now: datetime) -> DataFrame:
    """Jobs that pass stage 1, one filter that reaches the scan (FLT-01 to FLT-07)."""
    keep = in_window(jobs, *rules.window(now))
    role = text.any_of(text.haystack(F.col("title"), F.col("description")), rules.synonyms)
    if role is not None:
        keep &= role
    if rules.remote_only:
        keep &= F.col("is_remote")
    return jobs.where(keep & in_countries(rules.countries))


def keywords(rules: KeywordRules) -> Column:
    """Whether stage 2 passes a job (FLT-08 to FLT-11)."""
    hay = text.haystack(F.col("title"), F.col("description"))
    include, exclude = text.any_of(hay, rules.include), text.any_of(hay, rules.exclude)
    keep = F.lit(True) if include is None else include
    return keep if exclude is None else keep & ~exclude


def stage_2(jobs: DataFrame, rules: KeywordRules) -> DataFrame:
    """Every job with its stage-2 status: a partition of the jobs, none is dropped."""
    return jobs.withColumn("stage2_status", F.when(keywords(rules), schema.PASSED_2).otherwise(schema.REJECTED_2))


def cap(policy: int = schema.STAGE_3_BATCH, request: int | None = None) -> int:
    """How many jobs a batch takes: the smaller of policy and request (TOP-07)."""
    policy = min(policy if policy > 0 else schema.STAGE_3_BATCH, schema.STAGE_3_BATCH_MOST)
    return min(policy, request) if request and request > 0 else policy


def batch(candidates: DataFrame, excluded: DataFrame | None, size: int, key: str = "job_id") -> DataFrame:
    """The next ``size`` unlike candidates in canonical order, without blanks and those excluded (TOP-06, JON-08)."""
    left = candidates.where(text.trim(F.col(key)) != "").dropDuplicates([key])
    if excluded is not None:
        left = left.join(excluded.select(key), key, "left_anti")
    return canonical(left, key).limit(size)


@dataclass(frozen=True)
class Scored:
    score: int
    reason: str


Scorer = Callable[[str, str, str, str], str]


def zero_scorer(profile: str, title: str, company: str, description: str) -> str:
    """A scorer for tests and for engines without a model (SCR-09)."""
    return '{"score": 0, "rationale": "no scorer"}'


def prompt(profile: Column, title: Column, company: Column, description: Column) -> Column:
    """What a model is asked, in a wording of our own (SCR-03)."""
    parts = [F.lit("Rate how well this job fits the profile, from 0 to 100, with a short rationale, as JSON.\nProfile: "), profile, F.lit("\nTitle: "), title, F.lit("\nCompany: "), company, F.lit("\nDescription:\n"), description]
    return F.concat(*[text.text(p) for p in parts])


def answer_text(blocks: Column) -> Column:
    """Text of an answer's text blocks, joined and trimmed (SCR-04)."""
    return text.trim(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: text.text(b["text"])), ""))


def parsed_answer(raw: Column) -> Column:
    """``score`` and ``rationale`` of an answer; any other content, type or range is an error (SCR-05 to SCR-07)."""
    value = F.try_parse_json(text.text(raw))
    kind = F.schema_of_variant(value)
    sound = kind.isin("OBJECT<rationale: STRING, score: BIGINT>")
    score = F.try_variant_get(value, "$.score", "int")
    reason = F.try_variant_get(value, "$.rationale", "string")
    ok = F.coalesce(sound & score.between(0, 100) & (F.length(reason) > 0), F.lit(False))
    return F.when(ok, F.struct(score.alias("score"), reason.alias("reason"))).otherwise(F.raise_error(F.concat(F.lit("bad answer of the scorer: "), F.substring(text.text(raw), 1, 200))).cast("struct<score:int,reason:string>"))


def scored(jobs: DataFrame, profile: str, scorer: Scorer) -> DataFrame:
    """Adds ``score`` and ``reason``; the first failure of the scorer ends the job (SCR-01, SCR-02, SCR-08).

    A retried task calls the scorer again: write the result before anything depends on it.
    """
    fields = ("title", "company", "description")

    @F.pandas_udf("string")
    def ask(title: pd.Series, company: pd.Series, description: pd.Series) -> pd.Series:
        return pd.Series([scorer(profile, *(x or "" for x in row)) for row in zip(title, company, description, strict=True)], dtype=object)

    asked = jobs.withColumn("_answer", ask(*[F.col(f) for f in fields]))
    return asked.withColumn("_parsed", parsed_answer(F.col("_answer"))).withColumns({"score": F.col("_parsed.score"), "reason": F.col("_parsed.reason")}).drop("_answer", "_parsed")


def scored_by_model(jobs: DataFrame, profile: str, model: Callable[[str], str]) -> DataFrame:
    """Adds ``score`` and ``reason`` from a model's replies: prompt, reply, its text blocks, the checked answer (SCR-01 to SCR-08).

    ``model`` is asked with a prompt and gives the reply as JSON, ``{"content": [{"type": "text", "text": ...}, ...]}``.
    The first failure or bad answer ends the job.  A retried task asks again: write the result before anything depends on it.
    """

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(model)

    reply = F.from_json(ask(prompt(F.lit(profile), F.col("title"), F.col("company"), F.col("description"))), "content array<struct<type:string,text:string>>")
    asked = text.held(jobs, _answer=answer_text(reply["content"]))
    asked = text.held(asked, _parsed=parsed_answer(F.col("_answer")))
    return asked.withColumns({"score": F.col("_parsed.score"), "reason": F.col("_parsed.reason")}).drop("_answer", "_parsed")


def status_of(score: Column) -> Column:
    """Final status by the pass mark (PRJ-45)."""
    return F.when(score >= schema.PASS_SCORE, schema.PASSED_3).otherwise(schema.REJECTED_3)


def in_memory(jobs: DataFrame, broad_rules: BroadRules, keyword_rules: KeywordRules, profile: str, scorer: Scorer, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stages 1, 2 and 3 in a row, nothing stored (ORC-10)."""
    first = broad(jobs, broad_rules, now)
    second = first.where(keywords(keyword_rules))
    return first, second, scored(second, profile, scorer)


@dataclass
class Counters:
    """Counts by outcome for each source (AGG-05)."""

    columns: list[str] = field(default_factory=lambda: ["written", "skipped", "filtered"])

    def of(self, outcomes: DataFrame) -> DataFrame:
        """From rows of ``source`` and ``action`` (null: filtered out by stage 1)."""
        return outcomes.groupBy("source").agg(
            F.count_if(F.col("action").isin("INSERT", "FULL_UPDATE", "DESCRIPTION_ONLY")).alias("written"),
            F.count_if(F.col("action") == "SKIP").alias("skipped"),
            F.count_if(F.col("action").isNull()).alias("filtered"),
        )


__all__ = ["BroadRules", "KeywordRules", "broad", "stage_2", "batch", "scored", "status_of"]
