"""Several status writes of one job, in order: a fold over the transitions.

Writes of a key are folded in blocks, for each state that a block may begin in; the blocks' tables are then folded from the
state in which the job is.  So a key's writes are never gathered in one row: a row holds the writes of one block, or one
small table for each block of a key.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import once, trim
from .store import ILLEGAL, replaced, transition

#: Numbers of writes that a block spans.
BLOCK = 1024
_KEYS = ("pipeline_run_id", "job_id")
_STATES = tuple(product((None, *schema.STAGE_2), (None, *schema.STAGE_3)))


def _state(two: Column, three: Column, bad: Column) -> Column:
    return F.struct(two.cast("string").alias("two"), three.cast("string").alias("three"), bad.cast("bigint").alias("bad"))


def _step(at: Column, write: Column) -> Column:
    """The state after a write; an illegal write is noted and ends the fold."""

    def moved(change: Column) -> Column:
        none = F.lit(None)
        return (
            F.when(at["bad"].isNotNull() | (change == "NONE"), at)
            .when(change == "SET_2", _state(write["status"], at["three"], none))
            .when(change == "SET_3", _state(at["two"], write["status"], none))
            .otherwise(_state(at["two"], at["three"], write["seq"]))
        )

    return once(F.coalesce(transition(at["two"], at["three"], write["status"]), F.lit(ILLEGAL)), moved)


def _place(at: Column) -> Column:
    """A state's place among all states, from 1."""
    second = sum((F.when(at["two"] == name, k).otherwise(0) for k, name in enumerate(schema.STAGE_2, 1)), F.lit(0))
    third = sum((F.when(at["three"] == name, k).otherwise(0) for k, name in enumerate(schema.STAGE_3, 1)), F.lit(0))
    return F.coalesce(second, F.lit(0)) * 3 + F.coalesce(third, F.lit(0)) + 1


def folded(run_jobs: DataFrame, writes: DataFrame) -> DataFrame:
    """Keys that are written to, with ``stage2_status`` and ``stage3_status`` after all writes, and ``first_illegal``.

    ``writes`` has ``pipeline_run_id``, ``job_id``, ``status`` and ``seq``, a number that orders the writes of a key.  A key
    stays as it was before its first illegal write, whose number is ``first_illegal``; later writes have no effect (SNK-13).
    """
    sound = F.when(trim(F.col("job_id").cast("string")) == "", F.lit("")).otherwise(F.col("status")).alias("status")
    numbered = writes.select(*_KEYS, F.floor(F.col("seq") / BLOCK).alias("_block"), F.struct(F.col("seq").cast("bigint").alias("seq"), sound).alias("_write"))
    blocks = numbered.groupBy(*_KEYS, "_block").agg(F.array_sort(F.collect_list("_write")).alias("_writes"))
    begins = F.array(*(_state(F.lit(two), F.lit(three), F.lit(None)) for two, three in _STATES))
    tables = blocks.select(*_KEYS, F.struct("_block", F.transform(begins, lambda b: F.aggregate("_writes", b, _step)).alias("ends")).alias("_table"))
    gathered = tables.groupBy(*_KEYS).agg(F.array_sort(F.collect_list("_table")).alias("_tables"))
    met = gathered.join(run_jobs.select(*_KEYS, "stage2_status", "stage3_status"), list(_KEYS), "left")
    start = _state(F.col("stage2_status"), F.col("stage3_status"), F.lit(None))
    end = F.aggregate("_tables", start, lambda at, t: F.when(at["bad"].isNotNull(), at).otherwise(F.element_at(t["ends"], _place(at))))
    out = met.withColumn("_end", end)
    return out.select(*_KEYS, F.col("_end.two").alias("stage2_status"), F.col("_end.three").alias("stage3_status"), F.col("_end.bad").alias("first_illegal"))


def with_writes(run_jobs: DataFrame, writes: DataFrame) -> DataFrame:
    """Run rows after all writes; an illegal one is an error before anything is planned to be written."""
    ends = folded(run_jobs, writes)
    bad = ends.where("first_illegal is not null").select("job_id", "first_illegal").head(1)
    if bad:
        raise ValueError(f"illegal status change: {bad[0].asDict()}")
    reasons = run_jobs.select(*_KEYS, "stage3_rationale")
    return replaced(run_jobs, ends.drop("first_illegal").join(reasons, list(_KEYS), "left"), *_KEYS)
