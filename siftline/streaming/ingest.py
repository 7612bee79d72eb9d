"""Structured Streaming ingest: captured pages as they arrive, each micro-batch through the same upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.stages import BroadRules
from ..plans.runs import Engine

PAGES = "page int, url string, body string"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of captured pages from a folder of JSON lines."""
    return spark.readStream.schema(PAGES).json(path)


def ingest(stream: DataFrame, engine: Engine, slot_id: str, source_id: str, parse: Callable[[DataFrame], DataFrame], rules: BroadRules, checkpoint: str) -> StreamingQuery:
    """Writes a stream of pages into the engine's tables; upserts are idempotent, so a batch that is run again changes nothing.

    The checkpoint holds how far the stream was read: it stands in for the source's cursor.
    """

    def write(batch: DataFrame, number: int) -> None:
        engine.ingest(slot_id, source_id, parse(batch), rules, cursor=str(number), refresh=True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
