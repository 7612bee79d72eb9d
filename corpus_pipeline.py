"""The corpus pipeline: stages from raw documents to token ids, each over all rows that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontamination, jaccard_join, language_id, substring_dedup, word_bpe
from siftline.llm.work import Scratch, text_tag

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The least score of a language that keeps a document.
LEAST_LANGUAGE_SCORE = 0.5


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _same_rows(rows: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """``rows`` that have, or lack, a row of ``marked`` with their id (null, too) and hash of the text."""
    same = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.text_hash") == F.col("m.text_hash"))
    return rows.alias("r").join(marked.select("doc_id", "text_hash").alias("m"), same, how)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language; ``lang`` becomes the recognised one.

    Learned from the rows whose ``lang`` is known.  Where no language is known at all, nothing can be rejected.
    """
    pieces = language_id.Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.fit(docs, pieces)
    if not model.languages:
        return _documents(docs)
    told = language_id.identify(docs, model, carry=("text", "source", "n_chars"))
    kept = told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select("doc_id", F.col("carried_0").alias("text"), F.col("lang_pred").alias("lang"), F.col("carried_1").alias("source"), F.col("carried_2").alias("n_chars"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near duplicates.

    Of rows that share that id the one with the smallest hash of its text stays, and of equal rows one.  Rows with a
    null id and no near duplicate with an id form groups by their texts.
    """
    scratch = Scratch(spark, "groups")
    groups = jaccard_join.jaccard_components(docs, like=jaccard_join.Similarity(words=5, num=80, den=100))
    groups = scratch.keep(groups.select("doc_id", "component_id", "text_hash"), "groups")
    alone = F.when(F.col("component_id").isNull(), F.col("text_hash"))
    first = groups.groupBy("component_id", alone.alias("alone")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("rows")
    )
    shared = scratch.keep(first.where("rows > 1").select("component_id", "alone", "first"), "shared")
    met = groups.withColumn("alone", alone).alias("g").join(shared.alias("s"), F.col("g.component_id").eqNullSafe(F.col("s.component_id")) & F.col("g.alone").eqNullSafe(F.col("s.alone")))
    same = F.col("g.doc_id").eqNullSafe(F.col("s.first.doc_id")) & (F.col("g.text_hash") == F.col("s.first.text_hash"))
    met = met.groupBy("g.doc_id", "g.text_hash").agg(F.first(same).alias("stays"), F.count(F.lit(1)).alias("rows"))
    marked = scratch.keep(met.where("not stays or rows > 1").select("doc_id", "text_hash", "stays"), "marked")
    rows = _documents(docs).withColumn("text_hash", F.coalesce(text_tag(F.col("text")), F.lit(0)))
    equal = _same_rows(rows, marked.where("stays"), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return _same_rows(rows, marked, "left_anti").unionByName(equal).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 20 words or more that occur earlier in the corpus."""
    cut = substring_dedup.substring_dedup(docs, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), F.col("carried_0").alias("lang"), F.col("carried_1").alias("source"), F.length("kept").cast("bigint").alias("n_chars"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whole, in part or edited."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = Scratch(spark, "leaks").keep(found.select("doc_id", "text_hash").distinct(), "leaks")  # few, so that Spark may broadcast them
    return _same_rows(_documents(docs).withColumn("text_hash", text_tag(F.col("text"))), found, "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    encoder = word_bpe.Encoder.read(public_tokenizers.path("word_bpe_49k.json"))
    return word_bpe.encode(docs, encoder).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language ID", identified),
    ("n-gram Jaccard join", unlike),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", uncontaminated),
    ("BPE encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs
