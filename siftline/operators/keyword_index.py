"""Keyword rules of all slots at once, through an inverted index of word trigrams.

A word of a rule counts where it is a substring of a job's title and description in lower case.  Asking each job for each
word of each slot would cost a pass over the texts for every word.  Here each distinct word is listed under one of its
trigrams, the one that fewest other words have; a job's own trigrams find the listed words, and only those are looked for
in its text.  Finding costs one scan of the texts however many slots there are, and the texts aren't shuffled: trigrams
are exploded, met with the broadcast index and checked inside one compiled stage.

The index is measured before it is broadcast; one that is larger than ``BROADCAST_LIMIT`` is met in shards, a scan each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text

#: Bytes of listed words that may be broadcast at once.
BROADCAST_LIMIT = 32 * 1024 * 1024
#: Room that a listed word takes beside its letters.
_ENTRY = 96
GRAM = 3


def grams(value: Column) -> Column:
    """Distinct trigrams, and the empty one, under which shorter words are listed."""
    own = F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.array_distinct(F.concat(F.array(F.lit("")), own))


def effective(rules: DataFrame) -> DataFrame:
    """Rules ``(slot_id, kind, word)`` with words as they are looked for: trimmed, lower case, no blanks, each once (FLT-07)."""
    return rules.withColumn("word", F.lower(text.trim(F.col("word")))).where("word <> ''").select("slot_id", "kind", "word").distinct()


def index(words: DataFrame) -> DataFrame:
    """``(gram, word)``: each distinct word under its trigram that fewest words have; ties go to the first in order."""
    own = words.select("word").distinct()
    each = own.withColumn("gram", F.explode(grams(F.col("word")))).where((F.col("gram") != "") | (F.length("word") < GRAM))
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return each.join(shared, "gram").groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).select("gram", "word")


def found(jobs: DataFrame, words: DataFrame, key: str = "job_id") -> DataFrame:
    """``(key, words)``: the words that occur in each job; jobs without any have no row.

    A repeated id counts as one job with all its texts.
    """
    listed = index(words)
    size = listed.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("gram") + _ENTRY), F.lit(0)).alias("bytes")).first()["bytes"]
    shards = max(1, -(-size // BROADCAST_LIMIT))
    hay = jobs.select(key, text.haystack(F.col("title"), F.col("description")).alias("_hay"))
    each = hay.select(key, "_hay", F.explode(grams(F.col("_hay"))).alias("gram"))
    out = None
    for shard in range(shards):
        own = listed if shards == 1 else listed.where(F.pmod(F.xxhash64("word"), F.lit(shards)) == shard)
        part = each.join(F.broadcast(own), "gram").where(F.contains("_hay", "word")).select(key, "word")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.collect_set("word").alias("words"))


def of_slots(rules: DataFrame) -> DataFrame:
    """``(slot_id, include, exclude)``: a slot's words as two lists, null where it has none of a kind."""
    kinds = {kind: F.collect_set(F.when(F.col("kind") == kind, F.col("word"))) for kind in ("include", "exclude")}
    return rules.groupBy("slot_id").agg(*(F.when(F.size(words) > 0, words).alias(kind) for kind, words in kinds.items()))


def passes() -> Column:
    """Any word to include, if there are any, and none to exclude, over ``words``, ``include`` and ``exclude`` (FLT-08, FLT-10, FLT-11)."""
    words = F.coalesce("words", F.array().cast("array<string>"))
    wanted = F.col("include").isNull() | F.arrays_overlap(words, "include")
    return wanted & ~F.coalesce(F.arrays_overlap(words, "exclude"), F.lit(False))


def stage_2_of_slots(jobs: DataFrame, slot_jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """``(slot_id, job_id, stage2_status)`` for every job of every slot, each by its own slot's rules.

    ``rules`` has ``slot_id``, ``kind`` ("include" or "exclude") and ``word``.  A slot without rules passes all its jobs.
    Memberships and found words meet by job, so one slot with most of the jobs is no hot key; the slots' lists, a row each,
    are broadcast where they are small and otherwise joined by slot and salt.
    """
    clean = effective(rules)
    told = slot_jobs.select("slot_id", "job_id").join(found(jobs, clean), "job_id", "left")
    lists = of_slots(clean)
    size = clean.agg(F.coalesce(F.sum(F.octet_length("word") + _ENTRY), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= BROADCAST_LIMIT:
        met = told.join(F.broadcast(lists), "slot_id", "left")
    else:
        salts = 32
        salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = told.withColumn("_salt", F.pmod(F.xxhash64("job_id"), F.lit(salts)).cast("int")).join(salted, ["slot_id", "_salt"], "left")
    return met.select("slot_id", "job_id", F.when(passes(), schema.PASSED_2).otherwise(schema.REJECTED_2).alias("stage2_status"))


def with_role_of_slots(jobs: DataFrame, slot_jobs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(slot_id, job_id)`` of the memberships whose job has a role word of its slot; ``synonyms`` is ``(slot_id, word)``.

    A slot without role words keeps all its jobs (FLT-04, FLT-07).
    """
    told = stage_2_of_slots(jobs, slot_jobs, synonyms.select("slot_id", F.lit("include").alias("kind"), "word"))
    return told.where(F.col("stage2_status") == schema.PASSED_2).select("slot_id", "job_id")
