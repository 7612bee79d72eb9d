"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are the word n-grams of the test items that are rare in the corpus: a first scan counts the items' words in all
documents, and an n-gram is rare where its words, if independent, would meet in fewer than ``rare`` documents in one.
(Counting the n-grams themselves would call a seed frequent because the item leaked often.)  An item keeps its
``LEAST_SEEDS`` rarest seeds whatever they are.  A second scan joins the passages of all documents to the seeds and
aligns the words around each seed with the item's.

Test items are looked up in every task, in shards below ``BROADCAST_LIMIT``: a larger test set is joined shard by
shard, one scan each, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols
from .work import BROADCAST_LIMIT, Scratch, check_broadcast, text_tag

SEED = 3
RARE = 1e-3
LEAST_SEEDS = 8
#: Smith-Waterman scores for words.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, as a share of what a whole copy of the item gets, and least number of words that match.
LEAST_SCORE = 0.4
LEAST_WORDS = 8
#: A score of so many words, copied verbatim, counts whatever the item's length.
LONG_WORDS = 50
#: Bytes that a word of a test item takes in the lookups of a task, with room to spare.
_WORD_BYTES = 64

#: More than the words of any alignment.
_UNIT = 1 << 31

FOUND_SCHEMA = "doc bigint, tag bigint, item bigint, score double, matched int, begin int, end int"


def _row(above: np.ndarray, passage: np.ndarray, word: np.uint64, steps: np.ndarray, local: bool) -> np.ndarray:
    """Next row of the alignment table.  A cell is its score times ``_UNIT`` plus the words that match, so that of equal
    scores the one with more matches counts; local cells without a score are 0."""
    row = above + GAP * _UNIT
    row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, MATCH * _UNIT + 1, MISMATCH * _UNIT))
    if local:
        row = np.where(row < _UNIT, 0, row)
    row = np.maximum.accumulate(row + steps) - steps  # gaps along the row: the best earlier cell less one for each step
    return np.where(row < _UNIT, 0, row) if local else row


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two word sequences: (score, matched words, begin and end in ``passage``).

    Two rows of the table are held at a time, so memory grows with the passage alone; a second pass runs backwards from
    the end to find where the alignment begins.
    """
    steps = np.arange(len(passage) + 1) * (-GAP * _UNIT)
    row, best, last, end = np.zeros(len(passage) + 1, dtype=np.int64), 0, 0, 0
    for i, word in enumerate(item, 1):
        row = _row(row, passage, word, steps, True)
        at = int(row.argmax())
        if row[at] > best:
            best, last, end = int(row[at]), i, at
    if not best:
        return 0, 0, 0, 0
    back, row, begin = passage[:end][::-1], -steps[: end + 1].copy(), end
    for word in item[:last][::-1]:
        row = _row(row, back, word, steps[: end + 1], False)
        at = int(row.argmax())
        if row[at] >= best:
            begin = end - at
            break
    return best // _UNIT, best % _UNIT, begin, end


def _sequences(column: pa.Array, keyed: textcols.Prints) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in textcols.slices(column):
        found = textcols.words(data, offsets, keyed, lower=True, separators=textcols.NOT_WORD)
        out += [found.code[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    return out


def _joined(starts: list[int], before: int, after: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Windows around ``starts``, overlapping ones joined, so that no alignment is cut that one of them holds."""
    begin = end = None
    for start in starts:
        lo, hi = max(first, start - before), min(last, start + after)
        if begin is not None and lo > end:
            yield begin, end
            begin = None
        begin, end = lo if begin is None else begin, hi
    if begin is not None:
        yield begin, end


class Filter:
    """Fixed-size bit filter over 64-bit prints: says quickly that a print is in no test item."""

    def __init__(self, prints: np.ndarray):
        self.bits = max(16, int(8 * max(1, len(prints))).bit_length())
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[(prints >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def maybe(self, prints: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.table[(prints >> np.uint64(64 - self.bits)).astype(np.int64)])


def _word_counts(vocabulary, keyed: textcols.Prints):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        quick = Filter(known)
        n, docs, words = np.zeros(len(known) + 1, dtype=np.int64), 0, 0
        for batch in batches:
            for a, b, data, offsets in textcols.slices(batch.column(0)):
                codes = textcols.words(data, offsets, keyed, lower=True, separators=textcols.NOT_WORD).code
                docs, words = docs + b - a, words + len(codes)
                codes = codes[quick.maybe(codes)]
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                n += np.bincount(np.where(known[at] == codes, at, len(known)), minlength=len(n))
        at = np.flatnonzero(n[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, [-1, -2]).astype(np.int32)), pa.array(np.append(n[at], [words, docs]))], names=["word", "n"]
        )

    return count


def _found(lookups, keyed: textcols.Prints, seed: int, least_score: float, least_words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, owner, place, items, ids = lookups.value
        quick = Filter(prints)
        for batch in batches:
            for a, _, data, offsets in textcols.slices(batch.column(2)):
                found = textcols.words(data, offsets, keyed, lower=True, separators=textcols.NOT_WORD)
                grams = keyed.grams(found.code, seed)
                at = quick.maybe(grams)
                lo = np.searchsorted(prints, grams[at], side="left")
                hi = np.searchsorted(prints, grams[at], side="right")
                at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
                row = found.row[at]
                inside = found.row[np.minimum(at + seed - 1, len(found.row) - 1)] == row
                at, lo, hi, row = at[inside], lo[inside], hi[inside], row[inside]
                wanted: dict[tuple[int, int], set[int]] = {}
                for word, x, y, r in zip(at.tolist(), lo.tolist(), hi.tolist(), row.tolist(), strict=True):
                    for s in range(x, y):
                        wanted.setdefault((r, int(owner[s])), set()).add(word - int(place[s]))
                out = {k: [] for k in ("row", "item", "score", "matched", "begin", "end")}
                for (r, own), starts in wanted.items():
                    item = items[own]
                    slack = len(item) // 2 + 8
                    first, last = int(found.first[r]), int(found.first[r + 1])
                    best = (0, 0, 0, 0)
                    for begin, end in _joined(sorted(starts), slack, len(item) + slack, first, last):
                        score, matched, x, y = align(item, found.code[begin:end])
                        best = max(best, (score, matched, begin + x - first, begin + y - first))
                    share = best[0] / (MATCH * len(item))
                    if _is_copy(best[0], best[1], len(item), least_score, least_words):
                        for k, v in zip(out, (r + a, ids[own], share, best[1], best[2], best[3]), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(pa.array(out["row"], pa.int64())) for i in (0, 1)),
                        pa.array(out["item"], pa.int64()),
                        pa.array(out["score"], pa.float64()),
                        *(pa.array(out[k], pa.int32()) for k in ("matched", "begin", "end")),
                    ],
                    names=["doc", "tag", "item", "score", "matched", "begin", "end"],
                )

    return find


def _is_copy(score: int, matched: int, words: int, least_score: float, least_words: int) -> bool:
    """Whether an alignment tells a copy: a share of the item, or a long part of it; a short item must be there word by word."""
    if words < least_words:
        return score == MATCH * words
    return (score >= least_score * MATCH * words and matched >= least_words) or score >= MATCH * LONG_WORDS


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    seed: int = SEED,
    rare: float = RARE,
    least_score: float = LEAST_SCORE,
    least_words: int = LEAST_WORDS,
    shard_bytes: int = BROADCAST_LIMIT,
) -> DataFrame:
    """One row for each row of ``docs`` and test item that it holds a copy of, whole, in part or edited.

    A copy has ``least_score`` of the score of a whole one and ``least_words`` words that match, or a score worth
    ``LONG_WORDS`` verbatim words.  Items of ``seed`` words up to ``least_words`` count where all their words stand in a row.

    Columns: ``doc_id``, ``item_id``, ``score`` (share of a whole copy's alignment score), ``matched`` words and the
    range ``begin_word``, ``end_word`` of the document's words, and ``text_hash``, which tells rows of one id apart.  Words are lower-cased runs without ASCII space or
    punctuation.  Null and empty texts hold nothing; items with fewer than ``seed`` words are looked for nowhere, as
    they are too short to tell a copy from chance.  Repeated documents and items give repeated rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    keyed = textcols.Prints(textcols.draw_seed())
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), text_tag(F.col(text_col).cast("string")).alias("tag"), F.lower(F.col(text_col).cast("string")).alias("text"))
    tests = benchmark.select(F.col(item_id_col).cast("bigint").alias("item"), F.lower(F.col(item_text_col).cast("string")).alias("text")).where("text is not null")
    size = tests.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    shards = max(1, -(-size * _WORD_BYTES // shard_bytes))
    found = None
    for shard in range(shards):
        some = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard).toArrow()
        items = _sequences(some.column("text"), keyed) if some.num_rows else []
        ids = some.column("item").to_pylist()
        usable = [i for i, codes in enumerate(items) if len(codes) >= seed]
        items, ids = [items[i] for i in usable], [ids[i] for i in usable]
        if not items:
            continue
        words = np.unique(np.concatenate(items))
        check_broadcast(len(words) * 8, "the test items' words")
        counted = source.select("text").mapInArrow(_word_counts(spark.sparkContext.broadcast(words), keyed), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        n = dict(zip(counted.column("word").to_pylist(), counted.column("n").to_pylist(), strict=True))
        total, per_doc = max(1, n.get(-1, 0)), max(1.0, n.get(-1, 0) / max(1, n.get(-2, 1)))
        log_p = np.log([max(1, n.get(i, 0)) / total for i in range(len(words))])
        prints, owner, place = [], [], []
        for own, codes in enumerate(items):
            meets = np.convolve(log_p[np.searchsorted(words, codes)], np.ones(seed), "valid") + np.log(per_doc)
            rank = np.argsort(np.argsort(meets, kind="stable"), kind="stable")
            keep = np.flatnonzero((meets <= np.log(rare)) | (rank < LEAST_SEEDS))
            prints.append(keyed.grams(codes, seed)[keep])
            owner.append(np.full(len(keep), own))
            place.append(keep)
        prints, owner, place = np.concatenate(prints), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(prints, kind="stable")
        check_broadcast(24 * len(prints) + sum(x.nbytes for x in items), "a shard of test items")
        lookups = spark.sparkContext.broadcast((prints[order], owner[order], place[order], items, ids))
        part = source.mapInArrow(_found(lookups, keyed, seed, least_score, least_words), FOUND_SCHEMA)
        part = scratch.keep(part, f"found-{shard}") if shards > 1 else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND_SCHEMA)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col), "score", "matched", F.col("begin").alias("begin_word"), F.col("end").alias("end_word"), F.col("tag").alias("text_hash"))
