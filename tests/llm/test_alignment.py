"""Benchmark decontamination against an alignment of all pairs."""

from __future__ import annotations

import random

import numpy as np

from siftline.llm import decontamination as leaks


def aligned(item: list[str], passage: list[str]) -> int:
    """Best Smith-Waterman score, cell by cell."""
    above, best = [0] * (len(passage) + 1), 0
    for word in item:
        row = [0]
        for j, other in enumerate(passage, 1):
            step = leaks.MATCH if word == other else leaks.MISMATCH
            row.append(max(0, above[j - 1] + step, above[j] + leaks.GAP, row[j - 1] + leaks.GAP))
        above, best = row, max(best, *row)
    return best


def corpus(random_: random.Random) -> tuple[list[tuple], list[tuple]]:
    word = lambda: f"w{random_.randrange(400)}"
    items = [[word() for _ in range(random_.choice([9, 20, 40]))] for _ in range(8)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(random_.randrange(120))]
        if i % 3 == 0:
            copy = list(items[i % len(items)])
            for at in reversed(range(3, len(copy), 6)):  # edits that leave runs of five words
                kind = random_.randrange(3)
                copy[at : at + 1] = [[], [word()], [copy[at], word()]][kind]
            if i % 2 == 0:
                copy = copy[: len(copy) * 2 // 3]
            at = random_.randrange(len(text) + 1)
            text[at:at] = copy
        docs.append((i, " ".join(text)))
    return [*docs, (60, None), (61, ""), (None, " ".join(items[0])), (0, docs[0][1])], [(i, " ".join(x)) for i, x in enumerate(items)]


def test_agrees_with_alignment_of_all_pairs(spark):
    docs, items = corpus(random.Random(5))
    rows = spark.createDataFrame([(*d, "clash", 1.0) for d in docs], "doc_id bigint, text string, item_id string, score double")
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    found = leaks.contaminated(rows, tests).collect()
    wanted, unsure = [], []
    for doc, text in docs:
        for item, words in items:
            words = words.split()
            score = aligned(words, (text or "").split())
            if score >= leaks.LEAST_SCORE * leaks.MATCH * len(words):
                # with a lower score, fewer words may match than the operator asks for
                sure = score >= leaks.MATCH * leaks.LEAST_WORDS
                (wanted if sure else unsure).append((doc, item, round(score / (leaks.MATCH * len(words)), 9)))
    got = [(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in found]
    assert len(wanted) > 15 and sorted((g for g in got if g not in unsure), key=str) == sorted(wanted, key=str)


def test_parts_of_long_items_and_whole_short_ones(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(5000)}"
    long, short = [word() for _ in range(200)], [word() for _ in range(6)]
    pad = lambda n: [word() for _ in range(n)]
    texts = [
        [*pad(300), *long[60:130], *pad(300)],  # 70 verbatim words of 200
        [*pad(20), *short, *pad(20)],
        [*pad(20), *short[:3], "x", *short[3:], *pad(20)],
        [*pad(20), *short[:5], *pad(20)],
        [*pad(20), *long[60:100], *pad(20)],  # 40 of them
        pad(2000),
    ]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, "two words")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): (r["matched"], r["begin_word"], r["end_word"]) for r in leaks.contaminated(docs, items).collect()}
    assert found == {(0, 1): (70, 300, 370), (1, 2): (6, 20, 26)}


def test_alignment_in_two_rows():
    rng = random.Random(4)
    for _ in range(200):
        item, passage = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        score, matched, begin, end = leaks.align(np.array(item, np.uint64), np.array(passage, np.uint64))
        assert score == aligned(item, passage)
        # the part that it names has that score alone, and matches make up for it
        assert score == aligned(item, passage[begin:end]) and 2 * matched >= score and matched <= end - begin


def test_tables_without_rows(spark):
    docs, items = (spark.createDataFrame([], f"{n}_id bigint, text string") for n in ("doc", "item"))
    full = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id bigint, text string")
    assert leaks.contaminated(docs, full.withColumnRenamed("doc_id", "item_id")).count() == 0 and leaks.contaminated(full, items).count() == 0
