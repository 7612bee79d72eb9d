"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

*Folding* lower-cases, removes accents and maps look-alike letters and digit substitutions to one letter, so ``1d10t``
and a word with Cyrillic letters meet the plain word.  The *lexicon* is learned from a bounded sample of labelled rows:
whole words and word beginnings that are much more frequent in toxic documents, each weighted by its log odds.
*Exception phrases* are pairs of words with a lexicon word that occur in clean documents only; a match inside one
doesn't count.  A document's *score* is a logistic function of its matches: whether there are any, their summed
weight, and the sum normalised by the document's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import SHARES, Scratch, check_broadcast

#: Labelled rows used for learning, at most (about; rows are chosen by hash).
SAMPLE_ROWS = 24_000
#: A term must be in so many toxic documents, and so many times likelier there.
LEAST_DOCS, LEAST_RATIO = 3, 12.0
PREFIXES = (4, 5, 6, 7, 8)

# Letters of other alphabets and digits that look like Latin letters.
LOOK_ALIKES = {
    "a": "àáâãäåāăąαаɑ@4", "b": "ьЬвβ8", "c": "çćčсϲ", "d": "ďđԁ", "e": "èéêëēęěеёεє3", "g": "ğģɡ9", "h": "һн", "i": "ìíîïīįıіїι1l|",
    "k": "ķкκ", "m": "м", "n": "ñńňη", "o": "òóôõöøōőоοσ0", "p": "рρ", "r": "ŕřг", "s": "śşšѕ5$", "t": "ťţтτ7+", "u": "ùúûüūůűυц", "v": "νѵ", "w": "ŵωѡ",
    "x": "хχ", "y": "ýÿуγ", "z": "źżžʐ2",
}


def fold(text: Column) -> Column:
    """Folded text: one letter for each class of look-alikes, single spaces, no other signs."""
    source = "".join(LOOK_ALIKES.values())
    target = "".join(k * len(v) for k, v in LOOK_ALIKES.items())
    folded = F.translate(F.lower(text), source, target)
    # combining accents and zero-width signs vanish; other signs end a word
    return F.regexp_replace(F.regexp_replace(folded, "[\\u0300-\\u036f\\u200b-\\u200d\\ufeff\\u00ad]+", ""), r"[^\p{L}]+", " ")


@dataclass
class Lexicon:
    """Terms begin with a space, and end with one where they are whole words; exceptions are phrases with both."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    #: Bias, and weights of: any match, log of one plus the sum, sum by root of the length.
    logistic: np.ndarray = field(default_factory=lambda: np.array([-4.0, 2.0, 1.0, 1.0]))

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.logistic[1:] + self.logistic[0], -30, 30)))

    def n_bytes(self) -> int:
        return 200 * (len(self.terms) + len(self.exceptions)) + 4 * sum(map(len, [*self.terms, *self.exceptions]))


def matched(automaton: ahocorasick.Automaton | None, folded: str | None) -> tuple[float, int]:
    """Summed weight of the matches of ``folded`` outside exception phrases, and their number; longest terms first."""
    if automaton is None or not folded:
        return 0.0, 0
    hits, shields = {}, []
    for end, (length, weight) in automaton.iter(f" {folded} "):
        begin = end - length + 1
        if weight is None:
            shields.append((begin, end))
        elif begin not in hits or hits[begin][0] < end:
            hits[begin] = (end, weight)
    kept = [w for b, (e, w) in hits.items() if not any(x <= b and e <= y for x, y in shields)] if shields else [w for _, w in hits.values()]
    return sum(kept), len(kept)


def _features(automaton, folded: list[str | None]) -> np.ndarray:
    out = np.zeros((len(folded), 3))
    for row, text in enumerate(folded):
        total, n = matched(automaton, text)
        if n:
            out[row] = 1.0, np.log1p(total), total / np.sqrt(1 + text.count(" "))
    return out


def _terms(text: str) -> set[str]:
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each label hold each term, for a batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term in _terms(text):
                counts.setdefault(term, [0, 0])[label] += 1
        yield _counts(counts, "term")


def _counts(counts: dict[str, list[int]], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), *(pa.array([x[i] for x in counts.values()], pa.int64()) for i in (0, 1))], names=[name, "clean", "toxic"]
    )


def _phrase_rows(lexicon):
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = lexicon.value
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                found = set()
                for i, word in enumerate(words):
                    if f" {word} " in terms or any(f" {word[:n]}" in terms for n in PREFIXES):
                        found |= {f" {' '.join(words[max(0, i - 1) : i + 1])} ", f" {' '.join(words[i : i + 2])} "}
                for phrase in found:
                    counts.setdefault(phrase, [0, 0])[label] += 1
            yield _counts(counts, "phrase")

    return phrases


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a little shrinkage."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return w


def _feature_rows(lexicon):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.value.automaton()
        for batch in batches:
            x = _features(automaton, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), batch.column(1)], names=["x0", "x1", "x2", "label"])

    return features


def _bounded(entries: DataFrame, text: str, what: str) -> list:
    """All entries, which a bounded sample bounds; refused where they could not be broadcast."""
    entries = entries.orderBy(text)
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).first()
    check_broadcast(200 * size["n"] + 4 * size["chars"], what)
    return entries.collect()


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns from about ``sample_rows`` rows, chosen by the text's hash, of those with a text and a label of 0 or 1.

    ``exceptions`` are further phrases, folded like the texts, in which no term counts.  Without labels of both kinds the lexicon is empty.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = labelled.select(F.col(text_col).cast("string").alias("raw"), F.col(label_col).cast("int").alias("label")).where("raw is not null and label in (0, 1)")
    size = rows.count()
    if size > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("raw"), F.lit(SHARES)) < max(1, SHARES * sample_rows // size))
    rows = scratch.keep(rows.select(fold(F.col("raw")).alias("text"), "label"), "rows")
    by_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    clean, toxic = by_label.get(0, 0), by_label.get(1, 0)
    lexicon = Lexicon()
    if not clean or not toxic:
        return lexicon
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    counts = rows.mapInArrow(_term_rows, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counts.withColumn("weight", odds).where((F.col("toxic") >= LEAST_DOCS) & (F.col("weight") >= float(np.log(LEAST_RATIO))))
    taken = _bounded(best.select("term", "weight"), "term", "the lexicon")
    terms = {r["term"]: r["weight"] for r in taken}
    seen = rows.mapInArrow(_phrase_rows(spark.sparkContext.broadcast(set(terms))), "phrase string, clean bigint, toxic bigint").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    harmless = _bounded(seen.where((F.col("clean") >= LEAST_DOCS) & (F.col("toxic") == 0)).select("phrase"), "phrase", "the exceptions")
    given = spark.createDataFrame([(x,) for x in exceptions], "phrase string").select(F.trim(fold(F.col("phrase"))).alias("phrase")).where("phrase <> ''").collect()
    lexicon = Lexicon(terms, {r["phrase"] for r in harmless} | {f" {r['phrase']} " for r in given})
    check_broadcast(lexicon.n_bytes(), "the lexicon")
    points = rows.mapInArrow(_feature_rows(spark.sparkContext.broadcast(lexicon)), "x0 double, x1 double, x2 double, label int").groupBy("x0", "x1", "x2", "label").count().toArrow()
    x = np.column_stack([points.column(i).to_numpy() for i in range(3)])
    n = points.column("count").to_numpy()
    lexicon.logistic = _logistic(np.repeat(x, n, axis=0), np.repeat(points.column("label").to_numpy(), n))
    return lexicon


def _scored(lexicon):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = lexicon.value
        automaton = own.automaton()
        for batch in batches:
            x = _features(automaton, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(x)), pa.array((x[:, 0] > 0).astype(bool))], names=["doc", "score", "matched"])

    return score


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``score`` (0 to 1) and ``matched`` (whether any term counted).

    Null and empty texts match nothing and get the score of a text without matches.  Repeated rows get equal results.
    Other columns are not read, whatever their names.
    """
    check_broadcast(lexicon.n_bytes(), "the lexicon")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), fold(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    return source.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(lexicon)), "doc bigint, score double, matched boolean").withColumnRenamed("doc", id_col)
