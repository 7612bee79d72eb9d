"""Document quality by a linear-chain conditional random field over lines.

Every non-blank line gets features of its own and of the lines before and after it.  The field labels lines good or
bad; it is fitted by gradient ascent on a bounded sample of labelled documents whose lines take the document's label.
Forward-backward marginals, weighted by the lines' lengths, are a document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols
from .work import SHARES, Scratch

#: Labelled rows used for fitting, at most (about; rows are chosen by hash).
SAMPLE_ROWS = 3_000
STEPS = 150
#: Lines of the sample that fitting takes, at most (whole documents, chosen by hash whatever their length).
SAMPLE_LINES = 200_000
OWN = 11
#: Own, before and after, and a constant.
WIDTH = 3 * OWN + 1

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 small or non-ASCII letter, 2 capital, 3 digit, 4 sentence sign, 5 other sign, 0 space
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 1 if _i >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 0 if _c.isspace() or _i < 32 else 4 if _c in ".,;:?'\"-()" else 5
_KINDS = np.stack([_CLASS == k for k in range(1, 6)]).astype(np.int64)


@dataclass
class Lines:
    """Non-blank lines of a slice: features, bytes, and the row of each."""

    own: np.ndarray
    size: np.ndarray
    row: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray, keyed: textcols.Prints) -> Lines:
    newline = data == 10
    begin = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(newline) + 1]))
    begin = begin[begin < len(data)]
    if not len(begin):
        return Lines(np.zeros((0, OWN)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = np.searchsorted(offsets, begin, side="right") - 1
    found = textcols.words(data, offsets, keyed, lower=True)
    line = np.searchsorted(begin, found.start, side="right") - 1
    n_words = np.bincount(line, minlength=len(begin))
    kinds = np.stack([np.add.reduceat(kind[data], begin) for kind in _KINDS], 1)
    size = kinds.sum(1)
    # words that occurred before in the same line, and words equal to the one before
    order = np.lexsort((found.code, line))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (found.code[order][1:] == found.code[order][:-1]) & (line[order][1:] == line[order][:-1])
    repeated = np.bincount(line[order][again], minlength=len(begin))
    stutter = np.zeros(len(line), dtype=bool)
    stutter[1:] = (found.code[1:] == found.code[:-1]) & (line[1:] == line[:-1])
    stutters = np.bincount(line[stutter], minlength=len(begin))
    # lines that occurred before in the same document
    first_word = np.searchsorted(line, np.arange(len(begin)))
    last_word = np.searchsorted(line, np.arange(len(begin)), side="right")
    body = keyed.ranges(found.code.view(np.uint8), 8 * first_word, 8 * last_word)
    order = np.lexsort((body, row))
    twice = np.zeros(len(begin), dtype=bool)
    twice[order[1:]] = (body[order][1:] == body[order][:-1]) & (row[order][1:] == row[order][:-1])
    words = np.maximum(n_words, 1)
    per = kinds / np.maximum(size, 1)[:, None]
    own = np.column_stack([np.log1p(n_words) / 3, size / words / 10, per[:, 1], per[:, 2] * 2, per[:, 3] * 4, per[:, 4] * 4, repeated / words, stutters / words, twice, kinds[:, 4] > 0.5 * words, n_words <= 2])
    some = n_words > 0
    return Lines(own[some].astype(np.float64), size[some], row[some])


def features(lines: Lines) -> np.ndarray:
    """Each line's features with those of its neighbours in the document (zero where there is none), and a constant."""
    out = np.zeros((len(lines.row), WIDTH))
    out[:, :OWN] = lines.own
    same = lines.row[1:] == lines.row[:-1]
    out[1:, OWN : 2 * OWN] = lines.own[:-1] * same[:, None]
    out[:-1, 2 * OWN : 3 * OWN] = lines.own[1:] * same[:, None]
    out[:, -1] = 1
    return out


@dataclass
class Field:
    """Weights of the features for good over bad, and the worth of each change of label."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    change: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    prior: float = 0.5
    #: Slope and offset that turn a document's length-weighted log odds into its score.
    scale: tuple[float, float] = (1.0, 0.0)


def _chain(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First line and number of lines of each document, and the documents with more than k lines for each k."""
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    n = np.diff(np.append(begin, len(row)))
    order = np.argsort(-n, kind="stable")
    begin, n = begin[order], n[order]
    longer = [np.arange(np.searchsorted(-n, -k, side="left")) for k in range(int(n[0]))]
    return begin, n, longer


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def marginals(row: np.ndarray, score: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: P(good) of each line, expected changes, log normaliser of each document."""
    begin, n, longer = _chain(row)
    unary = np.column_stack([np.zeros(len(score)), score])
    ahead, back = unary.copy(), np.zeros_like(unary)
    for k in range(1, len(longer)):
        at = begin[longer[k]] + k
        ahead[at] = unary[at] + _sum(ahead[at - 1][:, :, None] + change, 1)
    pairs = np.zeros((2, 2))
    last = begin + n - 1
    z_doc = _sum(ahead[last], 1)
    for k in range(len(longer) - 1, 0, -1):
        at = begin[longer[k]] + k
        step = change + (unary[at] + back[at])[:, None, :]
        back[at - 1] = _sum(step, 2)
        pairs += np.exp(ahead[at - 1][:, :, None] + step - z_doc[longer[k]][:, None, None]).sum(0)
    both = ahead + back
    return np.exp(both[:, 1] - _sum(both, 1)), pairs, z_doc


def _weighted(lines: Lines, good: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted mean of the lines' log odds for each row, and whether it has lines."""
    size = np.bincount(lines.row, weights=lines.size, minlength=rows)
    odds = np.log(np.clip(good, 1e-9, 1)) - np.log(np.clip(1 - good, 1e-9, 1))
    mean = np.bincount(lines.row, weights=odds * lines.size, minlength=rows) / np.maximum(size, 1)
    return mean, size > 0


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the sample's documents: (doc, label, sizes and features of all lines as bytes)."""
    keyed = textcols.Prints(textcols.draw_seed())
    for batch in batches:
        for a, b, data, offsets in textcols.slices(batch.column(0)):
            lines = lines_of(data, offsets, keyed)
            x = features(lines).astype(np.float32)
            cut = np.searchsorted(lines.row, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(a, b - a),
                    pa.array([lines.size[lo:hi].astype(np.int64).tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([x[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ],
                names=["label", "sizes", "x"],
            )


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, steps: int = STEPS, prior: float | None = None) -> Field:
    """Fits on about ``sample_rows`` rows, chosen by the text's hash, of those with a text and a label of 0 or 1.

    Documents of the sample are taken in the order of a hash as long as ``SAMPLE_LINES`` hold them; without
    labels of both kinds every document gets the share of good labels as its score.  ``prior`` is that share where
    ``labelled`` was sampled by label; by default it is counted over ``labelled``.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "quality")
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")).where("text is not null and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(sizes.values())
    if prior is None:
        prior = sizes.get(1, 0) / total if total else 0.5
    out = Field(prior=prior)
    if len(sizes) < 2:
        return out
    share = F.when(F.col("label") == 1, min(SHARES, SHARES * sample_rows // 2 // sizes[1] + 1)).otherwise(min(SHARES, SHARES * sample_rows // 2 // sizes[0] + 1))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SHARES)) < share)
    kept = scratch.keep(sample.mapInArrow(_line_rows, "label int, sizes binary, x binary"), "lines")
    counted = kept.select(F.xxhash64("sizes", "x").alias("at"), (F.length("sizes") / 8).cast("bigint").alias("lines")).orderBy("at").limit(2 * sample_rows)
    taken, filled = [], 0
    for r in counted.collect():  # two numbers for each document of the bounded sample
        if r["lines"] and filled + r["lines"] <= SAMPLE_LINES:
            taken, filled = [*taken, r["at"]], filled + r["lines"]
    numbered = kept.withColumn("at", F.xxhash64("sizes", "x")).where(F.col("at").isin(taken)).orderBy("at").limit(2 * sample_rows)
    x_parts, label_of, size_parts, n_lines = [], [], [], 0
    for r in numbered.toLocalIterator():
        n_lines += len(r["sizes"]) // 8
        if n_lines > SAMPLE_LINES:  # equal documents share a hash
            break
        x_parts.append(np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH))
        size_parts.append(np.frombuffer(r["sizes"], np.int64))
        label_of.append(r["label"])
    if not x_parts:
        return out
    x = np.concatenate(x_parts).astype(np.float64)
    row = np.repeat(np.arange(len(x_parts)), [len(p) for p in x_parts])
    label = np.array(label_of)
    y = label[row]
    follow = row[1:] == row[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][follow], y[1:][follow]), 1)
    weight, change = np.zeros(WIDTH), np.zeros((2, 2))
    # each document counts once, whatever its number of lines: steps are scaled by lines
    moment, speed = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, steps + 1):
        good, pairs, _ = marginals(row, x @ weight, change)
        slope = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(label) - 0.002 * np.concatenate([weight, change.ravel()])
        moment, speed = 0.9 * moment + 0.1 * slope, 0.99 * speed + 0.01 * slope**2
        move = 0.15 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
        weight, change = weight + move[:WIDTH], np.clip(change + move[WIDTH:].reshape(2, 2), -3, 3)
    out.weight, out.change = weight, change
    good, _, _ = marginals(row, x @ weight, change)
    mean, _ = _weighted(Lines(x[:, :OWN], np.concatenate(size_parts), row), good, len(label))
    out.scale = _calibrated(mean, label, out.prior)
    return out


def _calibrated(mean: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic slope and offset for the sample's documents, weighted to the labels' shares."""
    balance = np.where(label == 1, prior / max(label.mean(), 1e-9), (1 - prior) / max(1 - label.mean(), 1e-9))
    x = np.column_stack([mean / 10, np.ones(len(mean))])
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (balance * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w += np.linalg.solve(hessian, x.T @ (balance * (label - p)) - 0.1 * w)
    return float(w[0]) / 10, float(w[1])


def _scored(field_):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Field = field_.value
        keyed = textcols.Prints(textcols.draw_seed())
        for batch in batches:
            for a, b, data, offsets in textcols.slices(batch.column(1)):
                lines = lines_of(data, offsets, keyed)
                out = np.full(b - a, own.prior)
                bad = np.zeros(b - a, dtype=np.int64)
                if len(lines.row):
                    good, _, _ = marginals(lines.row, features(lines) @ own.weight, own.change)
                    mean, some = _weighted(lines, good, b - a)
                    if own.weight.any():
                        out[some] = 1 / (1 + np.exp(-np.clip(own.scale[0] * mean + own.scale[1], -30, 30)))[some]
                    bad = np.bincount(lines.row, weights=good < 0.5, minlength=b - a).astype(np.int64)
                n = np.bincount(lines.row, minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out), pa.array(n), pa.array(bad)], names=["doc", "score", "n_lines", "n_bad_lines"])

    return score


def score_quality(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``score`` (0 to 1, higher is better), ``n_lines`` and ``n_bad_lines`` of its lines.

    Lines end at newlines; blank lines don't count.  Null, empty and blank texts get the share of good labels that was
    learned.  Repeated rows get equal results.  Other columns are not read, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc bigint, score double, n_lines bigint, n_bad_lines bigint").withColumnRenamed("doc", id_col)
