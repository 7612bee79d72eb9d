"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary.  For each language, piece probabilities are fitted by expectation
maximisation: expected counts of the pieces over all segmentations of the words of a bounded sample of labelled texts.
A word's probability in a language is the sum over all its segmentations, by the forward algorithm; a text's is the
product over its words, because pieces never cross words.  So each distinct word of a task is summed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from . import textcols
from .work import BROADCAST_LIMIT, SHARES, Scratch, check_broadcast

UNDETERMINED = "und"
#: Labelled rows used for fitting, at most (about; rows are chosen by hash).
SAMPLE_ROWS = 12_000
ROUNDS = 3
#: Probability of a single byte that no piece covers.
BYTE = 1e-6
#: Sums of a word in a language that a task keeps.
KEPT_SUMS = 4_000_000
_AT_ONCE = 16_384
_SUMS_AT_ONCE = 1 << 19
_BYTES_AT_ONCE = 400_000
#: After so many bytes the sums are scaled, so that long words don't vanish.
_SCALED = 16


@dataclass
class Pieces:
    """Fingerprints of the vocabulary's pieces, sorted; a piece that begins a word begins with a space."""

    prints: np.ndarray
    longest: int
    keyed: textcols.Prints

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = set()
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                texts.add(model.id_to_piece(i).replace("▁", " ").lower().encode())
        return cls.of([x for x in texts if x])

    @classmethod
    def of(cls, texts: list[bytes]) -> Pieces:
        keyed = textcols.Prints(textcols.draw_seed())
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        prints = keyed.ranges(data, ends - [len(x) for x in texts], ends)
        return cls(np.unique(prints), max(map(len, texts)), keyed)


class Lattice:
    """All pieces inside a block of words, longest word first: groups of hits of one end and length in a word."""

    def __init__(self, pieces: Pieces, data: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.order = np.argsort(-length, kind="stable")
        begin, length = begin[self.order], length[self.order]
        self.n, self.length, self.longest = len(begin), length, pieces.longest
        top = int(length.max(initial=0))
        self.alive = np.searchsorted(-length, -np.arange(top + 2), side="right")
        quick = np.zeros(1 << 18, dtype=bool)
        quick[(pieces.prints >> np.uint64(46)).astype(np.int64)] = True
        word = np.repeat(np.arange(self.n), length)
        place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
        at = begin[word] + place
        room = length[word] - place
        hits = []
        for size in range(1, pieces.longest + 1):
            fits = np.flatnonzero(room >= size)
            if not len(fits):
                break
            prints = pieces.keyed.ranges(data, at[fits], at[fits] + size)
            some = quick[(prints >> np.uint64(46)).astype(np.int64)]
            fits, prints = fits[some], prints[some]
            number = np.minimum(np.searchsorted(pieces.prints, prints), len(pieces.prints) - 1)
            true = pieces.prints[number] == prints
            fits, number = fits[true], number[true]
            hits.append((place[fits] + size, np.full(len(fits), size), word[fits], number))
        end, size, self.word, self.number = (np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, np.int64) for i in range(4))
        order = np.lexsort((self.word, size, end))
        end, size, self.word, self.number = end[order], size[order], self.word[order], self.number[order]
        new = np.flatnonzero(np.append(True, (end[1:] != end[:-1]) | (size[1:] != size[:-1]))) if len(end) else np.zeros(0, np.int64)
        cuts = np.append(new, len(end)).tolist()
        self.groups: list[list[tuple[int, int, int]]] = [[] for _ in range(top + 1)]
        for j, own, lo, hi in zip(end[new].tolist(), size[new].tolist(), cuts[:-1], cuts[1:], strict=True):
            self.groups[j].append((own, lo, hi))

    def totals(self, p: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of each word in each language, in the words' given order."""
        ring = np.zeros((self.longest + 1, self.n, p.shape[1]))
        ring[0] = 1
        scale = np.zeros((self.n, p.shape[1]))
        out = np.zeros((self.n, p.shape[1]))
        for j in range(1, len(self.groups)):
            alive = int(self.alive[j])
            now = ring[j % len(ring), :alive]
            np.multiply(ring[(j - 1) % len(ring), :alive], BYTE, out=now)
            for size, lo, hi in self.groups[j]:
                word = self.word[lo:hi]
                now[word] += ring[(j - size) % len(ring), word] * p[self.number[lo:hi]]
            ended = int(self.alive[j + 1])
            out[ended:alive] = np.log(now[ended:]) + scale[ended:alive]
            if j % _SCALED == 0 and ended:
                by = now[:ended].copy()
                scale[:ended] += np.log(by)
                ring[:, :ended] /= by
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def expected(self, p: np.ndarray, language: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces by language, over all segmentations of each word in its one language.

        Sums are kept as logarithms, and only up to the end of each word, so words of any length are summed whole.
        """
        language, weight = language[self.order], weight[self.order]
        with np.errstate(divide="ignore"):
            log_p = np.log(p)
        byte = np.log(BYTE)
        ahead = [np.zeros(self.n)]
        for j in range(1, len(self.groups)):
            ahead.append(ahead[-1][: self.alive[j]] + byte)
            for size, lo, hi in self.groups[j]:
                word = self.word[lo:hi]
                ahead[j][word] = np.logaddexp(ahead[j][word], ahead[j - size][word] + log_p[self.number[lo:hi], language[word]])
        back = [np.full(len(x), -np.inf) for x in ahead]
        whole = np.empty(self.n)
        for j, sums in enumerate(back):
            ended = slice(self.alive[j + 1], self.alive[j])
            sums[ended], whole[ended] = 0, ahead[j][ended]
        counts = np.zeros_like(p)
        for j in range(len(self.groups) - 1, 0, -1):
            for size, lo, hi in self.groups[j]:
                word, number = self.word[lo:hi], self.number[lo:hi]
                part = back[j][word] + log_p[number, language[word]]
                np.add.at(counts, (number, language[word]), weight[word] * np.exp(ahead[j - size][word] + part - whole[word]))
                back[j - size][word] = np.logaddexp(back[j - size][word], part)
            alive = self.alive[j]
            back[j - 1][:alive] = np.logaddexp(back[j - 1][:alive], back[j] + byte)
        return counts


def _blocks(pieces: Pieces, raw: bytes, begin: np.ndarray, end: np.ndarray, columns: int = 1) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices of words of ``raw``, each with a space before it, and the words' numbers; fewer words with more ``columns``."""
    joined = b"".join(b" " + raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True))
    data = np.frombuffer(joined, np.uint8)
    length = end - begin + 1
    start = np.cumsum(length) - length
    by_length = np.argsort(length, kind="stable")
    filled = np.cumsum(length[by_length])
    most = max(1, min(_AT_ONCE, _SUMS_AT_ONCE // max(1, columns)))
    lo = 0
    while lo < len(begin):
        done = int(filled[lo - 1]) if lo else 0
        hi = min(lo + most, max(lo + 1, int(np.searchsorted(filled, done + _BYTES_AT_ONCE, side="right"))))
        own = by_length[lo:hi]
        yield own, Lattice(pieces, data, start[own], length[own])
        lo = hi


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray  # piece, language

    def words(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(begin), len(self.languages)))
        for word, lattice in _blocks(self.pieces, raw, begin, end, len(self.languages)):
            out[word] = lattice.totals(self.p)
        return out

    def shards(self, at_once: int | None = None) -> list[Model]:
        """The model by languages, ``at_once`` in each shard; by default as many as may be broadcast."""
        at_once = at_once or _languages_at_once(self.pieces)
        cuts = range(0, max(1, len(self.languages)), at_once)
        return [Model(self.languages[i : i + at_once], self.pieces, self.p[:, i : i + at_once]) for i in cuts]

    def sent(self, spark: SparkSession):
        check_broadcast(self.p.nbytes + self.pieces.prints.nbytes, "the language model")
        return spark.sparkContext.broadcast(Model(self.languages, self.pieces, np.ascontiguousarray(self.p)))


def _languages_at_once(pieces: Pieces) -> int:
    return max(1, (BROADCAST_LIMIT - pieces.prints.nbytes) // max(1, pieces.prints.nbytes))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each slice by language: (language, word, n)."""
    keyed = textcols.Prints(textcols.draw_seed())
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), dtype=np.int64)
        for a, b, data, offsets in textcols.slices(batch.column(1)):
            found = textcols.words(data, offsets, keyed)
            raw = data.tobytes()
            language = languages[a:b][found.row]
            for own in np.unique(language):
                mine = np.flatnonzero(language == own)
                code, first, n = np.unique(found.code[mine], return_index=True, return_counts=True)
                at = mine[first]
                text = [raw[s:e] for s, e in zip(found.start[at].tolist(), found.end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), own, np.int32)), pa.array(text, pa.binary()), pa.array(n.astype(np.int64))], names=["language", "word", "n"]
                )


def _expectation(model):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        total = np.zeros_like(own.p)
        for batch in batches:
            words = batch.column("word").to_pylist()
            end = np.cumsum([len(x) for x in words])
            language, weight = batch.column("language").to_numpy(), batch.column("n").to_numpy()
            if len(words):
                for word, lattice in _blocks(own.pieces, b"".join(words), end - [len(x) for x in words], end):
                    total += lattice.expected(own.p, language[word], weight[word])
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[piece, language])], names=["piece", "language", "n"]
        )

    return expect


def fit(
    labelled: DataFrame, pieces: Pieces, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, at_once: int | None = None
) -> Model:
    """Fits on about ``sample_rows`` rows, chosen by the text's hash, of those with a language and a text.

    Languages are fitted apart from each other, ``at_once`` in one pass over the sample's words.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "language")
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    languages = list(sizes)
    p = np.full((len(pieces.prints), max(1, len(languages))), 1 / len(pieces.prints))
    if not languages:
        return Model(languages, pieces, p)
    # as many rows of each language, so that rare languages are fitted as well as frequent ones
    shares = [(lang, i, min(SHARES, SHARES * sample_rows // len(languages) // n + 1)) for i, (lang, n) in enumerate(sizes.items())]
    check_broadcast(sum(len(lang.encode()) + 64 for lang in languages), "the list of languages")
    shares = F.broadcast(spark.createDataFrame(shares, "lang string, language int, share bigint"))
    taken = rows.join(shares, "lang").where(F.pmod(F.xxhash64("text"), F.lit(SHARES)) < F.col("share")).select("language", "text")
    counts = taken.mapInArrow(_counted, "language int, word binary, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "words")
    fitted, first = [], 0
    for shard in Model(languages, pieces, p).shards(at_once):
        own = counts.where(F.col("language").between(first, first + len(shard.languages) - 1)).withColumn("language", F.col("language") - first)
        for _ in range(rounds):
            expected = own.mapInArrow(_expectation(shard.sent(spark)), "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
            n = np.full_like(shard.p, 0.01)
            n[expected.column("piece").to_numpy(), expected.column("language").to_numpy()] += expected.column("n").to_numpy()
            shard = Model(shard.languages, pieces, n / n.sum(0))
        fitted.append(shard.p)
        first += len(shard.languages)
    scratch.drop("words")
    return Model(languages, pieces, np.hstack(fitted))


class _Sums:
    """Log probabilities of the distinct words that a task has met, up to ``KEPT_SUMS``."""

    def __init__(self, model: Model):
        self.model = model
        self.codes, self.sums = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def of(self, raw: bytes, found: textcols.Words) -> np.ndarray:
        code, first, back = np.unique(found.code, return_index=True, return_inverse=True)
        at = np.searchsorted(self.codes, code)
        old = np.zeros(len(code), dtype=bool)
        old[at < len(self.codes)] = self.codes[at[at < len(self.codes)]] == code[at < len(self.codes)]
        new = first[~old]
        out = np.empty((len(code), self.sums.shape[1]))
        out[old] = self.sums[at[old]]
        out[~old] = self.model.words(raw, found.start[new], found.end[new])
        if (len(self.codes) + len(new)) * self.sums.shape[1] > KEPT_SUMS:
            self.codes, self.sums = code, out
        else:
            codes, sums = np.concatenate([self.codes, code[~old]]), np.concatenate([self.sums, out[~old]])
            order = np.argsort(codes, kind="stable")
            self.codes, self.sums = codes[order], sums[order]
        return out[back]


#: What is known of a row after some of the languages: the likeliest one, its log probability, and the sum of all as a multiple of it.
_STATE = [StructField("lang_pred", StringType()), StructField("peak", DoubleType()), StructField("mass", DoubleType())]


def _predicted(model, last: bool):
    """Adds the languages of ``model`` to the state of each row; the ``last`` pass lets go of the texts."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        sums = _Sums(own)
        keyed = textcols.Prints(textcols.draw_seed())
        names = np.array([*own.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            lettered, peaks, masses = (batch.column(at[x]).to_numpy(zero_copy_only=False) for x in ("lettered", "peak", "mass"))
            for a, b, data, offsets in textcols.slices(batch.column(at["text"])):
                found = textcols.words(data, offsets, keyed)
                total = np.zeros((b - a, max(1, len(own.languages))))
                worded = np.flatnonzero(np.diff(found.first))
                if len(worded) and own.languages:
                    # each row's words alone are added, so that equal texts get equal sums
                    total[worded] = np.add.reduceat(sums.of(data.tobytes(), found), found.first[worded], axis=0)
                best, here = total.argmax(1), total.max(1)
                peak = np.maximum(here, peaks[a:b])
                mass = np.exp(total - here[:, None]).sum(1) * np.exp(here - peak) + masses[a:b] * np.exp(peaks[a:b] - peak)
                before = np.array(batch.column(at["lang_pred"]).slice(a, b - a).to_pylist(), dtype=object)
                lang = np.where(here > peaks[a:b], names[best], before)  # the first of equals stays
                no = ~lettered[a:b].astype(bool) | (len(own.languages) == 0)
                lang[no], mass[no] = UNDETERMINED, np.inf
                new = {"lang_pred": pa.array(lang, pa.string()), "peak": pa.array(peak), "mass": pa.array(mass)}
                kept = [x for x in batch.schema.names if not (last and x in ("text", "lettered"))]
                yield pa.RecordBatch.from_arrays([new[x] if x in new else batch.column(at[x]).slice(a, b - a) for x in kept], names=kept)

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), at_once: int | None = None) -> DataFrame:
    """Per row of ``docs``: id, ``lang_pred`` and ``score``, the language's share of the text's summed probability.

    The columns in ``carry`` follow, renamed to ``carried_0`` and so on.

    Texts are lower-cased.  Null texts and texts without a letter are ``und`` with score 0; so is all where no language
    was learned.  Of two languages that are equally likely, the alphabetically first is taken.  Repeated rows get
    equal results.  Other columns are not read, whatever their names.  A model of more languages than may be broadcast
    (or than ``at_once``) is applied in several passes, with the rows written between them.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc"),
        F.lower(text).alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        F.lit(UNDETERMINED).alias("lang_pred"),
        F.lit(float("-inf")).alias("peak"),
        F.lit(0.0).alias("mass"),
        *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)),
    )
    carried = [f for f in rows.schema.fields if f.name.startswith("carried_")]
    between = StructType([StructField("doc", LongType()), StructField("text", StringType()), StructField("lettered", BooleanType()), *_STATE, *carried])
    shards = model.shards(at_once)
    scratch = Scratch(spark, "languages") if len(shards) > 1 else None
    for number, shard in enumerate(shards[:-1]):
        rows = scratch.keep(rows.mapInArrow(_predicted(shard.sent(spark), False), between), f"shard-{number}")
    told = rows.mapInArrow(_predicted(shards[-1].sent(spark), True), StructType([between.fields[0], *_STATE, *carried]))
    return told.select(F.col("doc").alias(id_col), "lang_pred", (1 / F.col("mass")).alias("score"), *(f.name for f in carried))


def fold(id_column: Column, folds: int) -> Column:
    """Which of ``folds`` parts a document is in, by the CRC-32 of its id as text."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)).cast("int")
