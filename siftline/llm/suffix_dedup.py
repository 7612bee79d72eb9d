"""Suffix-array dedup with a logarithmic family of indexes.

Bytes repeat where a string of ``width`` bytes starts anywhere else.  The index holds *sparse suffixes*: for each run
of windows with one minimiser, the suffix that begins at the minimiser, as the fingerprint of its first ``gram`` bytes
(``key``), that of the whole run around it (``body``), and how often both occur together.  (Long matches need suffixes
with an equal head to be neighbours, not alphabetical order.)  Each new batch of documents becomes a level of its own.
Levels of equal rank are merge-scanned: suffixes with an equal head meet, their counts add up, and the two levels
become one of the next rank; so a suffix is rewritten once for each doubling of the corpus and not once for each batch.

Suffixes that continue alike on both sides for the whole run repeat as a whole.  Where heads meet but the runs differ
(the ends of a repeated passage), the passages are cut from the texts, dealt by head and given a dense suffix array by
prefix doubling; neighbours with a common prefix of ``width`` bytes are the repeats.  A head with more than
``shard_limit`` unlike passages isn't collected in one task; its windows are counted one by one, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols
from .repeats import Grain, clustered, counted_runs, documents, passages, same_document, sampled_runs, window_rows
from .work import Scratch, met_by_key

WIDTH = 200
GRAM = 64
BATCHES = 4
SHARD_LIMIT = 4096
_SHARD_ROWS = 2000


@dataclass
class IndexFamily:
    """Levels of sparse suffix arrays; ``add`` merges levels of equal rank as a binary counter carries."""

    scratch: Scratch
    levels: list[tuple[int, str]] = field(default_factory=list)
    _made: int = 0

    def add(self, suffixes: DataFrame) -> None:
        """Takes a batch's ``(key, body, copies)`` rows as a new level."""
        rank, name = 0, self._write(suffixes.groupBy("key", "body").agg(F.sum("copies").alias("copies")))
        while self.levels and self.levels[-1][0] == rank:
            _, older = self.levels.pop()
            merged = self._write(self._merge([older, name]))
            self.scratch.drop(older, name)
            rank, name = rank + 1, merged
        self.levels.append((rank, name))

    def scan(self) -> DataFrame:
        """``(key, body, copies)`` over all levels."""
        return self._merge([name for _, name in self.levels]) if len(self.levels) > 1 else self.scratch.read(self.levels[0][1])

    def _merge(self, names: list[str]) -> DataFrame:
        both = self.scratch.read(names[0])
        for name in names[1:]:
            both = both.unionByName(self.scratch.read(name))
        return both.groupBy("key", "body").agg(F.sum("copies").alias("copies"))

    def _write(self, level: DataFrame) -> str:
        self._made += 1
        name = f"level-{self._made}"
        self.scratch.keep(level.sortWithinPartitions("key"), name)
        return name


def suffix_classes(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense suffix array of ``data`` by prefix doubling, cut at ``width`` bytes: (order, rank of each suffix's head).

    Suffixes shorter than ``width`` get ranks of their own; two longer ones have equal rank just if their first
    ``width`` bytes are equal.
    """
    n = len(data)
    reach = min(8, width)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.zeros(n, dtype=np.uint64)
    for i in range(reach):
        value = (value << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    order, rank = _ranked(value)
    while reach < width:
        step = min(reach, width - reach)
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        order, rank = _ranked(rank * (n + 1) + ahead)
        reach += step
    return order, rank


def _ranked(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(value, kind="stable")
    new = np.ones(len(value), dtype=np.int64)
    new[1:] = value[order[1:]] != value[order[:-1]]
    rank = np.empty(len(value), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def _repeats_in_shard(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in clustered(batches, _SHARD_ROWS):
            units = table.column("units").to_pylist()
            n = table.column("n").to_numpy()
            single = table.column("single").to_numpy()
            length = n + width - 1
            text = np.frombuffer(b"".join(units), np.uint8)
            begin = np.cumsum(length) - length
            order, rank = suffix_classes(text, width)
            row = np.repeat(np.arange(len(n)), length)
            offset = np.arange(len(text)) - begin[row]
            whole = offset < n[row]
            in_order = order[whole[order]]
            ranks = rank[in_order]
            alike = ranks[1:] == ranks[:-1]
            repeated = np.zeros(len(text), dtype=bool)
            repeated[in_order[1:][alike]] = True
            repeated[in_order[:-1][alike]] = True
            repeated &= single[row]
            at = np.flatnonzero(repeated)
            if not len(at):
                continue
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(at)))
            rows = row[at[first]]
            lo = table.column("lo").to_numpy()[rows] + offset[at[first]]
            doc, tag = (table.column(c).combine_chunks().take(pa.array(rows)) for c in ("doc", "tag"))
            yield pa.RecordBatch.from_arrays([doc, tag, pa.array(lo.astype(np.int32)), pa.array(count.astype(np.int32))], names=["doc", "tag", "lo", "n"])

    return scan


def repeated_windows(docs: DataFrame, scratch: Scratch, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Ranges ``(doc, tag, lo, n)`` of window starts of ``docs(doc, tag, text)`` whose windows start anywhere else too."""
    grain = Grain("byte", width, gram, textcols.Prints(textcols.draw_seed()))
    runs = scratch.keep(counted_runs(docs, grain, batches), "runs", "batch")
    family = IndexFamily(scratch)
    for number in range(batches):
        family.add(runs.where(F.col("batch") == number).select("key", "body", "copies"))
    scratch.drop("runs")
    index = scratch.keep(family.scan(), "index")
    scratch.drop(*(name for _, name in family.levels))
    crowded = scratch.keep(index.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd >= 2"), "crowded")
    meeting = scratch.keep(met_by_key(index, crowded, "key", "crowd", ("body",), "left").where("copies >= 2 or crowd is not null"), "meeting")
    scratch.drop("index", "crowded")
    rows = scratch.keep(met_by_key(sampled_runs(docs, grain), meeting, "body", "copies", ("doc", "tag", "lo")), "rows")
    scratch.drop("meeting")
    copied = rows.where("copies >= 2").select("doc", "tag", "lo", "n")
    wanted = (
        rows.where("crowd is not null")
        .groupBy("key", "body")
        .agg(F.min(F.struct("doc", "tag", "lo", "n")).alias("first"), F.max("copies").alias("copies"), F.max("crowd").alias("crowd"))
        .select("first.doc", "first.tag", "key", (F.col("copies") == 1).alias("single"), "crowd", "first.lo", "first.n")
    )
    found = scratch.keep(passages(docs, wanted, grain), "passages")
    scratch.drop()
    in_shard = (
        found.where(F.col("crowd") <= shard_limit)
        .select("key", "doc", "tag", "lo", "n", "single", "units")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_repeats_in_shard(width), "doc bigint, tag bigint, lo int, n int")
    )
    windows = window_rows(found.where(F.col("crowd") > shard_limit), grain)
    twice = scratch.keep(windows.groupBy("print").agg(F.count(F.lit(1)).alias("copies")).where("copies >= 2"), "twice")
    in_crowd = met_by_key(windows.where("single"), twice, "print", "copies", ("doc", "tag", "lo")).select("doc", "tag", "lo", F.lit(1).alias("n"))
    return copied.unionByName(in_shard).unionByName(in_crowd)


CUT_SCHEMA = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<begin:bigint,end:bigint>>, kept binary"


def _cut(width: int, with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2).to_pylist()
            for a, b, data, offsets in textcols.slices(batch.column(1)):
                raw = data.tobytes()
                n_bytes, removed, shas, spans, kept = [], [], [], [], []
                for row in range(a, b):
                    own = raw[int(offsets[row - a]) : int(offsets[row - a + 1])]
                    merged: list[list[int]] = []
                    for lo, hi in sorted((m["lo"], min(m["lo"] + m["n"] + width - 1, len(own))) for m in marks[row] or ()):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(hi, merged[-1][1])
                        elif lo < hi:
                            merged.append([lo, hi])
                    pieces, at = [], 0
                    for lo, hi in merged:
                        pieces.append(own[at:lo])
                        at = hi
                    pieces.append(own[at:])
                    left = b"".join(pieces)
                    n_bytes.append(len(own))
                    removed.append(len(own) - len(left))
                    shas.append(hashlib.sha256(left).hexdigest())
                    spans.append([{"begin": lo, "end": hi} for lo, hi in merged])
                    kept.append(left if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(n_bytes, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array([len(x) for x in spans], pa.int64()),
                        pa.array(shas, pa.string()),
                        pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                        pa.array(kept, pa.binary()),
                    ],
                    names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
                )

    return cut


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, with_text: bool = True, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_removed``, removed ``spans``, ``kept`` bytes and their SHA-256.

    Null text reads as empty.  Documents shorter than ``width`` bytes keep everything.  Every row is a document: a
    row given twice repeats itself and loses all its windows in both, and rows that share an id (null, too) with unlike
    texts are told apart by their texts.  Other columns are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    source = documents(docs, id_col, text_col)
    marks = repeated_windows(source, scratch, width, gram, batches, shard_limit).groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "n")).alias("marks"))
    marks = scratch.keep(marks, "marks")
    scratch.drop("rows", "passages", "twice")
    joined = source.alias("s").join(marks.alias("m"), same_document("s", "m"), "left").select("s.doc", "s.text", "m.marks")
    return joined.mapInArrow(_cut(width, with_text), CUT_SCHEMA).withColumnRenamed("doc", id_col)
