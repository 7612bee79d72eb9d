"""What the two exact repeat finders share: sampled windows, their index rows and fetching of passages.

A *unit* is a byte or a word.  A window is ``width`` consecutive units of one document.  Windows are not listed
one by one: consecutive windows with the same minimising gram form a run (see ``textcols.Runs``), one row of about
``width`` units.  Equal windows always lie in runs of equal ``key``; runs of equal ``body`` hold the same windows.
So repeats of whole runs are found by counting rows, and only runs that share a key without being equal, those at the
ends of a repeated passage, need their windows compared one by one.

A document is told by its id and a hash of its text (``doc`` and ``tag``), so rows that share an id with unlike texts
are different documents, and ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcols
from .work import text_tag

PASSAGE_SCHEMA = "key bigint, single boolean, crowd bigint, doc bigint, tag bigint, lo int, n int, units binary"
#: Runs that a task gathers before it counts equal ones.
_GATHERED = 500_000


@dataclass(frozen=True)
class Grain:
    """What a window is made of.  ``gram`` units (at most ``width``) make the sampled key."""

    unit: str
    width: int
    gram: int
    prints: textcols.Prints

    def __post_init__(self):
        if self.unit not in ("byte", "word") or not 1 <= self.gram <= self.width:
            raise ValueError(f"bad grain: {self}")

    def sequence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All units of a slice (bytes, or the words' 64-bit codes), and where each row's begin."""
        if self.unit == "byte":
            return data, offsets
        found = textcols.words(data, offsets, self.prints)
        return found.code, found.first

    def grams(self, units: np.ndarray, n: int) -> np.ndarray:
        return self.prints.byte_grams(units, n) if self.unit == "byte" else self.prints.grams(units, n)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[textcols.Runs, np.ndarray]:
        units, first = self.sequence(data, offsets)
        return textcols.minimiser_runs(self.prints, self.grams(units, self.gram), first, self.width, self.gram), first

    def units_of(self, packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), np.uint8 if self.unit == "byte" else np.uint64)


def documents(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``(doc, tag, text)`` of every row, and further columns."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(text_tag(text), F.lit(0)).alias("tag"), text.alias("text"), *more)


def same_document(left: str, right: str) -> Column:
    return F.col(f"{left}.doc").eqNullSafe(F.col(f"{right}.doc")) & (F.col(f"{left}.tag") == F.col(f"{right}.tag"))


def sampled_runs(docs: DataFrame, grain: Grain) -> DataFrame:
    """One row for each run of windows of ``docs(doc, tag, text)``; null text has none."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, _, data, offsets in textcols.slices(batch.column(2)):
                runs, first = grain.runs(data, offsets)
                if len(runs.key):
                    rows = pa.array(runs.row + first_row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(runs.body.view(np.int64)),
                            batch.column(0).take(rows),
                            batch.column(1).take(rows),
                            pa.array((runs.lo - first[runs.row]).astype(np.int32)),
                            pa.array((runs.hi - runs.lo + 1).astype(np.int32)),
                        ],
                        names=["body", "doc", "tag", "lo", "n"],
                    )

    return docs.select("doc", "tag", "text").mapInArrow(sample, "body bigint, doc bigint, tag bigint, lo int, n int")


def counted_runs(docs: DataFrame, grain: Grain, batches: int = 1) -> DataFrame:
    """``(batch, key, body, copies)``: runs of ``docs``, equal ones counted within a task as far as it gathers them.

    The documents are dealt to ``batches`` by the hash of their texts.
    """

    def count(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            batch, key, body = (np.concatenate([h[i] for h in held]) for i in range(3))
            _, first, n = np.unique(body + batch.astype(np.uint64), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(batch[first]), pa.array(key[first].view(np.int64)), pa.array(body[first].view(np.int64)), pa.array(n.astype(np.int32))], names=["batch", "key", "body", "copies"]
            )

        for rows in incoming:
            number = rows.column(1).to_numpy()
            for a, b, data, offsets in textcols.slices(rows.column(0)):
                runs, _ = grain.runs(data, offsets)
                if len(runs.key):
                    held.append((number[a:b][runs.row].astype(np.int32), runs.key, runs.body))
                    size += len(runs.key)
                if size >= _GATHERED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    dealt = F.pmod(F.col("tag"), F.lit(batches)).cast("int")
    return docs.select("text", dealt.alias("batch")).mapInArrow(count, "batch int, key bigint, body bigint, copies int")


def passages(docs: DataFrame, wanted: DataFrame, grain: Grain) -> DataFrame:
    """The units that the runs ``wanted(doc, tag, key, single, crowd, lo, n)`` cover."""
    by_doc = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "single", "crowd", "lo", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3)
            bounds = runs.offsets.to_numpy()
            flat = runs.flatten()
            base = bounds[0]
            key, single, crowd, lo, n = (flat.field(i) for i in range(5))
            lo_np, n_np = lo.to_numpy(), n.to_numpy()
            for a, b, data, offsets in textcols.slices(batch.column(2)):
                units, first = grain.sequence(data, offsets)
                cuts, rows = [], np.repeat(np.arange(a, b), np.diff(bounds[a : b + 1]))
                picked = np.arange(bounds[a] - base, bounds[b] - base)
                begin = first[rows - a] + lo_np[picked]
                end = begin + n_np[picked] + grain.width - 1
                for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                    cuts.append(units[x:y].tobytes())
                if len(picked):
                    take, row = pa.array(picked), pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [key.take(take), single.take(take), crowd.take(take), batch.column(0).take(row), batch.column(1).take(row), lo.take(take), n.take(take), pa.array(cuts, pa.binary())],
                        names=["key", "single", "crowd", "doc", "tag", "lo", "n", "units"],
                    )

    met = docs.alias("d").join(by_doc.alias("w"), same_document("d", "w"))
    return met.select("d.doc", "d.tag", "d.text", "w.runs").mapInArrow(cut, PASSAGE_SCHEMA)


def window_rows(found: DataFrame, grain: Grain) -> DataFrame:
    """One row for each window of ``passages``; for keys with too many unlike runs to meet in one task."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                n, key = part.column(4).to_numpy().astype(np.int64), part.column(0).to_numpy()
                length = n + grain.width - 1
                row = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                whole = grain.grams(grain.units_of(part.column(6).to_pylist()), grain.width)
                prints = grain.prints.join(whole[(np.cumsum(length) - length)[row] + offset], key.view(np.uint64)[row])
                same = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prints.view(np.int64)),
                        part.column(1).take(same),
                        part.column(2).take(same),
                        part.column(3).take(same),
                        pa.array((offset + part.column(5).to_numpy()[row]).astype(np.int32)),
                    ],
                    names=["print", "single", "doc", "tag", "lo"],
                )

    columns = found.select("key", "single", "doc", "tag", "n", "lo", "units")
    return columns.mapInArrow(windows, "print bigint, single boolean, doc bigint, tag bigint, lo int")


def clustered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Regroups rows sorted by their first column into tables of ``least`` rows or more that never split a key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
