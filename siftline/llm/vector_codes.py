"""Vector code compression: product codes of integer vectors, trained on all of them.

* Vectors become integers and are cut into equal consecutive parts; each part position has a codebook.
* *Search.*  A kd-tree of each codebook is built on the driver (codebooks are small by their parameters) and broadcast
  anew each round.  A part first descends to its home leaf, which gives a bound; then the tree is walked from its root
  with all parts of a chunk at once, and a part enters each node whose box is not farther than the best entry known.
  Nodes at just that distance are entered too, so that the entry with the lowest index wins a tie.  All distances and
  bounds are integers.
* *Update.*  Each task sums the parts of each entry and hands over one row for each entry that it met; Spark adds these
  up, and entries become the floors of the means.  Sums are integers, so neither partitioning nor a retried task changes
  a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .integer_vectors import chunks, joined, matrix, sums_of, usable
from .work import BROADCAST_LIMIT, HOT_KEYS, Scratch, check_broadcast, met_by_key

PARTS = 4
ENTRIES = 256
ROUNDS = 4
LEAF = 8


@dataclass
class KdTree:
    """Points in boxes: inner nodes split their widest side at the median; a leaf's points are in order of their index."""

    points: np.ndarray
    index: np.ndarray
    first: np.ndarray  # a node's points are first[node]:last[node] of points
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray  # (left, right), or -1 twice
    side: np.ndarray
    split: np.ndarray  # points of the left child are at most this far along the side

    @classmethod
    def of(cls, entries: np.ndarray, leaf: int = LEAF) -> KdTree:
        index = np.arange(len(entries))
        nodes: list[list] = []

        def grow(begin: int, end: int) -> int:
            own = entries[index[begin:end]]
            low, high = own.min(0), own.max(0)
            side = int((high - low).argmax())
            node = [begin, end, low, high, (-1, -1), side, 0]
            nodes.append(node)
            name = len(nodes) - 1
            if end - begin > leaf and low[side] < high[side]:
                along = np.sort(own[:, side])
                split = along[(len(along) - 1) // 2]
                split = split if split < high[side] else along[along < high[side]].max()
                goes = own[:, side] <= split
                index[begin:end] = np.concatenate([index[begin:end][goes], index[begin:end][~goes]])  # stable: a leaf keeps its order
                middle = begin + int(goes.sum())
                node[6] = split
                node[4] = grow(begin, middle), grow(middle, end)
            return name

        grow(0, len(entries))
        first, last, low, high, children, side, split = (np.array(x) for x in zip(*nodes, strict=True))
        return cls(entries[index], index, first, last, low, high, children, side, split)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values())

    def _scan(self, leaf: int, asked: np.ndarray, rows: np.ndarray, best: np.ndarray, near: np.ndarray) -> None:
        lo, hi = self.first[leaf], self.last[leaf]
        apart = ((asked[rows, None] - self.points[lo:hi]) ** 2).sum(2)
        at = apart.argmin(1)  # the first of equals: the lowest index of the leaf
        far, name = apart[np.arange(len(rows)), at], self.index[lo:hi][at]
        better = (far < near[rows]) | ((far == near[rows]) & (name < best[rows]))
        best[rows[better]], near[rows[better]] = name[better], far[better]

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row; of equally near ones the lowest index."""
        best, near = np.full(len(asked), np.iinfo(np.int64).max), np.full(len(asked), np.iinfo(np.int64).max)
        home, every = np.zeros(len(asked), np.int64), np.arange(len(asked))
        while (inner := self.children[home, 0] >= 0).any():
            rows, node = every[inner], home[inner]
            right = asked[rows, self.side[node]] > self.split[node]
            home[rows] = self.children[node, right.astype(np.int64)]
        for leaf in np.unique(home):
            self._scan(leaf, asked, every[home == leaf], best, near)
        waiting = [(0, every)]
        while waiting:
            node, rows = waiting.pop()
            here = asked[rows]
            outside = np.maximum(self.low[node] - here, 0) + np.maximum(here - self.high[node], 0)
            rows = rows[(outside**2).sum(1) <= near[rows]]  # equal bounds are visited: ties go to the lowest index
            if not len(rows):
                continue
            if self.children[node, 0] >= 0:
                waiting += [(int(child), rows) for child in self.children[node]]
            else:
                self._scan(node, asked, rows[home[rows] != node], best, near)
        return best, near


def _cut(ints: np.ndarray, parts: int) -> np.ndarray:
    """(row, part, place); a last part that isn't full is filled with zeros."""
    wide = -(-ints.shape[1] // parts) * parts
    return np.pad(ints, ((0, 0), (0, wide - ints.shape[1]))).reshape(len(ints), parts, wide // parts)


def _summed(trees, width: int, shape: tuple[int, int, int]):
    """Rows (part, entry, rows, sums) of the entries that a task met."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, _ = shape
        sums, rows = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            for piece in chunks(batch, width):
                cut = _cut(matrix(piece.column(0), width), parts)
                for part, tree in enumerate(trees.value):
                    home, _ = tree.nearest(cut[:, part])
                    sums[part] += sums_of(cut[:, part], home, entries)
                    rows[part] += np.bincount(home, minlength=entries)
        part, entry = np.nonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(rows[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "rows", "sums"],
        )

    return add


def _coded(trees, width: int, parts: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, width):
                cut = _cut(matrix(piece.column(2), width), parts)
                found = [tree.nearest(cut[:, part]) for part, tree in enumerate(trees.value)]
                codes = np.stack([home for home, _ in found], 1).astype(np.uint8)
                error = sum(far for _, far in found)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([x.tobytes().hex() for x in codes], pa.string()), pa.array(error)], names=["vec", "label", "code", "error"])

    return code


@dataclass
class Codes:
    """``rows`` (vec, label, code, error, label_error), and the final codebooks by part, entry and place."""

    rows: DataFrame
    codebooks: np.ndarray

    @property
    def codebooks_sha256(self) -> str:
        return hashlib.sha256(joined(self.codebooks).encode()).hexdigest()


def _trees(spark: SparkSession, books: np.ndarray):
    made = [KdTree.of(book) for book in books]
    check_broadcast(sum(tree.nbytes for tree in made), "the trees of the codebooks")
    return spark.sparkContext.broadcast(made)


def _with_label_error(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``label_error``, the error summed over rows of an equal label (nulls are equal)."""
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    of_label = scratch.keep(rows.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_copies")), "labels")
    size = of_label.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_key")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= HOT_KEYS and size["bytes"] <= BROADCAST_LIMIT // 4:
        met = rows.join(F.broadcast(of_label), "_key")
    else:
        met = met_by_key(rows, of_label, "_key", "_copies", ("vec", "code"))
    return met.drop("_key", "_copies")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int | None = None
) -> Codes:
    """Product codes of all usable vectors, and the codebooks that they refer to.

    Codebooks start as the parts of the ``entries`` smallest ids (ties by components; a null id comes after all
    others); with fewer vectors there are fewer entries.  ``width`` is the length of vectors, by default that of the
    smallest usable id's.  Vectors that are null, empty or of another length, hold null or non-finite components or
    ones beyond ``integer_vectors.LARGEST`` are left out.  Where ``parts`` doesn't divide the width, the last part is
    filled with zeros.  Rows that share an id are coded one by one; equal vectors get equal codes.  Null labels count
    as one label; without a label column (``None``) all rows do.  An empty table gives no rows and empty codebooks.
    Other columns are not read, whatever their names.
    """
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("codes have two hex digits: at most 256 entries, and at least one part")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    by_id = [F.col("vec").asc_nulls_last(), F.col("ints")]
    if width is None:
        first = usable(vectors, id_col, vector_col, None).orderBy(*by_id).select(F.size("ints").alias("n")).first()
        width = first["n"] if first else parts
    kept = scratch.keep(usable(vectors, id_col, vector_col, width, label.alias("label")), "kept")
    seeds = [r["ints"] for r in kept.orderBy(*by_id).select("ints").limit(entries).collect()]
    books = _cut(np.array(seeds, np.int64).reshape(-1, width), parts).transpose(1, 0, 2).copy()
    if not seeds:
        return Codes(kept.select("vec", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error")), books)
    for _ in range(rounds):
        told = kept.select("ints").mapInArrow(_summed(_trees(spark, books), width, books.shape), "part int, entry int, rows bigint, sums array<bigint>")
        added = told.groupBy("part", "entry").agg(F.sum("rows").alias("rows"), F.array(*(F.sum(F.col("sums")[i]) for i in range(books.shape[2]))).alias("sums"))
        for r in added.collect():  # a row for each entry of a codebook at most
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["rows"]  # rounds down, below zero too
    kind = kept.schema["label"].dataType.simpleString()
    coded = kept.select("vec", "label", "ints").mapInArrow(_coded(_trees(spark, books), width, parts), f"vec bigint, label {kind}, code string, error bigint")
    return Codes(_with_label_error(scratch.keep(coded, "coded"), scratch), books)
