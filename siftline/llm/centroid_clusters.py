"""Centroid clustering with Elkan's bounds, exact on integer vectors.

Each row carries, from round to round, its centroid, an upper bound of the distance to it and a lower bound of the
distance to every centroid.  When centroids move, bounds give way by as much; half the distances between centroids and
the lower bounds then tell which distances can't matter, and only the others are calculated (Elkan, "Using the Triangle
Inequality to Accelerate k-Means").

* Bounds are doubles, and every step rounds upper ones up and lower ones down.  A centroid is passed over only where its
  bound is strictly above the upper bound, so one at an equal distance is always compared, and the smaller number wins.
* Distances that decide, and the final ones, are integers; centroids are floors of exact sums.

A round is one scan: tasks read vectors with their bounds, write them with new ones, and add a row of sums for each
centroid that they met, to the same written table.  The sums of all tasks are then added up by Spark, a few numbers for
each centroid.  A round's table is dropped once the next one stands, and a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integer_vectors import chunks, joined, matrix, sums_of, usable
from .work import Scratch, check_broadcast

CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: More than all rounding errors of a step; each is below 2**-52.
_ROOM = 1e-15
_STATE = "summed boolean, vec bigint, ints array<int>, cluster int, upper double, lower array<double>, distance bigint, rows bigint, sums array<bigint>, computed bigint"


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + _ROOM)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) * (1 - _ROOM)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


@dataclass
class Centres:
    """Centroids of a round, how far each has moved at most, and half the distances between them at least."""

    at: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray) -> Centres:
        half = _down(np.sqrt(_squares(at[:, None], at[None]).astype(np.float64))) / 2
        np.fill_diagonal(half, np.inf)  # a centroid is no rival of itself
        return cls(at, _up(np.sqrt(_squares(at, before).astype(np.float64))), half)

    def first(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Centroid, upper and lower bounds of rows that have none yet, and how many distances were calculated."""
        squares = np.stack([_squares(ints, c) for c in self.at], 1)
        home = squares.argmin(1)  # the first of equals
        far = np.sqrt(squares.astype(np.float64))
        return home, _up(far[np.arange(len(ints)), home]), _down(far), squares.size

    def next(self, ints: np.ndarray, home: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the bounds of the round before."""
        home, upper, lower = home.copy(), _up(upper + self.moved[home]), _down(lower - self.moved)
        rivals = (lower <= upper[:, None]) & (self.half[home] <= upper[:, None])
        rows = np.flatnonzero(rivals.any(1))
        computed = len(rows)
        if not computed:
            return home, upper, lower, 0
        own, some, bound, least = ints[rows], home[rows], upper[rows], lower[rows]
        near = _squares(own, self.at[some])
        bound = _up(np.sqrt(near.astype(np.float64)))
        least[np.arange(len(rows)), some] = _down(np.sqrt(near.astype(np.float64)))
        for c in range(len(self.at)):
            asked = np.flatnonzero((some != c) & (least[:, c] <= bound) & (self.half[some, c] <= bound))
            if not len(asked):
                continue
            computed += len(asked)
            squares = _squares(own[asked], self.at[c])
            far = np.sqrt(squares.astype(np.float64))
            least[asked, c] = _down(far)
            wins = (squares < near[asked]) | ((squares == near[asked]) & (c < some[asked]))
            won = asked[wins]
            some[won], near[won], bound[won] = c, squares[wins], _up(far[wins])
        home[rows], upper[rows], lower[rows] = some, bound, least
        return home, upper, lower, computed


def _assigned(centres, width: int, begun: bool, final: bool):
    """Rows with their centroid and bounds (or final distance), then the sums of the rows of each centroid."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Centres = centres.value
        k = len(model.at)
        sums, rows, inertia, computed = np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for piece in chunks(batch, width):
                ints = matrix(piece.column("ints"), width)
                if begun:
                    lower = piece.column("lower").flatten().to_numpy().reshape(-1, k)
                    home, upper, lower, n = model.next(ints, piece.column("cluster").to_numpy().astype(np.int64), piece.column("upper").to_numpy(), lower)
                else:
                    home, upper, lower, n = model.first(ints)
                computed += n
                rows += np.bincount(home, minlength=k)
                none = pa.nulls(len(ints), pa.list_(pa.int64()))
                if final:
                    distance = _squares(ints, model.at[home])
                    for c in range(k):
                        inertia[c] += distance[home == c].sum()
                    state = [pa.nulls(len(ints), pa.list_(pa.int32())), pa.array(home, pa.int32()), pa.nulls(len(ints), pa.float64()), pa.nulls(len(ints), pa.list_(pa.float64())), pa.array(distance)]
                else:
                    sums += sums_of(ints, home, k)
                    ends = pa.array(np.arange(len(ints) + 1, dtype=np.int32) * k)
                    state = [piece.column("ints"), pa.array(home, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(ends, pa.array(lower.ravel())), pa.nulls(len(ints), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ints), bool)), piece.column("vec"), *state, pa.nulls(len(ints), pa.int64()), none, pa.nulls(len(ints), pa.int64())], names=_NAMES)
        met = np.flatnonzero(rows)
        share = np.zeros(len(met), np.int64)
        share[:1] = computed
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(len(met), bool)), pa.nulls(len(met), pa.int64()), pa.nulls(len(met), pa.list_(pa.int32())), pa.array(met, pa.int32()), pa.nulls(len(met), pa.float64()), pa.nulls(len(met), pa.list_(pa.float64())),
                pa.array(inertia[met]), pa.array(rows[met]), pa.array(list(sums[met]), pa.list_(pa.int64())), pa.array(share),
            ],
            names=_NAMES,
        )

    return assign


_NAMES = [field.split()[0] for field in _STATE.split(", ")]


@dataclass
class Clusters:
    """``rows`` (vec, cluster, distance, cluster_inertia, inertia, centroid_sha256), the final centroids, and how many distances each scan calculated."""

    rows: DataFrame
    centroids: np.ndarray
    computed: list[int]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Clusters:
    """Nearest centroid of each usable vector after ``rounds`` rounds, with exact distances.

    Centroids start as the vectors with the smallest SHA-256 of ``<seed>:<id>`` (ties by components; null ids last);
    with fewer vectors there are fewer.  Vectors that are null or not of ``width`` components, hold null or non-finite
    components or ones beyond ``integer_vectors.LARGEST`` are left out.  Rows that share an id count one by one.  A
    centroid that no row is nearest to stays where it is, with an inertia of its own only where rows come back to it.
    An empty table gives no rows.  Other columns are not read, whatever their names.
    """
    if clusters < 1 or width < 1:
        raise ValueError("at least one centroid and one component are needed")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    state = scratch.keep(usable(vectors, id_col, vector_col, width), "round-0")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec").cast("string")), 256).asc_nulls_last()
    seeds = [r["ints"] for r in state.orderBy(by_hash, "ints").select("ints").limit(clusters).collect()]
    at = np.array(seeds, np.int64).reshape(-1, width)
    check_broadcast(at.nbytes + 8 * len(at) ** 2, "the centroids")
    if not seeds:
        empty = "bigint cluster_inertia, bigint inertia"
        zero = [F.lit(0).cast(x.split()[0]).alias(x.split()[1]) for x in empty.split(", ")]
        return Clusters(state.select("vec", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), *zero, F.lit("").alias("centroid_sha256")), at, [])
    before, computed = at, []
    for scan in range(rounds + 1):
        centres = spark.sparkContext.broadcast(Centres.of(at, before))
        rows = state.select("vec", "ints", *(("cluster", "upper", "lower") if scan else ()))
        both = scratch.keep(rows.mapInArrow(_assigned(centres, width, scan > 0, scan == rounds), _STATE), f"round-{scan + 1}")
        scratch.drop(f"round-{scan}")
        state = both.where("not summed")
        told = both.where("summed").groupBy("cluster").agg(F.sum("rows").alias("rows"), F.sum("distance").alias("inertia"), F.sum("computed").alias("computed"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
        added = told.collect()  # a row for each centroid at most
        computed.append(sum(r["computed"] for r in added))
        if scan < rounds:
            before, at = at, at.copy()
            for r in added:
                at[r["cluster"]] = np.array(r["sums"], np.int64) // r["rows"]  # rounds down, below zero too
    hashes = [hashlib.sha256(joined(c).encode()).hexdigest() for c in at]
    ends = spark.createDataFrame([(r["cluster"], r["inertia"], hashes[r["cluster"]]) for r in added], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    whole = F.lit(sum(r["inertia"] for r in added)).cast("bigint").alias("inertia")
    shown = state.select("vec", "cluster", "distance").join(F.broadcast(ends), "cluster")  # a row for each centroid
    return Clusters(shown.select("vec", "cluster", "distance", "cluster_inertia", whole, "centroid_sha256"), at, computed)
