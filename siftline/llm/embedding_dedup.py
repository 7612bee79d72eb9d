"""Embedding near-duplicates by product quantisation over coarse inverted lists.

* *Training* on a bounded sample (``SAMPLE`` vectors): coarse centroids by k-means, then codebooks for the subspaces of
  the residuals.  Every vector is indexed, in the list of its nearest centroid, by its residual's codes and by the
  norm of what the codes leave out.
* *Probes.*  Two vectors of different lists within the threshold's distance ``r`` lie on either side of the plane
  between the two centroids, so the nearer one is within ``r / 2`` of it.  A query probes every list whose plane is that
  near: no pair is lost.  The pair belongs to the query that is nearer to the plane and counts for both vectors.
* *Distances.*  In each list a table of squared distances from the query's residual to all codewords gives the
  distance to every code by look-ups; by the triangle inequality the vector can be within ``r`` only where that
  distance less the norm left out is at most ``r``, so this step loses nothing.
* *Rerank.*  Exact cosines in double precision decide.

Equal vectors are collapsed before.  Lists are cut into blocks of index rows and chunks of queries, so a crowded list
is spread over tasks; pairs never leave a task, only link counts and spanning links do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .work import SHARES, Scratch, check_broadcast

SAMPLE = 16_384
LISTS = 65_536
SUBSPACES = 8
CODEWORDS = 256
BLOCK = 1024
CHUNK = 4096
_PAIRS = 65_536


def _kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(points, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        size = np.bincount(home, minlength=k)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre and its squared distance, a block of points at a time."""
    step = max(1, 4_000_000 // len(centres))
    home, near = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for i in range(0, len(points), step):
        squares = _squares(points[i : i + step], centres)
        home.append(squares.argmin(1))
        near.append(squares.min(1))
    return np.concatenate(home), np.concatenate(near)


@dataclass
class Quantiser:
    coarse: np.ndarray
    books: np.ndarray  # subspace, codeword, component

    @classmethod
    def train(cls, unit: np.ndarray, lists: int, subspaces: int) -> Quantiser:
        coarse = _kmeans(unit, lists)
        residual = _split(unit - coarse[_nearest(unit, coarse)[0]], subspaces)
        books = [_kmeans(residual[:, m], CODEWORDS) for m in range(subspaces)]
        return cls(coarse, np.stack(books))

    def encode(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the norms of what they leave out."""
        residual = _split(unit - self.coarse[home], len(self.books))
        codes = np.stack([_nearest(residual[:, m], book)[0] for m, book in enumerate(self.books)], 1).astype(np.uint8)
        left = residual - np.stack([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return codes, np.sqrt((left**2).sum((1, 2)))

    def distances(self, unit: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Distances from vectors to the codes of one list, by look-ups in a table of each vector."""
        residual = _split(unit - self.coarse[home], len(self.books))
        total = np.zeros((len(unit), len(codes)))
        for m, book in enumerate(self.books):
            total += _squares(residual[:, m], book)[:, codes[:, m]]
        return np.sqrt(total)

    def probes(self, unit: np.ndarray, home: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists beyond planes nearer than ``reach``; each row's own list among them."""
        squares = _squares(unit, self.coarse)
        apart = np.sqrt(_squares(self.coarse[home], self.coarse))
        beyond = squares - squares[np.arange(len(unit)), home][:, None] <= 2 * reach * apart + 1e-8  # room for rounding
        beyond[np.arange(len(unit)), home] = True
        return np.nonzero(beyond)

    def aside(self, unit: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Distances from the planes between two lists each, in a common unit of the two; equal bits whenever asked."""
        a, b = self.coarse[np.minimum(one, other)], self.coarse[np.maximum(one, other)]
        return np.abs(((b - a) * (unit - (a + b) / 2)).sum(1))


def _radius(threshold: float) -> float:
    """Distance of unit vectors that have the threshold's cosine, with room for rounding."""
    return float(np.sqrt(2 - 2 * threshold + 1e-13)) * (1 + 1e-9)


def _split(residual: np.ndarray, subspaces: int) -> np.ndarray:
    wide = -(-residual.shape[1] // subspaces) * subspaces
    return np.pad(residual, ((0, 0), (0, wide - residual.shape[1]))).reshape(len(residual), subspaces, -1)


def _units(raw: pa.Array, kind: type) -> np.ndarray:
    flat = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), -1).astype(np.float64)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # no overflow in squares
    return flat / np.sqrt((flat**2).sum(1, keepdims=True))


def _raw(kind: type):
    """(vec, dim, raw): a usable vector's components as bytes, or null."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dim = [], []
            for vector in batch.column(1):
                values = np.asarray(vector.values.to_numpy(zero_copy_only=False) if vector.is_valid else [], dtype=np.float64)
                good = len(values) > 0 and bool(np.isfinite(values).all()) and bool((values != 0).any())
                out.append((values.astype(kind) + kind(0)).tobytes() if good else None)  # -0 becomes 0
                dim.append(len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim, pa.int32()), pa.array(out, pa.binary())], names=["vec", "dim", "raw"])

    return convert


def _indexed(quantiser, kind: type, reach: float):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = quantiser.value
        for batch in batches:
            step = max(1, 4_000_000 // len(model.coarse))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                unit = _units(part.column(1), kind)
                home, _ = _nearest(unit, model.coarse)
                codes, left = model.encode(unit, home)
                row, probed = model.probes(unit, home, reach)
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(unit)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array(home.astype(np.int32)),
                        pa.array([x.tobytes() for x in codes], pa.binary()),
                        pa.array(left),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(probed.astype(np.int32))),
                    ],
                    names=["kind", "raw", "copies", "home", "codes", "left", "probes"],
                )

    return index


def _roots(q: np.ndarray, y: np.ndarray, n_q: int, n_y: int) -> tuple[np.ndarray, np.ndarray]:
    """Least index row in the component of each query and index row, over links (q, y) of two sides."""
    of_q, of_y = np.full(n_q, n_y), np.arange(n_y)
    while True:
        before = of_q.copy(), of_y.copy()
        np.minimum.at(of_q, q, of_y[y])
        np.minimum.at(of_y, y, of_q[q])
        if (before[0] == of_q).all() and (before[1] == of_y).all():
            return of_q, of_y


def _links(quantiser, kind: type, threshold: float):
    """Rows sorted by (home, block, chunk, side): index rows first, then the queries that stream past them."""
    reach = _radius(threshold)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = quantiser.value
        key, held, index, gained = None, [], None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
                edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
                for lo, hi in zip(edges, [*edges[1:], len(keys)], strict=True):
                    part = batch.slice(lo, hi - lo)
                    if tuple(keys[lo, :3]) != key:
                        if index is not None and gained.any():
                            yield _counts(index[3], gained)
                        key, held, index = tuple(keys[lo, :3]), [], None
                    if keys[lo, 3] == 0:
                        held.append(part)
                        continue
                    if not held:
                        continue
                    if index is None:
                        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(table.num_rows, -1)
                        index = _units(table.column("raw"), kind), codes, table.column("left").to_numpy(), table.column("kind").to_numpy(), table.column("copies").to_numpy()
                        gained = np.zeros(table.num_rows, dtype=np.int64)
                    asked = _units(part.column("raw"), kind), part.column("own").to_numpy(), part.column("kind").to_numpy(), part.column("copies").to_numpy()
                    out = _compare(model, int(key[0]), asked, index, gained, reach, threshold)
                    if out is not None:
                        yield out
        if index is not None and gained.any():
            yield _counts(index[3], gained)

    return scan


def _counts(names: np.ndarray, gained: np.ndarray) -> pa.RecordBatch:
    some = gained > 0
    return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[some]), pa.array(gained[some])], names=["a", "b", "n"])


def _compare(model: Quantiser, home: int, asked, index, gained: np.ndarray, reach: float, threshold: float) -> pa.RecordBatch | None:
    """Links of the pairs that belong to the queries; adds to ``gained`` what they are worth to the index rows."""
    unit, own, kinds, weight = asked
    units, codes, left, names, copies = index
    q, y = np.nonzero(model.distances(unit, home, codes) - left <= reach)
    other = (own[q] != home) | (kinds[q] < names[y])
    q, y = q[other], y[other]
    near = [np.einsum("ij,ij->i", unit[q[i : i + _PAIRS]], units[y[i : i + _PAIRS]]) >= threshold for i in range(0, len(q), _PAIRS)]
    if not near or not (hit := np.concatenate(near)).any():
        return None
    q, y = q[hit], y[hit]
    mine = [_belongs(model, home, unit[s], own[s], kinds[s], units[t], names[t]) for s, t in ((q[i : i + _PAIRS], y[i : i + _PAIRS]) for i in range(0, len(q), _PAIRS))]
    if not (kept := np.concatenate(mine)).any():
        return None
    q, y = q[kept], y[kept]
    links = np.bincount(q, weights=copies[y], minlength=len(unit)).astype(np.int64)
    gained += np.bincount(y, weights=weight[q], minlength=len(units)).astype(np.int64)
    of_q, of_y = _roots(q, y, len(unit), len(units))
    linked_q, linked_y = np.unique(q), np.unique(y)
    linked_y = linked_y[of_y[linked_y] != linked_y]
    a = np.concatenate([kinds[linked_q], kinds[linked_q], names[linked_y]])
    b = np.concatenate([kinds[linked_q], names[of_q[linked_q]], names[of_y[linked_y]]])
    n = np.concatenate([links[linked_q], np.zeros(len(linked_q) + len(linked_y), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])


def _belongs(model: Quantiser, home: int, unit: np.ndarray, own: np.ndarray, kinds: np.ndarray, units: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether a pair is the query's: in its own list, or nearer to the plane than the index row (ties by kind)."""
    there = np.full(len(own), home)
    here, beyond = model.aside(unit, own, there), model.aside(units, own, there)
    return (own == home) | (here < beyond) | ((here == beyond) & (kinds < names))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``vectors``: id, ``n_links`` (other rows linked directly), ``component_id``, ``kept``.

    Rows link where their cosine is ``threshold`` or more.  Null, empty and zero vectors and those with null or
    non-finite components link with nothing; vectors of unlike lengths don't link.  Equal vectors are linked whatever
    their ids; rows that share an id are one node with several vectors.  A row with a null id links and is counted,
    but names no component.  ``lists`` is the number of coarse lists, by default the root of the number of unlike
    vectors, ``LISTS`` at most and no more than ``BLOCK`` rows of each would fill; it has no bearing on the rows returned.
    Other columns, labels too, are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"bad threshold: {threshold}")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    listed = vectors.select(F.col(id_col).cast("bigint").alias("vec"), F.col(vector_col).alias("vector"))
    rows = scratch.keep(listed.mapInArrow(_raw(kind), "vec bigint, dim int, raw binary"), "rows")
    kinds = rows.where("raw is not null").groupBy("dim", "raw").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
    kinds = scratch.keep(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    sizes = {r["dim"]: r["count"] for r in kinds.groupBy("dim").count().collect()}
    parts = []
    for dim, size in sorted(sizes.items()):
        own = kinds.where(F.col("dim") == dim)
        parts.append(_linked(spark, scratch, own, dim, size, kind, threshold, lists, sample))
    found = scratch.keep(_union(spark, parts), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("kind")).agg(F.sum("n").alias("links"))
    named = kinds.select("kind", "vec")
    edges = found.where("a <> b").select("a", "b").distinct()
    edges = edges.join(named.toDF("a", "vec_a"), "a").join(named.toDF("b", "vec_b"), "b").select(F.col("vec_a").alias("a"), F.col("vec_b").alias("b"))
    components = connected_components(edges, scratch, "components").toDF("vec", "component")
    known = kinds.join(counts, "kind", "left").join(components, "vec", "left")
    known = known.select("dim", "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component"))
    out = rows.join(known, ["dim", "raw"], "left")
    component = F.coalesce("component", "vec")
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec") == component).alias("kept"))


def _union(spark, parts: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    for part in parts:
        out = out.unionByName(part)
    return out


def _linked(spark, scratch: Scratch, kinds: DataFrame, dim: int, size: int, kind: type, threshold: float, lists: int | None, sample: int) -> DataFrame:
    """``(a, b, n)``: a = b has the links of a kind, others are links that span the components."""
    share = F.pmod(F.xxhash64("raw"), F.lit(SHARES)) < max(1, int(SHARES * min(1.0, sample / size)))
    train = kinds.where(share if size > sample else F.lit(True)).select("raw").limit(sample).toArrow().column("raw").combine_chunks()
    if not len(train):
        train = kinds.select("raw").limit(1).toArrow().column("raw").combine_chunks()
    unit = _units(train, kind)
    model = Quantiser.train(unit, min(lists or max(1, min(int(size**0.5), -(-size // BLOCK))), LISTS), min(SUBSPACES, dim))
    check_broadcast(model.coarse.nbytes + model.books.nbytes, "the quantiser")
    quantiser = spark.sparkContext.broadcast(model)
    indexed = kinds.select("kind", "raw", "copies").mapInArrow(_indexed(quantiser, kind, _radius(threshold) / 2), "kind bigint, raw binary, copies bigint, home int, codes binary, left double, probes array<int>")
    indexed = scratch.keep(indexed, f"index-{dim}")
    held = indexed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = indexed.select(F.explode("probes").alias("home")).groupBy("home").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    shape = F.broadcast(scratch.keep(held.join(asked, "home"), f"shape-{dim}"))  # a row for each list, LISTS at most

    def dealt(of: str) -> Column:
        return F.pmod(F.xxhash64("kind"), F.col(of)).cast("int")

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    entries = (
        indexed.join(shape, "home")
        .select("home", dealt("blocks").alias("block"), each("chunks").alias("chunk"), F.lit(0).alias("side"), "kind", "copies", "raw", F.col("home").alias("own"), "codes", "left")
    )
    queries = (
        indexed.select("kind", "copies", "raw", F.col("home").alias("own"), F.explode("probes").alias("home"))
        .join(shape, "home")
        .select("home", each("blocks").alias("block"), dealt("chunks").alias("chunk"), F.lit(1).alias("side"), "kind", "copies", "raw", "own", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("left"))
    )
    met = entries.unionByName(queries).repartition("home", "block", "chunk").sortWithinPartitions("home", "block", "chunk", "side")
    return met.mapInArrow(_links(quantiser, kind, threshold), "a bigint, b bigint, n bigint")
