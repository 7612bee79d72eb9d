"""N-gram Jaccard join in the metric space of shingle sets, and its components.

Distance is ``1 - Jaccard``, a metric.  Documents are unlike almost all others (distance near 1), so whole documents
make poor pivots.  Pivots are single shingles and fixed classes of shingles:

* *Regions.*  Each shingle is a pivot, and a document lies nearest to the pivots it contains.  With any order over
  pivots, two documents within the threshold share one of the first ``size - needed + 1`` pivots of each.  So a
  document is replicated to the regions of those boundary pivots only, and the join by region is exact.  Pivots come
  rarest first: long shingles before short ones, and behind all others the ``HOT_KEYS`` at most that a first scan finds
  in more than a ``HOT_KEYS``-th of all places.  Any order gives the same result.
* *Windows.*  All shingles fall into ``CLASSES`` classes by hash.  The counts of a document in the classes are its
  symmetric-difference distances to those pivot sets but for constants.  By the triangle inequality, the counts of two
  linked documents differ in sum by at most ``(1 - t) / (1 + t)`` of their sizes; and their sizes by a factor ``t``.
* *Recursion.*  A region's smallest document is joined with all its members; members that are then in one component
  need no further comparison.  Regions with several components recur with another pivot document, and what is left is
  compared pair by pair inside tasks, block by block, leaving out pairs that are known to meet in an earlier region as
  well: near pairs share many pivots.  Pairs never become rows there: a block first tells which of its documents are in a
  pair inside the windows, gets windows of ``FINE_CLASSES`` for those and tells again, gets whole sets for those left, and
  then gives only links that join components of the block, fewer than it has documents.  A first pass takes the documents of ``TRIED`` pairs of any two components of a block, which
  link most of what belongs together; the second those of all pairs still apart.

Equal sets are collapsed before, so copies cost one row each.  Pairs of a document and a seat that are inside the windows
go through windows of ``FINE_CLASSES`` classes, which tell long documents apart, and are then checked on whole sets,
which are made for the documents of those pairs alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols
from .components import connected_components, joined_components
from .repeats import clustered, documents, same_document
from .work import HOT_KEYS, Scratch, met_by_key

CLASSES = 64
#: Classes of the second window, through which pairs go before whole sets are made; enough for sets of 20,000 shingles.
FINE_CLASSES = 1024
#: A pivot in fewer documents is never moved back.
LARGE_REGION = 48
BLOCK = 2048
#: Shingles of a block's documents, on average, so that their sets fit a task; a longer document has a block of its own.
BLOCK_SHINGLES = 2_000_000
#: Shingles that are looked up at once.
_LOOKED_UP = 2_000_000
#: Regions of a document, the first in order, by which pairs that met in an earlier region are told.
KNOWN_REGIONS = 16
#: Pairs of two components that a block gives first, before all that are still unlinked.
TRIED = 8


@dataclass(frozen=True)
class Similarity:
    """Links hold where ``den * |A & B| >= num * |A | B|`` over shingles of ``words`` words."""

    words: int = 3
    num: int = 90
    den: int = 100

    def __post_init__(self):
        if not (self.words >= 1 and 0 < self.num <= self.den):
            raise ValueError(f"bad similarity: {self}")

    def boundary(self, size: np.ndarray) -> np.ndarray:
        """How many pivots of a set of ``size`` shingles lie on its boundary."""
        return size - -(-self.num * size // self.den) + 1

    def near(self, n_a, n_b, gap):
        """Whether sizes and the summed difference of class counts allow a link."""
        small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
        return (self.den * small >= self.num * large) & (gap * (self.den + self.num) <= (self.den - self.num) * (n_a + n_b))


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int, keyed: textcols.Prints):
    """(row, fingerprint, letters) of each shingle; a shorter row is one shingle, one without words has none."""
    found = textcols.words(data, offsets, keyed, lower=True)
    counts = np.diff(found.first)
    full = np.maximum(counts - words + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), full)
    begin = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full) + np.repeat(found.first[:-1], full)
    end = np.minimum(begin + words, found.first[1:][row])
    prints = found.code[begin]
    for k in range(1, words):
        longer = np.flatnonzero(begin + k < end)
        prints[longer] = keyed.join(prints[longer], found.code[begin[longer] + k])
    letters = np.append(0, np.cumsum(found.end - found.start))
    return row, prints, letters[end] - letters[begin]


def _ordered(row, prints, letters, moved_back: np.ndarray):
    """Distinct shingles of each row in the global order of pivots: (row, fingerprint)."""
    at = np.searchsorted(moved_back, prints)
    back = moved_back[np.minimum(at, len(moved_back) - 1)] == prints if len(moved_back) else np.zeros(len(prints), bool)
    short = np.uint64(63) - np.minimum(letters, 63).astype(np.uint64)
    key = (back.astype(np.uint64) << np.uint64(63)) | np.where(back, np.uint64(0), short << np.uint64(57)) | (prints >> np.uint64(7))
    order = np.lexsort((prints, key, row))
    row, prints = row[order], prints[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])
    return row[new], prints[new]


SKETCH_SCHEMA = "doc bigint, tag bigint, n bigint, f1 bigint, f2 bigint, classes binary, pivots array<bigint>"


def _sketch(like: Similarity, moved_back, keyed: textcols.Prints):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textcols.slices(batch.column(2)):
                row, prints = _ordered(*_shingles(data, offsets, like.words, keyed), moved_back.value)
                rows = b - a
                size = np.bincount(row, minlength=rows)
                begin = np.cumsum(size) - size
                f1, f2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                np.add.at(f1, row, prints)
                np.add.at(f2, row, textcols.mix(prints ^ np.uint64(0x5851F42D4C957F2D)))
                taken = np.where(size > 0, like.boundary(size), 0)
                first = np.arange(len(row)) - begin[row] < taken[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, rows),
                        batch.column(1).slice(a, rows),
                        pa.array(size),
                        pa.array(f1.view(np.int64)),
                        pa.array(f2.view(np.int64)),
                        _class_counts(row, prints, rows, CLASSES),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(taken)).astype(np.int32)), pa.array(prints[first].view(np.int64))),
                    ],
                    names=["doc", "tag", "n", "f1", "f2", "classes", "pivots"],
                )

    return sketch


def _class_counts(row: np.ndarray, prints: np.ndarray, rows: int, classes: int) -> pa.Array:
    """How many shingles of each row are in each class, up to 255, as bytes."""
    counts = np.bincount(row * classes + (prints % np.uint64(classes)).astype(np.int64), minlength=rows * classes)
    counts = np.minimum(counts, 255).astype(np.uint8)
    return pa.array([counts[i : i + classes].tobytes() for i in range(0, len(counts), classes)], pa.binary())


def _fine_windows(words: int, keyed: textcols.Prints):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textcols.slices(batch.column(1)):
                row, prints = _ordered(*_shingles(data, offsets, words, keyed), np.zeros(0, np.uint64))
                size = pa.array(np.bincount(row, minlength=b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), size, _class_counts(row, prints, b - a, FINE_CLASSES)], names=["doc", "n", "classes"])

    return windows


def _sets(words: int, keyed: textcols.Prints):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textcols.slices(batch.column(1)):
                row, prints = _ordered(*_shingles(data, offsets, words, keyed), np.zeros(0, np.uint64))
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=b - a))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(prints.view(np.int64)))],
                    names=["doc", "shingles"],
                )

    return sets


def _gap(left: list[bytes], right: list[bytes]) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(side), np.uint8).reshape(len(left), -1).astype(np.int16) for side in (left, right))
    return np.abs(x - y).sum(axis=1, dtype=np.int64)


def _inside_windows(like: Similarity):
    """Keeps pairs that the windows allow: columns a, b, n_a, n_b, classes_a, classes_b."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                near = like.near(batch.column(2).to_numpy(), batch.column(3).to_numpy(), _gap(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return keep


def _padded(regions: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of each row, the last repeated up to ``KNOWN_REGIONS``, and how many there are."""
    told = np.array([len(r) // 8 for r in regions], np.int64)
    width = 8 * KNOWN_REGIONS
    filled = b"".join(r + r[-8:] * ((width - len(r)) // 8) for r in regions)
    return np.frombuffer(filled, np.int64).reshape(-1, KNOWN_REGIONS), told


def _listed_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of numbers as bytes: columns doc, regions."""
    for batch in batches:
        packed = [np.array(r, np.int64).tobytes() for r in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "regions"])


def _some_of_each(kinds: np.ndarray, most: int) -> np.ndarray:
    """Places of up to ``most`` rows of each kind (a row of numbers), spread over all of it."""
    mixed = np.random.default_rng(0).permutation(len(kinds))
    order = mixed[np.lexsort(kinds[mixed].T)]
    new = np.append(True, (kinds[order[1:]] != kinds[order[:-1]]).any(axis=1))
    start = np.flatnonzero(new)
    nth = np.arange(len(order)) - start[np.cumsum(new) - 1]
    return order[nth < most]


class _Sets:
    """Whole sets of a block's documents, numbered within the block."""

    def __init__(self, sets: pa.ListArray):
        self.start = sets.offsets.to_numpy().astype(np.int64)
        self.start -= self.start[0]
        self.size = np.diff(self.start)
        prints, self.code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        self.held = np.zeros(len(prints), bool)

    def shared(self, i: int, j: np.ndarray) -> np.ndarray:
        """How many shingles document ``i`` shares with each of ``j``."""
        mine = self.code[self.start[i] : self.start[i + 1]]
        self.held[mine] = True
        parts, ends = [np.zeros(0, np.int64)], np.cumsum(self.size[j])
        for part in np.split(j, np.flatnonzero(np.diff(ends // _LOOKED_UP)) + 1):
            size = self.size[part]
            first = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(self.start[part] - first, size)
            parts.append(np.add.reduceat(self.held[self.code[at]], first, dtype=np.int64))
        self.held[mine] = False
        return np.concatenate(parts)


def _inside(like: Similarity, classes: np.ndarray, n: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """Whether the class counts of row ``i`` and each of ``j`` allow a link."""
    gap = np.abs(classes[j].astype(np.int16) - classes[i]).sum(axis=1, dtype=np.int64)
    return like.near(n[j], n[i], gap)


def _met(like: Similarity, table: pa.Table, most: int | None = None) -> np.ndarray:
    """Places in ``table`` of the pairs that ``_region_pairs`` gives."""
    block = table.column("block").to_numpy()
    n, component, side = (table.column(c).to_numpy() for c in ("n", "component", "side"))
    component = component.copy()
    windows = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(len(block), -1) for c in ("classes", "fine") if c in table.column_names]
    pivot, (known, told) = table.column("pivot").to_numpy(), _padded(table.column("regions").to_pylist())
    sets = table.column("shingles").combine_chunks() if "shingles" in table.column_names else None
    edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
    out = [np.zeros((0, 2), np.int64)]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        found = [np.zeros((0, 2), np.int64)]
        whole = None if sets is None else _Sets(sets.slice(lo, hi - lo))
        for i in range(lo, hi - 1):
            stop = lo + int(np.searchsorted(n[lo:hi], like.den * n[i] // like.num, side="right"))
            j = np.arange(i + 1, stop)
            j = j[(component[j] != component[i]) & ((side[j] != side[i]) | (side[i] < 0))]
            j = j[_inside(like, windows[0], n, i, j)]
            for earlier in known[i, : told[i]].tolist():
                if earlier >= pivot[i] or not len(j):
                    break
                j = j[~((known[j] == earlier).any(axis=1))]
            for fine in windows[1:]:
                j = j[_inside(like, fine, n, i, j)]
            if whole and len(j):
                both = whole.shared(i - lo, j - lo)
                j = j[both * like.den >= (n[i] + n[j] - both) * like.num]
                others, first = np.unique(component[j], return_index=True)
                j = j[first]
                component[lo:hi][np.isin(component[lo:hi], others)] = component[i]
            if len(j):
                found.append(np.column_stack([np.full(len(j), i), j]))
        met = np.concatenate(found)
        if most and len(met) > most:
            met = met[_some_of_each(np.sort(component[met], axis=1), most)]
        out.append(met)
    return np.concatenate(out)


def _region_pairs(like: Similarity, most: int | None = None):
    """Pairs inside the windows of each block of a region: columns block, doc, n, component, side, classes, pivot, regions.

    ``regions`` are the first ``KNOWN_REGIONS`` pivots of a document in order of their numbers, as bytes.  A pair with a
    smaller pivot than the block's in both lists meets there, so it is left out here; no pair is left out of its first region.
    With ``most``, no more than so many pairs of any two components leave a block.  With a column ``fine`` of finer class
    counts, pairs must be inside those as well.  With a column ``shingles`` of whole sets, only links are given, and of
    those that join the same components of a block one.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in clustered(batches, 64):  # few, because sets are large
            met, doc = _met(like, table, most), table.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(doc[met[:, 0]], pa.int64()), pa.array(doc[met[:, 1]], pa.int64())], names=["a", "b"])

    return pairs


def _paired(like: Similarity, most: int | None):
    """The rows of each block that are in one of its pairs, or of ``most`` pairs of any two components, without ``fine``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in clustered(batches, BLOCK):
            kept = table.select([c for c in table.column_names if c != "fine"])
            yield from kept.take(pa.array(np.unique(_met(like, table, most)))).to_batches()

    return rows


def _with_copies(pairs: DataFrame, table: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """Rows of ``table(doc, ...)`` for the documents in column ``b`` of ``pairs``, with the number of those pairs."""
    asked = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("asked"))
    return scratch.keep(asked.join(table.withColumnRenamed("doc", "b"), "b"), name)


def _pivot_counts(source: DataFrame, like: Similarity, keyed: textcols.Prints, large_region: int) -> DataFrame:
    """``(pivot, docs)`` of pivots that lie on the boundary of more than ``large_region`` documents."""
    nothing = source.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64))
    pivots = source.mapInArrow(_sketch(like, nothing, keyed), SKETCH_SCHEMA).select(F.explode("pivots").alias("pivot"))
    return pivots.groupBy("pivot").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > large_region)


def _hot_pivots(counted: DataFrame) -> np.ndarray:
    """Pivots with more than a ``HOT_KEYS``-th of all counts, so fewer than ``HOT_KEYS``."""
    total = counted.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first()["n"]
    hot = counted.where(F.col("docs") > total // HOT_KEYS).toArrow().column("pivot").to_numpy()
    return np.unique(hot.astype(np.int64).view(np.uint64))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Similarity = Similarity(), large_region: int = LARGE_REGION) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id``, the smallest id reachable by links, and ``text_hash``.

    Words are lower-cased (A-Z) runs without ASCII white space.  A text with fewer words than a shingle is one shingle
    of all its words.  Null and empty texts have no shingles and are linked with nothing.  A row given twice has two
    equal sets, which are linked.  Rows that share an id (null, too) with unlike texts are documents of their own.  A
    component without an id has null.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    source = documents(docs, id_col, text_col)
    keyed = textcols.Prints(textcols.draw_seed())
    counted = scratch.keep(_pivot_counts(source, like, keyed, large_region), "counted")
    hot = spark.sparkContext.broadcast(_hot_pivots(counted))
    scratch.drop("counted")
    sketched = scratch.keep(source.mapInArrow(_sketch(like, hot, keyed), SKETCH_SCHEMA), "sketches")
    # equal sets are one kind; the number that it gets is written with it
    row = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "tag")).alias("row")
    kinds = sketched.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("id"), row, F.first("classes").alias("classes"), F.first("pivots").alias("pivots"))
    kinds = scratch.keep(kinds.withColumn("doc", F.monotonically_increasing_id()), "kinds")
    sketched = scratch.keep(sketched.select("doc", "tag", "n", "f1", "f2"), "rows")
    scratch.drop("sketches")
    entries = kinds.select(F.explode("pivots").alias("pivot"), "doc", "n")
    regions = scratch.keep(entries.groupBy("pivot").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("seat")).where("docs >= 2"), "regions")
    members = scratch.keep(met_by_key(entries, regions, "pivot", "docs", ("doc",)).select("pivot", "doc", "n", "seat"), "members")
    kinds = scratch.keep(kinds.drop("pivots"), "shapes")
    shapes = kinds.select("doc", "n", "classes")
    scratch.drop("kinds", "regions")  # and lets go of the shuffles so far, as below

    def made_of(involved: DataFrame, make, schema: str, name: str) -> DataFrame:
        """What ``make`` makes of the texts of all kinds ``involved(doc)``: one row for each."""
        asked = kinds.join(involved, "doc").select(F.col("doc").alias("kind"), "row.doc", "row.tag")
        texts = source.alias("s").join(asked.alias("k"), same_document("s", "k")).select(F.col("kind").alias("doc"), "text").mapInArrow(make, schema)
        columns = [c for c in texts.columns if c != "doc"]
        return scratch.keep(texts.groupBy("doc").agg(*(F.first(c).alias(c) for c in columns)), name)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()

    def windowed(pairs: DataFrame, shapes: DataFrame, name: str) -> DataFrame:
        """Pairs ``(a, b)`` that the windows of their ``shapes(doc, n, classes)`` allow."""
        a, b = (shapes.select(F.col("doc"), F.col("n").alias(f"n_{x}"), F.col("classes").alias(f"classes_{x}")) for x in "ab")
        met = met_by_key(pairs, _with_copies(pairs, b, f"{name}-right", scratch), "b", "asked", ("a",)).join(a.withColumnRenamed("doc", "a"), "a")
        near = scratch.keep(met.select("a", "b", "n_a", "n_b", "classes_a", "classes_b").mapInArrow(_inside_windows(like), "a bigint, b bigint"), f"{name}-near")
        scratch.drop(f"{name}-right")
        return near

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs ``(a, b)`` whose whole sets are within the threshold."""
        pairs = scratch.keep(pairs, f"{name}-pairs")
        fine = made_of(ends(pairs), _fine_windows(like.words, keyed), "doc bigint, n bigint, classes binary", f"{name}-fine")
        pairs = windowed(pairs, fine, f"{name}-fine")
        scratch.drop(f"{name}-fine", f"{name}-pairs")
        sets = made_of(ends(pairs), _sets(like.words, keyed), "doc bigint, shingles array<bigint>", f"{name}-sets")
        right = _with_copies(pairs, sets.withColumnRenamed("shingles", "y"), f"{name}-right", scratch)
        met = met_by_key(pairs, right, "b", "asked", ("a",)).join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
        both = F.size(F.array_intersect("x", "y")).cast("bigint")
        union = F.size("x") + F.size("y") - both
        linked = scratch.keep(met.where(both * like.den >= union * like.num).select("a", "b"), f"{name}-linked")
        scratch.drop(*(f"{name}-{x}" for x in ("fine-near", "sets", "right")))
        return linked

    def seated(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.keep(pairs.where("a <> b").distinct(), f"{name}-asked")
        return verified(windowed(pairs, shapes, name), name)

    def labelled(components: DataFrame) -> DataFrame:
        """Members of regions that still hold several components."""
        named = members.join(components, members.doc == components.node, "left").select("pivot", "doc", "n", F.coalesce("component", "doc").alias("component"))
        sizes = F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")
        mixed = named.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), *sizes).where("low <> high")
        return named.join(mixed, "pivot")

    links = seated(members.select(F.col("doc").alias("a"), F.col("seat").alias("b")), "first")
    scratch.drop()
    components = connected_components(links, scratch, "components-0")
    # recursion: another seat for the regions that are not yet one component, from the component that is last in order
    left = scratch.keep(labelled(components), "left")
    seats = left.where("component = high").groupBy("pivot").agg(F.min("doc").alias("seat"))
    more_links = seated(left.where("component <> high").join(seats, "pivot").select(F.col("doc").alias("a"), F.col("seat").alias("b")), "second")
    components = joined_components(components, more_links, scratch, "components-1")
    scratch.drop("left", "first-linked", "second-linked")

    def linked_in_blocks(components: DataFrame, name: str, most: int | None) -> DataFrame:
        """Links between unlike components that meet in a block of a region, as many as join them within the block."""
        mixed = scratch.keep(labelled(components), f"{name}-mixed")
        regions = mixed.groupBy("doc").agg(F.slice(F.array_sort(F.collect_set("pivot")), 1, KNOWN_REGIONS).alias("regions"))
        left = mixed.drop("n").join(shapes.join(regions.mapInArrow(_listed_regions, "doc bigint, regions binary"), "doc"), "doc")
        blocks = F.ceil(F.greatest(F.col("docs") / BLOCK, F.least("docs", F.col("shingles") / BLOCK_SHINGLES))).cast("int")
        mine = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
        dealt = (
            left.withColumn("blocks", blocks)
            .withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                F.xxhash64("pivot", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"),
                "doc",
                "n",
                "component",
                F.when(F.col("mine") == F.col("other"), -1 - F.col("mine")).otherwise(F.col("mine")).alias("side"),
                "classes",
                "pivot",
                "regions",
            )
        )

        def by_block(rows: DataFrame) -> DataFrame:
            return rows.select("block", *(c for c in rows.columns if c != "block")).repartition("block").sortWithinPartitions("block", "n")

        paired = scratch.keep(by_block(dealt).mapInArrow(_paired(like, most), dealt.schema), f"{name}-paired")
        fine = made_of(paired.select("doc").distinct(), _fine_windows(like.words, keyed), "doc bigint, n bigint, classes binary", f"{name}-fine")
        closer = by_block(paired.join(fine.select("doc", F.col("classes").alias("fine")), "doc")).mapInArrow(_paired(like, None), dealt.schema)
        closer = scratch.keep(closer, f"{name}-closer")
        scratch.drop(f"{name}-mixed", f"{name}-paired", f"{name}-fine")
        sets = made_of(closer.select("doc").distinct(), _sets(like.words, keyed), "doc bigint, shingles array<bigint>", f"{name}-sets")
        linked = scratch.keep(by_block(closer.join(sets, "doc")).mapInArrow(_region_pairs(like), "a bigint, b bigint"), f"{name}-linked")
        scratch.drop(f"{name}-closer", f"{name}-sets")
        return linked

    more_links = linked_in_blocks(components, "third", TRIED)
    components = joined_components(components, more_links, scratch, "components-2")
    scratch.drop("third-linked")
    more_links = linked_in_blocks(components, "fourth", None)
    scratch.drop("members")
    components = joined_components(components, more_links, scratch, "components-3")
    joined = kinds.join(components, kinds.doc == components.node, "left").select("n", "f1", "f2", "id", F.coalesce("component", "doc").alias("component"))
    least = joined.groupBy("component").agg(F.min("id").alias("least"))
    named = joined.join(least, "component").select("n", "f1", "f2", "least")
    return (
        sketched.join(named, ["n", "f1", "f2"], "left")
        .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("component_id"), F.col("tag").alias("text_hash"))
    )
