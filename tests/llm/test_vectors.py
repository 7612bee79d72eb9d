"""Vector codes and centroid clusters against brute force in Python's integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from siftline.llm import centroid_clusters, vector_codes
from siftline.llm.integer_vectors import LARGEST

BAD = [(901, None), (902, []), (903, [1.0, None, 2.0, 3.0]), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [1.0] * 7), (907, [2.0 * LARGEST / 1024] * 8)]
SCHEMA = "vec_id bigint, embedding array<double>, label string, ints int, vec string, cluster string, rows int"


def ints(vector):
    return [math.floor(1024 * x) for x in vector]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(vector, entries):
    return min((apart(vector, e), i) for i, e in enumerate(entries))


def means(vectors, homes, entries):
    out = []
    for i, entry in enumerate(entries):
        own = [v for v, h in zip(vectors, homes, strict=True) if h == i]
        out.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else entry)
    return out


def made(seed=4, n=90, coarse=False):
    """Vectors with repeats; coarse ones lie on a grid, so that many distances tie."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-1, 2, (n, 8)) / (1 if coarse else 7.0) if coarse else rng.normal(size=(n, 8))
    vectors[5] = vectors[6] = vectors[70]
    return [[float(x) for x in v] for v in vectors]


def frame(spark, vectors):
    rows = [(i, v, None if i % 3 == 0 else f"l{i % 3}", 1, "x", "y", 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *((i, v, "bad", 1, "x", "y", 2) for i, v in BAD)], SCHEMA).repartition(5)


@pytest.mark.parametrize("coarse", [False, True])
@pytest.mark.parametrize("entries", [7, 256])
def test_codes(spark, coarse, entries):
    vectors = made(coarse=coarse)
    whole = [ints(v) for v in vectors]
    found = vector_codes.compress(frame(spark, vectors), parts=4, entries=entries, rounds=3)
    codes, errors, flat = [""] * len(whole), [0] * len(whole), []
    for part in range(4):
        own = [v[2 * part : 2 * part + 2] for v in whole]
        book = own[:entries]
        for _ in range(3):
            book = means(own, [nearest(v, book)[1] for v in own], book)
        for i, v in enumerate(own):
            far, home = nearest(v, book)
            codes[i] += f"{home:02x}"
            errors[i] += far
        flat += [x for entry in book for x in entry]
    of_label = {k: sum(e for i, e in enumerate(errors) if i % 3 == k) for k in range(3)}
    rows = {r["vec"]: (r["code"], r["error"], r["label_error"]) for r in found.rows.collect()}
    assert rows == {i: (codes[i], errors[i], of_label[i % 3]) for i in range(len(whole))}
    assert found.codebooks_sha256 == hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def test_tree_finds_the_lowest_of_equals():
    rng = np.random.default_rng(1)
    for n in (1, 3, 60, 256):
        entries = rng.integers(-3, 4, (n, 3))
        asked = rng.integers(-5, 6, (500, 3))
        home, far = vector_codes.KdTree.of(entries, leaf=4).nearest(asked)
        squares = ((asked[:, None] - entries[None]) ** 2).sum(2)
        assert (home == squares.argmin(1)).all() and (far == squares.min(1)).all()


def test_codes_of_odd_tables(spark):
    empty = vector_codes.compress(frame(spark, made()).where("false"))
    assert empty.rows.count() == 0 and empty.codebooks_sha256 == hashlib.sha256(b"").hexdigest()
    odd = spark.createDataFrame([(None, [1.0] * 6), (2, [0.5] * 6), (2, [-0.5] * 6)], "vec_id bigint, embedding array<float>")
    found = vector_codes.compress(odd, label_col=None, entries=2, rounds=1)
    # 6 components are cut into 2 + 2 + 2 + 0 and padding; the id's two vectors are the seeds, smaller components first
    assert sorted((r["vec"] or -1, r["code"], r["error"]) for r in found.rows.collect()) == [(-1, "01010100", 256**2 * 6), (2, "00000000", 0), (2, "01010100", 256**2 * 6)]
    assert {r["label_error"] for r in found.rows.collect()} == {2 * 256**2 * 6}
    with pytest.raises(ValueError):
        vector_codes.compress(odd, entries=257)


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_KEYS", 2)
    found = vector_codes.compress(frame(spark, made()), entries=5, rounds=1).rows.collect()
    sums = {}
    for r in found:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert len(found) == 90 and all(r["label_error"] == sums[r["label"]] for r in found)


@pytest.mark.parametrize("coarse", [False, True])
def test_clusters(spark, coarse):
    vectors = made(9, 200, coarse)
    whole = [ints(v) for v in vectors]
    order = sorted(range(len(whole)), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [whole[i] for i in order[:8]]
    for _ in range(10):
        centres = means(whole, [nearest(v, centres)[1] for v in whole], centres)
    final = [nearest(v, centres) for v in whole]
    inertia = [sum(far for far, home in final if home == c) for c in range(8)]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    found = centroid_clusters.cluster(frame(spark, vectors), width=8)
    rows = {r["vec"]: tuple(r)[1:] for r in found.rows.collect()}
    assert rows == {i: (home, far, inertia[home], sum(inertia), hashes[home]) for i, (far, home) in enumerate(final)}
    assert found.computed[0] == 8 * 200 and sum(found.computed[1:]) < 8 * 200 * 10 / 2  # bounds save most distances


def test_clusters_of_odd_tables(spark):
    assert centroid_clusters.cluster(frame(spark, made()).where("false"), width=8).rows.count() == 0
    few = spark.createDataFrame([(None, [1.0]), (7, [1.0]), (7, [3.0]), (8, [1.0])], "vec_id bigint, embedding array<float>")
    rows = centroid_clusters.cluster(few, width=1, clusters=9, rounds=3).rows.collect()
    assert sorted((r["vec"] or -1, r["distance"], r["inertia"]) for r in rows) == [(-1, 0, 0), (7, 0, 0), (7, 0, 0), (8, 0, 0)]
    assert len({r["cluster"] for r in rows}) == 2  # of equal centroids the first has all rows
