"""Pairs that leave the regions of the Jaccard join: each once, and few of two components before all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import jaccard_join as jaccard


def blocks(docs: int, pivots: range, component) -> list[pa.RecordBatch]:
    """Every document in the regions of all pivots."""
    known = np.array(sorted(pivots)[: jaccard.KNOWN_REGIONS], np.int64).tobytes()
    rows = [{"block": p, "doc": d, "n": 100, "component": component(d), "side": -1, "classes": bytes(jaccard.CLASSES), "pivot": p, "regions": known} for p in pivots for d in range(docs)]
    kinds = [("block", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("side", pa.int32()), ("classes", pa.binary()), ("pivot", pa.int64()), ("regions", pa.binary())]
    return pa.Table.from_pylist(rows, pa.schema(kinds)).to_batches()


def given(batches, most=None):
    return [pair for out in jaccard._region_pairs(jaccard.Similarity(), most)(iter(batches)) for pair in zip(*(c.to_pylist() for c in out.columns), strict=True)]


@pytest.mark.parametrize("pivots", [range(3), range(-20, 60)])
def test_a_pair_leaves_one_region(pivots):
    pairs = given(blocks(12, pivots, lambda d: d))
    assert len(pairs) == 12 * 11 // 2 == len({frozenset(p) for p in pairs})


def test_few_pairs_of_two_components_first():
    made = blocks(400, range(2), lambda d: d % 40 and 1)
    some, every = given(made, jaccard.TRIED), given(made)
    assert len(every) == 10 * 390 and len(some) == jaccard.TRIED and set(some) <= set(every)
    kinds = np.array([[1, 2]] * 20 + [[1, 3]] * 3 + [[2, 3]] * 9)
    assert np.unique(kinds[jaccard._some_of_each(kinds, 8)], axis=0, return_counts=True)[1].tolist() == [8, 3, 8]
