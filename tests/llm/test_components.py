"""Connected components against a search of small random graphs, in one go and with further links."""

from __future__ import annotations

import random

import pytest

from siftline.llm.components import connected_components, joined_components
from siftline.llm.work import Scratch

SCHEMA = "a bigint, b bigint"


def _searched(links: list[tuple]) -> dict[int, int]:
    """Nodes with the smallest node that they reach, but for those that reach none smaller."""
    near: dict[int, set[int]] = {}
    for a, b in links:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    least = {}
    for node in sorted(near):
        ahead = [] if node in least else [node]
        while ahead:
            other = ahead.pop()
            if other not in least:
                least[other] = node
                ahead += near[other]
    return {node: top for node, top in least.items() if node != top}


def _found(components) -> dict[int, int]:
    rows = components.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_random_links(spark, seed):
    drawn = random.Random(seed)
    links = [(drawn.randrange(60), drawn.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (5, None)]
    links += [(100 + i, 101 + i) for i in range(12)] + [(200, 201 + i) for i in range(12)]  # a path and a star
    more = [(drawn.randrange(60), drawn.randrange(60)) for _ in range(8)] + [(106, 205), (205, 106), (9, 9), (300, 301), (None, 1)]
    scratch = Scratch(spark, "test")
    first = connected_components(spark.createDataFrame(links, SCHEMA), scratch, "first")
    assert _found(first) == _searched(links)
    assert _found(joined_components(first, spark.createDataFrame(more, SCHEMA), scratch, "second")) == _searched(links + more)


def test_no_links(spark):
    scratch, none = Scratch(spark, "test"), spark.createDataFrame([], SCHEMA)
    first = connected_components(none, scratch, "first")
    assert _found(first) == {}
    assert _found(joined_components(first, none, scratch, "second")) == {}
    assert _found(joined_components(first, spark.createDataFrame([(2, 1)], SCHEMA), scratch, "third")) == {2: 1}
