"""Documents inside each other's windows that are not linked: no pairs of them are written, links are."""

from __future__ import annotations

import random

import pytest

from siftline.llm import jaccard_join as jaccard
from siftline.llm.work import Scratch


@pytest.mark.parametrize("block_shingles", [jaccard.BLOCK_SHINGLES, 40_000])
def test_rows_of_crowded_regions_stay_linear(spark, monkeypatch, block_shingles):
    """150 texts at 0.87 of each other, each with a near copy: only the copies are linked."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block_shingles)
    written = {}
    kept = Scratch.keep

    def keep(self, df, name, *partition_by):
        out = kept(self, df, name, *partition_by)
        written[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    draw = random.Random(5)
    base = ["".join(draw.choices("abcdefgh", k=draw.randint(3, 9))) for _ in range(1000)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in draw.sample(range(1000), 12):
            words[at] = f"x{i}y{at}"
        rows.append((2 * i, " ".join(words)))
        words[draw.randrange(1000)] = f"z{i}"
        rows.append((2 * i + 1, " ".join(words)))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(i, i - i % 2) for i in range(300)}
    grown = {name: n for name, n in written.items() if name.startswith(("third", "fourth")) and not name.endswith("mixed")}
    assert max(grown.values()) <= 300 * jaccard.KNOWN_REGIONS, grown
