"""Heads with many unlike passages."""

from __future__ import annotations

from siftline.llm import substring_dedup


def test_a_head_of_many_passages_is_not_listed_by_windows(spark, monkeypatch):
    """300 passages with one rare head and unlike ends meet in one automaton."""
    listed = []
    kept = substring_dedup.window_rows
    monkeypatch.setattr(substring_dedup, "window_rows", lambda found, grain: listed.append(found.count()) or kept(found, grain))
    head = " ".join(f"h{i}" for i in range(20))
    rows = [(i, f"{head} " + " ".join(f"x{i}-{k}" for k in range(20))) for i in range(300)]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["n_removed"]) for r in found.collect()} == {(i, 20 if i else 0) for i in range(300)}
    assert listed == [0]
