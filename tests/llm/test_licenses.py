"""License scans against a plain search, and notices that are cut or edited."""

from __future__ import annotations

import random
import re

import pytest

from siftline.llm import license_scan
from siftline.llm.license_scan import Template

SCHEMA = "doc_id bigint, text string, label string, word int, places string"
MIT = next(t for t in license_scan.NOTICES if t.label == "mit").text


def scanned(spark, texts, **more):
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()}


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hits = [(at, t.label) for t in license_scan.BASE for at in range(len(words)) if words[at : at + len(t.words)] == t.words]
    return len(words), sorted(hits)


def test_base_places(spark):
    rng = random.Random(8)
    said = "gnu General public LICENSE apache cc-by CC by mit É ΣΑΣ İ , . \n x2 license".split(" ")
    texts = [" ".join(rng.choices(said, k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "MIT License", "mit\x00license", "mitlicense", "the mit license " * 40_000, "MIT License"]
    found = scanned(spark, texts)
    for i, text in enumerate(texts):
        hits = sorted((p["word"], p["label"]) for p in found[i]["places"] if p["base"])
        assert (found[i]["n_words"], hits) == plain(text)


def test_notices(spark):
    edited = MIT.replace("free of charge", "at no cost and free of any charge").replace("any person", "anyone")
    texts = [f"x y {MIT.upper()} z", f"x {edited}", MIT.replace("obtaining a copy of", "having"), "a copy of this software is granted to any person", "Licensed under the Apache License, Version 2.0.", "Redistribution and use in source and binary forms"]
    found = scanned(spark, texts)
    labels = {i: sorted({p["label"] for p in r["places"]}) for i, r in found.items()}
    assert labels == {0: ["mit"], 1: ["mit"], 2: [], 3: [], 4: ["apache", "apache-2.0"], 5: []}
    assert [(p["word"], p["share"]) for p in found[0]["places"]] == [(2, 1.0)] and all(0 < p["share"] < 1 for p in found[1]["places"])


def test_rare_words_come_from_all_texts(spark):
    own = (Template("odd", "alpha beta gamma", ("beta gamma",), rare=1, agree=1),)
    texts = ["alpha beta gamma", "beta gamma", "alpha", "alpha"]
    # "beta" and "gamma" are in two texts, "alpha" in three: the listed word is "beta", so a text that was cut is found, too
    assert {i: len(r["places"]) for i, r in scanned(spark, texts, templates=own).items()} == {0: 1, 1: 1, 2: 0, 3: 0}
    with pytest.raises(ValueError):
        scanned(spark, texts, templates=())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "MIT License"), (1, "MIT License"), (1, "MIT License"), (1, None)], "doc_id int, text string")
    rows = license_scan.scan_licenses(docs)
    assert sorted((r["doc_id"] or 0, len(r["places"])) for r in rows.collect()) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert license_scan.scan_licenses(docs.where("false")).count() == 0
