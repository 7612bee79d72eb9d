"""Each stage of the pipeline on a small corpus, against what brute force keeps."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"


def prose(seed: int, words: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(words))


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], COLUMNS)


def kept(df):
    assert df.columns == list(pipeline.COLUMNS)
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_near_duplicates(spark):
    a, b, c = prose(1), prose(2), prose(3)
    near = a.rsplit(" ", 2)[0] + " other end"
    rows = [(5, a), (2, near), (9, a), (5, b), (5, b), (7, b), (3, None), (4, ""), (None, c), (None, c), (None, a), (None, prose(4))]
    assert kept(pipeline.unlike(spark, made(spark, rows), "")) == sorted(
        [(2, near), (5, b), (3, None), (4, ""), (None, c), (None, prose(4))], key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    )


def test_repeats(spark):
    shared = prose(9, 30)
    rows = [(1, prose(1) + " " + shared), (2, shared + " " + prose(2)), (2, prose(5)), (None, prose(6)), (3, None)]
    found = kept(pipeline.without_repeats(spark, made(spark, rows), ""))
    assert found == [(1, rows[0][1]), (2, prose(2)), (2, prose(5)), (3, ""), (None, prose(6))] or found == [(1, rows[0][1]), (2, prose(5)), (2, prose(2)), (3, ""), (None, prose(6))]


def test_decontamination(spark, tmp_path):
    spark.createDataFrame([(1, prose(20, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, prose(1)), (2, prose(2) + " " + prose(20, 30)), (None, prose(20, 30)), (None, prose(3)), (4, None), (5, prose(20, 30)), (5, prose(7))]
    assert kept(pipeline.uncontaminated(spark, made(spark, rows), str(tmp_path))) == [(1, prose(1)), (4, None), (5, prose(7)), (None, prose(3))]


def test_languages(spark):
    rng = random.Random(1)
    said = {"en": "the house of water and fire", "fr": "la maison de leau et du feu"}
    rows = [(i, " ".join(rng.choices(said[lang].split(), k=8)), lang, "s", 1, 1) for i, lang in enumerate(["en", "fr"] * 20)]
    rows += [(90, "the water", None, "s", 1, 1), (91, "12 !?", "en", "s", 1, 1), (92, None, None, "s", 1, 1)]
    found = pipeline.identified(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert {r["doc_id"]: r["lang"] for r in found} == {i: lang for i, _, lang, *_ in rows[:40]} | {90: "en"}


def test_encoding(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows = [(1, prose(1)), (2, None), (3, "Don't  stop"), (None, "x" * 3000)]
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in pipeline.encoded(spark, made(spark, rows), "").collect()}
    assert found == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_empty(spark, tmp_path, stage):
    spark.createDataFrame([], "item_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, spark.createDataFrame([], COLUMNS), str(tmp_path)).count() == 0
