"""The training-data operators against brute force, with nulls, empty texts, repeats, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftline.llm import chat_format, decontamination, embedding_dedup, jaccard_join, language_id, line_quality, queries, substring_dedup, suffix_dedup, toxicity, word_bpe
from siftline.llm.queries import CONTROL

DOCS = "doc_id bigint, text string, doc string, key int"


def texts(seed=3, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    shared = " ".join(rng.choices(words, k=60))
    out = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(n)]
    for i in range(0, n, 4):
        out[i] += " " + shared[rng.randint(0, 40) :]
    return [*out, out[0], out[1] + " end", "", None, "x", "ab " * 300]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts())], DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("limit", [4096, 0])
def test_suffix_dedup(docs, limit):
    raw = [(t or "").encode() for t in texts()]
    seen = Counter(x[k : k + 200] for x in raw for k in range(len(x) - 199))
    found = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs, shard_limit=limit).collect()}
    for i, x in enumerate(raw):
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert (found[i]["n_removed"], bytes(found[i]["kept"])) == (gone.sum(), bytes(b for b, g in zip(x, gone, strict=True) if not g))


@pytest.mark.parametrize("limit", [4096, 0])
def test_substring_dedup(docs, limit):
    seen, found = set(), {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, shard_limit=limit).collect()}
    for i, t in enumerate(texts()):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (found[i]["n_removed"], found[i]["kept_sha256"]) == (sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("words", [3, 5])
def test_jaccard(docs, words):
    sets = []
    for t in texts():
        w = (t or "").split()
        sets.append({tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, min(len(w), 1)))})
    name = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    name[i] = name[j] = min(name[i], name[j])
    found = jaccard_join.jaccard_components(docs, like=jaccard_join.Similarity(words, 80, 100), large_region=4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == {i: (len(s), name[i]) for i, s in enumerate(sets)}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [*base, *(base[:20] + 0.05 * rng.normal(size=(20, 16))), *([base[0]] * 5), base[0] * 3]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [None] * 16), (904, [float("nan")] * 16), (905, [1.0, 2.0])]
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()}
    unit = np.stack(rows) / np.linalg.norm(rows, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    assert [found[i]["n_links"] for i in range(len(rows))] == (linked.sum(1) - 1).tolist()
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(900, 906))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("lists", [None, 40])
def test_embeddings_of_low_rank(spark, lists):
    rng = np.random.default_rng(5)
    basis, n = rng.normal(size=(8, 64)), 700
    base, moved = rng.normal(size=(n, 8)) @ basis, rng.normal(size=(n, 8)) @ basis
    near = base / np.linalg.norm(base, axis=1, keepdims=True) + 0.31 * moved / np.linalg.norm(moved, axis=1, keepdims=True)
    vectors = np.concatenate([base, near, base[:20], near[:5]]) + 0.0
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = unit @ unit.T
    assert np.abs(cosine - 0.95).min() > 1e-9
    wanted = (cosine >= 0.95).sum(1) - 1
    data = [(i, x.tolist()) for i, x in enumerate(vectors)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), lists=lists).collect()
    assert {r["vec_id"]: r["n_links"] for r in found} == dict(enumerate(wanted))


def test_chats(spark):
    parts = f"conv_id bigint, turn int, role string, parts array<{chat_format.PART}>, place int"
    image = ("image", None, "s3://a.png", 56, 29, None, None)
    data = [(1, 1, "assistant", [("text", "<|im_end|> <||x", None, None, None, None, None)], 0), (1, 0, "us\ner", [("text", CONTROL, None, None, None, None, None), image], 0), (1, 2, None, None, 0), (None, 0, "user", [], 0)]
    found = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(data, parts))).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [("us\ner", CONTROL + "<|image|>"), ("assistant", "<|im_end|> <||x"), ("", "")]
    assert found[1]["learned"] == ["<|im_end|> <||x"] and found[1]["attachments"][0].asDict() == {"type": "image", "ref": "s3://a.png", "tokens": 4}
    assert found[None]["n_turns"] == 1


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    item = [word() for _ in range(30)]
    edited = [word() if i % 9 == 4 else w for i, w in enumerate(item)]
    pad = [word() for _ in range(200)]
    rows = [(1, " ".join([*pad, *item, *pad])), (2, " ".join([*pad, *edited])), (3, " ".join(pad)), (4, None), (5, ""), (6, " ".join([*pad, *item[:5], *pad])), (7, " ".join(w.upper() + "," for w in item))]
    tests = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None)], "item_id bigint, text string")
    for shard_bytes in (1 << 26, 700):
        found = decontamination.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), tests, shard_bytes=shard_bytes)
        assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 10), (2, 10), (7, 10)]
    assert decontamination.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), tests.where("false")).count() == 0


def test_language(spark):
    rng = random.Random(1)
    said = {"en": "the house of water and fire", "fr": "la maison de leau et du feu"}
    rows = [(i, " ".join(rng.choices(said[lang].split(), k=8)), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), language_id.Pieces.read(public_tokenizers.path("piece_bpe_32k.model")))
    asked = spark.createDataFrame([(1, "The WATER of fire"), (2, "maison du feu"), (3, None), (4, "12 !?"), (5, "x" * 5000)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in language_id.identify(asked, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "fr", "und", "und"] and 0 < found[5]["score"] <= 1


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces.of([b"a", b"b", b"ab", b" ", b" a"])
    p = np.full((5, 1), 0.2)
    total = np.exp(language_id.Model(["x"], pieces, p).words(b"ab", np.array([0]), np.array([2])))[0, 0]
    assert total == pytest.approx(0.2**3 + 2 * 0.2**2, rel=1e-4)  # " ",a,b; " a",b; " ",ab; bytes add next to nothing


def test_toxicity(spark):
    rows = [(i, f"word{i} nice talk {'id1ot' if i % 2 else 'friend'} more", i % 2) for i in range(60)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"), exceptions=("such idiot boards",))
    asked = spark.createDataFrame([(1, "you ІDIОT now"), (2, "a friend"), (3, None), (4, ""), (5, "such idiot boards")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(asked, lexicon).collect()}
    assert found[1] > 0.5 > found[2] and found[3] == found[4] == found[2] == found[5]


def test_quality(spark):
    good, bad = "A plain sentence of words that differ.\nAnother line, quite calm.", "BUY!! NOW!! BUY!! NOW!!\n### @@ ### @@"
    rows = [(i, f"{good if i % 2 else bad} {i}", i % 2) for i in range(60)]
    model = line_quality.fit(spark.createDataFrame(rows, "doc_id bigint, text string, quality int"))
    asked = spark.createDataFrame([(1, good), (2, bad), (3, None), (4, ""), (5, "\n\n")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in line_quality.score_quality(asked, model).collect()}
    assert found[1] > 0.8 and found[2] < 0.2 and found[3] == found[4] == found[5] == 0.5


def test_quality_of_balanced_sample(spark, tmp_path):
    good, bad = "A plain sentence of words that differ.", "BUY!! NOW!! BUY!! ### @@"
    rows = [(i, f"{bad if i % 5 == 0 else good} {i}", int(i % 5 > 0)) for i in range(600)]
    held_out = F.col("doc_id") < 100
    spark.createDataFrame(rows, "doc_id bigint, text string, quality int").select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, q) for i, _, q in rows] + [(None, 1), (700, None), (701, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = queries.quality_model(spark, str(tmp_path), held_out, 100)
    assert model.prior == 0.8
    blank = line_quality.score_quality(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id bigint, text string"), model)
    assert {r["score"] for r in blank.collect()} == {0.8}


def test_bpe(docs, empty):
    encoder = word_bpe.Encoder.read(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = encoder.load()
    extra = docs.sparkSession.createDataFrame([(901, "don't <|endoftext|> ΣΑΣ é 12x", "", 0), (901, "again", "", 0), (None, "null id", "", 0)], DOCS)
    for size in (200, word_bpe.BLOCK_BYTES):
        found = word_bpe.encode(docs.union(extra), encoder, block_bytes=size, decoded=True).collect()
        wanted = Counter()
        for i, t in [*enumerate(texts()), *((r["doc_id"], r["text"]) for r in extra.collect())]:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            wanted[i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
        assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in found) == wanted
    assert word_bpe.encode(empty, encoder).count() == 0


def test_empty_tables(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
