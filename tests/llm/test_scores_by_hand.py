"""op1, op8 and op9 against plain versions that enumerate segmentations, places and labelings; odd tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import unicodedata

import numpy as np
import pytest

from siftline.llm import language_id, line_quality, textcols, toxicity

CLASHING = "doc_id bigint, text string, doc string, lettered int, peak int, mass string, score string, matched int, lang_pred int, n_lines string, raw int, label string"
LONG = "plain words of water and fire " * 25_000  # longer than a slice


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z", 3, 4, "w", 5, "v") for i, t in rows], CLASHING)


def segmentations(word: bytes, pieces: dict[bytes, float]):
    """All ways to cut ``word`` into pieces and single bytes: (pieces used, probability)."""
    if not word:
        yield (), 1.0
        return
    for used, p in segmentations(word[1:], pieces):
        yield used, p * language_id.BYTE
    for piece, own in pieces.items():
        if word.startswith(piece):
            for used, p in segmentations(word[len(piece) :], pieces):
                yield (piece, *used), p * own


TEXTS = [b"a", b"b", b"ab", b"ba", b"aab", b" ", b" a", b" b", "é".encode(), "bé".encode()]


@pytest.fixture
def model():
    """Three languages with random piece probabilities, and the same as dicts."""
    pieces = language_id.Pieces.of(TEXTS)
    p = np.random.default_rng(4).dirichlet(np.ones(len(TEXTS)), 3).T
    number = {t: int(np.searchsorted(pieces.prints, pieces.keyed.ranges(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0])) for t in TEXTS}
    return language_id.Model(["aa", "bb", "cc"], pieces, p), [{t: p[number[t], k] for t in TEXTS} for k in range(3)], number


def test_expected_counts_enumerate_segmentations(model):
    own, plain, number = model
    rng = random.Random(2)
    words = ["".join(rng.choices("abéc", k=rng.randint(1, 6))).encode() for _ in range(40)]
    language = np.array([rng.randrange(3) for _ in words])
    weight = np.array([rng.randint(1, 5) for _ in words])
    wanted = np.zeros_like(own.p)
    for word, k, times in zip(words, language.tolist(), weight.tolist(), strict=True):
        ways = list(segmentations(b" " + word, plain[k]))
        total = sum(p for _, p in ways)
        for used, p in ways:
            for piece in used:
                wanted[number[piece], k] += times * p / total
    end = np.cumsum([len(x) for x in words])
    found = np.zeros_like(own.p)
    for at, lattice in language_id._blocks(own.pieces, b"".join(words), end - [len(x) for x in words], end):
        found += lattice.expected(own.p, language[at], weight[at])
    assert np.allclose(found, wanted, rtol=1e-9, atol=1e-9)


def test_expected_counts_of_a_long_word(model):
    own, _, number = model
    word = b"ab" * 5000
    (at, lattice), *more = language_id._blocks(own.pieces, word, np.array([0]), np.array([len(word)]))
    counts = lattice.expected(own.p, np.array([1]), np.array([1]))
    covered = sum(len(t) * counts[n, 1] for t, n in number.items())
    assert not more and len(word) - 5 < covered <= len(word) + 1 + 1e-6 and not counts[:, [0, 2]].any()


def test_language_of_whole_texts_enumerates_segmentations(spark, model):
    own, plain, _ = model
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abéc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    texts += [texts[0].upper(), texts[0], "12 !", "", None]
    wanted = {}
    for i, text in enumerate(texts):
        logs = [sum(math.log(sum(p for _, p in segmentations(b" " + w.encode(), one))) for w in (text or "").lower().split()) for one in plain]
        best = max(range(3), key=lambda k: logs[k])
        wanted[i] = (own.languages[best], 1 / sum(math.exp(x - logs[best]) for x in logs)) if re.search(r"[^\W\d_]", text or "") else ("und", 0.0)
    for at_once in (None, 2, 1):
        found = {r["doc_id"]: r for r in language_id.identify(clashing(spark, enumerate(texts)), own, at_once=at_once).collect()}
        assert {i: r["lang_pred"] for i, r in found.items()} == {i: w[0] for i, w in wanted.items()}
        assert all(found[i]["score"] == pytest.approx(w[1], rel=1e-9) for i, w in wanted.items())


def test_languages_are_fitted_apart(spark):
    said = {"en": "the house of water and fire", "fr": "la maison de leau et du feu", "und": "zum haus am see", None: "x"}
    rows = [(" ".join(random.Random(i).choices(said[lang].split(), k=8)), lang, "clash") for i, lang in enumerate([*said] * 30)]
    labelled = spark.createDataFrame(rows, "text string, lang string, language string")
    pieces = language_id.Pieces.of([x.encode() for x in [*"abcdefghilmnorstuwz ", " the", " la", "wat", "er", "fe", "ha", "us"]])
    whole, apart = (language_id.fit(labelled, pieces, at_once=n) for n in (None, 1))
    assert whole.languages == apart.languages == ["en", "fr", "und"] and np.allclose(whole.p, apart.p, rtol=1e-9)
    asked = clashing(spark, [(1, "the water"), (2, "la maison"), (3, "haus am see"), (4, LONG), (4, LONG), (None, "fire")])
    found = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0.4) for r in language_id.identify(asked, whole).collect())
    assert found == [(0, "en", True), (1, "en", True), (2, "fr", True), (3, "und", True), (4, "en", True), (4, "en", True)]


def test_languages_of_odd_tables(spark):
    pieces = language_id.Pieces.of(TEXTS)
    none = language_id.fit(spark.createDataFrame([("ab", None), (None, "aa")], "text string, lang string"), pieces)
    assert none.languages == [] and [(r["lang_pred"], r["score"]) for r in language_id.identify(clashing(spark, [(1, "ab")]), none).collect()] == [("und", 0.0)]
    one = language_id.fit(spark.createDataFrame([("ab", "aa")], "text string, lang string"), pieces)
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(clashing(spark, [(1, "ba")]), one).collect()] == [("aa", 1.0)]
    assert language_id.identify(clashing(spark, []), one).count() == 0


def test_equally_likely_languages_in_order(spark):
    pieces = language_id.Pieces.of(TEXTS)
    even = language_id.Model(["aa", "bb", "cc"], pieces, np.full((len(TEXTS), 3), 0.1))
    for at_once in (None, 1):
        (found,) = language_id.identify(clashing(spark, [(1, "abba")]), even, at_once=at_once).collect()
        assert found["lang_pred"] == "aa" and found["score"] == pytest.approx(1 / 3)


def plainly_folded(text: str) -> str:
    table = {ord(c): letter for letter, signs in toxicity.LOOK_ALIKES.items() for c in signs}
    out = "".join(c for c in text.lower().translate(table) if not (0x300 <= ord(c) <= 0x36F))
    return re.sub(" +", " ", "".join(c if unicodedata.category(c).startswith("L") else " " for c in out))


def test_toxicity_scans_every_place(spark):
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " idio": 2.0, " trash": 1.5, " trash ": 1.0, " awfui ": 2.5}, {" trash can ", " an idiot "}, np.array([-3.0, 1.0, 0.7, 2.0]))
    rng = random.Random(8)
    words = ["1d10t", "ІDIОT", "idiots", "trash", "trashy", "trash can", "an idiot", "awful", "ａwful", "ídiot", "can", "an", "fine", "--", "4wful!", "你"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 15))) for _ in range(60)] + ["", None, " ", "awful", "awful", LONG + "awful"]
    wanted = {}
    for i, text in enumerate(texts):
        folded = plainly_folded(text or "")
        padded, weights = f" {folded} ", []
        shields = [(m, m + len(x)) for x in lexicon.exceptions for m in range(len(padded)) if padded.startswith(x, m)]
        for place in range(len(padded) if len(padded) < 10_000 else 0):
            terms = [t for t in lexicon.terms if padded.startswith(t, place)]
            if terms:
                longest = max(terms, key=len)
                if not any(x <= place and place + len(longest) <= y for x, y in shields):
                    weights.append(lexicon.terms[longest])
        if text and len(text) > 10_000:
            weights = [lexicon.terms[" awfui "]]
        total = sum(weights)
        x = np.array([1.0, math.log1p(total), total / math.sqrt(1 + folded.count(" "))]) if weights else np.zeros(3)
        wanted[i] = (1 / (1 + math.exp(-(lexicon.logistic[0] + x @ lexicon.logistic[1:]))), bool(weights))
    found = {r["doc_id"]: (r["score"], r["matched"]) for r in toxicity.score_toxicity(clashing(spark, enumerate(texts)), lexicon).collect()}
    assert {i: f[1] for i, f in found.items()} == {i: w[1] for i, w in wanted.items()}
    assert all(found[i][0] == pytest.approx(w[0], rel=1e-9) for i, w in wanted.items())


def test_given_exceptions_are_folded(spark):
    rows = [(f"word{i} nice talk {'id1ot' if i % 2 else 'friend'} more", i % 2) for i in range(60)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"), exceptions=("The Idiot: a novel", "--"))
    asked = clashing(spark, [(1, "he read the idiot (A NOVEL)"), (2, "the idiot"), (3, "he read")])
    found = {r["doc_id"]: (r["matched"], r["score"]) for r in toxicity.score_toxicity(asked, lexicon).collect()}
    assert [found[i][0] for i in (1, 2, 3)] == [False, True, False] and found[1] == found[3]


def test_toxicity_of_odd_tables(spark):
    labels = "text string, toxic int, raw string, label string, term int"
    for rows in ([], [("nice talk", 0, "x", "y", 1)] * 9, [("bad talk", 1, "x", "y", 1)] * 9, [(None, 1, "x", "y", 1), ("a", None, "x", "y", 1), ("b", 7, "x", "y", 1)]):
        lexicon = toxicity.learn(spark.createDataFrame(rows, labels))
        assert not lexicon.terms and not lexicon.exceptions
    assert toxicity.score_toxicity(clashing(spark, []), lexicon).count() == 0
    assert [r["matched"] for r in toxicity.score_toxicity(clashing(spark, [(1, "bad"), (None, None)]), lexicon).collect()] == [False, False]


def test_quality_enumerates_labelings(spark):
    rng = random.Random(9)
    rows = np.random.default_rng(9)
    field = line_quality.Field(rows.normal(size=line_quality.WIDTH) / 2, rows.normal(size=(2, 2)), 0.7, (0.8, 0.3))
    lines = ["A plain sentence of words.", "BUY!! NOW!! BUY!!", "", "  ", "### 12 34", "menu home menu home", "éa ça là", "x"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 8))) for _ in range(40)] + ["", None, "\n \n", "a\r\nb"]
    keyed = textcols.Prints(textcols.draw_seed())
    wanted = {}
    for i, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        found = line_quality.lines_of(raw, np.array([0, len(raw)]), keyed)
        n = len(found.row)
        if not n:
            wanted[i] = (0.7, 0, 0)
            continue
        unary = line_quality.features(found) @ field.weight
        total, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            worth = math.exp(sum(u for u, y in zip(unary, labels, strict=True) if y) + sum(field.change[a, b] for a, b in itertools.pairwise(labels)))
            total += worth
            good += worth * np.array(labels)
        good /= total
        mean = (np.log(good / (1 - good)) * found.size).sum() / max(found.size.sum(), 1)
        wanted[i] = (1 / (1 + math.exp(-(0.8 * mean + 0.3))), n, int((good < 0.5).sum()))
    found = {r["doc_id"]: r for r in line_quality.score_quality(clashing(spark, enumerate(texts)), field).collect()}
    assert {i: (r["n_lines"], r["n_bad_lines"]) for i, r in found.items()} == {i: w[1:] for i, w in wanted.items()}
    assert all(found[i]["score"] == pytest.approx(w[0], rel=1e-6) for i, w in wanted.items())


def test_quality_of_odd_tables(spark):
    labels = "text string, quality int, label string, sizes int"
    for rows, prior in (([], 0.5), ([("a line", 1, "x", 1)] * 4, 1.0), ([("a line", 0, "x", 1)] * 4, 0.0), ([(None, 1, "x", 1), ("a", None, "x", 1)], 0.5)):
        model = line_quality.fit(spark.createDataFrame(rows, labels))
        asked = clashing(spark, [(1, "a line"), (1, "a line"), (None, None), (2, LONG)])
        assert [r["score"] for r in line_quality.score_quality(asked, model).collect()] == [prior] * 4
    assert line_quality.score_quality(clashing(spark, []), model).count() == 0
