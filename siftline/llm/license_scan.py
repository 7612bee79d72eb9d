"""License scans by a positional index of rare words.

* *Rarity.*  A first scan counts, over all texts, in how many each word of the licence templates occurs.
* *Index.*  Of each template only the rarest words are listed, with their positions.  Words that no text has are passed
  over: no text could be found by them.
* *Search.*  A second scan looks up every occurrence of an indexed word in every text.  An occurrence and a listing
  together say where the template would begin; beginnings on which enough of a template's listed words agree are places
  to be checked.
* *Proof.*  A place counts where the template's mandatory phrases stand: exactly where they should for a phrase template
  (which is nothing but its phrase), within ``SLACK`` words for a longer notice.

Every place of a phrase holds its rarest word, and every occurrence of that is looked up, so no place is lost.  Words are
compared by keyed 64-bit fingerprints.  Texts don't leave their task; only the counts of template words are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols
from .work import check_broadcast

SLACK = 4


@dataclass(frozen=True)
class Template:
    """A licence's wording: words in order, the phrases in it that must stand, and how it is looked up.

    ``rare`` of its words are listed in the index, and ``agree`` of them must agree on a place.
    """

    label: str
    text: str
    phrases: tuple[str, ...]
    rare: int = 6
    agree: int = 2
    base: bool = False

    @classmethod
    def phrase(cls, label: str, text: str) -> Template:
        return cls(label, text, (text,), 1, 1, True)

    @property
    def words(self) -> list[str]:
        return self.text.split(" ")

    def keys(self) -> list[tuple[int, list[str]]]:
        """Offset and words of each mandatory phrase."""
        out, words = [], self.words
        for phrase in self.phrases:
            own = phrase.split(" ")
            out.append((next(i for i in range(len(words)) if words[i : i + len(own)] == own), own))
        return out


# The phrases and labels of the base scan.
BASE = (
    Template.phrase("gpl", "gnu general public license"),
    Template.phrase("apache", "apache license"),
    Template.phrase("cc-by", "cc by"),
    Template.phrase("mit", "mit license"),
)
# Notices by which public licences ask to be named, in lower case and without signs.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",), 4),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",), 4),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",), 4),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",), 3),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",), 3),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "obtaining a copy of this software")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",), 4),
)
TEMPLATES = BASE + NOTICES


@dataclass
class Index:
    """Template words by number, their fingerprints, and the listings of the rare ones."""

    templates: Sequence[Template]
    prints: textcols.Prints
    words: list[str]
    codes: np.ndarray  # of words, sorted
    names: np.ndarray  # the word of each code

    @classmethod
    def of(cls, templates: Sequence[Template], prints: textcols.Prints) -> Index:
        words = sorted({w for t in templates for w in t.words})
        codes = _codes(words, prints)
        order = np.argsort(codes)
        return cls(templates, prints, words, codes[order], order)

    def listed(self, found_in: dict[str, int]) -> list[tuple[int, int, str]]:
        """(template, position, word) of the rarest words that occur at all, ties in order of the words."""
        out = []
        for number, template in enumerate(self.templates):
            known = sorted({w for w in template.words if found_in.get(w)}, key=lambda w: (found_in[w], w))[: template.rare]
            out += [(number, at, w) for at, w in enumerate(template.words) if w in known]
        return out

    def met(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of template words in a sequence of fingerprints, and which words they are."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        places = np.flatnonzero(self.codes[at] == codes)
        return places, self.names[at[places]]


def _codes(words: list[str], prints: textcols.Prints) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return prints.ranges(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


def _words(data: np.ndarray, offsets: np.ndarray, prints: textcols.Prints) -> textcols.Words:
    return textcols.words(data, offsets, prints, lower=True, separators=textcols.NOT_WORD)


def _counted(index):
    """Rows (word, texts): in how many texts of a task each template word occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        texts = np.zeros(len(own.words), np.int64)
        for batch in batches:
            for _, _, data, offsets in textcols.slices(batch.column(0)):
                found = _words(data, offsets, own.prints)
                places, names = own.met(found.code)
                once = np.unique(found.row[places] * len(own.words) + names)
                texts += np.bincount(once % len(own.words), minlength=len(own.words))
        met = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(texts[met])], names=["word", "texts"])

    return count


@dataclass
class Search:
    """The index as tasks use it: listings by word, and the fingerprints of templates and mandatory phrases."""

    index: Index
    first: np.ndarray  # listings of word w are first[w]:first[w + 1]
    template: np.ndarray
    offset: np.ndarray
    whole: list[np.ndarray]
    keys: list[list[tuple[int, np.ndarray]]]

    @classmethod
    def of(cls, index: Index, listed: list[tuple[int, int, str]]) -> Search:
        number = {w: i for i, w in enumerate(index.words)}
        rows = np.array(sorted((number[w], t, at) for t, at, w in listed), np.int64).reshape(-1, 3)
        first = np.searchsorted(rows[:, 0], np.arange(len(index.words) + 1))
        whole = [_codes(t.words, index.prints) for t in index.templates]
        keys = [[(at, _codes(own, index.prints)) for at, own in t.keys()] for t in index.templates]
        return cls(index, first, rows[:, 1], rows[:, 2], whole, keys)

    def places(self, found: textcols.Words) -> np.ndarray:
        """(row, begin, template, words that agree with the template) of all proven places; begins count from the slice's first word."""
        places, names = self.index.met(found.code)
        lists = self.first[names + 1] - self.first[names]
        entry = np.arange(lists.sum()) - np.repeat(np.cumsum(lists) - lists, lists) + np.repeat(self.first[names], lists)
        begin = np.repeat(places, lists) - self.offset[entry]
        votes = np.stack([np.repeat(found.row[places], lists), begin, self.template[entry]], 1)
        asked, agreed = np.unique(votes, axis=0, return_counts=True) if len(votes) else (votes, np.zeros(0, np.int64))
        proven = [np.zeros((0, 4), np.int64)]
        for number, template in enumerate(self.index.templates):
            own = asked[(asked[:, 2] == number) & (agreed >= template.agree)]
            slack = range(1) if template.base else range(-SLACK, SLACK + 1)
            for at, key in self.keys[number]:
                own = own[np.logical_or.reduce([self._stand(found, own, at + move, key) for move in slack])] if len(own) else own
            if len(own):
                whole = self.whole[number]
                same = sum(self._same(found, own, at, code).astype(np.int64) for at, code in enumerate(whole))
                proven.append(np.column_stack([own, same]))
        return np.concatenate(proven)

    def _same(self, found: textcols.Words, asked: np.ndarray, at: int, code: np.uint64) -> np.ndarray:
        """Whether the text has the word ``at`` words after each begin, inside the same text."""
        place = asked[:, 1] + at
        inside = (place >= found.first[asked[:, 0]]) & (place < found.first[asked[:, 0] + 1])
        return inside & (found.code[np.where(inside, place, 0)] == code)

    def _stand(self, found: textcols.Words, asked: np.ndarray, at: int, key: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self._same(found, asked, at + i, code) for i, code in enumerate(key)])


PLACES = "array<struct<label:string,base:boolean,word:bigint,share:double>>"


def _scanned(search):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Search = search.value
        labels = np.array([t.label for t in own.index.templates], dtype=object)
        base = np.array([t.base for t in own.index.templates])
        length = np.array([len(t.words) for t in own.index.templates])
        for batch in batches:
            for lo, hi, data, offsets in textcols.slices(batch.column(1)):
                found = _words(data, offsets, own.index.prints)
                hits = own.places(found)
                hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
                row, begin, template, same = hits.T
                each = pa.StructArray.from_arrays(
                    [pa.array(labels[template], pa.string()), pa.array(base[template]), pa.array(begin - found.first[row]), pa.array(same / length[template])], names=["label", "base", "word", "share"]
                )
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=hi - lo))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(found.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), each)], names=["doc", "n_words", "places"]
                )

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: id, ``n_words`` and ``places`` (label, base, first word, share of the template's words there).

    ``places`` come in order; overlapping ones are all listed.  A null text reads as empty, and rows without a place have
    an empty list.  Rows are told apart by nothing but themselves, so null and repeated ids and equal rows are scanned one
    by one.  An empty table gives no rows.  Other columns are not read, whatever their names.
    """
    if not templates:
        raise ValueError("no templates to look for")
    spark = docs.sparkSession
    index = Index.of(templates, textcols.Prints(textcols.draw_seed()))
    check_broadcast(64 * sum(len(t.words) + sum(len(p.split(" ")) for p in t.phrases) for t in templates), "the licence templates")
    counted = docs.select(text_col).mapInArrow(_counted(spark.sparkContext.broadcast(index)), "word int, texts bigint")
    texts = {index.words[r["word"]]: r["n"] for r in counted.groupBy("word").agg(F.sum("texts").alias("n")).collect()}  # template words only
    search = spark.sparkContext.broadcast(Search.of(index, index.listed(texts)))
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_scanned(search), f"doc {kind}, n_words bigint, places {PLACES}")
    return found.withColumnRenamed("doc", id_col)


def scan_sql(documents: str = "documents", templates: Sequence[Template] = TEMPLATES) -> str:
    """The scan's method in SQL: rare words by their counts, agreeing listings, phrases that stand."""
    words = [(n, at, w) for n, t in enumerate(templates) for at, w in enumerate(t.words)]
    keys = [(n, k, at + i, w) for n, t in enumerate(templates) for k, (at, own) in enumerate(t.keys()) for i, w in enumerate(own)]
    rules = [(n, t.label, t.rare, t.agree, t.base, len(t.words), len(t.phrases)) for n, t in enumerate(templates)]

    def values(rows: list[tuple]) -> str:
        return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in rows)

    return f"""
        WITH template_words(template, pos, word) AS (VALUES {values(words)}),
        keys(template, key, pos, word) AS (VALUES {values(keys)}),
        rules(template, label, rare, agree, base, n, n_keys) AS (VALUES {values(rules)}),
        texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
            FROM {documents}),
        every AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM texts),
        w AS MATERIALIZED (SELECT * FROM every WHERE word IN (SELECT word FROM template_words)),
        counts AS (SELECT word, count(DISTINCT doc_id) AS n FROM w GROUP BY 1),
        ranked AS (
            SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY n, word) AS rarity
            FROM (SELECT DISTINCT template, word FROM template_words) JOIN counts USING (word)),
        listed AS (SELECT t.template, t.pos, t.word FROM ranked k JOIN rules r ON r.template = k.template JOIN template_words t ON t.template = k.template AND t.word = k.word WHERE k.rarity <= r.rare),
        asked AS (
            SELECT w.doc_id, l.template, w.place - l.pos AS begin FROM w JOIN listed l USING (word) JOIN rules r ON r.template = l.template
            GROUP BY w.doc_id, l.template, w.place - l.pos, r.agree HAVING count(*) >= r.agree),
        moves AS (SELECT template, move FROM rules, (SELECT unnest(range(-{SLACK}, {SLACK} + 1)) AS move) WHERE move = 0 OR NOT base),
        lengths AS (SELECT template, key, count(*) AS n_words FROM keys GROUP BY 1, 2),
        standing AS (
            SELECT a.doc_id, a.template, a.begin, k.key, m.move FROM asked a JOIN moves m ON m.template = a.template JOIN keys k ON k.template = a.template
            JOIN lengths x ON x.template = k.template AND x.key = k.key
            JOIN w ON w.doc_id = a.doc_id AND w.word = k.word AND w.place = a.begin + k.pos + m.move
            GROUP BY a.doc_id, a.template, a.begin, k.key, m.move, x.n_words HAVING count(*) = x.n_words),
        proven AS (
            SELECT s.doc_id, s.template, s.begin FROM standing s JOIN rules r ON r.template = s.template
            GROUP BY s.doc_id, s.template, s.begin, r.n_keys HAVING count(DISTINCT s.key) = r.n_keys),
        places AS (
            SELECT p.doc_id, r.label, r.base, p.begin, count(*) / CAST(r.n AS DOUBLE) AS share FROM proven p JOIN rules r ON r.template = p.template
            JOIN template_words t ON t.template = p.template JOIN w ON w.doc_id = p.doc_id AND w.word = t.word AND w.place = p.begin + t.pos
            GROUP BY p.doc_id, p.template, r.label, r.base, r.n, p.begin),
        found AS (
            SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(begin) FILTER (WHERE base) AS first_word, max(begin) FILTER (WHERE base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM places GROUP BY 1)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM texts LEFT JOIN found USING (doc_id)"""
