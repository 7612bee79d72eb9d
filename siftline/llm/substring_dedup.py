"""Substring dedup by suffix automata of reference shards.

Words repeat where a window of ``width`` consecutive words starts earlier in the corpus (a smaller doc_id, or an
earlier start in the same document).  The corpus is sampled into runs of windows.  A run that occurs earlier as a
whole is removed by one aggregation and join.  Runs that share a key but differ are cut out of the texts as
*reference passages* and dealt by key into shards.  Each shard builds a suffix automaton over its passages in corpus
order and streams the passages through it: where the matching statistic reaches ``width``, the window occurred before.

Shards are dealt to tasks by key and not broadcast: the reference passages grow with the corpus, so broadcasting every
shard would read the whole corpus once for each shard.  A key with more than ``shard_limit`` unlike passages isn't
collected in one task; its windows are counted one by one instead, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textcols
from .repeats import Grain, clustered, counted_runs, documents, passages, same_document, sampled_runs, window_rows
from .work import Scratch, met_by_key

WIDTH = 20
GRAM = 8
#: Words of so many passages, about 30 each, take an automaton half a second.
SHARD_LIMIT = 4096
_SHARD_ROWS = 2000


class SuffixAutomaton:
    """Suffix automaton of the words fed so far; ``feed`` says how much of what ends here occurred before."""

    def __init__(self):
        self._next: list[dict[int, int]] = [{}]
        self._link = [-1]
        self._length = [0]
        self.restart()

    def restart(self) -> None:
        """Begins another passage: matches and insertions never run across passages."""
        self._last, self._state, self._matched = 0, 0, 0

    def feed(self, word: int) -> int:
        """Length of the longest string that ends with this word and also ended earlier; then adds the word."""
        nexts, link, length = self._next, self._link, self._length
        state, matched = self._state, self._matched
        while state and word not in nexts[state]:
            state = link[state]
            matched = length[state]
        if word in nexts[state]:
            state, matched = nexts[state][word], matched + 1
        self._last = self._extend(word)
        while state and matched <= length[link[state]]:
            state = link[state]
        self._state, self._matched = state, matched
        return matched

    def _extend(self, word: int) -> int:
        nexts, link, length = self._next, self._link, self._length
        last = self._last
        known = nexts[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, known, word)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in nexts[at]:
            nexts[at][word] = new
            at = link[at]
        if at >= 0:
            target = nexts[at][word]
            link[new] = target if length[target] == length[at] + 1 else self._clone(at, target, word)
        return new

    def _clone(self, at: int, target: int, word: int) -> int:
        nexts, link, length = self._next, self._link, self._length
        copy = len(nexts)
        nexts.append(dict(nexts[target]))
        link.append(link[target])
        length.append(length[at] + 1)
        link[target] = copy
        while at >= 0 and nexts[at].get(word) == target:
            nexts[at][word] = copy
            at = link[at]
        return copy


def _earlier_in_shard(width: int):
    """Windows of a shard's passages that occurred before, as (doc, tag, lo, n) ranges of window starts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in clustered(batches, _SHARD_ROWS):
            keys = table.column("key").to_numpy()
            docs, tags, los, units = (table.column(c).to_pylist() for c in ("doc", "tag", "lo", "units"))
            out_doc, out_tag, out_lo, out_n = [], [], [], []
            automaton = SuffixAutomaton()
            for row, key in enumerate(keys):
                if row and key != keys[row - 1]:
                    automaton = SuffixAutomaton()
                elif row and (docs[row], tags[row], los[row]) == (docs[row - 1], tags[row - 1], los[row - 1]):
                    continue  # a repeated row
                automaton.restart()
                feed = automaton.feed
                hits = [i for i, word in enumerate(np.frombuffer(units[row], np.int64).tolist()) if feed(word) >= width]
                begin = None
                for here, after in zip(hits, [*hits[1:], None], strict=False):
                    begin = here if begin is None else begin
                    if after != here + 1:
                        out_doc.append(docs[row])
                        out_tag.append(tags[row])
                        out_lo.append(los[row] + begin - width + 1)
                        out_n.append(here - begin + 1)
                        begin = None
            columns = ((out_doc, pa.int64()), (out_tag, pa.int64()), (out_lo, pa.int32()), (out_n, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=["doc", "tag", "lo", "n"])

    return scan


def _after_first(rows: DataFrame, key: str, copies: str, scratch: Scratch, name: str) -> DataFrame:
    """Occurrences ``(doc, tag, lo, ...)`` of each key but for the earliest; rows at the same place are one occurrence."""
    first = rows.groupBy(key).agg(F.min(F.struct("doc", "tag", "lo")).alias("first"), F.count(F.lit(1)).alias(copies)).where(F.col(copies) >= 2)
    met = met_by_key(rows, scratch.keep(first, name), key, copies, ("doc", "tag", "lo"))
    return met.where(~F.struct("doc", "tag", "lo").eqNullSafe(F.col("first")))


def repeated_windows(docs: DataFrame, scratch: Scratch, width: int = WIDTH, gram: int = GRAM, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Ranges ``(doc, tag, lo, n)`` of window starts of ``docs(doc, tag, text)`` whose windows start earlier in the corpus."""
    grain = Grain("word", width, gram, textcols.Prints(textcols.draw_seed()))
    index = scratch.keep(counted_runs(docs, grain).groupBy("key", "body").agg(F.sum("copies").alias("copies")), "index")
    scratch.drop()  # lets go of the shuffle behind the table
    crowded = scratch.keep(index.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd >= 2"), "crowded")
    meeting = scratch.keep(met_by_key(index, crowded, "key", "crowd", ("body",), "left").where("copies >= 2 or crowd is not null"), "meeting")
    scratch.drop("index", "crowded")
    rows = scratch.keep(met_by_key(sampled_runs(docs, grain), meeting, "body", "copies", ("doc", "tag", "lo")), "rows")
    scratch.drop("meeting")
    later = scratch.keep(_after_first(rows.where("copies >= 2").select("body", "doc", "tag", "lo", "n"), "body", "times", scratch, "firsts").select("doc", "tag", "lo", "n"), "later")
    wanted = (
        rows.where("crowd is not null")
        .groupBy("key", "body")
        .agg(F.min(F.struct("doc", "tag", "lo", "n")).alias("first"), F.max("crowd").alias("crowd"))
        .select("first.doc", "first.tag", "key", F.lit(False).alias("single"), "crowd", "first.lo", "first.n")
    )
    found = scratch.keep(passages(docs, wanted, grain), "passages")
    scratch.drop("rows", "firsts")
    in_shard = (
        found.where(F.col("crowd") <= shard_limit)
        .select("key", "doc", "tag", "lo", "units")
        .repartition("key")
        .sortWithinPartitions("key", "doc", "tag", "lo")
        .mapInArrow(_earlier_in_shard(width), "doc bigint, tag bigint, lo int, n int")
    )
    windows = window_rows(found.where(F.col("crowd") > shard_limit), grain)
    in_crowd = _after_first(windows, "print", "times", scratch, "prints").select("doc", "tag", "lo", F.lit(1).alias("n"))
    return later.unionByName(in_shard).unionByName(in_crowd)


KEPT_SCHEMA = "doc bigint, text string, n_words bigint, n_removed bigint, kept string, kept_sha256 string, spans array<struct<begin:int,end:int>>"


def _strip(width: int, with_text: bool):
    plain = textcols.Prints(0)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2).to_pylist()
            for a, b, data, offsets in textcols.slices(batch.column(1)):
                found = textcols.words(data, offsets, plain)
                raw = data.tobytes()
                cols = {k: [] for k in ("text", "n_words", "n_removed", "kept", "sha", "spans")}
                for row in range(a, b):
                    lo, hi = int(found.first[row - a]), int(found.first[row - a + 1])
                    gone = np.zeros(hi - lo + 1, dtype=np.int32)
                    for mark in marks[row] or ():
                        begin, end = min(mark["lo"], hi - lo), min(mark["lo"] + mark["n"] + width - 1, hi - lo)
                        gone[begin] += 1
                        gone[end] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    starts, ends = found.start[lo:hi], found.end[lo:hi]
                    keep = np.flatnonzero(~gone)
                    joined = b" ".join(raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    cols["n_words"].append(hi - lo)
                    cols["n_removed"].append(int(gone.sum()))
                    cols["sha"].append(hashlib.sha256(joined).hexdigest())
                    cols["spans"].append([{"begin": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                    if with_text:
                        own = raw[int(offsets[row - a]) : int(offsets[row - a + 1])]
                        base, pieces, at = int(offsets[row - a]), [], 0
                        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                            pieces.append(own[at : int(starts[x]) - base])
                            at = int(starts[y]) - base if y < hi - lo else len(own)
                        pieces.append(own[at:])
                        cols["kept"].append(b"".join(pieces).decode("utf-8", "replace"))
                    else:
                        cols["kept"].append(None)
                n = b - a
                carried = [batch.column(i).slice(a, n) for i in range(3, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, n),
                        batch.column(1).slice(a, n) if with_text else pa.nulls(n, pa.string()),
                        pa.array(cols["n_words"], pa.int64()),
                        pa.array(cols["n_removed"], pa.int64()),
                        pa.array(cols["kept"], pa.string()),
                        pa.array(cols["sha"], pa.string()),
                        pa.array(cols["spans"], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                        *carried,
                    ],
                    names=["doc", "text", "n_words", "n_removed", "kept", "kept_sha256", "spans", *batch.schema.names[3:]],
                )

    return strip


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, with_text: bool = True, shard_limit: int = SHARD_LIMIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_removed``, ``spans`` of removed words, ``kept_sha256`` and the kept text.

    The columns in ``carry`` follow, renamed to ``carried_0`` and so on.

    Words are maximal runs without the six ASCII white-space characters.  Null or empty text has no words and loses
    none.  A row given again is the same document: it doesn't count as earlier than itself, and its rows share their
    result.  Rows that share an id with unlike texts are documents in the order of a hash of their texts; a null id
    sorts before all others.  Other columns are not read, whatever their names.
    ``kept`` is the text with each removed span and the space after it cut out; untouched text stays as it is.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    marks = repeated_windows(documents(docs, id_col, text_col), scratch, width, gram, shard_limit).groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "n")).alias("marks"))
    marks = scratch.keep(marks, "marks")
    scratch.drop("later", "passages", "prints")
    names = [f"carried_{i}" for i in range(len(carry))]
    whole = documents(docs, id_col, text_col, *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    joined = whole.alias("s").join(marks.alias("m"), same_document("s", "m"), "left").select("s.doc", "s.text", "m.marks", *names)
    schema = StructType([*StructType.fromDDL(KEPT_SCHEMA).fields, *whole.schema.fields[3:]])
    return joined.mapInArrow(_strip(width, with_text), schema).withColumnRenamed("doc", id_col)
