"""BPE encoding by a distinct-word table, and decoding by an id-to-piece join.

1. *Split.*  Documents are cut at ASCII white space into words, block by block (a block is about ``BLOCK_BYTES`` of
   text).  A block keeps its distinct words once, and each document as the sequence of their numbers in the block.
2. *Encode.*  The blocks' words meet word by word, so that each distinct word of the corpus is encoded once, and the
   ids go back to the blocks.  This runs in ``ROUNDS`` parts by fingerprint, which bounds the shuffled data at a time.
3. *Join back.*  Blocks and ids lie in tables bucketed by block; they meet without a shuffle, and each position of a
   document takes the ids of its word.
4. *Decode.*  Ids join the pieces of the vocabulary, a table of fixed size that every task holds.

The encoder must treat words between ASCII white space independently: its pre-tokenizer drops white space and no piece
crosses it.  ``Encoder`` checks that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import textcols
from .work import Scratch, check_broadcast, shuffle_partitions

BLOCK_BYTES = 8_000_000
ROUNDS = 6
_WORDS_AT_ONCE = 200_000
_ENCODED_AT_ONCE = 10_000
_SLICE_BYTES = 1_000_000


@dataclass
class Encoder:
    """A public tokenizer as the text of its file, so that tasks need no path."""

    definition: str

    def __post_init__(self):
        parsed = json.loads(self.definition)
        steps = [parsed["pre_tokenizer"], *(parsed["pre_tokenizer"] or {}).get("pretokenizers", [])]
        drops = any(s and s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and r"[^\s\p{L}\p{N}]" in s["pattern"].get("Regex", "") for s in steps)
        if not drops or parsed["post_processor"] or parsed["decoder"]:
            raise ValueError("this tokenizer doesn't treat words between white space independently")
        check_broadcast(len(self.definition.encode()), "the vocabulary")

    @classmethod
    def read(cls, path: str) -> Encoder:
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    def load(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def pieces(self) -> list[bytes]:
        tokenizer = self.load()
        return [(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size())]


def _pack(parts: list[bytes]) -> bytes:
    lengths = np.array([len(p) for p in parts], dtype="<u4")
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(parts)).tobytes() + lengths.tobytes() + b"".join(parts))


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    """Offsets and joined bytes of packed parts."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    lengths = np.frombuffer(raw[4 : 4 + 4 * n], "<u4").astype(np.int64)
    return np.append(0, np.cumsum(lengths)), raw[4 + 4 * n :]


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as one stream for each byte, which compresses well where small numbers are frequent."""
    return _pack([(numbers >> shift & 255).astype(np.uint8).tobytes() for shift in (0, 8, 16, 24)])


def _unpack_numbers(packed: bytes) -> np.ndarray:
    offsets, raw = _unpack(packed)
    out = np.zeros(int(offsets[1]), dtype=np.uint32)
    for shift, a, b in zip((0, 8, 16, 24), offsets[:-1], offsets[1:], strict=True):
        out |= np.frombuffer(raw[a:b], np.uint8).astype(np.uint32) << np.uint32(shift)
    return out


BLOCK_SCHEMA = "block bigint, docs array<bigint>, lengths array<int>, sequence binary, words binary"


def _same_words(held: list[tuple], offsets: np.ndarray, raw: bytes, number: np.ndarray) -> bool:
    """Whether each word of ``held`` has the bytes of the word ``number`` that its fingerprint made it."""
    data, at = np.frombuffer(raw, np.uint8), 0
    for _, begin, end, text in held:
        own = number[at : at + len(begin)]
        at += len(begin)
        length = end.astype(np.int64) - begin
        if (length != offsets[own + 1] - offsets[own]).any():
            return False
        # fingerprints of equally long words of up to eight bytes are different
        long = np.flatnonzero(length > 8)
        if (np.frombuffer(text, np.uint8)[_ranges(begin[long].astype(np.int64), length[long])] != data[_ranges(offsets[own[long]], length[long])]).any():
            return False
    return True


def _exact_codes(held: list[tuple]) -> list[tuple]:
    """``held`` with codes that no two words share, whatever their fingerprints."""
    known: dict[bytes, int] = {}
    out = []
    for _, begin, end, text in held:
        codes = [known.setdefault(text[s:e], len(known)) for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
        out.append((np.array(codes, dtype=np.uint64), begin, end, text))
    return out


def _split(block_bytes: int, prints: textcols.Prints):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lengths, held, size = [], [], [], 0  # held: code, begin and end of each word of a slice, and its bytes

        def numbered() -> tuple[np.ndarray, list[bytes]]:
            """The number of each word in the block, frequent words first, and the words."""
            distinct, first, back, n = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            number = np.empty(len(order), dtype=np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            edges = np.cumsum([0, *(len(h[0]) for h in held)])
            words: list[bytes] = [b""] * len(distinct)
            for base, stop, (_, begin, end, raw) in zip(edges[:-1], edges[1:], held, strict=True):
                here = np.flatnonzero((first >= base) & (first < stop))
                at = first[here] - base
                for i, s, e in zip(number[here].tolist(), begin[at].tolist(), end[at].tolist(), strict=True):
                    words[i] = raw[s:e]
            return number[back], words

        def flush() -> pa.RecordBatch:
            nonlocal held
            number, words = numbered()
            if not _same_words(held, np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64), b"".join(words), number):
                held = _exact_codes(held)
                number, words = numbered()
            # a name that no two blocks share; written once, so a later failure reads the same one
            row = (uuid.uuid4().int & ((1 << 63) - 1), docs, lengths, _pack_numbers(number), _pack(words))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["block", "docs", "lengths", "sequence", "words"])

        for batch in batches:
            for a, b, data, offsets in textcols.slices(batch.column(1), _SLICE_BYTES):
                found = textcols.words(data, offsets, prints)
                docs += batch.column(0).slice(a, b - a).to_pylist()
                lengths += np.diff(found.first).tolist()
                held.append((found.code, found.start.astype(np.uint32), found.end.astype(np.uint32), data.tobytes()))
                size += len(data)
                if size >= block_bytes or len(docs) >= block_bytes // 64:
                    yield flush()
                    docs, lengths, held, size = [], [], [], 0
        if docs:
            yield flush()

    return split


def _words_of(rounds: int, own: int, prints: textcols.Prints):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                offsets, raw = _unpack(packed)
                if len(offsets) < 2:
                    continue
                data = np.frombuffer(raw, np.uint8)
                code = prints.ranges(data, offsets[:-1], offsets[1:])
                for at in np.array_split(mine := np.flatnonzero(code % np.uint64(rounds) == own), max(1, len(mine) // 50_000)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([raw[offsets[i] : offsets[i + 1]] for i in at.tolist()], pa.binary()),
                            pa.array(np.full(len(at), block)),
                            pa.array(at.astype(np.int32)),
                        ],
                        names=["word", "block", "number"],
                    )

    return words


@lru_cache(maxsize=1)
def _loaded(definition: str):
    """A task's tokenizer, kept by its worker for the next task."""
    return Encoder(definition).load()


PART_SCHEMA = "block bigint, numbers binary, lengths binary, ids binary"


def _part(block: int, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Word numbers of a block with their ids, packed in one row."""
    row = (block, _pack_numbers(numbers), _pack_numbers(lengths), _pack_numbers(ids))
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "numbers", "lengths", "ids"])


def _encoded(encoder):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by word: the first of a word is encoded, the others take its ids.  Ids leave packed by block."""
        tokenizer = _loaded(encoder.value.definition)
        last, last_ids = None, np.zeros(0, np.uint32)
        for whole in batches:
            for start in range(0, whole.num_rows, _ENCODED_AT_ONCE):
                batch = whole.slice(start, _ENCODED_AT_ONCE)
                words = batch.column(0).to_pylist()
                new = np.array([a != b for a, b in zip(words, [last, *words[:-1]], strict=True)])
                texts = [words[i].decode("utf-8") for i in np.flatnonzero(new).tolist()]
                ids = [last_ids, *(np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))]
                nth = np.cumsum(new)
                last, last_ids = words[-1], ids[nth[-1]]
                size = np.array([len(x) for x in ids])
                begin, flat = np.cumsum(size) - size, np.concatenate(ids)
                block, number = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint32)
                order = np.argsort(block, kind="stable")
                edges = np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1]))
                for rows in np.split(order, edges[1:]):
                    own = nth[rows]
                    yield _part(int(block[rows[0]]), number[rows], size[own], flat[_ranges(begin[own], size[own])])

    return encode


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by block: one part for each block."""
    block, held = None, []

    def flush() -> pa.RecordBatch:
        return _part(block, *(np.concatenate([part[i] for part in held]) for i in range(3)))

    for batch in batches:
        for own, *packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if own != block:
                if held:
                    yield flush()
                block, held = own, []
            held.append([_unpack_numbers(p) for p in packed])
    if held:
        yield flush()


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _joined_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the ids of their words: one row for each document."""
    for batch in batches:
        for docs, lengths, sequence, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            number = _unpack_numbers(sequence)
            total = int(number.max()) + 1 if len(number) else 0
            size = np.zeros(total, np.int64)
            found = [[_unpack_numbers(part[name]) for name in ("numbers", "lengths", "ids")] for part in parts or ()]
            begin, base = np.zeros(total, np.int64), 0
            for own, own_size, flat in found:
                size[own] = own_size
                begin[own] = base + np.cumsum(size[own]) - size[own]
                base += len(flat)
            ids = np.concatenate([flat for _, _, flat in found]).astype("<u4") if found else np.zeros(0, "<u4")
            ends = np.append(0, np.cumsum(np.array(lengths, dtype=np.int64)))
            row = 0
            while row < len(docs):
                stop = max(row + 1, int(np.searchsorted(ends, ends[row] + _WORDS_AT_ONCE, side="right")) - 1)
                own = number[ends[row] : ends[stop]]
                n = np.append(0, np.cumsum(size[own]))
                tokens = ids[_ranges(begin[own], size[own])]
                cuts = n[ends[row : stop + 1] - ends[row]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[row:stop], pa.int64()),
                        pa.array(np.diff(cuts)),
                        pa.array([tokens[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc", "n_tokens", "ids"],
                )
                row = stop


class _Bucketed:
    """A table in the scratch folder, bucketed by block; its name leaves the catalogue when it is read, its files stay."""

    def __init__(self, scratch: Scratch, name: str, buckets: int):
        self.spark, self.path, self.buckets = scratch.spark, f"{scratch.path}/{name}", buckets
        self.table = f"siftline_{uuid.uuid4().hex}"

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").bucketBy(self.buckets, "block").sortBy("block").option("path", self.path).option("compression", "zstd").saveAsTable(self.table)

    def read(self) -> DataFrame:
        out = self.spark.table(self.table)
        self.spark.sql(f"DROP TABLE {self.table}")
        return out


def encode(docs: DataFrame, encoder: Encoder, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS, decoded: bool = False) -> DataFrame:
    """Per row of ``docs``: id, ``n_tokens`` and ``ids``, the token ids as little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded too, as ``decode`` does, by the same tasks.

    The same ids as the tokenizer's own for the whole text without special tokens added; control strings inside a text
    become special tokens, as there.  Null and empty texts have no tokens.  Repeated rows are kept, and ids may be
    null.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    buckets = shuffle_partitions(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    prints = textcols.Prints(textcols.draw_seed())
    split = _Bucketed(scratch, "blocks", buckets)
    split.add(source.mapInArrow(_split(block_bytes, prints), BLOCK_SCHEMA))
    blocks = split.read()
    held = spark.sparkContext.broadcast(encoder)
    table = _Bucketed(scratch, "ids", buckets)
    for own in range(rounds):
        words = blocks.select("block", "words").mapInArrow(_words_of(rounds, own, prints), "word binary, block bigint, number int")
        ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encoded(held), PART_SCHEMA)
        table.add(ids.repartition(buckets, "block").sortWithinPartitions("block").mapInArrow(_gathered, PART_SCHEMA))
        del words, ids
        scratch.drop()  # lets go of this round's shuffles
    parts = table.read().groupBy("block").agg(F.collect_list(F.struct("numbers", "lengths", "ids")).alias("parts"))
    met = blocks.select("block", "docs", "lengths", "sequence").join(parts.hint("shuffle_hash"), "block", "left").select("docs", "lengths", "sequence", "parts")
    if not decoded:
        return met.mapInArrow(_joined_back, "doc bigint, n_tokens bigint, ids binary").withColumnRenamed("doc", id_col)
    back = _decoded(_held_pieces(spark, encoder))
    return met.mapInArrow(lambda batches: back(_joined_back(batches)), "doc bigint, n_tokens bigint, ids binary, decoded string").withColumnRenamed("doc", id_col)


def _held_pieces(spark, encoder: Encoder):
    pieces = encoder.pieces()
    check_broadcast(sum(map(len, pieces)) + 64 * len(pieces), "the pieces")
    return spark.sparkContext.broadcast(pieces)


def _decoded(pieces):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [p + b" " for p in pieces.value]
        size = np.array([len(p) for p in table])
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            out = []
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw or b"", "<u4")
                text = b"".join(flat[_ranges(begin[ids[i : i + _WORDS_AT_ONCE]], size[ids[i : i + _WORDS_AT_ONCE]])].tobytes() for i in range(0, len(ids), _WORDS_AT_ONCE))
                out.append(text[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "decoded"])

    return decode


def decode(encoded: DataFrame, encoder: Encoder) -> DataFrame:
    """Adds ``decoded`` to rows with ``ids``: the ids' pieces with a space between, as the tokenizer decodes them.

    No or null ids give an empty text.  An id outside the vocabulary is an error.
    """
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(_decoded(_held_pieces(encoded.sparkSession, encoder)), schema)
