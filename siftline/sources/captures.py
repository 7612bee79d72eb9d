"""Captured pages as a data source: searches and page ranges pushed down, pages planned one by one or by blocks.

A capture is a folder of answers, ``mode=<browse|search>/term=<search>/block=<n>/``, as ``capture`` writes it: a block
holds the answers of ``BLOCK`` consecutive page numbers, so files, tasks and what they report grow with the blocks and not
with the pages.  The source plans only the pages that a read would ask for: those of the searches that a filter on ``term``
names, within the bounds that filters on ``page`` set, up to the number of pages that the first answer of a search
declares.  A read of up to ``FEW_BLOCKS`` blocks has a partition for each page, a longer one for each block or several.
Blocks without a planned page are never opened, other pages of a block never become rows.  Each row tells the request that
its page answers, in the board's own terms.

Folders are opened through Arrow's file systems (local paths, HDFS, object stores), in the planning and reading workers.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlencode

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

NAME = "captured_pages"
SCHEMA = "read string, term string, page int, url string, request string, body string"
BROWSE, SEARCH = "browse", "search"
_NO_TERM = "__HIVE_DEFAULT_PARTITION__"
#: Page numbers of a block of a capture.
BLOCK = 64
#: A read of more blocks isn't planned page by page.
FEW_BLOCKS = 8
#: Blocks of a partition, where there are enough of them for ``PARTITIONS`` partitions.
BLOCKS_AT_ONCE, PARTITIONS = 16, 256
#: Bytes that the writer gathers before it ends a row group; a reader holds one.
_ROW_GROUP = 8 << 20


@dataclass(frozen=True)
class Board:
    """How a board is asked: its address, names of the parameters, and fixed ones.

    ``term`` names the parameter that takes the search words; ``page`` the one that counts pages.  ``offset`` (with a page
    size) is for browsing.  ``fields`` (a name, and its weight where it has one) is for boards that take a query body.
    """

    search: str
    term: str = ""
    page: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    browse: str = ""
    offset: tuple[str, str] | None = None
    fields: tuple[str, ...] = ()
    default_term: str = ""

    def request(self, mode: str, term: str, page: int, limit: int) -> str:
        if self.fields:
            query: dict = {"match_all": {}}
            if term:
                query = {"multi_match": {"query": term, "fields": list(self.fields), "type": "best_fields", "operator": "and"}}
            return json.dumps({"track_total_hits": True, "from": (page - 1) * limit, "size": limit, "query": query})
        if mode == BROWSE and self.offset:
            return f"{self.browse}?{urlencode(dict(zip(self.offset, (page * limit, limit), strict=True)))}"
        asked = {self.term: term or self.default_term, **dict(self.fixed), self.page: str(page)}
        return f"{self.search}?{urlencode({k: v for k, v in sorted(asked.items()) if k and v})}"


# Addresses and parameters of the boards.
BOARDS = {
    "working_nomads": Board("https://www.workingnomads.com/jobsapi/_search", fields=("title^2", "description", "tags", "all_tags", "category_name")),
    "himalayas": Board("https://himalayas.app/jobs/api/search", "q", "page", browse="https://himalayas.app/jobs/api", offset=("offset", "limit")),
    "europe_remotely": Board("https://euremotejobs.com/wp-admin/admin-ajax.php", "search_keywords", "page"),
    "dou_ua": Board("https://jobs.dou.ua/vacancies/", "search", fixed=(("descr", "1"),)),
    "djinni": Board("https://djinni.co/jobs/", "all_keywords", "page", (("search_type", "full-text"),), default_term="go"),
}


@dataclass(frozen=True)
class Block:
    """Pages of one search from ``first`` to ``last`` that lie in one folder; ``numbers``, if any, are the only ones asked for."""

    term: str
    folder: str
    first: int
    last: int
    numbers: frozenset[int] | None = None

    def __contains__(self, number: int) -> bool:
        return self.first <= number <= self.last and (self.numbers is None or number in self.numbers)


class Blocks(InputPartition):
    def __init__(self, blocks: tuple[Block, ...]):
        super().__init__(None)
        self.blocks = blocks


def pages_declared(body: str) -> int | None:
    """Number of pages that an answer declares by its total and page size; None where it doesn't."""
    try:
        answer = json.loads(body)
    except ValueError:
        return None
    if not isinstance(answer, dict):
        return None
    hits = answer.get("hits")
    total, limit = answer.get("totalCount"), answer.get("limit")
    if isinstance(hits, dict):
        total, limit = (hits.get("total") or {}).get("value"), len(hits.get("hits") or [])
    return -(-int(total) // int(limit)) if total and limit else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.mode = options["path"], options.get("mode", BROWSE)
        self.board = BOARDS[options.get("board", "himalayas")]
        self.limit = int(options.get("limit", "20"))
        self.terms: set[str] | None = {options["term"]} if "term" in options else None
        self.first, self.last, self.numbers = 0, None, None
        if self.mode not in (BROWSE, SEARCH):
            raise ValueError(f"bad mode: {self.mode!r}")

    def _narrowed(self, *, first: int | None = None, last: int | None = None) -> None:
        self.first = max(self.first, first) if first is not None else self.first
        self.last = last if self.last is None else self.last if last is None else min(self.last, last)

    def _push(self, asked: Filter) -> bool:
        """Whether a filter is wholly done by planning."""
        of = getattr(asked, "attribute", None)
        value = getattr(asked, "value", None)
        if isinstance(asked, IsNotNull):
            return True  # no column is ever null
        if of == ("term",) and isinstance(asked, (EqualTo, EqualNullSafe, In)) and value is not None:
            wanted = set(value) if isinstance(asked, In) else {value}
            self.terms = wanted if self.terms is None else self.terms & wanted
            return True
        if of != ("page",) or value is None:
            return False
        if isinstance(asked, In):
            self.numbers = set(value) if self.numbers is None else self.numbers & set(value)
        elif isinstance(asked, (EqualTo, EqualNullSafe)):
            self._narrowed(first=value, last=value)
        elif isinstance(asked, (LessThan, LessThanOrEqual)):
            self._narrowed(last=value - isinstance(asked, LessThan))
        elif isinstance(asked, (GreaterThan, GreaterThanOrEqual)):
            self._narrowed(first=value + isinstance(asked, GreaterThan))
        else:
            return False
        return True

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return [f for f in filters if not self._push(f)]

    def _listed(self, files: fs.FileSystem, path: str, key: str) -> list[tuple[str, str]]:
        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = [(posixpath.basename(f.path), f.path) for f in found if f.type == fs.FileType.Directory]
        return sorted((unquote(name.removeprefix(f"{key}=")), at) for name, at in names if name.startswith(f"{key}="))

    def partitions(self) -> Sequence[InputPartition]:
        files, root = opened(self.path)
        blocks: list[Block] = []
        for term, folder in self._listed(files, f"{root}/mode={self.mode}", "term"):
            term = "" if term == _NO_TERM else term
            if self.terms is not None and term not in self.terms:
                continue
            listed = sorted((int(number), at) for number, at in self._listed(files, folder, "block"))
            most = self._declared(files, listed) if self.mode == SEARCH else None
            last = min((x for x in (self.last, most) if x is not None), default=None)
            for number, at in listed:
                begin, end = number * BLOCK, number * BLOCK + BLOCK - 1
                begin, end = max(begin, self.first), end if last is None else min(end, last)
                numbers = None if self.numbers is None else frozenset(x for x in self.numbers if begin <= x <= end)
                if begin <= end and (numbers is None or numbers):
                    blocks.append(Block(term, at, begin, end, numbers))
        if len(blocks) <= FEW_BLOCKS:
            return [Blocks((Block(b.term, b.folder, n, n),)) for b in blocks for n in _numbers(files, b)]
        at_once = min(BLOCKS_AT_ONCE, -(-len(blocks) // PARTITIONS))
        return [Blocks(tuple(blocks[i : i + at_once])) for i in range(0, len(blocks), at_once)]

    def _declared(self, files: fs.FileSystem, blocks: list[tuple[int, str]]) -> int | None:
        if not blocks:
            return None
        number, folder = blocks[0]
        first = _numbers(files, Block("", folder, number * BLOCK, number * BLOCK + BLOCK - 1))[0]
        return pages_declared(next(_answers(files, Block("", folder, first, first)))[1])

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        files, _ = opened(self.path)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        for block in partition.blocks:
            for number, body in _answers(files, block):
                row = (block.term, block.term, number, self.board.search, self.board.request(self.mode, block.term, number, self.limit), body)
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a bare path is a local one."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _parts(files: fs.FileSystem, folder: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(folder))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not posixpath.basename(f.path).startswith(("_", ".")))


def _numbers(files: fs.FileSystem, block: Block) -> list[int]:
    """Numbers of a block's pages, for which the answers themselves aren't read."""
    found: set[int] = set()
    for part in _parts(files, block.folder):
        with files.open_input_file(part) as source:
            found.update(pq.ParquetFile(source).read(columns=["page"]).column("page").to_pylist())
    return sorted(n for n in found if n in block)


def _answers(files: fs.FileSystem, block: Block) -> Iterator[tuple[int, str]]:
    """Numbers and bodies of a block's pages in order; rows of one page, which lie together, are lines of one answer."""
    held: tuple[int, list[str]] | None = None
    for part in _parts(files, block.folder):
        with files.open_input_file(part) as source:
            table = pq.ParquetFile(source)
            for group in range(table.num_row_groups):
                if not any(n in block for n in table.read_row_group(group, columns=["page"]).column("page").unique().to_pylist()):
                    continue
                for batch in table.iter_batches(16, [group], ["page", "body"]):
                    for number, body in zip(batch.column("page").to_pylist(), batch.column("body"), strict=True):
                        if number not in block:
                            continue
                        if held and held[0] != number:
                            yield held[0], "\n".join(held[1])
                            held = None
                        held = held or (number, [])
                        held[1].append(body.as_py() or "")
    if held:
        yield held[0], "\n".join(held[1])


class CapturedPages(DataSource):
    """``spark.read.format("captured_pages")``: options ``path``, ``board``, ``mode``, ``limit`` (page size), ``term``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("a capture needs a path")
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CapturedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def capture(pages: DataFrame, path: str) -> None:
    """Writes answers ``(mode, term, page, body)`` as a capture; a body may span lines."""
    block = F.floor(F.col("page") / BLOCK).cast("int")
    dealt = pages.select("mode", "term", "page", "body", block.alias("block")).repartition("mode", "term", "block")
    writer = dealt.sortWithinPartitions("mode", "term", "block", "page").write.partitionBy("mode", "term", "block")
    writer.option("parquet.block.size", _ROW_GROUP).option("compression", "zstd").parquet(path)
