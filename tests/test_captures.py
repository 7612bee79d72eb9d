"""The source of captured pages: what filters leave to be planned, and the requests that its rows tell."""

from __future__ import annotations

import json

import pytest

from siftline.functions.places import Countries
from siftline.sources import boards, captures

JOB = {"title": "T", "companyName": "C"}


@pytest.fixture(scope="module")
def capture(spark, tmp_path_factory):
    captures.register(spark)
    path = str(tmp_path_factory.mktemp("captures") / "c")
    answer = lambda term, page: json.dumps({"limit": 2, "totalCount": 5, "jobs": [JOB | {"guid": f"https://h.co/{term}-{page}"}]})
    rows = [("search", term, page, answer(len(term), page) if page < 4 else "broken") for term in ("go dev", "a/b=%", "x") for page in range(1, 6)]
    rows += [("browse", None, page, answer("all", page)) for page in range(3)]
    captures.capture(spark.createDataFrame(rows, "mode string, term string, page int, body string"), path)
    return path


def read(spark, path, **options):
    return spark.read.format(captures.NAME).options(path=path, **options).load()


def test_declared_pages_only(spark, capture):
    found = read(spark, capture, mode="search").select("term", "page").collect()
    assert sorted(map(tuple, found)) == sorted((t, p) for t in ("go dev", "a/b=%", "x") for p in (1, 2, 3))
    assert read(spark, capture).count() == 3


@pytest.mark.parametrize(("asked", "left"), [("term = 'go dev'", 3), ("term in ('x', 'a/b=%') and page <= 2", 4), ("term = 'x' and page = 2", 1), ("page > 1 and page < 3", 3), ("page in (1, 3)", 6), ("term = 'none'", 0), ("term = 'x' and length(body) > 0", 3)])
def test_filters_prune_pages(spark, capture, asked, left):
    pages = read(spark, capture, mode="search").where(asked)
    assert pages.count() == left
    assert pages.rdd.getNumPartitions() == max(left, 1)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "length(body" in plan or " Filter " not in plan  # the rest is left to Spark


def test_requests(spark, capture):
    rows = {r["term"]: r["request"] for r in read(spark, capture, mode="search").where("page = 2").collect()}
    assert rows["go dev"] == "https://himalayas.app/jobs/api/search?page=2&q=go+dev"
    assert read(spark, capture, limit="20").where("page = 2").first()["request"] == "https://himalayas.app/jobs/api?offset=40&limit=20"
    asked = json.loads(captures.BOARDS["working_nomads"].request("search", "go", 3, 100))
    assert asked["from"] == 200 and asked["query"]["multi_match"]["fields"][0] == "title^2" and asked["query"]["multi_match"]["operator"] == "and"
    assert captures.BOARDS["djinni"].request("search", "", 1, 15) == "https://djinni.co/jobs/?all_keywords=go&page=1&search_type=full-text"
    assert captures.BOARDS["dou_ua"].request("search", "c++", 1, 20) == "https://jobs.dou.ua/vacancies/?descr=1&search=c%2B%2B"


def test_a_board_reads_a_capture(spark, capture):
    jobs = boards.himalayas(read(spark, capture, mode="search").where("term = 'x'"), Countries({}), search=True)
    assert sorted(r["url"] for r in jobs.collect()) == ["https://h.co/1-1", "https://h.co/1-2", "https://h.co/1-3"]


def test_bad_options(spark, capture):
    with pytest.raises(Exception, match="bad mode"):
        read(spark, capture, mode="x").count()


def test_terms_in_one_field(spark):
    rows = spark.createDataFrame([(1, "Go", "dev", ["x"]), (2, "dev go", None, None), (3, "a", "b", ["GO", "dev"])], "id int, title string, description string, tags array<string>")
    told = lambda board, query="go dev": sorted(r["id"] for r in boards.matching(rows, query, board).collect())
    assert (told("working_nomads"), told("djinni"), told("djinni", " ")) == ([2, 3], [1, 2, 3], [1, 2, 3])


def test_a_long_read_is_planned_by_blocks(spark, tmp_path):
    """Files and tasks follow the blocks; a block's other pages are no rows."""
    pages = spark.range(4000).selectExpr("'browse' mode", "concat('t', id % 4) term", "cast(id div 4 as int) page", "concat('body\n', id) body")
    captures.capture(pages, str(tmp_path / "c"))
    blocks = 4 * -(-1000 // captures.BLOCK)
    assert len(list((tmp_path / "c").rglob("*.parquet"))) == blocks
    found = read(spark, str(tmp_path / "c"))
    assert found.rdd.getNumPartitions() == blocks
    assert found.selectExpr("count(*)", "count(distinct term, page)", "count_if(body = concat('body\n', page * 4 + cast(substring(term, 2) as int)))").first() == (4000, 4000, 4000)
    some = found.where("page >= 100 and page <= 900 and page not in (0)")
    assert some.rdd.getNumPartitions() == 4 * (900 // captures.BLOCK - 100 // captures.BLOCK + 1) and some.count() == 4 * 801
    few = found.where("term = 't1' and page in (3, 70, 999, 1000)")
    assert few.rdd.getNumPartitions() == 3 and sorted(r["page"] for r in few.collect()) == [3, 70, 999]


def test_partitions_grow_slower_than_pages(monkeypatch):
    listed = {"/c/mode=browse": [("", "/c/t")], "/c/t": [(str(n), f"/c/t/{n}") for n in range(100_000)]}
    monkeypatch.setattr(captures._Reader, "_listed", lambda self, files, path, key: listed[path])
    planned = captures._Reader({"path": "/c"}).partitions()
    assert len(planned) == 100_000 // captures.BLOCKS_AT_ONCE and sum(len(p.blocks) for p in planned) == 100_000
