"""Ordered reads against a loop that reads page by page, and the boards' own rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions.places import Countries
from siftline.sources import boards, paging
from siftline.sources.paging import Stop

PAGE = "page int, url string, body string"


def looped(read, stop):
    """Cards that a read keeps: pages (ended, urls) one after the other."""
    kept, seen = [], set()
    for at, (page, ended, urls) in enumerate(read):
        before = len(kept)
        for place, url in enumerate(urls):
            if url not in seen:
                seen.add(url)
                kept.append((page, place, url))
        if ended or (stop.nothing_new and at and len(kept) == before) or (stop.cap and len(kept) >= stop.cap) or (stop.pages and at + 1 >= stop.pages):
            break
    return kept[: stop.cap] if stop.cap else kept


@pytest.mark.parametrize("stop", [Stop(), Stop(cap=7), Stop(cap=9, nothing_new=True), Stop(pages=3), Stop(cap=25, pages=9, nothing_new=True)])
@pytest.mark.parametrize("block", [1, 3, 4096])
def test_reads(spark, monkeypatch, stop, block):
    monkeypatch.setattr(paging, "BLOCK", block)
    rng = random.Random(block)
    reads = {}
    for r in range(12):
        numbers = sorted(rng.sample(range(40), rng.randint(1, 12)))
        reads[f"r{r}"] = [(n, rng.random() < 0.1, [None if rng.random() < 0.05 else f"u{rng.randint(0, 12 if n % 3 else 2)}" for _ in range(rng.randint(0, 6))]) for n in numbers]
    pages = spark.createDataFrame([(r, n, e or None) for r, ps in reads.items() for n, e, _ in ps], "read string, page int, ended boolean")
    cards = spark.createDataFrame([(r, n, k, u, "more") for r, ps in reads.items() for n, _, us in ps for k, u in enumerate(us)], "read string, page int, place int, url string, more string")
    found = {}
    for row in paging.until(cards, pages, stop).orderBy("read", "nth").collect():
        found.setdefault(row["read"], []).append((row["page"], row["place"], row["url"]))
        assert row["nth"] == len(found[row["read"]]) and row["more"] == "more"
    assert found == {r: kept for r, ps in reads.items() if (kept := looped(ps, stop))}


def test_no_task_gets_a_whole_read(spark):
    pages = spark.range(100).select(F.lit(0).alias("read"), F.col("id").alias("page"), F.lit(1).alias("new"), F.lit(False).alias("ended"))
    plan = paging.pages_read(pages, Stop(cap=3))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_block" in line for line in windows)


def test_limits():
    assert [paging.limited(n, 100, 500) for n in (None, 0, -1, 7, 900)] == [100, 100, 100, 7, 500]


def card(n):
    return f'<li class="l-vacancy"><div class="title"><a class="vt" href="/v/{n}/">T{n}</a> <strong><a class="company">C</a></strong></div></li>'


@pytest.mark.parametrize(("more", "most", "found"), [([([2, 3], False), ([3], False), ([4], False)], None, 4), ([([2], True), ([3], False)], None, 3), ([([2, 3], False), ([4], False)], 3, 3), ([], None, 2)])
def test_dou_stops(spark, more, most, found):
    pages = spark.createDataFrame([(1, "https://d.ua/vacancies/", card(0) + card(1) + card(0))], PAGE)
    parts = [(k, "https://d.ua/vacancies/", json.dumps({"html": "".join(map(card, ns)), "last": last})) for k, (ns, last) in enumerate(more)]
    fragments = spark.createDataFrame(parts, PAGE) if parts else None
    jobs = boards.dou(pages, fragments, pages.where("false"), Countries({}), __import__("datetime").datetime(2024, 1, 1), max_jobs=most)
    assert sorted(r["title"] for r in jobs.collect()) == [f"T{n}" for n in range(found)]


def test_a_card_without_a_link_fails_only_a_read_that_gets_there(spark):
    def page(number, *cards, more=True):
        return number, "https://e.co/", json.dumps({"has_more": more, "html": "".join(cards)})

    good = '<div class="job-card"><h2 class="job-title"><a href="/j/1">T</a></h2><div class="company-name">C</div></div>'
    read = lambda *rows: boards.europe_remotely(spark.createDataFrame(list(rows), PAGE), spark.createDataFrame([], PAGE), Countries({}), __import__("datetime").datetime(2024, 1, 1)).count()
    bad = '<div class="job-card"></div>'
    assert read(page(1, good, more=False), page(2, bad)) == 1
    assert read(page(1, good), page(2), page(3, bad)) == 1  # two pages by default
    with pytest.raises(Exception, match="without a link"):
        read(page(1, good), page(2, bad))


def test_searched_pages(spark):
    made = lambda ids, **more: json.dumps({"jobs": [{"title": "T", "companyName": "C", "guid": f"https://h.co/{i}"} for i in ids], **more})
    rows = [(1, "", made([1, 2], limit=3, totalCount=7)), (2, "", made([3], limit=3, totalCount=7)), (3, "", made([4], limit=3, totalCount=7)), (4, "", made([5], limit=3, totalCount=7))]
    pages = spark.createDataFrame(rows, PAGE)
    assert boards.himalayas(pages, Countries({}), search=True).count() == 4  # ceil(7 / 3) pages, short ones don't end a search
    assert boards.himalayas(pages, Countries({})).count() == 2  # a short page ends browsing
    assert boards.himalayas(pages, Countries({}), search=True, max_pages=2).count() == 3
    assert sorted(r["url"] for r in boards.himalayas(pages, Countries({}), search=True, max_jobs=3).collect()) == ["https://h.co/1", "https://h.co/2", "https://h.co/3"]


def test_only_listed_details_are_sorted_and_read(spark):
    pages = spark.createDataFrame([("POL", 1, "https://b.co/", '<script type="application/ld+json">{"@graph":[{"@type":"ItemList","itemListElement":[{"url":"https://b.co/1"}]}]}</script>')], f"alpha_3 string, {PAGE}")
    posting = '<script type="application/ld+json">{"@type":"JobPosting","title":"T","hiringOrganization":{"name":"C"}}</script>'
    details = spark.createDataFrame([(1, f"https://b.co/{n}", posting) for n in (1, 2)], PAGE)
    jobs = boards.builtin(pages, details, "dev")
    plan = jobs._jdf.queryExecution().optimizedPlan().toString()
    assert [r["url"] for r in jobs.collect()] == ["https://b.co/1"]
    assert "LeftSemi" in plan
