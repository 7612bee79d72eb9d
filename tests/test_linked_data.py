"""Linked data and character references: rules of the boards, and the standard library's own decoding."""

from __future__ import annotations

import html
import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import linked_data, markup
from siftline.functions.places import Countries
from siftline.functions.references import unescaped
from siftline.sources import boards

PAGE = "page int, url string, body string"
POSTING = {"@type": "JobPosting", "title": " T ", "hiringOrganization": {"name": " C "}}


def script(block, kind='"application/ld+json"'):
    return f"<script type={kind}>{block if isinstance(block, str) else json.dumps(block)}</script>"


def told(spark, pages, column):
    rows = spark.createDataFrame(list(enumerate(pages)), "n int, page string").select("n", column(F.col("page")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["n"])]


def postings(spark, pages):
    rows = spark.createDataFrame([(n, f"https://x.y/{n:03}", page) for n, page in enumerate(pages)], PAGE)
    return boards.with_posting(rows).orderBy("_url").collect()


def test_first_posting(spark):
    other = {"@type": "Organization"}
    pages = {
        script(POSTING): ("T", None),
        script([other, POSTING, POSTING | {"title": "U"}]): ("T", None),
        script({"@graph": [other, POSTING | {"title": "G"}], **POSTING}): ("G", None),
        script({"@graph": [other], **POSTING}): ("T", None),
        script({"@type": ["x", " jobposting "], "title": "L"}): ("L", None),
        script(other) + script("  ") + script(POSTING, "'application/ld+json'"): ("T", None),
        script("not data") + script(POSTING, "application/ld+json"): ("T", None),
        script("{broken") + script(POSTING): (None, "broken linked data"),
        script(POSTING) + script("{broken"): ("T", None),
        script("[1,") + script(POSTING): (None, "broken linked data"),
        script(POSTING | {"title": 5}): ("", "a posting whose title is not a string"),
        script(POSTING | {"title": None}): ("", None),
        script({"@type": 5}): (None, None),
        script(POSTING, '"text/javascript"'): (None, None),
        f"<!-- {script(POSTING)} -->": (None, None),
        f'<script>var a = "<!--";</script>{script(POSTING)}': ("T", None),
        f"<SCRIPT data-x='>' {script(POSTING)[8:]}": ("T", None),
        "": (None, None),
    }
    both = postings(spark, list(pages))
    assert [(r["detail"] and r["detail"]["title"], r["wrong"]) for r in both] == list(pages.values())


def test_fields(spark):
    block = POSTING | {"skills": ["Go", " ", "é"], "qualifications": "one", "occupationalCategory": [1, "x"], "employmentType": ["A", "B"], "baseSalary": {"value": 5.5}, "description": " <b>d</b> ", "jobLocation": None}
    found = postings(spark, [script(block)])[0]["detail"]
    assert (found["company"], found["skills"], found["qualifications"], found["occupation"], found["employment_type"]) == ("C", ["Go", "é"], ["one"], [], "A, B")
    assert (json.loads(found["base_salary"]), found["description"], found["job_location"], found["applicant_location"]) == ({"value": 5.5}, " <b>d</b> ", "null", None)


def test_item_links(spark):
    listed = lambda *elements: {"@type": "itemlist", "itemListElement": list(elements)}
    pages = {
        script(listed({"url": " u "}, {"url": "", "item": "no"}, {"url": None, "item": "no"}, {"url": 5, "item": "i"}, {"item": {"url": "o"}}, {"item": ["x"]}, "text", 7)): ["u", "i", "o"],
        script([listed({"url": "a"}), {"@type": "x"}, listed({"url": "b"})]): ["a", "b"],
        script({"@graph": [listed({"url": "g"})], **listed({"url": "own"})}): ["g"],
        script({"@graph": [listed()], **listed({"url": "own"})}): ["own"],
        script("{broken") + script(listed({"url": "c"})): ["c"],
        script({"@type": "ItemList", "itemListElement": {"url": "x"}}): [],
        "": [],
    }
    assert told(spark, list(pages), linked_data.item_urls) == list(pages.values())


def test_apply_links(spark):
    button = '<a class=x href="/go?a=1&amp;b=2" id="applyButton">Apply</a>'
    pages = {
        button: "https://b.io/go?a=1&b=2",
        button.replace("/go?a=1&amp;b=2", "//ats.io/x"): "https://ats.io/x",
        button.replace("/go", "mailto:x") + r'<script>init({"job": {"howToApply" : "https:\/\/e.io\/\"q\"", "z": [1]}, "y": 2});</script>': 'https://e.io/"q"',
        f"<!-- {button} -->": "",
        f"<script>var x = '{button}';</script>": "",
        '<a id="applyButton">no link</a><a id=applyButton href=HTTP://x.io>': "HTTP://x.io",
        '{"howToApply": 5}': "",
        "": "",
    }
    assert told(spark, list(pages), lambda p: linked_data.apply_url(p, F.lit("https://b.io/job/1"))) == list(pages.values())


def test_references(spark):
    bits = "&amp; &lt &notit; &notin; &#39; &#x27 &#128; &#x80; &#0; &#xD800; &#1114112; &#99999999999999999999; & && &; &#; &#x; &Aacute &hellip; &ngE; a=1&b=2&copy=3 &nbsp; &#13; &#1; &#xfdd0; &#x1F600; é &unknown; &ampx &amp;lt; &#150 &#x0000000000000000000041; &#xFFFE".split(" ")
    rng = random.Random(2)
    rows = ["".join(rng.choices(bits, k=rng.randint(0, 6))) for _ in range(500)] + ["&" + name + tail for name in html.entities.html5 for tail in ("", "x")]
    assert told(spark, rows, unescaped) == [html.unescape(r) for r in rows]


def test_references_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", markup.plain(F.col("html")).alias("x"))
    for row in pages.collect():
        bare = __import__("re").sub(r"(?s)<[^>]*>", " ", row["html"] or "")
        assert row["x"] == " ".join(html.unescape(bare).split())
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_broken_data_fails_one_board_and_is_skipped_by_the_other(spark):
    card = '<li><a href="/jobs/7-dev/"><h2 class="job-item__position">Dev</h2></a></li>'
    pages = spark.createDataFrame([(1, "https://d.co/jobs/", card)], PAGE)
    bad = spark.createDataFrame([(1, "https://d.co/jobs/7-dev", script("{broken") + script(POSTING))], PAGE)
    with pytest.raises(Exception, match="broken linked data"):
        boards.djinni(pages, bad, Countries({})).select("title").collect()
    links = script({"@type": "ItemList", "itemListElement": [{"url": "https://b.io/1"}, {"url": "https://b.io/2"}, {"url": "/relative"}]})
    listed = spark.createDataFrame([("POL", 1, "https://b.io/jobs", links)], "alpha_3 string, page int, url string, body string")
    details = spark.createDataFrame([(1, "https://b.io/1", script("{broken")), (1, "https://b.io/2", script(POSTING | {"url": "https://b.io/own/"}))], PAGE)
    found = boards.builtin(listed, details, "dev")
    assert [r["url"] for r in found.collect()] == ["https://b.io/own"]
    assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()
