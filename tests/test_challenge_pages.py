"""Bot challenges are told by the first 96 KiB of a page, wherever these end."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftline.functions import text
from siftline.sources import boards

HEAD = 98_304
MARK = '<i id="CF-browser-verification">'


def told(spark, pages):
    rows = spark.createDataFrame([(n, bytearray(page)) for n, page in enumerate(pages)], "n int, page binary")
    rows = rows.select("n", text.challenge_page(F.col("page").cast("string")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["n"])]


def test_the_head_may_end_inside_a_character(spark):
    pages, wanted = [], []
    for char in ("é", "€", "😀"):
        for kept in range(1, len(char.encode())):  # so many of its bytes are in the head
            for before, behind, challenge in (("", "", False), ("", MARK, False), (MARK, "", True), ("", "é" * HEAD, False)):
                pages.append((before + "x" * (HEAD - kept - len(before)) + char + behind).encode())
                wanted.append(challenge)
            pages.append(("x" * (HEAD - kept - len(MARK)) + MARK + char).encode())  # the mark ends where the character begins
            wanted.append(True)
    assert all(page[HEAD] & 0xC0 == 0x80 for page in pages)
    assert told(spark, pages) == wanted


def test_the_head_is_counted_in_bytes_as_they_are(spark):
    latin = b"\xe9" * (HEAD - len(MARK))  # not UTF-8
    assert told(spark, [latin + MARK.encode(), latin + b"xxx" + MARK.encode(), b"\xff" + MARK.encode()]) == [True, False, True]
    assert told(spark, [("é" * ((HEAD - len(MARK)) // 2) + MARK).encode(), ("é" * (HEAD // 2) + MARK).encode()]) == [True, False]


def test_a_long_detail_page_is_read(spark):
    def script(block):
        return f'<script type="application/ld+json">{json.dumps(block, ensure_ascii=False)}</script>'

    links = script({"@type": "ItemList", "itemListElement": [{"url": f"https://b.io/{n}"} for n in range(4)]})
    pages = spark.createDataFrame([("POL", 1, "https://b.io/jobs", links)], "alpha_3 string, page int, url string, body string")
    bodies = [script({"@type": "JobPosting", "title": "T", "hiringOrganization": {"name": "C"}, "description": "x" * n + "ç" * HEAD}) for n in range(2)]
    assert any(body.encode()[HEAD] & 0xC0 == 0x80 for body in bodies)
    bodies += [MARK + bodies[0], MARK + bodies[1]]
    details = spark.createDataFrame([(1, f"https://b.io/{n}", body) for n, body in enumerate(bodies)], "page int, url string, body string")
    found = boards.builtin(pages, details, "dev").select("url", "description").collect()
    assert sorted((r["url"], r["description"]) for r in found) == [("https://b.io/0", "ç" * HEAD), ("https://b.io/1", "x" + "ç" * HEAD)]
