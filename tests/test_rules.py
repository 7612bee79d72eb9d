"""Scalar rules and markup."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftline.functions import dates, identity, linked_data, lists, markup, pay, places, text

NOW = datetime(2026, 4, 10)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["https://Ex.COM/a/", " https://ex.com/a?q=1", "HTTPS://ex.com/a#f", "https://ex.com/a", "https://ex.com/a/?x"])
def test_url_spellings_have_one_identity(spark, raw):
    assert value(spark, identity.canonical_url(F.lit(raw))) == "https://ex.com/a"


@pytest.mark.parametrize("raw", ["", "  ", "ftp://x/y", "no url", None])
def test_other_urls_have_none(spark, raw):
    assert value(spark, identity.stable_id(F.lit("s"), F.lit(raw).cast("string"))) is None


def test_apply_url_stands_in(spark):
    assert value(spark, identity.assigned_id(F.lit(" S "), F.lit(" "), F.lit("https://x.y/z"))) == "s\u001ehttps://x.y/z"


def test_filter_key_needs_content():
    slot = "00000000-0000-0000-0000-000000000001"
    with pytest.raises(ValueError):
        identity.FilterKey(slot).canonical()
    key = identity.FilterKey(slot, ["Go ", "go", "dev"], None, ["B", "a"], True, ["de"])
    assert key.canonical() == f'{{"slot_id":"{slot}","role":"dev go","sources":["a","b"],"keywords":["__remote_only__","country:de"]}}'
    assert len(key.digest()) == 64


@pytest.mark.parametrize(
    ("shown", "expected"),
    [("Posted 2 days ago", datetime(2026, 4, 8)), ("1 month ago", datetime(2026, 3, 11)), ("0 days ago", None), ("soon", None), ("March 28, 2026", None)],
)
def test_relative_dates(spark, shown, expected):
    assert value(spark, dates.relative(F.lit(shown), F.lit(NOW))) == expected


@pytest.mark.parametrize(("shown", "expected"), [("March 28, 2026", datetime(2026, 3, 28)), ("8 March 2026", datetime(2026, 3, 8)), ("2026-03-28T10:00:00Z", datetime(2026, 3, 28, 10)), ("x", None)])
def test_absolute_dates(spark, shown, expected):
    assert value(spark, dates.absolute(F.lit(shown))) == expected


@pytest.mark.parametrize(("shown", "expected"), [("8 квітня", datetime(2026, 4, 8)), ("8 грудня", datetime(2025, 12, 8)), ("8 квітня 2024", datetime(2024, 4, 8)), ("8 foo", None)])
def test_ukrainian_dates(spark, shown, expected):
    assert value(spark, dates.ukrainian(F.lit(shown), F.lit(NOW))) == expected


def test_positions_and_remote(spark):
    none = F.array().cast("array<string>")
    assert value(spark, text.position(F.lit("Backend"), F.lit("or front end"), none)) == "frontend"
    assert value(spark, text.position(F.lit("Cook"), F.lit(None).cast("string"), none)) is None
    assert value(spark, text.remote(F.lit("x"), F.lit("y"), none, F.lit("Віддалено"))) is True
    assert value(spark, text.remote(F.lit(None).cast("string"), F.lit(None).cast("string"), none)) is False


@pytest.mark.parametrize(("least", "most", "expected"), [(1000000.0, None, "1e+06+ EUR"), (50000.0, 60000.5, "50000-60000.5 EUR"), (None, 1234567.0, "up to 1.234567e+06 EUR"), (None, None, "")])
def test_salary_bounds(spark, least, most, expected):
    assert value(spark, pay.from_bounds(F.lit(least).cast("double"), F.lit(most).cast("double"), F.lit("EUR"))) == expected


def test_structured_salary(spark):
    raw = '{"currency":"USD","value":{"minValue":550,"maxValue":"650","unitText":"MONTH"}}'
    assert value(spark, pay.from_json(F.lit(raw))) == "550–650 USD / month"
    assert value(spark, pay.from_json(F.lit("{"))) == ""


def test_countries_and_tags(spark):
    known = places.Countries({"Germany": "de"})
    assert value(spark, known.first(F.array(F.lit("Remote, Moon")), F.array(F.lit("UK, Germany")))) == "GB"
    assert value(spark, lists.merged(F.array(F.lit("Go"), F.lit(" ")), F.array(F.lit("go"), F.lit("x")))) == ["Go", "x"]
    assert value(spark, lists.strings_of_json(F.lit('["a"," b "]'))) == ["a", "b"]
    assert value(spark, lists.strings_of_json(F.lit('"a"'))) == ["a"]


def test_markup(spark):
    page = F.lit('<script type="application/ld+json">{"@graph":[{"@type":["JobPosting"],"title":"T","hiringOrganization":{"name":"C"},"skills":"Go"}]}</script><a id="applyButton" href="/go">x</a>')
    found = text.held(spark.range(1), f=linked_data.first_posting(page)).select(linked_data.posting(F.col("f")).alias("x")).first()["x"]
    assert (found["title"], found["company"], found["skills"]) == ("T", "C", ["Go"])
    assert value(spark, linked_data.apply_url(page, F.lit("https://b.io/job/1"))) == "https://b.io/go"
    assert value(spark, markup.plain(F.lit("<p>a&amp;b</p><p>c</p>"))) == "a&b c"
    assert value(spark, linked_data.body_text(F.lit("<p>a</p><p>b</p>"))) == "ab"


def test_dates_that_need_care(spark):
    now = F.lit(datetime(2024, 1, 10, 12))
    row = spark.range(1).select(
        dates.relative(F.lit("Job posted 2 days ago"), now).alias("anywhere"),
        dates.relative(F.lit("3 Weeks ago"), now).alias("bare"),
        dates.relative(F.lit("ago 2 days"), now).alias("none"),
        dates.ukrainian(F.lit("30 лютого"), now).alias("over"),
        dates.ukrainian(F.lit("8 квітня 2026"), now).alias("given"),
        dates.ukrainian(F.lit("8 квітня 26"), now).alias("short"),
    ).first()
    assert [x and x.isoformat()[:10] for x in row] == ["2024-01-08", "2023-12-20", None, "2023-03-01", "2026-04-08", None]
