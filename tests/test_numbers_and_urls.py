"""Spelled numbers against the shortest decimals that Python knows, and the grammar of listing addresses."""

from __future__ import annotations

import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siftline.functions import identity, pay


def doubles(n):
    rng = random.Random(6)
    out = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(n)]
    out += [rng.uniform(0, 10) * 10 ** rng.randint(-8, 22) for _ in range(n)] + [float(rng.randint(0, 10**7)) / 100 for _ in range(n)]
    out += [0.0, -0.0, 1.0, 999999.0, 1e6, 999999.5, 1e-4, 9.999e-5, 2e-3, 5e-324, 1.7976931348623157e308, 1e22, 1e23, 2e23, 9007199254740993.0, 123456.0, 0.1, float("nan"), float("inf"), float("-inf")]
    return out


def spelled(x, exponents):
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
    sign, digits, scale = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    minus = "-" if sign else ""
    if not text:
        return f"{minus}0"
    power = len(text) + scale - 1
    text = text.rstrip("0")
    if exponents and not -4 <= power < 6:
        return f"{minus}{text[0]}{'.' + text[1:] if text[1:] else ''}e{'-' if power < 0 else '+'}{abs(power):02}"
    return minus + format(Decimal(repr(x)).normalize(), "f").lstrip("-")


def test_numbers(spark):
    values = doubles(4000)
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", pay.general(F.col("x")).alias("g"), pay.shortest(F.col("x")).alias("f")).collect()
    wrong = [(r["x"], r["g"], r["f"]) for r in rows if (r["g"], r["f"]) != (spelled(r["x"], True), spelled(r["x"], False))]
    assert len(rows) == len(values) and wrong == []
    assert spark.range(1).select(pay.general(F.lit(None).cast("double")).alias("x")).first()["x"] is None


URLS = {
    "HTTP://Ex.COM/A/B/?q#f": "http://ex.com/A/B",
    "https://ex.com": "https://ex.com",
    "https://ex.com/": "https://ex.com/",
    "https://ex.com//": "https://ex.com/",
    "https://Ex.com:8080/a/": "https://ex.com:8080/a",
    "https://ex.com:/a": "https://ex.com:/a",
    "https://ex.com:80a/": None,
    "https://User:PaSS@Ex.com/a/": "https://User:PaSS@ex.com/a",
    "https://us%41er@ex.com/": "https://usAer@ex.com/",
    "https://a@b@ex.com/x": "https://a%40b@ex.com/x",
    "https://us er@ex.com/": None,
    "https://@ex.com/a": "https://@ex.com/a",
    "https://ex.com/a b": "https://ex.com/a%20b",
    "https://ex.com/a%20b": "https://ex.com/a%20b",
    "https://ex.com/a%2fb": "https://ex.com/a%2fb",
    "https://ex.com/a%2fb/": "https://ex.com/a/b",
    "https://ex.com/a%2F": "https://ex.com/a",
    "https://ex.com/%zz": None,
    "https://ex.com/a%": None,
    "https://ex.com/a?q=%zz": "https://ex.com/a",
    "https://ex.com/a#%zz": None,
    "https://ex.com/a#%20": "https://ex.com/a",
    "https://ex.com/é": "https://ex.com/%C3%A9",
    "https://ex.com/%c3%a9/": "https://ex.com/%C3%A9",
    "https://ex.com/(a)!": "https://ex.com/(a)!",
    "https://ex.com/(a)!/": "https://ex.com/%28a%29%21",
    "https://ex.com/a|b": "https://ex.com/a%7Cb",
    "https://ex .com/": None,
    "https://e{x}.com/": None,
    "https://MÜN.de/a": "https://m%C3%BCn.de/a",
    "https://m%C3%9Cn.de/a": "https://m%C3%BCn.de/a",
    "https://e%41x.com/": None,
    "https://[::1]:80/a/": "https://[::1]:80/a",
    "https://[::1/a": None,
    "https:///a": None,
    "https://?q": None,
    "http:a/b": None,
    "//ex.com/a": None,
    "ftp://ex.com/a": None,
    "https://ex.com/a\x01b": None,
    " https://ex.com/a/ ": "https://ex.com/a",
    "": None,
}


@pytest.fixture(scope="module")
def canonical(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", identity.canonical_url(F.col("u")).alias("c")).collect()
    return {r["u"]: r["c"] for r in rows}


def test_addresses(canonical):
    assert canonical == URLS
