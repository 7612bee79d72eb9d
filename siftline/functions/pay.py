"""Salary texts: opaque for display, never parsed to numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, text, trim

# Names of pay periods.
UNITS = {"MONTH": "month", "MONTHLY": "month", "YEAR": "year", "YEARLY": "year", "HOUR": "hour", "HOURLY": "hour", "WEEK": "week", "WEEKLY": "week"}


def _digits(size: Column) -> Column:
    """``digits`` and ``power`` of a positive double: it is ``d.ddd`` times ten to that power, in the fewest digits that tell it.

    The digits are those of the double's own text, less one where that still reads back as the same double.  Between 2**53 and 2**63 that text is the whole number, which may have
    digits that tell nothing; there the number is rounded as far as it still reads back as the same double.
    """

    def whole(number: Column) -> Column:
        exact = number.cast("bigint").cast("decimal(20,0)")
        rounded = F.array(*(F.floor((exact + 10**k // 2) / F.lit(10**k).cast("decimal(7,0)")).cast("decimal(20,0)") * F.lit(10**k).cast("decimal(7,0)") for k in range(6, -1, -1)))
        told = F.get(F.filter(F.transform(rounded, lambda r: r.cast("string")), lambda r: r.cast("double") == number), F.lit(0))
        return once(told, lambda t: F.struct(F.regexp_replace(t, "0+$", "").alias("digits"), (F.length(t) - 1).alias("power")))

    def of_text(spelled: Column) -> Column:
        whole, part = F.regexp_extract(spelled, r"^(\d+)", 1), F.regexp_extract(spelled, r"^\d+\.(\d+)", 1)
        exponent = F.coalesce(F.regexp_extract(spelled, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
        zeros = F.length(F.regexp_extract(F.concat(whole, part), r"^(0*)", 1))
        digits = F.regexp_replace(F.concat(whole, part), r"^0+|0+$", "")
        return F.struct(digits.alias("digits"), (F.length(whole) - 1 - zeros + exponent).alias("power"))

    def shorter(long: Column) -> Column:
        rounded = F.floor((long["digits"].cast("decimal(20,0)") + 5) / F.lit(10).cast("decimal(2,0)")).cast("string")
        scale = long["power"] - F.length(long["digits"]) + 2
        same = F.concat(rounded, F.lit("E"), scale.cast("string")).try_cast("double") == size
        # one digit more after rounding, as from 99 to 10, is one power more
        power = long["power"] + F.length(rounded) - F.length(long["digits"]) + 1
        short = F.struct(F.regexp_replace(rounded, "0+$", "").alias("digits"), power.cast("int").alias("power"))
        return F.when((F.length(long["digits"]) > 1) & F.coalesce(same, F.lit(False)), short).otherwise(long)

    return F.when((size >= 2.0**53) & (size < 2.0**63), whole(size)).otherwise(once(once(size.cast("string"), of_text), shorter))


def _plain(d: Column) -> Column:
    """Digits without an exponent."""
    n, power = F.length(d["digits"]), d["power"]
    whole = F.concat(F.substr(d["digits"], F.lit(1), power + 1), F.repeat(F.lit("0"), power + 1 - n))
    part = F.substr(d["digits"], power + 2)
    large = F.concat(whole, F.when(n > power + 1, F.concat(F.lit("."), part)).otherwise(""))
    return F.when(power >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), d["digits"]))


def _powered(d: Column) -> Column:
    """Digits with an exponent of two digits at least, as in ``1.5e+06``."""
    size = F.abs(d["power"]).cast("string")
    mantissa = F.concat(F.substr(d["digits"], F.lit(1), F.lit(1)), F.when(F.length(d["digits"]) > 1, F.concat(F.lit("."), F.substr(d["digits"], F.lit(2)))).otherwise(""))
    return F.concat(mantissa, F.when(d["power"] < 0, "e-").otherwise("e+"), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))


def _spelled(number: Column, spell: Callable[[Column], Column]) -> Column:
    def of(x: Column) -> Column:
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")  # minus zero has one, too
        infinite = F.when(x > 0, "+Inf").otherwise("-Inf")
        return (
            F.when(F.isnan(x), "NaN")
            .when(F.abs(x) == float("inf"), infinite)
            .when(x == 0, F.concat(sign, F.lit("0")))
            .when(x.isNotNull(), F.concat(sign, once(_digits(F.abs(x)), spell)))
        )

    return once(number.cast("double"), of)


def shortest(number: Column) -> Column:
    """The fewest digits that tell a double, without an exponent."""
    return _spelled(number, _plain)


def general(number: Column) -> Column:
    """The fewest digits; from a million up and below 1e-4 with an exponent, as in ``1e+06`` (PRJ-27)."""
    return _spelled(number, lambda d: F.when((d["power"] < -4) | (d["power"] >= 6), _powered(d)).otherwise(_plain(d)))


def from_bounds(least: Column, most: Column, currency: Column) -> Column:
    """``a-b CUR``, ``a+ CUR`` or ``up to b CUR``; empty without bounds (PRJ-27)."""
    money = trim(currency)
    both = F.concat(general(least), F.lit("-"), general(most), F.lit(" "), money)
    lower = F.concat(general(least), F.lit("+ "), money)
    upper = F.concat(F.lit("up to "), general(most), F.lit(" "), money)
    return F.when(least.isNotNull() & most.isNotNull(), both).when(least.isNotNull(), lower).when(most.isNotNull(), upper).otherwise("")


def joined(first: Column, second: Column, prefer_first: bool = True) -> Column:
    """``a | b`` where both are given and differ, else the one that is (PRJ-32, PRJ-33)."""
    a, b = trim(first), trim(second)
    one = F.when(a != "", a).otherwise(b) if prefer_first else F.when(b != "", b).otherwise(a)
    return F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit(" | "), b)).otherwise(one)


def unit(raw: Column) -> Column:
    """Names of pay periods in words (PRJ-31)."""
    out = F.lower(text(raw))
    for key, name in UNITS.items():
        out = F.when(F.upper(text(raw)) == key, name).otherwise(out)
    return out


def number_text(value: Column) -> Column:
    """A JSON number or string as text: whole if within 1e-9, else the shortest decimal; null where neither (PRJ-30)."""
    number = F.try_variant_get(value, "$", "double")
    kind = F.schema_of_variant(value)
    whole = F.round(number).cast("bigint").cast("string")
    spelled = F.when(F.abs(number - F.round(number)) < 1e-9, whole).otherwise(shortest(number))
    string = F.nullif(trim(F.try_variant_get(value, "$", "string")), F.lit(""))
    return F.when(kind == "STRING", string).when(kind == "VOID", "0").when(kind != "BOOLEAN", spelled)


def from_json(raw: Column) -> Column:
    """``min–max CUR / unit`` from a structured base salary; empty where it has no amount (PRJ-28, PRJ-29)."""
    salary = F.try_parse_json(text(raw))
    least, most = (number_text(F.try_variant_get(salary, f"$.value.{k}", "variant")) for k in ("minValue", "maxValue"))
    amount = F.when(least == most, least).otherwise(F.concat_ws("–", least, most))
    money = trim(F.try_variant_get(salary, "$.currency", "string"))
    period = unit(trim(F.try_variant_get(salary, "$.value.unitText", "string")))
    out = F.concat(amount, F.when(money != "", F.concat(F.lit(" "), money)).otherwise(""), F.when(period != "", F.concat(F.lit(" / "), period)).otherwise(""))
    return F.when(least.isNotNull() | most.isNotNull(), out).otherwise("")
