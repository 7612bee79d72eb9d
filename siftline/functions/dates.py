"""Dates of postings as the boards write them.  The clock is always a parameter; results are instants in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

# Genitive month names, in order.
MONTHS_UK = ("січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня")
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000}
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
_OFFSET = r"([.]\d+)?(Z|[+-]\d{2}:\d{2})$"


def _parsed(value: Column, *formats: str) -> Column:
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in formats))


def with_offset(raw: Column) -> Column:
    """An instant with its offset from UTC; anything else is null (DAT-01; the caller decides whether null is an error)."""
    value = F.coalesce(raw, F.lit(""))
    return F.when(value.rlike(_ISO + _OFFSET), F.try_to_timestamp(value))


def date_only(raw: Column) -> Column:
    value = trim(raw)
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), _parsed(value, "yyyy-MM-dd"))


def without_offset(raw: Column) -> Column:
    value = trim(raw)
    return F.when(value.rlike(_ISO + r"([.]\d+)?$"), F.try_to_timestamp(F.concat(value, F.lit("Z"))))


def lenient(raw: Column) -> Column:
    """With an offset, else without (UTC), else a date; null where none fits (DAT-02)."""
    return F.coalesce(with_offset(trim(raw)), without_offset(raw), date_only(raw))


def offset_or_date(raw: Column) -> Column:
    """With an offset, else a date (DAT-03)."""
    return F.coalesce(with_offset(trim(raw)), date_only(raw))


def absolute(raw: Column) -> Column:
    """English dates such as ``March 8, 2026`` and ``8 March 2026``, ISO dates and instants (DAT-04)."""
    value = trim(raw)
    english = F.when(value.rlike(r"^\p{L}+ \d{1,2}, \d{4}$"), _parsed(value, "MMMM d, yyyy", "MMMM dd, yyyy"))
    british = F.when(value.rlike(r"^\d{1,2} \p{L}+ \d{4}$"), _parsed(value, "d MMMM yyyy", "dd MMMM yyyy"))
    return F.coalesce(english, british, date_only(value), with_offset(value))


def relative(raw: Column, now: Column) -> Column:
    """``[... posted] N units ago`` before the clock; a month is 30 days, a year 365; N must be positive (DAT-05)."""
    words = F.split(F.trim(F.substring_index(F.regexp_replace(F.lower(trim(raw)), r"\s+", " "), "posted", -1)), " ")
    shaped = (F.size(words) == 3) & (F.get(words, F.lit(2)) == "ago") & F.get(words, F.lit(0)).rlike(r"^\d+$")
    n = F.when(shaped, F.get(words, F.lit(0))).try_cast("bigint")
    unit = F.regexp_replace(F.get(words, F.lit(1)), "s$", "")
    seconds = F.lit(None).cast("bigint")
    for name, size in UNIT_SECONDS.items():
        seconds = F.when(unit == name, n * size).otherwise(seconds)
    return F.when(n > 0, now - F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def first_posted(listing: Column, detail: Column, now: Column) -> Column:
    """Detail's date, detail's age, listing's age, or null (DAT-06)."""
    return F.coalesce(absolute(detail), relative(detail, now), relative(listing, now))


def month_key(raw: Column) -> Column:
    """Letters only, lower case (DAT-09)."""
    return F.regexp_replace(F.lower(trim(raw)), r"[^\p{L}]", "")


def ukrainian(raw: Column, now: Column) -> Column:
    """``8 квітня [2026]``; without a year the clock's, or the one before if that is over a day ahead (DAT-07)."""
    words = F.split(trim(raw), r"\s+")
    first, year = F.get(words, F.lit(0)), F.get(words, F.lit(2))
    shaped = F.size(words).between(2, 3) & first.rlike(r"^\d{1,2}$") & ~F.get(words, F.lit(1)).rlike(r"\d") & (year.isNull() | year.rlike(r"^\d{4}$"))
    day = F.when(shaped, first).try_cast("int")
    key = month_key(F.get(words, F.lit(1)))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS_UK)), key), F.lit(0)).cast("int")
    given = F.when(shaped, year).try_cast("int")

    def at(year: Column, month: Column, day: Column) -> Column:
        # a day beyond the month's end runs on into the next month
        return F.when(day.between(1, 31), F.date_add(F.make_date(year, month, F.lit(1)), day - 1))

    own = at(F.year(now), month, day)
    before = at(F.year(own) - 1, F.month(own), F.dayofmonth(own))
    ahead = own.cast("timestamp") > now + F.expr("INTERVAL 24 HOURS")
    return F.when(given.isNotNull(), at(given, month, day)).when(ahead, before).otherwise(own).cast("timestamp")


def first_ukrainian(listing: Column, detail: Column, now: Column) -> Column:
    """Detail's date, else the listing's (DAT-08)."""
    return F.coalesce(ukrainian(detail, now), ukrainian(listing, now))


def epoch(seconds: Column) -> Column:
    """Positive whole seconds; all else is null."""
    return F.when((seconds > 0) & (seconds == F.floor(seconds)), F.timestamp_seconds(seconds.cast("bigint")))
