"""Arrays of tags: cleaning, merging and comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text, trim


def strings(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def cleaned(column: Column) -> Column:
    """Trimmed, without blanks (KEY-05 but for case)."""
    return F.filter(F.transform(strings(column), trim), lambda t: t != "")


def merged(*columns: Column) -> Column:
    """All tags in order, each once whatever its case, as first spelled (PRJ-22 to PRJ-24)."""
    every = F.concat(*[cleaned(c) for c in columns])
    return F.filter(every, lambda t, i: F.array_position(F.transform(every, F.lower), F.lower(t)) == i + 1)


def first_filled(first: Column, second: Column) -> Column:
    """The first list if it has a tag, else the second; duplicates stay (PRJ-25)."""
    return F.when(F.size(cleaned(first)) > 0, cleaned(first)).otherwise(cleaned(second))


def tagged_line(line: Column) -> Column:
    """``Tagged as: a, b`` as a list (PRJ-26)."""
    return cleaned(F.split(F.regexp_replace(trim(line), r"(?is)^.*?tagged as:", ""), ","))


def same_unordered(a: Column, b: Column) -> Column:
    """Equal whatever the order; duplicates count; null is empty (SNK-05)."""
    return F.array_sort(strings(a)).eqNullSafe(F.array_sort(strings(b)))


def same_numbers(a: Column, b: Column) -> Column:
    """Equal in order, and minus zero is not zero; null is empty (SNK-06)."""

    def spelled(x: Column) -> Column:
        return F.transform(F.coalesce(x, F.array().cast("array<double>")), lambda v: v.cast("string"))

    return spelled(a).eqNullSafe(spelled(b))


def strings_of_json(raw: Column) -> Column:
    """A JSON string or array of strings as a clean list; anything else is empty (EXT-11, EXT-15)."""
    value = F.try_parse_json(text(raw))
    kind = F.schema_of_variant(value)
    one = F.array(F.try_variant_get(value, "$", "string"))
    return cleaned(F.when(kind == "STRING", one).when(kind == "ARRAY<STRING>", F.try_variant_get(value, "$", "array<string>")))
