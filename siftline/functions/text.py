"""Text rules: trimming, plain text, search haystacks, position and remote work.

White space is Unicode's: Spark's ``trim`` strips only U+0020 unless it is told what to strip.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword groups in order of precedence, and phrases for remote work.
POSITIONS = (
    ("full-stack", ("full-stack", "full stack", "fullstack")),
    ("frontend", ("frontend", "front-end", "front end")),
    ("backend", ("backend", "back-end", "back end")),
)
REMOTE = ("remote", "віддалено", "віддалена робота")
# The characters with the property White_Space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def trim(column: Column) -> Column:
    """Without white space at the ends; reads no further than that."""
    return F.btrim(text(column), F.lit(WHITE))


def blank_to_null(column: Column) -> Column:
    return F.nullif(trim(column), F.lit(""))


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with ``value`` computed once, however often ``make`` refers to it.

    A filter pushed below a projection repeats every expression that it refers to; nested rules would outgrow compiled code.
    """
    return F.get(F.transform(F.array(value), make), F.lit(0))


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row whatever refers to them: no filter or projection is moved below."""
    made = rows.withColumn("_held", F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
    return made.withColumns({name: F.col(f"_held.{name}") for name in columns}).drop("_held")


def collapse(column: Column) -> Column:
    """Single spaces for runs of white space (PRJ-06)."""
    return trim(F.regexp_replace(text(column), r"(?U)\s+", " "))


def strip_tags(column: Column) -> Column:
    """Tags become spaces; entities stay (PRJ-07 before unescaping)."""
    return collapse(F.regexp_replace(text(column), r"(?s)<[^>]*>", " "))


def lowered(column: Column) -> Column:
    """Lower case letter by letter: no rule looks at a letter's neighbours."""
    return F.lower(F.translate(text(column), "Σİ", "σi"))


def haystack(title: Column, description: Column) -> Column:
    """What stage filters search: title and description, lower case (FLT-09)."""
    return F.lower(F.concat(text(title), F.lit(" "), text(description)))


def any_of(hay: Column, needles: list[str] | tuple[str, ...]) -> Column | None:
    """Whether any non-blank needle occurs as a substring; None without needles (FLT-07, FLT-10, FLT-11)."""
    wanted = [n.strip().lower() for n in needles if n.strip()]
    return reduce(or_, [hay.contains(n) for n in wanted]) if wanted else None


def _parts(title: Column, description: Column, tags: Column, *hints: Column) -> Column:
    """All parts in lower case, each trimmed, with a space between them."""
    own = F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(trim(t))), " ")
    return F.concat_ws(" ", F.lower(trim(title)), F.lower(trim(description)), own, *(F.lower(trim(h)) for h in hints))


def position(title: Column, description: Column, tags: Column) -> Column:
    """First position group with a keyword in title, description or tags; else null (PRJ-10)."""
    hay = _parts(title, description, tags)
    out = F.lit(None).cast("string")
    for label, keys in reversed(POSITIONS):
        out = F.when(any_of(hay, keys), label).otherwise(out)
    return out


def remote(title: Column, description: Column, tags: Column, *hints: Column) -> Column:
    """Whether a phrase for remote work occurs; never null (PRJ-11)."""
    return any_of(_parts(title, description, tags, *hints), REMOTE)


def remote_or_telecommute(kind: Column, title: Column, description: Column, tags: Column, *hints: Column) -> Column:
    """A declared telecommute wins over the phrases (PRJ-12, PRJ-13)."""
    return (F.upper(trim(kind)) == "TELECOMMUTE") | remote(title, description, tags, *hints)


def challenge_page(html: Column) -> Column:
    """Whether a page is a bot challenge, by its first 96 KiB, which may end inside a character (SRC-21)."""
    head = F.lower(F.make_valid_utf8(F.substring(text(html).cast("binary"), 1, 98304).cast("string")))
    return head.contains("cdn-cgi/challenge-platform") | head.contains("cf-browser-verification") | (head.contains("just a moment") & head.contains("cdn-cgi"))


def workflow_segment(column: Column) -> Column:
    """Characters outside ``[A-Za-z0-9_-]`` become underscores (PRJ-43)."""
    return F.regexp_replace(text(column), "[^A-Za-z0-9_-]", "_")
