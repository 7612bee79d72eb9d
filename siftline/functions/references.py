"""Character references of HTML as characters, in expressions.

Names come from the standard library's table of HTML5.  A reference ends at a semicolon; names that may go without one are
matched by their longest form, as browsers do.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, text

#: What may be a reference behind an ampersand: a number, or a name of up to 32 characters.
_AHEAD = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# What numbers from 128 to 159 stand for (zero and a few others apart), as in the HTML standard.
_C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_NONE = "�"


@cache
def _open_names() -> str:
    """Names that need no semicolon, longest first, as alternatives."""
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


@cache
def _numbers_left_out() -> tuple[int, ...]:
    """Control characters and noncharacters, which a reference can't make."""
    controls = [*range(0x1, 0x9), 0xB, *range(0xE, 0x20), *range(0x7F, 0xA0), *range(0xFDD0, 0xFDF0)]
    return tuple(n for n in controls if not 0x80 <= n < 0xA0) + tuple(plane * 0x10000 + end for plane in range(17) for end in (0xFFFE, 0xFFFF))


def _character(number: Column) -> Column:
    """The character of a number; characters above 255 are made from their UTF-8 bytes, as ``chr`` knows only Latin ones."""

    def part(shift: int, lead: int) -> Column:
        return F.hex(F.lit(lead) + (F.shiftright(number, shift) if lead != 0x80 else F.shiftright(number, shift).bitwiseAND(0x3F)))

    spelled = (
        F.when(number < 0x80, F.lpad(F.hex(number), 2, "0"))
        .when(number < 0x800, F.concat(part(6, 0xC0), part(0, 0x80)))
        .when(number < 0x10000, F.concat(part(12, 0xE0), part(6, 0x80), part(0, 0x80)))
        .otherwise(F.concat(part(18, 0xF0), part(12, 0x80), part(6, 0x80), part(0, 0x80)))
    )
    return F.decode(F.unhex(spelled), "UTF-8")


def _numbered(reference: Column) -> Column:
    digits = F.regexp_extract(reference, r"^#([0-9]+)", 1)
    hexes = F.regexp_extract(reference, r"^#[xX]([0-9a-fA-F]+)", 1)
    plain = F.when(digits != "", digits).otherwise(F.conv(F.substring(F.ltrim(hexes, F.lit("0")), 1, 9), 16, 10))
    return once(F.coalesce(plain.try_cast("bigint"), F.lit(1 << 40)), _of_number)


def _of_number(number: Column) -> Column:
    latin = F.element_at(F.split(F.lit(_C1), ""), F.when(number.between(0x80, 0x9F), (number - 0x7F).cast("int")).otherwise(1))
    return (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), _NONE)
        .when(number == 13, "\r")
        .when(number.between(0x80, 0x9F), latin)
        .when(number.isin(*_numbers_left_out()), "")
        .otherwise(_character(number))
    )


def _table(closed: bool) -> Column:
    """Names and what they stand for, as a constant map."""
    return F.from_json(F.lit(json.dumps({n: c for n, c in html5.items() if n.endswith(";") == closed})), "map<string,string>")


def _named(reference: Column) -> Column:
    whole = F.when(reference.endswith(";"), F.try_element_at(_table(True), reference))
    head = F.regexp_extract(reference, f"^({_open_names()})", 1)
    longest = F.when(head != "", F.concat(F.try_element_at(_table(False), head), F.substr(reference, F.length(head) + 1)))
    return F.coalesce(whole, longest, F.concat(F.lit("&"), reference))


def unescaped(column: Column) -> Column:
    """Text with its character references as characters; an ampersand that begins none stays (PRJ-07)."""

    def made(part: Column, reference: Column) -> Column:
        character = F.when(reference == "", "&").when(reference.startswith("#"), _numbered(reference)).otherwise(_named(reference))
        return F.concat(character, F.substr(part, F.length(reference) + 1))

    def piece(part: Column) -> Column:
        return once(F.regexp_extract(part, _AHEAD, 1), lambda reference: made(part, reference))

    def decoded(whole: Column) -> Column:
        pieces = F.split(whole, "&", -1)
        behind = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.when(F.contains(whole, F.lit("&")), F.concat(F.element_at(pieces, 1), F.array_join(F.transform(behind, piece), ""))).otherwise(whole)

    return once(text(column), decoded)
