"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds an array of parts (``PART``).  A visitor over the parts puts text as it is, escaped, and each image,
audio or document part as a placeholder, in order; the parts behind the placeholders are recorded as attachments with
their reference and the number of tokens that the placeholder expands to.

Control strings have the form ``<|name|>``.  Inside texts and roles every ``<`` that is followed by bars gets one more
bar, so a control string can't come from a text, and taking one bar away gives the text back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
MEDIA = ("image", "audio", "document")
OTHER = "file"


@dataclass(frozen=True)
class Expansion:
    """How many tokens stand for an attachment: tiles of an image, time steps of audio, a rate for each page."""

    tile: int = 28
    per_second: float = 25.0
    per_page: int = 576
    otherwise: int = 1

    def __post_init__(self):
        if self.tile < 1 or self.per_second <= 0 or self.per_page < 1 or self.otherwise < 0:
            raise ValueError(f"bad expansion: {self}")

    def tokens(self, part: Column) -> Column:
        tiles = F.ceil(part["width"] / self.tile).cast("bigint") * F.ceil(part["height"] / self.tile).cast("bigint")
        steps = F.ceil(part["seconds"] * self.per_second).cast("bigint")
        pages = part["pages"].cast("bigint") * self.per_page
        known = F.when(part["type"] == "image", tiles).when(part["type"] == "audio", steps).when(part["type"] == "document", pages)
        return F.greatest(F.coalesce(known, F.lit(self.otherwise)), F.lit(0)).cast("bigint")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", "<|$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", "<$1")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _visited(parts: Column) -> Column:
    """The parts in order, as one text: neighbouring texts are joined before they are escaped, so that no control string
    can be put together from several of them."""

    def visit(state: Column, part: Column) -> Column:
        media = F.concat(F.lit("<|"), F.when(part["type"].isin(*MEDIA), part["type"]).otherwise(OTHER), F.lit("|>"))
        joined = F.concat(state["open"], F.coalesce(part["text"], F.lit("")))
        closed = F.concat(state["done"], escape(state["open"]), media)
        return F.struct(
            F.when(_is_text(part), state["done"]).otherwise(closed).alias("done"),
            F.when(_is_text(part), joined).otherwise(F.lit("")).alias("open"),
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    return F.aggregate(parts, start, visit, lambda state: F.concat(state["done"], escape(state["open"])))


def text_parts(text: Column) -> Column:
    """A message's parts where it has only a text; null reads as an empty text."""
    fields = F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text")
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields, *rest))


def format_chats(messages: DataFrame, loss_role: str = "assistant", expansion: Expansion = Expansion()) -> DataFrame:
    """One row for each ``conv_id`` of ``messages(conv_id, turn, role, parts)``.

    Returns ``conv_id``, ``n_turns``, ``formatted``, ``loss_spans`` (turn from 0, and the range of characters of that
    turn's section, from its start mark on, that the loss covers) and ``attachments`` in the order of placeholders.

    Turns stand in the order of ``turn`` (null first), then of role and content; repeated rows are turns of their own.
    A null role or null parts read as empty, a part without type as text, an unknown type as ``<|file|>``.  A null
    ``conv_id`` is a conversation like others.  Other columns are not read.  A conversation is one row of the result,
    so it must fit in memory; turns are ordered by Spark's sort, which spills.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    body = _visited(parts)
    found = F.transform(
        F.filter(parts, lambda p: ~_is_text(p)),
        lambda p: F.struct(F.when(p["type"].isin(*MEDIA), p["type"]).otherwise(OTHER).alias("type"), p["ref"].alias("ref"), expansion.tokens(p).alias("tokens")),
    )
    sections = messages.select("conv_id", "turn", (role == loss_role).alias("learned"), head.alias("head"), body.alias("body"), found.alias("found"))
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "head", "body")
    ordered = sections.withColumn("place", F.row_number().over(place) - 1)
    turns = ordered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "head", "body", "learned", "found"))).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["learned"]),
        lambda t: F.struct(t["place"].alias("turn"), F.length(t["head"]).alias("begin"), (F.length(t["head"]) + F.length(t["body"])).alias("end")),
    )
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["found"])).alias("attachments"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Reads ``format_chats`` rows back: adds ``turns`` (role, text) and ``learned``, the texts under the loss mask.

    Placeholders stay in the texts as they are.
    """
    sections = F.transform(F.filter(F.split("formatted", r"<\|im_start\|>"), lambda s: s != ""), lambda s: F.concat(F.lit(START), s))

    def turn(section: Column) -> Column:
        role = F.substring_index(F.substr(section, F.lit(len(START) + 1)), "\n", 1)
        begin = F.length(role) + len(START) + 2
        content = F.substr(section, begin, F.length(section) - begin + 1 - len(END) - 1)
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(content).alias("text"))

    return (
        formatted.withColumn("sections", sections)
        .withColumn("turns", F.transform("sections", turn))
        .withColumn("learned", F.transform("loss_spans", lambda s: unescape(F.substr(F.get("sections", s["turn"]), s["begin"] + 1, s["end"] - s["begin"]))))
        .drop("sections")
    )
