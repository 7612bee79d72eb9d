"""Linked data of pages in expressions: script blocks, postings and lists of links.

A page's blocks are cut out by patterns and parsed as variants; nothing here needs Python workers.  A block counts if its
script has exactly the type ``application/ld+json``; comments and other scripts are passed over as whole elements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .references import unescaped
from .text import collapse, once, text, trim

_TAG = r"""<script\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ELEMENT = rf"(?is)<!--.*?-->|{_TAG}.*?</script\s*>"
_LINKED = r"""(?i)\stype\s*=\s*("application/ld\+json"|'application/ld\+json'|application/ld\+json[\s>])"""
_MARKS = r"(?s)<!--.*?(?:-->|$)|</?[a-zA-Z][^>]*(?:>|$)|<[!?][^>]*(?:>|$)"
_VARIANTS = "array<variant>"
POSTING = (
    "title company url description date_posted category location_type base_salary applicant_location job_location skills qualifications occupation employment_type"
).split()
#: What ``first_posting`` gives: whether a broken block came first, and the posting's block.
FOUND = "struct<broken:boolean,block:variant>"


def scripts(html: Column) -> Column:
    """Texts of a page's linked-data blocks, in order, without blank ones."""
    every = F.filter(F.regexp_extract_all(text(html), F.lit(_ELEMENT), F.lit(0)), lambda e: F.regexp_extract(e, f"(?is)^({_TAG})", 1).rlike(_LINKED))
    bodies = F.transform(every, lambda e: trim(F.regexp_replace(e, rf"(?is)^{_TAG}|</script\s*>$", "")))
    return F.filter(bodies, lambda b: b != "")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _elements(value: Column, path: str) -> Column:
    """An array's elements; null where there is no array."""
    return F.try_variant_get(value, path, _VARIANTS)


def string_of(value: Column, path: str) -> Column:
    """A string, empty where it is missing or null; SQL null where it is something else."""
    own = F.try_variant_get(value, path, "variant")
    return F.when(own.isNull() | F.is_variant_null(own), "").when(_kind(own) == "STRING", F.try_variant_get(own, "$", "string"))


def of_type(block: Column, name: str) -> Column:
    """Whether a block's ``@type`` is, or has among strings, this name, whatever its case (EXT-10)."""
    own = F.try_variant_get(block, '$["@type"]', "variant")
    names = F.when(_kind(own) == "STRING", F.array(F.try_variant_get(own, "$", "string"))).when(_kind(own) == "ARRAY<STRING>", F.try_variant_get(own, "$", "array<string>"))
    return F.coalesce(F.exists(names, lambda n: F.lower(trim(n)) == name.lower()), F.lit(False))


def _blocks(script: Column, value: Column) -> Column:
    """A script's blocks in the order in which they are looked at: an array's, or a graph's and then the object itself."""
    none = F.array().cast(_VARIANTS)
    whole = F.concat(F.coalesce(_elements(value, '$["@graph"]'), none), F.array(value))
    return F.coalesce(F.when(script.startswith("["), _elements(value, "$")).when(script.startswith("{"), F.when(value.isNotNull(), whole)), none)


def _broken(script: Column, value: Column) -> Column:
    """Whether a script begins as an array or object and can't be read; anything else is no block and no error."""
    return (script.startswith("[") | script.startswith("{")) & value.isNull()


def first_posting(html: Column) -> Column:
    """The page's first posting, or that a block before it is broken; null where there is neither (EXT-08, EXT-09, EXT-14)."""

    def told(script: Column) -> Column:
        def of_value(value: Column) -> Column:
            return F.struct(_broken(script, value).alias("broken"), F.get(F.filter(_blocks(script, value), lambda b: of_type(b, "JobPosting")), F.lit(0)).alias("block"))

        return once(F.try_parse_json(script), of_value)

    return F.get(F.filter(F.transform(scripts(html), told), lambda t: t["broken"] | t["block"].isNotNull()), F.lit(0))


def _words(block: Column, path: str) -> Column:
    """A string or an array of strings as trimmed words without blanks (EXT-11, EXT-15)."""
    own = F.try_variant_get(block, path, "variant")
    words = F.when(_kind(own) == "STRING", F.array(F.try_variant_get(own, "$", "string"))).when(_kind(own) == "ARRAY<STRING>", F.try_variant_get(own, "$", "array<string>"))
    return F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), trim), lambda w: w != "")


_STRINGS = {"title": "title", "url": "url", "description": "description", "date_posted": "datePosted", "category": "category", "location_type": "jobLocationType"}


def unsound(found: Column) -> Column:
    """Why a page's posting can't be read: a broken block, or a field that must be a string and isn't; null if nothing is wrong."""
    wrong = [F.when(string_of(found["block"], f"$.{key}").isNull(), F.lit(f"a posting whose {key} is not a string")) for key in _STRINGS.values()]
    return F.when(found["broken"], F.lit("broken linked data")).when(found["block"].isNotNull(), F.coalesce(*wrong))


def posting(found: Column) -> Column:
    """Fields of the posting that ``first_posting`` found, structured ones as JSON; null where there is none (EXT-16)."""
    block = found["block"]
    plain = {name: (lambda c: c) if name == "description" else trim for name in _STRINGS}
    strings = {name: plain[name](text(string_of(block, f"$.{key}"))) for name, key in _STRINGS.items()}
    raw = {name: F.to_json(F.try_variant_get(block, f"$.{key}", "variant")) for name, key in (("base_salary", "baseSalary"), ("applicant_location", "applicantLocationRequirements"), ("job_location", "jobLocation"))}
    words = {name: _words(block, f"$.{key}") for name, key in (("skills", "skills"), ("qualifications", "qualifications"), ("occupation", "occupationalCategory"))}
    kinds = {"company": trim(text(string_of(block, "$.hiringOrganization.name"))), "employment_type": F.array_join(_words(block, "$.employmentType"), ", ")}
    fields = strings | raw | words | kinds
    return F.when(block.isNotNull(), F.struct(*(fields[name].alias(name) for name in POSTING)))


def _link(element: Column) -> Column:
    """An element's ``url`` if that is a string, even an empty one; else its ``item``, or the item's ``url`` (EXT-13)."""
    whole = F.try_variant_get(element, "$.url", "variant")
    item = F.try_variant_get(element, "$.item", "variant")
    own = F.when(whole.isNotNull(), string_of(element, "$.url"))
    inner = F.when(_kind(item).startswith("OBJECT"), text(string_of(item, "$.url"))).otherwise(text(string_of(element, "$.item")))
    return trim(F.when(_kind(element).startswith("OBJECT"), F.coalesce(own, inner)).otherwise(""))


def item_urls(html: Column) -> Column:
    """Links of a page's item lists; a graph's lists stand for the object's own, and broken blocks have none (EXT-12)."""

    def of_block(block: Column) -> Column:
        links = F.filter(F.transform(F.coalesce(_elements(block, "$.itemListElement"), F.array().cast(_VARIANTS)), _link), lambda u: u != "")
        return F.when(of_type(block, "ItemList"), links).otherwise(F.array().cast("array<string>"))

    def of_script(script: Column) -> Column:
        def of_value(value: Column) -> Column:
            graph = F.flatten(F.transform(F.coalesce(_elements(value, '$["@graph"]'), F.array().cast(_VARIANTS)), of_block))
            own = once(graph, lambda links: F.when(F.size(links) > 0, links).otherwise(of_block(value)))
            listed = F.when(script.startswith("["), F.flatten(F.transform(_blocks(script, value), of_block)))
            return F.coalesce(listed.when(script.startswith("{"), own), F.array().cast("array<string>"))

        return once(F.try_parse_json(script), of_value)

    return F.flatten(F.transform(scripts(html), of_script))


def body_text(html: Column) -> Column:
    """Text of a marked-up description; neighbouring elements aren't parted, and text without a tag is taken as it is (PRJ-08, PRJ-09)."""
    return once(text(html), lambda whole: collapse(F.when(F.contains(whole, F.lit("<")), unescaped(F.regexp_replace(whole, _MARKS, ""))).otherwise(whole)))


def how_to_apply(html: Column) -> Column:
    """The string behind the key ``howToApply`` in a page's scripts, read as JSON up to the end of its object; null without (PRJ-35)."""
    behind = F.filter(F.slice(F.split(text(html), '"howToApply"'), 2, 1 << 30), lambda p: p.rlike(r'^\s*:\s*"'))
    return F.get_json_object(F.concat(F.lit('{"howToApply"'), F.get(behind, F.lit(0))), "$.howToApply")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value as it is written in a tag; null where the tag has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.when(tag.rlike(pattern), F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3))))


def apply_button(html: Column) -> Column:
    """The link of the first ``a#applyButton`` that has one; null without."""
    other = rf"<!--.*?-->|{_TAG}.*?</script\s*>"
    tags = F.regexp_extract_all(text(html), F.lit(rf"""(?is){other}|<a\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))
    own = F.filter(tags, lambda t: F.lower(F.substring(t, 1, 3)).rlike(r"^<a\s") & (_attribute(t, "id") == "applyButton") & _attribute(t, "href").isNotNull())
    return F.get(F.transform(F.slice(own, 1, 1), lambda t: unescaped(_attribute(t, "href"))), F.lit(0))


def apply_link(href: Column, page: Column) -> Column:
    """Absolute as it is; protocol-relative gets https; a path is resolved against the page (PRJ-36)."""
    origin = F.regexp_extract(trim(page), r"^(?i)(https?://[^/?#]+)", 1)

    def resolved(link: Column) -> Column:
        return F.when(link.rlike(r"^(?i)https?://"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(link)

    return once(trim(href), resolved)


def apply_url(html: Column, page: Column) -> Column:
    """The apply button's link, else the one in the page's script; empty where neither is a web address (PRJ-35)."""
    links = F.array(apply_link(apply_button(html), page), apply_link(how_to_apply(html), page))
    return F.coalesce(F.get(F.filter(links, lambda u: u.rlike(r"^(?i)https?://")), F.lit(0)), F.lit(""))
