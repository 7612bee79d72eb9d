"""Listing identity: canonical URLs, stable ids, and the key of a search's rules."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, trim

SEPARATOR = "\u001e"
#: Scheme, authority, path and fragment.
_URL = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?[^#]*)?(?:#(.*))?$"
#: Addresses in which nothing is escaped or needs to be.
_SIMPLE = r"^(?i)https?://[a-z0-9.\-]+(?::[0-9]*)?(?:/[a-z0-9\-_.~$&+,/:;=@]*)?(?:\?[^#\x00-\x1F\x7F]*)?(?:#[^%\x00-\x1F\x7F]*)?$"
# Characters that stand for themselves in a path, in user names and in hosts, and those that a path may have
# and still stay as it is written.
_IN_PATH = r"^[A-Za-z0-9\-_.~$&+,/:;=@]$"
_IN_USER = r"^[A-Za-z0-9\-_.~$&+,;=]$"
_IN_HOST = r"""^[A-Za-z0-9\-_.~!$&'()*+,;=:\[\]<>"]$"""
_WRITTEN_PATH = r"^(?:[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]]|%[0-9A-Fa-f]{2})*$"
_USER = r"^(?:[A-Za-z0-9\-._:~!$&'()*+,;=@]|%[0-9A-Fa-f]{2})*$"
_HOST = r"""^(?:[A-Za-z0-9\-_.~!$&'()*+,;=:\[\]<>"]|[^\x00-\x7F]|%25|%[89A-Fa-f][0-9A-Fa-f])+$"""
_PORT = r"^(?:\[.*\](?::[0-9]*)?|[^\[:][^:]*|(?:[^\[].*)?:[0-9]*)$"


def _escaped(part: Column, kept: str) -> Column:
    """A part with each character as it is or as ``%XX``, whichever way it was written."""
    tokens = F.regexp_extract_all(part, F.lit(r"(?s)%[0-9A-Fa-f]{2}|[^%]"), F.lit(0))

    def spelled(token: Column) -> Column:
        byte = F.conv(F.substring(token, 2, 2), 16, 10).cast("int")
        plain = F.when(byte < 128, F.char(byte)).otherwise("")
        coded = F.when(plain.rlike(kept), plain).otherwise(F.upper(token))
        own = F.when(token.rlike(kept), token).otherwise(F.regexp_replace(F.hex(F.encode(token, "UTF-8")), "(..)", r"%$1"))
        return F.when(token.startswith("%"), coded).otherwise(own)

    return F.array_join(F.transform(tokens, spelled), "")


def _decoded_host(host: Column) -> Column:
    """A host with its escaped characters as such; only non-ASCII ones and the percent sign may be escaped."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(host, r"\+", "%2B")), host)


def _general_url(url: Column) -> Column:
    """``canonical_url`` of any address."""
    scheme, authority, path, fragment = (F.regexp_extract(url, _URL, i) for i in (1, 2, 3, 4))
    user, host = F.regexp_extract(authority, r"(?s)^(.*)@", 1), F.regexp_replace(authority, r"(?s)^.*@", "")
    bad_escape = r"%(?![0-9A-Fa-f]{2})"
    sound = (scheme != "") & ~url.rlike(r"[\x00-\x1F\x7F]") & ~path.rlike(bad_escape) & ~fragment.rlike(bad_escape) & user.rlike(_USER) & host.rlike(_HOST) & host.rlike(_PORT)
    name, secret = F.regexp_extract(user, "^([^:]*)", 1), F.regexp_extract(user, "^[^:]*:(.*)$", 1)
    login = F.concat(_escaped(name, _IN_USER), F.when(user.contains(":"), F.concat(F.lit(":"), _escaped(secret, _IN_USER))).otherwise(""), F.lit("@"))
    trimmed = F.regexp_replace(path, r"(?:/|%2[Ff])$", "")
    at = F.when((path.rlike(r"(?:/|%2[Ff])$")) & (path != "/") & (trimmed != ""), _escaped(trimmed, _IN_PATH)).when(path.rlike(_WRITTEN_PATH), path).otherwise(_escaped(path, _IN_PATH))
    where = _escaped(F.replace(F.lower(_decoded_host(host)), F.lit("%"), F.lit("%25")), _IN_HOST)
    return F.when(sound, F.concat(F.lower(scheme), F.lit("://"), F.when(authority.contains("@"), login).otherwise(""), where, at))


def canonical_url(raw: Column) -> Column:
    """Lower-case scheme and host, no query, fragment or trailing slash; null where it isn't an http URL (PRJ-01, PRJ-04).

    User info stays as it is.  A path stays as it is written, but is escaped anew where it has characters that must be
    escaped, or where it lost its slash.  Control characters, unsound escapes, hosts, ports and user infos make no URL.
    """

    def simple(url: Column) -> Column:
        scheme, host, path = (F.regexp_extract(url, _URL, i) for i in (1, 2, 3))
        path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
        return F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path)

    url = trim(raw)
    return F.when(url.rlike(_SIMPLE), simple(url)).otherwise(once(url, _general_url))


def https_url(raw: Column) -> Column:
    """A trimmed absolute https address with a host, its scheme in lower case; null for any other (SRC-24)."""
    url = trim(raw)
    return F.when(url.rlike(r"(?i)^https://[^/?#]") & canonical_url(url).isNotNull(), F.concat(F.lit("https"), F.substr(url, F.lit(6))))


def source_id(raw: Column) -> Column:
    """Lower-case, trimmed source (PRJ-42)."""
    return F.lower(trim(raw))


def stable_id(source: Column, url: Column) -> Column:
    """Source and canonical URL joined by U+001E; null where either is missing (PRJ-02, PRJ-05)."""
    return F.concat(F.nullif(source_id(source), F.lit("")), F.lit(SEPARATOR), canonical_url(url))


def assigned_id(source: Column, url: Column, apply_url: Column) -> Column:
    """Stable id by the listing URL or, where that is blank, the apply URL; null where no id can be had (PRJ-03)."""
    return stable_id(source, F.when(trim(url) != "", url).otherwise(apply_url))


def _listed(values: list[str]) -> list[str]:
    return sorted({v.strip().lower() for v in values if v.strip()})


def _quoted(value) -> str:
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    for sign in "<>&  ":  # escaped as the stored keys have them
        out = out.replace(sign, f"\\u{ord(sign):04x}")
    return out


def _instant(at: datetime) -> str:
    at = at.astimezone(UTC) if at.tzinfo else at
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}".rstrip("0") if at.microsecond else "") + "Z"


@dataclass(frozen=True)
class FilterKey:
    """What makes two searches the same (KEY-01 to KEY-05)."""

    slot_id: str
    synonyms: list[str] = field(default_factory=list)
    window: tuple[datetime, datetime] | None = None
    sources: list[str] = field(default_factory=list)
    remote_only: bool = False
    countries: list[str] = field(default_factory=list)
    user_id: str | None = None

    def canonical(self) -> str:
        """Compact JSON with a fixed order of keys; a slot and one more field are needed."""
        slot = uuid.UUID(self.slot_id)
        if not slot.int:
            raise ValueError("a filter key needs a slot")
        parts: dict[str, object] = {}
        if role := " ".join(_listed(self.synonyms)):
            parts["role"] = role
        if self.window:
            parts["time_window"] = dict(zip(("from", "to"), map(_instant, self.window), strict=True))
        if own := _listed(self.sources):
            parts["sources"] = own
        if words := _listed([*(["__remote_only__"] if self.remote_only else []), *(f"country:{c.strip()}" for c in self.countries if c.strip())]):
            parts["keywords"] = words
        if not parts:
            raise ValueError("a filter key needs a field beside the slot")
        user = (self.user_id or "").strip().lower()
        return _quoted({"slot_id": str(slot)} | ({"user_id": user} if user else {}) | parts)

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def filter_key(slot_id: Column, role: Column, sources: Column, keywords: Column) -> Column:
    """``FilterKey.digest`` for rows, for fields without characters that JSON escapes."""

    def listed(values: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(trim(v))), lambda v: v != "")))

    def quoted(values: Column) -> Column:
        return F.concat(F.lit('["'), F.array_join(values, '","'), F.lit('"]'))

    fields = F.array_compact(
        F.array(
            F.concat(F.lit('"slot_id":"'), slot_id, F.lit('"')),
            F.when(F.size(listed(role)) > 0, F.concat(F.lit('"role":"'), F.array_join(listed(role), " "), F.lit('"'))),
            F.when(F.size(listed(sources)) > 0, F.concat(F.lit('"sources":'), quoted(listed(sources)))),
            F.when(F.size(listed(keywords)) > 0, F.concat(F.lit('"keywords":'), quoted(listed(keywords)))),
        )
    )
    return F.when(F.size(fields) > 1, F.sha2(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")), 256))


# What JSON escapes, and what stored keys escape beside that.
_ESCAPED = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_ESCAPED_BY_NUMBER = [*(chr(i) for i in range(32) if chr(i) not in _ESCAPED), "<", ">", "&", "\u2028", "\u2029"]


def json_text(value: Column) -> Column:
    """A JSON string with the escapes of stored keys, as ``FilterKey`` writes it."""
    some = value
    for sign, written in (_ESCAPED | {c: f"\\u{ord(c):04x}" for c in _ESCAPED_BY_NUMBER}).items():
        some = F.replace(some, F.lit(sign), F.lit(written))
    odd = value.rlike(r'[\x00-\x1f"\\<>&\u2028\u2029]')
    return F.concat(F.lit('"'), F.when(odd, some).otherwise(value), F.lit('"'))


def instant_text(at: Column) -> Column:
    """An instant in UTC with as many digits of a second as it has, whatever the session's zone."""
    micros = F.unix_micros(at)
    second = F.pmod(F.floor(micros / 1_000_000), F.lit(86_400))
    part = F.pmod(micros, F.lit(1_000_000))
    two = [F.lpad(x.cast("string"), 2, "0") for x in (F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)]
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int")).cast("string")
    fraction = F.when(part > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), 6, "0"), "0+$", ""))).otherwise("")
    return F.concat(day, F.lit("T"), F.concat_ws(":", *two), fraction, F.lit("Z"))


def canonical_filter(slot_id: Column, user_id: Column, synonyms: Column, start: Column, end: Column, sources: Column, remote_only: Column, countries: Column) -> Column:
    """``FilterKey.canonical`` for rows (KEY-02): null without a slot's UUID, or with nothing beside the slot.

    ``start`` and ``end`` are instants; a window with one end is left out.
    """
    empty = F.array().cast("array<string>")

    def listed(values: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, empty), lambda v: F.lower(trim(v))), lambda v: v != "")))

    def field_of(name: str, values: Column) -> Column:
        return once(values, lambda v: F.when(F.size(v) > 0, F.concat(F.lit(f'"{name}":['), F.array_join(F.transform(v, json_text), ","), F.lit("]"))))

    slot, user = F.lower(trim(slot_id)), F.lower(trim(user_id))
    is_slot = slot.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & slot.rlike("[1-9a-f]")
    role = once(F.array_join(listed(synonyms), " "), lambda r: F.when(r != "", F.concat(F.lit('"role":'), json_text(r))))
    window = F.concat(F.lit('"time_window":{"from":"'), instant_text(start), F.lit('","to":"'), instant_text(end), F.lit('"}'))
    named = F.transform(F.filter(F.transform(F.coalesce(countries, empty), trim), lambda c: c != ""), lambda c: F.concat(F.lit("country:"), c))
    words = F.concat(F.when(F.coalesce(remote_only, F.lit(False)), F.array(F.lit("__remote_only__"))).otherwise(empty), named)
    parts = F.array_compact(F.array(role, window, field_of("sources", listed(sources)), field_of("keywords", listed(words))))
    head = F.concat(F.lit('{"slot_id":"'), slot, F.lit('"'), F.when(user != "", F.concat(F.lit(',"user_id":'), json_text(user))).otherwise(""))
    return F.when(is_slot & (F.size(parts) > 0), F.concat(head, F.lit(","), F.array_join(parts, ","), F.lit("}")))
