"""Readers of captured payloads of six boards, each giving rows of the job schema.

A reader takes a DataFrame of captured pages (``page`` number, ``url``, ``body``; boards with detail pages take a second
one) and the clock where dates need one.  Bad items fail the read, but for the one board that skips them.  What a board's
own search would have returned is up to the capture; ``matching`` filters by all terms of a query instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, identity, linked_data, lists, markup, pay, places, text
from ..schema import JOB_FIELDS
from .paging import Stop, cut, ended_by_total, limited, of_one_read, pages_read, until, with_totals_before

# Source ids in their default order.
SOURCES = ("europe_remotely", "working_nomads", "dou_ua", "himalayas", "djinni", "builtin")

# Pages of a feed (by default, at most), jobs of a read (likewise), cards and links of a full page, pages of a search
# and of browsing by default.
FEED_PAGES = (2, 500)
BOARD_JOBS = (100, 500)
DJINNI_FULL, BUILTIN_FULL = 15, 20
SEARCHED_PAGES = 2
BROWSED_PAGES = 5
# Fixed value: where a home page states the feed's token.
FEED_TOKEN = r"(?s)var\s+ERJ\s*=\s*\{.*?nonce\s*:\s*'([^']+)'"
#: Fragments are numbered after all listing pages.
AFTER_LISTING = 1_000_000

_NOMADS = (
    "hits struct<total:struct<value:bigint>,hits:array<struct<_source:struct<id:bigint,title:string,slug:string,company:string,description:string,tags:array<string>,all_tags:array<string>,"
    "locations:array<string>,location_base:string,pub_date:string,apply_option:string,apply_email:string,apply_url:string,expired:boolean,salary_range:string,salary_range_short:string>>>>"
)
_HIMALAYAS = (
    "offset int, limit int, totalCount int, jobs array<struct<title:string,excerpt:string,companyName:string,employmentType:string,minSalary:double,maxSalary:double,currency:string,"
    "seniority:array<string>,locationRestrictions:array<string>,timezoneRestrictions:array<double>,categories:array<string>,parentCategories:array<string>,description:string,pubDate:double,applicationLink:string,guid:string>>"
)


def required(value: Column, what: str) -> Column:
    """A value that must not be blank or null: a bad item fails the read."""
    return text.once(value, lambda v: F.when(text.trim(v) != "", v).otherwise(F.raise_error(F.lit(what)).cast("string")))


def jobs(rows: DataFrame, source: str, **fields: Column) -> DataFrame:
    """Rows of the job schema from expressions over a board's fields; ids come from the URL (PRJ-38, PRJ-39)."""
    named = {"source": F.lit(source)} | fields
    staged = rows.select(*[named.get(f.split()[0], F.lit(None)).cast(f.split()[1]).alias(f.split()[0]) for f in JOB_FIELDS.split(", ")])
    tags = lists.strings(F.col("tags"))
    filled = staged.withColumns({"tags": tags, "position": text.position(F.col("title"), F.col("description"), tags), "stage1_status": F.lit(None).cast("string")})
    made = filled.withColumn("id", required(text.once(F.col("url"), lambda u: identity.assigned_id(F.col("source"), u, F.col("apply_url"))), f"{source}: no listing URL"))
    # a filter reads the required fields whatever columns are asked for, so that a bad item always fails the read
    read = F.length(F.concat_ws("", "id", "title", "company")) >= 0
    return made.where(read)


def first_of_each(rows: DataFrame, url: Column, *order: Column) -> DataFrame:
    """The first row of each canonical URL in a given order (TOP-09, TOP-10)."""
    place = Window.partitionBy("_url").orderBy(*order)
    return rows.withColumn("_url", identity.canonical_url(url)).withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def cards(pages: DataFrame, read: Callable[[str, str], object], stop: Stop, ended: Column, body: Column | None = None) -> DataFrame:
    """Listing cards that ordered reads of pages keep, each URL once a read (SRC-08, SRC-12, SRC-15).

    ``ended`` is the board's sign that a page is the last, over the page's columns and its ``cards``.  A card without a
    link fails the read if the read gets to it.
    """
    found = of_one_read(pages).withColumn("cards", markup.reader(read, markup.CARD)(F.col("body") if body is None else body, F.col("url")))
    found = cut(found.select("read", "page", ended.alias("ended"), "cards"))  # pages are parsed once
    listed = found.select("read", "page", F.posexplode("cards").alias("place", "card")).withColumn("url", identity.canonical_url(F.col("card.url")))
    kept = until(listed, found, stop)
    return kept.select("read", required(F.col("url"), "a card without a link").alias("_url"), "page", "place", "card")


def detailed(listed: DataFrame, details: DataFrame, read: Callable[[str, str], object], kind: str) -> DataFrame:
    """Cards with their detail page's fields by canonical URL; a card without one keeps its own (JON-10)."""
    own = first_of_each(details, F.col("url"), F.col("body")).select("_url", markup.reader(read, kind)(F.col("body"), F.col("url")).alias("detail"))
    return listed.join(own, "_url", "left")


def with_posting(details: DataFrame) -> DataFrame:
    """Detail pages by canonical URL with the posting in their linked data, and why it can't be read (``wrong``)."""
    own = text.held(first_of_each(details, F.col("url"), F.col("body")), _found=linked_data.first_posting(F.col("body")))
    return own.select("_url", "url", "body", linked_data.posting(F.col("_found")).alias("detail"), linked_data.unsound(F.col("_found")).alias("wrong"))


def _pick(detail: str, card: str) -> Column:
    return F.when(text.trim(F.col(detail)) != "", F.col(detail)).otherwise(text.text(F.col(card)))


def working_nomads(pages: DataFrame, countries: places.Countries, max_pages: int | None = None, max_jobs: int | None = None) -> DataFrame:
    """Hits of paged search answers; expired ones are left out, invalid ones fail the read (SRC-01).

    A read ends with an empty page or where its hits reach the answer's total (none is 0).  Two pages are read by default;
    a negative ``max_pages`` reads on.  ``max_jobs`` limits a read's jobs.
    """
    answer = F.from_json("body", _NOMADS, {"mode": "FAILFAST"})["hits"]
    parsed = cut(of_one_read(pages).select("read", "page", answer.alias("hits")))
    hits = F.coalesce(F.size("hits.hits"), F.lit(0))
    counted = parsed.select("read", "page", F.greatest(hits, F.lit(0)).alias("new"), (hits <= 0).alias("ended"), F.coalesce("hits.total.value", F.lit(0)).alias("total"))
    told = pages_read(counted, Stop(pages=None if max_pages and max_pages < 0 else max_pages or SEARCHED_PAGES))
    rows = parsed.join(told, ["read", "page"]).select("read", "page", F.posexplode("hits.hits._source").alias("place", "j")).where(~F.coalesce("j.expired", F.lit(False)))
    if max_jobs and max_jobs > 0:  # expired hits don't count as jobs
        per_page = with_totals_before(rows.groupBy("read", "page").agg(F.count(F.lit(1)).alias("jobs")), ["read"], "page", "jobs").select("read", "page", "jobs_before")
        nth = F.col("jobs_before") + F.row_number().over(Window.partitionBy("read", "page").orderBy("place"))
        rows = rows.join(per_page, ["read", "page"]).withColumn("nth", nth).where(F.col("nth") <= max_jobs)
    rows = rows.select("j.*")
    apply = (
        F.when(text.trim(F.col("apply_option")).isin("with_your_ats", "with_our_ats"), text.trim(F.col("apply_url")))
        .when(text.trim(F.col("apply_option")) == "with_email", F.when(text.trim(F.col("apply_email")) != "", F.concat(F.lit("mailto:"), text.trim(F.col("apply_email")))).otherwise(""))
        .otherwise(F.raise_error(F.lit("working_nomads: unknown apply option")).cast("string"))
    )  # PRJ-34
    tags = lists.first_filled(F.col("tags"), F.col("all_tags"))
    rows, body = text.held(rows, plain=markup.plain(F.col("description"))), F.col("plain")
    posted = F.coalesce(dates.with_offset(F.col("pub_date")), F.raise_error(F.lit("working_nomads: bad date")).cast("timestamp"))
    return jobs(
        rows,
        "working_nomads",
        title=text.text(text.trim(F.col("title"))),
        company=text.text(text.trim(F.col("company"))),
        url=identity.canonical_url(F.concat(F.lit("https://www.workingnomads.com/jobs/"), required(text.trim(F.col("slug")), "working_nomads: no slug"))),
        apply_url=F.nullif(apply, F.lit("")),
        description=body,
        posted_at=posted,
        is_remote=text.remote(F.col("title"), body, tags),
        country_code=countries.first(F.col("locations"), F.array("location_base")),
        salary_raw=pay.joined(F.col("salary_range"), F.col("salary_range_short")),
        tags=tags,
    )


def himalayas(pages: DataFrame, countries: places.Countries, search: bool = False, max_pages: int | None = None, max_jobs: int | None = None) -> DataFrame:
    """Jobs of paged answers, browsed or searched (SRC-03 to SRC-06).

    Browsing ends with an empty or short page (a missing limit is 20) or where offset and jobs reach the total.  A search
    counts its pages from 1 and ends with an empty page or the page ``ceil(total / limit)``.  Five pages are read by
    default; a negative ``max_pages`` reads on.  ``max_jobs`` limits a read's jobs.
    """
    answer = F.from_json("body", _HIMALAYAS, {"mode": "FAILFAST"})
    parsed = cut(of_one_read(pages).select("read", "page", answer.alias("a")).withColumn("new", F.size("a.jobs")))
    parsed = parsed.withColumns({"new": F.greatest("new", F.lit(0)), "most": F.when(F.col("a.limit") > 0, F.col("a.limit")).otherwise(20)})
    if search:
        ended = (F.col("new") == 0) | ended_by_total(F.col("page"), F.col("most"), F.col("a.totalCount"))
    else:
        ended = (F.col("new") < F.col("most")) | ((F.col("a.totalCount") > 0) & (F.col("a.offset") + F.col("new") >= F.col("a.totalCount")))
    stop = Stop(cap=max_jobs if max_jobs and max_jobs > 0 else None, pages=None if max_pages and max_pages < 0 else max_pages or BROWSED_PAGES)
    told = pages_read(parsed.select("read", "page", "new", ended.alias("ended")), stop)
    read = parsed.join(told, ["read", "page"])
    if stop.cap:
        read = read.withColumn("a", F.col("a").withField("jobs", F.slice("a.jobs", F.lit(1), F.greatest(F.lit(0), F.lit(stop.cap) - F.col("before")))))
    rows = read.select(F.explode("a.jobs").alias("j")).select("j.*")
    tags = lists.merged(F.col("categories"), F.col("seniority"), F.col("parentCategories"))
    rows, body = text.held(rows, plain=markup.plain(F.col("description"))), F.col("plain")
    link = F.when(text.trim(F.col("guid")) != "", F.col("guid")).otherwise(F.col("applicationLink"))
    where = F.array_join(lists.cleaned(F.col("locationRestrictions")), ", ")
    return jobs(
        rows,
        "himalayas",
        title=required(text.trim(F.col("title")), "himalayas: no title"),
        company=required(text.trim(F.col("companyName")), "himalayas: no company"),
        url=identity.canonical_url(link),
        description=body,
        posted_at=dates.epoch(F.col("pubDate")),
        is_remote=text.remote(F.col("title"), body, tags, F.col("excerpt"), where),
        country_code=countries.first(F.col("locationRestrictions")),
        salary_raw=pay.from_bounds(F.col("minSalary"), F.col("maxSalary"), F.col("currency")),
        tags=tags,
        timezone_offsets=F.col("timezoneRestrictions"),
    )


def feed(pages: DataFrame) -> DataFrame:
    """Pages of an AJAX feed, bare or wrapped in ``success`` and ``data``; no success is an error (SRC-09)."""
    parsed = F.from_json("body", "success boolean, data struct<has_more:boolean,html:string>, has_more boolean, html string", {"mode": "FAILFAST"})
    ok = F.coalesce(F.col("a.success"), F.lit(True))
    html = F.when(ok, F.coalesce("a.data.html", "a.html")).otherwise(F.raise_error(F.lit("the feed reports a failure")).cast("string"))
    return of_one_read(pages).withColumn("a", parsed).select("read", "page", "url", html.alias("body"), F.coalesce("a.data.has_more", "a.has_more", F.lit(False)).alias("has_more"))


def feed_token(home: Column) -> Column:
    """The nonce in the feed's own object of a home page's script; a page without it is an error (SRC-11).

    The first object counts, and in it the first bare key with a value in single quotes, whatever lies between.
    """
    found = text.trim(F.regexp_extract(home, FEED_TOKEN, 1))
    return F.when(found != "", found).otherwise(F.raise_error(F.lit("no feed token")).cast("string"))


def europe_remotely(pages: DataFrame, details: DataFrame, countries: places.Countries, now: datetime, max_pages: int | None = None, max_jobs: int | None = None) -> DataFrame:
    """Feed pages of cards with detail pages, up to the page that has no more after it (SRC-08).

    Two pages are read by default and 500 at most; ``max_jobs`` limits a read's jobs.
    """
    stop = Stop(cap=max_jobs if max_jobs and max_jobs > 0 else None, pages=limited(max_pages, *FEED_PAGES))
    rows = detailed(cards(feed(pages), markup.remotely_cards, stop, ~F.col("has_more")), details, markup.remotely_detail, markup.DETAIL)
    title, company, body, tags = _pick("detail.title", "card.title"), _pick("detail.company", "card.company"), text.text(F.col("detail.description")), lists.strings(F.col("detail.tags"))
    return jobs(
        rows,
        "europe_remotely",
        title=required(title, "europe_remotely: no title"),
        company=required(company, "europe_remotely: no company"),
        url=F.col("_url"),
        apply_url=F.col("detail.apply_url"),
        description=body,
        posted_at=dates.first_posted(F.col("card.posted"), F.col("detail.posted"), F.lit(now)),
        is_remote=text.remote(title, body, tags),
        country_code=countries.first(F.array("card.location"), F.array("detail.location")),
        salary_raw=pay.joined(F.col("card.compensation"), F.col("detail.compensation"), prefer_first=False),
        tags=tags,
    )


def dou(pages: DataFrame, more: DataFrame | None, details: DataFrame, countries: places.Countries, now: datetime, max_jobs: int | None = None) -> DataFrame:
    """A listing page, the fragments loaded after it, and detail pages (SRC-12).

    A read ends with the fragment that says it is the last or brings no new card, or once it has ``max_jobs`` jobs: 100 by
    default, 500 at most.
    """
    pages = of_one_read(pages).select("read", "page", "url", "body", F.lit(False).alias("last"))
    if more is not None:
        answer = F.from_json("body", "html string, last boolean", {"mode": "FAILFAST"})
        later = of_one_read(more).withColumn("a", answer)
        pages = pages.unionByName(later.select("read", (F.col("page") + AFTER_LISTING).alias("page"), "url", F.col("a.html").alias("body"), F.col("a.last").alias("last")))
    stop = Stop(cap=limited(max_jobs, *BOARD_JOBS), nothing_new=True)
    rows = detailed(cards(pages, markup.dou_cards, stop, F.col("last")), details, markup.dou_detail, markup.DETAIL)
    title, body, tags = _pick("detail.title", "card.title"), text.text(F.col("detail.description")), lists.strings(F.col("detail.tags"))
    return jobs(
        rows,
        "dou_ua",
        title=required(title, "dou_ua: no title"),
        company=required(F.col("card.company"), "dou_ua: no company"),
        url=F.col("_url"),
        description=body,
        posted_at=dates.first_ukrainian(F.col("card.posted"), F.col("detail.posted"), F.lit(now)),
        is_remote=text.remote(title, body, tags),
        country_code=countries.first(F.array("card.location"), F.array("detail.location")),
        salary_raw=text.text(F.col("detail.compensation")),
        tags=tags,
    )


def posting_country(countries: places.Countries, *places_json: Column) -> Column:
    """Country of the first place with one: applicant's location before the job's (PRJ-20)."""
    out = F.lit(None).cast("string")
    for raw in reversed(places_json):
        value = F.try_parse_json(text.text(raw))
        each = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
        codes = F.flatten(
            F.transform(each, lambda p: F.array(*[F.coalesce(countries.code_or_name(F.try_variant_get(p, path, "string")), F.lit("")) for path in ("$.address.addressCountry", "$.addressCountry")]))
        )
        out = F.coalesce(F.try_element_at(F.filter(codes, lambda c: c != ""), F.lit(1)), out)
    return text.text(out)


def djinni(pages: DataFrame, details: DataFrame, countries: places.Countries, max_jobs: int | None = None) -> DataFrame:
    """Listing pages with detail pages' postings; no title or company fails the read (SRC-15).

    A read ends with a page that isn't full, or once it has ``max_jobs`` jobs: 100 by default, 500 at most.
    """
    stop = Stop(cap=limited(max_jobs, *BOARD_JOBS))
    listed = cards(pages, markup.djinni_cards, stop, F.size("cards") < DJINNI_FULL)
    rows = listed.join(with_posting(details).select("_url", "detail", "wrong"), "_url", "left")
    why = F.concat(F.lit("djinni: "), F.coalesce("wrong", F.lit("a card without a posting")))
    rows = rows.where(F.when(F.col("wrong").isNull() & F.col("detail").isNotNull(), True).otherwise(F.raise_error(why).cast("boolean")))
    title, company = _pick("detail.title", "card.title"), _pick("detail.company", "card.company")
    rows, body = text.held(rows, plain=linked_data.body_text(F.col("detail.description"))), F.col("plain")
    tags = lists.merged(F.array("detail.category"), F.col("detail.skills"), F.col("card.tags"))
    salary = pay.from_json(F.col("detail.base_salary"))
    return jobs(
        rows,
        "djinni",
        title=required(title, "djinni: no title"),
        company=required(company, "djinni: no company"),
        url=identity.canonical_url(F.when(text.trim(F.col("detail.url")) != "", F.col("detail.url")).otherwise(F.col("_url"))),
        description=body,
        posted_at=dates.lenient(F.col("detail.date_posted")),
        is_remote=text.remote_or_telecommute(F.col("detail.location_type"), title, body, tags, F.array_join(lists.strings(F.col("card.hints")), " ")),
        country_code=posting_country(countries, F.col("detail.applicant_location"), F.col("detail.job_location")),
        salary_raw=F.when(salary != "", salary).otherwise(text.text(F.col("card.compensation"))),
        tags=tags,
    )


def builtin(pages: DataFrame, details: DataFrame, search: str = "", max_pages: int | None = None, max_jobs: int | None = None) -> DataFrame:
    """Listed links by territory, the first territory of a link counts; bad items are skipped (SRC-17 to SRC-19).

    ``pages`` also has the territory's ``alpha_3``.  Without a search there is nothing.  A territory's pages end with one
    that isn't full, or after ``max_pages``; ``max_jobs`` limits the jobs.  A link that isn't absolute is skipped.
    """
    spark = pages.sparkSession
    if not search.strip():
        return spark.createDataFrame([], JOB_FIELDS)
    listed = of_one_read(pages).join(F.broadcast(places.territories(spark)), "alpha_3")
    listed = cut(listed.select("read", "ordinal", "page", "alpha_2", linked_data.item_urls(F.col("body")).alias("links")))
    counted = listed.select("read", "ordinal", "page", F.size("links").alias("new"), (F.size("links") < BUILTIN_FULL).alias("ended"))
    told = pages_read(counted, Stop(pages=max_pages if max_pages and max_pages > 0 else None), ("read", "ordinal")).drop("before")
    links = listed.join(told, ["read", "ordinal", "page"]).select("ordinal", "page", "alpha_2", F.posexplode("links").alias("place", "link"))
    first = first_of_each(links, F.col("link"), F.col("ordinal"), F.col("page"), F.col("place")).where("_url is not null")
    asked = details.withColumn("_url", identity.canonical_url(F.col("url"))).join(first.select("_url"), "_url", "left_semi").drop("_url")
    own = text.held(with_posting(asked.where(~text.challenge_page(F.col("body")))), apply=linked_data.apply_url(F.col("body"), F.col("url")))
    rows = first.join(own.where("wrong is null").select("_url", F.col("detail").alias("p"), "apply"), "_url").where(text.trim(F.col("p.title")) != "")
    rows = rows.withColumn("_own", identity.canonical_url(F.when(text.trim(F.col("p.url")) != "", F.col("p.url")).otherwise(F.col("_url")))).where("_own is not null")
    if max_jobs and max_jobs > 0:
        rows = rows.orderBy("ordinal", "page", "place").limit(max_jobs)
    tags = lists.merged(F.col("p.skills"), F.col("p.qualifications"), F.col("p.occupation"))
    rows, body = text.held(rows, plain=linked_data.body_text(F.col("p.description"))), F.col("plain")
    return jobs(
        rows,
        "builtin",
        title=F.col("p.title"),
        company=text.trim(F.col("p.company")),
        url=F.col("_own"),
        apply_url=F.nullif(F.coalesce(identity.canonical_url(F.col("apply")), F.col("apply")), F.lit("")),
        description=body,
        posted_at=dates.offset_or_date(F.col("p.date_posted")),
        is_remote=text.remote_or_telecommute(F.col("p.location_type"), F.col("p.title"), body, tags, F.col("p.employment_type")),
        country_code=F.col("alpha_2"),
        salary_raw=pay.from_json(F.col("p.base_salary")),
        tags=tags,
    )


def matching(found: DataFrame, query: str, board: str = "") -> DataFrame:
    """Jobs with all terms of a query: stands in for the boards' searches where a capture wasn't searched (SRC-02, 07, 10, 13, 16).

    One board wants all terms in one of its fields, title, description or tags; for the others they may be spread.  Ranks
    (a title counts twice there) have no bearing on which jobs are found.
    """
    terms = query.lower().split()
    if not terms:
        return found
    tags = F.lower(F.array_join(lists.strings(F.col("tags")), " "))
    fields = [F.lower(text.text(F.col("title"))), F.lower(text.text(F.col("description"))), tags]
    if board != "working_nomads":
        fields = [F.concat_ws(" ", *fields)]
    return found.where(reduce(or_, [reduce(and_, [field.contains(term) for term in terms]) for field in fields]))


@dataclass
class Union:
    """What a union of sources gave: rows, and the errors of sources that failed."""

    jobs: DataFrame
    errors: dict[str, str]


def union(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]) -> Union:
    """Rows of all sources in order; one that fails is left out, and if all fail that is an error (SRC-25, SRC-26).

    A source fails when its plan can't be made or its rows can't be read: each is read once, to count it, before it
    joins the union.
    """
    parts, errors = [], {}
    for name, read in sources.items():
        try:
            rows = read()
            rows.write.format("noop").mode("overwrite").save()
            parts.append(rows)
        except Exception as error:  # a source is outside input: any failure of it is isolated
            errors[name] = str(error).splitlines()[0]
    if errors and not parts:
        raise RuntimeError(f"every source failed: {errors}")
    empty = spark.createDataFrame([], JOB_FIELDS)
    return Union(reduce(DataFrame.unionByName, parts, empty), errors)
