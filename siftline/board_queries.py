"""Registered queries of the board readers: every document is a listing on captured pages of each board.

The captures are made from the whole table, fifty listings to a page and two pages to a read, so that the SQL can say what
the reader must find.  After the end of a read come pages with items that would fail it, so that a rule that doesn't end
the read is noticed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from .functions import places
from .queries import CLOCK, query, table
from .sources import boards, captures, paging

_PER_PAGE = 50
_WHERE = "CASE lang WHEN 'de' THEN 'Berlin, Germany' WHEN 'fr' THEN 'France' ELSE 'Worldwide' END"
_CODE = "CASE lang WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' ELSE '' END"
_LISTED = r"""WITH d AS (SELECT doc_id, 'Job ' || doc_id AS title, 'Firm ' || coalesce(source, '') || doc_id % 9 AS company,
    trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS description, coalesce(lang, 'xx') AS lang FROM documents)"""


def _remote_sql(tags: str) -> str:
    hay = f"lower(title || ' ' || description || ' ' || {tags})"
    return f"(contains({hay}, 'remote') OR contains({hay}, 'віддалено'))"


def _sql(board: str, url: str, posted: str, salary: str, tags: str, country: str = _CODE, apply: str = "CAST(NULL AS VARCHAR)", remote: str = "false", where: str = "") -> str:
    return f"""{_LISTED} SELECT '{board}' || chr(30) || {url} AS id, title, company, {apply} AS apply_url, description, {posted} AS posted_at,
        {remote} OR {_remote_sql(tags)} AS is_remote, {country} AS country_code, {salary} AS salary_raw, {tags} AS tags FROM d {where}"""


def _countries() -> places.Countries:
    return places.Countries({"Germany": "DE", "France": "FR", "Spain": "ES"})


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the fields of a listing; ``marked`` is the whole text as HTML."""
    marked = F.coalesce("text", F.lit(""))
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        marked = F.replace(marked, F.lit(sign), F.lit(reference))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", marked.alias("marked"), F.coalesce("lang", F.lit("xx")).alias("lang"))
    company = _text("Firm ", F.coalesce("source", F.lit("")), F.col("doc_id") % 9)
    return docs.withColumns({"title": _text("Job ", F.col("doc_id")), "company": company, "place": F.expr(_WHERE), "page": F.floor(F.col("doc_id") / _PER_PAGE).cast("int")})


_READ = "floor(page / 2)"
#: Numbers pages that come after all others.
_AFTER = 10_000_000


def _paged(cards: DataFrame, html: Column, url: str) -> DataFrame:
    return cards.groupBy("page").agg(F.array_join(F.collect_list(html), "\n").alias("body")).select(F.expr(_READ).alias("read"), "page", F.lit(url).alias("url"), "body")


def _followed(pages: DataFrame, *bodies: str, pages_before: int = 1) -> DataFrame:
    """Pages, and further ones with these bodies after the last page of each read of at least so many."""
    long = pages.groupBy("read").agg(F.first("url").alias("url"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= pages_before)
    for k, body in enumerate(bodies):
        pages = pages.unionByName(long.select("read", F.lit(_AFTER + k).alias("page"), "url", F.lit(body).alias("body")))
    return pages


def _linked(block: Column) -> Column:
    """A block of linked data as a page's script."""
    return _text('<script type="application/ld+json">', F.replace(F.to_json(block), F.lit("<"), F.lit("\\u003c")), "</script>")


def _shown(found: DataFrame) -> DataFrame:
    posted = F.col("posted_at").cast("timestamp_ntz").alias("posted_at")
    return found.select("id", "title", "company", "apply_url", "description", posted, "is_remote", "country_code", "salary_raw", F.array_join("tags", ",").alias("tags"))


_DAY = "CAST(doc_id % 28 + 1 AS INTEGER)"


@query(
    _sql(
        "working_nomads",
        "'https://www.workingnomads.com/jobs/job-' || doc_id",
        f"make_timestamp(2024, 1, {_DAY}, 8, 30, 0)",
        "CASE WHEN doc_id % 4 = 0 THEN '$' || doc_id || ' | $9' ELSE '$9' END",
        "CASE WHEN doc_id % 2 = 0 THEN lang || ',dev' ELSE 'all,' || lang END",
        apply="CASE doc_id % 3 WHEN 0 THEN 'https://ats.example/' || doc_id WHEN 1 THEN 'mailto:' || doc_id || '@firm.example' END",
        where="WHERE doc_id % 10 <> 0",
    )
)
def board_working_nomads(spark, sf_dir):
    """Expired hits are left out by the board's own rule; even reads end at their total, odd ones with the second page."""
    n = F.col("doc_id")
    hit = F.struct(
        n.alias("id"),
        "title",
        _text("job-", n).alias("slug"),
        "company",
        _text("<p>", F.col("marked"), "</p>").alias("description"),
        F.when(n % 2 == 0, F.array("lang", F.lit("dev"))).otherwise(F.array(F.lit(" "))).alias("tags"),
        F.array(F.lit("all"), F.col("lang")).alias("all_tags"),
        F.array("place").alias("locations"),
        F.lit("Anywhere").alias("location_base"),
        _text("2024-01-", F.lpad((n % 28 + 1).cast("string"), 2, "0"), "T10:30:00+02:00").alias("pub_date"),
        F.when(n % 3 == 1, "with_email").when(n % 3 == 0, "with_your_ats").otherwise("with_our_ats").alias("apply_option"),
        _text(n, "@firm.example").alias("apply_email"),
        F.when(n % 3 == 0, _text("https://ats.example/", n)).otherwise("").alias("apply_url"),
        (n % 10 == 0).alias("expired"),
        F.when(n % 4 == 0, _text("$", n)).otherwise("").alias("salary_range"),
        F.lit("$9").alias("salary_range_short"),
    )
    hits = _listings(spark, sf_dir).groupBy("page").agg(F.collect_list(F.struct(hit.alias("_source"))).alias("hits")).withColumn("read", F.expr(_READ))
    whole = hits.groupBy("read").agg(F.sum(F.size("hits")).alias("value"))
    total = F.when(F.col("read") % 2 == 0, F.col("value")).otherwise(1_000_000)
    body = F.to_json(F.struct(F.struct(F.struct(total.alias("value")).alias("total"), "hits").alias("hits")))
    pages = hits.join(whole, "read").select("read", "page", F.lit("").alias("url"), body.alias("body"))
    return _shown(boards.working_nomads(_followed(pages, '{"hits": {"total": {"value": 9}, "hits": [{"_source": {"id": 1}}]}}', pages_before=2), _countries()))


_HIMALAYAS_SQL = _sql(
    "himalayas",
    "'https://h.example/w/' || doc_id",
    "make_timestamp(CAST((1700000000 + doc_id * 60) * 1000000 AS BIGINT))",
    "CASE doc_id % 3 WHEN 0 THEN (1000 + doc_id % 900) || '-' || (2000 + doc_id % 900) || ' EUR' WHEN 1 THEN (1000 + doc_id % 900) || '+ EUR' ELSE '' END",
    "lang || ',Senior'",
)


def _himalayas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: ``read``, ``page``, ``url``, ``jobs``."""
    n = F.col("doc_id")
    link = _text("https://h.example/w/", n, "/?ref=x")
    job = F.struct(
        "title",
        F.col("company").alias("companyName"),
        F.when(n % 2 == 0, link).otherwise("").alias("guid"),
        link.alias("applicationLink"),
        _text("<p>", F.col("marked"), "</p>").alias("description"),
        (n * 60 + 1_700_000_000).cast("double").alias("pubDate"),
        F.when(n % 3 != 2, 1000.0 + n % 900).alias("minSalary"),
        F.when(n % 3 == 0, 2000.0 + n % 900).alias("maxSalary"),
        F.lit("EUR").alias("currency"),
        F.array("place").alias("locationRestrictions"),
        F.array("lang").alias("categories"),
        F.array(F.lit(" Senior"), F.upper("lang")).alias("seniority"),
    )
    listed = _listings(spark, sf_dir).groupBy("page").agg(F.collect_list(job).alias("jobs"))
    return listed.select(F.expr(_READ).alias("read"), "page", F.lit("https://h.example/jobs").alias("url"), "jobs")


_NO_TITLE = '{"jobs": [{"guid": "https://h.example/none"}], "offset": 0, "limit": 1}'


@query(_HIMALAYAS_SQL)
def board_himalayas(spark, sf_dir):
    """Browsed: some reads end where they reach the total, the others with an empty page."""
    pages = _himalayas(spark, sf_dir)
    whole = pages.groupBy("read").agg(F.sum(F.size("jobs")).alias("total"), F.min("page").alias("first_page"), F.min_by(F.size("jobs"), "page").alias("ahead"))
    offset = F.when(F.col("page") > F.col("first_page"), F.col("ahead")).otherwise(0)
    total = F.when(F.col("read") % 2 == 0, F.col("total")).otherwise(0)
    told = pages.join(whole, "read").withColumn("body", F.to_json(F.struct(offset.alias("offset"), F.size("jobs").alias("limit"), total.alias("totalCount"), "jobs")))
    return _shown(boards.himalayas(_followed(told.select("read", "page", "url", "body"), '{"jobs": [], "limit": 20}', _NO_TITLE), _countries()))


@query(_HIMALAYAS_SQL)
def board_himalayas_search(spark, sf_dir):
    """Searched: pages count from 1, and a read ends with page ``ceil(total / limit)``, however full its pages are."""
    pages = _himalayas(spark, sf_dir)
    whole = pages.groupBy("read").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first_page"))
    told = pages.join(whole, "read").withColumn("page", (F.col("page") - F.col("first_page") + 1).cast("int"))
    body = F.to_json(F.struct(F.lit(1000).alias("limit"), (F.col("n") * 1000 - 999).alias("totalCount"), "jobs"))
    return _shown(boards.himalayas(_followed(told.select("read", "page", "url", body.alias("body")), _NO_TITLE), _countries(), search=True))


@query(
    _sql(
        "europe_remotely",
        "'https://er.example/job/' || doc_id",
        f"CASE WHEN doc_id % 2 = 0 THEN make_timestamp(2024, 1, {_DAY}, 0, 0, 0) ELSE TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(doc_id % 9 + 1 AS INTEGER)) END",
        "CASE WHEN doc_id % 2 = 0 THEN '€' || doc_id || ' | per year' ELSE '€' || doc_id END",
        "lang || ',team'",
        apply="'https://apply.example/' || doc_id",
    )
)
def board_europe_remotely(spark, sf_dir):
    """Odd reads end where there is no more, even ones with their second page."""
    n, rows = F.col("doc_id"), _listings(spark, sf_dir)
    card = _text(
        '<div class="job-card"><h2 class="job-title"><a href="/job/', n, '/?x=1">', F.col("title"), '</a></h2><div class="company-name">', F.col("company"), '</div><div class="job-time">Posted ', n % 9 + 1,
        ' days ago</div><div class="meta-item meta-location">', F.col("place"), '</div><div class="meta-item">€', n, "</div></div>",
    )
    listed = _paged(rows, card, "https://er.example/jobs/")
    wrapped = F.struct(F.lit(True).alias("success"), F.struct(F.lit(True).alias("has_more"), F.col("body").alias("html")).alias("data"))
    bare = F.struct((F.col("read") % 2 == 0).alias("has_more"), F.col("body").alias("html"))
    pages = listed.withColumn("body", F.when(F.col("page") % 2 == 0, F.to_json(wrapped)).otherwise(F.to_json(bare)))
    pages = _followed(pages, '{"html": "<div class=job-card></div>"}', pages_before=2)
    own = F.when(n % 2 == 0, _text('<li class="date-posted">January ', n % 28 + 1, ', 2024</li><li class="wpjmef-field-salary">per year</li>')).otherwise("")
    detail = _text(
        '<ul class="job-listing-meta">', own, '</ul><div class="job_listing-description"><p>', F.col("marked"), '</p></div><p class="job_tags">Tagged as: ', F.col("lang"),
        ', team</p><a class="application_button_link" href="https://apply.example/', n, '">Apply</a>',
    )
    details = rows.select("page", _text("https://er.example/job/", n).alias("url"), detail.alias("body"))
    return _shown(boards.europe_remotely(pages, details, _countries(), CLOCK))


@query(
    _sql(
        "dou_ua",
        "'https://d.example/v/' || doc_id",
        f"CASE WHEN doc_id % 3 = 0 THEN make_timestamp(2022, 4, {_DAY}, 0, 0, 0) ELSE make_timestamp(2023, 12, {_DAY}, 0, 0, 0) END",
        "'$' || doc_id",
        "lang || ',Kotlin'",
    )
)
def board_dou(spark, sf_dir):
    """The even pages are listing pages, the odd ones fragments loaded after them: the last, or followed by repeats."""
    n, rows = F.col("doc_id"), _listings(spark, sf_dir)
    card = _text(
        '<li class="l-vacancy"><div class="date">', n % 28 + 1, ' грудня</div><div class="title"><a class="vt" href="/v/', n, '/?from=list">', F.col("title"), '</a> <strong>в <a class="company" href="/c/">',
        F.col("company"), '</a></strong> <span class="cities">', F.col("place"), "</span></div></li>",
    )
    listed = _paged(rows, card, "https://d.example/vacancies/")
    first, later = listed.where("page % 2 = 0"), listed.where("page % 2 = 1")
    fragment = F.to_json(F.struct(F.col("body").alias("html"), (F.col("read") % 2 == 0).alias("last")))
    repeated = first.withColumns({"page": F.lit(_AFTER), "body": F.to_json(F.struct(F.col("body").alias("html"), F.lit(False).alias("last")))})
    more = later.withColumn("body", fragment).unionByName(repeated)
    more = more.unionByName(first.withColumns({"page": F.lit(_AFTER + 1), "body": F.lit('{"html": "<li class=l-vacancy></li>"}')}))
    own = F.when(n % 3 == 0, _text('<div class="date">', n % 28 + 1, " квітня 2022</div>")).otherwise("")
    detail = _text(
        '<h1 class="g-h2">', F.col("title"), "</h1>", own, '<div class="sh-info"><span class="salary">$', n, '</span></div><div class="b-typo vacancy-section"><p>', F.col("marked"), '</p></div><a class="badge">',
        F.col("lang"), '</a><a class="badge">Kotlin</a>',
    )
    details = rows.select("page", _text("https://d.example/v/", n, "/").alias("url"), detail.alias("body"))
    return _shown(boards.dou(first, more, details, _countries(), CLOCK, max_jobs=500))


def _posting(*more: Column) -> Column:
    n = F.col("doc_id")
    amount = F.struct(n.alias("minValue"), (n + 500).alias("maxValue"), F.lit("MONTH").alias("unitText"))
    return F.struct(
        F.lit("JobPosting").alias("@type"),
        "title",
        F.struct(F.col("company").alias("name")).alias("hiringOrganization"),
        _text("<p>", F.col("marked"), "</p>").alias("description"),
        _text("2024-01-", F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("datePosted"),
        F.struct(F.lit("USD").alias("currency"), amount.alias("value")).alias("baseSalary"),
        F.when(n % 2 == 0, "TELECOMMUTE").alias("jobLocationType"),
        *more,
    )


_POSTED = f"make_timestamp(2024, 1, {_DAY}, 0, 0, 0)"
_PAY = "doc_id || '–' || (doc_id + 500) || ' USD / month'"


@query(_sql("djinni", "'https://dj.example/jobs/' || doc_id || '-dev'", _POSTED, _PAY, "lang || ',Go,React'", country="upper(lang)", remote="doc_id % 2 = 0"))
def board_djinni(spark, sf_dir):
    n, rows = F.col("doc_id"), _listings(spark, sf_dir)
    card = _text(
        '<li><a href="/jobs/', n, '-dev/"><h2 class="job-item__position">', F.col("title"), '</h2></a><div class="job-item__tags"><span class="badge">React</span><span class="badge">go</span></div></li>'
    )
    address = F.struct(F.struct(F.col("lang").alias("addressCountry")).alias("address")).alias("applicantLocationRequirements")
    block = _posting(F.col("lang").alias("category"), F.array(F.lit("Go")).alias("skills"), address)
    details = rows.select("page", _text("https://dj.example/jobs/", n, "-dev").alias("url"), _linked(block).alias("body"))
    pages = _followed(_paged(rows, card, "https://dj.example/jobs/"), "<p>no more</p>", "<h2 class=job-item__position>no link</h2>")
    return _shown(boards.djinni(pages, details, _countries(), max_jobs=500))


@query(
    _sql(
        "builtin", "'https://bi.example/job/' || doc_id", _POSTED, _PAY, "'Go,' || lang", country="CASE WHEN doc_id % 2 = 0 THEN 'DE' ELSE 'PL' END",
        apply="CASE doc_id % 3 WHEN 0 THEN 'https://bi.example/apply/' || doc_id WHEN 1 THEN 'https://bi.example/mail/' || doc_id END", remote="doc_id % 2 = 0",
    )
)
def board_builtin(spark, sf_dir):
    """Even listings stand on pages of two territories; the first in order counts.  An element with an empty ``url`` beside
    an ``item`` has no link."""
    n, rows = F.col("doc_id"), _listings(spark, sf_dir)
    shown = rows.withColumn("alpha_3", F.explode(F.when(n % 2 == 0, F.array(F.lit("POL"), F.lit("DEU"))).otherwise(F.array(F.lit("POL")))))
    link = _text("https://bi.example/job/", n, "?utm=1")
    inner = F.to_json(F.struct(F.struct(link.alias("url")).alias("item")))
    element = F.when(n % 2 == 0, F.to_json(F.struct(link.alias("url")))).when(n % 4 == 1, inner).otherwise(F.to_json(F.struct(link.alias("item"))))
    hidden = F.to_json(F.struct(F.lit("").alias("url"), _text("https://bi.example/job/", n, "-hidden").alias("item")))
    links = F.array_join(F.flatten(F.collect_list(F.array(element, hidden))), ",")
    listed = shown.groupBy("alpha_3", "page").agg(_text('{"@graph":[{"@type":"ItemList","itemListElement":[', links, "]}]}").alias("block"))
    script = _text('<!-- <script type="application/ld+json">{</script> --><script>var a = "<!--";</script><script async type="application/ld+json">', F.col("block"), "</script>")
    pages = listed.select("alpha_3", "page", F.lit("https://bi.example/jobs").alias("url"), script.alias("body"))
    button = F.when(n % 3 == 0, _text('<a class="b" id="applyButton" href="/apply/', n, '?a=1&amp;b=2">Apply</a>')).when(n % 3 == 1, _text('<script>init({"job":{"howToApply":"https:\\/\\/bi.example/mail/', n, '","id":1}})</script>')).otherwise("")
    body = _text(_linked(_posting(F.array(F.lit("Go"), F.col("lang")).alias("skills"))), button)
    own = rows.select("page", _text("https://bi.example/job/", n).alias("url"), body.alias("body"))
    others = rows.select("page", _text("https://bi.example/job/", n, "-hidden").alias("url"), body.alias("body"))
    return _shown(boards.builtin(pages, own.unionByName(others), "dev"))


# ---- ordered reads -------------------------------------------------------------------------------------------------

#: Documents as cards of reads by source: a hundred ids to a page, some pages with nothing but repeats.
_CARDS_SQL = """WITH cards AS (SELECT coalesce(source, '') AS read, doc_id // 100 AS page, doc_id % 100 AS place,
        'https://c.example/v/' || CASE WHEN doc_id // 100 % 7 = 5 OR doc_id % 13 = 0 THEN doc_id % 100 // 20 * 20 ELSE doc_id END AS url FROM documents),
    pages AS (SELECT read, page, count(*) AS n FROM cards GROUP BY 1, 2),
    seen AS (SELECT read, page, place, url FROM (SELECT *, row_number() OVER (PARTITION BY read, url ORDER BY page, place) AS k FROM cards) WHERE k = 1),
    news AS (SELECT read, page, n, (SELECT count(*) FROM seen s WHERE s.read = p.read AND s.page = p.page) AS new FROM pages p),
    counted AS (SELECT *, coalesce(sum(new) OVER w, 0) AS new_before, coalesce(sum(1) OVER w, 0) AS pages_before FROM news
        WINDOW w AS (PARTITION BY read ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ends AS (SELECT read, min(page) AS last FROM counted WHERE {ends} GROUP BY 1),
    kept AS (SELECT s.*, c.new_before + row_number() OVER (PARTITION BY s.read, s.page ORDER BY place) AS nth
        FROM seen s JOIN counted c ON c.read = s.read AND c.page = s.page LEFT JOIN ends e ON e.read = s.read WHERE e.last IS NULL OR s.page <= e.last)
    SELECT read, page, place, url, CAST(nth AS BIGINT) AS nth FROM kept WHERE {kept}"""


def _ordered(spark: SparkSession, sf_dir: str, stop: paging.Stop, ended: Column) -> DataFrame:
    n = F.col("doc_id")
    page, place = F.floor(n / 100), n % 100
    shown = F.when((page % 7 == 5) | (n % 13 == 0), F.floor(place / 20) * 20).otherwise(n)
    cards = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("read"), page.alias("page"), place.alias("place"), _text("https://c.example/v/", shown).alias("url"))
    pages = cards.groupBy("read", "page").agg(F.count(F.lit(1)).alias("n")).withColumn("ended", ended)
    return paging.until(cards, pages, stop).select("read", "page", "place", "url", "nth")


@query(_CARDS_SQL.format(ends="page % 31 = 30 OR (new = 0 AND pages_before > 0) OR new_before + new >= 40", kept="nth <= 40"))
def paged_until_last_or_nothing_new(spark, sf_dir):
    return _ordered(spark, sf_dir, paging.Stop(cap=40, nothing_new=True), F.col("page") % 31 == 30)


@query(_CARDS_SQL.format(ends="n < 3 OR new_before + new >= 100", kept="nth <= 100"))
def paged_until_short_page(spark, sf_dir):
    return _ordered(spark, sf_dir, paging.Stop(cap=100), F.col("n") < 3)


@query(_CARDS_SQL.format(ends="page % 3 = 2 AND page > 8 OR pages_before + 1 >= 20", kept="true"))
def paged_until_no_more(spark, sf_dir):
    return _ordered(spark, sf_dir, paging.Stop(pages=20), (F.col("page") % 3 == 2) & (F.col("page") > 8))


# ---- captures as a source ------------------------------------------------------------------------------------------


def _captured(spark: SparkSession, pages: DataFrame) -> DataFrameReader:
    """A reader of these answers, written to the shared folder as a capture."""
    captures.register(spark)
    path = f"{paging.shared_folder(spark)}/capture-{uuid.uuid4().hex}"
    captures.capture(pages, path)
    return spark.read.format(captures.NAME).option("path", path).option("board", "himalayas")


@query(_HIMALAYAS_SQL)
def paged_source_browse(spark, sf_dir):
    """All answers of one read; an empty one ends it."""
    pages = _himalayas(spark, sf_dir).withColumn("read", F.lit("all"))
    made = F.to_json(F.struct((F.col("page") * _PER_PAGE).alias("offset"), F.size("jobs").alias("limit"), "jobs"))
    told = _followed(pages.select("read", "page", "url", made.alias("body")), '{"jobs": [], "limit": 20}', _NO_TITLE)
    reader = _captured(spark, told.select(F.lit(captures.BROWSE).alias("mode"), F.lit("").alias("term"), "page", "body"))
    return _shown(boards.himalayas(reader.option("limit", str(_PER_PAGE)).load(), _countries(), max_pages=-1))


def _searched(spark: SparkSession, sf_dir: str) -> DataFrameReader:
    """Answers to a search for each source, two hundred ids to a page; after the declared pages comes one that can't be read."""
    n = F.col("doc_id")
    job = F.struct(F.col("title"), F.col("company").alias("companyName"), _text("https://h.example/w/", n).alias("guid"), F.col("marked").alias("description"))
    listed = _listings(spark, sf_dir).where("source is not null").withColumn("page", (F.floor(n / 200) + 1).cast("int"))
    pages = listed.groupBy(F.col("source").alias("term"), "page").agg(F.collect_list(job).alias("jobs"))
    most = pages.groupBy("term").agg(F.max("page").alias("most"))
    whole = pages.join(most, "term")
    body = F.to_json(F.struct(F.lit(1000).alias("limit"), (F.col("most") * 1000 - 999).alias("totalCount"), "jobs"))
    told = whole.select("term", "page", body.alias("body")).unionByName(most.select("term", (F.col("most") + 1).alias("page"), F.lit("no answer").alias("body")))
    return _captured(spark, told.withColumn("mode", F.lit(captures.SEARCH))).option("mode", captures.SEARCH)


_SEARCH_SQL = "SELECT 'himalayas' || chr(30) || 'https://h.example/w/' || doc_id AS id, 'Job ' || doc_id AS title FROM documents WHERE source IS NOT NULL"


@query(_SEARCH_SQL)
def paged_source_search(spark, sf_dir):
    return boards.himalayas(_searched(spark, sf_dir).load(), _countries(), search=True, max_pages=-1).select("id", "title")


@query(f"{_SEARCH_SQL} AND source IN ('src1', 'src2') AND doc_id < 400")
def paged_source_pushdown(spark, sf_dir):
    """Two searches, two pages of each: what the filters ask for is all that is planned."""
    pages = _searched(spark, sf_dir).load().where(F.col("term").isin("src1", "src2") & (F.col("page") <= 2))
    return boards.himalayas(pages, _countries(), search=True, max_pages=-1).select("id", "title")
