"""Pages to links."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.fixed import PORTAL_BANNED_TITLES
from broadsheet.functions.core import literal_array
from broadsheet.functions.text import link_text, normalise_title
from broadsheet.functions.urls import has_prefix, is_feed_noise, is_web_url, parse_base
from broadsheet.functions.urls import resolve_url
from broadsheet.operators.links import (
    LINK_ARRAY,
    anchor_array,
    dedup_across_pages,
    dedup_within_pages,
    drop_banned,
    explode_links,
    first_per_url,
    or_empty,
    page_status,
    resolve_array,
    unknown_urls,
    with_base,
    with_events,
)
from broadsheet.operators.rules import SiteRule, with_rules
from broadsheet.plans.ingest import page_links
from broadsheet.queries.common import (
    SQL_ANCHORS,
    SQL_LINKS,
    WS,
    query,
    sql_collapse,
    sql_decode,
    sql_percent,
    sql_text_content,
    sql_visible,
    table,
)

from broadsheet.schemas import ARCHIVE
from broadsheet.session import shared_dir
from broadsheet.sources.archive import append_archive, read_known, url_id

ANCHOR_ARRAY = "array<struct<pos:int,title:string,href:string>>"

# Markup the fixture pages lack: other quoting, upper case, hidden, empty and nameless anchors.
_EXTRA = [
    ("<a class=\"n\" href='/q?x=1&amp;y=", "'>Q &lt;", "&gt;<b> b</b></a>"),
    ('<!-- <a href="/hidden', '">hidden', "</a> -->"),
    ('<A TITLE="a>b" HREF="/up', '">Up\n ', "</A>"),
    ('<a href="">empty', "", '</a><a href="/blank"> </a><a name="n">n</a>'),
]


def _extra_markup() -> Column:
    key = F.col("page_id").cast("string")
    pieces = []
    for head, middle, tail in _EXTRA:
        pieces += [F.lit(head), key, F.lit(middle), key, F.lit(tail)]
    return F.concat(F.col("html"), *pieces)


def _sql_extra() -> str:
    pieces = []
    for parts in _EXTRA:
        quoted = [p.replace("'", "''") for p in parts]
        pieces.append(f"'{quoted[0]}' || page_id || '{quoted[1]}' || page_id || '{quoted[2]}'")
    return "html || " + " || ".join(pieces)


def _with_found(pages: DataFrame, name: str = "links") -> DataFrame:
    """Resolved anchors of each page, before any selection."""
    cut = with_base(with_events(pages))
    return cut.withColumn(name, resolve_array(anchor_array(F.col("events")), F.col("base")))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_links(_with_found(table(spark, sf_dir, "pages")))


_HREF = r"""(?is)^<a\s(?:[^>"'']|"[^"]*"|''[^'']*'')*?href=("[^"]*"|''[^'']*''|[^\s>]+)"""

# Either quote character, trimmed off a raw attribute value.
_BARE = "trim(raw, '\"''')"


@query(
    "anchors",
    f"""
WITH p AS (SELECT page_id, {sql_visible(_sql_extra())} AS h FROM pages),
tags AS (
  SELECT page_id, unnest(found) AS a, generate_subscripts(found, 1) AS i
  FROM (SELECT page_id, regexp_extract_all(h,
        '(?is)<a\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>.*?</a>') AS found FROM p)
),
parts AS (
  SELECT page_id, i, regexp_extract(a, '{_HREF}', 1) AS raw,
         regexp_extract(a, '(?is)^<a\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>(.*)</a>$', 1) AS inside
  FROM tags
),
clean AS (
  SELECT page_id, i, {sql_text_content("inside")} AS title,
         {sql_decode(_BARE)} AS href
  FROM parts
)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, title, href
FROM clean WHERE title <> '' AND href <> ''""",
)
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_events(table(spark, sf_dir, "pages").withColumn("html", _extra_markup()))
    return pages.select("page_id", F.inline(or_empty(anchor_array(F.col("events")), ANCHOR_ARRAY)))


# References of every kind, made from each page's id.
_REFERENCES = [
    "a{}/../b/./c",
    "?q=é x{}",
    "#frag{}",
    "//CDN.Example.org:443/i{}",
    "HTTP://Up.Example.com:80/{}",
    "https://x.org/ä{}?ö#ü",
    "javascript:void({})",
    "mailto:u{}@example.com",
    "\\win\\{}",
    "./",
    "x{}/../../../y",
    "/r/../{}/..",
    "http://bad host/{}",
    "/plain/{}.html?a=b",
    "https://done.example.com/p/{}",
]


def _sql_references() -> str:
    items = []
    for ref in _REFERENCES:
        head, _, tail = ref.partition("{}")
        items.append(f"'{head}' || page_id || '{tail}'" if "{}" in ref else f"'{ref}'")
    return f"[{', '.join(items)}]"


_SQL_RESOLVE = rf"""
h AS (
  SELECT page_id, url, unnest(refs) AS href, generate_subscripts(refs, 1) AS n
  FROM (SELECT page_id, url, {_sql_references()} AS refs FROM pages)
),
s AS (
  SELECT *, lower(regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
         regexp_replace(href, '^[A-Za-z][A-Za-z0-9+.\-]*:', '') AS after
  FROM h
),
c AS (
  SELECT *, replace(regexp_extract(after, '^([^?#]*)', 1), '\', '/') AS path,
         regexp_extract(after, '^[^?#]*(\?[^#]*)', 1) AS query,
         regexp_extract(after, '(#.*)$', 1) AS fragment,
         regexp_extract(url, '^(https?)://', 1) AS base_scheme,
         regexp_extract(url, '^https?://([^/?#]*)', 1) AS base_host,
         regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS base_path
  FROM s
),
m AS (
  SELECT *,
         CASE WHEN scheme <> '' THEN scheme ELSE base_scheme END AS out_scheme,
         CASE WHEN scheme <> '' OR path LIKE '//%'
              THEN lower(regexp_extract(path, '^/*([^/]*)', 1)) ELSE base_host END AS host,
         CASE WHEN scheme <> '' OR path LIKE '//%' THEN regexp_replace(path, '^/*[^/]*', '')
              WHEN path LIKE '/%' THEN path
              WHEN path = '' THEN base_path
              ELSE regexp_replace(base_path, '[^/]*$', '') || path END AS merged,
         CASE WHEN scheme = '' AND path = '' AND query = ''
              THEN regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) ELSE query END AS out_query
  FROM c
),
d AS (
  SELECT *,
         list_reduce(string_split(regexp_replace(merged, '^/', ''), '/'),
           lambda acc, seg: CASE WHEN seg = '..' THEN regexp_replace(acc, '/[^/]*$', '')
                                 WHEN seg = '.' THEN acc ELSE acc || '/' || seg END, '')
         || CASE WHEN regexp_matches(merged, '/\.\.?$') THEN '/' ELSE '' END AS walked
  FROM m
)"""


@query(
    "abs_urls",
    rf"""
WITH {_SQL_RESOLVE}
SELECT page_id, n - 1 AS n, href,
       CASE WHEN scheme NOT IN ('', 'http', 'https') THEN href
            WHEN host = '' OR host LIKE '% %' THEN NULL
            ELSE out_scheme || '://'
                 || regexp_replace(host, CASE out_scheme WHEN 'http' THEN ':80$' ELSE ':443$' END, '')
                 || {sql_percent("walked", "[^!-~]")}
                 || {sql_percent("out_query", "[^!-~]")}
                 || {sql_percent("fragment", "[^!-~]")} END AS url
FROM d""",
)
def abs_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    refs = []
    for ref in _REFERENCES:
        head, _, tail = ref.partition("{}")
        refs.append(F.concat(F.lit(head), key, F.lit(tail)) if "{}" in ref else F.lit(ref))
    pages = table(spark, sf_dir, "pages").withColumn("base", parse_base(F.col("url")))
    rows = pages.select("page_id", "base", F.posexplode(F.array(*refs)).alias("n", "href"))
    return rows.select(
        "page_id", "n", "href", resolve_url(F.col("href"), F.col("base")).alias("url")
    )


_SQL_VARIANTS = f"""{SQL_LINKS},
variants AS (
  SELECT page_id, pos,
         CASE pos % 5 WHEN 4 THEN page_id || ' 评论' WHEN 3 THEN ' ' ELSE title END AS title,
         CASE (page_id + pos) % 6
              WHEN 1 THEN url || '#Comment'
              WHEN 2 THEN url || '/?source=feed'
              WHEN 3 THEN regexp_replace(url, '^(https?://[^/]*)', '\\1/a/Video')
              WHEN 4 THEN 'ftp:' || url
              ELSE url END AS url
  FROM links
)"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, shape = F.col("pos") % 5, (F.col("page_id") + F.col("pos")) % 6
    url = F.col("url")
    return _links(spark, sf_dir).select(
        "page_id",
        "pos",
        F.when(kind == 4, F.concat(F.col("page_id").cast("string"), F.lit(" 评论")))
        .when(kind == 3, F.lit(" "))
        .otherwise(F.col("title"))
        .alias("title"),
        F.when(shape == 1, F.concat(url, F.lit("#Comment")))
        .when(shape == 2, F.concat(url, F.lit("/?source=feed")))
        .when(shape == 3, F.regexp_replace(url, "^(https?://[^/]*)", "$1/a/Video"))
        .when(shape == 4, F.concat(F.lit("ftp:"), url))
        .otherwise(url)
        .alias("url"),
    )


@query(
    "scheme_filter",
    f"""WITH {_SQL_VARIANTS}
SELECT page_id, pos, url FROM variants WHERE regexp_matches(lower(url), '^https?://')""",
)
def scheme_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir).filter(is_web_url(F.col("url")))
    return rows.select("page_id", "pos", "url")


@query(
    "prefix_filter",
    f"""WITH {_SQL_VARIANTS}
SELECT page_id, pos, url FROM variants
WHERE starts_with(url, 'https://blog.') OR starts_with(url, 'http://www.')""",
)
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = literal_array(["https://blog.", "http://www."])
    rows = _variants(spark, sf_dir).filter(has_prefix(F.col("url"), allowed))
    return rows.select("page_id", "pos", "url")


@query(
    "feed_noise_filter",
    f"""WITH {_SQL_VARIANTS}
SELECT page_id, pos, title, url FROM variants
WHERE NOT (lower(regexp_extract(url, '(#.*)$', 1)) = '#comment'
        OR suffix(regexp_replace(url, '#.*$', ''), '/?source=feed')
        OR contains(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/video')
        OR regexp_matches(title, '^[0-9]+{WS}*评论$'))
  AND NOT regexp_matches(title, '^{WS}*$')""",
)
def feed_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, url = F.col("title"), F.col("url")
    rows = _variants(spark, sf_dir)
    return rows.filter(~is_feed_noise(title, url) & (normalise_title(title) != ""))


_BANNED_SAMPLE = ["de", "the", "in", "los", "was", "is", "The", "La", "der"]


@query(
    "banned_fallback",
    f"""WITH {SQL_LINKS},
titled AS (
  SELECT page_id, pos, CASE WHEN page_id % 10 = 0 THEN '首页' ELSE title END AS title, url
  FROM links
),
marked AS (
  SELECT *, title IN ('首页', {", ".join(f"'{t}'" for t in _BANNED_SAMPLE)}) AS banned
  FROM titled
)
SELECT page_id, pos, title, url FROM (
  SELECT *, count(*) FILTER (WHERE NOT banned) OVER (PARTITION BY page_id) AS kept FROM marked
) WHERE NOT banned OR kept = 0""",
)
def banned_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(
        F.col("all_links"),
        lambda link: F.struct(
            link["pos"],
            F.when(F.col("page_id") % 10 == 0, "首页").otherwise(link["title"]).alias("title"),
            link["url"],
        ),
    )
    banned = literal_array([*PORTAL_BANNED_TITLES, *_BANNED_SAMPLE])
    pages = _with_found(table(spark, sf_dir, "pages"), "all_links").withColumn("found", found)
    return explode_links(pages.withColumn("links", drop_banned(F.col("found"), banned)))


# Every link twice, the second time in upper case and further down the page.
_SQL_TWICE = f"""{SQL_LINKS},
twice AS (
  SELECT page_id, pos, title, url FROM links
  UNION ALL SELECT page_id, pos + 1000, title, upper(url) FROM links
)"""


@query(
    "dedup_first_ci",
    f"""WITH {_SQL_TWICE}
SELECT page_id, pos, title, url FROM twice
QUALIFY row_number() OVER (PARTITION BY page_id, lower(url) ORDER BY pos) = 1""",
)
def dedup_first_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _with_found(table(spark, sf_dir, "pages"), "found")
    shouted = F.transform(
        "found",
        lambda link: F.struct(
            (link["pos"] + 1000).alias("pos"), link["title"], F.upper(link["url"]).alias("url")
        ),
    )
    both = F.concat(F.col("found"), shouted.cast(LINK_ARRAY))
    return explode_links(pages.withColumn("links", first_per_url(both)))


@query("dedup_first_ci_table", f"""WITH {_SQL_TWICE}
SELECT page_id, pos, title, url FROM twice
QUALIFY row_number() OVER (PARTITION BY page_id, lower(url) ORDER BY pos) = 1""")
def dedup_first_ci_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    shouted = links.select("page_id", F.col("pos") + 1000, "title", F.upper("url"))
    return dedup_within_pages(links.union(shouted))


@query(
    "dedup_first_cs",
    f"""WITH {_SQL_TWICE}
SELECT page_id, pos, title, url FROM twice
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1""",
)
def dedup_first_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    shouted = links.select("page_id", F.col("pos") + 1000, "title", F.upper("url"))
    return dedup_across_pages(links.union(shouted))


@query(
    "page_status",
    f"""WITH {SQL_LINKS},
counted AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id)
SELECT page_id,
       CASE WHEN page_id % 13 = 0 THEN 'Error'
            WHEN page_id % 5 <> 0 AND coalesce(n, 0) > 0 THEN 'Success'
            WHEN page_id % 7 = 0 THEN 'NavigationFailed'
            ELSE 'NoLinks' END AS status,
       CASE WHEN page_id % 13 = 0 OR page_id % 5 = 0 THEN 0 ELSE coalesce(n, 0) END AS n_links
FROM pages LEFT JOIN counted USING (page_id)""",
)
def page_status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.when(key % 13 == 0, None)
        .when(key % 5 == 0, F.regexp_replace("html", "(?i)<a ", "<i "))
        .otherwise(F.col("html"))
        .alias("html"),
        F.when(key % 7 == 0, 404).otherwise(200).alias("http_status"),
    )
    found = _with_found(pages)
    return found.select(
        "page_id",
        page_status(F.col("links"), F.col("html"), F.col("http_status")).alias("status"),
        F.size(or_empty(F.col("links"), LINK_ARRAY)).alias("n_links"),
    )


_SQL_NEW = f"""{SQL_LINKS},
known AS (SELECT DISTINCT url FROM links WHERE page_id % 3 = 0),
fresh AS (
  SELECT * FROM links WHERE url NOT IN (SELECT url FROM known)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1
)"""


def _new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    known = links.filter(F.col("page_id") % 3 == 0).select("url")
    return unknown_urls(dedup_across_pages(links), known)


@query("known_url_anti", f"WITH {_SQL_NEW} SELECT page_id, pos, title, url FROM fresh")
def known_url_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_links(spark, sf_dir)


@query("known_url_stored", f"WITH {_SQL_NEW} SELECT page_id, pos, title, url FROM fresh")
def known_url_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against the key table of a stored archive."""
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    links = _links(spark, sf_dir)
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in ARCHIVE if f.name not in ("id", "url")}
    archived = links.filter(F.col("page_id") % 3 == 0).select(url_id(F.col("url")).alias("id"), "url")
    append_archive(archived.withColumns(nothing), path)
    return unknown_urls(dedup_across_pages(links), read_known(spark, path))


@query(
    "new_links_by_host",
    f"""WITH {_SQL_NEW}
SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, count(*) AS n_links,
       count(DISTINCT title) AS n_titles
FROM fresh GROUP BY 1""",
)
def new_links_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links no archive has yet, per host."""
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    return (
        _new_links(spark, sf_dir)
        .groupBy(host.alias("host"))
        .agg(F.count("*").alias("n_links"), F.countDistinct("title").alias("n_titles"))
    )


# Rules for hosts of the fixture pages: one by prefix, one that bans titles.
_FIXTURE_RULES = [
    SiteRule("blog", host="Blog.Tionsh.Example.NET", link_prefixes=["https://"]),
    SiteRule("forum", host="thther.example.org", banned_titles=_BANNED_SAMPLE),
]


@query(
    "site_rule_lookup",
    """
SELECT page_id, CASE lower(regexp_extract(url, '^https?://([^/?#]*)', 1))
                     WHEN 'blog.tionsh.example.net' THEN 'blog'
                     WHEN 'thther.example.org' THEN 'forum'
                     ELSE 'generic' END AS rule
FROM pages""",
)
def site_rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_rules(table(spark, sf_dir, "pages"), _FIXTURE_RULES)
    return pages.select("page_id", F.col("rule.name").alias("rule"))


@query(
    "page_links",
    f"""WITH {SQL_LINKS},
ruled AS (
  SELECT links.*, CASE lower(regexp_extract(pages.url, '^https?://([^/?#]*)', 1))
                       WHEN 'blog.tionsh.example.net' THEN 'blog'
                       WHEN 'thther.example.org' THEN 'forum' ELSE 'generic' END AS rule
  FROM links JOIN pages USING (page_id)
),
wanted AS (
  SELECT * FROM ruled WHERE rule <> 'blog' OR starts_with(url, 'https://')
  QUALIFY row_number() OVER (PARTITION BY page_id, lower(url) ORDER BY pos) = 1
),
marked AS (
  SELECT *, rule = 'forum' AND title IN ({", ".join(f"'{t}'" for t in _BANNED_SAMPLE)}) AS banned
  FROM wanted
)
SELECT page_id, pos, title, url FROM (
  SELECT *, count(*) FILTER (WHERE NOT banned) OVER (PARTITION BY page_id) AS kept FROM marked
) WHERE NOT banned OR kept = 0""",
)
def page_links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(table(spark, sf_dir, "pages"), _FIXTURE_RULES)

_SQL_RAGGED = (
    "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) || e' \\n\\t' || chr(12288) || ' ' || url"
    " || chr(160) || e'\\r\\n'"
)


@query(
    "title_normalise",
    f"""
SELECT page_id, {sql_collapse(_SQL_RAGGED)} AS title
FROM pages""",
)
def title_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(
        F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1),
        F.lit(" \n\t\u3000 "),
        F.col("url"),
        F.lit("\u00a0\r\n"),
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", normalise_title(raw).alias("title")
    )


@query(
    "link_text",
    f"""WITH {SQL_ANCHORS}
SELECT page_id, pos,
       CASE WHEN pos % 4 = 0 THEN '' ELSE title END || ' -> ' || href AS shown
FROM anchors""",
)
def link_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_events(table(spark, sf_dir, "pages"))
    rows = pages.select("page_id", F.inline(or_empty(anchor_array(F.col("events")), ANCHOR_ARRAY)))
    title = F.when(F.col("pos") % 4 == 0, None).otherwise(F.col("title"))
    return rows.select("page_id", "pos", link_text(title, F.col("href")).alias("shown"))
