"""Markup that the fixture pages lack, put in front of every whole page.

Expected values are the page's own, from its own oracle, and those that the markup adds, from ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.functions.core import or_empty
from broadsheet.functions.html import image_sources, text_content
from broadsheet.functions.timefmt import parse_publish_time
from broadsheet.operators.articles import articles, meta_from_spans
from broadsheet.operators.links import LINK_ARRAY, anchor_array, resolve_array, with_base, with_events
from broadsheet.operators.rules import SiteRule, with_rules
from broadsheet.queries.common import SQL_ANCHORS, query, sql_block_text, sql_percent, sql_text_content
from broadsheet.queries.common import sql_visible, table

_ANCHOR_ARRAY = "array<struct<pos:int,title:string,href:string>>"


def _before(markup: str) -> Column:
    """The page after some markup in which {} stands for its id."""
    head, tail = markup.split("{}")
    return F.concat(F.lit(head), F.col("page_id").cast("string"), F.lit(tail), F.col("html"))


def _marked_pages(spark: SparkSession, sf_dir: str, markup: str) -> DataFrame:
    """Whole pages behind some markup, cut into events."""
    return with_events(table(spark, sf_dir, "pages").withColumn("html", _before(markup)))


@query(
    "html_references",
    f"""
SELECT page_id, trim('café → ' || page_id || ' A äß © 2024 ∉ – ' || chr(65533) || ' &lt; a&b &bogus; | ' ||
       {sql_text_content(f"regexp_replace({sql_visible('html')}, '(?is)<title[\\s>].*?</title>', '', 'g')")}) AS text
FROM pages""",
)
def html_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named references with and without semicolon, long numbers, controls, no double decoding."""
    pages = _marked_pages(
        spark,
        sf_dir,
        "<p>caf&eacute; &rarr; {} &#x0000041; &auml;&szlig; &copy 2024 &notin; &#150; &#99999999999;"
        " &amp;lt; a&b &bogus; | </p>",
    )
    return pages.select("page_id", text_content(F.col("events")).alias("text"))


@query("nested_meta", "SELECT page_id, 'P ' || page_id || ' x' AS publish_time, 'b' AS publisher, len(html) > 0 AS read FROM pages")
def nested_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and third span by document order, each with its whole text."""
    pages = _marked_pages(spark, sf_dir, "<span>P <span>{}</span> x</span><span>b</span>")
    meta = pages.select("page_id", meta_from_spans(F.col("events")).alias("m"), (F.size("events") > 6).alias("read"))
    return meta.select("page_id", "m.*", "read")


@query(
    "inert_elements",
    f"""WITH {SQL_ANCHORS}
SELECT page_id, 0 AS pos, 'P' AS title, '/p' || page_id AS href, '/i.png' AS images FROM pages
UNION ALL SELECT page_id, pos + 1, title, href, '/i.png' FROM anchors""",
)
def inert_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and images inside noscript, template, textarea and title are none; all others are."""
    pages = _marked_pages(
        spark,
        sf_dir,
        "<title><a href='/t'>T</a></title><noscript><a href='/n'>N</a><img src='/n.png'></noscript>"
        "<template><img src='/t.png'></template><textarea><a href='/a'>A</a></textarea>"
        "<img data-src='/i.png'><a href='/p{}'>P</a>",
    )
    images = F.array_join(image_sources(F.col("events")), " ")
    links = or_empty(anchor_array(F.col("events")), _ANCHOR_ARRAY)
    return pages.select("page_id", images.alias("images"), F.inline(links))


@query(
    "base_href",
    f"""WITH {SQL_ANCHORS}
SELECT page_id, 0 AS pos, 'T' AS title, 'https://cdn.example.com/root/a' || page_id || '.html' AS url FROM pages
UNION ALL
SELECT page_id, pos + 1, title, 'https://cdn.example.com' || {sql_percent("href", "[^!-~]")} FROM anchors""",
)
def base_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of a page resolve against its base element, not against its own address."""
    markup = "<base href='https://cdn.example.com/root/x'><a href='a{}.html'>T</a>"
    pages = with_base(_marked_pages(spark, sf_dir, markup))
    links = resolve_array(anchor_array(F.col("events")), F.col("base"))
    return pages.select("page_id", F.inline(or_empty(links, LINK_ARRAY)))


_ZONED = SiteRule("zoned", host="zoned.example.org", meta_kind="spans", meta_class="m", zone="Asia/Shanghai")


@query(
    "site_zone",
    f"""
SELECT page_id, 'reader' AS publisher,
       CASE page_id % 3
            WHEN 0 THEN make_timestamp(2024, 1 + page_id % 12, 1 + page_id % 28, 7, 20, 0) - INTERVAL 8 HOUR
            WHEN 1 THEN make_timestamp(2023, 1 + page_id % 12, 1 + page_id % 28, 7, 20, 0) - INTERVAL 8 HOUR
            ELSE make_timestamp(2024, 1 + page_id % 12, 1 + page_id % 28, 7, 20, 0) END AS publish_time,
       md5('stamp' || chr(10) || {sql_block_text(f"regexp_extract({sql_visible('html')}, '(?is)<article>(.*)</article>', 1)")}) AS content
FROM pages""",
)
def site_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of whole pages in their site's zone, without a year, and with an offset of their own."""
    key = F.col("page_id")
    month, day = 1 + key % 12, 1 + key % 28
    time = (
        F.when(key % 3 == 0, F.format_string("2024-%02d-%02d 07:20", month, day))
        .when(key % 3 == 1, F.format_string("%d月%d日 07:20", month, day))
        .otherwise(F.format_string("2024-%02d-%02dT07:20:00Z", month, day))
    )
    stamp = F.concat(
        F.lit("<article><div class=m hidden><span>"), time, F.lit("</span><span>-</span><span>reader</span></div>")
    )
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("https://zoned.example.org/"), key.cast("string")).alias("url"),
        F.replace("html", F.lit("<article>"), stamp).alias("html"),
    )
    # The last moment of 2023 by UTC is 2024 already in the site's zone; 20 minutes past 15:00 is not.
    now = F.lit("2023-12-31 15:20:00").cast("timestamp")
    found = articles(with_rules(pages, [_ZONED]), now)
    body = F.regexp_replace("content", "^[^\\n]*", "stamp")
    return found.select("page_id", "publisher", "publish_time", F.md5(body).alias("content"))


@query(
    "publish_time_forms",
    """
    SELECT event_id, make_timestamp(2024, 1 + event_id % 12, 1 + event_id % 28, 15, 4, 0) AS slashed,
           make_timestamp(2024, 1 + event_id % 12, 1 + event_id % 28, 3, 4, 0) AS early,
           make_timestamp(2023, 1 + event_id % 12, 1 + event_id % 28, 10, 20, 0) AS no_year,
           make_timestamp(2024, 1 + event_id % 12, 1 + event_id % 28, 10, 20, 0) - INTERVAL 8 HOUR AS in_zone
    FROM events
    """,
)
def publish_time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-day marks, month-first dates, dates without a year, and a source's own zone."""
    month, day = 1 + F.col("event_id") % 12, 1 + F.col("event_id") % 28
    now = F.lit("2023-06-01 00:00:00").cast("timestamp")

    def parsed(form: str, **options) -> Column:
        return parse_publish_time(F.format_string(form, month, day), **options)

    return table(spark, sf_dir, "events").select(
        "event_id",
        parsed("2024年%d月%d日 下午3:04").alias("slashed"),
        parsed("2024/%d/%d 3:04 AM").alias("early"),
        parsed("%d月%d日 10:20", now=now).alias("no_year"),
        parsed("%d/%d/2024 10:20", zone="Asia/Shanghai").alias("in_zone"),
    )
