"""Pages to links. Everything that concerns one page stays inside that page's row.

Extraction, filters, first-per-URL and the banned-title fallback are array expressions, so a
page's links are final before they are exploded and no shuffle is needed to get them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadsheet.functions.core import is_blank, let, or_empty
from broadsheet.functions.html import anchors, base_href, tag_events
from broadsheet.functions.urls import has_prefix, is_feed_noise, is_web_url
from broadsheet.functions.urls import parse_base, resolve_url, url_buckets
from broadsheet.schemas import URL_BUCKET

LINK_ARRAY = "array<struct<pos:int,title:string,url:string>>"


def anchor_array(events: Column) -> Column:
    """ARRAY<STRUCT<pos, title, href>> of a page's anchors, titles normalised and not blank."""
    return F.transform(
        anchors(events),
        lambda a, i: F.struct(i.alias("pos"), a["title"].alias("title"), a["href"].alias("href")),
    )


def with_events(pages: DataFrame) -> DataFrame:
    """Add ``events`` of ``html``, cut once for all that is read off them."""
    return pages.withColumn("events", tag_events(F.col("html")))


def with_base(pages: DataFrame) -> DataFrame:
    """Add ``base``, parts of the URL that relative addresses of a page with ``events`` go by.

    Each step is a column of its own, so that none is computed or planned more than once.
    """
    own = pages.withColumns({"_own": parse_base(F.col("url")), "_target": base_href(F.col("events"))})
    resolved = F.when(F.col("_target").isNotNull(), resolve_url(F.col("_target"), F.col("_own")))
    found = own.withColumn("_resolved", resolved)
    base = F.when(is_web_url(F.col("_resolved")), parse_base(F.col("_resolved"))).otherwise(F.col("_own"))
    return found.withColumn("base", base).drop("_own", "_target", "_resolved")


def resolve_array(found: Column, base: Column) -> Column:
    """The anchors with absolute http(s) URLs; the others are dropped."""
    resolved = F.transform(
        found,
        lambda a: F.struct(
            a["pos"].alias("pos"),
            a["title"].alias("title"),
            resolve_url(a["href"], base).alias("url"),
        ),
    )
    return F.filter(resolved, lambda link: is_web_url(link["url"]))


def site_links(links: Column, prefixes: Column, feed_noise: Column) -> Column:
    """Keep what the site's rule allows."""
    return F.filter(
        links,
        lambda link: has_prefix(link["url"], prefixes)
        & ~(feed_noise & is_feed_noise(link["title"], link["url"])),
    )


def first_per_url(links: Column) -> Column:
    """First link per URL in any case, in page order.

    Sorting brings equal URLs together, so a page with many links costs n log n.
    """
    keyed = F.array_sort(
        F.transform(
            links,
            lambda link: F.struct(
                F.lower(link["url"]).alias("key"), link["pos"], link["title"], link["url"]
            ),
        )
    )

    def firsts(items: Column) -> Column:
        kept = F.filter(
            items,
            lambda item, i: (i == 0) | (F.get(items, i - 1)["key"] != item["key"]),
        )
        return F.array_sort(
            F.transform(kept, lambda k: F.struct(k["pos"], k["title"], k["url"]))
        )

    return let(keyed, firsts)


def drop_banned(links: Column, banned: Column) -> Column:
    """Links without banned titles, or all of them when nothing else would be left."""

    def choose(items: Column) -> Column:
        allowed = F.filter(items, lambda link: ~F.array_contains(banned, link["title"]))
        return let(allowed, lambda kept: F.when(F.size(kept) > 0, kept).otherwise(items))

    return let(links, choose)


def with_links(pages: DataFrame) -> DataFrame:
    """Add ``links``, the page's final links, to pages that carry a ``rule``."""
    found = resolve_array(anchor_array(F.col("events")), F.col("base"))
    wanted = site_links(found, F.col("rule.prefixes"), F.col("rule.feed_noise"))
    return with_base(with_events(pages)).withColumn(
        "links", drop_banned(first_per_url(wanted), F.col("rule.banned"))
    ).drop("events", "base")


def explode_links(pages: DataFrame) -> DataFrame:
    """One row per link: ``page_id, pos, title, url``."""
    return pages.select("page_id", F.inline(or_empty(F.col("links"), LINK_ARRAY)))


def page_status(links: Column, html: Column, http_status: Column | None = None) -> Column:
    """Success, NavigationFailed, NoLinks or Error. A bad response with links is a success."""
    answered = F.lit(True) if http_status is None else http_status.between(200, 299)
    return (
        F.when(html.isNull(), "Error")
        .when(F.size(links) > 0, "Success")
        .when(F.coalesce(answered, F.lit(False)), "NoLinks")
        .otherwise("NavigationFailed")
    )


def dedup_within_pages(links: DataFrame) -> DataFrame:
    """First link per page and URL in any case, for a table of exploded links."""
    order = Window.partitionBy("page_id", F.lower("url")).orderBy("pos")
    return links.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def dedup_across_pages(links: DataFrame, *order: str) -> DataFrame:
    """First link per URL, case kept, over all pages.

    Each task keeps one row per URL before the shuffle, so a URL that every page links to
    costs no more than any other.
    """
    ranked = Window.partitionBy("url").orderBy(*(order or ("page_id", "pos")))
    return links.withColumn("_n", F.row_number().over(ranked)).filter("_n = 1").drop("_n")


def known_among(known: DataFrame, urls: DataFrame) -> DataFrame:
    """The distinct ``url`` of ``urls`` that are in ``known``, an archive or a key table.

    Of a key table only the buckets that the URLs fall into are opened: the partition filter is a
    runtime subquery over the URLs. The known side is cut down to the URLs before it is made
    distinct, so where the URLs are few they are broadcast and the known side is not shuffled.
    """
    wanted = urls.select("url").filter(F.col("url").isNotNull())
    if URL_BUCKET in known.columns:
        # At most 16 + 256 + 4,096 names, however many URLs there are.
        named = wanted.select(F.explode(url_buckets(F.col("url"))).alias("bucket"))
        buckets = named.agg(F.collect_set("bucket")).scalar()
        known = known.filter(F.array_contains(buckets, F.col(URL_BUCKET)))
    held = known.select("url").filter(F.col("url").isNotNull())
    return held.join(wanted, "url", "left_semi").distinct()


def unknown_urls(
    rows: DataFrame, known: DataFrame, urls: DataFrame | None = None
) -> DataFrame:
    """Rows whose URL is not known yet; URLs compare with case, blank ones are dropped.

    ``known`` is the archive or its key table. ``urls`` names the rows' URLs where they can be had
    without computing the rows. Pass rows that are already one per URL so that no key repeats on
    either side.
    """
    fresh = rows.filter(~is_blank(F.col("url")))
    return fresh.join(known_among(known, fresh if urls is None else urls), "url", "left_anti")


def fresh_urls(pages: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct URLs of ``pages`` that are not known; no other column of the pages is read."""
    return unknown_urls(pages.select("url").distinct(), known, pages.select("url"))
