"""The ingest cycle as lazy plans.

    portals -> links -> unseen links            (what a fetcher has to get)
    landed pages -> articles -> gate -> labels  (what the archive appends)
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from broadsheet.functions.core import is_blank, keep_rows
from broadsheet.operators.articles import articles
from broadsheet.operators.classify import TextModel, classify_by_language
from broadsheet.operators.links import (
    dedup_across_pages,
    explode_links,
    fresh_urls,
    known_among,
    unknown_urls,
    with_links,
)
from broadsheet.operators.rules import SITE_RULES, SiteRule, with_rules
from broadsheet.schemas import ARCHIVE
from broadsheet.sources.archive import append_archive, read_known, restore_known, url_id

# URLs of a batch that are broadcast at most, in bytes.
BROADCAST_BYTES = 64 << 20


def page_links(pages: DataFrame, rules: Iterable[SiteRule] = SITE_RULES) -> DataFrame:
    """``page_id, pos, title, url`` of every page's final links. No shuffle."""
    return explode_links(with_links(with_rules(pages, rules)))


def links_to_fetch(
    portals: DataFrame, archive: DataFrame, rules: Iterable[SiteRule] = SITE_RULES
) -> DataFrame:
    """Links of all portals that are not archived yet, one per URL."""
    return unknown_urls(dedup_across_pages(page_links(portals, rules)), archive)


def landed_from_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages already at hand for a set of links, titled with the link's text.

    The links are one per URL, so no page is repeated; a link without a page keeps its row
    with no HTML and becomes an article with an error. The links are the side that can be
    broadcast: HTML is shuffled only when they are too many for that.
    """
    wanted = links.select("title", "url")
    at_hand = pages.select("page_id", "url", "html").join(wanted, "url")
    missing = wanted.join(pages.select("url").distinct(), "url", "left_anti")
    return at_hand.unionByName(missing, allowMissingColumns=True)


def gate_reasons(rows: DataFrame, archive: DataFrame) -> DataFrame:
    """Add ``reject``: 'blank url', 'known', 'empty' or null for rows to be written."""
    # Rows without a URL would all meet under one key; the join does not see them.
    blank = rows.filter(is_blank(F.col("url"))).withColumn("reject", F.lit("blank url"))
    named = rows.filter(~is_blank(F.col("url")))
    known = known_among(archive, named).withColumn("_known", F.lit(True))
    judged = named.join(known, "url", "left").withColumn(
        "reject", F.when(F.col("_known"), "known").when(F.col("text_length") == 0, "empty")
    )
    return judged.select(*blank.columns).unionByName(blank)


def new_articles(
    landed: DataFrame,
    known: DataFrame,
    rules: Iterable[SiteRule] = SITE_RULES,
    fresh: DataFrame | None = None,
) -> DataFrame:
    """Articles of landed pages that may be written, one per URL.

    Which URLs are new is decided on the URLs alone (``fresh`` if that is known already); HTML is
    read once, for the pages of those. What is left is extracted where it is; only article text
    is shuffled. Of several pages of one URL the first with text is taken.
    """
    urls = fresh_urls(landed, known) if fresh is None else fresh
    pages = landed.join(urls.select("url"), "url", "left_semi").select(*landed.columns)
    found = keep_rows(articles(with_rules(pages, rules)), F.col("text_length") > 0)
    return dedup_across_pages(found, "page_id")


def archive_rows(
    landed: DataFrame,
    known: DataFrame,
    models: dict[str, TextModel] | None = None,
    rules: Iterable[SiteRule] = SITE_RULES,
    fresh: DataFrame | None = None,
) -> DataFrame:
    """Rows to append. Only articles that survive the gate are classified.

    Without models every category is 0. A label that has no flag counts as 0 too; it never
    stops the batch.
    """
    found = new_articles(landed, known, rules, fresh)
    if models:
        labelled = classify_by_language(found, models, "title")
    else:
        labelled = found.withColumn("category", F.lit(0))
    return labelled.select(
        url_id(F.col("url")).alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        "url",
        "text_length",
        "image_count",
        "publish_time",
        "publisher",
        "content",
        F.coalesce("category", F.lit(0)).alias("category"),
    ).select(*ARCHIVE.fieldNames())


def ingest_batch(
    landed: DataFrame,
    archive_path: str,
    models: dict[str, TextModel] | None = None,
    rules: Iterable[SiteRule] = SITE_RULES,
) -> None:
    """Append what is new. Running the same batch again adds nothing.

    New URLs are decided first, against the key table's buckets, and kept. If they are at most
    ``BROADCAST_BYTES`` they are broadcast, so HTML is filtered where it is read and never
    shuffled; beyond that the join is left to Spark. A batch without new URLs ends there.
    """
    spark = landed.sparkSession
    restore_known(spark, archive_path)
    known = read_known(spark, archive_path)
    fresh = fresh_urls(landed, known).persist(StorageLevel.DISK_ONLY)
    try:
        # Every row weighs its text and some 64 bytes of a hash table.
        size = fresh.agg(F.sum(F.octet_length("url") + 64)).first()[0]
        if size is None:
            return
        kept = F.broadcast(fresh) if size <= BROADCAST_BYTES else fresh
        append_archive(archive_rows(landed, known, models, rules, kept), archive_path)
    finally:
        fresh.unpersist()
