"""Site rules: what to extract from which site, kept as data and joined to the pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.fixed import (
    FEED_BANNED_TITLES,
    NETEASE_PREFIXES,
    PORTAL_BANNED_TITLES,
    TOUTIAO_PREFIXES,
)
from broadsheet.functions.core import literal_array
from broadsheet.functions.html import open_tag
from broadsheet.functions.urls import host_of
from broadsheet.schemas import EXTRACT_RESULT


@dataclass(frozen=True)
class SiteRule:
    """How one site's pages are read. Empty prefixes allow every http(s) link."""

    name: str
    host: str | None = None
    link_prefixes: list[str] = field(default_factory=list)
    feed_noise: bool = False
    banned_titles: list[str] = field(default_factory=list)
    root_tag: str = "article"
    root_class: str | None = None
    meta_kind: str | None = None  # 'spans', 'info' or none
    meta_class: str | None = None
    zone: str | None = None  # of publish times without an offset; the session's by default


# Both built-in sites publish in China's time.
CHINA = "Asia/Shanghai"
GENERIC = SiteRule("generic", banned_titles=PORTAL_BANNED_TITLES)
NETEASE = SiteRule(
    "netease",
    host="www.163.com",
    link_prefixes=NETEASE_PREFIXES,
    root_tag="div",
    root_class="post_main",
    meta_kind="info",
    meta_class="post_info",
    zone=CHINA,
)
TOUTIAO = SiteRule(
    "toutiao",
    host="www.toutiao.com",
    link_prefixes=TOUTIAO_PREFIXES,
    feed_noise=True,
    banned_titles=FEED_BANNED_TITLES,
    root_tag="div",
    root_class="article-content",
    meta_kind="spans",
    meta_class="article-meta",
    zone=CHINA,
)
SITE_RULES = [TOUTIAO, NETEASE]


def rule_struct(rule: SiteRule) -> Column:
    """A rule as one struct column; class names become opening-tag patterns."""
    meta = open_tag("div", rule.meta_class) if rule.meta_class else None
    titles = literal_array([" ".join(title.split()) for title in rule.banned_titles])
    return F.struct(
        F.lit(rule.name).alias("name"),
        literal_array(rule.link_prefixes).alias("prefixes"),
        F.lit(rule.feed_noise).alias("feed_noise"),
        titles.alias("banned"),
        F.lit(rule.root_tag).alias("root_tag"),
        F.lit(open_tag(rule.root_tag, rule.root_class)).alias("root_open"),
        F.lit(rule.meta_kind).cast("string").alias("meta_kind"),
        F.lit(meta).cast("string").alias("meta_open"),
        F.lit(rule.zone).cast("string").alias("zone"),
    )


def with_rules(
    pages: DataFrame, rules: Iterable[SiteRule] = SITE_RULES, default: SiteRule = GENERIC
) -> DataFrame:
    """Attach the rule of each page's host, the default where no rule names it.

    Rules are a Python list, so the broadcast side is as small as the program text.
    """
    rules = list(rules)
    if not rules:
        return pages.withColumn("rule", rule_struct(default))
    entries = F.array(
        *[
            F.struct(F.lit(r.host.lower()).alias("rule_host"), rule_struct(r).alias("rule"))
            for r in rules
        ]
    )
    table = pages.sparkSession.range(1).select(F.inline(entries))
    return (
        pages.withColumn("rule_host", host_of(F.col("url")))
        .join(F.broadcast(table), "rule_host", "left")
        .withColumn("rule", F.coalesce("rule", rule_struct(default)))
        .drop("rule_host")
    )


def rule_named(rules: Iterable[SiteRule], name: str) -> SiteRule | None:
    """Rule by name in any case."""
    return next((r for r in rules if r.name.lower() == name.lower()), None)


def extract_with(
    pages: DataFrame, extractor: Callable[[str, str], dict]
) -> DataFrame:
    """Hook for sites that patterns cannot cover: ``extractor(url, html)`` gives the fields.

    Runs as Arrow batches inside the tasks; a page that fails becomes a row with ``error``.
    """
    names = EXTRACT_RESULT.fieldNames()
    kept = pages.select("page_id", "url", "html")
    extracted = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EXTRACT_RESULT)
    schema = f"page_id long, url string, {extracted.replace('html ', 'root_html ')}, error string"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, url, html in frame.itertuples(index=False):
                try:
                    result = extractor(url, html) or {}
                    rows.append((page_id, url, *[result.get(n) for n in names], None))
                except Exception as problem:  # one bad page must not end the job
                    rows.append((page_id, url, *[None] * len(names), str(problem)))
            columns = ["page_id", "url", *names, "error"]
            yield pd.DataFrame(rows, columns=columns).rename(columns={"html": "root_html"})

    return kept.mapInPandas(batches, schema)
