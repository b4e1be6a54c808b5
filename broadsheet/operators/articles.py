"""Pages to articles: body, publish time, publisher, images; and articles to text."""

from __future__ import annotations

from datetime import datetime
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet import fixed
from broadsheet.functions.categories import flags_to_chinese
from broadsheet.functions.core import apply_sql, is_blank, let, or_empty, sql_apply, sql_let
from broadsheet.functions.core import ws_trim
from broadsheet.functions.html import (
    element,
    image_sources,
    nth_text,
    plain_text,
    texts_of,
    visible_text,
)
from broadsheet.functions.text import cut_text, default_text, utf16_length
from broadsheet.functions.timefmt import friendly_time, parse_publish_time
from broadsheet.functions.urls import parse_base, sql_data_url, sql_image_url, sql_url_extension
from broadsheet.operators.links import with_events

NO_RESULT = "No result"
MANIFEST_ARRAY = (
    "array<struct<n:int,src:string,url:string,ext:string,bytes:binary,file_name:string>>"
)


def meta_from_spans(meta: Column) -> Column:
    """STRUCT<publish_time, publisher> from the first and third span of a meta block's events."""

    return F.struct(
        F.coalesce(nth_text(meta, "span", 0), F.lit("")).alias("publish_time"),
        F.coalesce(nth_text(meta, "span", 2), F.lit("")).alias("publisher"),
    )


def meta_from_info(info: Column) -> Column:
    """STRUCT<publish_time, publisher> from the events of an info line.

    The time leads the line, or is what stands before the source mark; the first link is the
    publisher.
    """
    text = ws_trim(plain_text(info))

    def fields(line: Column) -> Column:
        mark = F.locate(fixed.SOURCE_MARK, line)
        before = F.when(mark > 1, ws_trim(F.substring(line, F.lit(1), mark - 1)))
        leading = F.nullif(F.regexp_extract(line, fixed.LEADING_TIME, 1), F.lit(""))
        return F.coalesce(leading, before, F.lit(""))

    return F.struct(
        let(text, fields).alias("publish_time"),
        F.coalesce(F.get(texts_of(info, "a"), F.lit(0)), F.lit("")).alias("publisher"),
    )


def extract_fields(pages: DataFrame) -> DataFrame:
    """Text, images, raw publish time and publisher of pages that carry a ``rule``.

    A page is cut into events once; the main element and its meta block are parts of them. A
    missing root gives empty text and no images. A page that was never fetched keeps its row,
    with ``error`` set.
    """
    root = element(F.col("events"), F.col("rule.root_open"), F.lower("rule.root_tag"))
    meta = element(F.col("_root"), F.col("rule.meta_open"), F.lit("div"))
    found = with_events(pages).withColumn("_root", root).withColumn("_meta", meta).withColumn(
        "_fields",
        F.when(F.col("rule.meta_kind") == "spans", meta_from_spans(F.col("_meta"))).when(
            F.col("rule.meta_kind") == "info", meta_from_info(F.col("_meta"))
        ),
    )
    return found.select(
        *[c for c in pages.columns if c not in ("html", "rule")],
        F.coalesce(visible_text(F.col("_root")), F.lit("")).alias("content"),
        F.coalesce(image_sources(F.col("_root")), F.array().cast("array<string>")).alias(
            "images"
        ),
        F.col("_fields.publish_time").alias("publish_time_text"),
        F.col("_fields.publisher").alias("publisher_text"),
        F.col("rule.zone").alias("zone_text"),
        F.when(F.col("html").isNull(), NO_RESULT).alias("error"),
    )


@cache
def _sql_manifest() -> str:
    inline = "_src RLIKE '(?i)^data:'"
    data = sql_let(f"CASE WHEN {inline} THEN _src END", "_given", sql_apply("_given", sql_data_url()))
    url = f"CASE WHEN NOT ({inline}) THEN {sql_image_url('_src', '_in.base')} END"
    ext = f"coalesce(_data.ext, {sql_apply('_address', sql_url_extension())})"
    one = f"named_struct('src', _src, 'url', _address, 'ext', {ext}, 'bytes', _data.bytes)"
    each = sql_let(data, "_data", sql_let(url, "_address", one))
    kept = (
        f"filter(transform(array_distinct(_in.images), _src -> {each}), "
        "_p -> _p.url IS NOT NULL OR _p.bytes IS NOT NULL)"
    )
    return (
        f"_in -> transform({kept}, (_p, _i) -> named_struct('n', _i + 1, 'src', _p.src, 'url', _p.url, "
        "'ext', _p.ext, 'bytes', _p.bytes, 'file_name', format_string('img_%03d%s', _i + 1, _p.ext)))"
    )


def image_manifest(images: Column, base: Column) -> Column:
    """ARRAY<STRUCT<n, src, url, ext, bytes, file_name>> of the images that can be kept.

    Inline images are decoded; the others resolve to an http(s) address. What can do neither
    is skipped, and numbers run without gaps over what is kept. All inside the page's row.
    """
    return apply_sql(F.struct(images.alias("images"), base.alias("base")), _sql_manifest())


def articles(pages: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Article rows from pages with a ``rule``; failed pages stay as rows with ``error``.

    Publish times without an offset are read in the rule's zone; a date without a year is taken
    in the year of ``now``, by default the moment the query starts, as that zone has it.
    """
    fields = extract_fields(pages)
    manifest = image_manifest(F.col("images"), parse_base(F.col("url")))
    kept = [c for c in fields.columns if not c.endswith("_text")]
    moment = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    return fields.select(
        *kept,
        utf16_length(F.col("content")).alias("text_length"),
        F.size(manifest).cast("long").alias("image_count"),
        parse_publish_time(F.col("publish_time_text"), moment, F.col("zone_text")).alias("publish_time"),
        F.when(~is_blank(F.col("publisher_text")), F.col("publisher_text")).alias("publisher"),
    )


def image_rows(fields: DataFrame) -> DataFrame:
    """One row per kept image of ``extract_fields`` output."""
    manifest = image_manifest(F.col("images"), parse_base(F.col("url")))
    return fields.select("page_id", F.inline(or_empty(manifest, MANIFEST_ARRAY)))


def render(
    title: Column,
    publisher: Column,
    publish_time: Column,
    category: Column,
    content: Column,
    now: Column,
    zone: str = "UTC",
) -> Column:
    """The sentence a reader hears."""
    body = cut_text(
        default_text(content, fixed.NO_CONTENT), fixed.BODY_LIMIT, fixed.BODY_ELLIPSIS
    )
    when = F.coalesce(friendly_time(publish_time, now, zone), F.lit(fixed.NO_TIME))
    return F.concat(
        default_text(title, fixed.NO_TITLE),
        F.lit("。作者："),
        default_text(publisher, fixed.NO_AUTHOR),
        F.lit("。发布于"),
        when,
        F.lit("。分类："),
        flags_to_chinese(category),
        F.lit("。正文："),
        body,
    )
