"""Registry, table access and the SQL fragments that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.fixed import WS_CHARS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under ``name``, with its oracle when there is one."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(column: str) -> Column:
    """Event times carry no zone in the files; they are taken as session-local instants."""
    return F.col(column).cast("timestamp")


# White space as the library understands it, for RE2.
WS = (
    r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_CHARS_SQL = f"'{WS_CHARS}'"


def sql_visible(html: str) -> str:
    """Page without comments, scripts and styles."""
    return (
        f"regexp_replace({html}, '(?is)<!--.*?-->|<script[\\s>].*?</script>"
        f"|<style[\\s>].*?</style>', '', 'g')"
    )


def sql_decode(text: str) -> str:
    """The character references that occur in the fixtures; '&amp;' last."""
    for name, char in [
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&copy;", "©"),
        ("&middot;", "·"),
        ("&amp;", "&"),
    ]:
        text = f"replace({text}, '{name}', '{char}')"
    return text


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def sql_strip_tags(html: str) -> str:
    return f"regexp_replace({html}, '<[/!?]?[a-zA-Z][^>]*>', '', 'g')"


def sql_text_content(html: str) -> str:
    return sql_collapse(sql_decode(sql_strip_tags(html)))


def sql_block_text(html: str) -> str:
    """Visible text of a fragment: block tags start lines."""
    blocks = "(?i)</?(p|div|br|li|ul|h1|article|footer|nav)(\\s[^>]*)?>"
    marked = sql_strip_tags(f"regexp_replace({html}, '{blocks}', chr(1), 'g')")
    flat = f"regexp_replace({marked}, '{WS}+', ' ', 'g')"
    lined = f"regexp_replace({flat}, ' ?\\x01[ \\x01]*', chr(10), 'g')"
    return f"trim({sql_decode(lined)}, {WS_CHARS_SQL})"


# page_id, i, title, href of every anchor with text and target; double-quoted hrefs.
SQL_ANCHORS = f"""
anchor_tags AS (
  SELECT page_id, url AS page_url, unnest(found) AS a, generate_subscripts(found, 1) AS i
  FROM (SELECT page_id, url, regexp_extract_all({sql_visible('html')},
               '(?is)<a\\s[^>]*>.*?</a>') AS found FROM pages)
),
anchors AS (
  SELECT page_id, page_url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos,
         title, href
  FROM (SELECT page_id, page_url, i,
               {sql_text_content("regexp_extract(a, '(?is)^<a[^>]*>(.*)</a>$', 1)")} AS title,
               {sql_decode("regexp_extract(a, '(?is)href=.([^>]*?).>', 1)")} AS href
        FROM anchor_tags)
  WHERE title <> '' AND href <> ''
)"""


def sql_percent(text: str, unsafe: str) -> str:
    """Percent-encode the UTF-8 bytes of the characters in a class."""
    return (
        f"array_to_string(list_transform(string_split({text}, ''), lambda ch: CASE WHEN "
        f"regexp_matches(ch, '{unsafe}') THEN regexp_replace(hex(ch), '(..)', '%\\1', 'g') "
        f"ELSE ch END), '')"
    )


# page_id, pos, title, url of the fixture pages' anchors: every href there is a rooted path.
SQL_LINKS = f"""{SQL_ANCHORS},
links AS (
  SELECT page_id, pos, title,
         lower(regexp_extract(page_url, '^(https?://[^/?#]*)', 1)) ||
         {sql_percent("href", "[^!-~]")} AS url
  FROM anchors
)"""
