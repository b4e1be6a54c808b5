"""URL columns: resolution against a page, filters, data-URLs and file extensions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, functions as F

from broadsheet.fixed import (
    COMMENT_FRAGMENT,
    COMMENT_TITLE,
    DEFAULT_EXTENSION,
    FEED_SUFFIX,
    MAX_EXTENSION_LENGTH,
    MIME_EXTENSIONS,
    VIDEO_PATH,
)
from broadsheet.functions.core import apply_sql, sql_apply, sql_is_blank, sql_let, sql_literal, sql_map

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# Characters that are percent-encoded in each part of an http URL.
_PATH_UNSAFE = r"""[^\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E]"""
_QUERY_UNSAFE = r"""[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E]"""
_FRAGMENT_UNSAFE = r"""[^\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7E]"""
_HOST = r"""^(?:\[[0-9a-f:.]+\]|[^\x00-\x20"#%/:<>?@\[\\\]^`{|}]+)(?::[0-9]{1,5})?$"""
# The two commonest kinds of link need no parsing: URLs that are normalised already, and rooted
# paths. Neither may hold a dot segment.
_NO_DOTS = r"(?![^?#]*/(?:\.|%2[eE]))"
_ABSOLUTE_PLAIN = rf"^https?://[a-z0-9.\-]+(?=/){_NO_DOTS}[A-Za-z0-9/?#!$&()*+,\-.:;=@_~%]*$"
_ROOTED_PLAIN = rf"^/(?!/){_NO_DOTS}[^?#\\]*$"


# A bucket is named by the first hex digits of a URL's hash, one to this many of them.
BUCKET_DIGITS = 3


def _url_hash(url: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(url))), 16, "0")


def url_bucket(url: Column, digits: int) -> Column:
    """Bucket of a URL: a prefix of its 64-bit hash. URLs compare with case."""
    if not 1 <= digits <= BUCKET_DIGITS:
        raise ValueError(f"a bucket has 1 to {BUCKET_DIGITS} digits")
    return F.substring(_url_hash(url), 1, digits)


def url_buckets(url: Column) -> Column:
    """All buckets that may hold a URL, whatever number of digits they are named by."""
    return F.array(*[F.substring(_url_hash(url), 1, n) for n in range(1, BUCKET_DIGITS + 1)])


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user and port."""
    return F.lower(
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    )


def _sql_origin(scheme: str, authority: str) -> str:
    """``scheme://user@host:port`` normalised; null when it is no valid http(s) origin."""
    standard = f"CASE WHEN {scheme} = 'http' THEN ':80' ELSE ':443' END"
    bare = (
        f"CASE WHEN endswith(_host, {standard}) THEN regexp_replace(_host, ':[0-9]+$', '') "
        "ELSE regexp_replace(_host, ':$', '') END"
    )
    user = f"regexp_extract({authority}, '^(.*@)', 1)"
    whole = f"CASE WHEN _bare RLIKE {sql_literal(_HOST)} THEN concat({scheme}, '://', {user}, _bare) END"
    host = sql_let(f"lower(regexp_replace({authority}, '^.*@', ''))", "_host", sql_let(bare, "_bare", whole))
    return f"CASE WHEN {scheme} IN ('http', 'https') THEN {host} END"


@cache
def _sql_parse_base() -> str:
    def part(pattern: str) -> str:
        return f"regexp_extract(_url, {sql_literal(pattern)}, 1)"

    start = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
    origin = sql_let(part(start + "([^/?#]*)"), "_authority", _sql_origin("_scheme", "_authority"))
    whole = (
        f"named_struct('scheme', _scheme, 'origin', {origin}, 'path', {part(start + '[^/?#]*([^?#]*)')}, "
        f"'query', {part('^[^?#]*([?][^#]*)')})"
    )
    return "_url -> " + sql_let(f"lower({part(SCHEME)})", "_scheme", whole)


def parse_base(url: Column) -> Column:
    """STRUCT of the parts of a page's own URL that relative links need."""
    return apply_sql(url, _sql_parse_base())


def _sql_percent(text: str, unsafe: str) -> str:
    """Percent-encode the UTF-8 bytes of every character in the ``unsafe`` class."""
    encoded = "regexp_replace(hex(encode(_ch, 'UTF-8')), '(..)', '%$1')"
    each = f"_ch -> CASE WHEN _ch RLIKE {sql_literal(unsafe)} THEN {encoded} ELSE _ch END"
    whole = f"array_join(transform(split(_text, ''), {each}), '')"
    return sql_let(text, "_text", f"CASE WHEN _text RLIKE {sql_literal(unsafe)} THEN {whole} ELSE _text END")


def _sql_without_dots(path: str) -> str:
    """Resolve ``.`` and ``..`` in a path that starts with a slash."""
    up, here = sql_literal(r"^(?:\.|%2[eE]){2}$"), sql_literal(r"^(?:\.|%2[eE])$")
    step = (
        f"CASE WHEN _segment RLIKE {up} THEN regexp_replace(_done, '/[^/]*$', '') "
        f"WHEN _segment RLIKE {here} THEN _done ELSE concat(_done, '/', _segment) END"
    )
    walked = f"aggregate(split(regexp_replace(_path, '^/', ''), '/'), '', (_done, _segment) -> {step})"
    # A path that ends in a dot segment names a directory.
    ends = rf"CASE WHEN _path RLIKE {sql_literal(r'/(?:\.|%2[eE]){1,2}$')} THEN '/' ELSE '' END"
    dotted = sql_literal(r"/(?:\.|%2[eE]){1,2}(?:/|$)")
    return sql_let(path, "_path", f"CASE WHEN _path RLIKE {dotted} THEN concat({walked}, {ends}) ELSE _path END")


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` on a page whose parsed URL is ``base``.

    http and https URLs come out normalised (lower-case scheme and host, no default port, dot
    segments resolved, unsafe characters percent-encoded). Other schemes are returned as they
    are. Null when nothing can be resolved. Hosts outside ASCII are not converted.
    """
    return apply_sql(F.struct(href.alias("href"), base.alias("base")), _sql_resolve())


@cache
def _sql_resolve() -> str:
    rooted = f"concat(_in.base.origin, {_sql_percent('_href', _PATH_UNSAFE)})"
    dispatch = (
        f"CASE WHEN _href RLIKE {sql_literal(_ABSOLUTE_PLAIN)} THEN _href "
        f"WHEN _href RLIKE {sql_literal(_ROOTED_PLAIN)} THEN {rooted} ELSE {_sql_resolve_any()} END"
    )
    return "_in -> " + sql_let("translate(_in.href, '\t\n\r', '')", "_href", dispatch)


def _sql_resolve_any() -> str:
    """The general case; each stage binds its pieces so that none is computed twice."""
    base, scheme = "_in.base", sql_literal(SCHEME)

    def piece(pattern: str) -> str:
        return f"regexp_extract(_after, {sql_literal(pattern)}, 1)"

    cut = (
        rf"named_struct('path', translate({piece('^([^?#]*)')}, {sql_literal(chr(92))}, '/'), "
        rf"'query', {piece(r'(?s)^[^?#]*(\?[^#]*)')}, 'fragment', {piece('(?s)(#.*)$')})"
    )
    # An http(s) reference always names its host, however many slashes it has.
    own = "_scheme <> ''"
    names_host = f"({own} OR startswith(_p.path, '//'))"
    path = (
        f"CASE WHEN {names_host} THEN regexp_replace(_p.path, '^/*[^/]*', '') "
        f"WHEN startswith(_p.path, '/') THEN _p.path WHEN _p.path = '' THEN {base}.path "
        f"ELSE concat(regexp_replace({base}.path, '[^/]*$', ''), _p.path) END"
    )
    inherits_query = f"NOT ({own}) AND _p.path = '' AND _p.query = ''"
    placed = (
        f"named_struct('scheme', CASE WHEN {own} THEN _scheme ELSE {base}.scheme END, "
        f"'authority', CASE WHEN {names_host} THEN regexp_extract(_p.path, '^/*([^/]*)', 1) END, "
        f"'path', regexp_replace({path}, '^(?!/)', '/'), "
        f"'query', CASE WHEN {inherits_query} THEN {base}.query ELSE _p.query END, 'fragment', _p.fragment)"
    )
    origin = f"CASE WHEN _u.authority IS NULL THEN {base}.origin ELSE {_sql_origin('_u.scheme', '_u.authority')} END"
    whole = (
        f"concat({origin}, {_sql_percent(_sql_without_dots('_u.path'), _PATH_UNSAFE)}, "
        f"{_sql_percent('_u.query', _QUERY_UNSAFE)}, {_sql_percent('_u.fragment', _FRAGMENT_UNSAFE)})"
    )
    foreign = "_scheme <> '' AND NOT _scheme IN ('http', 'https')"
    web = sql_let(sql_let(f"regexp_replace(_href, {scheme}, '')", "_after", cut), "_p", sql_let(placed, "_u", whole))
    result = f"CASE WHEN {foreign} THEN _href ELSE {web} END"
    return sql_let(f"lower(regexp_extract(_href, {scheme}, 1))", "_scheme", result)


def is_web_url(url: Column) -> Column:
    """http or https, any case."""
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def has_prefix(url: Column, prefixes: Column) -> Column:
    """Starts with one of an array of prefixes; an empty array allows everything."""
    return (F.size(prefixes) == 0) | F.exists(prefixes, lambda p: F.startswith(url, p))


def is_feed_noise(title: Column, url: Column) -> Column:
    """Comment anchors, feed self-links, video pages and 'N comments' titles."""
    fragment = F.lower(F.regexp_extract(url, r"(#.*)$", 1))
    plain = F.regexp_replace(url, "#.*$", "")
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    return (
        (fragment == COMMENT_FRAGMENT)
        | F.endswith(plain, F.lit(FEED_SUFFIX))
        | F.contains(path, F.lit(VIDEO_PATH))
        | title.rlike(COMMENT_TITLE)
    )


def _sql_mime_extension(mime: str) -> str:
    return f"coalesce(try_element_at({sql_map(dict(MIME_EXTENSIONS))}, lower({mime})), '{DEFAULT_EXTENSION}')"


def mime_extension(mime: Column) -> Column:
    """Extension for an image MIME type, ``.img`` when unknown."""
    return apply_sql(mime, f"_mime -> {_sql_mime_extension('_mime')}")


def sql_url_extension() -> str:
    path = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
    ext = rf"regexp_extract(regexp_extract(_url, {sql_literal(path)}, 1), {sql_literal(r'(\.[^./\:]+)$')}, 1)"
    long = f"_ext = '' OR length(_ext) > {MAX_EXTENSION_LENGTH}"
    return "_url -> " + sql_let(ext, "_ext", f"CASE WHEN {long} THEN '{DEFAULT_EXTENSION}' ELSE _ext END")


def url_extension(url: Column) -> Column:
    """Extension of the last path segment; ``.img`` when missing or over-long."""
    return apply_sql(url, sql_url_extension())


@cache
def sql_data_url() -> str:
    payload = "substr(_src, locate(',', _src) + 1)"
    # A '%' that starts no escape is text, and '+' is never a blank here.
    escaped = f"regexp_replace({payload}, '%(?![0-9A-Fa-f]{{2}})', '%25')"
    content = (
        f"CASE WHEN _meta RLIKE '(?i);base64$' THEN try_to_binary({payload}, 'base64') "
        f"ELSE encode(try_url_decode(replace({escaped}, '+', '%2B')), 'UTF-8') END"
    )
    mime = "get(split(coalesce(get(split(_meta, ':'), 1), ''), ';'), 0)"
    result = f"named_struct('bytes', _bytes, 'ext', {_sql_mime_extension(mime)})"
    found = f"CASE WHEN locate(',', _src) > 1 AND _bytes IS NOT NULL THEN {result} END"
    return "_src -> " + sql_let("regexp_extract(_src, '^([^,]*),', 1)", "_meta", sql_let(content, "_bytes", found))


def decode_data_url(src: Column) -> Column:
    """STRUCT<bytes, ext> of a ``data:`` URL; null when it cannot be decoded."""
    return apply_sql(src, sql_data_url())


def sql_image_url(src: str, base: str) -> str:
    """Absolute http(s) address of an image; null when it has none."""
    resolved = sql_apply(f"named_struct('href', {src}, 'base', {base})", _sql_resolve())
    absolute = f"CASE WHEN NOT ({sql_is_blank(src)}) THEN {resolved} END"
    return sql_let(absolute, "_url", "CASE WHEN _url RLIKE '(?i)^https?://' THEN _url END")


def absolute_image_url(src: Column, base: Column) -> Column:
    """Absolute http(s) address of an image; null when it has none."""
    given = F.struct(src.alias("src"), base.alias("base"))
    return apply_sql(given, f"_image -> {sql_image_url('_image.src', '_image.base')}")
