"""HTML read with regular expressions over a pinned grammar.

This is not a DOM. Comments, scripts and styles go first; one pass then cuts the page into events, a
tag and the text behind it each. Links, images, texts and bodies are read off that array. Every
pattern is linear in the page, so a page full of unclosed tags stays cheap.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, functions as F

from broadsheet.fixed import BARE_NAMES, CONTROL_REFERENCES, ENTITIES, NAMES_JSON, WS_UNEVEN
from broadsheet.functions.core import apply_sql, sql_apply, sql_collapse_ws, sql_let, sql_literal
from broadsheet.functions.core import sql_map, sql_ws_trim

# Elements whose content is no part of the page as it is shown.
INERT_TAGS = ("script", "style", "noscript", "template", "textarea", "title")
INVISIBLE = (
    r"(?s)<(?:!--.*?(?:-->|\z)|"
    + "|".join(
        rf"(?i:{tag})[\s/>].*?(?:</(?i:{tag})(?=[\s/>])[^>]*(?:>|\z)|\z)" for tag in INERT_TAGS
    )
    + ")"
)
# A tag ends at a '>' outside quotes; where quotes do not match, at the first one. A tag that is
# never closed runs to the end of the text.
TAG = (
    r"""<[/!?]?[a-zA-Z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
    r"""|<[/!?]?[a-zA-Z][^>]*+(?:>|\z)"""
)
TEXT = r"[^<]*+(?:<(?![/!?]?[a-zA-Z])[^<]*+)*+"
BLOCK_TAGS = (
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer blockquote pre"
    " figure figcaption hr dl dt dd nav aside main form"
).split()
# Stands for a block boundary until the white space of the source is settled.
_EDGE = "\x01"
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def strip_invisible(html: Column) -> Column:
    """Drop comments and inert elements; an unclosed one runs to the end of the page."""
    return F.regexp_replace(html, INVISIBLE, "")


def _sql_char(name: str) -> str:
    """The character of a numeric reference without its semicolon."""
    digits = f"regexp_extract({name}, '^#[xX]?0*([0-9a-fA-F]*)$', 1)"
    short = f"CASE WHEN length({digits}) <= 8 THEN {digits} END"
    code = f"CASE WHEN {name} RLIKE '^#[xX]' THEN conv({short}, 16, 10) ELSE {short} END"
    legal = "(_number BETWEEN 1 AND 55295 OR _number BETWEEN 57344 AND 1114111)"
    plain = f"decode(unhex(lpad(hex(CASE WHEN {legal} THEN _number ELSE 65533 END), 8, '0')), 'UTF-32')"
    control = f"try_element_at({sql_map(CONTROL_REFERENCES)}, cast(_number AS string))"
    return sql_let(f"try_cast({code} AS long)", "_number", f"coalesce({control}, {plain})")


@cache
def _sql_decode(bare_names: bool) -> str:
    bare = BARE_NAMES if bare_names else "(?!)"
    reference = f"^(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[a-zA-Z][a-zA-Z0-9]*;|{bare})"
    # The full list is one constant, parsed once, instead of some 4,000 literals in every plan.
    every = f"from_json({sql_literal(NAMES_JSON)}, 'map<string,string>')"
    known = f"coalesce(try_element_at({sql_map(ENTITIES)}, _name), try_element_at({every}, _name))"
    char = f"CASE WHEN startswith(_written, '#') THEN {_sql_char('_name')} WHEN _written <> '' THEN {known} END"
    resolved = f"coalesce(concat({char}, substr(_part, length(_written) + 1)), concat('&', _part))"
    named = sql_let("trim(TRAILING ';' FROM _written)", "_name", resolved)
    piece = sql_let(f"regexp_extract(_part, {sql_literal(reference)}, 1)", "_written", named)
    rest = f"transform(slice(_parts, 2, size(_parts)), _part -> {piece})"
    decoded = sql_let("split(_whole, '&')", "_parts", f"concat(get(_parts, 0), array_join({rest}, ''))")
    return f"_whole -> CASE WHEN contains(_whole, '&') THEN {decoded} ELSE _whole END"


def decode_entities(text: Column, bare_names: bool = True) -> Column:
    """Resolve character references in one pass, so decoded text is never decoded again.

    All names of the HTML standard, and numbers of any length. Old names may lack their
    semicolon in text; in an attribute, where a query string would suffer, pass
    ``bare_names=False``.
    """
    return apply_sql(text, _sql_decode(bare_names))


@cache
def _sql_tag_events() -> str:
    piece, lead = sql_literal(f"({TAG})({TEXT})"), sql_literal(f"^{TEXT}")
    name = "lower(regexp_extract(_tag, '^<([/!?]?[a-zA-Z][^ \t\n\x0b\f\r/>]*)', 1))"
    event = f"named_struct('name', {name}, 'tag', _tag, 'text', _text)"
    first = f"named_struct('name', '', 'tag', '', 'text', regexp_extract(_page, {lead}, 0))"
    found = ", ".join(f"regexp_extract_all(_page, {piece}, {group})" for group in (1, 2))
    return f"_page -> concat(array({first}), zip_with({found}, (_tag, _text) -> {event}))"


def tag_events(html: Column) -> Column:
    """ARRAY<STRUCT<name, tag, text>> of a page: every tag as written, and what stands behind it.

    ``name`` is in lower case, with a leading slash for a closing tag. The first event has no tag
    and holds what stands before the first one. What is not shown is left out. Bind the result as
    a column and read everything off it.
    """
    return apply_sql(strip_invisible(html), _sql_tag_events())


def _sql_plain_text(events: str) -> str:
    return sql_apply(f"array_join(transform({events}, _e -> _e.text), '')", _sql_decode(True))


def _sql_text(events: str) -> str:
    return sql_collapse_ws(_sql_plain_text(events))


def plain_text(events: Column) -> Column:
    """Text of some events as written, references decoded."""
    return apply_sql(events, f"_events -> {_sql_plain_text('_events')}")


def text_content(events: Column) -> Column:
    """Text of some events on one line: references decoded, blanks collapsed."""
    return apply_sql(events, f"_events -> {_sql_text('_events')}")


@cache
def _sql_visible_text() -> str:
    block = sql_literal(f"^/?(?:{'|'.join(BLOCK_TAGS)})$")
    marked = f"concat(CASE WHEN _e.name RLIKE {block} THEN '{_EDGE}' ELSE '' END, _e.text)"
    blanks = f"regexp_replace(array_join(transform(_events, _e -> {marked}), ''), {sql_literal(WS_UNEVEN)}, ' ')"
    lined = f"regexp_replace({blanks}, ' ?{_EDGE}[ {_EDGE}]*+', '\n')"
    return f"_events -> {sql_ws_trim(sql_apply(lined, _sql_decode(True)))}"


def visible_text(events: Column) -> Column:
    """Text of some events as a reader sees it: block elements start new lines."""
    return apply_sql(events, _sql_visible_text())


def _sql_raw_attribute(tag: str, name: str) -> str:
    """Value of an attribute as written; '' when absent or the tag is never closed."""
    pattern = rf"""(?is)[\s/"']{name}\s*=\s*{_VALUE}"""
    raw = f"regexp_extract({tag}, {sql_literal(pattern)}, 1)"
    quotes = sql_literal(r"""(?s)^"(.*)"$|^'(.*)'$""")
    return f"CASE WHEN endswith({tag}, '>') THEN regexp_replace({raw}, {quotes}, '$1$2') ELSE '' END"


def _sql_attribute(tag: str, name: str) -> str:
    """Value of an attribute, references decoded and trimmed; '' when absent."""
    return sql_ws_trim(sql_apply(_sql_raw_attribute(tag, name), _sql_decode(False)))


def _sql_places(events: str, condition: str) -> str:
    """ARRAY<STRUCT<nth, name, tag>> of the events ``_e`` that satisfy a condition."""
    place = "named_struct('nth', _i, 'name', _e.name, 'tag', _e.tag)"
    return f"filter(transform({events}, (_e, _i) -> CASE WHEN {condition} THEN {place} END), _p -> _p IS NOT NULL)"


def _sql_up_to_next(events: str, name: str, result: str) -> str:
    """``result`` of each element of a kind that does not nest, from its ``_p.tag`` and ``_inside``.

    An element ends at the next tag of its kind, opening or closing, or at the end. The elements
    do not overlap, so all of them together cost one pass.
    """
    end = f"coalesce(get(_places, _k + 1).nth, size({events}))"
    inside = f"slice({events}, _p.nth + 1, {end} - _p.nth)"
    one = f"CASE WHEN _p.name = '{name}' THEN {sql_let(inside, '_inside', result)} END"
    found = f"filter(transform(_places, (_p, _k) -> {one}), _item -> _item IS NOT NULL)"
    return sql_let(_sql_places(events, f"_e.name IN ('{name}', '/{name}')"), "_places", found)


@cache
def _sql_anchors() -> str:
    link = f"named_struct('title', {_sql_text('_inside')}, 'href', {_sql_attribute('_p.tag', 'href')})"
    found = _sql_up_to_next("_events", "a", link)
    return f"_events -> filter({found}, _a -> _a.title <> '' AND _a.href <> '')"


def anchors(events: Column) -> Column:
    """ARRAY<STRUCT<title, href>> of the ``a[href]`` elements, in document order."""
    return apply_sql(events, _sql_anchors())


def texts_of(events: Column, name: str) -> Column:
    """ARRAY<STRING> of the one-line texts of all elements of a kind, in document order."""
    return apply_sql(events, f"_events -> {_sql_up_to_next('_events', name, _sql_text('_inside'))}")


def _sql_inside(events: str, nth: str, name: str) -> str:
    """The event at a place and those behind it, up to the tag that closes it."""
    change = f"CASE _e.name WHEN concat('/', {name}) THEN -1 WHEN {name} THEN 1 ELSE 0 END"
    deeper = f"named_struct('depth', _s.depth + {change}, 'kept', _s.kept + CASE WHEN _s.depth + {change} = 0 THEN 0 ELSE 1 END)"
    step = f"(_s, _e) -> CASE WHEN _s.depth = 0 THEN _s ELSE {deeper} END"
    start = "named_struct('depth', 1, 'kept', 1)"
    kept = f"aggregate(slice({events}, {nth} + 2, size({events})), {start}, {step}, _s -> _s.kept)"
    return f"slice({events}, {nth} + 1, {kept})"


def nth_text(events: Column, name: str, n: int) -> Column:
    """One-line text of the nth element of a kind, nested ones of its kind included; null if
    there are fewer."""
    whole = _sql_text(_sql_inside("_events", "_nth", f"'{name}'"))
    place = f"get({_sql_places('_events', f"_e.name = '{name}'")}, {n}).nth"
    return apply_sql(events, "_events -> " + sql_let(place, "_nth", f"CASE WHEN _nth IS NOT NULL THEN {whole} END"))


def element(events: Column, open_pattern: Column, name: Column) -> Column:
    """Events of the first element whose opening tag matches; null when there is none.

    The first event is the opening tag itself; the end is the closing tag at the same depth.
    """
    place = f"get({_sql_places('_in.events', '_e.name = _in.name AND rlike(_e.tag, _in.pattern)')}, 0).nth"
    inside = f"CASE WHEN _nth IS NOT NULL THEN {_sql_inside('_in.events', '_nth', '_in.name')} END"
    given = F.struct(events.alias("events"), open_pattern.alias("pattern"), name.alias("name"))
    return apply_sql(given, "_in -> " + sql_let(place, "_nth", inside))


def base_href(events: Column) -> Column:
    """Target of the first ``base`` element with one; null without."""
    targets = f"transform(filter(_events, _e -> _e.name = 'base'), _e -> {_sql_attribute('_e.tag', 'href')})"
    return apply_sql(events, f"_events -> get(filter({targets}, _t -> _t <> ''), 0)")


def image_sources(events: Column) -> Column:
    """Distinct image addresses, first occurrence first.

    Per image the first non-empty of src, data-src, data-original, data-actualsrc.
    """
    names = ["src", "data-src", "data-original", "data-actualsrc"]
    given = ", ".join(f"nullif({_sql_raw_attribute('_e.tag', n)}, '')" for n in names)
    sources = f"transform(filter(_events, _e -> _e.name = 'img'), _e -> {sql_apply(f'coalesce({given})', _sql_decode(False))})"
    return apply_sql(events, f"_events -> array_distinct(filter({sources}, _s -> _s IS NOT NULL))")


def open_tag(tag: str, css_class: str | None = None) -> str:
    """Pattern of an opening tag, optionally carrying one class."""
    if css_class is None:
        return rf"(?i)<{tag}(?=[\s/>])[^<>]*>"
    return (
        rf"(?i)<{tag}\s(?:[^<>]*[\s\"'])?class\s*=\s*[\"']?(?:[^\"'<>]*\s)?"
        rf"{css_class}(?=[\s\"'>/])[^<>]*>"
    )
