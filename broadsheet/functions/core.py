"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.fixed import NON_WS, WS_CHARS, WS_UNEVEN


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it any number of times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apply_sql(value: Column, body: str) -> Column:
    """A SQL lambda of one parameter applied to a column.

    A long expression that is put together from columns costs a call to the JVM for every piece of
    it, each time it is used; as text it is parsed in one.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(body)), F.lit(0))


def sql_let(value: str, name: str, body: str) -> str:
    """``let`` in SQL text: ``body`` uses the value by name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def sql_apply(value: str, body: str) -> str:
    """A SQL lambda of one parameter applied to SQL text."""
    return f"get(transform(array({value}), {body}), 0)"


def sql_collapse_ws(text: str) -> str:
    return f"trim(regexp_replace({text}, {sql_literal(WS_UNEVEN)}, ' '))"


def sql_ws_trim(text: str) -> str:
    return f"btrim({text}, {sql_literal(WS_CHARS)})"


def sql_is_blank(text: str) -> str:
    return f"NOT coalesce({text} RLIKE {sql_literal(NON_WS)}, false)"


def or_empty(items: Column, kind: str) -> Column:
    """The array, or an empty one.

    Exploding an expression rather than a bare column also keeps the optimizer from adding a
    non-empty filter below, which would compute the whole array a second time.
    """
    return F.coalesce(items, F.array().cast(kind))


def keep_rows(rows: DataFrame, condition: Column) -> DataFrame:
    """``filter`` that stays above the columns it looks at.

    A plain filter on a computed column is pushed below it and computes it a second time. For
    columns as costly as an article's text the rows go through a generator instead.
    """
    whole = F.struct(*[F.col(f"`{name}`") for name in rows.columns])
    return rows.select(F.inline(F.when(condition, F.array(whole))))


def ws_trim(text: Column) -> Column:
    """Trim every kind of white space, not just the ASCII blank."""
    return F.btrim(text, F.lit(WS_CHARS))


def single_blanks(text: Column) -> Column:
    """White-space runs become one blank. Lone blanks, the usual case, are not rewritten."""
    return F.regexp_replace(text, WS_UNEVEN, " ")


def collapse_ws(text: Column) -> Column:
    """White-space runs become one blank; ends are trimmed."""
    return F.trim(single_blanks(text))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(text.rlike(NON_WS), F.lit(False))


def sql_literal(value: str | int) -> str:
    """A Python value as a SQL literal."""
    if isinstance(value, int):
        return str(value)
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_map(entries: Mapping[str, str | int]) -> str:
    """A constant map as SQL text."""
    return f"map({', '.join(sql_literal(x) for pair in entries.items() for x in pair)})"


def literal_map(entries: Mapping[str, str | int]) -> Column:
    """A constant map column, built in one step however many entries it has."""
    return F.expr(sql_map(entries))


def literal_array(values: Iterable[str]) -> Column:
    """A constant ARRAY<STRING> column."""
    parts = ", ".join(sql_literal(v) for v in values)
    return F.expr(f"cast(array({parts}) AS array<string>)")


def lookup(entries: Mapping[str, str | int], key: Column) -> Column:
    """Value of ``key`` in a constant map, null when absent."""
    return F.try_element_at(literal_map(entries), key)
