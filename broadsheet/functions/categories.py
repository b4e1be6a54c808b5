"""Category flags: names, Chinese names, parsing, raw labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from broadsheet.fixed import (
    CATEGORIES,
    CATEGORY_ALL,
    CATEGORY_BITS,
    CATEGORY_LABELS,
    CATEGORY_NONE,
    ZH_ALL,
    ZH_NONE,
)
from broadsheet.functions.core import let, lookup, ws_trim


def has_flag(category: Column, flag: int | Column) -> Column:
    """True when every bit of ``flag`` is set."""
    return category.bitwiseAND(flag) == flag


def _named(category: Column, separator: str, names: list[str]) -> Column:
    return F.concat_ws(
        separator,
        *[F.when(has_flag(category, 1 << bit), F.lit(n)) for bit, n in enumerate(names)],
    )


def flags_to_text(category: Column) -> Column:
    """Names in bit order joined by ``', '``; a value with unknown bits is its number."""
    unknown = category.bitwiseAND(F.lit(~CATEGORY_ALL)) != 0
    return (
        F.when(category == CATEGORY_NONE, F.lit("None"))
        .when(category == CATEGORY_ALL, F.lit("All"))
        .when(unknown, category.cast("string"))
        .otherwise(_named(category, ", ", [name for name, _ in CATEGORIES]))
    )


def text_to_flags(text: Column) -> Column:
    """Flags from names in any case or from a number; anything else is 0."""
    known = {name.lower(): bit for name, bit in CATEGORY_BITS.items()}
    known |= {"none": CATEGORY_NONE, "all": CATEGORY_ALL}

    def parse(t: Column) -> Column:
        bits = F.transform(F.split(F.lower(t), ","), lambda name: lookup(known, ws_trim(name)))
        # A null (unknown name) makes the whole sum null.
        combined = F.aggregate(bits, F.lit(0), lambda acc, bit: acc.bitwiseOR(bit))
        return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int")).otherwise(combined)

    return F.coalesce(let(ws_trim(text), parse), F.lit(CATEGORY_NONE))


def flags_to_chinese(category: Column) -> Column:
    """Chinese names in bit order joined by ``、``."""
    joined = _named(category, "、", [zh for _, zh in CATEGORIES])
    return (
        F.when(category == CATEGORY_NONE, F.lit(ZH_NONE))
        .when(category == CATEGORY_ALL, F.lit(ZH_ALL))
        .otherwise(F.coalesce(F.nullif(joined, F.lit("")), F.lit(ZH_NONE)))
    )


def label_to_flag(label: Column) -> Column:
    """Flag of a raw corpus label in any case, null when the label is unknown."""
    return lookup({raw: CATEGORY_BITS[name] for raw, name in CATEGORY_LABELS}, F.lower(label))
