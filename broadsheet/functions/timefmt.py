"""Publish times: parsing, storage text, friendly display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from broadsheet.fixed import DAY_BEFORE, TODAY, WEEKDAYS, YESTERDAY
from broadsheet.functions.core import let, literal_array, ws_trim

# year, month, day with any of the usual separators; optional clock time; optional offset
_TIME = (
    r"^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?"
    r"(?:[T\s]+([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,7})?)?)\s*"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)


# 12-hour clocks: the mark may stand before or after the clock time.
_HALF = r"(?i)(上午|下午|[AP]M)"
_AFTERNOON = ["下午", "PM"]
_MONTH_FIRST = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
_NO_YEAR = r"^([0-9]{1,2})[-/月]([0-9]{1,2})日?(?=\s|$)"


def parse_publish_time(
    text: Column, now: Column | None = None, zone: str | Column | None = None
) -> Column:
    """Timestamp of a page's time line; null when it is none.

    Year first, or month first before a year (``01/05/2024``), on a 24-hour clock or with a
    morning or afternoon mark. A date without a year is taken in the year of ``now`` in that zone,
    and is none without it. Times without an offset are read in ``zone``, by default (or where it
    is null) the session's.
    """
    local = F.current_timezone()
    if zone is not None:
        zone = F.coalesce(F.lit(zone) if isinstance(zone, str) else zone, local)

    def with_year(line: Column) -> Column:
        here = now if zone is None else F.from_utc_timestamp(F.to_utc_timestamp(now, local), zone)
        dated = F.concat(F.year(here).cast("string"), F.lit("-"), F.regexp_replace(line, _NO_YEAR, "$1-$2"))
        return F.when(line.rlike(_NO_YEAR), dated).otherwise(line)

    def without_half(line: Column) -> Column:
        half = F.upper(F.regexp_extract(line, _HALF, 1))
        clock = ws_trim(F.regexp_replace(F.regexp_replace(line, _HALF, " "), r"\s+", " "))
        return F.struct(half.alias("half"), F.when(half == "", line).otherwise(clock).alias("plain"))

    def shifted(p: Column, found: Column) -> Column:
        hour = F.hour(found)
        shift = F.when(p["half"].isin(_AFTERNOON) & (hour < 12), 12).when(
            (p["half"] != "") & ~p["half"].isin(_AFTERNOON) & (hour == 12), -12
        )
        return F.when((p["half"] == "") | (hour > 12), found).otherwise(
            found + F.make_dt_interval(F.lit(0), F.coalesce(shift, F.lit(0)))
        )

    def placed(p: Column, found: Column) -> Column:
        if zone is None:
            return found
        has_offset = p["plain"].rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & p["plain"].rlike(":")
        return F.when(has_offset, found).otherwise(F.from_utc_timestamp(F.to_utc_timestamp(found, zone), local))

    def read(p: Column) -> Column:
        moved = let(_parse_clean(p["plain"]), lambda found: shifted(p, found))
        return let(moved, lambda found: placed(p, found))

    line = F.regexp_replace(ws_trim(text), _MONTH_FIRST, "$3-$1-$2")
    return let(let(line if now is None else let(line, with_year), without_half), read)


def _parse_clean(clean: Column) -> Column:
    canonical = F.trim(F.regexp_replace(clean, _TIME, "$1-$2-$3 $4$5"))
    # An offset may only follow full clock times.
    to_seconds = F.regexp_replace(canonical, r"^(\S+ [0-9]+:[0-9]{2})(Z|[+-]|$)", "$1:00$2")
    return F.when(clean.rlike(_TIME), to_seconds.try_cast("timestamp"))


def utc_iso(ts: Column) -> Column:
    """UTC ISO-8601 text with seven fractional digits, ordered like the instants."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS"), F.lit("+00:00"))


def from_utc_iso(text: Column) -> Column:
    """Timestamp of stored text; empty or unreadable text is null."""
    return F.nullif(text, F.lit("")).try_cast("timestamp")


def friendly_time(ts: Column, now: Column, zone: str) -> Column:
    """Local display time relative to ``now``.

    Today, yesterday and the day before by name; up to seven days back (and any future day) by
    weekday; then month and day within the year, else the full date.
    """

    def local(value: Column) -> Column:
        return F.convert_timezone(None, F.lit(zone), value)

    def show(pair: Column) -> Column:
        when, current = pair["ts"], pair["now"]
        age = F.datediff(current.cast("date"), when.cast("date"))
        clock = F.date_format(when, "HH:mm")
        weekday = F.get(literal_array(WEEKDAYS), F.dayofweek(when) - 1)
        return (
            F.when(age == 0, F.concat(F.lit(TODAY + " "), clock))
            .when(age == 1, F.concat(F.lit(YESTERDAY + " "), clock))
            .when(age == 2, F.concat(F.lit(DAY_BEFORE + " "), clock))
            .when(age <= 7, F.concat(weekday, F.lit(" "), clock))
            .when(F.year(when) == F.year(current), F.date_format(when, "MM-dd HH:mm"))
            .otherwise(F.date_format(when, "yyyy-MM-dd HH:mm"))
        )

    pair = F.struct(local(ts).alias("ts"), local(now).alias("now"))
    return F.when(ts.isNotNull(), let(pair, show))
