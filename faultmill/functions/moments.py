"""Instants: ISO text to UTC timestamps, and ages against a given instant."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let

# calendar or ISO week date, any one separator character, time, fraction, offset; each piece
# is either all extended (with separators) or all basic
_DATE = (r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})"
         r"|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)")
_TIME = r"(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{2}(?:\d{2}(?:[.,]\d+)?)?)?)"
_ZONE = r"(Z|[+-]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?|\d{2}(?:\d{2}(?:\.\d+)?)?)?)?"
_SHAPE = f"(?s)^{_DATE}(?:.{_TIME}{_ZONE})?$"


_GROUPS = 11
_CUT = "\u0001"


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def _day(part: Callable[[int], Column]) -> Column:
    """Calendar date, or the day of an ISO week."""
    def joined(*groups: int) -> Column:
        return F.concat_ws("-", *[part(g) for g in groups]).try_cast("date")

    week = F.coalesce(_number(part(6)), _number(part(8)))
    weekday = F.coalesce(_number(part(7)), _number(part(9)), F.lit(1))
    # January 4th always lies in week 1
    week_one = F.trunc(F.concat(part(1), F.lit("-01-04")).try_cast("date"), "week")
    by_week = F.date_add(week_one, (week - 1) * 7 + weekday - 1)
    return (
        F.when(week.isNotNull(), F.when(
            (F.weekofyear(by_week) == week) & weekday.between(1, 7), by_week))
        .when(part(2) != "", joined(1, 2, 3)).otherwise(joined(1, 4, 5))
    )


def _moment(part: Callable[[int], Column]) -> Column:
    def two(text: Column, start: int) -> Column:
        return F.coalesce(_number(F.substring(text, start, 2)), F.lit(0))

    time = F.replace(part(10), F.lit(":"), F.lit(""))
    zone = F.replace(part(11), F.lit(":"), F.lit(""))
    micros = F.rpad(F.substring(F.regexp_extract(time, r"[.,](\d+)$", 1), 1, 6), 6, "0")
    clock = F.struct(
        two(time, 1).alias("hour"), two(time, 3).alias("minute"), two(time, 5).alias("second"),
        micros.cast("long").alias("micros"),
        (F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
         * F.when(zone.isin("", "Z"), 0).otherwise(
             two(zone, 2) * 3600 + two(zone, 4) * 60 + two(zone, 6))).alias("shift"),
        F.unix_date(_day(part)).cast("long").alias("day"), _number(part(1)).alias("year"))

    def instant(c: Column) -> Column:
        seconds = c["hour"] * 3600 + c["minute"] * 60 + c["second"] - c["shift"]
        valid = ((c["hour"] < 24) & (c["minute"] < 60) & (c["second"] < 60)
                 & (F.abs(c["shift"]) < 86_400) & (c["year"] >= 1))
        return F.when(valid, F.timestamp_micros(
            c["day"] * F.lit(86_400_000_000) + seconds.cast("long") * 1_000_000 + c["micros"]))

    return let(clock, instant)


def _cut(text: Column) -> Column:
    groups = _CUT.join(f"${g}" for g in range(1, _GROUPS + 1))
    return F.when(F.rlike(text, F.lit(_SHAPE)), F.split(
        F.regexp_replace(text, F.lit(_SHAPE), F.lit(groups)), _CUT, -1))


def parse_all(*texts: Column) -> Column:
    """ISO 8601 texts to an array of instants; null where a text is not one.

    With an offset it is shifted to UTC, without one it is taken as UTC (session zone UTC).
    """
    def read(text: Column) -> Column:
        return let(_cut(text), lambda parts: F.when(
            parts.isNotNull(), _moment(lambda group: parts[group - 1])))

    return F.transform(F.array(*texts), read)


def parse_iso(text: Column) -> Column:
    return F.element_at(parse_all(text), 1)


def age_bucket(moment: Column, as_of: Column) -> Column:
    """``just now``, minutes, hours or days before ``as_of``; the future counts as now."""
    seconds = F.greatest(
        F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(moment)) / F.lit(1_000_000.0))

    def units(size: int, unit: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, units(60, "m"))
        .when(seconds < 86400, units(3600, "h"))
        .when(seconds.isNotNull(), units(86400, "d"))
    )
