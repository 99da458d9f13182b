"""Rules about times; every rule takes the present as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = {"m": 1 / 1440, "h": 1 / 24, "d": 1, "w": 7, "mo": 30, "y": 365}


def _ago(text: Column, now: Column, patterns: list[tuple[str, int]], none: Column) -> Column:
    """now less the first pattern's number of units (in seconds)."""
    out = none
    for pattern, seconds in reversed(patterns):
        n = F.regexp_extract(text, pattern, 1)
        out = F.when(n != "", F.timestamp_seconds(F.unix_timestamp(now) - n.cast("bigint") * seconds)).otherwise(out)
    return out


def linkedin_time(text: Column, now: Column) -> Column:
    """Minutes are tried first, so "2mo" counts as two minutes."""
    units = [("m(?:in)?", 60), ("h(?:r|our)?", 3600), ("d(?:ay)?", 86400), ("w(?:eek)?", 604800), ("mo(?:nth)?", 30 * 86400), ("y(?:ear)?", 365 * 86400)]
    return _ago(F.lower(F.trim(text)), now, [(rf"(\d+)\s*{u}", s) for u, s in units], now)


def instagram_time(text: Column, now: Column) -> Column:
    units = [("min", 60), ("hour", 3600), ("day", 86400), ("week", 604800), ("month", 30 * 86400), ("year", 365 * 86400)]
    return _ago(F.lower(F.trim(text)), now, [(rf"(\d+)\s*{u}", s) for u, s in units], F.lit(None).cast("timestamp"))


def within_active_hours(now: Column, start: int, end: int, weekdays_only: bool) -> Column:
    hour = F.hour(now)
    inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
    return inside & (F.weekday(now) < 5) if weekdays_only else inside


def week_start(now: Column) -> Column:
    return F.date_trunc("week", now)


def topic_days(now: Column) -> Column:
    """Days that topics look back: three on a Monday, else one."""
    return F.when(F.weekday(now) == 0, 3).otherwise(1)


def pdf_date(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 3, 14), F.lit("yyyyMMddHHmmss"))
