"""Date and time functions as column expressions; ``phrases`` parses what people say about times."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

def date_anchors(c: Column) -> Column:
    """Distinct phrases of a preposition and a date, in lower case and in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\b((?:on|since|from)\s+\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " ")))


def to_utc(day: datetime, zone: str) -> datetime:
    """A wall clock time of a zone as naive UTC."""
    return day.replace(tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def parse_due(c: Column, zone: str) -> Column:
    """A day of the zone, or an instant with its own zone, as a timestamp; anything else is null."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_utc_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), zone))
    instant = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(c))
    return F.coalesce(day, instant)


def due_state(due: Column, now: Column) -> Column:
    """unknown without a due time, overdue before today, due today, else fresh."""
    return F.when(due.isNull(), "unknown").when(due < F.date_trunc("day", now), "overdue").when(due < F.date_trunc("day", now) + F.expr("INTERVAL 1 DAY"), "due").otherwise("fresh")


def occurrences(first: Column, repeat: Column, count: int) -> Column:
    """The first ``count`` dates of a repetition: daily, weekly, monthly (clamped to the month's end), weekdays; null for others."""
    k = F.sequence(F.lit(0), F.lit(count - 1))
    work = F.filter(F.transform(F.sequence(F.lit(0), F.lit(count * 2 + 4)), lambda i: F.date_add(first, i)), lambda d: F.weekday(d) < 5)
    return (
        F.when(repeat == "daily", F.transform(k, lambda i: F.date_add(first, i))).when(repeat == "weekly", F.transform(k, lambda i: F.date_add(first, i * 7)))
        .when(repeat == "monthly", F.transform(k, lambda i: F.add_months(first, i))).when(repeat == "weekdays", F.slice(work, 1, count))
    )


def week_key(t: Column) -> Column:
    """ISO year and week, YYYY-Www."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), t).cast("int"), F.weekofyear(t))


def duration_minutes(c: Column) -> Column:
    """Minutes, hours or days as minutes from 1 to 43200; null for anything else."""
    n, unit = F.regexp_extract(F.lower(F.trim(c)), r"^(\d{1,5})\s*(minutes?|min|m|hours?|h|days?|d)$", 1), F.regexp_extract(F.lower(F.trim(c)), r"^(\d{1,5})\s*(minutes?|min|m|hours?|h|days?|d)$", 2)
    per = F.when(F.startswith(unit, F.lit("m")), 1).when(F.startswith(unit, F.lit("h")), 60).when(F.startswith(unit, F.lit("d")), 1440)
    v = n.try_cast("bigint") * per
    return F.when((v >= 1) & (v <= 43200), v)


def recency(score: Column, t: Column, now: Column) -> Column:
    """score raised by up to 15 %, falling over 90 whole UTC days."""
    return score * (1 + 0.15 * F.exp(-F.greatest(F.lit(0), F.datediff(now, t)) / 90))


def iso(c: str) -> Column:
    """A literal timestamp in UTC."""
    return F.lit(c).cast("timestamp")
