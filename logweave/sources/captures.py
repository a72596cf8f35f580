"""Captures: the lines of sessions, their listing and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line types that machines write, and spellings of the two speakers.
MACHINE = ("summary", "attachment", "system", "tool_result")
USER, ASSISTANT = ("user", "human"), ("assistant", "ai", "model")


def machine_line() -> Column:
    """True for a line that no speaker wrote."""
    return F.coalesce(F.lower(F.trim("line_type")).isin(*MACHINE), F.lit(False))


def said_by(names: tuple[str, ...]) -> Column:
    """True if the role, or the line's type without a role, is one of the names."""
    return F.coalesce(F.lower(F.trim(F.coalesce("message.role", "line_type"))).isin(*names), F.lit(False))


def real_user() -> Column:
    """A line with content that the person typed."""
    return said_by(USER) & F.col("message").isNotNull() & F.coalesce(F.col("message.content").rlike(r"(?U)[^\s]"), F.lit(False)) & ~machine_line()


def listing(lines: DataFrame, deleted: DataFrame) -> DataFrame:
    """``(path, ts_us)`` of captures whose session is not among deleted ``(session)``."""
    c = lines.groupBy("path").agg(F.unix_micros(F.min("ts")).alias("ts_us")).withColumn("session", F.split_part("path", F.lit("/"), F.lit(2)))
    return c.join(deleted, "session", "left_anti").select("path", "ts_us")


def states(register: DataFrame, seen: DataFrame) -> DataFrame:
    """``(session, state)`` of the union of two lists ``(s)``: present, unreachable or unregistered."""
    a = register.filter("s is not null").distinct().withColumn("a", F.lit(True))
    b = seen.filter("s is not null").distinct().withColumn("b", F.lit(True))
    return a.join(b, "s", "full").select(F.col("s").alias("session"), F.when(F.col("a").isNull(), "unregistered").when(F.col("b").isNull(), "unreachable").otherwise("present").alias("state"))


def import_turns(lines: DataFrame, known: DataFrame) -> DataFrame:
    """User and assistant turns of sessions that are not among known ``(session_id)``."""
    return lines.filter(said_by(USER + ASSISTANT) & F.col("message").isNotNull()).join(known, "session_id", "left_anti")
