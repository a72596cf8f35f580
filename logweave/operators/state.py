"""Current and as-of state: holding rows, validity, authority, folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Authority tiers from most to least entitled.
TIERS = ("user", "system", "agent", "external", "inferred", "unknown")
CLOSING = ("done", "discarded", "obsolete", "withdrawn")


def tier_rank(tier: Column) -> Column:
    """Place of a tier, 0 the highest; anything else is unknown."""
    out = F.lit(len(TIERS) - 1)
    for i, t in enumerate(TIERS[:-1]):
        out = F.when(tier == t, F.lit(i)).otherwise(out)
    return out


def may_change(claim_author: Column, claim_tier: Column, target_author: Column, target_tier: Column, supersede: Column) -> Column:
    """allowed, refused, or unresolved without a target. The same author may; a lower tier may not change a higher one; to supersede
    another's claim takes a higher tier."""
    same = F.coalesce(claim_author == target_author, F.lit(False))
    a, b = tier_rank(claim_tier), tier_rank(target_tier)
    ok = F.when(supersede, a < b).otherwise(a <= b)
    return F.when(target_tier.isNull(), "unresolved").when(same | ok, "allowed").otherwise("refused")


def holding(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows with an id that close nothing and that no line of the log retires."""
    gone = log.filter("retires_id is not null").select(F.col("retires_id").alias("id")).distinct()
    return rows.filter("id is not null and retires_id is null").join(gone, "id", "left_anti")


def admits(types: list[str] | None = None, project: str | None = None, since: str | None = None, raw: bool | None = None) -> Column:
    """One predicate over hit_type, project, found_at, is_raw and pending; a project's grant also sees what has none."""
    p = ~F.col("pending")
    if types:
        p = p & F.col("hit_type").isin(*types)
    if project:
        p = p & in_scope(F.col("project"), project)
    if since:
        p = p & (F.col("found_at") >= F.lit(since).cast("timestamp"))
    return p if raw is None else p & (F.col("is_raw") == raw)


def in_scope(c: Column, project: str) -> Column:
    """The project's own rows and those of none."""
    return c.isNull() | (c == project)


def with_validity(first: DataFrame) -> DataFrame:
    """Adds valid_from, of a correction its time, and valid_until, the earliest time of a correction of the row."""
    s = first.filter("replaces_id is not null").groupBy(F.col("replaces_id").alias("id")).agg(F.min("at_ts").alias("valid_until"))
    return first.join(s, "id", "left").withColumn("valid_from", F.when(F.col("replaces_id").isNotNull(), F.col("at_ts")))


def valid_at(start: Column, end: Column, t: Column) -> Column:
    """start <= t < end; missing bounds are open."""
    return (start.isNull() | (start <= t)) & (end.isNull() | (end > t))


def body() -> Column:
    """The text of an entry by its type."""
    join = lambda *c: F.concat_ws(" - ", *c)
    t = F.col("entry_type")
    return F.when(t == "decision", join("title", "choice", "why")).when(t == "learning", join("title", "learning")).when(t == "error", join("title", "err_class", "text")).otherwise(join("title", "text"))


def is_echo(words: Column, question: Column, share: float = 0.7) -> Column:
    """At least three content words, and that share of them stands in the question."""
    return (F.size(words) >= 3) & (F.size(F.array_intersect(words, question)) / F.greatest(F.size(words), F.lit(1)) >= share)


def merge_intervals(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``(key, a, b)``: the union of overlapping or touching intervals of each key."""
    w = Window.partitionBy(key).orderBy(a, b)
    r = rows.withColumn("_p", F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("_g", F.sum(F.when(F.col("_p").isNull() | (F.col(a) > F.col("_p")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, "_g").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("_g")


def current_facts(versions: DataFrame, now: Column, stale_days: int = 120) -> DataFrame:
    """``(key, state, current, age_days, stale, conflict, history, future, expired)`` of versions (key, id, value, valid_from, valid_until).

    The newest version valid now is current; state is current, not_yet, expired or none. Versions are aggregated, with map-side
    combine, so a key of any number of versions is one row in each task.
    """
    start, end = F.col("valid_from"), F.col("valid_until")
    future, ran_out = start.isNotNull() & (start > now), (start.isNull() | (start <= now)) & end.isNotNull() & (now >= end)
    holds = ~F.coalesce(future, F.lit(False)) & (end.isNull() | (now < end))
    v = versions.withColumns({"_f": F.coalesce(future, F.lit(False)), "_e": F.coalesce(ran_out, F.lit(False)), "_v": F.coalesce(holds, F.lit(False))})
    top = v.groupBy("key").agg(
        F.max(F.when(F.col("_v"), F.struct(F.coalesce(start, F.lit("0001-01-01").cast("timestamp")).alias("s"), "id", "value"))).alias("c"), F.count(F.lit(1)).alias("n"),
        F.count_if("_f").alias("future"), F.count_if("_e").alias("expired"),
    )
    same = v.filter("_v").groupBy("key", F.coalesce(start, F.lit("0001-01-01").cast("timestamp")).alias("s")).agg(F.countDistinct("value").alias("values"))
    top = top.join(same.select(F.col("key").alias("k2"), F.col("s").alias("s2"), "values"), (F.col("key") == F.col("k2")) & (F.col("c.s") == F.col("s2")), "left")
    age = F.when(F.year("c.s") > 1, F.round((F.unix_micros(now) - F.unix_micros("c.s")) / 86_400_000_000).cast("int"))
    named = F.when(F.col("c").isNotNull(), "current").when(F.col("future") > 0, "not_yet").when(F.col("expired") > 0, "expired").otherwise("none")
    return top.select("key", named.alias("state"), F.col("c.id").alias("current"), age.alias("age_days"), F.coalesce(age > stale_days, F.lit(False)).alias("stale"), F.coalesce(F.col("values") > 1, F.lit(False)).alias("conflict"), (F.col("n") - F.col("c").isNotNull().cast("int")).alias("history"), "future", "expired")


def _leases(cap_s: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, holder, until, refused, out = None, None, 0, 0, []

        def done():
            if key is not None:
                out.append((key, holder, until if holder is not None else None, refused))

        for b in batches:
            for k, t, who, kind in zip(*(b.column(n).to_pylist() for n in ("key", "t", "who", "kind"))):
                if k != key:
                    done()
                    key, holder, until, refused = k, None, 0, 0
                free = holder is None or t >= until
                if kind == "claim" and free:
                    holder, until = who, t + cap_s
                elif kind == "renew" and holder == who and not free:
                    until = t + cap_s
                elif kind in ("done", "failed") and holder == who:
                    holder = None
                else:
                    refused += 1
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int32()))], ["key", "holder", "until", "refused"])
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int32()))], ["key", "holder", "until", "refused"])

    return go


def fold_leases(events: DataFrame, lease_s: int) -> DataFrame:
    """``(key, holder, until, refused)``: events (key, t, who, kind) of claim, renew, done and failed, folded in order of t, who, kind.

    A stream over sorted partitions: one state in memory, whatever a key's length.
    """
    e = events.select("key", "t", "who", "kind").repartition("key").sortWithinPartitions("key", "t", "who", "kind")
    return e.mapInArrow(_leases(lease_s), "key long, holder string, until long, refused int")


def chain_hash(lines: Column) -> Column:
    """SHA-256 over previous hash, a zero byte and the line, running over an array of lines."""
    return F.aggregate(lines, F.lit(""), lambda h, x: F.sha2(F.concat(h, F.lit("\0"), x), 256))
