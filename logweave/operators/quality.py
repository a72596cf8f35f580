"""Checks of a log's quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import text as tx


def first_lines(log: DataFrame) -> DataFrame:
    """One row for each id of the log: its first line by seq."""
    cols = [c for c in log.columns if c != "id"]
    return log.filter("id is not null").groupBy("id").agg(F.min_by(F.struct(*cols), "seq").alias("x")).select("id", "x.*")


def lost_content(log: DataFrame, most_df: int) -> DataFrame:
    """``(id, lost)``: words of at most most_df entries that a corrected line had and its correction lacks."""
    e = first_lines(log).select("id", "replaces_id", tx.content_words(F.concat_ws(" ", "title", "text", "learning")).alias("w"))
    df = e.select(F.explode("w").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= most_df)
    old = e.select(F.col("id").alias("old_id"), F.col("w").alias("old"))
    gone = e.join(old, F.col("replaces_id") == F.col("old_id")).filter("id <> old_id").select("id", F.explode(F.array_except("old", "w")).alias("x"))
    return gone.join(df, "x").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("x")), " ").alias("lost"))


def integrity(log: DataFrame, now) -> DataFrame:
    """``(finding, n)``: missing and future times, repeated ids, pointers to nothing and to themselves, empty lines."""
    ids = log.select(F.col("id").alias("k")).filter("k is not null").distinct()
    once = log.agg(
        F.count_if(F.col("at_ts").isNull()).alias("missing_ts"), F.count_if(F.col("at_ts") > now).alias("future_ts"), F.count_if(F.col("id").isNull()).alias("no_id"),
        F.count_if((F.col("id") == F.col("replaces_id")) | (F.col("id") == F.col("retires_id"))).alias("self_pointer"),
        F.count_if(F.trim(F.concat_ws("", "title", "text", "learning", "choice", "why")) == "").alias("no_content"),
    )
    names = once.columns
    wide = once.select(F.explode(F.array(*(F.struct(F.lit(n).alias("finding"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.*")
    twice = log.filter("id is not null").groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_id").alias("finding"), "n")
    ptr = log.select(F.explode(F.array("replaces_id", "retires_id")).alias("k")).filter("k is not null")
    dangling = ptr.join(ids, "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dangling").alias("finding"), "n")
    return wide.unionByName(twice).unionByName(dangling)


def error_links(log: DataFrame, now, days: int = 30) -> DataFrame:
    """``(errors, fixed, learned, fixed_recent)``: shares of error entries that a correction or a closing line names."""
    e = first_lines(log).filter("entry_type = 'error'").select("id", "at_ts")
    f = log.filter("replaces_id is not null").select(F.col("replaces_id").alias("id")).distinct().withColumn("f", F.lit(1))
    r = log.filter("retires_id is not null").select(F.col("retires_id").alias("id")).distinct().withColumn("r", F.lit(1))
    j = e.join(f, "id", "left").join(r, "id", "left").select("at_ts", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("r", F.lit(0)).alias("r"))
    recent = F.col("at_ts") >= now - F.expr(f"INTERVAL {days} DAY")
    return j.agg(F.count(F.lit(1)).alias("errors"), F.round(F.avg("f"), 6).alias("fixed"), F.round(F.avg("r"), 6).alias("learned"), F.round(F.avg(F.when(recent, F.col("f"))), 6).alias("fixed_recent"))


def repetition(log: DataFrame, days: int = 7, least: int = 3, place_days: int = 30) -> DataFrame:
    """``(seq, repeated)`` of error lines: at least ``least`` of their class within ``days`` up to each, or an earlier one of the class in the
    same place, its topic, within ``place_days`` before."""
    day = 86_400_000_000
    w = Window.partitionBy("err_class").orderBy("t").rangeBetween(-days * day, 0)
    same = Window.partitionBy("err_class", "topic").orderBy("t").rangeBetween(-place_days * day, -1)
    e = log.filter("entry_type = 'error' and err_class is not null and at_ts is not null").select("seq", "err_class", "topic", F.unix_micros("at_ts").alias("t"))
    n = F.count(F.lit(1))
    return e.select("seq", ((n.over(w) >= least) | (F.col("topic").isNotNull() & (n.over(same) > 0))).alias("repeated"))
