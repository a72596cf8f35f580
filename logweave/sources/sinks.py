"""Writes: the append gate, corrections and tombstones, shards, exports. All give DataFrames; writing is the caller's step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import text as tx

#: Types of entries.
TYPES = ("decision", "error", "event", "timeline", "thought", "learning", "duty", "question", "skill", "procedure", "source", "update", "link", "workflow", "snippet", "card")


def shape_problems(entries: DataFrame) -> DataFrame:
    """Adds ``problems``: what keeps an entry from being written."""
    return entries.withColumn("problems", F.array_compact(F.array(
        F.when(F.col("id").isNull() | ~F.col("id").rlike("^[a-z0-9]{6,16}$"), "id"), F.when(~F.coalesce(F.col("entry_type").isin(*TYPES), F.lit(False)), "type"),
        F.when(F.col("at_ts").isNull(), "time"), F.when(F.trim(F.concat_ws("", "title", "text", "learning", "choice", "why")) == "", "empty"),
        F.when((F.col("replaces_id") == F.col("id")) | (F.col("retires_id") == F.col("id")), "self pointer"), F.when(F.length(F.concat_ws("", "title", "text", "learning")) > 1_000_000, "size"),
    )))


def stamp(entries: DataFrame) -> DataFrame:
    """Entries that pass the gate, redacted and with version and tier."""
    ok = shape_problems(entries).filter(F.size("problems") == 0).drop("problems")
    for c in ("title", "text", "learning", "choice", "why"):
        ok = ok.withColumn(c, tx.redact(F.col(c)))
    return ok.withColumns({"v": F.lit(1), "authority": F.lit("agent")})


def corrections(first: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``(id, *fields)`` of correcting lines, with what they leave out taken from the line they correct."""
    old = first.select(F.col("id").alias("_o"), *(F.col(c).alias(f"_{c}") for c in fields))
    j = first.filter("replaces_id is not null and replaces_id <> id").join(old, F.col("replaces_id") == F.col("_o"))
    return j.select("id", *(F.coalesce(c, f"_{c}").alias(c) for c in fields))


def tombstones(targets: DataFrame, state: str) -> DataFrame:
    """Closing lines for targets (id, by_id): new ids are drawn from the target's, so that writing twice writes the same."""
    return targets.select(F.substring(F.sha2(F.concat("id", F.lit(f"/{state}")), 256), 1, 12).alias("id"), F.col("id").alias("retires_id"), F.lit(state).alias("state"), "by_id")


def merged(entries: DataFrame, key: str, most: int = 20) -> DataFrame:
    """``(key, ids, text)``: the first two to ``most`` entries (key, id, seq, text) of each key joined to one text."""
    r = entries.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).filter(F.col("_n") <= most)
    g = r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "id", "text"))).alias("l")).filter(F.size("l") >= 2)
    return g.select(key, F.transform("l", lambda x: x["id"]).alias("ids"), F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"))


def oldest(lines: DataFrame, key: str, n: int) -> DataFrame:
    """Adds ``shard``: true for the n oldest lines of each key that retire nothing."""
    w = Window.partitionBy(key, F.col("retires_id").isNull()).orderBy("seq")
    return lines.withColumn("shard", F.col("retires_id").isNull() & (F.row_number().over(w) <= n))


def manifest(sharded: DataFrame, key: str) -> DataFrame:
    """``(key, lines, first_seq, last_seq, checksum)`` of the shards; the checksum does not depend on the order."""
    s = sharded.filter("shard").groupBy(key)
    return s.agg(F.count(F.lit(1)).alias("lines"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.bit_xor(F.xxhash64("seq", "id")).alias("checksum"))
