"""The same transformations on streams, with checkpoints in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.session import shared_dir


def stream(spark: SparkSession, d: str, name: str, files: int = 4) -> DataFrame:
    """A parquet table as a stream of its files; the schema is the table's own."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def place(spark: SparkSession) -> str:
    """A new folder within the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that is available, written as parquet; what is read back. complete mode keeps the last state of the result."""
    spark, at = df.sparkSession, place(df.sparkSession)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def run_twice(df: DataFrame) -> tuple[int, int]:
    """Rows of a first and a second run over the same checkpoint; the second finds nothing new."""
    at, counts = place(df.sparkSession), [0, 0]
    for i in range(2):

        def count(batch: DataFrame, _: int, i: int = i) -> None:
            counts[i] += batch.count()

        df.writeStream.foreachBatch(count).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return counts[0], counts[1]


def upsert(df: DataFrame, keys: list[str], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table kept by merging each batch into its last version: merge aggregates the union. Versions are folders named by
    the batch, so a batch that runs again after a failure writes the same version."""
    spark, at = df.sparkSession, place(df.sparkSession)
    last: list[str] = []

    def step(batch: DataFrame, n: int) -> None:
        part = merge(batch)
        rows = merge(spark.read.parquet(last[-1]).unionByName(part)) if last else part
        rows.write.mode("overwrite").parquet(f"{at}/v{n}")
        last.append(f"{at}/v{n}")

    df.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(last[-1])


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "60 days") -> DataFrame:
    """``(key, start_us, end_us, n)``: session windows over event time."""
    e = events.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late)
    g = e.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def expiring_leases(events: DataFrame, lease_s: int, late: str = "0 seconds") -> DataFrame:
    """``(key, holder, until)``: the lease of each key after each batch that touches it, and once more without a holder when
    it runs out before another batch touches the key.

    events is ``(key, ts, who, kind)``. A claim takes a free lease, a renewal by its holder extends it, done or failed by its holder frees
    it; equal times go by who, then kind. State is kept between batches while a lease is held, and a timer on the watermark ends it.
    Null keys and times give nothing; rows later than the watermark are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, until = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            holder = None
        else:
            rows = pd.concat(list(frames)).sort_values(["t", "who", "kind"])
            for t, who, kind in zip(rows["t"], rows["who"], rows["kind"]):
                if holder is not None and t >= until:
                    holder = None
                if kind == "claim" and holder is None or kind == "renew" and holder == who:
                    holder, until = who, int(t) + lease_s
                elif kind in ("done", "failed") and holder == who:
                    holder = None
        if holder is not None and until * 1000 > state.getCurrentWatermarkMs():
            state.update((holder, until))
            state.setTimeoutTimestamp(until * 1000)
        else:
            holder = None
            state.remove()
        yield pd.DataFrame({"key": [key[0]], "holder": [holder], "until": [until]})

    e = events.filter("key is not null and ts is not null").withWatermark("ts", late).select("key", "ts", F.unix_seconds("ts").alias("t"), "who", "kind")
    return e.groupBy("key").applyInPandasWithState(step, "key long, holder string, until long", "holder string, until long", "append", GroupStateTimeout.EventTimeTimeout)


def first_of_each(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """One row for each key: repeated and late rows within the watermark are left out."""
    return events.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
