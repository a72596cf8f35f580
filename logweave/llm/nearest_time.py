"""Problem 1: pair each record with the record nearest in time of the same entity.

Rows are hash-partitioned by (entity, time bucket) and sorted; each Arrow group is given to DuckDB, which
runs one backward and one forward ASOF join, and the nearer candidate within the tolerance is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import clean, is_side, not_blank, speaker

#: Rows held at once by a task: a chunk of the sorted stream, whole or part of a bucket.
CHUNK_ROWS = 100_000

_ASOF = """
WITH l AS (SELECT id, entity, bucket, t FROM chunk WHERE side = 1),
     r AS (SELECT id, entity, bucket, t FROM chunk WHERE side = 0 UNION ALL SELECT id, entity, bucket, t FROM carried),
     b AS (SELECT l.id, l.entity, l.bucket, l.t, r.id AS back_id, r.t AS back_t
           FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.bucket = r.bucket AND l.t >= r.t),
     f AS (SELECT b.*, r.id AS fwd_id, r.t AS fwd_t
           FROM b ASOF LEFT JOIN r ON b.entity = r.entity AND b.bucket = r.bucket AND b.t <= r.t),
     d AS (SELECT *, t - back_t AS back_d, fwd_t - t AS fwd_d FROM f)
SELECT id AS left_id,
       CASE WHEN fwd_d IS NULL OR back_d < fwd_d THEN back_id
            WHEN back_d IS NULL OR fwd_d < back_d THEN fwd_id
            ELSE least(back_id, fwd_id) END AS right_id,
       coalesce(least(back_d, fwd_d), back_d, fwd_d) AS distance_us
FROM d WHERE coalesce(least(back_d, fwd_d), back_d, fwd_d) <= {tolerance}
"""


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _join(tolerance_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.compute as pc

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        carried = None
        for chunk in _chunks(batches):
            carried = chunk.slice(0, 0) if carried is None else carried
            con.register("chunk", chunk)
            con.register("carried", carried)
            out = con.sql(_ASOF.format(tolerance=tolerance_us)).to_arrow_table()
            yield from out.cast(pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("distance_us", pa.int64())])).to_batches()
            # The right rows of the last bucket stand before its left rows, which may go on in the next chunk.
            last = chunk.slice(chunk.num_rows - 1, 1).to_pylist()[0]
            both = pa.concat_tables([carried, chunk])
            carried = both.filter(pc.and_(pc.equal(both["side"], 0), pc.and_(pc.equal(both["entity"], last["entity"]), pc.equal(both["bucket"], last["bucket"]))))

    return run


def nearest_in_time(left: DataFrame, right: DataFrame, *, left_cols: tuple[Column, Column, Column], right_cols: tuple[Column, Column, Column], tolerance_ms: int, bucket_ms: int = 600_000) -> DataFrame:
    """``(left_id, right_id, distance_us)``: for each left row the right row of the same entity nearest in time.

    left_cols and right_cols are (id, entity, timestamp) as columns of the two tables; ids are int64. The
    distance is at most tolerance_ms, inclusive; of equal distances the smaller right id wins, also among
    right rows at the same time. Left rows that are repeated each get their own row. Rows with a null id,
    entity or time, and left rows without a partner, give no row; empty tables give an empty result; other
    columns, whatever their names, are never read. A hot entity is split by time bucket: right rows within the
    tolerance of a bucket's edge are sent to both sides, so no join crosses buckets. Equal (entity, time)
    right rows are reduced to the smallest id before they are shuffled.
    """
    tol, width = tolerance_ms * 1000, max(bucket_ms, 2 * tolerance_ms) * 1000

    def narrow(df: DataFrame, cols: tuple[Column, Column, Column]) -> DataFrame:
        i, e, t = cols
        d = df.select(i.cast("long").alias("id"), e.cast("string").alias("entity"), F.unix_micros(t.cast("timestamp")).alias("t"))
        return d.filter("id is not null and entity is not null and t is not null")

    at = lambda c: F.floor(c / F.lit(width)).cast("long")
    lhs = narrow(left, left_cols).select("id", "entity", at(F.col("t")).alias("bucket"), "t", F.lit(1).alias("side"))
    rhs = narrow(right, right_cols).groupBy("entity", "t").agg(F.min("id").alias("id"))
    rhs = rhs.select("id", "entity", F.explode(F.sequence(at(F.col("t") - tol), at(F.col("t") + tol))).alias("bucket"), "t", F.lit(0).alias("side"))
    rows = lhs.unionByName(rhs).repartition("entity", "bucket").sortWithinPartitions("entity", "bucket", "side", "t", "id")
    return rows.mapInArrow(_join(tol), "left_id long, right_id long, distance_us long")


def typed_lines(lines: DataFrame) -> DataFrame:
    """Lines of the conversation that a person typed: a time, speaker user, content that is not blank."""
    keep = ~is_side(F.col("line_type")) & (speaker(F.col("message.role"), F.col("line_type")) == "user") & F.col("message").isNotNull()
    return lines.filter(F.col("ts").isNotNull() & keep & not_blank(F.col("message.content")))


def journal_to_lines(journal: DataFrame, lines: DataFrame, tolerance_ms: int = 15_000) -> DataFrame:
    """``(journal_id, line_id, distance_us)``: the typed line nearest to each journal row of the same session.

    Sessions are equal up to case and outer blanks. See nearest_in_time for nulls, ties and repeats.
    """
    cols = lambda i: (F.col(i), clean(F.col("session_id")), F.col("ts"))
    out = nearest_in_time(journal, typed_lines(lines), left_cols=cols("journal_id"), right_cols=cols("line_id"), tolerance_ms=tolerance_ms)
    return out.select(F.col("left_id").alias("journal_id"), F.col("right_id").alias("line_id"), "distance_us")
