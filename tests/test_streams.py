"""Streams over files that arrive one at a time."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from logweave.functions import maths as mt
from logweave.streaming import streams as st

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def arriving(spark, folder, batches, schema):
    """A stream whose batches are the given lists of rows."""
    for i, rows in enumerate(batches):
        at = folder / f"{i:03}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(at))
        for f in at.glob("part-*.parquet"):
            f.rename(folder / f"{i:03}.parquet")
    return spark.readStream.schema(spark.read.parquet(str(folder / "000.parquet")).schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder / "*.parquet"))


def test_leases_end_by_their_timer(spark, tmp_path):
    e = lambda key, s, who, kind: (key, T0 + timedelta(seconds=s), who, kind)
    batches = [
        [e(1, 0, "a", "claim"), e(1, 5, "b", "claim"), e(2, 0, "a", "claim"), e(3, 0, "a", "claim"), e(3, 1, "a", "done"), (None, T0, "a", "claim"), (4, None, "a", "claim")],
        [e(1, 8, "a", "renew"), e(9, 15, "z", "failed")],
        [e(2, 16, "b", "claim"), e(9, 17, "z", "failed")],
        [e(9, 60, "z", "failed")],
    ]
    out = st.run(st.expiring_leases(arriving(spark, tmp_path, batches, "key long, ts timestamp, who string, kind string"), 10))
    seconds = lambda r: r.until - int(T0.timestamp())
    got = {}
    for r in out.filter("key < 9").collect():
        got.setdefault(r.key, set()).add((r.holder, seconds(r) if r.until else 0))
    assert got[1] == {("a", 10), ("a", 18), (None, 18)}
    # What touches a key comes before its timer.
    assert got[2] == {("a", 10), ("b", 26), (None, 26)} and got[3] == {(None, 10)} and set(got) == {1, 2, 3}


def test_upsert_over_batches(spark, tmp_path):
    s = arriving(spark, tmp_path, [[("a", 1), ("b", 1)], [("a", 1)], [("c", 5), ("a", 2)]], "term string, df long")
    assert {tuple(r) for r in st.upsert(s, ["term"], lambda x: x.groupBy("term").agg(F.sum("df").alias("df"))).collect()} == {("a", 4), ("b", 1), ("c", 5)}


def test_late_rows_are_left_out(spark, tmp_path):
    day = lambda n: T0 + timedelta(days=n)
    # A batch is held against the watermark as it was before the last one.
    batches = [[("x", day(0)), ("y", day(10))], [("w", day(10))], [("x", day(10)), ("late", day(1))], [("z", day(9)), ("y", day(10))]]
    out = st.run(st.first_of_each(arriving(spark, tmp_path, batches, "id string, ts timestamp"), "id", "ts", "3 days"))
    assert sorted(r.id for r in out.collect()) == ["w", "x", "x", "y", "z"]


def test_short_hashes(spark):
    def fold(s, start, step):
        h = start
        for c in s:
            h = step(h, ord(c)) & 0xFFFFFFFF
        return h

    words = ["", "a", "foobar", "é", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [tuple(r) for r in df.select(mt.fnv1a(F.col("w")), mt.djb2(F.col("w"))).collect()]
    assert got == [(None, None) if w is None else (fold(w, 2166136261, lambda h, c: (h ^ c) * 16777619), fold(w, 5381, lambda h, c: (h * 33) ^ c)) for w in words]
    assert got[2][0] == 0xBF9CF968
