from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.llm import nearest_time as nt

T0 = datetime(2026, 3, 1, 12)
COLS = lambda i: (F.col(i), F.col("k"), F.col("ts"))


def run(spark, left, right, tol=15_000, bucket=600_000):
    l = spark.createDataFrame([(i, k, t, "x") for i, k, t in left], "a long, k string, ts timestamp, bucket string")
    r = spark.createDataFrame([(i, k, t, "y") for i, k, t in right], "b long, k string, ts timestamp, side string")
    out = nt.nearest_in_time(l, r, left_cols=COLS("a"), right_cols=COLS("b"), tolerance_ms=tol, bucket_ms=bucket)
    return sorted((x.left_id, x.right_id) for x in out.collect())


def brute(left, right, tol=15_000):
    out = []
    for i, k, t in left:
        c = [(abs(t - u), j) for j, q, u in right if None not in (i, k, t, j, q, u) and k == q and abs(t - u) <= timedelta(milliseconds=tol)]
        if c:
            out.append((i, min(c)[1]))
    return sorted(out)


def at(s):
    return None if s is None else T0 + timedelta(seconds=s)


def test_tolerance_ties_and_nulls(spark):
    left = [(1, "a", at(0)), (2, "a", at(100)), (3, None, at(0)), (4, "a", None), (5, "b", at(0)), (6, "a", at(0))]
    right = [(9, "a", at(-15)), (8, "a", at(15)), (7, "a", at(85)), (5, "a", at(84.999)), (3, "a", at(115.001)), (2, "a", None), (None, "a", at(0)), (4, None, at(0)), (11, "a", at(-15))]
    assert run(spark, left, right) == brute(left, right) == [(1, 8), (2, 7), (6, 8)]


def test_bucket_edges_and_one_hot_key(spark):
    left = [(i, "a", at(i * 7)) for i in range(400)]
    right = [(i, "a", at(i * 5 + 3)) for i in range(0, 500, 3)]
    assert run(spark, left, right, bucket=30_000) == brute(left, right)


def test_chunks_within_a_bucket(spark, monkeypatch):
    left = [(i, "a", at(i % 50)) for i in range(300)]
    right = [(i, "a", at(i)) for i in range(0, 60, 2)] + [(i + 100, "b", at(i)) for i in range(9)]
    rows = [("R", x) for x in right] + [("L", x) for x in left]
    monkeypatch.setattr(nt, "CHUNK_ROWS", 7)
    import pyarrow as pa

    us = lambda t: int((t - T0).total_seconds() * 1e6)
    data = sorted(((k, 0, 1 if s == "L" else 0, us(t), i) for s, (i, k, t) in rows))
    b = [pa.RecordBatch.from_pydict({"id": [x[4] for x in data[n : n + 5]], "entity": [x[0] for x in data[n : n + 5]], "bucket": pa.array([0] * len(data[n : n + 5]), pa.int64()), "t": [x[3] for x in data[n : n + 5]], "side": pa.array([x[2] for x in data[n : n + 5]], pa.int32())}) for n in range(0, len(data), 5)]
    got = sorted((r["left_id"], r["right_id"]) for x in nt._join(15_000_000)(iter(b)) for r in x.to_pylist())
    assert got == brute(left, right)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", at(0))], []) == []
    assert run(spark, [], [(1, "a", at(0))]) == []


seconds = st.one_of(st.none(), st.integers(0, 90))
rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), seconds), max_size=25)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, rows)
def test_against_brute_force(spark, a, b):
    left, right = [(i, k, at(s)) for i, (k, s) in enumerate(a)], [(i, k, at(s)) for i, (k, s) in enumerate(b)]
    assert run(spark, left, right, bucket=30_000) == brute(left, right)


def test_sessions_and_typed_lines(spark):
    j = spark.createDataFrame([(1, at(0), " S1 "), (2, at(0), "s2"), (3, at(0), None)], "journal_id long, ts timestamp, session_id string")
    line = "line_id long, ts timestamp, session_id string, line_type string, message struct<role:string,content:string>"
    rows = [
        (1, at(1), "s1", "user", ("assistant", "x")), (2, at(2), "S1", "user", (None, "x")), (3, at(0), "s1", "user", ("user", "  \n")),
        (4, at(0), "s1", "system", ("user", "x")), (5, at(0), "s1", "user", None), (6, at(14), "s2", None, (" Human", "x")), (7, None, "s2", "user", ("user", "x")),
    ]
    out = nt.journal_to_lines(j, spark.createDataFrame(rows, line)).collect()
    assert sorted((r.journal_id, r.line_id, r.distance_us) for r in out) == [(1, 2, 2_000_000), (2, 6, 14_000_000)]
