import random
from datetime import datetime, timedelta
from itertools import combinations

from pyspark.sql import functions as F

from logweave.operators import graph, joins, packing, quality, ranking, state
from logweave.sources import captures, logs, sinks

T0 = datetime(2026, 3, 1)

LOG = "seq long, id string, entry_type string, agent string, topic string, title string, text string, learning string, choice string, why string, err_class string, at_ts timestamp, replaces_id string, retires_id string, status string, state string"


def at(n):
    return None if n is None else T0 + timedelta(hours=n)


def make(spark, rows):
    names = [x.split()[0] for x in LOG.split(", ")]
    return spark.createDataFrame([tuple({"entry_type": "learning", **r}.get(n) for n in names) for r in rows], LOG)


def pairs(df, *c):
    return sorted(tuple(r[x] for x in c) for r in df.collect())


def test_holding_and_first_lines(spark):
    log = make(spark, [dict(seq=2, id="a", title="late copy"), dict(seq=1, id="a", title="first"), dict(seq=3, id="b"), dict(seq=4, id="x", retires_id="b"), dict(seq=5, id=None), dict(seq=6, id="y", retires_id="gone")])
    first = quality.first_lines(log)
    assert pairs(first, "id", "seq") == [("a", 1), ("b", 3), ("x", 4), ("y", 6)]
    assert pairs(state.holding(first, log), "id") == [("a",)]
    assert quality.first_lines(log.limit(0)).count() == 0


def test_validity_and_facts(spark):
    log = make(spark, [dict(seq=1, id="a", at_ts=at(0), topic="t", title="v1"), dict(seq=2, id="b", at_ts=at(10), topic="t", title="v2", replaces_id="a"), dict(seq=3, id="c", at_ts=at(10_000), topic="u", title="v"), dict(seq=4, id="d", at_ts=None, topic="w", title="v"), dict(seq=5, id="e", at_ts=at(10), topic="t", title="other")])
    v = state.with_validity(quality.first_lines(log))
    ok = v.filter(state.valid_at(F.col("valid_from"), F.col("valid_until"), F.lit(str(at(5))).cast("timestamp")))
    assert pairs(ok, "id") == [("a",), ("c",), ("d",), ("e",)]
    f = v.select(F.col("topic").alias("key"), "id", F.col("title").alias("value"), F.col("at_ts").alias("valid_from"), "valid_until")
    got = {r.key: r for r in state.current_facts(f, F.lit("2026-04-01").cast("timestamp")).collect()}
    assert (got["t"].current, got["t"].conflict, got["t"].history, got["t"].expired) == ("e", True, 2, 1)
    assert (got["u"].state, got["u"].current, got["w"].state, got["w"].age_days, got["w"].stale) == ("not_yet", None, "current", None, False)


def test_authority(spark):
    rows = [("x", "agent", "x", "user", True), ("x", "agent", "y", "agent", True), ("x", "agent", "y", "agent", False), ("x", "user", "y", "agent", True), ("x", "agent", None, None, True), (None, "inferred", None, "agent", False)]
    df = spark.createDataFrame(rows, "ca string, ct string, ta string, tt string, s boolean")
    got = [r[0] for r in df.select(state.may_change(*(F.col(c) for c in ("ca", "ct", "ta", "tt", "s")))).collect()]
    assert got == ["allowed", "refused", "allowed", "allowed", "unresolved", "refused"]


def test_leases(spark):
    e = [(1, 0, "a", "claim"), (1, 5, "b", "claim"), (1, 12, "b", "claim"), (1, 13, "a", "renew"), (1, 14, "b", "renew"), (2, 0, "a", "claim"), (2, 1, "a", "done"), (3, 0, "a", "done")]
    random.Random(1).shuffle(e)
    df = spark.createDataFrame(e, "key long, t long, who string, kind string")
    assert sorted(map(tuple, state.fold_leases(df, 10).collect())) == [(1, "b", 24, 2), (2, None, None, 0), (3, None, None, 1)]
    assert state.fold_leases(df.limit(0), 10).count() == 0


def test_intervals_and_chain(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 9, 10), ("k", 1, 2), ("j", 1, 1)], "k string, a long, b long")
    assert pairs(state.merge_intervals(df, "k", "a", "b"), "k", "a", "b") == [("j", 1, 1), ("k", 0, 7), ("k", 9, 10)]
    import hashlib

    h = ""
    for x in ("p", "q"):
        h = hashlib.sha256((h + "\0" + x).encode()).hexdigest()
    assert spark.range(1).select(state.chain_hash(F.array(F.lit("p"), F.lit("q")))).first()[0] == h


def test_time_joins_against_brute_force(spark):
    g = random.Random(3)
    left = [(i, g.choice("ab"), g.randrange(1000) if g.random() > 0.1 else None) for i in range(60)]
    right = [(i, g.choice("ab"), g.randrange(1000) if g.random() > 0.1 else None) for i in range(60)]
    l, r = spark.createDataFrame(left, "l long, k string, t long"), spark.createDataFrame(right, "r long, k string, t long")
    near, after, asof = [], [], []
    for i, k, t in left:
        if t is None:
            continue
        c = [(abs(u - t), j) for j, q, u in right if q == k and u is not None and abs(u - t) <= 50]
        near += [(i, min(c)[1])] if c else []
        c = [(u - t, j) for j, q, u in right if q == k and u is not None and 0 < u - t <= 50]
        after += [(i, min(c)[1])] if c else []
        c = [(u, j) for j, q, u in right if q == k and u is not None and u <= t]
        asof.append((i, max(c)[1] if c else None))
    assert pairs(joins.nearest_within(l, r, "k", "l", "r", 50), "l", "r") == near
    assert pairs(joins.first_after(l, r, "k", "l", "r", 50), "l", "r") == after
    assert sorted(map(tuple, joins.asof_backward(l, r, "k", "l", "r").collect()), key=str) == sorted(asof, key=str)


def test_overlaps_and_features(spark):
    g = random.Random(4)
    sets = {f"k{i}": {g.choice("abcdefghijkl") for _ in range(g.randint(0, 7))} for i in range(40)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k string, w array<string>")
    want = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 2 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.25]
    assert pairs(joins.overlapping_sets(df, "k", "w"), "a", "b") == want
    items = df.select("k", F.explode("w").alias("f"))
    df_of = {x: sum(x in v for v in sets.values()) for x in "abcdefghijkl"}
    want = [(a, b) for a, b in combinations(sorted(sets), 2) if any(df_of[x] <= 12 for x in sets[a] & sets[b])]
    assert pairs(joins.shared_features(items, "k", "f", 12, 40), "a", "b") == want


def test_similar_names(spark):
    df = spark.createDataFrame([(x,) for x in ("blue-kite", "blue_kite", "bluekite", "blue", "glue-kite", "far-away", "ab", "ac", None)], "n string")
    got = {(r.a, r.b): r.reason for r in joins.similar_names(df).collect()}
    assert got == {("blue-kite", "blue_kite"): "same", ("blue-kite", "bluekite"): "compact", ("blue_kite", "bluekite"): "compact", ("blue", "blue-kite"): "part", ("blue", "blue_kite"): "part", ("blue-kite", "glue-kite"): "letters", ("blue_kite", "glue-kite"): "letters", ("bluekite", "glue-kite"): "letters"}


def test_search_and_fusion(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha alpha alpha"), (3, "delta omega"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Alpha gamma?"), (2, "nothing here"), (3, None)], "q long, text string")
    got = pairs(ranking.bm25_search(docs, "doc_id", q, "q", 5), "q", "doc_id", "covered", "asked")
    assert got == [(1, 1, 2, 2), (1, 2, 1, 2)]
    one = spark.createDataFrame([("x", 1, 1), ("x", 2, 2)], "w string, h long, rank int")
    fused = {r.h: (r.score, r.found_by) for r in ranking.fuse([one, one.filter("h = 2")], "w", "h").collect()}
    assert fused[2] == (round(2 / 62, 6), "0,1") and fused[1] == (round(1 / 61, 6), "0")


def test_vectors_are_exact_with_ties(spark, monkeypatch):
    g = random.Random(5)
    rows = [(i, [float(g.randint(0, 3)) for _ in range(3)]) for i in range(80)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(ranking, "BLOCK", 2)
    got = pairs(ranking.nearest_vectors(v.filter("vec_id % 20 = 0"), v, 4), "query_id", "vec_id")
    want = []
    for i, a in rows[::20]:
        d = sorted((round(-1 / (1 + sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5), 6), j) for j, b in rows if j != i)
        want += [(i, j) for _, j in d[:4]]
    assert got == sorted(want)
    assert ranking.nearest_vectors(v.limit(0), v, 3).count() == 0


def test_mmr_prefers_what_differs(spark):
    h = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.6, [0.0, 1.0])], "query_id long, doc_id long, rel double, embedding array<double>")
    assert [r.doc_id for r in ranking.mmr(h, 3, 0.5).orderBy("place").collect()] == [1, 3, 2]


def test_packing(spark):
    r = spark.createDataFrame([("k", 1, 3, 60), ("k", 2, 2, 50), ("k", 3, 1, 40), ("j", 9, 1, 500)], "key string, id long, rank long, size long")
    assert pairs(packing.fill(r, 100), "key", "id", "used") == [("k", 1, 60), ("k", 3, 100)]
    # By ascending rank: 40 whole, 50 whole, of 60 only the short form (12) no longer fits; of 500 the short form does.
    assert pairs(packing.compose(r, 100, (1.0, 0.2)), "key", "id", "used") == [("j", 9, 100), ("k", 2, 90), ("k", 3, 40)]
    d = spark.createDataFrame([(1, "datenbank daten bank daten bank datenbank")], "doc_id long, text string")
    assert [tuple(x) for x in packing.compounds(d).collect()] == [("datenbank", "daten", "bank")]


def test_graph(spark):
    n = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("m", "gone"), ("o", "m"), ("s", "s")], "id string, parent string")
    assert dict(map(tuple, graph.audit(n).collect())) == {"missing": 1, "forks": 1, "cyclic": 3, "depth": 2}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "a string, b string")
    assert {r.node: r.layer for r in graph.layers(e).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


def test_log_lines(spark):
    lines = ['{"id": "a", "tags": ["x"]}', '{"id": "b"', "[1]", '{"tags": []}', "null", '{"id": "c", "other": 1}']
    p = logs.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.broken for r in p.collect()] == [False, True, True, True, True, False]
    got = spark.createDataFrame([("a, b,",), ('["x", " y "]',), ("",), (None,)], "c string").select(logs.as_list(F.col("c"))).collect()
    assert [r[0] for r in got] == [["a", "b"], ["x", "y"], [], None]


def test_drawers_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", "decision", "p", "t"), ("b", "error", "global", "u")], "id string, type string, project string, title string")
    logs.write_drawers(e, str(tmp_path / "d"))
    back = logs.read_drawers(spark, [str(tmp_path / "d" / "*" / "*")])
    assert sorted((r.entry.id, r.broken) for r in back.collect()) == [("a", False), ("b", False)]


def test_writes(spark):
    log = make(spark, [dict(seq=1, id="abcdef1", at_ts=at(1), title="old", topic="t", status="open"), dict(seq=2, id="abcdef2", at_ts=at(2), title="new", replaces_id="abcdef1"), dict(seq=3, id="bad id", at_ts=at(1), title="x"), dict(seq=4, id="abcdef3", at_ts=None, title=" ")])
    assert [sorted(r.problems) for r in sinks.shape_problems(log).orderBy("seq").collect()] == [[], [], ["id"], ["empty", "time"]]
    assert [tuple(r) for r in sinks.corrections(quality.first_lines(log), ("title", "topic")).collect()] == [("abcdef2", "new", "t")]
    t = spark.createDataFrame([("a", "b")], "id string, by_id string")
    assert sinks.tombstones(t, "done").collect() == sinks.tombstones(t, "done").collect()
    assert pairs(sinks.oldest(log, "entry_type", 2).filter("shard"), "seq") == [(1,), (2,)]


def test_captures(spark):
    rows = [(1, "user", ("user", "x")), (2, None, ("human", "x")), (3, "user", None), (4, "user", (None, " ")), (5, "system", ("user", "x")), (6, "user", ("assistant", "x"))]
    df = spark.createDataFrame(rows, "line_id long, line_type string, message struct<role:string,content:string>")
    assert pairs(df.filter(captures.real_user()), "line_id") == [(1,), (2,)]


def test_asof_within(spark):
    left = spark.createDataFrame([("a", 1, 100, 1), ("a", 1, 5, 2), ("a", 2, 100, 3), ("b", 1, 31, 4), (None, 1, 31, 5)], "s string, id int, t long, l long")
    right = spark.createDataFrame([("a", 1, 90, 10), ("a", 1, 90, 11), ("a", 1, 101, 12), ("a", 2, 69, 13), ("b", 1, 1, 14), (None, 1, 31, 15)], "s string, id int, t long, r long")
    got = {(r.l, r.r, r.after_us) for r in joins.asof_within(left, right, ["s", "id"], "l", "r", 30).collect()}
    assert got == {(1, 11, 10), (4, 14, 30)}
    assert joins.asof_within(left.limit(0), right, ["s", "id"], "l", "r", 30).count() == 0


def test_author_share(spark):
    rows = [("q", "x", i, False) for i in range(5)] + [("q", "x", 9, True), ("q", None, 10, False), ("q", "y", 11, False), ("p", "x", 12, False)]
    df = spark.createDataFrame(rows, "call string, who string, n int, exempt boolean")
    assert pairs(ranking.author_share(df, "call", "who", [F.col("n")], 2), "n") == [(0,), (1,), (9,), (10,), (11,), (12,)]


def test_answer_holds(spark):
    rows = [("lead", 1.0, False, False), ("lead", 0.9, False, False), ("tie", 1.0, False, False), ("tie", 1.0, False, False), ("low", 0.5, False, False), ("exact", 0.1, True, False), ("full", 0.1, False, True), ("alone", 1.0, False, False), ("far", 2.0, False, False), ("far", 2.0, False, False)]
    got = ranking.answer_holds(spark.createDataFrame(rows, "w string, score double, exact boolean, full boolean"), "w", F.lit(0.95))
    assert {r.w for r in got.filter("holds").collect()} == {"lead", "exact", "full", "alone", "far"}


def test_places(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.0, 2.0, None]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, s double, i int").repartition(5)
    got = {r.i: (r.place, r.n) for r in ranking.places(df, "g", [F.desc_nulls_last("s"), F.col("i")], "place", "n").collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in mine] == [(n, len(mine)) for n in range(1, len(mine) + 1)]
    assert ranking.places(df.limit(0), "g", [F.col("i")]).count() == 0
