import random
from datetime import datetime, timedelta

from logweave.operators.change_feed import replay_feed, resolve_roots
from logweave.operators.components import connected_components

T0 = datetime(2026, 3, 1)
SCHEMA = "seq long, id string, replaces_id string, retires_id string, status string, at_ts timestamp, entry_id string, closes int"


def at(n):
    return None if n is None else T0 + timedelta(minutes=n)


def got(spark, rows):
    return sorted((r.entry_id, r.current_id, r.status or "") for r in replay_feed(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect())


def brute(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[1] is not None:
            first.setdefault(r[1], r)
    entries = {}
    for r in first.values():
        k, seen = r, set()
        while k and (p := k[2] or k[3]):
            if k[1] in seen:
                k = None
                break
            seen.add(k[1])
            k = first.get(p)
        if k and r[5] is not None:
            entries.setdefault(k[1], []).append(r)
    out = []
    for e, own in entries.items():
        cur, status, closed = None, None, True
        for r in sorted(own, key=lambda r: (r[5], r[0])):
            s = r[4].strip().lower() if r[4] is not None else None
            closed, cur = bool(r[3]) or s in ("done", "discarded", "obsolete", "withdrawn"), r[1]
            if not closed and s is not None:
                status = s
        if not closed:
            out.append((e, cur, status or ""))
    return sorted(out)


def test_rules(spark):
    rows = [
        (1, "c", "b", None, None, at(5)), (2, "b", "a", None, " Draft ", at(3)), (3, "a", None, None, "open", at(1)), (4, "a", None, None, "open", at(1)),
        (5, "x", None, None, None, at(1)), (6, "y", None, "x", None, at(2)), (7, "z", "z", None, None, at(1)), (8, "u", "nowhere", None, None, at(1)),
        (9, "p", "q", None, None, at(1)), (10, "q", "p", None, None, at(1)), (11, "m", None, None, "DONE", at(1)), (12, "n", "m", None, None, at(1)),
        (13, "s", None, None, None, None), (14, "t", "s", None, "active", at(1)), (15, None, "a", None, "done", at(9)),
    ]
    assert got(spark, rows) == brute(rows) == [("a", "c", "draft"), ("m", "n", ""), ("s", "t", "active")]


def test_random_repeated_and_disordered(spark):
    for seed in range(2):
        g = random.Random(seed)
        rows = [(i, f"e{i}", f"e{g.randrange(120)}" if g.random() < 0.6 else None, f"e{g.randrange(120)}" if g.random() < 0.1 else None, g.choice([None, "open", "Done", " active"]), at(g.choice([None, *range(20)]))) for i in range(120)]
        rows += [(200 + n, *g.choice(rows)[1:]) for n in range(40)]
        g.shuffle(rows)
        assert got(spark, rows) == brute(rows)


def test_long_chain_and_hot_entry(spark):
    rows = [(i, f"e{i}", f"e{i - 1}" if i else None, None, "open", at(i)) for i in range(70)]
    rows += [(100 + i, f"h{i}", "e0", None, f"s{i}", at(500 + i)) for i in range(300)]
    assert got(spark, rows) == [("e0", "h299", "s299")]


def test_empty(spark):
    assert got(spark, []) == []
    assert resolve_roots(spark.createDataFrame([], "id string, parent string")).count() == 0


def test_components(spark):
    g = random.Random(1)
    edges = [(g.randrange(300), g.randrange(300)) for _ in range(170)] + [(7, 7), (1, None), (None, None)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in parent}
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
