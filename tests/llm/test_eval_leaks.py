import random

from logweave.llm import eval_leaks as el


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")


def both(spark, docs, items, **kw):
    d, i = frames(spark, [(*x, "z") for x in docs], [(*x, "z") for x in items])
    a = sorted(map(tuple, el.leaked_items(d, i, **kw).collect()))
    b = sorted(map(tuple, el.leaked_items(d, i, shard_chars=40, **kw).collect()))
    assert a == b
    return a


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_myers_against_the_table():
    g = random.Random(1)
    for _ in range(300):
        p, t, k = [g.choice("abc") for _ in range(g.randint(1, 8))], [g.choice("abc") for _ in range(g.randint(0, 12))], g.randint(0, 3)
        want = [e for e in range(1, len(t) + 1) if min(edit(p, t[s:e]) for s in range(e + 1)) <= k]
        assert el.myers_ends(p, t, k) == want


def test_runs_of_every_length_and_place(spark):
    g = random.Random(2)
    item = [f"w{i}" for i in range(40)]
    docs, want = [], []
    for n in range(60):
        s, size = g.randint(0, 27), g.choice([11, 12, 13, 14, 20])
        part = item[s : s + size]
        docs.append((n, " ".join([f"x{g.randrange(99)}" for _ in range(g.randint(0, 9))] + part + [f"y{g.randrange(99)}"]).replace(" w5 ", " W5, ")))
        if len(part) >= 13:
            want.append((n, 7))
    assert both(spark, docs, [(7, "-".join(item)), (8, "too short"), (9, None), (None, "w " * 20)]) == want


def test_random_against_brute_force(spark):
    g = random.Random(3)
    word = lambda: g.choice("abcdefgh")
    items = [(i, [word() for _ in range(14)]) for i in range(6)]
    docs = []
    for n in range(40):
        t = [word() for _ in range(6)] + list(g.choice(items)[1]) + [word() for _ in range(6)]
        for _ in range(g.randint(0, 4)):
            t[g.randrange(len(t))] = word()
        docs.append((n, t))
    for run, budget in ((6, 0), (8, 1), (10, 2)):
        want = set()
        for n, t in docs:
            for i, w in items:
                for s in range(len(w) - run + 1):
                    p = w[s : s + run]
                    if any(edit(p, t[x:y]) <= budget for x in range(len(t)) for y in range(x + run - budget, min(len(t), x + run + budget) + 1)):
                        want.add((n, i))
        assert both(spark, [(n, " ".join(t)) for n, t in docs], [(i, " ".join(w)) for i, w in items], run=run, budget=budget) == sorted(want)


def test_empty_and_null(spark):
    assert both(spark, [], []) == []
    assert both(spark, [(1, None), (None, "a " * 20), (2, "")], [(1, "a " * 20)]) == []
    assert both(spark, [(1, "b " * 3000 + "a " * 20)], [(1, "a " * 20)]) == [(1, 1)]
