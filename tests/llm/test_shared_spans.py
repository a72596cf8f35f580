import random

from logweave.llm import shared_spans as ss


def brute(docs, span):
    words = {i: t.split() for i, t in docs if i is not None and t}
    runs = {}
    for i, w in words.items():
        for k in range(len(w) - span + 1):
            runs.setdefault(tuple(w[k : k + span]), set()).add(i)
    out = []
    for i, w in words.items():
        hit = {p for k in range(len(w) - span + 1) if len(runs[tuple(w[k : k + span])]) > 1 for p in range(k, k + span)}
        if hit:
            out.append((i, len(hit)))
    return sorted(out)


def got(spark, docs, span, shingle):
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, at int, h1 string")
    return sorted((r.doc_id, r.shared_words) for r in ss.shared_words(d, span, shingle).collect())


def test_against_brute_force(spark):
    g = random.Random(4)
    parts = [[f"{g.randrange(40)}" for _ in range(g.randint(5, 40))] for _ in range(12)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(g.randint(0, 4)):
            p = g.choice(parts)
            s = g.randrange(len(p))
            w += p[s:] + [f"n{g.randrange(999)}"]
        docs.append((i, g.choice([" ", "\n", "  "]).join(w)))
    docs += [(100, docs[1][1]), (101, docs[1][1]), (102, None), (None, docs[1][1]), (103, ""), (104, " \n ")]
    for span, shingle in ((10, 3), (12, 8), (7, 7), (1, 1)):
        assert got(spark, docs, span, shingle) == brute(docs, span)


def test_runs_within_one_document_do_not_count(spark):
    w = " ".join(f"w{i}" for i in range(20))
    assert got(spark, [(1, f"{w} x {w}"), (2, "other words")], 10, 3) == []
    assert got(spark, [(1, w), (1, w)], 10, 3) == []
    assert got(spark, [], 10, 3) == []


def test_clusters(spark):
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    d = spark.createDataFrame([(5, a), (3, f"x {a} y {b}"), (9, f"{b} z"), (7, "q " * 30), (8, "q " * 30), (1, "alone")], "doc_id long, text string")
    assert {r.doc_id: r.cluster_id for r in ss.span_clusters(d, 10, 3).collect()} == {5: 3, 3: 3, 9: 3, 7: 7, 8: 7}
