"""Whole results where frequent words, whole entries or later answers decide; against plain Python."""

import math
import random
from collections import Counter
from itertools import combinations

from logweave.operators import joins, ranking
from logweave.plans import aggregates, folds, ranked, relational
from tests.test_operators import at, make


def on_disk(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


LOG_MORE = {"tags": "array<string>", "project": "string"}


def log_of(spark, rows):
    from pyspark.sql import functions as F

    df = make(spark, rows)
    tags = spark.createDataFrame([(r["seq"], r.get("tags")) for r in rows], "seq long, tags array<string>")
    return df.join(tags, "seq").withColumn("project", F.lit(None).cast("string"))


def test_first_sharing_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    draw = lambda n: sorted({words[min(59, int(rng.expovariate(0.12)))] for _ in range(n)})
    e = [(f"e{i}", rng.randrange(200), draw(3)) for i in range(400)]
    q = [(i, rng.randrange(200), draw(4), 2 if i % 3 else 1) for i in range(60)] + [(60, 5, ["word1"], 2), (61, 5, ["none", "nothing"], 2), (62, None, ["word1", "word2"], 2)]
    want = {}
    for k, t, w, need in q:
        hits = [(et, i) for i, et, ew in e if t is not None and et > t and len(set(w) & set(ew)) >= need]
        if hits:
            want[k] = (min(hits)[1], min(hits)[0])
    dq = spark.createDataFrame(q, "qid long, t long, w array<string>, need int")
    de = spark.createDataFrame(e, "eid string, t long, w array<string>")
    assert len(want) > 20
    for near, far in ((2, 16), (16, 2048), (1, 0)):
        assert {r["qid"]: (r["eid"], r["t"]) for r in joins.first_sharing(dq, de, near, far).collect()} == want
    assert joins.first_sharing(dq, de.limit(0)).count() == 0


def test_earliest_after_by_frequent_words_and_whole_text(spark, tmp_path):
    rows = [dict(seq=i, id=f"e{i:03}", at_ts=at(i), title="ledger window") for i in range(70)]
    rows += [dict(seq=100, id="q1", entry_type="question", at_ts=at(10), title="ledger window"), dict(seq=101, id="q2", entry_type="question", at_ts=at(60), text="where does the cobalt anchor hang"), dict(seq=102, id="a2", at_ts=at(80), title="hook", learning="the anchor is of cobalt")]
    d = on_disk(spark, tmp_path, world_log=log_of(spark, rows))
    got = {r["id"]: r["closed_by"] for r in relational.joi8_earliest_after(spark, d).collect()}
    assert got == {"q1": "e011", "q2": "a2"}


def plain_term_graph(docs, least=3, cap=0.5, floor=0.05, neighbours=6, terms=40, share=0.5, overlap=0.8):
    df = Counter(t for w in docs.values() for t in w)
    ok = {t for t, n in df.items() if least <= n <= max(least, int(len(docs) * share))}
    used = {k: sorted([t for t in w if t in ok][:terms]) for k, w in docs.items()}
    used = {k: w for k, w in used.items() if w}
    one, pair = Counter(t for w in used.values() for t in w), Counter(p for w in used.values() for p in combinations(w, 2))
    out, total = {}, len(used)
    for (x, y), n in pair.items():
        if n < least or n == total:
            continue
        weight = round(min(cap, cap * math.log(n / total / (one[x] / total * one[y] / total)) / -math.log(n / total)), 6)
        taken = []
        for k in sorted(used):
            if x in used[k] and y in used[k]:
                s = set(docs[k])
                if not any(len(s & r) >= overlap * max(len(s), len(r)) for r in taken):
                    taken.append(s)
        if weight >= floor and len(taken) >= least:
            out.setdefault(x, []).append((-weight, y))
            out.setdefault(y, []).append((-weight, x))
    return sorted((t, y, -w) for t, v in out.items() for w, y in sorted(v)[:neighbours])


def rounded(rows):
    return sorted((r["term"], r["neighbour"], round(r["weight"], 5)) for r in rows)


def test_term_graph_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "uvwxyz"]
    docs = {}
    for k in range(120):
        base = rng.randrange(4) * 12
        docs[k] = list(dict.fromkeys([words[base + rng.randrange(12)] for _ in range(8)] + [words[rng.randrange(48)] for _ in range(2)]))
        if k % 10 == 0:
            docs[k] += ["copied", "notice", "pqrs"[k // 10 % 4] + "only"]
    for k in range(120, 150):  # near copies: only one of them counts
        docs[k] = [*words[:9], "stamped", "carbon"]
    df = spark.createDataFrame(list(docs.items()), "k long, w array<string>")
    for terms, neighbours in ((40, 6), (5, 3)):
        want = plain_term_graph(docs, terms=terms, neighbours=neighbours)
        got = rounded(ranking.term_graph(df, terms=terms, neighbours=neighbours).collect())
        assert got == sorted((a, b, round(w, 5)) for a, b, w in want)
    assert not any("carbon" in r and "stamped" in r for r in got) and len(got) > 30


def test_term_graph_keeps_frequent_terms_of_whole_entries(spark, tmp_path):
    rows = [dict(seq=i, id=f"e{i}", title=f"entry {i}", text=f"{'ledger window' if i % 2 else 'anchor cobalt'} {'north' if i % 4 < 2 else 'south'} alpha{chr(97 + i % 26)} beta{chr(97 + i // 26 % 26)} gamma{chr(97 + i % 7)}") for i in range(640)]
    d = on_disk(spark, tmp_path, world_log=log_of(spark, rows))
    got = {(r["term"], r["neighbour"]) for r in aggregates.agg33_term_graph(spark, d).collect()}
    assert {("ledger", "window"), ("window", "ledger"), ("anchor", "cobalt")} <= got


def test_gap_sweep_of_misses(spark, tmp_path):
    from datetime import timedelta

    log = log_of(spark, [dict(seq=1, id="before", at_ts=at(0), title="cobalt anchor"), dict(seq=2, id="after", at_ts=at(50), text="an anchor of cobalt"), dict(seq=3, id="one", at_ts=at(60), title="lantern")])
    m = [(1, "question", "too-weak", "s1", 10), (2, "question", "empty", "s2", 10), (3, "question", "too-weak", "s3", 10), (4, "question", "too-weak", "s4", 10), (5, "question", "too-weak", "s5", 10), (6, "question", "too-weak", "s6", 10), (7, "question", None, "s1", 10), (8, "before-edit", "too-weak", "s1", 10), (9, "question", "too-weak", "s9", 10), (10, "question", "too-weak", "s10", 55)]
    journal = spark.createDataFrame([(i, o, r, s, at(h), 5 if r is None else 0) for i, o, r, s, h in m], "journal_id long, occasion string, reason string, session_id string, ts timestamp, hits int")
    said = [
        ("s1", "user", "where is the cobalt anchor", 10, 2),
        ("s2", "user", "harbour ledger", 10, 2), ("s2", "assistant", "the ledger says nothing of a harbour", 11, 0),
        ("s3", "user", "quartz ferry", 10, 2), ("s3", "user", "quartz ferry", 12, 0), ("s3", "assistant", "done", 12, 5),
        ("s4", "assistant", "cobalt anchor", 10, 1), ("s4", "user", "cobalt anchor", 10, 20),
        ("s5", "user", "quartz ferry", 10, 2), ("s5", "assistant", "I don't know", 11, 0),
        ("s6", "user", "lantern", 10, 2), ("s9", "user", "a to of", 10, 2), ("s10", "user", "cobalt anchor", 55, 1),
    ]
    lines = spark.createDataFrame([(i, s, at(h) + timedelta(seconds=x), None, (role, text)) for i, (s, role, text, h, x) in enumerate(said)], "line_id long, session_id string, ts timestamp, line_type string, message struct<role:string,content:string>")
    d = on_disk(spark, tmp_path, world_log=log, journal=journal, capture_lines=lines)
    got = {r["journal_id"]: r["state"] for r in folds.sta14_gap_sweep(spark, d).collect()}
    assert got == {1: "closed", 2: "open", 3: "noise", 4: "unknown", 5: "open", 6: "closed", 9: "unknown", 10: "noise"}


def test_expansion_by_the_term_graph(spark, tmp_path):
    fill = lambda i: f"alpha{chr(97 + i % 26)} beta{chr(97 + i * 7 % 26)} gamma{chr(97 + i * 11 % 26)}"
    rows = [dict(seq=i, id=f"e{i}", title=("budget limit ledger " if i % 5 == 0 else "") + fill(i), tags=["cursor", "tagged"] if i % 3 == 0 else ["other"]) for i in range(60)]
    items = spark.createDataFrame([(1, "a budget"), (2, "budget and ledger"), (3, "cursor")], "item_id long, text string")
    d = on_disk(spark, tmp_path, world_log=log_of(spark, rows), eval_items=items)
    got = {(r["item_id"], r["term"]): r["weight"] for r in ranked.rnk2_expansion(spark, d).collect()}
    assert got[1, "limit"] == got[2, "limit"] == 0.6 and 0.05 <= got[1, "ledger"] <= 0.5
    assert (2, "ledger") not in got and (2, "budget") not in got
    assert got[3, "pointer"] == 0.6 and 0.05 <= got[3, "tagged"] <= 0.5


def test_mmr_picks_from_a_hundred(spark, tmp_path):
    v = [(0, [0.1, 0.0])] + [(20 * i + 1, [0.6 - i * 1e-5, 0.0]) for i in range(60)] + [(7, [0.1, 0.52])]
    d = on_disk(spark, tmp_path, embeddings=spark.createDataFrame(v, "vec_id long, embedding array<double>"))
    got = {r["place"]: r["doc_id"] for r in ranked.win9_mmr(spark, d).collect()}
    assert len(got) == 10 and got[2] == 7


def test_overlapping_sets_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    draw = lambda n: sorted({f"w{min(89, int(rng.expovariate(0.06)))}" for _ in range(n)})
    sets = {f"k{i:03}": draw(rng.choice((1, 2, 4, 7, 9, 12, 40, 90))) for i in range(160)}
    sets |= {f"c{i:03}": ["w1", "w2", "w5"] for i in range(9)} | {f"o{i}": ["only", "here"] for i in range(3)} | {"n": [], "m": None, "x": ["lone", "words"]}
    want = {}
    for (a, v), (b, w) in combinations(sorted(sets.items()), 2):
        s = len(set(v or []) & set(w or []))
        if s >= 2 and s / (len(v) + len(w) - s) >= 0.25:
            want[a, b] = (s, round(s / (len(v) + len(w) - s), 6))
    df = spark.createDataFrame(list(sets.items()), "k string, w array<string>")
    assert len(want) > 1000 and ("o0", "o2") in want
    for together, carried, hot in ((64, 64, 1 << 13), (2, 8, 16), (64, 12, 1 << 13), (1, 1000, 7)):
        for name, value in (("TOGETHER", together), ("CARRIED", carried), ("HOT", hot)):
            monkeypatch.setattr(joins, name, value)
        got = joins.overlapping_sets(df, "k", "w").collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): (r["shared"], r["jaccard"]) for r in got} == want
    assert joins.overlapping_sets(df.limit(0), "k", "w").count() == 0


def test_overlapping_sets_do_not_shuffle_pairs(spark, tmp_path):
    rows = [dict(seq=i, id=f"e{i:03}", entry_type="decision", title=f"north{i % 5} south{i % 7} west{i % 9}word", choice=f"anchor cobalt{i % 11}") for i in range(600)]
    d = on_disk(spark, tmp_path, world_log=log_of(spark, rows))
    sc = spark.sparkContext

    def shuffled() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    as_on_large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in as_on_large.items():
            spark.conf.set(k, v)
        before = shuffled()
        n = relational.joi10_set_overlap(spark, d).count()
        moved = shuffled() - before
    finally:
        for k in as_on_large:
            spark.conf.unset(k)
    assert n > 20_000 and moved < n
