import random
from itertools import combinations

from logweave.llm import near_duplicates as nd

LOG = "seq long, id string, title string, text string, learning string, replaces_id string, retires_id string, sig string, body string"


def test_all_pairs_against_brute_force(spark):
    g = random.Random(5)
    base = [[g.randrange(500) for _ in range(g.randint(3, 40))] for _ in range(30)]
    sets = {}
    for i in range(200):
        s = list(g.choice(base))
        for _ in range(g.randint(0, 12)):
            s[g.randrange(len(s))] = g.randrange(500)
        sets[f"i{i}"] = set(s)
    sets |= {"copy1": set(sets["i0"]), "copy2": set(sets["i0"])}
    docs = spark.createDataFrame([(k, list(v)) for k, v in sets.items()] + [("e", []), ("n", None)], "id string, sig array<bigint>")
    for t in (0.5, 0.6, 0.8):
        want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
        members, pairs = nd.similar_pairs(docs, t)
        assert {(r.id_a, r.id_b) for r in nd.expand_pairs(members, pairs).collect()} == want
        assert {r.id for r in members.collect()} == set(sets)


def test_entries(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [
        (1, "a", words, None, None, None, None), (2, "a", words, None, None, None, None), (3, "b", None, words.upper() + "!", None, None, None), (4, "c", "one two three four", "five six seven", "eight nine ten eleven twelve THIRTEEN", None, None),
        (5, "d", words, None, None, "a", None), (6, "e", "one two three", None, None, None, None), (7, "f", None, None, None, None, None), (8, None, words, None, None, None, None), (9, "g", words + " fourteen", "", None, None, None),
    ]
    log = spark.createDataFrame([(*r, "x", "y") for r in rows], LOG)
    members, pairs = nd.near_duplicate_entries(log)
    found = sorted((r.id_a, r.id_b) for r in nd.expand_pairs(members, pairs).collect())
    assert found == [("a", "b"), ("a", "c"), ("a", "g"), ("b", "c"), ("b", "g"), ("c", "g")]
    g = {r.id: (r.class_id, r.group_id, r.links) for r in nd.groups(members, pairs).collect()}
    assert g == {"a": ("a", "a", 1), "b": ("a", "a", 1), "c": ("a", "a", 1), "g": ("g", "a", 1)}


def test_empty(spark):
    members, pairs = nd.near_duplicate_entries(spark.createDataFrame([], LOG))
    assert members.count() == pairs.count() == nd.expand_pairs(members, pairs).count() == 0


def test_shingles(spark):
    df = spark.createDataFrame([(1, "a b c a b c"), (2, "a"), (3, ""), (4, None), (5, "c a b"), (6, "b c a b c")], "id int, text string").coalesce(1)
    got = {r.id: r.sig for r in nd.shingle_sets(df, 3).collect()}
    assert {k: len(v) for k, v in got.items()} == {"1": 3, "2": 0, "3": 0, "4": 0, "5": 1, "6": 3}
    assert set(got["5"]) < set(got["1"]) == set(got["6"])


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 7)
    test_all_pairs_against_brute_force(spark)
