from logweave.llm import broken_pairs as bp


def frames(spark, rows):
    p = spark.createDataFrame([(*r, "x") for r in rows], "pair_id long, task_id string, antwort string, fehler string, aus_tok long, prompt string")
    t = spark.createDataFrame([("T", "What happens to the old timer after the lease is sealed?", 1), ("T", None, 1), ("D", "Was folgt daraus, wenn die Sperre nicht mehr gilt?", 1), (None, "x", 1)], "task_id string, prompt string, n int")
    return p, t


def test_each_defect(spark):
    full = "We sealed the timer so that the lease holds on slow disks."
    rows = [(i, "T", full.replace("timer", f"timer{i}"), None, 20) for i in range(100, 120)]
    rows += [
        (1, "T", None, None, None), (2, "T", " \n", None, 1), (3, "T", "n/a", None, 1), (4, "T", "…", "x", 1), (5, "T", '""', None, 1),
        (6, "T", "We sealed the timer so that the le", None, 9), (7, "T", "We sealed the timer (so the", None, 9), (8, "T", "We sealed the timer so that the lease holds on slow disks", None, 9),
        (9, "T", "- one thing.\n- ", None, 3), (10, "T", "It ran.\n\n```\nlook x --sin", "output limit reached", 3), (11, "T", "It ran.\n\n```\nlook x --since 3d\n```", None, 3),
        (12, "T", "I'm sorry, but I can't help with that.", None, 3), (13, "D", "Dazu möchte ich mich nicht äußern. Gibt es sonst noch etwas?", None, 3), (14, "T", "We decline writes without a lease. The timer holds on slow disks.", None, 3),
        (15, "T", "Question: what happens to the old timer after the lease is sealed", None, 3), (16, "T", "What happens to the old timer after the lease is sealed? Yes.", None, 3), (17, "T", "What happens to the timer after the lease is sealed?", None, 3),
        (18, "D", "We sealed the timer so that the lease holds on slow disks.", None, 3), (19, "D", "Die Sperre gilt nicht, weil der Zeiger ins Leere ging.", None, 3), (20, "missing", "Die Sperre gilt nicht.", None, 3), (21, None, None, None, 3), (None, "T", None, None, 3), (1, "T", "", None, None),
    ]
    p, t = frames(spark, rows)
    out = sorted((r.pair_id, r.defect) for r in bp.broken_pairs(p, t).collect())
    want = [(1, "empty"), (1, "empty"), (2, "empty"), (3, "empty"), (4, "empty"), (5, "empty"), (6, "truncated"), (7, "truncated"), (9, "truncated"), (10, "truncated"), (12, "refusal"), (13, "refusal"), (15, "copy"), (17, "copy"), (18, "other_language"), (21, "empty")]
    assert out == want


def test_neighbours_across_partitions(spark):
    done = [f"{a} one{b}" for a in "abcdefgh" for b in ("", " two", " three four")] + ["q", "r s"]
    open_ = [f"{a} one{b}" for a in "abcdefgh" for b in ("", " t", " three", " two five")] + ["r", "z", "a"]
    rows = [(None, True, [], [u]) for u in done * 2] + [(i, False, [u], None) for i, u in enumerate(open_ * 2)]
    got = {(r.unit, r.verdict) for r in bp.compared(spark.createDataFrame(rows, "pair_id long, done boolean, units array<string>, said array<string>").repartition(3)).collect()}

    def told(u):
        after = [x for x in done if x.startswith(u)]
        return "whole" if u in done else "alone" if not after else "after" if min(after)[len(u)] == " " else "word"

    assert got == {(u, told(u)) for u in open_}


def test_detectors_decide(spark):
    rows = [(i, "T", f"The timer number {i} ran because the old lease went on.", None, 20) for i in range(100, 130)]
    rows += [(1, "T", "The timer number 7 ran because the ol", None, 9), (2, "T", "The timer number 7 ran because the old lease went on", None, 9)]
    rows += [(i, "T", f"Pages {i} went {chr(97 + i % 26)}on", None, 64) for i in range(200, 260)] + [(i, "T", f"Pages {i} stay closed", None, 70 + i % 9) for i in range(300, 309)]
    p, t = frames(spark, rows)
    told = lambda *d: {r.pair_id for r in bp.broken_pairs(p, t, detectors=d).collect() if r.defect == "truncated"}
    assert told() == set()
    assert told("neighbours") == {1}
    assert told("limits") == set(range(200, 260))
    assert told("neighbours", "limits") == {1} | set(range(200, 260))


def test_length_limits(spark):
    rows = [(64,)] * 90 + [(n,) for n in range(50, 80) for _ in range(4)] + [(None,)] * 99
    got = [r.tokens for r in bp.length_limits(spark.createDataFrame(rows, "tokens long"), 8.0, 30).collect()]
    assert got == [64]


def test_empty(spark):
    p, t = frames(spark, [])
    assert bp.broken_pairs(p, t.limit(0)).count() == 0
