import random
from datetime import datetime, timedelta

from logweave.llm import conversations as c

T0 = datetime(2026, 3, 1, 12)
SCHEMA = "line_id long, path string, line int, conv_id string, ts timestamp, line_type string, message struct<role:string,content:string>, part string, t string, turn string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def at(s):
    return None if s is None else T0 + timedelta(seconds=s)


def brute(rows):
    """(conv_id, turn_no, line_id) of the conversations kept, told row by row."""
    side = {"summary", "attachment", "system", "tool_result"}
    who = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant"}
    out, convs = [], {}
    for r in rows:
        if r[3] is not None:
            convs.setdefault(r[3], []).append(r)
    for conv, own in convs.items():
        turns, bad = [], False
        for i, path, line, _, ts, kind, msg in own:
            if (kind or "").strip().lower() in side:
                continue
            said = msg and (msg[0] if msg[0] is not None else kind)
            sp = who.get((said or "").strip().lower())
            if msg is None or sp is None:
                bad = True
                continue
            if not (msg[1] or "").strip():
                continue
            t = ts
            if t is None and path is not None and line is not None:
                near = [(x[2], x[4]) for x in rows if x[1] == path and x[2] is not None and x[4] is not None and x[2] < line]
                t = max(near)[1] if near else None
            turns.append((t or datetime.min, -1 if line is None else line, i, sp, ts, msg[1]))
        keep = []
        for x in sorted(turns, key=lambda x: x[2]):
            if x[4] is None or not any(y[3:] == x[3:] for y in keep):
                keep.append(x)
        keep.sort(key=lambda x: x[:3])
        s = "".join(x[3][0] for x in keep)
        if not bad and s and s[0] == "u" and "uu" not in s and s[-1] == "a":
            out += [(conv, n, x[2]) for n, x in enumerate(keep, 1)]
    return sorted(out)


def got(spark, rows):
    return sorted((r.conv_id, r.turn_no, r.line_id) for r in c.rebuild_conversations(frame(spark, rows)).collect())


def test_rules(spark):
    u, a = ("user", "hi"), ("assistant", "yes")
    rows = [
        (1, "p", 1, "ok", at(0), "user", u), (2, "p", 2, "ok", at(1), "assistant", a), (3, "p", 3, "ok", at(1), "assistant", a), (4, "p", 4, "ok", None, "system", None), (5, "p", 5, "ok", None, "assistant", (None, "more")),
        (6, "q", 1, "noreply", at(0), "user", u), (7, "q", 2, "broken", at(0), "user", u), (8, "q", 3, "broken", at(1), "assistant", None),
        (9, "r", 1, "empty", at(0), "user", ("user", " ")), (10, "r", 2, "noq", at(1), "assistant", a), (11, "r", 3, "twice", at(2), "user", u), (12, "r", 4, "twice", at(3), "user", ("user", "again")), (13, "r", 5, "twice", at(4), "model", ("MODEL ", "x")),
        (14, "r", 6, None, at(0), "user", u), (15, "r", 7, "who", at(0), None, ("?", "x")), (16, "s", 1, "sideonly", at(0), "summary", None),
    ]
    assert got(spark, rows) == brute(rows) == [("ok", 1, 1), ("ok", 2, 2), ("ok", 3, 5)]
    v = {r.conv_id: r.verdict for r in c.conversation_verdicts(frame(spark, rows)).collect()}
    assert v == {"ok": "kept", "noreply": "no reply", "broken": "broken", "empty": "empty", "noq": "no question", "twice": "no reply", "who": "broken"}


def test_parts_of_a_long_conversation(spark, monkeypatch):
    rows = [(i, "p", i, "c", at(i * 60), "user" if i % 2 else "assistant", ("user" if i % 2 else "assistant", f"m{i}")) for i in range(1, 201)]
    monkeypatch.setattr(c, "SPAN_US", 600 * 1_000_000)
    monkeypatch.setattr(c, "PATH_BLOCK", 7)
    assert got(spark, rows) == brute(rows)
    broken = [r for r in rows if r[0] != 100]
    assert got(spark, broken) == brute(broken) == []


def test_random_against_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(c, "SPAN_US", 20 * 1_000_000)
    monkeypatch.setattr(c, "PATH_BLOCK", 3)
    for seed in range(3):
        g = random.Random(seed)
        rows = []
        for i in range(260):
            role = g.choice(["user", "assistant", "human", "ai", None, "user", "assistant"]) if g.random() > 0.01 else "?"
            kind = g.choice(["user", "assistant"]) if g.random() > 0.1 else g.choice(["system", "summary", None])
            rows.append((i, g.choice(["p", "q", "r", None]), g.randint(1, 12), f"c{g.randint(0, 60)}", at(g.randint(0, 60)) if g.random() > 0.2 else None, kind, None if g.random() < 0.02 else (role, g.choice(["a", "b", "c", " ", None]))))
        assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
