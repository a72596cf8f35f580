import os
from fractions import Fraction

import pytest

from logweave.llm import mixing as mx

vocabulary = pytest.mark.skipif(not os.path.exists(mx.VOCABULARY), reason="no vocabulary files")


def test_schedule_stays_within_a_block():
    for w in ([5, 3, 2], [1, 1, 1], [97, 2, 1], [50, 50], [1]):
        weights = {f"s{i}": Fraction(x, sum(w)) for i, x in enumerate(w)}
        seen = dict.fromkeys(weights, 0)
        for t, s in enumerate(mx.edf_schedule(weights, 400), 1):
            seen[s] += 1
            assert all(abs(n - weights[k] * t) < 1 for k, n in seen.items())


def test_sizes():
    assert mx.plan_sizes({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3)}) == (60, {"a": Fraction(1, 2), "b": Fraction(1, 2)})
    assert mx.plan_sizes({"a": 100}, {"a": (0.2, 2), "b": (0.8, 2)}) == (200, {"a": Fraction(1)})
    assert mx.plan_sizes({}, {"a": (1.0, 1)}) == (0, {})
    assert mx.plan_sizes({"a": 100}, {"a": (1.0, 1)}, total=30)[0] == 30


@vocabulary
def test_mix(spark):
    docs = [(i, f"the timer {i} was sealed again " * (1 + i % 7), s, "x") for i, s in enumerate(["big"] * 400 + [" SMALL "] * 12 + ["other"] * 60 + [None, "unknown"])]
    docs += [(900, None, "big", "x"), (901, "", "big", "x"), (None, "x", "big", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.1, 4), ("other", 0.3, 2), ("absent", 0.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    mix = mx.mix_sources(d, t).cache()
    rows = mix.collect()
    shares = {r.source: r for r in mx.mix_shares(mix, t).collect()}
    assert set(shares) == {"big", "small", "other", "absent"} and shares["absent"].actual_share == 0
    longest, whole = max(r.tokens for r in rows), sum(r.tokens for r in rows)
    for s, share in (("big", 0.6), ("small", 0.1), ("other", 0.3)):
        assert abs(shares[s].tokens - share * whole) <= 3 * longest and shares[s].most_repeats <= shares[s].max_repeat
    assert len({(r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    for r in (r for r in rows if r.repeat_no > 1):
        assert any(x.doc_id == r.doc_id and x.repeat_no == r.repeat_no - 1 for x in rows)
    got, block = dict.fromkeys(("big", "small", "other"), 0), whole / (max(r.block_no for r in rows) + 1)
    for n in sorted({r.block_no for r in rows}):
        for r in rows:
            if r.block_no == n:
                got[r.source] += r.tokens
        assert all(abs(got[s] - w * sum(got.values())) < block + 2 * longest for s, w in (("big", 0.6), ("small", 0.1), ("other", 0.3)))


@vocabulary
def test_tokens_and_empty(spark):
    d = spark.createDataFrame([(1, "hello world", " A "), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.source, r.tokens) for r in mx.count_tokens(d).collect()) == [(1, "a", 2), (2, "a", 0)]
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    assert mx.mix_sources(d.limit(0), t).count() == 0
    assert mx.mix_shares(mx.mix_sources(d, t.limit(0)), t).collect()[0].actual_share is None


def test_running_sums(spark):
    rows = [(i, "k" if i % 3 else "h", i % 5) for i in range(300)]
    got = mx.number(spark.createDataFrame(rows, "id long, key string, n long"), "key", "id", "n").collect()
    for key in "kh":
        own = sorted((r for r in got if r.key == key and r.n), key=lambda r: r.upto)
        at = 0
        for r in own:
            assert r.upto == at
            at += r.n
