from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.functions import dates as dt
from logweave.functions import phrases as ph
from logweave.functions import maths as mt
from logweave.functions import text as tx


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").orderBy("i").select(f(F.col("c"))).collect()]


def test_stems(spark):
    got = col(spark, ["libraries", "dogs", "planned", "called", "wording", None], tx.en_stem)
    assert got == ["library", "dogs", "plan", "call", "word", None]
    assert col(spark, ["zeitungen", "haus", "freundlich", None], tx.de_stem) == ["zeit", "haus", "freund", None]
    assert col(spark, ["Größe", "übermäßig"], lambda c: tx.fold_german(F.lower(c))) == ["groesse", "uebermaessig"]


def test_words(spark):
    assert col(spark, ["The big-data a_b x, ÄÖ!", "", None], tx.raw_words) == [["the", "big-data", "a_b", "äö"], [], None]
    assert col(spark, ["big-data-of", "plain"], tx.hyphen_forms) == [["big-data-of", "big", "data"], ["plain"]]
    assert col(spark, ["Café the WORDS words some"], tx.content_words) == [["cafe", "words", "some"]]
    assert col(spark, ['a "two words" and „noch eins“ "x"'], tx.quoted_phrases) == [["two words", "noch eins"]]


def test_identifiers(spark):
    got = col(spark, ["see src/a/b.mjs and 1.2.3, v1.2.3, far-reach 2026 ENV_NAME store.write e.g."], tx.identifiers)[0]
    assert {"src/a/b.mjs", "1.2.3", "far-reach", "2026", "env_name", "store.write"} <= set(got) and "e.g" not in got


def test_redaction(spark):
    got = col(spark, ["mail a@b.example key sk-abcdefghijklmnopqrst", "nothing", None], tx.redact)
    assert got == ["mail [secret:mail] key [secret:key]", "nothing", None]
    assert col(spark, got, tx.redactions) == [2, 0, None]
    assert col(spark, ["x [secret:mail] y"], lambda c: tx.cut_masked(c, 8)) == ["x "]
    assert col(spark, ["tok12 tok1"], lambda c: tx.redact_values(c, ["tok1", "tok12"])) == ["[secret:env] [secret:env]"]


def test_names_and_topics(spark):
    df = spark.createDataFrame([("blue-kite", "blue_kite"), ("blue-kite", "bluekite"), ("kite", "kite-x"), ("abcde", "abxye"), ("abc", "xyz"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(tx.similar_reason(F.col("a"), F.col("b"))).collect()] == ["same", "compact", "part", "letters", None, None]
    t = spark.createDataFrame([("a/b", None), ("one two three four five!", None), ("p/x", "p"), (None, None)], "t string, p string")
    assert [r[0] for r in t.select(tx.topic_warnings(F.col("t"), F.col("p"))).collect()] == [[], ["punctuation", "words"], ["prefix"], []]


def test_small_texts(spark):
    assert col(spark, ["Please, why?", "why?"], tx.drop_frame) == ["why?", "why?"]
    assert col(spark, ["ok 1\nnot ok 2\nTypeError: x\n# fail 0", "fine"], tx.error_signature) == ["not ok 2\nTypeError: x", None]
    assert col(spark, ["cat > f", "cat f", "grep x", "echo", "", "git  commit -m x", "git log | head -3", "echo 'a > b'", "ls 2>&1", "tee<<'E'", "jq . x >/dev/null", "rgx", None], tx.command_kind) == ["write", "read", "search", "other", "other", "write", "read", "other", "search", "write", "read", "other", "other"]
    assert col(spark, ["{{ a }} {{b}} {{a}}", "{x}"], tx.placeholders) == [["a", "b"], []]
    assert col(spark, ["Hello, Wörld!", "a-b " * 30], tx.slug)[0] == "hello-world"
    assert col(spark, ["Übergröße straße", "Łódź, ő é š", None], tx.slug) == ["ubergrosse-strasse", "odz-o-e-s", None]
    assert all(len(x) <= 40 for x in col(spark, ["word " * 30, "x" * 99], tx.slug))


def test_language(spark):
    df = spark.createDataFrame([(3, 0), (0, 2), (3, 2), (0, 0)], "e int, d int")
    assert [r[0] for r in df.select(tx.language_of(F.col("e"), F.col("d"))).collect()] == ["en", "de", "uncertain", "uncertain"]


NOW = datetime(2026, 4, 1, 12)


@pytest.mark.parametrize("text,want", [
    ("last 2 days", (datetime(2026, 3, 30, 12), NOW)), ("yesterday", (datetime(2026, 3, 30, 22), datetime(2026, 3, 31, 22))), ("on 2026-01-05", (datetime(2026, 1, 4, 23), datetime(2026, 1, 5, 23))),
    ("monday morning", (datetime(2026, 3, 30, 4), datetime(2026, 3, 30, 10))), ("today between 9 and 11", (datetime(2026, 4, 1, 7), datetime(2026, 4, 1, 9))), ("2026-13-40", None), ("soon", None),
])
def test_windows(text, want):
    assert ph.window_for(text, NOW, "Europe/Berlin") == want


def test_dates(spark):
    due = col(spark, ["2026-07-01", "2026-07-01T10:00:00+02:00", "2026-07-01T10:00:00", "1.7.2026", None], lambda c: F.unix_seconds(dt.parse_due(c, "Europe/Berlin")))
    assert due == [1782856800, 1782892800, None, None, None]
    assert col(spark, ["90 minutes", "2h", "31 days", "0 min", "x", None], dt.duration_minutes) == [90, 120, None, None, None, None]
    assert col(spark, ["2026-01-31"], lambda c: dt.occurrences(F.to_date(c), F.lit("monthly"), 3)) == [[datetime(2026, 1, 31).date(), datetime(2026, 2, 28).date(), datetime(2026, 3, 31).date()]]
    assert col(spark, ["2026-04-03"], lambda c: dt.occurrences(F.to_date(c), F.lit("weekdays"), 2)) == [[datetime(2026, 4, 3).date(), datetime(2026, 4, 6).date()]]
    assert col(spark, ["2027-01-01"], lambda c: dt.week_key(F.to_date(c))) == ["2026-W53"]
    assert col(spark, ["see you yesterday", "it was fine", "on 2026-01-01"], ph.has_time_intent) == [True, False, True]


SEP = datetime(2026, 9, 1, 18)


@pytest.mark.parametrize("text,zone,want", [
    ("the revoked token", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("work of the last 12 hours", "UTC", (datetime(2026, 9, 1, 6), SEP)), ("last hour", "UTC", (datetime(2026, 9, 1, 17), SEP)),
    ("previous week", "UTC", None), ("last 0 days", "UTC", None), ("yesterday", "UTC", (datetime(2026, 8, 31), datetime(2026, 9, 1))), ("the day before yesterday", "UTC", (datetime(2026, 8, 30), datetime(2026, 8, 31))),
    ("yesterday afternoon", "America/New_York", (datetime(2026, 8, 31, 16), datetime(2026, 8, 31, 22))), ("between 3 and 8 pm", "UTC", (datetime(2026, 9, 1, 15), datetime(2026, 9, 1, 20))), ("anything 3-8pm", "UTC", (datetime(2026, 9, 1, 15), datetime(2026, 9, 1, 20))),
    ("yesterday 3-8pm", "UTC", (datetime(2026, 8, 31, 15), datetime(2026, 8, 31, 20))), ("from 15:00 to 20:30", "UTC", (datetime(2026, 9, 1, 15), datetime(2026, 9, 1, 20, 30))), ("on 2026-08-29 from 15:00 to 20:00", "UTC", (datetime(2026, 8, 29, 15), datetime(2026, 8, 29, 20))),
    ("evening", "UTC", (datetime(2026, 9, 1, 18), datetime(2026, 9, 2))), ("yesterday evening", "UTC", (datetime(2026, 8, 31, 18), datetime(2026, 9, 1))), ("last tuesday", "UTC", (datetime(2026, 8, 25), datetime(2026, 8, 26))), ("11 am until 12 pm", "UTC", (datetime(2026, 9, 1, 11), datetime(2026, 9, 1, 12))),
])
def test_phrases(text, zone, want):
    assert ph.window_for(text, SEP, zone) == want


OCT = datetime(2026, 10, 3, 10)  # a Saturday, noon in Berlin


@pytest.mark.parametrize("text,want", [
    ("tomorrow 9:00", "10-04 07:00"), ("tomorrow", "10-04 07:00"), ("day after tomorrow 14:30", "10-05 12:30"), ("friday 3pm", "10-09 13:00"), ("next friday 9:00", "10-09 07:00"), ("saturday 15:00", "10-03 13:00"), ("saturday 9:00", "10-10 07:00"),
    ("oct 5 9am", "10-05 07:00"), ("5 oct 2026 14:30", "10-05 12:30"), ("2026-10-25T14:30", "10-25 13:30"), ("14:30", "10-03 12:30"), ("9am", "10-04 07:00"), ("in 2 hours", "10-03 12:00"), ("in 45 minutes", "10-03 10:45"), ("in 3 days", "10-06 10:00"), ("in 4 weeks", "10-31 11:00"),
    ("12am tomorrow", "10-03 22:00"), ("tomorrow 12pm", "10-04 10:00"), ("tomorrow noon", "10-04 10:00"), ("2026-10-25 2:30", "10-25 00:30"), ("weekdays 7:00", "10-05 05:00"), ("weekly friday 15:00", "10-09 13:00"),
    *((x, None) for x in ("", None, "blah", "tomorrow banana", "2026-02-30 10:00", "25:00", "tomorrow 13pm", "in 0 minutes", "in two hours", "weekdays", "feb 30")),
])
def test_appointments(text, want):
    found = ph.appointment(text, OCT, "Europe/Berlin")
    assert (found and f"{found['at']:%m-%d %H:%M}") == want


def test_intent(spark):
    yes = ["in the last 12 hours", "Last week", "what happened yesterday", "on Friday", "between 3 and 8 pm", "from 3-8pm", "the afternoon standup", "on 2026-08-29", "since 2026-08-29 nothing", "when was it, 2026-08-29", "what did the report of 2026-08-29 say"]
    no = ["the journal shows 2026-08-29 as the day it started", "build 2026-08-29, all green", "no time word here at all", "", "previous week", "tomorrow"]
    assert col(spark, yes + no, ph.has_time_intent) == [True] * len(yes) + [False] * len(no)


def test_maths(spark):
    df = spark.createDataFrame([(5, 10), (0, 0)], "k int, n int")
    lo, hi = mt.wilson(F.col("k"), F.col("n"))
    rows = [tuple(r) for r in df.select(F.round(lo, 4), F.round(hi, 4)).collect()]
    assert rows[0] == (0.2366, 0.7634)
    assert col(spark, [[1.0, 2.0, 3.0], [7.0], []], lambda c: mt.nearest_rank(c, 50), "array<double>") == [2.0, 7.0, None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text_goes_through(spark, texts):
    fs = (tx.raw_words, tx.content_words, tx.identifiers, tx.redact, tx.error_signature, tx.slug, tx.short_form, tx.body_hash, dt.date_anchors, dt.duration_minutes, lambda c: dt.parse_due(c, "UTC"))
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert df.select(*(f(F.col("c")) for f in fs)).count() == len(texts)
    df.select(*(f(F.col("c")) for f in fs)).write.format("noop").mode("overwrite").save()
