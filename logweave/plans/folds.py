"""Queries over graphs and state folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import text as tx
from logweave.functions.dates import iso
from logweave.operators import graph, joins, quality, state
from logweave.operators.change_feed import replay_feed, resolve_roots
from logweave.operators.components import connected_components
from logweave.plans import relational
from logweave.plans.registry import NOW, NOW_SQL, query
from logweave.plans.relational import _CW, _FIRST, entry_words, log
from logweave.session import cut
from logweave.sources import captures
from logweave.sources.tables import table

_NODES = f"{_FIRST}, n AS (SELECT id, coalesce(replaces_id, retires_id) AS parent, seq, at_ts, entry_type, agent, status, replaces_id, retires_id, topic, world FROM first)"
_CHAIN = f"WITH RECURSIVE {_NODES}, c AS (SELECT id, id AS root, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, c.root, c.depth + 1 FROM n JOIN c ON n.parent = c.id WHERE c.depth < 64)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return quality.first_lines(log(spark, d)).withColumn("parent", F.coalesce("replaces_id", "retires_id"))


@query(_CHAIN + " SELECT id, root FROM c")
def grf1_correction_chain(spark: SparkSession, d: str) -> DataFrame:
    return resolve_roots(nodes(spark, d).select("id", "parent"))


@query(_CHAIN + """, m AS (SELECT n.id FROM n WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n x WHERE x.id = n.parent)), b AS (SELECT id FROM m UNION ALL SELECT n.id FROM n JOIN b ON n.parent = b.id)
SELECT 'missing' AS finding, count(*) AS n FROM m UNION ALL SELECT 'forks', count(*) FROM (SELECT parent FROM n WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > 1)
UNION ALL SELECT 'cyclic', count(*) FROM n WHERE id NOT IN (SELECT id FROM c) AND id NOT IN (SELECT id FROM b) UNION ALL SELECT 'depth', max(depth) FROM c""")
def grf2_replacement_audit(spark: SparkSession, d: str) -> DataFrame:
    return graph.audit(nodes(spark, d).select("id", "parent"))


@query("SELECT DISTINCT id AS src, replaces_id AS dst, 'replaces' AS kind FROM world_log WHERE replaces_id IS NOT NULL AND id IS NOT NULL UNION SELECT DISTINCT id, retires_id, 'retires' FROM world_log WHERE retires_id IS NOT NULL AND id IS NOT NULL")
def grf3_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(log(spark, d))


@query()
def grf4_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers of corrections: an entry lies below what it corrects."""
    return graph.layers(graph.edges(log(spark, d)).filter("kind = 'replaces'").select(F.col("dst").alias("a"), F.col("src").alias("b")))


@query("SELECT dst, count(*) AS links, string_agg(src, ',' ORDER BY src) AS sources FROM (SELECT DISTINCT id AS src, replaces_id AS dst FROM world_log WHERE replaces_id IS NOT NULL AND id IS NOT NULL UNION ALL SELECT DISTINCT id, retires_id FROM world_log WHERE retires_id IS NOT NULL AND id IS NOT NULL) GROUP BY dst")
def grf5_back_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(log(spark, d)).groupBy("dst").agg(F.count(F.lit(1)).alias("links"), F.array_join(F.array_sort(F.collect_list("src")), ",").alias("sources"))


@query()
def grf6_components(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose titles differ by one word: they share a title with one word left out."""
    e = quality.first_lines(log(spark, d)).filter("title is not null").select("id", F.array_sort(tx.content_words(F.col("title"))).alias("w")).filter("size(w) >= 3")
    out = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.xxhash64(F.concat_ws(",", F.slice("w", F.lit(1), i - 1), F.slice("w", i + 1, F.size("w")))))
    keys = e.select("id", F.explode(F.concat(F.array(F.xxhash64(F.concat_ws(",", "w"))), out)).alias("k")).distinct()
    star = keys.groupBy("k").agg(F.min("id").alias("a"))
    return connected_components(keys.join(star, "k").select("a", F.col("id").alias("b")))


@query("WITH e AS (SELECT DISTINCT id AS src, coalesce(replaces_id, retires_id) AS dst FROM world_log WHERE coalesce(replaces_id, retires_id) IS NOT NULL AND id IS NOT NULL), i AS (SELECT DISTINCT id FROM world_log) SELECT i.id, (SELECT count(*) FROM e WHERE e.src = i.id) AS outgoing, (SELECT count(*) FROM e WHERE e.dst = i.id) AS incoming, (SELECT count(*) FROM e WHERE e.src = i.id AND e.dst NOT IN (SELECT id FROM i)) AS dangling FROM i")
def grf7_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges(log(spark, d)).select("src", "dst").distinct()
    ids = log(spark, d).select("id").filter("id is not null").distinct()
    known = e.join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("ok")), "dst", "left")
    o = known.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"), F.count_if(F.col("ok").isNull()).alias("dangling"))
    i = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("incoming"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ids.join(o, "id", "left").join(i, "id", "left").select("id", z("outgoing"), z("incoming"), z("dangling"))


@query(f"""WITH i AS (SELECT DISTINCT id AS k, unnest({_CW.format("concat_ws(' ', title, topic)")}) AS f FROM (SELECT * FROM world_log WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)), df AS (SELECT f, count(*) AS df FROM i GROUP BY f HAVING count(*) BETWEEN 2 AND 12), n AS (SELECT count(DISTINCT id) AS n FROM world_log)
SELECT a.k AS a, b.k AS b, CASE WHEN round(sum(ln(n / df::DOUBLE)), 6) >= 12 THEN 'auto' WHEN round(sum(ln(n / df::DOUBLE)), 6) >= 5.5 THEN 'borderline' ELSE 'dropped' END AS tier FROM i a JOIN df ON df.f = a.f JOIN i b ON b.f = a.f AND a.k < b.k, n GROUP BY 1, 2""")
def grf8_derived_links(spark: SparkSession, d: str) -> DataFrame:
    f = quality.first_lines(log(spark, d))
    i = f.select("id", F.explode(tx.content_words(F.concat_ws(" ", "title", "topic"))).alias("f")).distinct()
    p = joins.shared_features(i, "id", "f", 12, f.count())
    return p.select("a", "b", joins.tier_of(F.col("strength")).alias("tier"))


# ---- state

_TIER = "CASE split_part(agent, ':', 1) WHEN 'user' THEN 0 WHEN 'system' THEN 1 WHEN 'agent' THEN 2 WHEN 'external' THEN 3 WHEN 'inferred' THEN 4 ELSE 5 END"
_VERDICT = f"""WITH {_FIRST}, t AS (SELECT *, CASE WHEN agent IS NULL THEN 5 ELSE 2 + (length(agent) % 3) END AS tier FROM first), l AS (SELECT c.id, c.seq, x.id AS target, c.retires_id IS NOT NULL AS retires, CASE WHEN x.id IS NULL THEN 'unresolved' WHEN c.agent = x.agent OR (CASE WHEN c.retires_id IS NULL THEN c.tier < x.tier ELSE c.tier <= x.tier END) THEN 'allowed' ELSE 'refused' END AS verdict
 FROM t c LEFT JOIN t x ON x.id = coalesce(c.replaces_id, c.retires_id) WHERE coalesce(c.replaces_id, c.retires_id) IS NOT NULL)"""


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every state line with its verdict. Tiers stand in: agents have one of three by their name's length."""
    f = quality.first_lines(log(spark, d))
    names = F.array(*(F.lit(t) for t in state.TIERS))
    tier = F.when(F.col("agent").isNull(), "unknown").otherwise(F.get(names, (2 + F.length("agent") % 3)))
    f = f.withColumn("tier", tier)
    x = f.select(F.col("id").alias("target"), F.col("agent").alias("x_agent"), F.col("tier").alias("x_tier"))
    c = f.withColumn("ptr", F.coalesce("replaces_id", "retires_id")).filter("ptr is not null")
    j = c.join(x, F.col("ptr") == F.col("target"), "left")
    return j.select("id", "seq", "target", F.col("retires_id").isNotNull().alias("retires"), state.may_change(F.col("agent"), F.col("tier"), F.col("x_agent"), F.col("x_tier"), F.col("retires_id").isNull()).alias("verdict"))


@query(_VERDICT + " SELECT target AS id, arg_max(id, seq) FILTER (verdict = 'allowed') AS by_id, count(*) FILTER (verdict = 'refused') AS refused FROM l WHERE target IS NOT NULL GROUP BY target")
def sta1_retirement_fold(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d).filter("target is not null")
    last = F.max(F.when(F.col("verdict") == "allowed", F.struct("seq", "id")))["id"]
    return v.groupBy(F.col("target").alias("id")).agg(last.alias("by_id"), F.count_if(F.col("verdict") == "refused").alias("refused"))


@query(_VERDICT + " SELECT id, verdict FROM l")
def sta2_authority(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).select("id", "verdict")


_HELD = f"""{_CHAIN}, e AS (SELECT c.root, n.*, n.retires_id IS NOT NULL OR coalesce(lower(trim(n.status)) IN ('done', 'discarded', 'obsolete', 'withdrawn'), false) AS closes FROM n JOIN c USING (id) WHERE n.at_ts IS NOT NULL),
 z AS (SELECT root, arg_max(closes, (at_ts, seq)) AS closed, arg_max(id, (at_ts, seq)) AS head, min(at_ts) AS since, count(*) AS lines FROM e GROUP BY root)"""


def chains(spark: SparkSession, d: str) -> DataFrame:
    """``(root, closed, head, since, lines)`` of every entry's chain, plus its type."""
    n = nodes(spark, d)
    closes = F.col("retires_id").isNotNull() | F.coalesce(F.lower(F.trim("status")).isin(*state.CLOSING), F.lit(False))
    e = n.filter("at_ts is not null").join(resolve_roots(n.select("id", "parent")), "id").withColumn("closes", closes)
    last = F.max(F.struct("at_ts", "seq", "closes", "id"))
    z = e.groupBy("root").agg(last.alias("l"), F.min("at_ts").alias("since"), F.count(F.lit(1)).alias("lines"))
    return z.select("root", F.col("l.closes").alias("closed"), F.col("l.id").alias("head"), "since", "lines")


@query(_HELD + " SELECT z.root, z.head, epoch_us(z.since) AS since_us FROM z JOIN first f ON f.id = z.root WHERE f.entry_type = 'duty' AND NOT closed")
def sta3_open_duties(spark: SparkSession, d: str) -> DataFrame:
    duty = quality.first_lines(log(spark, d)).filter("entry_type = 'duty'").select(F.col("id").alias("root"))
    return chains(spark, d).filter("not closed").join(duty, "root", "left_semi").select("root", "head", F.unix_micros("since").alias("since_us"))


@query(_HELD + " SELECT z.root, CASE WHEN closed THEN 'closed' WHEN lines > 1 THEN 'waiting' ELSE 'open' END AS state FROM z")
def sta4_question_state(spark: SparkSession, d: str) -> DataFrame:
    return chains(spark, d).select("root", F.when(F.col("closed"), "closed").when(F.col("lines") > 1, "waiting").otherwise("open").alias("state"))


def lease_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as lease lines: a key is claimed, renewed, finished or failed by users."""
    kinds = F.array(*(F.lit(x) for x in ("claim", "renew", "done", "failed", "claim")))
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % 500).alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), (F.col("user_id") % 3).cast("string").alias("who"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"))


@query()
def sta5_lease_fold(spark: SparkSession, d: str) -> DataFrame:
    return state.fold_leases(lease_events(spark, d), 6 * 3600)


@query("""WITH m AS (SELECT session_id AS k, journal_id, ts, coalesce(reason, 'shown') AS state FROM journal WHERE ts IS NOT NULL AND session_id IS NOT NULL), p AS (SELECT *, lag(state) OVER (PARTITION BY k ORDER BY ts, journal_id) AS prior FROM m)
SELECT k, arg_max(state, (ts, journal_id)) AS state, count(*) FILTER (prior = state) AS conflicts FROM p GROUP BY k""")
def sta6_message_state(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "journal").filter("ts is not null and session_id is not null").select(F.col("session_id").alias("k"), "journal_id", "ts", F.coalesce("reason", F.lit("shown")).alias("state"))
    m = m.withColumn("prior", F.lag("state").over(Window.partitionBy("k").orderBy("ts", "journal_id")))
    return m.groupBy("k").agg(F.max(F.struct("ts", "journal_id", "state"))["state"].alias("state"), F.count_if(F.col("prior") == F.col("state")).alias("conflicts"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE + (7 * unnest(range(0, 8)))::INT AS day FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, day ORDER BY o_orderkey) AS n FROM s WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31')
SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS day, CASE WHEN n > 1 THEN 'held' ELSE 'due' END AS state FROM w""")
def sta7_appointments(spark: SparkSession, d: str) -> DataFrame:
    from logweave.functions.dates import occurrences

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.explode(occurrences(F.to_date("o_orderdate"), F.lit("weekly"), 8)).alias("day"))
    o = o.filter(F.col("day").between("1996-01-01", "1996-12-31")).withColumn("n", F.row_number().over(Window.partitionBy("o_custkey", "day").orderBy("o_orderkey")))
    return o.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(F.col("n") > 1, "held").otherwise("due").alias("state"))


@query(f"{_CHAIN}, s AS (SELECT c.root, lower(trim(n.status)) AS status, n.seq FROM n JOIN c USING (id) WHERE n.status IS NOT NULL) SELECT root, arg_max(status, seq) AS status FROM s GROUP BY root")
def sta8_rule_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    s = n.filter("status is not null").join(resolve_roots(n.select("id", "parent")), "id")
    return s.groupBy("root").agg(F.max(F.struct("seq", F.lower(F.trim("status")).alias("s")))["s"].alias("status"))


_ACCOUNT = f"WITH {_FIRST} SELECT split_part(topic, '/', 1) AS scope, count(*) FILTER (entry_type = 'error') AS errors, count(*) FILTER (replaces_id IS NOT NULL) AS fixes, count(*) FILTER (entry_type = 'learning') AS learnings, count(*) FILTER (retires_id IS NOT NULL) AS contradictions, count(*) FILTER (entry_type = 'error' AND at_ts >= TIMESTAMPTZ '2026-03-02 00:00:00+00') >= 2 AS due FROM first WHERE topic IS NOT NULL GROUP BY 1"


@query(_ACCOUNT)
def sta9_experience_account(spark: SparkSession, d: str) -> DataFrame:
    return account(spark, d)


def account(spark: SparkSession, d: str) -> DataFrame:
    f = quality.first_lines(log(spark, d)).filter("topic is not null").groupBy(F.split_part("topic", F.lit("/"), F.lit(1)).alias("scope"))
    err = F.col("entry_type") == "error"
    return f.agg(F.count_if(err).alias("errors"), F.count_if(F.col("replaces_id").isNotNull()).alias("fixes"), F.count_if(F.col("entry_type") == "learning").alias("learnings"), F.count_if(F.col("retires_id").isNotNull()).alias("contradictions"), (F.count_if(err & (F.col("at_ts") >= iso("2026-03-02"))) >= 2).alias("due"))


@query(f"WITH a AS ({_ACCOUNT}) SELECT scope, errors + fixes + learnings + contradictions AS points, (errors > 0)::INT + (fixes > 0)::INT + (learnings > 0)::INT + (contradictions > 0)::INT AS kinds FROM a WHERE errors + fixes + learnings + contradictions >= 3 AND (errors > 0)::INT + (fixes > 0)::INT + (learnings > 0)::INT + (contradictions > 0)::INT >= 2")
def sta10_sharpening(spark: SparkSession, d: str) -> DataFrame:
    names = ("errors", "fixes", "learnings", "contradictions")
    points, kinds = sum(F.col(n) for n in names), sum((F.col(n) > 0).cast("int") for n in names)
    return account(spark, d).select("scope", points.alias("points"), kinds.alias("kinds")).filter("points >= 3 and kinds >= 2")


@query()
def sta11_hash_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each writer's lines of a day as one seal: a running SHA-256. A day bounds what is hashed in one row."""
    e = log(spark, d).filter("agent is not null and at_ts is not null").select("agent", F.to_date("at_ts").alias("day"), "seq", F.concat_ws("|", "id", "title").alias("line"))
    g = e.groupBy("agent", "day").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return g.select("agent", "day", F.size("l").alias("lines"), state.chain_hash(F.transform("l", lambda x: x["line"])).alias("seal"))


@query("SELECT topic, arg_max(status, (CASE lower(trim(status)) WHEN 'confirmed' THEN 1 ELSE 0 END, seq)) AS status FROM (SELECT topic, lower(trim(status)) AS status, seq FROM world_log WHERE topic IS NOT NULL AND status IS NOT NULL) GROUP BY topic")
def sta12_category_fold(spark: SparkSession, d: str) -> DataFrame:
    s = log(spark, d).filter("topic is not null and status is not null").select("topic", "seq", F.lower(F.trim("status")).alias("s"))
    return s.groupBy("topic").agg(F.max(F.struct((F.col("s") == "confirmed").cast("int"), "seq", "s"))["s"].alias("status"))


@query("WITH s AS (SELECT session_id, count(*) AS n, max(ts) AS last, min(ts) AS first FROM capture_lines WHERE session_id IS NOT NULL GROUP BY 1) SELECT session_id, CASE WHEN n >= 20 THEN 'volume' WHEN last < TIMESTAMPTZ '2026-03-31 23:15:00+00' THEN 'quiet' WHEN first < TIMESTAMPTZ '2026-03-31 16:00:00+00' THEN 'ceiling' ELSE 'wait' END AS due FROM s")
def sta13_digest_due(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "capture_lines").filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.min("ts").alias("first"))
    return s.select("session_id", F.when(F.col("n") >= 20, "volume").when(F.col("last") < iso("2026-03-31 23:15:00"), "quiet").when(F.col("first") < iso("2026-03-31 16:00:00"), "ceiling").otherwise("wait").alias("due"))


@query(rf"""WITH {relational.ENTRY_WORDS_SQL}, m AS (SELECT journal_id, session_id AS k, epoch_us(ts) AS t FROM journal WHERE occasion = 'question' AND reason IN ('too-weak', 'empty')),
 l AS (SELECT line_id, session_id AS k, epoch_us(ts) AS t, message.content AS text, {relational._USER} AS person, coalesce(lower(trim(line_type)) IN ('summary', 'attachment', 'system', 'tool_result'), false) AS machine FROM capture_lines WHERE session_id IS NOT NULL),
 near AS (SELECT journal_id, line_id FROM m JOIN l USING (k) WHERE person AND abs(m.t - l.t) <= 15000000 QUALIFY row_number() OVER (PARTITION BY journal_id ORDER BY abs(m.t - l.t), line_id) = 1),
 a AS (SELECT m.*, l.text AS asked, {relational._CW.format('l.text')} AS w FROM m JOIN near USING (journal_id) JOIN l USING (line_id)), a2 AS (SELECT *, least(2, len(w)) AS need FROM a WHERE len(w) > 0),
 ax AS (SELECT journal_id, t, need, unnest(w) AS x FROM a2), ex AS (SELECT id, t, unnest(w) AS x FROM ew WHERE t IS NOT NULL),
 closed AS (SELECT DISTINCT journal_id FROM (SELECT journal_id, id FROM ax JOIN ex USING (x) WHERE ex.t > ax.t GROUP BY journal_id, id, need HAVING count(*) >= need)),
 later AS (SELECT journal_id, need, w, l.text FROM a2 JOIN l ON l.k = a2.k AND l.t > a2.t WHERE journal_id NOT IN (SELECT journal_id FROM closed) AND NOT machine AND l.text IS NOT NULL AND NOT (person AND l.text = asked)),
 told AS (SELECT journal_id FROM later GROUP BY journal_id, need HAVING len(list_distinct(flatten(list(list_intersect(w, {relational._CW.format('text')}))))) >= need OR bool_or(regexp_matches(text, '(?i)\btbd\b|\bnot (?:documented|recorded|established|evidenced)\b|\bi (?:do not|don''t) know\b')))
SELECT journal_id, CASE WHEN journal_id IN (SELECT journal_id FROM closed) THEN 'closed' WHEN journal_id IN (SELECT journal_id FROM told) THEN 'open' WHEN journal_id IN (SELECT journal_id FROM a2) THEN 'noise' ELSE 'unknown' END AS state FROM m""")
def sta14_gap_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Misses only: questions whose recall was empty or too weak.

    unknown: no line of the person within 15 s, or none with words. closed: a later entry shares two of its words, or its only one.
    open: the session itself says so much, or that it does not know, after the miss. Else noise.
    """
    miss = table(spark, d, "journal").filter("occasion = 'question' and reason in ('too-weak', 'empty')").select("journal_id", F.col("session_id").alias("k"), F.unix_micros("ts").alias("t"))
    lines = table(spark, d, "capture_lines").filter("session_id is not null").select("line_id", F.col("session_id").alias("k"), F.unix_micros("ts").alias("t"), F.col("message.content").alias("text"), captures.real_user().alias("person"), captures.machine_line().alias("machine"))
    near = joins.nearest_within(miss, lines.filter("person"), "k", "journal_id", "line_id", 15_000_000).select("journal_id", "line_id")
    asked = near.join(lines.select("line_id", F.col("text").alias("asked")), "line_id").select("journal_id", "asked", tx.content_words(F.col("asked")).alias("w")).filter(F.size("w") > 0)
    asked = cut(miss.join(asked, "journal_id").withColumn("need", F.least(F.lit(2), F.size("w"))))
    closed = joins.first_sharing(asked.select(F.col("journal_id").alias("qid"), "t", "w", "need"), entry_words(spark, d).select(F.col("id").alias("eid"), "t", "w")).select(F.col("qid").alias("journal_id"))
    rest = asked.join(closed, "journal_id", "left_anti")
    later = rest.join(lines.filter("not machine and text is not null").select("k", F.col("t").alias("said"), "text", "person"), "k").filter((F.col("said") > F.col("t")) & ~(F.col("person") & (F.col("text") == F.col("asked"))))
    unproven = F.max(F.col("text").rlike(r"(?i)\btbd\b|\bnot (?:documented|recorded|established|evidenced)\b|\bi (?:do not|don't) know\b"))
    # The session's later words together, as far as they are words of the question.
    shared = F.size(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("w", tx.content_words(F.col("text")))))))
    told = later.groupBy("journal_id", "need").agg(shared.alias("shared"), unproven.alias("unproven")).filter("shared >= need or unproven").select("journal_id")
    state_of = lambda x, s: x.select("journal_id", F.lit(s).alias("s"))
    known = state_of(closed, "closed").unionByName(state_of(told, "open")).unionByName(state_of(rest.join(told, "journal_id", "left_anti"), "noise"))
    return miss.join(known, "journal_id", "left").select("journal_id", F.coalesce("s", F.lit("unknown")).alias("state"))


@query("""WITH c AS (SELECT line_id, session_id, epoch_us(ts) AS t, coalesce(lower(trim(line_type)), '?') AS kind FROM capture_lines WHERE ts IS NOT NULL), j AS (SELECT journal_id, session_id, epoch_us(ts) AS t FROM journal WHERE ts IS NOT NULL AND session_id IS NOT NULL),
 f AS (SELECT journal_id, arg_min(kind, (c.t - j.t, line_id)) AS kind FROM j JOIN c ON c.session_id = j.session_id AND c.t > j.t AND c.t <= j.t + 600000000 GROUP BY 1) SELECT journal_id, CASE WHEN kind IS NULL THEN 'nothing' WHEN kind = 'tool_result' THEN 'looked again' WHEN kind IN ('user', 'assistant') THEN 'went on' ELSE 'other' END AS verdict FROM j LEFT JOIN f USING (journal_id)""")
def sta15_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    us = lambda t, *c: table(spark, d, t).filter("session_id is not null and ts is not null").select(*c, F.col("session_id").alias("k"), F.unix_micros("ts").alias("t"))
    j, c = us("journal", "journal_id"), us("capture_lines", "line_id", F.lower(F.trim("line_type")).alias("kind"))
    f = joins.first_after(j, c, "k", "journal_id", "line_id", 600_000_000).select("journal_id", "line_id").join(c.select("line_id", F.coalesce("kind", F.lit("?")).alias("kind")), "line_id")
    v = F.when(F.col("kind").isNull(), "nothing").when(F.col("kind") == "tool_result", "looked again").when(F.col("kind").isin("user", "assistant"), "went on").otherwise("other")
    return j.select("journal_id").join(f, "journal_id", "left").select("journal_id", v.alias("verdict"))


@query("SELECT pair_id, CASE WHEN erfolg AND fehler IS NULL THEN 'confirmed' WHEN fehler IS NOT NULL OR NOT erfolg THEN 'rework' ELSE 'unknown' END AS stage FROM paar_sauber")
def sta16_job_stage(spark: SparkSession, d: str) -> DataFrame:
    ok, bad = F.col("erfolg") & F.col("fehler").isNull(), F.col("fehler").isNotNull() | ~F.col("erfolg")
    return table(spark, d, "paar_sauber").select("pair_id", F.when(ok, "confirmed").when(bad, "rework").otherwise("unknown").alias("stage"))


@query(f"""WITH {_FIRST}, s AS (SELECT replaces_id AS id, min(at_ts) AS b FROM first WHERE replaces_id IS NOT NULL AND at_ts <= TIMESTAMPTZ '2026-03-20 00:00:00+00' GROUP BY 1)
SELECT topic, arg_max(f.id, (at_ts, seq)) AS fact FROM first f LEFT JOIN s USING (id) WHERE topic IS NOT NULL AND at_ts <= TIMESTAMPTZ '2026-03-20 00:00:00+00' AND at_ts <= TIMESTAMPTZ '2026-03-15 00:00:00+00' AND (b IS NULL OR b > TIMESTAMPTZ '2026-03-15 00:00:00+00') GROUP BY topic""")
def dat15_facts_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What was known by 20 March about what held on 15 March."""
    known = state.with_validity(quality.first_lines(log(spark, d)).filter(F.col("at_ts") <= iso("2026-03-20"))).filter("topic is not null")
    held = known.filter((F.col("at_ts") <= iso("2026-03-15")) & state.valid_at(F.col("valid_from"), F.col("valid_until"), iso("2026-03-15")))
    return held.groupBy("topic").agg(F.max(F.struct("at_ts", "seq", "id"))["id"].alias("fact"))
