"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import dates as dt
from logweave.functions import maths as mt
from logweave.functions import text as tx
from logweave.operators import quality, state
from logweave.operators import ranking as rk
from logweave.operators.components import connected_components
from logweave.plans.registry import NOW, NOW_SQL, query, sql_list
from logweave.plans.relational import _CW, _FIRST, log
from logweave.sources import captures
from logweave.sources.tables import table

_W = f"list_filter(regexp_split_to_array(strip_accents(lower({{}})), '[^a-z0-9_-]+'), lambda w: length(w) >= 4 AND w NOT IN ({sql_list(tx.EN_STOP)}))"
_TOPIC = "split_part(topic, '/', 1)"
DAY_US = 86_400_000_000


def journal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "journal")


def area() -> Column:
    return F.split_part("topic", F.lit("/"), F.lit(1))


@query(f"WITH w AS (SELECT DISTINCT doc_id, source, unnest({_W.format('text')}) AS term FROM documents) SELECT term, count(*) AS df, count(*) FILTER (lower(trim(source)) <> 'chat-import') AS curated_df FROM w GROUP BY term")
def agg1_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("source", F.explode(tx.content_words(F.col("text"))).alias("term"))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.lower(F.trim("source")) != "chat-import").alias("curated_df"))


@query(f"""WITH {_FIRST}, f AS (SELECT id, 3.0 AS w, title AS t FROM first UNION ALL SELECT id, 1.0, text FROM first UNION ALL SELECT id, 1.5, learning FROM first UNION ALL SELECT id, 1.2, why FROM first), e AS (SELECT id, w, unnest({_W.format('t')}) AS term FROM f WHERE t IS NOT NULL)
SELECT term, round(sum(w), 4)::DOUBLE AS weight, count(DISTINCT id) AS entries FROM e GROUP BY term""")
def agg2_weighted_terms(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(*(F.struct(F.lit(w).alias("w"), F.col(c).alias("t")) for c, w in (("title", 3.0), ("text", 1.0), ("learning", 1.5), ("why", 1.2))))
    f = quality.first_lines(log(spark, d)).select("id", F.explode(fields).alias("f")).filter("f.t is not null")
    words = F.filter(F.split(tx.strip_accents(F.lower("f.t")), r"[^a-z0-9_-]+"), lambda x: (F.length(x) >= 4) & ~x.isin(*tx.EN_STOP))
    e = f.select("id", "f.w", F.explode(words).alias("term"))
    per = e.groupBy("id", "term").agg(F.sum("w").alias("w"))
    return per.groupBy("term").agg(F.round(F.sum("w"), 4).alias("weight"), F.count(F.lit(1)).alias("entries"))


@query(f"WITH l AS (SELECT doc_id, len({_W.format('text')}) AS n FROM documents) SELECT sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, count(*) AS docs FROM l WHERE n > 0")
def agg3_corpus_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = rk.postings(table(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.sum("tf").alias("n"))
    return n.agg(F.sum("n").cast("long").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.count(F.lit(1)).alias("docs"))


@query("""WITH t AS (SELECT * FROM world_log WHERE topic IS NOT NULL), p AS (SELECT topic, project, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, project) AS rn FROM t WHERE project IS NOT NULL GROUP BY topic, project)
SELECT t.topic, count(*) AS n, epoch_us(max(at_ts)) AS last_us, count(DISTINCT entry_type) AS types, any_value(p.project) AS modal_project FROM t LEFT JOIN p ON p.topic = t.topic AND rn = 1 GROUP BY t.topic""")
def agg4_topics(spark: SparkSession, d: str) -> DataFrame:
    t = log(spark, d).filter("topic is not null")
    p = t.filter("project is not null").groupBy("topic", "project").count().groupBy("topic").agg(F.min_by("project", F.struct(-F.col("count"), "project")).alias("modal_project"))
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("at_ts")).alias("last_us"), F.countDistinct("entry_type").alias("types")).join(p, "topic", "left")


@query(f"WITH t AS (SELECT {_TOPIC} AS area, topic, count(*) AS n, epoch_us(max(at_ts)) AS last FROM world_log WHERE topic IS NOT NULL GROUP BY 1, 2) SELECT area, count(*) AS topics, sum(n)::BIGINT AS entries, max(last) AS last_us, count(*) = 1 AS orphan FROM t GROUP BY area")
def agg5_topic_tree(spark: SparkSession, d: str) -> DataFrame:
    t = log(spark, d).filter("topic is not null").groupBy(area().alias("area"), "topic").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("at_ts")).alias("last"))
    return t.groupBy("area").agg(F.count(F.lit(1)).alias("topics"), F.sum("n").alias("entries"), F.max("last").alias("last_us"), (F.count(F.lit(1)) == 1).alias("orphan"))


_TQ = "WITH t AS (SELECT topic, count(*) AS n FROM world_log WHERE topic IS NOT NULL GROUP BY topic) SELECT count(*) AS topics, round(avg(n), 6) AS per_topic, round(avg((n = 1)::INT), 6) AS single_share, count(*) FILTER (regexp_matches(topic, '[.!?,;:]|\\s\\(')) AS malformed FROM t"


@query(_TQ)
def agg6_topic_quality(spark: SparkSession, d: str) -> DataFrame:
    t = log(spark, d).filter("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.count(F.lit(1)).alias("topics"), F.round(F.avg("n"), 6).alias("per_topic"), F.round(F.avg((F.col("n") == 1).cast("int")), 6).alias("single_share"), F.count_if(F.col("topic").rlike(r"[.!?,;:]|\s\(")).alias("malformed"))


@query("SELECT agent, count(*) AS n, epoch_us(max(at_ts)) AS last_us FROM world_log WHERE agent IS NOT NULL GROUP BY agent")
def agg7_agents(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).filter("agent is not null").groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("at_ts")).alias("last_us"))


@query("SELECT agent, count(*) FILTER (entry_type = 'decision') AS decision, count(*) FILTER (entry_type = 'error') AS error, count(*) FILTER (entry_type = 'learning') AS learning, count(DISTINCT project) AS projects, count(DISTINCT topic) AS topics FROM world_log WHERE agent IS NOT NULL GROUP BY agent")
def agg8_agent_state(spark: SparkSession, d: str) -> DataFrame:
    g = log(spark, d).filter("agent is not null").groupBy("agent")
    kinds = [F.count_if(F.col("entry_type") == k).alias(k) for k in ("decision", "error", "learning")]
    return g.agg(*kinds, F.countDistinct("project").alias("projects"), F.countDistinct("topic").alias("topics"))


_REFS = "refs AS (SELECT replaces_id AS target, false AS against, id FROM world_log WHERE replaces_id IS NOT NULL UNION ALL SELECT retires_id, true, id FROM world_log WHERE retires_id IS NOT NULL)"


def refs(spark: SparkSession, d: str) -> DataFrame:
    w = log(spark, d)
    a = w.filter("replaces_id is not null").select(F.col("replaces_id").alias("target"), F.lit(False).alias("against"), "id")
    return a.unionByName(w.filter("retires_id is not null").select(F.col("retires_id").alias("target"), F.lit(True).alias("against"), "id"))


@query(f"WITH {_REFS} SELECT target, count(*) FILTER (NOT against) AS cited, bool_or(against) AS contested, count(DISTINCT id) AS sources FROM refs GROUP BY target")
def agg9_backing(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).groupBy("target").agg(F.count_if(~F.col("against")).alias("cited"), F.max("against").alias("contested"), F.countDistinct("id").alias("sources"))


@query(f"WITH {_REFS}, {_FIRST}, c AS (SELECT target AS id, count(*) AS cited FROM refs WHERE NOT against GROUP BY target) SELECT id, cited FROM c JOIN first USING (id) WHERE cited >= 2 AND entry_type = 'learning'")
def agg10_experiences(spark: SparkSession, d: str) -> DataFrame:
    c = refs(spark, d).filter("not against").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("cited")).filter("cited >= 2")
    return c.join(quality.first_lines(log(spark, d)).filter("entry_type = 'learning'").select("id"), "id")


@query("SELECT title AS form, count(*) AS n, count(DISTINCT agent) AS authors FROM world_log WHERE title IS NOT NULL GROUP BY title HAVING count(*) >= 2 AND count(DISTINCT agent) >= 2")
def agg11_flood_groups(spark: SparkSession, d: str) -> DataFrame:
    g = log(spark, d).filter("title is not null").groupBy(F.col("title").alias("form")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("agent").alias("authors"))
    return g.filter("n >= 2 and authors >= 2")


@query(f"""WITH {_FIRST}, s AS (SELECT replaces_id AS id, min(at_ts) AS b FROM first WHERE replaces_id IS NOT NULL GROUP BY 1), v AS (SELECT f.id, f.topic, coalesce(f.project, '') AS project, f.agent, f.at_ts AS a, coalesce(s.b, TIMESTAMPTZ '9999-01-01 00:00:00+00') AS b FROM first f LEFT JOIN s USING (id) WHERE topic IS NOT NULL AND at_ts IS NOT NULL AND agent IS NOT NULL)
SELECT x.project, x.topic, count(*) AS pairs FROM v x JOIN v y ON x.topic = y.topic AND x.project = y.project AND x.id < y.id AND x.agent <> y.agent AND x.a < y.b AND y.a < x.b GROUP BY 1, 2""")
def agg12_conflicts(spark: SparkSession, d: str) -> DataFrame:
    v = state.with_validity(quality.first_lines(log(spark, d))).filter("topic is not null and at_ts is not null and agent is not null")
    v = v.select("id", "topic", F.coalesce("project", F.lit("")).alias("project"), "agent", F.col("at_ts").alias("a"), F.coalesce("valid_until", dt.iso("9999-01-01")).alias("b"))
    x, y = v.alias("x"), v.alias("y")
    on = (F.col("x.topic") == F.col("y.topic")) & (F.col("x.project") == F.col("y.project")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.agent") != F.col("y.agent")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b"))
    return x.join(y, on).groupBy(F.col("x.project").alias("project"), F.col("x.topic").alias("topic")).agg(F.count(F.lit(1)).alias("pairs"))


@query(f"WITH {_FIRST}, l AS (SELECT coalesce(w.project, 'global') AS a, coalesce(f.project, 'global') AS b, w.retires_id IS NOT NULL AS retires FROM world_log w JOIN first f ON f.id = coalesce(w.replaces_id, w.retires_id)) SELECT a AS from_box, b AS to_box, count(*) FILTER (NOT retires) AS replaces, count(*) FILTER (retires) AS retires FROM l GROUP BY 1, 2")
def agg13_box_net(spark: SparkSession, d: str) -> DataFrame:
    f = quality.first_lines(log(spark, d)).select(F.col("id").alias("t"), F.coalesce("project", F.lit("global")).alias("to_box"))
    w = log(spark, d).select(F.coalesce("replaces_id", "retires_id").alias("t"), F.coalesce("project", F.lit("global")).alias("from_box"), F.col("retires_id").isNotNull().alias("r")).filter("t is not null")
    return w.join(f, "t").groupBy("from_box", "to_box").agg(F.count_if(~F.col("r")).alias("replaces"), F.count_if("r").alias("retires"))


@query("SELECT klasse, model_name, count(*) AS runs, count(*) FILTER (erfolg) AS confirmed, count(*) FILTER (NOT erfolg) AS rework, count(*) FILTER (erfolg IS NULL) AS unknown, count(DISTINCT task_id) AS tasks FROM paar_sauber GROUP BY ROLLUP (klasse, model_name)")
def agg14_job_ledger(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "paar_sauber").rollup("klasse", "model_name")
    return r.agg(F.count(F.lit(1)).alias("runs"), F.count_if("erfolg").alias("confirmed"), F.count_if(~F.col("erfolg")).alias("rework"), F.count_if(F.col("erfolg").isNull()).alias("unknown"), F.countDistinct("task_id").alias("tasks"))


@query("SELECT model_name, count(*) AS runs, sum(prompt_tok)::BIGINT AS tokens, round(sum(kosten), 6) AS cost, count(*) FILTER (kosten IS NULL) AS unmeasured FROM paar_sauber GROUP BY model_name")
def agg15_model_cost(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paar_sauber").groupBy("model_name").agg(F.count(F.lit(1)).alias("runs"), F.sum("prompt_tok").alias("tokens"), F.round(F.sum("kosten"), 6).alias("cost"), F.count_if(F.col("kosten").isNull()).alias("unmeasured"))


@query("WITH b(bucket) AS (VALUES ('shown'), ('too-weak'), ('unknown'), ('error')), c AS (SELECT coalesce(reason, 'shown') AS bucket, count(*) AS n FROM journal GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)")
def agg16_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = spark.createDataFrame([(x,) for x in ("shown", "too-weak", "unknown", "error")], "bucket string")
    c = journal(spark, d).groupBy(F.coalesce("reason", F.lit("shown")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return b.join(c, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("WITH s AS (SELECT session_id, sum(n_bytes)::BIGINT AS bytes, bool_or(n_bytes IS NULL) AS unmeasured FROM journal WHERE session_id IS NOT NULL GROUP BY 1) SELECT session_id, CASE WHEN NOT unmeasured THEN bytes END AS bytes, CASE WHEN NOT unmeasured THEN round(bytes / 200000.0, 6)::DOUBLE END AS share FROM s")
def agg17_occupancy(spark: SparkSession, d: str) -> DataFrame:
    s = journal(spark, d).filter("session_id is not null").groupBy("session_id").agg(F.sum("n_bytes").alias("b"), F.max(F.col("n_bytes").isNull()).alias("u"))
    return s.select("session_id", F.when(~F.col("u"), F.col("b")).alias("bytes"), F.when(~F.col("u"), F.round(F.col("b") / 200000.0, 6)).alias("share"))


_PCT = "l[(least(floor({} * len(l) / 100.0), len(l) - 1) + 1)::INT]"


def latency(rows: DataFrame, *by: str) -> DataFrame:
    """Exact nearest-rank percentiles by group: equal durations are counted first, so a group's window is over its distinct ones."""
    n = rows.filter("duration_ms is not null").groupBy(*by, "duration_ms").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by)
    r = n.withColumns({"upto": F.sum("k").over(w.orderBy("duration_ms")), "n": F.sum("k").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(p) * F.col("n") / 100), F.col("n") - 1), F.col("duration_ms")))
    return r.groupBy(*by).agg(at(50).alias("p50"), at(95).alias("p95"), F.max("duration_ms").alias("most"), F.sum("k").alias("n"))


@query(f"WITH g AS (SELECT occasion, list(duration_ms ORDER BY duration_ms) AS l FROM journal WHERE duration_ms IS NOT NULL GROUP BY occasion) SELECT occasion, {_PCT.format(50)} AS p50, {_PCT.format(95)} AS p95, l[-1] AS most, len(l) AS n FROM g")
def agg18_latency(spark: SparkSession, d: str) -> DataFrame:
    return latency(journal(spark, d), "occasion")


@query("SELECT strftime(ts, '%G-W%V') AS week, count(*) FILTER (hits > 0) AS closed, count(*) FILTER (hits = 0) AS open, round(count(*) FILTER (hits = 0) / count(hits)::DOUBLE, 6) AS rate FROM journal WHERE ts IS NOT NULL GROUP BY 1")
def agg19_gap_rate(spark: SparkSession, d: str) -> DataFrame:
    g = journal(spark, d).filter("ts is not null").groupBy(dt.week_key(F.col("ts")).alias("week"))
    return g.agg(F.count_if(F.col("hits") > 0).alias("closed"), F.count_if(F.col("hits") == 0).alias("open"), F.round(F.count_if(F.col("hits") == 0) / F.count("hits"), 6).alias("rate"))


_USER = "lower(trim(coalesce(message.role, line_type))) IN ('user', 'human') AND message IS NOT NULL AND regexp_matches(coalesce(message.content, ''), '[^\\s\\p{Z}]') AND NOT coalesce(lower(trim(line_type)) IN ('summary', 'attachment', 'system', 'tool_result'), false)"


@query(f"WITH h AS (SELECT hour(timezone('UTC', ts)) AS h, count(*) AS n FROM capture_lines WHERE ts IS NOT NULL AND {_USER} GROUP BY 1), r AS (SELECT range AS h FROM range(24)) SELECT r.h::INT AS hour, coalesce(n, 0) AS n, coalesce(n, 0) >= max(coalesce(n, 0)) OVER () / 2.0 AS main FROM r LEFT JOIN h USING (h)")
def agg20_hours(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "capture_lines").filter(F.col("ts").isNotNull() & captures.real_user()).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    full = spark.range(24).select(F.col("id").cast("int").alias("hour")).join(c, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))
    return full.join(F.broadcast(full.agg(F.max("n").alias("m"))), F.lit(True)).select("hour", "n", (F.col("n") >= F.col("m") / 2).alias("main"))


@query(f"SELECT project, floor(median(length(message.content)) + 0.5)::BIGINT AS median_chars FROM capture_lines WHERE {_USER} AND project IS NOT NULL GROUP BY project")
def agg21_median_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capture_lines").filter(captures.real_user() & F.col("project").isNotNull()).groupBy("project").agg(F.floor(F.median(F.length("message.content")) + 0.5).alias("median_chars"))


@query("WITH w AS (SELECT occasion, strftime(ts, '%G-W%V') AS week, count(*) AS n, count(*) FILTER (hits > 0) AS h FROM journal WHERE ts IS NOT NULL GROUP BY 1, 2) SELECT occasion, count(*) AS weeks, round(avg((h > 0)::INT), 6) AS stable FROM w WHERE n >= 5 GROUP BY occasion")
def agg22_weekly_stability(spark: SparkSession, d: str) -> DataFrame:
    w = journal(spark, d).filter("ts is not null").groupBy("occasion", dt.week_key(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hits") > 0).alias("h"))
    return w.filter("n >= 5").groupBy("occasion").agg(F.count(F.lit(1)).alias("weeks"), F.round(F.avg((F.col("h") > 0).cast("int")), 6).alias("stable"))


@query("SELECT path, origin, count(*) AS calls, count(DISTINCT lower(trim(session_id))) AS sessions, epoch_us(max(ts)) AS last_us FROM journal GROUP BY 1, 2")
def agg23_skill_usage(spark: SparkSession, d: str) -> DataFrame:
    return journal(spark, d).groupBy("path", "origin").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct(F.lower(F.trim("session_id"))).alias("sessions"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("""WITH g AS (SELECT klasse, count(*) FILTER (erfolg) AS k, count(erfolg) AS n FROM paar_sauber GROUP BY klasse), p AS (SELECT *, k / n::DOUBLE AS p, n::DOUBLE AS m FROM g WHERE n > 0)
SELECT klasse, round(greatest(0, (p + 1.96 * 1.96 / (2 * m) - 1.96 * sqrt(p * (1 - p) / m + 1.96 * 1.96 / (4 * m * m))) / (1 + 1.96 * 1.96 / m)), 6) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * m) + 1.96 * sqrt(p * (1 - p) / m + 1.96 * 1.96 / (4 * m * m))) / (1 + 1.96 * 1.96 / m)), 6) AS high FROM p""")
def agg24_wilson(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "paar_sauber").groupBy("klasse").agg(F.count_if("erfolg").alias("k"), F.count("erfolg").alias("n")).filter("n > 0")
    lo, hi = mt.wilson(F.col("k"), F.col("n"))
    return g.select("klasse", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@query("SELECT occasion, count(*) AS shown, CASE WHEN count(*) >= 100 THEN round(count(*) FILTER (hits >= 2) / count(*)::DOUBLE, 6) END AS used_rate FROM journal WHERE reason IS NULL GROUP BY occasion")
def agg25_effect_rate(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return journal(spark, d).filter("reason is null").groupBy("occasion").agg(n.alias("shown"), F.when(n >= 100, F.round(F.count_if(F.col("hits") >= 2) / n, 6)).alias("used_rate"))


@query(f"""WITH {_FIRST}, r AS (SELECT id, topic, at_ts FROM first WHERE entry_type = 'procedure' AND topic IS NOT NULL AND at_ts IS NOT NULL), e AS (SELECT topic, at_ts FROM first WHERE entry_type = 'error' AND topic IS NOT NULL AND at_ts IS NOT NULL)
SELECT r.id, count(e.at_ts) FILTER (e.at_ts < r.at_ts AND e.at_ts >= r.at_ts - INTERVAL 14 DAY) AS before, count(e.at_ts) FILTER (e.at_ts >= r.at_ts AND e.at_ts < r.at_ts + INTERVAL 14 DAY) AS after FROM r LEFT JOIN e USING (topic) GROUP BY r.id""")
def agg26_before_after(spark: SparkSession, d: str) -> DataFrame:
    f = quality.first_lines(log(spark, d)).filter("topic is not null and at_ts is not null").select("id", "topic", "entry_type", F.unix_micros("at_ts").alias("t"))
    r, e = f.filter("entry_type = 'procedure'").select("id", "topic", F.col("t").alias("rt")), f.filter("entry_type = 'error'").select("topic", F.col("t").alias("et"))
    lo, hi = (F.col("et") < F.col("rt")) & (F.col("et") >= F.col("rt") - 14 * DAY_US), (F.col("et") >= F.col("rt")) & (F.col("et") < F.col("rt") + 14 * DAY_US)
    return r.join(e, "topic", "left").groupBy("id").agg(F.count_if(lo).alias("before"), F.count_if(hi).alias("after"))


@query(f"WITH {_FIRST}, e AS (SELECT f.id, f.at_ts, EXISTS (SELECT 1 FROM world_log w WHERE w.replaces_id = f.id) AS fixed, EXISTS (SELECT 1 FROM world_log w WHERE w.retires_id = f.id) AS learned FROM first f WHERE entry_type = 'error') SELECT count(*) AS errors, round(avg(fixed::INT), 6) AS fixed, round(avg(learned::INT), 6) AS learned, round(avg(fixed::INT) FILTER (at_ts >= {NOW_SQL} - INTERVAL 30 DAY), 6) AS fixed_recent FROM e")
def agg27_error_links(spark: SparkSession, d: str) -> DataFrame:
    return quality.error_links(log(spark, d), dt.iso(NOW))


@query("WITH r AS (SELECT err_class, seq, row_number() OVER (PARTITION BY err_class ORDER BY seq DESC) AS rn, count(*) OVER (PARTITION BY err_class) AS n FROM world_log WHERE entry_type = 'error' AND err_class IS NOT NULL) SELECT err_class, n, string_agg(seq::VARCHAR, ',' ORDER BY rn) AS latest FROM r WHERE rn <= 3 GROUP BY err_class, n")
def agg28_same_class(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d).filter("entry_type = 'error' and err_class is not null").select("err_class", "seq")
    n = e.groupBy("err_class").agg(F.count(F.lit(1)).alias("n"))
    top = rk.top_k(e, "err_class", [F.desc("seq")], 3).groupBy("err_class").agg(F.array_join(F.transform(F.sort_array(F.collect_list("seq"), False), lambda x: x.cast("string")), ",").alias("latest"))
    return n.join(top, "err_class")


@query("SELECT coalesce(lower(trim(status)), 'none') AS basis, count(*) AS n, count(*) FILTER (title IS NULL) AS defects FROM world_log GROUP BY 1")
def agg29_basis(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy(F.coalesce(F.lower(F.trim("status")), F.lit("none")).alias("basis")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("title").isNull()).alias("defects"))


@query("SELECT occasion, reason, GROUPING(occasion)::INT AS all_occasions, GROUPING(reason)::INT AS all_reasons, count(*) AS rows, count(*) FILTER (reason IS NULL) AS shown, sum(n_bytes)::BIGINT AS bytes FROM journal GROUP BY CUBE (occasion, reason)")
def agg30_usage(spark: SparkSession, d: str) -> DataFrame:
    c = journal(spark, d).withColumn("is_shown", F.col("reason").isNull()).cube("occasion", "reason")
    return c.agg(F.grouping("occasion").cast("int").alias("all_occasions"), F.grouping("reason").cast("int").alias("all_reasons"), F.count(F.lit(1)).alias("rows"), F.count_if("is_shown").alias("shown"), F.sum("n_bytes").alias("bytes"))


#: Minutes ahead of one's own clock from which a foreign line is a warning and an error.
AHEAD_WARN, AHEAD_ERROR = 1, 5


@query(f"""WITH a AS (SELECT agent, count(*) AS n, max(epoch_us(at_ts)) AS t FROM world_log WHERE agent IS NOT NULL AND at_ts IS NOT NULL GROUP BY agent), w AS (SELECT sum(n) AS n, count(*) AS k FROM a), two AS (SELECT agent, t, row_number() OVER (ORDER BY t DESC, agent) AS r FROM a QUALIFY r <= 2),
 s AS (SELECT a.agent, o.agent AS newest_of, (w.n - a.n)::BIGINT AS lines, w.k - 1 AS writers, round((o.t - epoch_us({NOW_SQL})) / 60000000.0::DOUBLE, 2) AS minutes FROM a, w, two o WHERE o.r = (SELECT CASE WHEN f.agent = a.agent THEN 2 ELSE 1 END FROM two f WHERE f.r = 1))
SELECT agent, newest_of, lines, writers, minutes, CASE WHEN minutes >= 5 THEN 'error' WHEN minutes >= 1 THEN 'warn' ELSE 'good' END AS state FROM s""")
def agg31_clock_skew(spark: SparkSession, d: str) -> DataFrame:
    """For each writer the newest line of any other, in minutes ahead of now; below 0 it lags, which is no fault of a clock."""
    a = log(spark, d).filter("agent is not null and at_ts is not null").groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("at_ts")).alias("t"))
    best = lambda df: df.agg(F.min(F.struct((-F.col("t")).alias("t"), "agent")).alias("x"))
    first = best(a).select(F.col("x.agent").alias("w1"), (-F.col("x.t")).alias("t1"))
    second = best(a.join(first.select(F.col("w1").alias("agent")), "agent", "left_anti")).select(F.col("x.agent").alias("w2"), (-F.col("x.t")).alias("t2"))
    every = a.crossJoin(F.broadcast(a.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")))).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(second))  # three single rows
    own = F.col("agent") == F.col("w1")
    minutes = F.round((F.when(own, F.col("t2")).otherwise(F.col("t1")) - F.unix_micros(dt.iso(NOW))) / 60e6, 2)
    out = every.select("agent", F.when(own, F.col("w2")).otherwise(F.col("w1")).alias("newest_of"), (F.col("all") - F.col("n")).alias("lines"), (F.col("k") - 1).alias("writers"), minutes.alias("minutes"))
    return out.filter("newest_of is not null").withColumn("state", F.when(F.col("minutes") >= AHEAD_ERROR, "error").when(F.col("minutes") >= AHEAD_WARN, "warn").otherwise("good"))


def _npmi_sql(items: str, least: int, cap: float, floor: float, k: int, most_df: int) -> str:
    return f"""WITH i AS ({items}), n AS (SELECT count(DISTINCT k)::DOUBLE AS n FROM i), df AS (SELECT t, count(*) AS df FROM i GROUP BY t), u AS (SELECT k, t, df FROM i JOIN df USING (t) WHERE df <= {most_df}),
 p AS (SELECT a.t AS x, b.t AS y, a.df AS nx, b.df AS ny, count(*) AS c FROM u a JOIN u b ON a.k = b.k AND a.t < b.t GROUP BY 1, 2, 3, 4 HAVING count(*) >= {least}),
 w AS (SELECT x, y, round(least({cap}, {cap} * ln((c / n.n) / ((nx / n.n) * (ny / n.n))) / -ln(c / n.n)), 6) AS weight FROM p, n), b AS (SELECT x AS term, y AS neighbour, weight FROM w WHERE weight >= {floor} UNION ALL SELECT y, x, weight FROM w WHERE weight >= {floor})
SELECT term, neighbour, weight FROM b QUALIFY row_number() OVER (PARTITION BY term ORDER BY weight DESC, neighbour) <= {k}"""


@query(_npmi_sql("SELECT DISTINCT id AS k, unnest(tags) AS t FROM world_log WHERE id IS NOT NULL", 2, 0.5, 0.05, 8, 10**9))
def agg32_tag_graph(spark: SparkSession, d: str) -> DataFrame:
    return tag_graph(spark, d)


def tag_graph(spark: SparkSession, d: str) -> DataFrame:
    t = log(spark, d).filter("id is not null").select("id", F.explode("tags").alias("tag")).distinct()
    return rk.cooccurrence(t, "id", "tag", most_df=10**9)


#: Weights of an entry's fields.
FIELD_WEIGHTS = {"title": 3.0, "topic": 2.5, "err_class": 2.0, "tags": 2.0, "choice": 1.5, "learning": 1.5, "why": 1.2, "text": 1.0}

#: The term graph in SQL: three documents in order of their number, each no near copy of those before, support a pair.
TERM_GRAPH_SQL = f"""WITH {_FIRST}, n AS (SELECT count(*) AS n FROM first),
 wd AS (SELECT seq AS k, f, unnest(regexp_split_to_array(strip_accents(lower(s)), '[^a-z0-9_-]+')) AS term FROM (SELECT seq, unnest([{", ".join(f"struct_pack(f := {w}::DOUBLE, s := {'array_to_string(tags, chr(32))' if c == 'tags' else c})" for c, w in FIELD_WEIGHTS.items())}], recursive := true) FROM first)),
 bag AS (SELECT k, term, round(sum(f), 6) AS s FROM wd WHERE length(term) >= 4 AND term NOT IN ({sql_list(tx.EN_STOP)}) GROUP BY 1, 2), sets AS (SELECT k, list(term) AS w FROM bag GROUP BY k),
 ok AS (SELECT term FROM bag, n WHERE regexp_full_match(term, '[a-z][a-z_-]{{2,}}') GROUP BY term, n.n HAVING count(*) BETWEEN 3 AND greatest(3, floor(n.n * 0.5))),
 u AS (SELECT k, term FROM bag SEMI JOIN ok USING (term) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, term) <= 40), m AS (SELECT count(DISTINCT k)::DOUBLE AS m FROM u), single AS (SELECT term, count(*) AS s FROM u GROUP BY term),
 c AS (SELECT a.term AS x, b.term AS y, a.k FROM u a JOIN u b ON a.k = b.k AND a.term < b.term), pc AS (SELECT x, y, count(*) AS c, min(k) AS d1 FROM c GROUP BY 1, 2 HAVING count(*) >= 3),
 w AS (SELECT x, y, d1, round(least(0.35, 0.35 * ln((c / m) / ((a.s / m) * (b.s / m))) / -ln(c / m)), 6) AS weight FROM pc, m JOIN single a ON a.term = x JOIN single b ON b.term = y WHERE c < m), w2 AS (SELECT * FROM w WHERE weight >= 0.1),
 near AS (SELECT a.k AS a, b.k AS b FROM sets a JOIN sets b ON a.k < b.k AND least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w)) AND len(list_intersect(a.w, b.w)) >= 0.8 * greatest(len(a.w), len(b.w))),
 two AS (SELECT x, y, weight, d1, min(k) AS d2 FROM c JOIN w2 USING (x, y) WHERE k > d1 AND NOT EXISTS (SELECT 1 FROM near WHERE a = d1 AND b = k) GROUP BY 1, 2, 3, 4),
 held AS (SELECT DISTINCT x, y, weight FROM c JOIN two USING (x, y) WHERE k > d2 AND NOT EXISTS (SELECT 1 FROM near WHERE a = d1 AND b = k) AND NOT EXISTS (SELECT 1 FROM near WHERE a = d2 AND b = k)),
 both_ways AS (SELECT x AS term, y AS neighbour, weight FROM held UNION ALL SELECT y, x, weight FROM held), term_graph AS (SELECT * FROM both_ways QUALIFY row_number() OVER (PARTITION BY term ORDER BY weight DESC, neighbour) <= 6)"""


@query(TERM_GRAPH_SQL + " SELECT term, neighbour, weight FROM term_graph")
def agg33_term_graph(spark: SparkSession, d: str) -> DataFrame:
    """Over the terms of whole entries."""
    return term_graph(spark, d)


def term_graph(spark: SparkSession, d: str) -> DataFrame:
    e = quality.first_lines(log(spark, d).select("seq", "id", *FIELD_WEIGHTS))
    parts = F.array(*[F.struct(F.lit(w).alias("f"), F.concat_ws(" ", c).alias("s")) for c, w in FIELD_WEIGHTS.items()])
    words = e.repartition("seq").select("seq", F.explode(parts).alias("p")).select("seq", "p.f", F.explode(F.split(tx.strip_accents(F.lower("p.s")), r"[^a-z0-9_-]+")).alias("term")).filter((F.length("term") >= 4) & ~F.col("term").isin(*tx.EN_STOP))
    bag = words.groupBy("seq", "term").agg(F.sum("f").alias("s"))
    docs = bag.groupBy(F.col("seq").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("s", 6)).alias("s"), "term"))), lambda x: x["term"]).alias("w"))
    # An entry without words still counts for the share of all.
    return rk.term_graph(e.select(F.col("seq").alias("k")).join(docs, "k", "left").select("k", F.coalesce("w", F.array().cast("array<string>")).alias("w")), cap=0.35, floor=0.1)


@query(f"WITH w AS (SELECT unnest({_W.format('text')}) AS w FROM documents) SELECT w, count(*) AS n FROM w GROUP BY w HAVING count(*) >= 2")
def agg34_compound_lexicon(spark: SparkSession, d: str) -> DataFrame:
    p = rk.postings(table(spark, d, "documents"), "doc_id")
    return p.groupBy(F.col("term").alias("w")).agg(F.sum("tf").cast("long").alias("n")).filter("n >= 2")


@query()
def agg35_category_wishes(spark: SparkSession, d: str) -> DataFrame:
    """Names of areas that are alike, grouped, with the number of topics; wanted from three topics on."""
    from logweave.operators.joins import similar_names

    t = log(spark, d).filter("topic is not null").select(area().alias("n"), "topic").distinct()
    comp = connected_components(similar_names(t.select("n"))).select(F.col("node").alias("n"), "component")
    g = t.join(comp, "n", "left").groupBy(F.coalesce("component", "n").alias("category")).agg(F.countDistinct("topic").alias("topics"), F.countDistinct("n").alias("names"))
    return g.withColumn("wanted", F.col("topics") >= 3)


@query("WITH s AS (SELECT lower(trim(session_id)) AS s, ts, unnest(sources) AS source FROM journal WHERE reason IS NULL) SELECT source, count(DISTINCT s) AS sessions, count(*) AS mentions, epoch_us(max(ts)) AS last_us FROM s GROUP BY source")
def agg36_recall_count(spark: SparkSession, d: str) -> DataFrame:
    s = journal(spark, d).filter("reason is null").select(F.lower(F.trim("session_id")).alias("s"), "ts", F.explode("sources").alias("source"))
    return s.groupBy("source").agg(F.countDistinct("s").alias("sessions"), F.count(F.lit(1)).alias("mentions"), F.unix_micros(F.max("ts")).alias("last_us"))


@query(f"WITH t AS (SELECT topic, {_TOPIC} AS area, count(*) AS n FROM world_log WHERE topic IS NOT NULL GROUP BY 1, 2), a AS (SELECT area FROM t GROUP BY area HAVING count(*) >= 3), j AS (SELECT t.*, a.area AS cat FROM t LEFT JOIN a USING (area)) SELECT count(*) AS topics, sum(n)::BIGINT AS entries, count(*) FILTER (cat IS NULL) AS unassigned, round(count(*) FILTER (cat IS NULL) / count(*)::DOUBLE, 6) > 0.5 AS warn FROM j")
def agg37_category_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = log(spark, d).filter("topic is not null").groupBy("topic", area().alias("area")).agg(F.count(F.lit(1)).alias("n"))
    cat = t.groupBy("area").count().filter("count >= 3").select("area", F.lit(True).alias("cat"))
    j = t.join(cat, "area", "left")
    u = F.count_if(F.col("cat").isNull())
    return j.agg(F.count(F.lit(1)).alias("topics"), F.sum("n").alias("entries"), u.alias("unassigned"), (u / F.count(F.lit(1)) > 0.5).alias("warn"))


@query("WITH t AS (SELECT seq, unnest(list_distinct(tags)) AS t FROM world_log) SELECT a.t AS tag, coalesce(b.t, '') AS other, count(*) AS n FROM t a LEFT JOIN t b ON a.seq = b.seq AND a.t < b.t GROUP BY 1, 2")
def agg38_theme_counts(spark: SparkSession, d: str) -> DataFrame:
    t = log(spark, d).select("seq", F.explode(F.array_distinct("tags")).alias("t"))
    p = t.alias("a").join(t.alias("b"), (F.col("a.seq") == F.col("b.seq")) & (F.col("a.t") < F.col("b.t")), "left")
    return p.groupBy(F.col("a.t").alias("tag"), F.coalesce("b.t", F.lit("")).alias("other")).agg(F.count(F.lit(1)).alias("n"))
