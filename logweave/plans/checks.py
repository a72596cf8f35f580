"""Queries over writes, streams, quality checks and composed views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import text as tx
from logweave.functions.dates import due_state, iso
from logweave.operators import quality
from logweave.operators import ranking as rk
from logweave.plans import aggregates as ag
from logweave.plans import folds, ranked, scalars  # noqa: F401
from logweave.plans.registry import NOW, NOW_SQL, ORACLES, query
from logweave.plans.relational import _FIRST, log
from logweave.sources import logs, sinks
from logweave.sources.tables import table
from logweave.streaming import streams as st

_BAD = "id IS NULL OR NOT regexp_matches(id, '^[a-z0-9]{6,16}$') OR at_ts IS NULL OR trim(concat_ws('', title, text, learning, choice, why)) = '' OR coalesce(replaces_id = id, false) OR coalesce(retires_id = id, false)"


@query(f"SELECT entry_type, count(*) AS n FROM world_log WHERE NOT ({_BAD}) GROUP BY entry_type")
def snk1_checked_append(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines by type and project, and read back."""
    at = f"{st.place(spark)}/drawers"
    e = sinks.stamp(log(spark, d)).withColumnsRenamed({"entry_type": "type"}).withColumn("project", F.coalesce("project", F.lit("global")))
    logs.write_drawers(e.select("id", "type", "project", "title", "text", "tags", "v", "authority"), at)
    back = spark.read.schema("id string, title string, type string, project string").json(at)
    return back.groupBy(F.col("type").alias("entry_type")).agg(F.count("id").alias("n"))


@query(f"SELECT seq, {_BAD} AS refused FROM world_log")
def snk2_shape_gate(spark: SparkSession, d: str) -> DataFrame:
    return sinks.shape_problems(log(spark, d)).select("seq", (F.size("problems") > 0).alias("refused"))


@query(f"WITH {_FIRST} SELECT n.id, coalesce(n.title, o.title) AS title, coalesce(n.topic, o.topic) AS topic, coalesce(n.status, o.status) AS status FROM first n JOIN first o ON n.replaces_id = o.id WHERE n.id <> o.id")
def snk3_correction(spark: SparkSession, d: str) -> DataFrame:
    return sinks.corrections(quality.first_lines(log(spark, d)), ("title", "topic", "status"))


def _done(spark: SparkSession, d: str) -> DataFrame:
    return quality.first_lines(log(spark, d)).filter(F.lower(F.trim("status")) == "done")


@query(f"WITH {_FIRST} SELECT left(sha256(id || '/done'), 12) AS id, id AS retires_id, 'done' AS state FROM first WHERE lower(trim(status)) = 'done'")
def snk4_retire(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tombstones(_done(spark, d).select("id", F.lit(None).cast("string").alias("by_id")), "done").drop("by_id")


@query(f"WITH {_FIRST}, n AS (SELECT replaces_id AS id, max(id) AS by_id FROM first WHERE replaces_id IS NOT NULL GROUP BY 1) SELECT left(sha256(id || '/superseded'), 12) AS id, id AS retires_id, 'superseded' AS state, by_id FROM n")
def snk5_supersede(spark: SparkSession, d: str) -> DataFrame:
    n = quality.first_lines(log(spark, d)).filter("replaces_id is not null").groupBy(F.col("replaces_id").alias("id")).agg(F.max("id").alias("by_id"))
    return sinks.tombstones(n, "superseded")


@query(f"WITH {_FIRST}, r AS (SELECT topic, id, seq, coalesce(text, title) AS t, row_number() OVER (PARTITION BY topic ORDER BY seq) AS n FROM first WHERE topic IS NOT NULL AND coalesce(text, title) IS NOT NULL) SELECT topic, string_agg(id, ',' ORDER BY seq) AS ids, md5(string_agg(t, chr(10) || chr(10) ORDER BY seq)) AS digest FROM r WHERE n <= 20 GROUP BY topic HAVING count(*) >= 2")
def snk6_merge(spark: SparkSession, d: str) -> DataFrame:
    e = quality.first_lines(log(spark, d)).select("topic", "id", "seq", F.coalesce("text", "title").alias("text")).filter("topic is not null and text is not null")
    return sinks.merged(e, "topic").select("topic", F.array_join("ids", ",").alias("ids"), F.md5("text").alias("digest"))


@query("""WITH r AS (SELECT entry_type, seq, id, title FROM world_log WHERE retires_id IS NULL QUALIFY row_number() OVER (PARTITION BY entry_type ORDER BY seq) <= 50), l AS (SELECT *, concat_ws(chr(31), seq, id, title) || chr(10) AS line FROM r)
SELECT entry_type, count(*) AS lines, min(seq) AS first_seq, max(seq) AS last_seq, sum(strlen(line))::BIGINT AS bytes, md5(string_agg(md5(line), '' ORDER BY seq)) AS checksum FROM l GROUP BY entry_type""")
def snk7_shards(spark: SparkSession, d: str) -> DataFrame:
    """The 50 oldest lines of each type that retire nothing, as they are written, with their length and checksum."""
    e = rk.top_k(log(spark, d).filter("retires_id is null").select("entry_type", "seq", "id", "title"), "entry_type", ["seq"], 50)
    line = F.concat(F.concat_ws("\x1f", F.col("seq").cast("string"), "id", "title"), F.lit("\n"))
    sums = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.md5("line").alias("m")))), lambda x: x["m"]), ""))
    return e.withColumn("line", line).groupBy("entry_type").agg(F.count(F.lit(1)).alias("lines"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(F.octet_length("line")).alias("bytes"), sums.alias("checksum"))


@query(rf"""SELECT session_id, count(*) AS lines, sum(length({scalars._RED}))::BIGINT AS chars, sum(len(regexp_extract_all({scalars._RED}, '\[secret:[a-z]+\]')))::BIGINT AS markers, bit_xor(('0x' || left(md5(line_id || ':' || {scalars._RED}), 15))::BIGINT) AS digest
 FROM capture_lines WHERE message.content IS NOT NULL AND session_id IS NOT NULL GROUP BY session_id""")
def snk8_capture_writer(spark: SparkSession, d: str) -> DataFrame:
    """A stream that writes redacted lines."""
    s = st.stream(spark, d, "capture_lines").filter("message.content is not null and session_id is not null").select("session_id", "line_id", tx.redact(F.col("message.content")).alias("text"))
    digest = F.bit_xor(F.conv(F.left(F.md5(F.concat_ws(":", F.col("line_id").cast("string"), "text")), F.lit(15)), 16, 10).cast("long"))
    return st.run(s).groupBy("session_id").agg(F.count("text").alias("lines"), F.sum(F.length("text")).alias("chars"), F.sum(tx.redactions(F.col("text"))).cast("long").alias("markers"), digest.alias("digest"))


_NAME_SLUG = "regexp_replace(regexp_replace(strip_accents(replace(lower(name), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_CUT_SLUG = rf"CASE WHEN length({_NAME_SLUG}) <= 40 THEN {_NAME_SLUG} ELSE rtrim(regexp_replace(left({_NAME_SLUG}, 40), '^(.{{12,}})-[^-]*$', '\1'), '-') END"


@query(f"WITH s AS (SELECT {_CUT_SLUG} AS slug, concat_ws(chr(10), name, \"current\") AS v FROM ({ORACLES['rnk20_skill_registry']})) SELECT slug, sum(len(string_split(v, chr(10))))::BIGINT AS lines FROM s GROUP BY slug")
def snk9_skill_export(spark: SparkSession, d: str) -> DataFrame:
    """Registered items as text files, one folder for each name."""
    at = f"{st.place(spark)}/skills"
    s = ranked.rnk20_skill_registry(spark, d).select(tx.slug(F.col("name")).alias("slug"), F.concat_ws("\n", "name", "current").alias("value"))
    s.repartition("slug").write.partitionBy("slug").text(at)
    return spark.read.text(at).groupBy("slug").agg(F.count(F.lit(1)).alias("lines"))


# ---- streams


@query("SELECT count(*) AS first_run, 0::BIGINT AS second_run FROM capture_lines")
def str1_tailing(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([st.run_twice(st.stream(spark, d, "capture_lines"))], "first_run long, second_run long")


@query(ORACLES["agg1_document_frequency"].replace("SELECT term, count(*) AS df, count(*) FILTER (lower(trim(source)) <> 'chat-import') AS curated_df", "SELECT term, count(*) AS df"))
def str2_index_maintenance(spark: SparkSession, d: str) -> DataFrame:
    w = st.stream(spark, d, "documents").select(F.explode(tx.content_words(F.col("text"))).alias("term")).withColumn("df", F.lit(1).cast("long"))
    return st.upsert(w, ["term"], lambda x: x.groupBy("term").agg(F.sum("df").alias("df")))


@query("SELECT entry_type, count(*) FILTER (at_ts >= TIMESTAMPTZ '2026-03-25 00:00:00+00') > least(0.2 * count(*), 100) AS rebuild FROM world_log GROUP BY entry_type")
def str3_staleness(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return log(spark, d).groupBy("entry_type").agg((F.count_if(F.col("at_ts") >= iso("2026-03-25")) > F.least(0.2 * n, F.lit(100.0))).alias("rebuild"))


@query("""WITH e AS (SELECT session_id, epoch_us(ts) AS t FROM capture_lines WHERE ts IS NOT NULL AND session_id IS NOT NULL), p AS (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY t) AS pt FROM e), g AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > 2700000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT session_id, min(t) AS start_us, max(t) + 2700000000 AS end_us, least(max(t) + 2700000000, min(t) + 28800000000) AS due_us, count(*) AS n FROM g GROUP BY session_id, g""")
def str4_quiet_windows(spark: SparkSession, d: str) -> DataFrame:
    """A session is due after 45 minutes of silence, and after 8 hours at the latest."""
    s = st.run(st.sessions(st.stream(spark, d, "capture_lines"), "session_id", "ts", "45 minutes"), "complete")
    return s.withColumn("due_us", F.least("end_us", F.col("start_us") + 8 * 3_600_000_000))


@query("SELECT strftime(timezone('UTC', ts), '%Y-%m-%d') AS day, count(*) AS n FROM capture_lines WHERE ts >= TIMESTAMPTZ '2026-03-10 00:00:00+00' AND ts < TIMESTAMPTZ '2026-03-13 00:00:00+00' GROUP BY 1")
def str5_time_pruning(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "capture_lines").filter((F.col("ts") >= iso("2026-03-10")) & (F.col("ts") < iso("2026-03-13")))
    return w.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT entry_type AS name, count(*) AS n FROM world_log GROUP BY 1 UNION ALL SELECT agent, count(*) FROM world_log GROUP BY 1")
def str6_generation_cache(spark: SparkSession, d: str) -> DataFrame:
    """Two reports over one cached scan."""
    e = log(spark, d).select("entry_type", "project", "agent").cache()
    a = e.groupBy(F.col("entry_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(e.groupBy(F.col("agent").alias("name")).agg(F.count(F.lit(1)).alias("n")))


@query()
def str7_lease_expiry(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*(F.lit(x) for x in ("claim", "renew", "done", "failed", "claim")))
    e = st.stream(spark, d, "events").select((F.col("event_id") % 500).alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3).cast("string").alias("who"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"))
    return st.run(st.expiring_leases(e, 6 * 3600))


@query("SELECT entry_type, count(DISTINCT id) AS n FROM world_log WHERE at_ts IS NOT NULL AND id IS NOT NULL GROUP BY entry_type")
def str8_late_lines(spark: SparkSession, d: str) -> DataFrame:
    s = st.first_of_each(st.stream(spark, d, "world_log").select("id", "entry_type", "at_ts"), "id", "at_ts", "400 days")
    return st.run(s).groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"))


# ---- quality


def level(bad: Column) -> Column:
    """warn or good."""
    return F.when(bad, "warn").otherwise("good")


@query(f"""SELECT 'missing_ts' AS finding, count(*) AS n FROM world_log WHERE at_ts IS NULL UNION ALL SELECT 'future_ts', count(*) FROM world_log WHERE at_ts > {NOW_SQL} UNION ALL SELECT 'no_id', count(*) FROM world_log WHERE id IS NULL UNION ALL SELECT 'self_pointer', count(*) FROM world_log WHERE id = replaces_id OR id = retires_id
UNION ALL SELECT 'no_content', count(*) FROM world_log WHERE trim(concat_ws('', title, text, learning, choice, why)) = '' UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT id FROM world_log WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'dangling', count(*) FROM (SELECT unnest([replaces_id, retires_id]) AS k FROM world_log) WHERE k IS NOT NULL AND k NOT IN (SELECT id FROM world_log)""")
def dq1_integrity(spark: SparkSession, d: str) -> DataFrame:
    return quality.integrity(log(spark, d), iso(NOW))


@query(ranked._FACTS + " SELECT key FROM facts WHERE conflict")
def dq2_fact_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return ranked.facts(spark, d).filter("conflict").select("key")


@query("SELECT seq, k AS pointer FROM (SELECT seq, unnest([replaces_id, retires_id]) AS k FROM world_log) WHERE k IS NOT NULL AND k NOT IN (SELECT id FROM world_log)")
def dq3_orphans(spark: SparkSession, d: str) -> DataFrame:
    p = log(spark, d).select("seq", F.explode(F.array_compact(F.array("replaces_id", "retires_id"))).alias("pointer"))
    return p.join(log(spark, d).select(F.col("id").alias("pointer")), "pointer", "left_anti").select("seq", "pointer")


@query(folds._VERDICT + " SELECT target, count(*) AS refused FROM l WHERE verdict = 'refused' GROUP BY target")
def dq4_contested(spark: SparkSession, d: str) -> DataFrame:
    return folds.verdicts(spark, d).filter("verdict = 'refused'").groupBy("target").agg(F.count(F.lit(1)).alias("refused"))


@query(f"SELECT CASE WHEN per_topic >= 1.2 AND malformed = 0 THEN 'good' ELSE 'warn' END AS level FROM ({ag._TQ})")
def dq5_topic_gate(spark: SparkSession, d: str) -> DataFrame:
    return ag.agg6_topic_quality(spark, d).select(level((F.col("per_topic") < 1.2) | (F.col("malformed") > 0)).alias("level"))


@query("WITH r AS (SELECT seq, count(*) OVER (PARTITION BY err_class ORDER BY epoch_us(at_ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) >= 3 AS rep FROM world_log WHERE entry_type = 'error' AND err_class IS NOT NULL AND at_ts IS NOT NULL) SELECT round(avg(rep::INT), 6) AS rate, CASE WHEN avg(rep::INT) > 0.15 THEN 'warn' ELSE 'good' END AS level FROM r")
def dq6_repetition_rate(spark: SparkSession, d: str) -> DataFrame:
    r = quality.repetition(log(spark, d)).agg(F.avg(F.col("repeated").cast("int")).alias("r"))
    return r.select(F.round("r", 6).alias("rate"), level(F.col("r") > 0.15).alias("level"))


@query(f"WITH {_FIRST} SELECT id FROM first f WHERE entry_type = 'duty' AND lower(trim(status)) = 'done' AND NOT EXISTS (SELECT 1 FROM world_log w WHERE w.replaces_id = f.id OR w.retires_id = f.id)")
def dq7_closed_without_evidence(spark: SparkSession, d: str) -> DataFrame:
    done = _done(spark, d).filter("entry_type = 'duty'").select("id")
    ev = log(spark, d).select(F.explode(F.array_compact(F.array("replaces_id", "retires_id"))).alias("id"))
    return done.join(ev, "id", "left_anti")


@query("SELECT o_custkey, count(*) AS overdue FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-12-31' GROUP BY o_custkey")
def dq8_deadlines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").withColumn("s", due_state(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY"), iso("1997-01-01")))
    return o.filter("s = 'overdue'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("overdue"))


@query(folds._HELD + " SELECT count(*) AS old, CASE WHEN count(*) > 20 THEN 'warn' ELSE 'good' END AS level FROM z JOIN first f ON f.id = z.root WHERE f.entry_type = 'duty' AND NOT closed AND z.since < TIMESTAMPTZ '2026-03-18 00:00:00+00'")
def dq9_duty_age(spark: SparkSession, d: str) -> DataFrame:
    old = folds.sta3_open_duties(spark, d).filter(F.col("since_us") < F.unix_micros(iso("2026-03-18")))
    n = F.count(F.lit(1))
    return old.agg(n.alias("old"), level(n > 20).alias("level"))


@query("WITH x AS (" + ORACLES["txt12_lost_correction_content"] + ") SELECT id, len(string_split(lost, ' '))::INT AS words FROM x WHERE len(string_split(lost, ' ')) >= 2")
def dq10_correction_loss(spark: SparkSession, d: str) -> DataFrame:
    return quality.lost_content(log(spark, d), 3).select("id", F.size(F.split("lost", " ")).alias("words")).filter("words >= 2")


@query("SELECT seq FROM world_log WHERE id IS NULL OR trim(concat_ws('', title, text, learning, choice, why)) = '' OR len(list_filter(tags, lambda t: regexp_matches(t, '^[\\[{]'))) > 0 OR lower(title) IN ('true', 'false')")
def dq11_entry_form(spark: SparkSession, d: str) -> DataFrame:
    empty = F.trim(F.concat_ws("", "title", "text", "learning", "choice", "why")) == ""
    half = F.coalesce(F.exists("tags", lambda t: t.rlike(r"^[\[{]")), F.lit(False))
    return log(spark, d).filter(F.col("id").isNull() | empty | half | F.coalesce(F.lower("title").isin("true", "false"), F.lit(False))).select("seq")


@query(f"SELECT CASE WHEN errors < 5 THEN 'unknown' WHEN fixed_recent < 0.25 OR learned < 0.1 THEN 'warn' ELSE 'good' END AS level FROM ({ORACLES['agg27_error_links']})")
def dq12_error_linked(spark: SparkSession, d: str) -> DataFrame:
    e = quality.error_links(log(spark, d), iso(NOW))
    return e.select(F.when(F.col("errors") < 5, "unknown").otherwise(level((F.col("fixed_recent") < 0.25) | (F.col("learned") < 0.1))).alias("level"))


@query("SELECT count(*) AS n, CASE WHEN count(*) > 50000 THEN 'warn' ELSE 'good' END AS level FROM world_log")
def dq13_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return log(spark, d).agg(n.alias("n"), level(n > 50_000).alias("level"))


@query(f"WITH p AS (SELECT path, min(ingested_at) AS t FROM capture_lines GROUP BY path) SELECT epoch_us(min(t)) AS oldest_us, CASE WHEN min(t) < {NOW_SQL} - INTERVAL 7 DAY THEN 'error' WHEN min(t) < {NOW_SQL} - INTERVAL 2 DAY THEN 'late' ELSE 'good' END AS level FROM p")
def dq14_archive_backlog(spark: SparkSession, d: str) -> DataFrame:
    t, now = F.min("ingested_at"), iso(NOW)
    return table(spark, d, "capture_lines").agg(F.unix_micros(t).alias("oldest_us"), F.when(t < now - F.expr("INTERVAL 7 DAY"), "error").when(t < now - F.expr("INTERVAL 2 DAY"), "late").otherwise("good").alias("level"))


#: Latency budgets in ms by occasion.
BUDGETS = {"question": 4000, "before-edit": 1000, "after-error": 2500}


@query(f"SELECT occasion, CASE WHEN n < 20 THEN 'unknown' WHEN p95 > 2 * b THEN 'error' WHEN p95 > b THEN 'warn' ELSE 'good' END AS level FROM ({ORACLES['agg18_latency']}) JOIN (VALUES ('question', 4000), ('before-edit', 1000), ('after-error', 2500)) v(occasion, b) USING (occasion)")
def dq15_hook_latency(spark: SparkSession, d: str) -> DataFrame:
    b = spark.createDataFrame(list(BUDGETS.items()), "occasion string, b int")
    j = ag.agg18_latency(spark, d).join(F.broadcast(b), "occasion")
    return j.select("occasion", F.when(F.col("n") < 20, "unknown").when(F.col("p95") > 2 * F.col("b"), "error").when(F.col("p95") > F.col("b"), "warn").otherwise("good").alias("level"))


#: What a line says; a line that comes again must say the same.
_SAID = ("entry_type", "title", "text", "learning", "choice", "why", "topic", "replaces_id", "retires_id", "status")


@query(f"""WITH l AS (SELECT world, id, count(*) AS n, count(DISTINCT md5(concat_ws(chr(31), {', '.join(f"coalesce({c}, chr(30))" for c in _SAID)}))) AS bodies FROM world_log WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT world, sum(n)::BIGINT AS lines, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (bodies > 1) AS rewritten, bool_and(bodies = 1) AS appended FROM l GROUP BY world""")
def dq16_append_only(spark: SparkSession, d: str) -> DataFrame:
    """By world, the ids that come again and those that then say something else: a log that is only appended to has none of the latter."""
    body = F.md5(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("\x1e")) for c in _SAID)))
    l = log(spark, d).filter("id is not null").select("world", "id", body.alias("b")).groupBy("world", "id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("b").alias("bodies"))
    return l.groupBy("world").agg(F.sum("n").alias("lines"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("bodies") > 1).alias("rewritten"), F.bool_and(F.col("bodies") == 1).alias("appended"))


_LEVELS = " UNION ALL ".join([*(f"SELECT '{q}' AS finding, level FROM ({ORACLES[q]})" for q in ("dq5_topic_gate", "dq6_repetition_rate", "dq9_duty_age", "dq12_error_linked", "dq13_corpus_size", "dq14_archive_backlog")), f"SELECT 'dq15_' || occasion, level FROM ({ORACLES['dq15_hook_latency']})"])
_RANK = "CASE WHEN level = 'error' THEN 3 WHEN level IN ('warn', 'late') THEN 2 WHEN level = 'good' THEN 1 ELSE 0 END"


@query(f"WITH l AS ({_LEVELS}) SELECT finding, level FROM l UNION ALL SELECT 'all', arg_max(level, ({_RANK}, level)) FROM l")
def dq17_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the checks and the worst of all; unknown never lowers it."""
    parts = [f(spark, d).select(F.lit(f.__name__).alias("finding"), "level") for f in (dq5_topic_gate, dq6_repetition_rate, dq9_duty_age, dq12_error_linked, dq13_corpus_size, dq14_archive_backlog)]
    every = reduce(DataFrame.unionByName, [*parts, dq15_hook_latency(spark, d).select(F.concat(F.lit("dq15_"), "occasion").alias("finding"), "level")])
    rank = F.when(F.col("level") == "error", 3).when(F.col("level").isin("warn", "late"), 2).when(F.col("level") == "good", 1).otherwise(0)
    worst = every.agg(F.max_by("level", F.struct(rank, "level")).alias("level")).select(F.lit("all").alias("finding"), "level")
    return every.unionByName(worst)


@query("""WITH o AS (SELECT entry_type, at_ts::DATE AS day, 1 AS step FROM world_log WHERE at_ts IS NOT NULL AND replaces_id IS NULL AND retires_id IS NULL UNION ALL
 SELECT t.entry_type, r.at_ts::DATE, -1 FROM (SELECT retires_id, min(at_ts) AS at_ts FROM world_log WHERE retires_id IS NOT NULL AND at_ts IS NOT NULL GROUP BY 1) r JOIN (SELECT id, min(entry_type) AS entry_type FROM world_log WHERE id IS NOT NULL GROUP BY 1) t ON t.id = r.retires_id),
 d AS (SELECT entry_type, day, sum(step) AS step FROM o WHERE entry_type IS NOT NULL GROUP BY 1, 2), c AS (SELECT entry_type, day, sum(step) OVER (PARTITION BY entry_type ORDER BY day) AS size FROM d)
SELECT entry_type, arg_max(size, day)::BIGINT AS now, max(size)::BIGINT AS baseline, arg_max(size, day) < max(size) AS shrunk FROM c GROUP BY entry_type""")
def dq18_shrink(spark: SparkSession, d: str) -> DataFrame:
    """The books' sizes, opened less retired by day, against the largest they ever had."""
    e = log(spark, d).filter("at_ts is not null")
    opened = e.filter("replaces_id is null and retires_id is null").select("entry_type", F.to_date("at_ts").alias("day"), F.lit(1).alias("step"))
    kind = log(spark, d).filter("id is not null").groupBy(F.col("id").alias("retires_id")).agg(F.min("entry_type").alias("entry_type"))
    closed = e.filter("retires_id is not null").groupBy("retires_id").agg(F.min("at_ts").alias("at_ts")).join(kind, "retires_id").select("entry_type", F.to_date("at_ts").alias("day"), F.lit(-1).alias("step"))
    days = opened.unionByName(closed).filter("entry_type is not null").groupBy("entry_type", "day").agg(F.sum("step").alias("step"))
    size = days.withColumn("size", F.sum("step").over(Window.partitionBy("entry_type").orderBy("day")))  # a row a day
    now = size.groupBy("entry_type").agg(F.max_by("size", "day").alias("now"), F.max("size").alias("baseline"))
    return now.withColumn("shrunk", F.col("now") < F.col("baseline"))


@query("""WITH r AS (SELECT id, retires_id, at_ts FROM world_log WHERE retires_id IS NOT NULL AND at_ts IS NOT NULL), undone AS (SELECT retires_id AS id FROM r WHERE retires_id IS NOT NULL)
SELECT DISTINCT retires_id AS id FROM r WHERE at_ts < TIMESTAMPTZ '2026-03-20 00:00:00+00' AND retires_id NOT IN (SELECT retires_id FROM r WHERE id IS NULL OR id NOT IN (SELECT id FROM undone))""")
def dq19_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Ids retired at the mark of 20 March that are not retired now, as the lines that retired them were retired themselves."""
    r = log(spark, d).filter("retires_id is not null and at_ts is not null").select("id", F.col("retires_id").alias("gone"), "at_ts")
    now = r.join(r.select(F.col("gone").alias("id")), "id", "left_anti").select("gone")
    return r.filter(F.col("at_ts") < iso("2026-03-20")).select("gone").distinct().join(now, "gone", "left_anti").select(F.col("gone").alias("id"))


# ---- views


@query(ranked._FACTS + " SELECT key, current, conflict FROM facts WHERE state = 'current'")
def view1_current_facts(spark: SparkSession, d: str) -> DataFrame:
    return ranked.facts(spark, d).filter("state = 'current'").select("key", "current", "conflict")


_BACK = "cb AS (SELECT replaces_id AS id, count(*) AS cited FROM world_log WHERE replaces_id IS NOT NULL GROUP BY 1)"


@query(ranked._FACTS + f", {_BACK}, a AS (SELECT 'fact' AS part, key AS name FROM facts WHERE state = 'current' AND NOT conflict ORDER BY key LIMIT 40), b AS (SELECT 'experience' AS part, id AS name FROM cb JOIN first USING (id) WHERE entry_type = 'learning' ORDER BY cited DESC, id LIMIT 8) SELECT * FROM a UNION ALL SELECT * FROM b")
def view2_core(spark: SparkSession, d: str) -> DataFrame:
    a = ranked.facts(spark, d).filter("state = 'current' and not conflict").orderBy("key").limit(40).select(F.lit("fact").alias("part"), F.col("key").alias("name"))
    c = log(spark, d).filter("replaces_id is not null").groupBy(F.col("replaces_id").alias("id")).agg(F.count(F.lit(1)).alias("cited"))
    b = c.join(quality.first_lines(log(spark, d)).filter("entry_type = 'learning'").select("id"), "id").orderBy(F.desc("cited"), "id").limit(8)
    return a.unionByName(b.select(F.lit("experience").alias("part"), F.col("id").alias("name")))


@query(f"""SELECT 'errors' AS tile, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'warn' ELSE 'good' END AS level FROM world_log WHERE entry_type = 'error' AND at_ts >= {NOW_SQL} - INTERVAL 14 DAY UNION ALL SELECT 'quiet', count(*), CASE WHEN count(*) > 0 THEN 'warn' ELSE 'good' END FROM (SELECT agent FROM world_log WHERE agent IS NOT NULL GROUP BY agent HAVING max(at_ts) < {NOW_SQL} - INTERVAL 24 HOUR)
UNION ALL SELECT 'questions', count(*), CASE WHEN count(*) > 0 THEN 'warn' ELSE 'good' END FROM world_log WHERE entry_type = 'question' AND lower(trim(status)) = 'open'""")
def view3_board(spark: SparkSession, d: str) -> DataFrame:
    n, now = F.count(F.lit(1)), iso(NOW)
    tile = lambda name, df, least: df.agg(F.lit(name).alias("tile"), n.alias("n"), level(n >= least).alias("level"))
    e = log(spark, d).filter((F.col("entry_type") == "error") & (F.col("at_ts") >= now - F.expr("INTERVAL 14 DAY")))
    q = log(spark, d).filter("agent is not null").groupBy("agent").agg(F.max("at_ts").alias("m")).filter(F.col("m") < now - F.expr("INTERVAL 24 HOUR"))
    o = log(spark, d).filter("entry_type = 'question' and lower(trim(status)) = 'open'")
    return tile("errors", e, 5).unionByName(tile("quiet", q, 1)).unionByName(tile("questions", o, 1))


@query("SELECT part, name FROM (SELECT 'decision' AS part, id AS name FROM world_log WHERE entry_type = 'decision' AND at_ts IS NOT NULL ORDER BY at_ts DESC, seq DESC LIMIT 5) UNION ALL SELECT part, name FROM (SELECT 'project' AS part, project AS name FROM world_log WHERE project IS NOT NULL GROUP BY project ORDER BY count(*) DESC, project LIMIT 5)")
def view4_today(spark: SparkSession, d: str) -> DataFrame:
    a = log(spark, d).filter("entry_type = 'decision' and at_ts is not null").orderBy(F.desc("at_ts"), F.desc("seq")).limit(5).select(F.lit("decision").alias("part"), F.col("id").alias("name"))
    p = log(spark, d).filter("project is not null").groupBy("project").count().orderBy(F.desc("count"), "project").limit(5)
    return a.unionByName(p.select(F.lit("project").alias("part"), F.col("project").alias("name")))


@query("SELECT CASE GROUPING(entry_type) WHEN 0 THEN 'type' ELSE CASE GROUPING(agent) WHEN 0 THEN 'agent' ELSE 'project' END END AS kind, coalesce(entry_type, agent, project) AS name, count(*) AS n FROM (SELECT entry_type, coalesce(agent, '-') AS agent, coalesce(project, '-') AS project FROM world_log) GROUP BY GROUPING SETS ((entry_type), (agent), (project))")
def view5_dashboard_pass(spark: SparkSession, d: str) -> DataFrame:
    """All counts from one scan."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("type", F.col("entry_type")), ("agent", F.coalesce("agent", F.lit("-"))), ("project", F.coalesce("project", F.lit("-"))))))
    return log(spark, d).select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT seq, title FROM world_log WHERE list_contains(tags, (SELECT min(t) FROM (SELECT unnest(tags) AS t FROM world_log))) ORDER BY seq LIMIT 60")
def view6_theme_samples(spark: SparkSession, d: str) -> DataFrame:
    first = log(spark, d).select(F.explode("tags").alias("t")).agg(F.min("t")).first()[0]
    return log(spark, d).filter(F.array_contains("tags", first)).orderBy("seq").limit(60).select("seq", "title")


@query(f"SELECT metric, value FROM (UNPIVOT (SELECT r1::DOUBLE AS r1, r10::DOUBLE AS r10, mrr::DOUBLE AS mrr FROM ({ORACLES['mth8_retrieval_metrics']})) ON r1, r10, mrr INTO NAME metric VALUE value) UNION ALL SELECT 'p95 ' || occasion, p95::DOUBLE FROM ({ORACLES['agg18_latency']})")
def view7_value_report(spark: SparkSession, d: str) -> DataFrame:
    """Measures of search and journal in one table."""
    m = ranked.mth8_retrieval_metrics(spark, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("r1", "r10", "mrr")))).alias("x")).select("x.*")
    lat = ag.agg18_latency(spark, d).select(F.concat(F.lit("p95 "), "occasion").alias("metric"), F.col("p95").cast("double").alias("value"))
    return m.unionByName(lat)


@query("SELECT occasion, count(*) AS produced, count(*) FILTER (reason IS NULL AND hits > 0) AS consumed FROM journal GROUP BY occasion")
def view8_funnel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "journal").groupBy("occasion").agg(F.count(F.lit(1)).alias("produced"), F.count_if(F.col("reason").isNull() & (F.col("hits") > 0)).alias("consumed"))


@query(r"WITH n AS (SELECT project AS name, count(*) AS c FROM world_log WHERE project IS NOT NULL GROUP BY 1) SELECT count(*) AS names, count(*) FILTER (c = 1) AS once, count(DISTINCT regexp_replace(name, '-\d+$', '')) AS stems, count(DISTINCT array_to_string(list_sort(string_split(name, '-')), '-')) AS word_sets FROM n")
def view9_name_dispersion(spark: SparkSession, d: str) -> DataFrame:
    n = log(spark, d).filter("project is not null").groupBy(F.col("project").alias("name")).agg(F.count(F.lit(1)).alias("c"))
    words = F.array_join(F.array_sort(F.split("name", "-")), "-")
    return n.agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("c") == 1).alias("once"), F.countDistinct(F.regexp_replace("name", r"-\d+$", "")).alias("stems"), F.countDistinct(words).alias("word_sets"))
