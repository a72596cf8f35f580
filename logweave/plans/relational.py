"""Queries over scans, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import text as tx
from logweave.functions.dates import iso
from logweave.operators import joins, quality, state
from logweave.operators import ranking as rk
from logweave.plans.registry import query, sql_list
from logweave.session import cut
from logweave.sources import captures, logs
from logweave.sources.tables import table


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "world_log")


def content_text() -> Column:
    """All that an entry says, without what machines set."""
    return F.concat_ws(" ", "title", "topic", "err_class", "tags", "choice", "learning", "why", "text")


def entry_words(spark: SparkSession, d: str) -> DataFrame:
    """``(id, entry_type, t, w)``: each entry's time and distinct words, written down."""
    e = quality.first_lines(log(spark, d).select("seq", "id", "entry_type", "at_ts", content_text().alias("text")))
    return cut(e.select("id", "entry_type", F.unix_micros("at_ts").alias("t"), F.array_join(tx.content_words(F.col("text")), " ").alias("w"))).withColumn("w", F.split("w", " "))


_HELD = """held AS (SELECT * FROM world_log w WHERE id IS NOT NULL AND retires_id IS NULL AND NOT EXISTS (SELECT 1 FROM world_log r WHERE r.retires_id = w.id))"""
_FIRST = "first AS (SELECT * FROM world_log WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"


def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log as text lines; every 13th lacks its id, every 17th is cut off."""
    e = F.struct(F.when(F.col("seq") % 13 != 0, F.col("id")).alias("id"), F.col("entry_type").alias("type"), "title", "tags", "project")
    line = F.to_json(e)
    return log(spark, d).select("seq", F.when(F.col("seq") % 17 == 0, F.left(line, F.length(line) - 5)).otherwise(line).alias("value"))


@query("SELECT entry_type, coalesce(project, '') AS project, count(*) AS lines, count(*) FILTER (seq % 13 = 0 OR seq % 17 = 0) AS broken FROM world_log GROUP BY 1, 2")
def src1_drawer_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.parse_lines(_json_lines(spark, d)).join(log(spark, d).select("seq", "entry_type", "project"), "seq")
    return rows.groupBy("entry_type", F.coalesce("project", F.lit("")).alias("project")).agg(F.count(F.lit(1)).alias("lines"), F.count_if("broken").alias("broken"))


@query("SELECT entry_type, count(*) AS n, count(DISTINCT id) AS ids FROM world_log GROUP BY 1")
def src2_streaming_scan(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("SELECT seq, id FROM world_log WHERE entry_type = 'decision' ORDER BY seq DESC LIMIT 25")
def src3_tail_scan(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).filter("entry_type = 'decision'").orderBy(F.desc("seq")).limit(25).select("seq", "id")


@query("SELECT seq, CASE WHEN seq % 17 <> 0 AND seq % 13 <> 0 THEN id END AS id, seq % 13 = 0 OR seq % 17 = 0 AS broken FROM world_log")
def src4_line_parser(spark: SparkSession, d: str) -> DataFrame:
    p = logs.parse_lines(_json_lines(spark, d))
    return p.select("seq", F.when(~F.col("broken"), F.col("entry.id")).alias("id"), "broken")


@query(f"WITH {_FIRST} SELECT id, seq, entry_type, project FROM first WHERE retires_id IS NULL AND NOT EXISTS (SELECT 1 FROM world_log r WHERE r.retires_id = first.id)")
def src5_entries_by_id(spark: SparkSession, d: str) -> DataFrame:
    return state.holding(quality.first_lines(log(spark, d)), log(spark, d)).select("id", "seq", "entry_type", "project")


@query("WITH r AS (SELECT path, min(ts) AS ts FROM capture_lines GROUP BY path) SELECT path, epoch_us(ts) AS ts_us FROM r WHERE NOT EXISTS (SELECT 1 FROM journal j WHERE j.text IS NULL AND lower(trim(j.session_id)) = string_split(r.path, '/')[2] AND j.hits = 0)")
def src6_capture_listing(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "journal").filter("text is null and hits = 0").select(F.lower(F.trim("session_id")).alias("session")).distinct()
    return captures.listing(table(spark, d, "capture_lines"), gone)


@query("SELECT path, count(*) AS lines, min(line) AS first, max(line) AS last, count(*) FILTER (message IS NULL) AS without_message FROM capture_lines GROUP BY path")
def src7_capture_reader(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capture_lines").groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"), F.max("line").alias("last"), F.count_if(F.col("message").isNull()).alias("without_message"))


@query("""WITH r AS (SELECT DISTINCT session_id AS s FROM journal WHERE session_id IS NOT NULL), c AS (SELECT DISTINCT session_id AS s FROM capture_lines)
SELECT coalesce(r.s, c.s) AS session, CASE WHEN r.s IS NULL THEN 'unregistered' WHEN c.s IS NULL THEN 'unreachable' ELSE 'present' END AS state FROM r FULL JOIN c ON r.s = c.s""")
def src8_capture_states(spark: SparkSession, d: str) -> DataFrame:
    return captures.states(table(spark, d, "journal").select(F.col("session_id").alias("s")), table(spark, d, "capture_lines").select(F.col("session_id").alias("s")))


@query("""SELECT conv_id, count(*) AS turns FROM capture_lines WHERE lower(trim(coalesce(message.role, line_type))) IN ('user', 'human', 'assistant', 'ai', 'model') AND message IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM journal j WHERE j.session_id = capture_lines.session_id AND j.origin = 'ssh') GROUP BY conv_id""")
def src9_foreign_import(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "journal").filter("origin = 'ssh' and session_id is not null").select("session_id").distinct()
    return captures.import_turns(table(spark, d, "capture_lines"), known).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("SELECT source, target_share, max_repeat FROM mix_targets")
def src10_side_tables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mix_targets").select("source", "target_share", "max_repeat")


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS norm FROM embeddings GROUP BY label")
def src11_vector_scan(spark: SparkSession, d: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm), 6).alias("norm"))


@query("SELECT sha256(text) AS sha256, count(*) AS holdings, min(doc_id) AS first, max(doc_id) AS latest FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def src12_content_store(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").filter("text is not null").groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return h.agg(F.count(F.lit(1)).alias("holdings"), F.min("doc_id").alias("first"), F.max("doc_id").alias("latest")).filter("holdings > 1")


# ---- filters


@query("SELECT seq, id FROM world_log WHERE contains(lower(concat_ws(' ', title, text, learning, choice, why)), 'cursor') AND entry_type IN ('decision', 'error') AND at_ts >= TIMESTAMPTZ '2026-03-05 00:00:00+00' AND retires_id IS NULL")
def flt1_literal_find(spark: SparkSession, d: str) -> DataFrame:
    body = F.lower(F.concat_ws(" ", "title", "text", "learning", "choice", "why"))
    return log(spark, d).filter(F.col("entry_type").isin("decision", "error") & (F.col("at_ts") >= iso("2026-03-05")) & F.col("retires_id").isNull() & body.contains("cursor")).select("seq", "id")


@query("SELECT hit_id FROM search_hits WHERE NOT is_raw AND NOT pending AND hit_type IN ('decision', 'learning') AND (project IS NULL OR project = 'harbor-core') AND found_at >= TIMESTAMPTZ '2026-03-10 00:00:00+00'")
def flt2_admission(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits")
    return h.filter(state.admits(types=["decision", "learning"], project="harbor-core", since="2026-03-10", raw=False)).select("hit_id")


@query("SELECT seq FROM world_log WHERE project IS NULL OR project = (SELECT min(project) FROM world_log)")
def flt3_scope(spark: SparkSession, d: str) -> DataFrame:
    one = log(spark, d).agg(F.min("project")).first()[0]
    return log(spark, d).filter(state.in_scope(F.col("project"), one)).select("seq")


@query(f"""WITH {_FIRST}, s AS (SELECT replaces_id AS id, min(at_ts) AS superseded FROM first WHERE replaces_id IS NOT NULL GROUP BY 1),
 v AS (SELECT f.id, CASE WHEN f.replaces_id IS NOT NULL THEN f.at_ts END AS a, s.superseded AS b FROM first f LEFT JOIN s USING (id))
SELECT id FROM v WHERE (a IS NULL OR a <= TIMESTAMPTZ '2026-03-15 00:00:00+00') AND (b IS NULL OR b > TIMESTAMPTZ '2026-03-15 00:00:00+00')""")
def flt4_valid_at(spark: SparkSession, d: str) -> DataFrame:
    e = state.with_validity(quality.first_lines(log(spark, d)))
    return e.filter(state.valid_at(F.col("valid_from"), F.col("valid_until"), iso("2026-03-15"))).select("id")


@query(f"WITH {_HELD} SELECT seq FROM held")
def flt5_holds(spark: SparkSession, d: str) -> DataFrame:
    return state.holding(log(spark, d), log(spark, d)).select("seq")


@query("SELECT seq FROM world_log w WHERE NOT EXISTS (SELECT 1 FROM world_log r WHERE r.retires_id = w.id AND coalesce(lower(trim(r.state)), '') <> 'superseded')")
def flt6_recall_block(spark: SparkSession, d: str) -> DataFrame:
    block = log(spark, d).filter(F.col("retires_id").isNotNull() & (F.coalesce(F.lower(F.trim("state")), F.lit("")) != "superseded")).select(F.col("retires_id").alias("id")).distinct()
    return log(spark, d).join(block, "id", "left_anti").select("seq")


@query("SELECT seq FROM world_log WHERE topic IN (SELECT topic FROM world_log WHERE topic IS NOT NULL GROUP BY topic HAVING count(*) >= 3)")
def flt7_category_filter(spark: SparkSession, d: str) -> DataFrame:
    cat = log(spark, d).filter("topic is not null").groupBy("topic").count().filter("count >= 3").select("topic")
    return log(spark, d).join(cat, "topic", "left_semi").select("seq")


@query("SELECT seq FROM world_log WHERE trim(concat_ws('', title, text, learning, choice, why)) <> ''")
def flt8_has_content(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).filter(F.trim(F.concat_ws("", "title", "text", "learning", "choice", "why")) != "").select("seq")


_BODY = "CASE entry_type WHEN 'decision' THEN concat_ws(' - ', title, choice, why) WHEN 'learning' THEN concat_ws(' - ', title, learning) WHEN 'error' THEN concat_ws(' - ', title, err_class, text) ELSE concat_ws(' - ', title, text) END"


@query(f"SELECT seq, md5({_BODY}) AS body FROM world_log")
def flt9_body_projection(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("seq", F.md5(state.body()).alias("body"))


@query(f"SELECT seq, entry_type, coalesce(title, '') AS title, lower(trim(status)) AS status, array_to_string(tags, ',') AS tags, (replaces_id IS NOT NULL)::INT + (retires_id IS NOT NULL)::INT AS links, left({_BODY}, 80) AS excerpt FROM world_log")
def flt10_entry_row(spark: SparkSession, d: str) -> DataFrame:
    links = F.col("replaces_id").isNotNull().cast("int") + F.col("retires_id").isNotNull().cast("int")
    return log(spark, d).select("seq", "entry_type", F.coalesce("title", F.lit("")).alias("title"), F.lower(F.trim("status")).alias("status"), F.array_join("tags", ",").alias("tags"), links.alias("links"), F.left(state.body(), F.lit(80)).alias("excerpt"))


@query("SELECT seq FROM world_log WHERE contains(lower(concat_ws(' ', title, text, learning, choice, why, topic, agent)), 'register') AND seq > 500 ORDER BY seq LIMIT 50")
def flt11_full_text_page(spark: SparkSession, d: str) -> DataFrame:
    body = F.lower(F.concat_ws(" ", "title", "text", "learning", "choice", "why", "topic", "agent"))
    return log(spark, d).filter((F.col("seq") > 500) & body.contains("register")).orderBy("seq").limit(50).select("seq")


_CW = f"list_distinct(list_filter(regexp_split_to_array(strip_accents(lower({{}})), '[^a-z0-9_-]+'), lambda w: length(w) >= 4 AND w NOT IN ({sql_list(tx.EN_STOP)})))"


@query(f"""WITH p AS (SELECT pair_id, {_CW.format('antwort')} AS a, {_CW.format('prompt')} AS q FROM paar_sauber JOIN eval_tasks USING (task_id) WHERE antwort IS NOT NULL)
SELECT pair_id FROM p WHERE NOT (len(a) >= 3 AND len(list_intersect(a, q))::DOUBLE / len(a) >= 0.7)""")
def flt12_echo(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paar_sauber").filter("antwort is not null").join(table(spark, d, "eval_tasks").select("task_id", "prompt"), "task_id")
    a, q = tx.content_words(F.col("antwort")), tx.content_words(F.col("prompt"))
    return p.filter(~state.is_echo(a, q)).select("pair_id")


@query("SELECT line_id FROM capture_lines WHERE NOT coalesce(lower(trim(line_type)) IN ('summary', 'attachment', 'system', 'tool_result'), false)")
def flt13_line_drop(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capture_lines").filter(~captures.machine_line()).select("line_id")


_USER = "lower(trim(coalesce(message.role, line_type))) IN ('user', 'human') AND message IS NOT NULL AND regexp_matches(coalesce(message.content, ''), '[^\\s\\p{Z}]') AND NOT coalesce(lower(trim(line_type)) IN ('summary', 'attachment', 'system', 'tool_result'), false)"


@query(f"SELECT line_id FROM capture_lines WHERE {_USER}")
def flt14_real_user(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capture_lines").filter(captures.real_user()).select("line_id")


@query("SELECT DISTINCT project, regexp_matches(project, '^[a-z0-9][a-z0-9-]{1,62}$') AND project NOT IN ('global', 'all', 'none') AS ok FROM world_log WHERE project IS NOT NULL")
def flt15_name_checks(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("project").rlike("^[a-z0-9][a-z0-9-]{1,62}$") & ~F.col("project").isin("global", "all", "none")
    return log(spark, d).filter("project is not null").select("project", ok.alias("ok")).distinct()


# ---- joins


@query("SELECT seq, replaces_id, EXISTS (SELECT 1 FROM world_log x WHERE x.id = w.replaces_id) AS replaces_id_found FROM world_log w WHERE replaces_id IS NOT NULL")
def joi1_lookup(spark: SparkSession, d: str) -> DataFrame:
    links = log(spark, d).filter("replaces_id is not null").select("seq", "replaces_id")
    return joins.lookup(links, ["replaces_id"], log(spark, d), "id")


@query("SELECT seq, retires_id FROM world_log w WHERE retires_id IN (SELECT id FROM world_log)")
def joi2_semi_state(spark: SparkSession, d: str) -> DataFrame:
    w = log(spark, d)
    return w.filter("retires_id is not null").select("seq", "retires_id").join(w.select(F.col("id").alias("retires_id")), "retires_id", "left_semi")


@query("SELECT DISTINCT session_id FROM capture_lines c WHERE session_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM journal j WHERE j.session_id = c.session_id)")
def joi3_pending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capture_lines").filter("session_id is not null").select("session_id").distinct().join(table(spark, d, "journal").select("session_id"), "session_id", "left_anti")


def _us(df: DataFrame, key: str, ts: str, *cols: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).select(*cols, F.col(key).alias("k"), F.unix_micros(ts).alias("t"))


@query("""SELECT journal_id, line_id, abs(epoch_us(j.ts) - epoch_us(c.ts)) AS dt_us FROM journal j JOIN capture_lines c ON j.session_id = c.session_id AND abs(epoch_us(j.ts) - epoch_us(c.ts)) <= 15000000
 QUALIFY row_number() OVER (PARTITION BY journal_id ORDER BY abs(epoch_us(j.ts) - epoch_us(c.ts)), line_id) = 1""")
def joi4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return joins.nearest_within(_us(table(spark, d, "journal"), "session_id", "ts", "journal_id"), _us(table(spark, d, "capture_lines"), "session_id", "ts", "line_id"), "k", "journal_id", "line_id", 15_000_000)


@query(f"""SELECT journal_id, line_id, abs(epoch_us(j.ts) - epoch_us(c.ts)) AS dt_us FROM journal j JOIN (SELECT * FROM capture_lines WHERE {_USER}) c ON j.session_id = c.session_id AND abs(epoch_us(j.ts) - epoch_us(c.ts)) <= 300000000
 WHERE j.occasion = 'question' QUALIFY row_number() OVER (PARTITION BY journal_id ORDER BY abs(epoch_us(j.ts) - epoch_us(c.ts)), line_id) = 1""")
def joi5_question_line(spark: SparkSession, d: str) -> DataFrame:
    j = _us(table(spark, d, "journal").filter("occasion = 'question'"), "session_id", "ts", "journal_id")
    return joins.nearest_within(j, _us(table(spark, d, "capture_lines").filter(captures.real_user()), "session_id", "ts", "line_id"), "k", "journal_id", "line_id", 300_000_000)


@query("""WITH m AS (SELECT journal_id AS m_id, session_id, epoch_us(ts) AS t, unnest(ids) AS id FROM journal WHERE ts IS NOT NULL AND session_id IS NOT NULL),
 q AS (SELECT journal_id, session_id, epoch_us(ts) AS t FROM journal WHERE occasion = 'question' AND ts IS NOT NULL AND session_id IS NOT NULL)
SELECT q.journal_id, m.id, min(m.t - q.t) AS after_us FROM q JOIN m ON q.session_id = m.session_id AND m.t > q.t AND m.t <= q.t + 1800000000 GROUP BY 1, 2""")
def joi6_mentions(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "journal").filter("ts is not null and session_id is not null").select("journal_id", "session_id", "occasion", "ids", F.unix_micros("ts").alias("t"))
    w = 1_800_000_000
    b = lambda c: F.floor(c / w)
    q = j.filter("occasion = 'question'").select("journal_id", "session_id", F.col("t").alias("qt"), F.explode(F.array(b(F.col("t")), b(F.col("t")) + 1)).alias("b"))
    m = j.select("session_id", F.col("t").alias("mt"), b(F.col("t")).alias("b"), F.explode("ids").alias("id"))
    near = q.join(m, ["session_id", "b"]).filter((F.col("mt") > F.col("qt")) & (F.col("mt") <= F.col("qt") + w))
    return near.groupBy("journal_id", "id").agg(F.min(F.col("mt") - F.col("qt")).alias("after_us"))


@query("""WITH o AS (SELECT journal_id, session_id AS s, epoch_us(ts) AS t, unnest(ids) AS id FROM journal WHERE occasion = 'question' AND ts IS NOT NULL AND session_id IS NOT NULL),
 f AS (SELECT journal_id, session_id AS s, epoch_us(ts) AS t, unnest(ids) AS id FROM journal WHERE occasion <> 'question' AND ts IS NOT NULL AND session_id IS NOT NULL)
SELECT f.journal_id, f.id, arg_max(o.journal_id, (o.t, o.journal_id)) AS offer, f.t - max(o.t) AS after_us FROM f JOIN o ON f.s = o.s AND f.id = o.id AND o.t <= f.t AND f.t - o.t <= 86400000000 GROUP BY f.journal_id, f.id, f.t""")
def joi7_asof(spark: SparkSession, d: str) -> DataFrame:
    """What is used later in a session is credited to the latest question, a day ago at most, to which the same entry was offered."""
    j = table(spark, d, "journal").filter("ts is not null and session_id is not null").select("journal_id", "occasion", F.col("session_id").alias("s"), F.unix_micros("ts").alias("t"), F.explode("ids").alias("id"))
    used = j.filter("occasion <> 'question'").select("journal_id", "s", "id", "t").distinct()
    found = joins.asof_within(used, j.filter("occasion = 'question'").select(F.col("journal_id").alias("offer"), "s", "id", "t"), ["s", "id"], "journal_id", "offer", 86_400_000_000)
    return found.select("journal_id", "id", "offer", "after_us")


#: All that an entry says, as content_text; entries with their time and distinct words.
_SAYS = "concat_ws(' ', title, topic, err_class, array_to_string(tags, ' '), choice, learning, why, text)"
ENTRY_WORDS_SQL = f"{_FIRST}, ew AS (SELECT id, entry_type, epoch_us(at_ts) AS t, {_CW.format(_SAYS)} AS w FROM first)"


@query(f"""WITH {ENTRY_WORDS_SQL}, x AS (SELECT id, entry_type, t, unnest(w) AS x FROM ew WHERE t IS NOT NULL),
 p AS (SELECT a.id, b.id AS by_id, b.t FROM x a JOIN x b ON a.x = b.x AND b.t > a.t WHERE a.entry_type = 'question' GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT id, arg_min(by_id, (t, by_id)) AS closed_by FROM p GROUP BY id""")
def joi8_earliest_after(spark: SparkSession, d: str) -> DataFrame:
    """By the words of whole entries, all of them."""
    e = entry_words(spark, d)
    q = e.filter("entry_type = 'question'").select(F.col("id").alias("qid"), "t", "w", F.lit(2).alias("need"))
    return joins.first_sharing(q, e.select(F.col("id").alias("eid"), "t", "w")).select(F.col("qid").alias("id"), F.col("eid").alias("closed_by"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS k, l_partkey || ':' || l_suppkey AS f FROM lineitem), df AS (SELECT f, count(*) AS df FROM i GROUP BY f HAVING count(*) BETWEEN 2 AND 12), n AS (SELECT count(DISTINCT k) AS n FROM i)
SELECT a.k AS a, b.k AS b, round(sum(ln(n / df::DOUBLE)), 6) AS strength, count(*) AS shared FROM i a JOIN df ON df.f = a.f JOIN i b ON b.f = a.f AND a.k < b.k, n GROUP BY 1, 2""")
def joi9_shared_features(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").select("l_orderkey", F.concat_ws(":", "l_partkey", "l_suppkey").alias("f")).distinct()
    return joins.shared_features(i, "l_orderkey", "f", 12, i.select("l_orderkey").distinct().count())


@query(f"""WITH {_FIRST}, s AS (SELECT id, {_CW.format("concat_ws(' ', title, choice)")} AS w FROM first WHERE entry_type = 'decision'), e AS (SELECT id, len(w) AS n, unnest(w) AS x FROM s),
 p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (na + nb - shared)::DOUBLE, 6) AS jaccard FROM p WHERE shared >= 2 AND shared / (na + nb - shared)::DOUBLE >= 0.25""")
def joi10_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("entry_type") == "decision", F.concat_ws(" ", "title", "choice")).alias("said")
    s = quality.first_lines(log(spark, d).select("id", "seq", said)).filter("said is not null").select("id", tx.content_words(F.col("said")).alias("w"))
    return joins.overlapping_sets(s, "id", "w")


@query("""WITH t AS (SELECT seq, id, lower(trim(topic)) AS k FROM world_log WHERE topic IS NOT NULL AND trim(topic) <> ''), r AS (SELECT seq, id, k, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM t)
SELECT k AS topic, id, rn::INT AS place FROM r WHERE rn <= 3""")
def joi11_same_subject(spark: SparkSession, d: str) -> DataFrame:
    t = log(spark, d).filter("topic is not null and trim(topic) <> ''").select("seq", "id", F.lower(F.trim("topic")).alias("topic"))
    return rk.top_k(t, "topic", [F.desc("seq")], 3, "place").select("topic", "id", "place")


@query("""WITH a AS (SELECT hit_id, source || ':' || line AS place FROM search_hits WHERE call_name = 'rawOnly'), b AS (SELECT hit_id, source || ':' || line AS place FROM search_hits WHERE call_name <> 'rawOnly')
SELECT coalesce(x.place, y.place) AS place, concat_ws(',', CASE WHEN x.place IS NOT NULL THEN 'a' END, CASE WHEN y.place IS NOT NULL THEN 'b' END) AS found_by FROM (SELECT DISTINCT place FROM a WHERE place IS NOT NULL) x FULL JOIN (SELECT DISTINCT place FROM b WHERE place IS NOT NULL) y ON x.place = y.place""")
def joi12_full_join(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").select("call_name", F.concat("source", F.lit(":"), F.col("line").cast("string")).alias("place")).filter("place is not null")
    a = h.filter("call_name = 'rawOnly'").select("place").distinct().withColumn("a", F.lit("a"))
    b = h.filter("call_name <> 'rawOnly'").select("place").distinct().withColumn("b", F.lit("b"))
    return a.join(b, "place", "full").select("place", F.concat_ws(",", "a", "b").alias("found_by"))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS to_k FROM orders), c AS (SELECT k, k AS root FROM p WHERE to_k IS NULL UNION ALL SELECT p.k, c.root FROM p JOIN c ON p.to_k = c.k)
SELECT k, root FROM c""")
def joi13_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    from logweave.operators.change_feed import resolve_roots

    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    p = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, prev).cast("string").alias("parent"))
    return resolve_roots(p).select(F.col("id").cast("long").alias("k"), F.col("root").cast("long").alias("root"))


@query(r"""SELECT seq FROM world_log w WHERE entry_type = 'error' AND EXISTS (SELECT 1 FROM search_hits h WHERE h.source LIKE '%/errors.jsonl' AND regexp_replace(h.source, '/[^/]*$', '') = CASE WHEN w.project IS NULL THEN 'global' ELSE 'projects/' || w.project END)""")
def joi14_file_scope(spark: SparkSession, d: str) -> DataFrame:
    """Errors whose folder holds an error file that a search has touched."""
    touched = table(spark, d, "search_hits").filter(F.col("source").endswith("/errors.jsonl")).select(F.regexp_replace("source", "/[^/]*$", "").alias("folder")).distinct()
    e = log(spark, d).filter("entry_type = 'error'").select("seq", F.coalesce(F.concat(F.lit("projects/"), "project"), F.lit("global")).alias("folder"))
    return e.join(touched, "folder", "left_semi").select("seq")


@query(f"""WITH {_FIRST} SELECT w.seq, epoch_us(coalesce(f.at_ts, w.at_ts)) AS evidence_us FROM world_log w LEFT JOIN first f ON w.replaces_id = f.id WHERE w.replaces_id IS NOT NULL""")
def joi15_evidence_time(spark: SparkSession, d: str) -> DataFrame:
    f = quality.first_lines(log(spark, d)).select(F.col("id").alias("fid"), F.col("at_ts").alias("f_ts"))
    return log(spark, d).filter("replaces_id is not null").join(f, F.col("replaces_id") == F.col("fid"), "left").select("seq", F.unix_micros(F.coalesce("f_ts", "at_ts")).alias("evidence_us"))


# ---- sets


@query("SELECT 'log' AS drawer, entry_type AS kind, count(*) AS n FROM world_log GROUP BY 2 UNION ALL SELECT 'journal', occasion, count(*) FROM journal GROUP BY 2 UNION ALL SELECT 'hits', hit_type, count(*) FROM search_hits GROUP BY 2")
def set1_union(spark: SparkSession, d: str) -> DataFrame:
    parts = (("log", "world_log", "entry_type"), ("journal", "journal", "occasion"), ("hits", "search_hits", "hit_type"))
    every = None
    for name, t, c in parts:
        x = table(spark, d, t).select(F.lit(name).alias("drawer"), F.col(c).alias("kind"))
        every = x if every is None else every.unionByName(x, allowMissingColumns=True)
    return every.groupBy("drawer", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT agent FROM world_log WHERE agent IS NOT NULL EXCEPT SELECT author FROM documents")
def set2_difference(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("agent").filter("agent is not null").subtract(table(spark, d, "documents").select("author"))


@query("SELECT DISTINCT id FROM (SELECT unnest(ids) AS id FROM journal) INTERSECT SELECT id FROM world_log")
def set3_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "journal").select(F.explode("ids").alias("id")).intersect(log(spark, d).select("id"))


@query("""WITH p AS (SELECT session_id AS k, epoch_us(ts) AS a, epoch_us(ts) + 600000000 AS b FROM journal WHERE ts IS NOT NULL AND session_id IS NOT NULL), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM p),
 g AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, g""")
def set4_interval_union(spark: SparkSession, d: str) -> DataFrame:
    p = _us(table(spark, d, "journal"), "session_id", "ts").filter("t is not null").select("k", F.col("t").alias("a"), (F.col("t") + 600_000_000).alias("b"))
    return state.merge_intervals(p, "k", "a", "b")
