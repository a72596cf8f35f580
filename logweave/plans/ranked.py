"""Queries over windows, ranking and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import dates as dt
from logweave.functions import maths as mt
from logweave.functions import text as tx
from logweave.operators import packing, quality, state
from logweave.operators import ranking as rk
from logweave.plans.aggregates import TERM_GRAPH_SQL, _npmi_sql, tag_graph, term_graph
from logweave.plans.registry import NOW, NOW_SQL, ORACLES, query, sql_list
from logweave.plans.relational import _CW, _FIRST, log
from logweave.session import cut
from logweave.sources.tables import table

_FACTS = f"""WITH {_FIRST}, s AS (SELECT replaces_id AS id, min(at_ts) AS b FROM first WHERE replaces_id IS NOT NULL GROUP BY 1), v AS (SELECT f.topic AS key, f.id, f.title AS value, f.at_ts AS a, s.b FROM first f LEFT JOIN s USING (id) WHERE topic IS NOT NULL),
 h AS (SELECT *, (a IS NULL OR a <= TIMESTAMPTZ '2026-03-20 00:00:00+00') AND (b IS NULL OR TIMESTAMPTZ '2026-03-20 00:00:00+00' < b) AS ok, coalesce(a > TIMESTAMPTZ '2026-03-20 00:00:00+00', false) AS fut, coalesce((a IS NULL OR a <= TIMESTAMPTZ '2026-03-20 00:00:00+00') AND TIMESTAMPTZ '2026-03-20 00:00:00+00' >= b, false) AS ex FROM v),
 c AS (SELECT key, id, value, a FROM h WHERE ok QUALIFY row_number() OVER (PARTITION BY key ORDER BY a DESC NULLS LAST, id DESC, value DESC) = 1),
 g AS (SELECT key, count(*) AS n, count(*) FILTER (fut) AS future, count(*) FILTER (ex) AS expired FROM h GROUP BY key), x AS (SELECT h.key, count(DISTINCT h.value) AS vals FROM h JOIN c ON h.key = c.key AND h.a IS NOT DISTINCT FROM c.a WHERE h.ok GROUP BY h.key),
 facts AS (SELECT g.key, CASE WHEN c.id IS NOT NULL THEN 'current' WHEN future > 0 THEN 'not_yet' WHEN expired > 0 THEN 'expired' ELSE 'none' END AS state, c.id AS current, round((epoch_us(TIMESTAMPTZ '2026-03-20 00:00:00+00') - epoch_us(c.a)) / 86400000000.0)::INT AS age_days,
   coalesce(round((epoch_us(TIMESTAMPTZ '2026-03-20 00:00:00+00') - epoch_us(c.a)) / 86400000000.0) > 10, false) AS stale, coalesce(vals > 1, false) AS conflict, n - (c.id IS NOT NULL)::INT AS history, future, expired FROM g LEFT JOIN c USING (key) LEFT JOIN x USING (key))"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    v = state.with_validity(quality.first_lines(log(spark, d))).filter("topic is not null")
    v = v.select(F.col("topic").alias("key"), "id", F.col("title").alias("value"), F.col("at_ts").alias("valid_from"), "valid_until")
    return state.current_facts(v, dt.iso("2026-03-20"), 10)


@query(_FACTS + " SELECT key, state, current, age_days, stale, conflict, history, future, expired FROM facts")
def win1_current_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d)


@query("SELECT topic, arg_max(seq, seq) AS current, count(*) - 1 AS history FROM world_log WHERE topic IS NOT NULL GROUP BY topic")
def win2_topic_state(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).filter("topic is not null").groupBy("topic").agg(F.max("seq").alias("current"), (F.count(F.lit(1)) - 1).alias("history"))


@query("SELECT seq, id FROM world_log WHERE entry_type = 'learning' AND at_ts IS NOT NULL ORDER BY at_ts DESC, seq DESC LIMIT 20")
def win3_recent(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).filter("entry_type = 'learning' and at_ts is not null").orderBy(F.desc("at_ts"), F.desc("seq")).limit(20).select("seq", "id")


#: Rows that an answer shows, and the share of them that one author may have; two are always allowed.
SHOWN, AUTHOR_SHARE = 10, 0.5


@query("""WITH h AS (SELECT call_name, hit_id, score, world, project IS NULL AS own, row_number() OVER (PARTITION BY call_name, world, project IS NULL ORDER BY score DESC, hit_id) AS rn FROM search_hits WHERE score IS NOT NULL)
SELECT call_name, hit_id FROM h WHERE rn <= greatest(2, floor(10 * 0.5)) OR world IS NULL OR own""")
def win4_author_share(spark: SparkSession, d: str) -> DataFrame:
    """The worlds stand for authors; hits without one, and those of the user's own that belong to no project, are exempt."""
    h = table(spark, d, "search_hits").filter("score is not null").select("call_name", "world", "hit_id", "score", F.col("project").isNull().alias("exempt"))
    return rk.author_share(h, "call_name", "world", [F.desc("score"), F.col("hit_id")], max(2, int(SHOWN * AUTHOR_SHARE))).select("call_name", "hit_id")


@query("WITH r AS (SELECT call_name, hit_type, hit_id, row_number() OVER (PARTITION BY call_name, hit_type ORDER BY score DESC, hit_id) AS rn FROM search_hits WHERE score IS NOT NULL AND hit_type IS NOT NULL) SELECT call_name, hit_id, row_number() OVER (PARTITION BY call_name ORDER BY rn, hit_type, hit_id)::INT AS place FROM r WHERE rn <= 10")
def win5_round_robin(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").filter("score is not null and hit_type is not null").select("call_name", "hit_type", "hit_id", "score")
    r = h.withColumn("rn", F.row_number().over(Window.partitionBy("call_name", "hit_type").orderBy(F.desc("score"), "hit_id"))).filter("rn <= 10")
    return rk.places(r, "call_name", [F.col("rn"), F.col("hit_type"), F.col("hit_id")]).select("call_name", "hit_id", "place")


_HASH = r"left(sha256(trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g'))), 16)"


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {_HASH.format('text')}")
def win6_same_body(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(tx.body_hash(F.col("text")).alias("b")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query(f"WITH b AS (SELECT seq, id, {_HASH.format(chr(39) * 2 + ' || coalesce(text, title)')} AS h, at_ts FROM world_log WHERE coalesce(text, title) IS NOT NULL AND at_ts IS NOT NULL) SELECT h AS body, arg_min(seq, (at_ts, seq)) AS survivor, count(*) AS n FROM b GROUP BY h HAVING count(*) > 1")
def win7_duplicate_retirement(spark: SparkSession, d: str) -> DataFrame:
    b = log(spark, d).withColumn("t", F.coalesce("text", "title")).filter("t is not null and at_ts is not null").select("seq", "at_ts", tx.body_hash(F.col("t")).alias("body"))
    return b.groupBy("body").agg(F.min(F.struct("at_ts", "seq"))["seq"].alias("survivor"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT hit_id, row_number() OVER (PARTITION BY call_name ORDER BY score DESC NULLS LAST, source, line, hit_id)::INT AS place FROM search_hits")
def win8_stable_sort(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").select("call_name", "hit_id", "score", "source", "line")
    return rk.places(h, "call_name", [F.desc_nulls_last("score"), F.asc_nulls_last("source"), F.asc_nulls_last("line"), F.col("hit_id")]).select("hit_id", "place")


@query()
def win9_mmr(spark: SparkSession, d: str) -> DataFrame:
    """Every 20th vector's nearest others, re-ranked for diversity."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    top = 10
    near = rk.nearest_vectors(v.filter("vec_id % 20 = 0"), v, rk.mmr_pool(top))
    return rk.mmr(near.join(v, "vec_id").select("query_id", F.col("vec_id").alias("doc_id"), F.col("score").alias("rel"), "embedding"), top)


_HITS = "h AS (SELECT call_name, hit_id, score, row_number() OVER (PARTITION BY call_name ORDER BY score DESC, hit_id) AS rank, lag(score) OVER (PARTITION BY call_name ORDER BY score DESC, hit_id) AS prev FROM search_hits WHERE score IS NOT NULL)"


@query(f"WITH {_HITS} SELECT call_name, hit_id, rank::INT AS rank FROM h WHERE rank <= 5 OR (rank = 6 AND prev - score <= 0.02 * prev)")
def win10_tie_cut(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").filter("score is not null").select("call_name", "hit_id", "score")
    return rk.cut_with_tie(h, "call_name", "hit_id", 5, 0.02).select("call_name", "hit_id", "rank")


@query("""WITH h AS (SELECT world, score, is_raw AND score > 0.99 AS exact, len(list_filter(string_split(project, '-'), lambda w: NOT contains(lower(entry_text), w))) = 0 AS covered FROM search_hits WHERE score IS NOT NULL AND world IS NOT NULL),
 g AS (SELECT world, bool_or(exact) OR coalesce(bool_or(covered), false) AS sure, list(score ORDER BY score DESC) AS l FROM h GROUP BY world) SELECT world, sure OR l[1] >= 1.9 OR (l[1] >= 0.95 AND (l[2] IS NULL OR l[1] >= 1.05 * l[2])) AS holds FROM g""")
def win11_answer_gate(spark: SparkSession, d: str) -> DataFrame:
    """By world; a hit is fully covered if it names all words of its project."""
    h = table(spark, d, "search_hits").filter("score is not null and world is not null")
    covered = F.forall(F.split("project", "-"), lambda w: F.lower("entry_text").contains(w))
    h = h.select("world", "score", (F.col("is_raw") & (F.col("score") > 0.99)).alias("exact"), F.coalesce(covered, F.lit(False)).alias("full"))
    return rk.answer_holds(h, "world", F.lit(0.95))


@query()
def win12_budgeted_context(spark: SparkSession, d: str) -> DataFrame:
    """Greedy fill of each project's context by newest entries under 2,000 characters; an entry that does not fit is skipped."""
    e = log(spark, d).filter("project is not null and at_ts is not null").select(F.col("project").alias("key"), F.col("seq").alias("id"), F.unix_micros("at_ts").alias("rank"), F.length(state.body()).cast("long").alias("size"))
    return packing.fill(e, 2_000)


@query()
def win13_answer_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an answer in their longest form that still fits a budget of 1,500 characters, by rank."""
    h = table(spark, d, "search_hits").filter("score is not null and entry_text is not null").select(F.col("call_name").alias("key"), F.col("hit_id").alias("id"), (-F.col("score") * 1e6).cast("long").alias("rank"), F.length("entry_text").cast("long").alias("size"))
    return packing.compose(h, 1_500, (1.0, 0.5, 0.2))


@query("""WITH s AS (SELECT path, count(*) AS n, min(ts) AS t FROM capture_lines GROUP BY path), a AS (SELECT path, n, sum(n) OVER (ORDER BY t, path ROWS UNBOUNDED PRECEDING) AS up FROM s), o AS (SELECT path FROM a WHERE up <= 250),
 b AS (SELECT path, sum(n) OVER (ORDER BY n, path ROWS UNBOUNDED PRECEDING) AS up FROM s WHERE path NOT IN (SELECT path FROM o)) SELECT path, 'oldest' AS why FROM o UNION ALL SELECT path, 'smallest' FROM b WHERE up <= 750""")
def win14_digest_selection(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "capture_lines").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t"))
    o = packing.upto(s, [F.col("t"), F.col("path")], "n", 250).select("path", F.lit("oldest").alias("why"))
    rest = s.join(o, "path", "left_anti")
    return o.unionByName(packing.upto(rest, [F.col("n"), F.col("path")], "n", 750).select("path", F.lit("smallest").alias("why")))


@query("SELECT seq, count(*) OVER (PARTITION BY err_class ORDER BY epoch_us(at_ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) >= 3 OR (topic IS NOT NULL AND count(*) OVER (PARTITION BY err_class, topic ORDER BY epoch_us(at_ts) RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING) > 0) AS repeated FROM world_log WHERE entry_type = 'error' AND err_class IS NOT NULL AND at_ts IS NOT NULL")
def win15_repetition(spark: SparkSession, d: str) -> DataFrame:
    return quality.repetition(log(spark, d))


@query("WITH s AS (SELECT unnest(sources) AS source, journal_id, hits, ts FROM journal WHERE ts IS NOT NULL), m AS (SELECT source, journal_id, max(coalesce(hits, 0)) AS role, max(ts) AS t FROM s GROUP BY 1, 2) SELECT source, journal_id, row_number() OVER (PARTITION BY source ORDER BY role DESC, t DESC, journal_id)::INT AS place FROM m QUALIFY place <= 3")
def win16_before_edit(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "journal").filter("ts is not null").select("journal_id", "hits", "ts", F.explode("sources").alias("source"))
    m = s.groupBy("source", "journal_id").agg(F.max(F.coalesce("hits", F.lit(0))).alias("role"), F.max("ts").alias("t"))
    return rk.top_k(m, "source", [F.desc("role"), F.desc("t"), F.col("journal_id")], 3, "place").select("source", "journal_id", "place")


@query("WITH b AS (SELECT occasion, journal_id, row_number() OVER (PARTITION BY occasion ORDER BY journal_id) AS rn, count(*) OVER (PARTITION BY occasion) AS n FROM journal WHERE reason IS NOT NULL) SELECT occasion, journal_id FROM b WHERE rn = (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('2026-04-01', ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) % n + 1")
def win17_daily_pick(spark: SparkSession, d: str) -> DataFrame:
    """One row of each occasion, by the hash of the day."""
    b = table(spark, d, "journal").filter("reason is not null").select("occasion", "journal_id")
    seed = spark.range(1).select(mt.fnv1a(F.lit(NOW[:10])).alias("seed"))
    return rk.places(b, "occasion", [F.col("journal_id")], "rn", "n").crossJoin(F.broadcast(seed)).filter("rn = seed % n + 1").select("occasion", "journal_id")


@query("SELECT hit_id, round(CASE WHEN found_at < max(found_at) OVER (PARTITION BY hit_type) THEN score * 0.35 ELSE score END, 6) AS score FROM search_hits WHERE found_at IS NOT NULL AND score IS NOT NULL AND hit_type IS NOT NULL")
def win18_topic_dampening(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").filter("found_at is not null and score is not null and hit_type is not null")
    newest = h.groupBy("hit_type").agg(F.max("found_at").alias("newest"))
    return h.join(newest, "hit_type").select("hit_id", F.round(F.when(F.col("found_at") < F.col("newest"), F.col("score") * 0.35).otherwise(F.col("score")), 6).alias("score"))


@query(_FACTS + " SELECT key, current FROM facts WHERE state = 'current' AND (stale OR conflict) ORDER BY conflict DESC, age_days DESC, key LIMIT 3")
def win19_verify_candidates(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).filter("state = 'current' and (stale or conflict)").orderBy(F.desc("conflict"), F.desc_nulls_last("age_days"), "key").limit(3).select("key", "current")


# ---- search

_W = f"list_filter(regexp_split_to_array(strip_accents(lower({{}})), '[^a-z0-9_-]+'), lambda w: length(w) >= 4 AND w NOT IN ({sql_list(tx.EN_STOP)}))"
_BM25 = f"""p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_W.format('text')}) AS term FROM documents) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY 1), c AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
 q AS (SELECT item_id, unnest(w) AS term, len(w) AS asked FROM (SELECT item_id, {_CW.format('text')} AS w FROM eval_items)),
 s AS (SELECT item_id, p.doc_id, asked, count(*) AS covered, sum(ln(1 + (c.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS s FROM q JOIN df USING (term) JOIN p ON p.term = q.term JOIN l ON l.doc_id = p.doc_id, c GROUP BY 1, 2, 3),
 r AS (SELECT item_id, doc_id, round(s * (0.6 + 0.4 * covered / asked), 6) AS score, covered, asked FROM s)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", "text")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"WITH {_BM25} SELECT item_id, doc_id, score FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10")
def rnk1_bm25(spark: SparkSession, d: str) -> DataFrame:
    """All held-out items as one batch of queries against all documents."""
    return rk.bm25_search(docs(spark, d), "doc_id", items(spark, d), "item_id", 10).select("item_id", "doc_id", "score")


_TAGS = _npmi_sql("SELECT DISTINCT id AS k, unnest(tags) AS t FROM world_log WHERE id IS NOT NULL", 2, 0.5, 0.05, 8, 10**9)


@query(TERM_GRAPH_SQL + f""", g AS ({_TAGS}), cur(term, neighbour, weight) AS (VALUES ('cursor', 'pointer', 0.6), ('budget', 'limit', 0.6)), q AS (SELECT item_id, unnest({_CW.format('text')}) AS term FROM eval_items)
SELECT item_id, neighbour AS term, max(weight) AS weight FROM (SELECT item_id, neighbour, weight FROM q JOIN (SELECT * FROM g UNION ALL SELECT term, neighbour, weight::DOUBLE FROM cur) USING (term)
 UNION ALL SELECT q.item_id, neighbour, weight FROM q JOIN term_graph USING (term) WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.item_id = q.item_id AND o.term = neighbour)) GROUP BY 1, 2""")
def rnk2_expansion(spark: SparkSession, d: str) -> DataFrame:
    """By curated groups, tags and terms; the last adds no word that is asked already."""
    cur = spark.createDataFrame([("cursor", "pointer", 0.6), ("budget", "limit", 0.6)], "term string, neighbour string, weight double")
    q = items(spark, d).select("item_id", F.explode(tx.content_words(F.col("text"))).alias("term"))
    return rk.expand(q, cur, tag_graph(spark, d), term_graph(spark, d), "item_id")


_BRIDGE = (("sperre", "lock"), ("sicherung", "backup"), ("verzeichnis", "register"), ("abbild", "snapshot"), ("zeitgeber", "timer"))


@query(f"WITH b(asked, written) AS (VALUES {', '.join(str(x) for x in _BRIDGE)}), q AS (SELECT task_id, unnest({_CW.format('prompt')}) AS asked FROM eval_tasks) SELECT task_id, written, 0.8 AS weight FROM q JOIN b USING (asked)")
def rnk3_language_bridge(spark: SparkSession, d: str) -> DataFrame:
    b = spark.createDataFrame(list(_BRIDGE), "asked string, written string")
    q = table(spark, d, "eval_tasks").select("task_id", F.explode(tx.content_words(F.col("prompt"))).alias("asked"))
    return q.join(F.broadcast(b), "asked").select("task_id", "written", F.lit(0.8).alias("weight"))


@query(f"""WITH {_FIRST}, j AS (SELECT lower(trim(session_id)) AS s, ts, {_CW.format('text')} AS w, ids FROM journal WHERE text IS NOT NULL AND ts IS NOT NULL AND session_id IS NOT NULL), a AS (SELECT s, ts, ids, unnest(w) AS from_w FROM j), m AS (SELECT s, ts, from_w, unnest(ids) AS id FROM a),
 t AS (SELECT id, topic FROM first WHERE topic IS NOT NULL), p AS (SELECT from_w, topic AS to_w, count(DISTINCT s) AS sessions, max(ts) AS last FROM m JOIN t USING (id) GROUP BY 1, 2)
SELECT from_w, to_w, sessions FROM p WHERE sessions >= 2 AND last >= {NOW_SQL} - INTERVAL 90 DAY QUALIFY row_number() OVER (PARTITION BY from_w ORDER BY sessions DESC, to_w) <= 4""")
def rnk4_rewrites(spark: SparkSession, d: str) -> DataFrame:
    return rewrites(spark, d)


def rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Words of questions with the topics of what was shown: active from two sessions, not older than 90 days, four at most."""
    j = table(spark, d, "journal").filter("text is not null and ts is not null and session_id is not null")
    m = j.select(F.lower(F.trim("session_id")).alias("s"), "ts", "ids", F.explode(tx.content_words(F.col("text"))).alias("from_w")).select("s", "ts", "from_w", F.explode("ids").alias("id"))
    t = quality.first_lines(log(spark, d)).filter("topic is not null").select("id", F.col("topic").alias("to_w"))
    p = m.join(t, "id").groupBy("from_w", "to_w").agg(F.countDistinct("s").alias("sessions"), F.max("ts").alias("last"))
    p = p.filter((F.col("sessions") >= 2) & (F.col("last") >= dt.iso(NOW) - F.expr("INTERVAL 90 DAY")))
    return rk.top_k(p, "from_w", [F.desc("sessions"), F.col("to_w")], 4).select("from_w", "to_w", "sessions")


@query(f"SELECT from_w, to_w, sessions FROM ({ORACLES['rnk4_rewrites']}) WHERE levenshtein(from_w, to_w) > 2")
def rnk5_rewrite_learning(spark: SparkSession, d: str) -> DataFrame:
    """rnk4's pairs without those that are spellings of each other."""
    return rewrites(spark, d).filter(F.levenshtein("from_w", "to_w") > 2)


@query(f"""WITH v AS (SELECT DISTINCT unnest({_W.format('text')}) AS w FROM documents), s AS (SELECT DISTINCT x FROM (SELECT unnest(string_split(replace(replace(source, '.jsonl', ''), '/', '_'), '_')) AS x, source FROM search_hits)), n AS (SELECT DISTINCT replace(project, '-', '_') AS p FROM world_log WHERE project IS NOT NULL)
SELECT p, part, 0.6 AS weight FROM (SELECT p, unnest(list_distinct(string_split(p, '_'))) AS part FROM n WHERE p NOT IN (SELECT w FROM v)) WHERE part IN (SELECT w FROM v)""")
def rnk6_subwords(spark: SparkSession, d: str) -> DataFrame:
    v = docs(spark, d).select(F.explode(tx.content_words(F.col("text"))).alias("w")).distinct()
    n = log(spark, d).filter("project is not null").select(F.replace("project", F.lit("-"), F.lit("_")).alias("p")).distinct().join(v, F.col("p") == F.col("w"), "left_anti")
    return n.select("p", F.explode(F.array_distinct(F.split("p", "_"))).alias("part")).join(v, F.col("part") == F.col("w"), "left_semi").withColumn("weight", F.lit(0.6))


_IDS = tx.identifiers_sql("documents", "doc_id", "text")


_ASKED_HITS = "(SELECT hit_id AS item_id, entry_text AS text FROM search_hits WHERE entry_text IS NOT NULL)"


@query(f"""WITH {_BM25.replace('eval_items', _ASKED_HITS)}, i AS (SELECT DISTINCT doc_id, lower(i) AS x FROM ({_IDS})), few AS (SELECT x FROM i GROUP BY x HAVING count(*) <= 10), qi AS (SELECT DISTINCT item_id, lower(i) AS x FROM ({tx.identifiers_sql(_ASKED_HITS, 'item_id', 'text')}))
SELECT item_id, i.doc_id, count(*) AS identifiers, max(coalesce(r.score, 0)) AS score FROM qi JOIN few USING (x) JOIN i USING (x) LEFT JOIN r USING (item_id, doc_id) GROUP BY 1, 2""")
def rnk7_exact_hits(spark: SparkSession, d: str) -> DataFrame:
    """The texts of earlier hits ask; documents that share an identifier of at most ten documents answer."""
    asked = table(spark, d, "search_hits").filter("entry_text is not null").select(F.col("hit_id").alias("item_id"), F.col("entry_text").alias("text"))
    i = docs(spark, d).select("doc_id", F.explode(tx.identifiers(F.col("text"))).alias("x"))
    few = i.groupBy("x").count().filter("count <= 10").select("x")
    q = asked.select("item_id", F.explode(tx.identifiers(F.col("text"))).alias("x"))
    hits = cut(q.join(few, "x").join(i, "x").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("identifiers")))
    scored = rk.bm25_scores(docs(spark, d), "doc_id", asked.join(hits.select("item_id").distinct(), "item_id", "left_semi"), "item_id", wanted=hits).select("item_id", "doc_id", "score")
    return hits.join(scored, ["item_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


@query("SELECT call_name, hit_id, row_number() OVER (PARTITION BY call_name ORDER BY is_raw, score DESC, hit_id)::INT AS place FROM search_hits WHERE score IS NOT NULL")
def rnk8_raw_lane(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").filter("score is not null").select("call_name", "hit_id", "score", "is_raw")
    return rk.places(h, "call_name", [F.asc_nulls_last("is_raw"), F.desc("score"), F.col("hit_id")]).select("call_name", "hit_id", "place")


_REASON = "CASE WHEN pending THEN 'pending' WHEN score IS NULL OR score < 0.1 THEN 'weak' WHEN copy > 1 THEN 'duplicate' WHEN share > 5 THEN 'author share' ELSE 'kept' END"
_ELIG = f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY call_name, {_HASH.format("coalesce(entry_text, '')")} ORDER BY score DESC NULLS LAST, hit_id) AS copy FROM search_hits), b AS (SELECT *, row_number() OVER (PARTITION BY call_name, world ORDER BY score DESC NULLS LAST, hit_id) AS share FROM a), e AS (SELECT call_name, hit_id, {_REASON} AS reason FROM b)"""


def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Every hit with the reason why it is kept or not; no row is dropped."""
    best = [F.desc_nulls_last("score"), F.col("hit_id")]
    h = table(spark, d, "search_hits").withColumn("b", tx.body_hash(F.coalesce("entry_text", F.lit(""))))
    h = h.withColumns({"copy": F.row_number().over(Window.partitionBy("call_name", "b").orderBy(*best)), "share": F.row_number().over(Window.partitionBy("call_name", "world").orderBy(*best))})
    weak = F.col("score").isNull() | (F.col("score") < 0.1)
    return h.select("call_name", "hit_id", F.when(F.col("pending"), "pending").when(weak, "weak").when(F.col("copy") > 1, "duplicate").when(F.col("share") > 5, "author share").otherwise("kept").alias("reason"))


@query(_ELIG + " SELECT call_name, count(*) FILTER (reason = 'kept') AS kept, count(*) FILTER (reason <> 'kept') AS dropped, CASE WHEN count(*) FILTER (reason = 'kept') = 0 THEN 'unknown' WHEN count(*) FILTER (reason <> 'kept') > 0 THEN 'partial' ELSE 'complete' END AS coverage FROM e GROUP BY call_name")
def rnk9_retrieve(spark: SparkSession, d: str) -> DataFrame:
    kept, lost = F.count_if(F.col("reason") == "kept"), F.count_if(F.col("reason") != "kept")
    return eligibility(spark, d).groupBy("call_name").agg(kept.alias("kept"), lost.alias("dropped"), F.when(kept == 0, "unknown").when(lost > 0, "partial").otherwise("complete").alias("coverage"))


@query(_ELIG + " SELECT hit_id, reason FROM e WHERE reason <> 'kept'")
def rnk10_explain_missing(spark: SparkSession, d: str) -> DataFrame:
    return eligibility(spark, d).filter("reason <> 'kept'").select("hit_id", "reason")


_LISTS = "a AS (SELECT world, hit_type, hit_id, row_number() OVER (PARTITION BY world ORDER BY score DESC, hit_id) AS rank FROM search_hits WHERE score IS NOT NULL AND world IS NOT NULL), b AS (SELECT world, hit_id, row_number() OVER (PARTITION BY world ORDER BY found_at DESC, hit_id) AS rank FROM search_hits WHERE found_at IS NOT NULL AND world IS NOT NULL)"


def lists(spark: SparkSession, d: str) -> list[DataFrame]:
    h = table(spark, d, "search_hits").filter("world is not null")
    one = rk.places(h.filter("score is not null").select("world", "hit_id", "score"), "world", [F.desc("score"), F.col("hit_id")], "rank").select("world", "hit_id", "rank")
    two = rk.places(h.filter("found_at is not null").select("world", "hit_id", "found_at"), "world", [F.desc("found_at"), F.col("hit_id")], "rank").select("world", "hit_id", "rank")
    return [one, two]


@query(f"WITH {_LISTS} SELECT world, hit_id, round(sum(1.0 / (60 + rank)), 6)::DOUBLE AS score, string_agg(i, ',' ORDER BY i) AS found_by FROM (SELECT world, hit_id, rank, '0' AS i FROM a UNION ALL SELECT world, hit_id, rank, '1' FROM b) GROUP BY 1, 2")
def rnk11_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return rk.fuse(lists(spark, d), "world", "hit_id")


@query(f"WITH {_LISTS}, f AS (SELECT world, hit_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT world, hit_id, rank FROM a UNION ALL SELECT world, hit_id, rank FROM b) GROUP BY 1, 2) SELECT world, hit_id, row_number() OVER (PARTITION BY world ORDER BY score DESC, hit_id)::INT AS place FROM f QUALIFY place <= 5")
def rnk12_variants(spark: SparkSession, d: str) -> DataFrame:
    return rk.top_k(rk.fuse(lists(spark, d), "world", "hit_id"), "world", [F.desc("score"), F.col("hit_id")], 5, "place").select("world", "hit_id", "place")


@query(f"""WITH df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_W.format('text')}) AS w FROM documents) GROUP BY w), n AS (SELECT count(*) AS n FROM documents), q AS (SELECT item_id, unnest({_CW.format('text')}) AS w FROM eval_items)
SELECT item_id, w, CASE WHEN df IS NULL THEN 'unknown' WHEN df <= 0.01 * n THEN 'core' ELSE 'by-catch' END AS part FROM q LEFT JOIN df USING (w), n""")
def rnk13_question_split(spark: SparkSession, d: str) -> DataFrame:
    df = docs(spark, d).select("doc_id", F.explode(tx.content_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n = docs(spark, d).count()
    q = items(spark, d).select("item_id", F.explode(tx.content_words(F.col("text"))).alias("w")).join(df, "w", "left")
    return q.select("item_id", "w", F.when(F.col("df").isNull(), "unknown").when(F.col("df") <= 0.01 * n, "core").otherwise("by-catch").alias("part"))


@query("SELECT hit_id, round(score * least(1.5, 1 + 0.2 * (project = 'harbor-core')::INT + 0.3 * (hit_type = 'error')::INT + 0.1 * contains(entry_text, '.mjs')::INT), 6)::DOUBLE AS score FROM search_hits WHERE score IS NOT NULL AND project IS NOT NULL AND entry_text IS NOT NULL AND hit_type IS NOT NULL")
def rnk14_rerank(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").filter("score is not null and project is not null and entry_text is not null and hit_type is not null")
    up = 1 + 0.2 * (F.col("project") == "harbor-core").cast("int") + 0.3 * (F.col("hit_type") == "error").cast("int") + 0.1 * F.col("entry_text").contains(".mjs").cast("int")
    return h.select("hit_id", F.round(F.col("score") * F.least(F.lit(1.5), up), 6).alias("score"))


@query(f"WITH e AS (SELECT doc_id, unnest({_CW.format('title')}) AS term FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)) SELECT term, count(*) AS docs, round(sum(0.3), 4)::DOUBLE AS weight FROM e GROUP BY term")
def rnk15_document_expansion(spark: SparkSession, d: str) -> DataFrame:
    e = docs(spark, d).select(F.explode(tx.content_words(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("term"))
    return e.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.round(F.count(F.lit(1)) * 0.3, 4).alias("weight"))


@query(f"WITH {_BM25}, k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, lag(score) OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS prev, max(score) OVER (PARTITION BY item_id) AS best FROM r) SELECT item_id, doc_id, rank::INT AS rank FROM k WHERE best >= 5 AND (rank <= 5 OR (rank = 6 AND prev - score <= 0.02 * prev))")
def rnk16_ranked_find(spark: SparkSession, d: str) -> DataFrame:
    """Search, gate by the bar, and cut with ties."""
    r = rk.bm25_search(docs(spark, d), "doc_id", items(spark, d), "item_id", 6)
    r = r.withColumn("best", F.max("score").over(Window.partitionBy("item_id"))).filter(F.col("best") >= mt.FIND_BAR)
    return rk.cut_with_tie(r, "item_id", "doc_id", 5, 0.02).select("item_id", "doc_id", "rank")


@query(f"""WITH {_FIRST}, df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT id, unnest({_CW.format("concat_ws(' ', title, text, learning)")}) AS w FROM first) GROUP BY w), n AS (SELECT count(*) AS n FROM first), j AS (SELECT journal_id, ids, unnest({_CW.format('text')}) AS w FROM journal WHERE text IS NOT NULL), m AS (SELECT DISTINCT unnest(ids) AS id, w FROM j),
 e AS (SELECT id, {_CW.format("concat_ws(' ', title, text, learning)")} AS own FROM first), c AS (SELECT m.id, m.w, df.df FROM m JOIN e USING (id) JOIN df USING (w), n WHERE NOT list_contains(own, w) AND df <= 0.02 * n), u AS (SELECT w FROM c GROUP BY w HAVING count(DISTINCT id) = 1)
SELECT id, w FROM c SEMI JOIN u USING (w) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, w) <= 5""")
def rnk17_asked_words(spark: SparkSession, d: str) -> DataFrame:
    e = quality.first_lines(log(spark, d)).select("id", tx.content_words(F.concat_ws(" ", "title", "text", "learning")).alias("own"))
    df, n = e.select(F.explode("own").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")), e.count()
    j = table(spark, d, "journal").filter("text is not null").select("ids", F.explode(tx.content_words(F.col("text"))).alias("w")).select(F.explode("ids").alias("id"), "w").distinct()
    c = j.join(e, "id").filter(~F.array_contains("own", F.col("w"))).join(df.filter(F.col("df") <= 0.02 * n), "w").select("id", "w", "df")
    one = c.groupBy("w").agg(F.countDistinct("id").alias("k")).filter("k = 1").select("w")
    return rk.top_k(c.join(one, "w", "left_semi"), "id", [F.col("df"), F.col("w")], 5).select("id", "w")


_SKILL = f"""WITH {_FIRST}, s AS (SELECT id, {_CW.format("coalesce(topic, '')")} AS trig, {_CW.format("coalesce(title, '')")} AS tit FROM first WHERE entry_type IN ('procedure', 'learning')), q AS (SELECT task_id, {_CW.format('prompt')} AS w FROM eval_tasks),
 e AS (SELECT id, unnest(trig) AS x, 2 AS p FROM s UNION ALL SELECT id, unnest(tit), 1 FROM s), z AS (SELECT task_id, unnest(w) AS x FROM q), m AS (SELECT task_id, id, sum(p)::BIGINT AS score FROM z JOIN e USING (x) GROUP BY 1, 2)"""


def skill_scores(spark: SparkSession, d: str) -> DataFrame:
    """Twice the words shared with an item's topic plus those shared with its title, by an inverted index."""
    s = quality.first_lines(log(spark, d)).filter(F.col("entry_type").isin("procedure", "learning"))
    words = lambda c: F.explode(tx.content_words(F.coalesce(c, F.lit("")))).alias("x")
    e = s.select("id", words("topic")).withColumn("p", F.lit(2)).unionByName(s.select("id", words("title")).withColumn("p", F.lit(1)))
    z = table(spark, d, "eval_tasks").select("task_id", F.explode(tx.content_words(F.col("prompt"))).alias("x"))
    return z.join(e, "x").groupBy("task_id", "id").agg(F.sum("p").alias("score"))


@query(_SKILL + " SELECT task_id, id, score FROM m QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id) <= 3")
def rnk18_skill_find(spark: SparkSession, d: str) -> DataFrame:
    return rk.top_k(skill_scores(spark, d), "task_id", [F.desc("score"), F.col("id")], 3)


@query(_SKILL + ", r AS (SELECT task_id, id, score, rank() OVER (PARTITION BY task_id ORDER BY score DESC) AS k, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id) AS n FROM m WHERE score >= 2) SELECT task_id, id FROM r WHERE k = 1 AND n <= 3")
def rnk19_skill_offer(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy(F.desc("score"))
    r = skill_scores(spark, d).filter("score >= 2").withColumns({"k": F.rank().over(w), "n": F.row_number().over(w.orderBy(F.desc("score"), "id"))})
    return r.filter("k = 1 and n <= 3").select("task_id", "id")


@query("SELECT title AS name, arg_max(id, seq) AS current, arg_max(lower(trim(status)), seq) FILTER (status IS NOT NULL) AS status, count(*) AS versions FROM world_log WHERE entry_type IN ('procedure', 'learning', 'duty') AND title IS NOT NULL GROUP BY title")
def rnk20_skill_registry(spark: SparkSession, d: str) -> DataFrame:
    s = log(spark, d).filter(F.col("entry_type").isin("procedure", "learning", "duty") & F.col("title").isNotNull())
    last = F.max(F.when(F.col("status").isNotNull(), F.struct("seq", F.lower(F.trim("status")).alias("s"))))["s"]
    return s.groupBy(F.col("title").alias("name")).agg(F.max_by("id", "seq").alias("current"), last.alias("status"), F.count(F.lit(1)).alias("versions"))


# ---- maths on search


@query(f"WITH {_BM25} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, c")
def mth1_idf(spark: SparkSession, d: str) -> DataFrame:
    df, corpus = rk.term_stats(rk.postings(docs(spark, d), "doc_id"), "doc_id")
    return df.join(F.broadcast(corpus), F.lit(True)).select("term", F.round(mt.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"WITH {_BM25} SELECT item_id, max(covered) AS covered, round(0.6 + 0.4 * max(covered) / any_value(asked), 6)::DOUBLE AS factor FROM r GROUP BY item_id")
def mth2_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = rk.bm25_scores(docs(spark, d), "doc_id", items(spark, d), "item_id")
    g = r.groupBy("item_id", "asked").agg(F.max("covered").alias("covered"))
    return g.select("item_id", "covered", F.round(mt.coverage(F.col("covered"), F.col("asked")), 6).alias("factor"))


@query(f"""WITH p AS (SELECT item_id, term, count(*)::DOUBLE AS tf FROM (SELECT item_id, unnest({_W.format('text')}) AS term FROM eval_items) GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM p GROUP BY 1)
SELECT a.item_id AS a, b.item_id AS b, round(sum(a.tf * b.tf) / any_value(x.n * y.n), 6) AS cosine FROM p a JOIN p b ON a.term = b.term AND a.item_id < b.item_id JOIN n x ON x.item_id = a.item_id JOIN n y ON y.item_id = b.item_id GROUP BY 1, 2 HAVING round(sum(a.tf * b.tf) / any_value(x.n * y.n), 6) >= 0.5""")
def mth3_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = rk.postings(items(spark, d), "item_id")
    n = p.groupBy("item_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("n"))
    u = p.join(n, "item_id").select("item_id", "term", (F.col("tf") / F.col("n")).alias("w"))
    x = u.alias("a").join(u.alias("b"), (F.col("a.term") == F.col("b.term")) & (F.col("a.item_id") < F.col("b.item_id")))
    return x.groupBy(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).agg(F.round(F.sum(F.col("a.w") * F.col("b.w")), 6).alias("cosine")).filter("cosine >= 0.5")


@query(f"WITH {_LISTS} SELECT world, hit_id, round(1.0 / (60 + rank), 6)::DOUBLE AS share FROM a")
def mth4_rrf(spark: SparkSession, d: str) -> DataFrame:
    return lists(spark, d)[0].select("world", "hit_id", F.round(mt.rrf(F.col("rank")), 6).alias("share"))


@query(f"""WITH {_BM25}, k AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r), g AS (SELECT item_id, min(doc_id) AS gold FROM r WHERE covered >= 0.8 * asked GROUP BY item_id), h AS (SELECT g.item_id, k.rank FROM g LEFT JOIN k ON k.item_id = g.item_id AND k.doc_id = g.gold AND k.rank <= 10)
SELECT count(*) AS queries, round(avg(coalesce(rank = 1, false)::INT), 6) AS r1, round(avg((rank IS NOT NULL)::INT), 6) AS r10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM h""")
def mth8_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = cut(rk.bm25_scores(docs(spark, d), "doc_id", items(spark, d), "item_id"))
    gold = r.filter(F.col("covered") >= 0.8 * F.col("asked")).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    h = gold.join(rk.top_k(r, "item_id", [F.desc("score"), F.col("doc_id")], 10, "rank"), ["item_id", "doc_id"], "left")
    one = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 6)
    return h.agg(F.count(F.lit(1)).alias("queries"), one((F.col("rank") == 1).cast("int")).alias("r1"), one(F.col("rank").isNotNull().cast("int")).alias("r10"), one(1 / F.col("rank")).alias("mrr"))


@query("SELECT line_id, concat_ws(' ', message.role, message.content) AS text FROM capture_lines WHERE message IS NOT NULL AND line_id % 2 = 0 UNION ALL SELECT line_id, message.content FROM capture_lines WHERE message IS NOT NULL AND line_id % 2 = 1")
def mth10_message_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of messages whose content is a text, or a list of parts."""
    m = table(spark, d, "capture_lines").filter("message is not null")
    part = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    parts = F.to_json(F.filter(F.array(part(F.col("message.role")), part(F.col("message.content"))), lambda p: p["text"].isNotNull()))
    raw = F.when(F.col("line_id") % 2 == 0, parts).otherwise(F.to_json(F.struct(F.col("message.content").alias("v"))))
    listed = F.from_json("raw", "array<struct<type:string,text:string>>")
    text = F.array_join(F.transform(listed, lambda p: p["text"]), " ")
    return m.select("line_id", raw.alias("raw")).select("line_id", F.when(F.col("line_id") % 2 == 0, text).otherwise(F.get_json_object("raw", "$.v")).alias("text"))


@query("SELECT event_id, event_type AS tool, props::JSON->>'k' AS input FROM events WHERE event_type IN ('click', 'purchase')")
def mth11_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    call = F.array(F.struct(F.col("event_type").alias("name"), F.from_json("props", "map<string,string>").alias("input")))
    e = table(spark, d, "events").select("event_id", F.explode(F.filter(call, lambda c: c["name"].isin("click", "purchase"))).alias("c"))
    return e.select("event_id", F.col("c.name").alias("tool"), F.col("c.input")["k"].alias("input"))


@query("SELECT seq, unnest(list_distinct(list_filter([replaces_id, retires_id, id], lambda x: x IS NOT NULL))) AS ref FROM world_log")
def mth12_provenance(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("seq", F.explode(F.array_distinct(F.array_compact(F.array("replaces_id", "retires_id", "id")))).alias("ref"))


@query("SELECT line_id, md5(concat_ws('|', line_type, message.role, message.content, surface, project)) AS strings FROM capture_lines")
def mth13_nested_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capture_lines").select("line_id", F.md5(F.concat_ws("|", "line_type", "message.role", "message.content", "surface", "project")).alias("strings"))


@query()
def txt6_compound_split(spark: SparkSession, d: str) -> DataFrame:
    """Words that are made of two or three words of the corpus, with linking letters."""
    return packing.compounds(docs(spark, d))
