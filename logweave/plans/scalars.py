"""Queries over the text, date and maths functions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import dates as dt
from logweave.functions import phrases as ph
from logweave.functions import maths as mt
from logweave.functions import text as tx
from logweave.plans.registry import NOW, NOW_SQL, query, sql_list
from logweave.sources.tables import table

_RAW = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 2)"


def _stem_sql(w: str, suffixes, undouble: bool) -> str:
    whens = ""
    for s in suffixes:
        cut = f"left({w}, length({w}) - {len(s)})"
        then = f"CASE WHEN right({cut}, 1) = left(right({cut}, 2), 1) AND right({cut}, 2) NOT IN ('ss', 'll', 'ee', 'oo') THEN left({cut}, length({cut}) - 1) ELSE {cut} END" if undouble else cut
        whens += f" WHEN length({w}) >= {len(s) + 4} AND ends_with({w}, '{s}') THEN {then}"
    plural = f" WHEN ends_with({w}, 'ies') AND length({w}) >= 6 THEN left({w}, length({w}) - 3) || 'y'" if undouble else ""
    return f"CASE WHEN length({w}) <= 4 THEN {w}{plural}{whens} ELSE {w} END"


_EN = _stem_sql("{0}", tx.EN_SUFFIXES, True)
_DE = _stem_sql("{0}", tx.DE_SUFFIXES, False)
_PLAIN = f"translate({{}}, '{tx.MARKED}', '{tx.UNMARKED}')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "project", "author", "created_at")


@query(f"""
WITH w AS (SELECT doc_id, unnest({_RAW.format('text')}) AS w FROM documents),
     f AS (SELECT doc_id, unnest(CASE WHEN contains(w, '-') THEN list_concat([w], list_filter(string_split(w, '-'), lambda p: length(p) >= 2 AND p NOT IN ({sql_list(tx.EN_STOP)}))) ELSE [w] END) AS f
           FROM w WHERE w NOT IN ({sql_list(tx.EN_STOP)})),
     t AS (SELECT {_EN.format(_PLAIN.format('f'))} AS term FROM f UNION ALL SELECT {_EN.format('f')} FROM f WHERE f <> {_PLAIN.format('f')})
SELECT term, count(*) AS n FROM t GROUP BY term""")
def txt1_tokenize(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select(F.explode(tx.raw_words(F.col("text"))).alias("w")).filter(~F.col("w").isin(*tx.EN_STOP))
    f = w.select(F.explode(tx.hyphen_forms(F.col("w"))).alias("f"))
    forms = f.groupBy("f").count().select(F.explode(tx.spellings(F.col("f"))).alias("f"), "count")
    return forms.groupBy(tx.en_stem(F.col("f")).alias("term")).agg(F.sum("count").alias("n"))


@query(f"""
WITH w AS (SELECT DISTINCT unnest({_RAW.format('text')}) AS w FROM documents)
SELECT w, array_to_string(list_filter(string_split(w, '-'), lambda p: length(p) >= 2 AND p NOT IN ({sql_list(tx.EN_STOP)})), ',') AS parts FROM w WHERE contains(w, '-')""")
def txt2_hyphen_forms(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select(F.explode(tx.raw_words(F.col("text"))).alias("w")).filter(F.instr("w", "-") > 0).distinct()
    forms = tx.hyphen_forms(F.col("w"))
    return w.select("w", F.array_join(F.slice(forms, 2, F.greatest(F.size(forms) - 1, F.lit(0))), ",").alias("parts"))


@query(f"SELECT w, {_EN.format('w')} AS stem FROM (SELECT DISTINCT unnest({_RAW.format('text')}) AS w FROM documents)")
def txt3_english_stem(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.explode(tx.raw_words(F.col("text"))).alias("w")).distinct().select("w", tx.en_stem(F.col("w")).alias("stem"))


@query(f"""
WITH w AS (SELECT DISTINCT unnest({_RAW.format('text')}) AS w FROM documents), f AS (SELECT w, replace(replace(replace(replace(w, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS folded FROM w)
SELECT w, folded, {_DE.format('folded')} AS stem FROM f""")
def txt4_german_stem(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select(F.explode(tx.raw_words(F.col("text"))).alias("w")).distinct().withColumn("folded", tx.fold_german(F.col("w")))
    return w.select("w", "folded", tx.de_stem(F.col("folded")).alias("stem"))


@query(f"SELECT w, strip_accents(w) AS plain FROM (SELECT DISTINCT unnest({_RAW.format('text')}) AS w FROM documents) WHERE w <> strip_accents(w)")
def txt5_strip_accents(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select(F.explode(tx.raw_words(F.col("text"))).alias("w")).distinct().withColumn("plain", tx.strip_accents(F.col("w")))
    return w.filter("w <> plain")


@query(f"""
WITH w AS (SELECT doc_id, unnest({_RAW.format('text')}) AS w FROM documents),
     c AS (SELECT doc_id, count(*) FILTER (w IN ({sql_list(tx.EN_STOP)})) AS en, count(*) FILTER (w IN ({sql_list(tx.DE_STOP)})) AS de FROM w GROUP BY doc_id)
SELECT doc_id, en, de, CASE WHEN greatest(en, de) = 0 OR (greatest(en, de) - least(en, de))::DOUBLE / greatest(en, de) < {tx.LANGUAGE_MARGIN} THEN 'uncertain' WHEN en > de THEN 'en' ELSE 'de' END AS language FROM c""")
def txt7_detect_language(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select("doc_id", F.explode(tx.raw_words(F.col("text"))).alias("w"))
    c = w.groupBy("doc_id").agg(F.count_if(F.col("w").isin(*tx.EN_STOP)).alias("en"), F.count_if(F.col("w").isin(*tx.DE_STOP)).alias("de"))
    return c.withColumn("language", tx.language_of(F.col("en"), F.col("de")))


@query(f"""
WITH w AS (SELECT DISTINCT doc_id, unnest({_RAW.format('text')}) AS w FROM documents), f AS (SELECT w, count(*) AS df FROM w GROUP BY w)
SELECT w AS term, df, 0.45 AS weight FROM f WHERE starts_with(w, 'sea') ORDER BY df DESC, w LIMIT 50""")
def txt8_wildcard_prefix(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select("doc_id", F.explode(F.array_distinct(tx.raw_words(F.col("text")))).alias("term")).filter(F.startswith("term", F.lit("sea")))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("weight", F.lit(0.45)).orderBy(F.desc("df"), "term").limit(50)


@query(f"""
SELECT task_id, array_to_string(list_distinct_ordered, ' ') AS words FROM (SELECT task_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered
 FROM (SELECT task_id, list_filter(regexp_split_to_array(strip_accents(lower(prompt)), '[^a-z0-9_-]+'), lambda w: length(w) >= 4 AND w NOT IN ({sql_list(tx.EN_STOP)})) AS l FROM eval_tasks))""")
def txt9_content_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_tasks").select("task_id", F.array_join(tx.content_words(F.col("prompt")), " ").alias("words"))


@query(f"""
WITH df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9_-]+'), lambda w: length(w) >= 4 AND w NOT IN ({sql_list(tx.EN_STOP)}))) AS w FROM documents) GROUP BY w),
     q AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM (SELECT item_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9_-]+'), lambda w: length(w) >= 4 AND w NOT IN ({sql_list(tx.EN_STOP)})) AS l FROM eval_items)),
     e AS (SELECT item_id, l[i] AS w, i FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM q)),
     r AS (SELECT item_id, e.w, i, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), e.w) AS rn FROM e LEFT JOIN df USING (w))
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS query FROM r WHERE rn <= 8 GROUP BY item_id""")
def txt10_retrieval_query(spark: SparkSession, d: str) -> DataFrame:
    from logweave.operators.ranking import retrieval_queries

    return retrieval_queries(table(spark, d, "eval_items").select("item_id", "text"), "item_id", docs(spark, d).select("doc_id", "text"), 8)


@query("""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '["“„][^"“”„\\n]{2,200}["”“]'), lambda q: q[2:-2]), '|') AS quotes FROM documents WHERE len(regexp_extract_all(text, '["“„][^"“”„\\n]{2,200}["”“]')) > 0""")
def txt11_quoted_phrases(spark: SparkSession, d: str) -> DataFrame:
    q = docs(spark, d).select("doc_id", tx.quoted_phrases(F.col("text")).alias("q")).filter(F.size("q") > 0)
    return q.select("doc_id", F.array_join("q", "|").alias("quotes"))


_CW = f"list_filter(regexp_split_to_array(strip_accents(lower({{}})), '[^a-z0-9_-]+'), lambda w: length(w) >= 4 AND w NOT IN ({sql_list(tx.EN_STOP)}))"


@query(f"""
WITH e AS (SELECT id, arg_min(struct_pack(b := concat_ws(' ', title, text, learning), r := replaces_id), seq) AS x FROM world_log WHERE id IS NOT NULL GROUP BY id),
     df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT id, unnest({_CW.format('x.b')}) AS w FROM e) GROUP BY w),
     p AS (SELECT n.id, o.x.b AS old, n.x.b AS new FROM e n JOIN e o ON n.x.r = o.id WHERE n.id <> o.id),
     w AS (SELECT DISTINCT id, unnest({_CW.format('old')}) AS w, new FROM p)
SELECT id, string_agg(w, ' ' ORDER BY w) AS lost FROM w JOIN df USING (w) WHERE df <= 3 AND NOT list_contains({_CW.format('new')}, w) GROUP BY id""")
def txt12_lost_correction_content(spark: SparkSession, d: str) -> DataFrame:
    from logweave.operators.quality import lost_content

    return lost_content(table(spark, d, "world_log"), most_df=3)


_ID_SQL = tx.identifiers_sql("documents", "doc_id", "text")


@query(f"SELECT DISTINCT doc_id, lower(i) AS identifier FROM ({_ID_SQL})")
def txt13_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.explode(tx.identifiers(F.col("text"))).alias("identifier"))


@query(f"""
WITH i AS (SELECT DISTINCT doc_id, lower(i) AS identifier FROM ({_ID_SQL})), q AS (SELECT DISTINCT journal_id, unnest(ids) AS x FROM journal),
     n AS (SELECT identifier, count(*) AS n FROM i GROUP BY identifier)
SELECT identifier, n AS docs, min(doc_id) AS first_doc FROM i JOIN n USING (identifier) WHERE n <= 3 GROUP BY identifier, n""")
def txt14_exact_lane(spark: SparkSession, d: str) -> DataFrame:
    i = docs(spark, d).select("doc_id", F.explode(tx.identifiers(F.col("text"))).alias("identifier"))
    return i.groupBy("identifier").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc")).filter("docs <= 3")


_RED = "message.content"
for _p, _m in tx.SECRETS:
    _RED = f"regexp_replace({_RED}, '{_p}', '{_m}', 'g')"


@query(rf"SELECT line_id, md5({_RED}) AS digest, len(regexp_extract_all({_RED}, '\[secret:[a-z]+\]')) AS markers FROM capture_lines WHERE message.content IS NOT NULL")
def txt15_redact(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "capture_lines").filter("message.content is not null").select("line_id", tx.redact(F.col("message.content")).alias("t"))
    return r.select("line_id", F.md5("t").alias("digest"), tx.redactions(F.col("t")).alias("markers"))


@query("SELECT line_id, replace(replace(message.content, 'register', '[secret:env]'), 'cursor', '[secret:env]') AS text FROM capture_lines WHERE contains(message.content, 'register') OR contains(message.content, 'cursor')")
def txt16_redact_values(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "capture_lines").filter(F.col("message.content").contains("register") | F.col("message.content").contains("cursor"))
    return r.select("line_id", tx.redact_values(F.col("message.content"), ["cursor", "register"]).alias("text"))


@query(f"SELECT line_id, md5({_RED}) AS digest, message.role AS role FROM capture_lines WHERE message IS NOT NULL")
def txt17_redact_nested(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("message").withField("content", tx.redact(F.col("message.content")))
    return table(spark, d, "capture_lines").filter("message is not null").select("line_id", m.alias("m")).select("line_id", F.md5("m.content").alias("digest"), "m.role")


@query(r"SELECT doc_id, left(sha256(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), 16) AS body FROM documents")
def txt18_canonical_body(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.body_hash(F.col("text")).alias("body"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[{tx.BIDI}]')) AS controls FROM documents")
def txt19_bidi(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(f"[{tx.BIDI}]")).alias("controls"))


@query(rf"SELECT line_id, regexp_replace(left({_RED}, 60), '\[[a-z:]*$', '') AS head FROM capture_lines WHERE message.content IS NOT NULL")
def txt20_cut_masked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capture_lines").filter("message.content is not null").select("line_id", tx.cut_masked(tx.redact(F.col("message.content")), 60).alias("head"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: contains(lower(x), 'cursor'))[1] AS line FROM documents)
SELECT doc_id, substr(line, greatest(1, strpos(lower(line), 'cursor') - 40)::BIGINT, 80) AS snippet FROM l WHERE line IS NOT NULL""")
def txt21_snippet(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.snippet(F.col("text"), "cursor", 80).alias("snippet")).filter("snippet is not null")


_NORM = r"regexp_replace(lower(trim({})), '[_\s]+', '-', 'g')"


@query(rf"""
WITH p AS (SELECT DISTINCT project AS n FROM documents WHERE project IS NOT NULL), k AS (SELECT n, {_NORM.format('n')} AS x, replace({_NORM.format('n')}, '-', '') AS c FROM p),
     j AS (SELECT a.n AS a, b.n AS b, a.x AS ax, b.x AS bx, a.c AS ac, b.c AS bc, least(length(a.c), length(b.c)) AS s, levenshtein(a.c, b.c) AS d FROM k a JOIN k b ON a.n < b.n)
SELECT a, b, CASE WHEN ax = bx THEN 'same' WHEN ac = bc THEN 'compact' WHEN starts_with(ax, bx || '-') OR ends_with(ax, '-' || bx) OR starts_with(bx, ax || '-') OR ends_with(bx, '-' || ax) THEN 'part' ELSE 'letters' END AS reason
FROM j WHERE ax = bx OR ac = bc OR starts_with(ax, bx || '-') OR ends_with(ax, '-' || bx) OR starts_with(bx, ax || '-') OR ends_with(bx, '-' || ax) OR (s >= 5 AND d <= 2) OR (s >= 3 AND d <= 1)""")
def txt22_similar_names(spark: SparkSession, d: str) -> DataFrame:
    from logweave.operators.joins import similar_names

    return similar_names(docs(spark, d).select(F.col("project").alias("n")))


@query(r"""
WITH t AS (SELECT DISTINCT topic, project FROM world_log WHERE topic IS NOT NULL)
SELECT topic, coalesce(project, '') AS project, array_to_string(list_filter([CASE WHEN length(trim(topic)) > 12 THEN 'long' END, CASE WHEN regexp_matches(trim(topic), '[.!?,;:]|\s\(') THEN 'punctuation' END,
 CASE WHEN len(regexp_split_to_array(trim(topic), '\s+')) > 4 THEN 'words' END, CASE WHEN starts_with(trim(topic), project || '/') THEN 'prefix' END], lambda x: x IS NOT NULL), ',') AS warnings FROM t""")
def txt23_topic_check(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "world_log").filter("topic is not null").select("topic", "project").distinct()
    return t.select("topic", F.coalesce("project", F.lit("")).alias("project"), F.array_join(tx.topic_warnings(F.col("topic"), F.col("project"), 12), ",").alias("warnings"))


@query(f"SELECT task_id, trim(regexp_replace(trim('Please, ' || prompt), '{tx.FRAMES}', '')) AS question FROM eval_tasks")
def txt24_drop_frame(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_tasks").select("task_id", tx.drop_frame(F.concat(F.lit("Please, "), "prompt")).alias("question"))


@query(rf"""
WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, '. ', chr(10) || 'Error: '), '\r?\n'), lambda x: regexp_matches(x, '{tx.FAILURES}')) AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l[1:8], lambda x: left(trim(x), 300)), chr(10)) AS signature FROM l WHERE len(l) > 0""")
def txt25_error_signature(spark: SparkSession, d: str) -> DataFrame:
    lines = F.replace(F.col("text"), F.lit(". "), F.lit("\nError: "))
    return docs(spark, d).select("doc_id", tx.error_signature(lines).alias("signature")).filter("signature is not null")


@query(r"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '([\w./-]+\.(?:mjs|js|py|json|jsonl|md|ts))\b') AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ',') AS files FROM m WHERE len(l) > 0""")
def txt26_file_mentions(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.file_mentions(F.col("text")).alias("f")).filter(F.size("f") > 0).select("doc_id", F.array_join("f", ",").alias("files"))


_COMMANDS = r"""SELECT pair_id, trim(c) AS command FROM (SELECT pair_id, unnest(string_split(antwort, '```')) AS c, generate_subscripts(string_split(antwort, '```'), 1) AS i FROM paar_sauber WHERE antwort IS NOT NULL) WHERE i % 2 = 0"""


@query(rf"""
SELECT pair_id, CASE WHEN regexp_matches(command, '(?:^|[|;&]\s*)(?:git\s+(?:commit|push|add)|npm|node|mkdir|rm|mv|cp|touch|tee|chmod)(?:$|[\s|;&>])') OR regexp_matches(command, '(?:^|[^=>-])>>?\s*[^&>(\s]') THEN 'write'
 WHEN regexp_matches(command, '(?:^|[|;&]\s*)(?:cat|bat|sed|head|tail|less|more|zcat|zless|jq|wc|nl|column)(?:$|[\s|;&>])') THEN 'read' WHEN regexp_matches(command, '(?:^|[|;&]\s*)(?:grep|rg|ag|ack|find|fd|ls|tree|locate)(?:$|[\s|;&>])') THEN 'search' ELSE 'other' END AS kind
FROM (SELECT pair_id, trim(regexp_replace(command, '\s+', ' ', 'g')) AS command FROM ({_COMMANDS}))""")
def txt27_command_kind(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "paar_sauber").filter("antwort is not null").select("pair_id", F.posexplode(F.split("antwort", "```")).alias("i", "c")).filter("i % 2 = 1")
    return parts.select("pair_id", tx.command_kind(F.trim(F.regexp_replace("c", r"\s+", " "))).alias("kind"))


@query(f"""
SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}]+'), lambda x: length(x) >= 3 AND x NOT IN ({sql_list(tx.EN_STOP)})))), ',') AS form FROM (SELECT id, min(title) AS title FROM world_log WHERE title IS NOT NULL GROUP BY id)""")
def txt28_short_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "world_log").filter("title is not null").groupBy("id").agg(F.min("title").alias("title")).select("id", tx.short_form(F.col("title")).alias("form"))


@query(r"""SELECT item_id, array_to_string(list_transform(regexp_extract_all(t, '\{\{\s*([A-Za-z_][\w-]*)\s*\}\}', 1), lambda x: x), ',') AS slots FROM (SELECT item_id, regexp_replace(text, '\b([A-Z]\w+)\b', '{{\1}}') AS t FROM eval_items)""")
def txt29_placeholders(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "eval_items").select("item_id", F.regexp_extract("text", r"\b([A-Z]\w+)\b", 1).alias("w"), "text")
    body = F.when(F.col("w") != "", F.concat(F.lit("{{"), "w", F.lit("}}"))).otherwise("")
    return t.select("item_id", F.array_join(tx.placeholders(body), ",").alias("slots"))


_SLUG = "regexp_replace(regexp_replace(strip_accents(replace(lower(title), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(rf"SELECT DISTINCT title, CASE WHEN length({_SLUG}) <= 40 THEN {_SLUG} ELSE regexp_replace(left({_SLUG}, 40), '^(.{{12,}})-[^-]*$', '\1') END AS slug FROM world_log WHERE title IS NOT NULL")
def txt30_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "world_log").filter("title is not null").select("title").distinct().select("title", tx.slug(F.col("title")).alias("slug"))


@query(rf"""
WITH p(pattern) AS (VALUES ('since find'), ('find cursor'), ('find timer')), c AS (SELECT pair_id, regexp_split_to_array(lower(command), '[^a-z]+') AS w FROM ({_COMMANDS}))
SELECT pair_id, pattern FROM c, p WHERE len(list_filter(string_split(pattern, ' '), lambda x: NOT list_contains(w, x))) = 0""")
def txt31_command_patterns(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "paar_sauber").filter("antwort is not null").select("pair_id", F.posexplode(F.split("antwort", "```")).alias("i", "c")).filter("i % 2 = 1")
    w = parts.select("pair_id", F.split(F.lower("c"), "[^a-z]+").alias("w"))
    pats = F.array(*(F.lit(p) for p in ("since find", "find cursor", "find timer")))
    return w.select("pair_id", F.explode(F.filter(pats, lambda p: F.size(F.array_except(F.split(p, " "), F.col("w"))) == 0)).alias("pattern"))


@query(r"""
WITH p(name, pattern, reports, hits) AS (VALUES ('always', '^(Yes|No)\b', 0, 0), ('busy', '\bwait\b', 10, 2), ('idle', '\bcursor\b', 10, 1)), l AS (SELECT pair_id, unnest(string_split(antwort, chr(10))) AS line FROM paar_sauber)
SELECT pair_id, name, count(*) AS lines FROM l, p WHERE (reports < 5 OR hits >= reports / 5.0) AND regexp_matches(line, pattern) GROUP BY 1, 2""")
def txt32_answer_patterns(spark: SparkSession, d: str) -> DataFrame:
    pats = spark.createDataFrame([("always", r"^(Yes|No)\b", 0, 0), ("busy", r"\bwait\b", 10, 2), ("idle", r"\bcursor\b", 10, 1)], "name string, pattern string, reports int, hits int")
    active = pats.filter("reports < 5 or hits >= reports / 5")
    lines = table(spark, d, "paar_sauber").filter("antwort is not null").select("pair_id", F.explode(F.split("antwort", "\n")).alias("line"))
    return lines.join(F.broadcast(active), F.expr("line rlike pattern")).groupBy("pair_id", "name").agg(F.count(F.lit(1)).alias("lines"))


# ---- dates


#: What phrases name at NOW in Berlin, worked out by hand, as literals of the statements.
_WINDOWS = {
    "last 7 days": ("2026-03-25 00:00:00", "2026-04-01 00:00:00"), "yesterday evening": ("2026-03-31 16:00:00", "2026-03-31 22:00:00"), "on 2026-03-12": ("2026-03-11 23:00:00", "2026-03-12 23:00:00"),
    "last friday": ("2026-03-26 23:00:00", "2026-03-27 23:00:00"), "the past week": ("2026-03-25 00:00:00", "2026-04-01 00:00:00"), "between 3 and 8 pm": ("2026-04-01 13:00:00", "2026-04-01 18:00:00"),
    "on 2026-03-10 from 15:00 to 20:30": ("2026-03-10 14:00:00", "2026-03-10 19:30:00"), "the afternoon": ("2026-04-01 10:00:00", "2026-04-01 16:00:00"),
}
_APPOINTMENTS = {
    "tomorrow": ("2026-04-02 07:00:00", None, True), "friday 3pm": ("2026-04-03 13:00:00", None, False), "in 45 minutes": ("2026-04-01 00:45:00", None, False), "weekly friday 15:00": ("2026-04-03 13:00:00", "weekly", False),
    "jan 5": ("2027-01-05 08:00:00", None, True), "every weekday 7:00": ("2026-04-01 05:00:00", "weekdays", False), "2026-10-05T14:30:00+02:00": ("2026-10-05 12:30:00", None, False), "some day": (None, None, None),
}


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"
    return ", ".join(f"({', '.join(map(lit, r))})" for r in rows)


@query(f"""WITH w(phrase, t0, t1) AS (VALUES {_values((p, *w) for p, w in _WINDOWS.items())})
SELECT phrase, epoch_us(t0::TIMESTAMP) AS from_us, epoch_us(t1::TIMESTAMP) AS to_us, count(ts) AS "rows" FROM w LEFT JOIN journal j ON timezone('UTC', ts) >= t0::TIMESTAMP AND timezone('UTC', ts) < t1::TIMESTAMP GROUP BY 1, 2, 3""")
def dat1_time_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of phrases, parsed on the driver, and the journal rows within each."""
    now = datetime.fromisoformat(NOW).replace(tzinfo=None)
    w = spark.createDataFrame([(p, *(x.replace(tzinfo=timezone.utc) for x in ph.window_for(p, now, "Europe/Berlin"))) for p in _WINDOWS], "phrase string, t0 timestamp, t1 timestamp")
    rows = F.broadcast(w).join(table(spark, d, "journal").select("ts"), (F.col("ts") >= F.col("t0")) & (F.col("ts") < F.col("t1")))
    n = rows.groupBy("phrase").agg(F.count("ts").alias("rows"))
    return w.join(n, "phrase", "left").select("phrase", F.unix_micros("t0").alias("from_us"), F.unix_micros("t1").alias("to_us"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


_ASKED = """SELECT item_id AS id, text AS t FROM eval_items UNION ALL SELECT doc_id, text FROM documents UNION ALL SELECT journal_id, text || ' ' || strftime(timezone('UTC', ts), '%Y-%m-%d') FROM journal"""


@query(f"""WITH x AS (SELECT id, lower(t) AS t FROM ({_ASKED}) WHERE t IS NOT NULL)
SELECT id, regexp_matches(regexp_replace(t, '{ph.DATE}', ' ', 'g'), '{ph.INTENT}') OR regexp_matches(t, '{ph.DATE_ASKED}') OR (regexp_matches(t, '{ph.DATE}') AND regexp_matches(t, '{ph.QUESTION}')) AS asks FROM x""")
def dat2_time_intent(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("text").alias("t"))
    n = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    j = table(spark, d, "journal").select(F.col("journal_id").alias("id"), F.concat("text", F.lit(" "), F.date_format("ts", "yyyy-MM-dd")).alias("t"))
    return i.unionByName(n).unionByName(j).filter("t is not null").select("id", ph.has_time_intent(F.col("t")).alias("asks"))


@query(r"SELECT item_id, array_to_string(regexp_extract_all(lower(text || ' since  2026-03-01 and from 2026-03-02'), '\b(?:on|since|from)\s+\d{4}-\d{2}-\d{2}\b').list_transform(lambda x: regexp_replace(x, '\s+', ' ', 'g')), '|') AS anchors FROM eval_items")
def dat3_date_anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.array_join(dt.date_anchors(F.concat("text", F.lit(" since  2026-03-01 and from 2026-03-02"))), "|").alias("anchors"))


@query("SELECT journal_id, epoch_us(timezone('Europe/Berlin', ts)::TIMESTAMP) AS wall_us FROM journal WHERE ts IS NOT NULL")
def dat4_zone(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "journal").filter("ts is not null").select("journal_id", F.unix_micros(F.from_utc_timestamp("ts", "Europe/Berlin")).alias("wall_us"))


@query("""SELECT seq, id, epoch_us(at_ts) AS at_us FROM world_log WHERE at_ts >= TIMESTAMPTZ '2026-03-10 00:00:00+00' AND at_ts < TIMESTAMPTZ '2026-03-12 00:00:00+00'
 AND (contains(lower(concat_ws(' ', title, text)), 'cursor') OR contains(lower(concat_ws(' ', title, text)), 'frist'))""")
def dat5_entries_in_window(spark: SparkSession, d: str) -> DataFrame:
    body = F.lower(F.concat_ws(" ", "title", "text"))
    w = table(spark, d, "world_log").filter((F.col("at_ts") >= dt.iso("2026-03-10")) & (F.col("at_ts") < dt.iso("2026-03-12")))
    return w.filter(body.contains("cursor") | body.contains("frist")).select("seq", "id", F.unix_micros("at_ts").alias("at_us"))


@query("""WITH w AS (SELECT line_id, ts FROM capture_lines WHERE ts >= TIMESTAMPTZ '2026-03-10 00:00:00+00' AND ts < TIMESTAMPTZ '2026-03-11 00:00:00+00')
SELECT line_id, epoch_us(ts) AS at_us, (SELECT greatest(count(*) - 200, 0) FROM w) AS left_out FROM w ORDER BY ts, line_id LIMIT 200""")
def dat6_raw_in_window(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 lines of the window, and how many are left out."""
    w = table(spark, d, "capture_lines").filter((F.col("ts") >= dt.iso("2026-03-10")) & (F.col("ts") < dt.iso("2026-03-11"))).select("line_id", "ts")
    out = w.agg(F.greatest(F.count(F.lit(1)) - 200, F.lit(0).cast("long")).alias("left_out"))
    return w.orderBy("ts", "line_id").limit(200).crossJoin(F.broadcast(out)).select("line_id", F.unix_micros("ts").alias("at_us"), "left_out")


_DUE = "CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%d.%m.%Y') END"


def _due_texts(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp")
    c = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format(t, "dd.MM.yyyy"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", c.alias("due"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_us(timezone('Europe/Berlin', date_trunc('day', o_orderdate)::TIMESTAMP)) WHEN 1 THEN epoch_us(date_trunc('second', o_orderdate)) END AS due_us FROM (SELECT o_orderkey, o_orderdate, {_DUE} AS due FROM orders)")
def dat7_parse_due(spark: SparkSession, d: str) -> DataFrame:
    return _due_texts(spark, d).select("o_orderkey", F.unix_micros(dt.parse_due(F.col("due"), "Europe/Berlin")).alias("due_us"))


_STATE = "CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'overdue' WHEN o_orderdate < TIMESTAMP '1997-01-02' THEN 'due' ELSE 'fresh' END"


@query(f"SELECT o_orderkey, {_STATE} AS state FROM orders")
def dat8_due_state(spark: SparkSession, d: str) -> DataFrame:
    due = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", dt.due_state(due, dt.iso("1997-01-01 12:00:00")).alias("state"))


@query(f"SELECT o_custkey, count(*) FILTER ({_STATE} = 'overdue') AS overdue, count(*) FILTER ({_STATE} = 'due') AS due, count(*) FILTER ({_STATE} = 'fresh') AS fresh, count(*) FILTER ({_STATE} = 'unknown') AS unknown FROM orders GROUP BY o_custkey")
def dat9_due_situation(spark: SparkSession, d: str) -> DataFrame:
    due = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp"))
    s = table(spark, d, "orders").select("o_custkey", dt.due_state(due, dt.iso("1997-01-01 12:00:00")).alias("s"))
    return s.groupBy("o_custkey").agg(*(F.count_if(F.col("s") == x).alias(x) for x in ("overdue", "due", "fresh", "unknown")))


@query(f"""WITH a(phrase, t, repeat, default_time) AS (VALUES {_values((p, *w) for p, w in _APPOINTMENTS.items())})
SELECT phrase, epoch_us(t::TIMESTAMP) AS at_us, repeat, default_time::BOOLEAN AS default_time FROM a""")
def dat10_appointments(spark: SparkSession, d: str) -> DataFrame:
    """Phrases as appointments, on the driver."""
    now = datetime.fromisoformat(NOW).replace(tzinfo=None)
    us = lambda t: None if t is None else round(t.replace(tzinfo=timezone.utc).timestamp() * 1e6)
    found = {p: ph.appointment(p, now, "Europe/Berlin") or {} for p in _APPOINTMENTS}
    return spark.createDataFrame([(p, us(x.get("at")), x.get("repeat"), x.get("default_time")) for p, x in found.items()], "phrase string, at_us long, repeat string, default_time boolean")


@query("""
WITH k AS (SELECT o_orderkey, o_orderdate::DATE AS d, ['daily', 'weekly', 'monthly', 'weekdays'][(o_orderkey % 4 + 1)::INT] AS r FROM orders),
     s AS (SELECT o_orderkey, d, r, unnest(range(0, 14)) AS i FROM k), w AS (SELECT o_orderkey, r, d + i::INT AS day, row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1 AS n FROM s WHERE r = 'weekdays' AND isodow(d + i::INT) <= 5)
SELECT o_orderkey, r AS repeat, i::INT AS n, strftime(CASE r WHEN 'daily' THEN d + i::INT WHEN 'weekly' THEN d + (7 * i)::INT ELSE (d + to_months(i::INT))::DATE END, '%Y-%m-%d') AS day FROM s WHERE r <> 'weekdays' AND i < 5
UNION ALL SELECT o_orderkey, r, n::INT, strftime(day, '%Y-%m-%d') FROM w WHERE n < 5""")
def dat11_recurrence(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("daily", "weekly", "monthly", "weekdays")))
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("first"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("repeat"))
    return o.select("o_orderkey", "repeat", F.posexplode(dt.occurrences(F.col("first"), F.col("repeat"), 5)).alias("n", "day")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n FROM journal WHERE ts IS NOT NULL GROUP BY 1")
def dat12_iso_week(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "journal").filter("ts is not null").groupBy(dt.week_key(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT journal_id, (journal_id % 60)::VARCHAR || ['min', ' hours', 'd', ' weeks'][(journal_id % 4 + 1)::INT] AS t FROM journal), v AS (SELECT journal_id, (journal_id % 60) * CASE journal_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 1440 END AS v FROM t)
SELECT journal_id, CASE WHEN v BETWEEN 1 AND 43200 THEN v END::BIGINT AS minutes FROM v""")
def dat13_duration(spark: SparkSession, d: str) -> DataFrame:
    units = F.array(*(F.lit(x) for x in ("min", " hours", "d", " weeks")))
    t = F.concat((F.col("journal_id") % 60).cast("string"), F.get(units, (F.col("journal_id") % 4).cast("int")))
    return table(spark, d, "journal").select("journal_id", dt.duration_minutes(t).alias("minutes"))


@query(f"SELECT hit_id, round(score * (1 + 0.15 * exp(-greatest(0, date_diff('day', found_at::DATE, {NOW_SQL}::DATE)) / 90.0)), 6) AS score FROM search_hits WHERE found_at IS NOT NULL AND score IS NOT NULL")
def dat14_recency(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").filter("found_at is not null and score is not null")
    return h.select("hit_id", F.round(dt.recency(F.col("score"), F.col("found_at"), dt.iso(NOW)), 6).alias("score"))


# ---- maths


@query("SELECT a.vec_id AS query_id, b.vec_id, round(1 / (1 + sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 5")
def mth5_vector_score(spark: SparkSession, d: str) -> DataFrame:
    from logweave.operators.ranking import nearest_vectors

    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(v.filter("vec_id % 20 = 0"), v, 5)


_FOLD = "list_reduce(list_prepend({0}::BIGINT, list_transform(string_split(id, ''), lambda c: ord(c)::BIGINT)), lambda h, c: {1})"


@query(f"""SELECT DISTINCT id, {_FOLD.format(mt.FNV_START, f'(xor(h, c) * {mt.FNV_PRIME}) % 4294967296')} AS fnv1a, {_FOLD.format(mt.DJB_START, 'xor(h * 33, c) % 4294967296')} AS djb2 FROM world_log WHERE id IS NOT NULL AND id <> ''""")
def mth6_short_hash(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "world_log").filter("id is not null and id <> ''").select("id").distinct()
    return e.select("id", mt.fnv1a(F.col("id")).alias("fnv1a"), mt.djb2(F.col("id")).alias("djb2"))


@query("SELECT n, round(5.0 * ln(1 + (n - 0.5) / 1.5) / ln(1 + (1000 - 0.5) / 1.5), 6) AS bar FROM (SELECT count(*) AS n FROM documents GROUP BY project)")
def mth7_find_bar(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("n", F.round(mt.find_bar(F.col("n")), 6).alias("bar"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(replace(coalesce(author, '') || ',' || coalesce(project, '') || ', ' || source, '"', ''), ','), lambda x: trim(x)).list_filter(lambda x: x <> ''), '|') AS items FROM documents""")
def mth9_list_coercion(spark: SparkSession, d: str) -> DataFrame:
    from logweave.sources.logs import as_list

    empty = F.lit("")
    pick = F.col("doc_id") % 2
    comma = F.concat(F.coalesce("author", empty), F.lit(","), F.coalesce("project", empty), F.lit(", "), "source")
    listed = F.to_json(F.filter(F.transform(F.split(comma, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return docs(spark, d).select("doc_id", F.array_join(as_list(F.when(pick == 0, comma).otherwise(listed)), "|").alias("items"))
