"""The queries of the training-data operators and, where SQL can state them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import broken_pairs, conversations, eval_leaks, languages, mixing, near_duplicates, nearest_time, personal_data, shared_spans
from logweave.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = nearest_time.journal_to_lines(table(spark, d, "journal"), table(spark, d, "capture_lines"))
    return out.select("journal_id", "line_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs.broken_pairs(table(spark, d, "paar_sauber"), table(spark, d, "eval_tasks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild_conversations(table(spark, d, "capture_lines")).select("conv_id", "turn_no", "line_id")


def p3_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_verdicts(table(spark, d, "capture_lines"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.expand_pairs(*near_duplicates.near_duplicate_entries(table(spark, d, "world_log")))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each compared entry with its class and the group of classes linked by similarity, and the class's number of links."""
    members, pairs = near_duplicates.near_duplicate_entries(table(spark, d, "world_log"))
    return near_duplicates.groups(members, pairs)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts = personal_data.texts_of(table(spark, d, "capture_lines"), table(spark, d, "documents"))
    return personal_data.find_personal_data(texts, personal_data.learn_names(texts))


def p6_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    texts = personal_data.texts_of(table(spark, d, "capture_lines"), table(spark, d, "documents"))
    return personal_data.replace_personal_data(texts, personal_data.learn_names(texts))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    """p7_found with the confidence and place of each segment; a world's segment has no place."""
    hits, log = table(spark, d, "search_hits"), table(spark, d, "world_log")
    model = languages.fit_on(table(spark, d, "documents"), hits, log)
    a = languages.relabelled_hits(hits, model).withColumn("rec_kind", F.lit("hit"))
    b = languages.relabelled_worlds(table(spark, d, "world_config"), log, model).select(
        "rec_id", F.lit(1).alias("seg_no"), "lang", "confidence", F.lit(None).cast("int").alias("start_pos"), F.lit(None).cast("int").alias("end_pos"), F.lit("world").alias("rec_kind")
    )
    return a.unionByName(b).select("rec_kind", "rec_id", "seg_no", "lang", "confidence", "start_pos", "end_pos")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_segments(spark, d).select("rec_kind", "rec_id", "seg_no", "lang")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of 20 words with up to two words put in, left out or changed."""
    return eval_leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), run=20, budget=2)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The records of the mix in their blocks."""
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares the mix reaches, with the shares asked for."""
    targets = table(spark, d, "mix_targets")
    return mixing.mix_shares(mixing.mix_sources(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_words(table(spark, d, "documents")).select("doc_id", "shared_words")


def p10_clusters(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.span_clusters(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_verdicts, p4_found, p4_groups, p6_found, p6_replaced, p7_found, p7_segments, p8_found, p8_near, p9_mix, p9_shares, p10_found, p10_clusters)}
