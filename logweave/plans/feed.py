"""Queries over the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.operators.change_feed import replay_feed
from logweave.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The entries that hold at the end of the feed, with their current line and status."""
    return replay_feed(table(spark, d, "world_log"))


QUERIES = {"p5_found": p5_found}

ORACLES = {
    "p5_found": """
WITH RECURSIVE u AS (SELECT id, min(seq) AS seq, arg_min(struct_pack(r := replaces_id, x := retires_id, s := lower(trim(status)), a := at_ts), seq) AS f
                     FROM world_log WHERE id IS NOT NULL GROUP BY id),
     l AS (SELECT id, seq, coalesce(f.r, f.x) AS p, f.x AS retires_id, f.s AS status, f.a AS at_ts FROM u),
     c AS (SELECT id, id AS root FROM l WHERE p IS NULL UNION ALL SELECT l.id, c.root FROM l JOIN c ON l.p = c.id),
     e AS (SELECT root, l.*, retires_id IS NOT NULL OR coalesce(status IN ('done', 'discarded', 'obsolete', 'withdrawn'), false) AS closes
           FROM l JOIN c USING (id) WHERE at_ts IS NOT NULL),
     z AS (SELECT root AS entry_id, arg_max(struct_pack(id := id, c := closes), struct_pack(a := at_ts, b := seq)) AS last,
                  arg_max(status, struct_pack(a := at_ts, b := seq)) FILTER (NOT closes AND status IS NOT NULL) AS status FROM e GROUP BY root)
SELECT entry_id, last.id AS current_id, status FROM z WHERE NOT last.c"""
}
