"""Links between entries as an edge table: chains, audit, layers, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.change_feed import resolve_roots
from logweave.session import cut


def edges(log: DataFrame) -> DataFrame:
    """``(src, dst, kind)``: replaces and retires links of the log's lines, each once."""
    a = log.filter("id is not null and replaces_id is not null").select(F.col("id").alias("src"), F.col("replaces_id").alias("dst"), F.lit("replaces").alias("kind"))
    b = log.filter("id is not null and retires_id is not null").select(F.col("id").alias("src"), F.col("retires_id").alias("dst"), F.lit("retires").alias("kind"))
    return a.unionByName(b).distinct()


def depths(nodes: DataFrame, most: int = 64) -> DataFrame:
    """``(id, depth)`` of nodes (id, parent) that lead to a parentless node, up to most links; by levels, each written to the shared folder."""
    level = cut(nodes.filter("parent is null").select("id", F.lit(0).alias("depth")))
    out, n = level, 0
    rest = nodes.filter("parent is not null")
    while n < most:
        n += 1
        level = cut(rest.join(level.select(F.col("id").alias("parent")), "parent").select("id", F.lit(n).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def audit(nodes: DataFrame) -> DataFrame:
    """``(finding, n)`` of nodes (id, parent): missing targets, forks, nodes on or behind cycles, greatest depth."""
    ids = nodes.select(F.col("id").alias("k"))
    linked = nodes.filter("parent is not null")
    missing = linked.join(ids, F.col("parent") == F.col("k"), "left_anti")
    forks = linked.groupBy("parent").count().filter("count > 1")
    known = resolve_roots(nodes)
    lost = nodes.join(known.select("id"), "id", "left_anti").select("id", "parent")
    # What leads to a missing target is not on a cycle: follow it back from there.
    behind = cut(missing.select("id"))
    todo = behind
    while not todo.isEmpty():
        todo = cut(lost.join(todo.select(F.col("id").alias("p")), F.col("parent") == F.col("p")).select("id"))
        behind = behind.unionByName(todo)
    cyclic = lost.join(behind, "id", "left_anti")
    one = lambda name, df: df.agg(F.count(F.lit(1)).cast("long").alias("n")).select(F.lit(name).alias("finding"), "n")
    deep = depths(nodes).agg(F.max("depth").cast("long").alias("n")).select(F.lit("depth").alias("finding"), "n")
    return one("missing", missing).unionByName(one("forks", forks)).unionByName(one("cyclic", cyclic)).unionByName(deep)


def layers(pairs: DataFrame) -> DataFrame:
    """``(node, layer)`` of directed pairs (a, b): layer 0 has no incoming pair, others one more than the greatest before them;
    nodes on or behind cycles have layer null. Kahn's peeling, one round for each layer."""
    p = cut(pairs.filter("a <> b").select("a", "b").distinct())
    nodes = cut(p.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    left, done, n = nodes, None, 0
    while True:
        free = cut(left.join(p.select(F.col("b").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(n).alias("layer")))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(free.select("node"), "node", "left_anti"))
        p = cut(p.join(free.select(F.col("node").alias("a")), "a", "left_anti"))
        n += 1
    rest = left.select("node", F.lit(None).cast("int").alias("layer"))
    return rest if done is None else done.unionByName(rest)
