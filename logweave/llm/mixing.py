"""Problem 9: mix sources to target weights.

Pfair scheduling. A source of weight w must have had between floor(w t) and ceil(w t) blocks after t blocks of the mix, so
its block i has release time floor(i / w) and deadline ceil((i + 1) / w). The earliest deadline among released blocks goes
next, which keeps each source within less than one block of its share at every point of the mix.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import cut

#: Folder of the public vocabulary files, and the file and library used.
VOCABULARY = os.environ.get("LOGWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Blocks of the whole mix, where they are not shorter than a record; more if a source's weight is so small that it would have none.
#: The block table is on the driver, and its size follows the targets, not the corpus.
BLOCKS = 2_000
#: Slices over which the records of one source are numbered at least; as many as there are shuffle partitions, if those are more.
SLICES = 256
#: Fixed value: how this vocabulary splits text before merging, as the library publishes it for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _tokens(file: str, column: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(column).to_pylist()]
            rest = [c for c in b.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int64())], [*rest, "tokens"])

    return go


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``(doc_id, source, tokens)`` of the records with an id and a text; source trimmed and in lower case. The vocabulary file is
    read here and sent to the executors."""
    docs.sparkSession.sparkContext.addFile(os.path.join(vocabulary, file))
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text")
    return rows.mapInArrow(_tokens(file, "text"), "doc_id long, source string, tokens long")


def edf_schedule(weights: dict[str, Fraction], blocks: int) -> list[str]:
    """The source of each of ``blocks`` consecutive blocks. Weights are positive and sum to 1; of equal deadlines the
    heavier source goes first, then the first by name."""
    waiting, ready, out = [], [], []
    for s, w in weights.items():
        heapq.heappush(waiting, (0, s, 0))
    for t in range(blocks):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (ceil((i + 1) / weights[s]), -weights[s], s, i))
        if not ready:
            at, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (ceil((i + 1) / weights[s]), -weights[s], s, i))
        _, _, s, i = heapq.heappop(ready)
        out.append(s)
        heapq.heappush(waiting, (floor((i + 1) / weights[s]), s, i + 1))
    return out


def plan_sizes(have: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict[str, Fraction]]:
    """The mix's size in tokens and each source's exact weight.

    Sources without records or with a share of 0 are left out, and the other shares are scaled to sum to 1. The size is the
    largest at which every source fills its share within its cap, or ``total`` if that is smaller.
    """
    use = {s: Fraction(share).limit_denominator(10**9) for s, (share, cap) in targets.items() if share and share > 0 and cap and cap > 0 and have.get(s)}
    if not use:
        return 0, {}
    weights = {s: w / sum(use.values()) for s, w in use.items()}
    most = min(Fraction(have[s] * targets[s][1]) / w for s, w in weights.items())
    return floor(min(most, total) if total is not None else most), weights


def number(rows: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Adds ``upto``: the running sum of size before each row, by key in a fixed pseudo-random order.

    A key is cut into slices by a hash of its rows; sums run within slices, and the slices' own sums, a few rows for
    each key, give their offsets. So no key is summed up in one task.
    """
    h = F.xxhash64(order, F.lit(17))
    slices = max(SLICES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumns({"h": h, "slice": F.pmod(F.xxhash64(order, F.lit(3)), F.lit(slices))})
    inside = Window.partitionBy(key, "slice").orderBy("h", order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "slice").agg(F.sum(size).alias("s"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    rows = rows.withColumn("inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return rows.join(sums, [key, "slice"]).withColumn("upto", F.col("inside") + F.col("offset")).drop("inside", "offset", "h", "slice")


def mix_sources(docs: DataFrame, targets: DataFrame, *, total: int | None = None, blocks: int = BLOCKS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens, repeat_no, block_no, place)``: the records of the mix; order by block_no, place, doc_id.

    docs has doc_id, text and source, targets has source, target_share and max_repeat; other columns are never read.
    Records are whole and never cut. Each source goes through its records in a fixed pseudo-random order, again from the
    start (repeat_no 2, 3, ...) up to max_repeat times, until the first record that reaches its share of the mix's size;
    see plan_sizes. A block of a source is the records that begin in one of its equal stretches of tokens, ``blocks`` in all or as many
    as the longest record leaves room for, but at least as many as give each source one; blocks are placed by edf_schedule. Null ids and texts, and sources that are null, not a target, of share 0 or without tokens are left out;
    empty texts have no tokens and are carried along. Rows with the same doc_id are different records; of targets of the same
    source the first by share counts. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = cut(count_tokens(docs, vocabulary))
    sums = rows.join(targets.select(F.lower(F.trim("source")).alias("source")).distinct(), "source").groupBy("source").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("longest")).collect()
    have = {r["source"]: r["n"] for r in sums}
    t = targets.filter("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.min(F.struct("target_share", "max_repeat")).alias("t"))
    goals = {r["source"]: (r["t"]["target_share"], r["t"]["max_repeat"]) for r in t.collect()}
    size, weights = plan_sizes(have, goals, total)
    if not size:
        return rows.select("doc_id", "source", "tokens", F.lit(1).alias("repeat_no"), F.lit(0).cast("long").alias("block_no"), F.lit(0).cast("long").alias("place")).limit(0)
    blocks = max(1, min(blocks, size // max(1, *(r["longest"] for r in sums))), *(ceil(1 / w) for w in weights.values()))
    step = Fraction(size, blocks)
    order, seen = edf_schedule(weights, blocks), dict.fromkeys(weights, 0)
    slots = []
    for at, s in enumerate(order):
        slots.append((s, seen[s], at))
        seen[s] += 1
    plan = spark.createDataFrame([(s, have[s], max(1, round(size * w)), seen[s], goals[s][1]) for s, w in weights.items()], "source string, held long, goal long, n_blocks long, max_repeat int")
    slot = spark.createDataFrame(slots, "source string, nth long, block_no long")
    numbered = number(rows, "source", "doc_id", "tokens").join(F.broadcast(plan), "source")
    again = numbered.select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("max_repeat"), F.ceil(F.col("goal") / F.col("held"))).cast("int"))).alias("repeat_no"))
    begin = F.col("upto") + (F.col("repeat_no") - 1) * F.col("held")
    again = again.withColumn("place", begin.cast("long")).filter("place < goal")
    nth = F.least(F.floor(F.col("place") / F.lit(float(step))), F.greatest(F.col("n_blocks") - 1, F.lit(0)))
    out = again.withColumn("nth", nth.cast("long")).join(F.broadcast(slot), ["source", "nth"], "left")
    return out.select("doc_id", "source", "tokens", "repeat_no", F.coalesce("block_no", F.lit(blocks)).alias("block_no"), "place")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, actual_share, tokens, records, max_repeat, most_repeats)``: what a mix really holds.

    Every target has a row; one that the mix lacks has share 0. ``actual_share`` is null for an empty mix.
    """
    t = targets.filter("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.min(F.struct("target_share", "max_repeat")).alias("t")).select("source", "t.*")
    got = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("repeat_no").alias("most_repeats"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    out = t.join(got, "source", "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "source", "target_share", (zero(F.col("tokens")) / F.nullif(F.col("whole"), F.lit(0))).alias("actual_share"), zero(F.col("tokens")).alias("tokens"),
        zero(F.col("records")).alias("records"), "max_repeat", zero(F.col("most_repeats")).alias("most_repeats"),
    )
