"""Selections under a budget, and the compound splitter: sequential by definition, or by running sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ["key", "id", "size", "used"]


def _pack(budget: int, forms: tuple[float, ...]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, started = None, 0, False
        for b in batches:
            out = []
            for k, i, size in zip(*(b.column(n).to_pylist() for n in ("key", "id", "size"))):
                if not started or k != key:
                    key, used, started = k, 0, True
                for f in forms:
                    n = int(size * f)
                    if used + n <= budget:
                        used += n
                        out.append((k, i, n, used))
                        break
            cols = [pa.array(list(c), t) for c, t in zip(zip(*out), _KINDS)] if out else [pa.array([], t) for t in _KINDS]
            yield pa.RecordBatch.from_arrays(cols, _NAMES)

    return go


def compose(rows: DataFrame, budget: int, forms: tuple[float, ...]) -> DataFrame:
    """``(key, id, size, used)``: rows (key, id, rank, size) of each key by rank, then id, each in its longest form that still fits.

    A stream over sorted partitions with one number as its state, so a key may be of any length.
    """
    r = rows.select("key", "id", "rank", "size").repartition("key").sortWithinPartitions("key", F.desc("rank") if len(forms) == 1 else "rank", "id")
    return r.select("key", "id", "size").mapInArrow(_pack(budget, forms), "key string, id long, size long, used long")


def fill(rows: DataFrame, budget: int) -> DataFrame:
    """``(key, id, size, used)``: the newest rows (largest rank) of each key that fit; what does not fit is skipped."""
    return compose(rows, budget, (1.0,))


def upto(rows: DataFrame, order: list[Column], size: str, cap: int) -> DataFrame:
    """Rows in order while their running sum is at most cap. Only rows that can still count are summed: sizes are at least 1, so the
    first cap rows are enough."""
    head = rows.filter(F.col(size) >= 1).orderBy(*order).limit(cap)
    return head.withColumn("_up", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_up") <= cap).drop("_up")


def compounds(docs: DataFrame, shortest: int = 4, seen: int = 2, links: tuple[str, ...] = ("", "s", "n", "en", "es")) -> DataFrame:
    """``(word, left_part, right_part)``: corpus words made of two corpus words, joined by a linking element; the longest right part wins.

    The lexicon is not sent anywhere: every cut of every word is joined with it by both parts.
    """
    from logweave.operators.ranking import postings

    lex = postings(docs, "doc_id").groupBy(F.col("term").alias("w")).agg(F.sum("tf").alias("n")).filter((F.col("n") >= seen) & F.col("w").rlike("^[a-z]+$")).select("w")
    long = lex.filter(F.length("w") >= 2 * shortest)
    cut = long.select("w", F.explode(F.sequence(F.lit(shortest), F.length("w") - shortest)).alias("i"))
    parts = cut.select("w", F.substring("w", F.lit(1), F.col("i")).alias("l"), F.substring(F.col("w"), F.col("i") + 1, F.length("w")).alias("right_part"))
    heads = F.array(*(F.when(F.endswith("l", F.lit(x)), F.left("l", F.length("l") - len(x))) for x in links))
    parts = parts.select("w", "right_part", F.explode(F.array_compact(heads)).alias("left_part")).filter(F.length("left_part") >= shortest)
    both = parts.join(lex.select(F.col("w").alias("left_part")), "left_part", "left_semi").join(lex.select(F.col("w").alias("right_part")), "right_part", "left_semi")
    best = both.groupBy("w").agg(F.max(F.struct(F.length("right_part").alias("n"), "left_part", "right_part")).alias("b"))
    return best.select(F.col("w").alias("word"), "b.left_part", "b.right_part")
