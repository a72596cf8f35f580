"""Problem 4: all pairs of records whose word-shingle sets are similar.

Ball hashing that meets in the middle, on sets. Two sets with |A & B| / |A | B| >= t meet in A & B, which
either reaches by deleting at most r(A) = |A| - ceil(t |A|) of its own elements: half the radius. All the
variants of A within that ball are too many to write out, but in one global order of the elements the variants have
only few different leading elements: the first r(A) + 1 of A. So each fingerprint emits those keys, rows are
shuffled on them, and colliding pairs are deduplicated and verified. Any order that is the same everywhere loses no
pair. The one used is from rare to frequent, which keeps the keys' groups small; frequencies come from a table of
counters, as many as there are elements up to MOST_BUCKETS, each a byte with the count's magnitude. So each task orders its
own sets and nothing but keys is shuffled. A key of more than HOT sets is split: its sets are dealt into blocks, and each
pair of blocks is a task's work of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Words, mix, word_hashes
from logweave.operators.components import connected_components
from logweave.session import cut, drop

#: 64-bit words of the bitmap that each key carries.
WORDS = 2
#: Bounds of the number of counters of the frequency table; it is sent to the executors, a byte for each.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 24
#: Counters that come to the driver together.
_PAGE = 1 << 12
#: Sets of a key from which on it is split into blocks of about as many.
HOT = 1 << 14

_WORD = re.compile(r"[^\W_]+")
_MAPS = [f"m{i}" for i in range(WORDS)]


def shingle_sets(docs: DataFrame, k: int, min_words: int = 0) -> DataFrame:
    """``(id, sig)`` of ``(id, text)``: the distinct runs of k words as 64-bit hashes, in order of the hash. Words are maximal runs
    of Unicode letters and digits, lower-cased. Fewer words than k or min_words, and null, give an empty array."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = Words()
        for b in batches:
            texts = [_WORD.findall(t.lower()) if t else [] for t in b.column("text").to_pylist()]
            h, at = word_hashes([t if len(t) >= min_words else [] for t in texts], known)
            g = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
            for i in range(k):
                g = mix(g ^ h[i : i + len(g)]) + np.uint64(i)
            row = np.searchsorted(at, np.arange(len(g)), side="right") - 1
            g, row = (x[np.arange(len(g)) + k <= at[row + 1]] for x in (g, row))
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            keep = np.ones(len(g), dtype=bool)
            keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
            g, row = g[keep], row[keep]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), pa.array(g.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], ["id", "sig"])

    return docs.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(go, "id string, sig array<long>")


def _lists(b: pa.RecordBatch):
    """The hashes of a batch as one array, and where each row's begin."""
    import numpy as np

    sig = b.column("sig")
    at = sig.offsets.to_numpy()
    flat = sig.values.to_numpy()[at[0] : at[-1]]
    return flat, np.asarray(at - at[0])


def _count(buckets: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n = np.zeros(buckets, dtype=np.int32)
        for b in batches:
            np.add.at(n, _lists(b)[0] & (buckets - 1), 1)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(n[at[i : i + 100_000]].astype(np.int64))], ["bucket", "n"])

    return go


def _magnitudes(classes: DataFrame):
    """For each bucket of shingles how frequent they are: 12 steps for each doubling of the count, as a byte."""
    import numpy as np

    total = classes.agg(F.coalesce(F.sum(F.size("sig")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << int(total).bit_length()))
    n = classes.select("sig").mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    step = F.least(F.lit(255), F.floor(12 * F.log2("n")) + 1)
    # A page's counters come as two strings of bytes, so the driver gets no row for each.
    one = F.struct((F.col("bucket") % _PAGE).cast("int").alias("at"), step.cast("int").alias("step"))
    pages = n.groupBy(F.floor(F.col("bucket") / _PAGE).alias("page")).agg(F.collect_list(one).alias("x"))
    out = np.zeros(buckets, dtype=np.uint8)
    for page, at, step in pages.select("page", "x.at", "x.step").toLocalIterator():
        out[page * _PAGE + np.array(at)] = step
    return out


def _step(n: int) -> int:
    """The magnitude of a count; no smaller for a larger count."""
    return min(255, int(12 * log2(n)) + 1) if n else 0


def _emit(counts_b, threshold: float, least: int = 0):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        counts = counts_b.value
        for b in batches:
            flat, at = _lists(b)
            size = np.diff(at)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((flat, counts[flat & (len(counts) - 1)], row))
            place = np.arange(len(flat)) - at[:-1][row] + 1  # rows keep their stretches, so places count within each
            radius = size - np.ceil(size * threshold - 1e-9).astype(np.int64)
            keep = (place <= (radius + 1)[row]) & (counts[flat[order] & (len(counts) - 1)] >= least)
            bits = np.zeros((len(size), 64 * WORDS), dtype=bool)
            bits[row, (flat >> 40) & (64 * WORDS - 1)] = True
            maps = np.packbits(bits, axis=1).view(np.int64)[row[keep]]
            cols = [b.column("c1").take(pa.array(row[keep])), pa.array(flat[order][keep]), pa.array(size[row[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32)), *(pa.array(np.ascontiguousarray(maps[:, i])) for i in range(WORDS))]
            yield pa.RecordBatch.from_arrays(cols, ["c1", "h", "n", "place", *_MAPS])

    return go


def _keys(classes: DataFrame, threshold: float) -> DataFrame:
    """``(c1, h, n, place, m0, ..., block, cell, own)``: the keys each class ``(c1, sig)`` emits, with a bitmap of its set. Sets of a hot
    key are in a block of it, and go once to each cell that stands for it and another block."""
    counts = _magnitudes(classes)
    b = classes.sparkSession.sparkContext.broadcast(counts)
    emit = lambda least: classes.select("c1", "sig").mapInArrow(_emit(b, threshold, least), f"c1 long, h long, n int, place int, {', '.join(f'{m} long' for m in _MAPS)}")
    keys = emit(0)
    if counts.max(initial=0) < _step(HOT):
        return keys.withColumns({"block": F.lit(0), "cell": F.lit(0), "own": F.lit(True)})
    # Only a shingle whose counter says so can be a hot key.
    hot = cut(emit(_step(HOT)).groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > HOT).select("h", F.ceil(F.col("rows") / HOT).cast("int").alias("blocks")))
    rows = keys.join(hot, "h", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("c1"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = F.least("block", "other") * blocks + F.greatest("block", "other")
    return rows.withColumns({"cell": cell, "own": F.col("block") == F.col("other")}).drop("blocks", "other")


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: members ``(id, class_id)``, pairs ``(class_a, class_b, similarity)``, class_a < class_b.

    docs is ``(id, sig)``; sig is an array of distinct hashes, empty or null for records that are not compared.
    Equal sets form one class, named by its smallest id, so copies are not compared with each other. Two
    classes are a pair if |A & B| / |A | B| >= threshold. Every pair is found, see the module. Equal ids are
    the caller's to remove. An empty table gives two empty results.
    """
    sets = docs.filter(F.size("sig") > 0).select(F.col("id").cast("string").alias("id"), F.array_sort("sig").alias("sig"))
    sets = cut(sets.select("id", F.xxhash64("sig").alias("c1"), F.xxhash64(F.lit("2nd"), "sig").alias("c2"), "sig"))
    content = ["c1", "c2"]
    classes = cut(sets.groupBy(content).agg(F.min("id").alias("class_id"), F.any_value("sig").alias("sig")))
    members = cut(sets.select("id", *content).join(classes.select(*content, "class_id"), content).select("id", "class_id"))
    drop(sets)
    keys = _keys(classes, threshold)
    side = lambda z: keys.select("h", "cell", *(F.col(c).alias(f"{c}_{z}") for c in ("c1", "n", "place", "block", "own", *_MAPS)))
    # Sets of one block meet in the cell of that block alone.
    hit = side("a").join(side("b"), ["h", "cell"]).filter((F.col("c1_a") < F.col("c1_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9))
    hit = hit.filter((F.col("block_a") != F.col("block_b")) | F.col("own_a"))
    # Sizes, and what can still follow the first common element in both sets, bound the overlap; so do the
    # bits that only one set has, each of which stands for at least one element that the other lacks.
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    follow = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    lacks = lambda a, b: sum((F.bit_count(F.col(f"{m}_{a}").bitwiseAND(F.bitwise_not(F.col(f"{m}_{b}")))) for m in _MAPS), F.lit(0))
    shared = F.least(F.col("n_a") - lacks("a", "b"), F.col("n_b") - lacks("b", "a"))
    # The pair's first common element has the full bound; later ones may not, so the pair is kept if any has it.
    pairs = cut(hit.filter((follow >= need) & (shared >= need)).select("c1_a", "c1_b").distinct())
    x = classes.select(F.col("c1").alias("c1_a"), F.col("class_id").alias("x"), F.col("sig").alias("sig_a"))
    y = classes.select(F.col("c1").alias("c1_b"), F.col("class_id").alias("y"), F.col("sig").alias("sig_b"))
    # Two classes of one c1 both join, and are told apart by what they hold.
    full = pairs.join(x, "c1_a").join(y, "c1_b").withColumn("both", F.size(F.array_intersect("sig_a", "sig_b")))
    full = full.withColumn("similarity", F.col("both") / (F.size("sig_a") + F.size("sig_b") - F.col("both")))
    return members, full.filter(F.col("similarity") >= threshold - 1e-12).select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")


def opened_bodies(log: DataFrame) -> DataFrame:
    """``(id, body)``: title, text and learning of each opening line, nulls skipped; copies of an id count once."""
    opening = log.filter("id is not null and replaces_id is null and retires_id is null")
    body = F.concat_ws(" ", "title", "text", "learning")
    return opening.select("id", "seq", body.alias("body")).groupBy("id").agg(F.min_by("body", "seq").alias("body"))


def near_duplicate_entries(log: DataFrame, *, k: int = 3, threshold: float = 0.6, min_words: int = 12) -> tuple[DataFrame, DataFrame]:
    """similar_pairs of the opened entries with at least min_words words, over runs of k words.

    Entries with fewer words, and so those whose three texts are all null, are not compared.
    """
    return similar_pairs(shingle_sets(opened_bodies(log).select("id", F.col("body").alias("text")), k, min_words), threshold)


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: all pairs of records, those within a class included.

    As many rows as there are pairs; use members and pairs as they are where that is not asked for.
    """
    left = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    right = members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    across = pairs.join(left, "class_a").join(right, "class_b").select("x", "y")
    within = left.join(right, F.col("class_a") == F.col("class_b")).filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, class_id, group_id, links)``: each record with its class of equal records, the smallest class of the group that
    similarity links together, and the number of classes its own class is similar to."""
    comp = connected_components(pairs, "class_a", "class_b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(comp, "class_id", "left").join(links, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
