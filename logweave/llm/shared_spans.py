"""Problem 10: long spans that stand verbatim in more than one record.

A shared span may begin and end anywhere, so the paragraphs compared are all stretches of ``span`` words, and not those
between line breaks. Each has a MinHash over its ``shingle``-word shingles. Equal stretches have equal MinHashes, so one
band of one row already has recall 1, and neighbouring stretches mostly share theirs: they form a segment, and a record
sends one MinHash for each. That alone would let in whatever shares one shingle. So a segment whose MinHash stands in another
text gets two bands more: the words from half the rest of a stretch before its smallest shingle to the shingle's end, and as
many from the shingle on. An equal stretch holds one of the two whole, so recall stays 1. Segments that meet in a band are
compared stretch by stretch, on the MinHash and 64 bits of all words. Records that share one are clustered by
components. No text moves but that of records with such segments, and no pairs of a group are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import Words, mix, word_hashes
from logweave.operators.components import connected_components
from logweave.session import cut

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _within(at, k: int):
    """Whether each run of k words lies within one text; texts begin at the places at."""
    import numpy as np

    ok = np.ones(max(0, at[-1] - k + 1), dtype=bool)
    for n in range(len(at) - 2):  # the runs that begin less than k words before the next text
        ok[max(0, at[n + 1] - k + 1) : at[n + 1]] = False
    return ok


def _runs(h, k: int, base: int):
    """Rolling hash of each run of k elements of h, by doubling."""
    import numpy as np

    if len(h) < k:
        return h[:0]
    done, n, part, size, power = None, 0, h, 1, base
    left = k
    while left:
        if left & 1:
            if done is None:
                done, n = part, size
            else:
                m = len(h) - n - size + 1
                done, n = done[:m] * np.uint64(pow(base, size, 2**64)) + part[n : n + m], n + size
        left >>= 1
        if left:
            m = len(part) - size
            part, size, power = part[:m] * np.uint64(power) + part[size : size + m], 2 * size, power * power % 2**64
    return done


def _minhashes(h, span: int, shingle: int):
    """The MinHash of each stretch of span words."""
    import numpy as np

    if len(h) < span:
        return h[:0]
    g = mix(_runs(h, shingle, _BASES[0]))
    w, left, done, n, part, size = span - shingle + 1, span - shingle + 1, None, 0, g, 1
    while left:
        if left & 1:
            if done is None:
                done, n = part, size
            else:
                m = len(g) - n - size + 1
                done, n = np.minimum(done[:m], part[n : n + m]), n + size
        left >>= 1
        if left:
            m = len(part) - size
            part, size = np.minimum(part[:m], part[size : size + m]), 2 * size
    assert n == w
    return done


def _send_minhashes(span: int, shingle: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        known = Words()
        for b in batches:
            texts = b.column("text").to_pylist()
            h, at = word_hashes([t.split() for t in texts], known)
            m, ok = _minhashes(h, span, shingle), _within(at, span)
            # Neighbouring stretches mostly share theirs; it is sent where it changes or a text begins.
            ok[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
            sent = np.flatnonzero(ok)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(sent, at).astype(np.int32)), pa.array(m[sent].view(np.int64)))
            content = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), content, pa.array(np.diff(at)), lists], ["doc_id", "content", "words", "minhashes"])

    return go


def _send_segments(span: int, shingle: int):
    side, width = (span - shingle + 1) // 2, span - shingle + 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = Words()
        for b in batches:
            h, at = word_hashes([t.split() for t in b.column("text").to_pylist()], known)
            g, ok = mix(_runs(h, shingle, _BASES[0])), _within(at, span)
            m = _minhashes(h, span, shingle)
            if not len(m):
                continue
            change = np.flatnonzero(ok & np.concatenate([[True], (m[1:] != m[:-1]) | ~ok[:-1]]))
            stop = np.flatnonzero(ok & np.concatenate([(m[1:] != m[:-1]) | ~ok[1:], [True]])) + 1
            text = np.searchsorted(at, change, side="right") - 1
            wanted = b.column("minhashes").to_pylist()
            wanted = [set(x) for x in wanted]
            first, size, place, doc = [], [], [], []
            for f, end, x, d in zip(change.tolist(), stop.tolist(), m[change].view(np.int64).tolist(), text.tolist()):
                if x in wanted[d]:
                    x = np.uint64(x % 2**64)
                    while f < end:  # a text may have its smallest shingle twice; the first one in reach counts
                        p = f + int((g[f : f + width] == x).argmax())
                        first.append(f)
                        size.append(min(end, p + 1) - f)
                        place.append(p)
                        doc.append(d)
                        f = p + 1
            if not first:
                continue
            first, size, p, doc = (np.array(c) for c in (first, size, place, doc))
            band = mix(_runs(h, side + shingle, _BASES[1])).view(np.int64)
            has_left, has_right = p - side >= at[doc], p + side + shingle <= at[doc + 1]
            left = pa.array(band[np.where(has_left, p - side, 0)], mask=~has_left)
            right = pa.array(band[np.where(has_right, p, 0)], mask=~has_right)
            each = mix(_runs(h, span, _BASES[0])).view(np.int64)
            to = np.concatenate([[0], np.cumsum(size)])
            lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(each[np.repeat(first - to[:-1], size) + np.arange(to[-1])]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(g[p].view(np.int64)), pa.array(first - at[doc]), left, right, lists], ["doc_id", "minhash", "at", "before", "after", "each"])

    return go


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def shared_stretches(docs: DataFrame, span: int = 50, shingle: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, classes, stretches)``: records ``(doc_id, content, words)``, classes of equal texts ``(content, head, n_docs)``
    named by their first record, and the stretches of each class's first record that stand in another class too,
    ``(doc_id, at, low)``; low is a record that has the stretch."""
    sent = cut(_texts(docs).mapInArrow(_send_minhashes(span, shingle), "doc_id long, content binary, words long, minhashes array<long>"))
    rows = sent.select("doc_id", "content", "words").distinct()
    classes = cut(sent.groupBy("content").agg(F.min("doc_id").alias("head"), F.count_distinct("doc_id").alias("n_docs")))
    # Copies send the same, and 64 bits tell the classes of one MinHash apart.
    text = F.xxhash64("content").alias("text")
    each = sent.select("content", text, F.explode("minhashes").alias("minhash"))
    common = each.groupBy("minhash").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("minhash")
    heads = sent.join(classes.select("content", F.col("head").alias("doc_id")), ["content", "doc_id"], "left_semi").select("doc_id", F.explode("minhashes").alias("minhash"))
    of_doc = heads.join(common, "minhash", "left_semi").groupBy("doc_id").agg(F.collect_set("minhash").alias("minhashes"))
    # Repeated rows give the same segments again, which changes nothing below.
    read = _texts(docs).join(of_doc, "doc_id").mapInArrow(_send_segments(span, shingle), "doc_id long, minhash long, at long, before long, after long, each array<long>")
    segments = cut(read)
    bands = segments.select("doc_id", "at", F.explode(F.array("before", "after")).alias("band")).filter("band is not null")
    meet = bands.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("band")
    cand = cut(segments.select("doc_id", "minhash", "at", "each").join(bands.join(meet, "band", "left_semi").select("doc_id", "at").distinct(), ["doc_id", "at"], "left_semi"))
    each = cand.select("doc_id", "minhash", "at", F.posexplode("each").alias("k", "h"))
    twice = each.groupBy("minhash", "h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high").select("minhash", "h", "low")
    return rows, classes, cut(each.join(twice, ["minhash", "h"]).select("doc_id", (F.col("at") + F.col("k")).alias("at"), "low"))


def _shared_words(found: tuple[DataFrame, DataFrame, DataFrame], span: int) -> DataFrame:
    rows, classes, stretches = found
    after = F.lead("at").over(Window.partitionBy("doc_id").orderBy("at"))
    covered = stretches.select("doc_id", F.least(F.lit(span), F.coalesce(after - F.col("at"), F.lit(span))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("covered"))
    known = classes.join(covered.withColumnRenamed("doc_id", "head"), "head", "left")
    whole = (F.col("n_docs") > 1) & (F.col("words") >= span)
    out = rows.join(known.filter("n_docs > 1 or covered is not null"), "content").withColumn("shared_words", F.when(whole, F.col("words")).otherwise(F.coalesce("covered", F.lit(0))).cast("long"))
    return out.filter("shared_words > 0").select("doc_id", "shared_words", "words", "head")


def shared_words(docs: DataFrame, span: int = 50, shingle: int = 8) -> DataFrame:
    """``(doc_id, shared_words, words)``: how many of the record's words lie in a run of span consecutive words that
    also stands in a record with another doc_id. Records with none have no row.

    Words are what stands between white space, verbatim. Whole texts are read. A copy of a whole text counts in
    full if it has at least span words, and is compared with other records only once. Rows with a null doc_id or text,
    empty and blank texts, and texts of fewer than span words have no row; a row repeated with equal doc_id
    and text counts once; one doc_id must not have two texts. Empty tables give an empty result.
    """
    return _shared_words(shared_stretches(docs, span, shingle), span).drop("head")


def span_clusters(docs: DataFrame, span: int = 50, shingle: int = 8) -> DataFrame:
    """``(doc_id, cluster_id)``: records linked, directly or through others, by a shared run of span words.

    cluster_id is the cluster's smallest doc_id. Rows as in shared_words; records that share nothing have no row.
    """
    found = shared_stretches(docs, span, shingle)
    links = found[2].filter("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    comp = connected_components(links).withColumnRenamed("node", "head")
    return _shared_words(found, span).join(comp, "head", "left").select("doc_id", F.coalesce("component", "head").alias("cluster_id"))
