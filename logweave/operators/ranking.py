"""Ranked search: postings, BM25 over batches of queries, expansion graphs, rank fusion, vectors, re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import maths as mt
from logweave.functions import text as tx
from logweave.session import cut

#: Vectors of one query block; a block is what is sent to every executor at once.
BLOCK = 20_000


def postings(docs: DataFrame, key: str, text: str = "text", weight: Column | None = None) -> DataFrame:
    """``(key, term, tf)``: content words with their counts, times weight. One shuffle on (key, term), with map-side sums."""
    # Filtered after the explode: these predicates are compiled, a lambda's are not.
    w = docs.select(key, F.explode(F.split(tx.strip_accents(F.lower(F.col(text))), r"[^a-z0-9_-]+")).alias("term")).filter((F.length("term") >= 4) & ~F.col("term").isin(*tx.EN_STOP))
    return w.groupBy(key, "term").agg((F.count(F.lit(1)) * (F.lit(1.0) if weight is None else weight)).alias("tf"))


def term_stats(post: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Document frequencies ``(term, df)`` and the corpus row ``(n_docs, avg_len)``."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lengths = post.groupBy(key).agg(F.sum("tf").alias("len"))
    return df, lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


def bm25_scores(docs: DataFrame, key: str, queries: DataFrame, qkey: str, expansion: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """``(qkey, key, score, covered, asked)``: every document with a term of the query, or those of the pairs wanted ``(qkey, key)``; not ranked.

    docs is (key, text), queries (qkey, text). The postings, the index, are written once to the shared folder and read for
    statistics and hits. Only postings of asked terms are joined, so stop-like terms cost nothing if no query has them.
    expansion ``(term, neighbour, weight)`` adds neighbours at their weight, without coverage. The score is times coverage.
    """
    index, df, n_docs, avg = build_index(docs, key)
    asked = queries.select(qkey, F.explode(tx.content_words(F.col("text"))).alias("term")).withColumns({"w": F.lit(1.0), "own": F.lit(1)})
    asked = asked.withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy(qkey)))
    if expansion is not None:
        more = asked.join(expansion, "term").select(qkey, F.col("neighbour").alias("term"), F.col("weight").alias("w"), F.lit(0).alias("own"), "asked")
        asked = asked.unionByName(more).groupBy(qkey, "term", "asked").agg(F.max("w").alias("w"), F.max("own").alias("own"))
    asked = asked.join(df, "term").withColumn("w", F.col("w") * mt.idf(F.lit(float(n_docs)), F.col("df")))
    if wanted is not None:
        # Few pairs: their queries' terms meet their documents' postings by document, so no list of a term is read out.
        asked = asked.join(wanted.select(qkey, key).distinct(), qkey)
        hit = index.join(asked, [key, "term"])
    else:
        hit = index.join(asked, "term")
    part = mt.bm25(F.col("tf"), F.col("len"), F.lit(avg), F.col("w"))
    got = hit.groupBy(qkey, key, "asked").agg(F.sum(part).alias("s"), F.sum("own").alias("covered"))
    return got.select(qkey, key, F.round(F.col("s") * mt.coverage(F.col("covered"), F.col("asked")), 6).alias("score"), "covered", "asked")


def bm25_search(docs: DataFrame, key: str, queries: DataFrame, qkey: str, top: int = 10, expansion: DataFrame | None = None) -> DataFrame:
    """``(qkey, key, score, covered, asked)``: the top documents of every query, see bm25_scores; ties by key."""
    return top_k(bm25_scores(docs, key, queries, qkey, expansion), qkey, [F.desc("score"), F.col(key)], top)


def build_index(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int, float]:
    """Postings ``(key, term, tf, len)`` in the shared folder, document frequencies, number of documents and mean length.

    Texts are spread by key once; counting terms and summing lengths need no further shuffle.
    """
    post = postings(docs.select(key, "text").repartition(key), key)
    index = cut(post.withColumn("len", F.sum("tf").over(Window.partitionBy(key))))
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = index.agg(F.countDistinct(key).alias("n"), F.sum("tf").alias("s")).first()
    return index, df, one["n"], (one["s"] or 0.0) / max(1, one["n"])


def top_k(rows: DataFrame, by: str, order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; a rank column if named. Spark prunes each partition to k rows before the shuffle."""
    r = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rn") <= k)
    return r.withColumnRenamed("_rn", rank) if rank else r.drop("_rn")


def places(rows: DataFrame, by: str, order: list[Column], name: str = "place", total: str | None = None) -> DataFrame:
    """rows with each one's place from 1 among those of its group, as row_number gives it, and the group's size if ``total`` is named.

    For groups of any size: rows are sorted over all partitions, each is numbered within its partition and group, and what stands in
    the partitions before is added, a row for each group and partition. order must tell all rows of a group apart.
    """
    keys = [F.col(by), *order]
    put = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The numbers are written down with the rows, as partitions are others once they are read again.
    put = cut(put.withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(2**33 - 1)}))
    parts = put.groupBy(F.col(by).alias("_by"), F.col("_p").alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_by")
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(w)})
    out = put.join(parts, (F.col("_p") == F.col("_part")) & F.col(by).eqNullSafe(F.col("_by")))
    out = out.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int"))
    return (out.withColumn(total, F.col("_all")) if total else out).drop("_p", "_at", "_by", "_part", "_first", "_n", "_before", "_all")


def retrieval_queries(items: DataFrame, key: str, docs: DataFrame, n: int) -> DataFrame:
    """``(key, query)``: each item's n rarest content words among docs (doc_id, text), in their order."""
    w = docs.select("doc_id", F.explode(tx.content_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    e = items.select(key, F.posexplode(tx.content_words(F.col("text"))).alias("i", "w")).join(w, "w", "left")
    best = top_k(e, key, [F.coalesce("df", F.lit(0)).asc(), F.col("w")], n)
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("query"))


def fuse(lists: list[DataFrame], by: str, key: str) -> DataFrame:
    """``(by, key, score, found_by)`` of ranked lists ``(by, key, rank)``: reciprocal rank fusion."""
    rows = None
    for i, x in enumerate(lists):
        r = x.select(by, key, mt.rrf(F.col("rank")).alias("s"), F.lit(i).alias("i"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy(by, key).agg(F.round(F.sum("s"), 6).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_set("i")), lambda v: v.cast("string")), ",").alias("found_by"))


def _nearest(block_b, k: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ids, q = block_b.value
        for b in batches:
            v = np.array(b.column("embedding").to_pylist(), dtype=np.float64)
            if not len(v):
                continue
            own = np.array(b.column("vec_id").to_pylist(), dtype=np.int64)
            out: tuple[list, list, list] = ([], [], [])
            for i in range(0, len(q), 512):
                d = np.maximum(((q[i : i + 512] ** 2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q[i : i + 512] @ v.T), 0)
                d[ids[i : i + 512, None] == own[None, :]] = np.inf
                m = min(k, d.shape[1])
                best = np.argpartition(d, m - 1, axis=1)[:, :m]
                # Ties with the k-th distance are kept too; the final order decides among them.
                limit = np.take_along_axis(d, best, 1).max(axis=1) * (1 + 1e-9) + 1e-12
                a, c = np.nonzero(d <= limit[:, None])
                exact = ((q[i + a] - v[c]) ** 2).sum(axis=1)
                ok = np.isfinite(d[a, c])
                out[0].append(ids[i + a][ok]), out[1].append(own[c][ok]), out[2].append(exact[ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "dist2"])

    return go


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the k nearest other vectors by L2 of each query, score 1 / (1 + d); exact; ties by id.

    Queries go out in blocks of BLOCK vectors, so what is broadcast is bounded; each task keeps k rows a query.
    """
    import numpy as np

    parts, spark = None, vectors.sparkSession
    rows: list = []

    def send(block: list) -> DataFrame:
        b = spark.sparkContext.broadcast((np.array([r[0] for r in block], dtype=np.int64), np.array([r[1] for r in block], dtype=np.float64)))
        return vectors.select("vec_id", "embedding").mapInArrow(_nearest(b, k), "query_id long, vec_id long, dist2 double")

    for r in queries.select("vec_id", "embedding").toLocalIterator():
        rows.append((r[0], list(r[1])))
        if len(rows) == BLOCK:
            parts = send(rows) if parts is None else parts.unionByName(send(rows))
            rows = []
    if rows or parts is None:
        last = send(rows) if rows else vectors.select("vec_id", F.col("vec_id").alias("query_id"), F.lit(0.0).alias("dist2")).limit(0)
        parts = last if parts is None else parts.unionByName(last)
    scored = parts.withColumn("score", F.round(1 / (1 + F.sqrt("dist2")), 6))
    return top_k(scored, "query_id", [F.desc("score"), F.col("vec_id")], k).select("query_id", "vec_id", "score")


def npmi(pairs: DataFrame, a: str, b: str, n: str, na: str, nb: str, total: Column) -> Column:
    """Normalised pointwise mutual information of counts."""
    p = F.col(n) / total
    return F.log(p / (F.col(na) / total * F.col(nb) / total)) / -F.log(p)


def cooccurrence(items: DataFrame, key: str, item: str, *, least: int = 2, cap: float = 0.5, floor: float = 0.05, neighbours: int = 8, most_df: int | None = None) -> DataFrame:
    """``(term, neighbour, weight)``: items that occur together, by normalised PMI.

    items is ``(key, item)``, distinct. Pairs that occur at least ``least`` times weigh min(cap, cap * nPMI); those of at least
    floor are kept, the best ``neighbours`` for each item. Items of more than most_df keys carry no pairs: they are as frequent
    as stop words, and their pairs would be quadratic.
    """
    df = items.groupBy(item).agg(F.count(F.lit(1)).alias("df"))
    total = items.select(key).distinct().count()
    use = items.join(df.filter(F.col("df") <= most_df) if most_df else df, item).select(key, F.col(item).alias("t"), "df")
    pairs = use.alias("a").join(use.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.t") < F.col("b.t")))
    n = pairs.groupBy(F.col("a.t").alias("x"), F.col("b.t").alias("y"), F.col("a.df").alias("nx"), F.col("b.df").alias("ny")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    w = n.withColumn("weight", F.round(F.least(F.lit(cap), cap * npmi(n, "x", "y", "n", "nx", "ny", F.lit(float(total)))), 6)).filter(F.col("weight") >= floor)
    both = w.select(F.col("x").alias("term"), F.col("y").alias("neighbour"), "weight").unionByName(w.select(F.col("y").alias("term"), F.col("x").alias("neighbour"), "weight"))
    return top_k(both, "term", [F.desc("weight"), F.col("neighbour")], neighbours)


def _pairs_of(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``(k, x, y)``: the pairs of each document's sorted numbers ``a``; only some pairs (x, y) if named."""
    one = docs.select("k", "a", F.posexplode("a").alias("i", "x")).filter(F.col("i") + 1 < F.size("a"))
    if only is None:
        return one.select("k", "x", F.explode(F.slice(F.col("a"), F.col("i") + 2, F.size("a"))).alias("y"))
    # A few best pairs for each term are small beside the pairs of all documents, which are not to be shuffled.
    small = F.broadcast if only.count() <= 500_000 else lambda x: x
    two = one.join(small(only.select("x").distinct()), "x", "left_semi").select("k", "x", F.explode(F.slice(F.col("a"), F.col("i") + 2, F.size("a"))).alias("y"))
    return two.join(small(only.select("x", "y")), ["x", "y"], "left_semi")


def _distinct_support(least: int, overlap: float):
    """Over rows (x, y, k, w), each pair's together and in order: whether least documents are no near copies of those taken before."""

    def go(frames):
        import pandas as pd

        now, taken, ok = None, [], False
        for f in frames:
            out = []
            for x, y, w in zip(f["x"], f["y"], f["w"]):
                if (x, y) != now:
                    now, taken, ok = (x, y), [], False
                if ok:
                    continue
                s = set(w.split(" "))
                if not any(len(s & r) >= overlap * max(len(s), len(r)) for r in taken):
                    taken.append(s)
                    if len(taken) >= least:
                        ok = True
                        out.append(now)
            yield pd.DataFrame(out, columns=["x", "y"]).astype("int64")

    return go


def term_graph(docs: DataFrame, *, least: int = 3, cap: float = 0.5, floor: float = 0.05, neighbours: int = 6, terms: int = 40, share: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """``(term, neighbour, weight)``: terms that occur together, by normalised PMI as in cooccurrence.

    docs is ``(k, w)``: number of the document and its distinct terms, the strongest first. Of terms in at least ``least`` documents
    and at most this share of all, a document gives its first ``terms``, so its pairs are bounded. A pair needs ``least`` documents
    that are no near copies of each other (of the larger set this overlap is shared), taken in order of k. That is looked at only for
    pairs among the best of a term, again after some were refuted; the result is that of looking at all.
    """
    docs = cut(docs.select("k", F.array_join("w", " ").alias("w")))
    n = docs.count()
    every = docs.filter("w <> ''").select("k", F.posexplode(F.split("w", " ")).alias("pos", "term"))
    df = every.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(least, max(least, int(n * share))) & F.col("term").rlike("^[a-z][a-z_-]{2,}$"))
    usable = cut(df.select("term", F.monotonically_increasing_id().alias("i")))
    first = F.slice(F.array_sort(F.collect_list(F.struct("pos", "i"))), 1, terms)
    used = cut(every.join(usable, "term").groupBy("k").agg(F.array_sort(F.transform(first, lambda x: x["i"])).alias("a")))
    total = F.lit(float(used.count()))
    single = used.select(F.explode("a").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("s")).join(usable, "i")
    c = _pairs_of(used).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    c = c.join(single.select(F.col("i").alias("x"), F.col("s").alias("nx"), F.col("term").alias("tx")), "x").join(single.select(F.col("i").alias("y"), F.col("s").alias("ny"), F.col("term").alias("ty")), "y")
    # What stands in every document that counts says nothing.
    w = c.withColumn("weight", F.when(F.col("n") < total, F.round(F.least(F.lit(cap), cap * npmi(c, "x", "y", "n", "nx", "ny", total)), 6))).filter(F.col("weight") >= floor)
    left, known, wide = cut(w.select("x", "y", "tx", "ty", "weight")), None, neighbours
    while True:
        both = left.select(F.col("tx").alias("term"), F.col("ty").alias("neighbour"), "weight", "x", "y").unionByName(left.select(F.col("ty").alias("term"), F.col("tx").alias("neighbour"), "weight", "x", "y"))
        best = cut(top_k(both, "term", [F.desc("weight"), F.col("neighbour")], neighbours))
        ask = best.select("x", "y").distinct()
        ask = cut(ask if known is None else ask.join(known, ["x", "y"], "left_anti"))
        if ask.isEmpty():
            return best.select("term", "neighbour", "weight")
        if wide > neighbours:
            # Terms that lost neighbours before are asked about more of theirs at once, so the rounds stay few.
            open_ = best.join(ask, ["x", "y"], "left_semi").select("term").distinct()
            ask = top_k(both.join(open_, "term", "left_semi"), "term", [F.desc("weight"), F.col("neighbour")], wide).select("x", "y").distinct()
            ask = cut(ask.join(known, ["x", "y"], "left_anti"))
        wide *= 8
        held = cut(_supported(ask, used, docs, least, overlap))
        known = held if known is None else known.unionByName(held)
        left = cut(left.join(ask.join(held, ["x", "y"], "left_anti"), ["x", "y"], "left_anti"))


def _supported(ask: DataFrame, used: DataFrame, docs: DataFrame, least: int, overlap: float) -> DataFrame:
    """Those of the pairs (x, y) with enough documents that are no near copies. Frequent pairs are told by the first documents, the rest by all."""

    def greedy(rows: DataFrame) -> DataFrame:
        return rows.join(docs, "k").select("x", "y", "k", "w").repartition("x", "y").sortWithinPartitions("x", "y", "k").mapInPandas(_distinct_support(least, overlap), "x long, y long")

    last = used.approxQuantile("k", [0.05], 0.01)[0]
    early = _pairs_of(used.filter(F.col("k") <= last), ask).withColumn("r", F.row_number().over(Window.partitionBy("x", "y").orderBy("k"))).filter(F.col("r") <= least + 1).drop("r")
    held = cut(greedy(early))
    more = cut(ask.join(held, ["x", "y"], "left_anti"))
    return held if more.isEmpty() else held.unionByName(greedy(_pairs_of(used, more)))


def expand(terms: DataFrame, curated: DataFrame, tags: DataFrame, graph: DataFrame, by: str) -> DataFrame:
    """``(by, term, weight)``: neighbours of terms (by, term) in three graphs (term, neighbour, weight); the largest weight wins.

    The third, the learned graph of terms, adds no word that is asked already.
    """
    own = terms.select(by, F.col("term").alias("neighbour")).distinct()
    learned = terms.join(graph, "term").join(own, [by, "neighbour"], "left_anti").select(by, "neighbour", "weight")
    every = terms.join(curated.unionByName(tags), "term").select(by, "neighbour", "weight").unionByName(learned)
    return every.groupBy(by, F.col("neighbour").alias("term")).agg(F.max("weight").alias("weight"))


def _mmr(lam: float, top: int):
    def go(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["rel", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        v = np.array(pdf["embedding"].tolist(), dtype=float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        rel = pdf["rel"].to_numpy(dtype=float)
        rel = rel / max(rel.max(), 1e-12)
        sim, left, picked, near = v @ v.T, list(range(len(pdf))), [], np.zeros(len(pdf))
        while left and len(picked) < top:
            score = [lam * rel[i] - (1 - lam) * near[i] for i in left]
            best = left[max(range(len(left)), key=lambda j: (round(score[j], 12), -j))]
            picked.append(best)
            left.remove(best)
            near = np.maximum(near, sim[best])
        return pd.DataFrame({"query_id": key[0], "doc_id": pdf["doc_id"].iloc[picked], "place": range(1, len(picked) + 1)})

    return go


def mmr_pool(top: int) -> int:
    """How many hits a query's re-ranking chooses from."""
    return min(600, max(50, 10 * top))


def mmr(hits: DataFrame, top: int = 10, lam: float = 0.7) -> DataFrame:
    """``(query_id, doc_id, place)``: hits (query_id, doc_id, rel, embedding) re-ranked for diversity.

    Greedy by definition, so each query's pool, bounded to 10 * top and at most 600 rows, is one group.
    """
    pool = top_k(hits, "query_id", [F.desc("rel"), F.col("doc_id")], mmr_pool(top))
    return pool.groupBy("query_id").applyInPandas(_mmr(lam, top), "query_id long, doc_id long, place int")


def cut_with_tie(hits: DataFrame, by: str, key: str, top: int, spread: float) -> DataFrame:
    """The first top rows by score and one more if it is within spread of the last."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), key)
    r = hits.withColumns({"rank": F.row_number().over(w), "prev": F.lag("score").over(w)})
    return r.filter((F.col("rank") <= top) | ((F.col("rank") == top + 1) & (F.col("prev") - F.col("score") <= spread * F.col("prev")))).drop("prev")


def author_share(rows: DataFrame, by: str, author: str, order: list[Column], most: int) -> DataFrame:
    """Rows of each answer with at most so many of each author, the first in order; rows without an author and those that are ``exempt`` all stay."""
    free = F.col("exempt") | F.col(author).isNull()
    counted = rows.filter(~free).withColumn("_rn", F.row_number().over(Window.partitionBy(by, author).orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")
    return counted.unionByName(rows.filter(free))


def answer_holds(hits: DataFrame, by: str, bar: Column) -> DataFrame:
    """``(by, holds)``: some hit is exact, fully covered, twice over the bar, or over it and leading by 5 %."""
    two = top_k(hits.select(by, "score"), by, [F.desc("score")], 2, "_r").groupBy(by).agg(F.max("score").alias("best"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("second"))
    g = hits.groupBy(by).agg(F.max("exact").alias("exact"), F.max("full").alias("full")).join(two, by)
    lead = F.col("second").isNull() | (F.col("best") >= 1.05 * F.col("second"))
    return g.select(by, (F.col("exact") | F.col("full") | (F.col("best") >= 2 * bar) | ((F.col("best") >= bar) & lead)).alias("holds"))
