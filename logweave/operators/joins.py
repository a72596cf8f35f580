"""Joins of records with records: lookups, as-of and interval joins, shared features, overlaps, similar names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import text as tx
from logweave.session import cut


def lookup(links: DataFrame, ends: list[str], entries: DataFrame, key: str) -> DataFrame:
    """links with ``<end>_found`` for each end: whether it names an entry."""
    ids = entries.select(F.col(key).alias("_k")).filter("_k is not null").distinct()
    for e in ends:
        links = links.join(ids, F.col(e) == F.col("_k"), "left").withColumn(f"{e}_found", F.col("_k").isNotNull()).drop("_k")
    return links


def nearest_within(left: DataFrame, right: DataFrame, key: str, lid: str, rid: str, tolerance_us: int) -> DataFrame:
    """``(lid, rid, dt_us)``: the right row nearest in time of the same key; ties to the smaller rid.

    left and right have key and ``t`` in microseconds. Both are cut into buckets of the tolerance, right rows go to the
    neighbouring buckets too, and the join is an equi-join on key and bucket.
    """
    b = lambda c: F.floor(c / tolerance_us)
    lhs = left.select(lid, key, F.col("t").alias("lt"), b(F.col("t")).alias("b")).filter("lt is not null")
    rhs = right.select(F.col(rid), key, F.col("t").alias("rt")).filter("rt is not null").withColumn("b", F.explode(F.sequence(b(F.col("rt")) - 1, b(F.col("rt")) + 1)))
    near = lhs.join(rhs, [key, "b"]).withColumn("dt_us", F.abs(F.col("lt") - F.col("rt"))).filter(F.col("dt_us") <= tolerance_us)
    return near.groupBy(lid).agg(F.min(F.struct("dt_us", rid)).alias("m")).select(lid, f"m.{rid}", "m.dt_us")


def first_after(left: DataFrame, right: DataFrame, key: str, lid: str, rid: str, within_us: int) -> DataFrame:
    """``(lid, rid, dt_us)``: the first right row of the key after, at most within_us; bucketed as nearest_within."""
    b = lambda c: F.floor(c / within_us)
    lhs = left.select(lid, key, F.col("t").alias("lt")).filter("lt is not null").withColumn("b", F.explode(F.array(b(F.col("lt")), b(F.col("lt")) + 1)))
    rhs = right.select(rid, key, F.col("t").alias("rt"), b(F.col("t")).alias("b")).filter("rt is not null")
    near = lhs.join(rhs, [key, "b"]).withColumn("dt_us", F.col("rt") - F.col("lt")).filter((F.col("dt_us") > 0) & (F.col("dt_us") <= within_us))
    return near.groupBy(lid).agg(F.min(F.struct("dt_us", rid)).alias("m")).select(lid, f"m.{rid}", "m.dt_us")


def first_sharing(questions: DataFrame, entries: DataFrame, near: int = 16, far: int = 2_048) -> DataFrame:
    """``(qid, eid, t)``: the first entry after each question that shares at least ``need`` of its words; ties to the smaller eid. Exact.

    questions is ``(qid, t, w, need)``, entries ``(eid, t, w)``, w distinct words. Both stand in one order of time. A question meets
    the next ``near`` places, and if none answers it the places behind, each time eight times as many: of equal blocks up to ``far``
    places whole word sets are compared, beyond it those left are joined by (block, word). Frequent words find their answer early,
    what goes on is rare; no word is left out.
    """
    q = questions.filter((F.col("need") > 0) & (F.size("w") >= F.col("need")) & F.col("t").isNotNull())
    e = entries.filter((F.size("w") > 0) & F.col("t").isNotNull())
    text = F.array_join("w", " ").alias("w")
    every = q.select(F.col("qid"), F.lit(None).cast(e.schema["eid"].dataType).alias("eid"), "t", text, "need").unionByName(e.select(F.lit(None).cast(q.schema["qid"].dataType).alias("qid"), "eid", "t", text, F.lit(0).alias("need")))
    # The order is written down: numbers of partitions and rows within them are places only in what is not computed again.
    rows = cut(every.repartitionByRange("t", "eid").sortWithinPartitions("t", "eid"))
    counts = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    start, n = {}, 0
    for r in sorted(counts, key=lambda r: r["p"]):
        start[r["p"]], n = n, n + r["count"]
    if not n:
        return rows.select("qid", "eid", "t").limit(0)
    first = F.create_map(*[F.lit(x).cast("long") for kv in start.items() for x in kv])
    placed = rows.withColumn("p", F.spark_partition_id().cast("long")).withColumn("place", first[F.col("p")] + F.monotonically_increasing_id().bitwiseAND(2**33 - 1)).withColumn("w", F.split("w", " "))
    e = placed.filter("eid is not null").select("eid", "t", "w", "place")
    left = placed.filter("qid is not null").select("qid", F.col("t").alias("qt"), F.col("w").alias("qw"), "need", (F.col("place") + 1).alias("lo"))
    done, width = None, near
    while True:
        b = lambda c: F.floor(c / width)  # noqa: B023, E731
        asked = left.withColumn("b", F.explode(F.array(b(F.col("lo")), b(F.col("lo")) + 1)))
        there = e.withColumn("b", b(F.col("place")))
        inside = (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("lo") + width) & (F.col("t") > F.col("qt"))
        if width <= far:
            hit = asked.join(there, "b").filter(inside & (F.size(F.array_intersect("qw", "w")) >= F.col("need")))
        else:
            asked, there = asked.withColumn("x", F.explode("qw")).drop("qw"), there.select("eid", "t", "place", "b", F.explode("w").alias("x"))
            there = there.join(asked.select("x").distinct(), "x", "left_semi")
            hit = asked.join(there, ["b", "x"]).filter(inside).groupBy("qid", "eid", "t").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need")
        found = cut(hit.groupBy("qid").agg(F.min(F.struct("t", "eid")).alias("m")).select("qid", "m.eid", "m.t"))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found.select("qid"), "qid", "left_anti").withColumn("lo", F.col("lo") + width).filter(F.col("lo") < n))
        if left.isEmpty():
            return done
        width *= 8


def asof_backward(left: DataFrame, right: DataFrame, key: str, lid: str, rid: str) -> DataFrame:
    """``(lid, rid)``: the last right row of the key at or before each left row, null without one.

    One union and one window, no range join: right rows stand before left rows of the same time.
    """
    u = left.select(key, "t", F.lit(1).alias("side"), F.col(lid).alias("l"), F.lit(None).cast("long").alias("r")).unionByName(right.select(key, "t", F.lit(0).alias("side"), F.lit(None).cast("long").alias("l"), F.col(rid).alias("r")))
    w = Window.partitionBy(key).orderBy("t", "side", "r", "l").rowsBetween(Window.unboundedPreceding, 0)
    return u.filter("t is not null").withColumn("m", F.last("r", ignorenulls=True).over(w)).filter("side = 1").select(F.col("l").alias(lid), F.col("m").alias(rid))


def asof_within(left: DataFrame, right: DataFrame, keys: list[str], lid: str, rid: str, most: int) -> DataFrame:
    """``(keys, lid, rid, after_us)``: the last right row of the keys at or before each left row and most microseconds before it at most;
    of equal times the larger rid. Left rows without one have no row.

    Time is cut into buckets of that length, so the candidates of a left row are in two of them, and a hot key is split by time.
    """
    b = lambda c: F.floor(F.col(c) / most)
    l = left.select(*keys, F.col(lid), F.col("t").alias("lt")).withColumn("b", F.explode(F.array(b("lt"), b("lt") - 1)))
    r = right.select(*keys, F.col(rid), F.col("t").alias("rt")).withColumn("b", b("rt"))
    near = l.join(r, [*keys, "b"]).filter((F.col("rt") <= F.col("lt")) & (F.col("lt") - F.col("rt") <= most))
    return near.groupBy(*keys, lid, "lt").agg(F.max(F.struct("rt", rid)).alias("m")).select(*keys, lid, F.col(f"m.{rid}").alias(rid), (F.col("lt") - F.col("m.rt")).alias("after_us"))


def shared_features(items: DataFrame, key: str, feature: str, most_df: int, n: float) -> DataFrame:
    """``(a, b, strength, shared)``: pairs of keys by the features of at most most_df keys that they share, strength sum ln(n / df).

    items is ``(key, feature)``, distinct. The cap stands before the self-join, so a feature gives at most most_df squared pairs.
    """
    df = items.groupBy(feature).agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") <= most_df) & (F.col("df") > 1))
    x = items.join(df, feature).select(F.col(key).alias("k"), F.col(feature).alias("f"), "df")
    p = x.alias("p").join(x.alias("q"), (F.col("p.f") == F.col("q.f")) & (F.col("p.k") < F.col("q.k")))
    return p.groupBy(F.col("p.k").alias("a"), F.col("q.k").alias("b")).agg(F.round(F.sum(F.log(F.lit(float(n)) / F.col("p.df"))), 6).alias("strength"), F.count(F.lit(1)).alias("shared"))


def tier_of(strength: Column, auto: float = 12.0, borderline: float = 5.5) -> Column:
    """auto, borderline or dropped."""
    return F.when(strength >= auto, "auto").when(strength >= borderline, "borderline").otherwise("dropped")


#: Keys of equal sets that stand in one row, words of a set that its rows carry, 64-bit words of its bitmap, sets of a word that one task compares.
TOGETHER, CARRIED, MAPS, HOT = 64, 64, 4, 1 << 13


def overlapping_sets(sets: DataFrame, key: str, words: str, *, shared: int = 2, jaccard: float = 0.25) -> DataFrame:
    """``(a, b, shared, jaccard)``: pairs of keys whose word sets share enough. Exact.

    Equal sets are compared once. Prefix filter: in the order from rare to frequent, two sets at or over the bounds share one of their
    first n - least + 1 words, where least is what a set must share with any other. Sets meet on these words, and a pair comes out of
    the first word that it shares alone: the rows that meet carry what decides, so pairs are not shuffled. Only those with a set of more
    than CARRIED words are, as far as the bounds leave them. A word of more than HOT sets is split into blocks, a task for two of them.
    """
    spark = sets.sparkSession
    w = sets.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(words)).alias("w")).filter((F.size("w") >= max(1, shared)) & F.col("k").isNotNull())
    part = F.floor((F.row_number().over(Window.partitionBy("w").orderBy("k")) - 1) / TOGETHER)
    units = w.withColumn("part", part).groupBy("w", "part").agg(F.collect_list("k").alias("ks"))
    # Numbers of rows are the same for all who read them only in what is written down.
    every = cut(units.select(F.monotonically_increasing_id().alias("u"), F.size("w").alias("n"), "w", "ks"))
    e = every.select("u", F.explode("w").alias("x"))
    df = e.groupBy("x").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")  # a word of one unit is shared with none
    df = cut(df.select("x", "df", F.monotonically_increasing_id().alias("i")))
    spot = F.pmod(F.xxhash64("i"), F.lit(64 * MAPS))
    maps = [F.coalesce(F.bit_or(F.when(F.floor(spot / 64) == m, F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")))), F.lit(0)).alias(f"m{m}") for m in range(MAPS)]
    in_order = e.join(df, "x").groupBy("u").agg(F.array_sort(F.collect_list(F.struct("df", "i"))).alias("o"), *maps)
    least = F.greatest(F.lit(max(1, shared)), F.ceil(F.col("n") * jaccard - 1e-9)).cast("int")
    units = cut(every.drop("w").join(in_order, "u").filter(F.size("o") >= least).withColumn("least", least))

    small = F.col("n") <= CARRIED
    size = F.size("o").alias("size")
    x = units.select("u", "n", size, F.when(small, F.col("o.i")).alias("w"), F.when(small, F.col("ks")).alias("ks"), *(f"m{m}" for m in range(MAPS)), F.posexplode(F.slice("o", F.lit(1), F.size("o") - F.col("least") + 1)).alias("place", "x"))
    blocks = F.ceil(F.col("x.df") / HOT).cast("int")
    x = x.withColumn("block", F.pmod(F.xxhash64("u"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    x = x.withColumn("cell", F.least("block", "other") * blocks + F.greatest("block", "other"))
    keys = x.withColumn("own", F.col("block") == F.col("other")).withColumn("x", F.col("x.i")).drop("other").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "x", "cell")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    # What can follow the first shared word bounds what two sets share; so do the bits that only one set has, each of
    # which stands for a word at least that the other lacks.
    lacks = lambda p, q: sum((F.bit_count(p(f"m{m}").bitwiseAND(F.bitwise_not(q(f"m{m}")))) for m in range(MAPS)), F.lit(0))
    most = F.least(a("size") - F.greatest(a("place"), lacks(a, b)), b("size") - F.greatest(b("place"), lacks(b, a)))
    enough = (most >= shared) & (most * (1 + jaccard) >= (a("n") + b("n")) * jaccard - 1e-9)
    # Sets of one block meet in the cell of that block alone.
    on = (a("x") == b("x")) & (a("cell") == b("cell")) & (a("u") < b("u")) & ((a("block") != b("block")) | a("own")) & enough

    def decided(pairs: DataFrame, first: Column | None) -> DataFrame:
        # explode keeps the words shared from being sought again for each use of them.
        pairs = pairs.withColumn("both", F.explode(F.array(F.array_intersect("w_a", "w_b")))).withColumn("shared", F.size("both"))
        pairs = pairs.withColumn("j", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
        pairs = pairs.filter((F.col("shared") >= shared) & (F.col("j") >= jaccard) & (F.lit(True) if first is None else F.get("both", F.lit(0)) == first))
        return pairs.withColumn("k_a", F.explode("ks_a")).withColumn("k_b", F.explode("ks_b")).select("k_a", "k_b", "shared", "j")

    sides = lambda *cs: [f(c).alias(f"{c}_{z}") for z, f in (("a", a), ("b", b)) for c in cs]
    few = keys.filter(small)
    out = decided(few.alias("a").join(few.alias("b"), on).select(a("x").alias("x"), *sides("n", "w", "ks")), F.col("x"))
    # Equal sets of one row; 1 is at or over any bound.
    alike = every.filter(F.size("ks") > 1).withColumn("k_a", F.explode("ks")).withColumn("k_b", F.explode("ks")).filter("k_a < k_b").select("k_a", "k_b", F.col("n").alias("shared"), F.lit(1.0).alias("j"))
    out = out.unionByName(alike)
    if not units.filter(~small).isEmpty():
        near = keys.filter(F.col("n") > math.floor(CARRIED * jaccard)).drop("w", "ks")
        left = near.alias("a").join(near.alias("b"), on & (F.greatest(a("n"), b("n")) > CARRIED)).select(*sides("u")).distinct()
        for z in "ab":
            left = left.join(units.select(F.col("u").alias(f"u_{z}"), F.col("n").alias(f"n_{z}"), F.col("o.i").alias(f"w_{z}"), F.col("ks").alias(f"ks_{z}")), f"u_{z}")
        out = out.unionByName(decided(left, None))
    return out.filter("k_a <> k_b").select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"), "shared", F.round("j", 6).alias("jaccard"))


def similar_names(names: DataFrame) -> DataFrame:
    """``(a, b, reason)``: pairs of distinct names ``(n)`` that are alike, see functions.text.similar_reason.

    Candidates meet on keys: the compact name with up to two letters deleted, and the name at each of its hyphens. Exact.
    """
    n = names.filter("n is not null").distinct().select("n", tx.name_key(F.col("n")).alias("x"))
    c = F.replace(F.col("x"), F.lit("-"), F.lit(""))
    drop = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    once = drop(c)
    twice = F.flatten(F.transform(once, drop))
    parts = F.split("x", "-")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))
    keys = F.array_distinct(F.concat(F.array(c), once, twice, F.transform(F.concat(cuts, tails), lambda p: F.concat(F.lit("="), p))))
    k = n.select("n", F.explode(keys).alias("key"))
    cand = k.alias("a").join(k.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.n") < F.col("b.n"))).select(F.col("a.n").alias("a"), F.col("b.n").alias("b")).distinct()
    return cand.withColumn("reason", tx.similar_reason(F.col("a"), F.col("b"))).filter("reason is not null")
