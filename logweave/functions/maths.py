"""Scoring and statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: BM25 saturation and length weight; smoothing of rank fusion; bar of an answer.
K1, B, RRF_K, FIND_BAR = 1.2, 0.75, 60, 5.0


def idf(n_docs: Column, df: Column) -> Column:
    """ln(1 + (N - n + .5) / (n + .5))."""
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, avg: Column, weight: Column) -> Column:
    """The score of one term in one document; weight is its idf."""
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def coverage(covered: Column, asked: Column) -> Column:
    """0.6 to 1 by the share of the question's words that are covered."""
    return 0.6 + 0.4 * covered / asked


def rrf(rank: Column) -> Column:
    """Share of reciprocal rank fusion; rank counts from 1."""
    return 1 / (RRF_K + rank)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared L2 distance of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval for k of n; null for n = 0."""
    p, m = k / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0)).cast("double")
    mid, half, d = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    return F.greatest(F.lit(0.0), (mid - half) / d), F.least(F.lit(1.0), (mid + half) / d)


def find_bar(n: Column) -> Column:
    """The score below which an answer is weak, scaled by a rare word's weight among n documents."""
    return FIND_BAR * F.log(1 + (n - 0.5) / 1.5) / F.log(1 + F.lit((1000 - 0.5) / 1.5))


def nearest_rank(values: Column, p: int) -> Column:
    """The value at floor(p / 100 * n) of a sorted array, the last one at most; null for an empty array."""
    n = F.size(values)
    return F.get(values, F.least(F.floor(F.lit(p) * n / 100).cast("int"), n - 1))


#: Start and prime of the 32-bit FNV-1a hash, and the start of djb2.
FNV_START, FNV_PRIME, DJB_START = 2166136261, 16777619, 5381


def _fold(c: Column, start: int, step) -> Column:
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    return F.when(F.length(c) > 0, F.aggregate(codes, F.lit(start).cast("long"), lambda h, x: F.pmod(step(h, x), F.lit(1 << 32)))).when(c.isNotNull(), F.lit(start).cast("long"))


def fnv1a(c: Column) -> Column:
    """The 32-bit FNV-1a hash over the characters' codes."""
    return _fold(c, FNV_START, lambda h, x: h.bitwiseXOR(x) * FNV_PRIME)


def djb2(c: Column) -> Column:
    """The 32-bit djb2 hash over the characters' codes, which are mixed in by exclusive or."""
    return _fold(c, DJB_START, lambda h, x: (h * 33).bitwiseXOR(x))
