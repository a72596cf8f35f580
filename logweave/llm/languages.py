"""Problem 7: the language of records and of their segments.

A sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader and an
elastic-net penalty and calibrated by a temperature, scores the clauses of a text; a shortest path over the clauses with
a price for each change gives the segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "es", "fr", "nl", "pt")
#: Names of the languages besides their two-letter codes.
NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "es": ("spa", "spanish"),
    "fr": ("fra", "fre", "french"), "nl": ("nld", "dut", "dutch"), "pt": ("por", "portuguese"),
}
#: Hashed n-grams: sizes, and buckets (the model's and the statistics' fixed size).
SIZES, BUCKETS = (1, 2, 3), 1 << 16
#: Expected number of labelled rows of each language in the training sample, and clauses taken from them at most.
SAMPLE_ROWS, SAMPLE_CLAUSES = 300, 1500
#: Price of a change of language between clauses, in units of log probability.
SWITCH = 4.0

_SPLIT = re.compile(r"(?<=[.!?;:])[\"”»)\]]*\s+|\n+|\s[—–]\s")
_MARKS = re.compile(r"[^\w'’]+")
_CODE = re.compile(r"[\d_/@\\]")


def label(c: Column) -> Column:
    """The two-letter code that a label names, ``other`` for any other, null for null, blank and uncertain."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.when(c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)).isin("uncertain", "unknown", "und")), F.lit(None).cast("string"))
    for k, v in NAMES.items():
        out = out.when(base.isin(k, *v), F.lit(k))
    return out.otherwise("other")


def clauses(text: str) -> list[tuple[int, int]]:
    """Start and end of the stretches between marks, blank ones left out."""
    out, at = [], 0
    for m in [*_SPLIT.finditer(text), None]:
        end = m.start() if m else len(text)
        while at < end and (text[at].isspace() or text[at] in "—–->"):
            at += 1
        if at < end:
            out.append((at, end))
        at = m.end() if m else end
    return out


def plain(text: str) -> str:
    """The words of text in lower case, each between blanks; ids, paths and numbers are left out."""
    words = " ".join([w for w in text.lower().split() if not _CODE.search(w)])
    return f" {_MARKS.sub(' ', words).strip()} " if words else "  "


def grams(text: str):
    """The bucket of every n-gram of a plain text; the hash of a longer one goes on from that of a shorter one."""
    import numpy as np

    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    out, h = [], np.full(len(c), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for n in range(1, SIZES[-1] + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        if n in SIZES:
            out.append(h)
    return (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


@dataclass
class Model:
    weights: object  # (BUCKETS, languages), already times the idf
    idf: object
    bias: object
    temperature: float

    def log_probs(self, parts: list[str]):
        """One row of log probabilities for each plain text, and the letters in each."""
        import numpy as np

        ids = [grams(p) for p in parts]
        size = np.array([len(i) for i in ids])
        z = np.zeros((len(parts), len(LANGUAGES)))
        if size.sum():
            every = np.concatenate(ids)
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            some = size > 0
            z[some] = np.add.reduceat(self.weights.take(every, axis=0), at[some])
            z[some] /= np.sqrt(np.add.reduceat(self.idf[every] ** 2, at[some]))[:, None]
        z = (z + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), np.array([len(p) - p.count(" ") for p in parts])

    def segments(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """``(lang, confidence, start, end)`` of the longest stretches in one language, in order."""
        import numpy as np

        spans = clauses(text or "")
        parts = [plain(text[i:j]) for i, j in spans]
        keep = [k for k, p in enumerate(parts) if p.strip()]
        if not keep:
            return []
        spans, parts = [spans[k] for k in keep], [parts[k] for k in keep]
        lp, letters = self.log_probs(parts)
        # A clause of a few letters says little.
        lp = np.maximum(lp, -12.0) * np.minimum(1.0, letters / 24.0)[:, None]
        best, back = lp[0], []
        for row in lp[1:]:
            stay, move = best, best.max() - SWITCH
            back.append(np.where(stay >= move, np.arange(len(best)), best.argmax()))
            best = np.maximum(stay, move) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        out = []
        for k, lang in enumerate(path):
            if out and out[-1][0] == lang:
                out[-1][1].append(k)
            else:
                out.append((lang, [k]))
        done = []
        for lang, ks in out:
            w = letters[ks] + 1e-9
            done.append((LANGUAGES[lang], float((np.exp(lp[ks, lang]) * w).sum() / w.sum()), spans[ks[0]][0], spans[ks[-1]][1]))
        return done


def train(texts: list[tuple[str, str]], idf, *, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> Model:
    """FTRL-proximal over the clauses of labelled texts; every fifth clause is held out for the temperature."""
    import numpy as np

    rng = np.random.default_rng(seed)
    rows: dict[int, list] = {k: [] for k in range(len(LANGUAGES))}
    for lang, text in texts:
        k = LANGUAGES.index(lang)
        for i, j in clauses(text):
            p = plain(text[i:j])
            if len(p) > 12 and len(rows[k]) < SAMPLE_CLAUSES:
                g, n = np.unique(grams(p), return_counts=True)
                rows[k].append((g, n * idf[g] / np.sqrt((n * idf[g] ** 2).sum()), k))
    every = [r for v in rows.values() for r in v]
    order = rng.permutation(len(every))
    held = [every[i] for i in order[::5]]
    fit = [every[i] for n, i in enumerate(order) if n % 5]
    c = len(LANGUAGES)
    z, n2, zb, nb, bias = np.zeros((BUCKETS, c)), np.zeros((BUCKETS, c)), np.zeros(c), np.zeros(c), np.zeros(c)

    def weights(g):
        zz, nn = z[g], n2[g]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            g, x, k = fit[i]
            w = weights(g)
            s = x @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[k] -= 1.0
            grad = x[:, None] * p
            sigma = (np.sqrt(n2[g] + grad**2) - np.sqrt(n2[g])) / alpha
            z[g] += grad - sigma * w
            n2[g] += grad**2
            sb = (np.sqrt(nb + p**2) - np.sqrt(nb)) / alpha
            zb += p - sb * bias
            nb += p**2
            bias = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
    w = weights(slice(None))
    t = 1.0
    if held:
        s = np.stack([x @ w[g] + bias for g, x, _ in held])
        y = np.array([k for *_, k in held])

        def loss(temp: float) -> float:
            v = s / temp
            v = v - v.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]))

        t = min(np.geomspace(0.1, 5.0, 60), key=loss)
    return Model((w * idf[:, None]).astype(np.float32), idf.astype(np.float32), bias, float(t))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    df, n, place = np.zeros(BUCKETS, dtype=np.int64), 0, np.zeros(BUCKETS, dtype=np.int64)
    for b in batches:
        for t in b.column("text").to_pylist():
            g = grams(plain(t))
            k = np.arange(len(g))
            place[g] = k  # of equal n-grams the last one stands there, so each is counted once
            df[g[place[g] == k]] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])


def fit(labelled: DataFrame, corpus: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of labelled ``(id, text, lang)`` with document frequencies over all of corpus ``(text)``.

    About sample_rows labelled rows of each language are drawn by a hash of their id and come to the driver, as
    do the BUCKETS frequencies; nothing else does.
    """
    import numpy as np

    counted = corpus.filter("text is not null").select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = next((r["n"] for r in counted if r["bucket"] < 0), 0)
    df = np.zeros(BUCKETS)
    for r in counted:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    known = labelled.withColumn("lang", label(F.col("lang"))).filter(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    take = F.lit(False)
    for lang, n in sizes.items():
        take = take | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("id"), F.lit(max(1, n))) < sample_rows))
    rows = known.filter(take).select("lang", "text", F.xxhash64(F.lit("order"), "id").alias("h")).collect()
    # In an order that has nothing to do with the ids, so that the clauses taken come from all of the sample.
    return train([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["h"], r["lang"], r["text"]))], idf)


def _segment(model_b):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*model_b.value)
        kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for i, t in zip(b.column("rec_id").to_pylist(), b.column("text").to_pylist()):
                for n, s in enumerate(model.segments(t), 1):
                    for c, v in zip(cols, (i, n, *s)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["rec_id", "seg_no", "lang", "confidence", "start_pos", "end_pos"])

    return go


def segments(texts: DataFrame, model: Model) -> DataFrame:
    """``(rec_id, seg_no, lang, confidence, start_pos, end_pos)`` of texts ``(rec_id, text)``.

    Positions are code points, end exclusive; seg_no counts from 1. Texts without a word, null and empty ones, and empty tables
    give no rows. Whole texts are read, each on its own.
    """
    b = texts.sparkSession.sparkContext.broadcast(astuple(model))
    return texts.filter("text is not null").select(F.col("rec_id").cast("string").alias("rec_id"), "text").mapInArrow(_segment(b), "rec_id string, seg_no int, lang string, confidence double, start_pos int, end_pos int")


def _main(model_b):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*model_b.value)
        for b in batches:
            texts, best = b.column("text").to_pylist(), []
            for i in range(0, len(texts), 32):  # a few at once: a row of weights is read for every n-gram
                lp, letters = model.log_probs([plain(t) for t in texts[i : i + 32]])
                best += [LANGUAGES[k] if n else None for k, n in zip(lp.argmax(axis=1), letters)]
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array(best, pa.string())], ["rec_id", "lang"])

    return go


def main_language(texts: DataFrame, model: Model) -> DataFrame:
    """``(rec_id, lang)`` of texts ``(rec_id, text)``, one row each; lang is null without a word."""
    b = texts.sparkSession.sparkContext.broadcast(astuple(model))
    return texts.filter("text is not null").select("rec_id", "text").mapInArrow(_main(b), "rec_id string, lang string")


def line_texts(log: DataFrame) -> DataFrame:
    """``(world, text)`` of each line of the log that has any text."""
    body = F.concat_ws(". ", "title", "text", "learning", "choice", "why")
    return log.filter("world is not null").select("world", body.alias("text")).filter("text <> ''")


def fit_on(docs: DataFrame, hits: DataFrame, log: DataFrame) -> Model:
    """The model of the project's labelled documents, with frequencies over all texts of the three tables."""
    corpus = docs.select("text").unionByName(hits.select(F.col("entry_text").alias("text"))).unionByName(line_texts(log).select("text"))
    return fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"), corpus)


def relabelled_hits(hits: DataFrame, model: Model) -> DataFrame:
    """``(rec_id, seg_no, lang, confidence, start_pos, end_pos)`` of the hits whose lang is null, uncertain or another than
    that of their first segment, or that have several segments. Hits with a null hit_id or no word have no row."""
    rows = hits.filter("hit_id is not null and entry_text is not null").select(F.col("hit_id").cast("string").alias("rec_id"), F.col("entry_text").alias("text"), label(F.col("lang")).alias("labelled"))
    b = hits.sparkSession.sparkContext.broadcast(astuple(model))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*b.value)
        kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
        for x in batches:
            cols: list[list] = [[] for _ in kinds]
            for i, t, lab in zip(x.column("rec_id").to_pylist(), x.column("text").to_pylist(), x.column("labelled").to_pylist()):
                seg = m.segments(t)
                if len(seg) > 1 or seg and seg[0][0] != lab:
                    for n, s in enumerate(seg, 1):
                        for c, v in zip(cols, (i, n, *s)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["rec_id", "seg_no", "lang", "confidence", "start_pos", "end_pos"])

    return rows.mapInArrow(go, "rec_id string, seg_no int, lang string, confidence double, start_pos int, end_pos int")


def relabelled_worlds(config: DataFrame, log: DataFrame, model: Model) -> DataFrame:
    """``(rec_id, lang, confidence)`` of the worlds whose config_language is null, uncertain or not the language of most
    of their lines; confidence is those lines' share. Of equal counts the first language by name wins. Worlds without lines have no row."""
    lines = main_language(line_texts(log).withColumnRenamed("world", "rec_id"), model)
    n = lines.filter("lang is not null").groupBy("rec_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("rec_id")
    top = n.withColumn("all", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "lang"))).filter("rank = 1")
    c = config.filter("world is not null").select(F.col("world").alias("rec_id"), label(F.col("config_language")).alias("labelled")).distinct()
    return top.join(c, "rec_id").filter("labelled is null or labelled <> lang").select("rec_id", "lang", (F.col("n") / F.col("all")).alias("confidence"))
