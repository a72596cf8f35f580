"""Problem 8: passages of held-out items inside a corpus.

Pigeonhole edit matching. An item is cut into consecutive pieces so short that any stretch of ``run`` words holds
one whole piece more than the error budget; so in any leaked stretch at least one piece stands exactly. An
Aho-Corasick automaton finds all pieces in one pass over a document, and each hit is verified with Myers'
bit-parallel distance, with words as the symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import words

#: Size of a shard of the items, in characters. One automaton holds the pieces of one shard, and a pass over the documents is made
#: for each, so what an executor holds is bounded whatever the number of items.
SHARD_CHARS = 16_000_000


def myers_ends(pattern: list[str], text: list[str], k: int) -> list[int]:
    """Positions in text (exclusive) at which a stretch within edit distance k of the whole pattern ends."""
    m = len(pattern)
    if not m:
        return []
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
        if score <= k:
            out.append(j + 1)
    return out


def piece_length(run: int, budget: int) -> int:
    """Words of a piece: any run of that many words holds budget + 1 whole pieces."""
    return max(1, (run + 1) // (budget + 2))


def leaks(item: list[str], doc: list[str], at_item: int, at_doc: int, size: int, run: int, budget: int) -> bool:
    """Whether a stretch of run words of the item that holds the piece at at_item stands around at_doc."""
    for start in range(max(0, at_item + size - run), min(at_item, len(item) - run) + 1):
        lo = max(0, at_doc - (at_item - start) - budget)
        hi = at_doc + (start + run - at_item) + budget
        if myers_ends(item[start : start + run], doc[lo:hi], budget):
            return True
    return False


def _pieces(item: list[str], size: int) -> Iterator[tuple[int, str]]:
    for i in range(0, len(item) - size + 1, size):
        yield i, " ".join(item[i : i + size])


def _scan(items_b, run: int, budget: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        items, size = items_b.value, piece_length(run, budget)
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, w) in enumerate(items):
            if len(w) >= run:
                for i, p in _pieces(w, size):
                    where.setdefault(p, []).append((n, i))
        auto = ahocorasick.Automaton()
        for p, v in where.items():
            auto.add_word(f" {p} ", (len(p), v))
        if where:
            auto.make_automaton()
        for b in batches:
            docs, found = [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("norm").to_pylist()):
                if not text or not where:
                    continue
                seen, split = set(), None
                for end, (length, at) in auto.iter(text):
                    split = text.split() if split is None else split
                    first = text.count(" ", 0, end - length) - 1  # a blank stands before the first word too
                    for n, i in at:
                        if n not in seen and leaks(items[n][1], split, i, first, size, run, budget):
                            seen.add(n)
                docs += [doc_id] * len(seen)
                found += [items[n][0] for n in seen]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    return go


def leaked_items(docs: DataFrame, items: DataFrame, *, run: int = 13, budget: int = 0, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``(doc_id, item_id)``: each item of which run consecutive words stand, with at most budget edits, in the document.

    docs is ``(doc_id, text)``, items ``(item_id, text)``; other columns are never read. An edit is a word put in,
    left out or changed. Words are maximal runs of Unicode letters and digits, lower-cased. Items of fewer
    than run words leak nothing; null ids or texts and empty tables give no rows; each pair comes once, also
    where ids repeat. Whole texts are read. Items are dealt by their id into shards of about shard_chars characters, or one
    item if that is longer, and each shard is sent to the executors.
    """
    norm = F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" "))
    d = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    held = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    sc, out = docs.sparkSession.sparkContext, None
    total = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_chars))
    for k in range(shards):
        mine = held.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") >= run)
        known = [(r["item_id"], r["words"]) for r in mine.toLocalIterator()]
        found = d.mapInArrow(_scan(sc.broadcast(known), run, budget), "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
