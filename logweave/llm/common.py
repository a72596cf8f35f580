"""What several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line types that are no part of a conversation.
SIDE_TYPES = ("summary", "attachment", "system", "tool_result")
#: Spellings of the two speakers.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant"}
BLANKS = " \t\n\r\f\v    　﻿"


def clean(c: Column) -> Column:
    """Lower case without outer blanks."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def not_blank(c: Column) -> Column:
    """True if c holds a character that is not white space; null counts as blank."""
    return F.coalesce(c.rlike(r"(?U)[^\s]"), F.lit(False))


def is_side(line_type: Column) -> Column:
    """True for lines beside the conversation."""
    return F.coalesce(clean(line_type).isin(*SIDE_TYPES), F.lit(False))


def speaker(role: Column, line_type: Column) -> Column:
    """``user``, ``assistant`` or null: the role, or the line's type where the role is null."""
    said = clean(F.coalesce(role, line_type))
    out = F.lit(None).cast("string")
    for k, v in SPEAKERS.items():
        out = F.when(said == k, F.lit(v)).otherwise(out)
    return out


def words(c: Column) -> Column:
    """Maximal runs of Unicode letters and digits of c, lower-cased; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


class Words(dict):
    """The hash of each word, remembered; all are forgotten when there are too many."""

    def __missing__(self, w: str) -> int:
        import xxhash

        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def word_hashes(texts: list[list[str]], known: Words):
    """The hashes of the words of all texts one after the other, and where each text's begin."""
    import numpy as np

    if len(known) > 500_000:
        known.clear()
    every, at = [], [0]
    for t in texts:
        every += map(known.__getitem__, t)
        at.append(len(every))
    return np.array(every, dtype=np.uint64), np.array(at)


def mix(x):
    """Scattered 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
