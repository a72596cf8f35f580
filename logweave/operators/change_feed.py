"""Problem 5: rebuild the current state of entries from a feed of openings, corrections and closings.

Lines find their entry by pointer doubling. Then each key is replayed in order: rows are repartitioned by key,
sorted by sequence within the partitions, and a state machine applies the columns each line carries, skipping
what is already applied. A hot key is replayed in slices; a slice's state says for each column at which
sequence it was set, so the slices' states are merged by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import cut

#: A status that closes an entry.
CLOSING = ("done", "discarded", "obsolete", "withdrawn")
#: Slices over which the lines of one entry are spread at least; as many as there are shuffle partitions, if those are more.
SLICES = 16

_STATE = "entry_id string, last_at long, last_seq long, current_id string, closes boolean, status_at long, status_seq long, status string"


class Replay:
    """The state of one entry. Each column keeps the (time, sequence) at which it was set; an event at or
    before that mark is already applied, or is older than what stands, and is skipped."""

    __slots__ = ("key", "last", "current_id", "closes", "status_mark", "status")

    def __init__(self, key: str) -> None:
        self.key, self.last, self.current_id, self.closes, self.status_mark, self.status = key, None, None, None, None, None

    def apply(self, last, current_id, closes, status_mark, status) -> None:
        if self.last is None or last > self.last:
            self.last, self.current_id, self.closes = last, current_id, closes
        if status_mark is not None and (self.status_mark is None or status_mark > self.status_mark):
            self.status_mark, self.status = status_mark, status

    def row(self) -> tuple:
        return (self.key, *self.last, self.current_id, self.closes, *(self.status_mark or (None, None)), self.status)


_SCHEMA = pa.schema([("entry_id", pa.string()), ("last_at", pa.int64()), ("last_seq", pa.int64()), ("current_id", pa.string()), ("closes", pa.bool_()), ("status_at", pa.int64()), ("status_seq", pa.int64()), ("status", pa.string())])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal entry_id in the sorted stream, one state each."""
    state, done = None, []
    for b in batches:
        for k, at, seq, cur, closes, s_at, s_seq, status in zip(*(b.column(n).to_pylist() for n in _SCHEMA.names)):
            if state is None or state.key != k:
                if state is not None:
                    done.append(state.row())
                state = Replay(k)
            state.apply((at, seq), cur, closes, None if s_at is None else (s_at, s_seq), status)
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _SCHEMA)], schema=_SCHEMA)
            done = []
    if state is not None:
        done.append(state.row())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _SCHEMA)], schema=_SCHEMA)


def resolve_roots(nodes: DataFrame) -> DataFrame:
    """``(id, root)`` of nodes ``(id, parent)``: the parentless node to which the parents lead.

    Ids are unique and not null. Nodes that lead to nothing or round a cycle are left out. Pointer doubling: after k rounds all
    chains of up to 2**k links are resolved. Each round is written to the shared folder, and only what is
    still open is carried on; when a round resolves nothing, what remains are cycles.
    """
    roots = nodes.filter("parent is null").select("id", F.col("id").alias("root"))
    ends = cut(nodes.select("id", "parent"))
    done = [roots]
    left = ends.filter("parent is not null and parent <> id")
    resolved = ends.filter("parent is null").select(F.col("id").alias("rid"), F.col("id").alias("root"))
    while True:
        # One table holds, for every node, whether it is resolved and else where its pointer stands.
        look = resolved.select(F.col("rid").alias("key"), "root", F.lit(None).cast("string").alias("next")).unionByName(
            left.select(F.col("id").alias("key"), F.lit(None).cast("string").alias("root"), F.col("parent").alias("next"))
        )
        step = cut(left.join(look, F.col("parent") == F.col("key"), "left").filter("key is not null").select("id", "root", "next"))
        new = step.filter("root is not null").select("id", "root")
        n_new = new.limit(1).count()
        if not n_new:
            break
        done.append(new)
        left = step.filter("root is null").select("id", F.col("next").alias("parent"))
        resolved = resolved.unionByName(new.select(F.col("id").alias("rid"), "root"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def replay_feed(log: DataFrame) -> DataFrame:
    """``(entry_id, current_id, status)``: the entries that hold at the feed's end.

    log has seq, id, replaces_id, retires_id, status, at_ts; other columns are never read. Copies of an id count
    once, with their smallest seq. A line with neither pointer opens the entry of its id; any other belongs to
    the entry to which its pointer leads (replaces_id before retires_id), wherever the lines between stand.
    Lines with a null id or at_ts, and lines that lead to nothing, to themselves or round a cycle, do not count
    as lines of an entry; a line without at_ts still leads on. In order of at_ts, then seq, the last line
    decides: if it has retires_id or a closing status, the entry is gone. ``status`` is the latest status that
    is not null of the lines that do not close, trimmed and lower-cased. An empty feed gives no rows.
    """
    lines = log.filter("id is not null").groupBy("id").agg(
        F.min_by(F.struct("seq", "replaces_id", "retires_id", F.lower(F.trim("status")).alias("status"), F.unix_micros(F.col("at_ts").cast("timestamp")).alias("at")), "seq").alias("x")
    )
    lines = lines.select("id", "x.*", F.coalesce("x.replaces_id", "x.retires_id").alias("parent"))
    roots = resolve_roots(lines.select("id", "parent"))
    lines = lines.filter("at is not null").join(roots, "id")
    closes = F.col("retires_id").isNotNull() | F.coalesce(F.col("status").isin(*CLOSING), F.lit(False))
    sets = ~closes & F.col("status").isNotNull()
    events = lines.select(
        F.col("root").alias("entry_id"), F.col("at").alias("last_at"), F.col("seq").alias("last_seq"), F.col("id").alias("current_id"), closes.alias("closes"),
        F.when(sets, F.col("at")).alias("status_at"), F.when(sets, F.col("seq")).alias("status_seq"), F.when(sets, F.col("status")).alias("status"),
    )
    slices = max(SLICES, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = events.withColumn("slice", F.pmod(F.xxhash64("current_id"), F.lit(slices)))
    sliced = sliced.repartition("entry_id", "slice").sortWithinPartitions("entry_id", "slice", "last_at", "last_seq")
    # Within a partition the slices of an entry follow each other, so its state goes on over them.
    parts = sliced.drop("slice").mapInArrow(_replay, _STATE)
    whole = parts.repartition("entry_id").sortWithinPartitions("entry_id", "last_at", "last_seq").mapInArrow(_replay, _STATE)
    return whole.filter("not closes").select("entry_id", "current_id", "status")
