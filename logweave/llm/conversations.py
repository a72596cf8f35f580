"""Problem 3: rebuild conversations from message rows.

Rows are partitioned by conversation (a hot one further by time), secondary-sorted by sequence, and run through
a finite-state automaton. Its state after a turn is that turn's speaker, so a part of a conversation is
summarised by its first and last speaker and whether it died inside, and parts are joined by the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import is_side, not_blank, speaker

#: The automaton. States: start, user (a question is open), assistant (answered), and dead for all else.
TRANSITIONS = {("start", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "assistant"): "assistant"}
ACCEPTING = ("assistant",)
#: Lines of a path within one task; beyond that a path is split.
PATH_BLOCK = 65_536
#: Time span, in microseconds, within which one task sorts the lines of a conversation.
SPAN_US = 3600 * 1_000_000
#: Tasks over which the lines without a path or a place in it are spread.
LOOSE = 1_024


def _dies(state: Column, symbol: Column) -> Column:
    alive = F.lit(False)
    for (s, x) in TRANSITIONS:
        alive = alive | ((state == s) & (symbol == x))
    return symbol.isNotNull() & ~alive


def _with_times(lines: DataFrame) -> DataFrame:
    """Adds ``t``: the line's own time or that of the nearest earlier line of its path that has one. A line without a path or a place in it
    neither gives a time nor takes one, and goes to any task."""
    loose = F.col("path").isNull() | F.col("line").isNull()
    lines = lines.withColumn("capture", F.when(loose, F.concat(F.lit("\0"), F.pmod(F.xxhash64("line_id"), F.lit(LOOSE)).cast("string"))).otherwise(F.col("path")))
    block = F.floor(F.coalesce(F.col("line"), F.lit(0)) / PATH_BLOCK)
    rows = lines.withColumn("block", block).repartition("capture", "block")
    timed = F.when(F.col("ts").isNotNull() & ~loose, F.struct("line", "ts"))
    within = F.max(timed).over(Window.partitionBy("capture", "block").orderBy("line").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("near", within)
    ends = lines.withColumn("block", block).repartition("capture", "block").groupBy("capture", "block").agg(F.max(timed).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("capture").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("capture", "block", before.alias("carried")).filter("carried is not null")
    rows = rows.join(ends, ["capture", "block"], "left")
    known = F.when(~loose, F.coalesce("near.ts", "carried.ts"))
    return rows.withColumn("t", F.coalesce("ts", known)).drop("near", "carried", "block", "capture")


def _parts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their place in their part, and one row for each part of a conversation."""
    role = speaker(F.col("message.role"), F.col("line_type"))
    narrow = lines.filter("conv_id is not null").select(
        "line_id", "path", "line", "conv_id", "ts",
        is_side(F.col("line_type")).alias("side"),
        F.when(F.col("message").isNotNull(), role).alias("speaker"),
        not_blank(F.col("message.content")).alias("said"),
        F.unhex(F.md5(F.col("message.content"))).alias("digest"),
    )
    # What has no time stands first, in order of the line; without that either, first of all.
    part = F.coalesce(F.floor(F.unix_micros("t") / SPAN_US), F.lit(-(2**62)) + F.coalesce(F.floor(F.col("line") / PATH_BLOCK), F.lit(-(2**33))))
    rows = _with_times(narrow).filter("not side").withColumn("part", part).repartition("conv_id", "part")
    bad = F.col("speaker").isNull()
    same = Window.partitionBy("conv_id", "part", "speaker", "ts", "digest").orderBy("line_id")
    rows = rows.withColumn("turn", ~bad & F.col("said") & (F.col("ts").isNull() | (F.row_number().over(same) == 1)))
    order = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("t"), F.asc_nulls_first("line"), "line_id")
    spoken = F.when(F.col("turn"), F.col("speaker"))
    state = F.last(spoken, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    place = F.sum(F.col("turn").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"state": state, "place": place})
    dead = F.col("turn") & F.col("state").isNotNull() & _dies(F.col("state"), F.col("speaker"))
    parts = rows.groupBy("conv_id", "part").agg(
        F.max(bad).alias("bad"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("turn").alias("n_turns"),
        F.min(F.when(F.col("turn"), F.struct("place", "speaker")))["speaker"].alias("first"),
        F.max(F.when(F.col("turn"), F.struct("place", "speaker")))["speaker"].alias("last"),
        F.coalesce(F.max(dead), F.lit(False)).alias("dead"),
    )
    over = Window.partitionBy("conv_id").orderBy("part")
    whole = Window.partitionBy("conv_id")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({
        "entered": F.coalesce(F.last("last", ignorenulls=True).over(earlier), F.lit("start")),
        "offset": F.coalesce(F.sum("n_turns").over(earlier), F.lit(0)),
        "ended": F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "bad": F.max("bad").over(whole), "turns": F.sum("n_turns").over(whole), "lines": F.sum("n_lines").over(whole),
        "opened": F.first("first", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    parts = parts.withColumn("dead", F.max(F.col("dead") | F.coalesce(_dies(F.col("entered"), F.col("first")), F.lit(False))).over(whole))
    verdict = (
        F.when(F.col("bad"), "broken").when(F.col("turns") == 0, "empty").when(F.col("opened") != "user", "no question")
        .when(F.col("dead") | ~F.col("ended").isin(*ACCEPTING), "no reply").otherwise("kept")
    )
    return rows.filter("turn"), parts.withColumn("verdict", verdict)


def rebuild_conversations(lines: DataFrame) -> DataFrame:
    """``(conv_id, turn_no, line_id, speaker)``: the turns, in order, of every conversation that is whole.

    Side lines are ignored. A conversation is dropped if another line has a null message or a speaker that is
    neither user nor assistant, if no turn is left, if it does not begin with user, or if a user turn is not
    directly followed by an assistant turn. Blank messages are left out; of lines with equal speaker, own time
    (not null) and content the smallest line_id stays. Order is time, then line, then line_id; a line without a
    time takes that of the nearest earlier line of its path that has one (of several such lines the latest
    time), and stands first if there is none. Rows with a null conv_id belong to no conversation. An empty
    table gives an empty result; other columns are never read.
    """
    turns, parts = _parts(lines)
    kept = parts.filter("verdict = 'kept' and n_turns > 0").select("conv_id", "part", "offset")
    return turns.join(kept, ["conv_id", "part"]).select("conv_id", (F.col("offset") + F.col("place")).cast("long").alias("turn_no"), "line_id", "speaker")


def conversation_verdicts(lines: DataFrame) -> DataFrame:
    """``(conv_id, verdict, turns, lines)``: kept, or why the conversation is dropped: broken, empty,
    no question or no reply. ``lines`` counts all but side lines; conversations of side lines alone have no row."""
    _, parts = _parts(lines)
    return parts.groupBy("conv_id").agg(F.first("verdict").alias("verdict"), F.first("turns").alias("turns"), F.first("lines").alias("lines"))
