"""Interval operators on timed lines: overlap islands, padded merging, gap sessions, max-min partitions, packing.

Overlap components and gap sessions are windows over start-sorted lines; no pair of lines is ever enumerated for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OVERLAP, LONGEST, PADDING, PADDING_BUFFER, GAP = 0.2, 30.0, 0.5, 0.1, 7.0


def overlap_islands(lines: DataFrame, threshold: float = OVERLAP, song: str = "song_id") -> DataFrame:
    """Adds ``island``: lines of a song that overlap by more than ``threshold``, directly or through others, share one.

    An island's number is the least line_idx in it. Lines (line_idx, start, end) no longer than the threshold overlap
    nothing; they are set aside first, for else they would split an island they lie in.
    """
    long = F.col("end") - F.col("start") > threshold
    order = Window.partitionBy(song, "_long").orderBy("start", "line_idx")
    furthest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(~F.col("_long") | furthest.isNull() | ~(furthest - F.col("start") > threshold), 1).otherwise(0)
    marked = lines.withColumn("_long", long).withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("island", F.min("line_idx").over(Window.partitionBy(song, "_long", "_run"))).drop("_long", "_opens", "_run")


def merge_lines(lines: DataFrame, durations: DataFrame, threshold: float = OVERLAP, longest: float = LONGEST, padding: float = PADDING, buffer: float = PADDING_BUFFER, song: str = "song_id") -> DataFrame:
    """Overlapping lines merged and padded: (song_id, island, n_lines, text, start, end), without groups over ``longest``.

    Padding reaches up to ``buffer`` short of what the song's other lines leave free. Where both sides together would pass
    ``longest``, both shrink to the lesser, and what then remains, less a millisecond, is shared out, which may pass a
    limit or shorten the segment by a millisecond. ``durations`` has (song_id, duration).
    """
    marked = overlap_islands(lines, threshold, song)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "")
    groups = marked.groupBy(song, "island").agg(F.count("*").alias("n_lines"), text.alias("text"), F.min("start").alias("g_start"), F.max("end").alias("g_end"))
    other = marked.select(song, F.col("island").alias("_island"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    # A line of another island counts if it ends before the group ends, or starts after the group starts. Over lines sorted
    # by end (start) the nearest such value is a running extreme, so no group meets every line of its song.
    events = groups.select(song, "island", F.col("g_end").alias("at"), F.lit(None).cast("double").alias("value")).unionByName(
        other.select(song, F.col("_island").alias("island"), F.col("_end").alias("at"), F.col("_end").alias("value"))
    )
    left = _nearest_other(events, song, before=True).withColumnRenamed("near", "last_end")
    events = groups.select(song, "island", F.col("g_start").alias("at"), F.lit(None).cast("double").alias("value")).unionByName(
        other.select(song, F.col("_island").alias("island"), F.col("_start").alias("at"), F.col("_start").alias("value"))
    )
    right = _nearest_other(events, song, before=False).withColumnRenamed("near", "next_start")
    full = groups.join(left, [song, "island"], "left").join(right, [song, "island"], "left").join(durations, song)
    l_limit = F.greatest(F.lit(0.0), F.col("last_end") + buffer)
    r_limit = F.least(F.col("duration"), F.col("next_start") - buffer)
    l_pad = F.least(F.greatest(F.lit(0.0), F.col("g_start") - l_limit), F.lit(padding))
    r_pad = F.least(F.greatest(F.lit(0.0), r_limit - F.col("g_end")), F.lit(padding))
    full = full.withColumns({"l_pad": l_pad, "r_pad": r_pad, "room": F.greatest(F.lit(0.0), longest - (F.col("g_end") - F.col("g_start")))})
    tight = F.col("l_pad") + F.col("r_pad") > F.col("room")
    even = F.least("l_pad", "r_pad", F.col("room") / 2)
    extra = F.greatest(F.lit(0.0), F.col("room") - (even + even)) - 1e-3
    padded = full.select(
        song, "island", "n_lines", "text", (F.col("g_start") - F.when(tight, even + extra / 2).otherwise(F.col("l_pad"))).alias("start"),
        (F.col("g_end") + F.when(tight, even + extra / 2).otherwise(F.col("r_pad"))).alias("end"),
    )
    return padded.where(~(F.col("end") - F.col("start") > longest))


def _nearest_other(events: DataFrame, song: str, before: bool) -> DataFrame:
    """For each query event (null value): the nearest value strictly before (after) ``at`` that belongs to another island.

    The two nearest values of different islands are carried along by running extremes: the nearest of all, and the nearest
    of any island other than that one's, so one of both serves whatever island asks.
    """
    sign = F.lit(1.0 if before else -1.0)
    keyed = events.withColumn("_k", F.col("at") * sign)
    # queries come before values of the same place: the comparison is strict
    order = Window.partitionBy(song).orderBy("_k", F.col("value").isNotNull())
    sofar = order.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(F.col("value").isNotNull(), F.struct(F.col("_k").alias("k"), F.col("island").alias("i")))).over(sofar)
    keyed = keyed.withColumn("_best", best)
    # a value whose island is not that of the best before it pushes that best down to second
    second = F.max(F.when(F.col("value").isNotNull() & F.col("_best").isNotNull() & (F.col("_best.i") != F.col("island")), F.col("_best.k"))).over(sofar)
    asked = keyed.withColumn("_second", second).where("value is null")
    near = F.when(F.col("_best.i") != F.col("island"), F.col("_best.k")).otherwise(F.col("_second"))
    return asked.select(song, "island", (near * sign).alias("near"))


def gap_sessions(lines: DataFrame, gap: float = GAP, song: str = "song_id", drop_first_on_gap: bool = False) -> DataFrame:
    """Adds ``lag_gap`` (start less the previous line's end) and ``session``, from 0: a new one begins after more than ``gap``.

    ``drop_first_on_gap`` reproduces a known defect: a song whose very first gap is that long loses its first line.
    """
    order = Window.partitionBy(song).orderBy("start", "line_idx")
    lagged = lines.withColumn("lag_gap", F.col("start") - F.lag("end").over(order))
    out = lagged.withColumn("session", F.sum(F.when(F.col("lag_gap") > gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if drop_first_on_gap:
        out = out.withColumn("_next", F.lead("lag_gap").over(order)).where(~(F.col("lag_gap").isNull() & F.coalesce(F.col("_next") > gap, F.lit(False)))).drop("_next")
    return out


def partition_max_min(spans: list[tuple[float, float]], longest: float = LONGEST) -> list[int]:
    """Sizes of consecutive groups, each shorter than ``longest``, whose least duration is greatest.

    Of equal choices the one with the shorter first group wins. Raises ValueError if no partition exists.
    """
    n = len(spans)
    best = [float("-inf")] * n + [float("inf")]
    size = [0] * n
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, n + 1):
            duration = spans[j - 1][1] - spans[i][0]
            if duration >= longest:
                break
            if (worth := min(duration, best[j])) > best[i]:
                best[i], size[i] = worth, j - i
    if n and best[0] == float("-inf"):
        raise ValueError(f"a line is {longest} seconds or longer")
    out, at = [], 0
    while at < n:
        out.append(size[at])
        at += size[at]
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _partition_sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda spans: partition_max_min([(x["start"], x["end"]) for x in spans]))


def group_lines(lines: DataFrame, gap: float = GAP, song: str = "song_id", drop_first_on_gap: bool = False) -> DataFrame:
    """Sessions cut into groups under 30 s by max-min duration: (song_id, session, group_idx, n_lines, text, start, end)."""
    sessions = gap_sessions(lines, gap, song, drop_first_on_gap).groupBy(song, "session").agg(F.array_sort(F.collect_list(F.struct("start", "line_idx", "end", "text"))).alias("items"))
    sizes = sessions.withColumn("sizes", _partition_sizes(F.transform("items", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))))
    first = F.transform("sizes", lambda _, k: F.aggregate(F.slice("sizes", 1, k), F.lit(0), lambda a, b: a + b))
    cut = sizes.select(song, "session", "items", F.posexplode(F.arrays_zip(first.alias("at"), F.col("sizes").alias("n"))).alias("group_idx", "g"))
    part = F.slice("items", F.col("g.at") + 1, F.col("g.n"))
    return cut.select(
        song, "session", "group_idx", F.col("g.n").alias("n_lines"), F.array_join(F.transform(part, lambda x: x["text"]), "").alias("text"),
        F.array_min(F.transform(part, lambda x: x["start"])).alias("start"), F.array_max(F.transform(part, lambda x: x["end"])).alias("end"),
    )


def pack_segments(segments: str | Column, longest: int, field_start: str = "start", field_end: str = "end") -> Column:
    """Greedy packs of an ordered array of spans: array of (start, end, segments).

    A new pack begins when a span's end would lie more than ``longest`` after the pack's start and the pack has a length.
    Stays in the JVM: an ``aggregate`` whose state is the packs so far.
    """
    source = F.col(segments) if isinstance(segments, str) else segments
    span = F.transform(source, lambda s: F.struct(s[field_start].cast("long").alias("start"), s[field_end].cast("long").alias("end")))
    kind = "array<struct<start:bigint,end:bigint,segments:array<struct<start:bigint,end:bigint>>>>"

    def step(packs: Column, s: Column) -> Column:
        last = F.element_at(packs, -1)
        fresh = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(s).alias("segments")))
        grown = F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"), F.concat(last["segments"], F.array(s)).alias("segments")))
        full = (s["end"] - last["start"] > longest) & (last["end"] - last["start"] > 0)
        return F.when(F.size(packs) == 0, fresh).when(full, F.concat(packs, fresh)).otherwise(F.concat(F.slice(packs, 1, F.size(packs) - 1), grown)).cast(kind)

    return F.aggregate(span, F.array().cast(kind), step)
