"""Transcription tasks by level, and results put together from what a recogniser returned for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.operators import catalog, evaluation, intervals

CLIPS = "array<struct<start:bigint,end:bigint>>"
LEVELS = ("song", "merged_line", "grouped_line")


def line_clips(lines: DataFrame, key: str = "uid") -> DataFrame:
    """(key, clips): the spans of a song's timed lines in samples, in order of their start."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    return lines.groupBy(key).agg(F.transform(spans, lambda s: F.struct(catalog.to_samples(s["start"]).alias("start"), catalog.to_samples(s["end"]).alias("end"))).alias("clips"))


def activity_clips(segments: str | Column, longest_s: int = 30) -> Column:
    """Active segments packed into clips of at most ``longest_s`` seconds."""
    packs = intervals.pack_segments(segments, longest_s * catalog.SAMPLE_RATE)
    return F.transform(packs, lambda p: F.struct(p["start"].cast("long").alias("start"), p["end"].cast("long").alias("end")))


def transcription_tasks(
    songs: DataFrame, level: str, clips: DataFrame | None = None, audio: str = "original", separated_root: str = "sep", with_language: bool = True, batched: bool = True
) -> DataFrame:
    """(uid, audio_path, language, clips, clip_timestamps): one task a song.

    At line levels ``clips`` has (uid, clips) of :func:`line_clips`, and a song without any has an empty list. At song level
    it may have the clips of :func:`activity_clips`; songs without are transcribed natively, which is null for batched
    recognition and "0" otherwise. ``clip_timestamps`` is the flat list of seconds that sequential recognition of whole
    songs expects. Everything but that case is batched.
    """
    if level not in LEVELS:
        raise ValueError(f"unsupported level {level}")
    if level != "song" and clips is None:
        raise ValueError(f"level {level} needs the clips of its lines")
    rows = songs if clips is None else songs.join(clips, "uid", "left")
    known = F.lit(None).cast(CLIPS) if clips is None else F.col("clips")
    if level != "song":
        known = F.coalesce(known, F.array().cast(CLIPS))
    sequential = level == "song" and not batched
    flat = F.when(known.isNotNull(), F.transform(catalog.clip_timestamps(known), lambda x: x.cast("string"))).otherwise(F.array(F.lit("0"))) if sequential else F.lit(None).cast("array<string>")
    language = F.col("language") if with_language else F.lit(None).cast("string")
    return rows.select("uid", catalog.audio_path(audio, separated_root=separated_root).alias("audio_path"), language.alias("language"), known.alias("clips"), flat.alias("clip_timestamps"))


def results(songs: DataFrame, tasks: DataFrame, outputs: DataFrame, level: str, lines: DataFrame | None = None) -> DataFrame:
    """(uid, audio_path, dataset_id, language, sample_idx, ref, hyp, start, end): what each song's task gave, beside its reference.

    ``outputs`` has (uid, pos, text), the segments in order; an output without a task is an error, a task without output gives
    no row. At song level the segments are joined to one text; at line levels they are paired with ``lines``
    (uid, pos, text, start, end) by position, and what is left over on either side is dropped.
    """
    known = outputs.join(tasks.select("uid", "audio_path"), "uid", "left")
    known = known.withColumn("audio_path", F.when(F.col("audio_path").isNull(), F.raise_error(F.concat(F.lit("no task for "), F.col("uid").cast("string"))).cast("string")).otherwise(F.col("audio_path")))
    if level == "song":
        pairs = evaluation.song_pairs(songs, known)
    else:
        pairs = evaluation.line_pairs(lines, known)
    paths = known.groupBy("uid").agg(F.first("audio_path").alias("audio_path"))
    return pairs.join(paths, "uid").join(songs.select("uid", "dataset_id", "language"), "uid").select("uid", "audio_path", "dataset_id", "language", "sample_idx", "ref", "hyp", "start", "end")


def with_evaluation(rows: DataFrame) -> DataFrame:
    """Result rows with the counts of their own evaluation: the same row carries both, so nothing is joined."""
    made = evaluation.aligned(rows.withColumn("dataset", F.col("dataset_id")))
    return evaluation.samples(made, ("uid", "audio_path", "dataset_id", "language", "sample_idx"))


def group_names(lines: DataFrame, song: str = "song_id", position: str = "line_idx") -> DataFrame:
    """(song, island, name): "003-007" for lines 3 to 7 of a song merged into one group, "003" for a line alone."""
    order = Window.partitionBy(song).orderBy(position)
    numbered = intervals.overlap_islands(lines.withColumn("number", F.row_number().over(order) - 1), song=song)
    first, last = F.min("number"), F.max("number")
    return numbered.groupBy(song, "island").agg(F.when(F.count("*") > 1, F.format_string("%03d-%03d", first, last)).otherwise(F.format_string("%03d", first)).alias("name"))
