"""Report tables: alignments split at reference line breaks, timestamps for hypothesis words, renderable rows, HTML pages."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions.alignment import DELETE, EQUAL, INSERT, SUBSTITUTE


def split_range(start: Column, end: Column, splits: Column) -> Column:
    """Array of (start, end) of a range cut after each of the indices in ``splits`` that lie in it."""
    inside = F.array_sort(F.array_distinct(F.filter(splits, lambda s: (s >= start) & (s < end))))
    edges = F.array_distinct(F.concat(F.array(start), F.transform(inside, lambda s: s + 1), F.array(end)))
    return F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda e, k: F.struct(e.alias("start"), F.element_at(edges, k + 2).alias("end")))


def split_chunks(alignments: DataFrame, keys: list[str], times: Column | None = None) -> DataFrame:
    """(keys, line_no, piece_idx, type, ref_start, ref_end, hyp_start, hyp_end, ref_texts, hyp_texts, time): chunks cut at
    reference line breaks, with the texts of their words.

    Matched chunks move both sides in step, a deletion keeps its place in the hypothesis, an insertion stays on the current
    line. ``time`` is that of the piece's first hypothesis word in ``times`` (one a word), for a deletion of the word that
    follows, of the last word beyond the end, and null without any. Each chunk takes its own words, breaks and times along, so nothing is joined; one window for each
    sample's pieces.
    """
    part = lambda array, start, end: F.slice(array, start + 1, end - start)
    text = lambda t: t["text"]
    known = F.array().cast("array<double>") if times is None else times
    rows = alignments.select(*keys, "chunks", "ref_words", "hyp_words", known.alias("times"), "breaks")

    def own(c: Column) -> Column:
        return F.struct(
            c["type"].alias("type"), c["ref_start"].alias("ref_start"), c["ref_end"].alias("ref_end"), c["hyp_start"].alias("hyp_start"), c["hyp_end"].alias("hyp_end"),
            F.transform(part("ref_words", c["ref_start"], c["ref_end"]), text).alias("ref"), F.transform(part("hyp_words", c["hyp_start"], c["hyp_end"]), text).alias("hyp"),
            part("times", c["hyp_start"], F.greatest(c["hyp_end"], c["hyp_start"] + 1)).alias("times"), F.filter("breaks", lambda b: (b >= c["ref_start"]) & (b < c["ref_end"])).alias("breaks"),
        )

    last = F.try_element_at("times", F.lit(-1))
    rows = rows.select(*keys, last.alias("last"), F.posexplode(F.transform("chunks", own)).alias("chunk_idx", "c"))
    whole = F.array(F.struct(F.col("c.ref_start").alias("start"), F.col("c.ref_end").alias("end")))
    pieces = F.when(F.col("c.type") == INSERT, whole).otherwise(split_range(F.col("c.ref_start"), F.col("c.ref_end"), F.col("c.breaks")))
    cut = rows.select(*keys, "last", "chunk_idx", "c", F.posexplode(pieces).alias("part", "p"))
    matched = F.col("c.type").isin(EQUAL, SUBSTITUTE)
    h0 = F.when(matched, F.col("c.hyp_start") + F.col("p.start") - F.col("c.ref_start")).otherwise(F.col("c.hyp_start"))
    h1 = F.when(matched, h0 + F.col("p.end") - F.col("p.start")).otherwise(F.col("c.hyp_end"))
    ends = (F.col("c.type") != INSERT) & F.array_contains("c.breaks", F.col("p.end") - 1)
    order = Window.partitionBy(*keys).orderBy("chunk_idx", "part")
    line = F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = lambda array, start, end, base: F.slice(array, start - base + 1, end - start)
    return cut.select(
        *keys, line.alias("line_no"), (F.row_number().over(order) - 1).alias("piece_idx"), F.col("c.type").alias("type"), F.col("p.start").alias("ref_start"), F.col("p.end").alias("ref_end"),
        h0.alias("hyp_start"), h1.alias("hyp_end"), here("c.ref", F.col("p.start"), F.col("p.end"), F.col("c.ref_start")).alias("ref_texts"), here("c.hyp", h0, h1, F.col("c.hyp_start")).alias("hyp_texts"),
        F.coalesce(F.get("c.times", h0 - F.col("c.hyp_start")), "last").alias("time"),
    )


def hyp_timestamps(segments: str = "segments") -> Column:
    """Times of all words of an array of (start, end, n_words) segments, each segment's words spaced evenly from its start."""
    of = lambda s: F.when(s["n_words"] > 0, F.transform(F.sequence(F.lit(0), F.greatest(s["n_words"] - 1, F.lit(0))), lambda k: s["start"] + k / s["n_words"] * (s["end"] - s["start"]))).otherwise(F.array().cast("array<double>"))
    return F.flatten(F.transform(segments, of))


def word_times(words: DataFrame, segment: list[str], start: str = "start", end: str = "end", position: str = "word_idx") -> DataFrame:
    """Adds ``time`` to one row a word: start + index / count * (end - start) within each segment."""
    n = F.count("*").over(Window.partitionBy(*segment))
    return words.withColumn("time", F.col(start) + F.col(position) / n * (F.col(end) - F.col(start)))


def render_rows(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """What a page shows of each piece of :func:`split_chunks`: texts, fillers of the same length on the empty side, and the
    time to jump to, 0.1 at least and 0 if there are no words."""
    ref, hyp, kind = F.array_join("ref_texts", " "), F.array_join("hyp_texts", " "), F.col("type")
    return pieces.select(
        *keys, "line_no", "piece_idx", kind.alias("chunk_type"), F.when(kind == INSERT, F.repeat(F.lit("+"), F.char_length(hyp))).otherwise(ref).alias("ref_text"),
        F.when(kind == DELETE, F.repeat(F.lit("-"), F.char_length(ref))).when(kind == EQUAL, ref).otherwise(hyp).alias("hyp_text"),
        F.when(F.col("time").isNotNull(), F.greatest(F.lit(0.1), "time")).otherwise(0.0).alias("timestamp"),
    )


def pixel_ranges(series: str | Column, width: int) -> Column:
    """Array of (pixel, low, high) of a series drawn ``width`` pixels wide: the least and greatest of the values that a pixel
    stands for. Pixels without a value, which are many where the series is short, are left out. Stays in the JVM."""
    values = F.col(series) if isinstance(series, str) else series
    n = F.size(values)
    edge = lambda p: F.ceil(p * n / F.lit(float(width))).cast("int")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: F.struct(p.alias("pixel"), F.slice(values, edge(p) + 1, edge(p + 1) - edge(p)).alias("v")))
    return F.transform(F.filter(pixels, lambda p: F.size(p["v"]) > 0), lambda p: F.struct(p["pixel"].alias("pixel"), F.array_min(p["v"]).alias("low"), F.array_max(p["v"]).alias("high")))


def activity_svg(series: str | Column, segments: str | Column, frames: Column, width: int = 1000, height: int = 100) -> Column:
    """An SVG picture of a series between 0 and 1, a stroke a pixel, over its segments (start, end) in frames of ``frames``."""
    x = lambda at: F.round(at / frames * width, 2).cast("string")
    y = lambda v: F.round((1 - v) * height, 2).cast("string")
    strokes = F.array_join(F.transform(pixel_ranges(series, width), lambda p: F.concat(F.lit("M"), p["pixel"].cast("string"), F.lit(","), y(p["low"]), F.lit("V"), y(p["high"]))), "")
    boxes = F.array_join(F.transform(segments, lambda s: F.concat(F.lit('<rect class="active" x="'), x(s["start"]), F.lit('" width="'), x(s["end"] - s["start"]), F.lit(f'" height="{height}"/>'))), "")
    return F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">'), boxes, F.lit('<path d="'), strokes, F.lit('"/></svg>'))


def html_pages(rows: DataFrame, key: str = "uid") -> DataFrame:
    """(key, html): one page a song from render rows. A song's rows are sorted within its group; pages are made on executors."""
    lines = rows.groupBy(key, "line_no").agg(F.array_sort(F.collect_list(F.struct("piece_idx", "chunk_type", "ref_text", "hyp_text", "timestamp"))).alias("pieces"))
    songs = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "pieces"))).alias("lines"))

    @F.pandas_udf("string")
    def page(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def cell(p: dict) -> str:
            return f'<span class="{p["chunk_type"]}" data-t="{p["timestamp"]:.2f}"><b>{html.escape(p["ref_text"])}</b><i>{html.escape(p["hyp_text"])}</i></span>'

        for names, all_lines in batches:
            yield pd.Series([
                f"<!DOCTYPE html><title>{html.escape(str(name))}</title>" + "".join("<p>" + " ".join(cell(p) for p in line["pieces"]) + "</p>" for line in song)
                for name, song in zip(names, all_lines, strict=True)
            ])

    return songs.select(key, page(F.col(key).cast("string"), F.col("lines")).alias("html"))
