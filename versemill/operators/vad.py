"""Frame energy of samples, and activity segments from frame scores: runs of activity and silence in one recording's series,
cut and padded by Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VadOptions:
    onset: float = 0.1
    offset: float = 0.1
    min_speech_ms: float = 0
    max_speech_s: float = 30
    min_silence_ms: float = 1000
    pad_ms: float = 200
    window: int = 512
    rate: int = 16000


def normalised(scores: str | Column) -> Column:
    """Scores over their maximum; a series of zeros becomes NaN."""
    c = F.col(scores) if isinstance(scores, str) else scores
    top = F.array_max(c)
    return F.transform(c, lambda x: F.when(top == 0, F.lit(float("nan"))).otherwise(x / top))


def energies(samples: np.ndarray, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """Root mean squares of the ``frame`` samples around every ``hop``-th one, zeros beyond both ends.

    Squares are added up once by blocks that frames and hops are whole numbers of; a frame is a few neighbouring blocks.
    """
    block, n = math.gcd(frame, hop), 1 + len(samples) // hop
    padded = np.zeros(-(-((n - 1) * hop + frame) // block) * block)
    padded[frame // 2 : frame // 2 + len(samples)] = samples[: len(padded) - frame // 2]
    sums = np.square(padded).reshape(-1, block).sum(axis=1)
    return np.sqrt(np.lib.stride_tricks.sliding_window_view(sums, frame // block)[:: hop // block].sum(axis=1)[:n] / frame)


def frame_energy(samples: str | Column, frame: int = 2048, hop: int = 512) -> Column:
    """Array of the energy of each frame from an array of samples; null gives null, no samples give one silent frame."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for series in batches:
            flat, ends = series.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(series.value_lengths().fill_null(0)))
            none = series.is_null().to_numpy(zero_copy_only=False)
            made = [flat[:0] if null else energies(flat[a:b], frame, hop) for a, b, null in zip(ends[:-1], ends[1:], none, strict=True)]
            offsets = pa.array(np.append(0, np.cumsum([len(m) for m in made])), pa.int32(), mask=np.append(none, False))
            yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(made) if made else np.zeros(0)))

    return run((F.col(samples) if isinstance(samples, str) else samples).cast("array<double>"))


class _Series:
    """Runs of a score series: where activity is, and the silences between."""

    def __init__(self, p: np.ndarray, o: VadOptions):
        self.p, self.n, self.window = p, len(p), o.window
        self.active, self.low = np.flatnonzero(p >= o.onset), np.flatnonzero(p < o.offset)

    def _at(self, places: np.ndarray, frame: int) -> int | None:
        """The first of ``places`` from ``frame`` on."""
        k = int(np.searchsorted(places, frame))
        return int(places[k]) if k < len(places) else None

    def opens(self, frame: int) -> int | None:
        return self._at(self.active, frame)

    def silences(self, frame: int) -> Iterator[tuple[int, int]]:
        """(first low frame, frame at which activity resumes, or the series' length) from ``frame`` on."""
        while (first := self._at(self.low, frame)) is not None:
            resumes = self.opens(first + 1)
            frame = self.n if resumes is None else resumes
            yield first, frame

    def lasts(self, first: int, until: int, samples: float, beyond: bool) -> int | None:
        """The first low frame of a silence at which it has lasted ``samples``, or more than that."""
        at = first + (math.floor(samples / self.window) + 1 if beyond else math.ceil(samples / self.window))
        found = self._at(self.low, at)
        return found if found is not None and found < until else None


def closed_spans(scores: Sequence[float], o: VadOptions, start: int | None, watched: int, total: int | None) -> tuple[list[tuple[int, int]], int | None, int]:
    """[start, end) samples that a series of scores decides, not padded, and the state behind them: the frame at which a
    segment is open, if one is, and the frame from which silences, or else an opening, are looked for.

    ``total`` is the recording's length in samples; while it is not known, which is null, more frames may come and only what they cannot
    change is decided. A state goes on with the same series grown longer.
    """
    x = _Series(np.asarray(scores, float), o)
    pad = o.rate * o.pad_ms / 1000
    longest, shortest, silence, pause = o.rate * o.max_speech_s - o.window - 2 * pad, o.rate * o.min_speech_ms / 1000, o.rate * o.min_silence_ms / 1000, o.rate * 98 / 1000
    found: list[tuple[int, int]] = []

    def opened(frame: int) -> tuple[int | None, int]:
        at = x.opens(frame)
        return at, max(frame, x.n) if at is None else at + 1  # none of the frames at hand opens one

    if start is None:
        start, watched = opened(watched)
    while start is not None:
        full = max(watched, start + math.floor(longest / o.window) + 1)  # the frame at which the segment is too long
        paused = resumed = closed = None
        for first, until in x.silences(watched):
            if first >= full:
                break
            end = x.lasts(first, until, silence, beyond=False)
            noted = x.lasts(first, until, pause, beyond=True)
            if noted is not None and noted < full:
                paused, resumed = first, until
            if end is not None and end < full:
                closed = first
                break
        if closed is not None:
            if (closed - start) * o.window > shortest:
                found.append((start * o.window, closed * o.window))
            start, watched = opened(end + 1)
        elif full >= x.n:
            if total is not None:
                if total - start * o.window > shortest:
                    found.append((start * o.window, total))
                start = None
            break
        elif paused is not None:
            found.append((start * o.window, paused * o.window))
            start, watched = (resumed, full) if resumed <= full else opened(full + 1)
        else:
            half = start + (full + 1 - start) // 2
            later = x.p[half : full + 1]
            cut = half + int(np.flatnonzero(later == later.min())[-1])
            found.append((start * o.window, cut * o.window))
            start, watched = cut, full + 1
    return found, start, watched


def segments_of(scores: Sequence[float], o: VadOptions = VadOptions(), length: int | None = None) -> list[tuple[int, int]]:
    """[start, end) samples of the active segments of a series of frame scores; ``length`` is the recording's, in samples.

    A segment opens at an active frame and ends where a silence of ``min_silence_ms`` begins. One that grows beyond the
    longest ends at its last pause of more than 98 ms and goes on where activity has resumed, if it has; without a pause it
    is cut at the least score of its later half, the current frame included, the last of equals.
    """
    total = len(scores) * o.window if length is None else length
    found, _, _ = closed_spans(scores, o, None, 0, total)
    return padded_spans(np.asarray(found, float).reshape(-1, 2), o.rate * o.pad_ms / 1000, total)


def padded_spans(spans: np.ndarray, pad: float, total: int) -> list[tuple[int, int]]:
    """Spans in order, widened into what is around them: a gap gives either side ``pad``, or half of itself, a whole number, where it is
    under two paddings; the first start and the last end get all of it, inside the recording."""
    gap = spans[1:, 0] - spans[:-1, 1]
    share = np.where(gap < 2 * pad, gap // 2, pad)
    starts = np.maximum(0, spans[:, 0] - np.append(pad, share)[: len(spans)])
    ends = np.minimum(total, spans[:, 1] + np.append(share, pad)[: len(spans)])
    return list(zip(starts.astype(np.int64).tolist(), ends.astype(np.int64).tolist(), strict=True))


def vad_segments(scores: str | Column, options: VadOptions = VadOptions(), length: str | Column | None = None) -> Column:
    """Array of (start, end) in samples from an array of normalised scores; null gives null. ``length`` is the recording's
    length in samples, frames times window if it is null or not given."""

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for series, lengths in batches:
            yield pd.Series([
                None if p is None else [{"start": int(a), "end": int(b)} for a, b in segments_of(p, options, None if pd.isna(n) else int(n))] for p, n in zip(series, lengths, strict=True)
            ])

    return run(scores, F.lit(None).cast("long") if length is None else length)


def activity_mask(scores: DataFrame, segments: str = "segments", series: str = "scores", window: int = 512) -> DataFrame:
    """(…, frame, score, active): one row a frame, active 1 inside a segment; nothing is joined."""
    rows = scores.select("*", F.posexplode(series).alias("frame", "score"))
    at = F.col("frame") * window
    return rows.withColumn("active", F.exists(segments, lambda s: (s["start"] <= at) & (at < s["end"])).cast("int"))
