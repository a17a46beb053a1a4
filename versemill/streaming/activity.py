"""Activity segments of live recordings: frames come as a stream, segments leave as soon as no later frame can change them.

The state of a recording is the scores from its open segment on, which the longest segment bounds, and the last closed
segment, whose padding depends on where the next one begins. A recording ends when no frame has come for a while of event
time: a timer then closes what is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from versemill.operators.vad import VadOptions, closed_spans

STATE = "base long, scores array<double>, waiting_frames array<long>, waiting_scores array<double>, open long, watched long, held_start long, held_end long, before double, timer long"
SEGMENTS = "{key} {kind}, start long, end long"


class _Recording:
    """What is kept of a recording between batches; frames before ``base`` are decided and gone."""

    def __init__(self, o: VadOptions, state: tuple | None):
        self.o, self.pad = o, o.rate * o.pad_ms / 1000
        base, scores, frames, values, self.open, self.watched, start, end, self.before, self.timer = state or (0, [], [], [], None, 0, None, None, None, None)
        self.base, self.scores, self.waiting = base, list(scores), dict(zip(frames, values, strict=True))
        self.held = None if start is None else (start, end)

    def state(self) -> tuple:
        start, end = self.held or (None, None)
        return self.base, self.scores, list(self.waiting), list(self.waiting.values()), self.open, self.watched, start, end, self.before, self.timer

    def add(self, frames: Iterator[tuple[int, float]]) -> None:
        """Frames in any order: those that come again are left out, those that come too soon wait for the ones before."""
        self.waiting |= {f: s for f, s in frames if f >= self.base + len(self.scores)}
        while (at := self.base + len(self.scores)) in self.waiting:
            self.scores.append(self.waiting.pop(at))

    def decided(self, last: bool) -> list[tuple[int, int]]:
        """Padded segments that are certain now; all of them with the last frame."""
        shift, total = self.base * self.o.window, (self.base + len(self.scores)) * self.o.window
        local = None if self.open is None else self.open - self.base
        spans, start, watched = closed_spans(self.scores, self.o, local, self.watched - self.base, len(self.scores) * self.o.window if last else None)
        out = []
        for a, b in spans:
            a, b = a + shift, b + shift
            if self.held:
                gap = a - self.held[1]
                share = gap // 2 if gap < 2 * self.pad else self.pad
                out.append(self._padded(share, total))
                self.before = float(share)
            else:
                self.before = float(self.pad)
            self.held = (a, b)
        self.open, self.watched = None if start is None else start + self.base, watched + self.base
        if last and self.held:
            out.append(self._padded(self.pad, total))
            self.held = None
        gone = min((self.watched if self.open is None else self.open) - self.base, len(self.scores))
        self.base, self.scores = self.base + gone, self.scores[gone:]
        return out

    def _padded(self, after: float, total: int) -> tuple[int, int]:
        return int(np.floor(max(0, self.held[0] - self.before))), int(np.floor(min(total, self.held[1] + after)))


class _Activity(StatefulProcessor):
    def __init__(self, options: VadOptions, key: str, idle_ms: int):
        self.options, self.key, self.idle_ms = options, key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recording", STATE)

    def _told(self, key: tuple, spans: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        if spans:
            yield pd.DataFrame({self.key: [key[0]] * len(spans), "start": [s for s, _ in spans], "end": [e for _, e in spans]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recording, latest = _Recording(self.options, self.state.get() if self.state.exists() else None), 0
        for f in rows:
            recording.add(zip(f["frame"].tolist(), f["score"].tolist(), strict=True))
            latest = max(latest, int(f["ts"].max().timestamp() * 1000))
        spans = recording.decided(last=False)
        if recording.timer is None or latest + self.idle_ms > recording.timer:
            if recording.timer is not None:
                self.handle.deleteTimer(recording.timer)
            recording.timer = latest + self.idle_ms
            self.handle.registerTimer(recording.timer)
        self.state.update(recording.state())
        yield from self._told(key, spans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            spans = _Recording(self.options, self.state.get()).decided(last=True)
            self.state.clear()
            yield from self._told(key, spans)

    def close(self) -> None:
        pass


def live_activity(frames: DataFrame, options: VadOptions = VadOptions(), key: str = "uid", idle: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """(key, start, end) in samples of the active segments of a stream of frames (key, frame, score, ts).

    Frames are numbered from 0; ``score`` is on the scale of the options' thresholds. A recording is over when the watermark, ``late`` behind the latest ``ts``,
    has passed its last frame by ``idle``; frames that never came then end it where they are missing. State lives in the
    RocksDB store, which the session's configuration names.
    """
    wait = pd.Timedelta(idle) // pd.Timedelta("1 ms")
    kind = frames.schema[key].dataType.simpleString()
    rows = frames.select(key, "frame", "score", "ts").withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(_Activity(options, key, int(wait)), SEGMENTS.format(key=key, kind=kind), "Append", "EventTime")
