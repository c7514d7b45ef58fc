"""Stabilising the page boundary seen by a camera.

What a frame means depends only on how it compares with what is shown: it misses, is faint, is the first, has shrunk, is near, away
or far.  A table says for each of these what becomes of the candidate, how many votes let it through, and whether what is shown
ages.  A frame is one step through the table; the same step serves a replay of stored frames and a stream, whose state Spark keeps per camera.

A shutter is a row without a picture (``detected`` null): it changes nothing and reads what is shown then, if it was seen at
most RETENTION_MS ago.

In a stream, time is the frames' own.  Frames older than the last one of their camera are left out, as are those behind the
watermark.  Two timers a camera: RETENTION_MS after a boundary was last seen a shutter finds nothing, so it goes
if ``strict``; after SILENCE_MS without frames all that is known of the camera goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed values
SIMILAR, SUDDEN = 0.055, 0.16
SMOOTHING, SHRINK = 0.28, 0.28
RETENTION_MS = 750
SAMPLES = 24
#: How far frames may lag behind the latest, and how long a camera may be silent before its state goes.
LATENESS, SILENCE_MS = "10 minutes", 3_600_000

FRAME = ("t_ms", "event_id", "detected", "confidence", *[f"{a}{k}" for k in range(4) for a in ("x", "y")])
OUTPUT = "stream_id long, t_ms long, event_id long, stable boolean, left double, top double, right double, bottom double, matches int"


class Rule(NamedTuple):
    """candidate: keep it, drop it once old, show the frame, or let the frame vote for it.  With ``needed`` votes what is shown moves by ``share``
    towards the candidate, or towards the frame if no vote is needed; otherwise it ages, if it does."""

    candidate: str
    needed: int | None
    share: float
    ages: bool


class Rules(NamedTuple):
    """faint: the confidence below which a frame is faint; points: what turns corners into the points that are compared; outline: whether crossed outlines count as missed and shrinking as such."""

    faint: float
    points: np.ndarray
    outline: bool
    table: dict[str, Rule]


def along_edges(samples: int) -> np.ndarray:
    """Weights that turn four corners into the points of a closed outline, ``samples`` an edge, its ends shared."""
    share = np.linspace(0, 1, samples)
    blocks = []
    for edge in range(4):
        block = np.zeros((samples, 4))
        block[:, edge] = 1 - share
        block[:, (edge + 1) % 4] += share
        blocks.append(block if edge == 0 else block[1:])
    return np.vstack(blocks)


OUTLINE_RULES = Rules(0.22, along_edges(SAMPLES), True, {
    "missed": Rule("drop old", None, 0.0, True),
    "faint": Rule("show", None, 0.0, True),
    "first": Rule("vote", 3, 1.0, False),
    "shrunk": Rule("vote", 5, 1.0, True),
    "near": Rule("keep", 0, SMOOTHING, False),
    "away": Rule("vote", 3, SMOOTHING, False),
    "far": Rule("vote", None, 0.0, True),
})
#: The older rules: by corners alone; a faint frame is a missed one, shrinking is a move like any other.
CORNER_RULES = Rules(0.45, np.eye(4), False, OUTLINE_RULES.table | {"missed": Rule("keep", None, 0.0, True), "faint": Rule("keep", None, 0.0, True)})


class View(NamedTuple):
    """What is shown and when it was last seen; the candidate, its votes and when it was last looked at."""

    shown: np.ndarray | None = None
    seen: int | None = None
    tried: np.ndarray | None = None
    votes: int = 0
    since: int | None = None


def apart(rules: Rules, a: np.ndarray, b: np.ndarray) -> float:
    return float(np.linalg.norm(rules.points @ (a - b), axis=1).mean())


def extents(quad: np.ndarray) -> np.ndarray:
    """Area and height."""
    x, y = quad.T
    return np.array([abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2, np.ptp(y)])


def sound(quad: np.ndarray) -> bool:
    """Finite, of some area, and no opposite edges that cross."""
    if not np.isfinite(quad).all() or extents(quad)[0] <= 1e-6:
        return False
    edges = np.roll(quad, -1, axis=0) - quad

    def sides(k: int) -> np.ndarray:
        """On which side of edge k the ends of the opposite edge lie."""
        ends = quad[[(k + 2) % 4, (k + 3) % 4]] - quad[k]
        return np.sign(edges[k, 0] * ends[:, 1] - edges[k, 1] * ends[:, 0])

    return not any(sides(k).prod() < 0 and sides(k + 2).prod() < 0 for k in (0, 1))


def case(rules: Rules, view: View, detected: bool, confidence: float, quad: np.ndarray) -> str:
    if not detected or rules.outline and not sound(quad):
        return "missed"
    if confidence < rules.faint:
        return "faint"
    if view.shown is None:
        return "first"
    if rules.outline:
        before = extents(view.shown)
        left = np.divide(extents(quad), before, out=np.ones(2), where=before > 0)
        if left.min() < 1 - SHRINK:
            return "shrunk"
    distance = apart(rules, view.shown, quad)
    return "near" if distance <= SIMILAR else "far" if distance > SUDDEN else "away"


def candidate_after(rules: Rules, how: str, view: View, quad: np.ndarray, now: int) -> View:
    if how == "show":
        return view._replace(tried=quad, votes=0, since=now)
    if how == "vote":
        agrees = view.tried is not None and apart(rules, view.tried, quad) <= SIMILAR
        blend = view.tried + (quad - view.tried) * SMOOTHING if agrees else quad
        return view._replace(tried=blend, votes=view.votes + 1 if agrees else 1, since=now)
    if how == "drop old" and view.tried is not None and now - view.since > RETENTION_MS:
        return view._replace(tried=None, votes=0, since=None)
    return view


def aged(view: View, now: int) -> View:
    return view._replace(shown=None, seen=None) if view.seen is not None and now - view.seen > RETENTION_MS else view


def observed(rules: Rules, view: View, detected: bool, confidence: float, quad: np.ndarray, now: int) -> View:
    """The view after a frame."""
    rule = rules.table[case(rules, view, detected, confidence, quad)]
    if rule.candidate == "drop old":
        # a candidate stays as long as something is shown
        view = aged(view, now)
        return candidate_after(rules, rule.candidate, view, quad, now) if view.shown is None else view
    view = candidate_after(rules, rule.candidate, view, quad, now)
    if rule.needed is None or view.votes < rule.needed and rule.needed:
        return aged(view, now) if rule.ages else view
    target = view.tried if rule.needed else quad
    start = target if view.shown is None else view.shown
    view = view._replace(shown=start + (target - start) * rule.share, seen=now)
    return view._replace(tried=None, votes=0, since=None) if rule.needed else view


class Stabilizer:
    """A view that frames change, for a single camera."""

    rules = OUTLINE_RULES

    def __init__(self) -> None:
        self.view = View()

    @property
    def stable(self) -> np.ndarray | None:
        return self.view.shown

    @property
    def candidate(self) -> np.ndarray | None:
        return self.view.tried

    def update(self, detected: bool, confidence: float, corners: np.ndarray, now: int) -> None:
        self.view = observed(self.rules, self.view, detected, confidence, corners, now)


class CornerStabilizer(Stabilizer):
    rules = CORNER_RULES


def replay(rules: Rules, view: View, frames: pd.DataFrame, strict: bool = False) -> tuple[View, pd.DataFrame]:
    """The view after all frames, and one row a frame or shutter; frames are of one camera and in order of time."""
    columns = [frames[c].tolist() for c in ("stream_id", "t_ms", "event_id", "detected", "confidence")]
    quads = frames[list(FRAME[4:])].to_numpy(float).reshape(-1, 4, 2)
    out = []
    for stream, now, event, detected, confidence, quad in zip(*columns, quads, strict=True):
        if strict:
            view = aged(view, now)
        if detected is None:
            shown = aged(view, now).shown
            seen = shown
        else:
            view = observed(rules, view, bool(detected), float(confidence), quad, int(now))
            shown, seen = view.shown, view.shown if view.shown is not None else view.tried
        box = [None] * 4 if seen is None else [round(float(v), 6) for v in (*seen.min(axis=0), *seen.max(axis=0))]
        out.append((stream, now, event, shown is not None, *box, view.votes))
    return view, pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def stabilize_batch(frames: DataFrame, rules: Rules = OUTLINE_RULES, strict: bool = False) -> DataFrame:
    """A replay of stored frames: one pass along each task's cameras in order of time, which holds one view and one batch of frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, view = None, View()
        for batch in batches:
            batch["detected"] = batch["detected"].astype(object).where(batch["detected"].notna(), None)
            for stream, part in batch.groupby("stream_id", sort=False):
                if stream != at:
                    at, view = stream, View()
                view, rows = replay(rules, view, part, strict)
                yield rows

    return frames.select("stream_id", *FRAME).repartition("stream_id").sortWithinPartitions("stream_id", "t_ms", "event_id").mapInPandas(run, OUTPUT)


def timed(frames: DataFrame) -> DataFrame:
    """Frames with their time as a timestamp, and the watermark on it (which is 0 at first, and what is not after it is late)."""
    return frames.withColumn("time", F.timestamp_millis(F.col("t_ms") + 1)).withWatermark("time", LATENESS)


def in_time(parts: Iterator[pd.DataFrame], last: int | None) -> pd.DataFrame:
    """Frames of a micro-batch in order, without those that come too late."""
    frames = pd.concat(list(parts)).sort_values(["t_ms", "event_id"])
    return frames if last is None else frames[frames["t_ms"] >= last]


class Camera(StatefulProcessor):
    """A camera's view in typed states, with a timer for what is shown and one for the whole."""

    def __init__(self, rules: Rules, strict: bool) -> None:
        self.rules, self.strict = rules, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "corners array<double>, seen long")
        self.tried = handle.getValueState("tried", "corners array<double>, votes int, since long")
        self.last = handle.getValueState("last", "t_ms long")

    def load(self) -> View:
        quad = lambda values: np.array(values, float).reshape(4, 2)
        view = View()
        if self.shown.exists():
            corners, seen = self.shown.get()
            view = view._replace(shown=quad(corners), seen=seen)
        if self.tried.exists():
            corners, votes, since = self.tried.get()
            view = view._replace(tried=quad(corners), votes=votes, since=since)
        return view

    def save(self, view: View) -> None:
        if view.shown is None:
            self.shown.clear()
        else:
            self.shown.update((view.shown.ravel().tolist(), int(view.seen)))
        if view.tried is None:
            self.tried.clear()
        else:
            self.tried.update((view.tried.ravel().tolist(), int(view.votes), int(view.since)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        last = self.last.get()[0] if self.last.exists() else None
        frames = in_time(rows, last)
        if len(frames):
            frames["detected"] = frames["detected"].astype(object).where(frames["detected"].notna(), None)
            view, out = replay(self.rules, self.load(), frames, self.strict)
            self.save(view)
            last = int(frames["t_ms"].iloc[-1])
            self.last.update((last,))
            yield out
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = max(last or 0, timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(now + SILENCE_MS)
        if self.strict and self.shown.exists():
            self.handle.registerTimer(max(self.shown.get()[1] + RETENTION_MS + 1, now + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.last.exists() and due >= self.last.get()[0] + SILENCE_MS:
            for state in (self.shown, self.tried, self.last):
                state.clear()
        elif self.shown.exists() and due > self.shown.get()[1] + RETENTION_MS:
            self.shown.clear()
        return iter(())

    def close(self) -> None:
        pass


def stabilize_stream(frames: DataFrame, rules: Rules = OUTLINE_RULES, strict: bool = False) -> DataFrame:
    """The same on a stream: Spark keeps the states of each camera between micro-batches, and over restarts.  The session has to keep states in RocksDB."""
    return timed(frames).groupBy("stream_id").transformWithStateInPandas(Camera(rules, strict), OUTPUT, "Append", "EventTime")
