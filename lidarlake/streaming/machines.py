"""Order-dependent machines as pure steps ``(state, event) -> (state, output)``.

A step runs in a batch fold (operators.fold.ordered_fold), in a stream (run_stream) and in tests alike.
States are tuples of plain values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEALTHY, DEGRADED, RECOVERING, VALIDATING, UNRECOVERABLE = range(5)


@dataclass(frozen=True)
class Supervisor:
    """Recovery of an estimator: several bad frames start it, several good ones in a row end it."""

    state: int = HEALTHY
    degraded: int = 0
    streak: int = 0
    attempts: int = 0
    rollbacks: int = 0
    successes: int = 0
    failures: int = 0

    def on(self, event: str, trigger: int = 3, validation: int = 3, max_attempts: int = 6, max_degraded: int = 300) -> Supervisor:
        if self.state == UNRECOVERABLE:
            return self
        if event in ("invalid", "numerical"):
            n = self.degraded + 1
            if n >= max(max_degraded, 1):
                return replace(self, state=UNRECOVERABLE, degraded=n, streak=0, failures=self.failures + 1)
            hard = event == "numerical" or (self.state == DEGRADED and n >= max(trigger, 1)) or self.state in (RECOVERING, VALIDATING)
            return replace(self, state=RECOVERING if hard else DEGRADED, degraded=n, streak=0)
        if event == "reinit":
            if self.attempts >= max(max_attempts, 1):
                return self
            return replace(self, state=RECOVERING, attempts=self.attempts + 1, rollbacks=self.rollbacks + 1, streak=0)
        if event == "constraint":  # usable, but no proof: recovery goes on, its clock starts anew
            return replace(self, state=RECOVERING, degraded=0, streak=0)
        if event != "valid":
            raise ValueError(f"no such event: {event}")
        if self.state in (HEALTHY, DEGRADED):
            return replace(self, state=HEALTHY, degraded=0, attempts=0 if self.state == DEGRADED else self.attempts)
        s = replace(self, state=VALIDATING, streak=1, degraded=0) if self.state == RECOVERING else replace(self, streak=self.streak + 1)
        if s.streak >= max(validation, 1):
            s = replace(s, state=HEALTHY, streak=0, degraded=0, attempts=0, successes=s.successes + 1)
        return s


def supervise(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
    """row: (id, event)."""
    s = (Supervisor(*state) if state else Supervisor()).on(row[1])
    return astuple(s), (row[0], *astuple(s))


def adapt_sampler(state: tuple | None, row: tuple, most: int = 6, bad_frames: int = 2, good_frames: int = 5) -> tuple[tuple, tuple]:
    """row: (id, motion risk, valid ratio, quality, degeneracy). The stride grows slowly when all is well and shrinks at once when not."""
    stride, bad, good = state or (3, 0, 0)
    frame, motion, valid, quality, degeneracy = row
    if motion > 0.55 or valid < 0.30 or quality < 0.35 or degeneracy < 0.50:
        bad, good = bad + 1, 0
        if bad >= max(1, bad_frames):
            stride, bad = max(1, stride - (2 if degeneracy < 0.50 else 1)), 0
    elif motion < 0.25 and valid > 0.65 and quality > 0.65 and degeneracy > 0.80:
        good, bad = good + 1, 0
        if good >= max(1, good_frames):
            stride, good = min(most, stride + 1), 0
    else:
        bad = good = 0
    stride = max(1, min(most, stride))
    return (stride, bad, good), (frame, stride)


def admit(state: tuple | None, row: tuple, late: float = 0.1, gap: float = 0.5, tolerance: float = 1e-6) -> tuple[tuple, tuple]:
    """row: (id, stamp). Small inversions are late and dropped, large ones start a new session, long gaps are rejected."""
    last, session = state or (None, 0)
    name, stamp = row
    if last is None:
        return (stamp, session), (name, session, "ready")
    if stamp < last - tolerance:
        if last - stamp < late:
            return (last, session), (name, session, "late")
        return (stamp, session + 1), (name, session + 1, "reset")
    if stamp - last > gap:
        return (stamp, session), (name, session, "gap")
    return (stamp, session), (name, session, "ready")


def commit_goal(state: tuple | None, row: tuple, least_hold: float = 2.5, most_hold: float = 6.0, margin: float = 0.20, bearing: float = 18.0) -> tuple[tuple, tuple]:
    """row: (id, now, goal, score, direction in degrees).

    A goal is held for at least ``least_hold``. Then another takes its place if it is better by more than ``margin`` and
    lies at least ``bearing`` degrees elsewhere, or if it is that much better and the hold is longer than ``most_hold``."""
    name, now, goal, score, direction = row
    if state is not None:
        held, held_score, held_direction, since = state
        age, better = now - since, score > held_score + margin
        elsewhere = abs((direction - held_direction + 180.0) % 360.0 - 180.0) >= bearing
        if age < least_hold or not (better and (age > most_hold or elsewhere)):
            return state, (name, held, held_score)
    return (goal, score, direction, now), (name, goal, score)


def decay_visits(state: tuple | None, row: tuple, sectors: int = 8, every: float = 10.0, revisit: float = 5.0) -> tuple[tuple, tuple]:
    """row: (id, now, sector). Visits of sectors; each loses one every ``every`` seconds; staying on is no new visit."""
    visits, decayed, last, when = state or ((0,) * sectors, row[1], -1, -1e18)
    name, now, sector = row
    v = list(visits)
    while now - decayed >= every:
        v, decayed = [max(0, x - 1) for x in v], decayed + every
    if sector != last or now - when >= revisit:
        v[sector] += 1
        last, when = sector, now
    return (tuple(v), decayed, last, when), (name, v[sector])


@dataclass
class Quarantine:
    """Voxels that wait: promoted after support in several frames by centroids that stay near, within a budget."""

    voxel: float = 0.5
    support: int = 3
    ttl: int = 30
    most: int = 4096
    budget: float = 0.05

    def frame(self, waiting: dict, frame: int, seen: dict, total: int) -> tuple[dict, list]:
        """waiting: voxel -> (support, centroid, count, last frame). seen: voxel -> (centroid, count). Returns (waiting, promoted)."""
        out = {k: w for k, w in waiting.items() if frame - w[3] <= self.ttl}
        for k, (centroid, n) in seen.items():
            w = out.get(k)
            if w and w[3] == frame:
                continue
            drift = max(abs(a - b) for a, b in zip(centroid, w[1])) if w else 0.0
            near = w is not None and drift <= max(0.10, 0.75 * self.voxel)
            out[k] = (w[0] + 1, centroid, w[2] + n, frame) if near else (1, centroid, n, frame)
        if len(out) > self.most:  # the longest unseen go; of equals the lower voxel
            out = dict(sorted(out.items(), key=lambda x: (-x[1][3], x[0]))[: self.most])
        left, promoted = max(5, -(-int(total * self.budget * 1000) // 1000)), []
        for k in sorted((k for k, w in out.items() if w[0] >= self.support), key=lambda k: (-out[k][2], k)):
            if left <= 0:
                break
            n = min(left, out[k][2])
            promoted.append((k, n))
            left -= n
        return {k: w for k, w in out.items() if k not in dict(promoted)}, promoted


def run_stream(df: DataFrame, key: str, columns: list[str], order: list[str], step: Callable, output: str, state: str, pack: Callable = tuple, unpack: Callable = tuple) -> DataFrame:
    """A machine over a stream: each micro-batch's rows of a key in order; the state is kept between batches.

    The state is written once after a batch, so a batch that fails leaves it as it was.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = unpack(held.get) if held.exists else None
        rows = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        out = []
        for row in rows[columns].itertuples(index=False, name=None):
            now, made = step(now, row)
            if made is not None:
                out.append((k[0], *made))
        held.update(pack(now))
        yield pd.DataFrame(out, columns=[key, *[c.split()[0] for c in output.split(", ")]])

    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {output}", state, "append", GroupStateTimeout.NoTimeout)
