"""Operators on frame sequences: tolerance controllers, page pool, budgets, sweep, settling; in batch and as a stream.

Frames of a run are a sequence with state, so the folds take whole runs in order (applyInPandas, grouped by run); a
run is a recording of one session and fits a task.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismgraph.schema import TOLERANCE_STEPS

COARSEST = TOLERANCE_STEPS - 1
# Shares of the frame budget and times in seconds of the two controllers, what a step is taken to save, updates
# until costs count as settled, and the weight of a new measurement.
FIT, REFINE, CALM = 0.9, 0.75, 0.7
CALM_S, REFINE_S, FAIL_S, BACKOFF_S, RESET_S = 0.5, 0.1, 1.0, 16.0, 5.0
TARGET, PROPORTIONAL, INTEGRAL = 0.85, 2.0, 3.0
SAVING, SETTLED, LEARN = 0.93, 6, 0.2
# Motion hold, steps while moving, upload slices in ms (moving, still), budgets in MiB, weight of a rate, and
# seconds and frames of the sweep and the suite.
HOLD_S, MOTION_STEPS = 0.15, 4
SLICE_MS, LEAST_MIB, MOST_MIB, FIRST_MIB, OLD_RATE = (4.0, 12.0), 1, 256, 16, 0.8
SETTLE_S, ZOOM_S, REST_S, NEAR_ZOOM = 20.0, 12.0, 3.0, 1000.0
SUITE_FRAMES, SUITE_S = 5, 30.0


def half_up(x: float) -> int:
    """To the nearest integer, halves away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def clamp(x, lo, hi):
    return min(max(x, lo), hi)


class Controller:
    """What both controllers know: time, how long the drawn step has been drawn, learnt costs, predictions for each step.

    An update takes a dict: seconds, budget (ms), moving, drawn (step), requested (whether the step asked for is drawn),
    fixed, scaled, draw (ms of the last pass and draw), counts (segments of each step, or None) and the sample of a
    measured frame: frame (ms, or None), passed (whether it ran a pass) and step.
    """

    def __init__(self, step: int = 0):
        self.now, self.step = 0.0, clamp(step, 0, COARSEST)
        self.other, self.correction = None, 1.0
        self.last_drawn, self.settled = None, 0
        self.last_calm = False

    def ratio(self, x: dict, step: int) -> float:
        """Segments of a step over those of the drawn one, from counts where there are any."""
        counts, drawn = x.get("counts"), x["drawn"]
        if counts and 0 <= drawn <= COARSEST and counts[drawn]:
            return counts[step] / counts[drawn]
        return SAVING ** (step - drawn)

    def learn(self, x: dict) -> None:
        frame = x.get("frame")
        if frame is None:
            return
        if x["passed"] == x["moving"]:
            self.last_calm = frame <= CALM * x["budget"]
        if x["step"] != x["drawn"] or self.settled < SETTLED:
            return
        if not x["passed"]:
            other = max(frame - x["draw"], 0.0)
            self.other = other if self.other is None else self.other + LEARN * (other - self.other)
        elif self.other is not None and x["fixed"] + x["scaled"] > 0.01:
            seen = (frame - self.other - x["draw"]) / (x["fixed"] + x["scaled"])
            self.correction = clamp(self.correction + LEARN * (seen - self.correction), 0.5, 4.0)

    def predicted(self, x: dict) -> list[float]:
        out = []
        for s in range(TOLERANCE_STEPS):
            r = self.ratio(x, s)
            passes = self.correction * (x["fixed"] + x["scaled"] * r) if x["moving"] else 0.0
            out.append((self.other or 0.0) + passes + x["draw"] * r)
        return out

    def update(self, x: dict) -> int:
        self.now += x["seconds"]
        self.settled = self.settled + 1 if x["drawn"] == self.last_drawn else 0
        self.last_drawn = x["drawn"]
        self.learn(x)
        self.choose(x)
        return self.step


class Predictive(Controller):
    """Coarser at once when frames do not fit, or are predicted not to; finer one step at a time after calm frames; a finer
    step that failed rests, twice as long each time, until it has held."""

    def __init__(self, step: int = 0):
        super().__init__(step)
        self.calm, self.changed, self.refined = 0.0, 0.0, -1e9
        self.pending = self.refined_moving = self.blocked_moving = False
        self.blocked, self.until, self.rest = -1, 0.0, 1.0

    def choose(self, x: dict) -> None:
        budget, moving = x["budget"], x["moving"]
        self.calm = self.calm + x["seconds"] if self.last_calm else 0.0
        if self.pending and x["requested"]:
            self.pending, self.refined = False, self.now
        predicted, wanted = self.predicted(x), self.step
        if self.settled >= SETTLED:
            wanted = next((s for s in range(TOLERANCE_STEPS) if predicted[s] <= FIT * budget), COARSEST)
        if x.get("frame") is not None and x["step"] == self.step and x["passed"] == moving and x["frame"] > budget:
            wanted = max(wanted, min(self.step + 1, COARSEST))
        if wanted > self.step:
            if self.now - self.refined < FAIL_S and moving == self.refined_moving:
                self.blocked, self.blocked_moving, self.until = self.step, moving, self.now + self.rest
                self.rest, self.refined = min(2 * self.rest, BACKOFF_S), -1e9
            self.step, self.changed, self.calm, self.pending = wanted, self.now, 0.0, False
        elif wanted < self.step and x["requested"] and self.calm >= CALM_S and self.now - self.changed >= REFINE_S and predicted[self.step - 1] <= REFINE * budget:
            if not (self.step - 1 == self.blocked and moving == self.blocked_moving and self.now < self.until):
                self.step, self.changed, self.refined = self.step - 1, self.now, -1e9
                self.pending, self.refined_moving = True, moving
        if self.step == self.blocked and self.refined > 0 and self.now - self.refined > RESET_S:
            self.blocked, self.rest = -1, 1.0


class Feedback(Controller):
    """Proportional and integral, in steps per budget of error."""

    def __init__(self, step: int = 0):
        super().__init__(step)
        self.integral = self.step / INTEGRAL

    def choose(self, x: dict) -> None:
        if x.get("frame") is None or x["budget"] <= 0:
            return
        error = x["frame"] / x["budget"] - TARGET
        self.integral = clamp(self.integral + error * x["seconds"], 0.0, COARSEST / INTEGRAL)
        self.step = half_up(clamp(PROPORTIONAL * error + INTEGRAL * self.integral, 0.0, COARSEST))


class Manual(Controller):
    def choose(self, x: dict) -> None:
        self.step = clamp(x["drawn"], 0, COARSEST)


CONTROLLERS = {"manual": Manual, "predictive": Predictive, "feedback": Feedback}


def fold(frames: DataFrame, schema: str, start: Callable[[], Callable[[dict], tuple]]) -> DataFrame:
    """run, seq and what a fold over each run's frames, in order, gives for every frame."""
    names = [x.split()[0] for x in schema.split(", ")]

    def of(run: pd.DataFrame) -> pd.DataFrame:
        run, step = run.sort_values("seq"), start()
        return pd.DataFrame([(r["run"], r["seq"], *step(r)) for r in run.to_dict("records")], columns=["run", "seq", *names])

    return frames.groupBy("run").applyInPandas(of, f"run long, seq long, {schema}")


def tolerance(frames: DataFrame, controller: str, budget: float) -> DataFrame:
    """run, seq, step: the controller's step after each frame (columns run, seq, ms, dt; moving, passed, fixed, scaled, draw
    and counts where there are any). The step of a frame is drawn in the next one."""

    def start():
        c = CONTROLLERS[controller]()

        def step(r: dict) -> tuple:
            counts = r.get("counts")
            moving = bool(r.get("moving", True))
            x = {"seconds": r["dt"], "budget": budget, "moving": moving, "drawn": c.step, "requested": True, "fixed": r.get("fixed", 0.0), "scaled": r.get("scaled", 0.0), "draw": r.get("draw", r["ms"]), "counts": None if counts is None else list(counts), "frame": r["ms"], "passed": bool(r.get("passed", moving)), "step": c.step}
            return (c.update(x),)

        return step

    return fold(frames, "step int", start)


def coarsened(frames: DataFrame) -> DataFrame:
    """run, seq, coarse: whether twice the tolerance holds, while the camera moves and for a moment after (moving, dt)."""

    def start():
        still = [1e9]

        def step(r: dict) -> tuple:
            still[0] = 0.0 if r["moving"] else still[0] + r["dt"]
            return (still[0] < HOLD_S,)

        return step

    return fold(frames, "coarse boolean", start)


def eased_zoom(frames: DataFrame, zoom: float) -> DataFrame:
    """run, seq, zoom: the camera's zoom on its way to each frame's target (target, dt)."""

    def start():
        at = [zoom]

        def step(r: dict) -> tuple:
            at[0] += (r["target"] - at[0]) * (1 - math.exp(-14.0 * clamp(r["dt"], 0.0, 0.1)))
            at[0] = r["target"] if abs(r["target"] - at[0]) < 0.0001 else at[0]
            return (at[0],)

        return step

    return fold(frames, "zoom double", start)


def upload_budget(frames: DataFrame) -> DataFrame:
    """run, seq, budget: bytes that may be uploaded, from the running rate of earlier uploads (moving, bytes, ms)."""
    mib = 1 << 20

    def start():
        rate = [0.0]

        def step(r: dict) -> tuple:
            budget = clamp(int(rate[0] * SLICE_MS[0 if r["moving"] else 1]), LEAST_MIB * mib, MOST_MIB * mib) if rate[0] > 0 else FIRST_MIB * mib
            if r["bytes"] >= mib and r["ms"] > 0.05:
                now = r["bytes"] / r["ms"]
                rate[0] = OLD_RATE * rate[0] + (1 - OLD_RATE) * now if rate[0] > 0 else now
            return (budget,)

        return step

    return fold(frames, "budget long", start)


def suite_waits(frames: DataFrame) -> DataFrame:
    """run, seq, wait: whether a step of the suite is ready (five settled frames on end), timed out, or waits (settled, dt)."""

    def start():
        state = [0, 0.0]

        def step(r: dict) -> tuple:
            state[0], state[1] = state[0] + 1 if r["settled"] else 0, state[1] + r["dt"]
            wait = "ready" if state[0] >= SUITE_FRAMES else "timed out" if state[1] > SUITE_S else "waiting"
            if wait != "waiting":
                state[:] = [0, 0.0]
            return (wait,)

        return step

    return fold(frames, "wait string", start)


def sweep_target(phase: Column, seconds: Column, overview: float) -> Column:
    """The zoom that a phase of the sweep asks for, so many seconds after it began."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), seconds / ZOOM_S))
    ratio = F.lit(NEAR_ZOOM / overview)
    return F.when(phase == "zoom in", overview * F.pow(ratio, t)).when(phase == "hold near", NEAR_ZOOM).when(phase == "zoom out", overview * F.pow(ratio, 1 - t)).otherwise(overview)


def sweep_phases(frames: DataFrame) -> DataFrame:
    """run, seq, phase, seconds: the sweep's states. It settles until a frame is complete or 20 s are over, zooms in for 12 s,
    rests 3 s, zooms out for 12 s and rests 3 s (complete, dt); seconds are those since the phase began."""
    order = [("overview", SETTLE_S), ("zoom in", ZOOM_S), ("hold near", REST_S), ("zoom out", ZOOM_S), ("hold far", REST_S), ("idle", math.inf)]

    def start():
        state = [0, 0.0]

        def step(r: dict) -> tuple:
            name, limit = order[state[0]]
            state[1] += r["dt"]
            out = (name, state[1])
            over = state[1] >= limit if state[0] else bool(r["complete"]) or state[1] > limit
            if over and name != "idle":
                state[:] = [state[0] + 1, 0.0]
            return out

        return step

    return fold(frames, "phase string, seconds double", start)


def lru_pool(touches: DataFrame, slots: int) -> DataFrame:
    """run, seq, page, hit, evicted: a pool of fixed slots with the least recently used page leaving first.

    Pages that were touched in the same frame (column frame, else every touch is its own) are pinned: a page finds no slot
    when all are, and stays out.
    """

    def fold_pool(run: pd.DataFrame) -> pd.DataFrame:
        pool: OrderedDict = OrderedDict()  # page -> frame of its last touch
        out = []
        for r in run.sort_values("seq").to_dict("records"):
            frame, hit, gone = r.get("frame", r["seq"]), r["page"] in pool, None
            if hit:
                if pool[r["page"]] != frame:
                    pool.move_to_end(r["page"])
                    pool[r["page"]] = frame
            elif len(pool) < slots:
                pool[r["page"]] = frame
            elif pool and next(iter(pool.values())) != frame:
                gone = pool.popitem(last=False)[0]
                pool[r["page"]] = frame
            out.append((r["run"], r["seq"], r["page"], hit, gone))
        return pd.DataFrame(out, columns=["run", "seq", "page", "hit", "evicted"]).astype({"evicted": "Int64"})

    return touches.groupBy("run").applyInPandas(fold_pool, "run long, seq long, page long, hit boolean, evicted long")


def evictions(slots: DataFrame, budget: int) -> DataFrame:
    """Pages of a store that go (run, page, bytes, last_use): unreadable ones (0 bytes) always; else, while the store is over its
    budget, those that the last use did not touch, least recently used first."""
    w = Window.partitionBy("run")
    order = w.orderBy("last_use", "page")
    total, newest = F.sum("bytes").over(w), F.max("last_use").over(w)
    can = (F.col("bytes") > 0) & (F.col("last_use") < newest)
    freed = F.coalesce(F.sum(F.when(can, F.col("bytes")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = slots.withColumns({"_total": total, "_can": can, "_freed": freed})
    return s.where((F.col("bytes") == 0) | (F.col("_can") & (F.col("_total") - F.col("_freed") > budget))).drop("_total", "_can", "_freed")


def first_fitting(predicted: DataFrame, budget: float) -> DataFrame:
    """run, seq, step: the finest step whose predicted time fits (run, seq, step, ms), or the coarsest."""
    fits = F.min(F.when(F.col("ms") <= FIT * budget, F.col("step")))
    return predicted.groupBy("run", "seq").agg(F.coalesce(fits, F.lit(COARSEST)).cast("int").alias("step"))


def settle_times(frames: DataFrame) -> DataFrame:
    """Per run and view: time from the first incomplete frame to the next complete one (run, seq, at, complete)."""
    w = Window.partitionBy("run").orderBy("seq")
    starts = frames.withColumn("start", (~F.col("complete") & F.coalesce(F.lag("complete").over(w), F.lit(True))).cast("int"))
    island = starts.withColumn("island", F.sum("start").over(w)).where("island > 0")
    spans = island.groupBy("run", "island").agg(F.min("at").alias("began"), F.min(F.when(F.col("complete"), F.col("at"))).alias("ended"))
    return spans.select("run", F.col("island").cast("long").alias("island"), "began", "ended")


def moved(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames whose keys differ from the frame before: those that need a new pass."""
    w = Window.partitionBy("run").orderBy("seq")
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.lag(k).over(w))
        same = eq if same is None else same & eq
    return frames.withColumn("recompute", ~F.coalesce(same & (F.row_number().over(w) > 1), F.lit(False)))


def last_complete(frames: DataFrame, column: str) -> DataFrame:
    """What is shown: the last value of a complete frame."""
    w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("shown", F.last(F.when(F.col("complete"), F.col(column)), ignorenulls=True).over(w))


def styled(frames: DataFrame, read: Callable[[], DataFrame], path: str) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Frames joined with styles, and the same anew: styles are read again when their file has been written since."""
    from prismgraph.sources.tables import files

    known = {"at": None, "styles": None}

    def join() -> DataFrame:
        at = [x[2] for x in files(frames.sparkSession, path)]
        if at != known["at"]:
            known.update(at=at, styles=read())
        return frames.join(F.broadcast(known["styles"]), "type", "left")  # 64 types

    return join(), join


def stream_tolerance(stream: DataFrame, controller: str, budget: float) -> DataFrame:
    """tolerance() over a stream of frames (run, seq, ms, dt): the controller of each run is kept as state between batches."""
    import pickle

    def update(key, frames, state):
        c = pickle.loads(state.get[0]) if state.exists else CONTROLLERS[controller]()
        out = []
        for some in frames:
            for r in some.sort_values("seq").itertuples():
                x = {"seconds": r.dt, "budget": budget, "moving": True, "drawn": c.step, "requested": True, "fixed": 0.0, "scaled": 0.0, "draw": r.ms, "counts": None, "frame": r.ms, "passed": True, "step": c.step}
                out.append((key[0], r.seq, c.update(x)))
        state.update((pickle.dumps(c),))
        yield pd.DataFrame(out, columns=["run", "seq", "step"])

    return stream.groupBy("run").applyInPandasWithState(update, "run long, seq long, step int", "c binary", "append", "NoTimeout")
