"""From detections to dense tracks, turning points and their summaries, for many clips at once.

Window work is dealt by clip and by block of frames, with the few frames that a window reaches over from the neighbouring blocks, so
a clip of any length spreads over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcline.functions.numeric import clamp, ratio

#: Confidence is the score's share of this.
FULL_SCORE = 150.0
#: Frames that windows work on at a time, and rounds of suppression in windows before what is left is settled by clip.
FRAME_BLOCK, ROUNDS = 4096, 3


@dataclass(frozen=True)
class Detector:
    """Thresholds of the turning-point detector, in frames and pixels."""

    window: int = 3
    local_window: int = 4
    min_local_points: int = 5
    min_down_speed: float = 3.0
    min_up_speed: float = 2.0
    local_y_tolerance: float = 10.0
    max_x_velocity_change: float = 85.0
    min_score: float = 9.0
    min_gap: int = 10


def best_detection(detections: DataFrame, *, class_id: int | None = 0, min_confidence: float = 0.25, most: int = 10, order: list[Column] | None = None) -> DataFrame:
    """The most confident box of each (clip_id, frame_index), the first in ``order`` on a tie, with its centre as x and y.

    Boxes below ``min_confidence`` and beyond the ``most`` most confident of a frame are the model's to drop, and drop out first.
    """
    ties = order or [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    frame = Window.partitionBy("clip_id", "frame_index")
    kept = detections.where((F.col("confidence") >= min_confidence) & ~F.isnan("confidence"))  # in Spark NaN is greater than any number
    kept = kept.withColumn("_all", F.row_number().over(frame.orderBy(F.col("confidence").desc(), *ties))).where(F.col("_all") <= most)
    if class_id is not None:
        kept = kept.where(F.col("class_id") == class_id)
    first = kept.withColumn("_own", F.row_number().over(frame.orderBy("_all"))).where("_own = 1")
    return first.select("clip_id", "frame_index", "class_id", "confidence", "x1", "y1", "x2", "y2", ((F.col("x1") + F.col("x2")) * 0.5).alias("x"), ((F.col("y1") + F.col("y2")) * 0.5).alias("y"))


def dense_track(best: DataFrame, clips: DataFrame) -> DataFrame:
    """A row for each frame of ``clips`` (clip_id, frames, fps), detected or missing; a missing frame scores 0."""
    spine = clips.withColumn("frame_index", F.explode(F.expr("if(frames > 0, sequence(0, cast(frames as int) - 1), array())")))
    joined = spine.join(best.drop("class_id"), ["clip_id", "frame_index"], "left")
    seen = F.col("x").isNotNull()
    return joined.select(
        "clip_id", "frame_index", ratio(F.col("frame_index"), F.col("fps").cast("int"), 0.0).alias("time_sec"), "x", "y", F.when(seen, "detected").otherwise("missing").alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("score"), "x1", "y1", "x2", "y2")


def status_counts(track: DataFrame) -> DataFrame:
    """Frames of each status per clip; predicted and isolated are statuses that a smoother may add."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return track.groupBy("clip_id").agg(F.count("*").alias("frames"), *[count(s) for s in ("detected", "missing", "predicted", "isolated")])


def turning_candidates(track: DataFrame, detector: Detector = Detector(), fps: float | Column = 30.0, block: int = FRAME_BLOCK) -> DataFrame:  # noqa: B008
    """Frames of a dense ``track`` (clip_id, frame_index, x, y) where y turns from down to up, with their scores."""
    d = detector
    halo = max(d.window, d.local_window)
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    own = F.floor(F.col("frame_index") / block).cast("int")
    at = F.col("frame_index") % block
    blocks = F.array(own, F.when(at < halo, own - 1), F.when(at >= block - halo, own + 1))
    dealt = track.select("clip_id", "frame_index", F.when(whole, F.col("x")).alias("x"), F.when(whole, F.col("y")).alias("y"), F.explode(F.filter(blocks, lambda b: b.isNotNull())).alias("_block"))
    w = Window.partitionBy("clip_id", "_block").orderBy("frame_index")
    near = w.rowsBetween(-d.local_window, d.local_window)
    step = lambda c, k: (F.lag(c, d.window) if k < 0 else F.lead(c, d.window)).over(w)
    measured = dealt.withColumns({
        "_px": step("x", -1), "_py": step("y", -1), "_nx": step("x", 1), "_ny": step("y", 1), "_top": F.max("y").over(near), "_points": F.count("y").over(near),
    }).where(F.col("_block") == own)
    r = float(d.window)
    before, after = (F.col("y") - F.col("_py")) / r, (F.col("_ny") - F.col("y")) / r
    change = F.abs((F.col("_nx") - F.col("x")) / r - (F.col("x") - F.col("_px")) / r)
    prominence = F.col("y") - F.least("_py", "_ny")
    made = measured.withColumns({"vy_before": before, "vy_after": after, "prominence": prominence, "x_velocity_change": change})
    made = made.withColumn("score", (F.col("vy_before") - F.col("vy_after")) + F.greatest("prominence", F.lit(0.0)) * 0.35 - F.col("x_velocity_change") * 0.12)
    kept = made.where(
        F.col("y").isNotNull() & F.col("_py").isNotNull() & F.col("_ny").isNotNull() & (F.col("vy_before") >= d.min_down_speed) & (F.col("vy_after") <= -d.min_up_speed) & (F.col("_points") >= d.min_local_points)
        & (F.col("y") >= F.col("_top") - d.local_y_tolerance) & (F.col("x_velocity_change") <= d.max_x_velocity_change) & (F.col("score") >= d.min_score))
    rate = fps if isinstance(fps, Column) else F.lit(fps)
    return kept.select("clip_id", "frame_index", ratio(F.col("frame_index"), rate.cast("int"), 0.0).alias("time_sec"), "x", "y", "score", "vy_before", "vy_after", "prominence", "x_velocity_change")


def suppress(candidates: DataFrame, min_gap: int = 10, rounds: int = ROUNDS, block: int = FRAME_BLOCK) -> DataFrame:
    """Greedy suppression by score: a candidate stays unless one that stays is less than ``min_gap`` frames away; ties go to the lower frame.

    In a round each open candidate that is the best of the open ones within the gap stays, and what it covers goes, which is what taking them by score
    comes to.  Rounds are windows over blocks of frames, each with the frames on either side that can reach into it in ``rounds`` rounds, so neither a
    long clip nor a dense stretch lands in one task.  What is still open then, long runs of rising or falling scores, is settled by clip, from
    the best down, in time in proportion to the run.  Of rows of one frame the best counts, ties by the other columns in order.
    """
    if min_gap < 1:
        return candidates
    halo = 2 * rounds * (min_gap - 1)
    block = max(block, 2 * halo, 1)
    own, at = F.floor(F.col("frame_index") / block), F.pmod("frame_index", F.lit(block))
    blocks = F.array(own, F.when(at < halo, own - 1), F.when(at >= block - halo, own + 1))
    rest = [c for c in candidates.columns if c not in ("clip_id", "frame_index", "score")]
    dealt = candidates.withColumns({"_own": own, "_block": F.explode(F.filter(blocks, lambda b: b.isNotNull()))})
    w = Window.partitionBy("clip_id", "_block")
    ordered = w.orderBy("frame_index", F.col("score").desc(), *rest)
    state = dealt.withColumn("_twice", F.lag("frame_index").over(ordered).eqNullSafe(F.col("frame_index"))).where(~F.col("_twice")).drop("_twice")
    near = w.orderBy("frame_index").rangeBetween(1 - min_gap, min_gap - 1)
    rank = F.struct((-F.col("score")).alias("n"), F.col("frame_index").alias("f"))
    state = state.withColumns({"_open": F.lit(True), "_stays": F.lit(False)})
    for _ in range(rounds):
        state = state.withColumn("_now", F.coalesce(F.min(F.when(F.col("_open"), rank)).over(near) == rank, F.lit(False)) & F.col("_open"))
        state = state.withColumns({"_stays": F.col("_stays") | F.col("_now"), "_open": F.col("_open") & ~F.max("_now").over(near)})
    state = state.where(F.col("_block") == F.col("_own"))
    open_ = state.where("_open").select(*candidates.columns)
    settled = open_.groupBy("clip_id").applyInArrow(lambda run: settle(run, min_gap), open_.schema)
    return state.where("_stays").select(*candidates.columns).unionByName(settled)


def settle(run: pa.Table, min_gap: int) -> pa.Table:
    """The rows of one clip that stay, from the best down.  Stretches of ``min_gap`` frames hold one that stays at most, so three tell whether a row is covered."""
    frame = run["frame_index"].to_numpy()
    order = np.lexsort((frame, -run["score"].to_numpy()))
    held: dict[int, int] = {}
    for k in order.tolist():
        f = int(frame[k])
        stretch = f // min_gap
        if all(abs(f - held.get(s, f - min_gap)) >= min_gap for s in (stretch - 1, stretch, stretch + 1)):
            held[stretch] = f
    return run.filter(pa.array(np.isin(frame, list(held.values()))))


def turning_points(track: DataFrame, detector: Detector = Detector(), fps: float | Column = 30.0) -> DataFrame:  # noqa: B008
    return suppress(turning_candidates(track, detector, fps), detector.min_gap)


def primary(bounces: DataFrame) -> DataFrame:
    """Each clip's bounce of the highest score, the lowest frame on a tie, with its confidence."""
    first = F.min(F.struct((-F.col("score")).alias("n"), "frame_index", "time_sec", "x", "y")).alias("p")
    picked = bounces.groupBy("clip_id").agg(first, F.count("*").alias("bounce_count"))
    return picked.select("clip_id", "p.frame_index", "p.time_sec", "p.x", "p.y", (-F.col("p.n")).alias("score"), confidence(-F.col("p.n")).alias("confidence"), "bounce_count")


def confidence(score: Column) -> Column:
    return F.coalesce(clamp(score / FULL_SCORE, 0.0, 1.0), F.lit(0.0))
