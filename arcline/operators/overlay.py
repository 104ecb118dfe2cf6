"""What to draw on each frame, as tables: trace points, the visible event, and the banner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcline.functions import text as X


def nearest_bounce(frames: DataFrame, bounces: DataFrame, reach: int) -> DataFrame:
    """Each of ``frames`` (clip_id, frame_index) with the bounce at most ``reach`` frames away, the past one on a tie; nulls for none.

    A bounce goes to the 2 * reach + 1 frames about it, so the join is on equal frames.
    """
    rest = [c for c in bounces.columns if c not in ("clip_id", "frame_index")]
    spread = bounces.select("clip_id", F.explode(F.sequence(F.col("frame_index") - reach, F.col("frame_index") + reach)).alias("_frame"), F.col("frame_index").alias("bounce_frame"), *rest)
    far = F.abs(F.col("bounce_frame") - F.col("_frame"))
    best = spread.groupBy("clip_id", "_frame").agg(F.min(F.struct(far.alias("delta"), (F.col("bounce_frame") > F.col("_frame")).alias("ahead"), "bounce_frame", *rest)).alias("b"))
    named = best.select("clip_id", F.col("_frame").alias("frame_index"), "b.bounce_frame", *[F.col(f"b.{c}").alias(f"bounce_{c}") for c in rest])
    return frames.join(named, ["clip_id", "frame_index"], "left")


def trace(frames: DataFrame, track: DataFrame, length: int = 8, low: int = 120, span: int = 120) -> DataFrame:
    """The track's points of the last ``length`` frames for each frame, with their fading style: equal joins on shifted frames."""
    shifted = frames.select("clip_id", "frame_index", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("offset")).withColumn("_at", F.col("frame_index") - F.col("offset"))
    points = track.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("clip_id", F.col("frame_index").alias("_at"), "x", "y")
    alpha = 1.0 - F.col("offset") / F.lit(float(max(length, 1)))
    return shifted.join(points, ["clip_id", "_at"]).select(
        "clip_id", "frame_index", F.col("offset").cast("int").alias("offset"), F.col("x").cast("int").alias("px"), F.col("y").cast("int").alias("py"),
        (F.lit(low) + F.lit(span) * alpha).cast("int").alias("green"), F.greatest(F.lit(2), (5 - F.col("offset") * 0.28).cast("int")).alias("radius"))


def draw_plan(frames: DataFrame, judged: DataFrame, reach: int = 4) -> DataFrame:
    """Per frame the visible event's label, colour and text position, and the banner."""
    per_clip = judged.groupBy("clip_id").agg(F.count("*").alias("_n"))
    near = nearest_bounce(frames, judged.select("clip_id", "frame_index", "x", "y", "decision", "boundary_distance_px"), reach).join(per_clip, "clip_id", "left")
    seen = F.col("bounce_frame").isNotNull()
    decision = F.when(seen, F.coalesce("bounce_decision", F.lit("UNKNOWN")))
    far = F.col("bounce_boundary_distance_px").cast("string")
    return near.select(
        "clip_id", "frame_index", "bounce_frame", X.bounce_label(decision).alias("label"), F.when(seen, X.colour(decision)).alias("colour"), F.rint("bounce_x").cast("int").alias("px"), F.rint("bounce_y").cast("int").alias("py"),
        X.banner(decision, F.col("bounce_frame"), far, F.coalesce("_n", F.lit(0)) > 0).alias("banner"))


def with_court(frames: DataFrame, settings: DataFrame) -> DataFrame:
    """``frames`` with what is drawn of their clip's court (``courts.normalize``): ``polygon`` and ``segments`` in whole pixels; nulls for none.

    One row a clip is joined, worked out before the frames are.
    """
    whole = lambda p: F.struct(F.rint(p["x"].cast("float")).cast("int").alias("x"), F.rint(p["y"].cast("float")).cast("int").alias("y"))
    drawn = settings.where(F.col("mode").isNotNull()).select(
        "clip_id", F.when(F.col("mode") == "polygon", F.transform("court_polygon", whole)).alias("polygon"), F.transform("segments", lambda s: F.struct(whole(s["a"]).alias("a"), whole(s["b"]).alias("b"))).alias("segments"))
    return frames.join(drawn, "clip_id", "left")


def last_by_frame(track: DataFrame, order: Column) -> DataFrame:
    """Of rows that repeat a frame the last in ``order``."""
    w = Window.partitionBy("clip_id", "frame_index").orderBy(order.desc())
    return track.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
