"""The whole judgement as one plan: detections to tracks, bounces, decisions and a summary per clip."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcline.operators import courts, jobs, refusals, tracks
from arcline.sources.tables import BOUNCES, as_written


@dataclass(frozen=True)
class Judgement:
    track: DataFrame
    bounces: DataFrame
    judged: DataFrame
    summary: DataFrame
    #: clip_id, stage (config or bounce), refused and n: what was not worked on, and why; None without configurations.
    refused: DataFrame | None = None


def judge_clips(detections: DataFrame, clips: DataFrame, configs: DataFrame | None = None, detector: tracks.Detector = tracks.Detector(), *, strict: bool = False) -> Judgement:  # noqa: B008
    """``clips``: clip_id, frames, fps, clip_start_sec; ``configs``: as ``courts.normalize`` takes them, for those clips that have one.

    Decisions are made from bounces as they are written to CSV, rounded.  What can't be judged has no decision and is in ``refused``; with ``strict``
    reading the decisions or the summary is then an error that names the clip and the reason.
    """
    refused = None
    track = tracks.dense_track(tracks.best_detection(detections), clips)
    bounces = tracks.turning_points(track, detector)
    starts = clips.select("clip_id", F.coalesce("clip_start_sec", F.lit(0.0)).alias("clip_start_sec"))
    if configs is None:
        settings = None
        judged = as_written(bounces, BOUNCES).withColumns({c: F.lit(None).cast(t) for c, t in (("judge_x", "double"), ("judge_y", "double"), ("decision", "string"), ("decision_reason", "string"), ("boundary_distance_px", "double"), ("signed_distance_px", "double"))})
    else:
        settings = courts.normalize(configs)
        tried = courts.judge(as_written(bounces, BOUNCES), settings, refused="refused").withColumn("refused", F.when(F.col("refused") != "no_config", F.col("refused")))
        refused = refusals.collected("clip_id", config=settings, bounce=tried)
        settings = refusals.strict(settings, "clip_id") if strict else settings
        judged = refusals.strict(tried, "clip_id") if strict else tried.drop("refused")
    has = clips.select("clip_id", F.lit(False).alias("has_config")) if settings is None else clips.select("clip_id").join(settings.where(F.col("mode").isNotNull()).select("clip_id", F.lit(True).alias("has_config")), "clip_id", "left").withColumn("has_config", F.coalesce("has_config", F.lit(False)))
    return Judgement(track, bounces.join(starts, "clip_id"), judged.join(starts, "clip_id"), jobs.summarise(has, track, bounces, judged), refused)
