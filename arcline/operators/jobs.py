"""Requests, sessions and jobs: times, summaries, choice of the latest, and the views that clients read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcline.functions import text as X
from arcline.functions.numeric import blank_to_null, clamp, nearest_int, ratio
from arcline.operators.refusals import first_of


def recording_info(frame_count: Column, fps: Column, width: Column, height: Column) -> Column:
    """A recording's metadata with its duration, 0 where the rate is unknown."""
    return F.struct(frame_count.cast("int").alias("frame_count"), fps.cast("double").alias("fps"), width.cast("int").alias("width"), height.cast("int").alias("height"), F.when(fps > 0, ratio(frame_count, fps)).otherwise(0.0).alias("duration_sec"))


def recording_refusal(info: Column) -> Column:
    """Why a recording can't be used: video_unreadable without metadata, video_size_unreadable without a size, no_frames without frames."""
    return first_of((info.isNull() | info["frame_count"].isNull(), "video_unreadable"), (F.coalesce(info["width"], F.lit(0)) <= 0, "video_size_unreadable"), (F.coalesce(info["height"], F.lit(0)) <= 0, "video_size_unreadable"), (info["frame_count"] <= 0, "no_frames"))


def pressed_at(duration: Column, pressed: Column, use_end: Column, end_offset: Column) -> Column:
    """struct(source, raw, pressed_at_sec, clamped): the asked time or the end less an offset, within the recording."""
    from_end = pressed.isNull() | F.coalesce(use_end, F.lit(False))
    raw = F.when(from_end, duration - F.coalesce(end_offset, F.lit(0.0))).otherwise(pressed)
    at = F.when(duration > 0, clamp(raw, 0.0, duration)).otherwise(F.greatest(raw, F.lit(0.0)))
    return F.struct(F.when(from_end, "video_end").otherwise("request").alias("source"), raw.alias("raw_pressed_at_sec"), at.alias("pressed_at_sec"), (at != raw).alias("clamped"))


def clip_bounds(pressed_sec: Column, lookback: Column) -> Column:
    return F.struct(F.greatest(F.lit(0.0), pressed_sec - lookback).alias("start_sec"), pressed_sec.alias("end_sec"))


def clip_frames(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """Frames of each clip's time range, numbered from its start: ``clips`` (clip_id, recording_id, start_sec, end_sec, fps, total).

    A clip is spread over the frames that it wants, so the join is on equal frames.  A clip whose range is empty gives none (``empty_clips`` names it).
    """
    ranges = _ranges(clips).where("_to > _from")
    wanted = ranges.select("clip_id", "recording_id", "_from", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("_at"))
    joined = frames.withColumn("_at", F.col("frame_index").cast("long")).join(wanted.withColumn("_at", F.col("_at").cast("long")), ["recording_id", "_at"])
    return joined.withColumn("frame_index", (F.col("_at") - F.col("_from")).cast("int")).drop("_at", "_from")


def _ranges(clips: DataFrame) -> DataFrame:
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    return clips.withColumn("_from", nearest_int(F.col("start_sec") * rate)).withColumn("_to", F.least(F.col("total"), nearest_int(F.col("end_sec") * rate)))


def empty_clips(clips: DataFrame) -> DataFrame:
    """(clip_id, refused) of ``clips`` whose range holds no frame."""
    return _ranges(clips).where("_to <= _from").select("clip_id", F.lit("empty_clip_range").alias("refused"))


def validate(requests: DataFrame) -> DataFrame:
    """``requests`` with ``rejected``: null, or the field that is out of range."""
    bad = F.when(F.col("pressed_at_sec") < 0, "pressed_at_sec").when(F.col("end_offset_sec") < 0, "end_offset_sec").when(F.col("lookback_sec") <= 0, "lookback_sec")
    return requests.withColumn("rejected", bad)


def latest_job(jobs: DataFrame) -> DataFrame:
    """Each session's last finished job, else its last: by (modified, job_id)."""
    w = Window.partitionBy("session_id").orderBy((F.col("status") == "done").desc(), F.col("modified").desc(), F.col("job_id").desc())
    return jobs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def job_to_save(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """For (session_id, asked_job_id) the job to save and ``refused``: null, no_job, unknown_job or not_done."""
    named = jobs.select(F.col("session_id").alias("_s"), F.col("job_id").alias("_j"), F.col("status").alias("_status"))
    latest = latest_job(jobs).select(F.col("session_id").alias("_ls"), F.col("job_id").alias("_lj"), F.col("status").alias("_lstatus"))
    asked = blank_to_null(F.col("asked_job_id").cast("string"))
    joined = requests.join(named, (F.col("session_id") == F.col("_s")) & (asked == F.col("_j").cast("string")), "left").join(latest, F.col("session_id") == F.col("_ls"), "left")
    job = F.when(asked.isNotNull(), F.col("_j")).otherwise(F.col("_lj"))
    status = F.when(asked.isNotNull(), F.col("_status")).otherwise(F.col("_lstatus"))
    refused = F.when(job.isNull(), F.when(asked.isNotNull(), "unknown_job").otherwise("no_job")).when(status != "done", "not_done")
    return joined.select("session_id", "asked_job_id", F.when(refused.isNull(), job).alias("job_id"), refused.alias("refused"))


def with_session_defaults(jobs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Jobs with the configuration of their session where they have none; empty strings count as none."""
    s = sessions.select("session_id", *[F.col(c).alias(f"_{c}") for c in ("court_config_path", "config_image", "config_index")])
    either = lambda c: F.coalesce(blank_to_null(F.col(c)), blank_to_null(F.col(f"_{c}")))
    joined = jobs.join(s, "session_id", "left")
    return joined.withColumns({"court_config_path": either("court_config_path"), "config_image": either("config_image"), "config_index": F.coalesce("config_index", "_config_index", F.lit(0))}).drop(*[f"_{c}" for c in ("court_config_path", "config_image", "config_index")])


def bounce_view(bounces: DataFrame) -> DataFrame:
    """Bounces with their time in the clip and, by clip_start_sec, in the recording; metrics that are missing read 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return bounces.select("clip_id", "frame_index", F.col("time_sec").alias("clip_time_sec"), (F.col("time_sec") + F.col("clip_start_sec")).alias("recording_time_sec"), "x", "y", *[zero(c) for c in ("score", "vy_before", "vy_after", "prominence", "x_velocity_change")])


def decision_view(judged: DataFrame) -> DataFrame:
    """Judged bounces as clients read them."""
    return judged.select(
        "clip_id", F.col("frame_index").cast("int").alias("frame_index"), F.col("time_sec").alias("clip_time_sec"), (F.col("time_sec") + F.col("clip_start_sec")).alias("recording_time_sec"), F.coalesce("judge_x", "x").alias("x"), F.coalesce("judge_y", "y").alias("y"),
        F.coalesce("decision", F.lit("UNKNOWN")).alias("decision"), F.coalesce("decision_reason", F.lit("")).alias("decision_reason"), "boundary_distance_px", "signed_distance_px")


def summarise(clips: DataFrame, track: DataFrame, bounces: DataFrame, judged: DataFrame) -> DataFrame:
    """A row per clip of ``clips`` (clip_id, has_config): counts, the primary bounce and decision, result and what failed.

    The primary bounce is that of the highest score, the primary decision the first by frame.
    """
    from arcline.operators.tracks import primary, status_counts

    first = F.min(F.struct("frame_index", "decision", "decision_reason", "boundary_distance_px")).alias("d")
    decisions = judged.where(F.col("decision").isNotNull()).groupBy("clip_id").agg(first, F.count("*").alias("decision_count"))
    joined = clips.join(status_counts(track), "clip_id", "left").join(primary(bounces).select("clip_id", F.struct("frame_index", "time_sec", "x", "y", "score").alias("primary_bounce"), "confidence", "bounce_count"), "clip_id", "left").join(decisions, "clip_id", "left")
    bounced, decided = F.col("primary_bounce").isNotNull(), F.col("d").isNotNull()
    issue = X.detection_issue(bounced, F.col("has_config"), F.col("has_config"), decided)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "clip_id", *[zero(c) for c in ("frames", "detected", "missing", "predicted", "isolated", "bounce_count")], F.when(bounced, "bounce_detected").otherwise("unknown").alias("result"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "primary_bounce",
        F.col("d").alias("primary_decision"), F.when(F.col("has_config"), F.when(decided, "done").otherwise("no_bounce")).alias("inout_status"), issue["failure_type"].alias("failure_type"), issue["failure_reason"].alias("failure_reason"))


def merged_artifacts(artifacts: DataFrame) -> DataFrame:
    """(clip_id, artifacts map) of (clip_id, step, name, url): of equal names the one of the last step counts, rows without a url don't."""
    last = artifacts.where(F.col("url").isNotNull()).groupBy("clip_id", "name").agg(F.max_by("url", F.struct("step", "url")).alias("url"))
    return last.groupBy("clip_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "url")))).alias("artifacts"))


def results(summary: DataFrame, clips: DataFrame, bounces: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Whole results of jobs: ``summarise`` with its nested parts clip, inout_input, tracking and artifacts.

    ``clips``: clip_id, start_sec, end_sec, fps, width, height, frames_written and, for the paths of what was written, track_csv, bounces_csv and
    court_config, any null; ``bounces``: as for ``bounce_view``; ``artifacts``: as for ``merged_artifacts``.  A clip's bounces are listed by frame.
    """
    listed = bounce_view(bounces)
    each = F.struct("frame_index", *[c for c in listed.columns if c not in ("clip_id", "frame_index")])
    per_clip = listed.groupBy("clip_id").agg(F.sort_array(F.collect_list(each)).alias("bounces"))
    empty = F.array().cast(per_clip.schema["bounces"].dataType)
    joined = summary.join(clips, "clip_id").join(per_clip, "clip_id", "left").join(merged_artifacts(artifacts), "clip_id", "left").withColumn("bounces", F.coalesce("bounces", empty))
    tracking = F.struct(F.lit("yolo").alias("model"), "frames", F.col("detected").alias("raw_detected"), F.col("detected").alias("after_outlier"), "detected", "predicted", "isolated", "missing", "bounce_count")
    clip = F.struct("start_sec", "end_sec", "fps", "width", "height", F.col("frames_written").alias("frame_count"))
    given = F.struct(F.col("fps").cast("double").alias("fps"), F.col("width").alias("frame_width"), F.col("height").alias("frame_height"), F.col("start_sec").alias("clip_start_sec"), "bounces", "track_csv", "bounces_csv", "court_config")
    return joined.select(
        "clip_id", clip.alias("clip"), "result", "failure_type", "failure_reason", F.lit(True).alias("video_readable"), "confidence", "primary_bounce", "bounces", given.alias("inout_input"), F.when(F.col("inout_status").isNotNull(), F.struct("inout_status", "primary_decision")).alias("inout"),
        tracking.alias("tracking"), F.coalesce("artifacts", F.create_map().cast("map<string,string>")).alias("artifacts"))


def frontend_view(jobs: DataFrame) -> DataFrame:
    """Jobs flattened: decision and is_in from the nested primary decision, empty lists and maps instead of nulls."""
    decision = F.upper(F.col("inout.primary_decision.decision"))
    empty_map = F.create_map().cast("map<string,string>")
    return jobs.select(
        "job_id", "session_id", "status", "result", decision.alias("decision"), X.is_in(decision).alias("is_in"), "failure_type", "failure_reason", "video_readable", "recording_accessible", "confidence", "timing", "primary_bounce",
        F.col("inout.primary_decision").alias("primary_decision"), F.coalesce("bounces", F.filter("bounces", lambda _: F.lit(False)), F.array().cast(jobs.schema["bounces"].dataType.simpleString())).alias("bounces"),
        F.coalesce("inout.decisions", F.array().cast(jobs.schema["inout"].dataType["decisions"].dataType.simpleString())).alias("decisions"), F.coalesce("artifacts", empty_map).alias("artifacts"), "error")
