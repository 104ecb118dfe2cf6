"""Strings: labels, failure names, file names and dates in text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcline.functions.numeric import blank_to_null

#: Parts of messages, in order of precedence, and the failures that they mean.
UNREADABLE = ("could not open video", "clip range is empty", "clip has no readable frames", "no frames were written to clip")
NO_CONFIG = "court config"
FAILURES = ("video_unreadable", "line_config_unavailable", "processing_error")
#: Colours (blue, green, red) of decisions.
COLOURS = {"IN": (0, 210, 0), "OUT": (0, 0, 255), "UNKNOWN": (0, 220, 255)}


def bounce_label(decision: Column) -> Column:
    return F.concat(F.upper(decision), F.lit(" BOUNCE"))


def banner(decision: Column, bounce_frame: Column, distance_text: Column, any_bounce: Column) -> Column:
    """The status line of a frame: the visible event's decision, frame and distance; NO BOUNCE only in clips without events."""
    far = F.coalesce(F.concat(F.lit("  dist="), blank_to_null(distance_text), F.lit("px")), F.lit(""))
    return F.when(decision.isNotNull(), F.concat(F.upper(decision), F.lit("  frame="), bounce_frame.cast("string"), far)).when(~any_bounce, F.lit("NO BOUNCE"))


def is_in(decision: Column) -> Column:
    """True for IN, false for OUT, null for the rest."""
    return F.when(F.upper(decision).isin("IN", "OUT"), F.upper(decision) == "IN")


def failure(message: Column) -> Column:
    """The failure that an error message means."""
    low = F.lower(message)
    unreadable = F.lit(False)
    for part in UNREADABLE:
        unreadable = unreadable | low.contains(part)
    return F.when(unreadable, FAILURES[0]).when(low.contains(NO_CONFIG), FAILURES[1]).otherwise(FAILURES[2])


def detection_issue(has_bounce: Column, has_config: Column, has_inout: Column, has_decision: Column) -> Column:
    """struct(failure_type, failure_reason), of nulls where nothing is wrong."""
    kind = F.when(~has_bounce, "detection_unavailable").when(~has_config, "line_config_unavailable").when(has_inout & ~has_decision, "detection_unavailable")
    reason = F.when(~has_bounce, "ball_bounce_not_detected").when(~has_config, "court_config_missing").when(has_inout & ~has_decision, "inout_decision_not_available")
    return F.struct(kind.alias("failure_type"), reason.alias("failure_reason"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_url(path: Column, root: Column) -> Column:
    return F.concat(F.lit("/files/"), F.ltrim(F.replace(path, root, F.lit("")), F.lit("/")))


def recorded_at(at: Column, date: Column, session_at: Column, created_at: Column) -> Column:
    """Given time, else given date at midnight, else the session's time, else its creation; as ISO text."""
    return F.coalesce(blank_to_null(at), F.concat(blank_to_null(date), F.lit("T00:00:00")), blank_to_null(session_at), created_at)


def first_number(*columns: Column) -> Column:
    """The first that reads as a number."""
    return F.coalesce(*[blank_to_null(c.cast("string")).try_cast("double") for c in columns])


def colour(decision: Column) -> Column:
    known = F.create_map(*[x for k, v in COLOURS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    return F.coalesce(F.try_element_at(known, F.upper(F.coalesce(decision, F.lit("UNKNOWN")))), F.array(*[F.lit(c) for c in COLOURS["UNKNOWN"]]))


def as_json(value: Column) -> Column:
    """A nested value as JSON with its nulls and empty lists kept and letters beyond ASCII as they are; null for null."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def utc_now() -> Column:
    """The time as ISO text with microseconds and its offset from UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
