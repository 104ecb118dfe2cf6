"""The geometry as SQL functions of the session: Catalyst inlines them, no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PAIR = "struct<x:double,y:double>"
_VERDICT = "struct<decision:string,decision_reason:string,boundary_distance_px:double,signed_distance_px:double,refused:string>"
_EDGES = "zip_with(ring, concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1)), (a, b) -> struct(a as a, b as b))"


def _along(p: str, a: str, b: str) -> str:
    """The place of the point of a segment nearest to p, from 0 to 1."""
    return f"least(greatest(coalesce(try_divide(({p}.x - {a}.x) * ({b}.x - {a}.x) + ({p}.y - {a}.y) * ({b}.y - {a}.y), ({b}.x - {a}.x) * ({b}.x - {a}.x) + ({b}.y - {a}.y) * ({b}.y - {a}.y)), 0d), 0d), 1d)"


def _to_segment(p: str, a: str, b: str) -> str:
    return f"hypot({p}.x - ({a}.x + {_along(p, a, b)} * ({b}.x - {a}.x)), {p}.y - ({a}.y + {_along(p, a, b)} * ({b}.y - {a}.y)))"


_FUNCTIONS = {
    "plane_point(x double, y double)": (_PAIR, "struct(x as x, y as y)"),
    f"signed_line_distance(p {_PAIR}, a {_PAIR}, b {_PAIR})": ("double", "try_divide((p.x - a.x) * (b.y - a.y) - (p.y - a.y) * (b.x - a.x), hypot(b.x - a.x, b.y - a.y))"),
    f"segment_distance(p {_PAIR}, a {_PAIR}, b {_PAIR})": ("double", _to_segment("p", "a", "b")),
    f"point_in_ring(p {_PAIR}, ring array<{_PAIR}>)": ("boolean", f"""
        aggregate({_EDGES}, false, (odd, e) -> odd <> coalesce(((e.a.y > p.y) <> (e.b.y > p.y)) and p.x < try_divide((e.b.x - e.a.x) * (p.y - e.a.y), e.b.y - e.a.y) + e.a.x, false))"""),
    f"ring_distance(p {_PAIR}, ring array<{_PAIR}>)": ("double", f"""
        coalesce(array_min(transform({_EDGES}, e -> {_to_segment("p", "e.a", "e.b")})), double('infinity'))"""),
    f"judge_ring(p {_PAIR}, ring array<{_PAIR}>, tolerance double)": ("string", """
        case when ring_distance(p, ring) <= tolerance then 'IN' when point_in_ring(p, ring) then 'IN' else 'OUT' end"""),
    f"judge_side(p {_PAIR}, a {_PAIR}, b {_PAIR}, inside {_PAIR}, tolerance double)": ("string", """
        case when abs(signed_line_distance(p, a, b)) <= tolerance then 'IN'
             when signed_line_distance(p, a, b) = 0 or signed_line_distance(inside, a, b) = 0 then 'UNKNOWN'
             when (signed_line_distance(p, a, b) > 0) = (signed_line_distance(inside, a, b) > 0) then 'IN' else 'OUT' end"""),
    f"judge_point(mode string, p {_PAIR}, ring array<{_PAIR}>, a {_PAIR}, b {_PAIR}, inside {_PAIR}, tolerance double)": (_VERDICT, """
        case when coalesce(mode, '') not in ('polygon', 'line') then named_struct('decision', null, 'decision_reason', null, 'boundary_distance_px', null, 'signed_distance_px', null, 'refused', 'unsupported_mode')
             when p.x is null or p.y is null then named_struct('decision', null, 'decision_reason', null, 'boundary_distance_px', null, 'signed_distance_px', null, 'refused', 'coordinates_missing')
             when mode = 'polygon' and ring is null then named_struct('decision', null, 'decision_reason', null, 'boundary_distance_px', null, 'signed_distance_px', null, 'refused', 'court_polygon_missing')
             when mode = 'line' and (a is null or b is null or inside is null) then named_struct('decision', null, 'decision_reason', null, 'boundary_distance_px', null, 'signed_distance_px', null, 'refused', 'line_points_missing')
             when mode = 'line' and a = b then named_struct('decision', null, 'decision_reason', null, 'boundary_distance_px', null, 'signed_distance_px', null, 'refused', 'line_points_identical')
             when mode = 'polygon' then named_struct('decision', judge_ring(p, ring, tolerance),
                 'decision_reason', case when ring_distance(p, ring) <= tolerance then 'on_line' when point_in_ring(p, ring) then 'inside_polygon' else 'outside_polygon' end,
                 'boundary_distance_px', ring_distance(p, ring), 'signed_distance_px', null, 'refused', null)
             else named_struct('decision', judge_side(p, a, b, inside, tolerance),
                 'decision_reason', case when abs(signed_line_distance(p, a, b)) <= tolerance then 'on_line'
                     when signed_line_distance(p, a, b) = 0 or signed_line_distance(inside, a, b) = 0 then 'invalid_side_reference'
                     when (signed_line_distance(p, a, b) > 0) = (signed_line_distance(inside, a, b) > 0) then 'same_side_as_inside_point' else 'opposite_side_from_inside_point' end,
                 'boundary_distance_px', abs(signed_line_distance(p, a, b)), 'signed_distance_px', signed_line_distance(p, a, b), 'refused', null) end"""),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session and return their names."""
    for head, (kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.partition("(")[0] for head in _FUNCTIONS]
