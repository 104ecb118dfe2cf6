"""Plane geometry as column expressions.

A point is struct<x double, y double>; a ring is an array of points that closes by itself.  Nothing here needs Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcline.functions.numeric import clamp, rounded

#: Tolerances in pixels, and the names of decisions and reasons.
TOLERANCE = 3.0
PARALLEL, SAME_POINT, ON_SIDE = 1e-9, 1e-4, 1e-6
IN, OUT, UNKNOWN = "IN", "OUT", "UNKNOWN"
ON_LINE, INSIDE, OUTSIDE = "on_line", "inside_polygon", "outside_polygon"
SAME, OPPOSITE, NO_SIDE = "same_side_as_inside_point", "opposite_side_from_inside_point", "invalid_side_reference"

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, so that nested shapes don't repeat each other's expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column | float, y: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))


def point_of(pair: Column) -> Column:
    """A point from a two-element array; null unless there are two."""
    return F.when(F.size(pair) == 2, point(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))


def ring(*points: Column) -> Column:
    return F.array(*points)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def cross(p: Column, a: Column, b: Column) -> Column:
    """Which side of a -> b: the cross product without a length."""
    return (p["x"] - a["x"]) * (b["y"] - a["y"]) - (p["y"] - a["y"]) * (b["x"] - a["x"])


def signed_distance(p: Column, a: Column, b: Column) -> Column:
    """Signed distance to the line through a and b; null where they are one point."""
    return F.try_divide(cross(p, a, b), distance(b, a))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance to the segment a b; to the point where both are one."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    along = F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy)
    t = clamp(F.coalesce(along, F.lit(0.0)), 0.0, 1.0)
    return F.hypot(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


def edges(r: Column) -> Column:
    """The edges of a ring as structs (a, b), the last of them closing it."""
    turned = F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.zip_with(r, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_ring(p: Column, r: Column) -> Column:
    """Even-odd rule; an edge counts from its lower end up to, not including, its upper one."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = F.try_divide((b["x"] - a["x"]) * (p["y"] - a["y"]), b["y"] - a["y"]) + a["x"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < at)

    return F.aggregate(edges(r), F.lit(False), lambda odd, e: odd != F.coalesce(crosses(e), F.lit(False)))


def ring_distance(p: Column, r: Column) -> Column:
    """Distance to the nearest edge; infinite for a ring without points."""
    return F.coalesce(F.array_min(F.transform(edges(r), lambda e: segment_distance(p, e["a"], e["b"]))), F.lit(float("inf")))


def _verdict(decision: Column | str, reason: Column | str, boundary: Column, signed: Column | None) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = F.lit(None).cast("double")
    return F.struct(text(decision).alias("decision"), text(reason).alias("decision_reason"), boundary.alias("boundary_distance_px"), (none if signed is None else signed).alias("signed_distance_px"))


def judge_ring(p: Column, r: Column, tolerance: Column | float = TOLERANCE) -> Column:
    """IN on the boundary within ``tolerance`` or inside, else OUT, with the distance to the boundary."""
    far = ring_distance(p, r)
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    return F.when(far <= tol, _verdict(IN, ON_LINE, far, None)).when(in_ring(p, r), _verdict(IN, INSIDE, far, None)).otherwise(_verdict(OUT, OUTSIDE, far, None))


def judge_side(p: Column, a: Column, b: Column, inside: Column, tolerance: Column | float = TOLERANCE) -> Column:
    """IN on the line within ``tolerance`` or on the side of ``inside``; UNKNOWN where that lies on the line itself."""
    own, ref = signed_distance(p, a, b), signed_distance(inside, a, b)
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    decision = F.when(F.abs(own) <= tol, IN).when((own == 0) | (ref == 0), UNKNOWN).when((own > 0) == (ref > 0), IN).otherwise(OUT)
    reason = F.when(F.abs(own) <= tol, ON_LINE).when((own == 0) | (ref == 0), NO_SIDE).when((own > 0) == (ref > 0), SAME).otherwise(OPPOSITE)
    return _verdict(decision, reason, F.abs(own), own)


def judge_point(mode: Column, p: Column, r: Column, a: Column, b: Column, inside: Column, tolerance: Column | float = TOLERANCE) -> Column:
    """The verdict by a ring or a line, as ``mode`` says; null where ``judge_refusal`` has a reason."""
    verdict = F.when(mode == "polygon", judge_ring(p, r, tolerance)).when(mode == "line", judge_side(p, a, b, inside, tolerance))
    return F.when(judge_refusal(mode, p, r, a, b, inside).isNull(), verdict)


def judge_refusal(mode: Column, p: Column, r: Column, a: Column, b: Column, inside: Column) -> Column:
    """Why a point can't be judged: unsupported_mode, coordinates_missing, court_polygon_missing, line_points_missing or line_points_identical."""
    said = lambda case, reason: F.when(F.coalesce(case, F.lit(False)), reason)
    return F.coalesce(
        said(mode.isNull() | ~mode.isin("polygon", "line"), "unsupported_mode"), said(p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]), "coordinates_missing"),
        said((mode == "polygon") & r.isNull(), "court_polygon_missing"), said((mode == "line") & (a.isNull() | b.isNull() | inside.isNull()), "line_points_missing"), said((mode == "line") & (a == b), "line_points_identical"))


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the lines a b and c d meet; null for parallel ones."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    denom = ux * vy - uy * vx
    t = F.try_divide((c["x"] - a["x"]) * vy - (c["y"] - a["y"]) * vx, denom)
    return F.when(F.abs(denom) >= PARALLEL, point(a["x"] + t * ux, a["y"] + t * uy))


def in_padded_frame(p: Column, width: Column, height: Column, share: float = 0.08) -> Column:
    pad = F.greatest(width, height) * share
    return p["x"].between(-pad, width - 1.0 + pad) & p["y"].between(-pad, height - 1.0 + pad)


def joined_vertex(top: Column, top_vertex: Column, side: Column, side_vertex: Column, width: Column, height: Column) -> Column:
    """The corner of two lines: their crossing if it lies in the padded frame and near both ends, else the ends' midpoint."""
    near = F.greatest(F.lit(32.0), distance(top_vertex, side_vertex) * 4.0)
    good = lambda p: p.isNotNull() & in_padded_frame(p, width, height) & (distance(p, top_vertex) <= near) & (distance(p, side_vertex) <= near)
    middle = point((top_vertex["x"] + side_vertex["x"]) * 0.5, (top_vertex["y"] + side_vertex["y"]) * 0.5)
    return let(crossing(top, top_vertex, side, side_vertex), lambda p: F.when(good(p), p).otherwise(middle))


def border_distance(p: Column, width: Column, height: Column) -> Column:
    return F.least(p["x"], p["y"], width - 1.0 - p["x"], height - 1.0 - p["y"])


def border_first(a: Column, b: Column, width: Column, height: Column) -> Column:
    """struct(border, vertex): the end nearer to the frame's border first, ``a`` on a tie."""
    straight = border_distance(a, width, height) <= border_distance(b, width, height)
    return F.struct(F.when(straight, a).otherwise(b).alias("border"), F.when(straight, b).otherwise(a).alias("vertex"))


def perimeter_position(p: Column, width: Column, height: Column) -> Column:
    """Clockwise way along the frame from its first corner to the nearest edge's point; ties go top, right, bottom, left."""
    right, bottom = width - 1.0, height - 1.0
    to = [F.abs(p["y"]), F.abs(right - p["x"]), F.abs(bottom - p["y"]), F.abs(p["x"])]
    least = F.least(*to)
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(top, v))
    return (F.when(to[0] == least, inside(p["x"], right)).when(to[1] == least, right + inside(p["y"], bottom))
            .when(to[2] == least, right + bottom + inside(right - p["x"], right)).otherwise(right + bottom + right + inside(bottom - p["y"], bottom)))


def frame_ring(width: Column, height: Column) -> Column:
    return ring(point(0.0, 0.0), point(width - 1.0, 0.0), point(width - 1.0, height - 1.0), point(0.0, height - 1.0))


def clockwise_arc(a: Column, b: Column, width: Column, height: Column) -> Column:
    """From a to b clockwise along the frame; corners on the way stand in the order of the frame's corners, not of travel."""
    right, bottom = width - 1.0, height - 1.0
    around = 2.0 * (right + bottom)
    at = F.array(F.lit(0.0), right, right + bottom, right + bottom + right)
    turns = F.flatten(F.zip_with(frame_ring(width, height), at, lambda c, s: F.array(F.struct(c.alias("c"), s.alias("s")), F.struct(c.alias("c"), (s + around).alias("s")))))
    span = F.struct(perimeter_position(a, width, height).alias("begin"), perimeter_position(b, width, height).alias("end"))
    stop = lambda v: F.when(v["end"] < v["begin"], v["end"] + around).otherwise(v["end"])
    met = let(span, lambda v: F.transform(F.filter(turns, lambda t: (v["begin"] < t["s"]) & (t["s"] < stop(v))), lambda t: t["c"]))
    return F.concat(F.array(a), met, F.array(b))


def upper_arc(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Of both ways along the frame from a to b the higher one by mean y, clockwise on a tie."""
    both = F.struct(clockwise_arc(a, b, width, height).alias("one"), F.reverse(clockwise_arc(b, a, width, height)).alias("other"))
    mean_y = lambda r: F.aggregate(r, F.lit(0.0), lambda s, p: s + p["y"]) / F.greatest(F.size(r), F.lit(1))
    return let(both, lambda v: F.when(mean_y(v["one"]) <= mean_y(v["other"]), v["one"]).otherwise(v["other"]))


def border_hits(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Where the line a b meets the frame, up to four points, in the order left, right, top, bottom; corners may come twice."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    right, bottom = width - 1.0, height - 1.0

    def upright(x: Column) -> Column:
        y = a["y"] + F.try_divide(x - a["x"], dx) * dy
        return F.when((F.abs(dx) > PARALLEL) & y.between(0.0, bottom), point(x, y))

    def level(y: Column) -> Column:
        x = a["x"] + F.try_divide(y - a["y"], dy) * dx
        return F.when((F.abs(dy) > PARALLEL) & x.between(0.0, right), point(x, y))

    return F.filter(F.array(upright(F.lit(0.0)), upright(right), level(F.lit(0.0)), level(bottom)), lambda p: p.isNotNull())


def distinct_points(points: Column, near: float = SAME_POINT) -> Column:
    """Greedy: a point stays unless one that stays is nearer than ``near``."""
    return F.aggregate(points, F.array().cast(RING), lambda kept, p: F.when(F.exists(kept, lambda k: distance(p, k) < near), kept).otherwise(F.concat(kept, F.array(p))))


def farthest_pair(points: Column) -> Column:
    """The two points farthest apart, the first pair on a tie, as an array; null below two points.  For a handful of points."""
    pairs = F.flatten(F.transform(points, lambda a, i: F.transform(F.filter(points, lambda b, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    best = let(pairs, lambda v: first_best(v, lambda x: -distance(x["a"], x["b"])))
    return F.when(F.size(points) >= 2, let(best, lambda x: F.array(x["a"], x["b"])))


def by_y_then_x(points: Column) -> Column:
    keyed = F.array_sort(F.transform(points, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    return F.transform(keyed, lambda q: point(q["x"], q["y"]))


def frame_chord(a: Column, b: Column, width: Column, height: Column) -> Column:
    """The line's two farthest distinct points on the frame, by (y, x); null where it does not cross."""
    return let(distinct_points(border_hits(a, b, width, height)), lambda v: by_y_then_x(farthest_pair(v)))


def clip_to_side(r: Column, a: Column, b: Column, positive: Column) -> Column:
    """What of a ring lies on one side of the line a b, points nearer than 1e-4 to the one before dropped."""
    sided = F.transform(r, lambda p: F.struct(p.alias("p"), signed_distance(p, a, b).alias("side")))
    keep = lambda e: F.when(positive, e["side"] >= -ON_SIDE).otherwise(e["side"] <= ON_SIDE)

    def cut(e: Column, f: Column) -> Column:
        p, q, denom = e["p"], f["p"], e["side"] - f["side"]
        along = let(F.try_divide(e["side"], denom), lambda t: point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t))
        return F.when(F.abs(denom) < PARALLEL, q).otherwise(along)

    none = F.array().cast(RING)
    before = lambda v: F.concat(F.slice(v, -1, 1), F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))))
    part = lambda e, f: F.when(keep(f), F.when(keep(e), F.array(f["p"])).otherwise(F.array(cut(e, f), f["p"]))).otherwise(F.when(keep(e), F.array(cut(e, f))).otherwise(none))
    parts = let(sided, lambda v: F.zip_with(before(v), v, part))
    apart = F.aggregate(F.flatten(parts), none, lambda kept, p: F.when((F.size(kept) == 0) | (distance(p, F.element_at(kept, -1)) > SAME_POINT), F.concat(kept, F.array(p))).otherwise(kept))
    closed = lambda v: (F.size(v) > 1) & (distance(F.get(v, F.lit(0)), F.get(v, F.size(v) - 1)) < SAME_POINT)
    return let(apart, lambda v: F.when(closed(v), F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))).otherwise(v))


def scaled(p: Column, sx: Column, sy: Column) -> Column:
    return point(p["x"] * sx, p["y"] * sy)


def rounded_point(p: Column, places: int) -> Column:
    return point(rounded(p["x"], places), rounded(p["y"], places))


def mean_point(points: Column) -> Column:
    total = F.aggregate(points, point(0.0, 0.0), lambda s, p: point(s["x"] + p["x"], s["y"] + p["y"]))
    return point(F.try_divide(total["x"], F.size(points)), F.try_divide(total["y"], F.size(points)))


def fitted_line(points: Column) -> Column:
    """struct(direction, origin, error): total least squares through the centroid, with the root mean square distance."""
    def around(centre: Column) -> Column:
        moment = F.aggregate(
            points, F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy"), F.lit(0.0).alias("yy")),
            lambda s, p: F.struct((s["xx"] + (p["x"] - centre["x"]) * (p["x"] - centre["x"])).alias("xx"), (s["xy"] + (p["x"] - centre["x"]) * (p["y"] - centre["y"])).alias("xy"), (s["yy"] + (p["y"] - centre["y"]) * (p["y"] - centre["y"])).alias("yy")))
        angle = let(moment, lambda m: 0.5 * F.atan2(2.0 * m["xy"], m["xx"] - m["yy"]))
        return let(angle, lambda t: along(centre, point(F.cos(t), F.sin(t))))

    def along(centre: Column, direction: Column) -> Column:
        square = F.aggregate(points, F.lit(0.0), lambda s, p: s + F.pow((p["x"] - centre["x"]) * direction["y"] - (p["y"] - centre["y"]) * direction["x"], F.lit(2.0)))
        return F.struct(direction.alias("direction"), centre.alias("origin"), F.sqrt(square / F.size(points)).alias("error"))

    return let(mean_point(points), around)


def line_distance(p: Column, line: Column) -> Column:
    """Distance to a line (direction, origin) with a direction of length 1."""
    d, o = line["direction"], line["origin"]
    return F.abs((p["x"] - o["x"]) * d["y"] - (p["y"] - o["y"]) * d["x"])


def ring_area(r: Column) -> Column:
    return F.abs(F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2.0


def literal_ring(points: list[tuple[float, float]]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def first_best(items: Column, key) -> Column:
    """The element with the smallest ``key(element)``, the first on a tie; null for none."""
    keyed = lambda v: F.transform(v, lambda x: F.struct(key(x).alias("k"), x.alias("x")))
    rest = lambda v: F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1)))
    return let(keyed(items), lambda v: F.aggregate(rest(v), F.get(v, F.lit(0)), lambda best, x: F.when(x["k"] < best["k"], x).otherwise(best)))["x"]
