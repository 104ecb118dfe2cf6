"""Court lines from fiducial markers: a row per image, its markers an array of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcline.functions import geometry as G
from arcline.operators.refusals import first_of

#: The families that a decoder may be asked for.
FAMILIES = ("tag16h5", "tag25h9", "tag36h10", "tag36h11")


def marker(marker_id: Column, corners: Column) -> Column:
    """A marker's centre, side lengths and area from its four corners."""
    sides = F.transform(G.edges(corners), lambda e: G.distance(e["a"], e["b"]))
    return G.let(sides, lambda s: F.struct(
        marker_id.cast("int").alias("id"), G.mean_point(corners).alias("center"), corners.alias("corners"),
        (F.aggregate(s, F.lit(0.0), lambda t, x: t + x) / F.size(s)).alias("side_px_mean"), F.array_min(s).alias("side_px_min"), F.array_max(s).alias("side_px_max"), G.ring_area(corners).alias("area_px")))


def measured(detected: DataFrame, min_side_px: float = 0.0) -> DataFrame:
    """From (image, width, height, detected: array<struct<id, corners>>) to markers of ``min_side_px`` or more, by (id, y, x), numbered from 1."""
    made = F.filter(F.transform("detected", lambda m: marker(m["id"], m["corners"])), lambda m: m["side_px_min"] >= min_side_px)
    keyed = F.array_sort(F.transform(made, lambda m: F.struct(m["id"].alias("a"), m["center"]["y"].alias("b"), m["center"]["x"].alias("c"), m.alias("m"))))
    numbered = F.transform(keyed, lambda k, i: F.struct(*[k["m"][n].alias(n) for n in ("id", "center", "corners", "side_px_mean", "side_px_min", "side_px_max", "area_px")], (i + 1).cast("int").alias("marker_index")))
    return detected.withColumn("markers", numbered).drop("detected")


def largest(markers: Column, n: int = 3) -> Column:
    """The n markers of the largest area, the first on a tie; null where there are fewer."""
    keyed = F.array_sort(F.transform(markers, lambda m, i: F.struct((-m["area_px"]).alias("a"), i.alias("i"), m.alias("m"))))
    return F.when(F.size(markers) >= n, F.transform(F.slice(keyed, 1, n), lambda k: k["m"]))


def corner_roles(markers: Column) -> Column:
    """struct(top_marker, side_marker, vertex, view_side): the lowest of the three largest is the vertex."""
    def assign(picked: Column) -> Column:
        numbered = F.transform(picked, lambda m, i: F.struct(i.alias("i"), m.alias("m")))
        vertex = G.first_best(numbered, lambda k: -k["m"]["center"]["y"])
        return G.let(vertex, lambda v: G.let(F.transform(F.filter(numbered, lambda k: k["i"] != v["i"]), lambda k: k["m"]), lambda rest: ends(v["m"], rest)))

    def ends(vertex: Column, rest: Column) -> Column:
        both = F.struct(G.first_best(rest, lambda m: m["center"]["y"]).alias("t"), G.first_best(rest, lambda m: -m["center"]["y"]).alias("s"))
        return G.let(both, lambda b: F.struct(b["t"].alias("top_marker"), b["s"].alias("side_marker"), vertex.alias("vertex"), F.when(b["t"]["center"]["x"] < b["s"]["center"]["x"], "left").otherwise("right").alias("view_side")))

    return G.let(largest(markers), lambda p: F.when(p.isNotNull(), assign(p)))


def line_roles(markers: Column, line_ids: tuple[int, int] | None = None) -> Column:
    """struct(line_marker_top, line_marker_bottom, inside_marker).

    With ``line_ids`` those markers (the last of a repeated id) make the line and the largest other one is inside; else the pair
    of the three largest that stands most upright, the third being inside.  Null where markers are missing.
    """
    def roles(a: Column, b: Column, inside: Column) -> Column:
        swap = b["center"]["y"] < a["center"]["y"]
        return F.when(a.isNotNull() & b.isNotNull() & inside.isNotNull(), F.struct(F.when(swap, b).otherwise(a).alias("line_marker_top"), F.when(swap, a).otherwise(b).alias("line_marker_bottom"), inside.alias("inside_marker")))

    if line_ids is not None:
        by_id = lambda k: F.try_element_at(F.filter(markers, lambda m: m["id"] == k), F.lit(-1))
        rest = F.filter(markers, lambda m: ~m["id"].isin(*line_ids))
        return F.when(F.size(markers) >= 3, G.let(F.struct(by_id(line_ids[0]).alias("a"), by_id(line_ids[1]).alias("b"), G.first_best(rest, lambda m: -m["area_px"]).alias("i")), lambda v: roles(v["a"], v["b"], v["i"])))
    item = lambda p, i: F.get(p, F.lit(i))
    upright = lambda a, b: F.abs(a["center"]["x"] - b["center"]["x"]) / (F.abs(a["center"]["y"] - b["center"]["y"]) + 1.0)
    pairs = lambda p: F.array(*[F.struct(item(p, i).alias("a"), item(p, j).alias("b"), item(p, k).alias("i")) for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 2, 0))])
    return G.let(largest(markers), lambda p: F.when(p.isNotNull(), G.let(G.first_best(pairs(p), lambda v: upright(v["a"], v["b"])), lambda v: roles(v["a"], v["b"], v["i"]))))


def markers_refusal(markers: Column, family: Column | None = None, line_ids: tuple[int, int] | None = None) -> Column:
    """Why markers give no roles: unknown_family, too_few_markers, line_marker_missing or inside_marker_missing."""
    there = lambda k: F.exists(markers, lambda m: m["id"] == k)
    cases = [(~F.coalesce(family.isin(*FAMILIES), F.lit(False)), "unknown_family")] if family is not None else []
    cases.append((F.coalesce(F.size(markers), F.lit(0)) < 3, "too_few_markers"))
    if line_ids is not None:
        cases += [(~(there(line_ids[0]) & there(line_ids[1])), "line_marker_missing"), (F.size(F.filter(markers, lambda m: ~m["id"].isin(*line_ids))) == 0, "inside_marker_missing")]
    return first_of(*cases)


def edge_pair(line_marker: Column, other_marker: Column, inside: Column, *, toward_other: bool, weight: float, slack: float = 3.0) -> Column:
    """Of the 16 pairs of the two markers' edges the outer one of those that fit a line well.

    The geometric score is the fit's error plus ``weight`` times how far the line turns from the way between the centres, or from the
    upright; of pairs within ``slack`` of the best score the one farthest from ``inside`` is taken, the first on a tie.
    Returns struct(direction, origin, first_edge, first_points, second_edge, second_points).
    """
    def direction_of() -> Column:
        dx, dy = other_marker["center"]["x"] - line_marker["center"]["x"], other_marker["center"]["y"] - line_marker["center"]["y"]
        n = F.hypot(dx, dy)
        return F.when(n < 1e-9, G.point(0.0, 1.0)).otherwise(G.point(F.try_divide(dx, n), F.try_divide(dy, n)))

    numbered = lambda m: F.transform(G.edges(m["corners"]), lambda e, i: F.struct(i.alias("i"), F.array(e["a"], e["b"]).alias("points")))

    def measured_pair(e: Column, f: Column, way: Column) -> Column:
        def with_line(line: Column) -> Column:
            d = line["direction"]
            turned = F.abs(d["x"] * way["y"] - d["y"] * way["x"]) if toward_other else F.abs(d["x"])
            return F.struct(
                (line["error"] + turned * weight).alias("score"), G.line_distance(inside["center"], line).alias("far"), d.alias("direction"), line["origin"].alias("origin"),
                e["i"].alias("first_edge"), e["points"].alias("first_points"), f["i"].alias("second_edge"), f["points"].alias("second_points"))

        return G.let(G.fitted_line(F.concat(e["points"], f["points"])), with_line)

    pairs = G.let(direction_of(), lambda way: F.flatten(F.transform(numbered(line_marker), lambda e: F.transform(numbered(other_marker), lambda f: measured_pair(e, f, way)))))
    good = lambda v: F.filter(v, lambda x: x["score"] <= F.array_min(F.transform(v, lambda y: y["score"])) + slack)
    return G.let(pairs, lambda v: G.first_best(good(v), lambda x: -x["far"]))


def _border(line: Column, width: Column, height: Column) -> Column:
    """The two farthest border points of a line (direction, origin), null where it does not cross the frame twice."""
    ahead = G.point(line["origin"]["x"] + line["direction"]["x"], line["origin"]["y"] + line["direction"]["y"])
    return G.farthest_pair(G.border_hits(line["origin"], ahead, width, height))


def corner_lines(images: DataFrame) -> DataFrame:
    """Two lines that share a vertex, for each image of three markers or more: (image, width, height, view_side, vertex_point, lines)."""
    r = F.col("_roles")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    staged = images.withColumn("_roles", corner_roles(F.col("markers"))).where(r.isNotNull())
    staged = staged.withColumn("_top", edge_pair(r["top_marker"], r["vertex"], r["side_marker"], toward_other=True, weight=20.0))
    staged = staged.withColumn("_side", edge_pair(r["side_marker"], r["vertex"], r["top_marker"], toward_other=True, weight=20.0))
    t, s = F.col("_top"), F.col("_side")
    ends = lambda x: F.array(x["second_edge"], (x["second_edge"] + 1) % 4)
    common = F.array_intersect(ends(t), ends(s))
    ahead = lambda x: G.point(x["origin"]["x"] + x["direction"]["x"], x["origin"]["y"] + x["direction"]["y"])
    met = G.crossing(t["origin"], ahead(t), s["origin"], ahead(s))
    middle = G.mean_point(F.array(G.mean_point(t["second_points"]), G.mean_point(s["second_points"])))
    vertex = F.when(F.size(common) == 1, F.get(r["vertex"]["corners"], F.get(common, F.lit(0)))).otherwise(G.let(met, lambda p: F.when(p.isNotNull() & G.in_padded_frame(p, w, h), p).otherwise(middle)))
    staged = staged.withColumn("_vertex", vertex)

    def line(name: str, x: Column) -> Column:
        v, end = F.col("_vertex"), G.mean_point(x["first_points"])

        def reached(border: Column) -> Column:
            along = lambda p: (p["x"] - v["x"]) * (end["x"] - v["x"]) + (p["y"] - v["y"]) * (end["y"] - v["y"])
            far = G.first_best(border, lambda p: -along(p))
            return F.when(border.isNotNull() & (G.distance(v, end) >= 1e-9), far).otherwise(end)

        return F.struct(F.lit(name).alias("name"), F.array(G.rounded_point(G.let(_border(x, w, h), reached), 2), G.rounded_point(v, 2)).alias("points"))

    return staged.select("image", "width", "height", r["view_side"].alias("view_side"), G.rounded_point(F.col("_vertex"), 2).alias("vertex_point"), F.array(line("top_to_vertex", t), line("side_to_vertex", s)).alias("lines"))


def upright_line(images: DataFrame, line_ids: tuple[int, int] | None = None, vertical_weight: float = 20.0) -> DataFrame:
    """One upright line for each image of three markers or more: (image, width, height, view_side, lines, inside_point)."""
    r = F.col("_roles")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    staged = images.withColumn("_roles", line_roles(F.col("markers"), line_ids)).where(r.isNotNull())
    staged = staged.withColumn("_edge", edge_pair(r["line_marker_top"], r["line_marker_bottom"], r["inside_marker"], toward_other=False, weight=vertical_weight))
    x = F.col("_edge")
    inner = F.array(G.mean_point(x["first_points"]), G.mean_point(x["second_points"]))
    staged = staged.withColumn("_ends", G.let(_border(x, w, h), lambda b: F.when(b.isNull(), F.transform(inner, lambda p: G.rounded_point(p, 2))).otherwise(G.by_y_then_x(b))))
    start, end = F.get("_ends", F.lit(0)), F.get("_ends", F.lit(1))
    side = G.cross(r["inside_marker"]["center"], start, end)
    line = F.struct(F.lit("view3_vertical_outer_line").alias("name"), F.transform("_ends", lambda p: G.rounded_point(p, 2)).alias("points"))
    return staged.select("image", "width", "height", F.when(side > 0, "left").otherwise("right").alias("view_side"), F.array(line).alias("lines"), r["inside_marker"]["center"].alias("inside_point"))
