"""Court configurations: choosing a record, and building its polygon from line records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.functions import geometry as G
from arcline.functions.numeric import blank_to_null, ratio, rounded
from arcline.functions.text import base_name
from arcline.operators.refusals import first_of

_PAIR = T.ArrayType(T.DoubleType())
_LINE = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(n, T.ArrayType(_PAIR)) for n in ("points", "extended_endpoints", "segment_endpoints")]])
#: Every optional key of a court configuration: ready ones, and line records.
RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("image", "mode", "view", "view_side", "layout")], T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()),
    T.StructField("image_shape_hwc", T.ArrayType(T.IntegerType())), T.StructField("lines", T.ArrayType(_LINE)), *[T.StructField(n, _PAIR) for n in ("vertex_point", "court_vertex", "view2_vertex_point", "inside_point", "line_start", "line_end")],
    T.StructField("roles", T.StructType([T.StructField("inside_marker", T.StructType([T.StructField("center", _PAIR)]))])), T.StructField("court_polygon", T.ArrayType(_PAIR)), T.StructField("view2_line_segments", T.ArrayType(T.ArrayType(_PAIR))), T.StructField("line_tolerance_px", T.DoubleType()),
])
RECORDS = T.ArrayType(RECORD)


def parse_configs(text: Column) -> Column:
    """Records of a JSON document; a bare object is a list of one."""
    return F.from_json(text, RECORDS)


def frame_size(r: Column) -> Column:
    """struct(width, height): its own, else from the image's shape (height first)."""
    shape = r["image_shape_hwc"]
    return F.struct(F.coalesce(r["width"], F.get(shape, F.lit(1)).cast("double")).alias("width"), F.coalesce(r["height"], F.get(shape, F.lit(0)).cast("double")).alias("height"))


def closest_by_size(records: Column, width: Column, height: Column) -> Column:
    """The record nearest to a size, aspect first; the first on a tie."""
    def far(r: Column) -> Column:
        return G.let(frame_size(r), lambda s: F.abs(ratio(s["width"], s["height"]) - ratio(width, height)) * 1000 + F.abs(s["width"] - width) + F.abs(s["height"] - height))

    return G.first_best(records, far)


def select_record(records: Column, image: Column, width: Column, height: Column, index: Column) -> Column:
    """By image name if one is asked for, else by size if that is known, else the only one, else by index; null where none fits."""
    name = blank_to_null(image)
    by_name = F.get(F.filter(records, lambda r: base_name(r["image"]) == base_name(name)), F.lit(0))
    by_size = closest_by_size(records, width, height)
    by_index = F.get(records, F.coalesce(index, F.lit(0)))
    return F.when(name.isNotNull(), by_name).when(width.isNotNull() & height.isNotNull(), by_size).when(F.size(records) == 1, F.get(records, F.lit(0))).otherwise(by_index)


def _sized(r: Column) -> Column:
    return F.coalesce(G.let(frame_size(r), lambda s: (s["width"] > 0) & (s["height"] > 0)), F.lit(False))


def selection_refusal(records: Column, image: Column, width: Column, height: Column, index: Column) -> Column:
    """Why ``select_record`` has no record: no_records, unknown_image, no_frame_size (of any, where the size decides) or index_out_of_range."""
    name, at = blank_to_null(image), F.coalesce(index, F.lit(0))
    by_size = width.isNotNull() & height.isNotNull()
    return first_of(
        (F.coalesce(F.size(records), F.lit(0)) == 0, "no_records"),
        (name.isNotNull(), F.when(~F.exists(records, lambda r: F.coalesce(base_name(r["image"]) == base_name(name), F.lit(False))), "unknown_image")),
        (name.isNull() & by_size, F.when(F.exists(records, lambda r: ~_sized(r)), "no_frame_size")),
        (name.isNull() & ~by_size & (F.size(records) != 1) & ((at < 0) | (at >= F.size(records))), "index_out_of_range"))


def record_refusal(r: Column) -> Column:
    """Why a line record makes no polygon, but for polygons that turn out too small."""
    lines, side = r["lines"], F.lower(r["view_side"])
    two, one = (r["view"] == "view2") | (r["mode"] == "view2"), (r["view"] == "view3") | (r["mode"] == "view3")
    lacks = lambda e: e["a"].isNull() | e["b"].isNull()
    missing = lambda v: first_of((v["top"].isNull() | v["side"].isNull(), "view2_lines_missing"), (G.let(line_ends(v["top"]), lacks) | G.let(line_ends(v["side"]), lacks), "line_needs_two_ends"))
    inside = F.coalesce(r["inside_point"], r["roles"]["inside_marker"]["center"])
    only = F.get(lines, F.lit(0))
    is_two, is_one = F.coalesce(two, F.lit(False)), F.coalesce(one, F.lit(False)) & ~F.coalesce(two, F.lit(False))
    return first_of(
        (~is_two & ~is_one, "unsupported_kind"), (~_sized(r), "no_frame_size"),
        (is_two, G.let(_two_lines(lines), missing)),
        (is_one & (F.coalesce(F.size(lines), F.lit(0)) != 1), "view3_needs_one_line"), (is_one & G.let(line_ends(only), lacks), "line_needs_two_ends"),
        (is_one & inside.isNotNull() & (F.size(inside) != 2), "bad_point"),
        (is_one & inside.isNull() & ~F.coalesce(side.isin("left", "right"), F.lit(False)), "view3_needs_a_side"), (is_one & G.let(line_ends(only), lambda e: e["a"] == e["b"]), "line_points_identical"))


def ready_refusal(r: Column) -> Column:
    """Why a polygon or line configuration that is given as such can't judge."""
    pair = lambda p: F.coalesce(F.size(p) == 2, F.lit(False))
    named = [r[n] for n in ("line_start", "line_end", "inside_point")]
    line = r["mode"] == "line"
    return first_of(
        ((r["mode"] == "polygon") & r["court_polygon"].isNull(), "court_polygon_missing"), ((r["mode"] == "polygon") & F.exists(r["court_polygon"], lambda p: ~pair(p)), "bad_point"),
        (line & (named[0].isNull() | named[1].isNull() | named[2].isNull()), "line_points_missing"), (line & ~(pair(named[0]) & pair(named[1]) & pair(named[2])), "bad_point"), (line & (named[0] == named[1]), "line_points_identical"))


def line_ends(line: Column) -> Column:
    """struct(a, b): the first of a line's lists of ends that is not empty."""
    some = lambda c: F.when(F.size(c) > 0, c)
    ends = lambda x: F.coalesce(some(x["points"]), some(x["extended_endpoints"]), some(x["segment_endpoints"]))
    both = lambda v: F.when(F.size(v) == 2, F.struct(G.point_of(F.get(v, F.lit(0))).alias("a"), G.point_of(F.get(v, F.lit(1))).alias("b")))
    return G.let(line, lambda x: G.let(ends(x), both))


def _two_lines(lines: Column) -> Column:
    """struct(top, side): the last lines of these names, or two lines in their order; null where they are missing."""
    found = lambda n: F.try_element_at(F.filter(lines, lambda x: x["name"] == n), F.lit(-1))
    named = F.struct(found("top_to_vertex").alias("top"), found("side_to_vertex").alias("side"))
    placed = F.when(F.size(lines) == 2, F.struct(F.get(lines, F.lit(0)).alias("top"), F.get(lines, F.lit(1)).alias("side")))
    return G.let(named, lambda v: F.when(v["top"].isNotNull() & v["side"].isNotNull(), v).otherwise(placed))


def _frames(r: Column, width: Column, height: Column) -> Column:
    """struct(width, height, own_width, own_height, sx, sy): the target frame, the record's own, and the ratios of the two."""
    size = frame_size(r)
    return F.struct(
        width.cast("double").alias("width"), height.cast("double").alias("height"), size["width"].alias("own_width"), size["height"].alias("own_height"),
        ratio(width, size["width"]).alias("sx"), ratio(height, size["height"]).alias("sy"))


def two_line_polygon(r: Column, width: Column, height: Column) -> Column:
    """struct(polygon, vertex) in the target frame from a record of two lines that meet in a corner; null where lines are missing.

    The polygon runs along the frame from one line's border end to the other's, the upper way, and through the corner.
    """
    given = F.coalesce(*[G.point_of(F.when(F.size(r[n]) > 0, r[n])) for n in ("vertex_point", "court_vertex", "view2_vertex_point")])

    def split(e: Column, f: Column) -> Column:
        return F.struct(*[G.let(G.border_first(e[k]["a"], e[k]["b"], f["own_width"], f["own_height"]), lambda x: F.struct(G.scaled(x["border"], f["sx"], f["sy"]).alias("border"), G.scaled(x["vertex"], f["sx"], f["sy"]).alias("vertex"))).alias(k) for k in ("top", "side")])

    def corner(s: Column, f: Column) -> Column:
        met = G.joined_vertex(s["top"]["border"], s["top"]["vertex"], s["side"]["border"], s["side"]["vertex"], f["width"], f["height"])
        vertex = G.let(given, lambda p: F.when(p.isNotNull(), G.scaled(p, f["sx"], f["sy"])).otherwise(met))
        return F.struct(s["top"]["border"].alias("top"), s["side"]["border"].alias("side"), vertex.alias("vertex"))

    def shape(c: Column, f: Column) -> Column:
        polygon = F.transform(F.concat(G.upper_arc(c["top"], c["side"], f["width"], f["height"]), F.array(c["vertex"])), lambda p: G.rounded_point(p, 3))
        return F.struct(polygon.alias("polygon"), G.rounded_point(c["vertex"], 3).alias("vertex"))

    def drawn(e: Column) -> Column:
        return G.let(_frames(r, width, height), lambda f: G.let(split(e, f), lambda s: G.let(corner(s, f), lambda c: shape(c, f))))

    ends = G.let(_two_lines(r["lines"]), lambda v: F.struct(line_ends(v["top"]).alias("top"), line_ends(v["side"]).alias("side")))
    return G.let(ends, lambda e: F.when(e["top"].isNotNull() & e["side"].isNotNull(), drawn(e)))


def one_line_polygon(r: Column, width: Column, height: Column) -> Column:
    """struct(polygon, line_start, line_end): the part of the target frame on the inside of a record's one line.

    The inside is the side of the record's inside point, else the left or right that it names; null where neither is there or fewer than three
    vertices are left.
    """
    inside = F.coalesce(r["inside_point"], r["roles"]["inside_marker"]["center"])

    def chord(e: Column, f: Column) -> Column:
        ends = F.struct(G.scaled(e["a"], f["sx"], f["sy"]).alias("a"), G.scaled(e["b"], f["sx"], f["sy"]).alias("b"))
        return G.let(ends, lambda s: F.coalesce(G.frame_chord(s["a"], s["b"], f["width"], f["height"]), G.by_y_then_x(F.array(s["a"], s["b"]))))

    def shape(c: Column, f: Column) -> Column:
        start, end = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        named = G.let(F.lower(r["view_side"]), lambda s: F.when(s == "left", True).when(s == "right", False))
        positive = G.let(G.let(inside, G.point_of), lambda p: F.when(p.isNotNull(), G.signed_distance(G.scaled(p, f["sx"], f["sy"]), start, end) >= 0).otherwise(named))
        polygon = G.let(positive, lambda p: F.when(p.isNotNull(), G.clip_to_side(G.frame_ring(f["width"], f["height"]), start, end, p)))
        made = lambda v: F.struct(F.transform(v, lambda p: G.rounded_point(p, 3)).alias("polygon"), G.rounded_point(start, 3).alias("line_start"), G.rounded_point(end, 3).alias("line_end"))
        return G.let(polygon, lambda v: F.when(F.size(v) >= 3, made(v)))

    def drawn(e: Column) -> Column:
        return G.let(_frames(r, width, height), lambda f: G.let(chord(e, f), lambda c: shape(c, f)))

    ends = line_ends(F.when(F.size(r["lines"]) == 1, F.get(r["lines"], F.lit(0))))
    return G.let(ends, lambda e: F.when(e.isNotNull(), drawn(e)))


def configured_segments(r: Column) -> Column:
    """Segments that a configuration brings with it, those of two points, as structs (a, b); empty where it has none."""
    both = F.filter(F.coalesce(r["view2_line_segments"], F.array().cast("array<array<array<double>>>")), lambda s: F.size(s) == 2)
    return F.transform(both, lambda s: F.struct(G.point_of(F.get(s, F.lit(0))).alias("a"), G.point_of(F.get(s, F.lit(1))).alias("b")))


def scaled_segments(r: Column, width: Column, height: Column) -> Column:
    """The lines of a record as segments in the target frame."""
    scaled = lambda e, f: F.struct(G.scaled(e["a"], f["sx"], f["sy"]).alias("a"), G.scaled(e["b"], f["sx"], f["sy"]).alias("b"))
    return G.let(_frames(r, width, height), lambda f: F.transform(r["lines"], lambda x: G.let(line_ends(x), lambda e: scaled(e, f))))


def corner_segments(polygon: Column) -> Column:
    """From a two-line record's polygon the segments from its two border ends, its first and last but one, to its corner, its last point."""
    at = lambda k: F.element_at(polygon, k)
    return F.array(F.struct(at(1).alias("a"), at(-1).alias("b")), F.struct(at(-2).alias("a"), at(-1).alias("b")))


def _dealt(configs: DataFrame) -> DataFrame:
    """``configs`` over all cores: they are few bytes and much work each, so a million of them in one small file would be one task or two."""
    spark = configs.sparkSession
    return configs.repartition(min(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "clip_id")


def normalize(configs: DataFrame) -> DataFrame:
    """From (clip_id, document, target_width, target_height, config_image, config_index) to what ``judge`` takes, a row per clip.

    A lone polygon or line configuration goes through as it is, never scaled; of records one is chosen and made into a polygon.  Where that fails
    ``mode`` is null and ``refused`` says why: unreadable_document, what ``selection_refusal``, ``record_refusal`` or ``ready_refusal`` give, or
    polygon_too_small.  ``segments`` are the lines to draw: those that the configuration brings, else the record's, else the line that judges.
    """
    configs = _dealt(configs)
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))  # noqa: E731  worked out once: filters on what follows would repeat it
    parsed = once(configs, "_records", parse_configs(F.col("document")))
    asked = [F.col(c) for c in ("config_image", "target_width", "target_height", "config_index")]
    lone = F.get("_records", F.lit(0))
    ready = F.coalesce(F.ltrim("document").startswith("{") & lone["mode"].isin("polygon", "line"), F.lit(False))
    chosen = once(parsed.withColumn("_ready", ready), "_r", F.when(F.col("_ready"), lone).otherwise(select_record(F.col("_records"), *asked)))
    r = F.col("_r")
    size = frame_size(r)
    width, height = F.coalesce("target_width", size["width"]), F.coalesce("target_height", size["height"])
    view = F.when((r["view"] == "view2") | (r["mode"] == "view2"), "view2_lines").when((r["view"] == "view3") | (r["mode"] == "view3"), "view3_lines")
    made = F.when(view == "view2_lines", two_line_polygon(r, width, height)["polygon"]).when(view == "view3_lines", one_line_polygon(r, width, height)["polygon"])
    shaped = once(chosen, "_polygon", F.when(F.col("_ready"), F.transform(r["court_polygon"], G.point_of)).otherwise(made))
    readable = F.try_parse_json("document").isNotNull() & F.col("_records").isNotNull()
    refused = F.when(~readable, "unreadable_document").when(F.col("_ready"), ready_refusal(r)).otherwise(F.coalesce(selection_refusal(F.col("_records"), *asked), record_refusal(r), F.when(F.col("_polygon").isNull(), "polygon_too_small")))
    told = once(shaped, "_refused", refused)
    own = F.struct(G.point_of(r["line_start"]).alias("a"), G.point_of(r["line_end"]).alias("b"))
    brought = configured_segments(r)
    drawn = F.when(view == "view2_lines", corner_segments(F.col("_polygon"))).otherwise(scaled_segments(r, width, height))
    segments = F.when(~F.col("_ready"), drawn).when(F.size(brought) > 0, brought).when(r["mode"] == "line", F.array(own)).otherwise(brought)
    return told.select(
        "clip_id", F.when(F.col("_refused").isNull(), F.when(F.col("_ready"), r["mode"]).otherwise("polygon")).alias("mode"), F.when(~F.col("_ready"), view).alias("source_mode"), F.col("_polygon").alias("court_polygon"), G.point_of(r["line_start"]).alias("line_start"), G.point_of(r["line_end"]).alias("line_end"),
        G.point_of(r["inside_point"]).alias("inside_point"), F.coalesce(F.when(F.col("_ready"), r["line_tolerance_px"]), F.lit(G.TOLERANCE)).alias("line_tolerance_px"), F.when(F.col("_refused").isNull(), segments).alias("segments"), F.col("_refused").alias("refused"))


def minimal_record(r: Column) -> Column:
    """A record with only image, size, view, side, and its lines' names and points; ``to_json`` leaves out names that are null."""
    none = F.array().cast("array<array<double>>")
    lines = F.transform(F.coalesce(r["lines"], F.array().cast(T.ArrayType(_LINE).simpleString())), lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["points"], none).alias("points")))
    return F.struct(F.coalesce(r["image"], F.lit("")).alias("image"), r["width"].alias("width"), r["height"].alias("height"), F.coalesce(blank_to_null(r["view"]), r["mode"]).alias("view"), r["view_side"].alias("view_side"), lines.alias("lines"))


def judge(bounces: DataFrame, courts: DataFrame, *, refused: str | None = None) -> DataFrame:
    """``bounces`` (clip_id, x, y and any others) with the decision by their clip's configuration: six columns more.

    Bounces of clips without one, or with one that could not be built, get nulls.  With ``refused`` a column of that name says why: no_config, what the
    configuration was refused for, or what ``geometry.judge_refusal`` gives.  Configurations are one row per clip and joined by clip; Spark
    broadcasts them while they are small.
    """
    p = G.point(F.col("x"), F.col("y"))
    named = courts.select("clip_id", *[F.col(c).alias(f"_{c}") for c in ("mode", "court_polygon", "line_start", "line_end", "inside_point", "line_tolerance_px")], F.lit(True).alias("_there"), (F.col("refused") if "refused" in courts.columns else F.lit(None).cast("string")).alias("_why"))
    joined = bounces.drop("judge_x", "judge_y", "decision", "decision_reason", "boundary_distance_px", "signed_distance_px", *([refused] if refused else [])).join(named, "clip_id", "left")
    shape = [F.col(f"_{c}") for c in ("court_polygon", "line_start", "line_end", "inside_point")]
    out = joined.withColumn("_v", G.judge_point(F.col("_mode"), p, *shape, F.col("_line_tolerance_px"))).withColumns({
        "judge_x": rounded(F.col("x"), 3), "judge_y": rounded(F.col("y"), 3), "decision": F.col("_v.decision"), "decision_reason": F.col("_v.decision_reason"),
        "boundary_distance_px": rounded(F.col("_v.boundary_distance_px"), 3), "signed_distance_px": rounded(F.col("_v.signed_distance_px"), 3)})
    if refused:
        out = out.withColumn(refused, F.coalesce(F.when(F.col("_there").isNull(), "no_config"), F.col("_why"), G.judge_refusal(F.col("_mode"), p, *shape)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])
