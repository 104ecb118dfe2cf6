from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arcline.functions import geometry as G
from arcline.functions import sql, text
from arcline.functions.numeric import rounded

SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("p", "expected"), [((50, 50), ("IN", "inside_polygon", 50.0)), ((102, 50), ("IN", "on_line", 2.0)), ((103, 50), ("IN", "on_line", 3.0)), ((104, 50), ("OUT", "outside_polygon", 4.0))])
def test_judge_ring(spark, p, expected):
    assert tuple(value(spark, G.judge_ring(G.point(*p), G.literal_ring(SQUARE))))[:3] == expected


@pytest.mark.parametrize(("p", "inside", "expected"), [
    ((10, 50), (-10, 50), ("OUT", "opposite_side_from_inside_point", 10.0, 10.0)), ((-10, 20), (-10, 50), ("IN", "same_side_as_inside_point", 10.0, -10.0)), ((10, 50), (0, 50), ("UNKNOWN", "invalid_side_reference", 10.0, 10.0))])
def test_judge_side(spark, p, inside, expected):
    assert tuple(value(spark, G.judge_side(G.point(*p), G.point(0, 0), G.point(0, 100), G.point(*inside)))) == expected


def test_a_ring_turned_judges_alike(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-20, 120), rng.uniform(-20, 120)) for _ in range(40)]
    df = spark.createDataFrame(points, "x double, y double")
    p = G.point(F.col("x"), F.col("y"))
    got = df.select(*[G.judge_ring(p, G.literal_ring(SQUARE[k:] + SQUARE[:k]))["decision"].alias(f"d{k}") for k in range(4)]).collect()
    assert all(len(set(r)) == 1 for r in got)


def test_rounding_is_half_even_on_the_binary_value(spark):
    rng = random.Random(5)
    values = [2.675, 0.125, 1.005, -0.001, 1e6 + 0.005] + [rng.uniform(-500, 500) for _ in range(200)] + [k / 8 for k in range(-20, 20)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (2, 3, 4):
        got = [r["r"] for r in df.select(rounded(F.col("v"), places).alias("r")).collect()]
        assert got == [round(v, places) + 0.0 for v in values]


def test_sql_functions_are_inlined(spark):
    sql.register(spark)
    df = spark.sql("SELECT judge_ring(plane_point(102, 50), array(plane_point(0, 0), plane_point(100, 0), plane_point(100, 100), plane_point(0, 100)), 3d) AS a, judge_side(plane_point(10, 50), plane_point(0, 0), plane_point(0, 100), plane_point(-10, 50), 3d) AS b")
    assert tuple(df.first()) == ("IN", "OUT")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_empty_ring_is_out(spark):
    r = value(spark, G.judge_ring(G.point(1, 1), F.array().cast(G.RING)))
    assert (r.decision, r.boundary_distance_px) == ("OUT", float("inf"))


@pytest.mark.parametrize(("message", "expected"), [("could not open video: a", "video_unreadable"), ("could not open source video: a", "processing_error"), ("Court config not found: a", "line_config_unavailable")])
def test_failures(spark, message, expected):
    assert value(spark, text.failure(F.lit(message))) == expected


def test_texts(spark):
    assert value(spark, text.recorded_at(F.lit(""), F.lit("2026-06-07"), F.lit(None).cast("string"), F.lit("c"))) == "2026-06-07T00:00:00"
    assert value(spark, text.banner(F.lit("in"), F.lit(7), F.lit("1.5"), F.lit(True))) == "IN  frame=7  dist=1.5px"
    assert value(spark, text.banner(F.lit(None).cast("string"), F.lit(None), F.lit(None).cast("string"), F.lit(False))) == "NO BOUNCE"
    assert value(spark, text.is_in(F.lit("UNKNOWN"))) is None
    assert value(spark, text.first_number(F.lit(""), F.lit("x"), F.lit("2.5"))) == 2.5
    assert list(value(spark, text.colour(F.lit("in")))) == [0, 210, 0]
