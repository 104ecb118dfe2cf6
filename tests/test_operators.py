from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from arcline.operators import courts, jobs, markers, overlay, records, tracks
from arcline.plans.judgement import judge_clips
from arcline.sources import tables

TRACK = "clip_id string, frame_index int, x double, y double"


def track(spark, ys, clip="a"):
    return spark.createDataFrame([(clip, i, None if y is None else 500.0, None if y is None else float(y)) for i, y in enumerate(ys)], TRACK)


def test_one_bounce(spark):
    row = tracks.turning_points(track(spark, [100, 110, 120, 130, 120, 110, 100])).first()
    assert (row.frame_index, row.vy_before, row.vy_after, row.prominence, row.x_velocity_change, row.score) == (3, 10.0, -10.0, 30.0, 0.0, 30.5)


@pytest.mark.parametrize("gone", [0, 3, 6])
def test_no_bounce_without_its_frames(spark, gone):
    ys = [100, 110, 120, 130, 120, 110, 100]
    ys[gone] = None
    assert tracks.turning_points(track(spark, ys)).count() == 0


def test_blocks_of_frames_change_nothing(spark):
    ys = [200 - 8 * abs(i % 20 - 10) + (i * 7) % 5 for i in range(300)]
    whole = tracks.turning_candidates(track(spark, ys), block=100_000).orderBy("frame_index").collect()
    assert whole and whole == tracks.turning_candidates(track(spark, ys), block=16).orderBy("frame_index").collect()


def greedy(items, gap):
    kept = []
    for f, s in sorted(items, key=lambda x: (-x[1], x[0])):
        if all(abs(f - k) >= gap for k in kept):
            kept.append(f)
    return sorted(kept)


@pytest.mark.parametrize("items", [[(10, 20.0), (15, 30.0), (24, 25.0), (25, 20.0)], [(10, 20.0), (15, 20.0)], [(k * 3, float((k * 7) % 13)) for k in range(60)]])
def test_suppression(spark, items):
    c = spark.createDataFrame([("a", f, s) for f, s in items], "clip_id string, frame_index int, score double")
    assert sorted(r.frame_index for r in tracks.suppress(c, 10).collect()) == greedy(items, 10)


def test_first_box_on_a_tie(spark):
    d = spark.createDataFrame([("a", 0, 0, 0.9, 5.0, 0.0, 7.0, 2.0), ("a", 0, 0, 0.9, 1.0, 0.0, 3.0, 2.0), ("a", 0, 1, 0.95, 9.0, 9.0, 9.0, 9.0), ("a", 1, 0, 0.2, 1.0, 1.0, 1.0, 1.0)], "clip_id string, frame_index int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    rows = tracks.best_detection(d).collect()
    assert [(r.frame_index, r.x, r.y) for r in rows] == [(0, 2.0, 1.0)]


DOCUMENTS = [
    ("a", json.dumps([{"image": "p/a.png", "width": 1920, "height": 1080, "view": "view2", "lines": [{"name": "top_to_vertex", "points": [[600, 0], [1000, 600]]}, {"name": "side_to_vertex", "points": [[0, 800], [1000, 600]]}]}]), 1920.0, 1080.0),
    ("b", json.dumps({"image": "b.png", "width": 1000, "height": 800, "view": "view3", "view_side": "left", "lines": [{"name": "x", "points": [[400, 0], [600, 799]]}]}), 1000.0, 800.0),
    ("c", json.dumps({"mode": "polygon", "court_polygon": [[0, 0], [10, 0], [10, 10], [0, 10]]}), 5.0, 5.0),
    ("d", json.dumps({"mode": "line", "line_start": [0, 0], "line_end": [0, 100], "inside_point": [-10, 50], "line_tolerance_px": 1}), None, None),
    ("e", json.dumps([{"image": "e.png", "width": 10, "height": 10, "view": "view2", "lines": []}]), 10.0, 10.0),
]


def configs(spark):
    return spark.createDataFrame([(*d, None, None) for d in DOCUMENTS], "clip_id string, document string, target_width double, target_height double, config_image string, config_index int")


def test_configurations(spark):
    rows = {r.clip_id: r for r in courts.normalize(configs(spark)).collect()}
    ring = lambda k: [(p.x, p.y) for p in rows[k].court_polygon]
    assert ring("a") == [(600, 0), (0, 0), (0, 800), (1000, 600)] and rows["a"].source_mode == "view2_lines"
    assert ring("b") == [(400, 0), (999, 0), (999, 799), (600, 799)]
    assert ring("c") == [(0, 0), (10, 0), (10, 10), (0, 10)] and rows["c"].source_mode is None
    assert (rows["d"].mode, rows["d"].line_tolerance_px) == ("line", 1.0)
    assert rows["e"].mode is None


def test_configurations_are_dealt_out_and_looked_up_once(spark):
    """A file of many clips is a task or two by its bytes; and lines looked up in a record aren't looked up again for each use."""
    assert courts.normalize(configs(spark).coalesce(1)).rdd.getNumPartitions() == 4
    r, size = F.col("r"), F.lit(100.0)
    assert str(courts.two_line_polygon(r, size, size)).count("top_to_vertex") == 1
    assert str(courts.record_refusal(r)).count("top_to_vertex") == 1
    assert str(courts.one_line_polygon(r, F.col("wide"), size)).count("wide") <= 2


def test_judging_by_each_clips_own_configuration(spark):
    bounces = spark.createDataFrame([("a", 300.0, 300.0), ("a", 1200.0, 300.0), ("a", 1001.0, 600.0), ("d", 10.0, 50.0), ("e", 1.0, 1.0), ("z", 1.0, 1.0)], "clip_id string, x double, y double")
    got = {(r.clip_id, r.x): (r.decision, r.boundary_distance_px, r.signed_distance_px) for r in courts.judge(bounces, courts.normalize(configs(spark))).collect()}
    assert got["a", 300.0] == ("IN", 300.0, None) and got["a", 1001.0] == ("IN", 1.0, None) and got["a", 1200.0] == ("OUT", 332.82, None)
    assert got["d", 10.0] == ("OUT", 10.0, 10.0) and got["e", 1.0] == (None, None, None) == got["z", 1.0]


def test_the_whole_judgement(spark):
    ys = [100, 110, 120, 130, 120, 110, 100]
    boxes = spark.createDataFrame([("c", i, 0, 0.8, 4.0, y - 2.0, 6.0, y + 2.0) for i, y in enumerate(ys)], "clip_id string, frame_index int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    clips = spark.createDataFrame([("c", 8, 30.0, 150.0), ("e", 3, 30.0, 0.0)], "clip_id string, frames int, fps double, clip_start_sec double")
    out = judge_clips(boxes, clips, configs(spark).where("clip_id = 'c'"))
    rows = {r.clip_id: r for r in out.summary.collect()}
    c, e = rows["c"], rows["e"]
    assert (c.frames, c.detected, c.missing, c.bounce_count, c.result, round(c.confidence, 5), c.primary_decision.decision, c.failure_type) == (8, 7, 1, 1, "bounce_detected", 0.20333, "OUT", None)
    assert (e.result, e.confidence, e.failure_type, e.failure_reason, e.inout_status) == ("unknown", 0.0, "detection_unavailable", "ball_bounce_not_detected", None)
    assert round(jobs.bounce_view(out.bounces).first().recording_time_sec, 3) == 150.1


def test_marker(spark):
    images = spark.createDataFrame([("i", 100, 100, [(3, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])])], "image string, width int, height int, detected array<struct<id:int,corners:array<struct<x:double,y:double>>>>")
    m = markers.measured(images).first().markers[0]
    assert (tuple(m.center), m.side_px_mean, m.side_px_min, m.side_px_max, m.area_px, m.marker_index) == ((5.0, 5.0), 10.0, 10.0, 10.0, 100.0, 1)


def square(k, x, y, r=10.0):
    return (k, [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)])


def test_lines_from_markers(spark):
    schema = "image string, width int, height int, detected array<struct<id:int,corners:array<struct<x:double,y:double>>>>"
    images = spark.createDataFrame([("i", 1000, 800, [square(1, 300, 100), square(2, 800, 300), square(3, 500, 700)]), ("few", 1000, 800, [square(1, 300, 100)])], schema)
    measured = markers.measured(images)
    rows = markers.corner_lines(measured).collect()
    assert [(r.image, r.view_side, [x.name for x in r.lines]) for r in rows] == [("i", "left", ["top_to_vertex", "side_to_vertex"])]
    assert all(tuple(x.points[1]) == tuple(rows[0].vertex_point) for x in rows[0].lines)
    upright = markers.upright_line(measured).collect()
    assert len(upright) == 1 and [p.y for p in upright[0].lines[0].points] == sorted(p.y for p in upright[0].lines[0].points)
    chosen = markers.upright_line(measured, line_ids=(1, 3)).first()
    assert tuple(chosen.inside_point) == (800.0, 300.0)


def test_nearest_bounce(spark):
    frames = spark.createDataFrame([("a", f) for f in range(25)], "clip_id string, frame_index int")
    bounces = spark.createDataFrame([("a", 10, 1.0), ("a", 16, 2.0)], "clip_id string, frame_index int, score double")
    got = {r.frame_index: r.bounce_frame for r in overlay.nearest_bounce(frames, bounces, 4).collect()}
    assert (got[13], got[14], got[5], got[6]) == (10, 16, None, 10)


@pytest.mark.parametrize(("press", "use_end", "offset", "expected"), [(None, False, 0.5, ("video_end", 9.5, 9.5, False)), (12.0, False, 0.0, ("request", 12.0, 10.0, True)), (3.0, True, 0.0, ("video_end", 10.0, 10.0, False))])
def test_pressed_at(spark, press, use_end, offset, expected):
    df = spark.createDataFrame([(10.0, press, use_end, offset)], "d double, p double, u boolean, o double")
    assert tuple(df.select(jobs.pressed_at(*map(F.col, "dpuo")).alias("v")).first()["v"]) == expected


def record(spark, *rows):
    values = [tuple(r.get(c) for c in records.COLUMNS) for r in rows]
    return spark.createDataFrame(values, ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in records.COLUMNS))


def test_upsert_twice_is_once(spark):
    base = dict(id="1", job_id="j", created_at="t1", recorded_at="2026-01-02T00", match_type="singles", decision="IN", decision_reason="x", job_result_json="{}")
    again = base | dict(id="2", created_at="t2", decision="OUT", decision_reason=None)
    one = records.upsert(record(spark), record(spark, base))
    two = records.upsert(one, record(spark, again))
    r = two.first()
    assert two.count() == 1 and (r.id, r.created_at, r.decision, r.decision_reason) == ("1", "t1", "OUT", None)
    assert records.upsert(two, record(spark, again)).collect() == two.collect()
    bad = records.violations(record(spark, base | dict(match_type="mixed", decision=None))).first()
    assert sorted(bad.violated) == ["decision", "match_type"]
    assert records.listed(two, limit=-1).count() == 1 and records.listed(two, decision="IN").count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.033333, 1.005, None, "detected", 0.98765), (1, 0.066667, None, None, "missing", 0.0)], "frame_index int, time_sec double, x double, y double, status string, score double")
    written = tables.as_written(df, tables.TRACK)
    tables.write_csv(written, str(tmp_path / "track"), [c for c, _ in tables.TRACK])
    back = tables.read_csv(spark, str(tmp_path / "track"), [c for c, _ in tables.TRACK]).orderBy("frame_index").collect()
    assert [tuple(r) for r in back] == [("0", "0.0333", "1.0", None, "detected", "0.9877"), ("1", "0.0667", None, None, "missing", "0.0")]
    (tmp_path / "bom.csv").write_bytes("﻿frame_index,x,y,judge_x,judge_y,decision\n3,1,2,,,\n,1,2,,,IN\nx,1,2,,,IN\n4,q,2,7,8,OUT\n".encode())
    rows = tables.load_bounces(tables.read_csv(spark, str(tmp_path / "bom.csv"), ["frame_index", "x", "y", "judge_x", "judge_y", "decision"])).collect()
    assert [(r.frame_index, r.x, r.y, r.decision) for r in rows] == [(3, 1.0, 2.0, "UNKNOWN"), (4, 7.0, 8.0, "OUT")]


def test_requests_stream_into_the_table_once(spark, tmp_path):
    from arcline.streaming.requests import request_stream, upsert_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"job_id": j, "session_id": "s"}) for j in ("a", "b", "a")))
    versions: list[str] = []
    current = lambda: tables.read_records(spark, versions[-1]) if versions else record(spark)
    fixed = {"id": F.col("job_id"), "job_id": F.col("job_id"), "match_type": F.lit("singles"), "decision": F.lit("IN")}
    to_records = lambda r: r.select(*[fixed.get(c, F.lit(None if c == "confidence" else "x").cast("double" if c == "confidence" else "string")).alias(c) for c in records.COLUMNS])
    for _ in range(2):
        upsert_stream(request_stream(spark, str(tmp_path / "in")), to_records, current, str(tmp_path / "table"), versions.append, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(r.job_id for r in current().collect()) == ["a", "b"] and len(versions) == 1


def test_nan_confidence_is_no_detection(spark):
    rows = [(1, 0, 0, float("nan"), 0.0, 0.0, 2.0, 2.0), (1, 0, 0, 0.5, 4.0, 4.0, 6.0, 6.0), (1, 1, 0, None, 0.0, 0.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "clip_id int, frame_index int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert [(r.frame_index, r.x) for r in tracks.best_detection(df).collect()] == [(0, 5.0)]


def test_the_last_of_repeated_frames_wins(spark):
    from arcline.sources import tables

    rows = spark.createDataFrame([("3", "1", "1"), ("4", "2", "2"), ("3", "9", "9"), ("3", "", "5"), ("x", "1", "1")], "frame_index string, x string, y string").coalesce(1)
    assert sorted((r.frame_index, r.x) for r in tables.load_track(rows).collect()) == [(3, 9.0), (4, 2.0)]


def test_empty_clip_ranges_are_named(spark):
    from arcline.operators import jobs

    clips = spark.createDataFrame([("a", "r", 0.0, 0.1, 30.0, 9), ("b", "r", 2.0, 1.0, 30.0, 90), ("c", "r", 1.0, 2.0, 30.0, 9)], "clip_id string, recording_id string, start_sec double, end_sec double, fps double, total int")
    frames = spark.createDataFrame([("r", i) for i in range(9)], "recording_id string, frame_index int")
    assert sorted((r.clip_id, r.frame_index) for r in jobs.clip_frames(frames, clips).collect()) == [("a", 0), ("a", 1), ("a", 2)]
    assert sorted(r.clip_id for r in jobs.empty_clips(clips).collect()) == ["b", "c"]


def test_repeated_jobs_of_an_upsert_give_one_record(spark):
    from arcline.operators import records

    schema = "id string, job_id string, created_at string, decision string"
    table = spark.createDataFrame([("r1", "j1", "2026-01-01", "IN")], schema)
    new = spark.createDataFrame([("n1", "j1", "2026-01-02", "OUT"), ("n2", "j1", "2026-01-03", "UNKNOWN"), ("n3", "j2", "2026-01-02", "IN"), ("n3", "j2", "2026-01-02", "IN")], schema)
    assert sorted(tuple(r) for r in records.upsert(table, new).select("id", "job_id", "created_at", "decision").collect()) == [("n3", "j2", "2026-01-02", "IN"), ("r1", "j1", "2026-01-01", "UNKNOWN")]


def scored(rows):
    return [(f"c{c}", f, float(s)) for c, f, s in rows]


@pytest.mark.parametrize(("rounds", "block", "gap"), [(3, 4096, 10), (1, 20, 10), (2, 64, 7), (3, 4096, 1), (3, 30, 3), (0, 50, 10), (3, 4096, 0)])
def test_suppression_in_rounds_equals_taking_by_score(spark, rounds, block, gap):
    import random

    rng = random.Random(gap)
    rows = scored([(c, f, rng.randrange(6)) for c in range(12) for f in rng.sample(range(300), rng.randrange(150))])
    rows += scored([(99, f, f) for f in range(400)] + [(98, f, -f) for f in range(0, 500, 3)] + [(97, f, 1) for f in range(300)] + [(96, -f, f % 7) for f in range(100)])
    c = spark.createDataFrame([(*r, r[1] * 2.0) for r in rows], "clip_id string, frame_index int, score double, x double").repartition(3)
    kept = tracks.suppress(c, gap, rounds, block).collect()
    want = {(k, f) for k in {r[0] for r in rows} for f in greedy([r[1:] for r in rows if r[0] == k], gap)}
    assert {(r.clip_id, r.frame_index) for r in kept} == want and len(kept) == len(want) and all(r.x == r.frame_index * 2 for r in kept)


def test_of_rows_of_one_frame_the_best_counts(spark):
    c = spark.createDataFrame([("a", 5, 1.0, 9.0), ("a", 5, 2.0, 8.0), ("a", 5, 2.0, 7.0), ("a", 5, 2.0, 7.0), ("a", 40, None, 1.0)], "clip_id string, frame_index int, score double, x double")
    assert {(r.frame_index, r.x) for r in tracks.suppress(c, 10).collect()} == {(5, 7.0), (40, 1.0)}
    assert tracks.suppress(c.limit(0), 10).count() == 0


@pytest.mark.parametrize("kind", ["random", "rising"])
def test_a_dense_stretch_takes_time_in_proportion(spark, kind):
    import time

    def seconds(n):
        score = F.rand(3) if kind == "random" else F.col("id").cast("double")
        dense = spark.range(n).select(F.lit("a").alias("clip_id"), F.col("id").cast("int").alias("frame_index"), score.alias("score"))
        began = time.perf_counter()
        assert tracks.suppress(dense, 10).count() > n / 20
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 4 * seconds(50_000) + 2


def test_each_refusal_has_a_reason(spark):
    """A reason for each error that stops a configuration, the first in the order in which a reader would meet them."""
    line = {"name": "x", "points": [[400, 0], [600, 799]]}
    view3 = {"image": "b.png", "width": 1000, "height": 800, "view": "view3", "view_side": "left", "lines": [line]}
    view2 = {"image": "b.png", "width": 1000, "height": 800, "view": "view2", "lines": [line, line]}
    cases = [
        (None, None, None, None, "unreadable_document"), ("[{", None, None, None, "unreadable_document"), ([], None, None, None, "no_records"), ([view3], None, "c.png", None, "unknown_image"), ([view3], None, "x/b.png", 9, None),
        ([view3, {"image": "q"}], 100.0, None, None, "no_frame_size"), ([view3, view3], None, None, 2, "index_out_of_range"), ([view3, view3], None, None, -1, "index_out_of_range"), ([view3, view3], None, None, None, None), (view3, None, None, 7, None),
        (view3 | {"view": "x"}, None, None, None, "unsupported_kind"), (view3 | {"view": None, "mode": "view3"}, None, None, None, None), (view3 | {"width": None}, None, None, None, "no_frame_size"), (view3 | {"width": 0}, None, None, None, "no_frame_size"),
        (view3 | {"lines": []}, None, None, None, "view3_needs_one_line"), (view3 | {"lines": [{"name": "x", "points": [[1, 2]]}]}, None, None, None, "line_needs_two_ends"), (view3 | {"lines": [{"name": "x", "points": [[1], [2, 3]]}]}, None, None, None, "line_needs_two_ends"),
        (view3 | {"view_side": "up"}, None, None, None, "view3_needs_a_side"), (view3 | {"view_side": None}, None, None, None, "view3_needs_a_side"), (view3 | {"view_side": None, "inside_point": [1, 2]}, None, None, None, None), (view3 | {"inside_point": [1]}, None, None, None, "bad_point"),
        (view3 | {"lines": [{"name": "x", "points": [[5, 5], [5, 5]]}]}, None, None, None, "line_points_identical"), (view3 | {"lines": [{"name": "x", "points": [[-50, 0], [-50, 700]]}], "view_side": "left"}, None, None, None, None),
        (view3 | {"lines": [{"name": "x", "points": [[-50, 0], [-50, 700]]}], "view_side": "right"}, None, None, None, "polygon_too_small"),
        (view2, None, None, None, None), (view2 | {"lines": [line]}, None, None, None, "view2_lines_missing"), (view2 | {"lines": [line, {"name": "y"}]}, None, None, None, "line_needs_two_ends"),
        ({"mode": "polygon"}, None, None, None, "court_polygon_missing"), ({"mode": "polygon", "court_polygon": [[1, 2], [3]]}, None, None, None, "bad_point"), ({"mode": "polygon", "court_polygon": []}, None, None, None, None),
        ({"mode": "line", "line_start": [1, 2]}, None, None, None, "line_points_missing"), ({"mode": "line", "line_start": [1, 2], "line_end": [1, 2], "inside_point": [3, 4]}, None, None, None, "line_points_identical"),
    ]
    rows = [(i, c[0] if c[0] is None or isinstance(c[0], str) else json.dumps(c[0]), c[1], c[1], c[2], c[3]) for i, c in enumerate(cases)]
    got = courts.normalize(spark.createDataFrame(rows, "clip_id long, document string, target_width double, target_height double, config_image string, config_index int"))
    found = {r.clip_id: r for r in got.collect()}
    for i, c in enumerate(cases):
        assert found[i].refused == c[-1], (i, c, found[i])
        assert (found[i].mode is None) == (c[-1] is not None)


def test_refused_rows_are_set_apart_or_raised(spark):
    from arcline.operators import refusals

    settings = courts.normalize(configs(spark))
    good, bad = refusals.apart(settings)
    assert {r.clip_id for r in good.collect()} == {"a", "b", "c", "d"} and "refused" not in good.columns
    assert [(r.clip_id, r.refused) for r in bad.collect()] == [("e", "view2_lines_missing")]
    assert refusals.strict(settings.where("clip_id < 'e'"), "clip_id").count() == 4
    with pytest.raises(Exception, match="refused e: view2_lines_missing"):
        refusals.strict(settings, "clip_id").collect()


def test_the_judgement_says_what_it_refused(spark):
    ys = [100, 110, 120, 130, 120, 110, 100]
    box = "clip_id string, frame_index int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
    boxes = spark.createDataFrame([(c, i, 0, 0.8, 4.0, y - 2.0, 6.0, y + 2.0) for c in "cez" for i, y in enumerate(ys)], box)
    clips = spark.createDataFrame([(c, 8, 30.0, 0.0) for c in "cez"], "clip_id string, frames int, fps double, clip_start_sec double")
    mine = configs(spark).where("clip_id in ('c', 'e')")
    out = judge_clips(boxes, clips, mine)
    assert {(r.clip_id, r.stage, r.refused, r.n) for r in out.refused.collect()} == {("e", "config", "view2_lines_missing", 1), ("e", "bounce", "view2_lines_missing", 1)}
    assert {r.clip_id: r.decision for r in out.judged.collect()} == {"c": "OUT", "e": None, "z": None}
    with pytest.raises(Exception, match="view2_lines_missing"):
        judge_clips(boxes, clips, mine, strict=True).judged.collect()
    assert judge_clips(boxes, clips, mine.where("clip_id = 'c'"), strict=True).judged.count() == 3


def test_recordings_and_markers_say_why(spark):
    infos = spark.createDataFrame([(10, 30.0, 640, 360), (10, 30.0, 0, 360), (10, 30.0, 640, None), (0, 0.0, 640, 360), (None, None, None, None)], "n int, fps double, w int, h int")
    assert [r[0] for r in infos.select(jobs.recording_refusal(jobs.recording_info(F.col("n"), F.col("fps"), F.col("w"), F.col("h")))).collect()] == [None, "video_size_unreadable", "video_size_unreadable", "no_frames", "video_unreadable"]
    found = spark.createDataFrame([("tag36h11", [(1,), (2,), (3,)]), ("tag", [(1,), (2,), (3,)]), ("tag36h11", [(1,), (2,)]), ("tag36h11", [(1,), (4,), (3,)]), ("tag16h5", [(1,), (2,), (2,)]), (None, None)], "family string, m array<struct<id:int>>")
    assert [r[0] for r in found.select(markers.markers_refusal(F.col("m"), F.col("family"), (1, 2))).collect()] == [None, "unknown_family", "too_few_markers", "line_marker_missing", "inside_marker_missing", "unknown_family"]


def test_points_are_judged_or_refused_in_sql_too(spark):
    from arcline.functions import geometry as G
    from arcline.functions import sql

    sql.register(spark)
    square = "array(plane_point(0, 0), plane_point(100, 0), plane_point(100, 100), plane_point(0, 100))"
    rows = ["('polygon', plane_point(50, 50), {s}, null, null, null)", "('polygon', plane_point(102, 50), {s}, null, null, null)", "('line', plane_point(10, 50), null, plane_point(0, 0), plane_point(0, 100), plane_point(-10, 50))", "('line', plane_point(10, 50), null, plane_point(0, 0), plane_point(0, 0), plane_point(-10, 50))",
            "('line', plane_point(10, 50), null, plane_point(0, 0), null, plane_point(-10, 50))", "('polygon', plane_point(null, 50), {s}, null, null, null)", "('polygon', plane_point(1, 50), null, null, null, null)", "('oval', plane_point(1, 50), {s}, null, null, null)", "(null, plane_point(1, 50), {s}, null, null, null)"]
    kinds = ("string", G.POINT, G.RING, G.POINT, G.POINT, G.POINT)
    cast = ", ".join(f"CAST(t.{c} AS {kind}) AS {c}" for c, kind in zip("mprabi", kinds, strict=True))
    df = spark.sql(" UNION ALL ".join(f"SELECT {k} AS k, {cast} FROM (SELECT {row[1:-1].format(s=square)}) AS t(m, p, r, a, b, i)" for k, row in enumerate(rows)))
    columns = [F.col(c) for c in "mprabi"]
    got = df.select(F.expr("judge_point(m, p, r, a, b, i, 3d)").alias("sql"), G.judge_point(*columns).alias("v"), G.judge_refusal(*columns).alias("why"), "k").orderBy("k").collect()
    assert [r["sql"].refused for r in got] == [None, None, None, "line_points_identical", "line_points_missing", "coordinates_missing", "court_polygon_missing", "unsupported_mode", "unsupported_mode"]
    for r in got:
        assert r.why == r["sql"].refused
        assert tuple(r["sql"])[:4] == (tuple(r.v) if r.v else (None,) * 4)
