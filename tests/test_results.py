"""Nested results, their JSON, job folders, and what is drawn of a court."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from arcline.functions import text
from arcline.operators import courts, jobs, overlay, records
from arcline.sources import tables


def test_json_keeps_nulls(spark):
    df = spark.sql("SELECT named_struct('a', cast(null AS int), 'b', array(), 'c', named_struct('d', 'é'), 'e', map('k', cast(null AS string))) AS v UNION ALL SELECT null")
    made = [r[0] for r in df.select(text.as_json(F.col("v"))).collect()]
    assert json.loads(made[0]) == {"a": None, "b": [], "c": {"d": "é"}, "e": {"k": None}} and "é" in made[0] and made[1] is None


def test_variants_of_any_shape(spark):
    rows = spark.createDataFrame([("1", '{"a": {"b": 2}}', "[1, null]", "not json"), ("2", None, '"x"', "{}")], "job_id string, primary_bounce_json string, primary_decision_json string, job_result_json string")
    got = records.as_variants(rows).orderBy("job_id")
    assert got.columns == ["job_id", "primary_bounce", "primary_decision", "job_result"]
    first, second = got.select(F.try_variant_get("primary_bounce", "$.a.b", "int"), F.try_variant_get("primary_decision", "$[0]", "int"), F.col("job_result").isNull()).collect()
    assert tuple(first) == (2, 1, True) and tuple(second) == (None, None, False)


def test_the_time_is_iso_text(spark):
    from datetime import UTC, datetime

    stamp = spark.range(1).select(text.utc_now()).first()[0]
    assert len(stamp) == 32 and abs((datetime.fromisoformat(stamp) - datetime.now(UTC)).total_seconds()) < 60


def test_of_artifacts_of_one_name_the_last_step_counts(spark):
    rows = [("a", 0, "clip", "x"), ("a", 2, "clip", "z"), ("a", 1, "clip", "y"), ("a", 0, "csv", "c"), ("a", 5, "csv", None), ("b", 0, "v", None)]
    got = jobs.merged_artifacts(spark.createDataFrame(rows, "clip_id string, step int, name string, url string")).collect()
    assert {r.clip_id: r.artifacts for r in got} == {"a": {"clip": "z", "csv": "c"}}


def test_segments_of_each_kind_of_configuration(spark):
    docs = {
        "two": [{"view": "view2", "width": 100, "height": 100, "vertex_point": [50, 60], "lines": [{"name": "side_to_vertex", "points": [[0, 30], [49, 59]]}, {"name": "top_to_vertex", "points": [[51, 61], [20, 0]]}]}],
        "one": [{"view": "view3", "width": 100, "height": 100, "view_side": "left", "lines": [{"points": [[40, 0], [60, 99]]}]}],
        "given": {"mode": "polygon", "court_polygon": [[0, 0], [9, 0], [9, 9]], "view2_line_segments": [[[1, 2], [3, 4]], [[1, 2]]]}, "bare": {"mode": "polygon", "court_polygon": [[0, 0], [9, 0], [9, 9]]},
        "line": {"mode": "line", "line_start": [0.5, 1.5], "line_end": [2.5, 3], "inside_point": [9, 9]}, "bad": [],
    }
    rows = [(k, json.dumps(v), 200.0, 50.0, None, None) for k, v in docs.items()]
    settings = courts.normalize(spark.createDataFrame(rows, "clip_id string, document string, target_width double, target_height double, config_image string, config_index int"))
    frames = spark.createDataFrame([(k, i) for k in [*docs, "none"] for i in range(2)], "clip_id string, frame_index int")
    got = {(r.clip_id, r.frame_index): r for r in overlay.with_court(frames, settings).collect()}
    drawn = lambda k: got[k, 1].segments and [(*s.a, *s.b) for s in got[k, 1].segments] if got[k, 1].segments is not None else None
    assert len(got) == 14
    assert drawn("two") == [(40, 0, 100, 30), (0, 15, 100, 30)] and drawn("one") == [(80, 0, 120, 50)]
    assert drawn("given") == [(1, 2, 3, 4)] and drawn("bare") == [] and drawn("line") == [(0, 2, 2, 3)] and drawn("bad") is None and drawn("none") is None
    assert got["line", 0].polygon is None and len(got["bare", 0].polygon) == 3 and got["bad", 0].polygon is None


def test_a_job_is_found_by_its_folder(spark, tmp_path):
    for session, job in (("s1", "j1"), ("s1", "j2"), ("s 2", "j3"), ("s2", "j[4]")):
        folder = tmp_path / session / "jobs" / job
        folder.mkdir(parents=True)
        (folder / "job.json").write_text(json.dumps({"job_id": job}, indent=2))
    every = {(r.session_id, r.job_id): json.loads(r.document)["job_id"] for r in tables.job_documents(spark, str(tmp_path)).collect()}
    assert set(every) == {("s1", "j1"), ("s1", "j2"), ("s 2", "j3"), ("s2", "j[4]")} and all(v == k[1] for k, v in every.items())
    found = tables.find_job(spark, str(tmp_path), "j3")
    assert [(r.session_id, r.job_id) for r in found.collect()] == [("s 2", "j3")] and len(found.inputFiles()) == 1
    assert tables.find_job(spark, str(tmp_path), "j[4]").count() == 1 and tables.find_job(spark, str(tmp_path), "j*").count() == 0
    assert tables.job_documents(spark, str(tmp_path), session_id="s1").count() == 2


def test_sessions_are_partitions(spark, tmp_path):
    root = str(tmp_path / "jobs")
    rows = spark.createDataFrame([("s1", "j1", None), ("s1", "j2", "done"), ("s2", "j3", "done")], "session_id string, job_id string, status string")
    tables.write_jobs(rows, root)
    tables.write_jobs(rows.where("job_id = 'j3'").withColumn("status", F.lit("late")), root)
    read = tables.read_jobs_by_session(spark, root, "job_id string, status string")
    assert sorted((r.session_id, r.job_id, r.status) for r in read.collect()) == [("s1", "j1", None), ("s1", "j2", "done"), ("s2", "j3", "late")]
    assert "PartitionFilters: [isnotnull(session_id" in read.where("session_id = 's2'")._jdf.queryExecution().executedPlan().toString()
    assert '"status":null' in "".join(p.read_text() for p in (tmp_path / "jobs").rglob("*.json"))
    latest = jobs.latest_job(read.withColumn("modified", F.col("job_id")).where("session_id = 's1'"))
    assert [r.job_id for r in latest.collect()] == ["j2"]
