"""Detection on a stream equals detection in a batch, whatever the order and the batches."""

from __future__ import annotations

import json
import random

import pytest

from arcline.operators import tracks
from arcline.streaming import detection

CLIPS = {f"c{k}": [None if (i * 7 + k) % 13 == 0 else 200.0 - 8 * abs((i + 3 * k) % 20 - 10) + (i * 7) % 5 for i in range(40 + 9 * k)] for k in range(6)}


def rows():
    return [{"clip_id": c, "frame_index": i, "x": None if y is None else 500.0, "y": y} for c, ys in CLIPS.items() for i, y in enumerate(ys)]


def markers():
    return [{"clip_id": c, "expected": len(ys)} for c, ys in CLIPS.items()]


def write(folder, name, some):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in some))


@pytest.fixture(scope="module")
def want(spark):
    track = spark.createDataFrame([(r["clip_id"], r["frame_index"], r["x"], r["y"]) for r in rows()], "clip_id string, frame_index int, x double, y double")
    found = sorted(tuple(r) for r in tracks.turning_points(track).collect())
    assert len({r[0] for r in found}) == len(CLIPS)
    return found


def test_shuffled_files_and_a_restart_change_nothing(spark, tmp_path, want):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    every = rows() + markers() + [{"clip_id": None, "frame_index": 1}, {"clip_id": "none", "expected": 0}, {"clip_id": "half", "frame_index": 0, "x": 1.0, "y": 1.0}, {"clip_id": "half", "expected": 9}]
    random.Random(5).shuffle(every)
    parts = [every[k::5] for k in range(5)]

    def run():
        detection.detect_stream(detection.row_stream(spark, str(source), 1), out, checkpoint).awaitTermination()

    for k in (0, 1, 2):
        write(source, f"{k}.json", parts[k])
    run()
    before = spark.read.parquet(out).count() if any((tmp_path / "out").iterdir()) else 0
    for k in (3, 4):
        write(source, f"{k}.json", parts[k])
    run()  # the state of the first run is taken up
    write(source, "late.json", [{"clip_id": "c0", "frame_index": 1, "x": 9.0, "y": 9.0}])
    run()
    columns = ["clip_id", "frame_index", "time_sec", "x", "y", "score", "vy_before", "vy_after", "prominence", "x_velocity_change"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*columns).collect())
    assert got == want and before < len(want)
