"""Recordings are listed by their headers, and of a clip only its own ranges are read."""

from __future__ import annotations

import io

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from arcline.sources import frames


def y4m(n, width=4, height=2, rate="30:1", space="420jpeg", each=12):
    head = f"YUV4MPEG2 W{width} H{height} F{rate} Ip A1:1 C{space}\n".encode()
    return head + b"".join(b"FRAME\n" + bytes([k % 256]) * each for k in range(n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    for name, data in {"a.y4m": y4m(1000), "b.y4m": y4m(40, 3, 3, "25:2", "mono", 9) + b"FRAME\nxx", "c.y4m": b"RIFF....", "d.y4m": b"YUV4MPEG2 W0 H9 F30:1\n", "e.y4m": y4m(0)}.items():
        (root / name).write_bytes(data)
    return root


def test_recordings_are_told_from_their_headers(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in frames.recordings(spark, f"{folder}/*.y4m").collect()}
    assert got["a.y4m"] == (1000, 30.0, 4, 2, 1000 / 30, None) and got["b.y4m"] == (40, 12.5, 3, 3, 3.2, None)
    assert got["c.y4m"][-1] == "video_unreadable" and got["d.y4m"][-1] == "video_size_unreadable" and got["e.y4m"] == (0, 30.0, 4, 2, 0.0, "no_frames")


def test_frames_of_all_files(spark, folder):
    df = frames.read_frames(spark, f"{folder}/*.y4m", frames=100)
    rows = df.collect()
    assert len(rows) == 1040 and df.rdd.getNumPartitions() == 11
    assert all(bytes(r.content) == bytes([r.frame_index % 256]) * (12 if r.width == 4 else 9) for r in rows)
    assert all(r.time_sec == r.frame_index / (30 if r.width == 4 else 12.5) for r in rows)


def test_filters_cut_the_ranges(spark, folder):
    df = frames.read_frames(spark, f"{folder}/*.y4m", frames=100)
    some = df.where("frame_index >= 250 AND frame_index < 260 AND content IS NOT NULL")
    assert some.rdd.getNumPartitions() == 1 and sorted(r.frame_index for r in some.collect()) == list(range(250, 260))
    name = next(r.path for r in df.where("width = 3").limit(1).collect())
    assert df.where(f"path = '{name}'").rdd.getNumPartitions() == 1 and df.where(f"path = '{name}'").count() == 40
    assert df.where("frame_index = 999").count() == 1 and df.where("frame_index > 5000").count() == 0


def test_a_clip_reads_its_own_bytes_only(spark, folder):
    clip = frames.read_clip(spark, f"{folder}/a.y4m", 0.05, 0.25)
    assert sorted((r.frame_index, r.content[0]) for r in clip.collect()) == [(k, k + 2) for k in range(6)]  # 1.5 and 7.5 go to even
    with pytest.raises(ValueError, match="empty_clip_range"):
        frames.read_clip(spark, f"{folder}/a.y4m", 2.0, 2.0)
    with pytest.raises(ValueError, match="video_unreadable"):
        frames.read_clip(spark, f"{folder}/c.y4m", 0.0, 1.0)


def test_a_counter_of_what_is_read():
    data, read, opened = y4m(1000), [], []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            out = super().read(n)
            read.append(len(out))
            return out

        def size(self):
            return len(data)

    def opener(path):
        opened.append(path)
        return Counting(data)

    reader = frames.FrameReader(["x", "y", "z"], 64, opener)
    rest = list(reader.pushFilters([GreaterThanOrEqual(("frame_index",), 500), LessThan(("frame_index",), 700), In(("path",), ("x", "y")), EqualTo(("path",), "x"), IsNotNull(("content",))]))
    assert [type(f) for f in rest] == [IsNotNull]
    parts = reader.partitions()
    assert [(p.begin, p.end) for p in parts] == [(500, 564), (564, 628), (628, 692), (692, 700)] and opened == ["x"]
    read.clear()
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[1] for r in rows] == list(range(500, 700))
    assert sum(read) <= 200 * 18 + 4 * frames.LONGEST_HEADER < len(data)


def test_a_frame_out_of_place_is_an_error():
    data = bytearray(y4m(5))
    data[data.index(b"FRAME\n") + 18] = 0
    class File(io.BytesIO):
        def size(self):
            return len(data)

    reader = frames.FrameReader(["x"], 10, lambda _: File(bytes(data)))
    with pytest.raises(ValueError, match="frame 1"):
        list(reader.read(reader.partitions()[0]))
