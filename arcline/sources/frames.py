"""Frames of uncompressed YUV4MPEG2 recordings (.y4m) as a Spark source: tasks get ranges of frames, and filters on frames and files cut the ranges.

The format has a text header and then, for each frame, the line ``FRAME`` and planes of a size that the header tells, so a frame's place in its file is
known without reading what is before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from arcline.functions.numeric import nearest_int

#: Bytes of all planes for each pixel, by the header's colour space.
BYTES_PER_PIXEL = {"420": 1.5, "420jpeg": 1.5, "420mpeg2": 1.5, "420paldv": 1.5, "422": 2.0, "444": 3.0, "mono": 1.0}
MARK = b"FRAME\n"
LONGEST_HEADER = 1024
INFO = "path string, frame_count int, fps double, width int, height int, duration_sec double, refused string"


@dataclass(frozen=True)
class Layout:
    """Where a recording's frames are."""

    width: int
    height: int
    fps: float
    first: int
    frame_bytes: int

    def frames(self, length: int) -> int:
        """Whole frames of a file of so many bytes; one that was cut off at the end doesn't count."""
        return max(0, length - self.first) // (len(MARK) + self.frame_bytes)

    def offset(self, frame: int) -> int:
        return self.first + frame * (len(MARK) + self.frame_bytes)


def layout(head: bytes) -> Layout | str:
    """The layout that a file's first bytes tell, or why there is none: video_unreadable or video_size_unreadable."""
    line, found, _ = head.partition(b"\n")
    if not found or not line.startswith(b"YUV4MPEG2"):
        return "video_unreadable"
    tags = {t[:1]: t[1:] for t in line.decode("ascii", "replace").split(" ")[1:] if t}
    size = [int(tags[k]) if re.fullmatch(r"\d+", tags.get(k, "")) else 0 for k in "WH"]
    if min(size) <= 0:
        return "video_size_unreadable"
    rate = re.fullmatch(r"(\d+):(\d+)", tags.get("F", ""))
    space = tags.get("C", "420")
    if space not in BYTES_PER_PIXEL:
        return "video_unreadable"
    planes = {1.5: size[0] * size[1] + 2 * ((size[0] + 1) // 2) * ((size[1] + 1) // 2), 2.0: size[0] * size[1] + 2 * ((size[0] + 1) // 2) * size[1]}
    each = planes.get(BYTES_PER_PIXEL[space], int(size[0] * size[1] * BYTES_PER_PIXEL[space]))
    fps = int(rate[1]) / int(rate[2]) if rate and int(rate[2]) else 0.0
    return Layout(size[0], size[1], fps, len(line) + 1, each)


def open_file(path: str) -> BinaryIO:
    """A file that can be read from any place, in any store that Arrow knows."""
    if re.match(r"[a-z0-9+.-]+:", path):
        store, inner = pyarrow.fs.FileSystem.from_uri(path)
    else:
        store, inner = pyarrow.fs.LocalFileSystem(), path
    return store.open_input_file(inner)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of ``path`` (a file, folder or pattern): INFO, from its header and length alone; ``refused`` tells why the rest is null."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents are not read

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for name, length in zip(batch["path"], batch["length"], strict=True):
                with open_file(name) as f:
                    found = layout(f.read(LONGEST_HEADER))
                if isinstance(found, str):
                    rows.append((name, None, None, None, None, None, found))
                else:
                    n = found.frames(int(length))
                    rows.append((name, n, found.fps, found.width, found.height, n / found.fps if found.fps > 0 else 0.0, None if n else "no_frames"))
            yield pd.DataFrame(rows, columns=["path", "frame_count", "fps", "width", "height", "duration_sec", "refused"]).astype(object)

    return files.mapInPandas(run, INFO)


@dataclass
class FrameRange(InputPartition):
    path: str
    begin: int
    end: int


class FrameReader(DataSourceReader):
    """Reads (path, frame_index, time_sec, width, height, content) of the frames that the pushed filters leave."""

    def __init__(self, paths: list[str], each: int, opener: Callable[[str], BinaryIO] = open_file) -> None:
        self.paths, self.each, self.opener = paths, each, opener
        self.least, self.most, self.only = 0, 1 << 31, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name is Spark's
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("frame_index",) and isinstance(f, EqualTo):
                self.least, self.most = max(self.least, value), min(self.most, value + 1)
            elif column == ("frame_index",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, value + isinstance(f, GreaterThan))
            elif column == ("frame_index",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.most = min(self.most, value + isinstance(f, LessThanOrEqual))
            elif column == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> list[FrameRange]:
        out = []
        for path in self.paths:
            if self.only is not None and path not in self.only:
                continue
            with self.opener(path) as f:
                found = layout(f.read(LONGEST_HEADER))
                if isinstance(found, str):
                    raise ValueError(f"{found}: {path}")
                n = found.frames(f.size())
            begin, end = max(0, self.least), min(n, self.most)
            out += [FrameRange(path, b, min(b + self.each, end)) for b in range(begin, end, self.each)]
        return out

    def read(self, part: FrameRange) -> Iterator[tuple]:
        if part is None:  # nothing is left to read
            return
        with self.opener(part.path) as f:
            found = layout(f.read(LONGEST_HEADER))
            f.seek(found.offset(part.begin))
            for k in range(part.begin, part.end):
                if f.read(len(MARK)) != MARK:
                    raise ValueError(f"frame {k} doesn't begin where it should: {part.path}")
                yield part.path, k, k / found.fps if found.fps > 0 else 0.0, found.width, found.height, f.read(found.frame_bytes)


class FrameSource(DataSource):
    """``spark.read.format("y4m")`` with ``path`` (several lines for several files) and ``frames``, the frames of a task at most."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return "path string, frame_index int, time_sec double, width int, height int, content binary"

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader([p for p in self.options["path"].split("\n") if p], int(self.options.get("frames", 256)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def read_frames(spark: SparkSession, path: str, *, frames: int = 256) -> DataFrame:
    """The frames of all readable files of ``path``, listed and measured in tasks; filters on frame_index and path cut what is opened and read."""
    register(spark)
    listed = sorted(r["path"] for r in recordings(spark, path).where("refused IS NULL").select("path").collect())  # names of files
    return spark.read.format("y4m").option("path", "\n".join(listed)).option("frames", frames).load()


def read_clip(spark: SparkSession, path: str, start_sec: float, end_sec: float) -> DataFrame:
    """The frames of one recording from ``start_sec`` to ``end_sec``, numbered from 0; times are rounded to frames, halves to even.  An empty range is an error."""
    info = recordings(spark, path).select("path", "frame_count", "refused", F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("rate"))
    info = info.withColumns({"begin": F.greatest(F.lit(0), nearest_int(F.lit(float(start_sec)) * F.col("rate"))), "end": F.least("frame_count", nearest_int(F.lit(float(end_sec)) * F.col("rate")))}).first()
    if info is None or info.refused:
        raise ValueError(f"{info.refused if info else 'video_unreadable'}: {path}")
    if info.end <= info.begin:
        raise ValueError(f"empty_clip_range: {path}")
    register(spark)
    own = spark.read.format("y4m").option("path", info.path).load().where((F.col("frame_index") >= int(info.begin)) & (F.col("frame_index") < int(info.end)))
    return own.withColumn("frame_index", F.col("frame_index") - int(info.begin))
