"""Turning points of clips that arrive as a stream of track rows, in any order, a clip over several batches and files.

Rows wait in the state of their clip until its marker has come, which says how many rows the clip has, and all of them have; the whole clip then
goes through the batch functions, so windows and suppression see what they would see in a batch.  State is kept by Spark, across restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from arcline.operators.tracks import Detector, turning_points

#: A row of a track, or, with ``expected``, the marker of a clip: the number of its rows.  Missing frames have null x and y or no row.
ROW = "clip_id string, frame_index int, x double, y double, expected long"
CLIP = "clip_id string, frame_index int, x double, y double, complete boolean"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gather(StatefulProcessor):
    """Holds a clip's rows until they are all there, or until ``patience`` milliseconds after its marker (None: for ever)."""

    def __init__(self, patience: int | None) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "frame_index int, x double, y double")
        self.count = handle.getValueState("count", "n long, expected long, given boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names are Spark's
        n, expected, given = self.count.get() if self.count.exists() else (0, None, False)
        if given:  # what comes after a clip has gone out belongs to none
            return
        for some in rows:
            marker = some["expected"].notna()
            if marker.any():
                if expected is None and self.patience is not None:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
                expected = int(some.loc[marker, "expected"].max())
            own = some[~marker & some["frame_index"].notna()]
            if len(own):
                number = lambda v: None if pd.isna(v) else float(v)
                self.rows.appendList([(int(f), number(x), number(y)) for f, x, y in zip(own["frame_index"], own["x"], own["y"], strict=True)])
                n += len(own)
        if expected is not None and n >= expected:
            yield from self._gone(key, n, expected, True)
        else:
            self.count.update((n, expected, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, expected, given = self.count.get() if self.count.exists() else (0, None, True)
        if not given:
            yield from self._gone(key, n, expected, False)

    def _gone(self, key, n: int, expected: int | None, complete: bool) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.rows.get()) if n else [], columns=["frame_index", "x", "y"]).astype({"x": "float64", "y": "float64"})
        held.insert(0, "clip_id", key[0])
        held["complete"] = complete
        self.rows.clear()
        self.count.update((n, expected, True))
        if len(held):
            yield held


def whole_clips(stream: DataFrame, patience: int | None = None) -> DataFrame:
    """CLIP: the rows of ``stream`` (ROW), clip by clip as each is complete; with ``patience`` also of clips that are not, marked so.

    Rows without a clip and markers of no rows give nothing.  A clip that has gone out is not opened again.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    keyed = stream.where(F.col("clip_id").isNotNull()).groupBy("clip_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Gather(patience), outputStructType=CLIP, outputMode="Append", timeMode="None" if patience is None else "ProcessingTime")


def detect_stream(stream: DataFrame, out: str, checkpoint: str, detector: Detector = Detector(), fps: float = 30.0, patience: int | None = None) -> StreamingQuery:  # noqa: B008
    """Write the turning points of each batch's whole clips to ``out``/batch=N; a batch that is run again writes its folder again.

    Of rows that repeat a frame one counts.
    """
    def batch(clips: DataFrame, number: int) -> None:
        track = clips.groupBy("clip_id", "frame_index").agg(F.max(F.struct("x", "y")).alias("p")).select("clip_id", "frame_index", "p.x", "p.y")
        spine = track.groupBy("clip_id").agg(F.max("frame_index").alias("n")).withColumn("frame_index", F.explode(F.sequence(F.lit(0), "n"))).drop("n")
        turning_points(spine.join(track, ["clip_id", "frame_index"], "left"), detector, fps).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return whole_clips(stream, patience).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def row_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Track rows and markers as JSON lines, files as they land."""
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", files).json(path)
