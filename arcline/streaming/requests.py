"""Judgement requests as a stream of landed files: each micro-batch goes through the batch functions and an upsert by job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from arcline.operators import records
from arcline.sources.record_table import RecordTable
from arcline.sources.tables import write_next

REQUEST = "job_id string, session_id string, pressed_at_sec double, use_video_end boolean, end_offset_sec double, lookback_sec double, court_config_path string"


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST).json(path)


def upsert_stream(stream: DataFrame, to_records: Callable[[DataFrame], DataFrame], current: Callable[[], DataFrame], root: str, publish: Callable[[str], None], checkpoint: str) -> StreamingQuery:
    """Run ``to_records`` on each batch and upsert its rows into the table that ``current`` reads; ``publish`` gets the new version's path.

    A batch that is run again gives the same table, since the upsert is by job and keeps ids and creation times.  Of requests that repeat a job the
    latest record counts.  Each batch writes the whole table; ``record_stream`` writes what it touches.
    """
    def batch(requests: DataFrame, _: int) -> None:
        publish(write_next(records.upsert(current(), to_records(requests)), root))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_stream(stream: DataFrame, to_records: Callable[[DataFrame], DataFrame], table: RecordTable, checkpoint: str, writer: str = "requests") -> StreamingQuery:
    """Run ``to_records`` on each batch and upsert its rows into ``table``, which rewrites the buckets of the batch's jobs only.

    A batch that is run again after a failure is known by ``writer`` and its number and changes nothing.  Rows that break a rule are kept apart.
    """
    def batch(requests: DataFrame, number: int) -> None:
        table.upsert(to_records(requests), (writer, number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
