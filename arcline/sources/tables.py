"""Reading and writing the tables of the pipeline: CSV with fixed columns, JSON documents, Parquet record tables, and frames."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.functions.numeric import blank_to_null, rounded
from arcline.functions.text import first_number
from arcline.operators.courts import RECORDS
from arcline.operators.overlay import last_by_frame
from arcline.operators.records import SCHEMA as RECORD_SCHEMA

#: Columns of the CSV files and the decimal places that they are written with.
TRACK = (("frame_index", None), ("time_sec", 4), ("x", 2), ("y", 2), ("status", None), ("score", 4))
BOUNCES = (("frame_index", None), ("time_sec", 4), ("x", 2), ("y", 2), ("score", 4), ("vy_before", 4), ("vy_after", 4), ("prominence", 4), ("x_velocity_change", 4))
JUDGED = ("judge_x", "judge_y", "decision", "decision_reason", "boundary_distance_px", "signed_distance_px")


def as_written(df: DataFrame, columns: tuple[tuple[str, int | None], ...]) -> DataFrame:
    """The values that a written and read CSV would hold: rounded ones.  What follows has to work from these."""
    own = [c for c in df.columns if c not in {n for n, _ in columns}]
    return df.select(*own, *[(F.col(n) if p is None else rounded(F.col(n), p)).alias(n) for n, p in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A header CSV in the given column order; nulls as empty fields."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-text columns of header CSVs; empty fields are null and a byte-order mark is no part of the first name."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def load_bounces(rows: DataFrame) -> DataFrame:
    """Judged bounces from text rows: those without a frame or a point drop out, points come from the first columns that hold one."""
    there = [c for c in ("judge_x", "contact_x", "x") if c in rows.columns], [c for c in ("judge_y", "contact_y", "y") if c in rows.columns]
    x, y = (first_number(*[F.col(c) for c in names]) for names in there)
    frame = blank_to_null(F.col("frame_index")).try_cast("double").cast("int")
    made = rows.withColumns({"frame_index": frame, "x": x, "y": y, "decision": F.coalesce(blank_to_null(F.col("decision")), F.lit("UNKNOWN"))})
    return made.where(F.col("frame_index").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())


def load_track(rows: DataFrame) -> DataFrame:
    """Track points from text rows, those that don't read as numbers left out; of rows that repeat a frame the last one read stays."""
    number = lambda c: blank_to_null(F.col(c)).try_cast("double")
    made = rows.withColumns({"frame_index": number("frame_index").cast("int"), "x": number("x"), "y": number("y")})
    made = made.where(F.col("frame_index").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    named = made if "clip_id" in made.columns else made.withColumn("clip_id", F.lit(None).cast("string"))
    return last_by_frame(named.withColumn("_read", F.monotonically_increasing_id()), F.col("_read")).select(*made.columns)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as (path, modified, document)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("document"))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Court configuration files as (path, document, records)."""
    return read_documents(spark, path).withColumn("records", F.from_json("document", RECORDS))


def read_jobs(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Job files with the time of their last change; files that don't parse are left out."""
    jobs = read_documents(spark, path).withColumn("job", F.from_json("document", schema, {"mode": "PERMISSIVE"}))
    return jobs.where(F.col("job").isNotNull() & F.col("job.job_id").isNotNull()).select("job.*", "modified")


def job_documents(spark: SparkSession, root: str, session_id: str | None = None, job_id: str | None = None) -> DataFrame:
    """(session_id, job_id, modified, document) of ``root``/<session>/jobs/<job>/job.json; with a session or job only its folders are listed and opened."""
    plain = lambda part: re.sub(r"([*?\[\]{}\\\\])", r"\\\1", part) if part is not None else "*"
    found = read_documents(spark, f"{root.rstrip('/')}/{plain(session_id)}/jobs/{plain(job_id)}/job.json")
    part = lambda k: F.url_decode(F.element_at(F.split("path", "/"), k))
    return found.select(part(-4).alias("session_id"), part(-2).alias("job_id"), "modified", "document")


def find_job(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """The document of a job whose session isn't known; no row if there is none."""
    try:
        return job_documents(spark, root, job_id=job_id).limit(1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "session_id string, job_id string, modified timestamp, document string")


def write_jobs(jobs: DataFrame, root: str) -> None:
    """Jobs as JSON lines in a folder for each session, nulls kept; only the sessions that ``jobs`` has are replaced."""
    jobs.repartition("session_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("session_id").json(root)


def read_jobs_by_session(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What ``write_jobs`` wrote: session_id is a partition, so a filter on it opens that session's files alone."""
    return spark.read.schema(f"{schema}, session_id string").json(root)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).option("mergeSchema", True).parquet(path)


def write_next(df: DataFrame, root: str) -> str:
    """Write a new version of a table beside the old ones and return its path; the caller then points readers to it."""
    path = f"{root.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def decode(files: DataFrame, decoder: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``schema`` from (path, content) by a ``decoder`` of one file: video frames, markers, or metadata.

    The pixels are the decoder's; this only deals the files out, and starts each row with the file's path.
    """
    names = T.StructType.fromDDL(f"path string, {schema}").fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, *row) for row in decoder(content)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def detect(frames: DataFrame, load_model: Callable[[], Callable[[bytes], list[tuple]]]) -> DataFrame:
    """Detections of ``frames`` (clip_id, frame_index, content) by a model that is loaded once a task.

    The model gives (class_id, confidence, x1, y1, x2, y2) for each box of a frame.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            rows = [(clip, frame, *box) for clip, frame, content in zip(batch["clip_id"], batch["frame_index"], batch["content"], strict=True) for box in model(content)]
            yield pd.DataFrame(rows, columns=["clip_id", "frame_index", "class_id", "confidence", "x1", "y1", "x2", "y2"])

    return frames.select("clip_id", "frame_index", "content").mapInPandas(run, "clip_id string, frame_index int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
