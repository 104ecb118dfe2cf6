"""The table of judgement records: its schema, checks, upsert, migration, and the filtered list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.functions import text as X
from arcline.functions.numeric import blank_to_null

#: The columns in order, those that must be there, and the match types.
TEXT = ("id", "session_id", "job_id", "created_at", "recorded_at", "recorded_date", "match_type", "decision", "decision_reason", "video_path", "video_url", "clip_path", "clip_url", "result_video_url", "inout_overlay_video_url", "inout_csv_url")
JSON = ("primary_bounce_json", "primary_decision_json", "job_result_json")
COLUMNS = (*TEXT, "confidence", *JSON)
REQUIRED = ("id", "job_id", "created_at", "recorded_at", "match_type", "decision", "job_result_json")
MATCH_TYPES = ("singles", "doubles")
KEPT_ON_UPDATE = ("id", "created_at")
SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c == "confidence" else T.StringType(), c not in REQUIRED) for c in COLUMNS])


def violations(records: DataFrame) -> DataFrame:
    """Records with ``violated``: the columns that are missing or out of range."""
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]
    kind = F.when(F.col("match_type").isNotNull() & ~F.col("match_type").isin(*MATCH_TYPES), F.lit("match_type"))
    return records.withColumn("violated", F.filter(F.array(*missing, kind), lambda c: c.isNotNull()))


def offences(incoming: DataFrame, table: DataFrame) -> DataFrame:
    """``incoming`` with ``violated``: what ``violations`` finds, and whether its id is another job's.

    ``id_of_another_job``: the table has the id for another job.  ``id_repeated``: an earlier row of the batch, by (created_at, job_id), has.  A known
    job that comes in again under its own id or a new one breaks no rule; the table keeps the id that it has.
    """
    first = incoming.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("created_at", "job_id"))["job_id"].alias("_first"))
    held = table.where(F.col("id").isNotNull()).select("id", F.col("job_id").alias("_held"))
    joined = violations(incoming).join(first, "id", "left").join(held, "id", "left")
    other = lambda c, rule: F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col("job_id")), F.lit(rule))
    more = F.filter(F.array(F.when(F.col("_held").isNull(), other("_first", "id_repeated")), other("_held", "id_of_another_job")), lambda c: c.isNotNull())
    return joined.select(*incoming.columns, F.concat("violated", more).alias("violated"))


def latest_by_job(rows: DataFrame) -> DataFrame:
    """Of rows that repeat a job_id the latest by (created_at, id), nulls first; summed up in part before the shuffle, so a job may repeat often."""
    best = F.max_by(F.struct(*rows.columns), F.struct("created_at", "id")).alias("_best")
    return rows.groupBy(F.col("job_id").alias("_job")).agg(best).select("_best.*")


def upsert(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after ``incoming``: new jobs are added, known ones get every column but their id and creation time.

    Of rows of ``incoming`` that repeat a job_id the latest by (created_at, id) counts.

    Returns a new table; write it beside the old one and swap, never over the path that is being read.
    """
    incoming = latest_by_job(incoming)
    t, s = table.alias("t"), incoming.alias("s")
    joined = t.join(s, F.col("t.job_id") == F.col("s.job_id"), "full_outer")
    new = F.col("s.job_id").isNotNull()

    def merged(c: str) -> Column:
        if c == "job_id":
            return F.coalesce("t.job_id", "s.job_id")
        if c in KEPT_ON_UPDATE:
            return F.when(F.col("t.job_id").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        return F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

    return joined.select(*[merged(c).alias(c) for c in table.columns])


def with_recorded_date(table: DataFrame) -> DataFrame:
    """Adds recorded_date to tables from before it, from the first ten characters of recorded_at; fills it where it is null."""
    own = F.col("recorded_date") if "recorded_date" in table.columns else F.lit(None).cast("string")
    return table.withColumn("recorded_date", F.coalesce(own, F.substring("recorded_at", 1, 10)))


def listed(table: DataFrame, *, match_type: str | None = None, decision: str | None = None, recorded_date: str | None = None, date_from: str | None = None, date_to: str | None = None, limit: int = 50) -> DataFrame:
    """The newest records by created_at that pass all filters given; empty ones don't filter, a negative limit lists all."""
    for wanted, test in ((match_type, F.col("match_type") == match_type), (decision, F.col("decision") == decision), (recorded_date, F.col("recorded_date") == recorded_date), (date_from, F.col("recorded_date") >= date_from), (date_to, F.col("recorded_date") <= date_to)):
        if wanted:
            table = table.where(test)
    ordered = table.orderBy(F.col("created_at").desc(), F.col("id"))
    return ordered if limit < 0 else ordered.limit(limit)


def lookup(table: DataFrame, column: str, value: str) -> DataFrame:
    """The record with this id or job_id."""
    if column not in ("id", "job_id"):
        raise ValueError("records are looked up by id or job_id")
    return table.where(F.col(column) == value).limit(1)


def to_record(jobs: DataFrame, sessions: DataFrame, requests: DataFrame, record_id: Column | None = None) -> DataFrame:
    """Records of finished ``jobs`` that ``requests`` (job_id, match_type, recorded_at, recorded_date, created_at) save.

    ``jobs`` have decision, decision_reason, confidence, artifacts (map) and three JSON columns; the decision is UNKNOWN where there is none.
    """
    s = sessions.select("session_id", F.col("recording_path").alias("video_path"), F.col("recording_url").alias("video_url"), F.col("recorded_at").alias("_session_at"))
    joined = jobs.where(F.col("status") == "done").join(requests, "job_id").join(s, "session_id", "left")
    at = X.recorded_at(F.col("recorded_at"), F.col("recorded_date"), F.col("_session_at"), F.col("created_at"))
    artifact = lambda k: F.try_element_at(F.col("artifacts"), F.lit(k))
    made = {
        "id": record_id if record_id is not None else F.expr("uuid()"), "recorded_at": at, "recorded_date": F.coalesce(blank_to_null(F.col("recorded_date")), F.substring(at, 1, 10)), "decision": F.coalesce(blank_to_null(F.col("decision")), F.lit("UNKNOWN")),
        "clip_path": F.col("clip_path") if "clip_path" in jobs.columns else F.lit(None).cast("string"), "clip_url": artifact("clip"), "result_video_url": artifact("result_video"), "inout_overlay_video_url": artifact("inout_overlay_video"), "inout_csv_url": artifact("inout_csv"),
    }
    return joined.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in COLUMNS])


def with_json(jobs: DataFrame, result: list[str] | None = None) -> DataFrame:
    """``jobs`` with the three JSON columns of a record: their nested primary_bounce and primary_decision, and the whole row or the ``result`` columns of it.

    Nulls are kept within, and a value that is null has a null column.  Columns that are encoded stay.
    """
    named = result or [c for c in jobs.columns if c not in JSON]
    return jobs.withColumns({"primary_bounce_json": X.as_json(F.col("primary_bounce")), "primary_decision_json": X.as_json(F.col("primary_decision")), "job_result_json": X.as_json(F.struct(*named))})


def as_variants(table: DataFrame) -> DataFrame:
    """The JSON columns as variants, named without their suffix: whatever shape each record's values have.  Text that isn't JSON gives null."""
    for name in JSON:
        table = table.withColumn(name.removesuffix("_json"), F.try_parse_json(name)).drop(name)
    return table


def from_json_columns(table: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """JSON text columns read as ``schemas`` (by base name) and named without their suffix."""
    for name, schema in schemas.items():
        table = table.withColumn(name, F.from_json(f"{name}_json", schema)).drop(f"{name}_json")
    return table


def response(table: DataFrame, with_result: bool = False) -> DataFrame:
    """Records as clients read them, with is_in, and the whole job result only if asked for."""
    keep = [c for c in table.columns if c not in ("job_result", "job_result_json")]
    result = [c for c in ("job_result", "job_result_json") if with_result and c in table.columns]
    return table.select(*keep, X.is_in(F.col("decision")).alias("is_in"), *result)
