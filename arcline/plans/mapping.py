"""The driver's tables seen as the tables of the domain: the same derivations in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcline.functions import geometry as G

FPS = 30.0
FRAMES = 200
RING = [(10.0, 5.0), (90.0, 20.0), (70.0, 95.0), (30.0, 60.0), (5.0, 80.0)]
COURT = [(5.0, 20.0), (90.0, 40.0), (80.0, 420.0), (40.0, 300.0), (10.0, 380.0)]
LINE = ((20.0, 0.0), (70.0, 490.0), (10.0, 300.0))
SIZES = [(640.0, 480.0), (1280.0, 720.0), (1920.0, 1080.0), (1080.0, 1920.0), (1920.0, 1080.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = F.col("event_type") != "error"
    return table(spark, d, "events").select(
        F.col("user_id").alias("clip_id"), (F.row_number().over(order) - 1).alias("frame_index"), F.when(seen, (F.col("event_id") % 97).cast("double")).alias("x"), F.when(seen, F.col("value")).alias("y"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 100
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("clip_id"), (F.col("l_orderkey") % FRAMES).cast("int").alias("frame_index"), (F.col("l_linenumber") % 2).cast("int").alias("class_id"), (F.col("l_discount") * 10).alias("confidence"),
        x.alias("x1"), y.alias("y1"), (x + 8 + F.col("l_tax") * 100).alias("x2"), (y + 6).alias("y2"))


def clips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("clip_id")).distinct().select("clip_id", F.lit(FRAMES).alias("frames"), F.lit(FPS).alias("fps"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 101 + 0.25).alias("px"), F.col("value").alias("py"))


def markers(spark: SparkSession, d: str) -> DataFrame:
    """Eight markers an image: embeddings cut into corners, set apart on a grid."""
    at = lambda m, k: F.get("embedding", m * 8 + k).cast("double") * 40
    base = ((-20.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-20.0, 20.0))
    corner = lambda m, k: G.point(F.lit(200.0) + (m % 4) * 400 + base[k][0] + at(m, F.lit(2 * k)), F.lit(200.0) + F.floor(m / 4) * 450 + m * 13 + base[k][1] + at(m, F.lit(2 * k + 1)))
    detected = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda m: F.struct(m.alias("id"), F.array(*[corner(m, k) for k in range(4)]).alias("corners")))
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("image"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), detected.alias("detected"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("session_id"), status.alias("status"), F.col("o_orderdate").alias("modified"), F.col("o_totalprice").alias("price"))


def records(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey")).alias("id"), F.concat(F.lit("j"), F.col("o_orderkey")).alias("job_id"), F.concat(day, F.lit("T08:00:00")).alias("created_at"), F.concat(day, F.lit("T07:30:00")).alias("recorded_at"),
        F.when(F.col("o_orderkey") % 3 != 0, day).alias("recorded_date"), F.when(F.substring("o_orderpriority", 1, 1).cast("int") % 2 == 0, "doubles").otherwise("singles").alias("match_type"),
        F.when(F.col("o_orderstatus") == "F", "IN").when(F.col("o_orderstatus") == "O", "OUT").otherwise("UNKNOWN").alias("decision"), F.col("o_totalprice").alias("confidence"))


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """Records that come in again, changed, and new ones."""
    r = records(spark, d)
    key = F.substring("job_id", 2, 20).cast("long")
    again = r.where(key % 5 == 0).withColumns({"id": F.concat(F.lit("n"), F.col("id")), "created_at": F.lit("2030-01-01T00:00:00"), "decision": F.lit("OUT"), "recorded_date": F.lit(None).cast("string")})
    new = r.where(key % 7 == 0).withColumns({"id": F.concat(F.lit("x"), F.col("id")), "job_id": F.concat(F.lit("x"), F.col("job_id"))})
    return again.unionByName(new)


# The same in SQL.
def _ring(ring: list[tuple[float, float]], name: str) -> str:
    rows = ", ".join(f"({i}, CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))" for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)))
    return f"{name}(i, ux, uy, vx, vy) AS (VALUES {rows})"


SQL_RING, SQL_COURT = _ring(RING, "ring"), _ring(COURT, "ring")
SQL_TRACK = """ev AS (SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_index,
    CASE WHEN event_type <> 'error' THEN CAST(event_id % 97 AS DOUBLE) END AS x, CASE WHEN event_type <> 'error' THEN value END AS y FROM events)"""
SQL_CANDIDATES = SQL_TRACK + """,
w AS (SELECT *, lag(x, 3) OVER o AS px, lag(y, 3) OVER o AS py, lead(x, 3) OVER o AS nx, lead(y, 3) OVER o AS ny, max(y) OVER (o ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS top,
    count(y) OVER (o ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS pts FROM ev WINDOW o AS (PARTITION BY clip_id ORDER BY frame_index)),
v AS (SELECT clip_id, frame_index, frame_index / 30.0::DOUBLE AS time_sec, x, y, (y - py) / 3::DOUBLE AS vy_before, (ny - y) / 3::DOUBLE AS vy_after, y - least(py, ny) AS prominence, abs((nx - x) / 3::DOUBLE - (x - px) / 3::DOUBLE) AS x_velocity_change, top, pts
    FROM w WHERE y IS NOT NULL AND py IS NOT NULL AND ny IS NOT NULL),
c AS (SELECT *, (vy_before - vy_after) + greatest(prominence, 0) * 0.35::DOUBLE - x_velocity_change * 0.12::DOUBLE AS score FROM v
    WHERE vy_before >= 3 AND vy_after <= -2 AND pts >= 5 AND y >= top - 10 AND x_velocity_change <= 85),
cand AS (SELECT * FROM c WHERE score >= 9)"""
SQL_BOUNCES = SQL_CANDIDATES + """,
ranked AS (SELECT clip_id, frame_index, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, frame_index) AS k FROM cand),
nms AS (SELECT clip_id, k, [frame_index] AS kept FROM ranked WHERE k = 1
    UNION ALL SELECT r.clip_id, r.k, CASE WHEN len(list_filter(n.kept, lambda f: abs(f - r.frame_index) < 10)) > 0 THEN n.kept ELSE list_append(n.kept, r.frame_index) END
    FROM nms n JOIN ranked r ON r.clip_id = n.clip_id AND r.k = n.k + 1),
stay AS (SELECT clip_id, unnest(kept) AS frame_index FROM (SELECT clip_id, arg_max(kept, k) AS kept FROM nms GROUP BY clip_id)),
b AS (SELECT cand.* FROM cand JOIN stay USING (clip_id, frame_index))"""
SQL_DETECTIONS = """det AS (SELECT l_suppkey AS clip_id, CAST(l_orderkey % 200 AS INTEGER) AS frame_index, CAST(l_linenumber % 2 AS INTEGER) AS class_id, l_discount * 10 AS confidence, l_quantity AS x1, l_extendedprice / 100 AS y1,
    l_quantity + 8 + l_tax * 100 AS x2, l_extendedprice / 100 + 6 AS y2 FROM lineitem),
top10 AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_index ORDER BY confidence DESC, x1, y1, x2, y2, class_id) AS k FROM det WHERE confidence >= 0.25::DOUBLE),
best AS (SELECT clip_id, frame_index, class_id, confidence, x1, y1, x2, y2, (x1 + x2) * 0.5::DOUBLE AS x, (y1 + y2) * 0.5::DOUBLE AS y
    FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_index ORDER BY k) AS own FROM top10 WHERE k <= 10 AND class_id = 0) WHERE own = 1)"""
SQL_JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, o_orderdate AS modified, o_totalprice AS price FROM orders)"""
SQL_RECORDS = """rec AS (SELECT 'r' || o_orderkey AS id, 'j' || o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') || 'T08:00:00' AS created_at, strftime(o_orderdate, '%Y-%m-%d') || 'T07:30:00' AS recorded_at,
    CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS recorded_date, CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 2 = 0 THEN 'doubles' ELSE 'singles' END AS match_type,
    CASE o_orderstatus WHEN 'F' THEN 'IN' WHEN 'O' THEN 'OUT' ELSE 'UNKNOWN' END AS decision, o_totalprice AS confidence, o_orderkey AS k FROM orders)"""


def sql_round(x: str, places: int) -> str:
    return f"(CAST(printf('%.{places}f', {x}) AS DOUBLE) + 0.0::DOUBLE)"


def sql_judge(points_sql: str) -> str:
    """CTEs from ``ring`` and p(key..., x, y): far(p.*, dist, inside)."""
    return f"""p AS ({points_sql}),
e AS (SELECT p.*, i, CASE WHEN (uy > y) <> (vy > y) AND x < (vx - ux) * (y - uy) / (vy - uy) + ux THEN 1 ELSE 0 END AS hit,
    least(greatest(((x - ux) * (vx - ux) + (y - uy) * (vy - uy)) / ((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy)), 0), 1) AS t, ux, uy, vx, vy FROM p, ring),
far AS (SELECT key, any_value(x) AS x, any_value(y) AS y, sum(hit) % 2 = 1 AS inside, min(sqrt((x - (ux + t * (vx - ux))) * (x - (ux + t * (vx - ux))) + (y - (uy + t * (vy - uy))) * (y - (uy + t * (vy - uy))))) AS dist FROM e GROUP BY key)"""
