"""A query for each operator on the driver's tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcline.functions import geometry as G
from arcline.functions import text as X
from arcline.functions.numeric import rounded
from arcline.operators import courts, jobs, markers, overlay, records, tracks
from arcline.plans import mapping as M
from arcline.plans.judgement import judge_clips
from arcline.plans.mapping import sql_judge, sql_round

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), places) for c in columns})


_METRICS = ("x", "y", "score", "vy_before", "vy_after", "prominence", "x_velocity_change")
_SQL_METRICS = ", ".join(f"{sql_round(c, 4)} AS {c}" for c in ("time_sec", *_METRICS))


def _best(spark: SparkSession, d: str) -> DataFrame:
    return tracks.best_detection(M.detections(spark, d), order=[F.col(c) for c in ("x1", "y1", "x2", "y2", "class_id")])


@query(f"WITH {M.SQL_DETECTIONS} SELECT clip_id, frame_index, class_id, {', '.join(f'{sql_round(c, 4)} AS {c}' for c in ('confidence', 'x1', 'y1', 'x2', 'y2', 'x', 'y'))} FROM best")
def best_detection_per_frame(spark, d):
    return _rounded(_best(spark, d), 4, "confidence", "x1", "y1", "x2", "y2", "x", "y")


_SPINE = f"""WITH {M.SQL_DETECTIONS}, spine AS (SELECT clip_id, unnest(range(0, 200))::INTEGER AS frame_index FROM (SELECT DISTINCT l_suppkey AS clip_id FROM lineitem)),
tr AS (SELECT clip_id, frame_index, frame_index / 30::DOUBLE AS time_sec, x, y, CASE WHEN x IS NULL THEN 'missing' ELSE 'detected' END AS status, coalesce(confidence, 0) AS score FROM spine LEFT JOIN best USING (clip_id, frame_index))"""


@query(f"{_SPINE} SELECT clip_id, frame_index, {sql_round('time_sec', 4)} AS time_sec, {sql_round('x', 2)} AS x, {sql_round('y', 2)} AS y, status, {sql_round('score', 4)} AS score FROM tr")
def dense_track(spark, d):
    track = tracks.dense_track(_best(spark, d), M.clips(spark, d))
    return _rounded(_rounded(track.select("clip_id", "frame_index", "time_sec", "x", "y", "status", "score"), 4, "time_sec", "score"), 2, "x", "y")


@query(f"{_SPINE} SELECT clip_id, count(*) AS frames, count(*) FILTER (status = 'detected') AS detected, count(*) FILTER (status = 'missing') AS missing, 0::BIGINT AS predicted, 0::BIGINT AS isolated FROM tr GROUP BY clip_id")
def track_status_counts(spark, d):
    return tracks.status_counts(tracks.dense_track(_best(spark, d), M.clips(spark, d)))


@query(f"WITH {M.SQL_CANDIDATES} SELECT clip_id, frame_index, {_SQL_METRICS} FROM cand")
def bounce_candidates(spark, d):
    return _rounded(tracks.turning_candidates(M.track(spark, d)), 4, "time_sec", *_METRICS)


@query(f"WITH RECURSIVE {M.SQL_BOUNCES} SELECT clip_id, frame_index, {_SQL_METRICS} FROM b")
def bounces_nms(spark, d):
    return _rounded(tracks.turning_points(M.track(spark, d)), 4, "time_sec", *_METRICS)


_PRIMARY = "f AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, frame_index) AS k, count(*) OVER (PARTITION BY clip_id) AS n FROM b)"


@query(f"WITH RECURSIVE {M.SQL_BOUNCES}, {_PRIMARY} SELECT clip_id, frame_index, {sql_round('time_sec', 4)} AS time_sec, x, y, {sql_round('score', 4)} AS score, {sql_round('least(greatest(score / 150, 0), 1)', 6)} AS confidence, n AS bounce_count FROM f WHERE k = 1")
def primary_bounce(spark, d):
    return _rounded(_rounded(tracks.primary(tracks.turning_points(M.track(spark, d))), 4, "time_sec", "score"), 6, "confidence")


def _judged(spark, d, court: list) -> DataFrame:
    """The bounces judged by one configuration for all clips, ``court`` being its columns."""
    bounces = _rounded(tracks.turning_points(M.track(spark, d)).select("clip_id", "frame_index", "x", "y", "score"), 2, "x", "y")
    return courts.judge(bounces, bounces.select("clip_id").distinct().select("clip_id", *court))


def _polygon_court() -> list:
    none = F.lit(None).cast(G.POINT)
    return [F.lit("polygon").alias("mode"), G.literal_ring(M.COURT).alias("court_polygon"), none.alias("line_start"), none.alias("line_end"), none.alias("inside_point"), F.lit(3.0).alias("line_tolerance_px")]


def _line_court() -> list:
    a, b, c = (G.point(*p) for p in M.LINE)
    return [F.lit("line").alias("mode"), F.lit(None).cast(G.RING).alias("court_polygon"), a.alias("line_start"), b.alias("line_end"), c.alias("inside_point"), F.lit(3.0).alias("line_tolerance_px")]


_DECIDED = "CASE WHEN dist <= 3 OR inside THEN 'IN' ELSE 'OUT' END"
_JUDGED = f"WITH RECURSIVE {M.SQL_BOUNCES}, {M.SQL_COURT}, {sql_judge(f'SELECT clip_id * 1000000 + frame_index AS key, {sql_round(chr(120), 2)} AS x, {sql_round(chr(121), 2)} AS y FROM b')}"
_VERDICT = f"{_DECIDED} AS decision, CASE WHEN dist <= 3 THEN 'on_line' WHEN inside THEN 'inside_polygon' ELSE 'outside_polygon' END AS decision_reason, {sql_round('dist', 3)} AS boundary_distance_px"


@query(f"{_JUDGED} SELECT key // 1000000 AS clip_id, CAST(key % 1000000 AS INTEGER) AS frame_index, x AS judge_x, y AS judge_y, {_VERDICT}, CAST(NULL AS DOUBLE) AS signed_distance_px FROM far")
def judge_polygon(spark, d):
    return _judged(spark, d, _polygon_court()).drop("x", "y", "score")


@query(f"{_JUDGED} SELECT {_DECIDED} AS decision, count(*) AS n FROM far GROUP BY 1")
def judge_decision_counts(spark, d):
    return _judged(spark, d, _polygon_court()).groupBy("decision").agg(F.count("*").alias("n"))


@query(f"{_JUDGED}, verdict AS (SELECT key // 1000000 AS clip_id, CAST(key % 1000000 AS INTEGER) AS frame_index, {_VERDICT} FROM far) SELECT * FROM (SELECT * FROM verdict QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) = 1)")
def primary_decision(spark, d):
    judged = _judged(spark, d, _polygon_court())
    first = judged.groupBy("clip_id").agg(F.min(F.struct("frame_index", "decision", "decision_reason", "boundary_distance_px")).alias("p"))
    return first.select("clip_id", "p.*")


_SIDE = "((x - 20) * 490 - (y - 0) * 50) / sqrt(50 * 50 + 490 * 490)"
_REF = "((10 - 20) * 490 - (300 - 0) * 50)"


@query(f"""WITH RECURSIVE {M.SQL_BOUNCES}, s AS (SELECT clip_id, frame_index, x, y, ((x - 20) * 490 - y * 50) / sqrt(50 * 50 + 490 * 490) AS side FROM (SELECT clip_id, frame_index, {sql_round('x', 2)} AS x, {sql_round('y', 2)} AS y FROM b))
SELECT clip_id, frame_index, x AS judge_x, y AS judge_y, CASE WHEN abs(side) <= 3 THEN 'IN' WHEN (side > 0) = ({_REF} > 0) THEN 'IN' ELSE 'OUT' END AS decision,
    CASE WHEN abs(side) <= 3 THEN 'on_line' WHEN (side > 0) = ({_REF} > 0) THEN 'same_side_as_inside_point' ELSE 'opposite_side_from_inside_point' END AS decision_reason,
    {sql_round('abs(side)', 3)} AS boundary_distance_px, {sql_round('side', 3)} AS signed_distance_px FROM s""")
def judge_line(spark, d):
    return _judged(spark, d, _line_court()).drop("x", "y", "score")


_POINTS = f"WITH {M.SQL_RING}, {sql_judge('SELECT event_id AS key, event_id % 101 + 0.25::DOUBLE AS x, value AS y FROM events')}"


@query(f"{_POINTS} SELECT key AS event_id, inside FROM far")
def point_in_polygon(spark, d):
    return M.points(spark, d).select("event_id", G.in_ring(G.point(F.col("px"), F.col("py")), G.literal_ring(M.RING)).alias("inside"))


@query(f"{_POINTS} SELECT key AS event_id, {sql_round('dist', 4)} AS distance FROM far")
def polygon_distance(spark, d):
    return M.points(spark, d).select("event_id", rounded(G.ring_distance(G.point(F.col("px"), F.col("py")), G.literal_ring(M.RING)), 4).alias("distance"))


@query(f"SELECT event_id, {sql_round('((event_id % 101 + 0.25::DOUBLE - 20) * 490 - value * 50) / sqrt(50 * 50 + 490 * 490)', 4)} AS side FROM events")
def signed_line_distance(spark, d):
    a, b, _ = (G.point(*p) for p in M.LINE)
    return M.points(spark, d).select("event_id", rounded(G.signed_distance(G.point(F.col("px"), F.col("py")), a, b), 4).alias("side"))


_VIDEO = "SELECT s_suppkey, CAST(600 + (s_suppkey * 37) % 1500 AS DOUBLE) AS w, CAST(400 + (s_suppkey * 53) % 1500 AS DOUBLE) AS h FROM supplier"
_SIZES = ", ".join(f"({i}, {w}::DOUBLE, {h}::DOUBLE)" for i, (w, h) in enumerate(M.SIZES))


@query(f"""WITH v AS ({_VIDEO}), s(i, rw, rh) AS (VALUES {_SIZES}),
r AS (SELECT s_suppkey, i, rw, rh, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(rw / rh - w / h) * 1000 + abs(rw - w) + abs(rh - h), i) AS k FROM v, s)
SELECT s_suppkey, 'court' || i AS image, rw AS width, rh AS height FROM r WHERE k = 1""")
def closest_court_record(spark, d):
    empty = {f.name: F.lit(None).cast(f.dataType) for f in courts.RECORD}
    record = lambda i, w, h: F.struct(*[({"image": F.lit(f"court{i}"), "width": F.lit(w), "height": F.lit(h)}.get(f.name, empty[f.name])).alias(f.name) for f in courts.RECORD])
    found = courts.closest_by_size(F.array(*[record(i, w, h) for i, (w, h) in enumerate(M.SIZES)]), F.col("w"), F.col("h"))
    videos = M.table(spark, d, "supplier").selectExpr("s_suppkey", "CAST(600 + (s_suppkey * 37) % 1500 AS DOUBLE) AS w", "CAST(400 + (s_suppkey * 53) % 1500 AS DOUBLE) AS h")
    return videos.withColumn("r", found).select("s_suppkey", "r.image", "r.width", "r.height")


_PART = "SELECT p_partkey, CAST(300 + p_partkey % 400 AS DOUBLE) AS pax, CAST(p_size AS DOUBLE) AS pay, 900 + p_retailprice % 200 AS pbx, CAST(500 + p_partkey % 150 AS DOUBLE) AS pby, CAST(p_size AS DOUBLE) AS pcx, CAST(700 + p_partkey % 90 AS DOUBLE) AS pcy, 950 + p_retailprice % 90 AS pdx, CAST(560 + p_size AS DOUBLE) AS pdy FROM part"


@query(f"""WITH p AS ({_PART}), q AS (SELECT *, (pbx - pax) * (pdy - pcy) - (pby - pay) * (pdx - pcx) AS den, ((pcx - pax) * (pdy - pcy) - (pcy - pay) * (pdx - pcx)) AS num, greatest(32, 4 * sqrt((pbx - pdx) * (pbx - pdx) + (pby - pdy) * (pby - pdy))) AS near FROM p),
m AS (SELECT *, pax + num / den * (pbx - pax) AS ix, pay + num / den * (pby - pay) AS iy FROM q),
g AS (SELECT *, abs(den) >= 1e-9 AND ix BETWEEN -153.6::DOUBLE AND 1919 + 153.6::DOUBLE AND iy BETWEEN -153.6::DOUBLE AND 1079 + 153.6::DOUBLE AND sqrt((ix - pbx) * (ix - pbx) + (iy - pby) * (iy - pby)) <= near AND sqrt((ix - pdx) * (ix - pdx) + (iy - pdy) * (iy - pdy)) <= near AS good FROM m)
SELECT p_partkey, {sql_round('CASE WHEN good THEN ix ELSE (pbx + pdx) * 0.5::DOUBLE END', 3)} AS x, {sql_round('CASE WHEN good THEN iy ELSE (pby + pdy) * 0.5::DOUBLE END', 3)} AS y FROM g""")
def view2_vertex_merge(spark, d):
    p = M.table(spark, d, "part").selectExpr(*[c.strip() for c in _PART.removeprefix("SELECT ").removesuffix(" FROM part").replace(" AS DOUBLE)", " AS DOUBLE )").split(", ")])
    a, b, c, e = (G.point(F.col(f"p{k}x"), F.col(f"p{k}y")) for k in "abcd")
    return p.withColumn("v", G.joined_vertex(a, b, c, e, F.lit(1920.0), F.lit(1080.0))).select("p_partkey", rounded(F.col("v.x"), 3).alias("x"), rounded(F.col("v.y"), 3).alias("y"))


_TWO_LINES = "SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS k FROM part"


@query(f"""WITH p AS ({_TWO_LINES}), q AS (SELECT p_partkey, (k % 1900) * (1280 / 1920::DOUBLE) AS tx, (k % 1000) * (720 / 1080::DOUBLE) AS sy, (k % 700 + 600) * (1280 / 1920::DOUBLE) AS ax, (k % 300 + 500) * (720 / 1080::DOUBLE) AS ay, (k % 650 + 610) * (1280 / 1920::DOUBLE) AS bx, (k % 290 + 520) * (720 / 1080::DOUBLE) AS bw FROM p),
d AS (SELECT *, (ax - tx) * (bw - sy) - ay * bx AS den, -tx * (bw - sy) - sy * bx AS num, greatest(32, 4 * sqrt((ax - bx) * (ax - bx) + (ay - bw) * (ay - bw))) AS near FROM q),
m AS (SELECT *, tx + num / den * (ax - tx) AS ix, num / den * ay AS iy FROM d),
v AS (SELECT *, abs(den) >= 1e-9 AND ix BETWEEN -102.4::DOUBLE AND 1279 + 102.4::DOUBLE AND iy BETWEEN -102.4::DOUBLE AND 719 + 102.4::DOUBLE AND sqrt((ix - ax) * (ix - ax) + (iy - ay) * (iy - ay)) <= near AND sqrt((ix - bx) * (ix - bx) + (iy - bw) * (iy - bw)) <= near AS good FROM m),
r AS (SELECT p_partkey, {sql_round('tx', 3)} AS tx, {sql_round('sy', 3)} AS sy, {sql_round('CASE WHEN good THEN ix ELSE (ax + bx) * 0.5::DOUBLE END', 3)} AS vx, {sql_round('CASE WHEN good THEN iy ELSE (ay + bw) * 0.5::DOUBLE END', 3)} AS vy FROM v)
SELECT p_partkey, CASE WHEN tx = 0 OR sy = 0 THEN 3 ELSE 4 END AS n_vertices, {sql_round('abs(vx * sy + vy * tx) / 2', 1)} AS area, vx AS vertex_x, vy AS vertex_y FROM r""")
def view2_polygon(spark, d):
    w, h = F.lit(1920.0), F.lit(1080.0)
    line = lambda n, x1, y1, x2, y2: F.struct(F.lit(n).alias("name"), F.array(F.array(x1, y1), F.array(x2, y2)).alias("points"), F.lit(None).cast("array<array<double>>").alias("extended_endpoints"), F.lit(None).cast("array<array<double>>").alias("segment_endpoints"))
    k = F.col("p_partkey").cast("double")
    lines = F.array(line("top_to_vertex", k % 1900, F.lit(0.0), k % 700 + 600, k % 300 + 500), line("side_to_vertex", F.lit(0.0), k % 1000, k % 650 + 610, k % 290 + 520))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in courts.RECORD if f.name not in ("width", "height", "lines")]
    r = F.struct(*empty, w.alias("width"), h.alias("height"), lines.alias("lines"))
    made = M.table(spark, d, "part").withColumn("r", r).withColumn("p", courts.two_line_polygon(F.col("r"), F.lit(1280.0), F.lit(720.0)))
    return made.select("p_partkey", F.size("p.polygon").alias("n_vertices"), rounded(G.ring_area(F.col("p.polygon")), 1).alias("area"), F.col("p.vertex.x").alias("vertex_x"), F.col("p.vertex.y").alias("vertex_y"))


_HALF = "SELECT s_suppkey, CAST(200 + s_suppkey % 600 AS DOUBLE) AS tx, CAST(150 + (s_suppkey * 7) % 700 AS DOUBLE) AS bx FROM supplier"


@query(f"WITH l AS ({_HALF}) SELECT s_suppkey, {sql_round('tx', 3)} AS top_x, {sql_round('bx', 3)} AS bottom_x, {sql_round('(tx + bx) / 2 * 799', 1)} AS area_left, {sql_round('999 * 799 - (tx + bx) / 2 * 799', 1)} AS area_right FROM l")
def view3_half_plane(spark, d):
    lines = M.table(spark, d, "supplier").selectExpr("s_suppkey", "CAST(200 + s_suppkey % 600 AS DOUBLE) AS tx", "CAST(150 + (s_suppkey * 7) % 700 AS DOUBLE) AS bx")
    a, b = G.point(F.col("tx"), F.lit(0.0)), G.point(F.col("bx"), F.lit(799.0))
    frame = G.frame_ring(F.lit(1000.0), F.lit(800.0))
    # a line from top to bottom has the left of the picture on its negative side
    return lines.select("s_suppkey", rounded(F.col("tx"), 3).alias("top_x"), rounded(F.col("bx"), 3).alias("bottom_x"), rounded(G.ring_area(G.clip_to_side(frame, a, b, F.lit(False))), 1).alias("area_left"), rounded(G.ring_area(G.clip_to_side(frame, a, b, F.lit(True))), 1).alias("area_right"))


_PRESS = "SELECT o_orderkey, o_totalprice % 60 AS duration, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice % 71 END AS pressed, o_orderkey % 5 = 0 AS use_end, CAST(o_orderkey % 3 AS DOUBLE) AS off FROM orders"
_RAW = "CASE WHEN pressed IS NULL OR use_end THEN duration - off ELSE pressed END"


def _pressed(spark, d) -> DataFrame:
    o = M.table(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice % 60 AS duration", "CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice % 71 END AS pressed", "o_orderkey % 5 = 0 AS use_end", "CAST(o_orderkey % 3 AS DOUBLE) AS off")
    return o.withColumn("t", jobs.pressed_at(F.col("duration"), F.col("pressed"), F.col("use_end"), F.col("off")))


@query(f"""WITH o AS ({_PRESS}), r AS (SELECT *, {_RAW} AS raw FROM o), s AS (SELECT *, CASE WHEN duration > 0 THEN least(greatest(raw, 0), duration) ELSE greatest(raw, 0) END AS pin FROM r)
SELECT o_orderkey, CASE WHEN pressed IS NULL OR use_end THEN 'video_end' ELSE 'request' END AS source, {sql_round('raw', 4)} AS raw_pressed_at_sec, {sql_round('pin', 4)} AS pressed_at_sec, pin <> raw AS clamped FROM s""")
def pressed_at_resolution(spark, d):
    return _rounded(_pressed(spark, d).select("o_orderkey", "t.*"), 4, "raw_pressed_at_sec", "pressed_at_sec")


@query(f"""WITH o AS ({_PRESS}), r AS (SELECT *, {_RAW} AS raw FROM o), s AS (SELECT *, CASE WHEN duration > 0 THEN least(greatest(raw, 0), duration) ELSE greatest(raw, 0) END AS pin FROM r)
SELECT o_orderkey, {sql_round('greatest(pin - 5, 0)', 4)} AS start_sec, {sql_round('pin', 4)} AS end_sec FROM s""")
def clip_window(spark, d):
    bounds = jobs.clip_bounds(F.col("t.pressed_at_sec"), F.lit(5.0))
    return _rounded(_pressed(spark, d).select("o_orderkey", bounds.alias("b")).select("o_orderkey", "b.*"), 4, "start_sec", "end_sec")


@query(f"""WITH {M.SQL_TRACK} SELECT clip_id, frame_index - 8 AS frame_index, x, y FROM ev WHERE frame_index >= 8 AND frame_index < least(40, 36)""")
def clip_frames(spark, d):
    frames = M.track(spark, d).withColumnRenamed("clip_id", "recording_id")
    cut = frames.select("recording_id").distinct().select("recording_id", F.col("recording_id").alias("clip_id"), F.lit(0.25).alias("start_sec"), F.lit(1.2).alias("end_sec"), F.lit(30.0).alias("fps"), F.lit(40).alias("total"))
    return jobs.clip_frames(frames, cut).select("clip_id", "frame_index", "x", "y")


@query(f"WITH {M.SQL_JOBS} SELECT session_id, job_id, status, price FROM jobs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY (status = 'done') DESC, modified DESC, job_id DESC) = 1")
def latest_job_per_session(spark, d):
    return jobs.latest_job(M.jobs(spark, d)).select("session_id", "job_id", "status", "price")


@query(f"""WITH {M.SQL_JOBS}, l AS (SELECT session_id, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY (status = 'done') DESC, modified DESC, job_id DESC) = 1),
q AS (SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey * 4 AS VARCHAR) END AS asked FROM customer),
f AS (SELECT q.session_id, q.asked, CASE WHEN asked IS NOT NULL THEN j.job_id ELSE l.job_id END AS job, CASE WHEN asked IS NOT NULL THEN j.status ELSE l.status END AS status
    FROM q LEFT JOIN jobs j ON j.session_id = q.session_id AND CAST(j.job_id AS VARCHAR) = asked LEFT JOIN l ON l.session_id = q.session_id)
SELECT session_id, asked AS asked_job_id, CASE WHEN status = 'done' THEN job END AS job_id, CASE WHEN job IS NULL AND asked IS NOT NULL THEN 'unknown_job' WHEN job IS NULL THEN 'no_job' WHEN status <> 'done' THEN 'not_done' END AS refused FROM f""")
def job_to_save(spark, d):
    asked = M.table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") * 4).cast("string")).alias("asked_job_id"))
    return jobs.job_to_save(M.jobs(spark, d), asked)


_MESSAGES = ("could not open video: a", "could not open source video: a", "Court config not found: a", "Clip range is empty", "boom", "No frames were written to clip")
_CASE = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES)) + " END"


@query(f"""SELECT o_orderkey, CASE WHEN lower(m) LIKE '%could not open video%' OR lower(m) LIKE '%clip range is empty%' OR lower(m) LIKE '%clip has no readable frames%' OR lower(m) LIKE '%no frames were written to clip%' THEN 'video_unreadable'
WHEN lower(m) LIKE '%court config%' THEN 'line_config_unavailable' ELSE 'processing_error' END AS failure_type FROM (SELECT o_orderkey, {_CASE} AS m FROM orders)""")
def failure_taxonomy(spark, d):
    message = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return M.table(spark, d, "orders").select("o_orderkey", X.failure(message).alias("failure_type"))


@query("""WITH f AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS b, o_orderkey % 3 = 0 AS c, o_orderkey % 5 <> 0 AS i, o_orderkey % 7 = 0 AS k FROM orders)
SELECT o_orderkey, CASE WHEN NOT b THEN 'detection_unavailable' WHEN NOT c THEN 'line_config_unavailable' WHEN i AND NOT k THEN 'detection_unavailable' END AS failure_type,
CASE WHEN NOT b THEN 'ball_bounce_not_detected' WHEN NOT c THEN 'court_config_missing' WHEN i AND NOT k THEN 'inout_decision_not_available' END AS failure_reason FROM f""")
def detection_issue(spark, d):
    k = F.col("o_orderkey")
    issue = X.detection_issue(k % 2 == 0, k % 3 == 0, k % 5 != 0, k % 7 == 0)
    return M.table(spark, d, "orders").select("o_orderkey", issue.alias("i")).select("o_orderkey", "i.*")


@query("SELECT o_orderkey, CASE WHEN o_totalprice - 200000 < 0 THEN 'pressed_at_sec' WHEN o_orderkey % 9 - 1 < 0 THEN 'end_offset_sec' WHEN o_orderkey % 11 <= 0 THEN 'lookback_sec' END AS rejected FROM orders")
def request_validation(spark, d):
    k = F.col("o_orderkey")
    made = M.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") - 200000).alias("pressed_at_sec"), (k % 9 - 1).alias("end_offset_sec"), (k % 11).alias("lookback_sec"))
    return jobs.validate(made).select("o_orderkey", "rejected")


@query("""SELECT o_orderkey AS job_id, o_custkey AS session_id, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN 'job.json' ELSE '' END, ''), CASE WHEN c_custkey % 3 <> 0 THEN c_name END) AS court_config_path,
CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS config_image, coalesce(CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 END AS INTEGER), c_nationkey, 0) AS config_index FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def session_defaults(spark, d):
    k = F.col("o_orderkey")
    own = M.table(spark, d, "orders").select(k.alias("job_id"), F.col("o_custkey").alias("session_id"), F.when(k % 2 == 0, "job.json").otherwise("").alias("court_config_path"), F.lit("").alias("config_image"), F.when(k % 5 == 0, 2).alias("config_index"))
    c = F.col("c_custkey")
    sessions = M.table(spark, d, "customer").select(c.alias("session_id"), F.when(c % 3 != 0, F.col("c_name")).alias("court_config_path"), F.when(c % 2 == 0, F.col("c_mktsegment")).alias("config_image"), F.col("c_nationkey").alias("config_index"))
    return jobs.with_session_defaults(own, sessions).select("job_id", "session_id", "court_config_path", "config_image", "config_index")


_RECORD = "id, job_id, created_at, recorded_at, recorded_date, match_type, decision, confidence"
_INCOMING = f"""inc AS (SELECT 'n' || id AS id, job_id, '2030-01-01T00:00:00' AS created_at, recorded_at, CAST(NULL AS VARCHAR) AS recorded_date, match_type, 'OUT' AS decision, confidence FROM rec WHERE k % 5 = 0
UNION ALL SELECT 'x' || id, 'x' || job_id, created_at, recorded_at, recorded_date, match_type, decision, confidence FROM rec WHERE k % 7 = 0)"""


@query(f"""WITH {M.SQL_RECORDS}, {_INCOMING} SELECT coalesce(t.id, s.id) AS id, coalesce(t.job_id, s.job_id) AS job_id, coalesce(t.created_at, s.created_at) AS created_at,
{', '.join(f'CASE WHEN s.job_id IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}' for c in ('recorded_at', 'recorded_date', 'match_type', 'decision', 'confidence'))} FROM rec t FULL OUTER JOIN inc s ON t.job_id = s.job_id""")
def records_upsert(spark, d):
    return records.upsert(M.records(spark, d), M.incoming(spark, d))


@query(f"WITH {M.SQL_RECORDS} SELECT {_RECORD} FROM rec WHERE match_type = 'singles' AND decision = 'IN' ORDER BY created_at DESC, id LIMIT 50")
def records_list_top50(spark, d):
    return records.listed(M.records(spark, d), match_type="singles", decision="IN", recorded_date="")


@query(f"WITH {M.SQL_RECORDS} SELECT {_RECORD} FROM rec WHERE recorded_date >= '1995-01-01' AND recorded_date <= '1996-06-30'")
def records_date_range(spark, d):
    return records.listed(M.records(spark, d), date_from="1995-01-01", date_to="1996-06-30", limit=-1)


@query(f"WITH {M.SQL_RECORDS} SELECT {_RECORD} FROM rec WHERE job_id = 'j7'")
def record_lookup(spark, d):
    return records.lookup(M.records(spark, d), "job_id", "j7")


@query(f"WITH {M.SQL_RECORDS} SELECT id, recorded_at, coalesce(recorded_date, substr(recorded_at, 1, 10)) AS recorded_date FROM rec")
def recorded_date_backfill(spark, d):
    return records.with_recorded_date(M.records(spark, d)).select("id", "recorded_at", "recorded_date")


@query(f"WITH {M.SQL_RECORDS} SELECT id, decision, CASE decision WHEN 'IN' THEN true WHEN 'OUT' THEN false END AS is_in FROM rec")
def saved_response(spark, d):
    return records.response(M.records(spark, d)).select("id", "decision", "is_in")


_NEAR = f"""WITH RECURSIVE {M.SQL_BOUNCES}, n AS (SELECT ev.clip_id, ev.frame_index, b.frame_index AS bounce_frame, b.score FROM ev LEFT JOIN b ON b.clip_id = ev.clip_id AND abs(b.frame_index - ev.frame_index) <= 4
    QUALIFY row_number() OVER (PARTITION BY ev.clip_id, ev.frame_index ORDER BY abs(b.frame_index - ev.frame_index), b.frame_index) = 1)"""


@query(f"{_NEAR} SELECT clip_id, frame_index, bounce_frame, {sql_round('score', 4)} AS bounce_score FROM n")
def nearest_bounce_overlay(spark, d):
    track = M.track(spark, d)
    bounces = tracks.turning_points(track).select("clip_id", "frame_index", "score")
    return _rounded(overlay.nearest_bounce(track.select("clip_id", "frame_index"), bounces, 4), 4, "bounce_score")


@query(f"""WITH {M.SQL_TRACK} SELECT f.clip_id, f.frame_index, CAST(f.frame_index - t.frame_index AS INTEGER) AS "offset", CAST(trunc(t.x) AS INTEGER) AS px, CAST(trunc(t.y) AS INTEGER) AS py,
CAST(trunc(120 + 120 * (1 - (f.frame_index - t.frame_index) / 8::DOUBLE)) AS INTEGER) AS green, greatest(2, CAST(trunc(5 - (f.frame_index - t.frame_index) * 0.28::DOUBLE) AS INTEGER)) AS radius
FROM ev f JOIN ev t ON t.clip_id = f.clip_id AND t.frame_index BETWEEN f.frame_index - 7 AND f.frame_index WHERE t.x IS NOT NULL AND t.y IS NOT NULL""")
def trace_band_join(spark, d):
    track = M.track(spark, d)
    return overlay.trace(track.select("clip_id", "frame_index"), track)


@query(f"""{_NEAR}, {M.SQL_COURT}, {sql_judge(f'SELECT clip_id * 1000000 + frame_index AS key, {sql_round(chr(120), 2)} AS x, {sql_round(chr(121), 2)} AS y FROM b')},
k AS (SELECT clip_id, count(*) AS c FROM b GROUP BY clip_id)
SELECT n.clip_id, n.frame_index, CASE WHEN bounce_frame IS NOT NULL THEN {_DECIDED} || ' BOUNCE' END AS label, CASE WHEN bounce_frame IS NOT NULL THEN {_DECIDED} || '  frame=' || bounce_frame || '  dist=' || round({sql_round('dist', 3)}, 0)::INTEGER || 'px' WHEN k.c IS NULL THEN 'NO BOUNCE' END AS banner
FROM n LEFT JOIN far ON far.key = n.clip_id * 1000000 + n.bounce_frame LEFT JOIN k ON k.clip_id = n.clip_id""")
def banner_text(spark, d):
    judged = _judged(spark, d, _polygon_court()).withColumn("boundary_distance_px", F.round("boundary_distance_px", 0).cast("int"))
    return overlay.draw_plan(M.track(spark, d).select("clip_id", "frame_index"), judged).select("clip_id", "frame_index", "label", "banner")


_C = [[f"(200 + (m % 4) * 400 + {bx} + embedding[m * 8 + {2 * k + 1}]::DOUBLE * 40)" for k, (bx, _) in enumerate(((-20, -20), (20, -20), (20, 20), (-20, 20)))], [f"(200 + (m // 4) * 450 + m * 13 + {by} + embedding[m * 8 + {2 * k + 2}]::DOUBLE * 40)" for k, (_, by) in enumerate(((-20, -20), (20, -20), (20, 20), (-20, 20)))]]
_CORNERS = "m AS (SELECT vec_id AS image, embedding, unnest(range(0, 8)) AS m FROM embeddings WHERE len(embedding) = 64), c AS (SELECT image, m, " + ", ".join(f"{_C[0][k]} AS x{k}, {_C[1][k]} AS y{k}" for k in range(4)) + " FROM m)"
_SIDES = ", ".join(f"sqrt((x{(k + 1) % 4} - x{k}) * (x{(k + 1) % 4} - x{k}) + (y{(k + 1) % 4} - y{k}) * (y{(k + 1) % 4} - y{k})) AS s{k}" for k in range(4))
_AREA = "abs(" + " + ".join(f"(x{k} * y{(k + 1) % 4} - x{(k + 1) % 4} * y{k})" for k in range(4)) + ") / 2"
_STATS = f"{_CORNERS}, st AS (SELECT image, m, (x0 + x1 + x2 + x3) / 4 AS cx, (y0 + y1 + y2 + y3) / 4 AS cy, {_AREA} AS area, {_SIDES} FROM c)"


@query(f"WITH {_STATS} SELECT image, CAST(m AS INTEGER) AS id, {sql_round('cx', 3)} AS center_x, {sql_round('cy', 3)} AS center_y, {sql_round('(s0 + s1 + s2 + s3) / 4', 3)} AS side_mean, {sql_round('least(s0, s1, s2, s3)', 3)} AS side_min, {sql_round('greatest(s0, s1, s2, s3)', 3)} AS side_max, {sql_round('area', 2)} AS area, CAST(row_number() OVER (PARTITION BY image ORDER BY m) AS INTEGER) AS marker_index FROM st WHERE least(s0, s1, s2, s3) >= 20")
def marker_stats(spark, d):
    made = markers.measured(M.markers(spark, d), 20.0).select("image", F.explode("markers").alias("m"))
    r = lambda c, p, n: rounded(F.col(f"m.{c}"), p).alias(n)
    return made.select("image", "m.id", r("center.x", 3, "center_x"), r("center.y", 3, "center_y"), r("side_px_mean", 3, "side_mean"), r("side_px_min", 3, "side_min"), r("side_px_max", 3, "side_max"), r("area_px", 2, "area"), "m.marker_index")


@query(f"""WITH {_STATS}, t AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY image ORDER BY area DESC, m) <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY cy) AS k FROM t)
SELECT a.image, CAST(a.m AS INTEGER) AS top_id, CAST(b.m AS INTEGER) AS side_id, CAST(c.m AS INTEGER) AS vertex_id, CASE WHEN a.cx < b.cx THEN 'left' ELSE 'right' END AS view_side FROM o a JOIN o b ON a.image = b.image AND b.k = 2 JOIN o c ON a.image = c.image AND c.k = 3 WHERE a.k = 1""")
def marker_top3_roles(spark, d):
    made = markers.measured(M.markers(spark, d)).withColumn("r", markers.corner_roles(F.col("markers")))
    return made.select("image", F.col("r.top_marker.id").alias("top_id"), F.col("r.side_marker.id").alias("side_id"), F.col("r.vertex.id").alias("vertex_id"), "r.view_side")


@query(f"""WITH {_CORNERS}, p AS (SELECT image, m, unnest([x0, x1, x2, x3]) AS x, unnest([y0, y1, y2, y3]) AS y FROM c), a AS (SELECT image, avg(x) AS mx, avg(y) AS my FROM p GROUP BY image),
q AS (SELECT p.image, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy, count(*) AS n FROM p JOIN a USING (image) GROUP BY p.image)
SELECT image, {sql_round('mx', 3)} AS x, {sql_round('my', 3)} AS y, {sql_round('abs(cos(0.5::DOUBLE * atan2(2 * sxy, sxx - syy)))', 5)} AS direction_x, {sql_round('sqrt(greatest(0, (sxx + syy) / 2 - sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)) / n)', 3)} AS error FROM q""")
def line_fit(spark, d):
    points = F.flatten(F.transform("detected", lambda m: m["corners"]))
    made = M.markers(spark, d).withColumn("f", G.fitted_line(points))
    return made.select("image", rounded(F.col("f.origin.x"), 3).alias("x"), rounded(F.col("f.origin.y"), 3).alias("y"), rounded(F.abs("f.direction.x"), 5).alias("direction_x"), rounded(F.col("f.error"), 3).alias("error"))


_OF = lambda c, turn: "CASE k " + " ".join(f"WHEN {k} THEN {c}{(k + turn) % 4}" for k in range(4)) + " END"
_PX, _PY = ("ex", "gx", "fx", "hx"), ("ey", "gy", "fy", "hy")
_SPREAD = lambda a, b: " + ".join(f"({x} - {'ox' if a is _PX else 'oy'}) * ({y} - {'ox' if b is _PX else 'oy'})" for x, y in zip(a, b, strict=True))
_SCALED_HIT = [f"CASE WHEN abs(ux) > 1e-9 AND oy + ({x}::DOUBLE - ox) / ux * uy BETWEEN 0 AND 1079 THEN {{'x': {x}::DOUBLE, 'y': oy + ({x}::DOUBLE - ox) / ux * uy}} END" for x in (0, 1919)]
_SCALED_HIT += [f"CASE WHEN abs(uy) > 1e-9 AND ox + ({y}::DOUBLE - oy) / uy * ux BETWEEN 0 AND 1919 THEN {{'x': ox + ({y}::DOUBLE - oy) / uy * ux, 'y': {y}::DOUBLE}} END" for y in (0, 1079)]


def _sql_outer_edges(want: str, turned: str) -> str:
    """CTEs from want(image, line, a, b, i): best, the outer pair of edges of markers a and b, and hit, the farthest two points of its line on the frame."""
    return f"""WITH {_STATS}, eg AS (SELECT image, m, k, {_OF('x', 0)} AS ax, {_OF('y', 0)} AS ay, {_OF('x', 1)} AS bx, {_OF('y', 1)} AS by FROM c, range(4) AS r(k)),
big AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY area DESC, m) AS size_rank FROM st QUALIFY size_rank <= 3),
{want},
pr AS (SELECT w.*, e.k AS ek, f.k AS fk, e.ax AS ex, e.ay AS ey, e.bx AS gx, e.by AS gy, f.ax AS fx, f.ay AS fy, f.bx AS hx, f.by AS hy, (e.ax + e.bx + f.ax + f.bx) / 4 AS ox, (e.ay + e.by + f.ay + f.by) / 4 AS oy,
    p.cx AS pcx, p.cy AS pcy, q.cx AS qcx, q.cy AS qcy, o.cx AS icx, o.cy AS icy
    FROM want w JOIN eg e ON e.image = w.image AND e.m = w.a JOIN eg f ON f.image = w.image AND f.m = w.b JOIN st p ON p.image = w.image AND p.m = w.a JOIN st q ON q.image = w.image AND q.m = w.b JOIN st o ON o.image = w.image AND o.m = w.i),
an AS (SELECT *, 0.5::DOUBLE * atan2(2 * ({_SPREAD(_PX, _PY)}), ({_SPREAD(_PX, _PX)}) - ({_SPREAD(_PY, _PY)})) AS t, sqrt((qcx - pcx) * (qcx - pcx) + (qcy - pcy) * (qcy - pcy)) AS way FROM pr),
di AS (SELECT *, cos(t) AS dx, sin(t) AS dy FROM an),
sc AS (SELECT *, sqrt(({' + '.join(f'pow(({x} - ox) * dy - ({y} - oy) * dx, 2)' for x, y in zip(_PX, _PY, strict=True))}) / 4) + 20 * {turned} AS score, abs((icx - ox) * dy - (icy - oy) * dx) AS away FROM di),
best AS (SELECT *, ox + dx - ox AS ux, oy + dy - oy AS uy FROM (SELECT *, min(score) OVER (PARTITION BY image, line) AS least FROM sc) WHERE score <= least + 3 QUALIFY row_number() OVER (PARTITION BY image, line ORDER BY away DESC, ek, fk) = 1),
hits AS (SELECT image, line, list_filter([{', '.join(_SCALED_HIT)}], lambda p: p IS NOT NULL) AS h FROM best),
ij AS (SELECT image, line, h[i] AS p, h[j] AS q, i, j FROM hits, range(1, 5) AS a(i), range(1, 5) AS b(j) WHERE i < j AND j <= len(h)),
hit AS (SELECT * FROM ij QUALIFY row_number() OVER (PARTITION BY image, line ORDER BY sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) DESC, i, j) = 1)"""


def _sql_points(name: str, *points: str) -> str:
    xy = ", ".join(f"{{\"x\":' || {sql_round(f'{p}.x', 2)} || ',\"y\":' || {sql_round(f'{p}.y', 2)} || '}}" for p in points)
    return f"""'{{"name":"{name}","points":[{xy.replace('}, {', '},{')}]}}'"""


_CORNER_LINES = _sql_outer_edges("""ro AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY cy) AS k FROM big),
want AS (SELECT a.image, l.line, CASE l.line WHEN 1 THEN a.m ELSE b.m END AS a, c.m AS b, CASE l.line WHEN 1 THEN b.m ELSE a.m END AS i, CASE WHEN a.cx < b.cx THEN 'left' ELSE 'right' END AS view_side
    FROM ro a JOIN ro b ON a.image = b.image AND b.k = 2 JOIN ro c ON a.image = c.image AND c.k = 3, (VALUES (1), (2)) AS l(line) WHERE a.k = 1)""", "abs(dx * (qcy - pcy) / way - dy * (qcx - pcx) / way)")


@query(f"""{_CORNER_LINES},
two AS (SELECT t.image, t.view_side, t.b AS vertex_marker, list_intersect([t.fk, (t.fk + 1) % 4], [s.fk, (s.fk + 1) % 4]) AS shared, t.ux * s.uy - t.uy * s.ux AS den, ((s.ox - t.ox) * s.uy - (s.oy - t.oy) * s.ux) AS num,
    t.ox AS tox, t.oy AS toy, t.ux AS tux, t.uy AS tuy, ((t.fx + t.hx) / 2 + (s.fx + s.hx) / 2) / 2 AS mx, ((t.fy + t.hy) / 2 + (s.fy + s.hy) / 2) / 2 AS my, {{'x': (t.ex + t.gx) / 2, 'y': (t.ey + t.gy) / 2}} AS tend, {{'x': (s.ex + s.gx) / 2, 'y': (s.ey + s.gy) / 2}} AS send
    FROM best t JOIN best s ON s.image = t.image AND t.line = 1 AND s.line = 2),
met AS (SELECT *, CASE WHEN abs(den) >= 1e-9 THEN tox + num / den * tux END AS ix, CASE WHEN abs(den) >= 1e-9 THEN toy + num / den * tuy END AS iy FROM two),
ver AS (SELECT met.*, CASE WHEN len(shared) = 1 THEN {{'x': eg.ax, 'y': eg.ay}} WHEN ix BETWEEN -153.6::DOUBLE AND 1919 + 153.6::DOUBLE AND iy BETWEEN -153.6::DOUBLE AND 1079 + 153.6::DOUBLE THEN {{'x': ix, 'y': iy}} ELSE {{'x': mx, 'y': my}} END AS v
    FROM met LEFT JOIN eg ON eg.image = met.image AND eg.m = met.vertex_marker AND eg.k = shared[1]),
far AS (SELECT ver.*, t.p AS tp, t.q AS tq, s.p AS sp, s.q AS sq FROM ver LEFT JOIN hit t ON t.image = ver.image AND t.line = 1 LEFT JOIN hit s ON s.image = ver.image AND s.line = 2),
fin AS (SELECT *, {', '.join(f"CASE WHEN {k}p IS NULL OR sqrt((v.x - {k}end.x) * (v.x - {k}end.x) + (v.y - {k}end.y) * (v.y - {k}end.y)) < 1e-9 THEN {k}end WHEN ({k}q.x - v.x) * ({k}end.x - v.x) + ({k}q.y - v.y) * ({k}end.y - v.y) > ({k}p.x - v.x) * ({k}end.x - v.x) + ({k}p.y - v.y) * ({k}end.y - v.y) THEN {k}q ELSE {k}p END AS {k}far" for k in ('t', 's'))} FROM far)
SELECT image, view_side, {sql_round('v.x', 2)} AS vertex_x, {sql_round('v.y', 2)} AS vertex_y, '[' || {_sql_points('top_to_vertex', 'tfar', 'v')} || ',' || {_sql_points('side_to_vertex', 'sfar', 'v')} || ']' AS lines FROM fin""")
def view2_marker_lines(spark, d):
    made = markers.corner_lines(markers.measured(M.markers(spark, d)))
    return made.select("image", "view_side", F.col("vertex_point.x").alias("vertex_x"), F.col("vertex_point.y").alias("vertex_y"), F.to_json("lines").alias("lines"))


_UPRIGHT = _sql_outer_edges("""tri AS (SELECT image, x.m AS xm, y.m AS ym, 6 - x.size_rank - y.size_rank AS other, x.size_rank AS r, y.size_rank AS q, x.cy AS xy, y.cy AS yy, abs(x.cx - y.cx) / (abs(x.cy - y.cy) + 1) AS lean
    FROM big x JOIN big y USING (image) WHERE x.size_rank < y.size_rank QUALIFY row_number() OVER (PARTITION BY image ORDER BY lean, r, q) = 1),
want AS (SELECT tri.image, 1 AS line, CASE WHEN yy < xy THEN ym ELSE xm END AS a, CASE WHEN yy < xy THEN xm ELSE ym END AS b, z.m AS i FROM tri JOIN big z ON z.image = tri.image AND z.size_rank = other)""", "abs(dx)")


@query(f"""{_UPRIGHT},
ends AS (SELECT best.image, icx, icy, CASE WHEN p IS NULL THEN {{'x': {sql_round('(ex + gx) / 2', 2)}, 'y': {sql_round('(ey + gy) / 2', 2)}}} WHEN q.y < p.y OR q.y = p.y AND q.x < p.x THEN q ELSE p END AS a,
    CASE WHEN p IS NULL THEN {{'x': {sql_round('(fx + hx) / 2', 2)}, 'y': {sql_round('(fy + hy) / 2', 2)}}} WHEN q.y < p.y OR q.y = p.y AND q.x < p.x THEN p ELSE q END AS b FROM best LEFT JOIN hit USING (image, line))
SELECT image, CASE WHEN (icx - a.x) * (b.y - a.y) - (icy - a.y) * (b.x - a.x) > 0 THEN 'left' ELSE 'right' END AS view_side, '[' || {_sql_points('view3_vertical_outer_line', 'a', 'b')} || ']' AS lines FROM ends""")
def view3_marker_line(spark, d):
    made = markers.upright_line(markers.measured(M.markers(spark, d)))
    return made.select("image", "view_side", F.to_json("lines").alias("lines"))


@query(f"""WITH RECURSIVE {M.SQL_BOUNCES}, {_PRIMARY}, s AS (SELECT clip_id, count(*) AS frames, count(x) AS detected FROM ev GROUP BY clip_id)
SELECT s.clip_id, frames, detected, frames - detected AS missing, coalesce(n, 0) AS bounce_count, CASE WHEN n IS NULL THEN 'unknown' ELSE 'bounce_detected' END AS result, {sql_round('coalesce(least(greatest(score / 150, 0), 1), 0)', 6)} AS confidence,
CASE WHEN n IS NULL THEN 'detection_unavailable' WHEN s.clip_id % 2 = 1 THEN 'line_config_unavailable' END AS failure_type FROM s LEFT JOIN f ON f.clip_id = s.clip_id AND k = 1""")
def job_summary(spark, d):
    base = M.track(spark, d)
    track = base.withColumn("status", F.when(F.col("x").isNotNull(), "detected").otherwise("missing"))
    bounces = tracks.turning_points(base)
    clips = base.select("clip_id").distinct().withColumn("has_config", F.col("clip_id") % 2 == 0)
    judged = _judged(spark, d, _polygon_court()).where(F.col("clip_id") % 2 == 0)
    made = jobs.summarise(clips, track, bounces, judged)
    return _rounded(made.select("clip_id", "frames", "detected", "missing", "bounce_count", "result", "confidence", "failure_type"), 6, "confidence")


@query(f"""{_CORNER_LINES} SELECT image, CAST(line AS INTEGER) AS line, CAST(ek AS INTEGER) AS first_edge, CAST(fk AS INTEGER) AS second_edge, {sql_round('abs(dx)', 5)} AS direction_x FROM best""")
def edge_pair_selection(spark, d):
    made = markers.measured(M.markers(spark, d)).withColumn("r", markers.corner_roles(F.col("markers")))
    pick = lambda a, b: markers.edge_pair(F.col(f"r.{a}"), F.col("r.vertex"), F.col(f"r.{b}"), toward_other=True, weight=20.0)
    lines = F.array(pick("top_marker", "side_marker"), pick("side_marker", "top_marker"))
    return made.select("image", F.posexplode(lines).alias("at", "e")).select("image", (F.col("at") + 1).alias("line"), "e.first_edge", "e.second_edge", rounded(F.abs("e.direction.x"), 5).alias("direction_x"))


@query(f"WITH RECURSIVE {M.SQL_BOUNCES} SELECT clip_id, frame_index, {sql_round('least(greatest(score / 150, 0), 1)', 6)} AS confidence FROM b")
def bounce_confidence(spark, d):
    found = tracks.turning_points(M.track(spark, d))
    return found.select("clip_id", "frame_index", rounded(tracks.confidence(F.col("score")), 6).alias("confidence"))


def _record(**given) -> Column:
    """A court record with the ``given`` fields, all others null."""
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in courts.RECORD])


@query(f"""WITH l AS ({_HALF}) SELECT s_suppkey, 4 AS n_vertices, {sql_round('CASE WHEN s_suppkey % 2 = 0 THEN 999 * 799 - (tx + bx) / 2 * 799 ELSE (tx + bx) / 2 * 799 END', 1)} AS area, {sql_round('tx', 3)} AS start_x, {sql_round('bx', 3)} AS end_x FROM l""")
def view3_polygon(spark, d):
    """A line across the frame; even records name their side, odd ones have a point on it."""
    videos = M.table(spark, d, "supplier").selectExpr("s_suppkey", "CAST(200 + s_suppkey % 600 AS DOUBLE) AS tx", "CAST(150 + (s_suppkey * 7) % 700 AS DOUBLE) AS bx")
    none = F.lit(None).cast("array<array<double>>")
    line = F.struct(F.lit("line").alias("name"), F.array(F.array("tx", F.lit(0.0)), F.array("bx", F.lit(799.0))).alias("points"), none.alias("extended_endpoints"), none.alias("segment_endpoints"))
    odd = F.col("s_suppkey") % 2 == 1
    r = _record(width=F.lit(1000.0), height=F.lit(800.0), lines=F.array(line), view_side=F.when(~odd, F.lit("left")), inside_point=F.when(odd, F.array(F.lit(10.0), F.lit(400.0))))
    made = videos.withColumn("r", r).withColumn("p", courts.one_line_polygon(F.col("r"), F.lit(1000.0), F.lit(800.0)))
    return made.select("s_suppkey", F.size("p.polygon").alias("n_vertices"), rounded(G.ring_area(F.col("p.polygon")), 1).alias("area"), F.col("p.line_start.x").alias("start_x"), F.col("p.line_end.x").alias("end_x"))


@query(f"""WITH v AS ({_VIDEO}), s(i, rw, rh) AS (VALUES {_SIZES}), r AS (SELECT s_suppkey, i, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(rw / rh - w / h) * 1000 + abs(rw - w) + abs(rh - h), i) AS k FROM v, s)
SELECT s_suppkey, 'court' || CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 7 < 5 THEN s_suppkey % 7 END WHEN 1 THEN i ELSE CASE WHEN s_suppkey % 6 < 5 THEN s_suppkey % 6 END END AS image FROM r WHERE k = 1""")
def court_select(spark, d):
    """By image name, by size, or by index; names and indexes that no record has give null."""
    records_ = F.array(*[_record(image=F.lit(f"court{i}"), width=F.lit(w), height=F.lit(h)) for i, (w, h) in enumerate(M.SIZES)])
    videos = M.table(spark, d, "supplier").selectExpr("s_suppkey", "s_suppkey % 3 AS way", "CAST(600 + (s_suppkey * 37) % 1500 AS DOUBLE) AS w", "CAST(400 + (s_suppkey * 53) % 1500 AS DOUBLE) AS h")
    name = F.when(F.col("way") == 0, F.concat(F.lit("shots/court"), F.col("s_suppkey") % 7))
    sized = lambda c: F.when(F.col("way") == 1, F.col(c))
    found = courts.select_record(records_, name, sized("w"), sized("h"), (F.col("s_suppkey") % 6).cast("int"))
    return videos.withColumn("r", found).select("s_suppkey", "r.image")


_RESULT = """CASE o_orderkey % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'OUT' WHEN 2 THEN 'unknown' END"""


@query(f"""SELECT o_orderkey AS job_id, upper({_RESULT}) AS decision, CASE upper({_RESULT}) WHEN 'IN' THEN true WHEN 'OUT' THEN false END AS is_in, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_bounces,
CAST(CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 1 END AS INTEGER) AS n_decisions, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_artifacts FROM orders""")
def frontend_result(spark, d):
    """Jobs with and without bounces, decisions and artifacts, flattened for clients."""
    seen = jobs.frontend_view(_frontend_jobs(spark, d))
    return seen.select("job_id", "decision", "is_in", F.size("bounces").alias("n_bounces"), F.size("decisions").alias("n_decisions"), F.size("artifacts").alias("n_artifacts"))


def _frontend_jobs(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    decision = F.struct(F.expr(_RESULT).alias("decision"), F.lit("why").alias("decision_reason"))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    return M.table(spark, d, "orders").select(
        k.alias("job_id"), F.col("o_custkey").alias("session_id"), *none("status", "result", "failure_type", "failure_reason", "video_readable", "recording_accessible", "timing", "primary_bounce", "error"), F.lit(0.5).alias("confidence"),
        F.when(k % 5 != 0, F.array(F.lit(1.0), F.lit(2.0))).alias("bounces"), F.when(k % 4 != 3, F.struct(decision.alias("primary_decision"), F.array(decision).alias("decisions"))).alias("inout"),
        F.when(k % 6 != 0, F.create_map(F.lit("clip"), F.lit("/files/clip"))).alias("artifacts"))


@query(f"""WITH o AS (SELECT *, {_RESULT} AS decision, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), r AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN day || 'T09:15:00' WHEN o_orderkey % 3 = 1 THEN day || 'T00:00:00' WHEN o_custkey % 2 = 0 THEN '2020-02-02T02:02:02' ELSE '2030-01-01T00:00:00' END AS stamp FROM o WHERE o_orderstatus = 'F')
SELECT 'j' || o_orderkey AS job_id, stamp AS recorded_at, CASE WHEN o_orderkey % 3 = 1 THEN day ELSE substr(stamp, 1, 10) END AS recorded_date, coalesce(decision, 'UNKNOWN') AS decision, CASE WHEN o_custkey % 2 = 0 THEN 's' || o_custkey || '.mp4' END AS video_path, CASE WHEN o_orderkey % 6 <> 0 THEN '/files/clip' END AS clip_url FROM r""")
def saved_record(spark, d):
    """Finished jobs as records: the time asked for, else the date, else the session's, else that of the request."""
    o, k = M.table(spark, d, "orders"), F.col("o_orderkey")
    day, job = F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("j"), k).alias("job_id")
    status = F.when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    done = o.select(job, F.col("o_custkey").alias("session_id"), status.alias("status"), F.expr(_RESULT).alias("decision"), F.lit(None).cast("string").alias("decision_reason"), F.col("o_totalprice").alias("confidence"),
                    F.when(k % 6 != 0, F.create_map(F.lit("clip"), F.lit("/files/clip"))).alias("artifacts"), *[F.lit("{}").alias(c) for c in records.JSON])
    asked = o.select(job, F.lit("singles").alias("match_type"), F.when(k % 3 == 0, F.concat(day, F.lit("T09:15:00"))).alias("recorded_at"), F.when(k % 3 == 1, day).alias("recorded_date"), F.lit("2030-01-01T00:00:00").alias("created_at"))
    c = F.col("o_custkey")
    sessions = o.where(c % 2 == 0).select(c.alias("session_id"), F.concat(F.lit("s"), c, F.lit(".mp4")).alias("recording_path"), F.lit(None).cast("string").alias("recording_url"), F.lit("2020-02-02T02:02:02").alias("recorded_at")).distinct()
    return records.to_record(done, sessions, asked).select("job_id", "recorded_at", "recorded_date", "decision", "video_path", "clip_url")


_DENSE = "SELECT o_custkey % 40 AS clip_id, CAST(o_orderkey AS INTEGER) AS frame_index, CASE WHEN o_custkey % 40 < 5 THEN CAST(o_orderkey AS DOUBLE) ELSE o_totalprice END AS score FROM orders"


@query(f"""WITH RECURSIVE cand AS ({_DENSE}), ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, frame_index) AS k FROM cand),
nms AS (SELECT clip_id, k, [frame_index] AS kept FROM ranked WHERE k = 1
    UNION ALL SELECT r.clip_id, r.k, CASE WHEN len(list_filter(n.kept, lambda f: abs(f - r.frame_index) < 200)) > 0 THEN n.kept ELSE list_append(n.kept, r.frame_index) END
    FROM nms n JOIN ranked r ON r.clip_id = n.clip_id AND r.k = n.k + 1),
stay AS (SELECT clip_id, unnest(kept) AS frame_index FROM (SELECT clip_id, arg_max(kept, k) AS kept FROM nms GROUP BY clip_id)) SELECT cand.* FROM cand JOIN stay USING (clip_id, frame_index)""")
def dense_suppression(spark, d):
    """Candidates so dense that a clip is one stretch, five clips of rising scores among them."""
    rows = M.table(spark, d, "orders").select(
        (F.col("o_custkey") % 40).alias("clip_id"), F.col("o_orderkey").cast("int").alias("frame_index"), F.when(F.col("o_custkey") % 40 < 5, F.col("o_orderkey").cast("double")).otherwise(F.col("o_totalprice")).alias("score"))
    return tracks.suppress(rows, 200)


#: Numbers of a part by which its court document is made up, the same in both dialects.
_SHAPE = {
    "kind": "p_partkey % 5", "pair": "(p_partkey % 13) = 0", "lines": "floor(p_partkey / 5) % 4", "points": "1 + least(floor(p_partkey / 20) % 3, 1)", "side": "floor(p_partkey / 3) % 4", "sized": "(p_partkey % 7) <> 0",
    "broken": "(p_partkey % 53) = 0", "asked": "(p_partkey % 11) = 0", "same": "(p_partkey % 17) = 0", "ready": "floor(p_partkey / 5) % 4",
}
_SHAPES = ", ".join(f"CAST({v} AS INT) AS {k}" for k, v in _SHAPE.items())


@query(f"""WITH s AS (SELECT p_partkey AS clip_id, {_SHAPES} FROM part), r AS (SELECT clip_id, kind, CASE WHEN broken = 1 THEN 'unreadable_document'
    WHEN kind = 2 THEN CASE ready WHEN 0 THEN 'court_polygon_missing' WHEN 1 THEN 'bad_point' END
    WHEN kind = 3 THEN CASE ready WHEN 0 THEN 'line_points_missing' WHEN 1 THEN 'bad_point' WHEN 2 THEN 'line_points_identical' END
    WHEN asked = 1 THEN 'unknown_image' WHEN pair = 1 THEN 'index_out_of_range' WHEN kind = 4 THEN 'unsupported_kind' WHEN sized = 0 THEN 'no_frame_size'
    WHEN kind = 0 THEN CASE WHEN lines <> 2 THEN 'view2_lines_missing' WHEN points <> 2 THEN 'line_needs_two_ends' END
    ELSE CASE WHEN lines <> 1 THEN 'view3_needs_one_line' WHEN points <> 2 THEN 'line_needs_two_ends' WHEN side > 1 THEN 'view3_needs_a_side' WHEN same = 1 THEN 'line_points_identical' END END AS refused FROM s)
SELECT clip_id, CASE WHEN refused IS NULL THEN CASE WHEN kind = 3 THEN 'line' ELSE 'polygon' END END AS mode, refused FROM r""")
def court_refusals(spark, d):
    """Why each of many made-up configurations is refused, or the mode that it comes to."""
    s = M.table(spark, d, "part").select(F.col("p_partkey").alias("clip_id"), *[F.expr(f"CAST({v} AS INT)").alias(k) for k, v in _SHAPE.items()])
    line = F.when(F.col("points") != 2, "[[100, 0]]").when(F.col("same") == 1, "[[100, 50], [100, 50]]").otherwise("[[100, 0], [200, 300]]")
    lines = F.concat_ws(", ", F.transform(F.expr("if(lines = 0, array(), sequence(1, lines))"), lambda i: F.concat(F.lit('{"name": "l'), i.cast("string"), F.lit('", "points": '), line, F.lit("}"))))
    side = F.get(F.array(F.lit('"left"'), F.lit('"Right"'), F.lit('"middle"'), F.lit("null")), F.col("side"))
    view = F.when(F.col("kind") == 0, "view2").when(F.col("kind") == 1, "view3").otherwise("view9")
    record = F.concat(F.lit('{"image": "a/court.png", "view": "'), view, F.lit('", "view_side": '), side, F.when(F.col("sized") == 1, ', "width": 640, "height": 360').otherwise(""), F.lit(', "lines": ['), lines, F.lit("]}"))
    polygon = F.when(F.col("ready") == 0, '{"mode": "polygon"}').when(F.col("ready") == 1, '{"mode": "polygon", "court_polygon": [[0, 0], [10], [10, 10]]}').otherwise('{"mode": "polygon", "court_polygon": [[0, 0], [10, 0], [10, 10]]}')
    ends = lambda rest: F.lit('{"mode": "line", "line_start": [0, 0]' + rest + "}")
    ready = F.when(F.col("ready") == 0, ends(', "line_end": [9, 9]')).when(F.col("ready") == 1, ends(', "line_end": [9], "inside_point": [1, 2]')).when(F.col("ready") == 2, ends(', "line_end": [0, 0], "inside_point": [1, 2]')).otherwise(ends(', "line_end": [9, 9], "inside_point": [1, 2]'))
    document = F.when(F.col("broken") == 1, '[{"image": ').when(F.col("kind") == 2, polygon).when(F.col("kind") == 3, ready).otherwise(F.concat(F.lit("["), record, F.when(F.col("pair") == 1, F.concat(F.lit(", "), record)).otherwise(""), F.lit("]")))
    none = F.lit(None).cast("double")
    configs = s.select("clip_id", document.alias("document"), none.alias("target_width"), none.alias("target_height"), F.when(F.col("asked") == 1, "b/nowhere.png").alias("config_image"), F.when(F.col("pair") == 1, 5).alias("config_index"))
    return courts.normalize(configs).select("clip_id", "mode", "refused")


_POINTS = "SELECT event_id, CASE WHEN event_id % 19 <> 0 THEN event_id % 101 + 0.25::DOUBLE END AS x, CASE WHEN event_id % 23 <> 0 THEN value END AS y, event_id % 6 AS k FROM events"


@query(f"""WITH p AS ({_POINTS}), r AS (SELECT *, CASE WHEN k = 0 THEN 'no_config' WHEN k = 1 THEN 'unsupported_mode' WHEN x IS NULL OR y IS NULL THEN 'coordinates_missing' WHEN k = 2 THEN 'court_polygon_missing' WHEN k = 3 THEN 'line_points_missing' WHEN k = 4 THEN 'line_points_identical' END AS refused FROM p)
SELECT event_id, CASE WHEN refused IS NULL THEN CASE WHEN abs(x - 50) <= 3 OR x < 50 THEN 'IN' ELSE 'OUT' END END AS decision, refused FROM r""")
def judge_refusals(spark, d):
    """Points by six kinds of configurations, five of which can't judge."""
    points = M.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 19 != 0, F.col("event_id") % 101 + F.lit(0.25)).alias("x"), F.when(F.col("event_id") % 23 != 0, F.col("value")).alias("y"), (F.col("event_id") % 6).alias("clip_id"))
    at = lambda case, x, y: F.when(case, G.point(x, y))
    k = F.col("clip_id")
    settings = points.select("clip_id").distinct().where("clip_id > 0").select(
        "clip_id", F.when(k == 1, "Polygon").when(k == 2, "polygon").otherwise("line").alias("mode"), F.lit(None).cast(G.RING).alias("court_polygon"), at(k > 3, 50, 0).alias("line_start"),
        F.when(k == 4, G.point(50, 0)).otherwise(G.point(50, 100)).alias("line_end"), at(k > 3, 10, 50).alias("inside_point"), F.lit(3.0).alias("line_tolerance_px"))
    return courts.judge(points, settings, refused="refused").select("event_id", "decision", "refused")


_BATCH = """SELECT CASE WHEN o_orderkey % 24 < 12 THEN 's' ELSE 'r' END || (o_orderkey - o_orderkey % 8) AS id, 'j' || o_orderkey AS job_id, CASE WHEN o_orderkey % 36 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS created_at, CASE WHEN o_orderkey % 28 = 0 THEN 'mixed' WHEN o_orderkey % 20 <> 0 THEN 'singles' END AS match_type
    FROM orders WHERE o_orderkey % 4 = 0"""


@query(f"""WITH {M.SQL_RECORDS}, b AS ({_BATCH}), f AS (SELECT id, (min({{'c': created_at, 'j': job_id}})).j AS first FROM (SELECT id, coalesce(created_at, '') AS created_at, job_id FROM b) GROUP BY id)
SELECT b.id, b.job_id, concat_ws(',', CASE WHEN created_at IS NULL THEN 'created_at' END, CASE WHEN match_type IS NULL THEN 'match_type' END, CASE WHEN match_type = 'mixed' THEN 'match_type' END, CASE WHEN held IS NULL AND first <> b.job_id THEN 'id_repeated' END, CASE WHEN held <> b.job_id THEN 'id_of_another_job' END) AS violated
FROM b LEFT JOIN f USING (id) LEFT JOIN (SELECT id, job_id AS held FROM rec) USING (id)""")
def record_offences(spark, d):
    """A batch of records in which some ids are another job's, in the table or in the batch, and some columns are missing or out of range."""
    key = F.col("o_orderkey")
    batch = M.table(spark, d, "orders").where(key % 4 == 0).select(
        F.concat(F.when(key % 24 < 12, "s").otherwise("r"), key - key % 8).alias("id"), F.concat(F.lit("j"), key).alias("job_id"), F.when(key % 36 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("created_at"),
        F.when(key % 28 == 0, "mixed").when(key % 20 != 0, "singles").alias("match_type"), F.lit("t").alias("recorded_at"), F.lit("IN").alias("decision"), F.lit("{}").alias("job_result_json"))
    return records.offences(batch, M.records(spark, d)).select("id", "job_id", F.concat_ws(",", "violated").alias("violated"))


_SEGMENTS = """CASE kind WHEN 0 THEN [[(p + 10) / 2, 0, 350, 200], [0, (p % 300 + 20) / 2, 350, 200]] WHEN 1 THEN [[p / 2, 0, (p + 100) / 2, 359.5]] WHEN 2 THEN [[1, 2, p, 4]] ELSE [[p, 0, p, 100]] END"""


@query(f"""WITH s AS (SELECT p_partkey AS clip_id, p_partkey % 4 AS kind, CAST(p_partkey % 600 AS DOUBLE) AS p FROM part), g AS (SELECT clip_id, kind, {_SEGMENTS} AS segments FROM s)
SELECT clip_id, CAST(i AS INTEGER) AS frame_index, kind <> 3 AS has_polygon, array_to_string(list_transform(segments, lambda x: array_to_string(list_transform(x, lambda v: CAST(CAST(round_even(v, 0) AS INTEGER) AS VARCHAR)), ' ')), ', ') AS segments FROM g, range(2) AS f(i)""")
def court_segments(spark, d):
    """The court lines of four kinds of configurations on each frame of their clips, in pixels of half the record's size."""
    p, kind = (F.col("p_partkey") % 600).cast("string"), F.col("p_partkey") % 4
    low = (F.col("p_partkey") % 600 % 300 + 20).cast("string")
    plus = lambda n: (F.col("p_partkey") % 600 + n).cast("string")
    size = ', "width": 1280, "height": 720, '
    two = F.concat(F.lit('[{"view": "view2"' + size + '"vertex_point": [700, 400], "lines": [{"name": "top_to_vertex", "points": [['), plus(10), F.lit(', 0], [690, 390]]}, {"name": "side_to_vertex", "points": [[0, '), low, F.lit("], [690, 395]]}]}]"))
    one = F.concat(F.lit('[{"view": "view3"' + size + '"view_side": "left", "lines": [{"extended_endpoints": [['), p, F.lit(", 0], ["), plus(100), F.lit(", 719]]}]}]"))
    ring = F.concat(F.lit('{"mode": "polygon", "court_polygon": [[0, 0], [9, 0], [9, 9]], "view2_line_segments": [[[1, 2], ['), p, F.lit(", 4]], [[5, 6]]]}"))
    line = F.concat(F.lit('{"mode": "line", "inside_point": [-5, 50], "line_start": ['), p, F.lit(', 0], "line_end": ['), p, F.lit(", 100]}"))
    configs = M.table(spark, d, "part").select(
        F.col("p_partkey").alias("clip_id"), F.when(kind == 0, two).when(kind == 1, one).when(kind == 2, ring).otherwise(line).alias("document"), F.lit(640.0).alias("target_width"), F.lit(360.0).alias("target_height"), F.lit(None).cast("string").alias("config_image"), F.lit(0).alias("config_index"))
    frames = configs.select("clip_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("frame_index"))
    said = F.array_join(F.transform("segments", lambda s: F.concat_ws(" ", s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])), ", ")
    return overlay.with_court(frames, courts.normalize(configs)).select("clip_id", "frame_index", F.col("polygon").isNotNull().alias("has_polygon"), said.alias("segments"))


_BOUNCE_STRUCT = "{'frame_index': CAST(o_orderkey % 500 AS INTEGER), 'x': CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 + 0.5::DOUBLE END, 'note': CASE WHEN o_orderkey % 2 = 0 THEN 'Łódź \"é\"' END}"


@query(f"""WITH o AS (SELECT 'j' || o_orderkey AS job_id, CASE WHEN o_orderkey % 5 <> 0 THEN {_BOUNCE_STRUCT} END AS primary_bounce, CASE WHEN o_orderkey % 4 <> 0 THEN {{'decision': 'IN', 'signed_distance_px': CAST(NULL AS DOUBLE)}} END AS primary_decision,
    CASE o_orderkey % 3 WHEN 0 THEN CAST([] AS INTEGER[]) WHEN 1 THEN [1, NULL] END AS frames FROM orders)
SELECT job_id, CAST(to_json(primary_bounce) AS VARCHAR) AS primary_bounce_json, CAST(to_json(primary_decision) AS VARCHAR) AS primary_decision_json, CAST(to_json({{'job_id': job_id, 'primary_bounce': primary_bounce, 'frames': frames}}) AS VARCHAR) AS job_result_json,
    primary_bounce.frame_index AS frame_index, primary_bounce.note AS note FROM o""")
def record_json(spark, d):
    """Nested values with nulls, empty lists and letters beyond ASCII as the JSON of a record, and read back as variants."""
    k = F.col("o_orderkey")
    bounce = F.struct((k % 500).cast("int").alias("frame_index"), F.when(k % 3 != 0, k % 7 + F.lit(0.5)).alias("x"), F.when(k % 2 == 0, 'Łódź "é"').alias("note"))
    made = M.table(spark, d, "orders").select(
        F.concat(F.lit("j"), k).alias("job_id"), F.when(k % 5 != 0, bounce).alias("primary_bounce"), F.when(k % 4 != 0, F.struct(F.lit("IN").alias("decision"), F.lit(None).cast("double").alias("signed_distance_px"))).alias("primary_decision"),
        F.when(k % 3 == 0, F.array().cast("array<int>")).when(k % 3 == 1, F.array(F.lit(1), F.lit(None).cast("int"))).alias("frames"))
    coded = records.with_json(made, ["job_id", "primary_bounce", "frames"]).drop("primary_bounce", "primary_decision", "frames")
    back = records.as_variants(coded.withColumns({f"_{c}": F.col(c) for c in records.JSON}))
    return back.select("job_id", *[F.col(f"_{c}").alias(c) for c in records.JSON], F.try_variant_get("primary_bounce", "$.frame_index", "int").alias("frame_index"), F.try_variant_get("primary_bounce", "$.note", "string").alias("note"))


@query(f"""WITH RECURSIVE {M.SQL_BOUNCES}, s AS (SELECT clip_id, count(*) AS frames, count(x) AS detected FROM ev GROUP BY clip_id), n AS (SELECT clip_id, count(*) AS n, min(frame_index) AS first FROM b GROUP BY clip_id)
SELECT s.clip_id, s.clip_id % 50 + 5.0::DOUBLE AS end_sec, CAST(frames AS INTEGER) AS frame_count, frames - detected AS missing, CAST(coalesce(n, 0) AS INTEGER) AS n_bounces, first AS first_frame, {sql_round('first / 30::DOUBLE + s.clip_id % 50', 4)} AS first_sec,
    CASE WHEN s.clip_id % 2 = 0 THEN 'court' || s.clip_id || '.json' END AS court_config, CASE WHEN s.clip_id % 2 = 0 THEN CASE WHEN n IS NULL THEN 'no_bounce' ELSE 'done' END END AS inout_status,
    '{{"clip":"' || CASE WHEN s.clip_id % 5 = 0 THEN '/files/again' ELSE '/files/c' END || s.clip_id || '"' || CASE WHEN s.clip_id % 2 = 0 THEN ',"inout_csv":"/files/i' || s.clip_id || '"' ELSE '' END || ',"track_csv":"/files/t' || s.clip_id || '"}}' AS artifacts
FROM s LEFT JOIN n USING (clip_id)""")
def job_result(spark, d):
    """Whole results of jobs with their nested parts; artifacts of a later step replace those of the same name."""
    base = M.track(spark, d)
    track, bounces, c = base.withColumn("status", F.when(F.col("x").isNotNull(), "detected").otherwise("missing")), tracks.turning_points(base), F.col("clip_id")
    own = base.groupBy("clip_id").agg(F.count("*").cast("int").alias("frames_written"))
    clips = own.select("clip_id", (c % 50).cast("double").alias("start_sec"), (c % 50 + 5).cast("double").alias("end_sec"), F.lit(30.0).alias("fps"), F.lit(640).alias("width"), F.lit(360).alias("height"), "frames_written",
                       F.lit("track.csv").alias("track_csv"), F.lit("bounces.csv").alias("bounces_csv"), F.when(c % 2 == 0, F.concat(F.lit("court"), c, F.lit(".json"))).alias("court_config"))
    judged = courts.judge(bounces, own.where(c % 2 == 0).select("clip_id", *_polygon_court()))
    summary = jobs.summarise(own.select("clip_id", (c % 2 == 0).alias("has_config")), track, bounces, judged)
    url = lambda name, case=None: F.concat(F.lit(f"/files/{name}"), c) if case is None else F.when(case, F.concat(F.lit(f"/files/{name}"), c))
    steps = [(0, "clip", url("c")), (0, "track_csv", url("t")), (0, "result_video", F.lit(None).cast("string")), (1, "inout_csv", url("i", c % 2 == 0)), (1, "clip", url("again", c % 5 == 0))]
    artifacts = own.select("clip_id", F.inline(F.array(*[F.struct(F.lit(step).alias("step"), F.lit(name).alias("name"), at.alias("url")) for step, name, at in steps])))
    first = F.get("bounces", F.lit(0))
    made = jobs.results(summary, clips, bounces.join(clips.select("clip_id", F.col("start_sec").alias("clip_start_sec")), "clip_id"), artifacts)
    return made.select(
        "clip_id", "clip.end_sec", "clip.frame_count", "tracking.missing", F.size("inout_input.bounces").alias("n_bounces"), first["frame_index"].alias("first_frame"), rounded(first["recording_time_sec"], 4).alias("first_sec"), "inout_input.court_config", "inout.inout_status",
        F.to_json("artifacts").alias("artifacts"))


@query(f"""SELECT o_orderkey AS job_id, o_custkey AS session_id, CASE WHEN o_orderkey % 5 = 0 THEN '[]' ELSE '[1.0,2.0]' END AS bounces, CASE WHEN o_orderkey % 4 = 3 THEN '[]' ELSE '[{{"decision":' || coalesce('"' || {_RESULT} || '"', 'null') || ',"decision_reason":"why"}}]' END AS decisions,
CASE WHEN o_orderkey % 4 <> 3 THEN 'why' END AS decision_reason, CASE WHEN o_orderkey % 6 = 0 THEN '{{}}' ELSE '{{"clip":"/files/clip"}}' END AS artifacts, 0.5::DOUBLE AS confidence FROM orders""")
def frontend_content(spark, d):
    """What clients read of jobs: lists and maps with all that is in them, empty where the job has none."""
    seen = jobs.frontend_view(_frontend_jobs(spark, d))
    return seen.select("job_id", "session_id", X.as_json(F.col("bounces")).alias("bounces"), X.as_json(F.col("decisions")).alias("decisions"), "primary_decision.decision_reason", X.as_json(F.col("artifacts")).alias("artifacts"), "confidence")


def _border(edge: str, along: str) -> str:
    """A point on one of the four edges of a frame of 1000 by 800, and how far it is along the border, clockwise from the left upper corner."""
    x, y = f"CAST(50 + {along} % 900 AS DOUBLE)", f"CAST(50 + {along} % 700 AS DOUBLE)"
    return f"""CASE {edge} WHEN 0 THEN {{'x': {x}, 'y': 0::DOUBLE, 'at': {x}}} WHEN 1 THEN {{'x': 999::DOUBLE, 'y': {y}, 'at': 999 + {y}}} WHEN 2 THEN {{'x': {x}, 'y': 799::DOUBLE, 'at': 2797 - {x}}} ELSE {{'x': 0::DOUBLE, 'y': {y}, 'at': 3596 - {y}}} END"""


_FRAME = "[{'x': 0::DOUBLE, 'y': 0::DOUBLE, 'at': 0::DOUBLE}, {'x': 999, 'y': 0, 'at': 999}, {'x': 999, 'y': 799, 'at': 1798}, {'x': 0, 'y': 799, 'at': 2797}]"
_PASSED = "list_filter(frame, lambda q: (q.at > {s}.at AND q.at < {e}.at + CASE WHEN {e}.at < {s}.at THEN 3596 ELSE 0 END) OR (q.at + 3596 > {s}.at AND q.at + 3596 < {e}.at + CASE WHEN {e}.at < {s}.at THEN 3596 ELSE 0 END))"


@query(f"""WITH p AS (SELECT p_partkey, {_FRAME} AS frame, {_border('p_partkey % 4', '(p_partkey * 7)')} AS s, {_border('floor(p_partkey / 4) % 4', '(p_partkey * 19 + 3)')} AS e FROM part),
a AS (SELECT p_partkey, list_concat(list_concat([s], {_PASSED.format(s='s', e='e')}), [e]) AS one, list_reverse(list_concat(list_concat([e], {_PASSED.format(s='e', e='s')}), [s])) AS two FROM p),
r AS (SELECT p_partkey, list_append(list_transform(CASE WHEN list_sum(list_transform(one, lambda q: q.y)) / len(one) <= list_sum(list_transform(two, lambda q: q.y)) / len(two) THEN one ELSE two END, lambda q: {{'x': q.x, 'y': q.y}}), {{'x': 500::DOUBLE, 'y': 400::DOUBLE}}) AS ring FROM a)
SELECT p_partkey, CAST(len(ring) AS INTEGER) AS n_vertices, {sql_round('abs(list_sum(list_transform(range(1, len(ring) + 1), lambda i: ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y))) / 2', 1)} AS area,
    array_to_string(list_transform(ring, lambda q: CAST(CAST(q.x AS INTEGER) AS VARCHAR) || ' ' || CAST(CAST(q.y AS INTEGER) AS VARCHAR)), ', ') AS ring FROM r""")
def view2_layouts(spark, d):
    """Two-line records whose border ends lie on any two of the frame's edges, one edge twice too; arcs that pass the left upper corner among them."""
    k = F.col("p_partkey")

    def border(edge: Column, along: Column) -> Column:
        x, y = (50 + along % 900).cast("double"), (50 + along % 700).cast("double")
        at = lambda a, b: F.array(a, b)
        return F.when(edge == 0, at(x, F.lit(0.0))).when(edge == 1, at(F.lit(999.0), y)).when(edge == 2, at(x, F.lit(799.0))).otherwise(at(F.lit(0.0), y))

    none = F.lit(None).cast("array<array<double>>")
    inner = F.array(F.lit(480.0), F.lit(390.0))
    line = lambda name, end: F.struct(F.lit(name).alias("name"), F.array(inner, end).alias("points"), none.alias("extended_endpoints"), none.alias("segment_endpoints"))
    r = _record(width=F.lit(1000.0), height=F.lit(800.0), vertex_point=F.array(F.lit(500.0), F.lit(400.0)), lines=F.array(line("side_to_vertex", border(F.floor(k / 4) % 4, k * 19 + 3)), line("top_to_vertex", border(k % 4, k * 7))))
    made = M.table(spark, d, "part").withColumn("r", r).withColumn("ring", courts.two_line_polygon(F.col("r"), F.lit(1000.0), F.lit(800.0))["polygon"])
    said = F.array_join(F.transform("ring", lambda q: F.concat_ws(" ", q["x"].cast("int"), q["y"].cast("int"))), ", ")
    return made.select("p_partkey", F.size("ring").alias("n_vertices"), rounded(G.ring_area(F.col("ring")), 1).alias("area"), said.alias("ring"))


_AFTER_TRACK = M.SQL_BOUNCES.removeprefix(M.SQL_TRACK)


@query(f"""WITH RECURSIVE {_SPINE.removeprefix('WITH ')}, ev AS (SELECT clip_id, frame_index, x, y FROM tr){_AFTER_TRACK}, {_PRIMARY}, {M.SQL_COURT},
{sql_judge(f"SELECT clip_id * 1000000 + frame_index AS key, {sql_round('x', 2)} AS x, {sql_round('y', 2)} AS y FROM b WHERE clip_id % 2 = 0")},
verdict AS (SELECT key // 1000000 AS clip_id, CAST(key % 1000000 AS INTEGER) AS frame_index, {_VERDICT} FROM far), decided AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS decision_count FROM verdict QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) = 1),
held AS (SELECT clip_id, count(*) AS frames, count(x) AS detected FROM tr GROUP BY clip_id)
SELECT held.clip_id, frames, detected, coalesce(f.n, 0) AS bounce_count, f.frame_index AS primary_frame, {sql_round('coalesce(least(greatest(f.score / 150, 0), 1), 0)', 6)} AS confidence, decided.frame_index AS decided_frame, decision, decision_reason, boundary_distance_px,
    CASE WHEN held.clip_id % 2 = 0 THEN CASE WHEN decision IS NULL THEN 'no_bounce' ELSE 'done' END END AS inout_status,
    CASE WHEN f.n IS NULL THEN 'detection_unavailable' WHEN held.clip_id % 2 = 1 THEN 'line_config_unavailable' END AS failure_type, CASE WHEN held.clip_id % 10 = 3 THEN 'unreadable_document' END AS refused
FROM held LEFT JOIN f ON f.clip_id = held.clip_id AND f.k = 1 LEFT JOIN decided ON decided.clip_id = held.clip_id""")
def judged_clips(spark, d):
    """The whole plan from boxes to summaries: even clips have a court, of the others some have a document that can't be read."""
    c = F.col("clip_id")
    clips = M.clips(spark, d).withColumn("clip_start_sec", F.lit(0.0))
    court = '{"mode": "polygon", "court_polygon": [' + ", ".join(f"[{x}, {y}]" for x, y in M.COURT) + '], "line_tolerance_px": 3}'
    none = F.lit(None).cast("double")
    configs = clips.where((c % 2 == 0) | (c % 10 == 3)).select("clip_id", F.when(c % 2 == 0, court).otherwise('{"mode": ').alias("document"), none.alias("target_width"), none.alias("target_height"), F.lit(None).cast("string").alias("config_image"), F.lit(0).alias("config_index"))
    made = judge_clips(M.detections(spark, d), clips, configs)
    refused = made.refused.where("stage = 'config'").select("clip_id", "refused")
    joined = made.summary.join(refused, "clip_id", "left")
    return _rounded(joined.select(
        "clip_id", "frames", "detected", "bounce_count", F.col("primary_bounce.frame_index").alias("primary_frame"), "confidence", F.col("primary_decision.frame_index").alias("decided_frame"), "primary_decision.decision", "primary_decision.decision_reason",
        "primary_decision.boundary_distance_px", "inout_status", "failure_type", "refused"), 6, "confidence")
