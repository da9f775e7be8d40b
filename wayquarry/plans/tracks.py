"""Events as points of a track for each user, in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rows as r
from ..operators import tracks as t
from ..operators.surface import run_lengths
from ..sources.files import table
from ..streaming import views

LAT, LNG = "50 + (event_id % 997) / 10000.0", "4 + (event_id % 1009) / 10000.0"


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    # in order of time and number, those without one last
    seq = F.struct(F.col("ts").isNull().alias("no_ts"), "ts", F.col("event_id").isNull().alias("no_id"), "event_id").alias("seq")
    return e.select(F.col("user_id").alias("track_id"), seq, F.expr(LAT).cast("double").alias("lat"), F.expr(LNG).cast("double").alias("lng"),
                    F.when(F.col("event_type") != "error", F.col("value")).alias("ele"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("time"), "event_id", "event_type")


POINTS_SQL = f"""p AS (SELECT user_id AS track_id, ts, event_id, ({LAT})::DOUBLE AS lat, ({LNG})::DOUBLE AS lng, CASE WHEN event_type <> 'error' THEN value END AS ele,
  CASE WHEN event_id % 3 > 0 THEN ts END AS time, event_type FROM events)"""


def track_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Per event: the distance from the start of its user's track."""
    return t.with_distance(points(spark, sf)).select("event_id", F.round("km", 4).alias("km"))


def track_profiles(spark: SparkSession, sf: str) -> DataFrame:
    found = t.profiles(points(spark, sf))
    return found.select(F.col("track_id").alias("user_id"), "n_points", "distance_km", "minutes", "gain", "loss", F.round("start.lat", 4).alias("start_lat"), F.round("end.lng", 4).alias("end_lng"), F.size("profile").cast("long").alias("n_profile"))


def track_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The points that a profile of some 20 points keeps; thinning is the operation itself."""
    return t.sampled(points(spark, sf), 20).select("event_id")


def track_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Events of another type than the one before them."""
    return t.without_repeats(points(spark, sf), ["event_type"]).select("event_id", "event_type")


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events of equal types in a row, as one."""
    e = table(spark, sf, "events").withColumn("length", F.lit(1))
    return run_lengths(e, ["user_id"], ["ts", "event_id"], "event_type", "length").select("user_id", F.col("run").cast("long").alias("run"), "event_type", F.col("length").cast("long").alias("length"))


def running_segments(spark: SparkSession, sf: str) -> DataFrame:
    """What each event's value exceeds the one before it by."""
    e = table(spark, sf, "events")
    return t.segment_lengths(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("segment_km", 4).alias("segment"))


def event_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three purchases of a user are accepted each day; the quota is the operation's own."""
    e = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    done = r.running_quota(e, F.col("event_type") == "purchase", [F.asc("ts"), F.asc("event_id")], 3, ["user_id", "day"])
    return done.groupBy("user_id", "day").agg(F.count_if("accepted").alias("accepted"), F.count_if(F.expr("not accepted and event_type = 'purchase'")).alias("refused"))


def event_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of events that are unique within their type and value."""
    e = table(spark, sf, "events").withColumn("base", F.concat_ws("-", "event_type", F.floor("value").cast("string")))
    return r.ordinals(e, "base", [F.asc("event_id")], "name").select("event_id", "name")


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming scores, over the whole table at once."""
    found = views.scores(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.lit("2024-02-01").cast("timestamp"))
    return found.select("user_id", "views", "purchases", "signups", F.round("score", 6).alias("score"))


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    return views.daily(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("day", F.col("day").cast("date"))


QUERIES = {
    "track_distance": track_distance, "track_profiles": track_profiles, "track_samples": track_samples, "track_repeats": track_repeats, "event_runs": event_runs,
    "running_segments": running_segments, "event_quota": event_quota, "event_names": event_names, "event_scores": event_scores, "event_days": event_days,
}

STEPS_SQL = """s AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM {p} WINDOW w AS (PARTITION BY track_id ORDER BY ts, event_id)),
h AS (SELECT *, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2) AS a FROM s),
d AS (SELECT *, sum(coalesce(6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 0)) OVER (PARTITION BY track_id ORDER BY ts, event_id) AS km FROM h)"""

ORACLE_SQL = {
    "track_distance": f"WITH {POINTS_SQL}, {STEPS_SQL.format(p='p')} SELECT event_id, round(km, 4) AS km FROM d",
    "track_profiles": f"""
WITH {POINTS_SQL}, q AS (SELECT *, lag(lat) OVER w AS a, lag(lng) OVER w AS b, lag(ele) OVER w AS c, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY track_id ORDER BY ts, event_id)),
u AS (SELECT track_id, ts, event_id, lat, lng, ele, time FROM q WHERE k = 1 OR a IS DISTINCT FROM lat OR b IS DISTINCT FROM lng OR c IS DISTINCT FROM ele), {STEPS_SQL.format(p='u')},
e AS (SELECT track_id, ele - lag(ele) OVER (PARTITION BY track_id ORDER BY ts, event_id) AS x FROM u WHERE ele IS NOT NULL),
g AS (SELECT track_id, floor(sum(greatest(x, 0)) + 0.5)::BIGINT AS up, floor(sum(greatest(-x, 0)) + 0.5)::BIGINT AS down FROM e GROUP BY 1),
m AS (SELECT track_id, epoch_us(arg_max(time, (ts, event_id))) - epoch_us(arg_min(time, (ts, event_id))) AS us FROM u WHERE time IS NOT NULL GROUP BY 1),
n AS (SELECT track_id, count(*) AS n_points, floor(max(km) * 100 + 0.5) / 100 AS distance_km, round(arg_min(lat, (ts, event_id)), 4) AS start_lat, round(arg_max(lng, (ts, event_id)), 4) AS end_lng FROM d GROUP BY 1)
SELECT track_id AS user_id, n_points, distance_km, CASE WHEN us > 0 THEN floor(us / 6e7 + 0.5)::BIGINT END AS minutes, nullif(up, 0) AS gain, nullif(down, 0) AS loss, start_lat, end_lng,
  CASE WHEN n_points <= 250 THEN n_points ELSE (n_points - 1) // ceil(n_points / 250.0)::BIGINT + 1 + ((n_points - 1) % ceil(n_points / 250.0)::BIGINT > 0)::BIGINT END AS n_profile
FROM n LEFT JOIN g USING (track_id) LEFT JOIN m USING (track_id) WHERE n_points >= 2""",
    "track_samples": """
WITH k AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id FROM k WHERE n <= 20 OR i % ceil(n / 20.0)::BIGINT = 0 OR i = n - 1""",
    "track_repeats": """
SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type""",
    "event_runs": """
WITH c AS (SELECT *, (lag(event_type) OVER w IS DISTINCT FROM event_type)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM c)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS length FROM i GROUP BY ALL""",
    "running_segments": """
SELECT event_id, round(greatest(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 0), 4) AS segment FROM events""",
    "event_quota": """
WITH b AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY ALL)
SELECT user_id, day, least(n, 3) AS accepted, greatest(n - 3, 0) AS refused FROM b""",
    "event_names": """
WITH b AS (SELECT event_id, event_type || '-' || floor(value)::BIGINT AS base FROM events)
SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '_' || row_number() OVER (PARTITION BY base ORDER BY event_id) ELSE base END AS name FROM b""",
    "event_scores": """
WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'signup') AS signups, min(ts) AS since FROM events GROUP BY 1)
SELECT user_id, views, purchases, signups, round(log10(views + 3 * purchases + 5 * signups + 1) + (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(since)) / 3.6e9 / 48, 6) AS score FROM c""",
    "event_days": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
