"""Queries of request accounting, over the event stream as a log of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.values import span_label
from loomspan.operators import limits as L
from loomspan.sources.tables import table

NOW = "2024-01-30 12:00:00"
WINDOWS = (60, 3600, 86400)


def _log(spark: SparkSession, folder: str) -> DataFrame:
    outcome = F.expr("CASE event_id % 11 WHEN 1 THEN 'blocked' WHEN 2 THEN 'error:Timeout' WHEN 3 THEN 'error:Quota' WHEN 4 THEN 'abandoned' WHEN 5 THEN NULL ELSE 'ok' END")
    cost = F.when(F.pmod("event_id", F.lit(7)) == 0, 100).otherwise(1).cast("long")
    return table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("bucket"), F.col("ts").alias("requested_at"), cost.alias("cost"), outcome.alias("outcome"), F.pmod("user_id", F.lit(3)).alias("pid"))


def _specs(spark: SparkSession) -> DataFrame:
    rows = [(b, w, m) for b in ("view", "click", "purchase", "signup", "error") for w, m in ((60, 2), (3600, 150), (86400, 3000))]
    return spark.createDataFrame(rows, "bucket string, window_sec long, max_cost long")


def rate_usage_multiwindow(spark: SparkSession, folder: str) -> DataFrame:
    """Cost used at each request in the last minute, hour and day."""
    return L.window_usage(_log(spark, folder), WINDOWS).select("id", *(f"used_{n}" for n in WINDOWS))


def rate_daily_tz(spark: SparkSession, folder: str) -> DataFrame:
    """Cost by calendar day of the Pacific zone."""
    return L.daily_usage(_log(spark, folder), "America/Los_Angeles")


def rate_earliest_free(spark: SparkSession, folder: str) -> DataFrame:
    """When each bucket is free."""
    return L.earliest_free(_log(spark, folder), _specs(spark), NOW)


def rate_outcomes_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Requests by outcome over a day."""
    return L.outcome_pivot(_log(spark, folder), "2024-01-29 12:00:00")


def recent_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The last five requests."""
    return _log(spark, folder).orderBy(F.col("requested_at").desc(), "id").limit(5).select("id", "bucket", "requested_at", "outcome")


def inflight_holder(spark: SparkSession, folder: str) -> DataFrame:
    """The oldest request in flight of each bucket."""
    rows = _log(spark, folder).filter(F.col("outcome").isNull())
    return rows.groupBy("bucket").agg(F.min(F.struct("requested_at", "id")).alias("m")).select("bucket", F.col("m.id").alias("id"), F.col("m.requested_at").alias("requested_at"))


def rate_abandonment(spark: SparkSession, folder: str) -> DataFrame:
    """Requests whose process is gone, by bucket."""
    log = _log(spark, folder).withColumn("host", F.when(F.pmod("id", F.lit(2)) == 0, "here").otherwise("there")).withColumn("alive", F.col("pid") != 0)
    return L.abandoned(log, NOW, "here").filter("outcome = 'abandoned'").groupBy("bucket", "host").agg(F.count(F.lit(1)).alias("n"))


def rate_retention(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the log that are kept."""
    return L.retained(_log(spark, folder), _specs(spark), NOW).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def quota_report(spark: SparkSession, folder: str) -> DataFrame:
    """Use of every window now, and whether it is at its cap."""
    us = "timestampdiff(MICROSECOND, requested_at, TIMESTAMP_NTZ'" + NOW + "')"
    specs = _specs(spark)
    rows = _log(spark, folder).filter(L.counted(F.col("outcome"))).join(specs, "bucket").filter(f"{us} BETWEEN 0 AND window_sec * 1000000")
    used = specs.join(rows.groupBy("bucket", "window_sec").agg(F.sum("cost").alias("used")), ["bucket", "window_sec"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return used.select("bucket", span_label(F.col("window_sec")).alias("window"), "used", "max_cost", (F.col("used") >= F.col("max_cost")).alias("at_cap"))


def rate_admission_replay(spark: SparkSession, folder: str) -> DataFrame:
    """All requests replayed against the four kinds of limits."""
    kinds = {"view": "thumbnail", "click": "timedtext", "purchase": "data_api", "signup": "media", "error": "timedtext"}
    log = _log(spark, folder).withColumn("held_ms", F.pmod("id", F.lit(900)))
    return L.replay(log, {b: L.LIMITS[k] for b, k in kinds.items()})


#: The kinds of limits that rate_try_acquire puts on the buckets.
TRIED = {"view": "thumbnail", "click": "timedtext", "purchase": "media", "signup": "media", "error": "timedtext"}


def rate_try_acquire(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that don't wait: admitted at once or refused."""
    log = _log(spark, folder).select("id", "bucket", "requested_at", "cost", F.lit(0).alias("held_ms"))
    return L.replay(log, {b: L.LIMITS[k] for b, k in TRIED.items()}, blocking=False).select("id", "bucket", F.col("admitted_at").isNotNull().alias("admitted"))


QUERIES = {f.__name__: f for f in (rate_usage_multiwindow, rate_daily_tz, rate_earliest_free, rate_outcomes_pivot, recent_requests, inflight_holder, rate_abandonment, rate_retention, quota_report, rate_admission_replay, rate_try_acquire)}

_LOG = """log AS (SELECT event_id AS id, event_type AS bucket, ts AS requested_at, CASE WHEN event_id % 7 = 0 THEN 100 ELSE 1 END::BIGINT AS cost,
  CASE event_id % 11 WHEN 1 THEN 'blocked' WHEN 2 THEN 'error:Timeout' WHEN 3 THEN 'error:Quota' WHEN 4 THEN 'abandoned' WHEN 5 THEN NULL ELSE 'ok' END AS outcome, user_id % 3 AS pid FROM events),
used AS (SELECT * FROM log WHERE coalesce(outcome, '') <> 'abandoned'),
specs AS (SELECT b AS bucket, w.w AS window_sec, w.m AS max_cost FROM (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS b), (SELECT * FROM (VALUES (60::BIGINT, 2::BIGINT), (3600, 150), (86400, 3000)) t(w, m)) w)"""
_SUM = lambda n: f"sum(CASE WHEN coalesce(outcome, '') <> 'abandoned' THEN cost ELSE 0 END) OVER (PARTITION BY bucket ORDER BY requested_at RANGE BETWEEN INTERVAL {n} SECOND PRECEDING AND CURRENT ROW)::BIGINT AS used_{n}"


def admitted_sql(windows: dict[str, tuple[tuple[int, int], ...]], cost: str) -> str:
    """Requests admitted at once or refused, one after the other in each bucket, in SQL: id, bucket, admitted."""
    specs = ", ".join(f"('{b}', [{', '.join(f'{{s: {s}, m: {m}}}' for s, m in ws)}])" for b, ws in windows.items())
    return f"""WITH RECURSIVE spec AS (SELECT * FROM (VALUES {specs}) t(bucket, ws)),
r AS (SELECT event_id AS id, event_type AS bucket, epoch_us(ts) AS us, {cost} AS c, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
a AS (
  SELECT bucket, 0::BIGINT AS n, CAST([] AS STRUCT(u BIGINT, c BIGINT)[]) AS st, NULL::BIGINT AS id, NULL::BOOLEAN AS admitted FROM spec
  UNION ALL
  SELECT bucket, n, CASE WHEN ok THEN list_append(kept, {{u: us, c: c}}) ELSE kept END, id, ok FROM (
    SELECT *, len(list_filter(ws, lambda w: c + coalesce(list_sum(list_transform(list_filter(kept, lambda x: x.u >= us - w.s::BIGINT * 1000000), lambda x: x.c)), 0) > w.m)) = 0 AS ok FROM (
      SELECT r.bucket, r.n, r.id, r.us, r.c::BIGINT AS c, ws, list_filter(a.st, lambda x: x.u >= r.us - 86400000000) AS kept FROM a JOIN r ON r.bucket = a.bucket AND r.n = a.n + 1 JOIN spec ON spec.bucket = r.bucket)))
SELECT id, bucket, admitted FROM a WHERE n > 0"""


ORACLE = {
    "rate_try_acquire": admitted_sql({b: L.LIMITS[k][0] for b, k in TRIED.items()}, "CASE WHEN event_id % 7 = 0 THEN 100 ELSE 1 END"),
    "rate_usage_multiwindow": f"WITH {_LOG} SELECT id, {', '.join(map(_SUM, WINDOWS))} FROM log",
    "rate_daily_tz": f"""WITH {_LOG} SELECT bucket, CAST(timezone('America/Los_Angeles', timezone('UTC', requested_at)) AS DATE) AS day, sum(cost)::BIGINT AS used, count(*) AS requests FROM used GROUP BY ALL""",
    "rate_earliest_free": f"""WITH {_LOG}, u AS (SELECT s.bucket, s.window_sec, s.max_cost, coalesce(sum(cost), 0) AS used, min(requested_at) AS oldest FROM specs s LEFT JOIN used u ON u.bucket = s.bucket
    AND requested_at <= TIMESTAMP '{NOW}' AND requested_at >= TIMESTAMP '{NOW}' - to_seconds(window_sec) GROUP BY ALL)
SELECT bucket, max(CASE WHEN used + 1 <= max_cost THEN TIMESTAMP '{NOW}' ELSE oldest + to_seconds(window_sec) END) AS free_at, max(CASE WHEN used + 1 <= max_cost THEN TIMESTAMP '{NOW}' ELSE oldest + to_seconds(window_sec) END) <= TIMESTAMP '{NOW}' AS now FROM u GROUP BY 1""",
    "rate_outcomes_pivot": f"""WITH {_LOG} SELECT bucket, count(*) AS requests, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome LIKE 'error:%') AS errors,
  count(*) FILTER (outcome = 'abandoned') AS abandoned, count(*) FILTER (outcome IS NULL) AS in_flight, sum(cost)::BIGINT AS cost FROM log WHERE requested_at >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1""",
    "recent_requests": f"WITH {_LOG} SELECT id, bucket, requested_at, outcome FROM log ORDER BY requested_at DESC, id LIMIT 5",
    "inflight_holder": f"WITH {_LOG} SELECT bucket, id, requested_at FROM log WHERE outcome IS NULL QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY requested_at, id) = 1",
    "rate_abandonment": f"""WITH {_LOG}, h AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'here' ELSE 'there' END AS host FROM log)
SELECT bucket, host, count(*) AS n FROM h WHERE outcome = 'abandoned' OR outcome IS NULL AND (host = 'here' AND pid = 0 OR host <> 'here' AND date_diff('microsecond', requested_at, TIMESTAMP '{NOW}') // 1000000 > 86400) GROUP BY ALL""",
    "rate_retention": f"WITH {_LOG} SELECT bucket, count(*) AS n FROM log WHERE outcome IS NULL OR requested_at >= TIMESTAMP '{NOW}' - to_seconds(2 * 86400) GROUP BY 1",
    "quota_report": f"""WITH {_LOG}, u AS (SELECT s.bucket, s.window_sec, s.max_cost, coalesce(sum(cost), 0)::BIGINT AS used FROM specs s LEFT JOIN used u ON u.bucket = s.bucket AND requested_at <= TIMESTAMP '{NOW}' AND requested_at >= TIMESTAMP '{NOW}' - to_seconds(window_sec) GROUP BY ALL)
SELECT bucket, CASE window_sec WHEN 60 THEN '1m 0s' WHEN 3600 THEN '1h 0m' ELSE '1d 0h' END AS "window", used, max_cost, used >= max_cost AS at_cap FROM u""",
}
