"""Accounting and admission of requests under several windows at once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Windows (seconds, most cost) of a bucket, and the zone in whose days it counts, if it does.
Spec = tuple[Sequence[tuple[int, int]], str | None]

# The limits of the four kinds of requests.
LIMITS: Mapping[str, Spec] = {
    "timedtext": (((1, 1), (60, 5), (3600, 25), (86400, 200)), None),
    "data_api": (((86400, 10000),), "America/Los_Angeles"),
    "media": (((30, 1), (3600, 25), (86400, 150)), None),
    "thumbnail": (((1, 5), (60, 60), (3600, 1000), (86400, 10000)), None),
}
DAY_US = 86_400_000_000
MINUTE_US = 60_000_000


class UnknownBucket(ValueError):
    """A request for a bucket without limits."""


def spec_of(specs: Mapping[str, Spec], bucket: str) -> Spec:
    if bucket not in specs:
        raise UnknownBucket(f"unknown bucket {bucket!r}; there are {', '.join(sorted(specs))}")
    return specs[bucket]


def with_micros(log: DataFrame, at: str = "requested_at") -> DataFrame:
    return log.withColumn("us", F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{at}`)"))


def counted(outcome: Column) -> Column:
    """Whether a request uses quota: all but abandoned ones, those in flight included."""
    return F.coalesce(outcome, F.lit("")) != "abandoned"


def window_usage(log: DataFrame, windows: Sequence[int]) -> DataFrame:
    """``log`` with used_N for each window of N seconds: the cost of the bucket's requests from N seconds before on, inclusive.

    Running sums at two points give a window's: at the request, and just before
    the window begins. The points are summed up within minutes, and a table with
    a row a minute gives each minute what came before it; so a bucket with any
    number of requests is spread over its minutes, however long the windows are.
    """
    w = F.when(counted(F.col("outcome")), F.col("cost")).otherwise(0)
    rows = with_micros(log).select(F.monotonically_increasing_id().alias("__row"), F.struct(*log.columns).alias("__log"), "bucket", "us", w.alias("w"))
    point = lambda n, shift, cost: F.struct(F.lit(n).alias("n"), (F.col("us") - shift).alias("at"), cost.alias("w"))
    points = F.array(point(0, 0, F.col("w")), *(point(n, n * 1_000_000 + 1, F.lit(0)) for n in windows))
    rows = rows.select("__row", "__log", "bucket", F.explode(points).alias("p"))
    rows = rows.select("__row", F.when(F.col("p.n") == 0, F.col("__log")).alias("__log"), "bucket", F.col("p.n").alias("n"), F.col("p.at").alias("at"), F.col("p.w").alias("w"), F.floor(F.col("p.at") / MINUTE_US).alias("minute"))
    past = Window.partitionBy("bucket").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("bucket", "minute").agg(F.sum("w").alias("s")).select("bucket", "minute", F.coalesce(F.sum("s").over(past), F.lit(0)).alias("before"))
    upto = Window.partitionBy("bucket", "minute").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("sum", F.sum("w").over(upto)).join(before, ["bucket", "minute"]).withColumn("sum", F.col("sum") + F.col("before"))
    at = lambda n: F.max(F.when(F.col("n") == n, F.col("sum")))
    each = summed.groupBy("__row").agg(F.max("__log").alias("__log"), *((at(0) - at(n)).alias(f"used_{n}") for n in windows))
    return each.select("__log.*", *(f"used_{n}" for n in windows))


def daily_usage(log: DataFrame, zone: str) -> DataFrame:
    """Cost by bucket and calendar day of a zone; days begin at local midnight, whatever the clock change."""
    local = F.from_utc_timestamp(F.col("requested_at").cast("timestamp"), zone)
    rows = log.filter(counted(F.col("outcome"))).withColumn("day", F.to_date(local))
    return rows.groupBy("bucket", "day").agg(F.sum("cost").alias("used"), F.count(F.lit(1)).alias("requests"))


def earliest_free(log: DataFrame, specs: DataFrame, now: str, cost: int = 1) -> DataFrame:
    """By bucket: when a request of ``cost`` may be made at the earliest, and whether now.

    ``specs``: bucket, window_sec, max_cost. A full window is free again when
    its oldest request leaves it; the latest of the windows counts. A cost above
    a limit is never admitted (null).
    """
    us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', TIMESTAMP_NTZ'{now}')")
    rows = with_micros(log).filter(counted(F.col("outcome")) & (F.col("us") <= us) & (F.col("us") >= us - DAY_US))
    inside = rows.join(specs, "bucket").filter(F.col("us") >= us - F.col("window_sec") * 1_000_000)
    used = inside.groupBy("bucket", "window_sec", "max_cost").agg(F.sum("cost").alias("used"), F.min("us").alias("oldest"))
    both = specs.join(used, ["bucket", "window_sec", "max_cost"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    free = F.when(F.col("used") + cost <= F.col("max_cost"), us).otherwise(F.col("oldest") + F.col("window_sec") * 1_000_000)
    out = both.withColumn("free", free).groupBy("bucket").agg(F.max("free").alias("free"), F.max(F.lit(cost) > F.col("max_cost")).alias("never"))
    at = F.expr("timestampadd(MICROSECOND, free, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return out.select("bucket", F.when(~F.col("never"), at).alias("free_at"), (~F.col("never") & (F.col("free") <= us)).alias("now"))


def outcome_pivot(log: DataFrame, since: str) -> DataFrame:
    """Requests by bucket and outcome since a time; null is in flight, every error:... an error."""
    o = F.col("outcome")
    return log.filter(F.col("requested_at") >= F.lit(since).cast("timestamp_ntz")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(o == "ok").alias("ok"), F.count_if(o == "blocked").alias("blocked"), F.count_if(o.startswith("error:")).alias("errors"),
        F.count_if(o == "abandoned").alias("abandoned"), F.count_if(o.isNull()).alias("in_flight"), F.sum("cost").alias("cost"),
    )


def abandoned(log: DataFrame, now: str, host: str, seconds: int = 86_400) -> DataFrame:
    """``log`` with requests in flight marked abandoned whose process is gone: dead on this host, or too old on another."""
    age = F.expr(f"timestampdiff(SECOND, requested_at, TIMESTAMP_NTZ'{now}')")
    gone = F.col("outcome").isNull() & ((F.col("host") == host) & ~F.col("alive") | (F.col("host") != host) & (age > seconds))
    return log.withColumn("outcome", F.when(gone, "abandoned").otherwise(F.col("outcome")))


def retained(log: DataFrame, specs: DataFrame, now: str) -> DataFrame:
    """Rows still needed: in flight, or not older than twice the longest window of their bucket."""
    longest = specs.groupBy("bucket").agg(F.max("window_sec").alias("longest"))
    age = F.expr(f"timestampdiff(MICROSECOND, requested_at, TIMESTAMP_NTZ'{now}')")
    both = log.join(longest, "bucket", "left")
    return both.filter(F.col("outcome").isNull() | F.col("longest").isNull() | (age <= 2_000_000 * F.col("longest"))).drop("longest")


class Gate:
    """Admission to one bucket: what was admitted within the longest window, and no more."""

    def __init__(self, spec: Spec) -> None:
        self.windows, self.zone = spec
        self.times: list[int] = []  # rising, as an admission is never before the last
        self.costs: list[int] = [0]  # running sums
        self.busy_until = -(2**62)

    def _day(self, us: int) -> tuple[int, int]:
        zone = ZoneInfo(self.zone)
        local = datetime.fromtimestamp(us // 1_000_000, timezone.utc).astimezone(zone)
        start = datetime(local.year, local.month, local.day, tzinfo=zone)
        after = (start + timedelta(days=1)).date()
        end = datetime(after.year, after.month, after.day, tzinfo=zone)
        return int(start.timestamp()) * 1_000_000, int(end.timestamp()) * 1_000_000

    def free_at(self, us: int, cost: int) -> int | None:
        """The earliest time from ``us`` on; null if the cost is above a limit."""
        if any(cost > most for _, most in self.windows):
            return None
        at = max(us, self.busy_until)
        while True:
            later = at
            for seconds, most in self.windows:
                begin, end = self._day(at) if self.zone else (at - seconds * 1_000_000, None)
                oldest = bisect_left(self.times, begin)
                if self.costs[-1] - self.costs[oldest] + cost > most:
                    later = max(later, end if end is not None else self.times[oldest] + seconds * 1_000_000 + 1)
            if later == at:
                return at
            at = later

    def admit(self, us: int, cost: int, held: int) -> None:
        self.times.append(us)
        self.costs.append(self.costs[-1] + cost)
        self.busy_until = us + held
        span = 90_000_000_000 if self.zone else max(s for s, _ in self.windows) * 1_000_000
        gone = bisect_left(self.times, us - span)
        if gone > 1000:
            del self.times[:gone], self.costs[:gone]


def replay(log: DataFrame, specs: Mapping[str, Spec], *, blocking: bool = True) -> DataFrame:
    """Requests replayed against the limits: id, bucket, admitted_at, waited_ms; refused ones have no admitted_at.

    One request of a bucket is in flight at a time (for held_ms). Admission
    depends on all admissions before, so a bucket is one sequence and one task; the
    task streams over it and holds what its longest window holds. Buckets
    without limits raise an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gates: dict[str, Gate] = {}
        for pdf in batches:
            rows = []
            for key, bucket, us, cost, held in zip(*(pdf[c].tolist() for c in ("id", "bucket", "us", "cost", "held_ms"))):
                gate = gates.setdefault(bucket, Gate(spec_of(specs, bucket)))
                at = gate.free_at(us, cost)
                if at is None or not blocking and at > us:
                    rows.append((key, bucket, None, None))
                else:
                    gate.admit(at, cost, held * 1000)
                    rows.append((key, bucket, at, (at - us) // 1000))
            yield pd.DataFrame(rows, columns=["id", "bucket", "admitted_us", "waited_ms"]).astype({"admitted_us": "Int64", "waited_ms": "Int64"})

    ordered = with_micros(log).select("id", "bucket", "us", F.col("cost").cast("long").alias("cost"), F.col("held_ms").cast("long").alias("held_ms")).repartition("bucket").sortWithinPartitions("bucket", "us", "id")
    out = ordered.mapInPandas(run, "id long, bucket string, admitted_us long, waited_ms long")
    return out.select("id", "bucket", F.expr("timestampadd(MICROSECOND, admitted_us, TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("admitted_at"), "waited_ms")
