"""Odometer: daily distance, baselines, deviations, quality and repair."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from haulmark.functions.expressions import valid_distance
from haulmark.operators.repair import repaired
from haulmark.plans.register import query
from haulmark.sources import domain as d


def by_day() -> WindowSpec:
    return Window.partitionBy("device_id").orderBy("day")


DELTA_SQL = """
d1 AS (SELECT device_id, plate, day, greatest(total_km, 0) AS total_km, day_km, lag(greatest(total_km, 0)) OVER (PARTITION BY device_id ORDER BY day) AS prev FROM daily),
km AS (SELECT device_id, plate, day, total_km, CASE WHEN day_km >= 0 AND day_km <= 1000 AND day_km <= total_km + 0.1 THEN CAST(day_km AS DECIMAL(24,4))
  WHEN prev IS NOT NULL AND total_km - prev >= 0 AND total_km - prev <= 1000 THEN CAST(total_km - prev AS DECIMAL(24,4)) WHEN prev IS NOT NULL THEN CAST(greatest(total_km - prev, 0) AS DECIMAL(24,4)) ELSE 0 END AS km FROM d1)"""


def daily_distance(daily: DataFrame) -> DataFrame:
    """Kilometres of each device and day: the reported ones if valid, else the rise of the odometer since the device's previous day, else 0."""
    total = F.greatest("total_km", F.lit(0))
    rows = daily.select("device_id", "plate", "day", total.cast("decimal(24,2)").alias("total_km"), "day_km", F.lag(total).over(by_day()).alias("prev"))
    rise = F.col("total_km") - F.col("prev")
    km = F.when(valid_distance(F.col("day_km"), F.col("total_km")), F.col("day_km")).when(F.col("prev").isNotNull() & (rise >= 0) & (rise <= 1000), rise).when(F.col("prev").isNotNull(), F.greatest(rise, F.lit(0))).otherwise(0)
    return rows.withColumn("km", km.cast("decimal(24,4)")).select("device_id", "plate", "day", "total_km", "km")


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_distance(d.daily(spark, sf_dir))


@query("daily_km_latest", "SELECT device_id, day, total_km, observed_at FROM daily")
def daily_km_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.daily(spark, sf_dir).select("device_id", "day", "total_km", "observed_at")


@query("daily_km_delta", f", {DELTA_SQL.strip()} SELECT device_id, plate, day, km FROM km")
def daily_km_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).drop("total_km")


@query("legacy_day_km", "SELECT plate, day, greatest(coalesce(max(day_km), arg_max(total_km, (observed_at, event_id)) - arg_min(total_km, (observed_at, event_id))), 0) AS km FROM readings GROUP BY ALL")
def legacy_day_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a vehicle's day: the largest reported distance, else last minus first total."""
    order = F.struct("observed_at", "event_id")
    out = d.readings(spark, sf_dir).groupBy("plate", "day").agg(F.max("day_km").alias("told"), (F.max_by("total_km", order) - F.min_by("total_km", order)).alias("rise"))
    return out.select("plate", "day", F.greatest(F.coalesce("told", "rise"), F.lit(0)).alias("km"))


@query("fleet_km_by_day", f", {DELTA_SQL.strip()} SELECT day, sum(km) AS km, count(DISTINCT plate) AS vehicles, day = DATE '2024-01-30' AS provisional FROM km WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY day")
def fleet_km_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d.in_days(distances(spark, sf_dir), d.THIRTY).groupBy("day").agg(F.sum("km").alias("km"), F.count_distinct("plate").alias("vehicles"))
    return out.withColumn("provisional", F.col("day") == F.expr(d.LAST_DAY))


BASE_SQL = f"""
, {DELTA_SQL.strip()},
kmdays AS (SELECT DISTINCT plate, day FROM km WHERE km > 0 AND day BETWEEN DATE '2023-12-31' AND DATE '2024-01-29'),
known AS (SELECT DISTINCT plate FROM km),
base AS (SELECT k.plate, CASE WHEN count(kd.day) = 0 THEN 0.0 ELSE round(CAST(sum(coalesce(e.n, 0)) AS DOUBLE) / count(kd.day), 1) END AS baseline FROM known k LEFT JOIN kmdays kd USING (plate)
  LEFT JOIN (SELECT plate, day, count(*) AS n FROM kept GROUP BY ALL) e ON e.plate = kd.plate AND e.day = kd.day GROUP BY k.plate)"""


def baselines(alarms: DataFrame, km: DataFrame) -> DataFrame:
    """Mean alarms of a vehicle over the 30 days that end yesterday, of those with distance; 0 without any, no row without distances at all."""
    return day_baselines(alarms.groupBy("plate", "day").agg(F.count("*").alias("n")), km)


def day_baselines(n: DataFrame, km: DataFrame) -> DataFrame:
    """baselines() from counts of alarms by vehicle and day."""
    window = F.col("day").between(F.expr(f"date_sub({d.LAST_DAY}, 30)"), F.expr(f"date_sub({d.LAST_DAY}, 1)"))
    days = km.groupBy("plate", "day").agg(F.max((F.col("km") > 0) & window).alias("counts"))
    both = days.join(n, ["plate", "day"], "left").groupBy("plate").agg(F.count_if("counts").alias("days"), F.sum(F.when(F.col("counts"), F.coalesce("n", F.lit(0))).otherwise(0)).alias("n"))
    return both.select("plate", F.when(F.col("days") == 0, 0.0).otherwise(F.round(F.col("n").cast("double") / F.col("days"), 1)).alias("baseline"))


@query("vehicle_baseline", f"{BASE_SQL} SELECT plate, baseline FROM base")
def vehicle_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines(d.kept(spark, sf_dir), distances(spark, sf_dir))


@query(
    "fleet_baseline_delta",
    """SELECT today, baseline, CASE WHEN baseline > 0 THEN round((today - baseline) / baseline * 100, 1) END AS delta_pct FROM
    (SELECT count(*) FILTER (day = DATE '2024-01-30') AS today, round(CAST(count(*) FILTER (day BETWEEN DATE '2023-12-31' AND DATE '2024-01-29') AS DOUBLE) / 30, 1) AS baseline FROM kept)""",
)
def fleet_baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the baseline window counts, also those without alarms."""
    before = F.col("day").between(F.expr(f"date_sub({d.LAST_DAY}, 30)"), F.expr(f"date_sub({d.LAST_DAY}, 1)"))
    out = d.kept(spark, sf_dir).agg(F.count_if(F.col("day") == F.expr(d.LAST_DAY)).alias("today"), F.round(F.count_if(before).cast("double") / 30, 1).alias("baseline"))
    return out.withColumn("delta_pct", F.when(F.col("baseline") > 0, F.round((F.col("today") - F.col("baseline")) / F.col("baseline") * 100, 1)))


def deviation(today: Column, baseline: Column) -> Column:
    """Today over baseline; without a baseline today's count, and 1 for none at all."""
    raw = F.when(F.coalesce(baseline, F.lit(0.0)) > 0, F.round(today / baseline, 2)).otherwise(F.when(today > 0, today.cast("double")).otherwise(1.0))
    return F.when(raw == 0, 1.0).otherwise(raw)


@query(
    "deviation_spike",
    f"""{BASE_SQL}, t AS (SELECT plate, count(*) AS today FROM kept WHERE day = DATE '2024-01-30' GROUP BY plate), x AS (SELECT plate, coalesce(today, 0) AS today, coalesce(baseline, 0.0) AS baseline FROM base FULL JOIN t USING (plate))
    SELECT plate, today, baseline, CASE WHEN baseline > 0 THEN CASE WHEN today = 0 THEN 1.0 ELSE round(today / baseline, 2) END ELSE CASE WHEN today > 0 THEN CAST(today AS DOUBLE) ELSE 1.0 END END AS deviation, baseline > 0 AND today >= baseline * 1.5 AS spike FROM x""",
)
def deviation_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = d.in_days(d.kept(spark, sf_dir), 1).groupBy("plate").agg(F.count("*").alias("today"))
    both = vehicle_baseline(spark, sf_dir).join(today, "plate", "full").select("plate", F.coalesce("today", F.lit(0)).alias("today"), F.coalesce("baseline", F.lit(0.0)).alias("baseline"))
    return both.withColumns({"deviation": deviation(F.col("today"), F.col("baseline")), "spike": (F.col("baseline") > 0) & (F.col("today") >= F.col("baseline") * 1.5)})


@query(
    "km_quality",
    """SELECT company_slug, count(*) AS rows, CAST(count(*) FILTER (prev IS NOT NULL AND total_km + 0.1 < prev) AS BIGINT) AS regressions, CAST(count(*) FILTER (day_km > total_km + 0.1) AS BIGINT) AS above_total,
    CAST(count(*) FILTER (day_km > 1000) AS BIGINT) AS above_limit, CAST(count(*) FILTER (day_km IS NULL) AS BIGINT) AS not_told FROM (SELECT *, lag(total_km) OVER (PARTITION BY device_id ORDER BY day) AS prev FROM daily) GROUP BY company_slug""",
)
def km_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.daily(spark, sf_dir).withColumn("prev", F.lag("total_km").over(by_day()))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("company_slug").agg(
        F.count("*").alias("rows"), n(F.col("total_km") + F.expr("0.1BD") < F.col("prev")).alias("regressions"), n(F.col("day_km") > F.col("total_km") + F.expr("0.1BD")).alias("above_total"),
        n(F.col("day_km") > 1000).alias("above_limit"), F.count_if(F.col("day_km").isNull()).alias("not_told"),
    )


@query(
    "km_repair_derived",
    """SELECT device_id, day, greatest(hi - coalesce(lag(hi) OVER (PARTITION BY device_id ORDER BY day), lo), 0) AS repaired_km FROM (SELECT device_id, day, min(total_km) AS lo, max(total_km) AS hi FROM readings GROUP BY ALL)""",
)
def km_repair_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's distance from its odometer range, from the previous day's maximum where there is one."""
    span = d.readings(spark, sf_dir).groupBy("device_id", "day").agg(F.min("total_km").alias("lo"), F.max("total_km").alias("hi"))
    return span.select("device_id", "day", F.greatest(F.col("hi") - F.coalesce(F.lag("hi").over(by_day()), "lo"), F.lit(0)).alias("repaired_km"))


@query(
    "coverage_counts",
    """SELECT r.company_slug, count(DISTINCT r.device_id) AS devices, count(DISTINCT r.device_id) FILTER (r.observed_at >= TIMESTAMP '2024-01-30 00:00:00') AS with_status_24h, count(DISTINCT r.device_id) FILTER (r.day = DATE '2024-01-30') AS with_snapshot_today,
    count(DISTINCT r.device_id) - count(DISTINCT r.device_id) FILTER (r.day = DATE '2024-01-30') AS missing_today FROM readings r GROUP BY r.company_slug""",
)
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = d.readings(spark, sf_dir).groupBy("company_slug", "device_id").agg(F.max("observed_at").alias("seen"), F.max("day").alias("day"))
    out = one.groupBy("company_slug").agg(F.count("*").alias("devices"), F.count_if(F.col("seen") >= F.expr("TIMESTAMP '2024-01-30 00:00:00'")).alias("with_status_24h"), F.count_if(F.col("day") == F.expr(d.LAST_DAY)).alias("with_snapshot_today"))
    return out.withColumn("missing_today", F.col("devices") - F.col("with_snapshot_today"))


REPAIR_SQL = """
snap AS (SELECT device_id, day, observed_at, CASE WHEN event_id % 6 <> 0 THEN total_km END AS total_km, CASE WHEN event_id % 7 = 0 THEN -1 ELSE day_km END AS day_km FROM daily),
told AS (SELECT device_id, day, min(total_km) AS lo, max(total_km) AS hi FROM readings WHERE event_id % 4 = 1 GROUP BY ALL),
der AS (SELECT device_id, day, hi, round(CASE WHEN hi - lo <= 0 AND hi >= lag(hi) OVER w THEN hi - lag(hi) OVER w ELSE hi - lo END, 1) AS km FROM told WINDOW w AS (PARTITION BY device_id ORDER BY day)),
own AS (SELECT device_id, arg_max(total_km, (observed_at, event_id)) AS last_total, arg_max(coalesce(day_km, -1), (observed_at, event_id)) AS last_day FROM readings GROUP BY 1),
j AS (SELECT s.*, d.km AS told_km, CASE WHEN s.day = DATE '2024-01-30' THEN coalesce(l.latest, s.total_km) ELSE s.total_km END AS norm, o.last_total, o.last_day, s.day = DATE '2024-01-30' AND o.last_day >= 0 AND o.last_day <= 1000 AND o.last_day <= o.last_total + 0.1 AS own_day
  FROM snap s LEFT JOIN der d USING (device_id, day) LEFT JOIN (SELECT device_id, arg_max(hi, day) AS latest FROM der GROUP BY 1) l USING (device_id) LEFT JOIN own o USING (device_id)),
f AS (SELECT *, CASE WHEN own_day THEN last_total ELSE norm END AS final FROM j),
p AS (SELECT *, last_value(final IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY day, observed_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, coalesce(told_km, day_km) AS cand FROM f),
r AS (SELECT *, CASE WHEN own_day THEN round(last_day, 1) WHEN cand >= 0 AND cand <= 1000 AND (norm IS NULL OR cand <= norm + 0.1) THEN round(cand, 1) WHEN norm - prev >= 0 AND norm - prev <= 1000 AND norm - prev <= norm + 0.1 THEN round(norm - prev, 1) END AS km FROM p)"""


@query(
    "km_repair_whole",
    f""", {REPAIR_SQL.strip()} SELECT device_id, day, observed_at, CAST(coalesce(final, total_km) AS DOUBLE) AS total_km, CAST(km AS DOUBLE) AS day_km, CASE WHEN km IS NULL THEN 'invalid' ELSE 'valid' END AS km_validation_status, CASE WHEN km IS NULL THEN 'day_gt_total' END AS km_validation_reason,
    CASE WHEN (final IS NOT NULL AND final IS DISTINCT FROM total_km) OR km IS DISTINCT FROM day_km THEN 'normalized_from_raw_payload' END AS repair_reason FROM r""",
)
def km_repair_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots, some without a total or with a wrong distance, repaired from the device's alarms, its own record and the totals before."""
    k = F.col("event_id")
    snapshots = d.daily(spark, sf_dir).select("device_id", "day", "observed_at", F.when(k % 6 != 0, F.col("total_km")).alias("total_km"), F.when(k % 7 == 0, F.lit(-1)).otherwise(F.col("day_km")).cast("decimal(20,2)").alias("day_km"))
    readings = d.readings(spark, sf_dir)
    order = F.struct("observed_at", "event_id")
    devices = readings.groupBy("device_id").agg(F.max_by("total_km", order).alias("last_total_km"), F.max_by(F.coalesce("day_km", F.lit(-1)), order).alias("last_day_km"))
    out = repaired(snapshots, readings.filter("event_id % 4 = 1").select("device_id", "day", "total_km"), devices, date(2024, 1, 30), block_days=10)
    return out.withColumns({c: F.col(c).cast("double") for c in ("total_km", "day_km")})
