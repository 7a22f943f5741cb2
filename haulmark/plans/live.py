"""Live status stored from a stream: devices, readings, daily snapshots and anomalies after several micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.plans.operations import COMPANY_SQL
from haulmark.plans.register import query
from haulmark.sources import domain as d
from haulmark.sources.shared import shared_dir
from haulmark.sources.versions import TableStore, once
from haulmark.streaming.status import STATUS, run_status

STATUS_SQL = f""", {COMPANY_SQL.strip()}, tenant AS (SELECT device_id, arg_min(slug, company_position) AS slug FROM member GROUP BY device_id),
st AS (SELECT device_id, plate, fleet_id AS fleet, slug, event_id, received_at, occurred_at AS observed_at, day, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN greatest(total - 300, 0) WHEN event_id % 19 = 0 THEN greatest(total - value - 0.05, 0) ELSE total END AS told,
  CASE WHEN event_id % 5 = 0 THEN CAST(value AS DOUBLE) * 40 END AS told_day, CASE WHEN event_id % 7 = 0 THEN 'driver ' || (event_id % 5) END AS driver FROM (SELECT a.*, CAST(sum(value) OVER (PARTITION BY device_id ORDER BY received_at, event_id) AS DOUBLE) AS total FROM alarms a) JOIN tenant USING (device_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY received_at, event_id) AS n FROM st),
walked AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS last, false AS fell FROM numbered UNION ALL SELECT s.device_id, s.n, CASE WHEN s.told IS NULL OR s.told + 0.1 < w.last THEN w.last ELSE s.told END, coalesce(s.told + 0.1 < w.last, false) FROM w JOIN numbered s ON s.device_id = w.device_id AND s.n = w.n + 1) SELECT * FROM w WHERE n > 0)),
judged AS (SELECT s.*, w.last, w.fell, coalesce(told_day > w.last + 0.1, false) AS above FROM numbered s JOIN walked w USING (device_id, n)),
checked AS (SELECT *, CASE WHEN NOT fell THEN told END AS total_km, CASE WHEN NOT above THEN told_day END AS day_km, CASE WHEN fell OR above THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN fell AND above THEN 'total_regression,day_gt_total' WHEN fell THEN 'total_regression' WHEN above THEN 'day_gt_total' END AS reason FROM judged)"""

#: One store for the four queries of a session and its tables.
STORES: dict[tuple[str, str], str] = {}


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status messages in order of arrival: totals that are missing, fall back, or sink within the tolerance; days that exceed their total."""
    w = Window.partitionBy("device_id").orderBy("received_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    k, value = F.col("event_id"), F.col("value").cast("double")
    total = F.sum("value").over(w).cast("double")
    told = F.when(k % 17 == 0, F.lit(None)).when(k % 13 == 0, F.greatest(total - 300, F.lit(0.0))).when(k % 19 == 0, F.greatest(total - value - 0.05, F.lit(0.0))).otherwise(total)
    rows = d.alarms(spark, sf_dir).withColumns({"told": told, "told_day": F.when(k % 5 == 0, value * 40)})
    return rows.select(
        "device_id", k.alias("seq"), F.when(k % 3 != 0, F.col("plate")).alias("plate_no"), "fleet_id", F.when(k % 7 == 0, F.concat(F.lit("driver "), k % 5)).alias("driver_name"), F.col("occurred_at").alias("observed_at"), "received_at", "day",
        F.col("told").alias("total_km"), F.col("told_day").alias("day_km"), F.col("told").cast("string").alias("raw_total_value"), F.col("told_day").cast("string").alias("raw_day_value"), F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("raw_event_time"),
    )


def arrived(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """The messages as a stream of files, some days each; a file is a micro-batch."""
    rows = statuses(spark, sf_dir)
    for k, (lo, hi) in enumerate((("2000-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2024-01-24"), ("2024-01-24", "2100-01-01"))):
        rows.filter(f"received_at >= TIMESTAMP '{lo} 00:00:00' and received_at < TIMESTAMP '{hi} 00:00:00'").coalesce(1).write.parquet(f"{base}/landed/part={k}")
    return spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{base}/landed")


def stored(spark: SparkSession, sf_dir: str) -> TableStore:
    return once(spark, STORES, sf_dir, lambda: follow(spark, sf_dir))


def follow(spark: SparkSession, sf_dir: str) -> TableStore:
    base = f"{shared_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    store = TableStore(spark, f"{base}/store")
    run_status(arrived(spark, sf_dir, base), store, d.companies(spark), f"{base}/checkpoint")
    return store


@query(
    "live_devices",
    f"""{STATUS_SQL} SELECT device_id, arg_max(CASE WHEN event_id % 3 <> 0 THEN plate END, n) AS plate_no, any_value(slug) AS company_slug, arg_max(fleet, n) AS fleet_id, arg_max(driver, n) AS driver_name, arg_max(observed_at, n) AS last_seen_at, arg_max(received_at, n) AS last_received_at, arg_max(last, n) AS last_total_km, arg_max(day_km, n) AS last_day_km,
    CAST(count(total_km) AS BIGINT) AS accepted, CAST(count(*) FILTER (fell) AS BIGINT) AS regressions, arg_max(status, n) AS km_validation_status, arg_max(coalesce(reason, ''), n) AS km_validation_reason FROM checked GROUP BY device_id""",
)
def live_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each device: the last distances that hold, what is known of it, and how its last message was judged."""
    rows = stored(spark, sf_dir).read("device").drop("raw_total_value", "raw_day_value")
    return rows.withColumn("km_validation_reason", F.coalesce("km_validation_reason", F.lit("")))


@query("live_readings", f"{STATUS_SQL} SELECT device_id, observed_at AS recorded_at, fleet AS fleet_id, total_km, day_km FROM checked WHERE total_km IS NOT NULL")
def live_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading for each accepted total."""
    return stored(spark, sf_dir).read("reading").select("device_id", "recorded_at", "fleet_id", "total_km", "day_km")


@query(
    "live_snapshots",
    f"""{STATUS_SQL} SELECT device_id, day AS snapshot_date, arg_max(observed_at, n) AS observed_at, any_value(slug) AS company_slug, coalesce(arg_max(total_km, n), arg_min(coalesce(last, 0), n)) AS total_km, arg_max(day_km, n) AS day_km, arg_max(status, n) AS km_validation_status FROM checked GROUP BY device_id, day""",
)
def live_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot for each device and local day: its last valid distances, or the total known when the day began to be heard of."""
    return stored(spark, sf_dir).read("snapshot").select("device_id", "snapshot_date", "observed_at", "company_slug", "total_km", "day_km", "km_validation_status")


@query("live_anomalies", f"{STATUS_SQL} SELECT device_id, slug AS company_slug, received_at, r.reason AS reason FROM checked, LATERAL (VALUES (CASE WHEN fell THEN 'total_regression' END), (CASE WHEN above THEN 'day_gt_total' END)) r(reason) WHERE r.reason IS NOT NULL")
def live_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each total that falls back and each day that exceeds its total."""
    return stored(spark, sf_dir).read("anomaly").select("device_id", "company_slug", "received_at", "reason")


@query(
    "live_flags",
    f"""{STATUS_SQL}, latest AS (SELECT device_id, day, arg_max(coalesce(reason, ''), n) AS snap_reason, max(n) AS n FROM checked GROUP BY ALL), last_day AS (SELECT device_id, arg_max(snap_reason, day) AS snap_reason FROM latest GROUP BY 1),
    dev AS (SELECT device_id, any_value(slug) AS company_slug, arg_max(coalesce(reason, ''), n) AS reason FROM checked GROUP BY 1)
    SELECT company_slug, count(*) AS devices, CAST(count(*) FILTER (contains(reason, 'total_regression')) + count(*) FILTER (contains(snap_reason, 'total_regression')) AS BIGINT) AS regressions, array_to_string((list(device_id ORDER BY device_id) FILTER (contains(reason, 'total_regression') OR contains(snap_reason, 'total_regression')))[1:8], ',') AS flagged
    FROM dev JOIN last_day USING (device_id) GROUP BY company_slug""",
)
def live_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices whose last message, or whose latest daily snapshot, fell back, with the first eight of them: flags as the status stream has checked them."""
    store = stored(spark, sf_dir)
    last = store.read("snapshot").groupBy("device_id").agg(F.max_by(F.coalesce("km_validation_reason", F.lit("")), "snapshot_date").alias("snap"))
    rows = store.read("device").select("device_id", "company_slug", F.coalesce("km_validation_reason", F.lit("")).alias("own")).join(last, "device_id")
    own, snap = F.col("own").contains("total_regression"), F.col("snap").contains("total_regression")
    place = F.row_number().over(Window.partitionBy("company_slug").orderBy((own | snap).desc(), "device_id"))
    flagged = F.array_join(F.array_sort(F.collect_list(F.when((own | snap) & (F.col("place") <= 8), F.col("device_id")))), ",")
    return rows.withColumn("place", place).groupBy("company_slug").agg(F.count("*").alias("devices"), (F.count_if(own) + F.count_if(snap)).alias("regressions"), F.nullif(flagged, F.lit("")).alias("flagged"))
