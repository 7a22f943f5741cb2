"""A harvest over three cuts: landed replies, some of them errors, some devices without any, taken in from a stream and published where all succeeded."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.values import DMS_STEMS, TEXT_CATEGORIES
from haulmark.operators.batches import create_tables
from haulmark.plans.applied import LAYER, LAYER_SQL, TIMED_SQL, arriving, batch_sql, known_devices
from haulmark.plans.ingest import case
from haulmark.plans.operations import COMPANY_SQL
from haulmark.plans.register import query
from haulmark.plans.scalars import local_text
from haulmark.sources import domain as d
from haulmark.sources.shared import shared_dir
from haulmark.sources.versions import TableStore, once
from haulmark.streaming.harvest import create_harvest, harvest
from haulmark.streaming.rebuild import Deferred, rebuild

CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00", "2024-01-31 00:00:00"]
TEXTS = ["Yawning", "Speeding", "eye tracker lost", "FCW (Forward Collision Warning)", "Using phone while driving", "Idle too long", "Eyes Closed"]

HARVEST_SQL = f""", {COMPANY_SQL.strip()}, dev AS (SELECT device_id, any_value(user_id) AS user_id, arg_min(slug, company_position) AS slug FROM member GROUP BY device_id),
cuts(no, cut_at) AS (VALUES (1, TIMESTAMP '{CUTS[0]}'), (2, TIMESTAMP '{CUTS[1]}'), (3, TIMESTAMP '{CUTS[2]}')),
said AS (SELECT c.no, c.cut_at, v.slug, v.device_id, CASE WHEN v.user_id % 37 = 5 AND c.no = 2 AND v.user_id >= 40 THEN 'rate_limited' WHEN v.user_id < 40 AND (v.user_id % 11 = c.no OR v.user_id % 23 = c.no) THEN 'failed' ELSE 'succeeded' END AS outcome FROM dev v, cuts c),
stops AS (SELECT no, slug, min(device_id) FILTER (outcome = 'rate_limited') AS stop FROM said GROUP BY ALL),
judged AS (SELECT s.*, CASE WHEN device_id > stop THEN 'queued' ELSE outcome END AS status FROM said s JOIN stops USING (no, slug)),
texts AS (SELECT guid, device_id, date_trunc('second', occurred_at) + INTERVAL 3 SECOND AS moment, lower(CASE event_id % 7 {" ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TEXTS))} END) AS said_text FROM alarms),
told AS (SELECT *, CASE WHEN {case("said_text", TEXT_CATEGORIES)} IS NOT NULL THEN 'classified_dms' WHEN regexp_matches(said_text, '{"|".join(DMS_STEMS)}') THEN 'unmapped' ELSE 'classified_non_dms' END AS class FROM texts),
sent AS (SELECT j.no, j.cut_at, j.slug, t.* FROM told t JOIN judged j ON j.device_id = t.device_id AND j.status = 'succeeded' AND t.moment >= j.cut_at - INTERVAL 11 DAY AND t.moment < j.cut_at),
marked AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY no) = 1 AS first_time FROM sent),
per AS (SELECT no, device_id, count(*) AS provider_rows, CAST(count(*) FILTER (class = 'classified_dms') AS BIGINT) AS provider_dms_rows, CAST(count(*) FILTER (first_time) AS BIGINT) AS inserted_raw, CAST(count(*) FILTER (first_time AND class = 'classified_dms') AS BIGINT) AS inserted_dms FROM marked GROUP BY ALL),
devs AS (SELECT j.no, j.slug AS company_slug, j.cut_at, j.device_id, j.status, coalesce(provider_rows, 0) AS provider_rows, coalesce(provider_dms_rows, 0) AS provider_dms_rows, coalesce(inserted_raw, 0) AS inserted_raw, coalesce(inserted_dms, 0) AS inserted_dms FROM judged j LEFT JOIN per USING (no, device_id)),
runs AS (SELECT no, company_slug, cut_at, CASE WHEN bool_or(status = 'rate_limited') THEN 'rate_limited' WHEN bool_or(status = 'failed') THEN 'partial' ELSE 'succeeded' END AS status, count(*) AS devices_total, CAST(count(*) FILTER (status <> 'queued') AS BIGINT) AS devices_done, CAST(sum(provider_rows) AS BIGINT) AS rows_total, CAST(sum(provider_dms_rows) AS BIGINT) AS dms_total FROM devs GROUP BY ALL)"""

STORES: dict[tuple[str, str], str] = {}


def land(spark: SparkSession, sf_dir: str, base: str) -> None:
    """What the provider answers: pages of a device's alarms of the days before a cut, errors for some devices, nothing for others."""
    k, u = F.col("event_id"), F.col("user_id")
    at = F.date_trunc("second", "occurred_at")
    text = F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (k % 7 + 1).cast("int"))
    alarm = F.struct(F.col("guid").alias("alarmID"), F.col("device_id").alias("deviceID"), F.lower("plate").alias("plateNo"), text.alias("alarmTypeValue"), F.lit("999").alias("alarmType"), local_text(at).alias("startTime"), local_text(at + F.expr("INTERVAL 3 SECONDS")).alias("endTime"), (k * 100).alias("totalMileage"))
    rows = d.alarms(spark, sf_dir).select("device_id", "user_id", "event_id", (at + F.expr("INTERVAL 3 SECONDS")).alias("at"), alarm.alias("alarm"))
    devices = rows.select("device_id", "user_id").distinct()
    for no, time in enumerate(CUTS, 1):
        end, cut = F.lit(time).cast("timestamp"), time[:16].replace(" ", "T").replace(":", "")
        limited = (u % 37 == 5) & (u >= 40) & F.lit(no == 2)
        failed = (u < 40) & (u % 11 == no)
        silent = (u < 40) & (u % 23 == no)
        inside = rows.filter((F.col("at") >= end - F.expr("INTERVAL 11 DAYS")) & (F.col("at") < end) & ~limited & ~failed & ~silent)
        pages = inside.groupBy("device_id", F.floor(k / 50).alias("page")).agg(F.to_json(F.struct(F.lit(0).alias("status"), F.struct(F.collect_list("alarm").alias("list")).alias("data"))).alias("value")).drop("page")
        others = devices.filter(~silent).select("device_id", F.when(limited, '{"status":429}').when(failed, '{"status":500}').otherwise('{"status":0,"data":{"list":[]}}').alias("value"))
        pages.unionByName(others).select(F.concat_ws("\t", "device_id", "value").alias("value")).write.text(f"{base}/cut={cut}")
        spark.createDataFrame([(cut,)], "value string").coalesce(1).write.text(f"{base}/_cuts/{cut}")


def harvested(spark: SparkSession, sf_dir: str) -> TableStore:
    return once(spark, STORES, sf_dir, lambda: run_harvest(spark, sf_dir))


def run_harvest(spark: SparkSession, sf_dir: str) -> TableStore:
    base = f"{shared_dir(spark).rstrip('/')}/harvest-{uuid.uuid4().hex}"
    land(spark, sf_dir, f"{base}/landed")
    store, none = TableStore(spark, f"{base}/store"), F.lit(None)
    known = d.alarms(spark, sf_dir).select("device_id", F.col("plate").alias("plate_no"), none.cast("string").alias("company_slug"), "fleet_id", none.cast("string").alias("driver_name"), none.cast("timestamp").alias("last_seen_at"), none.cast("timestamp").alias("last_received_at")).distinct()
    create_harvest(store, known)
    harvest(spark, f"{base}/landed", store, d.companies(spark), d.ZONE, f"{base}/checkpoint")
    return store


@query("harvest_devices", f"{HARVEST_SQL} SELECT company_slug, cut_at, device_id, status, provider_rows, provider_dms_rows, inserted_raw, inserted_dms FROM devs")
def harvest_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each device in each cut: rows sent, rows new to the raw layer and to the events."""
    return harvested(spark, sf_dir).read("harvest_devices").drop("future_rejected", "error_message")


@query("harvest_runs", f"{HARVEST_SQL} SELECT company_slug, cut_at, status, devices_total, devices_done, rows_total, dms_total FROM runs")
def harvest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of each company and cut: partial if a device failed, rate_limited if the provider put one off."""
    return harvested(spark, sf_dir).read("harvest_runs").drop("error_message")


@query(
    "harvest_publications",
    f"""{HARVEST_SQL}, best AS (SELECT company_slug, max(cut_at) FILTER (status = 'succeeded') AS published_cut_at, arg_max(status, cut_at) AS status FROM runs GROUP BY 1)
    SELECT b.company_slug, b.published_cut_at, b.status, CASE WHEN b.published_cut_at IS NOT NULL THEN coalesce(e.events, 0) END AS events, e.last_event_at FROM best b LEFT JOIN (SELECT b.company_slug, count(DISTINCT m.guid) AS events, max(m.moment) AS last_event_at FROM best b JOIN marked m ON m.slug = b.company_slug AND m.cut_at <= b.published_cut_at AND m.class = 'classified_dms' GROUP BY 1) e USING (company_slug)""",
)
def harvest_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each company shows: the events of its last cut that succeeded, and how its last run went."""
    return harvested(spark, sf_dir).read("publications").drop("vehicles")


REBUILT: dict[tuple[str, str], str] = {}
FIRST, LAST = date(2024, 1, 1), date(2024, 1, 30)


def rebuilt(spark: SparkSession, sf_dir: str) -> TableStore:
    """A month rebuilt in three chunks; the provider puts the second off once, and the job goes on when it is run again."""
    return once(spark, REBUILT, sf_dir, lambda: run_rebuild(spark, sf_dir))


def run_rebuild(spark: SparkSession, sf_dir: str) -> TableStore:
    base = f"{shared_dir(spark).rstrip('/')}/rebuild-{uuid.uuid4().hex}"
    arriving(spark, sf_dir).withColumn("d", F.to_date(F.from_utc_timestamp("occurred_at", d.ZONE))).write.partitionBy("d").parquet(f"{base}/history")
    history, asked = spark.read.parquet(f"{base}/history"), []

    def fetch(lo: date, hi: date) -> DataFrame:
        asked.append(lo)
        if len(asked) == 2:
            raise Deferred(datetime(2024, 2, 1, 6))
        return history.filter(F.col("d").between(lo, hi)).drop("d")  # other days' folders aren't opened

    store = TableStore(spark, f"{base}/store")
    create_tables(store, known_devices(spark, sf_dir))
    for _ in range(2):
        rebuild(store, "month", fetch, FIRST, LAST, d.companies(spark))
    return store


REBUILT_SQL = TIMED_SQL + batch_sql("b", f"SELECT * FROM timed WHERE CAST(occurred_at - INTERVAL 5 HOUR AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'", "harvest", "none", "none")


@query("rebuild_raw", f"{REBUILT_SQL} SELECT {LAYER_SQL}, temporal AS temporal_status, result AS ingest_result FROM b_raw")
def rebuild_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw layer that a rebuild in chunks leaves: what the whole month gives at once."""
    return rebuilt(spark, sf_dir).read("alarm_raw").select(*LAYER, "temporal_status", "ingest_result")


@query("rebuild_jobs", f"{REBUILT_SQL} SELECT 'month' AS job, 'succeeded' AS status, CAST(30 AS BIGINT) AS days_total, CAST(30 AS BIGINT) AS days_done, count(*) AS rows_total, CAST(count(*) FILTER (event) AS BIGINT) AS inserted, CAST(count(*) FILTER (temporal <> 'accepted') AS BIGINT) AS anomalies FROM b_m")
def rebuild_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's row: all days done, and what came in over all chunks."""
    return rebuilt(spark, sf_dir).read("rebuild_jobs").select("job", "status", "days_total", "days_done", "rows_total", "inserted", "anomalies")
