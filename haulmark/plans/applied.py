"""Batches taken in by the table store: what each table holds after a backfill, an overlapping harvest, and the same harvest once more."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import expressions as x
from haulmark.operators.batches import apply_batch, create_tables
from haulmark.operators.singles import ingest_singles
from haulmark.plans.ingest import CLASS_SQL, classified
from haulmark.plans.operations import COMPANY_SQL
from haulmark.plans.raw_layer import FALLBACK_SQL
from haulmark.plans.register import query
from haulmark.sources import domain as d
from haulmark.sources.shared import shared_dir
from haulmark.sources.versions import TableStore, once


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms as messages bring them: unknown texts and codes, plates as numbers, several times."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    minutes = lambda n: F.col("occurred_at") + F.expr(f"INTERVAL {n} MINUTES")
    k, known = F.col("event_id"), F.col("user_id") % 4 != 0
    rows = classified(spark, sf_dir)
    return rows.select(
        k.alias("seq"), "guid", "device_id", F.when(~known | (k % 2 == 0), F.col("fleet_id")).alias("fleet_id"), F.when(known & (k % 3 == 0), F.lpad(F.col("user_id").cast("string"), 8, "9")).otherwise(F.lower("plate")).alias("plate_no"), F.when(k % 7 == 0, F.concat(F.lit("driver "), k % 5)).alias("driver_name"),
        F.col("mapped").alias("category"), "mapping_source", F.col("status").alias("classification_status"), F.col("alarm_type").alias("raw_alarm_type"), "raw_tp", F.col("raw_code").alias("raw_event_code"), "occurred_at", F.col("occurred_at").alias("start_at"),
        (F.col("occurred_at") + F.expr("INTERVAL 4 SECONDS")).alias("end_at"), "received_at", text(F.col("occurred_at")).alias("raw_event_time"), F.concat(F.lit('{"id":'), k, F.lit("}")).alias("payload_json"),
        F.when(k % 2 == 0, text(F.col("received_at"))).otherwise("").alias("report_text"), F.when(k % 3 == 0, text(F.col("occurred_at"))).otherwise(text(minutes(2))).alias("end_text"), F.when(k % 5 != 0, text(minutes(-20))).otherwise("never").alias("start_text"),
    )


def harvested(rows: DataFrame) -> DataFrame:
    """Rows as a later fetch brings them: some with another guid, some with another end, some with both, and every tenth twice."""
    k = F.col("seq")
    guid = F.when(k % 4 == 1, F.concat(F.lit("x"), "guid")).when(k % 4 == 3, F.concat(F.lit("y"), "guid")).otherwise(F.col("guid"))
    end = F.when(k % 4 >= 2, F.col("end_at") + F.expr("INTERVAL 5 SECONDS")).otherwise(F.col("end_at"))
    again = rows.filter("seq % 10 = 0").withColumns({"guid": F.concat(F.lit("r"), "guid"), "end_at": end, "seq": k + 1_000_000_000})
    return rows.withColumns({"guid": guid, "end_at": end}).unionByName(again)


def known_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue before the first batch: three of four devices, with their plate and fleet."""
    none = F.lit(None).cast("timestamp")
    rows = d.alarms(spark, sf_dir).filter("user_id % 4 <> 0").select("device_id", F.col("plate").alias("plate_no"), F.lit(None).cast("string").alias("company_slug"), "fleet_id", F.lit(None).cast("string").alias("driver_name"), none.alias("last_seen_at"), none.alias("last_received_at"))
    return rows.distinct()


BACKFILL, HARVEST = "occurred_at < TIMESTAMP '2024-01-16 00:00:00'", "occurred_at >= TIMESTAMP '2024-01-12 00:00:00'"


#: One store for the six queries of a session and its tables.
STORES: dict[tuple[str, str], str] = {}


def taken_in(spark: SparkSession, sf_dir: str) -> TableStore:
    """A store after a backfill, a harvest that overlaps it, and a replay of the harvest."""
    return once(spark, STORES, sf_dir, lambda: take_in(spark, sf_dir))


def take_in(spark: SparkSession, sf_dir: str) -> TableStore:
    store = TableStore(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    create_tables(store, known_devices(spark, sf_dir))
    rows, companies = arriving(spark, sf_dir), d.companies(spark)
    apply_batch(store, "b1", rows.filter(BACKFILL), companies, "backfill")
    harvest = harvested(rows.filter(HARVEST))
    apply_batch(store, "b2", harvest, companies, "harvest")
    apply_batch(store, "b2", harvest, companies, "harvest")
    return store


SLUG_SQL = "tenant AS (SELECT device_id, arg_min(slug, company_position) AS slug FROM member GROUP BY device_id)"
STAMP = "coalesce(strftime(date_trunc('second', {}), '%Y-%m-%dT%H:%M:%S+00:00'), '-')"
KEY = f"sha1(concat_ws('|', slug, lower(device_id), lower(mapped), lower(trim(coalesce(alarm_type, ''))), coalesce(raw_tp, ''), coalesce(raw_code, ''), {STAMP.format('moment')}, {STAMP.format('start_at')}, {STAMP.format('end_at')}))"


def batch_sql(name: str, rows: str, source: str, raw: str, events: str) -> str:
    """CTEs of one batch: rows told, kept, matched with what is stored, and the layers after it."""
    match = lambda table, where: f"(SELECT f.seq, coalesce((SELECT min(o.guid) FROM {table} o WHERE o.k = f.k), (SELECT min(o.guid) FROM {table} o WHERE o.guid = f.guid), (SELECT min(o.guid) FROM {table} o WHERE o.device_id = f.device_id AND o.mapped = f.mapped AND o.alarm_type IS NOT DISTINCT FROM f.alarm_type AND o.raw_tp IS NOT DISTINCT FROM f.raw_tp AND o.raw_code IS NOT DISTINCT FROM f.raw_code AND o.moment = f.moment)) AS found FROM {name}_first f WHERE {where})"
    columns = "k, slug, device_id, fleet, plate, source, moment, received_at, alarm_type, raw_tp, raw_code, now_text, status, mapped, mapping_source, temporal, result, driver, start_at, end_at"
    return f""",
{name}_told AS (SELECT *, {KEY} AS k, '{source}' AS source FROM ({rows})),
{name}_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, k ORDER BY seq) AS n1, row_number() OVER (PARTITION BY device_id, mapped, alarm_type, raw_tp, raw_code, moment ORDER BY seq) AS n2 FROM {name}_told) WHERE n1 = 1 AND n2 = 1),
{name}_m AS (SELECT f.* REPLACE (coalesce(r.found, f.guid) AS guid), f.guid AS own, r.found AS raw_found, e.found AS event_found, e.seq IS NOT NULL AS event,
  CASE WHEN temporal <> 'accepted' THEN 'future_rejected' WHEN e.found IS NOT NULL THEN 'updated_alarm_event' WHEN e.seq IS NOT NULL THEN 'inserted_alarm_event' WHEN status = 'classified_non_dms' THEN 'kept_raw_only_non_dms' ELSE 'kept_raw_only_unmapped' END AS result
  FROM {name}_first f LEFT JOIN {match(raw, "true")} r USING (seq) LEFT JOIN {match(events, "status = 'classified_dms' AND temporal = 'accepted'")} e USING (seq)),
{name}_nr AS (SELECT * EXCLUDE (n) FROM (SELECT guid, {columns}, row_number() OVER (PARTITION BY guid ORDER BY seq DESC) AS n FROM {name}_m) WHERE n = 1),
{name}_ne AS (SELECT * EXCLUDE (n) FROM (SELECT coalesce(event_found, guid) AS guid, {columns}, row_number() OVER (PARTITION BY coalesce(event_found, guid) ORDER BY seq DESC) AS n FROM {name}_m WHERE event) WHERE n = 1),
{name}_raw AS (SELECT * FROM {name}_nr UNION ALL SELECT * FROM {raw} WHERE guid NOT IN (SELECT guid FROM {name}_nr)),
{name}_events AS (SELECT * FROM {name}_ne UNION ALL SELECT * FROM {events} WHERE guid NOT IN (SELECT guid FROM {name}_ne)),
{name}_audit AS (SELECT own AS guid, slug, device_id, moment, s.stage AS stage, s.reason AS reason FROM {name}_m, LATERAL (VALUES ('classification_{source}', status), ('temporal_resolution_{source}', resolution), ('ingest_result_{source}', result), ('{source}_alarm', CASE WHEN temporal <> 'accepted' THEN 'future_timestamp' END)) s(stage, reason) WHERE s.reason IS NOT NULL),
{name}_anomalies AS (SELECT device_id, '{source}_alarm' AS source_type, now_text AS raw_event_time, arg_min(received_at, seq) AS received_at FROM {name}_m WHERE temporal <> 'accepted' GROUP BY ALL)"""


TIMED_SQL = f""", {CLASS_SQL.strip()}, {FALLBACK_SQL.strip()}, {COMPANY_SQL.strip()}, {SLUG_SQL},
fb AS (SELECT guid, now_text, occurred_at > received_at + INTERVAL 5 MINUTE AS future, CASE WHEN report_text <> '' AND report_text <> now_text AND TRY_CAST(report_text AS TIMESTAMP) <= received_at + INTERVAL 5 MINUTE THEN TRY_CAST(report_text AS TIMESTAMP) END AS c1,
  CASE WHEN end_text <> now_text AND TRY_CAST(end_text AS TIMESTAMP) <= received_at + INTERVAL 5 MINUTE THEN TRY_CAST(end_text AS TIMESTAMP) END AS c2, CASE WHEN TRY_CAST(start_text AS TIMESTAMP) <= received_at + INTERVAL 5 MINUTE THEN TRY_CAST(start_text AS TIMESTAMP) END AS c3 FROM t),
arr AS (SELECT c.event_id AS seq, c.guid, c.device_id, c.fleet_id AS fleet, c.plate, CASE WHEN c.event_id % 7 = 0 THEN 'driver ' || (c.event_id % 5) END AS driver, c.mapped, c.mapping_source, c.status, c.alarm_type, c.raw_tp, c.raw_code, c.occurred_at, c.occurred_at AS start_at, c.occurred_at + INTERVAL 4 SECOND AS end_at, c.received_at, fb.now_text, tenant.slug,
  CASE WHEN future THEN coalesce(c1, c2, c3, c.occurred_at) ELSE c.occurred_at END AS moment, CASE WHEN future THEN CASE WHEN c1 IS NOT NULL THEN 'fallback_reportTime' WHEN c2 IS NOT NULL THEN 'fallback_endTime' WHEN c3 IS NOT NULL THEN 'fallback_startTime' END END AS resolution FROM classes c JOIN fb USING (guid) JOIN tenant USING (device_id)),
timed AS (SELECT *, CASE WHEN moment > received_at + INTERVAL 5 MINUTE THEN 'future_rejected' ELSE 'accepted' END AS temporal FROM arr),
none AS (SELECT guid, CAST(NULL AS VARCHAR) AS k, slug, device_id, fleet, plate, '' AS source, moment, received_at, alarm_type, raw_tp, raw_code, now_text, status, mapped, mapping_source, temporal, '' AS result, driver, start_at, end_at FROM timed WHERE false)"""
TAKEN_SQL = f"""{TIMED_SQL}{batch_sql("b1", f"SELECT * FROM timed WHERE {BACKFILL}", "backfill", "none", "none")},
drivers AS (SELECT device_id, arg_max(driver, seq) FILTER (driver IS NOT NULL) AS last_driver FROM b1_m GROUP BY 1),
later AS (SELECT timed.* REPLACE (coalesce(driver, last_driver) AS driver, CASE WHEN seq % 4 >= 2 THEN end_at + INTERVAL 5 SECOND ELSE end_at END AS end_at) FROM timed LEFT JOIN drivers USING (device_id) WHERE {HARVEST})
{batch_sql("b2", "SELECT * REPLACE (CASE seq % 4 WHEN 1 THEN 'x' || guid WHEN 3 THEN 'y' || guid ELSE guid END AS guid) FROM later UNION ALL SELECT * REPLACE ('r' || guid AS guid, seq + 1000000000 AS seq) FROM later WHERE seq % 10 = 0", "harvest", "b1_raw", "b1_events")}"""

LAYER_SQL = "guid, k AS provider_event_key, slug AS company_slug, device_id, fleet AS fleet_id, plate AS plate_no, source, moment AS occurred_at, received_at, raw_code AS raw_event_code, status AS classification_status, mapped AS category"
LAYER = ["guid", "provider_event_key", "company_slug", "device_id", "fleet_id", "plate_no", "source", "occurred_at", "received_at", "raw_event_code", "classification_status", "category"]


@query("batch_raw", f"{TAKEN_SQL} SELECT {LAYER_SQL}, temporal AS temporal_status, result AS ingest_result FROM b2_raw")
def batch_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw layer after the batches: a row a guid, each updated by what was found under its key, its guid or its exact time."""
    return taken_in(spark, sf_dir).read("alarm_raw").select(*LAYER, "temporal_status", "ingest_result")


@query("batch_events", f"{TAKEN_SQL} SELECT {LAYER_SQL}, driver AS driver_name, end_at FROM b2_events")
def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events after the batches: classified alarms with an accepted time."""
    return taken_in(spark, sf_dir).read("alarm_events").select(*LAYER, "driver_name", "end_at")


@query("batch_audit", f"{TAKEN_SQL} SELECT guid, slug AS company_slug, device_id, moment AS observed_at, stage, reason FROM b1_audit UNION ALL SELECT guid, slug, device_id, moment, stage, reason FROM b2_audit n WHERE NOT EXISTS (SELECT 1 FROM b1_audit o WHERE o.guid = n.guid AND o.stage = n.stage AND o.reason = n.reason)")
def batch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every row, once: class, how its time was found, what became of it, and a time that was rejected."""
    return taken_in(spark, sf_dir).read("alarm_audit").select("guid", "company_slug", "device_id", "observed_at", "stage", "reason")


@query("batch_anomalies", f"{TAKEN_SQL} SELECT * FROM b1_anomalies UNION ALL SELECT * FROM b2_anomalies")
def batch_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_in(spark, sf_dir).read("anomalies").select("device_id", "source_type", "raw_event_time", "received_at")


@query(
    "batch_devices",
    f"""{TAKEN_SQL}, seen AS (SELECT device_id, 1 AS b, arg_min(plate, seq) AS plate_no, arg_min(slug, seq) AS company_slug, arg_min(fleet, seq) AS fleet_id, arg_max(driver, seq) FILTER (driver IS NOT NULL) AS driver_name, max(moment) AS last_seen_at, max(received_at) AS last_received_at FROM b1_m GROUP BY 1
    UNION ALL SELECT device_id, 2, arg_min(plate, seq), arg_min(slug, seq), arg_min(fleet, seq), arg_max(driver, seq) FILTER (driver IS NOT NULL), max(moment), max(received_at) FROM b2_m GROUP BY 1)
    SELECT device_id, arg_max(plate_no, b) AS plate_no, arg_max(company_slug, b) AS company_slug, arg_max(fleet_id, b) AS fleet_id, arg_max(driver_name, b) FILTER (driver_name IS NOT NULL) AS driver_name, max(last_seen_at) AS last_seen_at, max(last_received_at) AS last_received_at FROM seen GROUP BY device_id""",
)
def batch_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device records after the batches: later times win, what a batch doesn't know stays."""
    return taken_in(spark, sf_dir).read("devices")


def ledger_sql(name: str, source: str) -> str:
    count = lambda c: f"CAST(count(*) FILTER ({c}) AS BIGINT)"
    return f"""SELECT '{name}' AS batch, '{source}' AS source, (SELECT count(*) FROM {name}_told) AS provider_rows, count(*) AS prepared_rows, (SELECT count(*) FROM {name}_told) - count(*) AS duplicates, {count("raw_found IS NULL")} AS raw_inserted, {count("raw_found IS NOT NULL")} AS raw_updated,
    {count("event AND event_found IS NULL")} AS dms_inserted, {count("event AND event_found IS NOT NULL")} AS dms_updated, (SELECT {count("temporal = 'accepted' AND status = 'classified_non_dms'")} FROM {name}_told) AS non_dms, (SELECT {count("temporal = 'accepted' AND status = 'unmapped'")} FROM {name}_told) AS unmapped,
    {count("temporal <> 'accepted'")} AS temporal_rejected, max(moment) FILTER (event) AS latest_observed_at FROM {name}_m"""


@query("batch_ledger", f"{TAKEN_SQL} {ledger_sql('b1', 'backfill')} UNION ALL {ledger_sql('b2', 'harvest')}")
def batch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each batch; a replay has none."""
    return taken_in(spark, sf_dir).read("ledger")


SINGLES: dict[tuple[str, str], str] = {}


def one_by_one(spark: SparkSession, sf_dir: str) -> TableStore:
    """A store after the same alarms came one by one: no row is a duplicate then, a repeated one updates what the first has left."""
    return once(spark, SINGLES, sf_dir, lambda: take_singly(spark, sf_dir))


def take_singly(spark: SparkSession, sf_dir: str) -> TableStore:
    store = TableStore(spark, f"{shared_dir(spark).rstrip('/')}/singles-{uuid.uuid4().hex}")
    create_tables(store, known_devices(spark, sf_dir))
    rows, companies = arriving(spark, sf_dir).withColumn("total_mileage_km", F.col("seq").cast("double")), d.companies(spark)
    ingest_singles(store, "s1", rows.filter(BACKFILL), companies, "backfill", d.ZONE)
    ingest_singles(store, "s2", harvested(rows.filter(HARVEST)), companies, "harvest", d.ZONE)
    return store


AGAIN_SQL = "(SELECT guid, bool_or(seq % 10 = 0) AS again FROM b2_m GROUP BY 1) a"


@query("singles_raw", f"{TAKEN_SQL} SELECT {LAYER_SQL}, temporal AS temporal_status, CASE WHEN again AND result = 'inserted_alarm_event' THEN 'updated_alarm_event' ELSE result END AS ingest_result FROM b2_raw LEFT JOIN {AGAIN_SQL} USING (guid)")
def singles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw layer after alarms one by one: every tenth of the harvest came twice, so its event is an updated one."""
    return one_by_one(spark, sf_dir).read("alarm_raw").select(*LAYER, "temporal_status", "ingest_result")


@query(
    "singles_snapshots",
    f"""{TAKEN_SQL}, fresh AS (SELECT device_id, moment, seq FROM b1_m WHERE event AND event_found IS NULL UNION ALL SELECT device_id, moment, seq FROM b2_m WHERE event AND event_found IS NULL)
    SELECT device_id, CAST(moment - INTERVAL 5 HOUR AS DATE) AS snapshot_date, max(moment) AS observed_at, CAST(arg_max(seq, (moment, seq)) AS DOUBLE) AS total_km FROM fresh GROUP BY ALL""",
)
def singles_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily snapshots that alarms leave: only those that are new events write them."""
    return one_by_one(spark, sf_dir).read("alarm_snapshots").select("device_id", "snapshot_date", "observed_at", "total_km")
