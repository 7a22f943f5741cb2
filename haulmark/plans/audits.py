"""The operators' audit of a company as one report, and fleets that could become tenants, each as one roll-up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.operators.approvals import approve, create_reviews
from haulmark.operators.batches import kept_rows
from haulmark.plans.applied import TAKEN_SQL, taken_in
from haulmark.plans.client import CANDIDATE_SQL, REPORTED_SQL, manual_candidates, reconciliation
from haulmark.plans.operations import fleet_candidates, fleet_samples
from haulmark.plans.register import query
from haulmark.plans.raw_layer import raw
from haulmark.sources import domain as d
from haulmark.sources.shared import shared_dir
from haulmark.sources.versions import TableStore, once

START, END = "2024-01-20 00:00:00", "2024-01-31 00:00:00"
WINDOWS = {"requested": START, "recent_7d": "2024-01-24 00:00:00", "recent_24h": "2024-01-30 00:00:00"}


def histogram(rows: DataFrame, key: Column, name: str, most: int | None = None) -> DataFrame:
    """company_slug and name: key:count of each value in order of the key, or of the `most` commonest in order of count. Values are few, rows aren't collected."""
    counts = rows.groupBy("company_slug", key.alias("k")).agg(F.count("*").alias("n"))
    if most is None:
        entries = F.array_sort(F.collect_list(F.concat_ws(":", "k", "n")))
    else:
        counts = counts.withColumn("place", F.row_number().over(Window.partitionBy("company_slug").orderBy(F.desc("n"), "k"))).filter(F.col("place") <= most)
        entries = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "k", "n").alias("e")))), lambda x: x["e"])
    return counts.groupBy("company_slug").agg(F.array_join(entries, ",").alias(name))


def audit_report(events: DataFrame, raw: DataFrame, audits: DataFrame, anomalies: DataFrame, start: str, end: str, windows: dict[str, str]) -> DataFrame:
    """A row a company: accepted and visible alarms of the range with their histograms, stages and reasons of the audit, anomalies by reason, and for each
    window how many alarms, raw rows and devices it has. The columns of events that count are written once."""
    at = lambda text: F.lit(text).cast("timestamp")
    inside = lambda c, lo: F.coalesce(F.col(c).between(at(lo), at(end)), F.lit(False))
    events, raw = events.filter(F.col("occurred_at") <= at(end)), raw.filter((F.col("occurred_at") <= at(end)) | (F.col("received_at") <= at(end)))
    n = lambda c: F.count_if(c)
    # the few columns that count are written once; devices are counted by rows of their own, so no row is copied for a count of distinct ones
    events = kept_rows(events.select("company_slug", "device_id", "occurred_at", "classification_status", "mapping_source", "category", F.coalesce("raw_alarm_type", "raw_tp").alias("subtype")), "audited")
    totals = {"accepted_total": inside("occurred_at", start), "visible_total": inside("occurred_at", start) & (F.col("classification_status") == "classified_dms")} | {f"{name}_alarms": inside("occurred_at", lo) for name, lo in windows.items()}
    devices = events.groupBy("company_slug", "device_id").agg(*[n(c).alias(name) for name, c in totals.items()])
    out = devices.groupBy("company_slug").agg(
        *[F.sum(name).alias(name) for name in totals], *[n(F.col("device_id").isNotNull() & (F.col(f"{name}_alarms") > 0)).alias(f"{name}_devices") for name in windows],
    )
    kept = events.filter(inside("occurred_at", start))
    parts = [
        histogram(kept, F.coalesce("mapping_source", F.lit("unknown")), "mapping_sources"),
        histogram(kept, F.col("category"), "by_category"),
        histogram(kept, F.coalesce("subtype", F.lit("sin_subtipo")), "by_subtype", 20),
        raw.groupBy("company_slug").agg(*[n(inside("occurred_at", lo) | inside("received_at", lo)).alias(f"{name}_raw") for name, lo in windows.items()]),
        histogram(audits.filter(inside("observed_at", start)), F.col("stage"), "audit_stages"),
        histogram(audits.filter(inside("observed_at", start)), F.col("reason"), "audit_reasons"),
        histogram(anomalies.filter(inside("received_at", start)), F.col("reason"), "anomalies_by_reason"),
    ]
    for part in parts:
        out = out.join(part, "company_slug", "left")
    return out


def histogram_sql(table: str, key: str, where: str) -> str:
    return f"(SELECT slug, string_agg(k || ':' || n, ',' ORDER BY k || ':' || n) AS h FROM (SELECT slug, {key} AS k, count(*) AS n FROM {table} WHERE {where} GROUP BY ALL) GROUP BY slug)"


def window_sql(c: str, lo: str) -> str:
    return f"{c} BETWEEN TIMESTAMP '{lo}' AND TIMESTAMP '{END}'"


IN_RANGE = window_sql("moment", START)


@query(
    "audit_report",
    f"""{TAKEN_SQL}, shown AS (SELECT * FROM b2_events WHERE guid NOT IN (SELECT guid FROM alarms WHERE review = 'discarded')), said AS (SELECT * FROM b1_audit UNION ALL SELECT * FROM b2_audit n WHERE NOT EXISTS (SELECT 1 FROM b1_audit o WHERE o.guid = n.guid AND o.stage = n.stage AND o.reason = n.reason)),
    odd AS (SELECT t.slug, 'future_timestamp' AS reason, a.received_at FROM (SELECT * FROM b1_anomalies UNION ALL SELECT * FROM b2_anomalies) a JOIN tenant t USING (device_id)),
    subs AS (SELECT slug, string_agg(k || ':' || n, ',' ORDER BY n DESC, k) AS h FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, k) AS place FROM (SELECT slug, coalesce(alarm_type, raw_tp, 'sin_subtipo') AS k, count(*) AS n FROM shown WHERE {IN_RANGE} GROUP BY ALL)) WHERE place <= 20 GROUP BY slug),
    ev AS (SELECT slug, CAST(count(*) FILTER ({IN_RANGE}) AS BIGINT) AS accepted_total, {", ".join(f"CAST(count(*) FILTER ({window_sql('moment', lo)}) AS BIGINT) AS {name}_alarms, count(DISTINCT device_id) FILTER ({window_sql('moment', lo)}) AS {name}_devices" for name, lo in WINDOWS.items())} FROM shown GROUP BY slug),
    rw AS (SELECT slug, {", ".join(f"CAST(count(*) FILTER ({window_sql('moment', lo)} OR {window_sql('received_at', lo)}) AS BIGINT) AS {name}_raw" for name, lo in WINDOWS.items())} FROM b2_raw GROUP BY slug)
    SELECT ev.slug AS company_slug, ev.* EXCLUDE (slug), accepted_total AS visible_total, rw.* EXCLUDE (slug), ms.h AS mapping_sources, ct.h AS by_category, subs.h AS by_subtype, st.h AS audit_stages, rs.h AS audit_reasons, an.h AS anomalies_by_reason FROM ev LEFT JOIN rw USING (slug) LEFT JOIN subs USING (slug)
    LEFT JOIN {histogram_sql("shown", "coalesce(mapping_source, 'unknown')", IN_RANGE)} ms USING (slug) LEFT JOIN {histogram_sql("shown", "mapped", IN_RANGE)} ct USING (slug) LEFT JOIN {histogram_sql("said", "stage", IN_RANGE)} st USING (slug) LEFT JOIN {histogram_sql("said", "reason", IN_RANGE)} rs USING (slug)
    LEFT JOIN {histogram_sql("odd", "reason", window_sql("received_at", START))} an USING (slug)""",
)
def audit_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's audit over what batches have left: the range, the last week and the last day."""
    store = taken_in(spark, sf_dir)
    discarded = d.alarms(spark, sf_dir).filter("review = 'discarded'").select("guid")
    events = store.read("alarm_events").join(discarded, "guid", "left_anti")
    return audit_report(events, store.read("alarm_raw"), store.read("alarm_audit"), store.read("anomalies"), START, END, WINDOWS)


@query(
    "fleet_rollup",
    """SELECT coalesce(f.fleet_id, a.fleet_id, s.fleet_id) AS fleet_id, coalesce(f.devices, 0) AS devices, coalesce(a.recent, 0) AS recent_alarms, a.last_at, coalesce(s.vehicles, 0) AS vehicles, coalesce(s.sample, '') AS sample FROM (SELECT fleet_id, count(DISTINCT device_id) AS devices FROM readings WHERE fleet_id <> 'F4' GROUP BY 1) f
    FULL JOIN (SELECT fleet_id, count(*) AS recent, max(occurred_at) AS last_at FROM alarms WHERE fleet_id <> 'F0' AND occurred_at >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1) a ON f.fleet_id = a.fleet_id
    FULL JOIN (SELECT fleet_id, count(DISTINCT plate) AS vehicles, array_to_string(list(DISTINCT plate ORDER BY plate)[1:5], ',') AS sample FROM alarms GROUP BY fleet_id) s ON s.fleet_id = coalesce(f.fleet_id, a.fleet_id)""",
)
def fleet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleets with their devices, recent alarms and some of their vehicles, whichever of these they have."""
    both = fleet_candidates(spark, sf_dir).join(fleet_samples(spark, sf_dir), "fleet_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("fleet_id", zero("devices"), zero("recent_alarms"), "last_at", zero("vehicles"), F.coalesce("sample", F.lit("")).alias("sample"))


APPLIED: dict[tuple[str, str], str] = {}
APPLIED_SQL = f"""{REPORTED_SQL}, chosen AS (SELECT * FROM recon WHERE {CANDIDATE_SQL}), taken AS (SELECT * FROM chosen WHERE company_slug <> 'gamma'), held AS (SELECT guid, company_slug, device_id, source, status FROM stored)"""


def applied(spark: SparkSession, sf_dir: str) -> TableStore:
    """A store after the portal's candidates of all companies but one were approved, twice."""
    return once(spark, APPLIED, sf_dir, lambda: run_approvals(spark, sf_dir))


def run_approvals(spark: SparkSession, sf_dir: str) -> TableStore:
    store = TableStore(spark, f"{shared_dir(spark).rstrip('/')}/reviews-{uuid.uuid4().hex}")
    stored = raw(spark, sf_dir).filter("event_id % 11 <> 0").select("guid", "company_slug", "device_id", "source", "status")
    stored = kept_rows(stored, "stored")  # two tables are made from it
    key = F.sha2(F.concat_ws("|", "company_slug", "guid"), 256).alias("review_key")
    none = F.lit(None)
    reviews = manual_candidates(reconciliation(spark, sf_dir)).select(key, "guid", "company_slug", "device_id", (F.col("class") == "classified_dms").alias("dms"), F.lit("pending").alias("review_status"), none.cast("string").alias("decided_by"), none.cast("timestamp").alias("applied_at"))
    create_reviews(store, stored.withColumn("ingest_result", F.lit("stored")).drop("status"), stored.filter("status = 'classified_dms'").drop("status"), reviews)
    for _ in range(2):
        approve(store, F.col("company_slug") != "gamma", "operator", F.lit(d.AS_OF).cast("timestamp"))
    return store


@query(
    "portal_applied_raw",
    f"""{APPLIED_SQL} SELECT guid, company_slug, device_id, source, 'stored' AS ingest_result FROM held WHERE guid NOT IN (SELECT guid FROM taken) UNION ALL
    SELECT guid, company_slug, device_id, 'portal', CASE WHEN guid IN (SELECT guid FROM held WHERE status = 'classified_dms') THEN 'updated_alarm_event' ELSE 'inserted_alarm_event' END FROM taken""",
)
def portal_applied_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw layer after approvals."""
    return applied(spark, sf_dir).read("raw")


@query("portal_applied_events", f"{APPLIED_SQL} SELECT guid, company_slug, device_id, source FROM held WHERE status = 'classified_dms' AND guid NOT IN (SELECT guid FROM taken) UNION ALL SELECT guid, company_slug, device_id, 'portal' FROM taken")
def portal_applied_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events after approvals: candidates are drivers' alarms, so each is one."""
    return applied(spark, sf_dir).read("events")


@query("portal_applied_reviews", f"{APPLIED_SQL} SELECT company_slug, CASE WHEN company_slug = 'gamma' THEN 'pending' ELSE 'approved' END AS review_status, count(*) AS n FROM chosen GROUP BY ALL")
def portal_applied_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(spark, sf_dir).read("reviews").groupBy("company_slug", "review_status").agg(F.count("*").alias("n"))
