"""Queries over landed provider data and over the configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import expressions as x
from haulmark.operators import upserts
from haulmark.plans.raw_layer import RAW_SQL, devices
from haulmark.plans.register import query
from haulmark.sources import domain as d
from haulmark.sources.messages import at, envelope_rows, opened
from haulmark.sources.provider import history, land_history
from haulmark.sources.shared import shared_dir
from haulmark.sources.tables import assign_company, switch_company

#: Folders that the provider's history is landed in.
HISTORY_PARTS = 64


@query("provider_history", "SELECT guid, device_id, category, tp, occurred_at, CAST(value AS DOUBLE) AS value FROM alarms WHERE device_id IN ('D00003', 'D00007') AND occurred_at >= TIMESTAMP '2024-01-10 00:00:00' AND occurred_at < TIMESTAMP '2024-01-25 00:00:00' AND category <> 'Bostezo'")
def provider_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two devices' alarms of a fortnight: the source gets the devices and the times, Spark filters the category."""
    base = f"{shared_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    rows = d.alarms(spark, sf_dir).select("guid", "device_id", "category", "tp", "occurred_at", F.col("value").cast("double").alias("value"))
    land_history(rows, base, HISTORY_PARTS)
    rows = history(spark, base if "://" in base or base.startswith("file:") else f"file://{base}", HISTORY_PARTS)
    return rows.filter(F.col("device_id").isin("D00003", "D00007") & (F.col("occurred_at") >= F.expr("TIMESTAMP '2024-01-10 00:00:00'")) & (F.col("occurred_at") < F.expr("TIMESTAMP '2024-01-25 00:00:00'")) & (F.col("category") != "Bostezo"))


@query("device_sync", f"{RAW_SQL} SELECT device_id, CASE WHEN right(device_id, 1) IN ('1', '6') THEN 'N' || right(device_id, 1) ELSE fleet_id END AS fleet_id, plate FROM devices UNION ALL SELECT 'X' || device_id, 'N1', plate FROM devices WHERE right(device_id, 1) = '1'")
def device_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider's device catalogue (landed replies) put into the device table: known devices get what it says, new ones come in."""
    v = devices(spark, sf_dir).select("device_id", "fleet_id", "plate")
    last = F.col("device_id").substr(-1, 1)
    item = lambda device: F.to_json(F.struct(device.alias("deviceID"), F.concat(F.lit("N"), last).alias("fleetID"), F.lower("plate").alias("plateNo")))
    reply = F.concat(F.lit('{"status":0,"data":{"list":['), F.concat_ws(",", item(F.col("device_id")), F.when(last == "1", item(F.concat(F.lit("X"), "device_id"))), F.lit("7")), F.lit("]}}"))
    told = envelope_rows(v.filter(last.isin("1", "6")).select(reply.alias("value")))
    new = opened(told.select(F.col("value").alias("body")), [], ()).select(at("deviceID").alias("device_id"), at("fleetID").alias("fleet_id"), x.plate_label(at("plateNo")).alias("plate"))
    return upserts.merge_fields(v, new, ["device_id"])


@query(
    "config_writes",
    """, c AS (SELECT company_slug AS slug, min(device_id) AS lo, max(device_id) AS hi, list(DISTINCT fleet_id ORDER BY fleet_id) AS fleets FROM alarms GROUP BY 1)
    SELECT slug, CASE slug WHEN 'acme' THEN hi WHEN 'beta' THEN array_to_string(list_sort(list_distinct([lo, hi, 'D99999'])), ',') ELSE '' END AS devices, CASE slug WHEN 'acme' THEN '' WHEN 'beta' THEN array_to_string(list_sort(list_distinct(list_append(fleets, 'F9'))), ',') END AS fleets FROM c WHERE slug <> 'gamma' UNION ALL SELECT 'gamma new', (SELECT lo FROM c WHERE slug = 'gamma'), ''
    UNION ALL SELECT 'idle', '', (SELECT array_to_string(list(DISTINCT fleet_id ORDER BY fleet_id), ',') FROM alarms)""",
)
def config_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that the alarms know, and changes to them: one is assigned a device, one gets more, one is deleted, one is new; what isn't named stays."""
    a = d.alarms(spark, sf_dir)
    known = a.groupBy("company_slug").agg(F.array_distinct(F.array(F.min("device_id"), F.max("device_id"))).alias("device_ids"), F.collect_set("fleet_id").alias("fleet_ids")).withColumnRenamed("company_slug", "slug")  # two devices and few fleets each
    none = F.array().cast("array<string>")
    idle = a.agg(none.alias("device_ids"), F.collect_set("fleet_id").alias("fleet_ids")).withColumn("slug", F.lit("idle"))
    lo, hi = F.element_at("device_ids", 1), F.element_at("device_ids", -1)
    slug = F.col("slug")
    act = lambda slug, action, devices, fleets: F.struct(slug.alias("slug"), F.lit(action).alias("action"), devices.alias("device_ids"), fleets.alias("fleet_ids"))
    gone = F.array(act(slug, "delete", none, none), act(F.lit("gamma new"), "assign", F.array(lo), none))
    acts = known.select(F.when(slug == "gamma", gone).when(slug == "acme", F.array(act(slug, "assign", F.array(hi, hi), none))).otherwise(F.array(act(slug, "add", F.array(F.lit("D99999"), lo), F.array(F.lit("F9"))))).alias("c"))
    changes = acts.select(F.explode("c").alias("c")).select("c.*")
    out = assign_company(known.unionByName(idle), changes)
    return out.select("slug", F.array_join("device_ids", ",").alias("devices"), F.array_join("fleet_ids", ",").alias("fleets"))


@query(
    "config_switches",
    """, live AS (SELECT company_slug AS slug, count(*) FILTER (day = DATE '2024-01-30') AS now, list(DISTINCT fleet_id ORDER BY fleet_id) AS fleets FROM alarms GROUP BY 1)
    SELECT slug, now % 2 = 0 AS active, CASE WHEN now % 2 = 0 THEN array_to_string(fleets, ',') ELSE '' END AS fleets FROM live""",
)
def config_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies activated and deactivated: one that is deactivated keeps its row, but lists nothing until it is activated again."""
    a = d.alarms(spark, sf_dir)
    rows = a.groupBy("company_slug").agg(F.count_if(F.col("day") == F.expr(d.LAST_DAY)).alias("now"), F.collect_set("fleet_id").alias("fleet_ids")).withColumnRenamed("company_slug", "slug")
    config = rows.select("slug", F.array().cast("array<string>").alias("device_ids"), "fleet_ids")
    out = switch_company(config, rows.select("slug", (F.col("now") % 2 == 0).alias("active")))
    return out.select("slug", "active", F.array_join("fleet_ids", ",").alias("fleets"))
