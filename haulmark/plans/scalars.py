"""Scalar rules and message normalising over whole tables: messages are made from alarms, so what they must become is known."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import expressions as x
from haulmark.plans.register import query
from haulmark.sources import domain as d
from haulmark.sources.messages import normalize_alarm, normalize_status, rejected
from haulmark.sources.shared import shared_dir
from haulmark.sources.tables import company_config
from haulmark.streaming.cuts import publish_guard


def local_text(c: str | Column) -> Column:
    """A time as the provider writes it: local, without zone."""
    return F.date_format(F.from_utc_timestamp(c, d.ZONE), "yyyy-MM-dd HH:mm:ss")


def seconds(n: int) -> Column:
    return F.expr(f"INTERVAL {n} SECONDS")


@query("plate_or_device", "SELECT guid, CASE WHEN event_id % 3 = 0 THEN device_id ELSE plate END AS label FROM alarms")
def plate_or_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plate, or the device where that is missing or empty."""
    plate = F.when(F.col("event_id") % 3 != 0, F.col("plate")).when(F.col("event_id") % 2 == 0, F.lit(""))
    return d.alarms(spark, sf_dir).select("guid", x.first_non_empty(plate, F.col("device_id")).alias("label"))


@query("company_slugs", "SELECT DISTINCT 'acme-co-' || (user_id % 7) AS slug, user_id % 7 AS k FROM alarms")
def company_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of companies as slugs: lower case, without punctuation, with single dashes."""
    k = F.col("user_id") % 7
    return d.alarms(spark, sf_dir).select(x.company_slug(F.concat(F.lit("  Acme, Co.__ "), k, F.lit(" - "))).alias("slug"), k.alias("k")).distinct()


@query("raw_strings", "SELECT guid, CASE event_id % 4 WHEN 0 THEN tp WHEN 1 THEN NULL WHEN 2 THEN NULL END AS cleaned FROM alarms")
def raw_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of messages: trimmed; empty ones and dashes are missing."""
    k = F.col("event_id") % 4
    return d.alarms(spark, sf_dir).select("guid", x.clean_string(F.when(k == 0, F.concat(F.lit(" "), "tp", F.lit(" "))).when(k == 1, "-").when(k == 2, "  ")).alias("cleaned"))


@query("distance_texts", "SELECT guid, CASE event_id % 3 WHEN 0 THEN round(event_id * 1000 / 1000.0, 1) WHEN 1 THEN round(event_id + 0.5, 1) END AS km FROM alarms")
def distance_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances as texts: whole numbers are metres, others kilometres, thousands have commas; anything else is missing."""
    n, k = F.col("event_id"), F.col("event_id") % 3
    return d.alarms(spark, sf_dir).select("guid", x.distance_km(F.when(k == 0, F.concat(n, F.lit(",000"))).when(k == 1, F.concat(n, F.lit(".5"))).otherwise("far")).alias("km"))


@query("parse_times", "SELECT guid, CASE WHEN event_id % 6 < 5 THEN date_trunc('second', occurred_at) END AS at FROM alarms")
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in the shapes that messages have: seconds, milliseconds, local texts and ISO with a zone; others are missing."""
    at, k = F.date_trunc("second", "occurred_at"), F.col("event_id") % 6
    shapes = [F.unix_seconds(at).cast("string"), F.unix_millis(at).cast("string"), local_text(at), F.date_format(F.from_utc_timestamp(at, d.ZONE), "yyyy/MM/dd HH:mm:ss"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))]
    text = F.lit("soon")
    for i, shape in enumerate(shapes):
        text = F.when(k == i, shape).otherwise(text)
    return d.alarms(spark, sf_dir).select("guid", x.parse_time(text, d.ZONE).alias("at"))


@query("reason_lists", "SELECT guid, CASE event_id % 3 WHEN 0 THEN 'day_gt_total,late' WHEN 1 THEN 'late' ELSE 'late,day_gt_total' END AS reasons FROM alarms")
def reason_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of reasons that each is added to once."""
    k = F.col("event_id") % 3
    before = F.when(k == 0, "day_gt_total").when(k == 1, "").otherwise("late,day_gt_total")
    return d.alarms(spark, sf_dir).select("guid", x.add_reason(before, F.lit("late")).alias("reasons"))


@query("backoff_seconds", "SELECT DISTINCT user_id % 9 AS tries, CAST(least(15 * pow(2, user_id % 9), 900) AS BIGINT) AS wait_seconds FROM alarms")
def backoff_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = F.col("user_id") % 9
    return d.alarms(spark, sf_dir).select(tries.alias("tries"), x.backoff(15, tries, 900).alias("wait_seconds")).distinct()


@query("publish_monotone", "SELECT company_slug, max(time_bucket(INTERVAL 15 MINUTE, occurred_at)) AS cut_at FROM alarms GROUP BY company_slug")
def publish_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older cut that comes late never takes a publication back."""
    cuts = lambda kind: d.alarms(spark, sf_dir).filter(kind).groupBy("company_slug").agg(F.max(x.cut_start(F.col("occurred_at"))).alias("cut_at"))
    return publish_guard(cuts("event_id % 2 = 0"), cuts("event_id % 2 = 1"))


def alarm_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms as the provider sends them: by turns in the historical and in the live shape, and one of seven that is no message."""
    at = F.date_trunc("second", "occurred_at")
    flat = F.to_json(F.struct(
        F.col("guid").alias("alarmID"), F.col("device_id").alias("deviceID"), F.concat(F.lower(F.substring("plate", 1, 3)), F.lit("-"), F.substring("plate", 4, 3)).alias("plateNo"), F.lit("Yawning").alias("alarmTypeValue"), F.lit("122").alias("alarmType"),
        local_text(at).alias("startTime"), local_text(at + seconds(3)).alias("endTime"), local_text(at + seconds(9)).alias("reportTime"), F.lit("-74.1,4.6").alias("alarmGps"), (F.col("event_id") * 100).alias("totalMileage"),
    ))
    payload = F.struct(F.col("guid").alias("uuid"), F.lit("121").alias("ec"), local_text(at).alias("st"), local_text(at + seconds(4)).alias("et"), F.struct(F.lit("65").alias("tp")).alias("det"))
    live = F.to_json(F.struct(F.col("device_id").alias("deviceID"), payload.alias("payload"), F.struct(F.lit("4.5").alias("latitude"), F.lit("-74.2").alias("longitude")).alias("location")))
    value = F.when(F.col("event_id") % 7 == 6, F.lit("ping")).when(F.col("event_id") % 2 == 0, flat).otherwise(live)
    return d.alarms(spark, sf_dir).select(value.alias("value"))


@query(
    "normalized_alarms",
    """SELECT guid, device_id, date_trunc('second', occurred_at) + CASE WHEN event_id % 2 = 0 THEN INTERVAL 3 SECOND ELSE INTERVAL 0 SECOND END AS occurred_at, date_trunc('second', occurred_at) AS start_at, date_trunc('second', occurred_at) + CASE WHEN event_id % 2 = 0 THEN INTERVAL 3 SECOND ELSE INTERVAL 4 SECOND END AS end_at,
    CASE WHEN event_id % 2 = 0 THEN 'Bostezo' ELSE 'Ojos cerrados' END AS category, CASE WHEN event_id % 2 = 0 THEN 'text_alarm_type' ELSE 'subtype_map' END AS mapping_source, 'classified_dms' AS classification_status, 'visible' AS visibility_status, CASE WHEN event_id % 2 = 0 THEN 'Yawning' ELSE '65' END AS subtype,
    CASE WHEN event_id % 2 = 1 THEN '65' END AS raw_tp, CASE WHEN event_id % 2 = 0 THEN '122' ELSE '121' END AS raw_event_code, CASE WHEN event_id % 2 = 0 THEN plate END AS plate_no, CASE WHEN event_id % 2 = 0 THEN 4.6::DOUBLE ELSE 4.5::DOUBLE END AS latitude, CASE WHEN event_id % 2 = 0 THEN -74.1::DOUBLE ELSE -74.2::DOUBLE END AS longitude,
    CASE WHEN event_id % 2 = 0 THEN round(CAST(event_id * 100 AS DOUBLE) / 1000, 1) END AS total_mileage_km FROM alarms WHERE event_id % 7 <> 6""",
)
def normalized_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize_alarm(alarm_messages(spark, sf_dir), d.ZONE)
    return rows.select("guid", "device_id", "occurred_at", "start_at", "end_at", "category", "mapping_source", "classification_status", "visibility_status", "subtype", "raw_tp", "raw_event_code", "plate_no", "latitude", "longitude", "total_mileage_km")


@query("rejected_messages", "SELECT CASE event_id % 5 WHEN 1 THEN 'raw_text' WHEN 2 THEN 'non_object' WHEN 3 THEN 'missing_device' ELSE 'bad_time' END AS reason, count(*) AS n FROM alarms WHERE event_id % 5 <> 0 GROUP BY ALL")
def rejected_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that can't become rows, by reason."""
    k = F.col("event_id") % 5
    good = F.to_json(F.struct(F.col("device_id").alias("deviceID"), local_text("occurred_at").alias("dtu")))
    value = F.when(k == 0, good).when(k == 1, "no json").when(k == 2, "[1]").when(k == 3, F.to_json(F.struct(local_text("occurred_at").alias("dtu")))).otherwise(F.to_json(F.struct(F.col("device_id").alias("deviceID"), F.lit("never").alias("dtu"))))
    return rejected(d.alarms(spark, sf_dir).select(value.alias("value")), d.ZONE, ["dtu"]).groupBy("reason").agg(F.count("*").alias("n"))


@query("normalized_statuses", "SELECT device_id, date_trunc('second', occurred_at) AS observed_at, round(CAST(event_id * 100 AS DOUBLE) / 1000, 1) AS total_km, CASE WHEN event_id % 4 <> 0 THEN round(event_id + 0.5, 1) END AS day_km, plate AS plate_no, fleet_id, 'n ' || user_id AS driver_name FROM alarms WHERE event_id % 7 <> 6")
def normalized_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status messages as device rows: the time in one of two places, distances in metres or kilometres, fleets at the top or nested."""
    at, n = local_text(F.date_trunc("second", "occurred_at")), F.col("event_id")
    odd = n % 2 == 1
    mileage = F.struct((n * 100).alias("total"), F.when(n % 4 != 0, F.concat(n, F.lit(".5"))).otherwise("-").alias("todayDay"))
    fields = [F.col("device_id").alias("deviceID"), F.when(odd, at).alias("dtu"), F.struct(F.when(~odd, at).alias("dtu")).alias("location"), F.when(odd, F.col("fleet_id")).alias("fleetID"), F.struct(F.when(~odd, F.col("fleet_id")).alias("fleetid")).alias("basic"), mileage.alias("mileage")]
    fields += [F.struct(F.concat(F.lit("n "), "user_id").alias("name")).alias("driver"), F.struct(F.lower("plate").alias("deviceName")).alias("ext")]
    value = F.when(n % 7 == 6, F.lit('{"deviceID":""}')).otherwise(F.to_json(F.struct(*fields)))
    return normalize_status(d.alarms(spark, sf_dir).select(value.alias("value")), d.ZONE).select("device_id", "observed_at", "total_km", "day_km", "plate_no", "fleet_id", "driver_name")


@query(
    "company_overlay",
    """, c AS (SELECT company_slug AS slug, min(device_id) AS lo, max(device_id) AS hi, count(*) AS n FROM alarms GROUP BY 1)
    SELECT slug, CASE WHEN slug = 'beta' THEN 'Second ' || n WHEN slug = 'delta' THEN 'Delta' ELSE 'Company ' || slug END AS name, CASE WHEN slug = 'beta' OR slug = 'delta' THEN '' WHEN lo = hi THEN lo ELSE lo || ',' || hi END AS devices, CASE slug WHEN 'beta' THEN 'F9' WHEN 'delta' THEN 'F1' ELSE '' END AS fleets, CASE WHEN slug = 'beta' THEN 'Bostezo' ELSE '' END AS allowed
    FROM (SELECT * FROM c UNION ALL SELECT 'delta', NULL, NULL, 0)""",
)
def company_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of a configuration file, made from the alarms, overlaid by rows of a table: two of one slug, of which the later wins, and a new one."""
    path = f"{shared_dir(spark).rstrip('/')}/config-{uuid.uuid4().hex}"
    known = d.alarms(spark, sf_dir).groupBy("company_slug").agg(F.min("device_id").alias("lo"), F.max("device_id").alias("hi"), F.count("*").alias("n"))
    hi, lo = F.col("hi"), F.col("lo")
    item = F.to_json(F.struct(F.col("company_slug").alias("slug"), F.concat(F.lit("Company "), "company_slug").alias("name"), F.lit(d.ZONE).alias("timezone"), F.array(hi, F.concat(F.lit(" "), lo, F.lit(" ")), hi, F.lit("")).alias("device_ids")))
    text = known.agg(F.concat(F.lit("[7,"), F.array_join(F.collect_list(item), ","), F.lit(',{"name":"no slug"}]')).alias("value"))  # a file of the companies
    text.coalesce(1).write.text(path)
    row = lambda slug, name, fleets, allowed, place: known.filter("company_slug = 'beta'").select(F.lit(slug).alias("slug"), name.alias("name"), F.array(F.lit(fleets)).alias("fleet_ids"), allowed.cast("array<string>").alias("allowed_categories"), F.lit(place).alias("place"))
    rows = row("beta", F.concat(F.lit("First "), "n"), "F1", F.lit(None), 1).unionByName(row("beta", F.concat(F.lit("Second "), "n"), "F9", F.array(F.lit("Bostezo")), 2)).unionByName(row("delta", F.lit("Delta"), "F1", F.lit(None), 1))
    joined = lambda c: F.array_join(c, ",")
    return company_config(spark, path, rows, "place").select("slug", "name", joined("device_ids").alias("devices"), joined("fleet_ids").alias("fleets"), joined("allowed_categories").alias("allowed"))
