"""Domain tables out of the driver's events table, and the same tables as SQL for the oracle.

Alarms: an event is an alarm of its user's vehicle. Odometer: the running total of event values of a vehicle. Companies: three tenants, by
device list, by fleet list, and one that lists nothing. Analytics take an explicit as_of; none reads the clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.functions.values import CATEGORIES

ZONE = "America/Bogota"
AS_OF = datetime(2024, 1, 31)
SEVEN, THIRTY = 7, 30
LAST_DAY = "DATE '2024-01-30'"

DOMAIN_SQL = """
alarms AS (
  SELECT 'g' || event_id AS guid, event_id, user_id, 'D' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS device_id,
         chr(CAST(65 + (user_id // 676) % 26 AS INTEGER)) || chr(CAST(65 + (user_id // 26) % 26 AS INTEGER)) || chr(CAST(65 + user_id % 26 AS INTEGER)) || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') AS plate,
         CASE user_id % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'beta' ELSE 'gamma' END AS company_slug,
         'F' || (user_id % 5) AS fleet_id,
         CASE event_type WHEN 'error' THEN 'Ojos cerrados' WHEN 'click' THEN 'Bostezo' WHEN 'purchase' THEN 'Uso de celular' WHEN 'signup' THEN 'Riesgo de colision' ELSE 'Distraccion' END AS category,
         CAST(json_extract_string(props, '$.k') AS VARCHAR) AS tp,
         CAST(ts AS TIMESTAMP) AS occurred_at,
         CAST(ts AS TIMESTAMP) + CASE WHEN event_id % 97 = 0 THEN INTERVAL (-10) MINUTE ELSE to_minutes(event_id % 7) END AS received_at,
         CAST(ts AS TIMESTAMP) - INTERVAL 5 HOUR AS local_at, CAST(CAST(ts AS TIMESTAMP) - INTERVAL 5 HOUR AS DATE) AS day,
         CAST(hour(CAST(ts AS TIMESTAMP) - INTERVAL 5 HOUR) AS INTEGER) AS hour,
         CASE WHEN event_id % 41 = 0 THEN 'discarded' WHEN event_id % 43 = 0 THEN 'approved' END AS review, CAST(value AS DECIMAL(18,2)) AS value
  FROM events),
kept AS (SELECT * FROM alarms WHERE review IS DISTINCT FROM 'discarded'),
month AS (SELECT * FROM kept WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'),
categories(category, weight, severity, position) AS (VALUES ('Uso de celular', 10, 'critico', 0), ('Fatiga en progresion', 8, 'critico', 1), ('Ojos cerrados', 6, 'critico', 2), ('Riesgo de colision', 5, 'alto', 3), ('Bostezo', 3, 'alto', 4), ('Camara cubierta', 3, 'medio', 5), ('Fumando', 2, 'medio', 6), ('Distraccion', 1, 'medio', 7)),
days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day),
readings AS (SELECT device_id, plate, fleet_id, company_slug, event_id, occurred_at AS observed_at, day, sum(value) OVER (PARTITION BY device_id ORDER BY occurred_at, event_id) AS total_km, CASE WHEN event_id % 5 = 0 THEN value * 40 END AS day_km FROM alarms),
daily AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY device_id, day ORDER BY observed_at DESC, event_id) AS n FROM readings) WHERE n = 1)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(events(spark, sf_dir))


def from_events(e: DataFrame) -> DataFrame:
    """guid, device, plate, tenant, fleet, category, subtype code, times (UTC and local) and review status of each alarm."""
    u = F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    letter = lambda n: F.chr((65 + F.floor(u / n) % 26).cast("long"))
    kind = F.when(F.col("event_type") == "error", "Ojos cerrados").when(F.col("event_type") == "click", "Bostezo").when(F.col("event_type") == "purchase", "Uso de celular").when(F.col("event_type") == "signup", "Riesgo de colision").otherwise("Distraccion")
    late = F.when(F.col("event_id") % 97 == 0, F.expr("INTERVAL -10 MINUTES")).otherwise(F.expr("make_dt_interval(0, 0, cast(event_id % 7 as int), 0)"))
    local = F.from_utc_timestamp(ts, ZONE)
    return e.select(
        F.concat(F.lit("g"), F.col("event_id")).alias("guid"), "event_id", "user_id", F.concat(F.lit("D"), F.lpad(u.cast("string"), 5, "0")).alias("device_id"),
        F.concat(letter(676), letter(26), letter(1), F.lpad((u % 1000).cast("string"), 3, "0")).alias("plate"),
        F.when(u % 3 == 0, "acme").when(u % 3 == 1, "beta").otherwise("gamma").alias("company_slug"), F.concat(F.lit("F"), u % 5).alias("fleet_id"), kind.alias("category"),
        F.get_json_object("props", "$.k").alias("tp"), ts.alias("occurred_at"), (ts + late).alias("received_at"), local.alias("local_at"), F.to_date(local).alias("day"), F.hour(local).alias("hour"),
        F.when(F.col("event_id") % 41 == 0, "discarded").when(F.col("event_id") % 43 == 0, "approved").alias("review"), F.col("value").cast("decimal(18,2)").alias("value"),
    )


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms that no review has discarded."""
    return alarms(spark, sf_dir).filter(F.coalesce(F.col("review") != "discarded", F.lit(True)))


def in_days(df: DataFrame, n: int, day: str = "day") -> DataFrame:
    """Rows of the last n local days before as_of."""
    return df.filter(F.col(day).between(F.expr(f"date_sub({LAST_DAY}, {n - 1})"), F.expr(LAST_DAY)))


def month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_days(kept(spark, sf_dir), THIRTY)


def categories(spark: SparkSession) -> DataFrame:
    """Eight rows."""
    return spark.createDataFrame([(c, w, s, i) for i, (c, w, s) in enumerate(CATEGORIES)], "category string, weight int, severity string, position int")


def days(spark: SparkSession, n: int = THIRTY) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.expr(f"date_sub({LAST_DAY}, {n - 1})"), F.expr(LAST_DAY))).alias("day"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odometer readings: a running total for each device."""
    w = Window.partitionBy("device_id").orderBy("occurred_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return alarms(spark, sf_dir).select("device_id", "plate", "fleet_id", "company_slug", "event_id", F.col("occurred_at").alias("observed_at"), "day", F.sum("value").over(w).alias("total_km"), F.when(F.col("event_id") % 5 == 0, F.col("value") * 40).alias("day_km"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest reading of each device and local day."""
    return latest(readings(spark, sf_dir), ["device_id", "day"], F.col("observed_at").desc(), F.col("event_id"))


def companies(spark: SparkSession) -> DataFrame:
    """Tenants: one by devices, one by fleets, one by both, and one without lists, which takes everything."""
    rows = [("north", [f"D{i:05d}" for i in range(0, 40)], [], 0), ("south", [], ["F1", "F3"], 1), ("mixed", ["D00003", "D00005"], ["F2"], 2), ("all", [], [], 3)]
    return spark.createDataFrame(rows, "slug string, device_ids array<string>, fleet_ids array<string>, position int")
