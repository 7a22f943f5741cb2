"""A deterministic fleet: vehicles, odometer readings and alarms by hashing, at any scale, without a driver-side loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.functions.values import CATEGORIES


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / 1_000_003.0


def fleet_days(spark: SparkSession, vehicles: int = 38, days: int = 36, start: str = "2024-01-01", seed: int = 42) -> DataFrame:
    """A row for each vehicle and day on the road (14 % are not), with 22 to 128 km and the running total."""
    grid = spark.range(vehicles).select(F.col("id").alias("vehicle"), F.explode(F.sequence(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(start)), days - 1))).alias("day"))
    on_road = grid.filter(unit("vehicle", "day", F.lit(seed)) >= 0.14)
    km = F.round(22 + 106 * unit("vehicle", "day", F.lit(seed + 1)), 1).cast("decimal(12,1)")
    w = Window.partitionBy("vehicle").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return on_road.withColumn("day_km", km).withColumn("total_km", F.sum("day_km").over(w)).withColumn("device_id", F.concat(F.lit("SYN-"), F.lpad(F.col("vehicle").cast("string"), 5, "0")))


def fleet_alarms(days: DataFrame, seed: int = 42) -> DataFrame:
    """Up to five alarms for each vehicle and day."""
    n = F.floor(6 * unit("vehicle", "day", F.lit(seed + 2))).cast("int")
    rows = days.withColumn("k", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    names = F.array(*[F.lit(c) for c, _, _ in CATEGORIES])
    second = F.floor(86_400 * unit("vehicle", "day", "k", F.lit(seed + 3))).cast("long")
    category = F.element_at(names, (F.floor(len(CATEGORIES) * unit("vehicle", "day", "k", F.lit(seed + 4))) + 1).cast("int"))
    return rows.select("device_id", "day", category.alias("category"), F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + second).alias("occurred_at"))
