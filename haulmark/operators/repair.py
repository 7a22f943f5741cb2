"""Repair of daily odometer snapshots: a device's history is a chain of last known totals, worked out in blocks of days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, key: str, day: str, order: list[str], value: str, name: str, block_days: int = 30) -> DataFrame:
    """Adds name: the last value that isn't null of the rows before, by key and order; order begins with day.

    A prefix scan in blocks: each block of a key's days is ordered by itself and gives its last value; these, a row a block, are carried from
    block to block and then joined back. So a key with much of the data is as many tasks as it has blocks.
    """
    block = rows.withColumn("_b", F.floor(F.unix_date(day) / block_days))
    inside = Window.partitionBy(key, "_b").orderBy(*order)
    block = block.withColumn("_in", F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    last = block.groupBy(key, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    over = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = last.select(key, "_b", F.last("_last", ignorenulls=True).over(over).alias("_head"))
    return block.join(heads, [key, "_b"]).withColumn(name, F.coalesce("_in", "_head")).drop("_b", "_in", "_head")


def valid_day(day_km: Column, total_km: Column) -> Column:
    """Known, from 0 to 1000, and not above the total by more than 0.1, where there is one."""
    return F.coalesce((day_km >= 0) & (day_km <= 1000) & (total_km.isNull() | (day_km <= total_km + F.expr("0.1BD"))), F.lit(False))


def derived_days(alarms: DataFrame, block_days: int = 30) -> DataFrame:
    """device_id, day, derived_day_km and day_max: what a day's alarms tell of its distance: the range of their totals, or, where that is
    nothing, the rise since the device's day before."""
    span = alarms.filter("total_km is not null").groupBy("device_id", "day").agg(F.min("total_km").alias("lo"), F.max("total_km").alias("day_max"))
    before = carried(span, "device_id", "day", ["day"], "day_max", "_prev", block_days)
    rise = F.col("day_max") - F.col("lo")
    km = F.when((rise <= 0) & (F.col("day_max") >= F.col("_prev")), F.col("day_max") - F.col("_prev")).otherwise(rise)
    return before.select("device_id", "day", F.round(km, 1).alias("derived_day_km"), "day_max")


def repaired(snapshots: DataFrame, alarms: DataFrame, devices: DataFrame, end: date, block_days: int = 30) -> DataFrame:
    """Every snapshot (device_id, day, observed_at, total_km, day_km) with its repaired distances, status and reason, and whether it was changed.

    The last day takes its total from the device's alarms. A day's distance is what its alarms tell, else what was reported; if that isn't
    valid, the rise since the last known total, which missing totals don't break. On the last day a device whose own distances are valid has
    the last word.
    """
    told = derived_days(alarms, block_days)
    latest = told.groupBy("device_id").agg(F.max_by("day_max", "day").alias("_latest"))
    rows = snapshots.join(told.drop("day_max"), ["device_id", "day"], "left").join(latest, "device_id", "left")
    rows = rows.join(devices.select("device_id", F.col("last_total_km").alias("_last_total"), F.col("last_day_km").alias("_last_day")), "device_id", "left")
    at_end = F.col("day") == F.lit(end)
    rows = rows.withColumn("_norm", F.when(at_end, F.coalesce("_latest", "total_km")).otherwise(F.col("total_km")))
    own = at_end & valid_day(F.col("_last_day"), F.col("_last_total"))
    rows = rows.withColumns({"_own": own, "_final": F.when(own, F.coalesce("_last_total", "_norm")).otherwise(F.col("_norm"))})
    rows = carried(rows, "device_id", "day", ["day", "observed_at"], "_final", "_prev", block_days)
    candidate, rise = F.coalesce("derived_day_km", "day_km"), F.col("_norm") - F.col("_prev")
    clean = F.when(valid_day(candidate, F.col("_norm")), F.round(candidate, 1)).when((rise >= 0) & valid_day(rise, F.col("_norm")), F.round(rise, 1))
    day_km = F.when(F.col("_own"), F.round("_last_day", 1)).otherwise(clean)
    rows = rows.withColumns({"_day": day_km, "_moved": F.coalesce(F.col("_final") != F.col("total_km"), F.col("_final").isNotNull())})
    return rows.select(
        "device_id", "day", "observed_at", F.coalesce("_final", "total_km").alias("total_km"), F.col("_day").alias("day_km"), F.when(F.col("_day").isNotNull(), "valid").otherwise("invalid").alias("km_validation_status"),
        F.when(F.col("_day").isNull(), "day_gt_total").alias("km_validation_reason"), F.when(F.col("_moved") | ~F.col("_day").eqNullSafe(F.col("day_km")), "normalized_from_raw_payload").alias("repair_reason"),
    )
