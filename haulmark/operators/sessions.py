"""Gap sessions: events of a key belong together while each follows the one before within the gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, keys: list[str], ts: str, gap_minutes: Column, order: str) -> DataFrame:
    """Adds session_no (from 1 within the key). A gap of exactly gap_minutes still joins; gap_minutes depends on the key."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))
    return df.withColumn("_new", F.coalesce((gap > gap_minutes.cast("long") * 60_000_000).cast("long"), F.lit(1))).withColumn("session_no", F.sum("_new").over(w)).drop("_new")
