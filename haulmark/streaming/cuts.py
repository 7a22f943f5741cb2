"""Structured Streaming: sessions, cuts and per-device odometer state."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from haulmark.functions.values import RULES


def session_stream(alarms: DataFrame, watermark: str = "40 days") -> DataFrame:
    """Alarm sessions of a vehicle and category; a session closes after the category's gap. The watermark is the retention: nothing late is lost."""
    gap = F.when(F.col("category") == "Riesgo de colision", "30 minutes").when(F.col("category") == "Bostezo", "60 minutes").otherwise("15 minutes")
    timed = alarms.withWatermark("occurred_at", watermark)
    return timed.groupBy("plate", "category", F.session_window("occurred_at", gap)).agg(F.count("*").alias("n")).select("plate", "category", F.col("session_window.start").alias("start_at"), "n")


def cut_stream(alarms: DataFrame, watermark: str = "40 days") -> DataFrame:
    """Alarms that each 15-minute cut reads, with its look-back."""
    span = RULES["cut_minutes"] + RULES["overlap_minutes"]
    timed = alarms.withWatermark("occurred_at", watermark)
    return timed.groupBy(F.window("occurred_at", f"{span} minutes", f"{RULES['cut_minutes']} minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_at"), "n")


STATUS = "device_id string, accepted long, regressions long, last_total double"


def odometer_state(keys: tuple, batches, state: GroupState):
    """Counts readings of a device that fall below the last accepted total; such readings leave it as it is.

    Micro-batches count in order of arrival, the readings of one in order of time. A group comes in chunks, in no order, so they are
    put in order together: 24 bytes a reading, for the readings that a device has in one micro-batch.
    """
    accepted, regressions, last = state.get if state.exists else (0, 0, None)
    chunks = [(rows["observed_at"].to_numpy("datetime64[us]").astype(np.int64), rows["event_id"].to_numpy(np.int64), rows["total_km"].to_numpy(np.float64)) for rows in batches]
    if chunks:
        at, number, totals = (np.concatenate(c) for c in zip(*chunks, strict=True))
        chunks.clear()
        for i in np.lexsort((number, at)):
            total = float(totals[i])
            if last is not None and total + 0.1 < last:
                regressions += 1
            else:
                accepted, last = accepted + 1, total
    state.update((accepted, regressions, last))
    yield pd.DataFrame([(keys[0], accepted, regressions, last)], columns=["device_id", "accepted", "regressions", "last_total"])


def status_stream(readings: DataFrame) -> DataFrame:
    return readings.groupBy("device_id").applyInPandasWithState(odometer_state, STATUS, "accepted long, regressions long, last_total double", "update", GroupStateTimeout.NoTimeout)


def fold_readings(before: DataFrame, readings: DataFrame) -> DataFrame:
    """odometer_state for all devices of a micro-batch at once, as columns: a device's readings of the micro-batch are one array, in order of time."""
    order = F.array_sort(F.collect_list(F.struct("observed_at", "event_id", F.col("total_km").cast("double").alias("total"))))
    come = readings.groupBy("device_id").agg(order.alias("_rows"))
    both = before.join(come, before["device_id"].eqNullSafe(come["device_id"]), "full").select(F.coalesce(before["device_id"], come["device_id"]).alias("device_id"), "accepted", "regressions", "last_total", "_rows")
    start = F.struct(F.coalesce("accepted", F.lit(0).cast("long")).alias("accepted"), F.coalesce("regressions", F.lit(0).cast("long")).alias("regressions"), F.col("last_total"))

    def step(so_far, row):
        last, total = so_far["last_total"], row["total"]
        back = F.coalesce(~F.isnan(last) & (total + 0.1 < last), F.lit(False))
        return F.struct((so_far["accepted"] + F.when(back, 0).otherwise(1)).alias("accepted"), (so_far["regressions"] + F.when(back, 1).otherwise(0)).alias("regressions"), F.when(back, last).otherwise(total).alias("last_total"))

    none = F.array().cast("array<struct<observed_at: timestamp, event_id: bigint, total: double>>")
    return both.select("device_id", F.aggregate(F.coalesce("_rows", none), start, step).alias("s")).select("device_id", "s.*")


def run_odometers(stream: DataFrame, base: str) -> None:
    """Works off what has arrived; the state of all devices after each micro-batch is a table, made from the one before. For many devices: a
    stateful pass calls Python for each. A micro-batch that is done again overwrites its own."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STATUS).parquet(f"{base}/state/batch={number - 1}") if number else spark.createDataFrame([], STATUS)
        fold_readings(before, batch).write.mode("overwrite").parquet(f"{base}/state/batch={number}")

    run_cuts(stream, take, f"{base}/checkpoint")


def odometers(spark: SparkSession, base: str) -> DataFrame:
    """Each device's counts and last total after the last micro-batch."""
    rows = spark.read.schema(f"{STATUS}, batch int").parquet(f"{base}/state")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


def run_cuts(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works off what has arrived, batch by batch in order, and ends; a batch that is done again must give the same (upserts)."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def publish_guard(published: DataFrame, batch: DataFrame) -> DataFrame:
    """An older cut never rolls a publication back: the later cut of each company stays."""
    both = published.select("company_slug", "cut_at").unionByName(batch.select("company_slug", "cut_at"))
    return both.groupBy("company_slug").agg(F.max("cut_at").alias("cut_at"))
