"""Streaming queries, run to the end of what is there and read back as tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from haulmark.plans.episodes import SESSION_SQL
from haulmark.plans.register import query
from haulmark.sources import domain as d
from haulmark.sources.shared import shared_dir
from haulmark.sources.versions import TableStore
from haulmark.streaming import cuts
from haulmark.streaming.sessions import close_sessions, heartbeat, run_sessions


def stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with the columns of alarms."""
    schema = d.events(spark, sf_dir).schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return d.from_events(found)


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def finished(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there; its result as a table: the last batch in complete mode; of all batches, the last row of each key in
    update mode; all rows in append mode. A batch that is done again overwrites itself."""
    base = folder(spark)
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batches/batch={number}")
        done.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{base}/batches")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row
    if mode == "update":
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys and c != "batch"]), "batch").alias("_r")).select(*keys, "_r.*")
    return rows.drop("batch")


@query("stream_session", f", {SESSION_SQL.strip()} SELECT plate, category, start_at, n FROM sessions")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stream_of(spark, sf_dir).filter(F.coalesce(F.col("review") != "discarded", F.lit(True)))
    # a session window ends a gap after its last event, exclusive; sessions that touch are one in both forms
    return finished(spark, cuts.session_stream(kept), "complete")


@query("stream_cuts", "SELECT time_bucket(INTERVAL 15 MINUTE, occurred_at) + to_minutes(15 * k.k) - INTERVAL 30 MINUTE AS start_at, count(*) AS n FROM alarms, (SELECT unnest(range(3)) AS k) k GROUP BY 1")
def stream_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, cuts.cut_stream(stream_of(spark, sf_dir)), "update", ["start_at"])


@query("stream_status_state", "SELECT device_id, count(*) AS accepted, CAST(0 AS BIGINT) AS regressions, round(CAST(sum(value) AS DOUBLE), 2) AS last_total FROM alarms GROUP BY device_id")
def stream_status_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odometer state of each device over a stream of readings, as a rising total never regresses."""
    base = folder(spark)
    d.readings(spark, sf_dir).write.parquet(f"{base}/readings")
    schema = spark.read.parquet(f"{base}/readings").schema
    readings = spark.readStream.schema(schema).parquet(f"{base}/readings")
    cuts.run_odometers(readings.select("device_id", "observed_at", "event_id", "total_km"), base)
    return cuts.odometers(spark, base).withColumn("last_total", F.round("last_total", 2))


@query(
    "stream_status_regressions",
    """, rr AS (SELECT device_id, CAST(CASE WHEN event_id % 13 = 0 THEN greatest(total_km - 300, 0) ELSE total_km END AS DOUBLE) AS total, row_number() OVER (PARTITION BY device_id ORDER BY observed_at, event_id) AS n FROM readings)
    SELECT device_id, count_if(NOT bad)::BIGINT AS accepted, count_if(bad)::BIGINT AS regressions FROM (WITH RECURSIVE w AS (SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS last, false AS bad FROM rr
    UNION ALL SELECT r.device_id, r.n, CASE WHEN r.total + 0.1 < w.last THEN w.last ELSE r.total END, coalesce(r.total + 0.1 < w.last, false) FROM w JOIN rr r ON r.device_id = w.device_id AND r.n = w.n + 1) SELECT * FROM w WHERE n > 0) GROUP BY device_id""",
)
def stream_status_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that fall back, counted over several micro-batches: files of a few days arrive after each other, in order of time."""
    base = folder(spark)
    r = d.readings(spark, sf_dir).select("device_id", "observed_at", "event_id", F.when(F.col("event_id") % 13 == 0, F.greatest(F.col("total_km") - 300, F.lit(0))).otherwise(F.col("total_km")).cast("double").alias("total_km"))
    part = F.when(F.col("observed_at") < F.expr("TIMESTAMP '2024-01-08 00:00:00'"), 0).when(F.col("observed_at") < F.expr("TIMESTAMP '2024-01-20 00:00:00'"), 1).otherwise(2)
    r.withColumn("part", part).write.partitionBy("part").parquet(f"{base}/made")
    schema = "device_id string, observed_at timestamp, event_id long, total_km double"
    made = spark.read.schema(f"{schema}, part int").parquet(f"{base}/made")
    for k in range(3):
        made.filter(F.col("part") == k).drop("part").write.parquet(f"{base}/readings/part={k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{base}/readings")
        cuts.run_odometers(stream, base)
    return cuts.odometers(spark, base).drop("last_total")


@query("stream_sessions_closed", f", {SESSION_SQL.strip()} SELECT plate, category, start_at, n FROM sessions")
def stream_sessions_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions given out as they close, from parts of many files in which alarms of the first weeks come late; late alarms are merged into what was closed."""
    base = folder(spark)
    rows = d.kept(spark, sf_dir).select("event_id", "plate", "category", "occurred_at")
    late = F.col("event_id") % 9 == 4
    cut = lambda day: F.col("occurred_at") < F.expr(f"TIMESTAMP '2024-01-{day} 00:00:00'")
    parts = (rows.filter(cut(11) & ~late), rows.filter(~cut(11) & cut(21) & ~late), rows.filter(cut(16) & late), rows.filter(~cut(21) & ~late), rows.filter(~cut(16) & late))
    store, delay = TableStore(spark, f"{base}/store"), timedelta(hours=6)
    for k, part in enumerate(parts):
        part.drop("event_id").write.parquet(f"{base}/alarms/part={k}")
        stream = spark.readStream.schema("plate string, category string, occurred_at timestamp").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{base}/alarms")
        run_sessions(store, stream, delay, base)
    heartbeat(spark, base, datetime(2100, 1, 1))
    close_sessions(spark, store, delay, base)
    return store.read("sessions").select("plate", "category", "start_at", "n")
