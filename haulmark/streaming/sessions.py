"""Sessions over a stream whose state shrinks: sessions are given out when the watermark has passed them, and late alarms are merged in afterwards.

A first stream without state splits what arrives by one rule: an alarm is late if it is older than the newest alarm of earlier micro-batches by
more than the delay. The rest feeds session windows in append mode with that delay as their watermark, which so never drops a row. Sessions that
are given out and late alarms go the same way into the table: pieces that touch become one, in any order, so the table ends as a batch over all
alarms has it.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.operators.batches import kept_rows
from haulmark.sources.versions import TableStore

KEYS = ["plate", "category"]
TABLES = {"sessions": "plate string, category string, start_at timestamp, end_at timestamp, n long", "taken": "stream string, batch long", "frontier": "batch long, newest timestamp"}


def gap() -> F.Column:
    """How long a session waits for its next alarm."""
    return F.when(F.col("category") == "Riesgo de colision", "30 minutes").when(F.col("category") == "Bostezo", "60 minutes").otherwise("15 minutes")


def gap_interval() -> F.Column:
    return F.expr("CASE category WHEN 'Riesgo de colision' THEN INTERVAL 30 MINUTES WHEN 'Bostezo' THEN INTERVAL 60 MINUTES ELSE INTERVAL 15 MINUTES END")


def create_sessions(store: TableStore) -> None:
    if not store.version():
        t = store.begin()
        for name, schema in TABLES.items():
            t.append(name, store.spark.createDataFrame([], schema))
        t.commit()


def pieces_of(alarms: DataFrame) -> DataFrame:
    """Each alarm as a session of its own: it reaches a gap further."""
    return alarms.select(*KEYS, F.col("occurred_at").alias("start_at"), (F.col("occurred_at") + gap_interval()).alias("end_at"), F.lit(1).cast("long").alias("n"))


def merge_sessions(store: TableStore, pieces: DataFrame, stream: str, batch: int) -> bool:
    """Pieces and the stored sessions that they touch become one; other sessions stay where they are. False if the batch was taken before."""
    t = store.begin()
    if not t.read("taken").filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty():
        return False
    new = kept_rows(pieces.select(*KEYS, "start_at", "end_at", "n"), "pieces")
    stored = t.read("sessions", places=True).join(new.select(*KEYS).distinct(), KEYS, "left_semi")
    both = stored.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(*KEYS).orderBy("start_at", "end_at")
    reach = F.max("end_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = both.withColumn("cut", F.coalesce((F.col("start_at") > reach).cast("int"), F.lit(1)))
    grouped = apart.withColumn("part", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = kept_rows(grouped.withColumn("changed", F.max("fresh").over(Window.partitionBy(*KEYS, "part"))).filter("changed"), "merged")
    t.delete("sessions", marked.filter("not fresh"))
    t.append("sessions", marked.groupBy(*KEYS, "part").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("n").alias("n")).drop("part"))
    t.append("taken", store.spark.createDataFrame([(stream, batch)], TABLES["taken"]))
    t.commit()
    return True


def split(store: TableStore, alarms: DataFrame, delay: timedelta, base: str) -> None:
    """Deals what arrives to on-time alarms, which land as a folder of files a micro-batch, and late ones, which are merged at once."""

    def deal(batch: DataFrame, number: int) -> None:
        t = store.begin()
        seen = t.read("frontier").filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        rows = batch.select(*KEYS, "occurred_at")
        late = F.lit(False) if seen is None else F.col("occurred_at") < F.lit(seen - delay)
        rows = kept_rows(rows.withColumn("late", late), "dealt")
        rows.filter("not late").drop("late").write.mode("overwrite").parquet(f"{base}/dealt/batch={number:08d}")
        merge_sessions(store, pieces_of(rows.filter("late")), "late", number)
        if t.read("frontier").filter(F.col("batch") == number).isEmpty():
            t = store.begin()
            newest = rows.agg(F.max("occurred_at")).first()[0]
            t.append("frontier", store.spark.createDataFrame([(number, newest)], TABLES["frontier"]))
            t.commit()

    alarms.writeStream.foreachBatch(deal).option("checkpointLocation", f"{base}/split").trigger(availableNow=True).start().awaitTermination()


def close_sessions(spark: SparkSession, store: TableStore, delay: timedelta, base: str) -> list[dict]:
    """Sessions of what is on time, given out once the watermark has passed them; the progress of each micro-batch.

    The folders that were dealt are moved in one after another, so each is one micro-batch of many files: the watermark never gets ahead of a part of one."""
    # a filter on the stream itself would reach the scan and take heartbeats away before the watermark sees them
    take = lambda batch, number: (merge_sessions(store, batch.filter("plate is not null"), "closed", number), None)[1]

    def run() -> list[dict]:
        landed = spark.readStream.schema("plate string, category string, occurred_at timestamp").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{base}/on_time")
        timed = landed.withWatermark("occurred_at", f"{int(delay.total_seconds())} seconds")
        open_sessions = timed.groupBy(*KEYS, F.session_window("occurred_at", gap()).alias("w")).agg(F.count("*").alias("n"))
        closed = open_sessions.select(*KEYS, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")
        query = closed.writeStream.outputMode("append").foreachBatch(take).option("checkpointLocation", f"{base}/close").trigger(availableNow=True).start()
        query.awaitTermination()
        return [dict(p) for p in query.recentProgress]

    shared = TableStore(spark, base)
    dealt = [s.getPath().getName() for s in shared.files.util().listStatus(shared.path("dealt"))] if shared.files.util().exists(shared.path("dealt")) else []
    shared.files.mkdir(shared.path("on_time"), None, True)
    out = [] if dealt else run()
    for name in sorted(dealt):
        shared.files.rename(shared.path(f"dealt/{name}"), shared.path(f"on_time/{name}"), spark.sparkContext._gateway.new_array(getattr(shared.hadoop, "Options$Rename"), 0))
        out += run()
    return out


def run_sessions(store: TableStore, alarms: DataFrame, delay: timedelta, base: str) -> list[dict]:
    """Works off what has arrived, both streams after each other, and ends. Sessions that may still grow stay in the state."""
    create_sessions(store)
    split(store, alarms, delay, base)
    return close_sessions(store.spark, store, delay, base)


def heartbeat(spark: SparkSession, base: str, at) -> None:
    """An on-time row of no vehicle, which moves the watermark so that all sessions close."""
    spark.createDataFrame([(None, None, at)], "plate string, category string, occurred_at timestamp").coalesce(1).write.parquet(f"{base}/on_time/batch=beat-{uuid.uuid4().hex}")
