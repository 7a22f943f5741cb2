"""Copies and deliveries: a table copied in ranges with a break in between, and snapshots pushed to subscribers with a batch done again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.plans.register import query
from haulmark.sources import domain as d
from haulmark.sources.copies import copy_ranges
from haulmark.sources.push import PushWriter, Staged, delivered, push, uri
from haulmark.sources.shared import shared_dir
from haulmark.sources.versions import TableStore


class Broken(Exception):
    pass


@query("copied_alarms", "SELECT guid, event_id, device_id, category, occurred_at FROM alarms")
def copied_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarms after a copy that broke off in its third range and was started again."""
    store = TableStore(spark, f"{shared_dir(spark).rstrip('/')}/copy-{uuid.uuid4().hex}")
    source = d.alarms(spark, sf_dir).select("guid", "event_id", "device_id", "category", "occurred_at")
    publish, left = store.publish, [6]

    def breaking(manifest: dict, version: int) -> int:
        left[0] -= 1
        if not left[0]:
            raise Broken
        return publish(manifest, version)

    store.publish = breaking
    try:
        copy_ranges(store, "alarms", source, "event_id")
    except Broken:
        copy_ranges(store, "alarms", source, "event_id")
    return store.read("alarms")


@query(
    "pushed_snapshots",
    """, s AS (SELECT company_slug, date_trunc('week', CAST(day AS TIMESTAMP)) AS w, count(*) AS n FROM alarms GROUP BY ALL), subs AS (SELECT DISTINCT company_slug, 'user ' || (user_id % 4) AS subscriber FROM alarms WHERE user_id % 5 = 1)
    SELECT subscriber, company_slug AS topic, strftime(w, '%Y-%m-%d') AS week, CAST(n AS VARCHAR) AS alarms FROM s JOIN subs USING (company_slug)""",
)
def pushed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week's snapshot of a company in the box of each of its subscribers, once, although one micro-batch was delivered twice."""
    base = f"{shared_dir(spark).rstrip('/')}/push-{uuid.uuid4().hex}"
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd")
    rows = d.alarms(spark, sf_dir).groupBy("company_slug", week.alias("week")).agg(F.count("*").alias("n")).select(F.col("company_slug").alias("topic"), F.to_json(F.struct("week", "n")).alias("payload"), "week")
    rows.coalesce(1).write.partitionBy("week").parquet(f"{base}/snapshots")
    stream = spark.readStream.schema("topic string, payload string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{base}/snapshots")
    subscriptions = d.alarms(spark, sf_dir).filter("user_id % 5 = 1").select(F.col("company_slug").alias("topic"), F.concat(F.lit("user "), F.col("user_id") % 4).alias("subscriber")).distinct()
    push(stream, subscriptions, f"{base}/boxes", f"{base}/checkpoint")
    again = PushWriter(uri(f"{base}/boxes"))
    first = delivered(spark, f"{base}/boxes").filter("batch = 0").collect()
    again.commit([again.write(first), Staged([])], 0)
    out = delivered(spark, f"{base}/boxes")
    return out.select("subscriber", "topic", F.get_json_object("payload", "$.week").alias("week"), F.get_json_object("payload", "$.n").alias("alarms"))
