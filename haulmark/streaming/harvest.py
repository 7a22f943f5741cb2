"""Harvest: each cut's replies are judged by device, normalised, applied with the run's records as one version, and published if all devices succeeded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators.batches import ARRIVING, apply_batch, create_tables, kept_rows
from haulmark.operators.tenants import first_match
from haulmark.sources.landing import landed_replies
from haulmark.sources.messages import envelope_rows, normalize_alarm
from haulmark.sources.versions import TableStore, Transaction

CONTROL = {
    "harvest_runs": "company_slug string, cut_at timestamp, status string, devices_total long, devices_done long, rows_total long, dms_total long, error_message string",
    "harvest_devices": "company_slug string, cut_at timestamp, device_id string, status string, provider_rows long, provider_dms_rows long, inserted_raw long, inserted_dms long, future_rejected long, error_message string",
    "publications": "company_slug string, published_cut_at timestamp, status string, events long, vehicles long, last_event_at timestamp",
}


def create_harvest(store: TableStore, devices: DataFrame) -> None:
    create_tables(store, devices)
    t = store.begin()
    for name, schema in CONTROL.items():
        t.append(name, store.spark.createDataFrame([], schema))
    t.commit()


def outcomes(replies: DataFrame, members: DataFrame) -> DataFrame:
    """company_slug, device_id, status and error_message of every device of a company.

    A reply other than status 0 fails its device, and so does none at all. After a company's first device, by id, that the provider puts off (429),
    the others stay queued.
    """
    code = F.coalesce(F.get_json_object("body", "$.status"), F.lit("no envelope"))
    bad = F.max(F.when(code == "429", F.struct(F.lit(2).alias("k"), code.alias("code"))).when(code != "0", F.struct(F.lit(1).alias("k"), code.alias("code"))))
    told = replies.groupBy("device_id").agg(bad.alias("bad"), F.lit(True).alias("told"))
    judged = members.join(told, "device_id", "left")
    status = F.when(F.col("bad.k") == 2, "rate_limited").when(F.col("bad").isNotNull() | F.col("told").isNull(), "failed").otherwise("succeeded")
    judged = judged.withColumns({"status": status, "error_message": F.when(F.col("told").isNull(), "no reply").when(F.col("bad").isNotNull(), F.concat(F.lit("status "), F.col("bad.code")))})
    first = judged.groupBy("company_slug").agg(F.min(F.when(F.col("status") == "rate_limited", F.col("device_id"))).alias("stop"))
    held = F.coalesce(F.col("device_id") > F.col("stop"), F.lit(False))
    out = judged.join(first, "company_slug")
    return out.select("company_slug", "device_id", F.when(held, "queued").otherwise(F.col("status")).alias("status"), F.when(~held, F.col("error_message")).alias("error_message"))


#: How cuts are named: as text in order of time, fit for folders.
CUT_FORMAT = "yyyy-MM-dd'T'HHmm"


def cut_time(cut: str) -> F.Column:
    return F.to_timestamp(F.lit(cut), CUT_FORMAT)


def normalised(replies: DataFrame, zone: str, received: str) -> DataFrame:
    """The alarms in replies as a batch brings them, in order of device, time and guid; ranges of that order are the tasks, so a device may fill many.

    Replies are dealt evenly before they are parsed, as a small file of them holds many alarms, and each is parsed once: the ranges are found on what is written."""
    dealt = replies.select(F.col("body").alias("value")).repartition(int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    needed = {c for c, _ in (f.split() for f in ARRIVING.split(","))} - {"seq", "received_at", "payload_json", "report_text", "end_text", "start_text"}
    rows = kept_rows(normalize_alarm(envelope_rows(dealt), zone).select(*sorted(needed), "raw_payload"), "parsed")
    text = lambda *keys: F.coalesce(*[F.get_json_object("raw_payload", f"$.{k}") for k in keys])
    rows = rows.withColumns({"received_at": cut_time(received), "payload_json": F.col("raw_payload"), "report_text": text("reportTime"), "end_text": text("endTime", "payload.et"), "start_text": text("startTime", "payload.st")})
    order = ["device_id", "occurred_at", "guid"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    return kept_rows(ordered.select(*[F.col(c).cast(kind).alias(c) for c, kind in (f.split() for f in ARRIVING.split(","))]), "harvested")


def harvest_cut(store: TableStore, cut: str, replies: DataFrame, companies: DataFrame, zone: str) -> None:
    """Takes a cut in and publishes it for the companies whose devices all succeeded; done again, it changes nothing."""
    spark = store.spark
    devices = store.read("devices").select("device_id", "fleet_id")
    members = first_match(devices, companies, "device_id").withColumnRenamed("slug", "company_slug")
    judged = kept_rows(outcomes(replies, members), "outcomes")
    # those to leave out are few, and written, so Spark broadcasts them: replies aren't shuffled for it
    bad = kept_rows(replies.select("device_id").distinct().join(judged.filter("status = 'succeeded'").select("device_id"), "device_id", "left_anti"), "bad")
    good = replies.filter("device_id is not null").join(bad, "device_id", "left_anti")
    rows = normalised(good, zone, cut)
    # what each device sent, repeated rows included
    sent = rows.groupBy("device_id").agg(F.count("*").alias("provider_rows"), F.count_if(F.col("classification_status") == "classified_dms").alias("provider_dms_rows"))

    def records(t: Transaction, found: DataFrame) -> None:
        done = found.groupBy("device_id").agg(F.count_if(F.col("_raw").isNull()).alias("inserted_raw"), F.count_if(F.col("event") & F.col("_event").isNull()).alias("inserted_dms"), F.count_if(F.col("temporal_status") != "accepted").alias("future_rejected"))
        numbers = ["provider_rows", "provider_dms_rows", "inserted_raw", "inserted_dms", "future_rejected"]
        each = judged.join(sent, "device_id", "left").join(done, "device_id", "left").fillna(0, numbers).withColumn("cut_at", cut_time(cut))
        staged = t.append("harvest_devices", each.select(*[f.split()[0] for f in CONTROL["harvest_devices"].split(",")]))
        n = lambda s: F.count_if(F.col("status") == s)
        status = F.when(n("rate_limited") > 0, "rate_limited").when(n("failed") > 0, "partial").otherwise("succeeded")
        runs = staged.filter(F.col("cut_at") == cut_time(cut)).groupBy("company_slug", "cut_at").agg(
            status.alias("status"), F.count("*").alias("devices_total"), F.count_if(F.col("status") != "queued").alias("devices_done"), F.sum("provider_rows").alias("rows_total"), F.sum("provider_dms_rows").alias("dms_total"), F.max_by("error_message", "device_id").alias("error_message"),
        )
        t.append("harvest_runs", runs)

    apply_batch(store, f"harvest {cut}", rows, companies, "harvest", records)
    publish(store, cut)


def publish(store: TableStore, cut: str) -> None:
    """What each company shows after a cut: the events up to it if the cut succeeded, else what it showed before, with the run's status. An older
    cut never replaces a later one."""
    t = store.begin()
    at = cut_time(cut)
    runs = t.read("harvest_runs").filter(F.col("cut_at") == at).select("company_slug", "status")
    now = t.read("publications")
    events = t.read("alarm_events").filter(F.col("occurred_at") < at).groupBy("company_slug").agg(F.count("*").alias("events"), F.count_distinct("device_id").alias("vehicles"), F.max("occurred_at").alias("last_event_at"))
    fresh = runs.join(events, "company_slug", "left").select("company_slug", at.alias("published_cut_at"), "status", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("vehicles", F.lit(0)).alias("vehicles"), "last_event_at")
    both = now.alias("o").join(fresh.alias("n"), "company_slug", "full")
    newer = F.coalesce(F.col("n.published_cut_at") >= F.col("o.published_cut_at"), F.col("o.published_cut_at").isNull())
    shows = (F.col("n.status") == "succeeded") & newer
    pick = lambda c: F.when(shows, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    status = F.when(F.col("n.status").isNotNull() & newer, F.col("n.status")).otherwise(F.col("o.status"))
    out = both.select("company_slug", pick("published_cut_at").alias("published_cut_at"), status.alias("status"), *[pick(c).alias(c) for c in ("events", "vehicles", "last_event_at")])
    t.replace("publications", kept_rows(out, "publications"))
    t.commit(published=cut)


def harvest(spark: SparkSession, path: str, store: TableStore, companies: DataFrame, zone: str, checkpoint: str) -> None:
    """Takes in the cuts that have landed since the checkpoint, one after the other, and ends."""

    def take(batch: DataFrame, number: int) -> None:
        replies = kept_rows(batch, f"replies-{number}-{uuid.uuid4().hex}")
        for cut in sorted(r.cut for r in replies.select("cut").distinct().collect()):
            harvest_cut(store, cut, replies.filter(F.col("cut") == cut).select("device_id", "body"), companies, zone)

    stream = landed_replies(spark, path).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
