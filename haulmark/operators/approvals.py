"""Approving reviews: the portal's rows are written to the raw layer and the events, and the reviews are marked, as one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.operators.batches import kept_rows
from haulmark.sources.versions import TableStore

TABLES = {
    "raw": "guid string, company_slug string, device_id string, source string, ingest_result string",
    "events": "guid string, company_slug string, device_id string, source string",
    "reviews": "review_key string, guid string, company_slug string, device_id string, dms boolean, review_status string, decided_by string, applied_at timestamp",
}


def create_reviews(store: TableStore, raw: DataFrame, events: DataFrame, reviews: DataFrame) -> int:
    t = store.begin()
    for name, rows in (("raw", raw), ("events", events), ("reviews", reviews)):
        t.append(name, store.spark.createDataFrame([], TABLES[name]))
        t.append(name, rows.select(*store.spark.createDataFrame([], TABLES[name]).columns))
    return t.commit()


def approve(store: TableStore, chosen: Column, decided_by: str, now: Column) -> int:
    """Approves the pending reviews that chosen holds for; how many. Each writes its raw row, and its event if it is a drivers' alarm, whatever time it
    has: stored ones of the guid are replaced, others inserted. Approved or discarded ones aren't touched, so a second call does nothing."""
    t = store.begin()
    pending = kept_rows(t.read("reviews", places=True).filter(F.col("review_status") == "pending").filter(chosen), "approved")
    n = t.delete("reviews", pending)
    if not n:
        return 0
    t.append("reviews", pending.drop("_place").withColumns({"review_status": F.lit("approved"), "decided_by": F.lit(decided_by), "applied_at": now}))
    rows = pending.groupBy("guid").agg(F.min_by(F.struct("company_slug", "device_id"), "review_key").alias("r"), F.max("dms").alias("dms")).select("guid", "r.*", "dms")
    rows = kept_rows(rows, "rows")
    held = kept_rows(t.read("events", places=True).join(rows.select("guid"), "guid", "left_semi"), "held")
    events = held.join(rows.filter("dms").select("guid"), "guid", "left_semi")
    raw = t.read("raw", places=True).join(rows.select("guid"), "guid", "left_semi")
    result = F.when(~F.col("dms"), "kept_raw_only").when(F.col("_old").isNotNull(), "updated_alarm_event").otherwise("inserted_alarm_event")
    told = rows.join(held.select("guid", F.lit(1).alias("_old")).distinct(), "guid", "left").withColumns({"source": F.lit("portal"), "ingest_result": result})
    told = kept_rows(told, "portal")
    t.delete("raw", raw)
    t.append("raw", told.select("guid", "company_slug", "device_id", "source", "ingest_result"))
    t.delete("events", events)
    t.append("events", told.filter("dms").select("guid", "company_slug", "device_id", "source"))
    t.commit(approved=n)
    return n
