"""The whole dashboard of each company as one row, from small state that changes keep up to date.

The state is what snapshots are made of: counts of alarms by company, vehicle, day, hour and category (counts add up, and a vehicle is there as
long as one of its counts is), sessions, and the last odometer reading of each device and day. A batch of changes touches the cells and
the sessions that its alarms are in or near, whether they come, change or are taken back by a review; nothing else is written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.expressions import is_night
from haulmark.operators.batches import kept_rows
from haulmark.operators.sessions import sessionize
from haulmark.sources.versions import TableStore

CELL = ["company_slug", "plate", "day", "hour", "category"]
KEY = ["company_slug", "plate", "category"]
TABLES = {
    "alarms": "guid string, event_id long, company_slug string, plate string, category string, occurred_at timestamp, day date, hour int",
    "cells": "company_slug string, plate string, day date, hour int, category string, n long",
    "sessions": "company_slug string, plate string, category string, start_at timestamp, end_at timestamp, day date, n long",
    "odometer": "device_id string, company_slug string, plate string, day date, observed_at timestamp, event_id long, total_km decimal(28,2), day_km decimal(28,2)",
    "published": "company_slug string, cut_at timestamp, snapshot_json string",
    "ledger": "batch string",
}


def fields(name: str) -> list[str]:
    return [f.split()[0] for f in TABLES[name].replace("(28,2)", "").split(",")]


def typed(rows: DataFrame, name: str) -> DataFrame:
    kinds = dict(f.strip().split(" ", 1) for f in TABLES[name].replace("(28,2)", "").split(","))
    return rows.select(*[F.col(c).cast("decimal(28,2)" if k == "decimal" else k).alias(c) for c, k in kinds.items()])


def cells_of(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy(*CELL).agg(F.count("*").alias("n"))


def sessions_of(alarms: DataFrame, gap_minutes: Column) -> DataFrame:
    """company, vehicle, category, start, end, local day of the start, and alarms of each session."""
    rows = sessionize(alarms, KEY, "occurred_at", gap_minutes, "event_id")
    order = F.struct("occurred_at", "event_id")
    return rows.groupBy(*KEY, "session_no").agg(F.min("occurred_at").alias("start_at"), F.max("occurred_at").alias("end_at"), F.min_by("day", order).alias("day"), F.count("*").alias("n")).drop("session_no")


def micros(at: str) -> Column:
    """A time as a number; rows without one stand together, before all others."""
    return F.coalesce(F.unix_micros(at), F.lit(-(2**62)))


def touched_sessions(sessions: DataFrame, times: DataFrame, gap_minutes: Column) -> DataFrame:
    """Stored sessions that a changed alarm lies in or within a gap of: only these can grow, shrink, join or fall apart. One pass over a key in order of time."""
    gap = gap_minutes.cast("long") * 60_000_000
    held = sessions.select(*KEY, (micros("start_at") - gap).alias("_from"), (micros("end_at") + gap).alias("_upto"), F.struct("start_at", "end_at", "_place").alias("_s"))
    changed = times.select(*KEY, micros("occurred_at").alias("_from"), micros("occurred_at").alias("_at"))
    later = Window.partitionBy(*KEY).orderBy(F.desc("_from")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = held.unionByName(changed, allowMissingColumns=True).withColumn("_next", F.min("_at").over(later))
    return both.filter(F.col("_s").isNotNull() & (F.col("_next") <= F.col("_upto"))).select(*KEY, "_s.*")


def alarms_in(alarms: DataFrame, sessions: DataFrame) -> DataFrame:
    """The alarms of some sessions: those up to the end of the session of their key that started last."""
    rows = alarms.select(*KEY, micros("occurred_at").alias("_from"), F.struct(*alarms.columns).alias("_a"))
    starts = sessions.select(*KEY, micros("start_at").alias("_from"), micros("end_at").alias("_end"))
    before = Window.partitionBy(*KEY).orderBy("_from").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(starts, allowMissingColumns=True).withColumn("_last", F.last("_end", ignorenulls=True).over(before))
    return both.filter(F.col("_a").isNotNull() & (F.col("_from") <= F.col("_last"))).select("_a.*")


def create_dashboard(store: TableStore) -> None:
    t = store.begin()
    for name, schema in TABLES.items():
        t.append(name, store.spark.createDataFrame([], schema))
    t.commit()


def apply_changes(store: TableStore, batch: str, changes: DataFrame, readings: DataFrame, gap_minutes: Column) -> bool:
    """Takes in changes of alarms (op put or drop, seq, and the alarm's fields) and odometer readings as one version; False for a batch that the ledger has.

    The last change of a guid counts. A put of a known alarm replaces it, a drop of an unknown one is nothing.
    """
    t = store.begin()
    if not t.read("ledger").filter(F.col("batch") == batch).isEmpty():
        return False
    columns = fields("alarms")
    last = changes.groupBy("guid").agg(F.max_by(F.struct("op", *[c for c in columns if c != "guid"]), "seq").alias("c")).select("guid", "c.*")
    last = kept_rows(last, "changes")
    old = kept_rows(t.read("alarms", places=True).join(last.select("guid"), "guid", "left_semi"), "replaced")
    new = typed(last.filter("op = 'put'"), "alarms")

    signed = new.select(*CELL, F.lit(1).alias("s")).unionByName(old.select(*CELL, F.lit(-1).alias("s")))
    net = kept_rows(signed.groupBy(*CELL).agg(F.sum("s").alias("s")).filter("s <> 0"), "net")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in CELL]
    held = kept_rows(t.read("cells", places=True).alias("c").join(net.alias("x"), same("c", "x")).select("c.*", "x.s"), "held")
    fresh = net.alias("x").join(held.alias("c"), same("c", "x"), "left_anti").withColumn("n", F.col("s"))
    t.delete("cells", held)
    t.append("cells", typed(held.withColumn("n", F.col("n") + F.col("s")).select(*CELL, "n").unionByName(fresh.select(*CELL, "n")).filter("n > 0"), "cells"))

    times = new.select(*KEY, "occurred_at").unionByName(old.select(*KEY, "occurred_at"))
    touched = kept_rows(touched_sessions(t.read("sessions", places=True), times, gap_minutes), "touched")
    rest = alarms_in(t.read("alarms"), touched).join(last.select("guid"), "guid", "left_anti")
    t.delete("sessions", touched)
    t.append("sessions", typed(sessions_of(rest.unionByName(new), gap_minutes), "sessions"))
    t.delete("alarms", old)
    t.append("alarms", new)

    days = ["device_id", "day"]
    newest = F.struct("observed_at", (-F.col("event_id")).alias("e"))
    told = readings.groupBy(*days).agg(F.max_by(F.struct("company_slug", "plate", "observed_at", "event_id", "total_km", "day_km"), newest).alias("r")).select(*days, "r.*")
    before = kept_rows(t.read("odometer", places=True).join(told.select(*days), days, "left_semi"), "odometer")
    both = typed(told, "odometer").unionByName(before.drop("_place"))
    merged = both.groupBy(*days).agg(F.max_by(F.struct("company_slug", "plate", "observed_at", "event_id", "total_km", "day_km"), newest).alias("r")).select(*days, "r.*")
    t.append("odometer", typed(merged, "odometer"))
    t.delete("odometer", before)
    t.append("ledger", store.spark.createDataFrame([(batch,)], TABLES["ledger"]))
    t.commit(batch=batch)
    return True


def dashboard(cells: DataFrame, sessions: DataFrame, distances: DataFrame, baselines, first: Column, last: Column) -> DataFrame:
    """The snapshot of each company: alarms, vehicles, night, distance and rate of the days from first to last; vehicles whose last day is half above
    their mean; episodes; and the series, hours and leading vehicles as JSON. distances: company, vehicle, day and km. baselines(n, km) as
    in mileage.day_baselines."""
    now = cells.filter(F.col("day").between(first, last))
    by = lambda *keys: now.groupBy("company_slug", *keys).agg(F.sum("n").alias("n"))
    entries = lambda df, name, *keys: df.groupBy("company_slug").agg(F.array_sort(F.collect_list(F.struct(*keys, "n"))).alias(name))
    out = now.groupBy("company_slug").agg(F.sum("n").alias("alarms"), F.count_distinct("plate").alias("vehicles"), F.sum(F.when(is_night(F.col("hour")), F.col("n")).otherwise(0)).alias("night"))
    km = distances.filter(F.col("day").between(first, last)).groupBy("company_slug").agg(F.sum("km").cast("double").alias("km"))
    counts = cells.groupBy("plate", "day").agg(F.sum("n").alias("n"))
    today = cells.filter(F.col("day") == last).groupBy("company_slug", "plate").agg(F.sum("n").alias("today"))
    spikes = today.join(baselines(counts, distances), "plate").groupBy("company_slug").agg(F.count_if((F.col("baseline") > 0) & (F.col("today") >= F.col("baseline") * 1.5)).alias("spikes"))
    episodes = sessions.filter(F.col("day").between(first, last)).groupBy("company_slug").agg(F.count("*").alias("episodes"), F.max("n").alias("longest"))
    place = Window.partitionBy("company_slug").orderBy(F.desc("n"), "plate")
    top = by("plate").withColumn("place", F.row_number().over(place)).filter("place <= 8")
    for part in (km, spikes, episodes, entries(by("category", "day"), "series", "category", "day"), entries(by("hour"), "hours", "hour"), entries(top, "top", "place", "plate")):
        out = out.join(part, "company_slug", "left")
    rate = F.when(F.col("km") > 0, F.round(F.col("alarms") * 100 / F.col("km"), 1))
    return out.select("company_slug", "alarms", "vehicles", "night", F.round("km", 1).alias("km"), rate.alias("rate"), F.coalesce("spikes", F.lit(0)).alias("spikes"), F.coalesce("episodes", F.lit(0)).alias("episodes"), F.coalesce("longest", F.lit(0)).alias("longest"), F.to_json(F.struct("series", "hours", "top")).alias("body"))


def publish_dashboard(store: TableStore, snapshots: DataFrame, cut: Column) -> int:
    """Each company's snapshot as JSON text with the cut that it shows; a company that shows a later cut keeps it. Returns the version."""
    t = store.begin()
    new = kept_rows(snapshots.select("company_slug", cut.alias("cut_at"), F.to_json(F.struct(*[c for c in snapshots.columns if c != "company_slug"])).alias("snapshot_json")), "snapshot")
    old = t.read("published", places=True).alias("o").join(new.alias("n"), "company_slug").select("o.*", F.col("n.cut_at").alias("_cut"))
    later = new.join(old.filter("cut_at > _cut").select("company_slug"), "company_slug", "left_anti")
    t.delete("published", old.filter("cut_at <= _cut"))
    t.append("published", typed(later, "published"))
    return t.commit()
