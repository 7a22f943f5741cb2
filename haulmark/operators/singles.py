"""Alarms taken in one by one: each sees what those before it have left, so what an alarm is found under depends on their order.

Rows that share a key with each other or with a stored row, directly or through others, are a component; only within one can order matter.
Components are found by joins, each is folded by itself, one after the other as a task's rows stream by; rows that are alone in theirs need no fold, and rows
that repeat the one before are left out of it, as they end where that one did.
The tables are then aggregates over the rows by the guid that each ended under: the last value, the last that is known, or the latest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.operators.batches import FUZZY, LAYER, audited, fuzzy_key, kept_rows, keys_of, resolved
from haulmark.operators.upserts import digest
from haulmark.sources.versions import TableStore, Transaction

SNAPSHOT = "device_id string, snapshot_date date, observed_at timestamp, total_km double, plate_no string, company_slug string, fleet_id string, source string"
ENDED = "seq long, raw_guid string, raw_inserted boolean, event_guid string, event_inserted boolean"


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) of links (node, key): nodes that share a key belong together."""
    every = kept_rows(links.distinct(), "links")
    return every.select("node").distinct().join(labels_of(every), "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def labels_of(links: DataFrame) -> DataFrame:
    """label (the least node of its component) of each node that shares a key with another. Labels fall by two joins a round, and a label's
    own label is taken at once, so long chains take few rounds. Keys of one node link nothing: neighbours in one sort tell, and they stay out of the rounds."""
    by = Window.partitionBy("key").orderBy("node")
    beside = links.withColumns({"_before": F.lag(F.lit(True)).over(by), "_after": F.lead(F.lit(True)).over(by)})
    links = kept_rows(beside.filter("_before is not null or _after is not null").select("node", "key"), "shared")
    labels = kept_rows(links.select("node").distinct().withColumn("label", F.col("node")), "labels")
    while not links.isEmpty():
        by_key = links.join(labels, "node").groupBy("key").agg(F.min("label").alias("label"))
        least = links.join(by_key, "key").groupBy("node").agg(F.min("label").alias("label"))
        jump = least.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        now = least.join(jump, F.col("label") == F.col("_n"), "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label"))
        now = kept_rows(now, "labels")
        settled = now.join(labels.withColumnRenamed("label", "_old"), "node").filter("label <> _old").isEmpty()
        labels = now
        if settled:
            break
    return labels


def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by component, in batches that may end within one: each component's rows are folded as they come, its keys alone are held."""
    of, take = None, None
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if take is None or r.component != of:
                of, take = r.component, fold()
            if (told := take(r)) is not None:
                out.append(told)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ENDED.split(",")])


def fold() -> Callable[[tuple], tuple | None]:
    """Takes the rows of a component in order, stored ones first: under which guid each is found, and whether it was new. A row that is found takes its
    raw row's keys over, so a later one meets the keys that it has then."""
    tables = [({}, {}, {}), ({}, {}, {})]  # raw layer and events: guid by provider key, by guid, by device with texts and time
    keys = [{}, {}]  # of a guid, in each

    def put(k: int, guid: str, p: str | None, f: str) -> None:
        for place, key in zip(tables[k], keys[k].get(guid, ()), strict=False):
            if key is not None and place.get(key) == guid:
                del place[key]
        keys[k][guid] = (p, guid, f)
        for place, key in zip(tables[k], (p, guid, f), strict=True):
            if key is not None:
                place[key] = guid

    def get(k: int, p: str | None, g: str, f: str) -> str | None:
        by_p, by_g, by_f = tables[k]
        return by_p.get(p) or by_g.get(g) or by_f.get(f)

    def take(r: tuple) -> tuple | None:
        if r.stored:
            put(r.layer, r.guid, r.provider_event_key, r.fuzzy)
            return None
        raw = get(0, r.provider_event_key, r.guid, r.fuzzy)
        put(0, raw or r.guid, r.provider_event_key, r.fuzzy)
        event = get(1, r.provider_event_key, r.guid, r.fuzzy) if r.event else None
        if r.event:
            put(1, event or r.guid, r.provider_event_key, r.fuzzy)
        return r.seq, raw or r.guid, raw is None, (event or r.guid) if r.event else None, bool(r.event and event is None)

    return take


def third_key() -> Column:
    """Device, texts and time as a digest: it is only compared."""
    return F.md5(fuzzy_key(*FUZZY))


def ended(rows: DataFrame, raw: DataFrame, events: DataFrame) -> DataFrame:
    """For each row (seq, keys, event) that shares a key with another or a stored one, the guid that it ends under in the raw layer and among events, and
    whether it was new there. Other rows end under their own, as new ones, and aren't sorted or moved."""
    stored = lambda df, layer: df.select(F.lit(-1).cast("long").alias("seq"), "guid", "provider_event_key", third_key().alias("fuzzy"), F.lit(False).alias("event"), F.lit(True).alias("stored"), F.lit(layer).alias("layer"))
    every = rows.select("seq", "guid", "provider_event_key", "fuzzy", "event", F.lit(False).alias("stored"), F.lit(0).alias("layer"))

    def keyed(df: DataFrame, *names: str) -> DataFrame:
        return df.select(*names, F.explode(keys_of(F.col("fuzzy"))).alias("k")).select(*names, digest(F.to_json("k")).alias("key"))

    if not raw.isEmpty() or not events.isEmpty():
        # stored rows that share a key with a row that comes
        held = stored(raw, 0).unionByName(stored(events, 1))
        hit = kept_rows(keyed(held, "layer", "guid").join(keyed(every), "key", "left_semi").select("layer", "guid").distinct(), "hit")
        every = every.unionByName(held.join(hit, ["layer", "guid"], "left_semi"))
    every = kept_rows(every.withColumn("node", F.when(F.col("stored"), F.concat(F.lit("s"), "layer", "guid")).otherwise(F.concat(F.lit("r"), F.lpad(F.col("seq").cast("string"), 20, "0")))), "nodes")
    linked = every.join(labels_of(keyed(every, "node")).withColumnRenamed("label", "component"), "node")
    # a row that repeats the one before it in its component ends where that one did
    order = Window.partitionBy("component").orderBy("stored", "seq")
    same = lambda c: F.col(c).eqNullSafe(F.lag(c).over(order))
    repeats = ~F.col("stored") & F.coalesce(~F.lag("stored").over(order), F.lit(False)) & same("provider_event_key") & same("guid") & same("fuzzy") & same("event")
    runs = kept_rows(linked.withColumn("first", ~repeats).withColumn("run", F.sum(F.col("first").cast("int")).over(order)), "runs")
    told = runs.filter("first").select("component", "seq", "guid", "provider_event_key", "fuzzy", "event", "stored", "layer")
    result = told.repartition("component").sortWithinPartitions("component", F.desc("stored"), "seq", "guid").mapInPandas(folded, ENDED)
    firsts = runs.filter("first and not stored").select("component", "run", "seq").join(result, "seq").withColumnRenamed("seq", "_first")
    out = runs.filter("not stored").select("component", "run", "seq").join(firsts, ["component", "run"])
    new = lambda c: (F.col(c) & (F.col("seq") == F.col("_first"))).alias(c)
    return out.select("seq", "raw_guid", new("raw_inserted"), "event_guid", new("event_inserted"))


def last(c: str) -> Column:
    return F.max_by(c, "seq").alias(c)


def known(c: str) -> Column:
    """The last value that isn't null."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)


def merged(rows: DataFrame, stored: DataFrame, more: list[str], events: bool) -> DataFrame:
    """A layer's rows by guid: what is known of company, fleet, plate and key stays until something else is known, other fields are the last row's.
    Where a harvest and live messages meet, the source says harvest."""
    names = [f.split()[0] for f in LAYER.split(",")] + more
    # a row that is alone under its guid is what the layer then holds
    several = rows.groupBy("guid").agg(F.count("*").alias("n")).filter("n > 1").select("guid").unionByName(stored.select("guid"))
    several = kept_rows(several.distinct(), "several")
    alone, rows = rows.join(several, "guid", "left_anti").select(*names), rows.join(several, "guid", "left_semi")
    both = stored.select(*names).withColumn("seq", F.lit(-1).cast("long")).unionByName(rows.select(*names, "seq"))
    keep = {"company_slug", "fleet_id", "plate_no", "provider_event_key", *(["driver_name"] if events else [])}
    first, final = F.min_by("source", "seq"), F.max_by("source", "seq")
    source = F.when(final == "harvest", final).otherwise(F.when(F.max(F.col("source") == "harvest"), "harvest").otherwise(final) if events else F.coalesce(F.nullif(first, F.lit("")), final))
    latest = [] if events else ["received_at"]
    columns = [known(c) if c in keep else F.max(c).alias(c) if c in latest else last(c) for c in names if c not in ("guid", "source")]
    return both.groupBy("guid").agg(*columns, source.alias("source")).select(*names).unionByName(alone)


def ingest_singles(store: TableStore, batch: str, arriving: DataFrame, companies: DataFrame, source: str, zone: str) -> bool:
    """Takes alarms in as if they came one by one in order of seq, as one version; False for a batch that the ledger has.

    arriving: ARRIVING with total_mileage_km. Raw rows and events are found under any of their keys; audit rows come once, an anomaly each time; the
    device's snapshot of a local day follows the alarms that are new events. Tables are those of batches, and alarm_snapshots.
    """
    if not store.has("alarm_snapshots"):
        t = store.begin()
        t.append("alarm_snapshots", store.spark.createDataFrame([], SNAPSHOT))
        t.commit()
    t = store.begin()
    if not t.read("ledger").filter(F.col("batch") == batch).isEmpty():
        return False
    rows = resolved(arriving, t.read("devices"), companies).withColumns({"source": F.lit(source), "event": F.col("ingest_result") == "pending_alarm_upsert"})
    rows = kept_rows(rows.withColumn("fuzzy", third_key()).drop("report_text", "end_text", "start_text"), "singles")
    places = kept_rows(ended(rows, t.read("alarm_raw"), t.read("alarm_events")), "places")
    own = {"raw_guid": F.col("guid"), "raw_inserted": F.lit(True), "event_guid": F.when(F.col("event"), F.col("guid")), "event_inserted": F.col("event")}
    found = rows.join(places, "seq", "left").withColumns({c: F.coalesce(c, other) for c, other in own.items()})
    result = F.when(F.col("event"), F.when(F.col("event_inserted"), "inserted_alarm_event").otherwise("updated_alarm_event")).otherwise(F.col("ingest_result"))
    found = kept_rows(found.withColumns({"ingest_result": result, "own_guid": F.col("guid")}), "ended")

    layers = (
        ("alarm_raw", found.withColumn("guid", F.col("raw_guid")), ["temporal_status", "ingest_result"], False, "raw_inserted"),
        ("alarm_events", found.filter("event").withColumn("guid", F.col("event_guid")), ["driver_name", "start_at", "end_at"], True, "event_inserted"),
    )
    for name, of, more, events, new in layers:
        # what a row has put in is none of the stored ones
        old = kept_rows(t.read(name, places=True).join(kept_rows(of.filter(~F.col(new)).select("guid"), "guids"), "guid", "left_semi"), name)
        t.append(name, merged(of, old, more, events))
        t.delete(name, old, once=True)
    audit(t, found, source)
    snapshots(t, found, source, zone)
    device_records(t, found)
    counts = found.agg(F.count("*").alias("n"), F.count_if("raw_inserted").alias("raw"), F.count_if("event_inserted").alias("events"), F.count_if("event").alias("dms"), F.count_if(F.col("temporal_status") != "accepted").alias("late"), F.max(F.when(F.col("event"), F.col("occurred_at"))).alias("latest")).first()
    values = {"batch": batch, "source": source, "provider_rows": counts.n, "prepared_rows": counts.n, "duplicates": 0, "raw_inserted": counts.raw, "raw_updated": counts.n - counts.raw, "dms_inserted": counts.events, "dms_updated": counts.dms - counts.events, "non_dms": None, "unmapped": None, "temporal_rejected": counts.late, "latest_observed_at": counts.latest}
    t.append("ledger", store.spark.createDataFrame([tuple(values[c] for c in t.read("ledger").columns)], t.read("ledger").schema))
    t.commit(batch=batch)
    return True


def audit(t: Transaction, found: DataFrame, source: str) -> None:
    """What was decided on each row, once for each guid, stage and reason; a time that was rejected is an anomaly each time."""
    said = F.array(
        F.struct(F.lit(f"classification_{source}").alias("stage"), F.coalesce("classification_status", F.lit("unknown")).alias("reason")),
        F.struct(F.lit(f"temporal_resolution_{source}").alias("stage"), F.col("temporal_resolution").alias("reason")),
        F.struct(F.lit(f"ingest_result_{source}").alias("stage"), F.col("ingest_result").alias("reason")),
    )
    names, keys = t.read("alarm_audit").columns, ["guid", "stage", "reason"]
    stages = [f"{stage}_{source}" for stage in ("classification", "temporal_resolution", "ingest_result")]
    told = audited(found.filter("own_guid is not null"), t.read("alarm_audit").filter(F.col("stage").isin(stages)), said)
    # without a guid each stage and reason comes once
    others = found.filter("own_guid is null").withColumns({"guid": F.col("own_guid"), "observed_at": F.col("occurred_at"), "_s": F.explode(said)}).filter("_s.reason is not null").withColumns({"stage": F.col("_s.stage"), "reason": F.col("_s.reason")})
    once = others.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in names if c not in keys]), "seq").alias("_a")).select(*keys, "_a.*")
    t.append("alarm_audit", told.unionByName(once))
    late = found.filter("temporal_status <> 'accepted'").withColumns({"source_type": F.lit(f"{source}_alarm"), "reason": F.lit("future_timestamp")})
    t.append("anomalies", late.select(*t.read("anomalies").columns))


def snapshots(t: Transaction, found: DataFrame, source: str, zone: str) -> None:
    keys = ["device_id", "snapshot_date"]
    new = found.filter("event_inserted and total_mileage_km is not null").withColumns({"snapshot_date": F.to_date(F.from_utc_timestamp("occurred_at", zone)), "observed_at": F.col("occurred_at"), "total_km": F.col("total_mileage_km")})
    old = kept_rows(t.read("alarm_snapshots", places=True).join(new.select(*keys), keys, "left_semi"), "days")
    names = [f.split()[0] for f in SNAPSHOT.split(",")]
    both = old.select(*names).withColumn("seq", F.lit(-1).cast("long")).unionByName(new.select(*names, "seq"))
    best = F.max_by(F.struct("observed_at", "total_km"), F.struct("observed_at", "seq")).alias("_b")
    out = both.groupBy(*keys).agg(best, *[known(c) for c in ("plate_no", "company_slug", "fleet_id")], F.when(F.max(F.col("source") == "live"), "live").otherwise(F.max_by("source", "seq")).alias("source"))
    t.append("alarm_snapshots", out.select(*keys, "_b.observed_at", "_b.total_km", "plate_no", "company_slug", "fleet_id", "source"))
    t.delete("alarm_snapshots", old)


def device_records(t: Transaction, found: DataFrame) -> None:
    """The devices' records after the rows: what is known last, and the latest times."""
    names = t.read("devices").columns
    old = kept_rows(t.read("devices", places=True).join(found.select("device_id"), "device_id", "left_semi"), "records")
    new = found.withColumns({"last_seen_at": F.col("occurred_at"), "last_received_at": F.col("received_at")})
    both = old.select(*names).withColumn("seq", F.lit(-1).cast("long")).unionByName(new.select(*names, "seq"))
    times = ("last_seen_at", "last_received_at")
    t.append("devices", both.groupBy("device_id").agg(*[F.max(c).alias(c) if c in times else known(c) for c in names if c != "device_id"]))
    t.delete("devices", old)
