"""Live status over a stream: the state of each device, and what a micro-batch does to devices, readings, daily snapshots and anomalies.

Everything comes out of one stateful pass as rows of four kinds; the sink writes the four tables as one version of a store, with the number of
the micro-batch in its ledger, so a micro-batch that is done again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from haulmark.operators.tenants import first_match
from haulmark.sources.versions import TableStore

STATUS = """device_id string, seq long, plate_no string, fleet_id string, driver_name string, observed_at timestamp, received_at timestamp, day date, total_km double, day_km double,
raw_total_value string, raw_day_value string, raw_event_time string"""
OUT = f"kind string, {STATUS}, validation_status string, validation_reason string, first_total double, accepted long, regressions long"
KINDS = {
    "device": "device_id string, plate_no string, company_slug string, fleet_id string, driver_name string, last_seen_at timestamp, last_received_at timestamp, last_total_km double, last_day_km double, raw_total_value string, raw_day_value string, km_validation_status string, km_validation_reason string, accepted long, regressions long",
    "reading": "device_id string, plate_no string, fleet_id string, recorded_at timestamp, total_km double, day_km double, source string",
    "snapshot": "device_id string, snapshot_date date, plate_no string, company_slug string, fleet_id string, observed_at timestamp, total_km double, day_km double, raw_total_value string, raw_day_value string, km_validation_status string, km_validation_reason string, source string",
    "anomaly": "device_id string, company_slug string, source_type string, received_at timestamp, raw_event_time string, reason string",
}
SLACK = 0.1


def accepted_totals(totals: np.ndarray, last: float) -> tuple[np.ndarray, np.ndarray]:
    """(which totals are accepted, the last accepted total after each row). A total more than SLACK below the last accepted one isn't; nan is none.

    Rows are taken in runs: all up to the next fall are accepted at once, then all up to the next total that reaches the last one are rejected.
    """
    ok, known = ~np.isnan(totals), np.flatnonzero(~np.isnan(totals))
    values = totals[known]
    taken = np.ones(len(known), bool)
    falls = np.flatnonzero(values[1:] + SLACK < values[:-1]) + 1
    i = 0
    while i < len(values):
        if not np.isnan(last) and values[i] + SLACK < last:
            step = 64
            j = i + 1
            while j < len(values):  # the next one that reaches the last total, in steps that grow
                reach = np.flatnonzero(values[j : j + step] + SLACK >= last)
                if len(reach):
                    j += int(reach[0])
                    break
                j, step = j + step, step * 2
            j = min(j, len(values))
            taken[i:j] = False
            i = j
        else:
            k = np.searchsorted(falls, i + 1)
            j = int(falls[k]) if k < len(falls) else len(values)
            last = float(values[j - 1])
            i = j
    ok[known] = taken
    return ok, pd.Series(np.where(ok, totals, np.nan)).ffill().to_numpy()


class StatusProcessor(StatefulProcessor):
    """Keeps for each device its last accepted distances, what is known of it, and how many totals it had accepted and rejected."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "total_km double, day_km double, plate_no string, fleet_id string, driver_name string, accepted long, regressions long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """All rows of a device in a micro-batch, in order of arrival; chunks of a group come in no order, so they are sorted together."""
        got = sorted(rows, key=lambda r: (r["received_at"], r["seq"]))
        last_total, last_day, *known, accepted, regressions = self.state.get() or (None, None, None, None, None, 0, 0)
        told = np.array([np.nan if r["total_km"] is None else r["total_km"] for r in got], float)
        taken, after = accepted_totals(told, float("nan") if last_total is None else last_total)
        days: dict[object, dict] = {}
        for r, ok, reference in zip(got, taken.tolist(), after.tolist(), strict=True):
            total, day_km = r["total_km"], r["day_km"]
            reference = last_total if reference != reference else reference
            fell = total is not None and total == total and not ok
            above = day_km is not None and reference is not None and day_km > reference + SLACK
            reason = "total_regression,day_gt_total" if fell and above else "total_regression" if fell else "day_gt_total" if above else None
            known = [r[c] or k for c, k in zip(IDENTITY, known, strict=True)]
            now = r.asDict() | dict(zip(IDENTITY, known, strict=True))
            now |= {"total_km": total if ok else None, "day_km": None if above or day_km != day_km else day_km, "validation_status": "invalid" if fell or above else "valid", "validation_reason": reason}
            now["first_total"] = 0.0 if reference is None else reference
            last_total, last_day = reference, last_day if now["day_km"] is None else now["day_km"]
            accepted, regressions = accepted + ok, regressions + fell
            if ok:
                yield changed("reading", now)
            for wrong, why in ((fell, "total_regression"), (above, "day_gt_total")):
                if wrong:
                    yield changed("anomaly", now | {"validation_reason": why})
            # a day's distances are its last that hold, its first_total what was known at its first message
            before = days.get(r["day"], now)
            days[r["day"]] = now | {"first_total": before["first_total"]} | {c: before[c] if now[c] is None else now[c] for c in ("total_km", "day_km")}
        self.state.update((last_total, last_day, *known, accepted, regressions))
        yield changed("device", now | {"total_km": last_total, "day_km": last_day, "accepted": accepted, "regressions": regressions})
        for snapshot in days.values():
            yield changed("snapshot", snapshot)

    def close(self) -> None:
        pass


IDENTITY = ("plate_no", "fleet_id", "driver_name")
COLUMNS = [c.split()[0] for c in OUT.split(",")]


def changed(kind: str, values: dict) -> Row:
    return Row(*COLUMNS)(kind, *[values.get(c) for c in COLUMNS[1:]])


def status_changes(statuses: DataFrame) -> DataFrame:
    """What each micro-batch of a stream of STATUS rows changes. Needs RocksDB as state store (see run_status)."""
    return statuses.groupBy("device_id").transformWithState(StatusProcessor(), OUT, "Update", "None")


def fields(kind: str) -> list[str]:
    return [c.split()[0] for c in KINDS[kind].split(",")]


def store_changes(store: TableStore, changes: DataFrame, number: int, companies: DataFrame) -> bool:
    """Puts the changes of a micro-batch into the store as one version; False if it has them already."""
    if not store.version():
        t = store.begin()
        for kind, schema in (KINDS | {"ledger": "batch long"}).items():
            t.append(kind, store.spark.createDataFrame([], schema))
        t.commit()
    t = store.begin()
    if not t.read("ledger").filter(F.col("batch") == number).isEmpty():
        return False
    changes = changes.persist()
    try:
        device = changes.filter("kind = 'device'")
        tenant = first_match(device.select("device_id", "fleet_id"), companies, "device_id").withColumnRenamed("slug", "company_slug")
        told = changes.join(tenant, "device_id", "left").withColumnsRenamed({"validation_status": "km_validation_status", "validation_reason": "km_validation_reason"})
        now = {
            "device": told.filter("kind = 'device'").withColumnsRenamed({"observed_at": "last_seen_at", "received_at": "last_received_at", "total_km": "last_total_km", "day_km": "last_day_km"}),
            "reading": told.filter("kind = 'reading'").withColumnsRenamed({"observed_at": "recorded_at"}).withColumn("source", F.lit("status")),
            "anomaly": told.filter("kind = 'anomaly'").withColumnsRenamed({"km_validation_reason": "reason"}).withColumn("source_type", F.lit("status")),
        }
        keys = ["device_id", "snapshot_date"]
        fresh = told.filter("kind = 'snapshot'").withColumnsRenamed({"day": "snapshot_date"}).withColumn("source", F.lit("live"))
        kept = t.read("snapshot", places=True).join(fresh.select(*keys), keys, "left_semi")
        before = kept.select(*keys, F.col("total_km").alias("_total"), F.col("day_km").alias("_day"))
        fresh = fresh.join(before, keys, "left").withColumns({"total_km": F.coalesce("total_km", "_total", "first_total"), "day_km": F.coalesce("day_km", "_day")})
        t.append("snapshot", fresh.select(*fields("snapshot")))
        t.delete("snapshot", kept)
        old = t.read("device", places=True).join(device.select("device_id"), "device_id", "left_semi")
        t.append("device", now["device"].select(*fields("device")))
        t.delete("device", old)
        t.append("reading", now["reading"].select(*fields("reading")))
        t.append("anomaly", now["anomaly"].select(*fields("anomaly")))
        t.append("ledger", store.spark.createDataFrame([(number,)], "batch long"))
        t.commit(batch=number)
    finally:
        changes.unpersist()
    return True


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_status(statuses: DataFrame, store: TableStore, companies: DataFrame, checkpoint: str) -> list[dict]:
    """Works off what has arrived and ends; the progress of each micro-batch. The session's state store stays as it was."""
    spark = store.spark
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        sink = lambda batch, number: store_changes(store, batch, number, companies)
        stream = status_changes(statuses).writeStream.outputMode("update").foreachBatch(lambda b, n: (sink(b, n), None)[1])
        query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return [dict(p) for p in query.recentProgress]
