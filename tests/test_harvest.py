"""The landing source, harvests and rebuilds: replays, failing devices, and jobs that were stopped."""

import json
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from haulmark.operators.batches import ARRIVING, apply_batch, audited, create_tables, resolved, t_columns, upserted
from haulmark.plans.applied import arriving, known_devices
from haulmark.plans.harvest import land as land_cuts
from haulmark.sources import domain as d
from haulmark.sources import landing
from haulmark.sources.versions import TableStore
from haulmark.streaming.harvest import create_harvest, harvest
from haulmark.streaming.rebuild import Deferred, job_row, rebuild

SF = "/root/testdata/sf0.001"


def alarm(guid, device, at, text="Yawning"):
    return {"alarmID": guid, "deviceID": device, "alarmTypeValue": text, "alarmType": "999", "startTime": at, "endTime": at}


def page(*alarms, status=0):
    return json.dumps({"status": status, "data": {"list": list(alarms)}})


def land(folder, cut, replies):
    for device, lines in replies.items():
        path = Path(folder, f"cut={cut}", f"device_id={device}")
        path.mkdir(parents=True)
        (path / "part-0.txt").write_text("".join(f"{x}\n" for x in lines))
    Path(folder, "_cuts", cut).mkdir(parents=True)


def devices(spark, *names):
    return spark.createDataFrame([(n, None, None, "F0", None, None, None) for n in names], "device_id string, plate_no string, company_slug string, fleet_id string, driver_name string, last_seen_at timestamp, last_received_at timestamp")


def test_ranges_cover_each_line_once(tmp_path, monkeypatch):
    lines = [f"line {k} " + "x" * (k % 37) for k in range(200)]
    land(tmp_path, "2024-01-01T0000", {"D1": lines, "D2": ["a", "", "b"]})
    for size in (7, 64, 1000, 1 << 20):
        monkeypatch.setattr(landing, "TASK_BYTES", size)
        reader = landing.LandingReader(f"file://{tmp_path}")
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = [(r["device_id"], r["body"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(got) == sorted([("D1", x) for x in lines] + [("D2", x) for x in ("a", "", "b")])
        assert len(parts) > 1 or size > 1000
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_failing_device_gives_partial_and_no_publication(spark, tmp_path):
    store, companies = TableStore(spark, f"{tmp_path}/store"), d.companies(spark).filter("slug = 'all'")
    create_harvest(store, devices(spark, "A1", "A2", "A3"))
    run = lambda: harvest(spark, f"{tmp_path}/in", store, companies, "UTC", f"{tmp_path}/check")
    good = {"A1": [page(alarm("g1", "A1", "2024-01-05 08:00:00"))], "A2": [page(alarm("g2", "A2", "2024-01-05 09:00:00"), 7)], "A3": [page()]}
    land(f"{tmp_path}/in", "2024-01-06T0000", good)
    run()
    (p,) = store.read("publications").collect()
    assert (p.published_cut_at, p.status, p.events) == (datetime(2024, 1, 6), "succeeded", 2)
    version = store.version()
    run()  # nothing has landed since
    assert store.version() == version
    land(f"{tmp_path}/in", "2024-01-07T0000", {"A1": [page(alarm("g3", "A1", "2024-01-06 08:00:00"))], "A2": [page(status=500)], "A3": [page()]})
    run()
    (p,) = store.read("publications").collect()
    assert (p.published_cut_at, p.status, p.events) == (datetime(2024, 1, 6), "partial", 2)
    assert {r.guid for r in store.read("alarm_events").collect()} == {"g1", "g2", "g3"}
    land(f"{tmp_path}/in", "2024-01-08T0000", {"A1": [page(status=429)], "A2": [page(alarm("g4", "A2", "2024-01-07 08:00:00"))], "A3": [page()]})
    run()
    assert {(r.device_id, r.status) for r in store.read("harvest_devices").filter("cut_at = timestamp '2024-01-08'").collect()} == {("A1", "rate_limited"), ("A2", "queued"), ("A3", "queued")}
    assert store.read("alarm_raw").filter("guid = 'g4'").count() == 0
    land(f"{tmp_path}/in", "2024-01-09T0000", {"A1": [page()], "A2": [page(alarm("g4", "A2", "2024-01-07 08:00:00"), alarm("g1", "A1", "2024-01-05 08:00:00"))], "A3": [page()]})
    run()
    (p,) = store.read("publications").collect()
    assert (p.published_cut_at, p.status, p.events) == (datetime(2024, 1, 9), "succeeded", 4)
    assert store.read("harvest_runs").count() == 4 and Path(tmp_path, "in", "_taken", "2024-01-08T0000").exists()


def table(store, name):
    return sorted(str(r) for r in store.read(name).select(*[c for c in store.read(name).columns if c != "received_at"]).collect())


def test_stopped_rebuild_goes_on(spark, tmp_path):
    arriving(spark, SF).filter("occurred_at < timestamp '2024-01-13'").withColumn("d", F.to_date("occurred_at")).write.partitionBy("d").parquet(f"{tmp_path}/history")
    history = spark.read.parquet(f"{tmp_path}/history")
    asked = []

    def fetch(lo, hi, stop=None):
        asked.append(lo)
        if lo == stop:
            raise ValueError("provider is gone")
        return history.filter(F.col("d").between(lo, hi)).drop("d")

    first, last = date(2024, 1, 1), date(2024, 1, 12)
    whole = TableStore(spark, f"{tmp_path}/whole")
    create_tables(whole, known_devices(spark, SF))
    rebuild(whole, "j", fetch, first, last, d.companies(spark), 4)
    parts = TableStore(spark, f"{tmp_path}/parts")
    create_tables(parts, known_devices(spark, SF))
    with pytest.raises(ValueError):
        rebuild(parts, "j", lambda lo, hi: fetch(lo, hi, date(2024, 1, 9)), first, last, d.companies(spark), 4)
    assert job_row(parts, "j")["status"] == "failed" and job_row(parts, "j")["days_done"] == 8
    asked.clear()
    row = rebuild(parts, "j", fetch, first, last, d.companies(spark), 4)
    assert asked == [date(2024, 1, 9)] and row["status"] == "succeeded" and row["days_done"] == 12
    for name in ("alarm_raw", "alarm_events", "alarm_audit", "anomalies", "devices", "ledger"):
        assert table(parts, name) == table(whole, name), name
    version = parts.version()
    assert rebuild(parts, "j", fetch, first, last, d.companies(spark), 4)["status"] == "succeeded" and parts.version() == version


def test_deferred_rebuild_is_queued(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/store")
    create_tables(store)
    until = datetime(2024, 1, 2, 3)

    def later(lo, hi):
        raise Deferred(until)

    row = rebuild(store, "j", later, date(2024, 1, 1), date(2024, 1, 2), d.companies(spark))
    assert (row["status"], row["phase"], row["next_retry_at"], row["days_done"]) == ("queued", "waiting_retry", until, 0)
    assert job_row(store, "j")["status"] == "queued"


def small(spark, rows):
    t0 = datetime(2024, 1, 5)
    base = [(k, g, dev, "F0", None, None, "Bostezo", "m", cls, text, None, None, t0 + timedelta(minutes=at), None, None, t0 + timedelta(hours=1), "t", "{}", "", "", "") for k, (g, dev, cls, text, at) in enumerate(rows)]
    return spark.createDataFrame(base, ARRIVING)


def test_batch_replay_and_fault(spark, tmp_path):
    """Four alarms of a device: one, the same under another guid, one that is no alarm of drivers, one too far ahead."""
    store, companies = TableStore(spark, str(tmp_path)), d.companies(spark)
    create_tables(store)
    rows = small(spark, [("a", "D9", "classified_dms", "x", 0), ("b", "D9", "classified_dms", "x", 0), ("c", "D9", "classified_non_dms", "y", 10), ("e", "D9", "classified_dms", "x", 80)])
    assert apply_batch(store, "one", rows, companies, "harvest")
    sizes = lambda: {n: store.read(n).count() for n in ("alarm_raw", "alarm_events", "anomalies", "alarm_audit")}
    first = sizes()
    assert first == {"alarm_raw": 3, "alarm_events": 1, "anomalies": 1, "alarm_audit": 7}
    version = store.version()
    assert not apply_batch(store, "one", rows, companies, "harvest") and store.version() == version
    assert apply_batch(store, "again", rows, companies, "harvest")
    counts = {r.batch: (r.prepared_rows, r.duplicates, r.raw_inserted, r.raw_updated, r.dms_inserted, r.dms_updated, r.temporal_rejected) for r in store.read("ledger").collect()}
    assert counts == {"one": (3, 1, 3, 0, 1, 0, 1), "again": (3, 1, 0, 3, 0, 1, 1)}
    assert sizes() == first | {"alarm_audit": 8}  # the event is now an updated one

    def broken(t, found):
        raise RuntimeError("disk full")

    version, before = store.version(), sizes()
    with pytest.raises(RuntimeError):
        apply_batch(store, "two", small(spark, [("z", "D8", "classified_dms", "x", 5)]), companies, "harvest", broken)
    assert store.version() == version and sizes() == before
    assert apply_batch(store, "two", small(spark, [("z", "D8", "classified_dms", "x", 5)]), companies, "harvest")


def test_files_of_many_devices(spark, tmp_path, monkeypatch):
    """A line names its device; such files and folders of single devices stand side by side, and landing makes no folder a device."""
    land(tmp_path, "2024-01-01T0000", {"D1": ["one", "two"]})
    lines = [f"D{k % 7}\treply {k} " + "x" * (k % 23) for k in range(120)]
    Path(tmp_path, "cut=2024-01-01T0000", "part-0.txt").write_text("".join(f"{x}\n" for x in lines))
    for size in (50, 1 << 20):
        monkeypatch.setattr(landing, "TASK_BYTES", size)
        reader = landing.LandingReader(f"file://{tmp_path}")
        got = [(r["device_id"], r["body"]) for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(got) == sorted([tuple(x.split("\t")) for x in lines] + [("D1", "one"), ("D1", "two")])
    land_cuts(spark, SF, f"{tmp_path}/landed")
    assert not list(Path(tmp_path, "landed").glob("cut=*/device_id=*")) and list(Path(tmp_path, "landed").glob("cut=*/part-*"))


def test_rows_resolve_in_compiled_plans(spark, tmp_path):
    """The generated code of no step is beyond what Spark compiles."""
    store = TableStore(spark, str(tmp_path))
    create_tables(store, known_devices(spark, SF))
    rows = resolved(arriving(spark, SF), store.read("devices"), d.companies(spark))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_audit_rows_come_once(spark):
    """Of rows with one guid the first tells; what is known isn't told again, and rows without a guid always tell."""
    said = F.array(F.struct(F.lit("class").alias("stage"), F.col("classification_status").alias("reason")), F.struct(F.lit("time").alias("stage"), F.when(F.col("seq") == 1, "late").alias("reason")))
    names = [c for c in t_columns("alarm_audit") if c not in ("guid", "observed_at", "stage", "reason")]
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "x"), (5, None, "x"), (6, "c", None)], "seq long, own_guid string, classification_status string")
    found = rows.withColumns({"occurred_at": F.lit(None).cast("timestamp"), **{c: F.lit(None).cast("timestamp" if c == "received_at" else "string") for c in names}, "payload_json": F.col("seq").cast("string")})
    known = spark.createDataFrame([("b", "class", "x"), ("a", "class", "y")], "guid string, stage string, reason string")
    got = sorted((r.payload_json, r.guid, r.stage, r.reason) for r in audited(found, known, said).collect())
    assert got == [("1", "a", "class", "x"), ("1", "a", "time", "late"), ("4", None, "class", "x"), ("5", None, "class", "x")]


def test_last_row_of_a_guid_stays(spark, tmp_path):
    """Rows are stored without a shuffle of the whole rows: only guid and seq move."""
    store = TableStore(spark, str(tmp_path))
    t = store.begin()
    t.append("rows", spark.createDataFrame([("a", "old"), ("z", "kept")], "guid string, payload string"))
    t.commit()
    t = store.begin()
    upserted(t, "rows", spark.createDataFrame([(1, "a", "first"), (3, "a", "last"), (2, "b", "one")], "seq long, guid string, payload string"), ["guid", "payload"])
    t.commit()
    assert sorted((r.guid, r.payload) for r in store.read("rows").collect()) == [("a", "last"), ("b", "one"), ("z", "kept")]
