"""Devices with several records, and what moves for a row of a batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from haulmark.operators.batches import ARRIVING, apply_batch, contexts, create_tables, stored_matches
from haulmark.operators.singles import ended, ingest_singles
from haulmark.sources import domain as d
from haulmark.sources.versions import TableStore
from haulmark.streaming.harvest import create_harvest, harvest
from tests.test_harvest import alarm, land, page

T0 = datetime(2024, 1, 5)
DEVICES = "device_id string, plate_no string, company_slug string, fleet_id string, driver_name string, last_seen_at timestamp, last_received_at timestamp"


def several(spark):
    """D90000 has eleven records, those of F2 and F1 among them; D90001 has one."""
    return spark.createDataFrame([("D90000", f"ABC{k:03d}", None, f"F{k % 5}", None, None, None) for k in range(11)] + [("D90001", "XYZ001", None, "F0", None, None, None)], DEVICES)


def rows(spark, guid="g"):
    each = [(k, f"{guid}{k}", f"D9000{k % 3}", None, None, None, "Bostezo", "m", "classified_dms", "x", None, None, T0 + timedelta(minutes=k), None, None, T0 + timedelta(hours=1), "t", "{}", "", "", "") for k in range(9)]
    return spark.createDataFrame(each, ARRIVING)


def test_rows_are_not_multiplied_by_records(spark, tmp_path):
    """A row a row, whatever the number of records of its device; its company is the first that one of them belongs to, now and later."""
    store, companies = TableStore(spark, str(tmp_path)), d.companies(spark)
    create_tables(store, several(spark))
    for name in ("one", "two"):
        assert apply_batch(store, name, rows(spark), companies, "harvest")
    assert {r.batch: (r.provider_rows, r.prepared_rows, r.duplicates, r.raw_inserted, r.raw_updated) for r in store.read("ledger").collect()} == {"one": (9, 9, 0, 9, 0), "two": (9, 9, 0, 0, 9)}
    assert sorted((r.device_id, r.plate_no, r.fleet_id, r.company_slug) for r in store.read("devices").collect()) == [("D90000", "ABC001", "F1", "south"), ("D90001", "XYZ001", "F0", "all"), ("D90002", "D90002", None, "all")]
    assert sorted({(r.device_id, r.company_slug) for r in store.read("alarm_raw").collect()}) == [("D90000", "south"), ("D90001", "all"), ("D90002", "all")]


def test_digests_of_keys_move(spark):
    """Contexts are a row a device, and stored rows are found by digests: no text of a key is shuffled."""
    first = spark.createDataFrame([("D90000", (None, None)), ("D7", ("F3", "p"))], "device_id string, _first struct<fleet_id: string, plate_no: string>")
    assert sorted((r.device_id, r.slug, r.fleet_id) for r in contexts(several(spark), first, d.companies(spark)).collect()) == [("D7", "south", "F3"), ("D90000", "south", "F1")]
    keyed = spark.createDataFrame([(1, True, "g1", "k1", "f1"), (2, False, "g2", None, "f2"), (3, True, "g3", "k3", "f3")], "seq long, event boolean, guid string, provider_event_key string, fuzzy string")
    layer = lambda *guids: spark.createDataFrame([(g, key, "D", "c", "x", None, None, T0) for g, key in guids], "guid string, provider_event_key string, device_id string, category string, raw_alarm_type string, raw_tp string, raw_event_code string, occurred_at timestamp")
    assert stored_matches(keyed, layer(), layer()) is None
    found = stored_matches(keyed, layer(("s2", "k1"), ("s1", "k1"), ("g1", "k9"), ("g2", None)), layer(("e1", "k1"), ("g2", "k8"), ("g3", None)))
    assert sorted(map(tuple, found.collect())) == [(1, "s1", "e1"), (2, "g2", None), (3, None, "g3")]
    moved = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(tier" in line]
    assert moved and "key#" in moved[0] and "unhex" in found._jdf.queryExecution().executedPlan().toString()


def test_singles_are_not_multiplied_by_records(spark, tmp_path):
    """Alarms one by one of a device with several records: a row a row, and only rows that share a key are sorted or folded."""
    store, companies = TableStore(spark, str(tmp_path)), d.companies(spark)
    create_tables(store, several(spark))
    alarms = rows(spark).withColumn("total_mileage_km", F.col("seq").cast("double"))
    assert ingest_singles(store, "one", alarms, companies, "live", d.ZONE)
    (r,) = store.read("ledger").collect()
    assert (r.provider_rows, r.raw_inserted, r.raw_updated, r.dms_inserted) == (9, 9, 0, 9)
    assert store.read("alarm_raw").count() == store.read("alarm_events").count() == 9 and store.read("alarm_audit").count() == 18
    empty = store.read("alarm_raw").filter("false")
    keyed = spark.createDataFrame([(1, "a", "k", "f1", True), (2, "b", "k", "f2", False), (3, "c", "k3", "f3", True)], "seq long, guid string, provider_event_key string, fuzzy string, event boolean")
    assert sorted(map(tuple, ended(keyed, empty, empty).collect())) == [(1, "a", True, "a", True), (2, "a", False, None, False)]


def test_harvest_of_devices_with_several_records(spark, tmp_path):
    """Replies of a device with several records come in once; those of devices that failed, or that no company has, stay out."""
    cut = "2024-01-06T0000"
    land(f"{tmp_path}/landed", cut, {"D90000": [page(*[alarm(f"a{k}", "D90000", f"2024-01-05 0{k}:00:00") for k in range(5)])], "D90001": [page(status=500)], "D7": [page(alarm("x", "D7", "2024-01-05 01:00:00"))]})
    store = TableStore(spark, f"{tmp_path}/store")
    create_harvest(store, several(spark))
    harvest(spark, f"{tmp_path}/landed", store, d.companies(spark), d.ZONE, f"{tmp_path}/checkpoint")
    (r,) = store.read("ledger").collect()
    assert (r.provider_rows, r.duplicates, r.raw_inserted) == (5, 0, 5)
    assert sorted((r.device_id, r.company_slug, r.status, r.provider_rows, r.inserted_raw) for r in store.read("harvest_devices").collect()) == [("D90000", "south", "succeeded", 5, 5), ("D90001", "all", "failed", 0, 0)]
    assert {r.company_slug: r.events for r in store.read("publications").collect()} == {"south": 5, "all": None}
