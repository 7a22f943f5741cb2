"""Alarms one by one against a loop that takes them one by one."""

import json
import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest

from haulmark.operators.batches import ARRIVING, create_tables, resolved
from haulmark.operators.singles import components, folded, ingest_singles
from haulmark.sources import domain as d
from haulmark.sources.versions import TableStore

T0 = datetime(2024, 1, 5, 12)
SCHEMA = f"{ARRIVING}, total_mileage_km double"


def made(n, seed):
    g = random.Random(seed)
    rows = []
    for k in range(n):
        at = T0 + timedelta(minutes=g.randrange(4) * (1 if g.random() < 0.9 else 700))
        dms = g.random() < 0.7
        end = at + timedelta(seconds=g.choice([4, 9]))
        rows.append((
            k, f"g{g.randrange(n // 2)}", f"D0000{g.randrange(3)}", g.choice([None, "F1"]), g.choice([None, "abc123"]), g.choice([None, "dr"]), g.choice(["Bostezo", "Fumando"]) if dms else "No DMS", "m", "classified_dms" if dms else "classified_non_dms",
            g.choice(["x", "y"]), None, None, at, at, end, at + timedelta(minutes=g.choice([1, 2, 3, -20])), "t", json.dumps({"n": k}), "", "", "", g.choice([None, 10.0 + k]),
        ))
    return rows


def plain(rows, raw, events, days, source):
    """rows: dictionaries in order. raw, events: by guid; each row is looked up by key, guid, then device with texts and time."""

    def look(table, r):
        for test in (lambda x: x["provider_event_key"] == r["provider_event_key"], lambda x: x["guid"] == r["guid"], lambda x: x["fuzzy"] == r["fuzzy"]):
            hit = [x for x in table.values() if test(x)]
            if hit:
                return hit[-1]
        return None

    anomalies = 0
    for r in rows:
        x = look(raw, r)
        if x is None:
            x = raw[r["guid"]] = {"guid": r["guid"], "source": source, "received_at": r["received_at"], "company_slug": None, "fleet_id": None, "plate_no": None}
        x.update({c: r[c] for c in ("provider_event_key", "occurred_at", "fuzzy", "payload_json", "temporal_status")})
        x.update({c: r[c] or x[c] for c in ("company_slug", "fleet_id", "plate_no")})
        x["source"] = source if source == "harvest" or not x["source"] else x["source"]
        x["received_at"] = max(x["received_at"], r["received_at"])
        result = r["ingest_result"]
        anomalies += r["temporal_status"] != "accepted"
        if result == "pending_alarm_upsert":
            e, new = look(events, r), False
            if e is None:
                new, e = True, {"guid": r["guid"], "driver_name": None, "source": source}
                events[r["guid"]] = e
            e.update({c: r[c] for c in ("provider_event_key", "occurred_at", "fuzzy", "received_at", "end_at")})
            e["driver_name"] = r["driver_name"] or e["driver_name"]
            e["source"] = source if source == "harvest" or e["source"] != "harvest" else e["source"]
            result = "inserted_alarm_event" if new else "updated_alarm_event"
            if new and r["total_mileage_km"] is not None:
                key = (r["device_id"], (r["occurred_at"] - timedelta(hours=5)).date())
                if key not in days or r["occurred_at"] >= days[key][0]:
                    days[key] = (r["occurred_at"], r["total_mileage_km"])
        x["ingest_result"] = result
    return anomalies


@pytest.mark.parametrize("seed", [1, 2])
def test_like_one_by_one(spark, tmp_path, seed):
    store, companies = TableStore(spark, str(tmp_path)), d.companies(spark)
    create_tables(store)
    rows = made(90, seed)
    raw, events, days, anomalies = {}, {}, {}, 0
    for k, (part, source) in enumerate(((rows[:50], "live"), (rows[50:], "harvest"))):
        df = spark.createDataFrame(part, SCHEMA).coalesce(2)
        told = sorted((r.asDict() for r in resolved(df, store.read("devices"), companies).collect()), key=lambda r: r["seq"])
        anomalies += plain(told, raw, events, days, source)
        assert ingest_singles(store, f"b{k}", df, companies, source, d.ZONE)
        assert not ingest_singles(store, f"b{k}", df, companies, source, d.ZONE)
    pick = lambda table, *names: sorted(str(tuple(x[c] for c in names)) for x in table)
    got = [r.asDict() for r in store.read("alarm_raw").collect()]
    names = ("guid", "provider_event_key", "occurred_at", "payload_json", "company_slug", "fleet_id", "plate_no", "source", "received_at", "ingest_result", "temporal_status")
    assert pick(got, *names) == pick(raw.values(), *names)
    got = [r.asDict() for r in store.read("alarm_events").collect()]
    names = ("guid", "provider_event_key", "occurred_at", "received_at", "end_at", "driver_name", "source")
    assert pick(got, *names) == pick(events.values(), *names)
    assert sorted((r.device_id, r.snapshot_date, r.observed_at, r.total_km) for r in store.read("alarm_snapshots").collect()) == sorted((*k, *v) for k, v in days.items())
    assert store.read("anomalies").count() == anomalies and anomalies
    assert len(raw) < 80


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(f"n{k:03d}", f"k{k + j}") for k in range(60) for j in (0, 1)] + [("x", "alone")], "node string, key string")
    got = {r.node: r.component for r in components(links).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 61 and date.min


def test_copies_of_one_alarm(spark, tmp_path):
    row = made(2, 3)[0]
    rows = [(k, "same", *row[2:]) for k in range(400)]
    store = TableStore(spark, str(tmp_path))
    create_tables(store)
    assert ingest_singles(store, "b", spark.createDataFrame(rows, SCHEMA), d.companies(spark), "live", d.ZONE)
    (r,) = store.read("ledger").collect()
    assert (r.raw_inserted, r.raw_updated) == (1, 399) and store.read("alarm_raw").count() == 1


def test_components_stream_through_a_task(spark):
    """A batch may end within a component and hold several: the same as each component by itself."""
    columns = ["component", "seq", "guid", "provider_event_key", "fuzzy", "event", "stored", "layer"]
    rows = [("a", -1, "s", "p0", "f0", False, True, 0), ("a", 1, "g1", "p0", "f1", True, False, 0), ("a", 2, "g2", "p2", "f1", True, False, 0), ("b", 3, "g3", "p0", "f1", True, False, 0), ("b", 4, "g4", None, "f1", False, False, 0)]
    want = [(1, "s", False, "g1", True), (2, "s", False, "g1", False), (3, "g3", True, "g3", True), (4, "g3", False, None, False)]
    for size in (1, 2, 5):
        batches = (pd.DataFrame(rows[k : k + size], columns=columns) for k in range(0, len(rows), size))
        assert [tuple(r) for b in folded(batches) for r in b.itertuples(index=False)] == want
    links = spark.createDataFrame([("x", "alone"), ("y", "k"), ("z", "k")], "node string, key string")
    assert {r.node: r.component for r in components(links).collect()} == {"x": "x", "y": "y", "z": "y"}
    assert {r.node: r.component for r in components(links.filter("node = 'x'")).collect()} == {"x": "x"}
