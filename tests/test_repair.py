"""Odometer repair against a plain loop; purges."""

import os
import random
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from haulmark.operators.purge import purge, purge_tenant
from haulmark.operators.repair import repaired
from haulmark.sources.versions import TableStore

END = date(2024, 3, 1)


def one(x):
    return x.quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)


def valid(day, total):
    return day is not None and 0 <= day <= 1000 and (total is None or day <= total + Decimal("0.1"))


def plain(snapshots, alarms, devices):
    derived, latest, out = {}, {}, []
    by = {}
    for dev, day, total in alarms:
        if total is not None:
            by.setdefault(dev, {}).setdefault(day, []).append(total)
    for dev, days in by.items():
        before = None
        for day in sorted(days):
            hi, lo = max(days[day]), min(days[day])
            km = hi - lo
            if km <= 0 and before is not None and hi >= before:
                km = hi - before
            derived[dev, day] = one(km)
            before = latest[dev] = hi
    for dev in {s[0] for s in snapshots}:
        previous = None
        for _, day, at, total, km in sorted((s for s in snapshots if s[0] == dev), key=lambda s: (s[1], s[2])):
            norm = latest.get(dev, total) if day == END else total
            cand = derived.get((dev, day), km)
            if valid(cand, norm):
                fixed = one(cand)
            elif norm is not None and previous is not None and norm >= previous and valid(norm - previous, norm):
                fixed = one(norm - previous)
            else:
                fixed = None
            reason = None if fixed is not None else "day_gt_total"
            last = devices.get(dev)
            if day == END and last and valid(last[1], last[0]):
                fixed, reason, norm = one(last[1]), None, last[0] if last[0] is not None else norm
            changed = (norm is not None and norm != total) or fixed != km
            out.append((dev, day, at, norm if norm is not None else total, fixed, "valid" if reason is None else "invalid", reason, "normalized_from_raw_payload" if changed else None))
            previous = norm if norm is not None else previous
    return sorted(out, key=str)


@pytest.mark.parametrize("block_days", [1, 7, 1000])
def test_repair_like_a_loop(spark, block_days):
    g = random.Random(block_days)
    km = lambda a, b: Decimal(g.randrange(a, b)) / 100
    snapshots, alarms, devices = [], [], {}
    for k in range(6):
        dev, total = f"D{k}", km(0, 100_000)
        for n in range(60):
            day = END - timedelta(days=59 - n)
            total += km(-2000, 40_000) if g.random() < 0.8 else km(0, 300_000)
            if g.random() < 0.75 or n == 59:
                snapshots.append((dev, day, datetime(2024, 1, 1) + timedelta(days=n, seconds=g.randrange(9999)), None if g.random() < 0.25 else max(total, Decimal(0)), None if g.random() < 0.4 else km(-500, 120_000)))
            for _ in range(g.choice([0, 0, 1, 1, 3]) if k else 0):
                alarms.append((dev, day, None if g.random() < 0.1 else max(total + km(-500, 500), Decimal(0))))
        if k % 3:
            devices[dev] = (None if k == 2 else total, km(-100, 90_000))
    two = "decimal(12,2)"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = repaired(
        frame(snapshots, f"device_id string, day date, observed_at timestamp, total_km {two}, day_km {two}"), frame(alarms, f"device_id string, day date, total_km {two}"), frame([(d, *v) for d, v in devices.items()], f"device_id string, last_total_km {two}, last_day_km {two}"), END, block_days
    )
    norm = lambda rows: sorted(([str(x) if not isinstance(x, Decimal) else str(x.quantize(Decimal("0.01"))) for x in r] for r in rows), key=str)
    assert norm(tuple(r) for r in got.collect()) == norm(plain(snapshots, alarms, devices))
    assert repaired(*[f.limit(0) for f in (frame(snapshots, f"device_id string, day date, observed_at timestamp, total_km {two}, day_km {two}"), frame(alarms, f"device_id string, day date, total_km {two}"))], frame([("x", None, None)], f"device_id string, last_total_km {two}, last_day_km {two}"), END).count() == 0


def test_purges_leave_other_files_alone(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "D1", "F1"), ("b", "D2", "F2"), ("b", "D3", None), (None, "D4", "F2"), ("c", None, None)], "company_slug string, device_id string, fleet_id string")
    t = store.begin()
    t.append("one", rows)
    t.append("two", rows.select("device_id"))
    t.commit()
    before = {p: os.stat(p).st_mtime_ns for p in Path(tmp_path, "data").rglob("*.parquet")}
    company = spark.createDataFrame([("b", ["D1"], ["F2"])], "slug string, device_ids array<string>, fleet_ids array<string>")
    assert purge_tenant(store, company, "b", ["one", "two"]) == {"one": 4, "two": 1}
    assert [r.company_slug for r in store.read("one").collect()] == ["c"]
    assert sorted(str(r.device_id) for r in store.read("two").collect()) == ["D2", "D3", "D4", "None"]
    assert store.read("one", 1).count() == 5
    version = store.version()
    assert purge_tenant(store, company, "b", ["one", "two"]) == {"one": 0, "two": 0} and store.version() == version
    assert purge(store, {"two": F.col("device_id") == "D4"}) == {"two": 1}
    assert all(os.stat(p).st_mtime_ns == at for p, at in before.items())
