"""Status over a stream: the acceptance rule against a loop, replays, and groups that come in many chunks."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haulmark.sources import domain as d
from haulmark.sources.versions import TableStore
from haulmark.streaming.status import STATUS, accepted_totals, run_status, status_changes, store_changes

T0 = datetime.datetime(2024, 1, 5, 12)


def plain(totals, last):
    ok, after = [], []
    for t in totals:
        good = t is not None and not (last is not None and t + 0.1 < last)
        last = t if good else last
        ok.append(good)
        after.append(last)
    return ok, after


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1.05, 1.12, 5.0, 4.95, 4.88, 4.81, 9.0, 100.0])), max_size=40), st.one_of(st.none(), st.sampled_from([0.5, 5.0])))
def test_accepted_totals(totals, last):
    ok, after = accepted_totals(np.array([np.nan if t is None else t for t in totals], float), np.nan if last is None else last)
    want_ok, want_after = plain(totals, last)
    assert list(ok) == want_ok
    assert [last if np.isnan(a) else a for a in after] == want_after


def test_long_regressions():
    totals = np.concatenate([[100.0], np.arange(0, 50, 0.01), [100.0, 99.95, 99.88, 99.81]])
    ok, after = accepted_totals(totals, np.nan)
    assert list(ok) == plain(list(totals), None)[0] and after[-1] == 99.81


def row(device, seq, total, day=None, minutes=0, **more):
    at = T0 + datetime.timedelta(minutes=minutes or seq)
    base = {"plate_no": None, "fleet_id": "F1", "driver_name": None} | more
    return (device, seq, base["plate_no"], base["fleet_id"], base["driver_name"], at, at, at.date(), total, day, str(total), str(day), "t")


def landed(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, STATUS).repartition(3 if len(rows) > 3 else 1).write.parquet(f"{folder}/part={k}")
    return spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1 if max(map(len, batches)) <= 3 else 3).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)


def test_three_micro_batches_and_a_replay(spark, tmp_path):
    batches = [[row("a", 1, 10.0, 3.0, plate_no="abc123"), row("b", 2, None, 5.0)], [row("a", 3, 9.0, 2.0, plate_no=""), row("a", 4, 9.95, 50.0)], [row("b", 5, 7.0, driver_name="x")]]
    store, companies = TableStore(spark, f"{tmp_path}/store"), d.companies(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    run_status(landed(spark, f"{tmp_path}/in", batches), store, companies, f"{tmp_path}/check")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    devices = {r.device_id: r for r in store.read("device").collect()}
    a, b = devices["a"], devices["b"]
    assert (a.last_total_km, a.last_day_km, a.plate_no, a.accepted, a.regressions, a.km_validation_reason) == (9.95, 2.0, "abc123", 2, 1, "day_gt_total")
    assert (b.last_total_km, b.last_day_km, b.driver_name, b.accepted) == (7.0, 5.0, "x", 1)
    assert sorted((r.device_id, r.total_km) for r in store.read("reading").collect()) == [("a", 9.95), ("a", 10.0), ("b", 7.0)]
    assert sorted((r.device_id, r.total_km, r.day_km) for r in store.read("snapshot").collect()) == [("a", 9.95, 2.0), ("b", 7.0, 5.0)]
    assert sorted((r.device_id, r.reason) for r in store.read("anomaly").collect()) == [("a", "day_gt_total"), ("a", "total_regression")]
    version = store.version()
    changes = spark.createDataFrame([], status_changes(landed(spark, f"{tmp_path}/again", batches)).schema)
    assert not store_changes(store, changes, 1, companies) and store.version() == version


def test_chunks_of_a_group_are_ordered(spark, tmp_path):
    rows = [row("a", k, float(k if k % 7 else k - 3), minutes=k) for k in range(1, 60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        store = TableStore(spark, f"{tmp_path}/store")
        run_status(landed(spark, f"{tmp_path}/in", [rows[::-1]]), store, d.companies(spark), f"{tmp_path}/check")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    ok, after = plain([r[8] for r in rows], None)
    (device,) = store.read("device").collect()
    assert (device.accepted, device.regressions, device.last_total_km) == (sum(ok), len(ok) - sum(ok), pytest.approx(after[-1]))


def test_a_device_costs_one_state_and_no_frames():
    """A device's state is read and written once a micro-batch, and its rows come out as rows: no data frame is built for each device."""
    from pyspark.sql import Row

    from haulmark.streaming.status import StatusProcessor

    class Held:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    held, made = Held(), []

    class Handle:
        def getValueState(self, name, schema):
            made.append(name)
            return held

    processor = StatusProcessor()
    processor.init(Handle())
    one = Row(*[c.split()[0] for c in STATUS.split(",")])
    out = list(processor.handleInputRows(("a",), iter([one(*row("a", 2, 9.0, 3.0)), one(*row("a", 1, 10.0, 2.0, plate_no="p"))]), None))
    assert made == ["state"] and held.calls == 2 and held.value == (10.0, 3.0, "p", "F1", None, 1, 1)
    assert [r.kind for r in out] == ["reading", "anomaly", "device", "snapshot"] and (out[3].total_km, out[3].day_km, out[3].first_total) == (10.0, 3.0, 10.0)
