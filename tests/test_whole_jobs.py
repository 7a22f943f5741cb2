"""Queries that do the whole job, against plain loops over their own rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from haulmark.functions.values import CATEGORIES
from haulmark.operators import upserts
from haulmark.operators.asof import latest_unconsumed
from haulmark.plans.catalog import QUERIES
from haulmark.plans.ingest import keyed, resent
from haulmark.sources import domain as d
from haulmark.streaming import cuts

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return QUERIES[name][0](spark, SF).collect()


def test_every_arriving_row_is_matched(spark):
    tiers = [{}, {}, {}]
    keys = lambda r: (r.provider_key, r.guid, (r.device_id, r.category, r.tp, r.occurred_at))
    for r in keyed(d.alarms(spark, SF).filter("event_id % 5 <> 0")).collect():
        for n, (tier, key) in enumerate(zip(tiers, keys(r), strict=True)):
            if n or r.event_id % 4:
                tier[key] = min(r.guid, tier.get(key, r.guid))
    want = {}
    for r in keyed(resent(spark, SF)).collect():
        want[r.guid] = next(((n + 1, tier[key]) for n, (tier, key) in enumerate(zip(tiers, keys(r), strict=True)) if key in tier), (None, None))
    got = run(spark, "match_three_tiers_all")
    assert len(got) == len(want) and {r.guid: (r.tier, r.match) for r in got} == want


def test_categories_of_all_hours(spark):
    own = {}
    for r in d.month(spark, SF).collect():
        own.setdefault(r.company_slug, set()).add(r.category)
    assert {r.company_slug: r.shown for r in run(spark, "category_order_all")} == {k: ",".join(c for c, _, _ in CATEGORIES if c in v) for k, v in own.items()}


def test_duplicates_by_exact_time(spark, tmp_path):
    at = lambda seconds: dt.datetime(2024, 1, 5, 8) + dt.timedelta(seconds=seconds)
    times = [0, 20, 20.5, 59, 61, 61, 20, 300, 300.25]
    props = ['{"k": "1"}', '{"k": "1"}', '{"k": "1"}', None, '{"k": ""}', None, '{"k": "2"}', '{"k": "1"}', '{"k": "1"}']
    base = spark.read.parquet(f"{SF}/events.parquet")
    rows = [(i + 1, 7, "click", at(t), p) for i, (t, p) in enumerate(zip(times, props, strict=True))]
    new = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, props string")
    some = base.limit(50).select([c for c in base.columns])
    cast = new.select(*[F.col(c).cast(t).alias(c) for c, t in base.dtypes if c in new.columns])
    some.withColumn("event_id", (F.col("event_id") + 1000).cast(dict(base.dtypes)["event_id"])).unionByName(cast, allowMissingColumns=True).write.parquet(f"{tmp_path}/events.parquet")
    arriving = sorted(keyed(resent(spark, str(tmp_path))).collect(), key=lambda r: r.event_id)
    seen, want = set(), {}
    for r in arriving:
        own = {("guid", r.guid), ("key", r.provider_key), ("fuzzy", r.device_id, r.category, r.tp, r.occurred_at)}
        want[r.guid] = bool(own & seen)
        seen |= set() if want[r.guid] else own
    got = QUERIES["dedupe_three_key"][0](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.guid: r.is_duplicate for r in got} == want
    assert not any(want[f"g{i}"] for i in (1, 2, 4, 5, 7, 8)) and want["g3"] and want["g6"] and want["g9"]  # g3, g6 and g9 by the provider key: one second, null as empty


def test_status_state_over_chunks(spark, tmp_path):
    schema = "device_id string, observed_at timestamp, event_id long, total_km double"
    rows = [("hot", dt.datetime(2024, 1, 5) + dt.timedelta(minutes=i // 2), i, 10.0 * i - (15 if i % 7 == 3 else 0)) for i in range(200)]
    accepted = regressions = 0
    last = None
    for *_, total in rows:
        if last is not None and total + 0.1 < last:
            regressions += 1
        else:
            accepted, last = accepted + 1, total
    random.Random(4).shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k::5], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    seen = []
    try:
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/r")
        cuts.status_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in seen] == [("hot", accepted, regressions, last)] and regressions


def test_odometers_of_many_devices_without_a_call_each(spark, tmp_path):
    """Micro-batches in order of arrival, the readings of one in order of time, no total at times; a batch that is done again changes nothing."""
    schema = "device_id string, observed_at timestamp, event_id long, total_km double"
    r, want, parts = random.Random(6), {}, []
    for part in (1, 0, 2):  # the second one is older
        rows = [(r.choice(["a", "b", f"d{i}", None]), dt.datetime(2024, 1, 5 + part) + dt.timedelta(minutes=i // 3), 3000 * part + i, r.choice([None, float("nan"), 1.0 * i, 2.0 * i, 2.0 * i - 0.1, 3.0 * i - 40, 5.0])) for i in range(120)]
        for device, _, _, total in sorted(rows, key=lambda x: (x[1], x[2])):
            accepted, regressions, last = want.get(device, (0, 0, None))
            if last is not None and total is not None and total + 0.1 < last:
                want[device] = (accepted, regressions + 1, last)
            else:
                want[device] = (accepted + 1, regressions, total)
        parts.append(spark.createDataFrame(r.sample(rows, len(rows)), schema))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/readings")
    for k, part in enumerate(parts):
        part.repartition(3).write.parquet(f"{tmp_path}/readings/part={k}")
        cuts.run_odometers(stream(), str(tmp_path))
    cuts.run_odometers(stream(), str(tmp_path))
    got = {x.device_id: (x.accepted, x.regressions, x.last_total) for x in cuts.odometers(spark, str(tmp_path)).collect()}
    assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str)) and sum(x[1] for x in want.values()) > 20
    assert "Python" not in cuts.fold_readings(cuts.odometers(spark, str(tmp_path)), parts[0])._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_not_one_fold(spark):
    """One vehicle with all sessions: many small folds, with the result of one plain loop; duplicates without any fold."""
    at = lambda minutes: dt.datetime(2024, 1, 5) + dt.timedelta(minutes=minutes)
    r, t, rows = random.Random(5), 0, []
    for i in range(400):
        t += r.choice([1, 10, 30, 60, 61, 200])
        rows.append(("a", f"s{i:03d}", r.choice(["give", "give", "take"]), at(t), at(t + r.choice([0, 5, 90]))))
    used, want = set(), []
    for i, (plate, sid, kind, start, _) in enumerate(rows):
        fit = [y for y in rows[:i] if y[2] == "give" and y[1] not in used and y[4] < start and start - y[4] <= dt.timedelta(minutes=60)] if kind == "take" else []
        if fit:
            used.add(fit[-1][1])
            want.append((plate, sid, fit[-1][1]))
    got = latest_unconsumed(spark.createDataFrame(rows, "plate string, session_id string, kind string, start_at timestamp, end_at timestamp"), ["plate"], 60)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "_begin" in plan(got).split("FlatMapGroupsInPandas")[1].split("\n")[0]
    links = [("a", i, f"k{i // 2}", f"v{(i + 1) // 2}") for i in range(12)] + [(None, 12, "k0", None), (None, 13, "k0", "v")]
    flags = upserts.first_by_any_key(spark.createDataFrame(links, "dev string, id int, k1 string, k2 string"), "dev", "id", ["k1", "k2"])
    assert {x.id: x.is_duplicate for x in flags.collect()} == {i: i % 2 == 1 for i in range(14)}
    assert "Pandas" not in plan(flags)


def test_episodes_make_their_sessions_once(spark):
    """What sessions, pairs and yawns are read from is written once; the events are not scanned again for each."""
    plan = QUERIES["episodes"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "/episodes-" in plan


def test_a_stretch_with_one_giving_session_is_not_folded(spark):
    """A call for each stretch took most of the time: none is made where nothing competes."""
    at = lambda minutes: dt.datetime(2024, 1, 5) + dt.timedelta(minutes=minutes)
    rows = [(plate, f"{plate}{k}{n}", kind, at(200 * k + lo), at(200 * k + hi)) for plate in ("a", "b", None) for k in range(30) for n, kind, lo, hi in ((0, "give", 0, 10), (1, "take", 10, 11), (3, "take", 70, 75), (2, "take", 70, 71), (4, "take", 71, 72))]
    rows += [("c", "y", "give", None, at(5)), ("c", "z", "give", at(20), at(6)), ("c", "e", "take", at(7), None), ("c", "f", "take", at(30), None), ("c", "g", "take", None, at(31))]
    got = latest_unconsumed(spark.createDataFrame(rows, "plate string, session_id string, kind string, start_at timestamp, end_at timestamp"), ["plate"], 60)
    found = [tuple(r) for r in got.collect()]
    want = {(plate, f"{plate}{k}2", f"{plate}{k}0") for plate in ("a", "b", None) for k in range(30)} | {("c", "f", "z")}
    assert set(found) == want and len(found) == len(want)
    assert "_gives" in got._jdf.queryExecution().toString().split("FlatMapGroupsInPandas")[1]


def test_history_source_opens_only_what_is_asked_for(spark, tmp_path):
    import datetime

    from haulmark.sources.provider import EqualTo, GreaterThanOrEqual, HistoryReader, In, history

    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(f"g{k}", f"D{k % 4}", "Bostezo", "66", day(1 + k % 20), float(k)) for k in range(200)]
    spark.createDataFrame(rows, "guid string, device_id string, category string, tp string, occurred_at timestamp, value double").write.partitionBy("device_id").parquet(f"{tmp_path}/h")
    reader = HistoryReader(f"file://{tmp_path}/h")
    left = list(reader.pushFilters([In(("device_id",), ("D1", "D2", "D9")), GreaterThanOrEqual(("occurred_at",), day(15)), EqualTo(("category",), "Bostezo")]))
    assert left == [EqualTo(("category",), "Bostezo")] and [p.device for p in reader.partitions()] == ["D1", "D2"]
    df = history(spark, f"file://{tmp_path}/h")
    assert df.count() == 200
    got = {r.guid for r in df.filter("device_id = 'D1' and occurred_at >= TIMESTAMP '2024-01-15 00:00:00'").collect()}
    assert got == {g for g, dev, _, _, t, _ in rows if dev == "D1" and t >= day(15)}
    assert history(spark, f"file://{tmp_path}/none").collect() == []


def test_history_of_many_devices_is_few_files(spark, tmp_path):
    import datetime
    import glob

    from haulmark.sources.provider import HistoryReader, In, history, land_history

    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(f"g{k}", None if k == 7 else f"D{k % 300} é", "Bostezo", "66", day(1 + k % 20), float(k)) for k in range(900)]
    table = spark.createDataFrame(rows, "guid string, device_id string, category string, tp string, occurred_at timestamp, value double")
    land_history(table, f"{tmp_path}/h", 8)
    assert len(glob.glob(f"{tmp_path}/h/part=*")) == 9 and len(glob.glob(f"{tmp_path}/h/*/*.parquet")) < 40
    reader = HistoryReader(f"file://{tmp_path}/h", 8)
    assert list(reader.pushFilters([In(("device_id",), ("D1 é", "D299 é", "none"))])) == []
    assert 1 <= len({f.rsplit("/", 2)[-2] for p in reader.partitions() for f in p.files}) <= 3
    df = history(spark, f"file://{tmp_path}/h", 8)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)
    got = {r.guid for r in df.filter("device_id in ('D1 é', 'D299 é') and occurred_at >= TIMESTAMP '2024-01-15 00:00:00'").collect()}
    assert got == {g for g, dev, _, _, t, _ in rows if dev in ("D1 é", "D299 é") and t >= day(15)} and got


def test_members_like_the_rule(spark):
    from haulmark.operators.tenants import members

    companies = [("a", ["D1", "D1", "D2"], [], 0), ("b", [], ["F1"], 1), ("c", ["D3"], ["F2"], 2), ("d", [], [], 3), ("e", None, None, 4)]
    rows = [(i, dev, fleet) for i, (dev, fleet) in enumerate([("D1", "F1"), ("D1", "F1"), ("D3", "F2"), ("D9", "F2"), (None, "F2"), ("", "F1"), ("D2", None), (None, None)])]

    def belongs(dev, fleet, devs, fleets):
        devs, fleets = devs or [], fleets or []
        if devs and dev:
            return dev in devs
        if fleets and fleet:
            return fleet in fleets
        return not devs and not fleets

    got = members(spark.createDataFrame(rows, "i int, device_id string, fleet_id string"), spark.createDataFrame(companies, "slug string, device_ids array<string>, fleet_ids array<string>, position int")).collect()
    assert sorted((r.i, r.slug) for r in got) == sorted((i, s) for i, dev, fleet in rows for s, devs, fleets, _ in companies if belongs(dev, fleet, devs, fleets))


def test_update_mode_keeps_keys_of_all_batches(spark):
    from haulmark.plans.catalog import QUERIES

    got = QUERIES["stream_status_regressions"][0](spark, "/root/testdata/sf0.001").collect()
    devices = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
    assert len(got) == devices and sum(r.regressions for r in got) > 0
