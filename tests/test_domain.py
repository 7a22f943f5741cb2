"""Expressions, operators, sources and streams against plain versions and fixed cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from haulmark.functions import expressions as x
from haulmark.operators import upserts
from haulmark.operators.asof import latest_unconsumed, nearest
from haulmark.operators.sessions import sessionize
from haulmark.operators.tenants import members
from haulmark.plans.episodes import verdict
from haulmark.plans.mileage import daily_distance
from haulmark.sources import messages, synthetic, tables
from haulmark.streaming import cuts

T0 = dt.datetime(2024, 1, 5, 8)
m = lambda n: T0 + dt.timedelta(minutes=n)


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("ABC123", "ABC123"), ("AA0999", "AAO999"), (" abc-123 ", "ABC123"), ("12345678", "12345678"), ("", None), (None, None), ("--", None), ("AB123", "AB123"), ("0A0123", "OAO123")])
def test_plate(spark, raw, want):
    assert one(spark, x.plate_label(F.lit(raw).cast("string"))) == want


def test_canonical_plate(spark):
    c = lambda device, *plates: one(spark, x.canonical_plate(F.lit(device), *[F.lit(p).cast("string") for p in plates]))
    assert c("D1", "99999999", "abc123") == "ABC123" and c("D1", "unit 7", None) == "UNIT7" and c("D1", "99999999") == "D1" and c("", "99999999") == "99999999"


@pytest.mark.parametrize(("raw", "want"), [("1704441600", T0), ("1704441600000", T0), ("2024-01-05 03:00:00", T0), ("2024/01/05 03:00:00", T0), ("2024-01-05T03:00:00", T0), ("2024-01-05T08:00:00Z", T0), ("2024-01-05T03:00:00-05:00", T0), ("12", None), ("soon", None), ("", None), ("2024-13-45 00:00:00", None)])
def test_parse_time(spark, raw, want):
    assert one(spark, x.parse_time(F.lit(raw), "America/Bogota")) == want


@pytest.mark.parametrize(("raw", "want"), [("1500300", 1500.3), ("12.0", 12.0), ("1,500.55", 1500.6), ("-", None), ("abc", None), ("-2000", -2.0)])
def test_distance(spark, raw, want):
    assert one(spark, x.distance_km(x.clean_string(F.lit(raw)))) == want


def test_classify(spark):
    c = lambda *a: tuple(one(spark, x.classify(*[F.lit(v).cast("string") for v in a])))
    assert c(" YAWN ", None, None) == ("Bostezo", "text_alarm_type", "classified_dms")
    assert c(None, "68", None) == ("Uso de celular", "subtype_map", "classified_dms")
    assert c(None, "17", "124") == ("Riesgo de colision", "subtype_map", "classified_dms")
    assert c(None, None, "124") == ("Distraccion", "event_code_map", "classified_dms")
    assert c(None, None, None, "smoking") == ("Fumando", "payload_category", "classified_dms")
    assert c(None, "yawn", None) == ("Bostezo", "historical_equivalent", "classified_dms")
    assert c("eye lost", None, None) == ("Sin clasificar", "dms_like_unmapped", "unmapped")
    assert c("speeding", "eye", None) == ("No DMS", "non_dms_text", "classified_non_dms")
    assert c(None, None, None) == ("Sin clasificar", "unclassified", "unmapped")


def test_small_expressions(spark):
    for hour, want in ((21, False), (22, True), (23, True), (4, True), (5, False)):
        assert one(spark, x.is_night(F.lit(hour))) == want
    assert one(spark, x.is_night(F.lit(9), 8, 8)) and one(spark, x.is_night(F.lit(9), 8, 10)) and not one(spark, x.is_night(F.lit(10), 8, 10))
    for km, want in ((-1.0, False), (0.0, True), (1000.0, True), (1000.1, False), (None, False)):
        assert one(spark, x.valid_distance(F.lit(km).cast("double"), F.lit(5000.0))) == want
    assert not one(spark, x.valid_distance(F.lit(10.2), F.lit(10.0))) and one(spark, x.valid_distance(F.lit(10.1), F.lit(10.0)))
    assert one(spark, x.company_slug(F.lit("  Acme__ S.A. -x "))) == "acme-sa-x" and one(spark, x.company_slug(F.lit(None).cast("string"))) == ""
    assert one(spark, x.add_reason(F.lit("a,b"), F.lit("a"))) == "a,b" and one(spark, x.add_reason(F.lit(None).cast("string"), F.lit("z"))) == "z"
    assert [one(spark, x.feed_status(F.lit(v).cast("int"))) for v in (19, 20, 45, None)] == ["online", "delayed", "stopped", "no_data"]
    assert one(spark, x.in_future(F.lit(m(5)), F.lit(m(0)))) is False and one(spark, x.in_future(F.lit(m(6)), F.lit(m(0)))) is True


def test_membership(spark):
    c = spark.createDataFrame([("d", ["A"], [], 0), ("f", [], ["X"], 1), ("both", ["A"], ["X"], 2), ("none", [], [], 3)], "slug string, device_ids array<string>, fleet_ids array<string>, position int")
    rows = spark.createDataFrame([("A", "Y"), ("B", "X"), (None, "X"), ("", ""), (None, None)], "device_id string, fleet_id string")
    got = {}
    for r in members(rows, c).collect():
        got.setdefault((r.device_id, r.fleet_id), set()).add(r.slug)
    assert got == {("A", "Y"): {"d", "both", "none"}, ("B", "X"): {"f", "none"}, (None, "X"): {"f", "both", "none"}, ("", ""): {"none"}, (None, None): {"none"}}


def test_sessions_join_exact_gaps(spark):
    rows = [("p", m(t), i) for i, t in enumerate([0, 15, 30, 45.01, 100, 1440, 1450])]
    got = sessionize(spark.createDataFrame(rows, "plate string, at timestamp, id int"), ["plate"], "at", F.lit(15), "id").orderBy("id").collect()
    assert [r.session_no for r in got] == [1, 1, 1, 2, 3, 4, 4]


def test_fatigue_fold(spark):
    r = random.Random(1)
    rows = []
    for plate in ("a", "b", "c"):
        t = 0
        for i in range(40):
            t += r.randint(0, 50)
            rows.append((plate, f"{plate}{i:02d}", r.choice(["give", "take"]), m(t), m(t + r.randint(0, 20))))
    want = []
    for plate in ("a", "b", "c"):
        used = set()
        own = sorted([x for x in rows if x[0] == plate], key=lambda x: (x[3], x[1]))
        for i, (_, sid, kind, start, _) in enumerate(own):
            if kind == "take":
                fit = [y for y in own[:i] if y[2] == "give" and y[1] not in used and y[4] < start and start - y[4] <= dt.timedelta(minutes=60)]
                if fit:
                    used.add(fit[-1][1])
                    want.append((plate, sid, fit[-1][1]))
    got = latest_unconsumed(spark.createDataFrame(rows, "plate string, session_id string, kind string, start_at timestamp, end_at timestamp"), ["plate"], 60)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    edge = [("z", "y", "give", m(0), m(10)), ("z", "e", "take", m(10), m(11)), ("z", "f", "take", m(70), m(71))]
    got = latest_unconsumed(spark.createDataFrame(edge, "plate string, session_id string, kind string, start_at timestamp, end_at timestamp"), ["plate"], 60).collect()
    assert [tuple(r) for r in got] == [("z", "f", "y")]  # ends exactly at the start: not merged; sixty minutes later: merged


def test_verdict(spark):
    rows = [("Ojos cerrados", 1, False, 1.0, 1), ("Ojos cerrados", 1, True, 1.0, 1), ("Ojos cerrados", 2, False, 1.0, 1), ("Distraccion", 5, False, 2.99, 1), ("Distraccion", 5, False, 3.0, 1), ("Bostezo", 1, False, 1.0, 20), ("Bostezo", 1, False, 1.0, 21), ("Ojos cerrados", 1, False, 1.0, 21)]
    s, reason = verdict(F.lit(False))
    got = [tuple(r) for r in spark.createDataFrame(rows, "category string, n int, approved boolean, deviation double, same_day int").select(s, reason).collect()]
    assert got == [("suppressed_by_rule", "single_eye_closed"), ("visible_episode", "manual_approved"), ("visible_episode", "visible"), ("suppressed_by_rule", "distraction_below_3x"), ("visible_episode", "visible"), ("visible_episode", "visible"), ("visible_episode", "anti_noise_daily_cap"), ("suppressed_by_rule", "single_eye_closed")]


def test_nearest(spark):
    left = spark.createDataFrame([("l1", "d", m(0)), ("l2", "d", m(10)), ("l3", "e", m(0))], "lid string, dev string, a timestamp")
    right = spark.createDataFrame([("r1", "d", m(2)), ("r2", "d", m(-1.5)), ("r3", "d", m(12.02)), ("r4", "d", m(1.5))], "rid string, dev string, b timestamp")
    got = {r.lid: (r.rid, r.delta_seconds) for r in nearest(left, right, ["dev"], "a", "b", 120, "lid", F.col("rid")).collect()}
    assert got == {"l1": ("r2", 90.0)}
    assert {r.lid for r in nearest(left, right, ["dev"], "a", "b", 122, "lid", F.col("rid")).collect()} == {"l1", "l2"}


def test_daily_distance(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("d", "p", day(1), 100.0, None), ("d", "p", day(2), 150.0, None), ("d", "p", day(3), 150.0, 20.0), ("d", "p", day(4), 140.0, None), ("d", "p", day(5), 3000.0, None), ("d", "p", day(6), 3001.0, 1000.1), ("e", "q", day(6), -5.0, -1.0)]
    got = daily_distance(spark.createDataFrame(rows, "device_id string, plate string, day date, total_km double, day_km double")).orderBy("device_id", "day").collect()
    assert [float(r.km) for r in got] == [0, 50, 20, 0, 2860, 1, 0]


def test_first_by_any_key(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, r.choice([None, *"pqrst"]) , r.choice([None, *"uvwxyz"])) for i in range(80)]
    got = {x.id: x.is_duplicate for x in upserts.first_by_any_key(spark.createDataFrame(rows, "dev string, id int, k1 string, k2 string"), "dev", "id", ["k1", "k2"]).collect()}
    for dev in "ab":
        seen = set()
        for d, i, *keys in rows:
            if d == dev:
                own = {(n, k) for n, k in enumerate(keys) if k is not None}
                assert got[i] == bool(own & seen)
                seen |= set() if own & seen else own


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1, T0), ("b", 2, T0)], "k string, v int, t timestamp")
    new = spark.createDataFrame([("b", 3, m(1)), ("b", 4, m(2)), ("c", None, m(1))], "k string, v int, t timestamp")
    once = upserts.keep_latest(old, new, ["k"], F.col("t"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upserts.keep_latest(once, new, ["k"], F.col("t")).collect())) == [("a", 1, T0), ("b", 4, m(2)), ("c", None, m(1))]
    merged = upserts.merge_fields(old, spark.createDataFrame([("b", None, m(-9))], "k string, v int, t timestamp"), ["k"], ("t",))
    assert sorted(map(tuple, merged.collect())) == [("a", 1, T0), ("b", 2, T0)]
    audit = spark.createDataFrame([("g", "s"), (None, "s")], "guid string, stage string")
    more = spark.createDataFrame([("g", "s"), ("h", "s"), ("h", "s"), (None, "s")], "guid string, stage string")
    assert upserts.insert_if_absent(audit, more, ["guid", "stage"], "guid").count() == 2


LIVE = {"deviceID": "D1", "payload": {"uuid": "g1", "ec": "121", "st": "2024-01-05 03:00:00", "et": "2024-01-05 03:00:04", "det": {"tp": "65"}}, "location": {"latitude": "4.6", "longitude": "-74.1"}}
PAST = {"alarmID": "g2", "deviceID": "D1", "plateNo": "abc-123", "alarmTypeValue": "Yawning", "alarmType": "122", "startTime": "2024-01-05 03:10:00", "endTime": "2024-01-05 03:10:03", "reportTime": "2024-01-05 08:10:03", "alarmGps": "-74.1,4.6", "totalMileage": 1500900}
STATUS = {"deviceID": "D1", "fleetId": "F1", "dtu": "2024-01-05 03:00:00", "mileage": {"total": 1500300, "todayDay": 42100}, "driver": {"name": "n"}, "ext": {"deviceName": "ABC123"}}


def test_messages(spark):
    texts = [json.dumps(LIVE), json.dumps(PAST), json.dumps(PAST | {"alarmID": ""}), "not json", "[1]", None, "{}", json.dumps(LIVE | {"payload": {"det": {"tp": "65"}, "st": "never"}})]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string")
    got = {r.n: r for r in messages.normalize_alarm(df, "America/Bogota").collect()}
    assert set(got) == {0, 1, 2}
    assert (got[0].guid, got[0].category, got[0].occurred_at, got[0].latitude, got[0].longitude, got[0].subtype, got[0].visibility_status) == ("g1", "Ojos cerrados", T0, 4.6, -74.1, "65", "visible")
    assert (got[1].guid, got[1].category, got[1].plate_no, got[1].latitude, got[1].longitude, got[1].total_mileage_km, got[1].raw_event_code) == ("g2", "Bostezo", "ABC123", 4.6, -74.1, 1500.9, "122")
    assert got[1].occurred_at == T0 + dt.timedelta(minutes=10, seconds=3) and got[2].guid == got[2].provider_event_key == got[1].provider_event_key
    why = {r.n: r.reason for r in messages.rejected(df, "America/Bogota", ["payload.st", "endTime"]).collect()}
    assert why == {3: "raw_text", 4: "non_object", 5: "raw_text", 6: "missing_device", 7: "bad_time"}
    s = messages.normalize_status(spark.createDataFrame([(json.dumps(STATUS),), ("x",)], "value string"), "America/Bogota").collect()
    assert len(s) == 1 and (s[0].device_id, s[0].total_km, s[0].day_km, s[0].fleet_id, s[0].driver_name, s[0].plate_no, s[0].observed_at) == ("D1", 1500.3, 42.1, "F1", "n", "ABC123", T0)


def test_envelopes(spark):
    replies = [{"data": {"list": [], "rows": [{"a": 1}, 5, {"a": 2}]}}, {"data": {"result": {"items": [{"a": 3}]}}}, {"data": {}}, {}]
    got = messages.envelope_rows(spark.createDataFrame([(json.dumps(r),) for r in replies], "value string")).collect()
    assert sorted(json.loads(r.value)["a"] for r in got) == [1, 2, 3]


def test_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"slug": "a", "name": "A", "device_ids": ["2", "1", "1", " "]}, {"slug": "b", "name": "B"}, 5]))
    rows = spark.createDataFrame([("b", "B2")], "slug string, name string")
    got = {r.slug: (r.name, r.device_ids) for r in tables.company_config(spark, str(tmp_path / "c.json"), rows).collect()}
    assert got == {"a": ("A", ["1", "2"]), "b": ("B2", [])}
    ev = spark.createDataFrame([("a", "2024-01-01", "d", T0), ("a", "2024-01-02", "d", T0)], "company_slug string, day string, device_id string, occurred_at timestamp")
    for _ in range(2):  # rewriting the same days changes nothing
        tables.write_events(ev, str(tmp_path / "ev"))
    tables.write_events(ev.filter("day = '2024-01-02'"), str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 2
    (tmp_path / "pdf/acme/2024").mkdir(parents=True)
    (tmp_path / "pdf/acme/2024/01.pdf").write_bytes(b"x")
    (tmp_path / "pdf/acme/2024/02.pdf").write_bytes(b"xy")
    assert [(r.company, r.year, r.month, r.bytes) for r in tables.closed_months(tables.reports(spark, str(tmp_path / "pdf")), 2024, 2).collect()] == [("acme", 2024, 1, 1)]


def test_generator(spark):
    days = synthetic.fleet_days(spark)
    n, k = days.count(), synthetic.fleet_alarms(days).count()
    assert 38 * 36 * 0.8 < n < 38 * 36 * 0.92 and 2 * n < k < 3 * n and days.filter("day_km not between 22 and 128").isEmpty()
    assert synthetic.fleet_days(spark).exceptAll(days).isEmpty()


def test_status_state(spark, tmp_path):
    rows = [("d", m(i), i, t) for i, t in enumerate([10.0, 12.0, 11.0, 11.95, 20.0, 5.0])]
    spark.createDataFrame(rows, "device_id string, observed_at timestamp, event_id int, total_km double").coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema("device_id string, observed_at timestamp, event_id int, total_km double").parquet(str(tmp_path / "r"))
    seen = []
    cuts.status_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in seen] == [("d", 4, 2, 20.0)]


def test_publish_guard(spark):
    old = spark.createDataFrame([("a", m(30)), ("b", m(0))], "company_slug string, cut_at timestamp")
    new = spark.createDataFrame([("a", m(15)), ("b", m(15)), ("c", m(0))], "company_slug string, cut_at timestamp")
    assert sorted(map(tuple, cuts.publish_guard(old, new).collect())) == [("a", m(30)), ("b", m(15)), ("c", m(0))]


def test_catch_up_planner():
    from haulmark.streaming.planner import Limits, Progress, backoff, due_cuts, next_range

    at = lambda day, h, mi: dt.datetime(2026, 8, day, h, mi, tzinfo=dt.UTC)
    now, limits = at(16, 3, 15), Limits()
    assert next_range(now, Progress(at(16, 3, 5)), limits) == (at(16, 2, 55), now, 0)
    assert next_range(now, Progress(at(16, 0, 0)), limits) == (at(15, 23, 50), at(16, 0, 10), 0)
    assert next_range(now, Progress(at(16, 2, 50), (at(16, 3, 0), at(16, 3, 25)), 17), limits) == (at(16, 3, 0), at(16, 3, 20), 17)
    assert next_range(now, Progress(at(16, 3, 5), retry_at=at(16, 3, 20)), limits) is None
    assert next_range(now, Progress(), limits) == (at(15, 21, 15), at(15, 21, 35), 0)
    assert next_range(now, Progress(at(16, 0, 0)), limits, refusals=5) == (at(15, 23, 50), at(16, 0, 0), 0)
    assert [backoff(k).seconds for k in (0, 1, 9)] == [5, 10, 300]
    assert due_cuts(at(16, 2, 15), now) == [at(16, 2, 30), at(16, 2, 45), at(16, 3, 0)] and due_cuts(None, now) == [at(16, 3, 0)] and due_cuts(at(16, 3, 0), now) == []
    assert len(due_cuts(at(15, 0, 0), now)) == 4


def test_snapshot_adds_up(spark):
    from haulmark.plans.history import snapshot_full
    from haulmark.sources.domain import month

    sf = "/root/testdata/sf0.001"
    want = {r.company_slug: r["count"] for r in month(spark, sf).groupBy("company_slug").count().collect()}
    for r in snapshot_full(spark, sf).collect():
        s = json.loads(r.snapshot_json)
        assert s["alarms"] == want[r.company_slug] == sum(x["n"] for x in s["series"]) == sum(x["n"] for x in s["hours"])
        assert [x["place"] for x in s["top"]] == list(range(1, min(8, s["vehicles"]) + 1))


def test_normalising_works_each_field_out_once(spark):
    """Filters on fields of messages must not put the fields' expressions, and the messages' own, in place of their names."""
    from haulmark.plans.catalog import QUERIES

    for name in ("normalized_statuses", "normalized_alarms", "rejected_messages"):
        plan = QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        made = [str(p) for p in plan.toString().splitlines() if "StructsToJsonEvaluator" in p]
        assert len(made) == 1 and plan.treeString().count("StructsToJsonEvaluator") <= 8, name


def test_fields_in_odd_messages(spark):
    """An object told as a text holds no fields; numbers keep their form; of nulls, empty texts and other shapes the next place counts."""
    texts = ['{"deviceID":"D1","payload":"{\\"dtu\\":\\"x\\"}","basic":[1],"location":{"dtu":"2024-01-05 03:00:00"},"mileage":{"total":123.0,"todayDay":4e1},"fleetID":null,"ext":{"fleetid":7,"deviceName":""},"driver":"n"}', '{"deviceID":"","deviceno":"D2","dtu":1704423600,"mileage":null}']
    a, b = sorted(messages.normalize_status(spark.createDataFrame([(t,) for t in texts], "value string"), "America/Bogota").collect())
    assert (a.device_id, a.observed_at, a.total_km, a.day_km, a.fleet_id, a.plate_no, a.driver_name) == ("D1", T0, 123.0, 40.0, "7", None, None)
    assert (b.device_id, b.total_km) == ("D2", None)
