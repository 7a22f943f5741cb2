"""Provider messages (JSON text) to rows: envelopes, permissive decoding, and the two message kinds normalised with built-in functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions import expressions as x

#: Where a nested field may lie, in order of looking.
NESTED = ("payload", "basic", "detail", "det", "ext", "location", "mileage", "module")
#: Names of an envelope's list of rows.
LISTS = ("list", "rows", "result", "items", "dataList")


MAP = "map<string, string>"
OBJECTS = (*NESTED, "driver")


def opened(rows: DataFrame, keep: Iterable[str], deep: Iterable[str] = NESTED) -> DataFrame:
    """Adds body's fields as maps, for at() and pick() to look in: those at the top, of the nested objects, and of objects inside the deep ones.
    A text is parsed once for each level, however many fields are looked for."""
    maps = ", ".join(f"{n}: {MAP}" for n in OBJECTS)
    inner = ", ".join(f"{n}: struct<{maps}>" for n in deep)
    b = F.col("body")
    levels = {"_o1": MAP, "_o2": f"struct<{maps}>"} | ({"_o3": f"struct<{inner}>"} if inner else {})
    return picked(rows, {"body": b} | {k: F.from_json(b, schema) for k, schema in levels.items()}, keep)


def at(*paths: str) -> Column:
    """The first non-empty value of paths in opened() rows; one that isn't in their maps is looked for in body itself."""

    def one(path: str) -> Column:
        *objects, name = path.split(".")
        if len(objects) > 2 or not set(objects) <= set(OBJECTS):
            return F.get_json_object("body", f"$.{path}")
        return F.element_at(F.col(".".join([f"_o{len(objects) + 1}", *objects])), F.lit(name))

    return x.first_non_empty(*[one(p) for p in paths])


def pick(*keys: str) -> Column:
    """The first non-empty of keys at the top, else the same in each nested object, one level down."""
    return at(*keys, *[f"{n}.{k}" for n in NESTED for k in keys])


def picked(rows: DataFrame, fields: dict[str, Column], keep: Iterable[str] = ()) -> DataFrame:
    """The kept columns and the given fields. Filters and columns made from the fields refer to them: as an inlined struct of one, they are
    never put in place of their names, so each expression stands in the plan, and is worked out for a row, once."""
    plain = rows.select(*[F.col(k) for k in keep], *[v.alias(f"_p_{k}") for k, v in fields.items()])
    return plain.select(*[F.col(k) for k in keep], F.inline(F.array(F.struct(*[F.col(f"_p_{k}").alias(k) for k in fields]))))


def decoded(messages: DataFrame, column: str = "value") -> DataFrame:
    """Adds body (JSON objects only) and problem: raw_text for what isn't JSON, non_object for other JSON; nothing fails or is dropped."""
    told = picked(messages, {"_told": F.col(column), "_json": F.expr(f"try_parse_json({column})").isNotNull()}, messages.columns)
    is_object = F.trim("_told").startswith("{") & F.col("_json")
    problem = F.when(~F.col("_json"), "raw_text").when(~is_object, "non_object")
    return told.withColumns({"problem": problem, "body": F.when(is_object, F.col("_told"))}).drop("_told", "_json")


def envelope_rows(replies: DataFrame, column: str = "value") -> DataFrame:
    """One row for each object in a reply's list: under data, in the first non-empty list by name, or one level deeper. Others are dropped."""
    arrays = [f"$.data.{n}" for n in LISTS] + [f"$.data.{n}.{m}" for n in LISTS for m in LISTS if m != "result"]
    found = F.coalesce(*[F.nullif(F.when(F.get_json_object(column, a).startswith("["), F.get_json_object(column, a)), F.lit("[]")) for a in arrays])
    items = F.from_json(F.coalesce(found, F.lit("[]")), "array<variant>")
    out = replies.withColumn("value", F.explode(items)).withColumn("value", F.to_json("value"))
    return out.filter(F.col("value").startswith("{"))


def device_id() -> Column:
    return F.nullif(F.trim(at("deviceID", "deviceno", "deviceid")), F.lit(""))


def normalize_status(messages: DataFrame, zone: str, column: str = "value") -> DataFrame:
    """Status messages to device rows; those without device or readable time are left out (see rejected())."""
    b = F.col("body")
    fields = {
        "device_id": device_id(), "raw_event_time": F.coalesce(pick("dtu"), at("location.dtu"), at("ext.reportTime")), "_total": at("mileage.total"), "_day": at("mileage.todayDay"),
        "_plate": at("plateNo", "plateno", "ext.deviceName", "ext.devicename"), "fleet_id": pick("fleetID", "fleetId", "fleetid"), "driver_name": at("driver.name", "driver.drivername"), "raw_payload": b,
    }
    others = [c for c in messages.columns if c != column]
    rows = picked(opened(decoded(messages, column).filter("body is not null"), others, ()), fields, others).select(
        *[F.col(c) for c in others],
        "device_id", x.parse_time(F.col("raw_event_time"), zone).alias("observed_at"), x.distance_km(x.clean_string(F.col("_total"))).alias("total_km"), x.distance_km(x.clean_string(F.col("_day"))).alias("day_km"), x.plate_label(F.col("_plate")).alias("plate_no"),
        "fleet_id", "driver_name", "raw_event_time", x.clean_string(F.col("_total")).alias("raw_total_value"), x.clean_string(F.col("_day")).alias("raw_day_value"), "raw_payload",
    )
    return rows.filter("device_id is not null and observed_at is not null")


def normalize_alarm(messages: DataFrame, zone: str, column: str = "value") -> DataFrame:
    """Alarm messages of both shapes: live ones nest their detail under payload.det, historical ones are flat. A missing id becomes the event key."""
    b = F.col("body")
    both = lambda *keys: at(*[p for k in keys for p in (f"payload.{k}", k)])
    live = F.get_json_object(b, "$.payload.det").isNotNull() | F.get_json_object(b, "$.det").isNotNull()
    number = lambda c: x.clean_string(c).try_cast("double")
    # each field is picked once, as a column of its own: what is worked out from it refers to the column
    fields = {
        "_live": live, "_said": both("alarmTypeValue", "alarmType", "alarmtypeValue", "alarmName", "typeName", "name"), "_said_in": both("alarmDetail"), "_sub": both("det.tp", "tp"), "_sub_in": both("alarmvalue", "alarmDetail"), "_ec": both("ec", "alarmtype", "alarmType"), "_category": both("category"), "_detail": at("payload.detail.category", "detail.category"),
        "_live_time": at("payload.dtu", "payload.st", "location.dtu", "dtu", "st"), "_told_time": both("endTime", "startTime", "reportTime"), "_st": both("st"), "_et": both("et"), "_start": both("startTime", "endTime"), "_end": both("endTime", "reportTime"), "_gps": both("alarmGps"),
        "_lat": at("location.latitude"), "_lon": at("location.longitude"), "given_guid": at("alarmID", "guid", "payload.uuid", "uuid"), "device_id": device_id(), "plate_no": both("plateNo", "plateno"), "fleet_id": pick("fleetID", "fleetId", "fleetid"),
        "driver_name": both("drname", "driverName", "drivername"), "_km": both("totalMileage", "mileage.total"), "raw_payload": b,
    }
    others = [k for k in messages.columns if k != column]
    found = picked(opened(decoded(messages, column).filter("body is not null"), others, ("payload",)), fields, others)
    inside = lambda c, pattern: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), pattern, 1), F.lit(""))
    found = found.withColumns({
        "_text": F.coalesce(x.clean_string(F.col("_said")), inside("_said_in", r"(?i)type\s*:\s*([^;]+)")), "_tp": F.coalesce(x.clean_string(F.col("_sub")), inside("_sub_in", r"tp:(\d+)")), "_code": x.clean_string(F.col("_ec")),
    })
    live, text, tp, code = (F.col(c) for c in ("_live", "_text", "_tp", "_code"))
    time = F.when(live, F.col("_live_time")).otherwise(F.col("_told_time"))
    gps = F.split(F.coalesce("_gps", F.lit("")), ",", 2)
    stamp = lambda live_at, other: x.parse_time(F.when(live, F.col(live_at)).otherwise(F.col(other)), zone)
    rows = found.select(
        *[F.col(k) for k in messages.columns if k != column],
        "given_guid", "device_id", x.parse_time(time, zone).alias("occurred_at"), stamp("_st", "_start").alias("start_at"), stamp("_et", "_end").alias("end_at"), x.classify(text, tp, code, F.col("_category"), F.col("_detail")).alias("_c"),
        F.when(live, F.coalesce(tp, text)).otherwise(F.coalesce(text, tp)).alias("subtype"), text.alias("raw_alarm_type"), tp.alias("raw_tp"), code.alias("raw_event_code"),
        x.plate_label(F.col("plate_no")).alias("plate_no"), "fleet_id", "driver_name",
        F.when(live, number(F.col("_lat"))).otherwise(number(F.get(gps, 1))).alias("latitude"), F.when(live, number(F.col("_lon"))).otherwise(number(F.get(gps, 0))).alias("longitude"),
        x.distance_km(x.clean_string(F.col("_km"))).alias("total_mileage_km"), time.alias("raw_event_time"), "raw_payload",
    ).filter("device_id is not null and occurred_at is not null")
    none = F.lit(None).cast("string")
    key = x.event_key(none, F.col("device_id"), F.col("_c.category"), F.col("raw_alarm_type"), F.col("raw_tp"), F.col("raw_event_code"), F.col("occurred_at"), F.col("start_at"), F.col("end_at"))
    rows = rows.withColumns({"category": F.col("_c.category"), "mapping_source": F.col("_c.source"), "classification_status": F.col("_c.status"), "provider_event_key": key})
    shown = F.when(F.col("classification_status") == "classified_dms", "visible").when(F.col("classification_status") == "classified_non_dms", "non_dms_hidden").otherwise("unmapped_hidden")
    return rows.withColumns({"guid": F.coalesce("given_guid", "provider_event_key"), "visibility_status": shown}).drop("_c", "given_guid")


def rejected(messages: DataFrame, zone: str, time_paths: Iterable[str], column: str = "value") -> DataFrame:
    """The quarantine: messages that can't become rows, each with its reason."""
    keep = [*messages.columns, "problem"]
    rows = picked(opened(decoded(messages, column), keep), {"_device": device_id(), "_time": at(*time_paths)}, keep)
    reason = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("_device").isNull(), "missing_device").when(x.parse_time(F.col("_time"), zone).isNull(), "bad_time")
    return rows.withColumn("reason", reason).filter("reason is not null").drop("_device", "_time", "problem")


def pick_deep(*keys: str) -> Column:
    """The first non-empty of keys at the top of opened() rows, else in each nested object, one level down and then two, in their fixed order."""
    two = [f"{a}.{b}.{k}" for a in NESTED for b in NESTED if a != b for k in keys]
    return x.first_non_empty(pick(*keys), at(*two))


#: What the provider's action codes mean.
ACTIONS = {"80000": "login", "80001": "subscribe", "80003": "status", "80004": "alarm", "80009": "heartbeat"}


def by_action(messages: DataFrame, column: str = "value") -> DataFrame:
    """Adds kind: what a live message is by its action code. Status and alarm messages whose payload is no object are wrong_shape, other codes
    unknown, and what is no JSON object keeps its problem."""
    rows = decoded(messages, column)
    action = F.get_json_object("body", "$.action")
    kind = F.coalesce(x.mapped(ACTIONS, action), F.lit("unknown"))
    payload = F.coalesce(F.get_json_object("body", "$.payload").startswith("{"), F.lit(False))
    return rows.withColumn("kind", F.when(F.col("problem").isNotNull(), F.col("problem")).when(kind.isin("status", "alarm") & ~payload, "wrong_shape").otherwise(kind)).drop("body", "problem")
