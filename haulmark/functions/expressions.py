"""Scalar expressions of the domain as plain Column functions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.values import DEFAULT_SUBTYPES, DMS_STEMS, EVENT_CODES, LIVE_SUBTYPES, RULES, TEXT_CATEGORIES


def mapped(values: dict[str, str], key: Column) -> Column:
    """values[key], null for others. A literal map: nothing to join or broadcast."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.coalesce(key, F.lit("")))


def clean_string(c: Column) -> Column:
    """Trimmed; empty and '-' count as missing."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (t != "-"), t)


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def plate_label(c: Column) -> Column:
    """Upper case, letters and digits only; AA0999 and the like become AAO999; empty becomes null."""
    cleaned = F.nullif(F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", ""), F.lit(""))
    fixed = F.concat(F.translate(F.substring(cleaned, 1, 3), "0", "O"), F.substring(cleaned, 4, 3))
    return F.when(cleaned.rlike(r"^.{3}\d{3}$") & fixed.rlike(r"^\p{L}{3}\d{3}$"), fixed).otherwise(cleaned)


def is_plate(c: Column) -> Column:
    return F.coalesce(plate_label(c).rlike(r"^\p{L}{3}\d{3}$"), F.lit(False))


def canonical_plate(device: Column, *candidates: Column) -> Column:
    """The first candidate of plate shape; else the first that is neither the device id nor all digits; else the device id; else the first."""
    return canonical_label(device, *[plate_label(c) for c in candidates])


def canonical_label(device: Column, *labels: Column) -> Column:
    """canonical_plate() of candidates in normal form: each stands in the expression several times, so columns are cheaper than expressions."""
    shaped = [F.when(c.rlike(r"^\p{L}{3}\d{3}$"), c) for c in labels]
    named = [F.when((c != F.coalesce(device, F.lit(""))) & ~c.rlike(r"^\d+$"), c) for c in labels]
    return F.coalesce(*shaped, *named, F.nullif(device, F.lit("")), *labels)


def company_slug(c: Column) -> Column:
    lowered = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N} _-]", "")
    return F.regexp_replace(F.regexp_replace(lowered, r"[ _-]+", "-"), r"^-+|-+$", "")


def safe_double(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")


def distance_km(c: Column) -> Column:
    """Integer texts are metres, others kilometres; one decimal."""
    text = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(""))
    value = text.try_cast("double")
    return F.round(F.when(text.rlike(r"^-?\d+$"), value / 1000).otherwise(value), 1)


def parse_time(c: Column, zone: str = "UTC") -> Column:
    """Epoch milliseconds or seconds, ISO 8601, or local date and time in zone; null if none fits."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    local = F.coalesce(*[F.try_to_timestamp(F.when(text.rlike(shape), text), F.lit(fmt)) for shape, fmt in ((r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d$", "yyyy/MM/dd HH:mm:ss"), (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", "yyyy-MM-dd'T'HH:mm:ss"))])
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ].*(Z|[+-]\d\d:?\d\d)$"), text).try_cast("timestamp")
    return F.coalesce(F.when(number > 1e12, F.timestamp_millis(number.cast("long"))), F.when(number > 1e9, F.timestamp_seconds(number.cast("long"))), iso, F.to_utc_timestamp(local, zone))


def local_time(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def is_night(hour: Column, start: int = RULES["night_start"], end: int = RULES["night_end"]) -> Column:
    """Wraps midnight; equal bounds mean always."""
    if start < end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def in_future(occurred: Column, received: Column, minutes: int = RULES["future_minutes"]) -> Column:
    return F.coalesce(occurred > received + F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False))


def valid_distance(day_km: Column, total_km: Column) -> Column:
    return F.coalesce((day_km >= 0) & (day_km <= 1000) & (day_km <= total_km + 0.1), F.lit(False))


def belongs(device: Column, fleet: Column, device_ids: Column, fleet_ids: Column) -> Column:
    """Devices decide if the company lists any and the row has one; else fleets; else a company without lists takes all."""
    d, f = F.nullif(device, F.lit("")), F.nullif(fleet, F.lit(""))
    nd, nf = F.size(device_ids), F.size(fleet_ids)
    return F.when((nd > 0) & d.isNotNull(), F.array_contains(device_ids, d)).when((nf > 0) & f.isNotNull(), F.array_contains(fleet_ids, f)).otherwise((nd + nf) == 0)


def classify(alarm_type: Column, tp: Column, code: Column, *categories: Column, subtypes: dict[str, str] | None = None) -> Column:
    """struct(category, source, status) of an alarm, from the first table that knows one of its fields."""
    words = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    text, fields = words(alarm_type), [words(c) for c in (alarm_type, tp, code, *categories)]
    by_tp = F.coalesce(mapped(subtypes or DEFAULT_SUBTYPES, clean_string(tp)), mapped(LIVE_SUBTYPES, clean_string(tp)))
    found = lambda category, source, status="classified_dms": F.struct(category.alias("category"), F.lit(source).alias("source"), F.lit(status).alias("status"))
    out = F.when(mapped(TEXT_CATEGORIES, text).isNotNull(), found(mapped(TEXT_CATEGORIES, text), "text_alarm_type"))
    out = out.when(by_tp.isNotNull(), found(by_tp, "subtype_map"))
    by_code = mapped(EVENT_CODES, clean_string(code))
    out = out.when(by_code.isNotNull(), found(by_code, "event_code_map"))
    for group, source in (([words(c) for c in categories], "payload_category"), ([words(tp), words(code)], "historical_equivalent")):
        if group:
            hit = F.coalesce(*[mapped(TEXT_CATEGORIES, c) for c in group])
            out = out.when(hit.isNotNull(), found(hit, source))
    first = first_non_empty(*fields)
    out = out.when(first.rlike("|".join(DMS_STEMS)), found(F.lit("Sin clasificar"), "dms_like_unmapped", "unmapped"))
    out = out.when(first.isNotNull(), found(F.lit("No DMS"), "non_dms_text", "classified_non_dms"))
    return out.otherwise(found(F.lit("Sin clasificar"), "unclassified", "unmapped"))


def event_key(slug: Column, device: Column, category: Column, alarm_type: Column, tp: Column, code: Column, *times: Column) -> Column:
    """SHA-1 over nine tokens; concat_ws drops nulls, so each token is made non-null first."""
    token = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    stamp = lambda c: F.coalesce(F.date_format(F.date_trunc("second", c), "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit("-"))
    return F.sha1(F.concat_ws("|", token(F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))), token(device), token(category), token(alarm_type), token(tp), token(code), *[stamp(t) for t in times]))


def cut_start(ts: Column, minutes: int = RULES["cut_minutes"]) -> Column:
    return F.timestamp_seconds((F.floor(F.unix_timestamp(ts) / (60 * minutes)) * 60 * minutes).cast("long"))


def age_minutes(later: Column, earlier: Column) -> Column:
    return F.floor(F.greatest(F.unix_timestamp(later) - F.unix_timestamp(earlier), F.lit(0)) / 60)


def feed_status(minutes: Column, late: int = RULES["late_minutes"], stopped: int = RULES["stopped_minutes"]) -> Column:
    return F.when(minutes.isNull(), "no_data").when(minutes < late, "online").when(minutes < stopped, "delayed").otherwise("stopped")


def add_reason(reasons: Column, reason: Column) -> Column:
    """A comma list without repetitions."""
    return F.array_join(F.array_distinct(F.filter(F.split(F.concat_ws(",", reasons, reason), ","), lambda x: x != "")), ",")


def persisted_km(km: Column) -> Column:
    """A stored total in kilometres: ten thousand and more are metres; never negative; null stays null."""
    return F.when(km.isNotNull(), F.round(F.greatest(F.when(km >= 10_000, km / 1000).otherwise(km), F.lit(0.0)), 1))


def resolve_time(occurred: Column, received: Column, current_text: Column, candidates: list[tuple[str, Column]], zone: str = "UTC", minutes: int = RULES["future_minutes"], times: list[Column] | None = None) -> Column:
    """struct(at, reason): the event's time; where that is too far ahead of its receipt, the first candidate that is another text, can be
    read and isn't; the event's time again where none is. times: what the candidates are read as, where they are columns already."""
    out = F.when(~in_future(occurred, received, minutes), F.struct(occurred.alias("at"), F.lit(None).cast("string").alias("reason")))
    for (reason, text), at in zip(candidates, times or [parse_time(text, zone) for _, text in candidates], strict=True):
        fits = (F.trim(text) != "") & (F.trim(text) != F.trim(current_text)) & at.isNotNull() & ~in_future(at, received, minutes)
        out = out.when(F.coalesce(fits, F.lit(False)), F.struct(at.alias("at"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(occurred.alias("at"), F.lit(None).cast("string").alias("reason")))


def normal_aliases(aliases: Column) -> Column:
    """A map of aliases with keys and values in the plates' normal form."""
    return F.transform_values(F.transform_keys(aliases, lambda k, v: plate_label(k)), lambda k, v: plate_label(v))


def plate_alias(plate: Column, aliases: Column) -> Column:
    """The plate that an alias stands for; others are only normalised."""
    label = plate_label(plate)
    return F.coalesce(F.element_at(normal_aliases(aliases), label), label)


def alias_applied(plate: Column, aliases: Column) -> Column:
    return F.coalesce(plate_alias(plate, aliases) != plate_label(plate), F.lit(False))


def plate_in_name(name: Column) -> Column:
    """Three letters and three digits that stand alone in a name, upper case; null without them."""
    return F.nullif(F.upper(F.regexp_extract(name, r"(?i)(?<![a-z0-9])([a-z]{3}[ -]?[0-9]{3})(?![a-z0-9])", 1)), F.lit(""))


def labelled(reason: Column, phrases: list[tuple[str, str]]) -> Column:
    """A reason as people read it: underscores become spaces, then the first place of each phrase its label, in order."""
    out = F.replace(reason, F.lit("_"), F.lit(" "))
    for phrase, label in phrases:
        out = F.regexp_replace(out, f"^(.*?){phrase}", f"$1{label}")
    return out


def progress(done: Column, total: Column) -> Column:
    """Percent with one decimal, 100 at most; 0 where there is nothing to do."""
    return F.when(total > 0, F.least(F.lit(100.0), F.round(done / total * 100, 1))).otherwise(0.0)


def ceil_share(done: Column, whole: Column, of: Column) -> Column:
    """done of whole, in parts of of, rounded up; at least one part and at most all."""
    return F.when(whole <= 0, of).otherwise(F.least(of, F.greatest(F.lit(1), F.ceil(done * of / whole)))).cast("long")


def window_bounds(kind: str, start: Column, end: Column, zone: str) -> tuple[Column, Column]:
    """A report's range: the day that ends at end, the local calendar month of start, or what is given."""
    if kind == "rolling_24h":
        return end - F.expr("INTERVAL 24 HOURS"), end
    if kind == "calendar_month_local":
        first = F.date_trunc("month", F.from_utc_timestamp(start, zone))
        return F.to_utc_timestamp(first, zone), F.to_utc_timestamp(first + F.expr("INTERVAL 1 MONTH") - F.expr("INTERVAL 0.000001 SECOND"), zone)
    return start, end


def backoff(base_seconds: int, tries: Column, most_seconds: int) -> Column:
    """Seconds to wait after so many failures: doubled each time, up to a bound."""
    return F.least(F.lit(base_seconds) * F.pow(F.lit(2), F.least(tries, F.lit(30))), F.lit(most_seconds)).cast("long")
