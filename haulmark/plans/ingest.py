"""From messages to tables: normalising, keys, duplicates, quarantine and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import expressions as x
from haulmark.functions.values import DEFAULT_SUBTYPES, DMS_STEMS, EVENT_CODES, LIVE_SUBTYPES, TEXT_CATEGORIES
from haulmark.operators import upserts
from haulmark.plans.register import query
from haulmark.sources import domain as d

RAW_PLATE_SQL = "CASE event_id % 4 WHEN 0 THEN lower(plate) WHEN 1 THEN substr(plate, 1, 3) || '-' || substr(plate, 4, 3) WHEN 2 THEN ' ' || plate || ' ' ELSE substr(plate, 1, 2) || '0' || substr(plate, 4, 3) END"
CLEAN = "nullif(regexp_replace(upper(raw), '[^0-9A-Z]', '', 'g'), '')"
FIXED = "(replace(substr(clean, 1, 3), '0', 'O') || substr(clean, 4, 3))"
LABEL = f"CASE WHEN regexp_matches(clean, '^...[0-9][0-9][0-9]$') AND regexp_matches({FIXED}, '^[A-Z][A-Z][A-Z][0-9][0-9][0-9]$') THEN {FIXED} ELSE clean END"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms with plates as people write them."""
    p, k = F.col("plate"), F.col("event_id") % 4
    raw = F.when(k == 0, F.lower(p)).when(k == 1, F.concat(F.substring(p, 1, 3), F.lit("-"), F.substring(p, 4, 3))).when(k == 2, F.concat(F.lit(" "), p, F.lit(" "))).otherwise(F.concat(F.substring(p, 1, 2), F.lit("0"), F.substring(p, 4, 3)))
    return d.alarms(spark, sf_dir).withColumn("raw_plate", raw)


@query("plate_normalize", f"SELECT guid, raw AS raw_plate, {LABEL} AS label FROM (SELECT *, {CLEAN} AS clean FROM (SELECT guid, {RAW_PLATE_SQL} AS raw FROM alarms))")
def plate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).select("guid", "raw_plate", x.plate_label(F.col("raw_plate")).alias("label"))


@query(
    "canonical_plate",
    "SELECT guid, CASE WHEN event_id % 3 = 0 THEN plate WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'UNIT' || user_id ELSE device_id END ELSE plate END AS canonical FROM alarms",
)
def canonical_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    first = F.when(k == 0, F.lower("plate")).when(k == 1, F.lpad(F.col("user_id").cast("string"), 8, "9")).otherwise(F.concat(F.lit("unit "), F.col("user_id")))
    second = F.when(k == 0, F.lit(None)).when((k == 1) & (F.col("event_id") % 2 == 0), F.concat(F.lit("unit-"), F.col("user_id"))).when(k == 2, F.col("plate"))
    return d.alarms(spark, sf_dir).select("guid", x.canonical_plate(F.col("device_id"), first, second).alias("canonical"))


def case(key: str, values: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


TEXT_SQL = "CASE event_id % 9 WHEN 0 THEN ' Yawning ' WHEN 1 THEN 'Speeding' WHEN 2 THEN 'eye tracker lost' WHEN 3 THEN '' WHEN 4 THEN 'FCW (Forward Collision Warning)' END"
CODE_SQL = "CAST(100 + event_id % 30 AS VARCHAR)"
TP_SQL = "CASE WHEN event_id % 2 = 0 THEN tp END"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms with provider texts and codes, many of them unknown."""
    k = F.col("event_id") % 9
    text = F.when(k == 0, " Yawning ").when(k == 1, "Speeding").when(k == 2, "eye tracker lost").when(k == 3, "").when(k == 4, "FCW (Forward Collision Warning)")
    return d.alarms(spark, sf_dir).withColumns({"alarm_type": text, "raw_tp": F.when(F.col("event_id") % 2 == 0, F.col("tp")), "raw_code": F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 30 + 100).cast("string"))})


CLASS_SQL = f"""
msg AS (SELECT *, {TEXT_SQL} AS alarm_type, {TP_SQL} AS raw_tp, CASE WHEN event_id % 5 <> 0 THEN {CODE_SQL} END AS raw_code FROM alarms),
m1 AS (SELECT *, {case("lower(trim(coalesce(alarm_type, '')))", TEXT_CATEGORIES)} AS by_text, coalesce({case("raw_tp", DEFAULT_SUBTYPES)}, {case("raw_tp", LIVE_SUBTYPES)}) AS by_tp, {case("raw_code", EVENT_CODES)} AS by_code,
  coalesce(nullif(lower(trim(coalesce(alarm_type, ''))), ''), nullif(lower(trim(coalesce(raw_tp, ''))), ''), nullif(lower(trim(coalesce(raw_code, ''))), '')) AS first FROM msg),
classes AS (SELECT *, CASE WHEN by_text IS NOT NULL THEN by_text WHEN by_tp IS NOT NULL THEN by_tp WHEN by_code IS NOT NULL THEN by_code WHEN regexp_matches(first, '{"|".join(DMS_STEMS)}') THEN 'Sin clasificar' WHEN first IS NOT NULL THEN 'No DMS' ELSE 'Sin clasificar' END AS mapped,
  CASE WHEN by_text IS NOT NULL THEN 'text_alarm_type' WHEN by_tp IS NOT NULL THEN 'subtype_map' WHEN by_code IS NOT NULL THEN 'event_code_map' WHEN regexp_matches(first, '{"|".join(DMS_STEMS)}') THEN 'dms_like_unmapped' WHEN first IS NOT NULL THEN 'non_dms_text' ELSE 'unclassified' END AS mapping_source,
  CASE WHEN coalesce(by_text, by_tp, by_code) IS NOT NULL THEN 'classified_dms' WHEN regexp_matches(first, '{"|".join(DMS_STEMS)}') THEN 'unmapped' WHEN first IS NOT NULL THEN 'classified_non_dms' ELSE 'unmapped' END AS status FROM m1)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = x.classify(F.col("alarm_type"), F.col("raw_tp"), F.col("raw_code"))
    return messages(spark, sf_dir).withColumn("_c", c).withColumns({"mapped": F.col("_c.category"), "mapping_source": F.col("_c.source"), "status": F.col("_c.status")}).drop("_c")


@query("classify_alarm", f", {CLASS_SQL.strip()} SELECT guid, mapped, mapping_source, status FROM classes")
def classify_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("guid", "mapped", "mapping_source", "status")


@query("prune_silver", f", {CLASS_SQL.strip()} SELECT mapped, count(*) AS n FROM classes WHERE status = 'classified_dms' GROUP BY mapped")
def prune_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver table keeps classified alarms only."""
    return classified(spark, sf_dir).filter("status = 'classified_dms'").groupBy("mapped").agg(F.count("*").alias("n"))


@query("audit_histograms", f", {CLASS_SQL.strip()} SELECT mapping_source, status, count(*) AS n, count(DISTINCT device_id) AS devices FROM classes GROUP BY ALL")
def audit_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).groupBy("mapping_source", "status").agg(F.count("*").alias("n"), F.count_distinct("device_id").alias("devices"))


@query("unmapped_codes_topk", f", {CLASS_SQL.strip()} SELECT raw_tp, raw_code, count(*) AS n, arg_min(guid, (occurred_at, event_id)) AS sample FROM classes WHERE status <> 'classified_dms' GROUP BY ALL ORDER BY n DESC, min(occurred_at) LIMIT 12")
def unmapped_codes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classified(spark, sf_dir).filter("status <> 'classified_dms'").groupBy("raw_tp", "raw_code").agg(F.count("*").alias("n"), F.min_by("guid", F.struct("occurred_at", "event_id")).alias("sample"), F.min("occurred_at").alias("t"))
    return out.orderBy(F.desc("n"), "t").limit(12).drop("t")


KEY_SQL = "sha1(concat_ws('|', company_slug, lower(device_id), lower(category), '', coalesce(tp, ''), '', strftime(date_trunc('second', occurred_at), '%Y-%m-%dT%H:%M:%S+00:00'), '-', '-'))"


def keyed(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    when = F.lit(None).cast("timestamp")
    return df.withColumn("provider_key", x.event_key(F.col("company_slug"), F.col("device_id"), F.col("category"), none, F.col("tp"), none, F.col("occurred_at"), when, when))


@query("provider_key", f"SELECT guid, {KEY_SQL} AS provider_key FROM alarms")
def provider_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(d.alarms(spark, sf_dir)).select("guid", "provider_key")


RESENT_SQL = "resent AS (SELECT * FROM alarms UNION ALL BY NAME SELECT * REPLACE ('r' || guid AS guid, event_id + 1000000000 AS event_id) FROM alarms WHERE event_id % 10 = 0)"


def resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of which every tenth comes again under another guid."""
    a = d.alarms(spark, sf_dir)
    again = a.filter("event_id % 10 = 0").withColumns({"guid": F.concat(F.lit("r"), "guid"), "event_id": F.col("event_id") + 1_000_000_000})
    return a.unionByName(again)


@query("dedupe_provider_key", f", {RESENT_SQL} SELECT provider_key, guid, copies FROM (SELECT *, count(*) OVER (PARTITION BY provider_key) AS copies, row_number() OVER (PARTITION BY provider_key ORDER BY event_id) AS n FROM (SELECT *, {KEY_SQL} AS provider_key FROM resent)) WHERE n = 1")
def dedupe_provider_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of grouping: the first row of a key and the number of its copies."""
    return keyed(resent(spark, sf_dir)).groupBy("provider_key").agg(F.min_by("guid", "event_id").alias("guid"), F.count("*").alias("copies"))


@query(
    "dedupe_three_key",
    f""", {RESENT_SQL}, k AS (SELECT device_id, guid, ['g' || guid, 'p' || {KEY_SQL}, 'f' || category || '|' || coalesce(tp, '~') || '|' || epoch_us(occurred_at)] AS keys, row_number() OVER (PARTITION BY device_id ORDER BY event_id) AS n FROM resent)
    SELECT guid, dup AS is_duplicate FROM (WITH RECURSIVE st AS (SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS seen, '' AS guid, false AS dup FROM k UNION ALL SELECT k.device_id, k.n, CASE WHEN list_has_any(st.seen, k.keys) THEN st.seen ELSE list_concat(st.seen, k.keys) END, k.guid, list_has_any(st.seen, k.keys) FROM st JOIN k ON k.device_id = st.device_id AND k.n = st.n + 1) SELECT * FROM st WHERE n > 0)""",
)
def dedupe_three_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate if any of three keys was seen on a kept row. The third key is category, subtype and exact time; a null is a value of its own."""
    fuzzy = F.to_json(F.struct("category", "tp", F.unix_micros("occurred_at").alias("at")), {"ignoreNullFields": "false"})
    rows = keyed(resent(spark, sf_dir)).withColumn("fuzzy", fuzzy)
    return upserts.first_by_any_key(rows.select("device_id", "event_id", "guid", "provider_key", "fuzzy"), "device_id", "event_id", ["guid", "provider_key", "fuzzy"]).select("guid", "is_duplicate")


@query("future_reject_split", "SELECT company_slug, CAST(count(*) FILTER (occurred_at > received_at + INTERVAL 5 MINUTE) AS BIGINT) AS rejected, CAST(count(*) FILTER (NOT (occurred_at > received_at + INTERVAL 5 MINUTE)) AS BIGINT) AS accepted FROM alarms GROUP BY company_slug")
def future_reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    future = x.in_future(F.col("occurred_at"), F.col("received_at"))
    return d.alarms(spark, sf_dir).groupBy("company_slug").agg(F.count_if(future).alias("rejected"), F.count_if(~future).alias("accepted"))


CHANGES_SQL = "old AS (SELECT guid, device_id, category, value, received_at FROM alarms WHERE event_id % 3 <> 0), new AS (SELECT guid, device_id, category, value + 1 AS value, received_at FROM alarms WHERE event_id % 3 = 0 OR event_id % 5 = 0)"


def changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = d.alarms(spark, sf_dir).select("event_id", "guid", "device_id", "category", "value", "received_at")
    one = F.lit(1).cast("decimal(18,2)")
    return a.filter("event_id % 3 <> 0").drop("event_id"), a.filter("event_id % 3 = 0 or event_id % 5 = 0").withColumn("value", (F.col("value") + one).cast("decimal(18,2)")).drop("event_id")


@query("upsert_latest", f", {CHANGES_SQL} SELECT * FROM new UNION ALL SELECT * FROM old WHERE guid NOT IN (SELECT guid FROM new)")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = changes(spark, sf_dir)
    return upserts.keep_latest(old, new, ["guid"], F.col("received_at"))


@query("merge_fields", f", {CHANGES_SQL}, n2 AS (SELECT guid, CASE WHEN device_id < 'D00050' THEN device_id END AS device_id, category, CASE WHEN value > 20 THEN value END AS value, received_at - INTERVAL 1 DAY AS received_at FROM new) SELECT coalesce(n.guid, o.guid) AS guid, coalesce(n.device_id, o.device_id) AS device_id, coalesce(n.category, o.category) AS category, coalesce(n.value, o.value) AS value, greatest(o.received_at, n.received_at) AS received_at FROM old o FULL JOIN n2 n ON o.guid = n.guid")
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = changes(spark, sf_dir)
    new = new.withColumns({"device_id": F.when(F.col("device_id") < "D00050", F.col("device_id")), "value": F.when(F.col("value") > 20, F.col("value")), "received_at": F.col("received_at") - F.expr("INTERVAL 1 DAY")})
    return upserts.merge_fields(old, new, ["guid"], ("received_at",))


@query("insert_if_absent", "SELECT guid, stage, reason FROM (SELECT DISTINCT 'g' || (event_id // 2) AS guid, 'classify' AS stage, category AS reason FROM alarms WHERE event_id % 2 = 1) x WHERE NOT EXISTS (SELECT 1 FROM alarms a WHERE a.event_id % 3 = 0 AND a.guid = x.guid AND a.category = x.reason)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = d.alarms(spark, sf_dir)
    old = a.filter("event_id % 3 = 0").select("guid", F.lit("classify").alias("stage"), F.col("category").alias("reason"))
    new = a.filter("event_id % 2 = 1").select(F.concat(F.lit("g"), F.floor(F.col("event_id") / 2)).alias("guid"), F.lit("classify").alias("stage"), F.col("category").alias("reason"))
    return upserts.insert_if_absent(old, new, ["guid", "stage", "reason"], "guid")


def three_tiers(spark: SparkSession, sf_dir: str, arriving: DataFrame) -> DataFrame:
    right = keyed(d.alarms(spark, sf_dir).filter("event_id % 5 <> 0")).withColumn("provider_key", F.when(F.col("event_id") % 4 != 0, F.col("provider_key"))).withColumn("right_guid", F.col("guid"))
    return upserts.prioritised_match(keyed(arriving), right, "guid", "right_guid", [["provider_key"], ["guid"], ["device_id", "category", "tp", "occurred_at"]], null_safe=(2,))


def tiers_sql() -> str:
    return f""", {RESENT_SQL}, l AS (SELECT *, {KEY_SQL} AS k FROM resent), r AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN {KEY_SQL} END AS k FROM alarms WHERE event_id % 5 <> 0)
    SELECT l.guid, CAST(CASE WHEN t1.g IS NOT NULL THEN 1 WHEN t2.g IS NOT NULL THEN 2 WHEN t3.g IS NOT NULL THEN 3 END AS INTEGER) AS tier, coalesce(t1.g, t2.g, t3.g) AS match FROM l LEFT JOIN (SELECT k, min(guid) AS g FROM r GROUP BY k) t1 ON l.k = t1.k LEFT JOIN (SELECT guid AS g FROM r) t2 ON l.guid = t2.g
    LEFT JOIN (SELECT device_id, category, tp, occurred_at, min(guid) AS g FROM r GROUP BY ALL) t3 ON l.device_id = t3.device_id AND l.category = t3.category AND l.tp IS NOT DISTINCT FROM t3.tp AND l.occurred_at = t3.occurred_at"""


@query("match_three_tiers", tiers_sql())
def match_three_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that arrives, by provider key, else by guid, else by device, category, subtype and time."""
    return three_tiers(spark, sf_dir, resent(spark, sf_dir))


@query("match_three_tiers_all", tiers_sql())
def match_three_tiers_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as match_three_tiers, which once took every seventh row."""
    return three_tiers(spark, sf_dir, resent(spark, sf_dir))


@query(
    "raw_metrics_24h",
    f""", {CLASS_SQL.strip()} SELECT count(*) AS raw_rows, CAST(count(*) FILTER (status = 'classified_dms') AS BIGINT) AS dms, CAST(count(*) FILTER (status = 'classified_non_dms') AS BIGINT) AS non_dms, CAST(count(*) FILTER (status = 'unmapped') AS BIGINT) AS unmapped,
    CAST(count(*) FILTER (occurred_at > received_at + INTERVAL 5 MINUTE) AS BIGINT) AS future_rejected, count(DISTINCT device_id) AS devices, count(DISTINCT device_id) FILTER (status = 'classified_dms') AS dms_devices FROM classes WHERE occurred_at >= TIMESTAMP '2024-01-30 00:00:00' OR received_at >= TIMESTAMP '2024-01-30 00:00:00'""",
)
def raw_metrics_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.expr("TIMESTAMP '2024-01-30 00:00:00'")
    n = lambda s: F.count_if(F.col("status") == s)
    return classified(spark, sf_dir).filter((F.col("occurred_at") >= since) | (F.col("received_at") >= since)).agg(
        F.count("*").alias("raw_rows"), n("classified_dms").alias("dms"), n("classified_non_dms").alias("non_dms"), n("unmapped").alias("unmapped"), F.count_if(x.in_future(F.col("occurred_at"), F.col("received_at"))).alias("future_rejected"),
        F.count_distinct("device_id").alias("devices"), F.count_distinct(F.when(F.col("status") == "classified_dms", F.col("device_id"))).alias("dms_devices"),
    )


@query(
    "json_extract_fallback",
    """SELECT event_id, coalesce(nullif(json_extract_string(doc, '$.deviceID'), ''), nullif(json_extract_string(doc, '$.payload.deviceno'), '')) AS device, TRY_CAST(replace(json_extract_string(doc, '$.payload.km'), ',', '') AS DOUBLE) AS km
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"deviceID":"' || device_id || '","payload":{"km":"1,2' || (event_id % 10) || '0.5"}}' WHEN 1 THEN '{"deviceID":"","payload":{"deviceno":"' || device_id || '","km":"bad"}}' ELSE '[1]' END AS doc FROM alarms)""",
)
def json_extract_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    doc = F.when(k == 0, F.concat(F.lit('{"deviceID":"'), "device_id", F.lit('","payload":{"km":"1,2'), F.col("event_id") % 10, F.lit('0.5"}}'))).when(k == 1, F.concat(F.lit('{"deviceID":"","payload":{"deviceno":"'), "device_id", F.lit('","km":"bad"}}'))).otherwise("[1]")
    rows = d.alarms(spark, sf_dir).select("event_id", doc.alias("doc"))
    return rows.select("event_id", x.first_non_empty(F.get_json_object("doc", "$.deviceID"), F.get_json_object("doc", "$.payload.deviceno")).alias("device"), x.safe_double(F.get_json_object("doc", "$.payload.km")).alias("km"))


@query("retention_purge", "SELECT company_slug, CAST(count(*) FILTER (day < DATE '2024-01-10') AS BIGINT) AS purged, CAST(count(*) FILTER (day >= DATE '2024-01-10') AS BIGINT) AS left_rows FROM alarms GROUP BY company_slug")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("day") < F.expr(f"date_sub({d.LAST_DAY}, 20)")
    return d.alarms(spark, sf_dir).groupBy("company_slug").agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("left_rows"))
