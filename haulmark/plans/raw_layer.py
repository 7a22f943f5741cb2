"""The raw layer: sources, temporal status and ingest results of alarms; diagnostics, defaults, propagation and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.functions import expressions as x
from haulmark.functions.values import ACTIVE_SOURCES, DONE_RESULTS, REASON_LABELS
from haulmark.operators import upserts
from haulmark.plans.ingest import CLASS_SQL, KEY_SQL, RESENT_SQL, classified, keyed, resent
from haulmark.plans.register import query
from haulmark.sources import domain as d

RAW_SQL = f""", {CLASS_SQL.strip()},
raw AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'live' WHEN 1 THEN 'backfill' WHEN 2 THEN 'catchup' WHEN 3 THEN 'harvest' ELSE 'mock' END AS source,
  CASE WHEN occurred_at > received_at + INTERVAL 5 MINUTE THEN 'future_rejected' ELSE 'accepted' END AS temporal_status,
  CASE event_id % 6 WHEN 0 THEN 'inserted_alarm_event' WHEN 1 THEN 'updated_alarm_event' WHEN 2 THEN 'raw_only' WHEN 4 THEN 'temporal_rejected' WHEN 5 THEN 'inserted_alarm_event' END AS ingest_result FROM classes),
devices AS (SELECT device_id, plate, fleet_id, company_slug, total_km AS last_total_km, day_km AS last_day_km, observed_at AS last_seen FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY observed_at DESC, event_id DESC) AS n FROM readings) WHERE n = 1)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw alarms as they are stored: source, whether their time was accepted, and what ingesting made of them (null: nothing yet)."""
    k, m = F.col("event_id") % 5, F.col("event_id") % 6
    source = F.when(k == 0, "live").when(k == 1, "backfill").when(k == 2, "catchup").when(k == 3, "harvest").otherwise("mock")
    temporal = F.when(x.in_future(F.col("occurred_at"), F.col("received_at")), "future_rejected").otherwise("accepted")
    result = F.when(m.isin(0, 5), "inserted_alarm_event").when(m == 1, "updated_alarm_event").when(m == 2, "raw_only").when(m == 4, "temporal_rejected")
    return classified(spark, sf_dir).withColumns({"source": source, "temporal_status": temporal, "ingest_result": result})


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device dimension: the latest reading of each."""
    last = F.max_by(F.struct("plate", "fleet_id", "company_slug", F.col("total_km").alias("last_total_km"), F.col("day_km").alias("last_day_km"), F.col("observed_at").alias("last_seen")), F.struct("observed_at", "event_id"))
    return d.readings(spark, sf_dir).groupBy("device_id").agg(last.alias("r")).select("device_id", "r.*")


def problematic(status: Column, temporal: Column, result: Column, null_differs: bool = False) -> Column:
    """Whether a raw row needs a look. null_differs: a missing status or temporal status counts as another value, as in the client's form."""
    other = (lambda c, v: ~c.eqNullSafe(F.lit(v))) if null_differs else (lambda c, v: F.coalesce(c != v, F.lit(False)))
    return other(status, "classified_dms") | other(temporal, "accepted") | result.isNull() | ~F.coalesce(result.isin(*DONE_RESULTS), F.lit(False))


@query("source_allow_list", f"{RAW_SQL} SELECT company_slug, source, count(*) AS n FROM raw WHERE source IN ('harvest', 'live', 'backfill', 'catchup', 'admin_backfill') GROUP BY ALL")
def source_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).filter(F.col("source").isin(*ACTIVE_SOURCES)).groupBy("company_slug", "source").agg(F.count("*").alias("n"))


@query("classified_not_discarded", f"{RAW_SQL} SELECT company_slug, mapped, count(*) AS n FROM raw WHERE status = 'classified_dms' AND review IS DISTINCT FROM 'discarded' GROUP BY ALL")
def classified_not_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir).filter((F.col("status") == "classified_dms") & ~F.col("review").eqNullSafe(F.lit("discarded")))
    return rows.groupBy("company_slug", "mapped").agg(F.count("*").alias("n"))


HURT_SQL = "hurt AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE temporal_status END AS t FROM raw)"


@query("problematic_rows", f"{RAW_SQL}, {HURT_SQL} SELECT company_slug, CAST(count(*) FILTER (status <> 'classified_dms' OR t <> 'accepted' OR ingest_result IS NULL OR ingest_result NOT IN ('inserted_alarm_event', 'updated_alarm_event')) AS BIGINT) AS as_stored, CAST(count(*) FILTER (status <> 'classified_dms' OR t IS DISTINCT FROM 'accepted' OR ingest_result IS NULL OR ingest_result NOT IN ('inserted_alarm_event', 'updated_alarm_event')) AS BIGINT) AS as_shown FROM hurt GROUP BY company_slug")
def problematic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that need a look, by three-valued logic and with a missing temporal status counted as not accepted."""
    rows = raw(spark, sf_dir).withColumn("t", F.when(F.col("event_id") % 11 != 0, F.col("temporal_status")))
    hit = lambda null_differs: F.count_if(problematic(F.col("status"), F.col("t"), F.col("ingest_result"), null_differs))
    return rows.groupBy("company_slug").agg(hit(False).alias("as_stored"), hit(True).alias("as_shown"))


@query("raw_diagnostics", f"{RAW_SQL} SELECT guid, device_id, plate, source, status, temporal_status, ingest_result, alarm_type, raw_tp, raw_code, occurred_at, received_at FROM raw WHERE fleet_id IN ('F1', 'F3') AND (status <> 'classified_dms' OR temporal_status <> 'accepted' OR ingest_result IS NULL OR ingest_result NOT IN ('inserted_alarm_event', 'updated_alarm_event')) ORDER BY received_at DESC, event_id DESC LIMIT 200")
def raw_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 200 rows of a tenant that need a look: the limit comes after the tenant's filter."""
    rows = raw(spark, sf_dir).filter(F.col("fleet_id").isin("F1", "F3") & problematic(F.col("status"), F.col("temporal_status"), F.col("ingest_result")))
    top = rows.orderBy(F.desc("received_at"), F.desc("event_id")).limit(200)
    return top.select("guid", "device_id", "plate", "source", "status", "temporal_status", "ingest_result", "alarm_type", "raw_tp", "raw_code", "occurred_at", "received_at")


@query(
    "raw_counters_24h",
    f"""{RAW_SQL}, r AS (SELECT *, status = 'classified_dms' AND temporal_status = 'accepted' AS dms, status = 'classified_non_dms' AND temporal_status = 'accepted' AS non FROM raw WHERE occurred_at >= TIMESTAMP '2024-01-30 00:00:00' OR received_at >= TIMESTAMP '2024-01-30 00:00:00')
    SELECT count_if(source = 'live')::BIGINT AS live_alarms, count_if(dms)::BIGINT AS dms, count_if(dms AND source = 'live')::BIGINT AS live_dms, count_if(dms AND source = 'backfill')::BIGINT AS backfill_dms, count_if(dms AND source = 'catchup')::BIGINT AS catchup_dms,
    count_if(status = 'unmapped' AND source = 'live')::BIGINT AS live_unmapped, count_if(non)::BIGINT AS non_dms, count_if(non AND source = 'live')::BIGINT AS live_non_dms, count_if(temporal_status = 'future_rejected')::BIGINT AS future_rejected,
    count_if(temporal_status = 'future_rejected' AND source = 'live')::BIGINT AS live_future_rejected, count(DISTINCT device_id) AS vehicles, count(DISTINCT device_id) FILTER (dms AND source = 'live') AS vehicles_live_dms FROM r""",
)
def raw_counters_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by source, class and temporal status over the rows that occurred or arrived in the last day: one pass."""
    since = F.expr("TIMESTAMP '2024-01-30 00:00:00'")
    rows = raw(spark, sf_dir).filter((F.col("occurred_at") >= since) | (F.col("received_at") >= since))
    accepted, live = F.col("temporal_status") == "accepted", F.col("source") == "live"
    future = F.col("temporal_status") == "future_rejected"
    dms, non = (F.col("status") == "classified_dms") & accepted, (F.col("status") == "classified_non_dms") & accepted
    n = F.count_if
    return rows.agg(
        n(live).alias("live_alarms"), n(dms).alias("dms"), n(dms & live).alias("live_dms"), n(dms & (F.col("source") == "backfill")).alias("backfill_dms"), n(dms & (F.col("source") == "catchup")).alias("catchup_dms"),
        n((F.col("status") == "unmapped") & live).alias("live_unmapped"), n(non).alias("non_dms"), n(non & live).alias("live_non_dms"), n(future).alias("future_rejected"), n(future & live).alias("live_future_rejected"),
        F.count_distinct("device_id").alias("vehicles"), F.count_distinct(F.when(dms & live, F.col("device_id"))).alias("vehicles_live_dms"),
    )


@query(
    "audit_histograms_all",
    f"""{RAW_SQL}, a AS (SELECT *, CASE WHEN temporal_status <> 'accepted' THEN 'ingest' WHEN status <> 'classified_dms' THEN 'classify' ELSE 'store' END AS stage, CASE WHEN temporal_status <> 'accepted' THEN 'future_timestamp' ELSE mapping_source END AS reason FROM raw),
    h AS (SELECT 'mapping_source' AS kind, mapping_source AS label, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'category', mapped, count(*) FROM a GROUP BY ALL UNION ALL SELECT 'stage', stage, count(*) FROM a GROUP BY ALL UNION ALL SELECT 'reason', reason, count(*) FROM a GROUP BY ALL
      UNION ALL (SELECT 'subtype', coalesce(nullif(tp, ''), '-'), count(*) AS n FROM a GROUP BY ALL ORDER BY n DESC, 2 LIMIT 20)) SELECT kind, label, n FROM h""",
)
def audit_histograms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping sources, categories, stages, reasons and the 20 commonest subtypes: one grouping, then small ones over its cells."""
    late = F.col("temporal_status") != "accepted"
    stage = F.when(late, "ingest").when(F.col("status") != "classified_dms", "classify").otherwise("store")
    reason = F.when(late, "future_timestamp").otherwise(F.col("mapping_source"))
    cells = raw(spark, sf_dir).select("mapping_source", F.col("mapped").alias("category"), stage.alias("stage"), reason.alias("reason"), F.coalesce(F.nullif("tp", F.lit("")), F.lit("-")).alias("subtype"))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("label")) for c in cells.columns]))
    counts = cells.groupBy(*cells.columns).agg(F.count("*").alias("c")).select(kinds.alias("k"), "c").groupBy("k.kind", "k.label").agg(F.sum("c").alias("n"))
    top = counts.filter("kind = 'subtype'").orderBy(F.desc("n"), "label").limit(20)
    return counts.filter("kind <> 'subtype'").unionByName(top)


@query("diagnostics_top", f"{RAW_SQL} SELECT coalesce(ingest_result, 'sin resultado') AS label, count(*) AS n FROM raw WHERE status <> 'classified_dms' GROUP BY ALL ORDER BY n DESC, label LIMIT 6")
def diagnostics_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir).filter("status <> 'classified_dms'")
    return rows.groupBy(F.coalesce("ingest_result", F.lit("sin resultado")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(6)


@query("support_only", f"{RAW_SQL} SELECT company_slug, count_if(status = 'classified_non_dms')::BIGINT + count_if(status = 'unmapped')::BIGINT + count_if(temporal_status = 'future_rejected')::BIGINT AS support_only FROM raw GROUP BY company_slug")
def support_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only support looks at: other alarms, unmapped ones and those from the future; a row may count twice."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return raw(spark, sf_dir).groupBy("company_slug").agg((n("status", "classified_non_dms") + n("status", "unmapped") + n("temporal_status", "future_rejected")).alias("support_only"))


@query("hour_buckets", "SELECT company_slug, strftime(local_at, '%Y-%m-%d %H:00') AS hour_label, count(*) AS n FROM month WHERE day = DATE '2024-01-30' GROUP BY ALL")
def hour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.in_days(d.kept(spark, sf_dir), 1).groupBy("company_slug", F.date_format("local_at", "yyyy-MM-dd HH:00").alias("hour_label")).agg(F.count("*").alias("n"))


@query("alarm_km_normalise", "SELECT guid, km, CASE WHEN km IS NOT NULL THEN round(greatest(CASE WHEN km >= 10000 THEN km / 1000 ELSE km END, 0), 1) END AS normalised FROM (SELECT guid, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id * 37 - 500 AS DOUBLE) END AS km FROM alarms)")
def alarm_km_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored totals that are metres become kilometres; none is negative; null stays."""
    rows = d.alarms(spark, sf_dir).select("guid", F.when(F.col("event_id") % 5 != 0, (F.col("event_id") * 37 - 500).cast("double")).alias("km"))
    return rows.withColumn("normalised", x.persisted_km(F.col("km")))


@query("reason_labels", f"{RAW_SQL} SELECT DISTINCT mapping_source AS reason, CASE mapping_source WHEN 'non_dms_text' THEN 'clasificada como no DMS por texto' WHEN 'dms_like_unmapped' THEN 'parece DMS pero quedo sin mapa' ELSE replace(mapping_source, '_', ' ') END AS label FROM raw")
def reason_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons as people read them: underscores go, then each known phrase becomes its label."""
    return raw(spark, sf_dir).select(F.col("mapping_source").alias("reason")).distinct().withColumn("label", x.labelled(F.col("reason"), REASON_LABELS))


FALLBACK_SQL = """
t AS (SELECT guid, occurred_at, received_at, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS now_text, CASE WHEN event_id % 2 = 0 THEN strftime(received_at, '%Y-%m-%d %H:%M:%S') ELSE '' END AS report_text,
  CASE WHEN event_id % 3 = 0 THEN strftime(occurred_at, '%Y-%m-%d %H:%M:%S') ELSE strftime(occurred_at + INTERVAL 2 MINUTE, '%Y-%m-%d %H:%M:%S') END AS end_text, CASE WHEN event_id % 5 <> 0 THEN strftime(occurred_at - INTERVAL 20 MINUTE, '%Y-%m-%d %H:%M:%S') ELSE 'never' END AS start_text FROM alarms)"""


@query(
    "future_fallback",
    f""", {FALLBACK_SQL.strip()}, c AS (SELECT *, occurred_at > received_at + INTERVAL 5 MINUTE AS future, CASE WHEN report_text <> '' AND report_text <> now_text AND TRY_CAST(report_text AS TIMESTAMP) <= received_at + INTERVAL 5 MINUTE THEN TRY_CAST(report_text AS TIMESTAMP) END AS c1,
    CASE WHEN end_text <> now_text AND TRY_CAST(end_text AS TIMESTAMP) <= received_at + INTERVAL 5 MINUTE THEN TRY_CAST(end_text AS TIMESTAMP) END AS c2, CASE WHEN TRY_CAST(start_text AS TIMESTAMP) <= received_at + INTERVAL 5 MINUTE THEN TRY_CAST(start_text AS TIMESTAMP) END AS c3 FROM t)
    SELECT guid, CASE WHEN future THEN coalesce(c1, c2, c3, occurred_at) ELSE occurred_at END AS resolved_at, CASE WHEN future THEN CASE WHEN c1 IS NOT NULL THEN 'fallback_reportTime' WHEN c2 IS NOT NULL THEN 'fallback_endTime' WHEN c3 IS NOT NULL THEN 'fallback_startTime' END END AS reason FROM c""",
)
def future_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms more than five minutes ahead of their receipt take the first other time of the message that isn't."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    k = F.col("event_id")
    minutes = lambda n: F.col("occurred_at") + F.expr(f"INTERVAL {n} MINUTES")
    report, end, start = F.when(k % 2 == 0, text("received_at")).otherwise(""), F.when(k % 3 == 0, text("occurred_at")).otherwise(text(minutes(2))), F.when(k % 5 != 0, text(minutes(-20))).otherwise("never")
    resolved = x.resolve_time(F.col("occurred_at"), F.col("received_at"), text("occurred_at"), [("fallback_reportTime", report), ("fallback_endTime", end), ("fallback_startTime", start)])
    return d.alarms(spark, sf_dir).select("guid", resolved.alias("r")).select("guid", F.col("r.at").alias("resolved_at"), "r.reason")


ANOMALY_SQL = "seen AS (SELECT device_id, 'alarm' AS source_type, 'future_timestamp' AS reason, strftime(occurred_at, '%Y-%m-%d %H') AS raw_event_time, event_id FROM alarms WHERE occurred_at > received_at + INTERVAL 5 MINUTE)"


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = d.alarms(spark, sf_dir).filter(x.in_future(F.col("occurred_at"), F.col("received_at")))
    return late.select("device_id", F.lit("alarm").alias("source_type"), F.lit("future_timestamp").alias("reason"), F.date_format("occurred_at", "yyyy-MM-dd HH").alias("raw_event_time"), "event_id")


@query("anomaly_batch", f", {ANOMALY_SQL} SELECT DISTINCT device_id, source_type, reason, raw_event_time FROM seen n WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM seen o WHERE o.event_id % 2 = 0 AND o.device_id IS NOT DISTINCT FROM n.device_id AND o.raw_event_time IS NOT DISTINCT FROM n.raw_event_time)")
def anomaly_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch adds to the anomalies: each key once, and only if it isn't there (nulls are equal)."""
    a = anomalies(spark, sf_dir)
    keys = ["device_id", "source_type", "reason", "raw_event_time"]
    return upserts.insert_if_absent(a.filter("event_id % 2 = 0").select(*keys), a.filter("event_id % 2 = 1").select(*keys), keys)


@query("anomaly_single", f", {ANOMALY_SQL} SELECT device_id, count(*) AS n FROM seen GROUP BY device_id")
def anomaly_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single message's anomaly is always appended, repeated or not."""
    return anomalies(spark, sf_dir).groupBy("device_id").agg(F.count("*").alias("n"))


@query("update_defaults", f"{RAW_SQL} SELECT guid, coalesce(nullif(CASE WHEN event_id % 7 = 0 THEN '' ELSE status END, ''), CASE WHEN mapped IN ('No DMS', 'Sin clasificar') THEN 'unmapped' ELSE 'classified_dms' END) AS status, CASE status WHEN 'classified_dms' THEN 'visible' WHEN 'classified_non_dms' THEN 'hidden_non_dms' ELSE 'hidden_unmapped' END AS visibility, coalesce(CASE WHEN event_id % 9 = 0 THEN NULL ELSE mapping_source END, 'legacy') AS mapping_source FROM raw")
def update_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults for rows from before the columns existed: class by category, visibility by class, a source for none."""
    given = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("status"))
    default = F.when(F.col("mapped").isin("No DMS", "Sin clasificar"), "unmapped").otherwise("classified_dms")
    shown = F.when(F.col("status") == "classified_dms", "visible").when(F.col("status") == "classified_non_dms", "hidden_non_dms").otherwise("hidden_unmapped")
    origin = F.coalesce(F.when(F.col("event_id") % 9 != 0, F.col("mapping_source")), F.lit("legacy"))
    return raw(spark, sf_dir).select("guid", F.coalesce(F.nullif(given, F.lit("")), default).alias("status"), shown.alias("visibility"), origin.alias("mapping_source"))


@query("raw_time_fill", "SELECT e.guid, CASE WHEN e.event_id % 3 = 0 AND EXISTS (SELECT 1 FROM alarms r WHERE r.event_id % 4 <> 0 AND r.guid = e.guid) THEN (SELECT strftime(max(r.received_at), '%H:%M:%S') FROM alarms r WHERE r.event_id % 4 <> 0 AND r.guid = e.guid) WHEN e.event_id % 3 <> 0 THEN strftime(e.occurred_at, '%H:%M:%S') END AS raw_event_time FROM alarms e")
def raw_time_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing event times come from the raw layer where it has the row: a correlated update as one join with one row a key."""
    e = d.alarms(spark, sf_dir).select("guid", "event_id", F.when(F.col("event_id") % 3 != 0, F.date_format("occurred_at", "HH:mm:ss")).alias("told"))
    r = d.alarms(spark, sf_dir).filter("event_id % 4 <> 0").groupBy("guid").agg(F.date_format(F.max("received_at"), "HH:mm:ss").alias("raw"))
    return e.join(r, "guid", "left").select("guid", F.coalesce("told", "raw").alias("raw_event_time"))


@query("assign_company", "SELECT guid, coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE company_slug END, ''), CASE WHEN user_id < 40 THEN 'north' WHEN fleet_id IN ('F1', 'F3') THEN 'south' END) AS company_slug FROM alarms")
def assign_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a company take one that lists their device, else one that lists their fleet."""
    c = d.companies(spark)
    lists = lambda ids: c.filter("slug in ('north', 'south')").select(F.explode(ids).alias("id"), "slug").groupBy("id").agg(F.min("slug").alias("slug"))
    rows = d.alarms(spark, sf_dir).select("guid", "device_id", "fleet_id", F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.col("company_slug")).alias("told"))
    both = rows.join(lists("device_ids").select(F.col("id").alias("device_id"), F.col("slug").alias("by_device")), "device_id", "left").join(lists("fleet_ids").select(F.col("id").alias("fleet_id"), F.col("slug").alias("by_fleet")), "fleet_id", "left")
    return both.select("guid", F.coalesce(F.nullif("told", F.lit("")), "by_device", "by_fleet").alias("company_slug"))


SYNTHETIC = "device_id LIKE 'D0000%' OR fleet_id IN ('F4')"


@query("synthetic_counts", f"{RAW_SQL} SELECT 'devices' AS tbl, count(*) AS total, count_if({SYNTHETIC})::BIGINT AS synthetic, count_if(NOT ({SYNTHETIC}))::BIGINT AS observed FROM devices UNION ALL SELECT 'snapshots', count(*), count_if({SYNTHETIC})::BIGINT, count_if(NOT ({SYNTHETIC}))::BIGINT FROM daily UNION ALL SELECT 'alarms', count(*), count_if({SYNTHETIC})::BIGINT, count_if(NOT ({SYNTHETIC}))::BIGINT FROM alarms")
def synthetic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated and observed rows of three tables: by a device's prefix or its fleet."""
    made = F.col("device_id").startswith("D0000") | F.col("fleet_id").isin("F4")
    n = lambda name, df: df.agg(F.count("*").alias("total"), F.count_if(made).alias("synthetic"), F.count_if(~made).alias("observed")).select(F.lit(name).alias("tbl"), "total", "synthetic", "observed")
    return n("devices", devices(spark, sf_dir)).unionByName(n("snapshots", d.daily(spark, sf_dir))).unionByName(n("alarms", d.alarms(spark, sf_dir)))


@query("synthetic_purge", f"SELECT company_slug, count_if({SYNTHETIC})::BIGINT AS purged, count_if(NOT ({SYNTHETIC}))::BIGINT AS left_rows FROM alarms GROUP BY company_slug")
def synthetic_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.col("device_id").startswith("D0000") | F.col("fleet_id").isin("F4")
    return d.alarms(spark, sf_dir).groupBy("company_slug").agg(F.count_if(made).alias("purged"), F.count_if(~made).alias("left_rows"))


@query("propagate_attributes", f"{RAW_SQL} SELECT a.guid, coalesce(CASE WHEN a.event_id % 4 <> 0 THEN a.company_slug END, v.company_slug) AS company_slug, coalesce(CASE WHEN a.event_id % 6 <> 0 THEN a.fleet_id END, v.fleet_id) AS fleet_id, coalesce(v.plate, a.plate) AS plate FROM alarms a LEFT JOIN devices v USING (device_id)")
def propagate_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company, fleet and plate that rows lack come from their device, where tables are read rather than written."""
    v = devices(spark, sf_dir).select("device_id", F.col("company_slug").alias("v_slug"), F.col("fleet_id").alias("v_fleet"), F.col("plate").alias("v_plate"))
    rows = d.alarms(spark, sf_dir).withColumns({"own_slug": F.when(F.col("event_id") % 4 != 0, F.col("company_slug")), "own_fleet": F.when(F.col("event_id") % 6 != 0, F.col("fleet_id"))})
    return rows.join(v, "device_id", "left").select("guid", F.coalesce("own_slug", "v_slug").alias("company_slug"), F.coalesce("own_fleet", "v_fleet").alias("fleet_id"), F.coalesce("v_plate", "plate").alias("plate"))


ALIASES = {"AAA000": "ZZZ900", "AAB001": "ZZZ901", "AAC002": "ZZZ902"}


@query("plate_alias", "SELECT guid, CASE plate WHEN 'AAA000' THEN 'ZZZ900' WHEN 'AAB001' THEN 'ZZZ901' WHEN 'AAC002' THEN 'ZZZ902' ELSE plate END AS plate, plate IN ('AAA000', 'AAB001', 'AAC002') AS alias_applied FROM alarms")
def plate_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of plates, both sides in normal form."""
    messy = F.lower(F.concat(F.substring("plate", 1, 3), F.lit("-"), F.substring("plate", 4, 3)))
    names = F.create_map(*[F.lit(v) for pair in ALIASES.items() for v in (f"{pair[0][:3].lower()} {pair[0][3:]}", pair[1])])
    return d.alarms(spark, sf_dir).select("guid", x.plate_alias(messy, names).alias("plate"), x.alias_applied(messy, names).alias("alias_applied"))


@query("device_name_plate", "SELECT DISTINCT device_id, CASE WHEN user_id % 2 = 0 THEN plate END AS plate FROM alarms")
def device_name_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plate in a device's name, where there is one."""
    name = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("cam "), F.lower("plate"), F.lit(" front"))).otherwise(F.concat(F.lit("unit "), F.col("user_id")))
    return d.alarms(spark, sf_dir).select("device_id", x.plate_in_name(name).alias("plate")).distinct()


@query("device_by_plate", f"{RAW_SQL} SELECT plate, device_id FROM (SELECT plate, device_id, row_number() OVER (PARTITION BY plate ORDER BY CASE WHEN right(device_id, 1) <> '3' THEN last_seen END DESC NULLS LAST, last_total_km DESC NULLS LAST, device_id) AS n FROM devices) WHERE n = 1")
def device_by_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plate's device: the one heard of last; those never heard of come last."""
    heard = F.when(~F.col("device_id").endswith("3"), F.col("last_seen"))
    return d.latest(devices(spark, sf_dir).withColumn("heard", heard), ["plate"], F.desc_nulls_last("heard"), F.desc_nulls_last("last_total_km"), F.col("device_id")).select("plate", "device_id")


BATCH_SQL = f""", {RESENT_SQL}, arriving AS (SELECT *, {KEY_SQL} AS k, occurred_at > received_at + INTERVAL 5 MINUTE AS future, category <> 'Distraccion' AS dms FROM resent), stored AS (SELECT {KEY_SQL} AS k FROM alarms WHERE event_id % 4 = 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS n FROM arriving) WHERE n = 1), known AS (SELECT f.*, f.k IN (SELECT k FROM stored) AS old FROM firsts f)"""


@query(
    "ingest_batches",
    f"""{BATCH_SQL} SELECT a.device_id, a.received, a.received - p.prepared AS duplicates, p.prepared, p.temporal_rejected, p.raw_inserted, p.raw_updated, p.events_inserted, p.events_updated FROM (SELECT device_id, count(*) AS received FROM arriving GROUP BY 1) a JOIN
    (SELECT device_id, count(*) AS prepared, count_if(future)::BIGINT AS temporal_rejected, count_if(NOT old)::BIGINT AS raw_inserted, count_if(old)::BIGINT AS raw_updated, count_if(dms AND NOT future AND NOT old)::BIGINT AS events_inserted, count_if(dms AND NOT future AND old)::BIGINT AS events_updated FROM known GROUP BY 1) p USING (device_id)""",
)
def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A harvest's batch of each device, prepared and applied: repeated keys go, future times are rejected from the event layer, keys that are
    stored are updated and others inserted. Counters are sums, so batches merge."""
    rows = keyed(resent(spark, sf_dir)).withColumns({"future": x.in_future(F.col("occurred_at"), F.col("received_at")), "dms": F.col("category") != "Distraccion"})
    one = rows.groupBy("device_id", "provider_key").agg(F.count("*").alias("copies"), F.min_by(F.struct("future", "dms"), "event_id").alias("r"))
    stored = keyed(d.alarms(spark, sf_dir).filter("event_id % 4 = 0")).select("provider_key", F.lit(True).alias("old")).distinct()
    known = one.join(stored, "provider_key", "left").withColumn("old", F.coalesce("old", F.lit(False)))
    event = F.col("r.dms") & ~F.col("r.future")
    return known.groupBy("device_id").agg(
        F.sum("copies").alias("received"), F.sum(F.col("copies") - 1).alias("duplicates"), F.count("*").alias("prepared"), F.count_if("r.future").alias("temporal_rejected"), F.count_if(~F.col("old")).alias("raw_inserted"), F.count_if("old").alias("raw_updated"),
        F.count_if(event & ~F.col("old")).alias("events_inserted"), F.count_if(event & F.col("old")).alias("events_updated"),
    )


@query("batch_counters_total", f"{BATCH_SQL} SELECT company_slug, count(*) AS rows, count_if(future)::BIGINT AS rejected, max(occurred_at) AS last_at FROM arriving GROUP BY company_slug")
def batch_counters_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of chunks of 500 rows, merged: what is added up in parts gives the same as at once."""
    rows = resent(spark, sf_dir).withColumns({"chunk": F.floor(F.col("event_id") / 500), "future": x.in_future(F.col("occurred_at"), F.col("received_at"))})
    part = rows.groupBy("company_slug", "chunk").agg(F.count("*").alias("rows"), F.count_if("future").alias("rejected"), F.max("occurred_at").alias("last_at"))
    return part.groupBy("company_slug").agg(F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"), F.max("last_at").alias("last_at"))


@query("single_alarm", "SELECT device_id, day, arg_max(guid, (occurred_at, event_id)) AS guid, max(occurred_at) AS last_seen, max(value) AS day_km FROM alarms WHERE NOT (occurred_at > received_at + INTERVAL 5 MINUTE) GROUP BY ALL")
def single_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms one by one also keep the device's snapshot of the day, which batches don't: its last alarm and largest distance."""
    rows = d.alarms(spark, sf_dir).filter(~x.in_future(F.col("occurred_at"), F.col("received_at")))
    return rows.groupBy("device_id", "day").agg(F.max_by("guid", F.struct("occurred_at", "event_id")).alias("guid"), F.max("occurred_at").alias("last_seen"), F.max("value").alias("day_km"))


@query("quarantine_replay", "SELECT device_id, count(*) AS replayed, CAST(0 AS BIGINT) AS twice FROM alarms WHERE occurred_at > received_at + INTERVAL 5 MINUTE AND occurred_at <= received_at + INTERVAL 15 MINUTE GROUP BY device_id")
def quarantine_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined rows taken in again with a wider tolerance, twice: the second time adds nothing."""
    late = d.alarms(spark, sf_dir).filter(x.in_future(F.col("occurred_at"), F.col("received_at")) & ~x.in_future(F.col("occurred_at"), F.col("received_at"), 15)).select("guid", "device_id")
    nothing = late.limit(0)
    once = upserts.insert_if_absent(nothing, late, ["guid"])
    again = upserts.insert_if_absent(once, late, ["guid"]).groupBy("device_id").agg(F.count("*").alias("twice"))
    return once.groupBy("device_id").agg(F.count("*").alias("replayed")).join(again, "device_id", "left").select("device_id", "replayed", F.coalesce("twice", F.lit(0)).alias("twice"))


@query("anomaly_list", "SELECT device_id, plate, 'alarm' AS source_type, 'future_timestamp' AS reason, received_at, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS raw_event_time, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - received_at) / 60) AS BIGINT) AS age_minutes FROM alarms WHERE occurred_at > received_at + INTERVAL 5 MINUTE ORDER BY received_at DESC, event_id DESC LIMIT 200")
def anomaly_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 200 anomalies, as the operators' list shows them."""
    rows = d.alarms(spark, sf_dir).filter(x.in_future(F.col("occurred_at"), F.col("received_at"))).orderBy(F.desc("received_at"), F.desc("event_id")).limit(200)
    age = F.floor((F.unix_micros(F.lit(d.AS_OF).cast("timestamp")) - F.unix_micros("received_at")) / 60_000_000)
    return rows.select("device_id", "plate", F.lit("alarm").alias("source_type"), F.lit("future_timestamp").alias("reason"), "received_at", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("raw_event_time"), age.alias("age_minutes"))
