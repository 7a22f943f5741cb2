"""What the client shows: alerts with levels and priorities, profiles, compositions, reports; reconciliation and reviews in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import expressions as x
from haulmark.functions.values import CATEGORIES, CONFIDENCE, RULES
from haulmark.plans.episodes import DEVIATION_SQL, SESSION_SQL, sessions, with_deviation
from haulmark.plans.history import fatigue_first_client
from haulmark.plans.mileage import BASE_SQL
from haulmark.plans.raw_layer import RAW_SQL, raw
from haulmark.plans.reconcile import PORTAL_SQL, QUEUE_SQL, firsts, portal, queue
from haulmark.plans.register import query
from haulmark.sources import domain as d

NIGHT_SQL = "(hour(end_at - INTERVAL 5 HOUR) >= 22 OR hour(end_at - INTERVAL 5 HOUR) < 5)"
CONFIDENCE_SQL = "CASE final " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CONFIDENCE.items()) + " ELSE 0.5 END"
ALERT_SQL = f"""{BASE_SQL}, {SESSION_SQL.strip()}, {DEVIATION_SQL.strip()},
firstyawn AS (SELECT e.session_id AS taker, min_by(y.session_id, y.start_at) AS given FROM sessions e JOIN sessions y ON y.plate = e.plate AND e.category = 'Ojos cerrados' AND y.category = 'Bostezo' AND y.end_at < e.start_at AND floor((epoch_us(e.start_at) - epoch_us(y.end_at)) / 60000000) <= 60 GROUP BY e.session_id),
a0 AS (SELECT j.*, f.given, CASE WHEN f.given IS NOT NULL THEN 'Fatiga en progresion' ELSE j.category END AS final, {NIGHT_SQL} AS at_night FROM judged j LEFT JOIN firstyawn f ON f.taker = j.session_id),
a1 AS (SELECT *, CASE WHEN same_day > 20 THEN 'medio' WHEN given IS NOT NULL OR category = 'Uso de celular' OR (category = 'Ojos cerrados' AND n >= 3) THEN 'critico'
  WHEN category = 'Ojos cerrados' OR (category = 'Riesgo de colision' AND n >= 3) OR (category = 'Bostezo' AND n >= 5) THEN 'alto' ELSE 'medio' END AS level, category = 'Ojos cerrados' AND same_day > 12 AS glasses_note,
  CASE WHEN category = 'Ojos cerrados' AND given IS NULL AND n >= 3 THEN 0.9 ELSE {CONFIDENCE_SQL} END AS confidence FROM a0 WHERE NOT (category = 'Ojos cerrados' AND given IS NULL AND n = 1) AND NOT (category = 'Distraccion' AND deviation < 3)),
alerts AS (SELECT a1.session_id, plate, final AS category, level, glasses_note, n, at_night, end_at, CAST(coalesce(c.weight, 1) * confidence * CASE WHEN n >= 4 THEN 1.8 WHEN n >= 2 THEN 1.4 ELSE 1.0 END * CASE WHEN at_night THEN 1.3 ELSE 1.0 END * CASE WHEN deviation > 1.5 THEN 1.25 ELSE 1.0 END AS DOUBLE) AS priority FROM a1 LEFT JOIN categories c ON c.category = a1.final)"""


def decimal(value: str) -> Column:
    return F.expr(f"{value}BD")


def client_alerts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as alerts: level by thresholds, medium where a day has too many, and a priority of weight, confidence, length, night and deviation.

    Lone eyes-closed sessions without a yawn before them, and distractions of usual vehicles, are dismissed. Yawn sessions that an
    eyes-closed one is merged with stay alerts of their own.
    """
    s = with_deviation(spark, sf_dir, sessions(spark, sf_dir))
    s = s.join(fatigue_first_client(spark, sf_dir).withColumnRenamed("taker", "session_id"), "session_id", "left")
    n, kind, merged = F.col("n"), F.col("category"), F.col("given").isNotNull()
    eyes = kind == "Ojos cerrados"
    s = s.filter(~(eyes & ~merged & (n == 1)) & ~((kind == "Distraccion") & (F.col("deviation") < RULES["distraction_deviation"])))
    critical = merged | (kind == "Uso de celular") | (eyes & (n >= RULES["eyes_closed_critical"]))
    high = eyes | ((kind == "Riesgo de colision") & (n >= RULES["collision_pattern"])) | ((kind == "Bostezo") & (n >= RULES["yawn_fatigue"]))
    level = F.when(F.col("same_day") > RULES["daily_cap"], "medio").when(critical, "critico").when(high, "alto").otherwise("medio")
    final = F.when(merged, "Fatiga en progresion").otherwise(kind)
    known = F.element_at(F.create_map(*[v for k, c in CONFIDENCE.items() for v in (F.lit(k), decimal(c))]), final)
    sure = F.when(eyes & ~merged & (n >= RULES["eyes_closed_critical"]), decimal("0.9")).otherwise(F.coalesce(known, decimal("0.5")))
    weight = F.coalesce(F.element_at(F.create_map(*[v for c, w, _ in CATEGORIES for v in (F.lit(c), F.lit(w))]), final), F.lit(1))
    night = x.is_night(F.hour(F.from_utc_timestamp("end_at", d.ZONE)))
    factor = lambda *cases: F.when(*cases[0]).when(*cases[1]).otherwise(decimal("1.0")) if len(cases) > 1 else F.when(*cases[0]).otherwise(decimal("1.0"))
    priority = weight * sure * factor((n >= 4, decimal("1.8")), (n >= 2, decimal("1.4"))) * factor((night, decimal("1.3"))) * F.when(F.col("deviation") > RULES["spike"], decimal("1.25")).otherwise(decimal("1.00"))
    return s.select("session_id", "plate", final.alias("category"), level.alias("level"), (eyes & (F.col("same_day") > 12)).alias("glasses_note"), "n", night.alias("at_night"), "end_at", priority.cast("double").alias("priority"))


@query("client_alerts", f"{ALERT_SQL} SELECT * FROM alerts")
def client_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client_alerts_of(spark, sf_dir)


@query("timeline_filters", f"{ALERT_SQL} SELECT f.name, count(*) AS n, max(end_at) AS latest FROM alerts, (VALUES ('todas'), ('noche'), ('critico'), ('alto')) f(name) WHERE f.name = 'todas' OR (f.name = 'noche' AND at_night) OR f.name = level GROUP BY f.name")
def timeline_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many alerts each filter of the timeline shows: all, those at night, or one level; an alert counts under each that takes it."""
    names = F.array_compact(F.array(F.lit("todas"), F.when(F.col("at_night"), F.lit("noche")), F.when(F.col("level") != "medio", F.col("level"))))
    return client_alerts_of(spark, sf_dir).withColumn("name", F.explode(names)).groupBy("name").agg(F.count("*").alias("n"), F.max("end_at").alias("latest"))


@query(
    "timeline_with_markers",
    f"""{ALERT_SQL}, r AS (SELECT min(end_at - INTERVAL 5 HOUR) AS lo, max(end_at - INTERVAL 5 HOUR) AS hi FROM alerts WHERE end_at >= TIMESTAMP '2024-01-27 00:00:00'), marks AS (SELECT label, mark_at FROM (SELECT 'night_start' AS label, CAST(day AS TIMESTAMP) + INTERVAL 22 HOUR AS mark_at FROM days UNION ALL SELECT 'night_end', CAST(day AS TIMESTAMP) + INTERVAL 29 HOUR FROM days), r WHERE mark_at > lo AND mark_at < hi)
    SELECT label, local_at FROM (SELECT session_id AS label, end_at - INTERVAL 5 HOUR AS local_at FROM alerts WHERE end_at >= TIMESTAMP '2024-01-27 00:00:00' UNION ALL SELECT label, mark_at FROM marks) ORDER BY local_at DESC, label LIMIT 300""",
)
def timeline_with_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest alerts with the beginnings and ends of nights among them, newest first."""
    alerts = client_alerts_of(spark, sf_dir).filter("end_at >= TIMESTAMP '2024-01-27 00:00:00'").select(F.col("session_id").alias("label"), F.from_utc_timestamp("end_at", d.ZONE).alias("local_at"))
    bounds = alerts.agg(F.min("local_at").alias("lo"), F.max("local_at").alias("hi"))  # one row
    day = F.col("day").cast("timestamp")
    mark = lambda name, hours: F.struct(F.lit(name).alias("label"), (day + F.expr(f"INTERVAL {hours} HOURS")).alias("local_at"))
    marks = d.days(spark).select(F.explode(F.array(mark("night_start", 22), mark("night_end", 29))).alias("m")).select("m.*")
    inside = marks.join(F.broadcast(bounds), (F.col("local_at") > F.col("lo")) & (F.col("local_at") < F.col("hi"))).select("label", "local_at")
    return alerts.unionByName(inside).orderBy(F.desc("local_at"), "label").limit(300)


CAMERA_SQL = "seen AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'Camara cubierta' ELSE category END AS kind FROM month)"


def with_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month's alarms, of which some say that the camera was covered."""
    return d.month(spark, sf_dir).withColumn("kind", F.when(F.col("event_id") % 7 == 0, "Camara cubierta").otherwise(F.col("category")))


@query("camera_recurrence", f", {CAMERA_SQL} SELECT plate, count(DISTINCT day) AS active_days, CASE WHEN count(DISTINCT day) >= 2 THEN 'alto' ELSE 'medio' END AS level FROM seen WHERE kind = 'Camara cubierta' GROUP BY plate")
def camera_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles whose camera was covered on two days or more are of high level."""
    out = with_cameras(spark, sf_dir).filter("kind = 'Camara cubierta'").groupBy("plate").agg(F.count_distinct("day").alias("active_days"))
    return out.withColumn("level", F.when(F.col("active_days") >= 2, "alto").otherwise("medio"))


PIVOT = {"phone": "Uso de celular", "fatigue": "Fatiga en progresion", "eyes_closed": "Ojos cerrados", "collision": "Riesgo de colision", "yawn": "Bostezo", "camera": "Camara cubierta", "smoking": "Fumando", "distraction": "Distraccion"}
PIVOT_SQL = ", ".join(f"count_if(kind = '{v}')::BIGINT AS {k}" for k, v in PIVOT.items())


@query("vehicle_categories", f", {CAMERA_SQL} SELECT plate, {PIVOT_SQL}, count(*) AS total, CAST(sum(coalesce(c.weight, 0)) AS BIGINT) AS risk FROM seen LEFT JOIN categories c ON c.category = kind GROUP BY plate")
def vehicle_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vehicle's month over all eight categories, with its total and risk: one aggregate."""
    weight = F.element_at(F.create_map(*[v for c, w, _ in CATEGORIES for v in (F.lit(c), F.lit(w))]), F.col("kind"))
    return with_cameras(spark, sf_dir).groupBy("plate").agg(*[F.count_if(F.col("kind") == v).alias(k) for k, v in PIVOT.items()], F.count("*").alias("total"), F.sum(F.coalesce(weight, F.lit(0))).alias("risk"))


@query("category_composition", "SELECT c.category, count(m.guid) AS n, CASE WHEN (SELECT count(*) FROM month) = 0 THEN 0.0 ELSE round(count(m.guid)::DOUBLE / (SELECT count(*) FROM month) * 100, 1) END AS share FROM categories c LEFT JOIN month m USING (category) GROUP BY c.category")
def category_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the series of each category add up to, and its share."""
    from haulmark.plans.overview import serie_cat

    sums = serie_cat(spark, sf_dir).groupBy("category").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n").alias("total"))  # one row
    return sums.join(F.broadcast(total)).select("category", "n", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("n").cast("double") / F.col("total") * 100, 1)).alias("share"))


FATIGUE = ("Fatiga en progresion", "Ojos cerrados", "Bostezo")
PROFILE_SQL = "v AS (SELECT plate, count_if(category IN ('Fatiga en progresion', 'Ojos cerrados', 'Bostezo'))::BIGINT AS fatigue, count_if(category = 'Uso de celular')::BIGINT AS phone, count_if(hour >= 22 OR hour < 5)::BIGINT AS night, count(*) AS total FROM month GROUP BY plate)"


@query(
    "profiles_all",
    f", {PROFILE_SQL} SELECT * FROM (SELECT 'fatigue' AS profile, plate, fatigue AS n FROM v WHERE fatigue >= 40 ORDER BY n DESC, plate LIMIT 5) UNION ALL SELECT * FROM (SELECT 'night', plate, night AS n FROM v WHERE night >= 15 ORDER BY n DESC, plate LIMIT 5) UNION ALL SELECT * FROM (SELECT 'phone', plate, phone AS n FROM v WHERE phone > 0 ORDER BY n DESC, plate LIMIT 5)",
)
def profiles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vehicles that stand out most by fatigue, by night and by phone, each from its threshold on."""
    v = vehicle_profiles(spark, sf_dir)
    top = lambda name, least: v.filter(F.col(name) >= least).select(F.lit(name).alias("profile"), "plate", F.col(name).alias("n")).orderBy(F.desc("n"), "plate").limit(5)
    return top("fatigue", RULES["fatigue_profile"]).unionByName(top("night", RULES["night_profile"])).unionByName(top("phone", 1))


def vehicle_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.month(spark, sf_dir).groupBy("plate").agg(F.count_if(F.col("category").isin(*FATIGUE)).alias("fatigue"), F.count_if(F.col("category") == "Uso de celular").alias("phone"), F.count_if(x.is_night(F.col("hour"))).alias("night"), F.count("*").alias("total"))


@query("profile_counts", f", {PROFILE_SQL} SELECT count_if(total >= 10 AND fatigue::DOUBLE / greatest(total, 1) >= 0.7)::BIGINT AS fatigued, count_if(phone > 0)::BIGINT AS phoning, count(*) AS vehicles FROM v")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles whose alarms are of fatigue for the most part, and those with any phone alarm."""
    share = F.col("fatigue").cast("double") / F.greatest("total", F.lit(1))
    return vehicle_profiles(spark, sf_dir).agg(F.count_if((F.col("total") >= 10) & (share >= 0.7)).alias("fatigued"), F.count_if(F.col("phone") > 0).alias("phoning"), F.count("*").alias("vehicles"))


@query("daily_average", "SELECT company_slug, count(*) AS n, round_even(count(*)::DOUBLE / 30, 1) AS per_day, CASE WHEN sum(value) > 0 THEN round_even(CAST(count(*) / sum(value) * 100 AS DOUBLE), 2) END AS per_100_km FROM month GROUP BY company_slug")
def daily_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms a day and for 100 km, rounded half to even as the service does."""
    out = d.month(spark, sf_dir).groupBy("company_slug").agg(F.count("*").alias("n"), F.sum("value").alias("km"))
    return out.select("company_slug", "n", F.bround(F.col("n").cast("double") / 30, 1).alias("per_day"), F.when(F.col("km") > 0, F.bround(F.col("n").cast("double") / F.col("km").cast("double") * 100, 2)).alias("per_100_km"))


REPORT_SQL = "reports AS (SELECT DISTINCT company_slug, CAST(year(day - INTERVAL 20 DAY) AS INTEGER) AS y, CAST(month(day - INTERVAL 20 DAY) AS INTEGER) AS m FROM alarms)"


@query("reports_by_year", f", {REPORT_SQL} SELECT company_slug, y, array_to_string(list(m ORDER BY m DESC), ',') AS months, CAST(row_number() OVER (PARTITION BY company_slug ORDER BY y DESC) AS BIGINT) AS place FROM reports WHERE (y, m) < (2024, 2) GROUP BY company_slug, y")
def reports_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of closed months, the latest year first."""
    from pyspark.sql import Window

    from haulmark.sources.tables import closed_months

    at = F.date_sub("day", 20)
    rows = d.alarms(spark, sf_dir).select("company_slug", F.year(at).alias("year"), F.month(at).alias("month")).distinct()
    out = closed_months(rows, 2024, 2).groupBy("company_slug", F.col("year").alias("y")).agg(F.array_join(F.sort_array(F.collect_list("month"), False), ",").alias("months"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("company_slug").orderBy(F.desc("y"))).cast("long"))


@query("window_resolver", "SELECT 'rolling_24h' AS kind, TIMESTAMP '2024-01-30 00:00:00' AS start_at, TIMESTAMP '2024-01-31 00:00:00' AS end_at, count_if(occurred_at >= TIMESTAMP '2024-01-30 00:00:00' AND occurred_at <= TIMESTAMP '2024-01-31 00:00:00')::BIGINT AS n FROM alarms UNION ALL SELECT 'calendar_month_local', TIMESTAMP '2024-01-01 05:00:00', TIMESTAMP '2024-02-01 04:59:59.999999', count_if(occurred_at >= TIMESTAMP '2024-01-01 05:00:00' AND occurred_at <= TIMESTAMP '2024-02-01 04:59:59.999999')::BIGINT FROM alarms UNION ALL SELECT 'custom', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-31 00:00:00', count_if(occurred_at >= TIMESTAMP '2024-01-20 00:00:00' AND occurred_at <= TIMESTAMP '2024-01-31 00:00:00')::BIGINT FROM alarms")
def window_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of a report's three kinds, and the alarms in each: one scan."""
    start, end = F.expr("TIMESTAMP '2024-01-20 00:00:00'"), F.lit(d.AS_OF).cast("timestamp")
    kinds = ("rolling_24h", "calendar_month_local", "custom")
    bounds = {k: x.window_bounds(k, start, end, d.ZONE) for k in kinds}
    counts = d.alarms(spark, sf_dir).agg(*[F.count_if(F.col("occurred_at").between(*bounds[k])).alias(k) for k in kinds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), bounds[k][0].alias("start_at"), bounds[k][1].alias("end_at"), F.col(k).alias("n")) for k in kinds])).alias("r")).select("r.*")


def in_facets(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Rows that every facet takes: a facet with nothing chosen takes all."""
    for column, values in chosen.items():
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


@query("facet_filter", f"{RAW_SQL} SELECT company_slug, source, count(*) AS n FROM raw WHERE source IN ('live', 'catchup') AND mapped IN ('Bostezo', 'Ojos cerrados') GROUP BY ALL")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_facets(raw(spark, sf_dir), {"source": ["live", "catchup"], "mapped": ["Bostezo", "Ojos cerrados"], "temporal_status": []})
    return rows.groupBy("company_slug", "source").agg(F.count("*").alias("n"))


@query(
    "allowed_order",
    """, own AS (SELECT DISTINCT fleet_id, CASE WHEN fleet_id = 'F4' THEN 'x ' || category ELSE category END AS category FROM alarms WHERE user_id % 7 = 1 AND hour BETWEEN 1 AND 2), known AS (SELECT o.fleet_id, c.category, c.position FROM own o JOIN categories c USING (category)),
    f AS (SELECT DISTINCT fleet_id FROM own) SELECT fleet_id, array_to_string(list(category ORDER BY position), ',') AS shown FROM (SELECT * FROM known UNION ALL SELECT f.fleet_id, c.category, c.position FROM f, categories c WHERE f.fleet_id NOT IN (SELECT fleet_id FROM known)) GROUP BY fleet_id""",
)
def allowed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that a fleet lists, in canonical order; all of them where what it lists names none."""
    told = d.alarms(spark, sf_dir).filter("user_id % 7 = 1 and hour between 1 and 2")
    rules = told.groupBy("fleet_id").agg(F.collect_set(F.when(F.col("fleet_id") == "F4", F.concat(F.lit("x "), "category")).otherwise(F.col("category"))).alias("allowed"))  # eight at most
    canonical = F.array(*[F.lit(c) for c, _, _ in CATEGORIES])
    own = F.array_intersect(canonical, F.col("allowed"))
    return rules.select("fleet_id", F.array_join(F.when(F.size(own) > 0, own).otherwise(canonical), ",").alias("shown"))


REPORTED_SQL = f"""{RAW_SQL}, {PORTAL_SQL.strip()}, {SESSION_SQL.strip()},
shown AS (SELECT guid, row_number() OVER (PARTITION BY plate, category, session_no ORDER BY occurred_at, event_id) AS nth, arg_min(guid, (occurred_at, event_id)) OVER (PARTITION BY plate, category, session_no) AS episode FROM s WHERE NOT (category = 'Distraccion')),
stored AS (SELECT * FROM raw WHERE event_id % 11 <> 0),
recon AS (SELECT f.guid, f.company_slug, f.device_id, f.copies, f.begin_at, f.event_id, l.source, l.guid IS NOT NULL AS in_raw, p.status AS class, p.occurred_at > p.received_at + INTERVAL 5 MINUTE AS future,
  CASE WHEN p.occurred_at > p.received_at + INTERVAL 5 MINUTE THEN 'rejected_temporal' WHEN p.status = 'classified_non_dms' THEN 'classified_non_dms' WHEN p.status = 'unmapped' THEN 'unmapped' WHEN l.guid IS NULL THEN 'missing_local' WHEN l.event_id % 19 = 0 THEN 'stored_local_unmapped' WHEN w.guid IS NULL THEN 'suppressed_by_rule' WHEN w.nth = 1 THEN 'visible_episode' ELSE 'fused_in_episode' END AS reason, w.episode
  FROM firsts f JOIN raw p ON p.event_id = f.event_id LEFT JOIN stored l ON l.guid = f.guid LEFT JOIN shown w ON w.guid = f.guid)"""


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each guid that the portal shows with what is stored of it and what became of it: portal, raw layer and episodes by left joins."""
    from haulmark.operators.sessions import sessionize
    from haulmark.plans.episodes import gap_minutes
    from pyspark.sql import Window

    every = raw(spark, sf_dir)
    rows = sessionize(d.kept(spark, sf_dir), ["plate", "category"], "occurred_at", gap_minutes(), "event_id").filter("category <> 'Distraccion'")
    w = Window.partitionBy("plate", "category", "session_no").orderBy("occurred_at", "event_id")
    shown = rows.select("guid", F.row_number().over(w).alias("nth"), F.first("guid").over(w).alias("episode"))
    p = firsts(portal(spark, sf_dir)).select("guid", "company_slug", "device_id", "copies", "begin_at", "event_id")
    told = every.select("event_id", F.col("status").alias("class"), x.in_future(F.col("occurred_at"), F.col("received_at")).alias("future"))
    stored = every.filter("event_id % 11 <> 0").select("guid", "source", F.lit(True).alias("in_raw"), (F.col("event_id") % 19 == 0).alias("other"))
    both = p.join(told, "event_id").join(stored, "guid", "left").join(shown, "guid", "left").withColumn("in_raw", F.coalesce("in_raw", F.lit(False)))
    reason = F.when(F.col("future"), "rejected_temporal").when(F.col("class") == "classified_non_dms", "classified_non_dms").when(F.col("class") == "unmapped", "unmapped").when(~F.col("in_raw"), "missing_local")
    reason = reason.when(F.col("other"), "stored_local_unmapped").when(F.col("nth").isNull(), "suppressed_by_rule").when(F.col("nth") == 1, "visible_episode").otherwise("fused_in_episode")
    return both.select("guid", "company_slug", "device_id", "copies", "begin_at", "event_id", "source", "in_raw", "class", "future", reason.alias("reason"), "episode")


@query("reconcile_full", f"{REPORTED_SQL} SELECT guid, company_slug, copies, source, in_raw, class, future, reason, episode FROM recon")
def reconcile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation(spark, sf_dir).select("guid", "company_slug", "copies", "source", "in_raw", "class", "future", "reason", "episode")


@query(
    "reconcile_counters",
    f"""{REPORTED_SQL} SELECT company_slug, count(*) AS portal_rows, count_if(source = 'live')::BIGINT AS live, count_if(source IN ('backfill', 'catchup'))::BIGINT AS backfill, count_if(class = 'classified_dms')::BIGINT AS dms, count_if(class = 'classified_non_dms')::BIGINT AS non_dms, count_if(class = 'unmapped')::BIGINT AS unmapped,
    count_if(future)::BIGINT AS rejected_temporal, count_if(reason IN ('missing_local', 'stored_local_unmapped'))::BIGINT AS missing_local, count_if(reason IN ('visible_episode', 'fused_in_episode'))::BIGINT AS visible_events, count_if(reason = 'suppressed_by_rule')::BIGINT AS suppressed, count(DISTINCT episode) FILTER (reason IN ('visible_episode', 'fused_in_episode')) AS visible_episodes FROM recon GROUP BY company_slug""",
)
def reconcile_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's counters over distinct guids, with the episodes that can be seen."""
    n, reason, kind = F.count_if, F.col("reason"), F.col("class")
    seen = reason.isin("visible_episode", "fused_in_episode")
    return reconciliation(spark, sf_dir).groupBy("company_slug").agg(
        F.count("*").alias("portal_rows"), n(F.col("source") == "live").alias("live"), n(F.col("source").isin("backfill", "catchup")).alias("backfill"), n(kind == "classified_dms").alias("dms"), n(kind == "classified_non_dms").alias("non_dms"), n(kind == "unmapped").alias("unmapped"),
        n("future").alias("rejected_temporal"), n(reason.isin("missing_local", "stored_local_unmapped")).alias("missing_local"), n(seen).alias("visible_events"), n(reason == "suppressed_by_rule").alias("suppressed"), F.count_distinct(F.when(seen, F.col("episode"))).alias("visible_episodes"),
    )


CANDIDATE_SQL = "class = 'classified_dms' AND (reason IN ('missing_local', 'rejected_temporal') OR reason LIKE 'stored_local_%')"


def manual_candidates(rows: DataFrame) -> DataFrame:
    """What people have to decide: driver alarms that are missing here, were rejected for their time, or are stored as something else."""
    return rows.filter((F.col("class") == "classified_dms") & (F.col("reason").isin("missing_local", "rejected_temporal") | F.col("reason").startswith("stored_local_")))


@query("review_payloads", f"{REPORTED_SQL} SELECT sha256(r.company_slug || '|' || r.guid || '|' || r.device_id || '|' || strftime(r.begin_at, '%Y-%m-%d %H:%M:%S')) AS review_key, r.reason, p.portal_id, p.tp FROM recon r JOIN portal p ON p.company_slug = r.company_slug AND p.guid = r.guid AND p.device_id = r.device_id AND date_trunc('second', p.begin_at) = date_trunc('second', r.begin_at) WHERE {CANDIDATE_SQL}")
def review_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the portal's payload, joined by the hash that names a review."""
    key = F.sha2(F.concat_ws("|", "company_slug", "guid", "device_id", F.date_format("begin_at", "yyyy-MM-dd HH:mm:ss")), 256)
    payload = portal(spark, sf_dir).filter("guid is not null").select(key.alias("review_key"), "portal_id", "tp")
    return manual_candidates(reconciliation(spark, sf_dir)).select(key.alias("review_key"), "reason").join(payload, "review_key")


ALL_QUEUES_SQL = f"""{BASE_SQL}, {SESSION_SQL.strip()}, {DEVIATION_SQL.strip()}, {PORTAL_SQL.strip()}, {QUEUE_SQL.strip()},
reviews AS (SELECT review_key, action, company_slug, state FROM states UNION ALL SELECT sha256('suppressed|' || plate || '|' || session_id), 'review_visibility', substr(plate, 1, 1), 'pending' FROM judged WHERE category = 'Ojos cerrados' AND n = 1 AND NOT approved
  UNION ALL SELECT sha256('reconcile|' || f.company_slug || '|' || f.guid), 'reconcile', f.company_slug, 'pending' FROM firsts f LEFT JOIN local l USING (guid) WHERE l.guid IS NULL)"""


@query("review_sources_all", f"{ALL_QUEUES_SQL} SELECT company_slug, action, state, count(*) AS n, count(DISTINCT review_key) AS keys FROM reviews GROUP BY ALL")
def review_sources_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five sources of the review queue under keys of their own: anomalies, raw rows, distances, suppressed sessions, and what reconciling misses."""
    from haulmark.plans.reconcile import local

    key = lambda kind, *c: F.sha2(F.concat_ws("|", F.lit(kind), *c), 256).alias("review_key")
    alone = sessions(spark, sf_dir).filter("category = 'Ojos cerrados' and n = 1 and not approved")
    suppressed = alone.select(key("suppressed", "plate", "session_id"), F.lit("review_visibility").alias("action"), F.substring("plate", 1, 1).alias("company_slug"), F.lit("pending").alias("state"))
    missing = firsts(portal(spark, sf_dir)).join(local(spark, sf_dir), "guid", "left_anti").select(key("reconcile", "company_slug", "guid"), F.lit("reconcile").alias("action"), "company_slug", F.lit("pending").alias("state"))
    rows = queue(spark, sf_dir).select("review_key", "action", "company_slug", "state").unionByName(suppressed).unionByName(missing)
    return rows.groupBy("company_slug", "action", "state").agg(F.count("*").alias("n"), F.count_distinct("review_key").alias("keys"))


@query("portal_apply", f"{REPORTED_SQL} SELECT guid, company_slug, CASE WHEN in_raw THEN 'updated' ELSE 'inserted' END AS raw_result, CASE WHEN class <> 'classified_dms' THEN 'none' WHEN future THEN 'forced' WHEN in_raw THEN 'updated' ELSE 'inserted' END AS event_result FROM recon WHERE {CANDIDATE_SQL}")
def portal_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What approving the candidates writes: the raw layer always, the event layer for driver alarms, with future times accepted by force."""
    rows = manual_candidates(reconciliation(spark, sf_dir))
    event = F.when(F.col("class") != "classified_dms", "none").when(F.col("future"), "forced").when(F.col("in_raw"), "updated").otherwise("inserted")
    return rows.select("guid", "company_slug", F.when(F.col("in_raw"), "updated").otherwise("inserted").alias("raw_result"), event.alias("event_result"))


@query(
    "reconcile_type_anti",
    f", {PORTAL_SQL.strip()} SELECT p.portal_id FROM portal p WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.device_id = p.device_id AND l.category = p.category AND date_trunc('second', l.occurred_at) = date_trunc('second', p.begin_at) AND coalesce(l.tp, '') = coalesce(p.tp, ''))",
)
def reconcile_type_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal rows without a local alarm of the device, category, second and type, types compared trimmed and in lower case."""
    form = lambda df, at, kind: df.select(*df.columns, F.date_trunc("second", F.col(at)).alias("second"), F.lower(F.trim(kind)).alias("kind"))
    p = form(portal(spark, sf_dir), "begin_at", F.concat(F.lit(" T"), F.coalesce("tp", F.lit("")), F.lit(" ")))
    l = form(d.alarms(spark, sf_dir).filter("event_id % 11 <> 0"), "occurred_at", F.concat(F.lit("t"), F.coalesce("tp", F.lit(""))))  # noqa: E741
    return p.join(l, ["device_id", "category", "second", "kind"], "left_anti").select("portal_id")


@query("json_pick_deep", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN device_id WHEN 1 THEN 'in-ext' WHEN 2 THEN 'deep' END AS found FROM alarms")
def json_pick_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value by name at the top of a message, else in its nested objects, two levels down, in their fixed order; empty ones don't count."""
    from haulmark.sources.messages import opened, pick_deep

    k = F.col("event_id") % 4
    doc = F.when(k == 0, F.concat(F.lit('{"ext":{"deviceno":"no"},"deviceno":"'), "device_id", F.lit('"}'))).when(k == 1, F.lit('{"deviceno":"","payload":{"x":1},"ext":{"deviceno":"in-ext"}}')).when(k == 2, F.lit('{"payload":{"det":{"deviceno":"deep"}},"module":{"deviceno":""}}')).otherwise(F.lit("{}"))
    return opened(d.alarms(spark, sf_dir).select("event_id", doc.alias("body")), ["event_id"]).select("event_id", pick_deep("deviceno").alias("found"))


@query("demultiplex", "SELECT kind, count(*) AS n, max(CASE WHEN kind = 'alarm' THEN received_at END) AS last_alarm FROM (SELECT received_at, CASE event_id % 5 WHEN 0 THEN 'status' WHEN 1 THEN 'alarm' WHEN 2 THEN 'heartbeat' WHEN 3 THEN 'wrong_shape' ELSE 'raw_text' END AS kind FROM alarms) GROUP BY kind")
def demultiplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live messages by their action code; those of another shape are anomalies. Alarms are telemetry: only their last time is kept."""
    from haulmark.sources.messages import by_action

    k = F.col("event_id") % 5
    doc = F.when(k == 0, F.lit('{"action":"80003","payload":{"a":1}}')).when(k == 1, F.lit('{"action":80004,"payload":{"a":1}}')).when(k == 2, F.lit('{"action":"80009"}')).when(k == 3, F.lit('{"action":"80003","payload":[1]}')).otherwise(F.lit("no json"))
    rows = by_action(d.alarms(spark, sf_dir).select("received_at", doc.alias("value")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "alarm", F.col("received_at"))).alias("last_alarm"))


@query(
    "snapshot_overlay",
    "SELECT company_slug, '{\"feed\":\"' || CASE WHEN max(received_at) > TIMESTAMP '2024-01-30 23:40:00' THEN 'online' ELSE 'late' END || '\",\"anomalies_24h\":' || count_if(occurred_at > received_at + INTERVAL 5 MINUTE AND received_at >= TIMESTAMP '2024-01-30 00:00:00') || ',\"alarms\":' || count_if(review IS DISTINCT FROM 'discarded' AND day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') || '}' AS snapshot FROM alarms GROUP BY company_slug",
)
def snapshot_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored snapshot with its live fields put in anew: the feed's state and the anomalies of the last day."""
    stored = d.month(spark, sf_dir).groupBy("company_slug").agg(F.to_json(F.struct(F.lit("old").alias("feed"), F.lit(0).cast("long").alias("anomalies_24h"), F.count("*").alias("alarms"))).alias("snapshot"))
    late = F.count_if(x.in_future(F.col("occurred_at"), F.col("received_at")) & (F.col("received_at") >= F.expr("TIMESTAMP '2024-01-30 00:00:00'")))
    feed = F.when(F.max("received_at") > F.expr("TIMESTAMP '2024-01-30 23:40:00'"), "online").otherwise("late")
    live = d.alarms(spark, sf_dir).groupBy("company_slug").agg(feed.alias("feed"), late.alias("anomalies_24h"))
    body = F.from_json("snapshot", "feed string, anomalies_24h long, alarms long")
    return stored.join(live, "company_slug").select("company_slug", F.to_json(body.withField("feed", F.col("feed")).withField("anomalies_24h", F.col("anomalies_24h"))).alias("snapshot"))


SECTION_SQL = """, cells AS (SELECT company_slug, plate, day, hour, category, coalesce(nullif(tp, ''), category) AS subtype, count(*) AS n FROM month GROUP BY ALL),
sections AS (SELECT company_slug, 'series' AS section, category AS k1, CAST(day AS VARCHAR) AS k2, sum(n) AS n FROM cells GROUP BY ALL UNION ALL SELECT company_slug, 'heat', category, CAST(hour AS VARCHAR), sum(n) FROM cells GROUP BY ALL
  UNION ALL SELECT company_slug, 'today_category', category, '', sum(n) FROM cells WHERE day = DATE '2024-01-30' GROUP BY ALL UNION ALL SELECT company_slug, 'today_vehicle', plate, '', sum(n) FROM cells WHERE day = DATE '2024-01-30' GROUP BY ALL
  UNION ALL SELECT company_slug, 'vehicle_category', plate, category, sum(n) FROM cells GROUP BY ALL UNION ALL SELECT company_slug, 'vehicle_night', plate, '', sum(n) FROM cells WHERE hour >= 22 OR hour < 5 GROUP BY ALL
  UNION ALL SELECT company_slug, 'week_vehicle_day', plate, CAST(day AS VARCHAR), sum(n) FROM cells WHERE day > DATE '2024-01-23' GROUP BY ALL UNION ALL SELECT company_slug, 'week_category_vehicle', category, plate, sum(n) FROM cells WHERE day > DATE '2024-01-23' GROUP BY ALL
  UNION ALL SELECT company_slug, 'severity', coalesce(severity, 'medio'), '', sum(n) FROM cells LEFT JOIN categories USING (category) GROUP BY ALL UNION ALL SELECT company_slug, 'subtype', subtype, category, sum(n) FROM cells GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY company_slug, section ORDER BY n DESC, k1, k2) AS place FROM sections)"""


@query("snapshot_sections", f"{SECTION_SQL} SELECT company_slug, section, k1, k2, CAST(n AS BIGINT) AS n FROM ranked WHERE place <= CASE section WHEN 'today_vehicle' THEN 8 WHEN 'subtype' THEN 20 ELSE 1000000000 END")
def snapshot_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counted parts of a company's snapshot, a row an entry: series, heat, today, vehicles, the week's matrices, severities and subtypes.

    One aggregate over the month gives cells; each cell goes into the sections that hold it and is added up there. Ranked sections keep
    their first entries.
    """
    from pyspark.sql import Window

    subtype = F.coalesce(F.nullif("tp", F.lit("")), F.col("category"))
    cells = d.month(spark, sf_dir).groupBy("company_slug", "plate", "day", "hour", "category", subtype.alias("subtype")).agg(F.count("*").alias("n"))
    severity = F.coalesce(F.element_at(F.create_map(*[v for c, _, s in CATEGORIES for v in (F.lit(c), F.lit(s))]), F.col("category")), F.lit("medio"))
    today, week = F.col("day") == F.expr(d.LAST_DAY), F.col("day") > F.expr(f"date_sub({d.LAST_DAY}, 7)")
    entry = lambda name, k1, k2=None: F.struct(F.lit(name).alias("section"), (k1 if isinstance(k1, Column) else F.col(k1)).alias("k1"), (F.lit("") if k2 is None else F.col(k2).cast("string")).alias("k2"))
    parts = [
        entry("series", "category", "day"), entry("heat", "category", "hour"), F.when(today, entry("today_category", "category")), F.when(today, entry("today_vehicle", "plate")), entry("vehicle_category", "plate", "category"),
        F.when(x.is_night(F.col("hour")), entry("vehicle_night", "plate")), F.when(week, entry("week_vehicle_day", "plate", "day")), F.when(week, entry("week_category_vehicle", "category", "plate")), entry("severity", severity), entry("subtype", "subtype", "category"),
    ]
    sums = cells.select("company_slug", F.explode(F.array_compact(F.array(*parts))).alias("e"), "n").groupBy("company_slug", "e.section", "e.k1", "e.k2").agg(F.sum("n").alias("n"))
    most = F.when(F.col("section") == "today_vehicle", 8).when(F.col("section") == "subtype", 20)
    some = sums.filter(most.isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("company_slug", "section").orderBy(F.desc("n"), "k1", "k2"))).filter(F.col("place") <= most).drop("place")
    return sums.filter(most.isNull()).unionByName(some)
