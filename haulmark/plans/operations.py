"""Tenants, vehicles, fleets, windows and recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.functions import expressions as x
from haulmark.operators.tenants import first_match, members
from haulmark.plans.ingest import CLASS_SQL, classified
from haulmark.plans.register import query
from haulmark.sources import domain as d

COMPANY_SQL = """
companies(slug, position) AS (VALUES ('north', 0), ('south', 1), ('mixed', 2), ('all', 3)),
member AS (SELECT a.*, c.slug, c.position AS company_position FROM alarms a JOIN companies c ON CASE c.slug WHEN 'north' THEN a.user_id < 40 WHEN 'south' THEN a.fleet_id IN ('F1', 'F3') WHEN 'mixed' THEN a.device_id IN ('D00003', 'D00005') ELSE true END)"""


@query("membership_join", f", {COMPANY_SQL.strip()} SELECT slug, category, count(*) AS n, count(DISTINCT device_id) AS devices FROM member GROUP BY ALL")
def membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = members(d.alarms(spark, sf_dir).select("device_id", "fleet_id", "category"), d.companies(spark))
    return found.groupBy("slug", "category").agg(F.count("*").alias("n"), F.count_distinct("device_id").alias("devices"))


@query("tenant_first_match", f", {COMPANY_SQL.strip()} SELECT device_id, arg_min(slug, company_position) AS slug FROM member GROUP BY device_id")
def tenant_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = d.alarms(spark, sf_dir).select("device_id", "fleet_id").distinct()
    return first_match(devices, d.companies(spark), "device_id")


@query("any_tenant_semi", f", {COMPANY_SQL.strip()} SELECT DISTINCT device_id FROM member WHERE slug <> 'all'")
def any_tenant_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of any company that lists some."""
    devices = d.alarms(spark, sf_dir).select("device_id", "fleet_id").distinct()
    return members(devices, d.companies(spark).filter("slug <> 'all'")).select("device_id").distinct()


@query(
    "vehicle_status",
    """SELECT l.device_id, l.plate, l.total_km, a.last_alarm, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - l.observed_at) / 60) AS BIGINT) AS age_minutes,
    CASE WHEN floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - l.observed_at) / 60) < 20 THEN 'online' WHEN floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - l.observed_at) / 60) < 45 THEN 'delayed' ELSE 'stopped' END AS feed_status
    FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY observed_at DESC, event_id) AS n FROM readings) l LEFT JOIN (SELECT device_id, arg_max(coalesce(occurred_at, received_at), (received_at, event_id)) AS last_alarm FROM alarms GROUP BY 1) a USING (device_id) WHERE l.n = 1""",
)
def vehicle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest reading and alarm of each device."""
    last = d.readings(spark, sf_dir).groupBy("device_id").agg(F.max_by(F.struct("plate", "total_km", "observed_at"), F.struct("observed_at", -F.col("event_id"))).alias("r")).select("device_id", "r.*")
    alarm = d.alarms(spark, sf_dir).groupBy("device_id").agg(F.max_by(F.coalesce("occurred_at", "received_at"), F.struct("received_at", "event_id")).alias("last_alarm"))
    age = F.floor((F.unix_micros(F.lit(d.AS_OF).cast("timestamp")) - F.unix_micros("observed_at")) / 60_000_000)
    return last.join(alarm, "device_id", "left").select("device_id", "plate", "total_km", "last_alarm", age.alias("age_minutes"), x.feed_status(age).alias("feed_status"))


@query(
    "fleet_candidates",
    """SELECT coalesce(f.fleet_id, a.fleet_id) AS fleet_id, coalesce(f.devices, 0) AS devices, coalesce(a.recent, 0) AS recent_alarms, a.last_at FROM (SELECT fleet_id, count(DISTINCT device_id) AS devices FROM readings WHERE fleet_id <> 'F4' GROUP BY 1) f
    FULL JOIN (SELECT fleet_id, count(*) AS recent, max(occurred_at) AS last_at FROM alarms WHERE fleet_id <> 'F0' AND occurred_at >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1) a ON f.fleet_id = a.fleet_id""",
)
def fleet_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = d.readings(spark, sf_dir).filter("fleet_id <> 'F4'").groupBy("fleet_id").agg(F.count_distinct("device_id").alias("devices"))
    a = d.alarms(spark, sf_dir).filter("fleet_id <> 'F0' and occurred_at >= TIMESTAMP '2024-01-30 00:00:00'").groupBy("fleet_id").agg(F.count("*").alias("recent_alarms"), F.max("occurred_at").alias("last_at"))
    return f.join(a, "fleet_id", "full").select("fleet_id", F.coalesce("devices", F.lit(0)).alias("devices"), F.coalesce("recent_alarms", F.lit(0)).alias("recent_alarms"), "last_at")


@query("fleet_samples", "SELECT fleet_id, count(DISTINCT plate) AS vehicles, array_to_string(list(DISTINCT plate ORDER BY plate)[1:5], ',') AS sample FROM alarms GROUP BY fleet_id")
def fleet_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five plates of each fleet: distinct plates are ranked, never collected whole."""
    one = d.alarms(spark, sf_dir).select("fleet_id", "plate").distinct().withColumn("n", F.row_number().over(Window.partitionBy("fleet_id").orderBy("plate")))
    return one.groupBy("fleet_id").agg(F.count("*").alias("vehicles"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.col("plate")))), ",").alias("sample"))


@query("recency_max", f", {CLASS_SQL.strip()} SELECT company_slug, max(occurred_at) FILTER (status = 'classified_dms') AS last_accepted, max(coalesce(occurred_at, received_at)) AS last_raw, max(occurred_at) FILTER (review = 'approved') AS last_approved FROM classes GROUP BY company_slug")
def recency_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda c: F.max(F.when(c, F.col("occurred_at")))
    return classified(spark, sf_dir).groupBy("company_slug").agg(when(F.col("status") == "classified_dms").alias("last_accepted"), F.max(F.coalesce("occurred_at", "received_at")).alias("last_raw"), when(F.col("review") == "approved").alias("last_approved"))


@query("cut_alignment", "SELECT time_bucket(INTERVAL 15 MINUTE, occurred_at) AS cut_at, count(*) AS n FROM alarms GROUP BY 1")
def cut_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.alarms(spark, sf_dir).groupBy(x.cut_start(F.col("occurred_at")).alias("cut_at")).agg(F.count("*").alias("n"))


@query("sliding_cut_window", "SELECT time_bucket(INTERVAL 15 MINUTE, occurred_at) + to_minutes(15 * k.k) - INTERVAL 30 MINUTE AS start_at, count(*) AS n FROM alarms, (SELECT unnest(range(3)) AS k) k GROUP BY 1")
def sliding_cut_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each 15-minute cut reads: the 45 minutes up to it."""
    return d.alarms(spark, sf_dir).groupBy(F.window("occurred_at", "45 minutes", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_at"), "n")


@query("audit_windows", f", {CLASS_SQL.strip()} SELECT w, count(*) AS n, CAST(count(*) FILTER (status = 'unmapped') AS BIGINT) AS unmapped, count(DISTINCT device_id) AS devices FROM classes, (VALUES ('month', 30), ('week', 7), ('day', 1)) v(w, n_days) WHERE day > DATE '2024-01-30' - CAST(n_days AS INTEGER) AND day <= DATE '2024-01-30' GROUP BY w")
def audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested windows from one scan: a row counts in each window that holds it."""
    rows = classified(spark, sf_dir).filter(F.col("day").between(F.expr(f"date_sub({d.LAST_DAY}, 29)"), F.expr(d.LAST_DAY)))
    age = F.date_diff(F.expr(d.LAST_DAY), "day")
    in_windows = F.array_compact(F.array(F.lit("month"), F.when(age < 7, F.lit("week")), F.when(age < 1, F.lit("day"))))
    return rows.withColumn("w", F.explode(in_windows)).groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "unmapped").alias("unmapped"), F.count_distinct("device_id").alias("devices"))


NOTES = [("acme", "gps outage", "2024-01-05", "2024-01-09"), ("beta", "camera swap", "2024-01-20", None), ("gamma", "before", "2023-12-01", "2023-12-31")]


@query("quality_note_overlap", "SELECT m.company_slug, n.title, count(*) AS alarms FROM (VALUES ('acme', 'gps outage', DATE '2024-01-05', DATE '2024-01-09'), ('beta', 'camera swap', DATE '2024-01-20', NULL), ('gamma', 'before', DATE '2023-12-01', DATE '2023-12-31')) n(slug, title, a, b) JOIN month m ON m.company_slug = n.slug AND m.day BETWEEN n.a AND coalesce(n.b, DATE '2024-01-30') GROUP BY ALL")
def quality_note_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = spark.createDataFrame(NOTES, "company_slug string, title string, a string, b string").select("company_slug", "title", F.to_date("a").alias("a"), F.coalesce(F.to_date("b"), F.expr(d.LAST_DAY)).alias("b"))
    return d.month(spark, sf_dir).join(F.broadcast(notes), "company_slug").filter("day between a and b").groupBy("company_slug", "title").agg(F.count("*").alias("alarms"))


@query("labels_union", "SELECT plate FROM alarms UNION SELECT device_id FROM readings")
def labels_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.alarms(spark, sf_dir).select("plate").union(d.alarms(spark, sf_dir).select("device_id")).distinct()


@query("allowed_categories", "SELECT company_slug, count(*) AS n FROM month WHERE CASE company_slug WHEN 'acme' THEN category IN ('Bostezo', 'Uso de celular') WHEN 'beta' THEN category = 'Distraccion' ELSE true END GROUP BY company_slug")
def allowed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's list of categories; an empty list allows all."""
    rules = spark.createDataFrame([("acme", ["Bostezo", "Uso de celular"]), ("beta", ["Distraccion"]), ("gamma", [])], "company_slug string, allowed array<string>")
    both = d.month(spark, sf_dir).join(F.broadcast(rules), "company_slug")
    return both.filter((F.size("allowed") == 0) | F.array_contains("allowed", F.col("category"))).groupBy("company_slug").agg(F.count("*").alias("n"))


@query("latest_run_overview", "SELECT company_slug, arg_max(state, (cut_at, n)) AS latest_state, max(cut_at) AS latest_cut FROM (SELECT company_slug, time_bucket(INTERVAL 15 MINUTE, occurred_at) AS cut_at, count(*) AS n, CASE WHEN count(*) % 3 = 0 THEN 'partial' ELSE 'completed' END AS state FROM alarms GROUP BY ALL) GROUP BY company_slug")
def latest_run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = d.alarms(spark, sf_dir).groupBy("company_slug", x.cut_start(F.col("occurred_at")).alias("cut_at")).agg(F.count("*").alias("n")).withColumn("state", F.when(F.col("n") % 3 == 0, "partial").otherwise("completed"))
    return runs.groupBy("company_slug").agg(F.max_by("state", F.struct("cut_at", "n")).alias("latest_state"), F.max("cut_at").alias("latest_cut"))


@query("tenant_purge_counts", "SELECT 'alarms' AS tbl, count(*) AS n FROM alarms WHERE company_slug = 'beta' OR fleet_id = 'F2' UNION ALL SELECT 'readings', count(*) FROM readings WHERE company_slug = 'beta' OR fleet_id = 'F2'")
def tenant_purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = "company_slug = 'beta' or fleet_id = 'F2'"
    n = lambda name, df: df.filter(scope).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    return n("alarms", d.alarms(spark, sf_dir)).unionByName(n("readings", d.readings(spark, sf_dir)))


@query("order_rollup", "SELECT coalesce(n.n_name, 'all') AS nation, coalesce(o.o_orderpriority, 'all') AS priority, count(*) AS orders, sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ROLLUP (n.n_name, o.o_orderpriority)")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join with a rollup: the small dimensions are broadcast by size, which Spark checks."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.rollup("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))
    return out.select(F.coalesce("n_name", F.lit("all")).alias("nation"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "orders", "revenue")
