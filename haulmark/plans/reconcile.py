"""A provider's portal against the local tables, and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.values import RULES
from haulmark.operators.asof import nearest
from haulmark.plans.register import query
from haulmark.sources import domain as d

PORTAL_SQL = """
portal AS (SELECT 'p' || event_id AS portal_id, CASE WHEN event_id % 3 <> 0 THEN guid END AS guid, device_id, plate, company_slug, category, tp, CAST(occurred_at + to_seconds((event_id % 6 - 2) * 50) AS TIMESTAMP) AS begin_at, event_id FROM alarms WHERE event_id % 13 <> 0
  UNION ALL SELECT 'q' || event_id, guid, device_id, plate, company_slug, category, tp, occurred_at, event_id FROM alarms WHERE event_id % 17 = 0),
local AS (SELECT * FROM alarms WHERE event_id % 11 <> 0),
firsts AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY portal_id) AS n, count(*) OVER (PARTITION BY guid) AS copies FROM portal WHERE guid IS NOT NULL) WHERE n = 1)"""


def portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the provider shows: some rows missing, some twice, a third without guid, begin times off by up to 150 seconds."""
    a = d.alarms(spark, sf_dir)
    cols = ["portal_id", "guid", "device_id", "plate", "company_slug", "category", "tp", "begin_at", "event_id"]
    shift = F.expr("make_dt_interval(0, 0, 0, (event_id % 6 - 2) * 50)")
    main = a.filter("event_id % 13 <> 0").select(F.concat(F.lit("p"), "event_id").alias("portal_id"), F.when(F.col("event_id") % 3 != 0, F.col("guid")).alias("guid"), "device_id", "plate", "company_slug", "category", "tp", (F.col("occurred_at") + shift).alias("begin_at"), "event_id")
    again = a.filter("event_id % 17 = 0").select(F.concat(F.lit("q"), "event_id").alias("portal_id"), "guid", "device_id", "plate", "company_slug", "category", "tp", F.col("occurred_at").alias("begin_at"), "event_id")
    return main.select(cols).unionByName(again.select(cols))


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.alarms(spark, sf_dir).filter("event_id % 11 <> 0")


def firsts(p: DataFrame) -> DataFrame:
    """The first portal row of each guid, with the number of its copies: one grouping."""
    known = p.filter("guid is not null")
    return known.groupBy("guid").agg(F.min_by(F.struct(*[c for c in p.columns if c != "guid"]), "portal_id").alias("r"), F.count("*").alias("copies")).select("guid", "r.*", "copies")


@query("portal_duplicates", f", {PORTAL_SQL.strip()} SELECT guid, count(*) AS copies FROM portal WHERE guid IS NOT NULL GROUP BY guid HAVING count(*) > 1")
def portal_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portal(spark, sf_dir).filter("guid is not null").groupBy("guid").agg(F.count("*").alias("copies")).filter("copies > 1")


STATUS_SQL = "CASE WHEN l.guid IS NULL THEN 'missing_local' WHEN l.review = 'discarded' THEN 'discarded' WHEN l.occurred_at > l.received_at + INTERVAL 5 MINUTE THEN 'future_rejected' ELSE 'matched' END"


@query("reconcile_drilldown", f", {PORTAL_SQL.strip()} SELECT f.guid, f.portal_id, f.copies, {STATUS_SQL} AS status FROM firsts f LEFT JOIN local l USING (guid)")
def reconcile_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = firsts(portal(spark, sf_dir)).select("guid", "portal_id", "copies")
    both = p.join(local(spark, sf_dir).select("guid", "review", "occurred_at", "received_at", F.lit(True).alias("found")), "guid", "left")
    status = F.when(F.col("found").isNull(), "missing_local").when(F.col("review") == "discarded", "discarded").when(F.col("occurred_at") > F.col("received_at") + F.expr("INTERVAL 5 MINUTES"), "future_rejected").otherwise("matched")
    return both.select("guid", "portal_id", "copies", status.alias("status"))


@query("reconcile_summary", f", {PORTAL_SQL.strip()}, dd AS (SELECT f.company_slug, f.copies, {STATUS_SQL} AS status FROM firsts f LEFT JOIN local l USING (guid)) SELECT company_slug, status, count(*) AS n, CAST(sum(copies) AS BIGINT) AS portal_rows FROM dd GROUP BY ALL")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = firsts(portal(spark, sf_dir)).select("guid", "company_slug")
    return reconcile_drilldown(spark, sf_dir).join(who, "guid").groupBy("company_slug", "status").agg(F.count("*").alias("n"), F.sum("copies").alias("portal_rows"))


@query(
    "reconcile_nearest_120s",
    f""", {PORTAL_SQL.strip()}, n AS (SELECT p.portal_id, l.guid, abs(epoch_us(p.begin_at) - epoch_us(l.occurred_at)) / 1000000.0 AS delta_seconds, row_number() OVER (PARTITION BY p.portal_id ORDER BY abs(epoch_us(p.begin_at) - epoch_us(l.occurred_at)), l.event_id) AS k
    FROM portal p JOIN local l ON p.device_id = l.device_id AND p.category = l.category AND abs(epoch_us(p.begin_at) - epoch_us(l.occurred_at)) <= 120000000 WHERE p.guid IS NULL) SELECT portal_id, guid, delta_seconds FROM n WHERE k = 1""",
)
def reconcile_nearest_120s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal rows without guid take the nearest local alarm of the device and category within two minutes."""
    p = portal(spark, sf_dir).filter("guid is null").select("portal_id", "device_id", "category", "begin_at")
    l = local(spark, sf_dir).select("device_id", "category", "occurred_at", "guid", "event_id")  # noqa: E741
    return nearest(p, l, ["device_id", "category"], "begin_at", "occurred_at", RULES["match_seconds"], "portal_id", F.col("event_id")).select("portal_id", "guid", "delta_seconds")


@query("reconcile_anti", f", {PORTAL_SQL.strip()} SELECT p.portal_id FROM portal p WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.device_id = p.device_id AND l.category = p.category AND date_trunc('second', l.occurred_at) = date_trunc('second', p.begin_at))")
def reconcile_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda df, c: df.withColumn("second", F.date_trunc("second", F.col(c)))
    return key(portal(spark, sf_dir), "begin_at").join(key(local(spark, sf_dir), "occurred_at"), ["device_id", "category", "second"], "left_anti").select("portal_id")


@query("class_breakdown", f", {PORTAL_SQL.strip()} SELECT coalesce(a.category, b.category) AS category, coalesce(a.n, 0) AS portal_n, coalesce(b.n, 0) AS local_n FROM (SELECT category, count(*) AS n FROM portal GROUP BY 1) a FULL JOIN (SELECT category, count(*) AS n FROM local GROUP BY 1) b ON a.category = b.category")
def class_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = portal(spark, sf_dir).groupBy("category").agg(F.count("*").alias("portal_n"))
    b = local(spark, sf_dir).groupBy("category").agg(F.count("*").alias("local_n"))
    return a.join(b, "category", "full").select("category", F.coalesce("portal_n", F.lit(0)).alias("portal_n"), F.coalesce("local_n", F.lit(0)).alias("local_n"))


QUEUE_SQL = """
queue AS (SELECT sha256('anomaly|' || company_slug || '|' || guid) AS review_key, 'review_anomaly' AS action, company_slug, occurred_at AS updated_at, review FROM alarms WHERE occurred_at > received_at + INTERVAL 5 MINUTE
  UNION ALL SELECT sha256('raw|' || company_slug || '|' || guid), 'review_raw', company_slug, occurred_at, review FROM alarms WHERE event_id % 29 = 0
  UNION ALL SELECT sha256('km|' || company_slug || '|' || device_id || '|' || day), 'review_km', company_slug, observed_at, NULL FROM daily WHERE day_km > 1000),
states AS (SELECT *, coalesce(review, 'pending') AS state FROM queue)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review candidates of three sources under hashed keys; a union whose keys don't overlap, so nothing is de-duplicated."""
    a = d.alarms(spark, sf_dir)
    key = lambda kind, *c: F.sha2(F.concat_ws("|", F.lit(kind), *c), 256).alias("review_key")
    part = lambda df, kind, action, ts, review, *c: df.select(key(kind, *c), F.lit(action).alias("action"), "company_slug", F.col(ts).alias("updated_at"), review.alias("review"))
    future = a.filter(F.col("occurred_at") > F.col("received_at") + F.expr("INTERVAL 5 MINUTES"))
    km = d.daily(spark, sf_dir).filter("day_km > 1000")
    out = part(future, "anomaly", "review_anomaly", "occurred_at", F.col("review"), "company_slug", "guid").unionByName(part(a.filter("event_id % 29 = 0"), "raw", "review_raw", "occurred_at", F.col("review"), "company_slug", "guid"))
    out = out.unionByName(part(km, "km", "review_km", "observed_at", F.lit(None).cast("string"), "company_slug", "device_id", "day"))
    return out.withColumn("state", F.coalesce("review", F.lit("pending")))


@query("review_facets", f", {QUEUE_SQL.strip()} SELECT company_slug, action, state, count(*) AS n FROM states GROUP BY ALL")
def review_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(spark, sf_dir).groupBy("company_slug", "action", "state").agg(F.count("*").alias("n"))


@query("review_page", f", {QUEUE_SQL.strip()} SELECT review_key, action, state, updated_at FROM states WHERE state = 'pending' ORDER BY updated_at DESC, review_key LIMIT 100")
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(spark, sf_dir).filter("state = 'pending'").orderBy(F.desc("updated_at"), "review_key").limit(100).select("review_key", "action", "state", "updated_at")


@query("review_latest_pending", f", {QUEUE_SQL.strip()} SELECT action, max(updated_at) AS latest, arg_max(review_key, (updated_at, review_key)) AS review_key FROM states WHERE state = 'pending' GROUP BY action")
def review_latest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(spark, sf_dir).filter("state = 'pending'").groupBy("action").agg(F.max("updated_at").alias("latest"), F.max_by("review_key", F.struct("updated_at", "review_key")).alias("review_key"))


@query("review_stale", f", {QUEUE_SQL.strip()} SELECT a.company_slug, max(a.received_at) AS source_at, q.review_at, max(a.received_at) > q.review_at AS stale FROM alarms a JOIN (SELECT company_slug, max(updated_at) AS review_at FROM states GROUP BY 1) q USING (company_slug) GROUP BY a.company_slug, q.review_at")
def review_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = d.alarms(spark, sf_dir).groupBy("company_slug").agg(F.max("received_at").alias("source_at"))
    seen = queue(spark, sf_dir).groupBy("company_slug").agg(F.max("updated_at").alias("review_at"))
    return source.join(seen, "company_slug").withColumn("stale", F.col("source_at") > F.col("review_at"))


@query("review_decide", f", {QUEUE_SQL.strip()} SELECT review_key, CASE WHEN state = 'pending' AND action = 'review_raw' THEN 'approved' ELSE state END AS state FROM states")
def review_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk decision: all pending raw reviews are approved."""
    from haulmark.operators.upserts import keep_latest

    old = queue(spark, sf_dir).select("review_key", "state")
    new = queue(spark, sf_dir).filter("state = 'pending' and action = 'review_raw'").select("review_key", F.lit("approved").alias("state"))
    return keep_latest(old, new, ["review_key"], F.col("state"))


@query("drivers_last_known", "SELECT device_id, max_by(tp, (occurred_at, event_id)) FILTER (event_id % 4 = 0) AS last_tp FROM alarms GROUP BY device_id")
def drivers_last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value that isn't missing, in order of time."""
    return d.alarms(spark, sf_dir).groupBy("device_id").agg(F.max_by("tp", F.when(F.col("event_id") % 4 == 0, F.struct("occurred_at", "event_id"))).alias("last_tp"))
