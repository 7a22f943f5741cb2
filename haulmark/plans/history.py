"""Replays, slices, markers and whole snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.functions.expressions import is_night
from haulmark.functions.values import CATEGORIES, RULES
from haulmark.plans.episodes import SESSION_SQL, sessions
from haulmark.plans.register import query
from haulmark.sources import domain as d


@query(
    "fatigue_first_client",
    f""", {SESSION_SQL.strip()} SELECT e.session_id AS taker, min_by(y.session_id, y.start_at) AS given FROM sessions e JOIN sessions y ON y.plate = e.plate AND e.category = 'Ojos cerrados' AND y.category = 'Bostezo'
    AND y.end_at < e.start_at AND floor((epoch_us(e.start_at) - epoch_us(y.end_at)) / 60000000) <= 60 GROUP BY e.session_id""",
)
def fatigue_first_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's form of fatigue merging: the first yawn session that fits, in whole minutes, without consumption."""
    s = sessions(spark, sf_dir)
    width = 60 * (RULES["fatigue_merge_minutes"] + 1)
    bucket = lambda c: F.floor(F.unix_timestamp(c) / width)
    eyes = s.filter("category = 'Ojos cerrados'").select("plate", F.col("session_id").alias("taker"), F.col("start_at").alias("eyes_at"), F.explode(F.array(bucket("start_at"), bucket("start_at") - 1)).alias("b"))
    yawns = s.filter("category = 'Bostezo'").select("plate", "session_id", "start_at", "end_at", bucket("end_at").alias("b"))
    minutes = F.floor((F.unix_micros("eyes_at") - F.unix_micros("end_at")) / 60_000_000)
    return eyes.join(yawns, ["plate", "b"]).filter((F.col("end_at") < F.col("eyes_at")) & (minutes <= RULES["fatigue_merge_minutes"])).groupBy("taker").agg(F.min_by("session_id", "start_at").alias("given"))


@query("replay_latest", "SELECT event_id, occurred_at, CAST(row_number() OVER (ORDER BY occurred_at, event_id) AS BIGINT) AS place FROM (SELECT * FROM alarms WHERE occurred_at > received_at + INTERVAL 5 MINUTE ORDER BY occurred_at DESC, event_id DESC LIMIT 2000)")
def replay_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 2000 quarantined rows, oldest first: what a replay works off."""
    late = d.alarms(spark, sf_dir).filter(F.col("occurred_at") > F.col("received_at") + F.expr("INTERVAL 5 MINUTES"))
    rows = late.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(2000)
    return rows.select("event_id", "occurred_at", F.row_number().over(Window.orderBy("occurred_at", "event_id")).cast("long").alias("place"))  # 2000 rows


@query("device_slice", "SELECT device_id FROM (SELECT device_id, row_number() OVER (ORDER BY device_id) AS n FROM (SELECT DISTINCT device_id FROM alarms)) WHERE n BETWEEN 11 AND 30")
def device_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices eleven to thirty by name."""
    return d.alarms(spark, sf_dir).select("device_id").distinct().orderBy("device_id").offset(10).limit(20)


@query("tenant_recover", "SELECT company_slug, array_to_string(list(device_id ORDER BY device_id), ',') AS devices FROM (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY t DESC, device_id) AS n FROM (SELECT company_slug, device_id, max(occurred_at) AS t FROM alarms GROUP BY ALL)) WHERE n <= 25 GROUP BY company_slug")
def tenant_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's device list out of its rows: the 25 devices seen last."""
    seen = d.alarms(spark, sf_dir).groupBy("company_slug", "device_id").agg(F.max("occurred_at").alias("t"))
    w = Window.partitionBy("company_slug").orderBy(F.desc("t"), "device_id")
    return seen.withColumn("n", F.row_number().over(w)).filter("n <= 25").groupBy("company_slug").agg(F.array_join(F.array_sort(F.collect_list("device_id")), ",").alias("devices"))


def in_order(rows: DataFrame) -> DataFrame:
    canonical = F.array(*[F.lit(c) for c, _, _ in CATEGORIES])
    own = rows.groupBy("company_slug").agg(F.collect_set("category").alias("own"))  # eight at most
    return own.select("company_slug", F.array_join(F.array_intersect(canonical, F.col("own")), ",").alias("shown"))


@query("category_order", "SELECT company_slug, array_to_string(list(category ORDER BY position), ',') AS shown FROM (SELECT DISTINCT company_slug, category FROM month) JOIN categories USING (category) GROUP BY company_slug")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that a company has in the month, in canonical order."""
    return in_order(d.month(spark, sf_dir))


@query("category_order_all", "SELECT company_slug, array_to_string(list(category ORDER BY position), ',') AS shown FROM (SELECT DISTINCT company_slug, category FROM month) JOIN categories USING (category) GROUP BY company_slug")
def category_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as category_order, which once took one hour; tests hold it against a plain loop."""
    return in_order(d.month(spark, sf_dir))


MARKERS = """SELECT label, mark_at FROM (SELECT 'start' AS label, CAST(day AS TIMESTAMP) + INTERVAL 22 HOUR AS mark_at FROM days UNION ALL SELECT 'end', CAST(day AS TIMESTAMP) + INTERVAL 29 HOUR FROM days), (SELECT min(local_at) AS lo, max(local_at) AS hi FROM kept WHERE day > DATE '2024-01-23') r WHERE mark_at > lo AND mark_at < hi"""


@query("night_markers", MARKERS)
def night_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where nights begin and end among the week's alarms, in local time."""
    bounds = d.in_days(d.kept(spark, sf_dir), d.SEVEN).agg(F.min("local_at").alias("lo"), F.max("local_at").alias("hi"))  # one row
    day = F.col("day").cast("timestamp")
    marks = d.days(spark).select(F.explode(F.array(F.struct(F.lit("start").alias("label"), (day + F.expr("INTERVAL 22 HOURS")).alias("mark_at")), F.struct(F.lit("end").alias("label"), (day + F.expr("INTERVAL 29 HOURS")).alias("mark_at")))).alias("m")).select("m.*")
    return marks.join(F.broadcast(bounds), (F.col("mark_at") > F.col("lo")) & (F.col("mark_at") < F.col("hi"))).select("label", "mark_at")


@query("json_object_only", """SELECT event_id, CASE WHEN json_valid(doc) AND json_type(doc) = 'OBJECT' THEN json_extract_string(doc, '$.k') ELSE NULL END AS k FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[1]' WHEN 2 THEN '{broken' END AS doc, FROM events)""")
def json_object_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text columns: anything but an object counts as empty."""
    from haulmark.sources.messages import decoded

    k = F.col("event_id") % 4
    rows = d.events(spark, sf_dir).select("event_id", F.when(k == 0, F.col("props")).when(k == 1, "[1]").when(k == 2, "{broken").alias("doc"))
    return decoded(rows, "doc").select("event_id", F.get_json_object("body", "$.k").alias("k"))


@query(
    "snapshot_full",
    """, cells AS (SELECT company_slug, plate, day, hour, category, count(*) AS n FROM month GROUP BY ALL), t AS (SELECT company_slug, CAST(sum(n) AS BIGINT) AS alarms, count(DISTINCT plate) AS vehicles, CAST(sum(CASE WHEN hour >= 22 OR hour < 5 THEN n ELSE 0 END) AS BIGINT) AS night FROM cells GROUP BY 1),
    sr AS (SELECT company_slug, list(struct_pack(category := category, day := day, n := n) ORDER BY category, day) AS series FROM (SELECT company_slug, category, day, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL) GROUP BY 1), hr AS (SELECT company_slug, list(struct_pack(hour := hour, n := n) ORDER BY hour) AS hours FROM (SELECT company_slug, hour, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL) GROUP BY 1),
    tp AS (SELECT company_slug, list(struct_pack(place := place, plate := plate, n := n) ORDER BY place) AS top FROM (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY n DESC, plate) AS place FROM (SELECT company_slug, plate, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL)) WHERE place <= 8 GROUP BY 1)
    SELECT company_slug, CAST(to_json(struct_pack(alarms := alarms, vehicles := vehicles, night := night, series := series, hours := hours, top := top)) AS VARCHAR) AS snapshot_json FROM t JOIN sr USING (company_slug) JOIN hr USING (company_slug) JOIN tp USING (company_slug)""",
)
def snapshot_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's month as one JSON text: totals, a series for each category, hours, severities and the most alarmed vehicles.

    One aggregate over (company, vehicle, day, hour, category) feeds all of it; the nested parts have a bounded number of entries.
    """
    m = d.month(spark, sf_dir)
    cells = m.groupBy("company_slug", "plate", "day", "hour", "category").agg(F.count("*").alias("n"))
    by = lambda *keys: cells.groupBy("company_slug", *keys).agg(F.sum("n").alias("n"))
    entries = lambda df, name, *keys: df.groupBy("company_slug").agg(F.array_sort(F.collect_list(F.struct(*keys, "n"))).alias(name))
    totals = cells.groupBy("company_slug").agg(F.sum("n").alias("alarms"), F.count_distinct("plate").alias("vehicles"), F.sum(F.when(is_night(F.col("hour")), F.col("n")).otherwise(0)).alias("night"))
    w = Window.partitionBy("company_slug").orderBy(F.desc("n"), "plate")
    top = by("plate").withColumn("place", F.row_number().over(w)).filter("place <= 8")
    out = totals
    for part in (entries(by("category", "day"), "series", "category", "day"), entries(by("hour"), "hours", "hour"), entries(top, "top", "place", "plate")):
        out = out.join(part, "company_slug", "left")
    return out.select("company_slug", F.to_json(F.struct(*[c for c in out.columns if c != "company_slug"])).alias("snapshot_json"))
