"""Counts by day, hour, category and vehicle: a month at a glance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.functions.expressions import is_night
from haulmark.plans.register import query
from haulmark.sources import domain as d


def dense(counts: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Counts on a full grid, zero where there is none. The grid is bounded (days, hours, categories), so it is the small side."""
    return grid.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


@query("serie_cat", "SELECT d.day, c.category, count(m.guid) AS n FROM days d CROSS JOIN categories c LEFT JOIN month m ON m.day = d.day AND m.category = c.category GROUP BY ALL")
def serie_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = d.month(spark, sf_dir).groupBy("day", "category").agg(F.count("*").alias("n"))
    return dense(counts, d.days(spark).join(d.categories(spark).select("category")), ["day", "category"])


@query("heat_hour", "SELECT c.category, h.hour, count(m.guid) AS n FROM categories c CROSS JOIN (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour) h LEFT JOIN month m ON m.hour = h.hour AND m.category = c.category GROUP BY ALL")
def heat_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = d.month(spark, sf_dir).groupBy("category", "hour").agg(F.count("*").alias("n"))
    return dense(counts, d.categories(spark).select("category").join(spark.range(24).select(F.col("id").cast("int").alias("hour"))), ["category", "hour"])


@query("dist_tipo_topk", "SELECT coalesce(nullif(tp, ''), category) AS subtype, category, count(*) AS n FROM month GROUP BY ALL ORDER BY n DESC, min(occurred_at), subtype LIMIT 20")
def dist_tipo_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    subtype = F.coalesce(F.nullif(F.col("tp"), F.lit("")), F.col("category")).alias("subtype")
    return d.month(spark, sf_dir).groupBy(subtype, "category").agg(F.count("*").alias("n"), F.min("occurred_at").alias("t")).orderBy(F.desc("n"), "t", "subtype").limit(20).drop("t")


@query("today_by_category", "SELECT c.category, count(m.guid) AS n FROM categories c LEFT JOIN month m ON m.category = c.category AND m.day = DATE '2024-01-30' GROUP BY ALL")
def today_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = d.in_days(d.kept(spark, sf_dir), 1).groupBy("category").agg(F.count("*").alias("n"))
    return dense(counts, d.categories(spark).select("category"), ["category"])


@query("today_top_vehicles", "SELECT plate, count(*) AS n FROM month WHERE day = DATE '2024-01-30' GROUP BY plate ORDER BY n DESC, min(occurred_at), plate LIMIT 8")
def today_top_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.in_days(d.kept(spark, sf_dir), 1).groupBy("plate").agg(F.count("*").alias("n"), F.min("occurred_at").alias("t")).orderBy(F.desc("n"), "t", "plate").limit(8).drop("t")


NIGHT_SQL = "(hour >= 22 OR hour < 5)"


@query(
    "vehicle_table",
    f"""SELECT m.plate, CAST(count(*) FILTER (m.category = 'Uso de celular') AS BIGINT) AS phone, CAST(count(*) FILTER (m.category = 'Ojos cerrados') AS BIGINT) AS eyes_closed,
    CAST(count(*) FILTER (m.category = 'Riesgo de colision') AS BIGINT) AS collision, CAST(count(*) FILTER (m.category = 'Bostezo') AS BIGINT) AS yawn, CAST(count(*) FILTER (m.category = 'Distraccion') AS BIGINT) AS distraction,
    count(*) AS total, CAST(count(*) FILTER ({NIGHT_SQL}) AS BIGINT) AS night, CAST(sum(coalesce(c.weight, 0)) AS BIGINT) AS risk
    FROM month m LEFT JOIN categories c USING (category) GROUP BY m.plate""",
)
def vehicle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = d.month(spark, sf_dir).join(F.broadcast(d.categories(spark)), "category", "left")
    n = lambda category: F.count_if(F.col("category") == category)
    return m.groupBy("plate").agg(
        n("Uso de celular").alias("phone"), n("Ojos cerrados").alias("eyes_closed"), n("Riesgo de colision").alias("collision"), n("Bostezo").alias("yawn"), n("Distraccion").alias("distraction"),
        F.count("*").alias("total"), F.count_if(is_night(F.col("hour"))).alias("night"), F.sum(F.coalesce("weight", F.lit(0))).alias("risk"),
    )


@query(
    "vehicle_rate",
    """SELECT plate, n, km, covered_days, CASE WHEN covered_days = 30 AND km > 0 THEN round(CAST(n AS DOUBLE) / CAST(km AS DOUBLE) * 100, 1) END AS per_100_km FROM
    (SELECT plate, count(*) AS n FROM month GROUP BY plate) JOIN (SELECT plate, sum(value) AS km, count(DISTINCT day) AS covered_days FROM alarms WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY plate) USING (plate)""",
)
def vehicle_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms per 100 km, only where every day of the window has distance."""
    a = d.in_days(d.alarms(spark, sf_dir), d.THIRTY)
    out = a.groupBy("plate").agg(F.count_if(F.coalesce(F.col("review") != "discarded", F.lit(True))).alias("n"), F.sum("value").alias("km"), F.count_distinct("day").alias("covered_days")).filter("n > 0")
    return out.withColumn("per_100_km", F.when((F.col("covered_days") == 30) & (F.col("km") > 0), F.round(F.col("n").cast("double") / F.col("km").cast("double") * 100, 1)))


WEEK_SQL = "(SELECT * FROM days WHERE day > DATE '2024-01-23')"


@query("week_matrix", f"SELECT p.plate, w.day, count(m.guid) AS n FROM (SELECT DISTINCT plate FROM month WHERE day > DATE '2024-01-23') p CROSS JOIN {WEEK_SQL} w LEFT JOIN month m ON m.plate = p.plate AND m.day = w.day GROUP BY ALL")
def week_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = d.in_days(d.kept(spark, sf_dir), d.SEVEN).groupBy("plate", "day").agg(F.count("*").alias("n"))
    counts = week.groupBy("plate").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("m"))  # seven entries at most
    full = counts.select("plate", F.explode(F.sequence(F.expr(f"date_sub({d.LAST_DAY}, 6)"), F.expr(d.LAST_DAY))).alias("day"), "m")
    return full.select("plate", "day", F.coalesce(F.element_at("m", F.col("day")), F.lit(0)).cast("long").alias("n"))


@query("week_category_vehicle", "SELECT category, plate, count(*) AS n FROM month WHERE day > DATE '2024-01-23' GROUP BY ALL")
def week_category_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.in_days(d.kept(spark, sf_dir), d.SEVEN).groupBy("category", "plate").agg(F.count("*").alias("n"))


@query("severity_totals", "SELECT coalesce(c.severity, 'medio') AS severity, count(*) AS n FROM month LEFT JOIN categories c USING (category) GROUP BY 1")
def severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.month(spark, sf_dir).join(F.broadcast(d.categories(spark)), "category", "left").groupBy(F.coalesce("severity", F.lit("medio")).alias("severity")).agg(F.count("*").alias("n"))


@query("night_share", f"SELECT count(*) AS total, CAST(count(*) FILTER ({NIGHT_SQL}) AS BIGINT) AS night, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0::DOUBLE * count(*) FILTER ({NIGHT_SQL}) / count(*), 1) END AS night_pct FROM month")
def night_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d.month(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(is_night(F.col("hour"))).alias("night"))
    return out.withColumn("night_pct", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.lit(100.0) * F.col("night") / F.col("total"), 1)))


@query(
    "kpis",
    f"""SELECT count(DISTINCT plate) AS vehicles, count(*) AS alarms_30d, CAST(count(*) FILTER (day > DATE '2024-01-23') AS BIGINT) AS alarms_7d, CAST(count(*) FILTER (day = DATE '2024-01-30') AS BIGINT) AS alarms_today,
    CAST(count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-30 00:00:00') AS BIGINT) AS alarms_24h, CAST(count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-30 00:00:00' AND {NIGHT_SQL}) AS BIGINT) AS night_24h,
    count(DISTINCT plate) FILTER (occurred_at >= TIMESTAMP '2024-01-30 00:00:00') AS vehicles_24h FROM month""",
)
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = F.col("occurred_at") >= F.expr("TIMESTAMP '2024-01-30 00:00:00'")
    return d.month(spark, sf_dir).agg(
        F.count_distinct("plate").alias("vehicles"), F.count("*").alias("alarms_30d"), F.count_if(F.col("day") > F.expr("DATE '2024-01-23'")).alias("alarms_7d"), F.count_if(F.col("day") == F.expr(d.LAST_DAY)).alias("alarms_today"),
        F.count_if(recent).alias("alarms_24h"), F.count_if(recent & is_night(F.col("hour"))).alias("night_24h"), F.count_distinct(F.when(recent, F.col("plate"))).alias("vehicles_24h"),
    )


@query(
    "vehicle_ranking",
    """SELECT plate, risk, CAST(row_number() OVER (ORDER BY risk IS NULL, risk DESC, plate) AS BIGINT) AS place FROM (SELECT m.plate, CAST(sum(coalesce(c.weight, 0)) AS BIGINT) AS risk FROM month m LEFT JOIN categories c USING (category) GROUP BY m.plate) ORDER BY place LIMIT 50""",
)
def vehicle_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vehicle_table(spark, sf_dir).select("plate", "risk").orderBy(F.col("risk").isNull(), F.desc("risk"), "plate").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("risk").isNull(), F.desc("risk"), "plate")).cast("long"))  # 50 rows


@query(
    "dominant_window",
    """SELECT start_hour, n FROM (SELECT h.hour AS start_hour, (SELECT count(*) FROM month m JOIN categories c USING (category) WHERE c.severity = 'critico' AND m.hour BETWEEN h.hour AND h.hour + 5) AS n FROM (SELECT CAST(unnest(range(19)) AS INTEGER) AS hour) h) ORDER BY n DESC, start_hour LIMIT 1""",
)
def dominant_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hours with most critical alarms; windows don't wrap past midnight."""
    m = d.month(spark, sf_dir).join(F.broadcast(d.categories(spark).filter("severity = 'critico'")), "category")
    counts = m.groupBy("hour").agg(F.count("*").alias("n"))
    full = dense(counts, spark.range(24).select(F.col("id").cast("int").alias("hour")), ["hour"])
    rolled = full.withColumn("n", F.sum("n").over(Window.orderBy("hour").rowsBetween(0, 5)))  # 24 rows
    return rolled.filter("hour <= 18").orderBy(F.desc("n"), "hour").limit(1).select(F.col("hour").alias("start_hour"), "n")


@query(
    "profiles_topk",
    """SELECT plate, fatigue, total, round(CAST(fatigue AS DOUBLE) / total, 4) AS share FROM (SELECT plate, CAST(count(*) FILTER (category IN ('Ojos cerrados', 'Bostezo', 'Fatiga en progresion')) AS BIGINT) AS fatigue, count(*) AS total FROM month GROUP BY plate) WHERE total >= 10 ORDER BY share DESC, fatigue DESC, plate LIMIT 5""",
)
def profiles_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles whose alarms are mostly of fatigue."""
    fatigue = F.col("category").isin("Ojos cerrados", "Bostezo", "Fatiga en progresion")
    out = d.month(spark, sf_dir).groupBy("plate").agg(F.count_if(fatigue).alias("fatigue"), F.count("*").alias("total")).filter("total >= 10")
    return out.withColumn("share", F.round(F.col("fatigue").cast("double") / F.col("total"), 4)).orderBy(F.desc("share"), F.desc("fatigue"), "plate").limit(5)


@query("rollup_companies", "SELECT coalesce(company_slug, 'all') AS company, coalesce(category, 'all') AS category, count(*) AS n, max(occurred_at) AS last_at FROM month GROUP BY ROLLUP (company_slug, category)")
def rollup_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d.month(spark, sf_dir).rollup("company_slug", "category").agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_at"))
    return out.select(F.coalesce("company_slug", F.lit("all")).alias("company"), F.coalesce("category", F.lit("all")).alias("category"), "n", "last_at")


@query("recurrence_days", "SELECT plate, count(DISTINCT day) AS active_days, count(DISTINCT day) >= 2 AS recurrent FROM month WHERE category = 'Distraccion' AND day > DATE '2024-01-23' GROUP BY plate")
def recurrence_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d.in_days(d.kept(spark, sf_dir), d.SEVEN).filter("category = 'Distraccion'").groupBy("plate").agg(F.count_distinct("day").alias("active_days"))
    return out.withColumn("recurrent", F.col("active_days") >= 2)


@query(
    "event_feed",
    "SELECT guid, device_id, plate, company_slug, category, tp, strftime(local_at, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS local_iso FROM month WHERE day = DATE '2024-01-30' AND category IN ('Ojos cerrados', 'Bostezo')",
)
def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = d.in_days(d.kept(spark, sf_dir), 1).filter(F.col("category").isin("Ojos cerrados", "Bostezo"))
    return recent.select("guid", "device_id", "plate", "company_slug", "category", "tp", F.concat(F.date_format("local_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")).alias("local_iso"))


@query("snapshot_json", "SELECT company_slug, count(*) AS alarms, count(DISTINCT plate) AS vehicles, '{\"alarms\":' || count(*) || ',\"vehicles\":' || count(DISTINCT plate) || '}' AS snapshot FROM month GROUP BY company_slug")
def snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materialised snapshot of each company."""
    out = d.month(spark, sf_dir).groupBy("company_slug").agg(F.count("*").alias("alarms"), F.count_distinct("plate").alias("vehicles"))
    return out.withColumn("snapshot", F.to_json(F.struct("alarms", "vehicles")))
