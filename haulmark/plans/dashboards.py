"""The whole dashboard of each company, at once and kept up to date by ten batches of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators.dashboard import apply_changes, cells_of, create_dashboard, dashboard, publish_dashboard, sessions_of
from haulmark.plans.episodes import SESSION_SQL, gap_minutes
from haulmark.plans.mileage import BASE_SQL, daily_distance, day_baselines
from haulmark.plans.register import query
from haulmark.sources import domain as d
from haulmark.sources.shared import shared_dir
from haulmark.sources.versions import TableStore

SNAPSHOT_SQL = f"""{BASE_SQL}, {SESSION_SQL.strip()},
cells AS (SELECT company_slug, plate, day, hour, category, count(*) AS n FROM month GROUP BY ALL), tot AS (SELECT company_slug, CAST(sum(n) AS BIGINT) AS alarms, count(DISTINCT plate) AS vehicles, CAST(sum(CASE WHEN hour >= 22 OR hour < 5 THEN n ELSE 0 END) AS BIGINT) AS night FROM cells GROUP BY 1),
owner AS (SELECT plate, any_value(company_slug) AS company_slug FROM alarms GROUP BY 1),
far AS (SELECT company_slug, CAST(sum(km) AS DOUBLE) AS km FROM km JOIN owner USING (plate) WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1),
spiked AS (SELECT company_slug, CAST(count(*) FILTER (baseline > 0 AND today >= baseline * 1.5) AS BIGINT) AS spikes FROM (SELECT company_slug, plate, count(*) AS today FROM kept WHERE day = DATE '2024-01-30' GROUP BY ALL) JOIN base USING (plate) GROUP BY 1),
ep AS (SELECT company_slug, count(*) AS episodes, max(n) AS longest FROM (SELECT company_slug, plate, category, session_no, count(*) AS n, arg_min(day, (occurred_at, event_id)) AS first_day FROM s GROUP BY ALL) WHERE first_day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1),
sr AS (SELECT company_slug, list(struct_pack(category := category, day := day, n := n) ORDER BY category, day) AS series FROM (SELECT company_slug, category, day, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL) GROUP BY 1), hr AS (SELECT company_slug, list(struct_pack(hour := hour, n := n) ORDER BY hour) AS hours FROM (SELECT company_slug, hour, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL) GROUP BY 1),
tp AS (SELECT company_slug, list(struct_pack(place := place, plate := plate, n := n) ORDER BY place) AS top FROM (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY n DESC, plate) AS place FROM (SELECT company_slug, plate, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL)) WHERE place <= 8 GROUP BY 1)
SELECT company_slug, alarms, vehicles, night, round(km, 1) AS km, CASE WHEN km > 0 THEN round(alarms * 100 / km, 1) END AS rate, coalesce(spikes, 0) AS spikes, episodes, longest, CAST(to_json(struct_pack(series := series, hours := hours, top := top)) AS VARCHAR) AS body
FROM tot LEFT JOIN far USING (company_slug) LEFT JOIN spiked USING (company_slug) LEFT JOIN ep USING (company_slug) JOIN sr USING (company_slug) JOIN hr USING (company_slug) JOIN tp USING (company_slug)"""


def of(cells: DataFrame, sessions: DataFrame, odometer: DataFrame) -> DataFrame:
    owners = odometer.select("device_id", "day", "company_slug")
    km = daily_distance(odometer).join(owners, ["device_id", "day"]).select("company_slug", "plate", "day", "km")
    return dashboard(cells, sessions, km, day_baselines, F.expr(f"date_sub({d.LAST_DAY}, {d.THIRTY - 1})"), F.expr(d.LAST_DAY))


@query("dashboard_whole", SNAPSHOT_SQL)
def dashboard_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a company's page shows, from the tables."""
    alarms = d.kept(spark, sf_dir)
    return of(cells_of(alarms), sessions_of(alarms, gap_minutes()), d.daily(spark, sf_dir))


FEED = {
    "changes": "guid string, event_id long, company_slug string, plate string, occurred_at timestamp, day date, hour int, op string, seq int, category string",
    "readings": "device_id string, plate string, fleet_id string, company_slug string, event_id long, observed_at timestamp, day date, total_km decimal(28,2), day_km decimal(21,2)",
}


def land_feed(spark: SparkSession, sf_dir: str, base: str, parts: int) -> None:
    """Lands the changes by parts, in one pass over the alarms and one over the readings. Alarms come in any order of time, some twice, and reviews take
    discarded ones back some parts later. At first an alarm may be under another category."""
    k = F.col("event_id")
    at, wrong = (k % parts).cast("int"), k % 15 == 0
    change = lambda op, seq, part, category="category": F.struct(F.lit(op).alias("op"), F.lit(seq).alias("seq"), part.cast("int").alias("part"), (F.col(category) if isinstance(category, str) else category).alias("category"))
    each = F.array(
        change("put", 1, at, F.when(wrong, F.lit("Fumando")).otherwise(F.col("category"))),
        F.when(wrong, change("put", 2, F.least(at + 1, F.lit(parts - 1)))),
        F.when((k % 7 == 0) & ~wrong & (at + 2 < parts), change("put", 3, at + 2)),
        F.when(F.col("review") == "discarded", change("drop", 4, F.least(at + 3, F.lit(parts - 1)))),
    )
    rows = d.alarms(spark, sf_dir).select("guid", "event_id", "company_slug", "plate", "occurred_at", "day", "hour", F.inline(F.filter(each, lambda c: c.isNotNull())))
    rows.write.partitionBy("part").parquet(f"{base}/changes")
    d.readings(spark, sf_dir).withColumn("part", at).write.partitionBy("part").parquet(f"{base}/readings")


def kept_up(spark: SparkSession, sf_dir: str, parts: int = 10) -> TableStore:
    base = f"{shared_dir(spark).rstrip('/')}/dashboard-{uuid.uuid4().hex}"
    store = TableStore(spark, base)
    create_dashboard(store)
    land_feed(spark, sf_dir, f"{base}/feed", parts)
    # a part without rows has no folder
    told = lambda name, part: spark.read.schema(f"{FEED[name]}, part int").parquet(f"{base}/feed/{name}").filter(F.col("part") == part).drop("part")
    for part in range(parts):
        apply_changes(store, f"part {part}", told("changes", part), told("readings", part), gap_minutes())
    return store


@query("dashboard_incremental", SNAPSHOT_SQL)
def dashboard_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of state that ten batches of changes have kept up to date, as it was published."""
    store = kept_up(spark, sf_dir)
    made = of(store.read("cells"), store.read("sessions"), store.read("odometer"))
    publish_dashboard(store, made, F.lit(d.AS_OF).cast("timestamp"))
    body = F.from_json("snapshot_json", "alarms long, vehicles long, night long, km double, rate double, spikes long, episodes long, longest long, body string")
    return store.read("published").select("company_slug", body.alias("b")).select("company_slug", "b.*")
