"""Alarm sessions, episodes and the timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.functions.expressions import is_night
from haulmark.functions.values import RULES
from haulmark.operators.asof import latest_unconsumed
from haulmark.operators.batches import kept_rows
from haulmark.operators.sessions import sessionize
from haulmark.plans.mileage import BASE_SQL, vehicle_baseline
from haulmark.plans.register import query
from haulmark.sources import domain as d


def gap_minutes() -> Column:
    return F.when(F.col("category") == "Riesgo de colision", RULES["collision_minutes"]).when(F.col("category") == "Bostezo", RULES["yawn_minutes"]).otherwise(RULES["streak_minutes"])


SESSION_SQL = """
g AS (SELECT *, CASE WHEN occurred_at - lag(occurred_at) OVER w <= to_minutes(CASE category WHEN 'Riesgo de colision' THEN 30 WHEN 'Bostezo' THEN 60 ELSE 15 END) THEN 0 ELSE 1 END AS new FROM kept WINDOW w AS (PARTITION BY plate, category ORDER BY occurred_at, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY plate, category ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING) AS session_no, count(*) OVER (PARTITION BY plate, category, day) AS same_day FROM g),
sessions AS (SELECT plate, category, CAST(session_no AS BIGINT) AS session_no, arg_min(guid, (occurred_at, event_id)) AS session_id, min(occurred_at) AS start_at, max(occurred_at) AS end_at, count(*) AS n, arg_max(same_day, (occurred_at, event_id)) AS same_day, bool_or(coalesce(review = 'approved', false)) AS approved FROM s GROUP BY ALL)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each session of a vehicle and category; same_day: the category's alarms of the vehicle on the last alarm's local day."""
    rows = sessionize(d.kept(spark, sf_dir), ["plate", "category"], "occurred_at", gap_minutes(), "event_id")
    rows = rows.withColumn("same_day", F.count("*").over(Window.partitionBy("plate", "category", "day")))
    order = F.struct("occurred_at", "event_id")
    return rows.groupBy("plate", "category", "session_no").agg(
        F.min_by("guid", order).alias("session_id"), F.min("occurred_at").alias("start_at"), F.max("occurred_at").alias("end_at"), F.count("*").alias("n"),
        F.max_by("same_day", order).alias("same_day"), F.max(F.coalesce(F.col("review") == "approved", F.lit(False))).alias("approved"),
    )


@query("episode_sessions", f", {SESSION_SQL.strip()} SELECT * FROM sessions")
def episode_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir)


def fatigue_pairs(found: DataFrame) -> DataFrame:
    """plate, taker (an eyes-closed session) and given (the yawn session merged into it)."""
    kind = F.when(F.col("category") == "Bostezo", "give").otherwise("take").alias("kind")
    return latest_unconsumed(found.filter(F.col("category").isin("Bostezo", "Ojos cerrados")).select("plate", "session_id", kind, "start_at", "end_at"), ["plate"], RULES["fatigue_merge_minutes"])


#: Yawn sessions of a vehicle lie more than an hour apart, so an eyes-closed one has one candidate at most, and the first taker gets it.
PAIRS_SQL = """
pairs AS (SELECT plate, taker, given FROM (SELECT e.plate, e.session_id AS taker, y.session_id AS given, row_number() OVER (PARTITION BY y.session_id ORDER BY e.start_at, e.session_id) AS k FROM sessions e JOIN sessions y ON y.plate = e.plate AND e.category = 'Ojos cerrados' AND y.category = 'Bostezo'
  AND y.end_at < e.start_at AND e.start_at - y.end_at <= INTERVAL 60 MINUTE) WHERE k = 1)"""


@query("fatigue_merge", f", {SESSION_SQL.strip()}, {PAIRS_SQL.strip()} SELECT plate, taker, given FROM pairs")
def fatigue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With consumption: a fold in general; tests hold it against a plain loop too, with sessions that compete."""
    return fatigue_pairs(sessions(spark, sf_dir))


@query(
    "fatigue_merge_asof",
    f""", {SESSION_SQL.strip()} SELECT e.session_id AS taker, max_by(y.session_id, y.start_at) AS given, max(y.end_at) AS yawn_end FROM sessions e JOIN sessions y ON y.plate = e.plate AND e.category = 'Ojos cerrados' AND y.category = 'Bostezo'
    AND y.end_at < e.start_at AND e.start_at - y.end_at <= INTERVAL 60 MINUTE GROUP BY e.session_id""",
)
def fatigue_merge_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without consumption: the latest yawn session that ended within the hour before. The equi-key is a vehicle and an hour, so no group grows large."""
    s = sessions(spark, sf_dir)
    hour = lambda c: F.floor(F.unix_timestamp(c) / (60 * RULES["fatigue_merge_minutes"]))
    eyes = s.filter("category = 'Ojos cerrados'").select("plate", F.col("session_id").alias("taker"), F.col("start_at").alias("eyes_at"), F.explode(F.array(hour("start_at"), hour("start_at") - 1)).alias("h"))
    yawns = s.filter("category = 'Bostezo'").select("plate", "session_id", "start_at", "end_at", hour("end_at").alias("h"))
    near = eyes.join(yawns, ["plate", "h"]).filter((F.col("end_at") < F.col("eyes_at")) & (F.col("eyes_at") - F.col("end_at") <= F.expr("INTERVAL 60 MINUTES")))
    return near.groupBy("taker").agg(F.max_by("session_id", "start_at").alias("given"), F.max("end_at").alias("yawn_end"))


STATUS_SQL = """CASE WHEN category = 'Ojos cerrados' AND n = 1 AND NOT approved THEN 'suppressed_by_rule' WHEN category = 'Distraccion' AND NOT approved AND deviation < 3 THEN 'suppressed_by_rule' ELSE 'visible_episode' END AS status,
  CASE WHEN category = 'Ojos cerrados' AND n = 1 AND NOT approved THEN 'single_eye_closed' WHEN category = 'Distraccion' AND NOT approved AND deviation < 3 THEN 'distraction_below_3x' WHEN same_day > 20 THEN 'anti_noise_daily_cap'
       WHEN (category = 'Ojos cerrados' AND n = 1 OR category = 'Distraccion') AND approved THEN 'manual_approved' ELSE 'visible' END AS reason"""


def with_deviation(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Today's count over the baseline as episodes use it: no baseline gives the count, or 1; nothing today gives 0."""
    today = d.in_days(d.kept(spark, sf_dir), 1).groupBy("plate").agg(F.count("*").alias("today"))
    both = vehicle_baseline(spark, sf_dir).join(today, "plate", "full")
    n, base = F.coalesce("today", F.lit(0)), F.coalesce("baseline", F.lit(0.0))
    both = both.select("plate", F.when(base > 0, F.round(n / base, 2)).otherwise(F.when(n > 0, n.cast("double")).otherwise(1.0)).alias("deviation"))
    return found.join(both, "plate", "left").withColumn("deviation", F.coalesce("deviation", F.lit(1.0)))


def verdict(merged: Column) -> tuple[Column, Column]:
    """Status and reason of a session."""
    eyes, distraction, approved = F.col("category") == "Ojos cerrados", F.col("category") == "Distraccion", F.col("approved")
    single = eyes & (F.col("n") == 1) & ~merged
    weak = distraction & (F.col("deviation") < RULES["distraction_deviation"])
    status = F.when((single | weak) & ~approved, "suppressed_by_rule").otherwise("visible_episode")
    reason = F.when(single & ~approved, "single_eye_closed").when(weak & ~approved, "distraction_below_3x").when(F.col("same_day") > RULES["daily_cap"], "anti_noise_daily_cap").when(merged, "merged_yawn_into_fatigue").when((single | distraction) & approved, "manual_approved").otherwise("visible")
    return status, reason


DEVIATION_SQL = """
dev AS (SELECT plate, CASE WHEN coalesce(baseline, 0) > 0 THEN round(coalesce(today, 0) / baseline, 2) ELSE CASE WHEN coalesce(today, 0) > 0 THEN CAST(today AS DOUBLE) ELSE 1.0 END END AS deviation FROM base FULL JOIN (SELECT plate, count(*) AS today FROM kept WHERE day = DATE '2024-01-30' GROUP BY plate) USING (plate)),
judged AS (SELECT s.*, coalesce(dev.deviation, 1.0) AS deviation FROM sessions s LEFT JOIN dev USING (plate))"""


@query("episode_status", f"{BASE_SQL}, {SESSION_SQL.strip()}, {DEVIATION_SQL.strip()} SELECT session_id, category, n, {STATUS_SQL} FROM judged")
def episode_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of single sessions, before yawns are merged into eyes-closed ones."""
    status, reason = verdict(F.lit(False))
    return with_deviation(spark, sf_dir, sessions(spark, sf_dir)).select("session_id", "category", "n", status.alias("status"), reason.alias("reason"))


@query(
    "episodes",
    f"""{BASE_SQL}, {SESSION_SQL.strip()}, {DEVIATION_SQL.strip()}, {PAIRS_SQL.strip()}, e AS (SELECT j.*, p.given, y.n AS yawns, p.given IS NOT NULL AS merged, j.category = 'Ojos cerrados' AND j.n = 1 AND p.given IS NULL AS single, j.category = 'Distraccion' AND j.deviation < 3 AS weak FROM judged j LEFT JOIN pairs p ON p.taker = j.session_id LEFT JOIN sessions y ON y.session_id = p.given)
    SELECT coalesce(given, session_id) AS episode_id, session_id, plate, CASE WHEN merged THEN 'Fatiga en progresion' ELSE category END AS category, CASE WHEN same_day > 20 THEN category || ' fuera de patron' WHEN merged THEN 'Fatiga en progresion' ELSE category END AS title, n + coalesce(yawns, 0) AS events,
    CASE WHEN (single OR weak) AND NOT approved THEN 'suppressed_by_rule' ELSE 'visible_episode' END AS status, CASE WHEN single AND NOT approved THEN 'single_eye_closed' WHEN weak AND NOT approved THEN 'distraction_below_3x' WHEN same_day > 20 THEN 'anti_noise_daily_cap' WHEN merged THEN 'merged_yawn_into_fatigue' WHEN (single OR category = 'Distraccion') AND approved THEN 'manual_approved' ELSE 'visible' END AS reason, start_at, end_at FROM e""",
)
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with fatigue merging: an eyes-closed session and the yawn session that it takes are one; yawn sessions stay visible themselves."""
    s = kept_rows(with_deviation(spark, sf_dir, sessions(spark, sf_dir)), "episodes")  # read four times below
    pairs = fatigue_pairs(s).drop("plate")
    yawns = s.select(F.col("session_id").alias("given"), F.col("n").alias("yawns"))
    both = s.join(pairs.join(yawns, "given"), F.col("session_id") == F.col("taker"), "left")
    status, reason = verdict(F.col("taker").isNotNull())
    category = F.when(F.col("taker").isNotNull(), "Fatiga en progresion").otherwise(F.col("category"))
    title = F.when(F.col("same_day") > RULES["daily_cap"], F.concat(F.col("category"), F.lit(" fuera de patron"))).otherwise(category)
    return both.select(F.coalesce("given", "session_id").alias("episode_id"), "session_id", "plate", category.alias("category"), title.alias("title"), (F.col("n") + F.coalesce("yawns", F.lit(0))).alias("events"), status.alias("status"), reason.alias("reason"), "start_at", "end_at")


@query("episode_metrics", f"{BASE_SQL}, {SESSION_SQL.strip()}, {DEVIATION_SQL.strip()}, v AS (SELECT *, {STATUS_SQL} FROM judged) SELECT CAST(sum(n) AS BIGINT) AS raw_events, count(*) AS grouped_episodes, CAST(count(*) FILTER (status = 'visible_episode') AS BIGINT) AS visible_alerts, CAST(sum(n) FILTER (status <> 'visible_episode') AS BIGINT) AS suppressed_by_rule FROM v")
def episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episode_status(spark, sf_dir)
    return e.agg(F.sum("n").alias("raw_events"), F.count("*").alias("grouped_episodes"), F.count_if(F.col("status") == "visible_episode").alias("visible_alerts"), F.sum(F.when(F.col("status") != "visible_episode", F.col("n"))).alias("suppressed_by_rule"))


@query(
    "event_first_in_session",
    f", {SESSION_SQL.strip()} SELECT guid, CASE WHEN row_number() OVER (PARTITION BY plate, category, session_no ORDER BY occurred_at, event_id) = 1 THEN 'visible_episode' ELSE 'fused_in_episode' END AS visibility FROM s",
)
def event_first_in_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessionize(d.kept(spark, sf_dir), ["plate", "category"], "occurred_at", gap_minutes(), "event_id")
    n = F.row_number().over(Window.partitionBy("plate", "category", "session_no").orderBy("occurred_at", "event_id"))
    return rows.select("guid", F.when(n == 1, "visible_episode").otherwise("fused_in_episode").alias("visibility"))


@query(
    "priority_score",
    f"""{BASE_SQL}, {SESSION_SQL.strip()}, {DEVIATION_SQL.strip()} SELECT j.session_id, round(coalesce(c.weight, 0) * CASE WHEN j.n >= 5 THEN 1.8 WHEN j.n >= 3 THEN 1.4 ELSE 1.0 END
    * CASE WHEN hour(j.end_at - INTERVAL 5 HOUR) >= 22 OR hour(j.end_at - INTERVAL 5 HOUR) < 5 THEN 1.3 ELSE 1.0 END * CASE WHEN j.deviation >= 3 THEN 1.25 ELSE 1.0 END, 1) AS score FROM judged j LEFT JOIN categories c USING (category)""",
)
def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, times factors for long sessions, night and unusual vehicles."""
    s = with_deviation(spark, sf_dir, sessions(spark, sf_dir)).join(F.broadcast(d.categories(spark)), "category", "left")
    streak = F.when(F.col("n") >= 5, F.expr("1.8BD")).when(F.col("n") >= 3, F.expr("1.4BD")).otherwise(F.expr("1.0BD"))
    night = F.when(is_night(F.hour(F.from_utc_timestamp("end_at", d.ZONE))), F.expr("1.3BD")).otherwise(F.expr("1.0BD"))
    unusual = F.when(F.col("deviation") >= 3, F.expr("1.25BD")).otherwise(F.expr("1.00BD"))
    return s.select("session_id", F.round(F.coalesce("weight", F.lit(0)) * streak * night * unusual, 1).cast("double").alias("score"))


@query(
    "timeline_alerts",
    f", {SESSION_SQL.strip()} SELECT session_id, plate, category, n, end_at, (hour(end_at - INTERVAL 5 HOUR) >= 22 OR hour(end_at - INTERVAL 5 HOUR) < 5) AS at_night, end_at > TIMESTAMP '2024-01-30 23:45:00' AS new_in_cycle FROM sessions WHERE end_at >= TIMESTAMP '2024-01-30 00:00:00' AND NOT (category = 'Ojos cerrados' AND n = 1) ORDER BY end_at DESC, session_id LIMIT 100",
)
def timeline_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = sessions(spark, sf_dir).filter("end_at >= TIMESTAMP '2024-01-30 00:00:00' and not (category = 'Ojos cerrados' and n = 1)")
    out = recent.select("session_id", "plate", "category", "n", "end_at", is_night(F.hour(F.from_utc_timestamp("end_at", d.ZONE))).alias("at_night"), (F.col("end_at") > F.expr("TIMESTAMP '2024-01-30 23:45:00'")).alias("new_in_cycle"))
    return out.orderBy(F.desc("end_at"), "session_id").limit(100)


@query("timeline_counts", f", {SESSION_SQL.strip()} SELECT count(*) AS n, CAST(count(*) FILTER (c.severity = 'critico') AS BIGINT) AS critical, CAST(count(*) FILTER (c.severity = 'alto') AS BIGINT) AS high, CAST(count(*) FILTER (hour(end_at - INTERVAL 5 HOUR) >= 22 OR hour(end_at - INTERVAL 5 HOUR) < 5) AS BIGINT) AS night, max(end_at) AS latest FROM sessions LEFT JOIN categories c USING (category)")
def timeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).join(F.broadcast(d.categories(spark)), "category", "left")
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critico").alias("critical"), F.count_if(F.col("severity") == "alto").alias("high"), F.count_if(is_night(F.hour(F.from_utc_timestamp("end_at", d.ZONE)))).alias("night"), F.max("end_at").alias("latest"))
