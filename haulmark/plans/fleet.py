"""Fleets, tenants, jobs and publications; odometer repair and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.functions import expressions as x
from haulmark.operators.tenants import members
from haulmark.plans.raw_layer import RAW_SQL, devices
from haulmark.plans.register import query
from haulmark.sources import domain as d

CATALOG_SQL = """
assigned AS (SELECT 'F1' AS fleet_id, 'south' AS slug UNION ALL SELECT 'F3', 'south' UNION ALL SELECT 'F2', 'mixed'),
jobs AS (SELECT company_slug, 'job' || day AS job_id, day, n, CASE n % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'partial' ELSE 'succeeded' END AS status FROM (SELECT company_slug, day, count(*) AS n FROM alarms GROUP BY ALL)),
latest_jobs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY day DESC) AS k FROM jobs) WHERE k = 1)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild job for each company and day, with a status of its own."""
    n = d.alarms(spark, sf_dir).groupBy("company_slug", "day").agg(F.count("*").alias("n"))
    k = F.col("n") % 5
    status = F.when(k == 0, "queued").when(k == 1, "running").when(k == 2, "failed").when(k == 3, "partial").otherwise("succeeded")
    return n.select("company_slug", F.concat(F.lit("job"), "day").alias("job_id"), "day", "n", status.alias("status"))


def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("company_slug").agg(F.max_by(F.struct("job_id", "day", "n", "status"), "day").alias("r")).select("company_slug", "r.*")


def assigned(spark: SparkSession) -> DataFrame:
    """fleet_id and the company that lists it; of several the last one in configured order."""
    return d.companies(spark).select(F.explode("fleet_ids").alias("fleet_id"), "slug", "position").groupBy("fleet_id").agg(F.max_by("slug", "position").alias("assigned"))


@query(
    "fleet_listing",
    f"""{RAW_SQL}, {CATALOG_SQL.strip()}, f AS (SELECT fleet_id, count(*) AS total_devices, count_if(last_seen >= TIMESTAMP '2024-01-30 00:00:00')::BIGINT AS seen_24h, min(plate) AS first_plate FROM devices WHERE fleet_id <> 'F4' GROUP BY 1),
    a AS (SELECT fleet_id, count(*) AS alarms_7d, max(occurred_at) AS last_alarm FROM alarms WHERE fleet_id <> 'F0' AND day > DATE '2024-01-23' GROUP BY 1)
    SELECT fleet_id, 'Flota ' || right(fleet_id, 1) AS fleet_name, g.slug AS assigned, g.slug IS NULL AS unassigned, coalesce(total_devices, 0) AS total_devices, coalesce(seen_24h, 0) AS seen_24h, coalesce(alarms_7d, 0) AS alarms_7d, last_alarm, first_plate,
    CAST(row_number() OVER (ORDER BY g.slug IS NOT NULL, coalesce(alarms_7d, 0) DESC, coalesce(seen_24h, 0) DESC, coalesce(total_devices, 0) DESC, 'Flota ' || right(fleet_id, 1)) AS BIGINT) AS place FROM f FULL JOIN a USING (fleet_id) LEFT JOIN assigned g USING (fleet_id)""",
)
def fleet_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleets of devices and of recent alarms, with the company that each is assigned to: unassigned ones first, then by alarms and devices."""
    f = devices(spark, sf_dir).filter("fleet_id <> 'F4'").groupBy("fleet_id").agg(F.count("*").alias("total_devices"), F.count_if(F.col("last_seen") >= F.expr("TIMESTAMP '2024-01-30 00:00:00'")).alias("seen_24h"), F.min("plate").alias("first_plate"))
    a = d.in_days(d.alarms(spark, sf_dir), d.SEVEN).filter("fleet_id <> 'F0'").groupBy("fleet_id").agg(F.count("*").alias("alarms_7d"), F.max("occurred_at").alias("last_alarm"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = f.join(a, "fleet_id", "full").join(assigned(spark), "fleet_id", "left").select("fleet_id", F.concat(F.lit("Flota "), F.substring("fleet_id", -1, 1)).alias("fleet_name"), "assigned", F.col("assigned").isNull().alias("unassigned"), zero("total_devices"), zero("seen_24h"), zero("alarms_7d"), "last_alarm", "first_plate")
    order = Window.orderBy(~F.col("unassigned"), F.desc("alarms_7d"), F.desc("seen_24h"), F.desc("total_devices"), "fleet_name")  # a row a fleet
    return both.withColumn("place", F.row_number().over(order).cast("long"))


@query(
    "company_list",
    "SELECT slug, name, operational, CAST(row_number() OVER (ORDER BY NOT operational, lower(name), slug) AS BIGINT) AS place FROM (SELECT fleet_id AS slug, CASE WHEN count(DISTINCT device_id) % 2 = 0 THEN 'flota ' ELSE 'Transporte ' END || fleet_id AS name, max(day) >= DATE '2024-01-30' AND count(*) FILTER (day = DATE '2024-01-30') % 3 <> 0 AS operational FROM alarms GROUP BY fleet_id)",
)
def company_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleets as tenants in the selector's order: operational ones first, then by name in any case."""
    last = F.count_if(F.col("day") == F.expr(d.LAST_DAY))
    name = F.concat(F.when(F.count_distinct("device_id") % 2 == 0, "flota ").otherwise("Transporte "), "fleet_id")
    rows = d.alarms(spark, sf_dir).groupBy("fleet_id").agg(name.alias("name"), ((F.max("day") >= F.expr(d.LAST_DAY)) & (last % 3 != 0)).alias("operational")).withColumnRenamed("fleet_id", "slug")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(~F.col("operational"), F.lower("name"), "slug")).cast("long"))  # a row a tenant


PUBLISHED_SQL = "published AS (SELECT company_slug, max(occurred_at) AS cut_at, CASE WHEN company_slug <> 'gamma' THEN '{}' END AS snapshot_json FROM kept GROUP BY company_slug)"


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.kept(spark, sf_dir).groupBy("company_slug").agg(F.max("occurred_at").alias("cut_at")).withColumn("snapshot_json", F.when(F.col("company_slug") != "gamma", "{}"))


@query("company_ready", f", {CATALOG_SQL.strip()}, {PUBLISHED_SQL} SELECT c.slug, p.cut_at, j.status AS rebuild, p.snapshot_json IS NOT NULL AND coalesce(j.status, 'idle') NOT IN ('queued', 'running', 'failed') AS ready FROM (VALUES ('acme'), ('beta'), ('gamma'), ('delta')) c(slug) LEFT JOIN published p ON p.company_slug = c.slug LEFT JOIN latest_jobs j ON j.company_slug = c.slug")
def company_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that can be shown: a publication with a snapshot, and a latest rebuild that isn't queued, running or failed."""
    c = spark.createDataFrame([("acme",), ("beta",), ("gamma",), ("delta",)], "company_slug string")
    both = c.join(published(spark, sf_dir), "company_slug", "left").join(latest_jobs(spark, sf_dir).select("company_slug", F.col("status").alias("rebuild")), "company_slug", "left")
    ready = F.col("snapshot_json").isNotNull() & ~F.coalesce("rebuild", F.lit("idle")).isin("queued", "running", "failed")
    return both.select(F.col("company_slug").alias("slug"), "cut_at", "rebuild", ready.alias("ready"))


@query(
    "publication_meta",
    f""", {CATALOG_SQL.strip()}, {PUBLISHED_SQL} SELECT company_slug, published_cut_at, time_bucket(INTERVAL 15 MINUTE, coalesce(published_cut_at, TIMESTAMP '2024-01-31 00:00:00')) + INTERVAL 15 MINUTE AS next_cut_at, CASE WHEN own IS NOT NULL THEN 'partial' WHEN published_cut_at IS NOT NULL THEN 'succeeded' ELSE 'pending' END AS cut_status, last_message_at
    FROM (SELECT a.company_slug, CASE WHEN p.snapshot_json IS NOT NULL THEN p.cut_at END AS own, coalesce(CASE WHEN p.snapshot_json IS NOT NULL THEN p.cut_at END, max(a.received_at) FILTER (a.event_id % 50 = 0)) AS published_cut_at, max(a.received_at) AS last_message_at FROM alarms a LEFT JOIN published p USING (company_slug) GROUP BY a.company_slug, p.snapshot_json, p.cut_at)""",
)
def publication_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot says of its publication: its cut, or a fallback; the next boundary; a status; the last message."""
    p = published(spark, sf_dir).filter("snapshot_json is not null").select("company_slug", F.col("cut_at").alias("own"))
    seen = d.alarms(spark, sf_dir).groupBy("company_slug").agg(F.max(F.when(F.col("event_id") % 50 == 0, F.col("received_at"))).alias("fallback"), F.max("received_at").alias("last_message_at"))
    both = seen.join(p, "company_slug", "left").withColumn("published_cut_at", F.coalesce("own", "fallback"))
    status = F.when(F.col("own").isNotNull(), "partial").when(F.col("published_cut_at").isNotNull(), "succeeded").otherwise("pending")
    after = x.cut_start(F.coalesce("published_cut_at", F.lit(d.AS_OF).cast("timestamp"))) + F.expr("INTERVAL 15 MINUTES")
    return both.select("company_slug", "published_cut_at", after.alias("next_cut_at"), status.alias("cut_status"), "last_message_at")


@query("run_overview", f", {CATALOG_SQL.strip()} SELECT count_if(status = 'succeeded' AND day = (SELECT max(day) FROM jobs))::BIGINT AS completed, count_if(status IN ('partial', 'failed') OR (status NOT IN ('queued', 'running') AND day < (SELECT max(day) FROM jobs)))::BIGINT AS delayed, count_if(status = 'running')::BIGINT AS running, count_if(status = 'queued')::BIGINT AS queued, count_if(status IN ('running', 'queued'))::BIGINT AS queue_depth FROM latest_jobs")
def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the companies' latest runs: those that finished the current cut, those behind, and the queue."""
    cut = jobs(spark, sf_dir).agg(F.max("day").alias("cut"))  # one row
    s = F.col("status")
    behind = s.isin("partial", "failed") | (~s.isin("queued", "running") & (F.col("day") < F.col("cut")))
    n = F.count_if
    return latest_jobs(spark, sf_dir).join(F.broadcast(cut)).agg(n((s == "succeeded") & (F.col("day") == F.col("cut"))).alias("completed"), n(behind).alias("delayed"), n(s == "running").alias("running"), n(s == "queued").alias("queued"), n(s.isin("running", "queued")).alias("queue_depth"))


@query(
    "job_progress",
    f""", {CATALOG_SQL.strip()} SELECT company_slug, count_if(status = 'queued')::BIGINT AS queued, count_if(status = 'running')::BIGINT AS running, count_if(status = 'succeeded')::BIGINT AS succeeded, count_if(status IN ('failed', 'partial'))::BIGINT AS failed, arg_max(job_id, day) FILTER (status = 'running') AS current_job,
    least(100.0, round(count_if(status = 'succeeded')::DOUBLE / count(*) * 100, 1)) AS progress_pct, CAST(least(30, greatest(1, (count_if(status = 'succeeded') * 30 + count(*) - 1) // count(*))) AS BIGINT) AS days_done FROM jobs GROUP BY company_slug""",
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's jobs by status, the running one, and how far a rebuild of 30 days has come."""
    s, n = F.col("status"), F.count_if
    out = jobs(spark, sf_dir).groupBy("company_slug").agg(n(s == "queued").alias("queued"), n(s == "running").alias("running"), n(s == "succeeded").alias("succeeded"), n(s.isin("failed", "partial")).alias("failed"), F.max(F.when(s == "running", F.struct("day", "job_id"))).alias("now"), F.count("*").alias("all"))
    return out.select("company_slug", "queued", "running", "succeeded", "failed", F.col("now.job_id").alias("current_job"), x.progress(F.col("succeeded").cast("double"), F.col("all")).alias("progress_pct"), x.ceil_share(F.col("succeeded"), F.col("all"), F.lit(30)).alias("days_done"))


@query("orphan_jobs", f", {CATALOG_SQL.strip()} SELECT job_id, company_slug FROM jobs WHERE company_slug NOT IN ('acme', 'beta') AND status <> 'succeeded'")
def orphan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of companies that are no longer configured."""
    configured = spark.createDataFrame([("acme",), ("beta",)], "company_slug string")
    return jobs(spark, sf_dir).filter("status <> 'succeeded'").join(configured, "company_slug", "left_anti").select("job_id", "company_slug")


@query("job_devices", f"{RAW_SQL}, {CATALOG_SQL.strip()} SELECT j.job_id, j.company_slug, v.device_id, v.plate FROM latest_jobs j LEFT JOIN devices v ON v.company_slug = j.company_slug")
def job_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with the devices that they work off."""
    v = devices(spark, sf_dir).select("company_slug", "device_id", "plate")
    return latest_jobs(spark, sf_dir).select("job_id", "company_slug").join(v, "company_slug", "left")


@query(
    "tenant_devices",
    f"""{RAW_SQL}, found AS (SELECT 'north' AS slug, device_id FROM devices WHERE device_id BETWEEN 'D00000' AND 'D00039' UNION ALL SELECT 'south', device_id FROM devices WHERE fleet_id IN ('F1', 'F3') UNION ALL SELECT 'mixed', device_id FROM devices WHERE device_id IN ('D00003', 'D00005') UNION ALL SELECT 'all', device_id FROM devices),
    listed AS (SELECT 'ghost' AS slug, unnest(['X00001', 'X00002']) AS device_id UNION ALL SELECT 'mixed', unnest(['D00003', 'D00005']))
    SELECT slug, device_id FROM found UNION ALL SELECT slug, device_id FROM listed WHERE slug NOT IN (SELECT slug FROM found)""",
)
def tenant_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's devices: the known ones that belong to it; those that it lists only where none is known."""
    ghost = spark.createDataFrame([("ghost", ["X00001", "X00002", "X00001"], [], 4)], "slug string, device_ids array<string>, fleet_ids array<string>, position int")
    config = d.companies(spark).unionByName(ghost)
    found = members(devices(spark, sf_dir).select("device_id", "fleet_id"), config).select("slug", "device_id").distinct()
    listed = config.select("slug", F.explode("device_ids").alias("device_id")).distinct()
    return found.unionByName(listed.join(found.select("slug").distinct(), "slug", "left_anti"))


PURGED = "company_slug = 'beta' OR device_id IN ('D00003', 'D00005') OR fleet_id = 'F2'"


@query("tenant_purge_all", f"{RAW_SQL} SELECT 'alarms' AS tbl, count_if({PURGED})::BIGINT AS purged, count_if(NOT ({PURGED}))::BIGINT AS left_rows FROM alarms UNION ALL SELECT 'raw', count_if({PURGED})::BIGINT, count_if(NOT ({PURGED}))::BIGINT FROM raw UNION ALL SELECT 'readings', count_if({PURGED})::BIGINT, count_if(NOT ({PURGED}))::BIGINT FROM readings UNION ALL SELECT 'daily', count_if({PURGED})::BIGINT, count_if(NOT ({PURGED}))::BIGINT FROM daily UNION ALL SELECT 'devices', count_if({PURGED})::BIGINT, count_if(NOT ({PURGED}))::BIGINT FROM devices")
def tenant_purge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing a tenant takes from each table, and what it leaves: its slug, its devices or its fleets."""
    from haulmark.plans.raw_layer import raw

    scope = (F.col("company_slug") == "beta") | F.col("device_id").isin("D00003", "D00005") | (F.col("fleet_id") == "F2")
    tables = {"alarms": d.alarms(spark, sf_dir), "raw": raw(spark, sf_dir), "readings": d.readings(spark, sf_dir), "daily": d.daily(spark, sf_dir), "devices": devices(spark, sf_dir)}
    out = None
    for name, df in tables.items():
        one = df.agg(F.count_if(scope).alias("purged"), F.count_if(~scope).alias("left_rows")).select(F.lit(name).alias("tbl"), "purged", "left_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "tenant_recover_all",
    f"""{RAW_SQL}, s(slug) AS (VALUES ('acme'), ('beta'), ('gamma')), tiers AS (SELECT 0 AS tier, 25 AS most, company_slug, device_id, last_seen AS t FROM devices WHERE company_slug = 'acme' UNION ALL SELECT 1, 50, company_slug, device_id, max(received_at) FROM raw WHERE company_slug IN ('acme', 'beta') GROUP BY ALL UNION ALL SELECT 2, 50, company_slug, device_id, max(occurred_at) FROM alarms GROUP BY ALL),
    best AS (SELECT company_slug, min(tier) AS tier FROM tiers GROUP BY 1), r AS (SELECT t.*, row_number() OVER (PARTITION BY t.company_slug ORDER BY t.t DESC, t.device_id) AS n FROM tiers t JOIN best b ON b.company_slug = t.company_slug AND b.tier = t.tier)
    SELECT company_slug, CAST(max(tier) AS INTEGER) AS tier, array_to_string(list(device_id ORDER BY device_id), ',') AS devices FROM r WHERE n <= most GROUP BY company_slug""",
)
def tenant_recover_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's device list out of its rows: the 25 devices seen last, else the last 50 of the raw layer, else of the events."""
    from haulmark.plans.raw_layer import raw

    first = devices(spark, sf_dir).filter("company_slug = 'acme'").select("company_slug", "device_id", F.col("last_seen").alias("t"))
    by = lambda df, c: df.groupBy("company_slug", "device_id").agg(F.max(c).alias("t"))
    second, third = by(raw(spark, sf_dir).filter("company_slug in ('acme', 'beta')"), "received_at"), by(d.alarms(spark, sf_dir), "occurred_at")
    tiers = None
    for k, (df, most) in enumerate(((first, 25), (second, 50), (third, 50))):
        one = df.withColumns({"tier": F.lit(k), "most": F.lit(most)})
        tiers = one if tiers is None else tiers.unionByName(one)
    best = tiers.groupBy("company_slug").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("company_slug").orderBy(F.desc("t"), "device_id")
    ranked = tiers.join(best, ["company_slug", "tier"]).withColumn("n", F.row_number().over(w)).filter("n <= most")
    return ranked.groupBy("company_slug").agg(F.max("tier").alias("tier"), F.array_join(F.array_sort(F.collect_list("device_id")), ",").alias("devices"))


@query("harvest_status", "SELECT company_slug, cut_at, CASE WHEN limited > 0 THEN 'rate_limited' WHEN failed = 0 THEN 'succeeded' WHEN failed = devices THEN 'failed' ELSE 'partial' END AS status, failed = 0 AND limited = 0 AS publishes, devices FROM (SELECT company_slug, time_bucket(INTERVAL 15 MINUTE, occurred_at) AS cut_at, count(DISTINCT device_id) AS devices, count(DISTINCT device_id) FILTER (user_id % 11 = 0) AS failed, count(DISTINCT device_id) FILTER (user_id % 37 = 0) AS limited FROM alarms GROUP BY ALL)")
def harvest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of each company's cut: published only if all devices succeed."""
    one = d.alarms(spark, sf_dir).groupBy("company_slug", x.cut_start(F.col("occurred_at")).alias("cut_at"), "device_id").agg(F.max(F.col("user_id") % 11 == 0).alias("bad"), F.max(F.col("user_id") % 37 == 0).alias("slow"))
    out = one.groupBy("company_slug", "cut_at").agg(F.count("*").alias("devices"), F.count_if("bad").alias("failed"), F.count_if("slow").alias("limited"))
    status = F.when(F.col("limited") > 0, "rate_limited").when(F.col("failed") == 0, "succeeded").when(F.col("failed") == F.col("devices"), "failed").otherwise("partial")
    return out.select("company_slug", "cut_at", status.alias("status"), ((F.col("failed") == 0) & (F.col("limited") == 0)).alias("publishes"), "devices")


@query("rebuild_chunks", "SELECT company_slug, chunk_start, chunk_end, n, chunk_end < DATE '2024-01-15' AS done FROM (SELECT company_slug, CAST(DATE '2024-01-01' + CAST((day - DATE '2024-01-01') // 10 * 10 AS INTEGER) AS DATE) AS chunk_start, CAST(DATE '2024-01-01' + CAST((day - DATE '2024-01-01') // 10 * 10 + 9 AS INTEGER) AS DATE) AS chunk_end, count(*) AS n FROM alarms WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY ALL)")
def rebuild_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild of a month in chunks of ten days; chunks up to the last processed day are done and are left out when it resumes."""
    a = d.in_days(d.alarms(spark, sf_dir), d.THIRTY)
    number = F.floor(F.date_diff("day", F.expr("DATE '2024-01-01'")) / 10).cast("int") * 10
    start = F.date_add(F.expr("DATE '2024-01-01'"), number)
    out = a.groupBy(F.col("company_slug"), start.alias("chunk_start")).agg(F.count("*").alias("n")).withColumn("chunk_end", F.date_add("chunk_start", 9))
    return out.withColumn("done", F.col("chunk_end") < F.expr("DATE '2024-01-15'"))


@query("km_repair_carry", "SELECT device_id, day, event_id, norm, CAST(greatest(norm - coalesce(lag(norm) OVER (PARTITION BY device_id ORDER BY day, observed_at, event_id), norm), 0) AS DECIMAL(24,5)) AS repaired_km FROM (SELECT *, CAST(total_km AS DECIMAL(24,5)) AS norm FROM readings)")
def km_repair_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading's distance from the normalised total before it, in order of day and time: totals in metres are normalised first."""
    metres = F.col("event_id") % 10 == 0
    told = F.when(metres, F.col("total_km") * 1000).otherwise(F.col("total_km"))
    norm = F.when(metres, told / 1000).otherwise(told).cast("decimal(24,5)")
    w = Window.partitionBy("device_id").orderBy("day", "observed_at", "event_id")
    rows = d.readings(spark, sf_dir).withColumn("norm", norm)
    return rows.select("device_id", "day", "event_id", "norm", F.greatest(F.col("norm") - F.coalesce(F.lag("norm").over(w), "norm"), F.lit(0)).cast("decimal(24,5)").alias("repaired_km"))


@query(
    "km_quality_samples",
    f"""{RAW_SQL}, v AS (SELECT device_id, plate, company_slug, right(device_id, 1) IN ('2', '5') AS device_flag, right(device_id, 1) IN ('5', '8') AS day_flag, coalesce(last_day_km >= 0 AND last_day_km <= 1000 AND last_day_km <= last_total_km + 0.1, false) AS ok, last_day_km IS NULL AS missing FROM devices)
    SELECT company_slug, count_if(ok)::BIGINT AS valid, count_if(NOT ok)::BIGINT AS invalid, count_if(device_flag)::BIGINT + count_if(day_flag)::BIGINT AS regressions, array_to_string(list(plate ORDER BY plate, device_id) FILTER (NOT ok)[1:8], ',') AS invalid_sample,
    array_to_string(list(plate ORDER BY plate, device_id) FILTER (device_flag OR day_flag)[1:8], ',') AS regression_sample, array_to_string(list(plate ORDER BY plate, device_id) FILTER (NOT ok AND missing)[1:8], ',') AS missing_sample FROM v GROUP BY company_slug""",
)
def km_quality_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with and without a valid day's distance, with up to eight plates each. A device counts twice as a regression if both it and
    its snapshot are flagged. Samples are ranked, never collected whole."""
    last = F.col("device_id").substr(-1, 1)
    ok = x.valid_distance(F.col("last_day_km"), F.col("last_total_km"))
    v = devices(spark, sf_dir).select("device_id", "plate", "company_slug", last.isin("2", "5").alias("device_flag"), last.isin("5", "8").alias("day_flag"), ok.alias("ok"), F.col("last_day_km").isNull().alias("missing"))
    nth = lambda c: F.when(c, F.sum(c.cast("int")).over(Window.partitionBy("company_slug").orderBy("plate", "device_id")))
    ranked = v.withColumns({"i": nth(~F.col("ok")), "g": nth(F.col("device_flag") | F.col("day_flag")), "m": nth(~F.col("ok") & F.col("missing"))})
    sample = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= 8, F.struct(F.col(c).alias("k"), F.col("plate").alias("p"))))), lambda s: s["p"])
    return ranked.groupBy("company_slug").agg(
        F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"), (F.count_if("device_flag") + F.count_if("day_flag")).alias("regressions"),
        F.nullif(F.array_join(sample("i"), ","), F.lit("")).alias("invalid_sample"), F.nullif(F.array_join(sample("g"), ","), F.lit("")).alias("regression_sample"), F.nullif(F.array_join(sample("m"), ","), F.lit("")).alias("missing_sample"),
    )


@query("km_flagged_vehicles", f"{RAW_SQL} SELECT device_id, plate, last_total_km FROM devices WHERE plate IN (SELECT plate FROM devices WHERE right(device_id, 1) IN ('2', '5'))")
def km_flagged_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles whose plate some check has flagged."""
    v = devices(spark, sf_dir)
    flagged = v.filter(F.col("device_id").substr(-1, 1).isin("2", "5")).select("plate")
    return v.join(flagged, "plate", "left_semi").select("device_id", "plate", "last_total_km")


@query("km_exceptions_top", f"{RAW_SQL} SELECT plate, count(*) AS n FROM (SELECT plate FROM devices WHERE last_day_km IS NULL UNION ALL SELECT plate FROM devices WHERE last_day_km > 1000 UNION ALL SELECT plate FROM daily WHERE day_km > 1000) GROUP BY plate ORDER BY n DESC, plate LIMIT 6")
def km_exceptions_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = devices(spark, sf_dir)
    lists = v.filter("last_day_km is null").select("plate").union(v.filter("last_day_km > 1000").select("plate")).union(d.daily(spark, sf_dir).filter("day_km > 1000").select("plate"))
    return lists.groupBy("plate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "plate").limit(6)


@query(
    "fleet_km_replaced",
    """SELECT day, sum(km) AS km FROM (SELECT coalesce(s.plate, l.plate) AS plate, coalesce(s.day, l.day) AS day, CAST(round(greatest(coalesce(s.km, l.km), 0), 1) AS DECIMAL(24,1)) AS km FROM (SELECT plate, day, max(day_km) AS km FROM readings WHERE day_km IS NOT NULL GROUP BY ALL) l
    FULL JOIN (SELECT plate, day, arg_max(value, (occurred_at, event_id)) AS km FROM alarms WHERE event_id % 3 = 0 GROUP BY ALL) s ON s.plate = l.plate AND s.day = l.day) GROUP BY day""",
)
def fleet_km_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fleet's distance of a day when vehicles' values are replaced: each vehicle and day has the last snapshot's value, else the largest
    reading's, and only then the day adds up."""
    told = d.readings(spark, sf_dir).filter("day_km is not null").groupBy("plate", "day").agg(F.max("day_km").alias("told"))
    snap = d.alarms(spark, sf_dir).filter("event_id % 3 = 0").groupBy("plate", "day").agg(F.max_by("value", F.struct("occurred_at", "event_id")).alias("snap"))
    km = F.round(F.greatest(F.coalesce("snap", "told"), F.lit(0)), 1).cast("decimal(24,1)")
    return told.join(snap, ["plate", "day"], "full").groupBy("day").agg(F.sum(km).alias("km"))


@query("vehicle_status_sorted", f"{RAW_SQL} SELECT device_id, feed_status, CAST(row_number() OVER (ORDER BY feed_status, coalesce(nullif(plate, ''), device_id), device_id) AS BIGINT) AS place FROM (SELECT *, CASE WHEN a < 20 THEN 'online' WHEN a < 45 THEN 'delayed' ELSE 'stopped' END AS feed_status FROM (SELECT *, floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - last_seen) / 60) AS a FROM devices)) ORDER BY place LIMIT 500")
def vehicle_status_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 vehicles by feed status and plate."""
    age = F.floor((F.unix_micros(F.lit(d.AS_OF).cast("timestamp")) - F.unix_micros("last_seen")) / 60_000_000)
    rows = devices(spark, sf_dir).select("device_id", x.feed_status(age).alias("feed_status"), x.first_non_empty(F.col("plate"), F.col("device_id")).alias("label"))
    order = ["feed_status", "label", "device_id"]
    return rows.orderBy(*order).limit(500).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("label")  # 500 rows


@query("status_stored", "SELECT device_id, day, CAST(count(*) AS BIGINT) AS readings, max(total_km) AS total_km, count_if(prev IS NOT NULL AND total_km + 0.1 < prev)::BIGINT AS regressions FROM (SELECT *, lag(total_km) OVER (PARTITION BY device_id ORDER BY observed_at, event_id) AS prev FROM (SELECT * REPLACE (CASE WHEN event_id % 23 = 0 THEN total_km - 500 ELSE total_km END AS total_km) FROM readings)) GROUP BY ALL")
def status_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stored status messages leave: a snapshot of each device and day, with the readings that fall below the one before."""
    rows = d.readings(spark, sf_dir).withColumn("total_km", F.when(F.col("event_id") % 23 == 0, F.col("total_km") - 500).otherwise(F.col("total_km")))
    prev = F.lag("total_km").over(Window.partitionBy("device_id").orderBy("observed_at", "event_id"))
    falls = F.coalesce(F.col("total_km") + F.expr("0.1BD") < F.col("prev"), F.lit(False))
    return rows.withColumn("prev", prev).groupBy("device_id", "day").agg(F.count("*").alias("readings"), F.max("total_km").alias("total_km"), F.count_if(falls).alias("regressions"))
