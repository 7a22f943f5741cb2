"""Tables after purges, and what went from each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators.purge import purge, purge_tenant
from haulmark.plans.register import query
from haulmark.sources import domain as d
from haulmark.sources.shared import shared_dir
from haulmark.sources.versions import TableStore

STORES: dict[tuple[str, str], tuple[str, dict[str, int], dict[str, int]]] = {}
NAMES = ["alarms", "readings", "daily"]
GONE = "(company_slug = 'mixed' OR device_id IN ('D00003', 'D00005') OR fleet_id = 'F2')"
MADE = "(device_id LIKE 'D0000%' OR fleet_id = 'F4')"


def purged(spark: SparkSession, sf_dir: str) -> tuple[TableStore, dict[str, int], dict[str, int]]:
    """A store of three tables after the tenant `mixed` and then all generated rows have gone, and the alarms' deletes were merged."""
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in STORES or not TableStore(spark, STORES[made][0]).version():
        store = TableStore(spark, f"{shared_dir(spark).rstrip('/')}/purged-{uuid.uuid4().hex}")
        t = store.begin()
        alarms = d.alarms(spark, sf_dir).select("guid", "device_id", "fleet_id", "company_slug", "day", "category")
        t.append("alarms", alarms.filter("day < date '2024-01-16'"), ["day"])
        t.append("alarms", alarms.filter("day >= date '2024-01-16'"))
        t.append("readings", d.readings(spark, sf_dir).select("device_id", "fleet_id", "company_slug", "observed_at", "total_km"))
        t.append("daily", d.daily(spark, sf_dir).select("device_id", "fleet_id", "day", "total_km"))
        t.commit()
        tenant = purge_tenant(store, d.companies(spark), "mixed", NAMES)
        generated = F.col("device_id").startswith("D0000") | (F.col("fleet_id") == "F4")
        synthetic = purge(store, dict.fromkeys(NAMES, generated))
        store.rewrite("alarms")
        STORES[made] = (store.root, tenant, synthetic)
    root, tenant, synthetic = STORES[made]
    return TableStore(spark, root), tenant, synthetic


@query("purged_alarms", f"SELECT guid, device_id, fleet_id, company_slug, day, category FROM alarms WHERE NOT {GONE} AND NOT {MADE}")
def purged_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarms that a tenant's purge and the purge of generated rows leave."""
    return purged(spark, sf_dir)[0].read("alarms")


@query("purged_readings", f"SELECT device_id, fleet_id, company_slug, observed_at, total_km FROM readings WHERE NOT {GONE} AND NOT {MADE}")
def purged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purged(spark, sf_dir)[0].read("readings")


def counts(table: str, slug: bool = True) -> str:
    gone = GONE if slug else "(device_id IN ('D00003', 'D00005') OR fleet_id = 'F2')"
    return f"SELECT '{table}' AS tbl, CAST(count(*) FILTER ({gone}) AS BIGINT) AS tenant, CAST(count(*) FILTER (NOT {gone} AND {MADE}) AS BIGINT) AS synthetic, CAST(count(*) FILTER (NOT {gone} AND NOT {MADE}) AS BIGINT) AS left_rows FROM {table}"


@query("purge_counts", " UNION ALL ".join([counts("alarms"), counts("readings"), counts("daily", False)]))
def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each purge took from each table, and rows that are left."""
    store, tenant, synthetic = purged(spark, sf_dir)
    took = spark.createDataFrame([(n, tenant[n], synthetic[n]) for n in NAMES], "tbl string, tenant long, synthetic long")
    left = None
    for n in NAMES:
        one = store.read(n).agg(F.count("*").alias("left_rows")).withColumn("tbl", F.lit(n))
        left = one if left is None else left.unionByName(one)
    return took.join(left, "tbl").select("tbl", "tenant", "synthetic", "left_rows")
