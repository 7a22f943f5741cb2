"""Purges: rows of several tables go in one version, as deletes by position, and are counted before it is committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.sources.versions import TableStore, Transaction


def purge(store: TableStore, conditions: dict[str, Column]) -> dict[str, int]:
    """Deletes the rows of each table that its condition holds for; how many went, by table. All go or none does."""
    t = store.begin()
    gone = {name: t.delete_where(name, F.coalesce(condition, F.lit(False))) for name, condition in conditions.items()}
    if any(gone.values()):
        t.commit(purged=gone)
    return gone


def tenant_rows(t: Transaction, name: str, slug: str, device_ids: DataFrame, fleet_ids: DataFrame) -> DataFrame:
    """Rows of a table that are a tenant's: by its slug, by a device or by a fleet that it lists, in one pass. Lists of any length are joined."""
    rows = t.read(name, places=True)
    own = F.coalesce(F.col("company_slug") == slug, F.lit(False)) if "company_slug" in rows.columns else F.lit(False)
    for key, listed in (("device_id", device_ids), ("fleet_id", fleet_ids)):
        if key in rows.columns:
            rows = rows.join(listed.select(key).distinct().withColumn(f"_{key}", F.lit(True)), key, "left")
            own = own | F.coalesce(F.col(f"_{key}"), F.lit(False))
    return rows.filter(own).select("_place")


def purge_tenant(store: TableStore, company: DataFrame, slug: str, names: list[str]) -> dict[str, int]:
    """Removes a company's rows from tables. company: the configured row(s) of the slug, with device_ids and fleet_ids."""
    t = store.begin()
    listed = lambda c, to: company.filter(F.col("slug") == slug).select(F.explode(c).alias(to)).distinct()
    devices, fleets = listed("device_ids", "device_id"), listed("fleet_ids", "fleet_id")
    gone = {name: t.delete(name, tenant_rows(t, name, slug, devices, fleets), once=True) for name in names}
    if any(gone.values()):
        t.commit(purged=gone)
    return gone
