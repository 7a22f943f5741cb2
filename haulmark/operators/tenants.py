"""Which company a row belongs to, by equi-joins on what companies list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of names up to which the companies that take every row are broadcast.
MOST_BYTES = 8 << 20


def members(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Each row with each company that it belongs to: slug and position are added.

    Devices decide if the company lists any and the row has one; else fleets; else a company without lists takes all. Lists of any length
    become rows of (kind, id), so a row looks up its device and its fleet in one equi-join, which Spark broadcasts or shuffles by size.
    Companies without lists have no key: each row meets each of them, as its result says.
    """
    none = F.array().cast("array<string>")
    c = companies.select("slug", "position", F.coalesce("device_ids", none).alias("_d"), F.coalesce("fleet_ids", none).alias("_f"))
    listed = F.array_union(F.transform("_d", lambda v: F.struct(F.lit("device").alias("kind"), v.alias("id"))), F.transform("_f", lambda v: F.struct(F.lit("fleet").alias("kind"), v.alias("id"))))
    keys = c.select("slug", "position", (F.size("_d") > 0).alias("_by_device"), F.explode(listed).alias("_k"))
    device, fleet = F.nullif(F.col("device_id"), F.lit("")), F.nullif(F.col("fleet_id"), F.lit(""))
    own = F.array(F.struct(F.lit("device").alias("kind"), device.alias("id")), F.struct(F.lit("fleet").alias("kind"), fleet.alias("id")))
    looks = rows.withColumn("_k", F.explode(own)).filter("_k.id is not null")
    found = looks.join(keys, "_k").filter((F.col("_k.kind") == "device") | ~F.col("_by_device") | device.isNull())
    found = found.select(*[F.col(f"`{x}`") for x in rows.columns], "slug", "position")
    whole = c.filter((F.size("_d") == 0) & (F.size("_f") == 0)).select("slug", "position", F.lit(0).alias("_all"))
    small = (whole.agg(F.sum(F.octet_length("slug") + 16)).first()[0] or 0) <= MOST_BYTES
    return found.unionByName(rows.withColumn("_all", F.lit(0)).join(F.broadcast(whole) if small else whole, "_all").drop("_all"))


def first_match(rows: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """key and slug: the first company, in configured order, that a row of key belongs to."""
    return members(rows, companies).groupBy(key).agg(F.min_by("slug", "position").alias("slug"))
