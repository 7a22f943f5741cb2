"""Tables in and out: configuration overlays, partitioned layouts, relational copies and binary reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPANY = "slug string, name string, timezone string, device_ids array<string>, fleet_ids array<string>, allowed_categories array<string>, subtype_map map<string,string>, plate_aliases map<string,string>"


def company_config(spark: SparkSession, file: str, rows: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Companies from a JSON array (what isn't an object in it is dropped), overlaid by rows of a table: the last one of a slug wins, lists are sorted and distinct.

    order: a column of rows that says which comes later; without it a slug has one row there.
    """
    items = spark.read.option("wholetext", True).text(file).select(F.explode(F.from_json("value", "array<variant>")).alias("v")).select(F.to_json("v").alias("v"))
    base = items.filter(F.col("v").startswith("{")).select(F.from_json("v", COMPANY).alias("c")).select("c.*").filter("slug is not null").withColumn("_p", F.lit(0))
    both = base if rows is None else base.unionByName(rows.withColumn("_p", F.lit(1) if order is None else F.lit(1) + F.dense_rank().over(Window.partitionBy("slug").orderBy(order))).drop(*([order] if order else [])), allowMissingColumns=True)
    w = Window.partitionBy("slug").orderBy(F.desc("_p"))
    tidy = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""))).alias(c)
    one = both.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return one.select("slug", "name", "timezone", tidy("device_ids"), tidy("fleet_ids"), tidy("allowed_categories"), "subtype_map", "plate_aliases")


def write_events(df: DataFrame, path: str, day: str = "day") -> None:
    """The layout of event tables: a folder a company and day, rows of a device together, so tenant and time filters prune. Rewrites touched days
    only. Rebalancing splits a day of a large tenant over tasks, each with a file of its own, and puts small ones together."""
    (
        df.hint("rebalance", F.col("company_slug"), F.col(day))
        .sortWithinPartitions("company_slug", day, "device_id", "occurred_at")
        .write.partitionBy("company_slug", day).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    )


def write_snapshot(df: DataFrame, path: str, key: str = "company_slug") -> None:
    """A materialised JSON snapshot for each company; companies that df lacks keep theirs."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("snapshot_json")
    df.select(body, key).write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def copy_table(spark: SparkSession, source_url: str, target_url: str, table: str, properties: dict[str, str] | None = None, truncate: bool = False, batch: int = 500) -> int:
    """Copies a relational table by JDBC in batches; returns its rows."""
    rows = spark.read.jdbc(source_url, table, properties=properties or {})
    writer = rows.write.option("batchsize", batch).option("truncate", truncate).mode("overwrite" if truncate else "append")
    writer.jdbc(target_url, table, properties=properties or {})
    return rows.count()


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly PDF reports: company, year, month, path and size from names like <company>/<yyyy>/<mm>.pdf; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)
    part = lambda k: F.regexp_extract("path", r"([^/]+)/(\d{4})/(\d{2})\.pdf$", k)
    return files.select(part(1).alias("company"), part(2).cast("int").alias("year"), part(3).cast("int").alias("month"), "path", F.col("length").alias("bytes"))


def closed_months(df: DataFrame, year: int, month: int) -> DataFrame:
    """Reports of months before the given one."""
    return df.filter(F.struct("year", "month") < F.struct(F.lit(year).alias("year"), F.lit(month).alias("month")))


def publish(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "15 minutes"):
    """Pushes each micro-batch to subscribers through send; returns the running query."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def assign_company(config: DataFrame, changes: DataFrame) -> DataFrame:
    """The configuration with changes of (slug, action, device_ids, fleet_ids): 'assign' replaces a company's lists, 'add' unites them, 'delete'
    removes it, and an unknown slug is added. Lists come out sorted and distinct. One change a slug."""
    none = F.array().cast("array<string>")
    tidy = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    both = config.alias("c").join(changes.alias("x"), "slug", "full")
    now = lambda c: F.when(F.col("x.action").isNull(), F.col(f"c.{c}")).when(F.col("x.action") == "add", F.array_union(F.coalesce(F.col(f"c.{c}"), none), F.col(f"x.{c}"))).otherwise(F.col(f"x.{c}"))
    return both.filter(F.coalesce(F.col("x.action") != "delete", F.lit(True))).select("slug", tidy(now("device_ids")).alias("device_ids"), tidy(now("fleet_ids")).alias("fleet_ids"))


def switch_company(config: DataFrame, switches: DataFrame) -> DataFrame:
    """The configuration after switches of (slug, active): a company that is switched off keeps its row and lists nothing; others are as they were,
    active. One switch a slug."""
    none = F.array().cast("array<string>")
    both = config.join(switches, "slug", "left").withColumn("active", F.coalesce("active", F.lit(True)))
    held = lambda c: F.when(F.col("active"), F.array_sort(F.coalesce(F.col(c), none))).otherwise(none).alias(c)
    return both.select("slug", "active", held("device_ids"), held("fleet_ids"))
