"""Sharded dataset store with size-tiered compaction (operator 10), in DataFrame functions and Spark's own readers and writers.

Arrivals are written as small immutable shards. When enough runs of similar size have come together, a merge reads their shards in
target-sized splits and writes each split as one file: rows pass from scan to file without a shuffle, so no key can be hot. A version
is a manifest, written as a table of its own and made current by one rename that fails if the version exists; readers see the old
version or the new one. Nothing that a version names is ever changed. A manifest has a row a run, not a shard: a run's folder is complete
before a version names it, so its files need no list of their own, and compaction keeps runs to a few for each tier. Commits, merges
and reads therefore handle as many rows as there are runs, however many shards these have.

The rename replaces nothing and is atomic on local and HDFS file systems. Object stores that copy on rename need a single writer.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "run string, tier int, path string, bytes long"
RUNS = "run string, tier int, bytes long, files long, columns string"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def all_columns(schemas: list[StructType]) -> StructType:
    """The columns of several schemas, each once and in order of first coming; one name with two types is refused."""
    out, kinds = StructType([]), {}
    for f in (f for schema in schemas for f in schema.fields):
        if f.name not in kinds:
            out, kinds[f.name] = out.add(f.name, f.dataType, True), f.dataType.simpleString()
        elif kinds[f.name] != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {kinds[f.name]} in the store, not {f.dataType.simpleString()}")
    return out


@dataclass(frozen=True)
class Tiers:
    """fan_in: runs of similar size that make a merge. spread: how far sizes may lie from their mean to be similar. target_bytes: of a merged shard."""

    fan_in: int = 4
    spread: float = 0.5
    target_bytes: int = 64 << 20


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, tiers: Tiers | None = None):
        self.spark, self.root, self.tiers = spark, root.rstrip("/"), tiers or Tiers()
        self.jvm = spark._jvm
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.root).toUri(), spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    # versions

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        folder = self.path(f"{self.root}/versions")
        if not self.files.util().exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self.files.util().listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def stored(self, version: int | None = None) -> DataFrame:
        """run, tier, bytes and files of every run of a version: what its manifest says."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(f"{self.root}/versions/{version:08d}")

    def manifest(self, version: int | None = None) -> DataFrame:
        """run, tier, path and bytes of every shard of a version, from a listing of its runs."""
        found = [self.shards_of(r.run, r.tier, f"{self.root}/runs/{r.run}") for r in self.stored(version).collect()]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], MANIFEST)

    def commit(self, shards: DataFrame, version: int) -> int:
        """Makes shards (or runs, as stored() gives them) the given version, at once and only if nobody else has: a rename that doesn't replace."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        files = F.sum("files") if "files" in shards.columns else F.count("*")
        columns = F.max("columns") if "columns" in shards.columns else F.lit(None).cast("string")
        runs = shards.groupBy("run").agg(F.max("tier").cast("int").alias("tier"), F.sum("bytes").cast("long").alias("bytes"), files.cast("long").alias("files"), columns.alias("columns"))
        runs.coalesce(1).write.parquet(staged)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        self.files.mkdir(self.path(f"{self.root}/versions"), None, True)
        final = self.path(f"{self.root}/versions/{version:08d}")
        if self.files.util().exists(final):
            raise Conflict(f"version {version} exists")
        try:
            self.files.rename(self.path(staged), final, options)
        except Exception as e:
            raise Conflict(f"version {version} exists") from e
        return version

    # shards

    def shards_of(self, run: str, tier: int, folder: str) -> DataFrame:
        """The files of a run, with their sizes, from a listing: no content is read."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        return found.select(F.lit(run).alias("run"), F.lit(tier).alias("tier"), "path", F.col("length").alias("bytes"))

    def run_of(self, run: str, tier: int, folder: str, schema: StructType | None = None) -> DataFrame:
        columns = F.lit((schema or self.spark.read.parquet(folder).schema).json())
        return self.shards_of(run, tier, folder).groupBy("run", "tier").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files")).withColumn("columns", columns)

    def schema_of(self, runs: list) -> StructType:
        """All columns of runs, as their manifest says; of runs without that, as their files say."""
        return all_columns([StructType.fromJson(json.loads(r.columns)) if r.columns else self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/runs/{r.run}").schema for r in runs])

    def stage(self, df: DataFrame, arrival: Column | None = None) -> list[tuple[str, str]]:
        """Writes one run, or one for each value of arrival, in one pass; returns (run, folder). They count only once committed."""
        all_columns([self.schema_of(self.stored().orderBy("run").collect()), df.schema])
        name = uuid.uuid4().hex
        folder, part = f"{self.root}/runs/{name}", f"_arrival_{name}"
        writer = (df if arrival is None else df.withColumn(part, arrival)).write.option("compression", "zstd")
        if arrival is None:
            writer.parquet(folder)
            return [(name, folder)]
        writer.partitionBy(part).parquet(folder)
        parts = sorted(s.getPath().getName() for s in self.files.util().listStatus(self.path(folder)) if s.getPath().getName().startswith(f"{part}="))
        return [(f"{name}/{p}", f"{folder}/{p}") for p in parts]

    def append(self, df: DataFrame) -> int:
        """One arrival: its shards are written, then committed beside those of the current version."""
        version = self.version()
        (run, folder), = self.stage(df)
        return self.add(run, folder, version, df.schema)

    def add(self, run: str, folder: str, version: int | None = None, schema: StructType | None = None) -> int:
        version = self.version() if version is None else version
        return self.commit(self.stored(version).unionByName(self.run_of(run, 0, folder, schema)), version + 1)

    def runs(self) -> list[tuple[str, int, int]]:
        """(run, tier, bytes) of the current version; compaction keeps their number to a few for each tier."""
        return [tuple(r) for r in self.stored().select("run", "tier", "bytes").collect()]

    def similar(self) -> list[tuple[str, int, int]]:
        """The smallest fan_in runs or more whose sizes lie within spread of their mean; empty if there are none."""
        group: list[tuple[str, int, int]] = []
        for run in sorted(self.runs(), key=lambda r: (r[2], r[0])):
            mean = sum(r[2] for r in group) / len(group) if group else 0
            if group and run[2] > mean * (1 + self.tiers.spread):
                if len(group) >= self.tiers.fan_in:
                    return group
                group = []
            group.append(run)
        return group if len(group) >= self.tiers.fan_in else []

    def merge(self, group: list[tuple[str, int, int]]) -> int:
        """Rewrites runs as one of target-sized files and commits a version with it in their place."""
        version = self.version()
        now = self.stored(version)
        gone = [r[0] for r in group]
        scan = self.spark.newSession()
        scan.conf.set("spark.sql.files.maxPartitionBytes", str(self.tiers.target_bytes))
        scan.conf.set("spark.sql.files.openCostInBytes", "0")
        scan.conf.set("spark.sql.files.minPartitionNum", "1")
        name = uuid.uuid4().hex
        folder = f"{self.root}/runs/{name}"
        schema = self.schema_of(now.filter(F.col("run").isin(gone)).orderBy("run").collect())
        scan.read.schema(schema).parquet(*[f"{self.root}/runs/{run}" for run in gone]).write.option("compression", "zstd").parquet(folder)
        merged = self.run_of(name, max(r[1] for r in group) + 1, folder, schema)
        return self.commit(now.filter(~F.col("run").isin(gone)).unionByName(merged), version + 1)

    def compact(self) -> int:
        """Merges until no fan_in runs are of similar size; returns the version."""
        while group := self.similar():
            self.merge(group)
        return self.version()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with shard (file name), its bytes, run and tier: said by each file's own path, so nothing is joined."""
        found = self.stored(version).orderBy("run").collect()
        runs = {r.run: r.tier for r in found}
        if not runs:
            raise ValueError("the store has no shards")
        rows = self.spark.read.schema(self.schema_of(found)).parquet(*[f"{self.root}/runs/{run}" for run in runs])
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/(.*)$", 1)
        tiers = F.create_map(*[F.lit(x) for pair in runs.items() for x in pair])
        run = F.regexp_extract("shard", r"^(.*)/[^/]*$", 1)
        rows = rows.select(*rows.columns, name.alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))
        return rows.withColumn("run", run).withColumn("tier", F.element_at(tiers, F.col("run")))

    def vacuum(self) -> int:
        """Deletes runs that the current version doesn't name; returns how many. Only for when no reader uses an older version."""
        used = {r[0] for r in self.runs()}
        folder = self.path(f"{self.root}/runs")
        gone = 0
        for s in self.files.util().listStatus(folder):
            name = s.getPath().getName()
            if not any(u == name or u.startswith(f"{name}/") for u in used):
                gone += bool(self.files.delete(s.getPath(), True))
        return gone


def compacted(docs: DataFrame, root: str, arrivals: int = 8, tiers: Tiers | None = None) -> tuple[ShardStore, DataFrame]:
    """Takes docs in as arrivals (by hash of doc_id), a version each, compacting whenever runs of similar size have come together."""
    store = ShardStore(docs.sparkSession, root, tiers)
    schema = docs.schema
    for run, folder in store.stage(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int")):
        store.add(run, folder, schema=schema)
        store.compact()
    return store, store.read() if store.version() else docs.limit(0)


def sharding(docs: DataFrame, root: str, arrivals: int = 8, tiers: Tiers | None = None) -> DataFrame:
    """Per row of docs, read back from the compacted store: doc_id, n_bytes and text_sha256 of its text, shard, shard_bytes, run, tier, version.

    All columns of docs are stored; null texts stay null. Rows with a null doc_id arrive like any other; repeated rows are kept. Columns
    of docs named like the store's own (shard, run, tier, shard_bytes) are set aside under a prefix. Empty tables give empty results.
    """
    own = {"shard", "run", "tier", "shard_bytes"}
    safe = docs.select(*[F.col(f"`{c}`").alias(f"given_{c}" if c in own else c) for c in docs.columns])
    store, rows = compacted(safe, root, arrivals, tiers)
    version = store.version()
    if not version:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit("").alias("text_sha256"), F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit("").alias("run"), F.lit(0).alias("tier"), F.lit(0).alias("version"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "shard", "shard_bytes", "run", "tier", F.lit(version).alias("version"))
