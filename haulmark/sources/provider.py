"""The provider's alarm history as a Python data source: device and time go to the source.

The transport is landed: a folder of Parquet files per device (device_id=<id>/...), a partition or more each, or, where devices are many, folders
of many devices (part=<crc32 of the device % parts>/..., the device a column). Folders that a filter excludes are never opened, and
devices and times are filtered where files are read, row group by row group. Whatever else a query asks for, Spark filters itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote, unquote
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of files that a task reads.
PART_BYTES = 64 << 20
SCHEMA = "guid string, device_id string, category string, tp string, occurred_at timestamp, value double"


class DevicePartition(InputPartition):
    def __init__(self, device: str | None, files: list[str]):
        super().__init__(None)
        self.device, self.files = device, files  # no device: a folder of many


class HistoryReader(DataSourceReader):
    def __init__(self, path: str, parts: int = 0):
        self.path, self.parts, self.devices, self.times = path, parts, None, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on the device and on the time; others go back to Spark."""
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("device_id",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.devices = wanted if self.devices is None else self.devices & wanted
            elif column == ("occurred_at",) and type(f) in signs:
                self.times.append(("occurred_at", signs[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files of the devices that are asked for: only their folders are listed. A device with many files is many partitions, of some size each."""
        import pyarrow.fs as pafs

        system, root = pafs.FileSystem.from_uri(self.path)
        if self.devices is None:
            folders = [root]
        elif self.parts:
            folders = sorted({f"{root}/part={crc32(str(d).encode()) % self.parts}" for d in self.devices})
        else:
            folders = [f"{root}/device_id={quote(str(d), safe=' ')}" for d in sorted(self.devices)]
        kind = "part=" if self.parts else "device_id="
        found: dict[str, list] = {}
        for folder in folders:
            for item in system.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)):
                name = item.path.rsplit("/", 2)[-2]
                if item.is_file and item.base_name.endswith(".parquet") and name.startswith(kind):
                    found.setdefault(unquote(name[len(kind) :]), []).append(item)
        out = []
        for device, items in sorted(found.items()):
            device = None if self.parts else device
            part, size = [], 0
            for item in sorted(items, key=lambda i: i.path):
                if part and size + item.size > PART_BYTES:
                    out.append(DevicePartition(device, part))
                    part, size = [], 0
                part, size = [*part, item.path], size + item.size
            out.append(DevicePartition(device, part))
        return out

    def read(self, partition: InputPartition):
        import pyarrow as pa
        import pyarrow.dataset as pads
        import pyarrow.fs as pafs

        if partition is None:  # Spark reads one empty partition where there are none
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        files = pads.dataset(partition.files, filesystem=system, format="parquet")
        keep = None
        for name, sign, value in self.times:
            at = pa.scalar(value if isinstance(value, datetime) else datetime.fromisoformat(str(value)), files.schema.field(name).type)
            f = pads.field(name)
            test = {">": f > at, ">=": f >= at, "<": f < at, "<=": f <= at}[sign]
            keep = test if keep is None else keep & test
        columns = ["guid", "category", "tp", "occurred_at", "value"]
        if partition.device is None:
            columns.append("device_id")
            if self.devices is not None:
                asked = pads.field("device_id").isin(sorted(map(str, self.devices)))
                keep = asked if keep is None else keep & asked
        for batch in files.to_batches(columns=columns, filter=keep):
            if batch.num_rows:
                device = pa.array([partition.device] * batch.num_rows) if partition.device is not None else batch.column("device_id")
                stamp = batch.column("occurred_at").cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([batch.column("guid"), device, batch.column("category"), batch.column("tp"), stamp, batch.column("value")], names=["guid", "device_id", "category", "tp", "occurred_at", "value"])


class ProviderHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader(self.options["path"], int(self.options.get("parts", 0)))


def land_history(rows: DataFrame, path: str, parts: int) -> None:
    """Lands rows in folders of many devices: as many folders as parts, however many devices there are; files grow in number with the rows."""
    part = F.crc32(F.col("device_id").cast("binary")) % parts
    rows = rows.withColumn("part", part).hint("rebalance", F.col("part"))
    rows.sortWithinPartitions("part", "device_id", "occurred_at").write.partitionBy("part").parquet(path)


def history(spark: SparkSession, path: str, parts: int = 0) -> DataFrame:
    """Landed alarm history below path (a URI); an empty folder gives no rows. parts: those of land_history; 0 for a folder a device.

    Spark hands filters to Python sources only where spark.sql.python.filterPushdown.enabled is set when the query is planned, so this turns it on
    for the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderHistory)
    return spark.read.format("provider_history").option("path", path).option("parts", parts).load()
