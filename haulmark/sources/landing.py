"""The provider's landed replies as a streaming source: cuts are offsets, replies are lines.

    <path>/_cuts/<cut>/...                     a cut that is complete
    <path>/cut=<cut>/*                         the replies of any devices, one a line: the device's id, a tab, the reply
    <path>/cut=<cut>/device_id=<id>/*          the replies of a device, one a line
    <path>/_taken/<cut>                        written when a cut has been committed

Offsets name the last complete cut, so a micro-batch that is done again reads the same files. Only the folders of the cuts of a micro-batch are
listed. Large files are read in ranges of lines, small ones several a task: one device's replies may take many tasks. Files of many devices are
as many as the tasks that wrote them; folders of single devices are for few devices, as each costs files of its own.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "cut string, device_id string, body string"
#: Bytes of a task, and lines of a batch.
TASK_BYTES, LINES = 32 << 20, 4096


class Ranges(InputPartition):
    """Byte ranges (cut, device or None for files of many, file, start, end) that a task reads the lines of: those that start inside."""

    def __init__(self, ranges: list[tuple[str, str | None, str, int, int]]):
        super().__init__(None)
        self.ranges = ranges


class LandingReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def files(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.path)

    def cuts(self) -> list[str]:
        import pyarrow.fs as pafs

        system, root = self.files()
        return sorted(i.base_name for i in system.get_file_info(pafs.FileSelector(f"{root}/_cuts", allow_not_found=True)))

    def initialOffset(self) -> dict:
        return {"cut": ""}

    def latestOffset(self) -> dict:
        return {"cut": max(self.cuts(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        import pyarrow.fs as pafs

        system, root = self.files()
        out: list[list[tuple[str, str | None, str, int, int]]] = [[]]
        room = TASK_BYTES
        for cut in (c for c in self.cuts() if start["cut"] < c <= end["cut"]):
            for item in sorted(system.get_file_info(pafs.FileSelector(f"{root}/cut={cut}", recursive=True, allow_not_found=True)), key=lambda i: i.path):
                folder = item.path.rsplit("/", 2)[-2]
                many = folder == f"cut={cut}"
                if not item.is_file or not (many or folder.startswith("device_id=")) or item.base_name[0] in "_.":
                    continue
                for a in range(0, item.size, TASK_BYTES):
                    b = min(item.size, a + TASK_BYTES)
                    if out[-1] and b - a > room:
                        out.append([])
                        room = TASK_BYTES
                    out[-1].append((cut, None if many else folder[10:], item.path, a, b))
                    room -= b - a
        return [Ranges(r) for r in out if r]

    def lines(self, system, file: str, start: int, end: int) -> Iterator[str]:
        with system.open_input_file(file) as opened:
            f = io.BufferedReader(opened)
            if start:
                f.seek(start - 1)
                f.readline()  # the line that began before
            while f.tell() < end:
                line = f.readline()
                if not line:
                    return
                yield line.decode("utf-8", "replace").rstrip("\r\n")

    def read(self, partition: InputPartition):
        import pyarrow as pa

        if partition is None:
            return
        system, _ = self.files()
        for cut, device, file, a, b in partition.ranges:
            some: list[str] = []
            for line in self.lines(system, file, a, b):
                some.append(line)
                if len(some) == LINES:
                    yield self.batch(pa, cut, device, some)
                    some = []
            if some:
                yield self.batch(pa, cut, device, some)

    def batch(self, pa, cut: str, device: str | None, lines: list[str]):
        devices = [device] * len(lines)
        if device is None:
            parts = [line.partition("\t") for line in lines]
            devices, lines = [p[0] for p in parts], [p[2] for p in parts]
        return pa.RecordBatch.from_arrays([pa.array([cut] * len(lines)), pa.array(devices), pa.array(lines)], names=["cut", "device_id", "body"])

    def commit(self, end: dict) -> None:
        if end["cut"]:
            system, root = self.files()
            system.create_dir(f"{root}/_taken/{end['cut']}", recursive=True)


class ProviderLanding(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_landing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LandingReader(self.options["path"])


def landed_replies(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the replies below path (a folder or a URI): cut, device_id, body."""
    spark.dataSource.register(ProviderLanding)
    return spark.readStream.format("provider_landing").option("path", path if ":/" in path else f"file://{path}").load()
