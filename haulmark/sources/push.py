"""A sink that delivers messages to subscribers, once each: a file a message in the subscriber's box, named by the micro-batch and the topic.

    <path>/_staged/<id>                          what a task has written; counts for nothing
    <path>/subscriber=<name>/<batch>-<topic>.json  delivered
    <path>/_done/<batch>                         the micro-batch has been delivered whole

Tasks stage their messages and tell the driver where they are; its commit moves them to names that depend on the micro-batch alone. So a batch that is
done again, after whatever failure, puts the same files in the same places, and one that was delivered whole does nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

SCHEMA = "subscriber string, topic string, payload string"


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str, str]]  # subscriber, topic, staged file


class PushWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def files(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator) -> Staged:
        system, root = self.files()
        system.create_dir(f"{root}/_staged", recursive=True)
        out = []
        for row in iterator:
            staged = f"{root}/_staged/{uuid.uuid4().hex}"
            with system.open_output_stream(staged) as f:
                f.write(json.dumps({"type": "snapshot", "subscriber": row.subscriber, "topic": row.topic, "payload": row.payload}).encode())
            out.append((row.subscriber, row.topic, staged))
        return Staged(out)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        import pyarrow.fs as pafs

        system, root = self.files()
        done = f"{root}/_done/{batchId:08d}"
        delivered = system.get_file_info(done).type != pafs.FileType.NotFound
        for subscriber, topic, staged in (f for m in messages if m for f in m.files):
            if delivered:
                system.delete_file(staged)
                continue
            box = f"{root}/subscriber={quote(subscriber, safe='')}"
            system.create_dir(box, recursive=True)
            system.move(staged, f"{box}/{batchId:08d}-{quote(topic, safe='')}.json")
        if not delivered:
            system.create_dir(done, recursive=True)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        system, _ = self.files()
        for _, _, staged in (f for m in messages if m for f in m.files):
            system.delete_file(staged)


class SnapshotPush(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot_push"

    def schema(self) -> str:
        return SCHEMA

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:
        return PushWriter(self.options["path"])


def uri(path: str) -> str:
    return path if ":/" in path else f"file://{path}"


def push(snapshots: DataFrame, subscriptions: DataFrame, path: str, checkpoint: str) -> None:
    """Delivers a stream of (topic, payload) to each of the topic's subscribers (subscriber, topic), works off what is there and ends.

    A micro-batch has one payload a topic: the last one to come in would stand for it.
    """
    snapshots.sparkSession.dataSource.register(SnapshotPush)
    rows = snapshots.join(subscriptions, "topic").select("subscriber", "topic", "payload")
    rows.writeStream.format("snapshot_push").option("path", uri(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """What stands in the boxes: subscriber, topic, payload and batch."""
    from pyspark.sql import functions as F

    files = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return files.withColumn("batch", F.regexp_extract("_metadata.file_name", r"^(\d+)-", 1).cast("long"))
