"""Copies that go on, and deliveries that don't repeat."""

import os
from pathlib import Path

import pytest
from pyspark.sql import Row

from haulmark.sources.copies import copy_ranges, planned
from haulmark.sources.push import PushWriter, delivered
from haulmark.sources.versions import TableStore


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_copy_goes_on(spark, tmp_path, kind):
    source = spark.range(200).selectExpr(f"cast({'date_add(date\"2024-01-01\", cast(id as int))' if kind == 'date' else 'id'} as {kind}) as k", "id as v").union(spark.sql(f"select cast(null as {kind}), 7L union all select cast(null as {kind}), 8L"))
    store = TableStore(spark, str(tmp_path))
    real, calls = store.publish, []

    def breaking(manifest, version):
        calls.append(version)
        if len(calls) == 5:
            raise OSError("gone")
        return real(manifest, version)

    store.publish = breaking
    with pytest.raises(OSError):
        copy_ranges(store, "t", source, "k", 6)
    held = store.read("t").count()
    assert 0 < held < 202
    files = {p: os.stat(p).st_mtime_ns for p in Path(tmp_path, "data", "t").rglob("*.parquet")}
    plan = planned(store, "t", source, "k", 6)
    assert copy_ranges(store, "t", source, "k", 6) == 202 - held
    assert planned(store, "t", source, "k", 6) == plan and len(plan) > 3
    assert sorted(r.v for r in store.read("t").collect()) == sorted([*range(200), 7, 8])
    assert all(os.stat(p).st_mtime_ns == t for p, t in files.items())
    assert copy_ranges(store, "t", source, "k", 6) == 0


def test_empty_copy(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert copy_ranges(store, "t", spark.range(0).withColumnRenamed("id", "k"), "k") == 0 and store.read("t").count() == 0


def test_a_batch_is_delivered_once(spark, tmp_path):
    writer = PushWriter(f"file://{tmp_path}")
    rows = [Row(subscriber="a/b", topic="acme", payload="1"), Row(subscriber="c", topic="acme", payload="1")]
    lost = writer.write(rows)  # the driver dies before it commits
    writer.commit([writer.write(rows[:1]), writer.write(rows[1:]), None], 0)
    writer.commit([writer.write([Row(subscriber="a/b", topic="acme", payload="other")])], 0)
    writer.commit([writer.write([Row(subscriber="c", topic="acme", payload="2")])], 1)
    got = sorted((r.subscriber, r.topic, r.payload, r.batch) for r in delivered(spark, f"{tmp_path}").collect())
    assert got == [("a/b", "acme", "1", 0), ("c", "acme", "1", 0), ("c", "acme", "2", 1)]
    writer.abort([lost], 0)
    assert not list(Path(tmp_path, "_staged").iterdir())
