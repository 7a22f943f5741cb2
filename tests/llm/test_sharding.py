"""The shard store: nothing is lost, versions are atomic, sizes are tiered."""

import hashlib
from collections import Counter

import pytest

from haulmark.llm.sharding import Conflict, ShardStore, Tiers, sharding

SCHEMA = "doc_id long, text string, shard string, tier int"


def test_whole_table(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 50), "x", i) for i in range(500)] + [(3, "again", "y", 1), (3, "again", "y", 1), (None, "no id", None, None), (501, None, "n", 0), (502, "", "n", 0)]
    got = sharding(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/s", arrivals=9).collect()
    want = Counter((i, None if t is None else len(t.encode()), None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.text_sha256) for r in got) == want
    assert {r.version for r in got} == {9 + 2} and max(r.tier for r in got) > 0
    assert sharding(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e").collect() == []


def test_versions(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/v", Tiers(fan_in=3, target_bytes=1 << 20))
    df = lambda a: spark.range(a * 1000, a * 1000 + 1000).withColumnRenamed("id", "doc_id").repartition(4)
    assert store.version() == 0 and store.manifest().count() == 0
    for a in range(3):
        assert store.append(df(a)) == a + 1
    before = store.read().count()
    assert store.compact() == 4 and before == store.read().count() == 3000
    assert [r[1] for r in store.runs()] == [1] and store.manifest().count() == 1
    assert store.read(2).count() == 2000  # older versions stay readable
    with pytest.raises(Conflict):
        store.commit(store.manifest(1), 4)
    assert store.version() == 4 and store.read().count() == 3000
    assert store.vacuum() == 3 and store.read().count() == 3000
    big = ShardStore(spark, f"file://{tmp_path}/t", Tiers(fan_in=2, target_bytes=4096))
    for a in range(2):
        big.append(df(a))
    big.compact()
    assert big.manifest().count() > 1 and big.read().count() == 2000


def test_runs_of_different_columns(spark, tmp_path):
    """A column that comes later is there for all rows, also after a merge and after the older runs are gone."""
    store = ShardStore(spark, f"file://{tmp_path}/c", Tiers(fan_in=2, spread=9))
    store.append(spark.createDataFrame([(1,)], "doc_id long"))
    store.append(spark.createDataFrame([(2, "en", "a")], "doc_id long, lang string, _arrival string"))
    want = [(1, None, None), (2, "en", "a")]
    rows = lambda: sorted((r.doc_id, r.lang, r._arrival) for r in store.read().collect())
    assert rows() == want
    store.compact()
    assert len(store.runs()) == 1 and rows() == want
    assert store.vacuum() == 2 and rows() == want
    store.append(spark.createDataFrame([("x", 3)], "more string, doc_id long"))
    assert rows() == [*want, (3, None, None)]
    with pytest.raises(ValueError, match="lang"):
        store.append(spark.createDataFrame([(4, 5)], "doc_id long, lang int"))
    assert rows() == [*want, (3, None, None)]


def test_very_long_text(spark, tmp_path):
    rows = [(1, "é" * 2_000_000), (2, "short")]
    got = {r.doc_id: (r.n_bytes, r.text_sha256) for r in sharding(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/l").collect()}
    assert got == {i: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
