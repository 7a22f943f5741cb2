"""Approvals: an alarm that is stored twice is replaced by one row."""

from pyspark.sql import functions as F

from haulmark.operators.approvals import approve, create_reviews
from haulmark.sources.versions import TableStore


def test_an_alarm_that_is_stored_twice_is_replaced_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    raw = spark.createDataFrame([("g1", "acme", "D1", "live", "stored"), ("g1", "acme", "D1", "mock", "stored"), ("g2", "acme", "D2", "live", "stored")], "guid string, company_slug string, device_id string, source string, ingest_result string")
    reviews = spark.createDataFrame([("k1", "g1", "acme", "D1", True), ("k3", "g3", "acme", "D3", True), ("k4", "g2", "gamma", "D2", True)], "review_key string, guid string, company_slug string, device_id string, dms boolean").selectExpr("*", "'pending' as review_status", "cast(null as string) as decided_by", "cast(null as timestamp) as applied_at")
    create_reviews(store, raw, raw.drop("ingest_result"), reviews)
    now = F.lit("2024-01-31").cast("timestamp")
    assert approve(store, F.col("company_slug") != "gamma", "op", now) == 2 and approve(store, F.col("company_slug") != "gamma", "op", now) == 0
    assert sorted(map(tuple, store.read("events").select("guid", "source").collect())) == [("g1", "portal"), ("g2", "live"), ("g3", "portal")]
    assert sorted(map(tuple, store.read("raw").select("guid", "ingest_result").collect())) == [("g1", "updated_alarm_event"), ("g2", "stored"), ("g3", "inserted_alarm_event")]
