"""Joins by nearness in time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, seconds: int, left_id: str, *ties: Column) -> DataFrame:
    """Each left row with the right row of equal keys that is nearest in time, within seconds on either side; left rows without one are left out.

    Time falls into buckets as wide as the tolerance and a left row looks into three, so the join is an equi-join whose groups stay small
    even if one key holds much of the data.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    looks = left.withColumn("_b", F.explode(F.array(*[bucket(F.col(left_ts)) + k for k in (-1, 0, 1)])))
    both = looks.join(right.withColumn("_b", bucket(F.col(right_ts))), [*keys, "_b"])
    delta = F.abs(F.unix_micros(F.col(left_ts)) - F.unix_micros(F.col(right_ts)))
    near = both.withColumn("_delta", delta).filter(F.col("_delta") <= seconds * 1_000_000)
    w = Window.partitionBy(left_id).orderBy("_delta", *ties)
    return near.withColumn("_n", F.row_number().over(w)).filter("_n = 1").withColumn("delta_seconds", F.col("_delta") / 1e6).drop("_n", "_b", "_delta")


def latest_unconsumed(sessions: DataFrame, keys: list[str], gap_minutes: int) -> DataFrame:
    """Backward as-of with consumption: each taking session takes the latest earlier giving one of its key that no other has taken.

    sessions: keys, session_id, kind ('give' or 'take'), start_at, end_at. A given session must end before the taking one starts, by gap_minutes
    at most. Sequential only within a stretch: a key is cut wherever no giving session has ended within gap_minutes before, so that none
    reaches across. Where a stretch has one giving session, the first taking one gets it, by an aggregate; only stretches in which several compete
    are folded each by itself, and those are dealt over all shuffle partitions, since calls cost more than their bytes tell.
    """
    gap = pd.Timedelta(minutes=gap_minutes)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_at", "session_id"])
        given: list[tuple] = []
        out = []
        for row in rows.itertuples():
            if row.kind == "give":
                given.append((row.end_at, row.session_id))
                continue
            given = [x for x in given if row.start_at - x[0] <= gap]  # later sessions start later still
            for i in range(len(given) - 1, -1, -1):
                end_at, session_id = given[i]
                if end_at < row.start_at:
                    out.append((*[getattr(row, k) for k in keys], row.session_id, session_id))
                    del given[i]
                    break
        return pd.DataFrame(out, columns=[*keys, "taker", "given"])

    types = dict(sessions.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"taker {types['session_id']}", f"given {types['session_id']}"])
    give = F.col("kind") == "give"
    w = Window.partitionBy(*keys).orderBy("_point", "session_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = sessions.filter(F.col("start_at").isNotNull() & (~give | F.col("end_at").isNotNull())).withColumn("_point", F.when(give, F.col("end_at")).otherwise(F.col("start_at")))
    near = F.unix_micros("_point") - F.unix_micros(F.max(F.when(give, F.col("end_at"))).over(w)) <= gap_minutes * 60_000_000
    rows = rows.withColumn("_near", F.coalesce(near, F.lit(False))).filter(give | F.col("_near"))
    # a giving session that no other reaches begins a stretch, and so names it
    begin = F.max(F.when(~F.col("_near"), F.struct("_point", "session_id"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_begin", begin)
    stretch = Window.partitionBy(*keys, "_begin")
    rows = rows.withColumns({"_gives": F.count_if(give).over(stretch), "_takes": F.count_if(~give).over(stretch), "_from": F.max(F.when(give, F.struct("start_at", "session_id"))).over(stretch)})
    rows = rows.filter("_takes > 0").drop("_point", "_near", "_takes")
    own = F.struct("start_at", "session_id")
    fit = rows.filter(~give & (F.col("_gives") == 1) & (F.col("start_at") > F.col("_begin._point")) & (own > F.col("_from")))
    alone = fit.groupBy(*keys, "_begin").agg(F.min(own).alias("_t")).select(*keys, F.col("_t.session_id").alias("taker"), F.col("_begin.session_id").alias("given"))
    compete = rows.filter("_gives > 1").drop("_gives", "_from").repartition(int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_begin")
    return alone.unionByName(compete.groupBy(*keys, "_begin").applyInPandas(fold, schema))
