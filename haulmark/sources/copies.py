"""Table copies that can be interrupted: the source is cut into ranges of its key, which are copied in order, each as one version with its mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.sources.versions import TableStore

PLAN = "name string, part int, low string, high string"
DONE = "name string, part int, rows long"


def planned(store: TableStore, name: str, source: DataFrame, key: str, parts: int) -> list[tuple[int, str | None, str | None]]:
    """The ranges of a copy, from quantiles of the key that Spark estimates in one pass; the plan is stored, so that a copy goes on with the same ones."""
    if not store.has("copy_plan"):
        t = store.begin()
        t.append("copy_plan", store.spark.createDataFrame([], PLAN))
        t.append("copy_done", store.spark.createDataFrame([], DONE))
        t.commit()
    found = store.read("copy_plan").filter(F.col("name") == name).orderBy("part").collect()
    if not found:
        kind = source.schema[key].dataType.simpleString()
        shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
        cuts = source.agg(F.percentile_approx(key, shares, 10_000).cast("array<string>").alias("q")).first().q or [] if parts > 1 and kind != "string" else []
        if kind == "string":  # strings have no quantiles: those of a bounded sample, the rows of least hash
            sample = source.select(F.col(key).alias("k")).orderBy(F.xxhash64("k"), "k").limit(1000).orderBy("k").collect()
            cuts = [sample[len(sample) * k // parts].k for k in range(1, parts)] if sample else []
        cuts = list(dict.fromkeys(c for c in cuts if c is not None))
        t = store.begin()
        t.append("copy_plan", store.spark.createDataFrame([(name, k, lo, hi) for k, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))], PLAN))
        t.commit()
        found = store.read("copy_plan").filter(F.col("name") == name).orderBy("part").collect()
    return [(r.part, r.low, r.high) for r in found]


def copy_ranges(store: TableStore, name: str, source: DataFrame, key: str, parts: int = 8) -> int:
    """Copies a table in order of its key, or goes on with a copy; the rows copied now. Each range is read by as many tasks as its files have
    splits, with the range pushed to the scan. Rows without a key belong to the first range. Repeated rows are copied each."""
    kind = source.schema[key].dataType.simpleString()
    total = 0
    for part, low, high in planned(store, name, source, key, parts):
        if not store.read("copy_done").filter((F.col("name") == name) & (F.col("part") == part)).isEmpty():
            continue
        k = F.col(key)
        inside = F.lit(True) if low is None else k >= F.lit(low).cast(kind)
        inside = inside if high is None else inside & ((k < F.lit(high).cast(kind)) | (k.isNull() if low is None else F.lit(False)))
        t = store.begin()
        n = t.append(name, source.filter(inside).repartitionByRange(key).sortWithinPartitions(key)).count()
        t.append("copy_done", store.spark.createDataFrame([(name, part, n)], DONE))
        t.commit()
        total += n
    return total
