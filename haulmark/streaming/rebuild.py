"""Rebuilding history in chunks of days: each chunk is a batch, and the job's progress is part of the version that the batch makes.

So a job that was stopped anywhere goes on after its last whole chunk, and no chunk is fetched or applied twice.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.operators.batches import apply_batch
from haulmark.sources.versions import TableStore, Transaction

JOBS = "job string, status string, phase string, first_day date, last_day date, days_total long, days_done long, rows_total long, inserted long, anomalies long, last_processed date, next_retry_at timestamp, error string"
FIELDS = [f.split()[0] for f in JOBS.split(",")]


class Deferred(Exception):
    """The provider wants to be asked again later."""

    def __init__(self, until: datetime):
        super().__init__(f"deferred until {until}")
        self.until = until


def record(t: Transaction, row: dict) -> None:
    """The job's row takes the place of the one before."""
    t.delete("rebuild_jobs", t.read("rebuild_jobs", places=True).filter(F.col("job") == row["job"]))
    t.append("rebuild_jobs", t.store.spark.createDataFrame([tuple(row[c] for c in FIELDS)], JOBS))


def job_row(store: TableStore, job: str) -> dict | None:
    found = store.read("rebuild_jobs").filter(F.col("job") == job).first() if store.has("rebuild_jobs") else None
    return found and found.asDict()


def noted(store: TableStore, row: dict) -> dict:
    t = store.begin()
    record(t, row)
    t.commit()
    return row


def rebuild(store: TableStore, job: str, fetch: Callable[[date, date], DataFrame], first: date, last: date, companies: DataFrame, chunk_days: int = 10, source: str = "harvest") -> dict:
    """Runs a job, or goes on with it; its row afterwards. fetch(lo, hi) gives the rows of some days as a batch brings them (ARRIVING).

    Where fetch raises Deferred the job is queued with the time to try again; another error marks it failed and is raised. Either way what
    was done stays done.
    """
    if not store.has("rebuild_jobs"):
        t = store.begin()
        t.append("rebuild_jobs", store.spark.createDataFrame([], JOBS))
        t.commit()
    days = (last - first).days + 1
    row = job_row(store, job) or dict.fromkeys(FIELDS) | {"job": job, "days_done": 0, "rows_total": 0, "inserted": 0, "anomalies": 0}
    if row["status"] == "succeeded":
        return row
    row |= {"status": "running", "phase": "fetching", "first_day": first, "last_day": last, "days_total": days, "next_retry_at": None, "error": None}
    lo = max(first, row["last_processed"] + timedelta(days=1)) if row["last_processed"] else first
    try:
        while lo <= last:
            hi = min(lo + timedelta(days=chunk_days - 1), last)

            def progress(t: Transaction, found: DataFrame, hi: date = hi) -> None:
                n = found.agg(F.count("*").alias("rows"), F.count_if(F.col("event") & F.col("_event").isNull()).alias("inserted"), F.count_if(F.col("temporal_status") != "accepted").alias("anomalies")).first()
                row.update(days_done=(hi - first).days + 1, rows_total=row["rows_total"] + n.rows, inserted=row["inserted"] + n.inserted, anomalies=row["anomalies"] + n.anomalies, last_processed=hi)
                record(t, row)

            before = dict(row)
            try:
                apply_batch(store, f"rebuild {job} {lo}", fetch(lo, hi), companies, source, progress)
            except Exception:
                row = before
                raise
            lo = hi + timedelta(days=1)
    except Deferred as e:
        return noted(store, row | {"status": "queued", "phase": "waiting_retry", "next_retry_at": e.until, "error": str(e)})
    except Exception as e:
        noted(store, row | {"status": "failed", "phase": "failed", "error": str(e)[:500]})
        raise
    return noted(store, row | {"status": "succeeded", "phase": "succeeded"})
