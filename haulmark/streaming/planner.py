"""What a catch-up job reads next: pure functions of times, so that a job can be replayed and tested without a clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta


@dataclass(frozen=True)
class Limits:
    overlap: timedelta = timedelta(minutes=10)
    stale: timedelta = timedelta(minutes=90)
    bootstrap: timedelta = timedelta(hours=6)
    window: timedelta = timedelta(minutes=20)

    def narrowed(self, refusals: int) -> timedelta:
        """The window after refusals for reading too fast: halved each time, three times at most, but never under the overlap."""
        least = max(self.overlap, timedelta(minutes=10))
        return self.window if refusals <= 0 else max(self.window / 2 ** min(refusals, 3), least)


@dataclass(frozen=True)
class Progress:
    """done_until: the cursor. pending: a range that was begun, and how many devices of it are done. retry_at: not before."""

    done_until: datetime | None = None
    pending: tuple[datetime, datetime] | None = None
    devices_done: int = 0
    retry_at: datetime | None = None


def next_range(now: datetime, progress: Progress, limits: Limits, refusals: int = 0, force: bool = False) -> tuple[datetime, datetime, int] | None:
    """(start, end, devices to skip) of the next read, or None if there is nothing to read yet."""
    if progress.retry_at is not None and now < progress.retry_at:
        return None
    window = limits.narrowed(refusals)
    if progress.pending is not None:
        start, end = progress.pending
        return start, min(end, start + window), max(progress.devices_done, 0)
    if progress.done_until is None:
        start = now - limits.bootstrap
    else:
        start = progress.done_until - limits.overlap
        behind = force or now - progress.done_until >= limits.stale
        if not behind:  # near the present, the recent window is read again so that gaps close before the cursor is stale
            start = max(start, now - window)
            return (start, now, 0) if start < now else None
    end = min(now, start + window)
    return (start, end, 0) if start < end else None


def backoff(attempt: int, base: timedelta = timedelta(seconds=5), most: timedelta = timedelta(minutes=5)) -> timedelta:
    """Doubles with each attempt from 0, up to most."""
    return min(base * 2**attempt, most)


def due_cuts(last: datetime | None, now: datetime, minutes: int = 15, lag: timedelta = timedelta(seconds=45), most: int = 4) -> list[datetime]:
    """Cuts that are due and not done, oldest first, at most so many in one go; without a last one, the latest."""
    step = timedelta(minutes=minutes)
    epoch = datetime(1970, 1, 1, tzinfo=now.tzinfo)
    latest = epoch + (now - lag - epoch) // step * step
    first = latest if last is None else last + step
    return [first + k * step for k in range(min(most, max(0, (latest - first) // step + 1)))]
