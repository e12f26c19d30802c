"""Date parameters and time predicates.

All bounds are parsed once on the driver into typed literals so Catalyst
can fold them and push the range down to the parquet scan:
``to_date(ts) BETWEEN lo AND hi`` becomes ``ts >= lo AND ts < hi + 1``.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's peak bands, inclusive on the hour
# (morning 07:00:00-08:59:59, evening 16:00:00-18:59:59).
PEAK_BANDS = {"morning": (7, 8), "evening": (16, 18)}
MOST_RUNS = 8             # ranges that a set of days is written as: more make slow code


def as_date(value) -> dt.date:
    """Accept a ``date``/``datetime`` or an ISO ``YYYY-MM-DD`` string."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value).strip())


def month_bounds(time_ym: str) -> tuple[dt.date, dt.date]:
    """``'YYYY-MM'`` -> first and last day of that month (H2)."""
    year, month = (int(p) for p in str(time_ym).strip().split("-")[:2])
    return dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])


def in_days(ts_col: str | Column, lo, hi) -> Column:
    """Inclusive calendar-day range on a timestamp column."""
    return F.to_date(ts_col).between(F.lit(as_date(lo)), F.lit(as_date(hi)))


def day_runs(days) -> list[tuple[dt.date, dt.date]]:
    """Days as the fewest (first, last) ranges."""
    runs: list[tuple[dt.date, dt.date]] = []
    for day in sorted({as_date(d) for d in days}):
        if runs and day - runs[-1][1] == dt.timedelta(days=1):
            runs[-1] = (runs[-1][0], day)
        else:
            runs.append((day, day))
    return runs


def _covering(runs: list[tuple[dt.date, dt.date]], most: int) -> list[tuple[dt.date, dt.date]]:
    """At most ``most`` ranges over all of ``runs``, joined where the gaps are smallest."""
    if len(runs) <= most:
        return runs
    widest = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1])[len(runs) - most:]
    cuts = [0, *sorted(widest), len(runs)]
    return [(runs[a][0], runs[b - 1][1]) for a, b in zip(cuts, cuts[1:])]


def on_days(column: Column, days) -> Column:
    """Whether a date expression is one of ``days``, as an OR of ranges, which
    (unlike a list of several dates) reaches the scan also for ``to_date(ts)``.
    Days in more than ``MOST_RUNS`` ranges are covered by that many, so that the
    expression does not grow deeper with them, and a list tells them apart."""
    runs = day_runs(days)
    cover = _covering(runs, MOST_RUNS)
    cond = F.lit(False)
    for i, (lo, hi) in enumerate(cover):
        run = column.between(F.lit(lo), F.lit(hi))
        cond = cond | run if i else run
    return cond if len(cover) == len(runs) else cond & column.isin(sorted({as_date(d) for d in days}))


def entered(trips, lo, hi) -> Column:
    """Entry-day range over a trip table (B1). A table partitioned by
    ``entry_day`` is also filtered on that column, so only its partitions of
    the range are listed and opened."""
    cond = in_days("time_in", lo, hi)
    if "entry_day" in trips.columns:
        cond = cond & F.col("entry_day").between(F.lit(as_date(lo)), F.lit(as_date(hi)))
    return cond


def in_hour_band(ts_col: str | Column, band: tuple[int, int]) -> Column:
    """Inclusive hour band."""
    return F.hour(ts_col).between(band[0], band[1])


def trailing_window(start, days: int) -> tuple[dt.date, dt.date]:
    """``[start - days, start - 1]``."""
    start = as_date(start)
    return start - dt.timedelta(days=days), start - dt.timedelta(days=1)


def forward_window(start, n: int) -> tuple[dt.date, dt.date]:
    """``[start, start + n - 1]``."""
    start = as_date(start)
    return start, start + dt.timedelta(days=n - 1)


def date_str(c: str | Column) -> Column:
    """Dates are emitted as ISO strings, as the reference's records are."""
    return F.date_format(c, "yyyy-MM-dd")
