"""The original API's record shapes, built from the long results.

Each function takes the long DataFrame a query returns and gives one row
in the nested shape the original service answered with, e.g. Q5's
``{morning: [{station, flow_in, flow_out}], evening: [...]}``. The lists are
``sort_array(collect_list(struct))`` over a query *result* - bounded by
stations, sections or days, never by trips - so they are meant for
serving answers, not for intermediate data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _list_where(cond: Column, fields: Sequence[str]) -> Column:
    """Sorted list of structs of the rows where ``cond`` holds (empty if none)."""
    items = F.collect_list(F.when(cond, F.struct(*[F.col(f) for f in fields])))
    return F.sort_array(items)


def split_lists(df: DataFrame, by: str, labels: dict[str, str], fields: Sequence[str],
                keys: Sequence[str] = ()) -> DataFrame:
    """One row (per ``keys``) with a list column per value of ``by``.

    ``labels`` maps output column -> value of ``by``; ``fields`` are the
    struct fields of each list element, in order (the first one sorts).
    """
    lists = [_list_where(F.col(by) == v, fields).alias(out) for out, v in labels.items()]
    return df.groupBy(*keys).agg(*lists)


def station_series(df: DataFrame) -> DataFrame:
    """Q3 / Q11: (station, direction, time, flow) -> station, flow_in[{time, flow}], flow_out[...]."""
    return split_lists(df, "direction", {"flow_in": "in", "flow_out": "out"}, ["time", "flow"], ["station"])


def age_lists(df: DataFrame) -> DataFrame:
    """Q4: (sex, bin, n) -> male[10 counts], female[10 counts] in bin order."""
    out = split_lists(df, "sex", {"male": "male", "female": "female"}, ["bin", "n"])
    return out.select(*[F.transform(c, lambda x: x["n"]).alias(c) for c in ("male", "female")])


def peak_lists(df: DataFrame) -> DataFrame:
    """Q5 / Q13: (period, station, flow_in, flow_out) -> morning[...], evening[...]."""
    return split_lists(df, "period", {"morning": "morning", "evening": "evening"},
                       ["station", "flow_in", "flow_out"])


def section_lists(df: DataFrame) -> DataFrame:
    """Q8 / Q12: (direction, section_id, source, target, flow) -> up[{source, target, flow}], down[...]
    in section order."""
    out = split_lists(df, "direction", {"up": "up", "down": "down"},
                      ["section_id", "source", "target", "flow"])
    keep = lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"),
                              x["flow"].alias("flow"))
    return out.select(*[F.transform(c, keep).alias(c) for c in ("up", "down")])
