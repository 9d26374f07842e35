"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def regular_grid(readings: DataFrame, keys: list[str], step: str, values: list[str] = [], fill_within: int = 5, start: Column | None = None, end: Column | None = None) -> DataFrame:  # noqa: B006
    """One row for every grid point `step` (an integer) of each series, from its first to its last reading.

    readings: one row per series and step at most (pre-aggregate repeats before). lead pairs each reading with the
    next, and only the points between the two are made. `state` says what a row is: 'recorded'; 'interpolated' in a
    gap of up to `fill_within` points (values linear in the step); 'missing' in a longer gap (values null).
    start, end: boundaries to which each series is extended, as expressions over the keys' rows; points there are
    'missing'. A null value in a reading isn't interpolated from or to: the result is null. Rows with a null step
    are left out; an empty table gives no rows. A series is as long as its grid, so a window over it is bounded.
    """
    w = W.partitionBy(*keys).orderBy(step)
    at = readings.where(F.col(step).isNotNull()).withColumn("_next", F.lead(step).over(w))
    for v in values:
        at = at.withColumn(f"_n_{v}", F.lead(v).over(w))
    upto = F.coalesce(F.col("_next") - 1, F.col(step))
    if end is not None:
        upto = F.when(F.col("_next").isNull(), F.greatest(end, F.col(step))).otherwise(upto)
    since = F.col(step)
    if start is not None:
        since = F.when(F.row_number().over(w) == 1, F.least(start, F.col(step))).otherwise(since)
    at = at.withColumn("_since", since).withColumn("_upto", upto)
    out = at.withColumn("_g", F.explode(F.sequence("_since", "_upto")))
    own, gap = F.col("_g") == F.col(step), F.col("_next") - F.col(step) - 1
    inner = (F.col("_g") > F.col(step)) & F.col("_next").isNotNull() & (gap <= fill_within)
    share = (F.col("_g") - F.col(step)) / (F.col("_next") - F.col(step))
    filled = [F.when(own, F.col(v)).when(inner, F.col(v) + (F.col(f"_n_{v}") - F.col(v)) * share).alias(v) for v in values]
    return out.select(*keys, F.col("_g").alias(step), *filled, F.when(own, "recorded").when(inner, "interpolated").otherwise("missing").alias("state"))
