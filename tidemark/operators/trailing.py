"""Rolling totals over trailing periods, from event-contribution deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def trailing_spans(daily: DataFrame, keys: list[str], day: str, values: list[str], windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Spans [since, upto] of days over which no trailing total changes, from the first to the last active day of a key.

    daily: any number of rows per key and day, values null or not. Each amount adds at its day and subtracts w days
    later; the deltas of a key and day are summed before they are shuffled, and a running sum over them gives the
    totals: n_w active days, sum_v_w and cnt_v_w of each value. Values are summed as decimals (6 places), so that
    what is subtracted leaves no residue. NaN and infinite amounts count as null. Rows with a null day are left out.
    """
    clean = [F.when(~F.isnan(v) & (F.abs(F.col(v)) < 1e18), F.col(v)).cast("decimal(30,6)").alias(v) for v in values]
    base = daily.where(F.col(day).isNotNull()).select(*keys, F.col(day).alias("_d"), *clean)
    per_day = base.groupBy(*keys, "_d").agg(*[F.sum(v).alias(f"s_{v}") for v in values], *[F.count(v).alias(f"c_{v}") for v in values], F.lit(1).alias("n"))
    names = ["n", *[f"{k}_{v}" for v in values for k in "sc"]]
    # One row a day becomes 1 + len(windows) events: sign +1 for all windows at the day, -1 for one window after it.
    events = per_day.select(*keys, "_d", *names, F.explode(F.array(F.lit(0), *[F.lit(w) for w in windows])).alias("_w"))
    deltas = events.select(
        *keys,
        F.date_add("_d", F.col("_w")).alias("_e"),
        (F.col("_w") == 0).alias("_own"),
        *[F.when(F.col("_w") == 0, F.col(x)).when(F.col("_w") == w, -F.col(x)).alias(f"{x}_{w}") for w in windows for x in names],
    )
    cols = [f"{x}_{w}" for w in windows for x in names]
    at = deltas.groupBy(*keys, "_e").agg(F.bool_or("_own").alias("_own"), *[F.sum(c).alias(c) for c in cols])
    w = W.partitionBy(*keys).orderBy("_e")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    spans = at.select(*keys, F.col("_e").alias("since"), *[F.sum(F.coalesce(c, F.lit(0))).over(run).alias(c) for c in cols], F.date_sub(F.lead("_e").over(w), 1).alias("_to"), F.max(F.when(F.col("_own"), F.col("_e"))).over(whole).alias("_last"))
    out = spans.where(F.col("since") <= F.col("_last")).withColumn("upto", F.least(F.coalesce("_to", "_last"), "_last"))
    named = [F.col(f"n_{w}") for w in windows] + [F.col(f"{a}_{v}_{w}").alias(f"{'sum' if a == 's' else 'cnt'}_{v}_{w}") for w in windows for v in values for a in "sc"]
    return out.select(*keys, "since", "upto", *named)


def trailing_totals(daily: DataFrame, keys: list[str], day: str, values: list[str], windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row for every calendar day from the first to the last active day of each key: n_w, sum_v_w and avg_v_w.

    A total over no value is null; n_w is 0 on a day whose window holds no active day.
    """
    spans = trailing_spans(daily, keys, day, values, windows)
    out = spans.withColumn(day, F.explode(F.sequence("since", "upto")))
    cols = [F.col(f"n_{w}") for w in windows]
    for w in windows:
        for v in values:
            some = F.col(f"cnt_{v}_{w}") > 0
            total = F.col(f"sum_{v}_{w}").cast("double")
            cols += [F.when(some, total).alias(f"sum_{v}_{w}"), F.when(some, total / F.col(f"cnt_{v}_{w}")).alias(f"avg_{v}_{w}")]
    return out.select(*keys, day, *cols)
