"""Indicators that need no state beyond a frame of rows: all stay in built-in window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec


def seq(key: str = "code", order: str = "date") -> WindowSpec:
    return W.partitionBy(key).orderBy(order)


def frame(w: WindowSpec, n: int, skip: int = 0) -> WindowSpec:
    """The n rows that end `skip` rows before the current one."""
    return w.rowsBetween(-(n - 1) - skip, -skip)


def full(x: Column, n: int, w: WindowSpec, value: Column, skip: int = 0) -> Column:
    """value where the frame of x holds n non-null values, else null."""
    return F.when(F.count(x).over(frame(w, n, skip)) >= n, value)


def sma(x: Column, n: int, w: WindowSpec, skip: int = 0) -> Column:
    return full(x, n, w, F.avg(x).over(frame(w, n, skip)), skip)


def roll(fn, x: Column, n: int, w: WindowSpec, skip: int = 0) -> Column:
    return full(x, n, w, fn(x).over(frame(w, n, skip)), skip)


def change(x: Column, n: int, w: WindowSpec) -> Column:
    """x over its value n rows ago, less one; null where there is none or it is zero."""
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def crossed_up(a: Column, b: Column, w: WindowSpec) -> Column:
    """a at or below b on the row before and above now."""
    return F.coalesce((F.lag(a).over(w) <= F.lag(b).over(w)) & (a > b), F.lit(False))


def crossed_down(a: Column, b: Column, w: WindowSpec) -> Column:
    return F.coalesce((F.lag(a).over(w) >= F.lag(b).over(w)) & (a < b), F.lit(False))


def cross_strict(a: Column, b: Column, w: WindowSpec) -> Column:
    """a above b now and below it on the row before (equality is no cross)."""
    return F.coalesce((F.lag(a).over(w) < F.lag(b).over(w)) & (a > b), F.lit(False))


def true_range(w: WindowSpec) -> Column:
    """Against the close before; the first bar's own close stands in."""
    prev = F.coalesce(F.lag("close").over(w), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def volume_ratio(w: WindowSpec) -> Column:
    """Mean volume of the last 5 rows over that of the 15 before; null within the first 19 rows or if that is zero."""
    v = F.col("vol")
    before = F.avg(v).over(frame(w, 15, 5))
    return F.when((F.row_number().over(w) >= 20) & (before > 0), F.avg(v).over(frame(w, 5)) / before)


def log_return(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    return F.when((F.col("close") > 0) & (prev > 0), F.ln(F.col("close") / prev))


def rsi_simple(n: int, w: WindowSpec) -> Column:
    """Sums of gains and losses over n changes: null if flat or too early, 100 without losses."""
    d = F.col("_d")
    up, down = F.sum(F.greatest(d, F.lit(0.0))).over(frame(w, n)), F.sum(F.greatest(-d, F.lit(0.0))).over(frame(w, n))
    return F.when(F.row_number().over(w) > n, F.when((up == 0) & (down == 0), None).when(down == 0, 100.0).otherwise(100 * up / (up + down)))


def last_known(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def islands(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Adds `run`, the length of the run of rows with flag that the row is in (0 where flag is false)."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    grouped = marked.withColumn("_g", F.sum((~F.col("_f")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.withColumn("run", F.when(F.col("_f"), F.sum(F.col("_f").cast("int")).over(W.partitionBy(*keys, "_g"))).otherwise(0)).drop("_f", "_g")


def rank01(value: str, by: list[str], tie: str, least: int = 6) -> Column:
    """(position - 1) / (n - 1) among the non-null values of a group, ties broken; null under `least` values."""
    has = F.col(value).isNotNull()
    w = W.partitionBy(*by, has).orderBy(F.col(value), F.col(tie))
    n = F.count(value).over(W.partitionBy(*by))
    return F.when(has & (n >= least), (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1)))
