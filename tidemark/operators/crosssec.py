"""Cross-sections: information coefficients, metrics of curves and trades, decile portfolios, false discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def corr(x: str, y: str) -> Column:
    """Pearson correlation of pairs without nulls; null without variation (the built-in one divides by zero then)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 with ties averaged."""
    w = W.partitionBy(*by).orderBy(value)
    ties = W.partitionBy(*by, value)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2


def daily_ic(panel: DataFrame, x: str, y: str, by: list[str], least: int = 30, spearman: bool = False) -> DataFrame:
    """by, ic, n: correlation per group; null under `least` pairs or without variation. Null values are no pair."""
    p = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if spearman:
        p = p.withColumns({x: average_rank(x, by), y: average_rank(y, by)})
    enough = (F.count("*") >= least) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
    return p.groupBy(*by).agg(F.when(enough, corr(x, y)).alias("ic"), F.count("*").alias("n"))


def ic_stats(ic: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """mean, sd (sample), ratio, t and number of the coefficients."""
    g = ic.where("ic is not null").groupBy(*by).agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.count("*").alias("n"))
    ratio = F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd"))
    return g.withColumn("ir", ratio).withColumn("t", ratio * F.sqrt("n"))


def curve_metrics(curve: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """total, ann (365.25 days, at least .05 year), mdd, sharpe (252, population deviation), days.

    The rows of a curve are its days, so a window over one is as long as the calendar. Under two days, or from a
    first value of zero or less, the metrics are null.
    """
    w = W.partitionBy(*by).orderBy(order)
    peak = F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    x = curve.withColumns({"_dd": F.col(value) / peak - 1, "_r": F.col(value) / F.lag(value).over(w) - 1})
    g = x.groupBy(*by).agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("z"), F.min(order).alias("d0"), F.max(order).alias("d1"), F.min("_dd").alias("mdd"), F.avg("_r").alias("m"), F.stddev_pop("_r").alias("s"), F.count("*").alias("days"))
    ok = (F.col("days") >= 2) & (F.col("a") > 0)
    mult = F.col("z") / F.col("a")
    years = F.greatest(F.datediff("d1", "d0") / 365.25, F.lit(0.05))
    return g.select(*by, F.when(ok, mult - 1).alias("total"), F.when(ok, F.when(mult > 0, F.pow(mult, 1 / years) - 1).otherwise(-1.0)).alias("ann"), F.when(ok, F.col("mdd")).alias("mdd"), F.when(ok & (F.col("s") > 1e-12), F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).alias("sharpe"), "days")


def trade_stats(trades: DataFrame, by: list[str], ret: str) -> DataFrame:
    """n, mean, median, winrate, avg_win, avg_loss, payoff, pf, best, worst; a loss is a return of zero or less."""
    r = F.col(ret)
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    g = trades.where(r.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.avg((r > 0).cast("double")).alias("winrate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.coalesce(F.sum(win), F.lit(0.0)).alias("gp"), (-F.coalesce(F.sum(loss), F.lit(0.0))).alias("gl"), F.max(r).alias("best"), F.min(r).alias("worst"))
    return g.withColumn("payoff", F.when(F.abs("avg_loss") > 1e-12, F.col("avg_win") / F.abs("avg_loss"))).withColumn("pf", F.when(F.col("gl") > 1e-9, F.col("gp") / F.col("gl"))).drop("gp", "gl")


def decile_portfolio(panel: DataFrame, x: str, y: str, day: str, code: str, tenths: int = 10, cost: float = 0.001) -> DataFrame:
    """day, long_ret, ls_ret, turnover, net: equal-weight top tenth, long-short, share of new names, return after cost."""
    p = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = W.partitionBy(day).orderBy(F.col(x), F.col(code))
    n = F.count("*").over(W.partitionBy(day))
    r = p.select(day, code, y, F.floor((F.row_number().over(w) - 1) * tenths / n).alias("_t"), n.alias("_n")).where(F.col("_n") >= tenths)
    dates = r.select(day).distinct()
    number = dates.withColumn("_i", F.row_number().over(W.orderBy(day)))  # one row a day
    top = r.where(F.col("_t") == tenths - 1).join(number, day)
    before = F.lag("_i").over(W.partitionBy(code).orderBy("_i"))
    new = top.withColumn("_new", (before.isNull() | (before != F.col("_i") - 1)).cast("double"))
    a = new.groupBy(day).agg(F.avg(y).alias("long_ret"), F.avg("_new").alias("turnover"))
    b = r.where("_t = 0").groupBy(day).agg(F.avg(y).alias("_short"))
    return a.join(b, day).select(day, "long_ret", (F.col("long_ret") - F.col("_short")).alias("ls_ret"), "turnover", (F.col("long_ret") - cost * F.col("turnover")).alias("net"))


#: Values are ranked in this many ranges with about as many values in each.
RANGES = 64


def bh_fdr(tests: DataFrame, p: str, q: float) -> DataFrame:
    """Adds `passed`: p at most the largest p with p <= q rank / n, rank being the number of tests with a p no larger.

    A test without a p counts among the n and doesn't pass. Equal values are counted first, then ranked within ranges
    between quantiles, so no task sees all tests; only the bound, one number, goes back to them.
    """
    one = tests.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    cuts = one.agg(F.percentile_approx("_p", [i / RANGES for i in range(1, RANGES)], 1000).alias("x")).scalar()
    placed = one.withColumn("_x", cuts).withColumn("_r", F.size(F.filter("_x", lambda x: x < F.col("_p")))).drop("_x")
    sizes = placed.groupBy("_r").agg(F.sum("_c").alias("_s"))
    before = sizes.select(F.col("_r").alias("_q"), (F.sum("_s").over(W.orderBy("_r")) - F.col("_s")).alias("_b"))  # at most RANGES rows
    run = F.sum("_c").over(W.partitionBy("_r").orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    ranked = placed.withColumn("_k", run).join(F.broadcast(before), F.col("_r") == F.col("_q")).withColumn("_k", F.col("_k") + F.col("_b"))
    n = tests.agg(F.count("*")).scalar()
    bound = ranked.where(F.col("_p") <= q * F.col("_k") / n).agg(F.max("_p")).scalar()
    return tests.withColumn("passed", F.coalesce(F.col(p) <= bound, F.lit(False)))
