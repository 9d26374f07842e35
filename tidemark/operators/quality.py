"""Data-quality scan of daily bars, and upserts that notice a change of price base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.market import bar_strict
from tidemark.operators import windows as I


def scan(bars: DataFrame, limit: float = 0.10, low_price: float = 1.0, gap_days: int = 20, stale_days: int = 10, gone_days: int = 180, sticky: int = 20) -> DataFrame:
    """code and a count per issue: structure, breach, low_price, gap, zero_vol, stale, gone, sticky, negative.

    stale and gone compare a code's last day with the market's; sticky counts the rows in runs of at least `sticky`
    equal closes. Bars with a null date are left out.
    """
    w = I.seq()
    b = bars.where("date is not null")
    end = b.agg(F.max("date")).first()[0]
    x = b.withColumns({"_p": F.lag("close").over(w), "_gap": F.datediff("date", F.lag("date").over(w))})
    x = I.islands(x, ["code"], "date", F.col("close") == F.col("_p"))
    g = x.groupBy("code").agg(
        F.count_if(~bar_strict(F.col("open"), F.col("high"), F.col("low"), F.col("close"))).alias("structure"),
        F.count_if(F.abs(F.col("close") / F.when(F.col("_p") > 0, F.col("_p")) - 1) > limit + 0.03).alias("breach"),
        F.count_if(F.col("close") < low_price).alias("low_price"),
        F.count_if(F.col("_gap") > gap_days).alias("gap"),
        F.count_if(F.coalesce("vol", F.lit(0.0)) == 0).alias("zero_vol"),
        F.count_if(F.col("run") >= sticky - 1).alias("sticky"),
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("negative"),
        F.datediff(F.lit(end), F.max("date")).alias("_late"),
    )
    return g.withColumns({"stale": (F.col("_late") > stale_days).cast("long"), "gone": (F.col("_late") > gone_days).cast("long")}).drop("_late")


def health(bars: DataFrame, limit: float = 0.10, least: int = 100, most: int = 3) -> DataFrame:
    """code, n, bad, healthy: enough bars, and from the sixth on at most `most` invalid or beyond the limit."""
    w = I.seq()
    p = F.lag("close").over(w)
    bad = ~bar_strict(F.col("open"), F.col("high"), F.col("low"), F.col("close")) | F.coalesce(F.abs(F.col("close") / F.when(p > 0, p) - 1) > limit + 0.03, F.lit(False))
    x = bars.withColumns({"_bad": bad, "_i": F.row_number().over(w)})
    g = x.groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("_bad") & (F.col("_i") > 5)).alias("bad"))
    return g.withColumn("healthy", (F.col("n") >= least) & (F.col("bad") <= most))


def upsert(old: DataFrame, new: DataFrame, overlap: int = 200, drift: float = 0.005, least: int = 5, keep: int = 400) -> DataFrame:
    """code, date, close, how: the merged bars of each code in `new` and `old`.

    Over a code's last `overlap` common days (at least `least`), a close that moved by more than `drift` means that
    the base changed: the new history replaces the old if it is long enough (min(keep, half the old)), and is
    otherwise ignored ('kept'). Else new days win ('merged').
    """
    o, n = old.select("code", "date", F.col("close").alias("c0")), new.select("code", "date", F.col("close").alias("c1"))
    both = o.join(n, ["code", "date"], "full")
    rank = F.when(F.col("c0").isNotNull() & F.col("c1").isNotNull(), F.lit(1))
    w = W.partitionBy("code").orderBy(F.desc("date"))
    x = both.withColumn("_common", F.sum(rank).over(w.rowsBetween(W.unboundedPreceding, 0)))
    seen = rank.isNotNull() & (F.col("_common") <= overlap)
    moved = F.abs(F.col("c1") / F.when(F.col("c0") != 0, F.col("c0")) - 1) > drift
    g = x.groupBy("code").agg(F.count_if(seen).alias("k"), F.count_if(seen & moved).alias("m"), F.count("c0").alias("n0"), F.count("c1").alias("n1"))
    shift = (F.col("k") >= least) & (F.col("m") > 0)
    long_ = F.col("n1") >= F.least(F.lit(keep), F.floor(F.col("n0") / 2))
    how = g.select("code", F.when(shift & long_, "replaced").when(shift, "kept").otherwise("merged").alias("how"))
    j = both.join(how, "code")
    value = F.when(F.col("how") == "replaced", F.col("c1")).when(F.col("how") == "kept", F.col("c0")).otherwise(F.coalesce("c1", "c0"))
    return j.select("code", "date", value.alias("close"), "how").where("close is not null")
