"""The queries p1 to p6: operators on market data as the feeds delivered it, and their SQL where it can be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import folded, normal_code, readable_day
from tidemark.operators.grid import regular_grid
from tidemark.operators.history import latest_snapshots, versions
from tidemark.operators.orphans import orphans
from tidemark.operators.trailing import trailing_spans, trailing_totals
from tidemark.operators.units import common_bars, unit_cases
from tidemark.operators.spikes import spike_rows
from tidemark.plans.problems_sql import SQL  # noqa: F401
from tidemark.sources.tables import bars, open_days, series_bars, table

SERIES = ["src", "code"]


def iso(c: str | object):
    return F.date_format(c, "yyyy-MM-dd")


# ---- 1: regular grid -------------------------------------------------------------------------------------------


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Open days between the first and last recorded day of a series on which it has no row."""
    recorded = series_bars(spark, d, "src").groupBy(*SERIES, "day_no").agg(F.lit(1).alias("n")).drop("n")
    grid = regular_grid(recorded, SERIES, "day_no").where("state != 'recorded'")
    return grid.join(F.broadcast(open_days(spark, d)), "day_no").select(*SERIES, iso("day").alias("trade_day"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every series on the grid of open days, close in yuan: recorded, interpolated within five days, or missing."""
    b = common_bars(spark, d).where("code is not null and src is not null and day is not null")
    fine = F.when((F.col("close") > 0) & (F.col("close") < 1e15), F.col("close"))
    one = b.groupBy(*SERIES, "day_no").agg(F.max_by(fine, F.struct("fetched_at", "bar_id")).alias("close"))
    grid = regular_grid(one, SERIES, "day_no", ["close"])
    return grid.join(F.broadcast(open_days(spark, d)), "day_no").select(*SERIES, iso("day").alias("trade_day"), F.round("close", 6).alias("close"), "state")


# ---- 2: units --------------------------------------------------------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored values that aren't in common units."""
    return unit_cases(spark, d)


def p2_common(spark: SparkSession, d: str) -> DataFrame:
    """Every bar with prices in yuan and volume in single shares."""
    return common_bars(spark, d).select("bar_id", "code", "src", iso("day").alias("day"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "vol")])


# ---- 3: trailing totals ----------------------------------------------------------------------------------------


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Calendar days of a series whose trailing seven days hold no recorded day."""
    spans = trailing_spans(series_bars(spark, d, "src"), SERIES, "day", [], (7,)).where("n_7 = 0")
    return spans.select(*SERIES, F.explode(F.sequence("since", "upto")).alias("cal_day")).withColumn("cal_day", iso("cal_day"))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums and averages of close (yuan) and vol (shares) over trailing 7 and 30 calendar days."""
    b = common_bars(spark, d).where("code is not null and src is not null and day is not null")
    one = b.groupBy(*SERIES, "day").agg(F.max_by(F.struct("close", "vol"), F.struct("fetched_at", "bar_id")).alias("x")).select(*SERIES, "day", "x.close", "x.vol")
    return trailing_totals(one, SERIES, "day", ["close", "vol"]).withColumn("day", iso("day"))


# ---- 4: spikes -------------------------------------------------------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows with prices that can't be true or don't fit their series."""
    return spike_rows(spark, d).select("bar_id")


# ---- 5: history ------------------------------------------------------------------------------------------------


def stock_versions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stocks").select(normal_code(F.col("code")).alias("code"), readable_day(F.col("updated")).alias("day"), "industry", "tier", "mktcap", "loaded_at", "snap_id").where("code is not null")
    one = latest_snapshots(s, ["code"], "day", ["industry", "tier", "mktcap"], ["loaded_at", "snap_id"])
    clean = one.withColumns({"industry": folded(F.col("industry")), "tier": folded(F.col("tier")), "mktcap": F.nanvl("mktcap", F.lit(None).cast("double"))})
    return versions(clean, ["code"], "day", {a: F.col(a) for a in ("industry", "tier", "mktcap")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return stock_versions(spark, d).select("code", iso("valid_from").alias("valid_from"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    """Each version with the last day for which it was valid (null: still valid)."""
    return stock_versions(spark, d).select("code", iso("valid_from").alias("valid_from"), iso("valid_to").alias("valid_to"), "industry", "tier", "mktcap")


# ---- 6: orphans ------------------------------------------------------------------------------------------------


def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "stocks").select(normal_code(F.col("code")).alias("code"), readable_day(F.col("updated")).alias("day")).where("code is not null").groupBy("code").agg(F.min("day").alias("since"))
    gone = table(spark, d, "delisted").select(normal_code(F.col("code")).alias("code"), readable_day(F.col("last_date")).alias("day")).where("code is not null").groupBy("code").agg(F.max("day").alias("upto"))
    parents = known.withColumn("known", F.lit(True)).join(gone, "code", "left")
    b = bars(spark, d, "bar_id").select(F.lit("daily_bars").alias("tab"), F.col("bar_id").alias("row_id"), "code", "raw_code", "day")
    a = table(spark, d, "adjust").select(F.lit("adjust").alias("tab"), F.col("adj_id").alias("row_id"), normal_code(F.col("code")).alias("code"), F.col("code").alias("raw_code"), F.expr("date_add(date'1970-01-01', cast(floor(if(isnan(ts) or abs(ts) > 1e11, null, ts) / 86400) as int))").alias("day"))
    x = table(spark, d, "delisted").select(F.lit("delisted").alias("tab"), F.col("dl_id").alias("row_id"), normal_code(F.col("code")).alias("code"), F.col("code").alias("raw_code"), readable_day(F.col("last_date")).alias("day"))
    rows = b.union(a).union(x).withColumn("has_ref", F.col("raw_code").isNotNull()).drop("raw_code")
    return orphans(rows, "code", "day", parents, ["tab", "row_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_rows(spark, d).select("tab", "row_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted per table, month ('none' for rows without a day) and reason."""
    return orphan_rows(spark, d).groupBy("tab", F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none")).alias("period"), "why").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_common, p3_found, p3_totals, p4_found, p5_found, p5_history, p6_found, p6_report)}
