"""Market-data views of the star-schema tables: supplier = instrument, ship date = trading day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.sources.tables import table


def _bars(spark: SparkSession, d: str, price: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), F.expr(price).alias("p"), F.col("l_quantity").alias("q"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("k"))
    return li.groupBy("code", "date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("vol"))


def bars_raw(spark: SparkSession, d: str) -> DataFrame:
    """code, date, open, high, low, close, vol with the unit price of a line as price."""
    return _bars(spark, d, "l_extendedprice / l_quantity")


def bars_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The same with prices between 18 and 22, for limits, stops, lots and fees."""
    return _bars(spark, d, "20 * (1 + l_discount - l_tax)")


def instruments(spark: SparkSession, d: str) -> DataFrame:
    """code, name, industry, board, mktcap, tier; tiers by the sorted positions n//3 and 2n//3 of mktcap."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    base = s.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("board"), F.col("s_acctbal").alias("mktcap"))
    return tercile(base, "mktcap")


#: Rows are ranked in this many ranges of values, each in its own task.
RANGES = 64


def tercile(df: DataFrame, value: str) -> DataFrame:
    """df with `tier`: large and mid from the values at the sorted positions 2n//3 and n//3 on, else small.

    Null and NaN have no position and are small. The positions are found in ranges of values: the ranges are counted, and
    only the two that hold the positions are sorted, so no task sees all values. Bounds are computed within the plan.
    """
    some = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("v"))
    ends = some.agg(F.min("v").alias("a"), F.max("v").alias("z")).select(F.struct("a", "z")).scalar()
    at = lambda x: F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.coalesce(F.floor(F.try_divide(x - ends["a"], ends["z"] - ends["a"]) * RANGES).cast("int"), F.lit(0))))
    placed = some.withColumn("r", at(F.col("v")))
    sizes = placed.groupBy("r").agg(F.count("*").alias("c"))
    w = W.orderBy("r")  # at most RANGES rows
    n = F.sum("c").over(W.partitionBy())
    runs = sizes.select("r", (F.sum("c").over(w) - F.col("c")).alias("since"), F.sum("c").over(w).alias("upto"), n.alias("n"))
    wanted = runs.select("r", "since", "upto", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.expr("n div 3").alias("p")), F.struct(F.lit(2).alias("k"), F.expr("2 * n div 3").alias("p")))).alias("x")).where("x.p >= since and x.p < upto").select("r", "x.k", (F.col("x.p") - F.col("since") + 1).alias("nth"))
    inner = placed.join(F.broadcast(wanted), "r").withColumn("i", F.row_number().over(W.partitionBy("k").orderBy("v"))).where("i = nth")
    lo, hi = (inner.where(F.col("k") == k).select("v").scalar() for k in (1, 2))
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return df.withColumn("tier", F.when(v >= hi, "large").when(v >= lo, "mid").otherwise("small"))


def factors(spark: SparkSession, d: str) -> DataFrame:
    """code, k: a price factor per instrument."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), (1 + F.col("s_suppkey") % 7 / 10).alias("k"))


def index_close(bars: DataFrame, even: bool = False) -> DataFrame:
    """date, idx: mean close of all (or all even) codes."""
    b = bars.where(F.col("code") % 2 == 0) if even else bars
    return b.groupBy("date").agg(F.avg("close").alias("idx"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("code"), "ts", F.col("value").alias("price"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Trades from orders: F buys, O sells; one hundred units at a hundredth of the total."""
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.select(F.col("o_custkey").alias("code"), F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL").alias("type"), F.col("o_orderkey").alias("trade_id"), (F.col("o_totalprice") / 100).alias("price"), F.lit(100.0).alias("volume"))


# The same views as SQL, for the queries' oracles.
_K = "row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)"


def _bars_sql(name: str, price: str) -> str:
    return f"""{name} AS (SELECT code, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q) AS vol FROM
 (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, {price} AS p, l_quantity AS q, {_K} AS k FROM lineitem) GROUP BY code, date)"""


RAW_SQL = _bars_sql("bars", "l_extendedprice / l_quantity")
BOUNDED_SQL = _bars_sql("bounded", "20 * (1 + l_discount - l_tax)")
INSTRUMENTS_SQL = """inst0 AS (SELECT s_suppkey AS code, s_name AS name, n_name AS industry, r_name AS board, s_acctbal AS mktcap FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cap AS (SELECT list_sort(list(mktcap)) AS c, count(*) AS n FROM inst0),
inst AS (SELECT inst0.*, CASE WHEN mktcap >= c[2 * n // 3 + 1] THEN 'large' WHEN mktcap >= c[n // 3 + 1] THEN 'mid' ELSE 'small' END AS tier FROM inst0, cap)"""
FACTORS_SQL = "fac AS (SELECT s_suppkey AS code, 1 + s_suppkey % 7 / 10 AS k FROM supplier)"
INDEX_SQL = "idx AS (SELECT date, avg(close) AS idx FROM bars GROUP BY date)"
LEDGER_SQL = "led AS (SELECT o_custkey AS code, CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS type, o_orderkey AS trade_id, o_totalprice / 100 AS price, 100.0 AS volume FROM orders WHERE o_orderstatus IN ('F', 'O'))"
