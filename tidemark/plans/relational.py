"""Queries for joins and set operations (JN), aggregations (AGG), top-k (TOP), similarity (SIM) and quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import crosssec as X
from tidemark.operators import quality as Q
from tidemark.operators import similarity as M
from tidemark.operators import windows as I
from tidemark.operators.crosssec import corr
from tidemark.plans.declare import declare
from tidemark.sources.tables import table
from tidemark.sources.views import BOUNDED_SQL, FACTORS_SQL, INDEX_SQL, INSTRUMENTS_SQL, LEDGER_SQL, RAW_SQL, bars_bounded, bars_raw, factors, index_close, instruments, ledger

QUERIES, SQL, query = declare()
BARS = f"WITH {RAW_SQL}"
BOUND = f"WITH {BOUNDED_SQL}, bars AS (SELECT * FROM bounded)"
RET = "r AS (SELECT code, date, close, vol, round(close / lag(close) OVER w - 1, 9) AS r, round(close / lag(close, 20) OVER w - 1, 9) AS x, round(lead(close) OVER w / close - 1, 9) AS y FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))"


def returns(spark, d):
    """code, date, close, vol, r (last return), x (20-row return), y (next return)."""
    w, c = I.seq(), F.col("close")
    return bars_bounded(spark, d).select("code", "date", "close", "vol", F.round(I.change(c, 1, w), 9).alias("r"), F.round(I.change(c, 20, w), 9).alias("x"), F.round(F.lead(c).over(w) / c - 1, 9).alias("y"))


# ---- joins -----------------------------------------------------------------------------------------------------


@query(f"{BARS}, {INSTRUMENTS_SQL} SELECT coalesce(industry, '') AS industry, count(*) AS n, round(avg(close), 4) AS mean FROM bars LEFT JOIN inst USING (code) GROUP BY 1")
def jn_1_lkp_1_bars_instruments(spark, d):
    return bars_raw(spark, d).join(instruments(spark, d), "code", "left").groupBy(F.coalesce("industry", F.lit("")).alias("industry")).agg(F.count("*").alias("n"), F.round(F.avg("close"), 4).alias("mean"))


@query(f"{BOUND}, {INDEX_SQL}, i AS (SELECT date, round(idx / lag(idx) OVER (ORDER BY date) - 1, 9) AS ir FROM idx) SELECT code, count(*) AS n, count(ir) AS known, count(*) FILTER (WHERE coalesce(ir < -0.015, false)) AS weak FROM bars LEFT JOIN i USING (date) GROUP BY code")
def jn_3_bars_index_return(spark, d):
    b = bars_bounded(spark, d)
    i = index_close(b).select("date", F.round(F.col("idx") / F.lag("idx").over(W.orderBy("date")) - 1, 9).alias("ir"))  # one row a day
    return b.join(i, "date", "left").groupBy("code").agg(F.count("*").alias("n"), F.count("ir").alias("known"), F.count_if(F.coalesce(F.col("ir") < -0.015, F.lit(False))).alias("weak"))


@query(f"{BOUND}, {INSTRUMENTS_SQL}, {RET}, k AS (SELECT industry, date, avg(r) AS m FROM r JOIN inst USING (code) WHERE r IS NOT NULL GROUP BY ALL) SELECT code, count(m) AS n, round(avg(r - m), 6) AS active FROM r JOIN inst USING (code) LEFT JOIN k USING (industry, date) GROUP BY code")
def jn_4_industry_series(spark, d):
    r = returns(spark, d).join(instruments(spark, d).select("code", "industry"), "code")
    k = r.where("r is not null").groupBy("industry", "date").agg(F.avg("r").alias("m"))
    return r.join(k, ["industry", "date"], "left").groupBy("code").agg(F.count("m").alias("n"), F.round(F.avg(F.col("r") - F.col("m")), 6).alias("active"))


@query(f"{BARS}, s AS (SELECT code, date, close, CASE WHEN close > open * 1.5 THEN 'BUY' WHEN close < open * 0.5 THEN 'SELL' END AS side FROM bars) SELECT code, date, close AS fill, exec FROM (SELECT code, date, close, lag(side) OVER (PARTITION BY code ORDER BY date) AS exec FROM s) WHERE exec IS NOT NULL")
def jn_5_execution_next_bar(spark, d):
    """A signal's fill at the next bar, by shifting the side instead of joining on the index."""
    s = F.when(F.col("close") > F.col("open") * 1.5, "BUY").when(F.col("close") < F.col("open") * 0.5, "SELL")
    return bars_raw(spark, d).withColumn("side", s).select("code", "date", F.col("close").alias("fill"), F.lag("side").over(I.seq()).alias("exec")).where("exec is not null")


@query(f"{BARS}, sel AS (SELECT code FROM bars GROUP BY code HAVING count(*) > 535) SELECT b.code, count(*) AS n FROM bars b JOIN sel USING (code) GROUP BY b.code")
def jn_6_selection(spark, d):
    b = bars_raw(spark, d)
    sel = b.groupBy("code").agg(F.count("*").alias("n")).where("n > 535")
    return sel.select("code", "n")


@query(f"{BARS}, cal AS (SELECT DISTINCT date FROM bars), one AS (SELECT date, close FROM bars WHERE code = 2) SELECT cal.date, one.close AS mark FROM cal ASOF LEFT JOIN one ON one.date <= cal.date")
def jn_7_as_of_index(spark, d):
    """Last known close on every day of the calendar; null before the first."""
    b = bars_raw(spark, d)
    cal = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    j = cal.join(b.where("code = 2").select("date", "close"), "date", "left")
    return j.select("date", I.last_known(F.col("close"), W.orderBy("date")).alias("mark"))  # one row a day


@query(f"{BARS}, cal AS (SELECT DISTINCT date FROM bars), cc AS (SELECT code, date FROM (SELECT DISTINCT code FROM bars), cal) SELECT cc.code, cc.date, b.close AS mark FROM cc ASOF LEFT JOIN bars b ON b.code = cc.code AND b.date <= cc.date")
def jn_8_16_dense_marks(spark, d):
    """Every code on every day of the calendar with its last known close: gaps are exploded between a bar and the
    next, so no cross join of codes and days is made."""
    b = bars_raw(spark, d)
    cal = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().withColumn("t", F.row_number().over(W.orderBy("date")).cast("int"))  # one row a day
    begin, last = cal.agg(F.min("t"), F.max("t")).first()
    w = I.seq("code", "t")
    at = b.join(F.broadcast(cal), "date").select("code", "t", "close", F.coalesce(F.lead("t").over(w) - 1, F.lit(last)).alias("upto"), F.row_number().over(w).alias("i"))
    on = at.where(F.col("upto") >= begin).select("code", F.col("close").alias("mark"), F.explode(F.sequence(F.greatest("t", F.lit(begin)), F.col("upto"))).alias("t"))
    # Days before a code's first bar have no mark.
    head = at.where((F.col("i") == 1) & (F.col("t") > begin)).select("code", F.lit(None).cast("double").alias("mark"), F.explode(F.sequence(F.lit(begin), F.col("t") - 1)).alias("t"))
    return on.union(head).join(F.broadcast(cal), "t").select("code", "date", "mark")


@query(f"{BARS}, seen AS (SELECT DISTINCT code FROM bars WHERE date > DATE '2001-11-05') SELECT DISTINCT code FROM bars WHERE code NOT IN (SELECT code FROM seen)")
def jn_11_anti_join(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"))
    return b.join(b.where("date > date'2001-11-05'"), "code", "left_anti").select("code").distinct()


_NEW = "n AS (SELECT code, date, CASE WHEN code % 3 = 0 THEN close * 2 WHEN code % 3 = 1 THEN close * 1.001 ELSE close END AS c1 FROM bars WHERE date >= DATE '1999-01-01' OR code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)), o AS (SELECT code, date, close AS c0 FROM bars WHERE date < DATE '2001-01-01')"


@query(f"""{BARS}, {_NEW}, f AS (SELECT coalesce(o.code, n.code) AS code, coalesce(o.date, n.date) AS date, c0, c1 FROM o FULL JOIN n ON o.code = n.code AND o.date = n.date),
g AS (SELECT *, sum((c0 IS NOT NULL AND c1 IS NOT NULL)::INTEGER) OVER (PARTITION BY code ORDER BY date DESC ROWS UNBOUNDED PRECEDING) AS k FROM f),
h AS (SELECT code, count(*) FILTER (WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND k <= 200) AS k, count(*) FILTER (WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND k <= 200 AND abs(c1 / c0 - 1) > 0.005) AS m, count(c0) AS n0, count(c1) AS n1 FROM g GROUP BY code),
w AS (SELECT code, CASE WHEN k >= 5 AND m > 0 AND n1 >= least(400, n0 // 2) THEN 'replaced' WHEN k >= 5 AND m > 0 THEN 'kept' ELSE 'merged' END AS how FROM h)
SELECT code, how, count(v) AS n, round(sum(v), 2) AS total FROM (SELECT f.code, how, CASE how WHEN 'replaced' THEN c1 WHEN 'kept' THEN c0 ELSE coalesce(c1, c0) END AS v FROM f JOIN w USING (code)) GROUP BY code, how""")
def jn_12_str_4_upsert_rebase(spark, d):
    b = bars_raw(spark, d)
    c = F.when(F.col("code") % 3 == 0, F.col("close") * 2).when(F.col("code") % 3 == 1, F.col("close") * 1.001).otherwise(F.col("close"))
    deep = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("code"), F.lit(True).alias("deep"))
    new = b.join(deep, "code", "left").where("date >= date'1999-01-01' or deep").select("code", "date", c.alias("close"))
    u = Q.upsert(b.where("date < date'2001-01-01'"), new)
    return u.groupBy("code", "how").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total"))


@query(f"{BARS} SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT date FROM bars WHERE close > open UNION SELECT date FROM bars WHERE close < open)")
def jn_13_union_calendar(spark, d):
    b = bars_raw(spark, d)
    u = b.where("close > open").select("date").union(b.where("close < open").select("date")).distinct()
    return u.select("date", F.row_number().over(W.orderBy("date")).cast("long").alias("t"))  # one row a day


@query(f"{BARS} SELECT code, date FROM bars WHERE close > open EXCEPT SELECT code, date FROM bars WHERE vol > 40")
def jn_14_except(spark, d):
    b = bars_raw(spark, d)
    return b.where("close > open").select("code", "date").exceptAll(b.where("vol > 40").select("code", "date"))  # keys are unique


@query(f"{BARS} SELECT code, date FROM bars WHERE close > open INTERSECT SELECT code, date FROM bars WHERE vol > 40")
def jn_15_intersect(spark, d):
    b = bars_raw(spark, d)
    return b.where("close > open").select("code", "date").intersect(b.where("vol > 40").select("code", "date"))


@query(f"WITH {INSTRUMENTS_SQL} SELECT code, peer, rn FROM (SELECT a.code, b.code AS peer, row_number() OVER (PARTITION BY a.code ORDER BY abs(ln(greatest(a.mktcap, 10)) - ln(greatest(b.mktcap, 10))), b.code) AS rn FROM inst a JOIN inst b ON a.industry = b.industry AND a.code <> b.code) WHERE rn <= 3")
def jn_17_peers(spark, d):
    """The nearest peers by log size in the same industry: the k below and above in sorted order hold the k nearest,
    so no pairs of a whole industry are made."""
    k = 3
    i = instruments(spark, d).select("code", "industry", F.ln(F.greatest("mktcap", F.lit(10.0))).alias("s"))
    # Of equal sizes the k + 1 lowest codes can be anyone's peers; sizes are then neighbours in sorted order.
    low = i.withColumn("c", F.row_number().over(W.partitionBy("industry", "s").orderBy("code"))).where(F.col("c") <= k + 1)
    sizes = low.groupBy("industry", "s").agg(F.collect_list(F.struct("code", "s")).alias("own"))
    w = W.partitionBy("industry").orderBy("s")
    near = sizes.select("industry", "s", "own", *[f("own", j).over(w).alias(f"{n}{j}") for j in range(1, k + 1) for n, f in (("b", F.lag), ("a", F.lead))])
    pool = near.select("industry", "s", F.flatten(F.array_compact(F.array("own", *[f"{n}{j}" for j in range(1, k + 1) for n in "ba"]))).alias("pool"))
    x = i.join(pool, ["industry", "s"]).select("code", "s", F.explode("pool").alias("p")).where("code != p.code")
    rn = F.row_number().over(W.partitionBy("code").orderBy(F.abs(F.col("s") - F.col("p.s")), F.col("p.code"))).cast("long")
    return x.select("code", F.col("p.code").alias("peer"), rn.alias("rn")).where(F.col("rn") <= k)


@query(f"WITH {INSTRUMENTS_SQL} SELECT code, tier, rn FROM (SELECT code, tier, row_number() OVER (PARTITION BY tier ORDER BY md5(CAST(code AS VARCHAR)), code) AS rn FROM inst WHERE industry <> 'NATION_1') WHERE rn <= 5")
def jn_18_top_9_tier_sample(spark, d):
    """A stratified sample that is the same each time: per tier, the first by a hash of the code."""
    i = instruments(spark, d).where("industry != 'NATION_1'")
    rn = F.row_number().over(W.partitionBy("tier").orderBy(F.md5(F.col("code").cast("string")), "code")).cast("long")
    return i.select("code", "tier", rn.alias("rn")).where("rn <= 5")


@query(f"WITH {INSTRUMENTS_SQL} SELECT code, 'peer' AS kind FROM inst WHERE industry = 'NATION_2' UNION ALL SELECT code, 'fund' FROM inst WHERE code IN (1, 2, 3)")
def jn_19_pool_union(spark, d):
    i = instruments(spark, d)
    return i.where("industry = 'NATION_2'").select("code", F.lit("peer").alias("kind")).unionByName(i.where("code in (1, 2, 3)").select("code", F.lit("fund").alias("kind")))


# ---- aggregations ----------------------------------------------------------------------------------------------


@query(f"{BOUND}, {INSTRUMENTS_SQL}, {RET} SELECT date, industry, round(avg(r), 6) AS ret, count(*) AS n FROM r JOIN inst USING (code) WHERE r IS NOT NULL GROUP BY date, industry")
def agg_2_industry_return(spark, d):
    r = returns(spark, d).where("r is not null").join(instruments(spark, d).select("code", "industry"), "code")
    return r.groupBy("date", "industry").agg(F.round(F.avg("r"), 6).alias("ret"), F.count("*").alias("n"))


@query(f"""{BOUND}, {INSTRUMENTS_SQL}, {RET}, l AS (SELECT industry, round(avg(close5), 9) AS m FROM (SELECT code, arg_max(x5, date) AS close5 FROM (SELECT code, date, close / lag(close, 5) OVER (PARTITION BY code ORDER BY date) - 1 AS x5 FROM bars) WHERE x5 IS NOT NULL GROUP BY code) JOIN inst USING (code) GROUP BY industry),
k AS (SELECT *, row_number() OVER (ORDER BY m DESC, industry) AS rk, count(*) OVER () AS n FROM l) SELECT industry, round(m, 6) AS m, rk <= greatest(1, n // 5) AS leader FROM k""")
def agg_3_leaders(spark, d):
    """Industries by their members' latest five-row return; the top fifth, at least one, lead."""
    w = I.seq()
    x = bars_bounded(spark, d).select("code", "date", I.change(F.col("close"), 5, w).alias("x")).where("x is not null").groupBy("code").agg(F.max_by("x", "date").alias("x"))
    m = x.join(instruments(spark, d).select("code", "industry"), "code").groupBy("industry").agg(F.round(F.avg("x"), 9).alias("m"))
    rk = F.row_number().over(W.orderBy(F.desc("m"), "industry"))  # one row an industry
    return m.withColumns({"rk": rk, "n": F.count("*").over(W.partitionBy())}).select("industry", F.round("m", 6).alias("m"), (F.col("rk") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5))).alias("leader"))


@query(f"{BOUND}, {INSTRUMENTS_SQL}, {RET}, k AS (SELECT industry, date, avg(r) AS m FROM r JOIN inst USING (code) WHERE r IS NOT NULL GROUP BY ALL), s AS (SELECT industry, date, round(sum(m) OVER (PARTITION BY industry ORDER BY date ROWS 4 PRECEDING), 9) AS s5 FROM k) SELECT date, count(*) AS n, round(median(s5), 6) AS med, round(max(s5), 6) AS top FROM s GROUP BY date HAVING count(*) >= 3")
def agg_6_industry_context(spark, d):
    r = returns(spark, d).where("r is not null").join(instruments(spark, d).select("code", "industry"), "code")
    k = r.groupBy("industry", "date").agg(F.avg("r").alias("m"))
    s = k.select("date", F.round(F.sum("m").over(I.frame(I.seq("industry"), 5)), 9).alias("s5"))
    return s.groupBy("date").agg(F.count("*").alias("n"), F.round(F.median("s5"), 6).alias("med"), F.round(F.max("s5"), 6).alias("top")).where("n >= 3")


@query(f"{BARS} SELECT code, round(quantile_cont(close, 0.1) + 1e-9, 4) AS p10, round(quantile_cont(close, 0.5) + 1e-9, 4) AS p50, round(quantile_cont(close, 0.9) + 1e-9, 4) AS p90, round(median(vol), 4) AS med FROM bars GROUP BY code")
def agg_7_9_percentiles(spark, d):
    return bars_raw(spark, d).groupBy("code").agg(*[F.round(F.percentile("close", p) + 1e-9, 4).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)], F.round(F.median("vol"), 4).alias("med"))


@query("""WITH o AS (SELECT l_suppkey AS code, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY code ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY code) AS al FROM o)
SELECT code, min(v) FILTER (WHERE run >= 0.1 * al - 1e-12) AS p10, min(v) FILTER (WHERE run >= 0.5 * al - 1e-12) AS p50, min(v) FILTER (WHERE run >= 0.9 * al - 1e-12) AS p90 FROM c GROUP BY code""")
def agg_8_weighted_quantile(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"))
    return M.weighted_quantile(li, ["code"], "v", "w", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


_ST = "count(*) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(avg((r > 0)::INTEGER), 6) AS winrate, round(avg(r) FILTER (WHERE r > 0), 6) AS avg_win, round(avg(r) FILTER (WHERE r <= 0), 6) AS avg_loss, max(r) AS best, min(r) AS worst, round(avg(r) FILTER (WHERE r > 0) / abs(avg(r) FILTER (WHERE r <= 0)), 4) AS payoff, round(coalesce(sum(r) FILTER (WHERE r > 0), 0) / nullif(-coalesce(sum(r) FILTER (WHERE r <= 0), 0), 0), 4) AS pf"


@query(f"{BOUND}, {RET} SELECT code, {_ST} FROM r WHERE r IS NOT NULL GROUP BY code")
def agg_10_11_trade_stats(spark, d):
    s = X.trade_stats(returns(spark, d), ["code"], "r")
    return s.select("code", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "winrate", "avg_win", "avg_loss")], "best", "worst", *[F.round(c, 4).alias(c) for c in ("payoff", "pf")])


@query(f"WITH {INSTRUMENTS_SQL} SELECT tier, count(*) AS n, min(mktcap) AS lo, max(mktcap) AS hi FROM inst GROUP BY tier")
def agg_12_29_terciles(spark, d):
    return instruments(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.min("mktcap").alias("lo"), F.max("mktcap").alias("hi"))


_IC = "SELECT date, count(*) AS n, CASE WHEN count(*) >= 10 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN round(corr(x, y), 5) END AS ic FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY date"


@query(f"{BOUND}, {RET} {_IC}")
def agg_16_daily_ic(spark, d):
    return X.daily_ic(returns(spark, d), "x", "y", ["date"], 10).select("date", "n", F.round("ic", 5).alias("ic"))


_RK = "k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2 AS x, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2 AS y FROM r WHERE x IS NOT NULL AND y IS NOT NULL)"


@query(f"{BOUND}, {RET}, {_RK} {_IC.replace('FROM r', 'FROM k')}")
def agg_16_rank_ic(spark, d):
    return X.daily_ic(returns(spark, d), "x", "y", ["date"], 10, spearman=True).select("date", "n", F.round("ic", 5).alias("ic"))


@query(f"{BOUND}, {RET}, i AS ({_IC.replace('round(corr(x, y), 5)', 'corr(x, y)')}) SELECT count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd, round(avg(ic) / stddev_samp(ic), 5) AS ir, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 4) AS t FROM i WHERE ic IS NOT NULL")
def agg_13_14_16_ic_stats(spark, d):
    s = X.ic_stats(X.daily_ic(returns(spark, d), "x", "y", ["date"], 10))
    return s.select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("ir", 5).alias("ir"), F.round("t", 4).alias("t"))


@query(f"{BOUND}, {RET}, e AS (SELECT code, x / 20 AS p, y FROM r WHERE x IS NOT NULL AND y IS NOT NULL) SELECT code, count(*) AS n, round(corr(p, y), 5) AS ic, round(avg(abs(p - y)), 6) AS mae, round(avg(CASE WHEN abs(p) > 0.001 THEN (sign(p) = sign(y))::INTEGER END), 5) AS hit FROM e GROUP BY code HAVING count(*) >= 25")
def agg_17_pooled_eval(spark, d):
    e = returns(spark, d).where("x is not null and y is not null").select("code", (F.col("x") / 20).alias("p"), "y")
    hit = F.when(F.abs("p") > 0.001, (F.signum("p") == F.signum("y")).cast("double"))
    return e.groupBy("code").agg(F.count("*").alias("n"), F.round(corr("p", "y"), 5).alias("ic"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mae"), F.round(F.avg(hit), 5).alias("hit")).where("n >= 25")


_Q = "q AS (SELECT code, y, quantile_cont(y, 0.1) OVER (PARTITION BY code) AS q10, quantile_cont(y, 0.5) OVER (PARTITION BY code) AS q50, quantile_cont(y, 0.9) OVER (PARTITION BY code) AS q90 FROM r WHERE y IS NOT NULL)"


@query(f"{BOUND}, {RET}, {_Q} SELECT code, round(avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))), 6) AS pin10, round(avg(greatest(0.9 * (y - q90), -0.1 * (y - q90))), 6) AS pin90, round(avg((y BETWEEN q10 - 1e-9 AND q90 + 1e-9)::INTEGER), 5) AS cover, round(avg((q10 > q90)::INTEGER), 5) AS crossed FROM q GROUP BY code")
def agg_18_pinball(spark, d):
    r = returns(spark, d).where("y is not null")
    q = r.groupBy("code").agg(F.percentile("y", 0.1).alias("q10"), F.percentile("y", 0.9).alias("q90"))
    x = r.select("code", "y").join(q, "code")
    pin = lambda p, c: F.avg(F.greatest(p * (F.col("y") - F.col(c)), (p - 1) * (F.col("y") - F.col(c))))
    return x.groupBy("code").agg(F.round(pin(0.1, "q10"), 6).alias("pin10"), F.round(pin(0.9, "q90"), 6).alias("pin90"), F.round(F.avg(F.col("y").between(F.col("q10") - 1e-9, F.col("q90") + 1e-9).cast("double")), 5).alias("cover"), F.round(F.avg((F.col("q10") > F.col("q90")).cast("double")), 5).alias("crossed"))


@query(f"{BOUND}, {RET}, h AS (SELECT code, count(*) AS n, avg((sign(x) = sign(y))::INTEGER) AS hit, corr(x, y) AS ic FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY code) SELECT code, n, round((hit - 0.5) / sqrt(0.25 / n), 4) AS z, round(ic * sqrt(n), 4) AS t FROM h")
def agg_19_hit_stats(spark, d):
    h = returns(spark, d).where("x is not null and y is not null").groupBy("code").agg(F.count("*").alias("n"), F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("hit"), corr("x", "y").alias("ic"))
    return h.select("code", "n", F.round((F.col("hit") - 0.5) / F.sqrt(0.25 / F.col("n")), 4).alias("z"), F.round(F.col("ic") * F.sqrt("n"), 4).alias("t"))


@query(f"{BOUND}, {RET}, {_Q} SELECT k, round(avg((y BETWEEN q50 + k * (q10 - q50) - 1e-9 AND q50 + k * (q90 - q50) + 1e-9)::INTEGER), 6) AS cover FROM q, (SELECT unnest([1.0::DOUBLE, 1.25, 1.5]) AS k) GROUP BY k")
def agg_20_interval_scales(spark, d):
    r = returns(spark, d).where("y is not null").select("code", "y")
    q = r.groupBy("code").agg(*[F.percentile("y", p).alias(f"q{int(p * 100)}") for p in (0.1, 0.5, 0.9)])
    x = r.join(q, "code").withColumn("k", F.explode(F.array(F.lit(1.0), F.lit(1.25), F.lit(1.5))))
    m, k = F.col("q50"), F.col("k")
    return x.groupBy("k").agg(F.round(F.avg(F.col("y").between(m + k * (F.col("q10") - m) - 1e-9, m + k * (F.col("q90") - m) + 1e-9).cast("double")), 6).alias("cover"))


_FEE = "round(greatest(price * volume * 0.00025, 5) + price * volume * 0.00001 + CASE WHEN type = 'SELL' THEN price * volume * 0.0005 ELSE 0 END, 2)"


@query(f"WITH {LEDGER_SQL}, s AS (SELECT code, CASE type WHEN 'BUY' THEN 1 ELSE -1 END AS s, price, volume, {_FEE} AS fee FROM led) SELECT code, sum(s * volume) AS volume, round(sum(s * volume * price), 2) AS cost, round(sum(s * volume * price) / sum(s * volume) + 1e-7, 4) AS avg_cost, round(sum(fee), 2) AS fees FROM s GROUP BY code HAVING sum(s * volume) > 0")
def agg_21_positions(spark, d):
    from tidemark.functions.market import fee

    s = F.when(F.col("type") == "BUY", 1).otherwise(-1)
    amount = F.col("price") * F.col("volume")
    x = ledger(spark, d).select("code", (s * F.col("volume")).alias("v"), (s * F.col("volume") * F.col("price")).alias("a"), fee(amount, F.col("type") == "SELL").alias("fee"))
    g = x.groupBy("code").agg(F.sum("v").alias("volume"), F.sum("a").alias("c"), F.sum("fee").alias("fees")).where("volume > 0")
    return g.select("code", "volume", F.round("c", 2).alias("cost"), F.round(F.col("c") / F.col("volume") + 1e-7, 4).alias("avg_cost"), F.round("fees", 2).alias("fees"))


@query(f"WITH {LEDGER_SQL}, s AS (SELECT type, price * volume AS a, {_FEE} AS fee FROM led) SELECT round(1e9 + sum(CASE type WHEN 'SELL' THEN a ELSE -a END) - sum(fee), 2) AS cash, round(sum(fee), 2) AS fees, count(*) AS trades FROM s")
def agg_22_account(spark, d):
    from tidemark.functions.market import fee

    x = ledger(spark, d).select(F.when(F.col("type") == "SELL", F.col("price") * F.col("volume")).otherwise(-F.col("price") * F.col("volume")).alias("a"), fee(F.col("price") * F.col("volume"), F.col("type") == "SELL").alias("fee"))
    return x.agg(F.round(1e9 + F.sum("a") - F.sum("fee"), 2).alias("cash"), F.round(F.sum("fee"), 2).alias("fees"), F.count("*").alias("trades"))


_FW = ", ".join(f"round(lead(close, {k}) OVER w / close - 1, 9) AS f{k}" for k in (5, 10, 20))


@query(f"{BOUND}, f AS (SELECT code, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS sig, {_FW} FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) SELECT sig, count(*) AS n, {', '.join(f'round(avg(f{k}) * 100, 4) AS mean{k}, round(avg((f{k} > 0)::INTEGER) * 100, 4) AS win{k}' for k in (5, 10, 20))} FROM f GROUP BY sig")
def agg_23_snk_7_signal_forward(spark, d):
    w, c = I.seq(), F.col("close")
    sig = F.when(c > F.col("open"), "up").when(c < F.col("open"), "down").otherwise("flat")
    f = bars_bounded(spark, d).select(sig.alias("sig"), *[F.round(F.lead("close", k).over(w) / c - 1, 9).alias(f"f{k}") for k in (5, 10, 20)])
    return f.groupBy("sig").agg(F.count("*").alias("n"), *[x for k in (5, 10, 20) for x in (F.round(F.avg(f"f{k}") * 100, 4).alias(f"mean{k}"), F.round(F.avg((F.col(f"f{k}") > 0).cast("double")) * 100, 4).alias(f"win{k}"))])


_STRICT = "coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND high >= greatest(open, close) AND low <= least(open, close), false)"


@query(f"""{BOUND}, x AS (SELECT *, lag(close) OVER w AS p, date - lag(date) OVER w AS g FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
y AS (SELECT *, sum((close IS DISTINCT FROM p)::INTEGER) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS k FROM x), z AS (SELECT *, count(*) FILTER (WHERE close = p) OVER (PARTITION BY code, k) AS run FROM y), e AS (SELECT max(date) AS e FROM bars)
SELECT code, count(*) FILTER (WHERE NOT {_STRICT}) AS structure, count(*) FILTER (WHERE abs(close / p - 1) > 0.13) AS breach, count(*) FILTER (WHERE close < 1) AS low_price, count(*) FILTER (WHERE g > 20) AS gap, count(*) FILTER (WHERE coalesce(vol, 0) = 0) AS zero_vol, count(*) FILTER (WHERE close = p AND run >= 2) AS sticky,
 count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS negative, (max(e) - max(date) > 10)::BIGINT AS stale, (max(e) - max(date) > 180)::BIGINT AS gone FROM z, e GROUP BY code""")
def agg_24_quality_scan(spark, d):
    return Q.scan(bars_bounded(spark, d), sticky=3)


@query(f"""{BOUND}, x AS (SELECT code, NOT {_STRICT} OR coalesce(abs(close / lag(close) OVER w - 1) > 0.13, false) AS bad, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) SELECT code, count(*) AS n, count(*) FILTER (WHERE bad AND i > 5) AS bad, count(*) >= 100 AND count(*) FILTER (WHERE bad AND i > 5) <= 3 AS healthy FROM x GROUP BY code""")
def qa_1_health(spark, d):
    return Q.health(bars_bounded(spark, d))


_MET = """x AS (SELECT *, v / max(v) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd, v / lag(v) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM c),
g AS (SELECT code, arg_min(v, date) AS a, arg_max(v, date) AS z, max(date) - min(date) AS span, min(dd) AS mdd, avg(r) AS m, stddev_pop(r) AS s, count(*) AS days FROM x GROUP BY code)
SELECT code, round(z / a - 1, 6) AS total, round(pow(z / a, 1 / greatest(span / 365.25, 0.05)) - 1, 6) AS ann, round(mdd, 6) AS mdd, round(CASE WHEN s > 1e-12 THEN m / s * sqrt(252) END, 4) AS sharpe, days FROM g"""


def _metrics(m):
    return m.select("code", *[F.round(c, 6).alias(c) for c in ("total", "ann", "mdd")], F.round("sharpe", 4).alias("sharpe"), "days")


@query(f"{BOUND}, c AS (SELECT code, date, close AS v FROM bars), {_MET}")
def agg_25_bt_12_buy_and_hold(spark, d):
    return _metrics(X.curve_metrics(bars_bounded(spark, d), ["code"], "date", "close"))


@query(f"{BOUND}, {RET}, m AS (SELECT date, avg(r) AS m FROM r WHERE r IS NOT NULL GROUP BY date) SELECT count(*) AS days, round(pow(exp(sum(ln(1 + m))), 250.0 / count(*)) - 1, 6) AS ann FROM m")
def agg_26_basket(spark, d):
    m = returns(spark, d).where("r is not null").groupBy("date").agg(F.avg("r").alias("m"))
    return m.agg(F.count("*").alias("days"), F.round(F.pow(F.exp(F.sum(F.log1p("m"))), F.lit(250.0) / F.count("*")) - 1, 6).alias("ann"))


@query(f"{BOUND}, x AS (SELECT code, year(date) AS y, date, close, close / max(close) OVER (PARTITION BY code, year(date) ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) SELECT code, y, round(arg_max(close, date) / arg_min(close, date) - 1, 6) AS ret, round(min(dd), 6) AS mdd FROM x GROUP BY code, y")
def agg_27_per_year(spark, d):
    w = W.partitionBy("code", "y").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    x = bars_bounded(spark, d).select("code", F.year("date").cast("long").alias("y"), "date", "close").withColumn("dd", F.col("close") / F.max("close").over(w) - 1)
    return x.groupBy("code", "y").agg(F.round(F.max_by("close", "date") / F.min_by("close", "date") - 1, 6).alias("ret"), F.round(F.min("dd"), 6).alias("mdd"))


@query(f"{BOUND}, x AS (SELECT code, row_number() OVER w - 1 AS i, lead(close, 120) OVER w / close - 1 AS r FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) SELECT code, count(*) AS n, round(quantile_cont(r, 0.25), 6) AS p25, round(median(r), 6) AS p50, round(quantile_cont(r, 0.75), 6) AS p75, round(min(r), 6) AS worst, round(avg((r > 1e-12)::INTEGER), 6) AS positive FROM x WHERE i % 20 = 0 AND r IS NOT NULL GROUP BY code")
def agg_28_rolling_windows(spark, d):
    w = I.seq()
    x = bars_bounded(spark, d).select("code", (F.row_number().over(w) - 1).alias("i"), (F.lead("close", 120).over(w) / F.col("close") - 1).alias("r")).where("i % 20 = 0 and r is not null")
    return x.groupBy("code").agg(F.count("*").alias("n"), *[F.round(F.percentile("r", p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.round(F.min("r"), 6).alias("worst"), F.round(F.avg((F.col("r") > 1e-12).cast("double")), 6).alias("positive"))


@query(f"{BOUND}, s AS (SELECT code, count(*) AS n, count(*) FILTER (WHERE close > open) AS ups FROM bars GROUP BY code), t AS (SELECT code, CASE WHEN ups * 2 > n THEN 'trend' ELSE 'band' END AS algo FROM s) SELECT algo, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY algo")
def agg_15_distribution(spark, d):
    t = bars_bounded(spark, d).groupBy("code").agg(F.when(F.count_if(F.col("close") > F.col("open")) * 2 > F.count("*"), "trend").otherwise("band").alias("algo"))
    g = t.groupBy("algo").agg(F.count("*").alias("n"))
    return g.select("algo", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))  # one row an algorithm


# ---- top-k -----------------------------------------------------------------------------------------------------


@query(f"{BOUND}, {RET} SELECT date, code, rn FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY x DESC, code) AS rn FROM r WHERE x IS NOT NULL) WHERE rn <= 5")
def top_1_4_5_per_date(spark, d):
    r = returns(spark, d).where("x is not null")
    return r.select("date", "code", F.row_number().over(W.partitionBy("date").orderBy(F.desc("x"), "code")).cast("long").alias("rn")).where("rn <= 5")


@query(f"{BOUND}, {RET}, a AS (SELECT code, date, x, y, row_number() OVER (PARTITION BY code ORDER BY abs(x - 0.05), date) AS k FROM r WHERE x IS NOT NULL AND y IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(abs(x - 0.05) + abs(y) / 2, 9), date) AS rn FROM a WHERE k <= 100) SELECT code, date, rn FROM b WHERE rn <= 10")
def top_2_two_stage(spark, d):
    """A cheap distance keeps the best hundred, the dearer one ranks them."""
    r = returns(spark, d).where("x is not null and y is not null")
    cheap = F.abs(F.col("x") - 0.05)
    a = r.withColumn("k", F.row_number().over(W.partitionBy("code").orderBy(cheap, "date"))).where("k <= 100")
    rn = F.row_number().over(W.partitionBy("code").orderBy(F.round(cheap + F.abs("y") / 2, 9), "date")).cast("long")
    return a.select("code", "date", rn.alias("rn")).where("rn <= 10")


@query("SELECT p_partkey AS k, p_retailprice AS v FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_6_7_8_limit(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")).orderBy(F.desc("v"), "k").limit(25)


# ---- similarity ------------------------------------------------------------------------------------------------

_RL = "r AS (SELECT code, date, row_number() OVER w - 1 AS i, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)), v AS (SELECT code, i, list(r) OVER (PARTITION BY code ORDER BY i ROWS 9 PRECEDING) AS v FROM r WHERE i >= 1), z AS (SELECT code, i, list_transform(v, LAMBDA q: (q - list_avg(v)) / greatest(list_stddev_pop(v), 1e-12)) AS z FROM v WHERE i >= 10)"


@query(f"{BOUND}, {_RL}, l AS (SELECT code, max(i) AS m FROM z GROUP BY code) SELECT a.code, b.i, round(sqrt(list_sum(list_transform(range(1, 11), LAMBDA q: pow(a.z[q] - b.z[q], 2)))), 4) AS dist FROM z a JOIN l ON l.code = a.code AND l.m = a.i JOIN z b ON b.code = a.code AND b.i <= a.i - 10")
def sim_1_jn_9_window_distance(spark, d):
    """Distance of a code's last window of ten log returns to each earlier window that doesn't overlap it."""
    w = I.seq()
    r = bars_bounded(spark, d).select("code", (F.row_number().over(w) - 1).alias("i"), I.log_return(w).alias("r")).where("i >= 1")
    z = r.select("code", "i", F.collect_list("r").over(W.partitionBy("code").orderBy("i").rowsBetween(-9, 0)).alias("v")).where("i >= 10").select("code", "i", M.znorm(F.col("v")).alias("z"))
    last = z.groupBy("code").agg(F.max("i").alias("m"), F.max_by("z", "i").alias("q"))
    return z.join(last, "code").where("i <= m - 10").select("code", F.col("i").cast("long").alias("i"), F.round(M.distance(F.col("q"), F.col("z")), 4).alias("dist"))


def sim_5_6_sig_6_own_matches(spark, d):
    """SIM-6 for every bar; SIG-6's side on every fifth of them, with five outcomes at least."""
    m = M.own_matches(bars_bounded(spark, d), every=1)
    # The first value is that of the 17th window, so every fifth row is one of the windows 20, 25, ...
    fifth = (F.row_number().over(I.seq()) % 5 == 0) & (F.col("n") >= 5)
    return m.select("code", "date", F.round("p_up", 6).alias("p_up"), F.round("mean_next", 6).alias("mean_next"), "n", F.round("best", 4).alias("best"), F.when(fifth & (F.col("p_up") >= 0.6), "BUY").when(fifth & (F.col("p_up") <= 0.4), "SELL").alias("side"))


QUERIES["sim_5_6_sig_6_own_matches"] = sim_5_6_sig_6_own_matches


@query(f"{BOUND}, {RET} SELECT code, date, round(least(abs(ln((1 + x) / 1.05)), 2.5) * 0.6 + least(0.3 * abs(r * 100), 1.5) + CASE WHEN y IS NULL THEN 0.3 ELSE least(0.25 * abs(y * 100), 1.2) END + 1e-9, 5) AS pen FROM r WHERE x IS NOT NULL")
def sim_3_penalties(spark, d):
    r = returns(spark, d).where("x is not null")
    p = F.least(F.abs(F.ln((1 + F.col("x")) / 1.05)), F.lit(2.5)) * 0.6 + F.least(0.3 * F.abs(F.col("r") * 100), F.lit(1.5)) + F.when(F.col("y").isNull(), 0.3).otherwise(F.least(0.25 * F.abs(F.col("y") * 100), F.lit(1.2)))
    return r.select("code", "date", F.round(p + 1e-9, 5).alias("pen"))


@query()
def sim_2_extra_distance(spark, d):
    """What structure, deviation, RSI, volume change and weekly returns add to the distance of a code's last bar to
    each bar before it."""
    from tidemark.operators import matching as N

    return N.extra_of_last(bars_bounded(spark, d)).select("code", "date", F.round("extra", 6).alias("extra"))


_FUSE = f"""{BOUND}, {RET}, s AS (SELECT code, y AS v, round(CASE WHEN a <= 90 THEN 1 ELSE greatest(0.3, 1 - (a - 90) / 365 * 0.5) END, 6) AS w FROM (SELECT code, y, DATE '2001-12-31' - date AS a FROM r WHERE y IS NOT NULL AND x BETWEEN 0.0 AND 0.05)),
o AS (SELECT code, v, sum(w) AS w FROM s GROUP BY ALL), c AS (SELECT *, round(sum(w) OVER (PARTITION BY code ORDER BY v ROWS UNBOUNDED PRECEDING), 6) AS run, round(sum(w) OVER (PARTITION BY code), 6) AS al FROM o),
q AS (SELECT code, """ + ", ".join(f"min(v) FILTER (WHERE run >= {p} * al - 1e-9) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", sum(w) FILTER (WHERE v > 0) / sum(w) AS up, sum(w) AS w FROM c GROUP BY code)"


@query(_FUSE + " SELECT code, " + ", ".join(f"round(p50 + 1.3 * (p{p} - p50), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + ", round(up, 6) AS up FROM q")
def sim_9_fused_quantiles(spark, d):
    """Weighted quantiles of what followed similar days, stretched by 1.3 about the median; weight of a rise."""
    age = F.datediff(F.lit("2001-12-31").cast("date"), "date")
    w = F.round(F.when(age <= 90, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (age - 90) / 365 * 0.5)), 6)
    s = returns(spark, d).where("y is not null and x between 0.0 and 0.05").select("code", F.col("y").alias("v"), w.alias("w"))
    pts = {f"p{int(p * 100)}": p for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    q = M.weighted_quantile(s, ["code"], "v", "w", pts)
    up = s.groupBy("code").agg((F.sum(F.when(F.col("v") > 0, F.col("w"))) / F.sum("w")).alias("up"))
    m = F.col("p50")
    return q.join(up, "code").select("code", *[F.round(m + 1.3 * (F.col(p) - m), 6).alias(p) for p in pts], F.round("up", 6).alias("up"))


_POOL = f"""{BOUND}, {INSTRUMENTS_SQL}, {_RL.replace("v AS (", "y AS (SELECT code, row_number() OVER w - 1 AS i, date, round(lead(close) OVER w / close - 1, 9) AS nxt FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)), v AS (")},
peers AS (SELECT code, peer FROM (SELECT a.code, b.code AS peer, row_number() OVER (PARTITION BY a.code ORDER BY abs(ln(greatest(a.mktcap, 10)) - ln(greatest(b.mktcap, 10))), b.code) AS rn FROM inst a JOIN inst b ON a.industry = b.industry AND a.code <> b.code) WHERE rn <= 3),
w AS (SELECT z.code, z.i, z.z, y.date, y.nxt FROM z JOIN y USING (code, i)), l AS (SELECT code, max(date) AS d FROM w GROUP BY code), t AS (SELECT w.* FROM w JOIN l ON w.code = l.code AND w.date = l.d),
m AS (SELECT t.code, t.date AS d, b.date, b.nxt, round(sqrt(list_sum(list_transform(range(1, 11), LAMBDA q: pow(t.z[q] - b.z[q], 2)))), 6) AS dist, b.code AS peer FROM t JOIN peers USING (code) JOIN w b ON b.code = peers.peer AND b.date < t.date AND b.nxt IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dist, peer, date) AS rn FROM m), g AS (SELECT code, dist, nxt, CASE WHEN d - date <= 90 THEN 1.0::DOUBLE ELSE greatest(0.3::DOUBLE, 1 - (d - date - 90)::DOUBLE / 365 * 0.5) END AS wt FROM k WHERE rn <= 10)"""


@query(_POOL + " SELECT code, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(sum(wt * nxt) / sum(wt) + 1e-12, 6) END AS mean_next, round(sum(wt) FILTER (WHERE nxt > 0) / sum(wt), 6) AS p_up, round(exp(-least(median(dist), 6) / 1.25) * (0.65 + 0.35 * least(1, sqrt(count(*) / 6))), 6) AS weight, CASE WHEN count(*) >= 8 THEN 'high' WHEN count(*) >= 4 THEN 'mid' ELSE 'low' END AS confidence FROM g GROUP BY code")
def sim_4_jn_10_pool_match(spark, d):
    """What followed the ten windows of a code's peers most like its last one: peers' outcomes known by then only,
    weighed by age; the level's weight by its median distance, and how sure it is by the number of samples."""
    w = I.seq()
    b = bars_bounded(spark, d)
    r = b.select("code", "date", (F.row_number().over(w) - 1).alias("i"), I.log_return(w).alias("r"), F.round(F.lead("close").over(w) / F.col("close") - 1, 9).alias("nxt")).where("i >= 1")
    z = r.select("code", "date", "i", "nxt", F.collect_list("r").over(W.partitionBy("code").orderBy("i").rowsBetween(-9, 0)).alias("v")).where("i >= 10").select("code", "date", "nxt", M.znorm(F.col("v")).alias("z"))
    last = z.groupBy("code").agg(F.max_by(F.struct("date", "z"), "date").alias("x")).select("code", F.col("x.date").alias("d"), F.col("x.z").alias("q"))
    pool = last.join(jn_17_peers(spark, d).select("code", "peer"), "code")
    m = z.withColumnRenamed("code", "peer").where("nxt is not null").join(pool, "peer").where("date < d")
    m = m.select("code", "peer", "date", "nxt", F.datediff("d", "date").alias("age"), F.round(M.distance(F.col("q"), F.col("z")), 6).alias("dist"))
    k = m.withColumn("rn", F.row_number().over(W.partitionBy("code").orderBy("dist", "peer", "date"))).where("rn <= 10")
    g = k.withColumn("wt", F.when(F.col("age") <= 90, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (F.col("age") - 90) / 365 * 0.5)))
    n = F.count("*")
    weight = F.exp(-F.least(F.median("dist"), F.lit(6.0)) / 1.25) * (0.65 + 0.35 * F.least(F.lit(1.0), F.sqrt(n / 6)))
    return g.groupBy("code").agg(n.alias("n"), F.when(n >= 3, F.round(F.sum(F.col("wt") * F.col("nxt")) / F.sum("wt") + 1e-12, 6)).alias("mean_next"), F.round(F.sum(F.when(F.col("nxt") > 0, F.col("wt"))) / F.sum("wt"), 6).alias("p_up"), F.round(weight, 6).alias("weight"), F.when(n >= 8, "high").when(n >= 4, "mid").otherwise("low").alias("confidence"))


@query()
def sim_7_jn_17_pool_series(spark, d):
    """At every window end of a code, what followed the ten windows of its 50 nearest peers most like it."""
    from tidemark.operators import matching as N

    return N.pool_factor(bars_bounded(spark, d), N.peers_of(instruments(spark, d), "industry", 50), "l2")


@query(f"""{BOUND}, {INSTRUMENTS_SQL}, {RET}, k AS (SELECT industry, date, avg(r) AS m FROM r JOIN inst USING (code) WHERE r IS NOT NULL GROUP BY ALL), s AS (SELECT date, round(stddev_pop(m), 9) AS disp FROM k GROUP BY date HAVING count(*) >= 3),
n AS (SELECT date, disp, row_number() OVER (ORDER BY date) AS i FROM s) SELECT a.date, any_value(a.disp) AS disp, CASE WHEN any_value(a.i) >= 60 THEN round((count(*) FILTER (WHERE b.disp < a.disp) + 0.5 * count(*) FILTER (WHERE b.disp = a.disp)) / any_value(a.i) + 1e-9, 6) END AS pct FROM n a JOIN n b ON b.i <= a.i GROUP BY a.date""")
def ind_33_dispersion(spark, d):
    """Dispersion of the industries' mean returns, and its percentile (mid-rank) among all days until then, from 60
    days on. The series has one row a day, so it is ranked in one pass by insertion."""
    import bisect

    r = returns(spark, d).where("r is not null").join(instruments(spark, d).select("code", "industry"), "code")
    s = r.groupBy("industry", "date").agg(F.avg("r").alias("m")).groupBy("date").agg(F.round(F.stddev_pop("m"), 9).alias("disp"), F.count("*").alias("n")).where("n >= 3")

    def rank(pdf):
        pdf, seen, out = pdf.sort_values("date", ignore_index=True), [], []
        for x in pdf["disp"]:
            bisect.insort(seen, x)
            a, z = bisect.bisect_left(seen, x), bisect.bisect_right(seen, x)
            out.append((a + 0.5 * (z - a)) / len(seen) if len(seen) >= 60 else None)
        return pdf.assign(pct=out)[["date", "disp", "pct"]]

    return s.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(rank, "date date, disp double, pct double").withColumn("pct", F.round(F.nanvl("pct", F.lit(None).cast("double")) + 1e-9, 6))
