"""Queries for window indicators (IND), the moving-average slice, and cross-sectional ranks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import windows as I
from tidemark.plans.declare import declare
from tidemark.sources.views import BOUNDED_SQL, FACTORS_SQL, INDEX_SQL, INSTRUMENTS_SQL, RAW_SQL, bars_bounded, bars_raw, index_close, instruments

QUERIES, SQL, query = declare()
BARS = f"WITH {RAW_SQL}"
BOUND = f"WITH {BOUNDED_SQL}, bars AS (SELECT * FROM bounded)"
WIN = "WINDOW w AS (PARTITION BY code ORDER BY date)"


def _sma(x: str, n: int, skip: int = 0) -> str:
    fr = f"OVER (w ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)" if skip else f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {fr} >= {n} THEN avg({x}) {fr} END"


def _r(x: str, n: int, name: str) -> str:
    return f"round({x} + 1e-9, {n}) AS {name}"


def R(x, n: int, name: str):
    return F.round(x + 1e-9, n).alias(name)


@query(f"""{BARS}, s AS (SELECT code, date, {_sma('close', 20)} AS a, {_sma('close', 60)} AS b FROM bars {WIN}),
x AS (SELECT code, a, b, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM s {WIN})
SELECT code, count(*) FILTER (WHERE pa <= pb AND a > b) AS ups, count(*) FILTER (WHERE pa >= pb AND a < b) AS downs FROM x GROUP BY code""")
def q_ma_cross(spark, d):
    """Crossings of the 20- and 60-row averages, counted per code."""
    w = I.seq()
    s = bars_raw(spark, d).select("code", "date", I.sma(F.col("close"), 20, w).alias("a"), I.sma(F.col("close"), 60, w).alias("b"))
    x = s.select("code", I.crossed_up(F.col("a"), F.col("b"), w).alias("u"), I.crossed_down(F.col("a"), F.col("b"), w).alias("v"))
    return x.groupBy("code").agg(F.count_if("u").alias("ups"), F.count_if("v").alias("downs"))


@query(f"{BARS} SELECT code, date, {_r(_sma('close', 20), 4, 'ma20')}, {_r(_sma('close', 5, 1), 4, 'prev5')} FROM bars {WIN}")
def ind_1_2_sma(spark, d):
    w = I.seq()
    return bars_raw(spark, d).select("code", "date", R(I.sma(F.col("close"), 20, w), 4, "ma20"), R(I.sma(F.col("close"), 5, w, 1), 4, "prev5"))


_SD = "CASE WHEN count(close) OVER (w ROWS 19 PRECEDING) >= 20 THEN stddev_pop(close) OVER (w ROWS 19 PRECEDING) END"


@query(f"{BOUND}, s AS (SELECT code, date, {_sma('close', 20)} AS m, {_SD} AS sd FROM bars {WIN}) SELECT code, date, {_r('m', 4, 'mid')}, {_r('m + 2 * sd', 4, 'upper')}, {_r('m - 2 * sd', 4, 'lower')} FROM s")
def ind_8_bollinger(spark, d):
    w = I.seq()
    m, sd = I.sma(F.col("close"), 20, w), I.roll(F.stddev_pop, F.col("close"), 20, w)
    return bars_bounded(spark, d).select("code", "date", R(m, 4, "mid"), R(m + 2 * sd, 4, "upper"), R(m - 2 * sd, 4, "lower"))


@query(f"""{BOUND}, t AS (SELECT code, date, greatest(high - low, abs(high - coalesce(lag(close) OVER w, close)), abs(low - coalesce(lag(close) OVER w, close))) AS tr FROM bars {WIN})
SELECT code, date, round(CASE WHEN row_number() OVER w >= 15 THEN avg(tr) OVER (w ROWS 13 PRECEDING) ELSE 0 END + 1e-9, 4) AS atr FROM t {WIN}""")
def ind_10_atr(spark, d):
    """Mean true range of 14 bars, 0 before the 15th."""
    w = I.seq()
    t = bars_bounded(spark, d).select("code", "date", I.true_range(w).alias("tr"))
    return t.select("code", "date", R(F.when(F.row_number().over(w) >= 15, F.avg("tr").over(I.frame(w, 14))).otherwise(0.0), 4, "atr"))


_X = "CASE WHEN vol % 7 = 0 THEN NULL ELSE close END"


@query(f"""{BOUND}, t AS (SELECT code, date, {_X} AS x FROM bars)
SELECT code, date, {_r('avg(x) OVER (w ROWS 9 PRECEDING)', 4, 'mean10')}, {_r('stddev_pop(x) OVER (w ROWS 9 PRECEDING)', 4, 'std10')}, {_r("CASE WHEN count(x) OVER (w ROWS 9 PRECEDING) = 10 THEN stddev_pop(x) OVER (w ROWS 9 PRECEDING) END", 4, 'strict10')}, {_r('sum(coalesce(x, 0)) OVER (w ROWS 9 PRECEDING) / 10', 4, 'zero10')} FROM t {WIN}""")
def ind_11_12_13_missing_aware(spark, d):
    """Rolling mean and deviation over known values, over full frames only, and with the missing as zero."""
    w = I.seq()
    f = I.frame(w, 10)
    t = bars_bounded(spark, d).select("code", "date", F.when(F.col("vol") % 7 == 0, None).otherwise(F.col("close")).alias("x"))
    return t.select("code", "date", R(F.avg("x").over(f), 4, "mean10"), R(F.stddev_pop("x").over(f), 4, "std10"), R(I.roll(F.stddev_pop, F.col("x"), 10, w), 4, "strict10"), R(F.sum(F.coalesce("x", F.lit(0.0))).over(f) / 10, 4, "zero10"))


@query(f"""{BARS} SELECT code, count(*) FILTER (WHERE c) AS crosses, sum(up5) AS ups, {_r('avg(l)', 4, 'low5')} FROM (SELECT code, coalesce(lag(close) OVER w < lag(open) OVER w AND close > open, false) AS c,
 sum((close > open)::INTEGER) OVER (w ROWS 4 PRECEDING) AS up5, CASE WHEN count(low) OVER (w ROWS 4 PRECEDING) = 5 THEN min(low) OVER (w ROWS 4 PRECEDING) END AS l FROM bars {WIN}) GROUP BY code""")
def ind_14_formula_functions(spark, d):
    """REF, LLV, COUNT and strict CROSS as columns."""
    w = I.seq()
    up = (F.col("close") > F.col("open")).cast("int")
    x = bars_raw(spark, d).select("code", I.cross_strict(F.col("close"), F.col("open"), w).alias("c"), F.sum(up).over(I.frame(w, 5)).alias("u"), I.roll(F.min, F.col("low"), 5, w).alias("l"))
    return x.groupBy("code").agg(F.count_if("c").alias("crosses"), F.sum("u").alias("ups"), R(F.avg("l"), 4, "low5"))


@query(f"""{BOUND}, r AS (SELECT code, date, close, close / lag(close) OVER w - 1 AS r, ln(close / lag(close) OVER w) AS lr, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars {WIN}),
c AS (SELECT code, count(*) AS n FROM bars GROUP BY code)
SELECT code, CASE WHEN n < 30 OR count(lr) < 20 THEN NULL ELSE round(stddev_samp(lr) * sqrt(252), 5) END AS annual_vol FROM r JOIN c USING (code) WHERE rn <= 250 GROUP BY code, n""")
def ind_21_annualised_vol(spark, d):
    w = I.seq()
    r = bars_bounded(spark, d).select("code", "date", I.log_return(w).alias("lr"), F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))).alias("rn"), F.count("*").over(W.partitionBy("code")).alias("n")).where("rn <= 250")
    return r.groupBy("code").agg(F.when((F.max("n") >= 30) & (F.count("lr") >= 20), F.round(F.stddev_samp("lr") * F.sqrt(F.lit(252)), 5)).alias("annual_vol"))


def tier_features(bars, idx):
    """code, date, close, ret20, vol20, amt20, n, beta60 to the index (at least 48 pairs, else null)."""
    w = I.seq()
    b = bars.withColumn("r", I.change(F.col("close"), 1, w))
    i = idx.select("date", (F.col("idx") / F.lag("idx").over(W.orderBy("date")) - 1).alias("ir"))  # one row a day
    x = b.join(F.broadcast(i), "date", "left")
    f = I.frame(w, 60)
    pair = F.col("r").isNotNull() & F.col("ir").isNotNull()
    a, c = F.when(pair, F.col("r")), F.when(pair, F.col("ir"))
    enough = (F.sum(pair.cast("int")).over(f) >= 48) & (F.var_pop(c).over(f) > 1e-12)
    return x.select("code", "date", "close", I.change(F.col("close"), 20, w).alias("ret20"), F.stddev_pop("r").over(I.frame(w, 20)).alias("vol20"), F.avg(F.col("vol") * F.col("close")).over(I.frame(w, 20)).alias("amt20"), F.row_number().over(w).alias("n"), F.when(enough, F.covar_pop(a, c).over(f) / F.var_pop(c).over(f)).alias("beta60"))


@query(f"""{BOUND}, {INDEX_SQL}, i AS (SELECT date, idx / lag(idx) OVER (ORDER BY date) - 1 AS ir FROM idx), b AS (SELECT *, close / lag(close) OVER w - 1 AS r FROM bars {WIN}),
x AS (SELECT b.*, ir, CASE WHEN r IS NOT NULL AND ir IS NOT NULL THEN r END AS a, CASE WHEN r IS NOT NULL AND ir IS NOT NULL THEN ir END AS c FROM b LEFT JOIN i USING (date))
SELECT code, date, {_r('close / lag(close, 20) OVER w - 1', 4, 'ret20')}, {_r('stddev_pop(r) OVER (w ROWS 19 PRECEDING)', 5, 'vol20')}, {_r('avg(vol * close) OVER (w ROWS 19 PRECEDING)', 3, 'amt20')}, row_number() OVER w AS n,
 {_r('CASE WHEN count(a) OVER (w ROWS 59 PRECEDING) >= 48 AND var_pop(c) OVER (w ROWS 59 PRECEDING) > 1e-12 THEN covar_pop(a, c) OVER (w ROWS 59 PRECEDING) / var_pop(c) OVER (w ROWS 59 PRECEDING) END', 4, 'beta60')} FROM x {WIN}""")
def ind_22_tier_features(spark, d):
    b = bars_bounded(spark, d)
    t = tier_features(b, index_close(b))
    return t.select("code", "date", R(F.col("ret20"), 4, "ret20"), R(F.col("vol20"), 5, "vol20"), R(F.col("amt20"), 3, "amt20"), F.col("n").cast("long").alias("n"), R(F.col("beta60"), 4, "beta60"))


@query(f"""{BOUND}, {INSTRUMENTS_SQL}, t AS (SELECT b.*, industry, close / lag(close) OVER (PARTITION BY b.code ORDER BY date) - 1 AS r FROM bars b JOIN inst USING (code)),
m AS (SELECT date, avg(r) AS m FROM t GROUP BY date), k AS (SELECT industry, date, avg(r) AS m FROM t GROUP BY industry, date),
m5 AS (SELECT date, avg(m) OVER (ORDER BY date ROWS 4 PRECEDING) AS mkt5 FROM m), k5 AS (SELECT industry, date, avg(m) OVER (PARTITION BY industry ORDER BY date ROWS 4 PRECEDING) AS ind5 FROM k),
f AS (SELECT code, date, industry, close / nullif({_sma('close', 20)}, 0) - 1 AS bias20, close / nullif({_sma('close', 60)}, 0) - 1 AS bias60, close / lag(close, 5) OVER w - 1 AS ret5, close / lag(close, 10) OVER w - 1 AS ret10, close / lag(close, 20) OVER w - 1 AS ret20,
 avg(vol) OVER (w ROWS 4 PRECEDING) / nullif({_sma('vol', 20)}, 0) - 1 AS volchg, CASE WHEN count(r) OVER (w ROWS 19 PRECEDING) >= 20 THEN stddev_pop(r) OVER (w ROWS 19 PRECEDING) END AS vola20 FROM t {WIN})
SELECT code, date, {', '.join(_r(c, 4, c) for c in ('bias20', 'bias60', 'ret5', 'ret10', 'ret20', 'volchg', 'vola20', 'mkt5', 'ind5'))} FROM f LEFT JOIN m5 USING (date) LEFT JOIN k5 USING (industry, date)""")
def ind_23_24_25_26_ml_factors(spark, d):
    """Window factors per code beside the five-day means of market and industry."""
    w, W5 = I.seq(), lambda *p: W.partitionBy(*p).orderBy("date").rowsBetween(-4, 0)
    t = bars_bounded(spark, d).join(instruments(spark, d).select("code", "industry"), "code").withColumn("r", I.change(F.col("close"), 1, w))
    k = t.groupBy("industry", "date").agg(F.avg("r").alias("m"), F.sum("r").alias("s"), F.count("r").alias("c"))
    m = k.groupBy("date").agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
    m5 = m.select("date", F.avg("m").over(W.orderBy("date").rowsBetween(-4, 0)).alias("mkt5"))  # one row a day
    k5 = k.select("industry", "date", F.avg("m").over(W5("industry")).alias("ind5"))
    c, v = F.col("close"), F.col("vol")
    f = t.select("code", "date", "industry", (c / I.sma(c, 20, w) - 1).alias("bias20"), (c / I.sma(c, 60, w) - 1).alias("bias60"), *[I.change(c, n, w).alias(f"ret{n}") for n in (5, 10, 20)], (F.avg(v).over(I.frame(w, 5)) / I.sma(v, 20, w) - 1).alias("volchg"), I.roll(F.stddev_pop, F.col("r"), 20, w).alias("vola20"))
    j = f.join(F.broadcast(m5), "date", "left").join(k5, ["industry", "date"], "left")
    return j.select("code", "date", *[R(F.col(x), 4, x) for x in ("bias20", "bias60", "ret5", "ret10", "ret20", "volchg", "vola20", "mkt5", "ind5")])


@query(f"""{BOUND}, {INDEX_SQL}, g AS (SELECT date, idx, CASE WHEN count(*) OVER (ORDER BY date ROWS 19 PRECEDING) >= 20 THEN avg(idx) OVER (ORDER BY date ROWS 19 PRECEDING) END AS ma, CASE WHEN count(*) OVER (ORDER BY date ROWS 119 PRECEDING) >= 120 THEN avg(idx) OVER (ORDER BY date ROWS 119 PRECEDING) END AS ma120, idx / lag(idx) OVER (ORDER BY date) - 1 AS r FROM idx)
SELECT date, coalesce(lag(idx) OVER (ORDER BY date) > lag(ma) OVER (ORDER BY date), false) AS gate, coalesce(avg(r) OVER (ORDER BY date ROWS 4 PRECEDING) < -0.002 AND count(r) OVER (ORDER BY date ROWS 4 PRECEDING) >= 3, false) AS weak, CASE WHEN ma120 IS NULL THEN '?' WHEN idx >= ma120 THEN 'bull' ELSE 'bear' END AS regime FROM g""")
def ind_28_29_30_gates(spark, d):
    """Of the index: yesterday above its average, a weak run of five returns, bull or bear by the 120-day average."""
    w = W.orderBy("date")  # one row a day
    n = lambda k: w.rowsBetween(1 - k, 0)
    g = index_close(bars_bounded(spark, d)).select("date", "idx", *[F.when(F.count("*").over(n(k)) >= k, F.avg("idx").over(n(k))).alias(f"ma{k}") for k in (20, 120)], (F.col("idx") / F.lag("idx").over(w) - 1).alias("r"))
    gate = F.coalesce(F.lag("idx").over(w) > F.lag("ma20").over(w), F.lit(False))
    weak = F.coalesce((F.avg("r").over(n(5)) < -0.002) & (F.count("r").over(n(5)) >= 3), F.lit(False))
    return g.select("date", gate.alias("gate"), weak.alias("weak"), F.when(F.col("ma120").isNull(), "?").when(F.col("idx") >= F.col("ma120"), "bull").otherwise("bear").alias("regime"))


@query(f"""{BOUND}, s AS (SELECT code, date, close, {_sma('close', 20)} AS m FROM bars {WIN}), x AS (SELECT code, date, close, m, lag(m, 10) OVER w AS m10 FROM s {WIN})
SELECT code, count(*) FILTER (WHERE abs(m / m10 - 1) < 0.0149 AND abs(close / m - 1) <= 0.0299) AS swing FROM x GROUP BY code""")
def ind_31_swing_state(spark, d):
    w = I.seq()
    s = bars_bounded(spark, d).select("code", "date", "close", I.sma(F.col("close"), 20, w).alias("m")).withColumn("m10", F.lag("m", 10).over(w))
    return s.groupBy("code").agg(F.count_if((F.abs(F.col("m") / F.col("m10") - 1) < 0.0149) & (F.abs(F.col("close") / F.col("m") - 1) <= 0.0299)).alias("swing"))


@query(f"{BARS} SELECT code, date, lag(close) OVER w AS close_m, coalesce(lag(CAST(vol AS INTEGER)) OVER w, -1) AS vol_m, coalesce(lag(close > open) OVER w, false) AS up_m FROM bars {WIN}")
def ind_32_morning_view(spark, d):
    """Decision columns as known in the morning: shifted by one, floats to null, integers to -1, flags to false."""
    w = I.seq()
    return bars_raw(spark, d).select("code", "date", F.lag("close").over(w).alias("close_m"), F.lag(F.col("vol").cast("int"), 1, -1).over(w).alias("vol_m"), F.lag(F.col("close") > F.col("open"), 1, False).over(w).alias("up_m"))


@query(f"""{BOUND}, {INSTRUMENTS_SQL}, t AS (SELECT industry, date, close / lag(close) OVER (PARTITION BY b.code ORDER BY date) - 1 AS r FROM bars b JOIN inst USING (code)),
k AS (SELECT industry, date, avg(r) AS m FROM t WHERE r IS NOT NULL GROUP BY ALL), k5 AS (SELECT industry, date, round(avg(m) OVER (PARTITION BY industry ORDER BY date ROWS 4 PRECEDING), 9) AS m5 FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY m5, industry) AS i, count(*) OVER (PARTITION BY date) AS n FROM k5)
SELECT industry, date, CASE WHEN n >= 3 THEN round((i - 1) / (n - 1), 6) END AS rot FROM p""")
def ind_33_rotation(spark, d):
    """Rank of an industry's five-day mean return among the industries of the day (at least three)."""
    t = bars_bounded(spark, d).join(instruments(spark, d).select("code", "industry"), "code").select("industry", "date", I.change(F.col("close"), 1, I.seq()).alias("r")).where("r is not null")
    k = t.groupBy("industry", "date").agg(F.avg("r").alias("m"))
    k5 = k.select("industry", "date", F.round(F.avg("m").over(W.partitionBy("industry").orderBy("date").rowsBetween(-4, 0)), 9).alias("m5"))
    return k5.select("industry", "date", F.round(I.rank01("m5", ["date"], "industry", 3), 6).alias("rot"))


@query(f"""{BOUND}, f AS (SELECT code, date, round(close / lag(close, 20) OVER w - 1, 9) AS x FROM bars {WIN}), g AS (SELECT *, count(x) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date, x IS NULL ORDER BY x, code) AS i, avg(x) OVER (PARTITION BY date) AS m, stddev_pop(x) OVER (PARTITION BY date) AS s FROM f)
SELECT code, date, CASE WHEN x IS NOT NULL AND n >= 6 THEN round((i - 1) / (n - 1), 6) END AS rnk, CASE WHEN n >= 6 AND x IS NOT NULL THEN round(CASE WHEN s <= 1e-12 THEN 0 ELSE least(greatest((x - m) / s, -3.5), 3.5) END, 4) END AS z FROM g""")
def ind_34_35_cross_section(spark, d):
    """Rank in [0, 1] and clipped z-score of the 20-day return among the codes of a day."""
    f = bars_bounded(spark, d).select("code", "date", F.round(I.change(F.col("close"), 20, I.seq()), 9).alias("x"))
    w = W.partitionBy("date")
    n, m, s = F.count("x").over(w), F.avg("x").over(w), F.stddev_pop("x").over(w)
    z = F.when(s <= 1e-12, 0.0).otherwise(F.least(F.greatest((F.col("x") - m) / F.when(s > 1e-12, s), F.lit(-3.5)), F.lit(3.5)))
    return f.select("code", "date", F.round(I.rank01("x", ["date"], "code"), 6).alias("rnk"), F.round(F.when((n >= 6) & F.col("x").isNotNull(), z), 4).alias("z"))


@query(f"""{BOUND}, f AS (SELECT code, date, round(close / lag(close, 20) OVER w - 1, 9) AS a, round(close / lag(close, 5) OVER w - 1, 9) AS b, round(vol / 10, 9) AS c FROM bars {WIN}),
g AS (SELECT code, date, {', '.join(f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY date) >= 10 THEN (row_number() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}, code) - 1) / (count({x}) OVER (PARTITION BY date) - 1) END AS r{x}" for x in 'abc')} FROM f)
SELECT code, date, round((coalesce(ra, 0) + coalesce(rb, 0) + coalesce(rc, 0)) / nullif((ra IS NOT NULL)::INTEGER + (rb IS NOT NULL)::INTEGER + (rc IS NOT NULL)::INTEGER, 0) + 1e-9, 5) AS ens FROM g""")
def ind_36_rank_ensemble(spark, d):
    """Mean of the ranks that are there, each over at least ten values."""
    w = I.seq()
    f = bars_bounded(spark, d).select("code", "date", F.round(I.change(F.col("close"), 20, w), 9).alias("a"), F.round(I.change(F.col("close"), 5, w), 9).alias("b"), F.round(F.col("vol") / 10, 9).alias("c"))
    g = f.select("code", "date", F.array_compact(F.array(*[I.rank01(x, ["date"], "code", 10) for x in "abc"])).alias("r"))
    return g.select("code", "date", F.round(F.when(F.size("r") > 0, F.aggregate("r", F.lit(0.0), lambda s, x: s + x) / F.size("r")) + 1e-9, 5).alias("ens"))


@query(f"""{BOUND}, x AS (SELECT code, date, close, close / lag(close) OVER w - 1 AS r, {_sma('close', 20)} AS m20, {_sma('close', 60)} AS m60, row_number() OVER w AS i, count(*) OVER (PARTITION BY code) AS n FROM bars {WIN}),
y AS (SELECT code, i, n, close, m20, m60, stddev_samp(r) OVER (w ROWS 19 PRECEDING) AS sd, avg(abs(r)) OVER (w ROWS 19 PRECEDING) AS act, first_value(close) OVER (w ROWS 59 PRECEDING) AS c60 FROM (SELECT *, row_number() OVER w AS k, date AS d2 FROM x {WIN}) {WIN})
SELECT code, n, round(CASE WHEN n < 60 THEN 50 ELSE CASE WHEN sd BETWEEN 0.01 AND 0.04 THEN 25 WHEN sd BETWEEN 0.005 AND 0.06 THEN 15 ELSE 5 END + CASE WHEN close > m20 AND m20 > m60 THEN 30 WHEN close > m20 THEN 20 ELSE 8 END + least(25, act * 1000) + CASE WHEN close / c60 > 1 THEN 20 ELSE 8 END END, 3) AS score FROM y WHERE i = n""")
def ind_20_band_fit(spark, d):
    """A score of 0 to 100 at each code's last bar from volatility, trend, activity and the longer trend."""
    w = I.seq()
    x = bars_bounded(spark, d).withColumn("r", I.change(F.col("close"), 1, w))
    c = F.col("close")
    y = x.select("code", "close", F.row_number().over(w).alias("i"), F.count("*").over(W.partitionBy("code")).alias("n"), I.sma(c, 20, w).alias("m20"), I.sma(c, 60, w).alias("m60"), F.stddev_samp("r").over(I.frame(w, 20)).alias("sd"), F.avg(F.abs("r")).over(I.frame(w, 20)).alias("act"), F.first("close").over(I.frame(w, 60)).alias("c60")).where("i = n")
    sd = F.when(F.col("sd").between(0.01, 0.04), 25).when(F.col("sd").between(0.005, 0.06), 15).otherwise(5)
    trend = F.when((c > F.col("m20")) & (F.col("m20") > F.col("m60")), 30).when(c > F.col("m20"), 20).otherwise(8)
    score = sd + trend + F.least(F.lit(25.0), F.col("act") * 1000) + F.when(c / F.col("c60") > 1, 20).otherwise(8)
    return y.select("code", "n", F.round(F.when(F.col("n") < 60, 50.0).otherwise(score), 3).alias("score"))
