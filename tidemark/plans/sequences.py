"""Queries for recursive indicators, chip distributions and signals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import recursive as R
from tidemark.operators import signals as S
from tidemark.operators import windows as I
from tidemark.plans.declare import declare
from tidemark.sources.views import BOUNDED_SQL, INDEX_SQL, INSTRUMENTS_SQL, bars_bounded, index_close, instruments

QUERIES, SQL, query = declare()
BOUND = f"WITH RECURSIVE {BOUNDED_SQL}, bars AS (SELECT * FROM bounded), b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM bars)"


def rnd(*cols: str, n: int = 3):
    return [F.round(F.col(c) + 1e-9, n).alias(c) for c in cols]


def srnd(*cols: str, n: int = 3) -> str:
    return ", ".join(f"round({c} + 1e-9, {n}) AS {c}" for c in cols)


EMA = f"""{BOUND}, e AS (SELECT code, date, i, close AS e12, close AS e26, 0.0::DOUBLE AS dif, 0.0::DOUBLE AS dea FROM b WHERE i = 1 UNION ALL
 SELECT b.code, b.date, b.i, e12 + (close - e12) * 2 / 13, e26 + (close - e26) * 2 / 27, (e12 + (close - e12) * 2 / 13) - (e26 + (close - e26) * 2 / 27), dea + ((e12 + (close - e12) * 2 / 13) - (e26 + (close - e26) * 2 / 27) - dea) * 2 / 10
 FROM e JOIN b ON b.code = e.code AND b.i = e.i + 1)"""


@query(EMA + f" SELECT code, date, round(e12 + 1e-9, 3) AS ema12, round(dif + 1e-9, 3) AS dif, CASE WHEN i > 8 THEN round(dea + 1e-9, 3) END AS dea, CASE WHEN i > 8 THEN round(2 * (dif - dea) + 1e-9, 3) END AS hist FROM e")
def ind_3_5_ema_macd(spark, d):
    return R.with_recursive(bars_bounded(spark, d)).select("code", "date", *rnd("ema12", "dif", "dea", "hist"))


KDJ = f"""{BOUND}, v AS (SELECT code, date, i, CASE WHEN max(high) OVER x > min(low) OVER x THEN (close - min(low) OVER x) / nullif(max(high) OVER x - min(low) OVER x, 0) * 100 ELSE 50 END AS rsv FROM b WINDOW x AS (PARTITION BY code ORDER BY date ROWS 8 PRECEDING)),
k AS (SELECT code, 0::BIGINT AS i, NULL::DATE AS date, 50.0::DOUBLE AS k, 50.0::DOUBLE AS d FROM (SELECT DISTINCT code FROM b) UNION ALL
 SELECT v.code, v.i, v.date, k.k * 2 / 3 + rsv / 3, k.d * 2 / 3 + (k.k * 2 / 3 + rsv / 3) / 3 FROM k JOIN v ON v.code = k.code AND v.i = k.i + 1)"""


@query(KDJ + f" SELECT code, date, {srnd('k', 'd')}, round(3 * k - 2 * d + 1e-9, 3) AS j FROM k WHERE i > 0")
def ind_6_kdj(spark, d):
    return R.with_recursive(bars_bounded(spark, d)).select("code", "date", *rnd("k", "d", "j"))


RSI = f"""{BOUND}, m AS (SELECT code, date, i, greatest(close - lag(close) OVER w, 0) AS g, greatest(lag(close) OVER w - close, 0) AS l FROM b WINDOW w AS (PARTITION BY code ORDER BY date)),
s AS (SELECT code, 15::BIGINT AS i, avg(g) AS g, avg(l) AS l FROM m WHERE i BETWEEN 2 AND 15 GROUP BY code HAVING count(*) = 14),
r AS (SELECT code, i, g, l FROM s UNION ALL SELECT m.code, m.i, (r.g * 13 + m.g) / 14, (r.l * 13 + m.l) / 14 FROM r JOIN m ON m.code = r.code AND m.i = r.i + 1)"""


@query(RSI + " SELECT m.code, m.date, round(CASE WHEN r.i IS NULL THEN NULL WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / nullif(r.l, 0)) END + 1e-9, 3) AS rsi14 FROM m LEFT JOIN r ON r.code = m.code AND r.i = m.i")
def ind_7_rsi(spark, d):
    return R.with_recursive(bars_bounded(spark, d)).select("code", "date", *rnd("rsi14"))


def ind_9_adx(spark, d):
    return R.with_recursive(bars_bounded(spark, d)).select("code", "date", *rnd("pdi", "mdi", "adx"))


def ind_4_15_bottom_fishing(spark, d):
    """EMA with resets over a gappy ratio to long averages, and the composite that buys when it turns up from below."""
    import pandas as pd

    w = I.seq()
    b = bars_bounded(spark, d)
    c = F.col("close")
    v1 = I.sma(c, 80, w) - I.sma(c, 13, w) / 3
    x = b.select("code", "date", "close", F.try_divide(c - v1, v1).alias("v2"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        return pdf.assign(fast=R.ema_reset(pdf["v2"].to_numpy(float), 3), slow=R.ema_reset(pdf["v2"].to_numpy(float), 8))[["code", "date", "close", "v2", "fast", "slow"]]

    e = x.groupBy("code").applyInPandas(run, "code long, date date, close double, v2 double, fast double, slow double").withColumns({k: F.nanvl(k, F.lit(None).cast("double")) for k in ("fast", "slow", "v2")})
    hit = I.cross_strict(F.col("fast"), F.col("slow"), w)
    near = F.col("close") <= F.min("close").over(I.frame(w, 20)) * 1.02
    return _bottom(e, hit, near, w)


def _bottom(e, hit, near, w):
    y = e.withColumns({"buy": hit, "near_bottom": near})
    first = F.col("near_bottom") & ~F.coalesce(F.lag("near_bottom").over(w), F.lit(False))
    return y.select("code", "date", *rnd("v2", "fast", "slow", n=6), "buy", "near_bottom", first.alias("first_bottom"), (F.col("buy") & F.col("near_bottom")).alias("bottom_fish"))


def ind_17_19_chips(spark, d):
    return R.chip_summary(bars_bounded(spark, d)).select("code", *rnd("avg_cost", "profit", "p5", "p95", "sup", "res", "cur", n=6))


def ind_18_chip_snapshots(spark, d):
    return R.chip_snapshots(bars_bounded(spark, d)).select("code", "date", *rnd("sup", "res", "profit", n=6))


def signals(spark, d):
    return S.signal_columns(R.with_recursive(bars_bounded(spark, d)))


_M = "x AS (SELECT code, date, i, dif, CASE WHEN i > 8 THEN dea END AS dea, lag(dif) OVER w AS pd, lag(CASE WHEN i > 8 THEN dea END) OVER w AS pe FROM e WINDOW w AS (PARTITION BY code ORDER BY date))"


@query(EMA + f", {_M} SELECT code, date, CASE WHEN dif > dea THEN 'BUY' ELSE 'SELL' END AS side FROM x WHERE i > 9 AND ((pd <= pe AND dif > dea) OR (pd >= pe AND dif < dea))")
def sig_1_macd(spark, d):
    return signals(spark, d).where("sig_macd is not null").select("code", "date", F.col("sig_macd").alias("side"))


_K = "x AS (SELECT code, date, i, k, d, lag(k) OVER w AS pk, lag(d) OVER w AS pd FROM k WHERE i > 0 WINDOW w AS (PARTITION BY code ORDER BY date))"


@query(KDJ + f", {_K} SELECT code, date, CASE WHEN k > d THEN 'BUY' ELSE 'SELL' END AS side FROM x WHERE i > 3 AND ((pk <= pd AND k > d AND k < 45) OR (pk >= pd AND k < d AND k > 65))")
def sig_2_kdj(spark, d):
    return signals(spark, d).where("sig_kdj is not null").select("code", "date", F.col("sig_kdj").alias("side"))


def _win(n: int, f: str = "avg") -> str:
    return f"CASE WHEN count(close) OVER (w ROWS {n - 1} PRECEDING) >= {n} THEN {f}(close) OVER (w ROWS {n - 1} PRECEDING) END"


@query(f"""WITH {BOUNDED_SQL}, s AS (SELECT code, date, close, {_win(20)} AS m, {_win(20, 'stddev_pop')} AS sd FROM bounded WINDOW w AS (PARTITION BY code ORDER BY date)),
x AS (SELECT code, date, close, m - 2 * sd AS lo, m + 2 * sd AS up, lag(close) OVER w AS pc, lag(m - 2 * sd) OVER w AS plo, lag(m + 2 * sd) OVER w AS pup FROM s WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, CASE WHEN pc <= plo AND close > lo THEN 'BUY' ELSE 'SELL' END AS side FROM x WHERE (pc <= plo AND close > lo) OR (pc >= pup AND close < up)""")
def sig_4_boll(spark, d):
    w = I.seq()
    c = F.col("close")
    m, sd = I.sma(c, 20, w), I.roll(F.stddev_pop, c, 20, w)
    x = bars_bounded(spark, d).select("code", "date", "close", (m - 2 * sd).alias("lo"), (m + 2 * sd).alias("up"))
    s = S.side((F.lag("close").over(w) <= F.lag("lo").over(w)) & (c > F.col("lo")), (F.lag("close").over(w) >= F.lag("up").over(w)) & (c < F.col("up")))
    return x.select("code", "date", s.alias("side")).where("side is not null")


@query(f"""WITH {BOUNDED_SQL}, s AS (SELECT code, date, row_number() OVER w - 1 AS i, round({_win(20)}, 9) AS a, round({_win(60)}, 9) AS b FROM bounded WINDOW w AS (PARTITION BY code ORDER BY date)),
x AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM s WINDOW w AS (PARTITION BY code ORDER BY date)), e AS (SELECT code, date, CASE WHEN pa <= pb AND a > b THEN 'BUY' WHEN pa >= pb AND a < b THEN 'SELL' END AS side FROM x WHERE i >= 60)
SELECT code, date, side FROM (SELECT *, lag(side) OVER (PARTITION BY code ORDER BY date) AS p FROM e WHERE side IS NOT NULL) WHERE p IS DISTINCT FROM side""")
def sig_5_ma_trend(spark, d):
    w = I.seq()
    s = bars_bounded(spark, d).select("code", "date", (F.row_number().over(w) - 1).alias("i"), F.round(I.sma(F.col("close"), 20, w), 9).alias("a"), F.round(I.sma(F.col("close"), 60, w), 9).alias("b"))
    e = s.select("code", "date", "i", S.side(I.crossed_up(F.col("a"), F.col("b"), w), I.crossed_down(F.col("a"), F.col("b"), w)).alias("side")).where("i >= 60 and side is not null")
    return S.drop_repeats(e, ["code"], "date", "side").select("code", "date", "side")


SECTOR = f"""WITH {BOUNDED_SQL}, {INSTRUMENTS_SQL}, t AS (SELECT b.code, industry, date, close / lag(close) OVER w - 1 AS r, close / lag(close, 5) OVER w - 1 AS r5, row_number() OVER w - 1 AS i FROM bounded b JOIN inst USING (code) WINDOW w AS (PARTITION BY b.code ORDER BY date)),
k AS (SELECT industry, date, avg(r) AS m FROM t WHERE r IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), l AS (SELECT industry, date, exp(sum(ln(1 + m)) OVER w) AS lvl, row_number() OVER w AS j, round(avg(m) OVER (w ROWS 4 PRECEDING), 9) AS mom FROM k WINDOW w AS (PARTITION BY industry ORDER BY date)),
q AS (SELECT *, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) >= 20 THEN avg(lvl) OVER (w ROWS 19 PRECEDING) END AS ma FROM l WINDOW w AS (PARTITION BY industry ORDER BY date)), md AS (SELECT date, round(median(mom), 9) AS md FROM q GROUP BY date)"""


def sector(bars, inst):
    """industry, date, lvl (compounded mean return of at least 3 members), mom (five-row mean), ma (20 rows), md (median of the day)."""
    w = I.seq("industry")
    t = bars.join(inst.select("code", "industry"), "code").select("industry", "date", I.change(F.col("close"), 1, I.seq()).alias("r")).where("r is not null")
    k = t.groupBy("industry", "date").agg(F.avg("r").alias("m"), F.count("r").alias("n")).where("n >= 3")
    q = k.select("industry", "date", F.exp(F.sum(F.log1p("m")).over(w.rowsBetween(W.unboundedPreceding, 0))).alias("lvl"), F.round(F.avg("m").over(w.rowsBetween(-4, 0)), 9).alias("mom"))
    q = q.withColumn("ma", I.sma(F.col("lvl"), 20, w))
    md = q.groupBy("date").agg(F.round(F.median("mom"), 9).alias("md"))
    return q.join(md, "date")


@query(SECTOR + " SELECT industry, date, round(lvl, 4) AS lvl, round(mom, 6) AS mom, round(md, 6) AS md FROM q JOIN md USING (date)")
def agg_4_5_sector_series(spark, d):
    return sector(bars_bounded(spark, d), instruments(spark, d)).select("industry", "date", F.round("lvl", 4).alias("lvl"), F.round("mom", 6).alias("mom"), F.round("md", 6).alias("md"))


@query(SECTOR + """ SELECT t.code, date, CASE WHEN lvl > ma AND mom > 0 THEN 'BUY' WHEN lvl < ma AND mom < 0 THEN 'SELL' END AS side FROM t JOIN q USING (industry, date) WHERE i >= 5 AND (i - 5) % 3 = 0 AND j > 20 AND ((lvl > ma AND mom > 0) OR (lvl < ma AND mom < 0))""")
def sig_7_l2_industry(spark, d):
    w = I.seq()
    b, inst = bars_bounded(spark, d), instruments(spark, d)
    q = sector(b, inst).withColumn("j", F.row_number().over(I.seq("industry")))
    t = b.join(inst.select("code", "industry"), "code").select("code", "industry", "date", (F.row_number().over(w) - 1).alias("i"))
    x = t.join(q, ["industry", "date"]).where("i >= 5 and (i - 5) % 3 = 0 and j > 20")
    s = S.side((F.col("lvl") > F.col("ma")) & (F.col("mom") > 0), (F.col("lvl") < F.col("ma")) & (F.col("mom") < 0))
    return x.select("code", "date", s.alias("side")).where("side is not null")


@query(SECTOR + """ SELECT t.code, date, CASE WHEN mom > md AND round(r5, 9) > 0.0101 THEN 'BUY' ELSE 'SELL' END AS side FROM t JOIN q USING (industry, date) JOIN md USING (date) WHERE i >= 5 AND (i - 5) % 3 = 0 AND ((mom > md AND round(r5, 9) > 0.0101) OR (mom < md AND round(r5, 9) < 0))""")
def sig_9_sector_rotation(spark, d):
    w = I.seq()
    b, inst = bars_bounded(spark, d), instruments(spark, d)
    t = b.join(inst.select("code", "industry"), "code").select("code", "industry", "date", (F.row_number().over(w) - 1).alias("i"), F.round(I.change(F.col("close"), 5, w), 9).alias("r5"))
    x = t.join(sector(b, inst), ["industry", "date"]).where("i >= 5 and (i - 5) % 3 = 0")
    s = S.side((F.col("mom") > F.col("md")) & (F.col("r5") > 0.0101), (F.col("mom") < F.col("md")) & (F.col("r5") < 0))
    return x.select("code", "date", s.alias("side")).where("side is not null")


def sig_8_chip_peak(spark, d):
    """From the chip features of each bar: mostly loss and near support buys, mostly profit sells."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        s = S.chip_side(*[pdf[x].to_numpy(float) for x in ("low", "high", "close", "vol")])
        return pd.DataFrame({"code": pdf["code"], "date": pdf["date"], "side": pd.Series(s).map({1: "BUY", -1: "SELL"})})[s != 0]

    return bars_bounded(spark, d).groupBy("code").applyInPandas(run, "code long, date date, side string")


def _scored(spark, d):
    return S.score(signals(spark, d))


def sig_10_12_composite(spark, d):
    b = bars_bounded(spark, d)
    r = index_close(b).select("date", (F.col("idx") / F.lag("idx").over(W.orderBy("date")) - 1).alias("r"))  # one row a day
    return S.composite(_scored(spark, d), r.where("r < -0.015"))


def sig_13_14_band_router(spark, d):
    """Composite events where the score of a code's fit is at least 60, else moving-average trend events."""
    from tidemark.plans.indicators import ind_20_band_fit

    fit = ind_20_band_fit(spark, d).select("code", (F.col("score") >= 60).alias("band"))
    comp = S.composite(_scored(spark, d)).where("preset = 'balanced'").select("code", "date", "side", F.lit(True).alias("band"))
    trend = sig_5_ma_trend(spark, d).select("code", "date", "side", F.lit(False).alias("band"))
    return comp.union(trend).join(fit, ["code", "band"], "left_semi").select("code", "date", "side", "band")


def sig_15_16_daily_picks(spark, d):
    """The latest day's codes above both averages by score, best first, at most 20."""
    x = _scored(spark, d)
    last = x.groupBy("code").agg(F.max_by(F.struct("date", "score", "close", "m20", "m60"), "date").alias("x")).select("code", "x.*")
    ok = last.where("close >= 2 and close > m20 and m20 > m60 and score >= 1")
    return ok.orderBy(F.desc("score"), "code").limit(20).select("code", "date", "score")


def sig_17_verdict(spark, d):
    x = _scored(spark, d)
    last = x.groupBy("code").agg(F.max_by("score", "date").alias("score"))
    v = F.when(F.col("score") >= 4, "strong buy").when(F.col("score") >= 2, "buy").when(F.col("score") <= -4, "strong sell").when(F.col("score") <= -2, "sell").otherwise("hold")
    return last.select("code", "score", v.alias("verdict"))


def sig_18_19_scan(spark, d):
    """Per code, the newest of its last 30 bars with any signal; the first rule by priority gives the side."""
    x = signals(spark, d).withColumn("back", F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))) - 1).where("back < 30")
    ev = x.withColumn("side", F.coalesce("sig_macd", "sig_kdj", "sig_rsi")).where("side is not null")
    return ev.groupBy("code").agg(F.max_by(F.struct("date", "side", "back", "close"), "date").alias("x")).select("code", "x.date", "x.side", F.col("x.back").alias("since"))


def sig_20_udf_6_registry(spark, d):
    """Signals of every registered rule in one table: algo, code, buys, sells."""
    inst = instruments(spark, d)
    return S.registry(S.with_industry(_scored(spark, d), sector(bars_bounded(spark, d), inst), inst))


for _f in (ind_9_adx, ind_4_15_bottom_fishing, ind_17_19_chips, ind_18_chip_snapshots, sig_8_chip_peak, sig_10_12_composite, sig_13_14_band_router, sig_15_16_daily_picks, sig_17_verdict, sig_18_19_scan, sig_20_udf_6_registry):
    QUERIES[_f.__name__] = _f
