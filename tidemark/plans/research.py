"""Queries for back-tests and portfolios (BT), factor research (ML, FAC), streams (STR), and formats (SRC, SNK, ADJ)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import atomic as A
from tidemark.operators import backtest as B
from tidemark.operators import crosssec as X
from tidemark.operators import matching as N
from tidemark.operators import ml as L
from tidemark.operators import packed as K
from tidemark.operators import signals as S
from tidemark.operators import windows as I
from tidemark.operators.crosssec import corr
from tidemark.operators.recursive import with_recursive
from tidemark.plans.declare import declare
from tidemark.plans.indicators import tier_features
from tidemark.plans.relational import RET, _MET, returns
from tidemark.sources import formats as P
from tidemark.sources.tables import cut, shared_path, table
from tidemark.sources.views import BOUNDED_SQL, FACTORS_SQL, INDEX_SQL, INSTRUMENTS_SQL, bars_bounded, factors, index_close, instruments, ticks
from tidemark.streaming import ticks as T

QUERIES, SQL, query = declare()
BOUND = f"WITH {BOUNDED_SQL}, bars AS (SELECT * FROM bounded)"


def scored(spark, d):
    return S.score(S.signal_columns(with_recursive(bars_bounded(spark, d))))


def ruled(spark, d):
    """scored, with what the rules that look at industries need."""
    from tidemark.plans.sequences import sector

    inst = instruments(spark, d)
    return S.with_industry(scored(spark, d), sector(bars_bounded(spark, d), inst), inst)


# ---- back-tests ------------------------------------------------------------------------------------------------


@query()
def bt_1_single(spark, d):
    return B.single(scored(spark, d))


@query()
def bt_2_4_ablation(spark, d):
    return B.ablation(ruled(spark, d))


@query()
def bt_5_choice(spark, d):
    c = cut(B.ablation(ruled(spark, d)), "ablation")
    return B.choose(c, "steady").withColumn("objective", F.lit("steady")).union(B.choose(c, "bold").withColumn("objective", F.lit("bold")))


@query()
def agg_15_bt_4_ablation_summary(spark, d):
    """Per rule and segment: candidates, medians and means of what they made."""
    return B.ablation(ruled(spark, d)).groupBy("algo", "segment").agg(F.count("*").alias("n"), F.round(F.median("ann"), 6).alias("ann_median"), F.round(F.avg("ann"), 6).alias("ann_mean"), F.round(F.median("mdd"), 6).alias("mdd_median"), F.round(F.median("winrate"), 6).alias("winrate_median"))


@query(f"""{BOUND}, {INDEX_SQL}, m AS (SELECT date, idx, CASE WHEN count(*) OVER (ORDER BY date ROWS 119 PRECEDING) >= 120 THEN avg(idx) OVER (ORDER BY date ROWS 119 PRECEDING) END AS ma FROM idx), g AS (SELECT date, CASE WHEN idx >= ma THEN 'bull' ELSE 'bear' END AS regime FROM m WHERE ma IS NOT NULL),
{RET} SELECT code, regime, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(sum(ln(1 + least(greatest(r, -0.5), 0.5))) * 252 / count(*), 5) END AS ann FROM r JOIN g USING (date) WHERE r IS NOT NULL GROUP BY code, regime""")
def bt_3_bull_bear(spark, d):
    """Annualised log return by the index's regime, over at least 20 days of it."""
    w = W.orderBy("date").rowsBetween(-119, 0)
    g = index_close(bars_bounded(spark, d)).select("date", F.when(F.count("*").over(w) >= 120, F.when(F.col("idx") >= F.avg("idx").over(w), "bull").otherwise("bear")).alias("regime")).where("regime is not null")  # one row a day
    r = returns(spark, d).where("r is not null").join(F.broadcast(g), "date")
    clip = F.least(F.greatest("r", F.lit(-0.5)), F.lit(0.5))
    return r.groupBy("code", "regime").agg(F.count("*").alias("n"), F.when(F.count("*") >= 20, F.round(F.sum(F.log1p(clip)) * 252 / F.count("*"), 5)).alias("ann"))


TIERS = [B.Tier("steady", 0.5, 20, 20, True), B.Tier("balanced", 0.5, 10, 10, True), B.Tier("aggressive", 0.7, 5, 5, False)]


def _tier_rows(spark, d):
    from tidemark.plans.indicators import ind_28_29_30_gates

    b = bars_bounded(spark, d)
    return B.tier_days(tier_features(b, index_close(b)), ind_28_29_30_gates(spark, d).select("date", "gate"), TIERS)


@query()
def bt_9_tier_phases(spark, d):
    e = B.fold(_tier_rows(spark, d), TIERS)
    return e.groupBy("tier", "phase").agg(F.round(F.max_by("equity", "date"), 2).alias("last"), F.sum("trades").alias("trades"), F.sum("wins").alias("wins"))


@query()
def bt_10_12_13_tier_eval(spark, d):
    """Each tier's mean over phases: metrics, trades, win rate and profit factor."""
    e = cut(B.fold(_tier_rows(spark, d), TIERS), "equity")
    m = X.curve_metrics(B.phase_mean(e, TIERS), ["tier"], "date", "v")
    t = e.groupBy("tier").agg(F.sum("trades").alias("trades"), F.round(F.try_divide(F.sum("wins"), F.sum("trades")), 6).alias("winrate"), F.round(F.try_divide(F.sum("gain"), F.sum("loss")), 6).alias("pf"))
    return m.join(t, "tier").select("tier", *[F.round(c, 6).alias(c) for c in ("total", "ann", "mdd", "sharpe")], "days", "trades", "winrate", "pf")


@query(f"""{BOUND}, f AS (SELECT code, date, close, row_number() OVER w AS n, round(close / lag(close, 20) OVER w - 1, 9) AS m, round(stddev_pop(r) OVER (w ROWS 19 PRECEDING), 9) AS v FROM (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM bars) WINDOW w AS (PARTITION BY code ORDER BY date)),
k AS (SELECT *, CASE WHEN m IS NOT NULL AND count(m) OVER (PARTITION BY date) >= 6 THEN (row_number() OVER (PARTITION BY date, m IS NULL ORDER BY m, code) - 1) / (count(m) OVER (PARTITION BY date) - 1) END AS rm, CASE WHEN v IS NOT NULL AND count(v) OVER (PARTITION BY date) >= 6 THEN (row_number() OVER (PARTITION BY date, v IS NULL ORDER BY v, code) - 1) / (count(v) OVER (PARTITION BY date) - 1) END AS rv FROM f),
s AS (SELECT date, code, close, round(0.5 * rm + 0.5 * (1 - rv), 9) AS score FROM k WHERE n >= 60 AND close > 1), l AS (SELECT max(date) AS d FROM (SELECT date FROM s WHERE score IS NOT NULL GROUP BY date HAVING count(*) >= 10))
SELECT code, rk, round(score, 6) AS score, floor(1e6 / 10 / (close * 100)) AS lots FROM (SELECT *, row_number() OVER (ORDER BY score DESC, code) AS rk FROM s JOIN l ON s.date = l.d WHERE score IS NOT NULL) WHERE rk <= 10""")
def bt_11_latest_picks(spark, d):
    """The last day with at least ten candidates: its ten best by the blended rank, and the lots a tenth buys."""
    w = I.seq()
    b = bars_bounded(spark, d).withColumn("r", I.change(F.col("close"), 1, w))
    f = b.select("code", "date", "close", F.row_number().over(w).alias("n"), F.round(I.change(F.col("close"), 20, w), 9).alias("m"), F.round(F.stddev_pop("r").over(I.frame(w, 20)), 9).alias("v"))
    k = f.withColumns({"rm": I.rank01("m", ["date"], "code"), "rv": I.rank01("v", ["date"], "code")})
    s = k.where("n >= 60 and close > 1").select("date", "code", "close", F.round(0.5 * F.col("rm") + 0.5 * (1 - F.col("rv")), 9).alias("score")).where("score is not null")
    last = s.groupBy("date").agg(F.count("*").alias("c")).where("c >= 10").agg(F.max("date").alias("date"))
    top = s.join(F.broadcast(last), "date").orderBy(F.desc("score"), "code").limit(10)
    return top.select("code", F.row_number().over(W.orderBy(F.desc("score"), "code")).cast("long").alias("rk"), F.round("score", 6).alias("score"), F.floor(F.lit(1e6) / 10 / (F.col("close") * 100)).cast("double").alias("lots"))  # ten rows


@query(f"{BOUND}, {INDEX_SQL}, c AS (SELECT 1 AS code, date, idx AS v FROM idx), {_MET}")
def bt_8_benchmark(spark, d):
    c = index_close(bars_bounded(spark, d)).select(F.lit(1).alias("code"), "date", F.col("idx").alias("v"))
    m = X.curve_metrics(c, ["code"], "date", "v")
    return m.select("code", *[F.round(c, 6).alias(c) for c in ("total", "ann", "mdd")], F.round("sharpe", 4).alias("sharpe"), "days")


@query()
def bt_6_7_slot_and_sleeve(spark, d):
    """The chosen rule's sides as candidates: slots share cash (by lowest ATR share), sleeves are independent curves."""
    x = scored(spark, d).withColumn("trp", F.avg(I.true_range(I.seq())).over(I.frame(I.seq(), 14)) / F.col("close"))
    w = I.seq()
    up = F.last(F.col("sig_macd"), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)) == "BUY"
    r = I.change(F.col("close"), 1, w)
    y = x.select(F.lit("slot").alias("tier"), "date", "code", "close", F.when(up & (F.col("i") >= 60), F.round("trp", 9)).alias("s"), F.coalesce(r >= 0.095, F.lit(False)).alias("lim_up"), F.coalesce(r <= -0.095, F.lit(False)).alias("lim_dn"), F.lit(True).alias("on"))
    y = y.withColumn("rank", F.when(F.col("s").isNotNull(), F.row_number().over(W.partitionBy("date").orderBy(F.asc_nulls_last("s"), "code"))))
    e = B.fold(y, [B.Tier("slot", 1.0, 10, 1, False)])
    slot = X.curve_metrics(e.select(F.lit("slot").alias("kind"), "date", "equity"), ["kind"], "date", "equity")
    one = B.single(scored(spark, d)).agg(F.avg("total").alias("total"), F.avg("ann").alias("ann"), F.avg("mdd").alias("mdd"), F.count("*").alias("days"))
    cols = lambda m, k: m.select(F.lit(k).alias("kind"), *[F.round(c, 6).alias(c) for c in ("total", "ann", "mdd")], "days")
    return cols(slot, "slot").union(cols(one, "sleeve"))


@query(f"""{BOUND}, {RET}, n AS (SELECT date, code, y, floor((row_number() OVER (PARTITION BY date ORDER BY x, code) - 1) * 10 / count(*) OVER (PARTITION BY date)) AS t, count(*) OVER (PARTITION BY date) AS n FROM r WHERE x IS NOT NULL AND y IS NOT NULL),
u AS (SELECT *, dense_rank() OVER (ORDER BY date) AS i FROM n WHERE n >= 10), b AS (SELECT *, lag(i) OVER (PARTITION BY code ORDER BY i) AS p FROM u WHERE t = 9),
a AS (SELECT date, avg(y) AS l, avg((p IS NULL OR p <> i - 1)::INTEGER) AS turnover FROM b GROUP BY date), s AS (SELECT date, avg(y) AS s FROM u WHERE t = 0 GROUP BY date)
SELECT date, round(l, 6) AS long_ret, round(l - s, 6) AS ls_ret, round(turnover, 6) AS turnover, round(l - 0.001 * turnover, 6) AS net FROM a JOIN s USING (date)""")
def bt_19_decile_portfolio(spark, d):
    p = X.decile_portfolio(returns(spark, d), "x", "y", "date", "code")
    return p.select("date", *[F.round(c, 6).alias(c) for c in ("long_ret", "ls_ret", "turnover", "net")])


@query(f"{BOUND}, {RET}, t AS (SELECT date, avg(y) AS m, count(*) AS n FROM r WHERE x > 0.02 AND y IS NOT NULL GROUP BY date) SELECT count(*) AS days, sum(n) AS trades, round(exp(sum(ln(1 + m))) - 1, 5) AS total FROM t")
def bt_20_threshold(spark, d):
    t = returns(spark, d).where("x > 0.02 and y is not null").groupBy("date").agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    return t.agg(F.count("*").alias("days"), F.sum("n").alias("trades"), F.round(F.exp(F.sum(F.log1p("m"))) - 1, 5).alias("total"))


def _grid():
    return [B.Tier(f"m{int(w * 10)}_t{t}_r{r}", w, t, r, False) for w in (0.3, 0.7) for t in (5, 10) for r in (5, 10)]


@query()
def bt_10_blend_grid(spark, d):
    """A grid of rotations folded in parallel, one task for each setting."""
    from tidemark.plans.indicators import ind_28_29_30_gates

    b, grid = bars_bounded(spark, d), _grid()
    rows = B.tier_days(tier_features(b, index_close(b)), ind_28_29_30_gates(spark, d).select("date", "gate"), grid)
    e = cut(B.fold(rows, grid), "grid")
    m = X.curve_metrics(B.phase_mean(e, grid), ["tier"], "date", "v")
    return m.select("tier", *[F.round(c, 6).alias(c) for c in ("total", "ann", "mdd", "sharpe")], "days")


@query()
def bt_24_model_portfolio(spark, d):
    """A rotation by the forecasts of the walk-forward models: entry needs a rise more likely than not."""
    f = L.walk_forward(_panel(spark, d), XS, "y").select("code", "date", "pred", "p_up")
    b = bars_bounded(spark, d).select("code", "date", "close").withColumn("r", I.change(F.col("close"), 1, I.seq()))
    y = b.join(f, ["code", "date"], "left").select(F.lit("model").alias("tier"), "date", "code", "close", F.when(F.col("p_up") > 0.5, F.col("pred")).alias("s"), F.coalesce(F.col("r") >= 0.095, F.lit(False)).alias("lim_up"), F.coalesce(F.col("r") <= -0.095, F.lit(False)).alias("lim_dn"), F.lit(True).alias("on"))
    y = y.withColumn("rank", F.when(F.col("s").isNotNull(), F.row_number().over(W.partitionBy("date").orderBy(F.desc_nulls_last("s"), "code"))))
    e = B.fold(y, [B.Tier("model", 1.0, 10, 5, False)])
    return e.groupBy("tier", "phase").agg(F.round(F.max_by("equity", "date"), 2).alias("last"), F.sum("trades").alias("trades"))


@query()
def bt_15_core_and_lottery(spark, d):
    """A core of the largest names beside a sleeve of low-priced names with rising volume after a drop."""
    w = I.seq()
    b = bars_bounded(spark, d).join(instruments(spark, d).select("code", "mktcap"), "code")
    x = b.withColumns({"vr": F.avg("vol").over(I.frame(w, 5)) / F.nullif(F.avg("vol").over(I.frame(w, 20)), F.lit(0.0)), "drop": I.change(F.col("close"), 5, w), "r": I.change(F.col("close"), 1, w), "n": F.row_number().over(w)})
    low = F.percent_rank().over(W.partitionBy("date").orderBy("close"))
    x = x.withColumn("low", low)
    pick = (F.col("low") <= 0.3) & (F.col("vr") >= 1.2) & (F.col("drop") <= -0.03) & (F.col("n") >= 20)
    each = F.explode(F.array(F.struct(F.lit("core").alias("tier"), F.when(F.col("n") >= 20, F.col("mktcap")).alias("s")), F.struct(F.lit("lottery").alias("tier"), F.when(pick, -F.col("close")).alias("s"))))
    y = x.select("date", "code", "close", F.coalesce(F.col("r") >= 0.095, F.lit(False)).alias("lim_up"), F.coalesce(F.col("r") <= -0.095, F.lit(False)).alias("lim_dn"), F.lit(True).alias("on"), each.alias("t")).select("t.tier", "date", "code", "close", "t.s", "lim_up", "lim_dn", "on")
    y = y.withColumn("rank", F.when(F.col("s").isNotNull(), F.row_number().over(W.partitionBy("tier", "date").orderBy(F.desc_nulls_last("s"), "code"))))
    two = [B.Tier("core", 1.0, 10, 20, False), B.Tier("lottery", 1.0, 10, 5, False)]
    m = X.curve_metrics(B.phase_mean(cut(B.fold(y, two), "sleeves"), two), ["tier"], "date", "v")
    return m.select("tier", *[F.round(c, 6).alias(c) for c in ("total", "ann", "mdd", "sharpe")], "days")


# ---- factor research -------------------------------------------------------------------------------------------

XS = ["f_ret5", "f_ret20", "f_vola", "f_bias", "f_volchg", "f_gap"]
_PANEL = """p AS (SELECT code, date, round(close / lag(close, 5) OVER w - 1, 9) AS f_ret5, round(close / lag(close, 20) OVER w - 1, 9) AS f_ret20, round(CASE WHEN count(r) OVER (w ROWS 19 PRECEDING) >= 20 THEN stddev_pop(r) OVER (w ROWS 19 PRECEDING) END, 9) AS f_vola,
 round(CASE WHEN count(close) OVER (w ROWS 19 PRECEDING) >= 20 THEN close / avg(close) OVER (w ROWS 19 PRECEDING) - 1 END, 9) AS f_bias, round(CASE WHEN count(vol) OVER (w ROWS 19 PRECEDING) >= 20 THEN avg(vol) OVER (w ROWS 4 PRECEDING) / avg(vol) OVER (w ROWS 19 PRECEDING) - 1 END, 9) AS f_volchg, round(open / lag(close) OVER w - 1, 9) AS f_gap, round(lead(close) OVER w / close - 1, 9) AS y
 FROM (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM bars) WINDOW w AS (PARTITION BY code ORDER BY date))"""


def _panel(spark, d):
    w, c, v = I.seq(), F.col("close"), F.col("vol")
    b = bars_bounded(spark, d).withColumn("r", I.change(c, 1, w))
    x = {"f_ret5": I.change(c, 5, w), "f_ret20": I.change(c, 20, w), "f_vola": I.roll(F.stddev_pop, F.col("r"), 20, w), "f_bias": c / I.sma(c, 20, w) - 1, "f_volchg": F.avg(v).over(I.frame(w, 5)) / I.sma(v, 20, w) - 1, "f_gap": F.col("open") / F.lag(c).over(w) - 1, "y": F.lead(c).over(w) / c - 1}
    return b.select("code", "date", *[F.round(e, 9).alias(n) for n, e in x.items()])


def _atomic(spark, d):
    """code, date, y and the 21 atomic factors: columns, own matches and chips, peers by industry and by size, market.

    Bars are made once, packed to a row a code and cut. Peers and own factors are made from such rows by array, so no
    bar is joined or sorted again; only industries' and market's figures are joined to the bars, by day.
    """
    b, inst = cut(K.pack(bars_bounded(spark, d)), "bars"), cut(instruments(spark, d), "instruments")
    pools = [K.pool_values(b, cut(peers, "peers"), name) for name, peers in (("l2", N.peers_of(inst, "industry", 50)), ("l3", N.peers_of(inst, "tier", 30, "industry")))]
    b = b.join(inst.select("code", "industry"), "code", "left")
    days = cut(K.day_sums(b), "days")  # one row an industry and day
    w = W.orderBy("date")  # one row a day
    idx = days.groupBy("date").agg((F.sum("c") / F.nullif(F.sum("k"), F.lit(0.0))).alias("idx"))
    mkt = idx.select("date", (F.try_divide("idx", F.lag("idx", 5).over(w)) - 1).alias("mkt5"))
    sector = cut(A.sector_of(days.where("industry is not null and n > 0").select("industry", "date", (F.col("r") / F.col("n")).alias("m"))), "sector")  # written, so Spark knows how small it is
    x = b.join(inst.select("code"), "code", "left_semi")
    for p in pools:
        x = x.join(p, "code", "left")
    x = K.own_factors(x.repartition(K.PARTS, "code")).join(F.broadcast(mkt), "date", "left").join(sector, ["industry", "date"], "left")
    return x.select("code", "date", "y", *A.NAMES)


def _atomic_stats(spark, d):
    """The sufficient statistics of each day of the standardised 21 factors."""
    return cut(L.day_products(A.standardised(cut(_atomic(spark, d), "atomic"), A.NAMES), list(A.NAMES), "y", least=10), "stats")


@query()
def ind_24_atomic_factors(spark, d):
    return _atomic(spark, d)


@query()
def ind_23_l1_rsi_atr(spark, d):
    """The four factors of IND-23 that ind_23_24_25_26_ml_factors doesn't hold."""
    return A.l1_rsi_atr(bars_bounded(spark, d))


@query()
def ind_25_26_context(spark, d):
    """IND-25's context with structure and weekly returns, and IND-26's volume ratio and five-day drop."""
    b, w = bars_bounded(spark, d), I.seq()
    more = b.select("code", "date", (I.sma(F.col("vol"), 5, w) / F.nullif(I.sma(F.col("vol"), 20, w), F.lit(0.0))).alias("vr5_20"), I.change(F.col("close"), 5, w).alias("drop5"))
    return A.context_factors(b).join(more, ["code", "date"])


_NN = " AND ".join(f"{x} IS NOT NULL" for x in [*XS, "y"])


@query(f"{BOUND}, {_PANEL} SELECT date, count(*) AS n, " + ", ".join(f"round(covar_pop({x}, y) * count(*), 6) AS s_{i}" for i, x in enumerate(XS)) + f", round(var_pop(y) * count(*), 6) AS yy FROM p WHERE {_NN} GROUP BY date HAVING count(*) >= 10")
def ml_3_sufficient_statistics(spark, d):
    s = L.day_stats(_panel(spark, d), XS, "y", least=10)
    return s.select("date", "n", *[F.round(f"s_{i}", 6).alias(f"s_{i}") for i in range(len(XS))], F.round("yy", 6).alias("yy"))


@query()
def ml_4_all_subsets(spark, d):
    """All 2^21 subsets of the atomic factors, those of no factor left out."""
    m = L.all_subsets(spark, _atomic_stats(spark, d), len(A.NAMES))
    return m.select("mask", "size", *[F.round(c, 6).alias(c) for c in ("train_ic", "train_ir", "val_ic", "val_ir")])


@query(f"{BOUND}, {_PANEL}, i AS (SELECT date, count(*) AS n, " + ", ".join(f"corr({x}, y) AS {x}" for x in XS) + f" FROM p WHERE {_NN} GROUP BY date HAVING count(*) >= 10) SELECT " + ", ".join(f"CASE WHEN avg({x}) < 0 THEN -1 ELSE 1 END AS {x}" for x in XS) + ", count(*) AS days FROM i")
def ml_5_sign_flip(spark, d):
    p = _panel(spark, d).where(" and ".join(f"{x} is not null" for x in [*XS, "y"]))
    i = p.groupBy("date").agg(F.count("*").alias("n"), *[corr(x, "y").alias(x) for x in XS]).where("n >= 10")
    return i.agg(*[F.when(F.avg(x) < 0, -1).otherwise(1).alias(x) for x in XS], F.count("*").alias("days"))


@query()
def ml_6_10_greedy_path(spark, d):
    """The greedy path over all days, and over a part that expands by 60 days, with its IC on the 60 days after it."""
    s, g, yy = L._arrays(cut(L.day_stats(_panel(spark, d), XS, "y", least=10), "stats"), len(XS), "date")
    rows = [(n, i, XS[f], round(v, 6), m, *(None if x is None else round(x, 6) for x in oos)) for n, path, m, *oos in L.reselected(s, g, yy, 4) for i, (f, v) in enumerate(path)]
    return spark.createDataFrame(rows, "days int, step int, factor string, ic double, oos_days int, oos_ic double, oos_ir double")


@query()
def ml_7_stability(spark, d):
    s = cut(L.day_stats(_panel(spark, d), XS, "y", least=10), "stats")
    return L.stability(spark, s, len(XS)).select("factor", F.round("share", 6).alias("share"))


@query()
def ml_8_lasso_nnls(spark, d):
    """Lasso and non-negative weights of the factors from the pooled statistics alone."""
    import numpy as np

    s, g, _ = L._arrays(cut(L.day_stats(_panel(spark, d), XS, "y", least=10), "stats"), len(XS), "date")
    q, c = g.sum(axis=0), s.sum(axis=0)
    sd = np.sqrt(np.maximum(np.diag(q), 1e-18))
    r = np.linalg.cholesky(q / np.outer(sd, sd) + 1e-9 * np.eye(len(XS))).T
    z = np.linalg.solve(r.T, c / sd)
    n = max(1, len(z))
    rows = [(XS[i], float(round(a, 6)), float(round(b, 6))) for i, (a, b) in enumerate(zip(L.lasso(r, z, 0.01 * abs(z).max() / n), L.nnls_small(r, z)))]
    return spark.createDataFrame(rows, "factor string, lasso double, nnls double")


@query("WITH t AS (SELECT p_partkey AS k, (p_partkey * 7919 % 1000) * (p_partkey * 7919 % 1000) / 1e6 AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM t), b AS (SELECT max(p) FILTER (WHERE p <= 0.05 * i / n) AS b FROM r) SELECT k, coalesce(p <= b, false) AS passed FROM r, b")
def ml_9_bh_fdr(spark, d):
    h = F.col("p_partkey") * 7919 % 1000
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (h * h / 1e6).alias("p"))
    return X.bh_fdr(t, "p", 0.05).select("k", "passed")


@query(f"{BOUND}, {_PANEL}, c AS (SELECT code, corr(f_ret5, y) AS ic, quantile_cont(f_ret5, 0.8) AS cutoff, count(*) AS n FROM p WHERE {_NN} GROUP BY code) SELECT p.code, any_value(n) AS n, round(any_value(ic), 5) AS ic, round(avg(y) FILTER (WHERE f_ret5 >= cutoff), 6) AS event, round(avg((y > 0)::INTEGER) FILTER (WHERE f_ret5 >= cutoff), 6) AS hit FROM p JOIN c USING (code) WHERE {_NN} GROUP BY p.code")
def ml_12_per_code_check(spark, d):
    p = _panel(spark, d).where(" and ".join(f"{x} is not null" for x in [*XS, "y"]))
    c = p.groupBy("code").agg(corr("f_ret5", "y").alias("ic"), F.percentile("f_ret5", 0.8).alias("cutoff"), F.count("*").alias("n"))
    e = F.when(F.col("f_ret5") >= F.col("cutoff"), F.col("y"))
    return p.join(c, "code").groupBy("code").agg(F.first("n").alias("n"), F.round(F.first("ic"), 5).alias("ic"), F.round(F.avg(e), 6).alias("event"), F.round(F.avg((e > 0).cast("double")), 6).alias("hit"))


@query()
def ml_13_chip_grid(spark, d):
    """The 54 settings of the chip distribution by the mean |IC| of its three factors with the next return, day by day
    over the first 70 % of the days."""
    b = bars_bounded(spark, d)
    days = [r["date"] for r in b.select("date").distinct().orderBy("date").collect()]  # one row a day
    upto = days[int(len(days) * 0.7) - 1] if len(days) > 1 else None
    x = A.chip_settings(b, upto)
    kinds = ["bins", "decay", "cap", "prom"]
    y = lambda f: F.when(F.col(f).isNotNull(), F.col("y"))
    z = x.withColumns({f"y_{f}": y(f) for f in A.CHIPS})
    ic = z.groupBy(*kinds, "date").agg(*[F.when(F.count(f) >= 10, corr(f, f"y_{f}")).alias(f) for f in A.CHIPS])
    m = ic.groupBy(*kinds).agg(*[F.round(F.avg(f), 6).alias(f"ic_{f}") for f in A.CHIPS], F.count("chip_profit").alias("days"), *[F.avg(f).alias(f"_{f}") for f in A.CHIPS])
    known = F.array_compact(F.array(*[F.abs(F.col(f"_{f}")) for f in A.CHIPS]))
    score = F.round(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)), 6)
    return m.select(*kinds, *[f"ic_{f}" for f in A.CHIPS], "days", score.alias("score"))


@query(f"{BOUND}, {_PANEL}, q AS (SELECT *, CASE WHEN f_ret5 IS NULL OR f_ret20 IS NULL OR f_vola IS NULL OR abs(f_gap) > 0.1 THEN 1 ELSE 0 END AS miss FROM p), l AS (SELECT code, max(date) FILTER (WHERE miss = 1) AS l FROM q GROUP BY code), k AS (SELECT q.code, q.date FROM q JOIN l USING (code) WHERE l IS NULL OR q.date > l) SELECT code, min(date) AS since, count(*) AS n FROM k GROUP BY code HAVING count(*) >= 20")
def ml_14_panel_trailing_run(spark, d):
    p = _panel(spark, d).withColumn("f_gap", F.when(F.abs("f_gap") > 0.1, None).otherwise(F.coalesce("f_gap", F.lit(0.0))))
    t = L.trailing_complete(p, ["f_ret5", "f_ret20", "f_vola", "f_gap"], 20)
    return t.groupBy("code").agg(F.min("date").alias("since"), F.count("*").alias("n"))


@query()
def ml_1_walk_forward(spark, d):
    f = L.walk_forward(_panel(spark, d), XS, "y")
    return f.select("code", "date", *[F.round(c, 6).alias(c) for c in ("y", "pred", "p_up", "q10", "q50", "q90")], "used")


@query()
def ml_1_boosted(spark, d):
    b = L.boosted(_panel(spark, d), XS, "y", "2000-01-01", trees=5)
    return b.groupBy("code").agg(F.count("*").alias("n"), F.round(corr("pred", "y"), 6).alias("ic"))


@query()
def ml_11_15_candidates(spark, d):
    """Every subset by train and validation IC, ranked by a weighted score."""
    return L.ranked(ml_4_all_subsets(spark, d), {"train_ic": 0.25, "train_ir": 0.15, "val_ic": 0.35, "val_ir": 0.25})


@query(f"{BOUND}, {_PANEL} SELECT code, date, round(2 * f_ret5 - f_ret20 + 0.5 * f_gap, 6) AS score FROM p WHERE {_NN}")
def fac_1_linear_score(spark, d):
    p = _panel(spark, d).where(" and ".join(f"{x} is not null" for x in [*XS, "y"]))
    return p.select("code", "date", F.round(2 * F.col("f_ret5") - F.col("f_ret20") + 0.5 * F.col("f_gap"), 6).alias("score"))


@query(f"{BOUND}, {INDEX_SQL} SELECT date, round(idx / lag(idx) OVER (ORDER BY date) - 1, 6) AS r, round(idx / lag(idx, 5) OVER (ORDER BY date) - 1, 6) AS r5, date - DATE '1970-01-01' AS ord FROM idx")
def fac_2_4_ind_27_index_returns(spark, d):
    w = W.orderBy("date")  # one row a day
    i = index_close(bars_bounded(spark, d))
    return i.select("date", F.round(F.col("idx") / F.lag("idx").over(w) - 1, 6).alias("r"), F.round(F.col("idx") / F.lag("idx", 5).over(w) - 1, 6).alias("r5"), F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("ord"))


# ---- streams ---------------------------------------------------------------------------------------------------


@query("SELECT user_id AS code, date_trunc('day', ts) AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def str_1_stream_day_bars(spark, d):
    """The event table as a stream, folded to daily bars by a run over all files; the newest state of each bar."""
    return T.drain(T.bars_of(T.tick_stream(spark, d)), ["code", "start"])


@query("SELECT user_id AS code, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def str_1_batch_hour_bars(spark, d):
    return T.bars_of(ticks(spark, d), "1 hour")


@query("SELECT code, start, count(*) AS n FROM (SELECT user_id AS code, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events WHERE value IS NOT NULL) GROUP BY ALL")
def str_ext_sliding(spark, d):
    return T.bars_of(ticks(spark, d), "12 hours", slide="6 hours").select("code", "start", "n")


@query("""WITH g AS (SELECT user_id AS code, ts, value, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT code, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY code, k""")
def str_ext_sessions(spark, d):
    return T.sessions_of(ticks(spark, d)).select("code", "start", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, CASE WHEN strftime(ts, '%H%M')::INTEGER >= 925 AND strftime(ts, '%H%M')::INTEGER < 1500 THEN value END AS live FROM events")
def str_2_live_bar_window(spark, d):
    hm = F.hour("ts") * 100 + F.minute("ts")
    return ticks(spark, d).select("event_id", F.when((hm >= 925) & (hm < 1500), F.col("price")).alias("live"))


@query("SELECT code, ts FROM (SELECT user_id AS code, ts, CAST(ts AS DATE) AS x, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL AND p <> x")
def str_1_roll_over(spark, d):
    return T.roll_over(ticks(spark, d))


@query("SELECT code, ts, n FROM (SELECT user_id AS code, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 2")
def str_6_rate_limit(spark, d):
    return T.over_limit(ticks(spark, d), 2, 3600)


@query()
def str_3_7_progressive(spark, d):
    """A forecast that is refined batch by batch: the running mean a code has after each file, and after the last."""
    s = T.tick_stream(spark, d).where("price is not null").groupBy("code").agg(F.avg("price").alias("mean"), F.count("*").alias("n"))
    return T.drain(s, ["code"], "means").select("code", F.round("mean", 6).alias("mean"), "n")


@query(f"WITH {INSTRUMENTS_SQL} SELECT industry, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean FROM events JOIN inst ON inst.code = events.user_id GROUP BY industry")
def str_ext_stream_static_join(spark, d):
    t = ticks(spark, d).join(instruments(spark, d).select("code", "industry"), "code")
    return t.groupBy("industry").agg(F.count("*").alias("n"), F.round(F.avg("price") + 1e-9, 4).alias("mean"))


@query("SELECT key, val FROM (SELECT user_id AS key, value AS val, ts, max(ts) OVER () AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND z - ts <= INTERVAL 1 DAY")
def str_5_lkp_3_fresh_cache(spark, d):
    """The newest value of each key that isn't older than a day at the newest event."""
    e = table(spark, d, "events")
    z = e.agg(F.max("ts")).first()[0]
    g = e.groupBy(F.col("user_id").alias("key")).agg(F.max_by(F.struct(F.col("value").alias("val"), "ts"), F.struct("ts", "event_id")).alias("x"))
    return g.where(F.col("x.ts") >= F.lit(z) - F.expr("interval 1 day")).select("key", "x.val")


# ---- formats, sinks, adjustment --------------------------------------------------------------------------------

_ROUND = f"{BOUND} SELECT code, date, open, close, high, low, vol FROM bars"


def _payload(spark, d, fmt):
    b = bars_bounded(spark, d)
    txt = [F.col(c).cast("string") for c in ("date", "open", "close", "high", "low", "vol")]
    return b.select("code", fmt(txt).alias("payload"))


@query(_ROUND)
def src_7_21_json_arrays(spark, d):
    p = _payload(spark, d, lambda t: F.concat(F.lit('{"day": [["'), F.concat_ws('","', *t), F.lit('"], ["bad"]]}')))
    return P.arrays_json(p, "payload", "code")


@query(_ROUND)
def src_8_json_lines(spark, d):
    p = _payload(spark, d, lambda t: F.concat(F.lit('{"klines": ["'), F.concat_ws(",", *t), F.lit('", "bad"]}')))
    return P.lines_json(p, "payload", "code")


@query(_ROUND)
def src_10_loose_json(spark, d):
    p = _payload(spark, d, lambda t: F.concat(F.lit('[{day:"'), t[0], F.lit('",open:"'), t[1], F.lit('",close:"'), t[2], F.lit('",high:"'), t[3], F.lit('",low:"'), t[4], F.lit('",volume:"'), t[5], F.lit('"}]')))
    return P.loose_json(p, "payload", "code")


@query(_ROUND)
def src_9_reversed_csv(spark, d):
    """Every code's rows written in that encoding, newest first, with the code as last field, and read again."""
    path = shared_path(spark, "csv")
    P.allow_charsets(spark)
    z = F.lit("0")
    b = bars_bounded(spark, d).repartition("code").sortWithinPartitions("code", F.desc("date"))
    b.select(F.col("date").alias("日期"), z.alias("a"), F.lit("名称").alias("名称"), "close", "high", "low", "open", z.alias("b"), z.alias("c"), z.alias("e"), z.alias("f"), "vol", F.col("code").alias("代码")).write.option("header", True).option("encoding", "GBK").csv(path)
    return P.reversed_csv(spark, path, code=12)


@query("SELECT 'ev' || event_id AS code, 'n' || user_id AS name, value AS price FROM events WHERE value IS NOT NULL")
def src_19_20_24_quotes(spark, d):
    t = ticks(spark, d).where("price is not null")
    body = F.concat_ws("~", F.lit("1"), F.concat(F.lit("n"), "code"), F.lit("x"), F.col("price").cast("string"))
    p = t.select(F.concat(F.lit('v_ev'), "event_id", F.lit('="'), body, F.lit('";v_none="";')).alias("payload"))
    return P.quotes(p, "payload").select("code", "name", "price")


@query(f"{BOUND}, {INSTRUMENTS_SQL}, l AS (SELECT code, arg_max(r, date) AS r FROM (SELECT code, date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM bars) WHERE r IS NOT NULL GROUP BY code), m AS (SELECT industry, round(avg(r), 6) AS m FROM l JOIN inst USING (code) GROUP BY industry) SELECT * FROM (SELECT industry, m, 'top' AS side FROM m ORDER BY m DESC, industry LIMIT 3) UNION ALL SELECT * FROM (SELECT industry, m, 'bottom' FROM m ORDER BY m, industry LIMIT 3)")
def src_22_leaderboard(spark, d):
    r = bars_bounded(spark, d).select("code", "date", I.change(F.col("close"), 1, I.seq()).alias("r")).where("r is not null").groupBy("code").agg(F.max_by("r", "date").alias("r"))
    m = r.join(instruments(spark, d).select("code", "industry"), "code").groupBy("industry").agg(F.round(F.avg("r"), 6).alias("m"))
    return m.orderBy(F.desc("m"), "industry").limit(3).withColumn("side", F.lit("top")).union(m.orderBy("m", "industry").limit(3).withColumn("side", F.lit("bottom")))


@query(f"{BOUND}, u AS (SELECT code, date, close, 0 AS page FROM bars WHERE date < DATE '1999-01-01' UNION ALL SELECT code, date, close, 1 FROM bars WHERE date >= DATE '1998-06-01') SELECT code, count(*) AS n, min(date) AS since, max(date) AS upto FROM (SELECT DISTINCT code, date FROM u) GROUP BY code")
def src_14_17_18_paged_union(spark, d):
    """Overlapping pages put together, each day once, the later page's row winning."""
    b = bars_bounded(spark, d).select("code", "date", "close")
    u = b.where("date < date'1999-01-01'").withColumn("page", F.lit(0)).unionByName(b.where("date >= date'1998-06-01'").withColumn("page", F.lit(1)))
    one = u.groupBy("code", "date").agg(F.max_by("close", "page").alias("close"))
    return one.groupBy("code").agg(F.count("*").alias("n"), F.min("date").alias("since"), F.max("date").alias("upto"))


@query(f"{BOUND}, {FACTORS_SQL}, {INSTRUMENTS_SQL} SELECT code, date, close * k AS close, vol FROM bars JOIN fac USING (code) JOIN inst USING (code) WHERE tier <> 'small' AND date >= DATE '1996-01-01'")
def src_29_30_31_panel(spark, d):
    use = instruments(spark, d).where("tier != 'small'").select("code")
    b = bars_bounded(spark, d).where("date >= date'1996-01-01'").join(use, "code", "left_semi")
    return b.join(factors(spark, d), "code").select("code", "date", (F.col("close") * F.col("k")).alias("close"), "vol")


@query(f"{BOUND} SELECT code, date, close FROM (SELECT code, date, close, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars) WHERE n >= 200 AND rn <= 100")
def src_32_trimmed(spark, d):
    w = W.partitionBy("code")
    b = bars_bounded(spark, d).select("code", "date", "close", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("date"))).alias("rn"))
    return b.where("n >= 200 and rn <= 100").select("code", "date", "close")


@query(f"{BOUND} SELECT code, date, close FROM (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars) WHERE rn BETWEEN 11 AND 40")
def snk_11_sim_14_view_slice(spark, d):
    return P.view_slice(bars_bounded(spark, d), 30, 10).select("code", "date", "close")


@query(f"{BOUND} SELECT code, count(*) AS n, round(max(close), 2) AS top FROM bars GROUP BY code")
def snk_2_5_json_report(spark, d):
    """Rows to JSON texts and back."""
    r = bars_bounded(spark, d).groupBy("code").agg(F.count("*").alias("n"), F.round(F.max("close"), 2).alias("top"), F.lit(float("nan")).alias("bad"))
    j = F.from_json("report", "code long, n long, top double, bad double")
    return P.to_report(r).select(j.alias("j")).where("j.bad is null").select("j.code", "j.n", "j.top")


_RAW = "raw AS (SELECT code, date, close * CASE WHEN code % 4 = 0 THEN 1.5 ELSE 1 END AS raw FROM bars)"


@query(f"{BOUND}, {_RAW}, l AS (SELECT b.code, b.date, raw / close AS k, row_number() OVER (PARTITION BY b.code ORDER BY b.date DESC) AS rn FROM bars b JOIN raw USING (code, date)) SELECT code, round(arg_max(k, date), 6) AS k FROM l WHERE rn <= 8 GROUP BY code")
def adj_1_same_day_factor(spark, d):
    """Raw over stored close on the newest common day of a code's last eight bars."""
    b = bars_bounded(spark, d)
    raw = b.select("code", "date", (F.col("close") * F.when(F.col("code") % 4 == 0, 1.5).otherwise(1.0)).alias("raw"))
    last = b.select("code", "date", "close", F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))).alias("rn")).where("rn <= 8")
    return last.join(raw, ["code", "date"]).groupBy("code").agg(F.round(F.max_by(F.col("raw") / F.col("close"), "date"), 6).alias("k"))


@query(f"{BOUND}, {_RAW}, r AS (SELECT b.code, b.date, raw / close AS q, row_number() OVER (PARTITION BY b.code ORDER BY b.date DESC) AS rn FROM bars b JOIN raw USING (code, date)), m AS (SELECT code, median(q) FILTER (WHERE rn > 1) AS m, count(*) FILTER (WHERE rn > 1) AS n, count(*) FILTER (WHERE rn > 1 AND abs(q - 1) > 0.01) AS off FROM r WHERE rn <= 15 GROUP BY code) SELECT code, round(m, 6) AS factor, n >= 3 AND off >= 3 AS rebase FROM m")
def adj_2_3_factor_audit(spark, d):
    """Median ratio of a code's last days but the very last; rebase if at least three of them are off by over 1 %."""
    b = bars_bounded(spark, d)
    raw = b.select("code", "date", (F.col("close") * F.when(F.col("code") % 4 == 0, 1.5).otherwise(1.0)).alias("raw"))
    r = b.join(raw, ["code", "date"]).select("code", (F.col("raw") / F.col("close")).alias("q"), F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))).alias("rn")).where("rn between 2 and 15")
    return r.groupBy("code").agg(F.round(F.median("q"), 6).alias("factor"), ((F.count("*") >= 3) & (F.count_if(F.abs(F.col("q") - 1) > 0.01) >= 3)).alias("rebase"))


@query(f"{BOUND}, {INDEX_SQL}, b AS (SELECT date, idx, avg(idx) OVER (ORDER BY date ROWS 19 PRECEDING) AS m20, avg(idx) OVER (ORDER BY date ROWS 59 PRECEDING) AS m60, idx / lag(idx, 20) OVER (ORDER BY date) - 1 AS r20, idx / lag(idx, 60) OVER (ORDER BY date) - 1 AS r60 FROM idx) SELECT date, idx > m20 AS above20, idx > m60 AS above60, round(r20, 6) AS r20, round(r60, 6) AS r60 FROM b ORDER BY date DESC LIMIT 1")
def q_market_brief(spark, d):
    w = W.orderBy("date")  # one row a day
    i = index_close(bars_bounded(spark, d))
    b = i.select("date", *[(F.col("idx") > F.avg("idx").over(w.rowsBetween(1 - k, 0))).alias(f"above{k}") for k in (20, 60)], *[F.round(F.col("idx") / F.lag("idx", k).over(w) - 1, 6).alias(f"r{k}") for k in (20, 60)])
    return b.orderBy(F.desc("date")).limit(1)
