"""Queries for forecasts from similar days and for the signals beside the composite (SIM, SIG), beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.market import vol_regime
from tidemark.operators import signals as S
from tidemark.operators import similarity as M
from tidemark.operators import windows as I
from tidemark.plans.declare import declare
from tidemark.plans.relational import RET, returns
from tidemark.plans.scalars import _VR
from tidemark.plans.sequences import RSI, signals
from tidemark.sources.views import BOUNDED_SQL, bars_bounded, index_close

QUERIES, SQL, query = declare()
BOUND = f"WITH {BOUNDED_SQL}, bars AS (SELECT * FROM bounded)"
END = "2001-12-31"
DAYS = 10
#: Quantiles are stretched about the median, those of five days more.
STRETCH, STRETCH_5 = 1.3, 1.4
POINTS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
FIELDS = ("cl", "hi", "lo")

_AGE = f"DATE '{END}' - date"
_WEIGHT = f"round(CASE WHEN {_AGE} <= 90 THEN 1 ELSE greatest(0.3, 1 - ({_AGE} - 90) / 365 * 0.5) END, 6)"
_OUT = ", ".join(f"round(lead({p}, {k}) OVER w / lead(close, {k - 1}) OVER w - 1, 9) AS {f}{k}" for k in range(1, DAYS + 1) for f, p in zip(FIELDS, ("close", "high", "low"))).replace("lead(close, 0) OVER w", "close")
_SAMPLES = f"o AS (SELECT code, date, round(close / lag(close, 20) OVER w - 1, 9) AS x, {_OUT}, round(lead(close, 5) OVER w / close - 1, 9) AS t5 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)), s AS (SELECT *, {_WEIGHT} AS w FROM o WHERE x BETWEEN 0.0 AND 0.05)"


def _samples(spark, d):
    """code, date, w and what followed each similar day: cl1 hi1 lo1 ... against the close of the day before each, t5."""
    w = I.seq()
    at = lambda p, k: F.lead(p, k).over(w) if k else F.col(p)
    out = [F.round(at(p, k) / at("close", k - 1) - 1, 9).alias(f"{f}{k}") for k in range(1, DAYS + 1) for f, p in zip(FIELDS, ("close", "high", "low"))]
    o = bars_bounded(spark, d).select("code", "date", F.round(I.change(F.col("close"), 20, w), 9).alias("x"), *out, F.round(at("close", 5) / F.col("close") - 1, 9).alias("t5"))
    age = F.datediff(F.lit(END).cast("date"), "date")
    weight = F.round(F.when(age <= 90, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (age - 90) / 365 * 0.5)), 6)
    return o.where("x between 0.0 and 0.05").withColumn("w", weight)


def _quantiles_sql(fields: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT code, '{f}' AS f, {f} AS v, w FROM s WHERE {f} IS NOT NULL" for f in fields)
    pts = ", ".join(f"min(v) FILTER (run >= {p} * al - 1e-9) AS {n}" for n, p in POINTS.items())
    return f"""l AS ({long}), l1 AS (SELECT code, f, v, sum(w) AS w FROM l GROUP BY ALL), c AS (SELECT *, round(sum(w) OVER (PARTITION BY code, f ORDER BY v ROWS UNBOUNDED PRECEDING), 6) AS run, round(sum(w) OVER (PARTITION BY code, f), 6) AS al FROM l1),
q AS (SELECT code, f, {pts}, sum(w) FILTER (v > 0) / sum(w) AS up FROM c GROUP BY code, f)"""


def _quantiles(samples, fields: list[str]):
    """code, f, the weighted quantiles of each field, and the weight of a rise."""
    long = samples.select("code", "w", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])).alias("x")).select("code", "x.f", "x.v", "w").where("v is not null")
    up = long.groupBy("code", "f").agg((F.sum(F.when(F.col("v") > 0, F.col("w"))) / F.sum("w")).alias("up"))
    return M.weighted_quantile(long, ["code", "f"], "v", "w", POINTS).join(up, ["code", "f"])


_FUSED = ["cl1", "hi1", "lo1", "t5"]
_TOLD = ", ".join(f"CASE WHEN f = 'hi1' THEN greatest(round({{0}}, 2), round(high, 2)) WHEN f = 'lo1' THEN least(round({{0}}, 2), round(low, 2)) ELSE round({{0}}, 6) END AS {p}".format(f"close * (1 + p50 + CASE WHEN f = 't5' THEN {STRETCH_5} ELSE {STRETCH} END * ({p} - p50)) + 1e-9") for p in POINTS)


@query(f"{BOUND}, {_SAMPLES}, {_quantiles_sql(_FUSED)}, z AS (SELECT code, arg_max(close, date) AS close, arg_max(high, date) AS high, arg_max(low, date) AS low FROM bars GROUP BY code) SELECT code, f AS field, {_TOLD}, round(up, 6) AS up FROM q JOIN z USING (code)")
def sim_10_fused_forecast(spark, d):
    """Prices forecast for the next close, high and low and for the fifth close: stretched quantiles of what followed
    similar days; the day's own high and low bound those of the forecast."""
    q = _quantiles(_samples(spark, d), _FUSED)
    z = bars_bounded(spark, d).groupBy("code").agg(*[F.max_by(c, "date").alias(c) for c in ("close", "high", "low")])
    f, m = F.col("f"), F.col("p50")
    price = lambda p: F.col("close") * (1 + m + F.when(f == "t5", STRETCH_5).otherwise(STRETCH) * (F.col(p) - m)) + 1e-9
    told = lambda p: F.when(f == "hi1", F.greatest(F.round(price(p), 2), F.round("high", 2))).when(f == "lo1", F.least(F.round(price(p), 2), F.round("low", 2))).otherwise(F.round(price(p), 6))
    return q.join(z, "code").select("code", f.alias("field"), *[told(p).alias(p) for p in POINTS], F.round("up", 6).alias("up"))


_CHAIN = {"cl": "p50", "hi": "p75", "lo": "p25"}
_BY_DAY = ", ".join(f"max(p50 + {STRETCH} * ({p} - p50)) FILTER (f = '{f}{k}') AS {f}{k}" for f, p in _CHAIN.items() for k in range(1, DAYS + 1))
_RUN = ", ".join(f"{f}{k} * 1.0::double AS c_{f}{k}" if k == 1 else f"((1 + c_{f}{k - 1}) * (1 + {f}{k}) - 1) * {max(0.6, 1 - 0.04 * (k - 1)):.2f}::double AS c_{f}{k}" for f in _CHAIN for k in range(1, DAYS + 1))
_LONG = " UNION ALL ".join(f"SELECT code, {k} AS day, " + ", ".join(f"round(c_{f}{k} + 1e-12, 7) AS cum_{f}" for f in _CHAIN) + f" FROM r WHERE cl{k} IS NOT NULL" for k in range(1, DAYS + 1))


@query(f"{BOUND}, {_SAMPLES}, {_quantiles_sql([f'{f}{k}' for f in FIELDS for k in range(1, DAYS + 1)])}, d AS (SELECT code, {_BY_DAY} FROM q GROUP BY code), r AS (SELECT *, {_RUN} FROM d) {_LONG}")
def sim_11_multi_day_forecast(spark, d):
    """The next ten days from medians and quartiles of what followed similar days, compounded; each day's total is drawn
    towards zero, the more the farther off it is."""
    q = _quantiles(_samples(spark, d), [f"{f}{k}" for f in FIELDS for k in range(1, DAYS + 1)])
    kind, day = F.left("f", F.lit(2)), F.expr("cast(substring(f, 3) as int)")
    move = F.col("p50") + STRETCH * (F.when(kind == "cl", F.col("p50")).when(kind == "hi", F.col("p75")).otherwise(F.col("p25")) - F.col("p50"))
    days = q.select("code", kind.alias("k"), day.alias("day"), move.alias("m")).groupBy("code", "k").agg(F.array_sort(F.collect_list(F.struct("day", "m"))).alias("x"))
    fade = lambda n: F.greatest(F.lit(0.6), 1 - 0.04 * (n - 1))
    step = lambda a, x: F.array_append(a, F.struct(x["day"].alias("day"), (((1 + F.coalesce(F.get(a, F.size(a) - 1)["c"], F.lit(0.0))) * (1 + x["m"]) - 1) * fade(x["day"])).alias("c")))
    run = days.select("code", "k", F.explode(F.aggregate("x", F.array().cast("array<struct<day:int,c:double>>"), step)).alias("y"))
    return run.groupBy("code", F.col("y.day").alias("day")).agg(*[F.round(F.max(F.when(F.col("k") == f, F.col("y.c"))) + 1e-12, 7).alias(f"cum_{f}") for f in FIELDS])


_LEVELS = "v AS (SELECT s.code, abs(s.x - l.x) * 100 AS score, 0.5 + s.w AS weight, CASE WHEN abs(s.x - l.x) <= 0.01 THEN 1 WHEN abs(s.x - l.x) <= 0.03 THEN 2 ELSE 3 END AS lvl FROM s JOIN l USING (code) WHERE s.cl1 IS NOT NULL)"


@query(f"""{BOUND}, {_SAMPLES}, l AS (SELECT code, arg_max(x, date) AS x FROM o WHERE x IS NOT NULL GROUP BY code), {_LEVELS},
g AS (SELECT code, count(*) AS n, stddev_pop(score) AS sd, avg((weight > 1)::int) AS good, count(DISTINCT lvl) AS lvls FROM v GROUP BY code),
h AS (SELECT *, CASE WHEN n < 3 THEN 0.5 WHEN n < 6 THEN 0.8 ELSE 1.0 END::double * CASE WHEN n > 1 THEN greatest(0.6, 1 - least(sd / 2, 0.4)) ELSE 1.0 END::double * (0.7 + 0.3 * good) * CASE lvls WHEN 3 THEN 1.0 WHEN 2 THEN 0.9 ELSE 0.7 END::double AS c FROM g)
SELECT code, n, lvls AS levels, round(c + 1e-9, 6) AS score, CASE WHEN c >= 0.6 THEN 'high' WHEN c >= 0.3 THEN 'mid' ELSE 'low' END AS confidence FROM h""")
def sim_12_confidence(spark, d):
    """How sure a forecast is: by the number of samples, how alike their distances are, the share of heavy ones, and how
    many levels have any. Samples are similar days, their levels how near they are to the code's last day."""
    w = I.seq()
    last = bars_bounded(spark, d).select("code", "date", F.round(I.change(F.col("close"), 20, w), 9).alias("x")).where("x is not null").groupBy("code").agg(F.max_by("x", "date").alias("l"))
    far = F.abs(F.col("x") - F.col("l"))
    v = _samples(spark, d).where("cl1 is not null").join(last, "code").select("code", (far * 100).alias("score"), (F.col("w") + 0.5).alias("weight"), F.when(far <= 0.01, 1).when(far <= 0.03, 2).otherwise(3).alias("lvl"))
    return M.confidence(v, ["code"], "score", "weight", "lvl")


_CTX = f"""c AS (SELECT code, date, row_number() OVER w AS i, vol, round((open / lag(close) OVER w - 1) * 100, 6) AS gap, {_VR} AS vr, round(lead(close) OVER w / close - 1, 9) AS y FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
x AS (SELECT date, round((avg(close) / lag(avg(close)) OVER (ORDER BY date) - 1) * 100, 6) AS idx FROM bars GROUP BY date),
k AS (SELECT code, c.date, gap, y, idx, CASE WHEN vr IS NULL THEN '?' WHEN round(vr, 9) > 1.2 THEN 'expand' WHEN round(vr, 9) < 0.8 THEN 'shrink' ELSE 'flat' END AS regime FROM c JOIN x USING (date)),
t AS (SELECT code, max(date) AS d, arg_max(gap, date) AS g, arg_max(regime, date) AS r FROM k WHERE gap IS NOT NULL GROUP BY code),
p AS (SELECT code, y, regime = r AND idx IS NOT NULL AND abs(idx) <= 0.8 AS ctx, abs(gap - g) <= 1 AS near FROM k JOIN t USING (code) WHERE date < d AND y IS NOT NULL AND gap IS NOT NULL),
n AS (SELECT code, CASE WHEN count(*) FILTER (ctx) >= 3 THEN 'context' WHEN count(*) FILTER (near) >= 3 THEN 'gap' ELSE 'all' END AS used FROM p GROUP BY code)"""


@query(f"{BOUND}, {_CTX} SELECT code, used, count(*) AS n, round(avg(y) + 1e-12, 7) AS mean_next, round(avg((y > 0)::int), 6) AS p_up FROM p JOIN n USING (code) WHERE CASE used WHEN 'context' THEN ctx WHEN 'gap' THEN near ELSE true END GROUP BY code, used")
def sim_8_context_filter(spark, d):
    """Which earlier days of a code count for its last: those of its volume regime on calm days of the index if there are
    three, else those whose opening gap is within a point of its own if there are three, else all."""
    w = I.seq()
    b = bars_bounded(spark, d)
    c = b.select("code", "date", F.round((F.col("open") / F.lag("close").over(w) - 1) * 100, 6).alias("gap"), vol_regime(F.round(I.volume_ratio(w), 9)).alias("regime"), F.round(F.lead("close").over(w) / F.col("close") - 1, 9).alias("y"))
    x = index_close(b).select("date", F.round((F.col("idx") / F.lag("idx").over(W.orderBy("date")) - 1) * 100, 6).alias("idx"))  # one row a day
    k = c.join(x, "date").where("gap is not null")
    t = k.groupBy("code").agg(F.max("date").alias("d"), F.max_by(F.struct(F.col("gap").alias("g"), F.col("regime").alias("r")), "date").alias("t"))
    p = k.join(t, "code").where("date < d and y is not null").select("code", "y", F.coalesce((F.col("regime") == F.col("t.r")) & (F.abs("idx") <= 0.8), F.lit(False)).alias("ctx"), (F.abs(F.col("gap") - F.col("t.g")) <= 1).alias("near"))
    return M.stratified(p, ["code"], {"context": "ctx", "gap": "near"}, 3).groupBy("code", "used").agg(F.count("*").alias("n"), F.round(F.avg("y") + 1e-12, 7).alias("mean_next"), F.round(F.avg((F.col("y") > 0).cast("int")), 6).alias("p_up"))


_RSI6 = RSI.replace("15::BIGINT", "7::BIGINT").replace("BETWEEN 2 AND 15", "BETWEEN 2 AND 7").replace("count(*) = 14", "count(*) = 6").replace("* 13", "* 5").replace("/ 14", "/ 6")


@query(_RSI6 + ", v AS (SELECT m.code, m.date, CASE WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / nullif(r.l, 0)) END AS v FROM m JOIN r ON r.code = m.code AND r.i = m.i), p AS (SELECT *, lag(v) OVER (PARTITION BY code ORDER BY date) AS p FROM v) SELECT code, date, CASE WHEN p < 20 THEN 'BUY' ELSE 'SELL' END AS side FROM p WHERE (p < 20 AND v >= 20) OR (p > 80 AND v <= 80)")
def sig_3_rsi(spark, d):
    return signals(spark, d).where("sig_rsi is not null").select("code", "date", F.col("sig_rsi").alias("side"))


@query(f"""{BOUND}, x AS (SELECT date, avg(close) / lag(avg(close)) OVER (ORDER BY date) - 1 AS r FROM bars GROUP BY date),
s AS (SELECT code, date, row_number() OVER w AS i, count(*) OVER (PARTITION BY code) AS n, CASE WHEN row_number() OVER w >= 20 THEN round(avg(close) OVER (w ROWS 19 PRECEDING), 9) END AS a, CASE WHEN row_number() OVER w >= 60 THEN round(avg(close) OVER (w ROWS 59 PRECEDING), 9) END AS b FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
p AS (SELECT s.*, lag(a) OVER w AS pa, lag(b) OVER w AS pb, r FROM s JOIN x USING (date) WINDOW w AS (PARTITION BY code ORDER BY date)),
e AS (SELECT code, date, CASE WHEN a > b AND pa <= pb AND a > pa AND coalesce(r > -0.012, true) THEN 'BUY' WHEN a < b AND pa >= pb THEN 'SELL' END AS side FROM p WHERE i > n - 120),
f AS (SELECT *, lag(side) OVER (PARTITION BY code ORDER BY date) AS before FROM e WHERE side IS NOT NULL) SELECT code, date, side FROM f WHERE before IS DISTINCT FROM side AND (before IS NOT NULL OR side = 'BUY')""")
def sig_13_trend_tracking(spark, d):
    """Crossings of the 20- and 60-row averages in a code's last 120 rows: up with a rising average on days on which the
    index doesn't fall by 1.2 %, and down after that."""
    w = I.seq()
    b = bars_bounded(spark, d)
    x = index_close(b).select("date", (F.col("idx") / F.lag("idx").over(W.orderBy("date")) - 1).alias("r"))  # one row a day
    s = b.select("code", "date", F.round(I.sma(F.col("close"), 20, w), 9).alias("a"), F.round(I.sma(F.col("close"), 60, w), 9).alias("b"), F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))).alias("back"))
    p = s.withColumns({"pa": F.lag("a").over(w), "pb": F.lag("b").over(w)}).where("back <= 120").join(x, "date")
    up = (F.col("a") > F.col("b")) & (F.col("pa") <= F.col("pb")) & (F.col("a") > F.col("pa")) & F.coalesce(F.col("r") > -0.012, F.lit(True))
    e = p.select("code", "date", S.side(up, (F.col("a") < F.col("b")) & (F.col("pa") >= F.col("pb"))).alias("side")).where("side is not null")
    before = F.lag("side").over(w)
    return e.withColumn("before", before).where("(before is null and side = 'BUY') or before != side").select("code", "date", "side")


@query()
def sig_11_weighted_scores(spark, d):
    """The rules' points in a weighted sum per bar; without chips and pauses."""
    return S.score(signals(spark, d), S.WEIGHTS, "points").select("code", "date", F.round("points", 4).alias("points")).where("points is not null")
