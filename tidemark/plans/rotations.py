"""Queries for rotations with exits, fills and masks (BT-14, BT-16, BT-18, BT-21)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import crosssec as X
from tidemark.operators import rotation as R
from tidemark.operators import windows as I
from tidemark.plans.declare import declare
from tidemark.sources.tables import cut
from tidemark.sources.views import bars_bounded, index_close

QUERIES, SQL, query = declare()
TRIED = 40


def _features(spark, d):
    """Bars with three scores (momentum, low volatility, both), an exit by the average, limits and the index mask."""
    w = I.seq()
    b = bars_bounded(spark, d).withColumn("r", F.round(I.change(F.col("close"), 1, w), 9))
    f = b.withColumns({"m": F.round(I.change(F.col("close"), 20, w), 9), "s": F.round(I.roll(F.stddev_pop, F.col("r"), 20, w), 9), "ma": F.round(I.sma(F.col("close"), 20, w), 9)})
    f = f.withColumns({"_m": I.rank01("m", ["date"], "code"), "_s": I.rank01("s", ["date"], "code")})
    x = index_close(b).select("date", "idx", F.lag("idx").over(W.orderBy("date")).alias("_i"), F.avg("idx").over(W.orderBy("date").rowsBetween(-20, -1)).alias("_a"))  # one row a day
    x = x.select("date", F.coalesce(F.col("_i") >= F.col("_a"), F.lit(False)).alias("on"))
    f = f.join(F.broadcast(x), "date")
    return f.select("code", "date", "open", "close", "m", "_m", "_s", F.coalesce(F.col("close") < F.col("ma"), F.lit(False)).alias("below"), F.coalesce(F.col("r") >= 0.095, F.lit(False)).alias("lim_up"), F.coalesce(F.col("r") <= -0.095, F.lit(False)).alias("lim_dn"), "on")


def _kinds(f, scores: dict, below: bool = False):
    """A copy of the rows for each kind (score), for they are folded side by side."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.round(s, 9).alias("score")) for k, s in scores.items()]))
    return f.withColumn("_e", each).select(F.col("_e.kind").alias("kind"), "code", "date", "open", "close", F.col("_e.score").alias("score"), (F.col("below") if below else F.lit(False)).alias("exit"), "lim_up", "lim_dn", "on")


def _scores():
    return {"momentum": F.col("_m"), "calm": 1 - F.col("_s"), "both": 0.5 * F.col("_m") + 0.5 * (1 - F.col("_s"))}


def grid() -> dict[str, list[R.Rotation]]:
    """108 settings: three scores, three sizes, three ages, masked or not, filled at the open or the close."""
    out: dict[str, list[R.Rotation]] = {}
    for s in ("momentum", "calm", "both"):
        for masked in (False, True):
            kind = f"{s}_{'mask' if masked else 'free'}"
            out[kind] = [R.Rotation(f"{kind}_t{top}_h{hold}_{'open' if o else 'close'}", top, hold, o, masked) for top in (5, 10, 20) for hold in (5, 10, 20) for o in (True, False)]
    return out


def _metrics(e):
    m = X.curve_metrics(e, ["name"], "date", "v")
    t = e.groupBy("name").agg(F.sum("trades").alias("trades"), F.round(F.try_divide(F.sum("wins"), F.sum("trades")), 6).alias("winrate"), F.round(F.try_divide(F.sum("gain"), F.sum("loss")), 6).alias("pf"))
    return m.join(t, "name").select("name", *[F.round(c, 6).alias(c) for c in ("total", "ann", "mdd", "sharpe")], "days", "trades", "winrate", "pf")


@query()
def bt_16_rotation_grid(spark, d):
    """All settings of the grid: return, a year's rate, deepest fall, trades, win rate and profit factor of each."""
    rules = grid()
    s = _scores()
    rows = R.candidates(_kinds(_features(spark, d), {k: s[k.split("_")[0]] for k in rules}), TRIED)
    return _metrics(cut(R.rotate(rows, rules), "rotations"))


@query()
def bt_18_pick_rotation(spark, d):
    """Picks of every fifth day, bought at the next open; out when below the average or after four such days."""
    rules = {"momentum": [R.Rotation("picks", 10, 20, every=5)]}
    return _metrics(cut(R.rotate(R.candidates(_kinds(_features(spark, d), {"momentum": _scores()["momentum"]}, below=True), TRIED), rules), "picks"))


def exits() -> list[R.Rotation]:
    return [R.Rotation(f"stop{int(100 * (s or 0))}_trail{int(100 * (t or 0))}_pause{p}", 10, 60, True, True, s, t, p, off_sells=True) for s in (None, 0.03, 0.06) for t in (None, 0.04, 0.08) for p in (0, 5)]


@query()
def bt_14_21_exit_sweep(spark, d):
    """Stops, ratchets and pauses, with all sold while the mask is off: each setting in every year, and which of them the
    years before would have chosen (walk-forward)."""
    rules = {"momentum": exits()}
    e = cut(R.rotate(R.candidates(_kinds(_features(spark, d), {"momentum": _scores()["momentum"]}), TRIED), rules), "exits")
    y = e.withColumn("year", F.year("date"))
    ends = y.groupBy("name", "year").agg(F.max_by("v", "date").alias("z"), F.min_by("v", "date").alias("a"), F.sum("trades").alias("trades"))
    w = W.partitionBy("name").orderBy("year")  # a row a year
    seg = ends.withColumn("ret", F.round(F.col("z") / F.coalesce(F.lag("z").over(w), F.col("a")) - 1, 6))
    past = F.avg("ret").over(w.rowsBetween(W.unboundedPreceding, -1))
    best = F.row_number().over(W.partitionBy("year").orderBy(F.desc_nulls_last("past"), "name"))
    return seg.withColumn("past", F.round(past, 9)).withColumn("chosen", F.col("past").isNotNull() & (best == 1)).select("name", "year", "ret", "trades", "chosen")
