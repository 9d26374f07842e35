"""Buy and sell signals: crossings and scores as columns; only alternation with a cooldown needs a pass per code."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as I
from tidemark.operators.recursive import chip_factors
from tidemark.operators.similarity import own_series


@dataclass(frozen=True)
class Risk:
    atr_mult: float
    trail_trigger: float
    trail_ratio: float
    buy_th: int
    cooldown: int


# The three risk settings.
PRESETS = {"conservative": Risk(1.5, 1.01, 0.96, 3, 8), "balanced": Risk(1.5, 1.02, 0.94, 2, 5), "aggressive": Risk(2.5, 1.05, 0.90, 1, 3)}
SELL_AT = -2
# The weights of the rules' points in the weighted sum.
WEIGHTS = {"macd": 1.1, "kdj": 0.9, "rsi": 0.9, "volume": 1.0, "trend": 1.0, "boll": 0.8, "adx": 0.8}


def side(up: Column, down: Column) -> Column:
    return F.when(up, "BUY").when(down, "SELL")


def signal_columns(ind: DataFrame) -> DataFrame:
    """ind (with_recursive) with a column per rule: sig_macd, sig_kdj, sig_rsi, sig_boll, sig_ma, null where none."""
    w = I.seq()
    c = F.col("close")
    up = lambda a, b: I.crossed_up(F.col(a), F.col(b), w)
    dn = lambda a, b: I.crossed_down(F.col(a), F.col(b), w)
    x = ind.withColumns({"i": F.row_number().over(w) - 1, "m20": I.sma(c, 20, w), "m60": I.sma(c, 60, w), "sd20": I.roll(F.stddev_pop, c, 20, w)})
    x = x.withColumns({"b_up": F.col("m20") + 2 * F.col("sd20"), "b_low": F.col("m20") - 2 * F.col("sd20")})
    through = lambda level, rising: F.coalesce((F.lag("rsi6").over(w) < level) & (F.col("rsi6") >= level) if rising else (F.lag("rsi6").over(w) > level) & (F.col("rsi6") <= level), F.lit(False))
    return x.withColumns(
        {
            "sig_macd": F.when(F.col("i") >= 9, side(up("dif", "dea"), dn("dif", "dea"))),
            "sig_kdj": F.when(F.col("i") >= 3, side(up("k", "d") & (F.col("k") < 45), dn("k", "d") & (F.col("k") > 65))),
            "sig_rsi": side(through(20, True), through(80, False)),
            "sig_boll": side(F.coalesce((F.lag("close").over(w) <= F.lag("b_low").over(w)) & (c > F.col("b_low")), F.lit(False)), F.coalesce((F.lag("close").over(w) >= F.lag("b_up").over(w)) & (c < F.col("b_up")), F.lit(False))),
            "sig_ma": F.when(F.col("i") >= 60, side(up("m20", "m60"), dn("m20", "m60"))),
        }
    )


# Rules of price and volume alone, and those that look at the code's industry too.
COLUMN_RULES = ("macd", "kdj", "rsi", "boll", "ma")
INDUSTRY = ("lvl", "ma_lvl", "mom", "md", "ind_day")


def pattern_side(close: np.ndarray) -> np.ndarray:
    """SIG-6: every fifth bar, 1 where at least 60 % of the best own matches rose, -1 where at most 40 % did; five
    outcomes are needed."""
    out = np.zeros(len(close), np.int8)
    for i, up, _, n, _ in own_series(close):
        if up is not None and n >= 5:
            out[i] = 1 if up >= 0.6 else -1 if up <= 0.4 else 0
    return out


def chip_side(low: np.ndarray, high: np.ndarray, close: np.ndarray, vol: np.ndarray) -> np.ndarray:
    """SIG-8: mostly loss and near support buys, mostly profit sells; from a quarter of the bars on, the 251st at latest."""
    f = chip_factors(low, high, close, vol, min(250, len(close) // 4))
    with np.errstate(invalid="ignore"):
        return np.where((f[:, 2] < 0.35) & (f[:, 0] > -0.04), 1, np.where(f[:, 2] > 0.9, -1, 0)).astype(np.int8)


def industry_sides(close: np.ndarray, lvl: np.ndarray, ma: np.ndarray, mom: np.ndarray, md: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SIG-7 and SIG-9, every third bar from the sixth on: the industry against its own average, and against the
    median industry with the code's five-bar return beside it."""
    i = np.arange(len(close))
    due = (i >= 5) & ((i - 5) % 3 == 0)
    r5 = np.full(len(close), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        r5[5:] = np.round(close[5:] / close[:-5] - 1, 9)
        own = due & (j > 20)
        l2 = np.where(own & (lvl > ma) & (mom > 0), 1, np.where(own & (lvl < ma) & (mom < 0), -1, 0))
        rot = np.where(due & (mom > md) & (r5 > 0.0101), 1, np.where(due & (mom < md) & (r5 < 0), -1, 0))
    return l2.astype(np.int8), rot.astype(np.int8)


def with_industry(frame: DataFrame, sector: DataFrame, inst: DataFrame) -> DataFrame:
    """frame with INDUSTRY of each code's industry on each day (sector: industry, date, lvl, ma, mom, md), null where
    there is none."""
    q = sector.select("industry", "date", "lvl", F.col("ma").alias("ma_lvl"), "mom", "md", F.row_number().over(I.seq("industry")).alias("ind_day"))
    return frame.join(inst.select("code", "industry"), "code", "left").join(q, ["industry", "date"], "left").drop("industry")


def bar_sides(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """1, -1 or 0 per bar for every rule but the composite, of one code's bars in order of date."""
    out = {a: np.where(pdf[f"sig_{a}"] == "BUY", 1, np.where(pdf[f"sig_{a}"] == "SELL", -1, 0)).astype(np.int8) for a in COLUMN_RULES}
    o = {x: pdf[x].to_numpy(float) for x in ("low", "high", "close", "vol", *INDUSTRY)}
    out["l1_pattern"] = pattern_side(o["close"])
    out["l2_ind"], out["sector_rot"] = industry_sides(o["close"], *[o[x] for x in INDUSTRY])
    out["chip_peak"] = chip_side(o["low"], o["high"], o["close"], o["vol"])
    return out


def registry(scored: DataFrame, preset: str = "balanced") -> DataFrame:
    """algo, code, buys, sells of every registered rule over each code's bars (scored, with INDUSTRY); rules without a
    signal give no row. The composite goes by `preset`."""
    kind = dict(scored.dtypes)["code"]
    risk = PRESETS[preset]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        sides = bar_sides(pdf) | {"composite": alternate(pdf["score"].to_numpy(float), np.full(len(pdf), risk.buy_th), SELL_AT, risk.cooldown)}
        rows = [(a, pdf["code"][0], int((s > 0).sum()), int((s < 0).sum())) for a, s in sides.items() if s.any()]
        return pd.DataFrame(rows, columns=["algo", "code", "buys", "sells"])

    cols = ["code", "date", "low", "high", "close", "vol", "score", *INDUSTRY, *[f"sig_{a}" for a in COLUMN_RULES]]
    return scored.select(*cols).groupBy("code").applyInPandas(run, f"algo string, code {kind}, buys long, sells long")


def drop_repeats(events: DataFrame, keys: list[str], order: str, what: str) -> DataFrame:
    """Events whose side differs from the event before."""
    from pyspark.sql import Window as W

    before = F.lag(what).over(W.partitionBy(*keys).orderBy(order))
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(what))).drop("_b")


def score(sig: DataFrame, weights: dict[str, float] | None = None, name: str = "score") -> DataFrame:
    """Adds `score`, the sum of the rules' points, null in the warm-up of MACD: an integer, or a weighted sum."""
    w = I.seq()
    c, p = F.col("close"), F.lag("close").over(w)
    two = lambda s, more, less: F.when(F.col(s) == "BUY", 2).when(F.col(s) == "SELL", -2).when(more, 1).when(less, -1).otherwise(0)
    macd = F.when(I.crossed_up(F.col("dif"), F.col("dea"), w), 2).when(I.crossed_down(F.col("dif"), F.col("dea"), w), -2).when(F.col("dif") > F.col("dea"), 1).otherwise(-1)
    kdj = two("sig_kdj", F.col("k") > F.col("d"), F.lit(True))
    rsi = F.when(F.lag("rsi6").over(w).isNull() | F.col("rsi6").isNull(), 0).otherwise(two("sig_rsi", F.col("rsi6") < 30, F.col("rsi6") > 70))
    v5 = F.avg("vol").over(w.rowsBetween(-5, -1))
    heavy = F.coalesce(F.col("vol") > 1.5 * v5, F.lit(False)) & (v5 > 0)
    volume = F.when(heavy & (c > p), 1).when(heavy & (c < p), -1).otherwise(0)
    m, mp = F.col("m20"), F.lag("m20").over(w)
    trend = F.when((c > m) & (m > mp), 1).when((c < m) & (m < mp), -1).otherwise(0)
    boll = F.when(c < F.col("b_low"), 1).when(c > F.col("b_up"), -1).otherwise(0)
    strong = F.when(F.col("adx") >= 20, F.when(F.col("pdi") > F.col("mdi"), 1).otherwise(-1)).otherwise(0)
    points = {"macd": macd, "kdj": kdj, "rsi": rsi, "volume": volume, "trend": trend, "boll": boll, "adx": strong}
    total = sum((c if weights is None else c * float(weights[k]) for k, c in points.items()), F.lit(0))
    ready = F.col("dea").isNotNull() & F.lag("dea").over(w).isNotNull()
    return sig.withColumn(name, F.when(ready, total))


def alternate(value: np.ndarray, buy: np.ndarray, sell: int, cooldown: int) -> np.ndarray:
    """1 and -1 where a score triggers: buys at `buy` or more, sells at `sell` or less, in turn, with a pause of
    `cooldown` rows after each. A missing score can't trigger. The loop runs over candidate rows only."""
    out = np.zeros(len(value), np.int8)
    with np.errstate(invalid="ignore"):
        want = np.where(value >= buy, 1, np.where(value <= sell, -1, 0))
    state, free = 0, 0
    for i in np.flatnonzero(want):
        if i >= free and want[i] != state:
            out[i] = state = want[i]
            free = i + cooldown + 1
    return out


def composite(scored: DataFrame, weak: DataFrame | None = None, last: int = 1000) -> DataFrame:
    """code, preset, date, i, side of the composite rule, for each preset, over a code's last `last` bars.

    weak: dates on which one more point is asked for. Codes under 60 bars have none.
    """
    kind = dict(scored.dtypes)["code"]
    x = scored.select("code", "date", "i", F.col("score").cast("double").alias("score"))
    x = x.withColumn("weak", F.lit(0)) if weak is None else x.join(weak.select("date", F.lit(1).alias("weak")), "date", "left").fillna(0, ["weak"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        parts = []
        if len(pdf) >= 60:
            pdf = pdf.iloc[max(1, len(pdf) - last) :]
            v, more = pdf["score"].to_numpy(), pdf["weak"].to_numpy()
            for name, r in PRESETS.items():
                s = alternate(v, r.buy_th + more, SELL_AT, r.cooldown)
                hit = s != 0
                parts.append(pd.DataFrame({"code": pdf["code"][hit], "preset": name, "date": pdf["date"][hit], "i": pdf["i"][hit], "side": np.where(s[hit] > 0, "BUY", "SELL")}))
        return pd.concat(parts) if parts else pd.DataFrame({"code": [], "preset": [], "date": [], "i": [], "side": []})

    return x.groupBy("code").applyInPandas(run, f"code {kind}, preset string, date date, i int, side string")
