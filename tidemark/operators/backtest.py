"""Event back-tests of signals per instrument, the choice among candidates, and portfolios that fold over days."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.signals import COLUMN_RULES, INDUSTRY, PRESETS, SELL_AT, Risk, alternate, bar_sides


def atr14(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Mean true range of the last 14 bars, 0 for the first 14."""
    out = np.zeros(len(c))
    if len(c) > 14:
        tr = np.maximum.reduce([h[1:] - low[1:], np.abs(h[1:] - c[:-1]), np.abs(low[1:] - c[:-1])])
        run = np.cumsum(np.append(0.0, tr))
        out[14:] = (run[14:] - run[:-14]) / 14
    return out


@dataclass
class Outcome:
    trades: list[float]
    curve: np.ndarray
    floating: float | None


def hold_from(entry: float, at: int, stop: int, o: np.ndarray, h: np.ndarray, low: np.ndarray, atr: np.ndarray, risk: Risk) -> tuple[int, float] | None:
    """The first bar after `at` and before `stop` on which the stop order fills, and its price; None if none does.

    The order for a bar is set from what was known the day before: its ATR and the highest price until then. All
    bars of the holding are looked at together.
    """
    i = np.arange(at + 1, stop)
    if not len(i):
        return None
    top = np.maximum.accumulate(np.append(entry, h[at + 1 : stop - 1]))
    before = atr[i - 1]
    order = np.where(before > 0, entry - risk.atr_mult * before, entry * 0.95)
    order = np.where(top > entry * risk.trail_trigger, top * risk.trail_ratio, order)
    hit = np.flatnonzero(low[i] <= order)
    if not len(hit):
        return None
    k = hit[0]
    return int(i[k]), float(o[i[k]] if 0 < o[i[k]] <= order[k] else order[k])


def run_events(bars: dict[str, np.ndarray], side: np.ndarray, risk: Risk, i0: int = 0, i1: int | None = None, reenter: bool = True, at_open: bool = False) -> Outcome:
    """Trade the sides (1, -1 or 0 per bar): a signal fills on the next bar, at its close or open.

    reenter: a buy that fills on the bar of a stop opens a new position. The last position stays open: it marks the
    curve and is no trade.
    """
    o, h, low, c = (bars[x] for x in ("open", "high", "low", "close"))
    i1 = len(c) if i1 is None else min(i1, len(c))
    atr = bars["atr"]
    due = np.append(0, side[:-1])
    fill = np.where(o > 0, o, c) if at_open else c
    buys, sells = (np.flatnonzero((due == s) & (np.arange(len(c)) >= i0) & (np.arange(len(c)) < i1)) for s in (1, -1))
    buys = buys[c[buys] > 0]
    curve, trades, eq, done, floating = np.ones(i1 - i0), [], 1.0, i0, None
    at = i0
    while True:
        j = np.searchsorted(buys, at)
        if j == len(buys):
            break
        b = int(buys[j])
        entry = float(fill[b])
        k = np.searchsorted(sells, b, side="right")
        s = int(sells[k]) if k < len(sells) else i1
        out = hold_from(entry, b, min(s + 1, i1), o, h, low, atr, risk)
        curve[done - i0 : b - i0] = eq
        if out is None and s >= i1:
            curve[b - i0 :] = eq * c[b:i1] / entry
            floating, done = float(c[i1 - 1] / entry - 1), i1
            break
        end, price = out if out is not None else (s, float(fill[s]))
        curve[b - i0 : end - i0] = eq * c[b:end] / entry
        eq *= price / entry
        trades.append(price / entry - 1)
        again = out is not None and reenter and end > b
        done, at = (end, end) if again and end in buys else (end + 1, end + 1)
        curve[end - i0] = eq
    curve[done - i0 :] = eq if done < i1 else curve[done - i0 :]
    return Outcome(trades, curve, floating)


def measures(out: Outcome, days: int, floor: float) -> dict:
    """Of a run: closed trades, wins, winrate, pf (null without losses), total, ann, mdd."""
    t = np.array(out.trades)
    total = float(out.curve[-1]) if len(out.curve) else 1.0
    years = max(days / 365.25, floor)
    loss = float(-t[t <= 0].sum()) if len(t) else 0.0
    return {"trades": len(t), "wins": int((t > 0).sum()), "winrate": float((t > 0).mean()) if len(t) else None, "pf": float(t[t > 0].sum()) / loss if loss > 1e-9 else None, "total": total - 1, "ann": total ** (1 / years) - 1 if total > 0 else -1.0, "mdd": float((out.curve / np.maximum.accumulate(out.curve) - 1).min()) if len(out.curve) else 0.0}


RULES = (*COLUMN_RULES, "l1_pattern", "l2_ind", "chip_peak", "sector_rot", "composite")
MEASURES = "trades int, wins int, winrate double, pf double, total double, ann double, mdd double"
ABLATION = f"code long, algo string, preset string, segment string, {MEASURES}"


def _composite(pdf: pd.DataFrame, risk: Risk) -> np.ndarray:
    return alternate(pdf["score"].to_numpy(float), np.full(len(pdf), risk.buy_th), SELL_AT, risk.cooldown)


def prepared(pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    pdf = pdf.sort_values("date", ignore_index=True)
    bars = {x: pdf[x].to_numpy(float) for x in ("open", "high", "low", "close")}
    bars["atr"] = atr14(bars["high"], bars["low"], bars["close"])
    return pdf, bars


def ablation(scored: DataFrame, last: int = 1000, least: int = 200) -> DataFrame:
    """Every rule with every preset on each code's training part (all but the last quarter, 200 bars at least) and
    validation part: one row each; parts with fewer than two closed trades give none. Codes under `least` bars give none.

    scored: with signals.INDUSTRY. Patterns, chips and the strides of the industry rules see the last `last` bars only.
    All candidates of a code are run in one group, on arrays made once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _ = prepared(pdf)
        pdf = pdf.iloc[-last:].reset_index(drop=True)
        rows = []
        if len(pdf) >= least:
            pdf, bars = prepared(pdf)
            n, val = len(pdf), max(200, len(pdf) // 4)
            dates = pd.to_datetime(pdf["date"])
            sides = bar_sides(pdf)
            for algo in RULES:
                for name, risk in PRESETS.items():
                    side = _composite(pdf, risk) if algo == "composite" else sides[algo]
                    for seg, a, z in (("train", 0, n - val), ("val", n - val, n)):
                        if z - a < 30:
                            continue
                        out = run_events(bars, side, risk, a, z)
                        if len(out.trades) >= 2:
                            rows.append({"code": pdf["code"][0], "algo": algo, "preset": name, "segment": seg, **measures(out, (dates[z - 1] - dates[a]).days, 0.25)})
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ABLATION.split(", ")])

    cols = ["code", "date", "open", "high", "low", "close", "vol", "score", *INDUSTRY, *[f"sig_{a}" for a in COLUMN_RULES]]
    return scored.select(*cols).groupBy("code").applyInPandas(run, ABLATION)


def single(scored: DataFrame, preset: str = "balanced") -> DataFrame:
    """The composite rule on each code's whole history, without re-entry on the day of a stop; ann counts from the
    first signal, floating is the open position's gain."""
    schema = f"code long, {MEASURES}, floating double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, bars = prepared(pdf)
        risk = PRESETS[preset]
        side = _composite(pdf, risk)
        first = np.flatnonzero(side)
        if len(pdf) < 30 or not len(first):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        out = run_events(bars, side, risk, reenter=False)
        d = pd.to_datetime(pdf["date"])
        return pd.DataFrame([{"code": pdf["code"][0], **measures(out, (d.iloc[-1] - d[first[0]]).days, 1e-9), "floating": out.floating}])

    return scored.select("code", "date", "open", "high", "low", "close", "score").groupBy("code").applyInPandas(run, schema)


# Weights of the four training measures, for the steady and for the bolder choice.
CHOICE = {"steady": {"calmar": 0.45, "pf": 0.25, "winrate": 0.20, "ann": 0.10}, "bold": {"calmar": 0.30, "pf": 0.20, "winrate": 0.15, "ann": 0.35}}


def choose(cands: DataFrame, objective: str = "steady") -> DataFrame:
    """The best candidate of each code by ranked training measures: those with eight trades, else three, else any."""
    t = cands.where("segment = 'train'")
    whole = W.partitionBy("code")
    level = F.when(F.col("trades") >= 8, 2).when(F.col("trades") >= 3, 1).otherwise(0)
    t = t.withColumn("_l", level).withColumn("_m", F.max("_l").over(whole)).where("_l = _m")
    t = t.withColumns({"calmar": F.col("ann") / F.greatest(F.abs("mdd"), F.lit(0.05)), "pf": F.least(F.coalesce("pf", F.lit(0.0)), F.lit(5.0)), "winrate": F.coalesce("winrate", F.lit(0.0))})
    order = [F.col("algo"), F.col("preset")]
    n = F.count("*").over(whole)
    score = F.lit(0.0)
    for m, w in CHOICE[objective].items():
        score = score + w * F.row_number().over(whole.orderBy(F.round(m, 9), *order)) / n
    t = t.withColumn("choice", F.round(score, 9))
    best = F.row_number().over(whole.orderBy(F.desc("choice"), *order))
    return t.withColumn("_b", best).where("_b = 1").select("code", "algo", "preset", "choice")


# ---- portfolios ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tier:
    """A rotation: `top` names, rebalanced every `reb` days; mom_w weighs momentum against low volatility."""

    name: str
    mom_w: float
    top: int
    reb: int
    gate: bool
    universe: str = "all"


@dataclass(frozen=True)
class Costs:
    commission: float = 2.5e-4
    least: float = 5.0
    stamp: float = 5e-4
    transfer: float = 1e-5
    slip: float = 1e-3
    lot: int = 100
    stale: int = 20


class Phase:
    """One portfolio that started on day `start` of its tier; only its holdings are kept between days."""

    def __init__(self, tier: Tier, start: int, capital: float, costs: Costs) -> None:
        self.tier, self.start, self.cash, self.costs = tier, start, capital, costs
        self.held: dict = {}  # code -> [shares, cost a share, day, last price, days without one]
        self.target: set = set()
        self.trades: list[tuple] = []

    def _sell(self, code, t: int, px: float, why: str) -> None:
        n, cost, day, _, _ = self.held.pop(code)
        c, amount = self.costs, n * px
        net = amount - max(amount * c.commission, c.least) - amount * (c.stamp + c.transfer)
        self.cash += net
        self.trades.append((code, net / (n * cost) - 1, t - day, why))
        self.target.discard(code)

    def worth(self) -> float:
        return self.cash + sum(p[0] * p[3] for p in self.held.values())

    def day(self, t: int, price: dict, up: set, down: set, ranked: list, on: bool) -> float:
        """price: today's close by code; up, down: codes at their limit; ranked: yesterday's candidates, best first."""
        c = self.costs
        for code, p in list(self.held.items()):
            if code in price:
                p[3], p[4] = price[code], 0
            else:
                p[4] += 1
                if p[4] >= c.stale:
                    self._sell(code, t, p[3], "gone")
        turn = t > self.start and (t - self.start) % self.tier.reb == 0
        if turn:
            self.target = set(ranked[: self.tier.top]) if on else set()
        for code in [x for x in self.held if x not in self.target and x in price and x not in down]:
            self._sell(code, t, price[code] * (1 - c.slip), "target" if on else "gate")
        if turn and on:
            share = self.worth() / self.tier.top
            for code in ranked:
                if len(self.held) >= self.tier.top:
                    break
                if code in self.held or code not in price or code in up:
                    continue
                px = price[code] * (1 + c.slip)
                n = int(min(share, self.cash) / (px * c.lot)) * c.lot
                fee = max(n * px * c.commission, c.least) + n * px * c.transfer
                if n <= 0 or n * px + fee > self.cash:
                    continue
                self.cash -= n * px + fee
                self.held[code] = [n, (n * px + fee) / n, t, price[code], 0]
        return self.worth()


EQUITY = "tier string, phase int, date date, equity double, trades int, wins int, gain double, loss double"


def fold(days: DataFrame, tiers: list[Tier], capital: float = 1e6, costs: Costs = Costs()) -> DataFrame:
    """Equity of every phase of every tier on every day, with the day's closed trades.

    days: tier, date, code, close, rank (1 is best; null if no candidate on that day), lim_up, lim_dn, on (gate).
    A tier's rows reach one task in order of date and are streamed through it: it holds a day and the positions, not
    the history. Tiers run in parallel; phases of a tier share each day's rows.
    """
    by = {t.name: t for t in tiers}
    names = ["tier", "phase", "date", "equity", "trades", "wins", "gain", "loss"]

    def whole_days(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        kept = None
        for b in batches:
            b = b if kept is None else pd.concat([kept, b], ignore_index=True)
            key = b["tier"].astype(str) + b["date"].astype(str)
            edge = np.flatnonzero((key != key.shift()).to_numpy())
            for a, z in zip(edge[:-1], edge[1:]):
                yield (b["tier"][a], b["date"][a]), b.iloc[a:z]
            kept = b.iloc[edge[-1] :].reset_index(drop=True) if len(edge) else None
        if kept is not None and len(kept):
            yield (kept["tier"][0], kept["date"][0]), kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, t, phases, ranked, out = None, 0, [], [], []
        for (tier, date), g in whole_days(batches):
            if tier != now:
                now, t, ranked = tier, 0, []
                phases = [Phase(by[tier], p, capital, costs) for p in range(by[tier].reb)]
            g = g[g["close"] > 0]
            price = dict(zip(g["code"], g["close"]))
            up, down = set(g["code"][g["lim_up"]]), set(g["code"][g["lim_dn"]])
            on = bool(g["on"].iloc[0]) if len(g) else True
            for k, p in enumerate(phases):
                if t >= p.start:
                    seen = len(p.trades)
                    eq = p.day(t, price, up, down, ranked, on)
                    r = np.array([x[1] for x in p.trades[seen:]])
                    out.append((tier, k, date, eq, len(r), int((r > 0).sum()), float(r[r > 0].sum()), float(-r[r <= 0].sum())))
            ok = g[g["rank"].notna()].sort_values("rank", kind="stable")
            ranked, t = ok["code"].tolist(), t + 1
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    cols = ["tier", "date", "code", "close", "rank", "lim_up", "lim_dn", "on"]
    return days.select(*cols).repartition(len(tiers), "tier").sortWithinPartitions("tier", "date", "rank", "code").mapInPandas(run, EQUITY)


def tier_days(feat: DataFrame, gate: DataFrame, tiers: list[Tier], min_price: float = 1.0, min_bars: int = 60, min_amount: float = 0.0, limit: float = 0.10) -> DataFrame:
    """Rows for `fold`: the blend of momentum and low-volatility ranks of each day, for each tier.

    feat: code, date, close, ret20, vol20, amt20, n. gate: date, gate (of the morning). Ranks are made once for each
    day and weighed for each tier.
    """
    from tidemark.operators.windows import change, rank01, seq

    ok = (F.col("close") > min_price) & (F.col("n") >= min_bars) & (F.col("amt20") >= min_amount)
    x = feat.withColumns({"r": F.round(change(F.col("close"), 1, seq()), 9), "ret20": F.round("ret20", 9), "vol20": F.round("vol20", 9)})
    x = x.withColumns({"_m": rank01("ret20", ["date"], "code"), "_v": rank01("vol20", ["date"], "code")})
    x = x.select("date", "code", "close", F.coalesce(F.col("r") >= limit - 0.005, F.lit(False)).alias("lim_up"), F.coalesce(F.col("r") <= 0.005 - limit, F.lit(False)).alias("lim_dn"), ok.alias("ok"), "_m", "_v")
    each = F.explode(F.array(*[F.struct(F.lit(t.name).alias("tier"), F.lit(t.mom_w).alias("w"), F.lit(t.gate).alias("gated")) for t in tiers]))
    y = x.join(F.broadcast(gate), "date", "left").withColumn("t", each)
    score = F.when(F.col("ok"), F.round(F.col("t.w") * F.col("_m") + (1 - F.col("t.w")) * (1 - F.col("_v")), 9))
    y = y.select(F.col("t.tier").alias("tier"), "date", "code", "close", score.alias("score"), "lim_up", "lim_dn", (~F.col("t.gated") | F.coalesce("gate", F.lit(False))).alias("on"))
    w = W.partitionBy("tier", "date").orderBy(F.desc_nulls_last("score"), "code")
    return y.withColumn("rank", F.when(F.col("score").isNotNull(), F.row_number().over(w)))


def phase_mean(equity: DataFrame, tiers: list[Tier], capital: float = 1e6) -> DataFrame:
    """tier, date, v: the mean over a tier's phases of equity over capital, from the day on which all have started."""
    reb = F.create_map(*[x for t in tiers for x in (F.lit(t.name), F.lit(t.reb))])
    g = equity.groupBy("tier", "date").agg(F.avg("equity").alias("v"), F.count("*").alias("n"))
    return g.where(F.col("n") == reb[F.col("tier")]).select("tier", "date", (F.col("v") / capital).alias("v"))
