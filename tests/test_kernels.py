"""Recursive indicators, back-tests and portfolios against plain loops, and properties that must hold."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.plugins import Plugin, Registry
from tidemark.operators import backtest as B
from tidemark.operators import recursive as R
from tidemark.operators.crosssec import bh_fdr
from tidemark.operators.signals import PRESETS, alternate
from tidemark.operators.similarity import greedy_apart
from tidemark.sources import formats as P


def walk(n, seed=0):
    g = np.random.default_rng(seed)
    c = 20 * np.exp(np.cumsum(g.normal(0, 0.03, n)))
    o = c * np.exp(g.normal(0, 0.02, n))
    return {"open": o, "high": np.maximum(o, c) * 1.01, "low": np.minimum(o, c) * 0.99, "close": c}


def test_constant_and_ramp():
    c = np.full(70, 10.0)
    assert np.isnan(R.rsi(c, 14)[:14]).all() and (R.rsi(c, 14)[14:] == 100).all()
    k, d, j = R.kdj(c, c, c)
    assert np.allclose(k, 50) and np.allclose(d, 50) and np.allclose(j, 50)
    up = 10 * 1.01 ** np.arange(130)
    dif, dea, hist = R.macd(up)
    assert (dif[1:] > 0).all() and np.isnan(dea[:8]).all() and np.isfinite(dea[8:]).all()
    assert np.isnan(R.adx(up, up, up)[2][:27]).all() and np.isfinite(R.adx(up * 1.01, up, up)[2][27:]).all()
    assert np.isnan(R.adx(up[:28], up[:28], up[:28])[2]).all()


def test_wilder_rsi_against_loop():
    c, n = walk(90)["close"], 6
    move = np.diff(c)
    g, l = np.maximum(move, 0), np.maximum(-move, 0)
    a, b = g[:n].mean(), l[:n].mean()
    want = [100 - 100 / (1 + a / b)]
    for x, y in zip(g[n:], l[n:]):
        a, b = (a * (n - 1) + x) / n, (b * (n - 1) + y) / n
        want.append(100 - 100 / (1 + a / b))
    assert np.allclose(R.rsi(c, n)[n:], want)


def test_ema_reset():
    x = np.array([np.nan, 1.0, 2.0, np.nan, 5.0, 7.0])
    assert np.allclose(R.ema_reset(x, 3), [np.nan, 1, 1.5, np.nan, 5, 6], equal_nan=True)


def test_nothing_later_changes_the_past():
    w = walk(200)
    f = pd.DataFrame({**w, "date": range(200)})
    a, b = R.compute(f), R.compute(f.iloc[:150].copy())
    for col in R.COLUMNS:
        assert np.allclose(a[col][:150], b[col], equal_nan=True), col


def test_scale_changes_no_oscillator():
    f = pd.DataFrame({**walk(120), "date": range(120)})
    g = f.copy()
    g[["open", "high", "low", "close"]] *= 7
    a, b = R.compute(f), R.compute(g)
    for col in ("k", "d", "rsi6", "rsi14", "pdi", "adx"):
        assert np.allclose(a[col], b[col], equal_nan=True), col


def test_chips_of_two_zones():
    lo, hi = np.full(30, 10.0), np.full(30, 12.0)
    f = pd.DataFrame({"date": range(61), "low": [*lo, *hi, 10.9], "high": [*(lo + 0.2), *(hi + 0.2), 11.1], "close": [*lo, *hi, 11.0], "vol": 100.0})
    c = R.chips(f)
    assert c["sup"] < 11 < c["res"] and 0 < c["profit"] < 1
    assert R.chips(f.iloc[:20]) is None and R.chips(f.assign(low=5.0, high=5.0)) is None


def naive(b, side, risk, i0, i1, again):
    o, h, l, c, atr = (b[k] for k in ("open", "high", "low", "close", "atr"))
    due, eq, entry, top, trades, curve = np.append(0, side[:-1]), 1.0, None, None, [], []
    for i in range(i0, i1):
        stopped = False
        if entry is not None:
            before, top = top, max(top, h[i])
            stop = entry - risk.atr_mult * atr[i - 1] if atr[i - 1] > 0 else entry * 0.95
            stop = before * risk.trail_ratio if before > entry * risk.trail_trigger else stop
            if l[i] <= stop:
                px = o[i] if o[i] <= stop else stop
                trades.append(px / entry - 1)
                eq, entry, stopped = eq * px / entry, None, True
        if again or not stopped:
            if due[i] == 1 and entry is None:
                entry = top = c[i]
            elif due[i] == -1 and entry:
                trades.append(c[i] / entry - 1)
                eq, entry = eq * c[i] / entry, None
        curve.append(eq * c[i] / entry if entry else eq)
    return trades, curve


@pytest.mark.parametrize("again", [True, False])
@pytest.mark.parametrize("preset", PRESETS)
def test_event_engine_against_loop(again, preset):
    g = np.random.default_rng(1)
    for t in range(40):
        n = int(g.integers(40, 160))
        b = walk(n, t)
        b["atr"] = B.atr14(b["high"], b["low"], b["close"])
        side, i0 = g.choice([0, 0, 0, 1, -1], n), int(g.integers(0, 10))
        out = B.run_events(b, side, PRESETS[preset], i0, n, again)
        trades, curve = naive(b, side, PRESETS[preset], i0, n, again)
        assert np.allclose(out.trades, trades) and np.allclose(out.curve, curve)


def test_gap_through_the_stop_fills_at_the_open():
    b = {"open": [10, 10, 8, 9], "high": [10, 10, 8.5, 9], "low": [10, 10, 7.5, 9], "close": [10, 10, 8.2, 9]}
    b = {k: np.array(v, float) for k, v in b.items()} | {"atr": np.zeros(4)}
    out = B.run_events(b, np.array([1, 0, 0, 0]), PRESETS["balanced"])
    assert np.allclose(out.trades, [8 / 10 - 1])


def test_sides_alternate_and_pause():
    g = np.random.default_rng(3)
    s = alternate(g.integers(-4, 5, 400).astype(float), np.full(400, 2), -2, 5)
    at = np.flatnonzero(s)
    assert (s[at][1:] == -s[at][:-1]).all() and (np.diff(at) >= 6).all()
    assert not alternate(np.full(9, np.nan), np.full(9, 1), -2, 0).any()


def test_greedy_keeps_apart():
    at = np.arange(100)
    took = greedy_apart(np.random.default_rng(0).random(100), at, 10, 7)
    assert len(took) == 10 and min(np.diff(sorted(took))) >= 7
    assert len(greedy_apart(np.zeros(8), np.arange(8), 10, 9)) == 8  # relaxed


def test_portfolio_keeps_its_books(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        for c in range(12):
            if rng.random() < 0.93:
                rows.append(("t", dt.date(2024, 1, 1) + dt.timedelta(days=i), c, 10 + c + rng.random(), rng.randrange(1, 13), rng.random() < 0.05, rng.random() < 0.05, rng.random() < 0.9))
    df = spark.createDataFrame(rows, "tier string, date date, code long, close double, rank int, lim_up boolean, lim_dn boolean, on boolean")
    tiers = [B.Tier("t", 0.5, 3, 5, True)]
    e = B.fold(df, tiers).toPandas()
    assert set(e["phase"]) == set(range(5)) and (e["equity"] > 0).all()
    assert e.groupby("phase")["date"].min().tolist() == sorted(e["date"].unique())[:5]
    assert e["trades"].sum() > 10
    part = B.fold(df.where("date < date'2024-02-01'"), tiers).toPandas()
    both = e.merge(part, on=["tier", "phase", "date"])
    assert len(both) == len(part) and np.allclose(both["equity_x"], both["equity_y"])
    assert B.fold(df.limit(0), tiers).count() == 0


def test_phase_skips_what_it_cannot_pay():
    p = B.Phase(B.Tier("t", 1.0, 2, 1, False), 0, 1500.0, B.Costs())
    p.day(0, {1: 10.0}, set(), set(), [], True)
    assert p.day(1, {1: 10.0, 2: 500.0}, set(), set(), [2, 1], True) <= 1500 and set(p.held) <= {1} and p.cash >= 0


def test_bh(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    got = bh_fdr(spark.createDataFrame([(x,) for x in p], "p double"), "p", 0.05).where("passed").count()
    assert got == 2


def test_plugins_are_told_in_order_and_apart():
    told = []

    class Good(Plugin):
        name, order = "good", 2

        def on_close(self):
            told.append(self.name)

    class Bad(Plugin):
        name, order = "bad", 1

        def on_close(self):
            raise RuntimeError("x")

    r = Registry()
    r.add(Good())
    r.add(Bad())
    assert list(r.tell("on_close")) == ["bad"] and told == ["good"]


def test_settings_clamp(tmp_path):
    f = tmp_path / "a.ini"
    f.write_text("[predict]\nwindow = 99\ntopk = x\n", encoding="utf-8")
    s = P.load_settings(str(f))
    assert s.window == 30 and s.topk == 10
    P.save_settings(str(f), s)
    assert P.load_settings(str(f)) == s and P.load_settings(None) == P.Settings()


def test_markdown_refuses_to_drop_rows(spark):
    assert P.to_markdown(spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double")).endswith("| 1 |  | 0.5000 |")
    with pytest.raises(ValueError):
        P.to_markdown(spark.range(20), 10)
