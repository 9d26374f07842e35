"""Indicators whose state carries from row to row: one grouped pass per instrument computes them all.

A group is one instrument's bars; a bar is unique by code and date, so a group is as long as the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = ("ema12", "ema26", "dif", "dea", "hist", "k", "d", "j", "rsi6", "rsi14", "pdi", "mdi", "adx")


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Seeded with the first value; weight 2 / (n + 1)."""
    return pd.Series(x).ewm(span=n, adjust=False).mean().to_numpy()


def ema_reset(x: np.ndarray, n: int) -> np.ndarray:
    """As ema, but a missing value gives a missing result, and the next known value seeds anew."""
    s = pd.Series(x)
    run = s.isna().cumsum()
    return s.groupby(run).transform(lambda g: g.dropna().ewm(span=n, adjust=False).mean().reindex(g.index)).to_numpy()


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first n values, then (previous * (n - 1) + x) / n; missing before the n-th."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        seeded = np.concatenate([[x[:n].mean()], x[n:]])
        out[n - 1 :] = pd.Series(seeded).ewm(alpha=1 / n, adjust=False).mean()
    return out


def macd(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dif = ema(c, 12) - ema(c, 26)
    dea = ema(dif, 9)
    dea[:8] = np.nan
    return dif, dea, 2 * (dif - dea)


def kdj(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo, hi = pd.Series(low).rolling(n, min_periods=1).min().to_numpy(), pd.Series(h).rolling(n, min_periods=1).max().to_numpy()
    span = hi - lo
    rsv = np.where(span > 0, (c - lo) / np.where(span > 0, span, 1) * 100, 50.0)
    smooth = lambda x: pd.Series(np.append(50.0, x)).ewm(alpha=1 / 3, adjust=False).mean().to_numpy()[1:]
    k = smooth(rsv)
    d = smooth(k)
    return k, d, 3 * k - 2 * d


def rsi(c: np.ndarray, n: int) -> np.ndarray:
    """100 where the average loss is zero; missing for the first n rows."""
    out = np.full(len(c), np.nan)
    if len(c) > n:
        move = np.diff(c)
        up, down = wilder(np.maximum(move, 0), n), wilder(np.maximum(-move, 0), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[1:] = np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))
    return out


def adx(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI and ADX; all missing under 2n + 1 rows."""
    m = len(c)
    pdi, mdi, out = (np.full(m, np.nan) for _ in range(3))
    if m < 2 * n + 1:
        return pdi, mdi, out
    up, dn = np.diff(h), -np.diff(low)
    plus, minus = np.where((up > dn) & (up > 0), up, 0.0), np.where((dn > up) & (dn > 0), dn, 0.0)
    tr = np.maximum.reduce([h[1:] - low[1:], np.abs(h[1:] - c[:-1]), np.abs(low[1:] - c[:-1])])
    a, p, q = wilder(tr, n), wilder(plus, n), wilder(minus, n)
    ok = a > 0
    pdi[1:][ok], mdi[1:][ok] = 100 * p[ok] / a[ok], 100 * q[ok] / a[ok]
    s = pdi + mdi
    known = np.flatnonzero(np.isfinite(s))
    dx = np.where(s[known] > 0, 100 * np.abs(pdi[known] - mdi[known]) / np.where(s[known] > 0, s[known], 1), 0.0)
    out[known] = wilder(dx, n)
    return pdi, mdi, out


def states(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """COLUMNS of one instrument's prices, in order of date."""
    cols = {"ema12": ema(c, 12), "ema26": ema(c, 26)}
    cols["dif"], cols["dea"], cols["hist"] = macd(c)
    cols["k"], cols["d"], cols["j"] = kdj(h, low, c)
    cols["rsi6"], cols["rsi14"] = rsi(c, 6), rsi(c, 14)
    cols["pdi"], cols["mdi"], cols["adx"] = adx(h, low, c)
    return cols


def compute(pdf: pd.DataFrame) -> pd.DataFrame:
    """The bars of one instrument, in order of date, with COLUMNS. Bars with a null price are left out before."""
    return pdf.assign(**states(*[pdf[x].to_numpy(float) for x in ("high", "low", "close")]))


def with_recursive(bars: DataFrame) -> DataFrame:
    """bars (code, date, open, high, low, close, vol) with COLUMNS; NaN becomes null."""
    from pyspark.sql import functions as F

    kind = dict(bars.dtypes)["code"]
    base = ("open", "high", "low", "close", "vol")
    schema = f"code {kind}, date date, " + ", ".join(f"{x} double" for x in (*base, *COLUMNS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return compute(pdf.sort_values("date", ignore_index=True))

    ok = bars.where("close is not null and high is not null and low is not null").select("code", "date", *[F.col(x).cast("double").alias(x) for x in base])
    out = ok.groupBy("code").applyInPandas(run, schema)
    return out.withColumns({x: F.nanvl(x, F.lit(None).cast("double")) for x in COLUMNS})


def chips(pdf: pd.DataFrame, bins: int = 120, decay: float = 0.02, floor: float = 0.002, cap: float = 0.2) -> dict | None:
    """Cost distribution at the last bar: older volume fades by a turnover proxy, a bar's volume is spread over its range.

    None under 30 valid bars or without a price range. sup and res: the densest local peak below and above the last
    close, else the densest bin there.
    """
    b = pdf[(pdf["vol"] > 0) & (pdf["low"] > 0) & (pdf["high"] >= pdf["low"])].sort_values("date")
    if len(b) < 30:
        return None
    low, high, vol = (b[x].to_numpy(float) for x in ("low", "high", "vol"))
    base, top = low.min(), high.max()
    if top <= base:
        return None
    step = (top - base) / bins
    usual = np.sort(vol)[len(vol) // 2]
    fade = np.clip(decay * vol / usual, floor, cap)
    # What is left of a bar's volume at the end is the product of all later fades: no need to carry the histogram.
    keep = np.append(np.cumprod((1 - fade)[::-1])[::-1][1:], 1.0)
    first = np.clip(((low - base) / step).astype(int), 0, bins)
    last = np.maximum(np.clip(((high - base) / step).astype(int), 0, bins), first)
    share = vol * keep / (last - first + 1)
    edge = np.zeros(bins + 2)
    np.add.at(edge, first, share)
    np.add.at(edge, last + 1, -share)
    mass = np.maximum(np.cumsum(edge)[: bins + 1], 0)
    mid, total, cur = base + step * (np.arange(bins + 1) + 0.5), mass.sum(), b["close"].iloc[-1]
    run = np.cumsum(mass)
    inner = np.arange(1, bins)
    peak = inner[(mass[inner] > mass[inner - 1]) & (mass[inner] >= mass[inner + 1])]

    def densest(below: bool) -> float:
        side = mid < cur if below else mid > cur
        at = peak[side[peak]] if side[peak].any() else np.flatnonzero(side)
        return float(mid[at[np.argmax(mass[at])]]) if len(at) else np.nan

    return {"avg_cost": float((mid * mass).sum() / total), "profit": float(mass[mid <= cur].sum() / total), "p5": float(mid[np.searchsorted(run, 0.05 * total)]), "p95": float(mid[min(bins, np.searchsorted(run, 0.95 * total))]), "sup": densest(True), "res": densest(False), "cur": float(cur)}


CHIP_SCHEMA = "avg_cost double, profit double, p5 double, p95 double, sup double, res double, cur double"


def chip_summary(bars: DataFrame, **settings: float) -> DataFrame:
    """One row per code with a distribution."""
    kind = dict(bars.dtypes)["code"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = chips(pdf, **settings)
        return pd.DataFrame([] if c is None else [{"code": pdf["code"].iloc[0], **c}], columns=["code", "avg_cost", "profit", "p5", "p95", "sup", "res", "cur"])

    return bars.groupBy("code").applyInPandas(run, f"code {kind}, {CHIP_SCHEMA}")


def chip_snapshots(bars: DataFrame, tail: int = 20) -> DataFrame:
    """code, date, sup, res, profit for each of a code's last `tail` days, each from the bars up to that day only."""
    kind = dict(bars.dtypes)["code"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        out = []
        for i in range(max(30, len(pdf) - tail), len(pdf)):
            c = chips(pdf.iloc[: i + 1])
            if c:
                out.append((pdf["code"].iloc[0], pdf["date"].iloc[i], c["sup"], c["res"], c["profit"]))
        return pd.DataFrame(out, columns=["code", "date", "sup", "res", "profit"])

    return bars.groupBy("code").applyInPandas(run, f"code {kind}, date date, sup double, res double, profit double")


def chip_mass(low: np.ndarray, high: np.ndarray, vol: np.ndarray, start: int, bins: int = 200, decay: float = 0.02, floor: float = 0.002, cap: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(rows, mids, mass): the cost distribution after each valid bar from `start` on, a row of `mass` for each.

    Bin bounds and the usual volume come from the valid bars before `start`, which must be 30 or more, as must be
    all; prices beyond the bounds count in the outer bins. None if there is no distribution.
    """
    ok = np.flatnonzero((vol > 0) & (low > 0) & (high >= low))
    base = ok[ok < start]
    if len(ok) < 30 or start < 30 or not len(base):
        return None
    lo, hi = low[base].min(), high[base].max()
    if hi <= lo:
        return None
    step = (hi - lo) / bins
    usual = np.sort(vol[base])[len(base) // 2]
    keep = 1 - np.clip(decay * vol[ok] / usual, floor, cap)
    at = lambda x: np.clip(((x[ok] - lo) / step).astype(int), 0, bins)
    first, last = at(low), at(high)
    share = vol[ok] / (last - first + 1)
    mass, now, n = np.empty((len(ok) - len(base), bins + 1)), np.zeros(bins + 1), 0
    for i, (kept, a, z, x) in enumerate(zip(keep.tolist(), first.tolist(), (last + 1).tolist(), share.tolist())):  # plain numbers are read faster
        if i >= len(base):
            now, n = np.multiply(now, kept, out=mass[n]), n + 1
        else:
            now *= kept
        now[a:z] += x
    return ok[len(base) :], lo + step * (np.arange(bins + 1) + 0.5), mass


def chip_peaks(close: np.ndarray, mids: np.ndarray, mass: np.ndarray, prom: float = 0.0) -> np.ndarray:
    """Support, resistance and profit (columns) of each close under its row of `mass`.

    Support is -(close - peak) / close of the strongest local peak below, resistance the same above; a side without
    a peak higher than `prom` of the highest bin takes its densest bin. Profit is the share of mass at or below the close.
    """
    peak = np.zeros(mass.shape, bool)
    inner = mass[:, 1:-1]
    peak[:, 1:-1] = (inner > mass[:, :-2]) & (inner >= mass[:, 2:]) & (inner > prom * mass.max(axis=1, keepdims=True))
    below = mids[None, :] < close[:, None]
    out = np.full((len(close), 3), np.nan)
    for j, side in enumerate((below, ~below)):
        tops = peak & side
        use = np.where(tops.any(axis=1, keepdims=True), tops, side)
        m = mids[np.argmax(np.where(use, mass, -1.0), axis=1)]
        out[:, j] = np.where(use.any(axis=1), (m - close if j == 0 else close - m) / close, np.nan)
    out[:, 2] = np.where(mids[None, :] <= close[:, None], mass, 0.0).sum(axis=1) / mass.sum(axis=1)
    return out


def chip_factors(low: np.ndarray, high: np.ndarray, close: np.ndarray, vol: np.ndarray, start: int, prom: float = 0.0, **settings: float) -> np.ndarray:
    """chip_peaks for each bar of one code; NaN before `start` and where there is none."""
    out = np.full((len(close), 3), np.nan)
    m = chip_mass(low, high, vol, start, **settings)
    if m is not None:
        out[m[0]] = chip_peaks(close[m[0]], m[1], m[2], prom)
    return out
