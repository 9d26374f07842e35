"""Implausible spikes, stuck values and impossible readings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.units import day_levels, expected_bars, fine, in_blocks, in_series, numbered
from tidemark.sources.tables import cut

PRICES = ("open", "high", "low", "close")
TIMES = 12.0
LONGEST_RUN = 3
STUCK = 10
#: A day is looked at closely if its sparse part, or its share in the low-rank part, exceeds this many usual moves.
SUSPECT = 3.0
REACH = 3
SAME = 1e-9


def impossible(open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> Column:
    """A non-null price that is NaN, infinite, zero or negative; a high below or a low above another price."""
    cols = [F.col(c) for c in (open_, high, low, close)]
    bad = [F.isnan(c) | (F.abs(c) == float("inf")) | (c <= 0) for c in cols]
    order = [F.col(high) < c for c in cols] + [F.col(low) > c for c in cols]
    out = F.lit(False)
    for x in bad + order:
        out = out | F.coalesce(x, F.lit(False))
    return out


def robust_pca(m: np.ndarray, rounds: int = 25, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """m as low-rank plus sparse (principal component pursuit by augmented Lagrangian), m with few columns.

    which: the number of the matrix each row belongs to, ascending from 0; every matrix is split on its own, all of them
    side by side. The singular values come from the small Gram matrices, so a round is linear in the rows.
    """
    n, k = m.shape
    if not n:
        return m, m
    which = np.zeros(n, int) if which is None else which
    size = np.bincount(which)
    at = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    a = np.zeros((len(size), size.max(), k))
    a[which, at] = m
    one = lambda x: x[:, None, None]
    lam = 1 / np.sqrt(np.maximum(size, k))
    norm = np.sqrt(np.maximum(np.linalg.eigvalsh(a.transpose(0, 2, 1) @ a)[:, -1], 1e-30))
    y = a / one(np.maximum(np.maximum(norm, np.abs(a).max(axis=(1, 2)) / lam), 1e-30))
    mu, s = 1.25 / norm, np.zeros_like(a)
    low = s
    for _ in range(rounds):
        x = a - s + y / one(mu)
        val, vec = np.linalg.eigh(x.transpose(0, 2, 1) @ x)
        keep = np.maximum(1 - 1 / (mu[:, None] * np.sqrt(np.maximum(val, 1e-30))), 0)
        low = x @ ((vec * keep[:, None, :]) @ vec.transpose(0, 2, 1))
        r = a - low + y / one(mu)
        s = np.sign(r) * np.maximum(np.abs(r) - one(lam / mu), 0)
        left = a - low - s
        y = y + one(mu) * left
        mu = mu * 1.5
        if np.abs(left).max() < 1e-3:
            break
    return low[which, at], s[which, at]


def _near(ref: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest day with a reference before and after each day of its series, -1 if none."""
    n = len(ref)
    i = np.arange(n)
    has = np.isfinite(ref)
    before = np.maximum.accumulate(np.where(has, i, -1))
    before = np.append(-1, before[:-1]) if n else before
    after = np.minimum.accumulate(np.where(has, i, n)[::-1])[::-1]
    after = np.append(after[1:], n) if n else after
    before = np.where((before >= 0) & (series[np.maximum(before, 0)] == series), before, -1)
    after = np.where((after < n) & (series[np.minimum(after, n - 1)] == series), after, -1)
    return before, after


def judge_days(series: np.ndarray, ref: np.ndarray, hi: np.ndarray, lo: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each recorded day (series laid end to end, days in order): up, dn, stuck.

    A price above up or below dn is off by more than TIMES the median move of the series against the days around it,
    or around the run of at most LONGEST_RUN days that lie off with it; inf and -inf where nothing is. ref: the
    day's close or NaN; hi, lo: extremes of its prices or NaN; active: volume above zero. stuck: the day is one of
    at least STUCK with the same close and volume above zero. Series that are unchanged on most days give nothing.
    """
    n = len(series)
    up, dn, stuck = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, bool)
    if not n:
        return up, dn, stuck
    before, after = _near(ref, series)
    has = np.isfinite(ref)
    first = np.flatnonzero(np.diff(series, prepend=series[0] - 1))
    size = np.diff(np.append(first, n))
    num = np.repeat(np.arange(len(first)), size)
    move = np.where(has & (before >= 0), np.abs(ref / ref[np.maximum(before, 0)] - 1), np.nan)
    move = np.where(move < SAME, 0, move)
    got = np.isfinite(move)
    count = np.bincount(num, got, len(first))
    order = np.lexsort((np.where(got, move, np.inf), num))
    sorted_ = np.where(got, move, np.inf)[order]
    c = count.astype(int)
    a, b = first + np.maximum((c - 1) // 2, 0), first + np.minimum(c // 2, size - 1)
    mid = np.where(c > 0, (sorted_[a] + sorted_[b]) / 2, np.nan)
    still = np.bincount(num, got & (move == 0), len(first))
    lively = (c > 0) & (still * 2 <= c) & (mid > 0)
    med, ok = np.where(lively, mid, np.nan)[num], lively[num]

    # Profiles: the closes around a day and its own extremes, as logs over the local median, in usual moves.
    where = np.flatnonzero(has)
    place = np.searchsorted(where, np.arange(n))  # of the first reference at or after the day
    cols = []
    for k in range(1, REACH + 1):
        for at in (place - k, place + k - np.where(has, 0, 1)):
            j = where[np.clip(at, 0, max(len(where) - 1, 0))] if len(where) else np.zeros(n, int)
            good = (at >= 0) & (at < len(where)) & (series[j] == series)
            cols.append(np.where(good, ref[j], np.nan))
    around = np.log(np.column_stack(cols))
    own = np.log(np.column_stack([np.where(has, ref, np.nan), hi, lo]))
    see = np.flatnonzero(ok & np.isfinite(own[:, 1]) & np.isfinite(around).any(axis=1))
    if not len(see):
        return up, dn, _stuck(series, ref, active, ok, stuck)
    pool = np.column_stack([around[see], own[see, 0]])
    base = np.nanmedian(pool, axis=1, keepdims=True)
    m = np.nan_to_num((np.column_stack([around[see], own[see]]) - base) / med[see, None])
    low, sparse = robust_pca(m, which=np.unique(series[see], return_inverse=True)[1])  # a matrix for each series
    mine = slice(2 * REACH, None)
    odd = see[(np.abs(sparse[:, mine]).max(axis=1) > SUSPECT) | (np.abs(low[:, mine]).max(axis=1) > SUSPECT)]
    # A usual day between odd ones lies off from both: so days near an odd one are tested as well.
    near = np.zeros(n, bool)
    for k in range(-LONGEST_RUN - 1, LONGEST_RUN + 2):
        near[np.clip(odd + k, 0, n - 1)] = True

    # The exact test, on the suspects only.
    j = np.flatnonzero(near & ok)
    for length in range(1, LONGEST_RUN + 1):
        for back in range(length):
            s, e = j - back, j - back + length - 1
            fit = (s >= 0) & (e < n)
            s2, e2 = np.clip(s, 0, n - 1), np.clip(e, 0, n - 1)
            fit &= (series[s2] == series[j]) & (series[e2] == series[j]) & (before[s2] >= 0) & (after[e2] >= 0)
            x, z = ref[np.maximum(before[s2], 0)], ref[np.maximum(after[e2], 0)]
            over, under = np.maximum(x, z) * (1 + TIMES * med[j]), np.minimum(x, z) * (1 - TIMES * med[j])
            all_up, all_dn = fit.copy(), fit.copy()
            for k in range(length):
                p = np.clip(s2 + k, 0, n - 1)
                all_up &= hi[p] > over
                all_dn &= lo[p] < under
            up[j] = np.where(all_up, np.minimum(up[j], over), up[j])
            dn[j] = np.where(all_dn, np.maximum(dn[j], under), dn[j])
    return up, dn, _stuck(series, ref, active, ok, stuck)


def _stuck(series: np.ndarray, ref: np.ndarray, active: np.ndarray, ok: np.ndarray, out: np.ndarray) -> np.ndarray:
    use = np.isfinite(ref) & active & ok
    same = np.zeros(len(ref), bool)
    same[1:] = use[1:] & use[:-1] & (series[1:] == series[:-1]) & (np.abs(ref[1:] / ref[:-1] - 1) < SAME)
    run = np.cumsum(~same)
    length = np.bincount(run)[run]
    return out | (use & (length >= STUCK))


FOUND = "src string, code string, day_no int, own_p int, n long, bar_id long, up double, dn double, stuck boolean"


def _spikes(pdf: pd.DataFrame) -> pd.DataFrame:
    """pdf: a block of whole series, a row for each day and own unit note."""
    pdf = numbered(pdf)
    noted = pdf["own_p"].to_numpy(float)
    bare = np.isnan(noted)
    key = pdf.groupby(["series", "day_no"], sort=False).ngroup().to_numpy()
    head = np.flatnonzero(np.diff(key, prepend=-1))
    days = pd.DataFrame({"series": pdf["series"].to_numpy()[head], "exp_p": pdf["exp_p"].to_numpy()[head], "exp_v": 0, "lv": np.nan, "lvn": np.nan})
    lp = pdf["lp"].to_numpy(float)
    top = lambda x: np.maximum.reduceat(np.where(np.isfinite(x), x, -np.inf), head)
    for c, x in (("lp", np.where(bare, lp, np.nan)), ("lpn", np.where(bare, np.nan, lp - noted))):
        v = top(x)
        days[c] = np.where(np.isfinite(v), v, np.nan)
    level = np.where(bare, day_levels(days)["lev_p"].to_numpy()[key], noted)
    scale = 10.0**-level
    hi, lo, ref = (pdf[c].to_numpy(float) * scale for c in ("hi", "lo", "ref"))
    fhi, flo = np.maximum.reduceat(np.where(np.isfinite(hi), hi, -np.inf), head), np.minimum.reduceat(np.where(np.isfinite(lo), lo, np.inf), head)
    # The last delivery with a usable close is the day's reference; the last of all tells whether it was traded.
    rank = pdf["ref_at"].to_numpy("datetime64[us]").astype("int64")
    rank = np.where(np.isfinite(ref), rank, np.iinfo("int64").min)
    best = np.lexsort((pdf["ref_bar"].to_numpy(float), rank, key))
    last = best[np.append(np.flatnonzero(np.diff(key[best])), len(best) - 1)]
    latest = np.lexsort((pdf["last_at"].to_numpy("datetime64[us]").astype("int64"), key))
    traded = pdf["traded"].to_numpy(bool)[latest[np.append(np.flatnonzero(np.diff(key[latest])), len(latest) - 1)]]
    up, dn, stuck = judge_days(days["series"].to_numpy(), ref[last], np.where(np.isfinite(fhi), fhi, np.nan), np.where(np.isfinite(flo), flo, np.nan), traded)
    up, dn, stuck = up[key], dn[key], stuck[key]
    hit = (hi > up) | (lo < dn) | stuck
    out = pdf.loc[hit, ["src", "code", "day_no", "own_p", "n", "bar_id"]]
    return out.assign(own_p=out["own_p"].astype("Int32"), up=(up / scale)[hit], dn=(dn / scale)[hit], stuck=stuck[hit])


def _extremes(df: DataFrame) -> DataFrame:
    """hi and lo of the prices that are finite and above zero."""
    good = [F.when(fine(c) & (F.col(c) > 0), F.col(c)) for c in PRICES]
    return df.withColumns({"hi": F.greatest(*good), "lo": F.least(*good)})


def spike_rows(spark: SparkSession, d: str) -> DataFrame:
    """bar_id and why of every stored row that is impossible, stuck or off the usual behaviour of its series.

    Per series, profiles of days are split by robust principal components into usual behaviour and sparse spikes; the
    days that stand out are then tested exactly. Sources are handled in blocks of whole series, so no source is too
    large, and which series share a block plays no part. Rows of the same day and unit are summed up before; only where such a group has several rows are they
    looked up again. Rows outside of series are only tested for impossible prices.
    """
    noted = expected_bars(spark, d, "bar_id", *PRICES, "fetched_at", bad=impossible())
    rows = _extremes(noted).where(in_series())
    sound = fine("close") & (F.col("close") > 0) & ~F.coalesce((F.col("high") < F.col("close")) | (F.col("low") > F.col("close")), F.lit(False))
    variants = rows.groupBy("src", "code", "day_no", "own_p").agg(
        F.max("exp_p").alias("exp_p"),
        F.max(F.when(fine("close"), F.log10(F.abs("close")))).cast("float").alias("lp"),
        F.max("hi").alias("hi"),
        F.min("lo").alias("lo"),
        F.max(F.when(sound, F.struct("fetched_at", "bar_id", "close"))).alias("r"),
        F.max(F.struct("fetched_at", "bar_id", F.coalesce(F.col("vol") > 0, F.lit(False)).alias("t"))).alias("l"),
        F.count("*").alias("n"),
    )
    flat = variants.select("src", "code", "day_no", "own_p", "exp_p", "lp", "hi", "lo", F.col("r.close").alias("ref"), F.coalesce("r.fetched_at", F.lit(0).cast("timestamp")).alias("ref_at"), F.coalesce("r.bar_id", F.lit(0)).alias("ref_bar"), F.coalesce("l.fetched_at", F.lit(0).cast("timestamp")).alias("last_at"), F.col("l.t").alias("traded"), "n", F.col("l.bar_id").alias("bar_id"))
    found = cut(in_blocks(flat, rows).groupBy("src", "block").applyInPandas(_spikes, FOUND), "spikes")
    single = found.where("n = 1").select("bar_id", F.when(F.col("stuck"), "stuck").otherwise("spike").alias("why"))
    f = found.where("n > 1").select(F.col("src").alias("f_src"), F.col("code").alias("f_code"), F.col("day_no").alias("f_day"), F.col("own_p").alias("f_own"), "up", "dn", "stuck")
    on = (F.col("src") == F.col("f_src")) & (F.col("code") == F.col("f_code")) & (F.col("day_no") == F.col("f_day")) & F.col("own_p").eqNullSafe(F.col("f_own"))
    several = rows.join(f, on).where("stuck or hi > up * (1 + 1e-12) or lo < dn * (1 - 1e-12)").select("bar_id", F.when(F.col("stuck"), "stuck").otherwise("spike").alias("why"))
    faulty = noted.where("bad").select("bar_id", F.lit("impossible").alias("why"))
    return faulty.union(single).union(several).groupBy("bar_id").agg(F.min("why").alias("why"))
