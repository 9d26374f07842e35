"""Similar stretches of history: distances of normalised windows, best matches, and quantiles of what followed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import let


def znorm(v: Column) -> Column:
    """(x - mean) / population deviation of an array; a deviation of zero counts as 1e-12."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    spread = lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v))
    # Mean and deviation are bound once per row; written inside the lambda they would be made again for each element.
    return let(total(v) / F.size(v), lambda m: let(F.greatest(spread(m), F.lit(1e-12)), lambda s: F.transform(v, lambda x: (x - m) / s)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of the same size."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, points: dict[str, float]) -> DataFrame:
    """The first value, in order, at which the cumulative weight reaches p of the total. Equal values are summed first."""
    one = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    run = F.sum("_w").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    c = one.withColumn("_run", run).withColumn("_all", F.sum("_w").over(W.partitionBy(*by)))
    return c.groupBy(*by).agg(*[F.min(F.when(F.col("_run") >= p * F.col("_all") - 1e-12, F.col(value))).alias(n) for n, p in points.items()])


def confidence(samples: DataFrame, by: list[str], score: str, weight: str, level: str, least: int = 3) -> DataFrame:
    """by, n, levels, score, confidence of samples with a distance, a weight and a level (1 to 3): fewer than `least` or
    twice as many, scattered distances, few weights above 1 and levels without a sample each take something off 1."""
    g = samples.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop(score).alias("_sd"), F.avg((F.col(weight) > 1).cast("int")).alias("_good"), F.count_distinct(level).alias("levels"))
    many = F.when(F.col("n") < least, 0.5).when(F.col("n") < 2 * least, 0.8).otherwise(1.0)
    alike = F.when(F.col("n") > 1, F.greatest(F.lit(0.6), 1 - F.least(F.col("_sd") / 2, F.lit(0.4)))).otherwise(1.0)
    whole = F.when(F.col("levels") == 3, 1.0).when(F.col("levels") == 2, 0.9).otherwise(0.7)
    c = many * alike * (0.7 + 0.3 * F.col("_good")) * whole
    return g.withColumn("_c", c).select(*by, "n", "levels", F.round(F.col("_c") + 1e-9, 6).alias("score"), F.when(F.col("_c") >= 0.6, "high").when(F.col("_c") >= 0.3, "mid").otherwise("low").alias("confidence"))


def stratified(samples: DataFrame, by: list[str], tests: dict[str, str], least: int) -> DataFrame:
    """The samples that pass the first test (name -> boolean column) that at least `least` of a group pass, with the name
    as `used`; all of a group, as 'all', where no test has so many."""
    n = samples.groupBy(*by).agg(*[F.count_if(c).alias(f"_n{i}") for i, c in enumerate(tests.values())])
    used = F.lit("all")
    for i, name in reversed(list(enumerate(tests))):
        used = F.when(F.col(f"_n{i}") >= least, name).otherwise(used)
    passes = F.col("used") == "all"
    for name, c in tests.items():
        passes = passes | ((F.col("used") == name) & F.col(c))
    return samples.join(n.select(*by, used.alias("used")), by).where(passes)


def _windows(r: np.ndarray, w: int) -> np.ndarray:
    v = np.lib.stride_tricks.sliding_window_view(r, w)
    sd = v.std(axis=1, keepdims=True)
    return (v - v.mean(axis=1, keepdims=True)) / np.maximum(sd, 1e-12)


def greedy_apart(score: np.ndarray, at: np.ndarray, k: int, gap: int) -> list[int]:
    """Indices in ascending score, at most k, each at least `gap` from those taken; the gap is relaxed to 3 and 1
    until min(k, 6) are found. Ties go by position."""
    order = np.lexsort((at, score))
    for g in dict.fromkeys((gap, 3, 1)):
        taken: list[int] = []
        for i in order:
            if all(abs(at[i] - at[j]) >= g for j in taken):
                taken.append(int(i))
                if len(taken) == k:
                    break
        if len(taken) >= min(k, 6):
            return taken
    return taken


def greedy_rows(score: np.ndarray, k: int, gap: int) -> np.ndarray:
    """Of each row what greedy_apart takes where the position is the column: k columns in the order taken, -1 after the
    last. Columns of inf are not there."""
    out = np.full((len(score), k), -1)
    left = np.arange(len(score))
    for g in dict.fromkeys((gap, 3, 1)):
        wide = score.shape[1] + 2 * g - 2
        d = np.full((len(left), wide), np.inf)  # room for what lies beyond the ends
        inner = d[:, g - 1 : wide - g + 1]
        inner[:] = score if len(left) == len(score) else score[left]
        taken, start, flat = np.full((len(left), k), -1), np.arange(len(left)) * wide, d.reshape(-1)
        near = np.arange(2 * g - 1)
        for n in range(k):
            at = d.argmin(axis=1)  # of whole rows: a view would be copied first
            some = np.isfinite(flat[start + at])
            if not some.any():
                break
            at = np.maximum(at - g + 1, 0)
            taken[:, n] = np.where(some, at, -1)
            flat[(start + at)[:, None] + near] = np.inf
        out[left] = taken
        left = left[(taken >= 0).sum(axis=1) < min(k, 6)]
        if not len(left):
            break
    return out


def own_arrays(c: np.ndarray, width: int = 10, k: int = 10, every: int = 5, horizon: int = 1, cells: int = 60_000) -> tuple[np.ndarray, ...]:
    """bar, known, p_up, mean_next, n, best of one code's closes, as own_matches tells; where known is false there is no
    p_up and mean_next. Blocks hold about `cells` cells."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.nan_to_num(np.diff(np.log(np.where(c > 0, c, np.nan))))
    z = _windows(r, width) if len(r) >= width else np.zeros((0, width))  # window j: returns j .. j+width-1, it ends at bar j+width
    nxt = np.full(len(c), np.nan)
    nxt[:-horizon] = c[horizon:] / np.where(c[:-horizon] > 0, c[:-horizon], np.nan) - 1
    q = np.arange(0, len(z), every)
    q, a = q[q - width - horizon >= 5], 0
    pick, best, zt = np.full((len(q), k), -1), np.empty(len(q)), np.ascontiguousarray(z.T)
    while a < len(q):
        b = min(len(q), a + max(8, cells // int(q[a] + 1)))
        last = q[a:b] - width - horizon
        d = z[q[a:b]] @ zt[:, : last[-1] + 1]
        d *= -2
        d += 2 * width
        np.maximum(d, 0, out=d)
        np.sqrt(d, out=d)
        d[:, last[0] :][np.arange(last[0], d.shape[1]) > last[:, None]] = np.inf
        best[a:b] = d.min(axis=1)
        pick[a:b] = greedy_rows(np.round(d, 9, out=d), k, max(3, width // 2))
        a = b
    y = np.where(pick >= 0, nxt[pick + width], np.nan) if len(q) else np.zeros((0, k))
    known = np.isfinite(y)
    n = known.sum(axis=1)
    ok = ((pick >= 0).sum(axis=1) >= 6) & (n >= 3)
    up, mean = ((y > 0) & known).sum(axis=1) / np.maximum(n, 1), np.where(known, y, 0.0).sum(axis=1) / np.maximum(n, 1)
    return q + width, ok, up, mean, n, best


def own_series(c: np.ndarray, width: int = 10, k: int = 10, every: int = 5, horizon: int = 1, cells: int = 60_000) -> list[tuple[int, float | None, float | None, int, float]]:
    """own_arrays as (bar, p_up, mean_next, n, best)."""
    rows = zip(*[x.tolist() for x in own_arrays(c, width, k, every, horizon, cells)])
    return [(i, u if ok else None, m if ok else None, n, e) for i, ok, u, m, n, e in rows]


def own_matches(bars: DataFrame, width: int = 10, k: int = 10, every: int = 5, horizon: int = 1) -> DataFrame:
    """code, date, p_up, mean_next, n, best: every `every` bars, what followed the k own windows most like the last.

    Only windows whose outcome lies before the current one begins are compared, so nothing later is used. At least
    six windows and three outcomes are needed, else p_up is null and n tells how many there were. Blocks of the
    distance matrix are made by the identity |a-b|^2 = 2w - 2ab of normalised windows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        out = [(pdf["code"].iloc[0], pdf["date"].iloc[i], *x) for i, *x in own_series(pdf["close"].to_numpy(float), width, k, every, horizon)]
        return pd.DataFrame(out, columns=["code", "date", "p_up", "mean_next", "n", "best"])

    kind = dict(bars.dtypes)["code"]
    return bars.select("code", "date", "close").groupBy("code").applyInPandas(run, f"code {kind}, date date, p_up double, mean_next double, n long, best double")
