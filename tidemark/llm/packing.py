"""Filling fixed-capacity containers with items of varying size.

Which sizes go together is planned on the histogram of sizes, which has at most as many rows as the capacity; the
plan, a table of rank ranges, is then joined with the items, each of which has a rank among those of its size.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A combination fills the capacity but for at most this share of it.
WINDOW = 0.01
DEPTH = 4
#: Second sizes that are tried beside each largest one in combinations of three and four.
TRIED = 6
ROUNDS = 400
#: Ranks within one size are made in this many parts, for one size may be that of a third of all items.
PARTS = 64


@dataclass
class Plan:
    """Containers first + i * step ... of a combination: `times` containers, each with `each` items of `size`."""

    size: list[int]
    rank: list[int]
    each: list[int]
    times: list[int]
    first: list[int]
    containers: int = 0

    def add(self, combo: dict[int, int], times: int, given: dict[int, int]) -> None:
        for s, k in combo.items():
            self.size.append(s)
            self.rank.append(given.get(s, 0))
            self.each.append(k)
            self.times.append(times)
            self.first.append(self.containers)
            given[s] = given.get(s, 0) + k * times
        self.containers += times


def combinations(sizes: np.ndarray, capacity: int, window: float = WINDOW, depth: int = DEPTH, tried: int = TRIED) -> list[tuple[int, ...]]:
    """Shallow combinations of the sizes (ascending, distinct) that fill the capacity but for the window.

    Every size appears as the largest of a combination of each depth, if one can be made: the others are `tried`
    sizes spread over the range, and the last is the largest that still fits.
    """
    room = max(1, int(capacity * window))
    out: set[tuple[int, ...]] = set()
    have = sizes.tolist()

    def fit(rest: int, most: int) -> int | None:
        i = bisect.bisect_right(have, min(rest, most)) - 1
        return have[i] if i >= 0 and rest - have[i] <= room else None

    spread = [have[i] for i in np.unique(np.linspace(0, len(have) - 1, tried).astype(int))]
    for a in have:
        if capacity - a <= room:
            out.add((a,))
        k = capacity // a
        if k > 1 and capacity - k * a <= room and k <= depth:
            out.add((a,) * k)
        if (b := fit(capacity - a, capacity)) is not None:
            out.add(tuple(sorted((a, b), reverse=True)))
        heads = [(a,)]
        for _ in range(depth - 2):
            heads = [(*h, s) for h in heads for s in spread if sum(h) + s < capacity and s <= h[-1] or len(h) == 1 and sum(h) + s < capacity]
            for h in heads:
                if (c := fit(capacity - sum(h), capacity)) is not None:
                    out.add(tuple(sorted((*h, c), reverse=True)))
            heads = heads[: tried * tried]
    return sorted(out, reverse=True)


def nnls(index: np.ndarray, weight: np.ndarray, combo: np.ndarray, n: int, target: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises |A x - target|^2, A sparse: entry `weight` in row `index` of column `combo` of n.

    Accelerated projected gradient; the step comes from a bound of the largest singular value.
    """
    if not n:
        return np.zeros(0)
    rows = len(target)
    bound = np.sqrt(np.bincount(combo, weight, n).max() * np.bincount(index, weight, rows).max())
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        left = np.bincount(index, weight * y[combo], rows) - target
        grad = np.bincount(combo, weight * left[index], n)
        new = np.maximum(y - grad / bound**2, 0)
        if (grad * (new - x)).sum() > 0:
            t = 1.0
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
        y = np.maximum(y, 0)
    return x


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """The plan for a histogram of sizes between 1 and the capacity."""
    out, given = Plan([], [], [], [], []), {}
    order = np.argsort(sizes)
    sizes, left = sizes[order].astype(np.int64), counts[order].astype(np.int64).copy()
    at = {int(s): i for i, s in enumerate(sizes)}
    combos = combinations(sizes, capacity) if len(sizes) else []
    if combos:
        made = [dict(zip(*np.unique(c, return_counts=True))) for c in combos]
        index = np.array([at[int(s)] for m in made for s in m])
        weight = np.array([float(k) for m in made for k in m.values()])
        which = np.repeat(np.arange(len(made)), [len(m) for m in made])
        x = nnls(index, weight, which, len(made), left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            times = min([int(x[j] + 0.5), *(int(left[at[int(s)]] // k) for s, k in made[j].items())])
            if times > 0:
                out.add({int(s): int(k) for s, k in made[j].items()}, times, given)
                for s, k in made[j].items():
                    left[at[int(s)]] -= k * times
    # What is left over: the largest size with whatever fits best beside it, as often as all of it lasts.
    have = [int(s) for s, n in zip(sizes, left) if n]
    while have:
        combo, rest = {have[-1]: 1}, capacity - have[-1]
        while True:
            i = bisect.bisect_right(have, rest) - 1
            while i >= 0 and combo.get(have[i], 0) >= left[at[have[i]]]:
                i -= 1
            if i < 0:
                break
            s = have[i]
            k = min(rest // s, int(left[at[s]]) - combo.get(s, 0))
            combo[s] = combo.get(s, 0) + k
            rest -= k * s
        times = min(int(left[at[s]] // k) for s, k in combo.items())
        out.add(combo, times, given)
        for s, k in combo.items():
            left[at[s]] -= k * times
        have = [s for s in have if left[at[s]]]
    return out


def ranked(items: DataFrame, by: list[str], key: str) -> DataFrame:
    """Adds `rank`, from 0 within each combination of `by`: numbered in PARTS parts, each from where the last ends."""
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    cut = items.withColumn("_part", part)
    sizes = cut.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inner = cut.withColumn("_n", F.row_number().over(W.partitionBy(*by, "_part").orderBy(key)) - 1)
    return inner.join(before, [*by, "_part"]).withColumn("rank", F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def pack(spark: SparkSession, items: DataFrame, key: str, size: str, bins: list[tuple[int, int]]) -> DataFrame:
    """Every item in containers of each (bin, capacity): bin_id, capacity, key, piece, from_token, n_tokens, container.

    items: (key, size) with unique keys. An item above the capacity is cut: its full pieces have containers of their
    own, which they fill, and its remainder is packed like an item. No other item is split. An item of size 0 (null
    or empty text) takes no room and is put in container 0. Containers are numbered from 0 in each bin: first those
    of the plan, then one for each full piece. Bins without a capacity above 0 give no rows.

    items are read once for the histogram and once for the result, so pass a written table.
    """
    parts = []
    for bin_id, cap in sorted(set(bins)):
        if cap is None or cap < 1:
            continue
        rest = F.when(F.col(size) > cap, F.col(size) % cap).otherwise(F.col(size))
        sized = items.select(F.col(key), F.col(size).alias("_size"), rest.cast("int").alias("_rest"), F.when(F.col(size) > cap, F.floor(F.col(size) / cap)).otherwise(0).cast("int").alias("_full"))
        seen = sized.where("_rest > 0").groupBy("_rest").agg(F.count("*").alias("n")).collect()  # at most cap rows
        p = plan(np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], np.int64), cap)
        rows = list(zip(p.size, p.rank, p.each, p.times, p.first))
        table = spark.createDataFrame([(int(a), int(b), int(b + c * d), int(c), int(e)) for a, b, c, d, e in rows], "p_size int, a long, z long, each int, first long")
        r = ranked(sized.where("_rest > 0"), ["_rest"], key)
        placed = r.join(table, (F.col("_rest") == F.col("p_size")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("z")))
        tail = placed.select(key, F.col("_full").alias("piece"), (F.col("_full") * F.lit(cap)).cast("long").alias("from_token"), F.col("_rest").cast("long").alias("n_tokens"), (F.col("first") + F.floor((F.col("rank") - F.col("a")) / F.col("each"))).cast("long").alias("container"))
        zero = sized.where("_size = 0").select(key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("from_token"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("container"))
        # Full pieces: items with the same number of them are ranked together, then numbered one after another.
        cut = sized.where("_full > 0")
        many = cut.groupBy("_full").agg(F.count("*").alias("_m"))
        start = many.withColumn("_start", F.coalesce(F.sum(F.col("_m") * F.col("_full")).over(W.orderBy("_full").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_m")  # one row for each number of pieces
        whole = ranked(cut, ["_full"], key).join(start, "_full").withColumn("piece", F.explode(F.expr("sequence(0, _full - 1)")))
        full = whole.select(key, "piece", (F.col("piece") * F.lit(cap)).cast("long").alias("from_token"), F.lit(cap).cast("long").alias("n_tokens"), (F.lit(p.containers) + F.col("_start") + F.col("rank") * F.col("_full") + F.col("piece")).cast("long").alias("container"))
        parts.append(tail.union(zero).union(full).select(F.lit(bin_id).alias("bin_id"), F.lit(cap).alias("token_capacity"), key, "piece", "from_token", "n_tokens", "container"))
    out = parts[0] if parts else items.limit(0).select(F.lit(0).alias("bin_id"), F.lit(0).alias("token_capacity"), key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("from_token"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("container"))
    for x in parts[1:]:
        out = out.union(x)
    return out
