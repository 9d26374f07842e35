"""What the review of round 2 found: each test fails on the code before."""

import numpy as np

from tests.test_advice_r01 import bars_of


def test_pool_looks_at_few_pairs_in_full(monkeypatch):
    """the shapes alone rule out most pairs, and peers that are the same are compared once, but count as many."""
    from tidemark.operators import matching as N

    looked, full = [], N._totals
    monkeypatch.setattr(N, "_totals", lambda f, i, *x: looked.append(len(i)) or full(f, i, *x))
    t, peers = N.Series(bars_of(300, 1), 10), [N.Series(bars_of(300, s), 10) for s in range(2, 22)]
    got = N.pool_series(t, peers)
    pairs = sum(int((p.known <= day).sum()) for p in peers for day in t.day)
    assert sum(looked) < pairs / 5
    assert np.allclose(got, N.pool_series(t, peers, cells=2000), equal_nan=True, atol=1e-12)
    looked.clear()
    same = N.pool_series(t, [peers[0]] * 12)
    assert sum(looked) < pairs / 5
    for i in np.flatnonzero(np.isfinite(same))[:50]:  # ten of twelve like windows: the best one alone
        age = t.day[i] - peers[0].known
        d = N._totals(N.laid(t.z, t.ctx), np.full(len(age), i), N.laid(peers[0].z, peers[0].ctx), np.arange(len(age)), np.full(len(age), 10, np.float32), np.full(len(age), 1e9))[1]
        assert np.isclose(same[i], peers[0].nxt[np.argmin(np.where(age >= 0, d, np.inf))])


def test_own_series_picks_by_array_as_by_loop(monkeypatch):
    """no pick of one window at a time, and the same picks as greedy_apart."""
    from tidemark.operators import similarity as S

    c = bars_of(160, 5)["close"].to_numpy()
    slow = S.greedy_apart
    monkeypatch.setattr(S, "greedy_apart", lambda *x: 1 / 0)
    got = S.own_series(c, every=1)
    assert [r[0] for r in got] == list(range(26, 160))
    z = S._windows(np.diff(np.log(c)), 10)
    for bar, up, _, n, best in got:
        d = np.sqrt(np.maximum(20 - 2 * z[: bar - 20] @ z[bar - 10], 0))
        y = [c[p + 11] / c[p + 10] - 1 for p in slow(np.round(d, 9), np.arange(len(d)), 10, 5)]
        assert n == len(y) and np.isclose(best, d.min()) and (up is None if n < 6 else np.isclose(up, np.mean(np.array(y) > 0)))


def test_states_come_with_own_matches_and_chips(spark):
    """one pass makes what two passes and a join made before."""
    import pandas as pd
    from tidemark.operators import atomic as A
    from tidemark.operators.recursive import with_recursive

    data = pd.concat([bars_of(n, s) for n, s in ((200, 1), (40, 2), (5, 3), (1, 4))], ignore_index=True)
    data.loc[30, "close"] = None
    b = spark.createDataFrame(data, "code long, date date, open double, high double, low double, close double, vol double")
    b = b.selectExpr("* except (close)", "nanvl(close, null) as close", "vol / 2 as more")
    got = A.states_own_and_chips(b, ("more",)).toPandas().sort_values(["code", "date"], ignore_index=True)
    want = with_recursive(b).join(A.own_and_chips(b), ["code", "date"], "left").toPandas().sort_values(["code", "date"], ignore_index=True)
    assert len(got) == len(want) == len(data) - 1
    cols = ["code", "date", "close", "vol", *A.STATES, *A.OWN]
    pd.testing.assert_frame_equal(got[cols], want[cols])
    assert np.allclose(got["more"], got["vol"] / 2)


def test_bars_are_made_once(spark, monkeypatch):
    """the panel reads the lines once, not once a factor."""
    import os

    from tidemark.plans import research as Q

    made, data = [], os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
    bars = Q.bars_bounded
    monkeypatch.setattr(Q, "bars_bounded", lambda *x: made.append(1) or bars(*x))
    df = Q._atomic(spark, data)
    assert len(made) == 1 and not any("lineitem" in f for f in df.inputFiles())


def test_products_equal_the_covariances(spark):
    """sums of products by array are those of the aggregates, however the rows are parted."""
    from tidemark.operators import ml as L

    g = np.random.default_rng(3)
    rows = [(f"2000-01-{1 + d:02d}", *map(float, g.normal(size=3)), None if i == 7 else float(g.normal())) for d in range(4) for i in range(12 - 4 * (d == 3))]
    p = spark.createDataFrame(rows, "d string, a double, b double, c double, y double").selectExpr("cast(d as date) as date", "a", "b", "c", "y").repartition(5)
    got, want = (f(p, ["a", "b", "c"], "y", least=8).orderBy("date").toPandas() for f in (L.day_products, L.day_stats))
    assert list(got.columns) == list(want.columns) and len(got) == 3 and (got["n"] == want["n"]).all() and (got["date"] == want["date"]).all()
    assert np.allclose(got.drop(columns="date").astype(float), want.drop(columns="date").astype(float), atol=1e-12)


def test_blocks_of_subsets_equal_each_subset(spark):
    """all subsets in blocks, with the figures of each subset alone."""
    from tidemark.operators import ml as L

    g, k, days = np.random.default_rng(4), 11, 300
    x, y = g.normal(size=(days, 30, k)), g.normal(size=(days, 30))
    x[3, :, :5], x[5] = 0, 0
    s, q, yy = np.einsum("dni,dn->di", x, y), np.einsum("dni,dnj->dij", x, x), (y * y).sum(axis=1)
    inner, cut = L.inner_sums(k, q, yy), 210
    for block in range(4):
        ic = L.subset_ic(block * 512 + np.arange(512), k, s, q, yy)
        want = [f(part).sum(axis=1) for part in (ic[:, :cut], ic[:, cut:]) for f in (np.asarray, np.square)]
        assert np.allclose(L.subset_moments(block, k, s, q, yy, inner, cut), want)


def test_ranks_without_a_sort_a_column(spark):
    """the total is the weighted percent ranks, ties by mask."""
    from pyspark.sql import functions as F
    from pyspark.sql import Window as W
    from tidemark.operators import ml as L

    g = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(g.integers(0, 9)), float(g.normal())) for i in range(1, 200)], "mask long, a double, b double")
    r = lambda c: F.percent_rank().over(W.orderBy(c, "mask"))
    want = df.select("mask", F.round(0.25 * r("a") + 0.75 * r("b"), 6).alias("total"))
    got = L.ranked(df.repartition(3), {"a": 0.25, "b": 0.75})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
