"""Scores, confidence, strata, stores and tests of many hypotheses against plain code."""

import datetime as dt
import random
import statistics

import pytest

from tidemark.operators import crosssec as X
from tidemark.operators import signals as S
from tidemark.operators import similarity as M
from tidemark.operators.recursive import with_recursive
from tidemark.sources import stores as P
from tidemark.sources.views import tercile

D = dt.date


def test_weighted_points_add_up(spark):
    g, p, data = random.Random(2), 20.0, []
    for i in range(150):
        p *= g.uniform(0.96, 1.04)
        data.append((1, D(2024, 1, 1) + dt.timedelta(days=i), p * 0.99, p * 1.01, p * 0.98, p, g.uniform(1, 9)))
    sig = S.signal_columns(with_recursive(spark.createDataFrame(data, "code long, date date, open double, high double, low double, close double, vol double")))
    one = {k: 1.0 for k in S.WEIGHTS}
    x = S.score(sig)
    for name in S.WEIGHTS:
        x = S.score(x, {k: float(k == name) for k in one}, name + "_")
    x = S.score(S.score(x, one, "ones"), S.WEIGHTS, "points").select("score", "ones", "points", *[k + "_" for k in one]).where("score is not null").collect()
    assert len(x) > 50
    for r in x:
        assert r.score == r.ones == sum(r[k + "_"] for k in one)
        assert r.points == pytest.approx(sum(S.WEIGHTS[k] * r[k + "_"] for k in one))


def test_confidence(spark):
    g = random.Random(1)
    groups = {k: [(g.uniform(0, 3), g.choice([0.5, 1.5]), g.randrange(1, lv + 1)) for _ in range(n)] for k, (n, lv) in {"a": (2, 1), "b": (5, 2), "c": (40, 3), "d": (1, 1)}.items()}
    df = spark.createDataFrame([(k, *x) for k, v in groups.items() for x in v], "k string, s double, w double, l int")
    for r in M.confidence(df, ["k"], "s", "w", "l").collect():
        v = groups[r.k]
        levels = len({x[2] for x in v})
        c = (0.5 if len(v) < 3 else 0.8 if len(v) < 6 else 1) * (max(0.6, 1 - min(statistics.pstdev([x[0] for x in v]) / 2, 0.4)) if len(v) > 1 else 1)
        c *= (0.7 + 0.3 * sum(x[1] > 1 for x in v) / len(v)) * {1: 0.7, 2: 0.9, 3: 1}[levels]
        assert r.score == pytest.approx(c, abs=1e-5) and r.confidence == ("high" if c >= 0.6 else "mid" if c >= 0.3 else "low")
    assert M.confidence(df.limit(0), ["k"], "s", "w", "l").count() == 0


def test_strata_fall_back(spark):
    rows = [("a", i, i < 3, True) for i in range(9)] + [("b", i, i < 2, i < 4) for i in range(9)] + [("c", i, None, i < 2) for i in range(9)]
    got = M.stratified(spark.createDataFrame(rows, "k string, i int, x boolean, y boolean"), ["k"], {"one": "x", "two": "y"}, 3).groupBy("k", "used").count().collect()
    assert sorted(map(tuple, got)) == [("a", "one", 3), ("b", "two", 4), ("c", "all", 9)]


def test_terciles_stand_at_sorted_positions(spark):
    g = random.Random(3)
    for n in (0, 1, 2, 3, 7, 200):
        v = [g.choice([None, float("nan"), 5.0, g.uniform(-9, 9), g.uniform(0, 1) * 1e9]) for _ in range(n)]
        s = sorted(x for x in v if x is not None and x == x)
        got = tercile(spark.createDataFrame(list(enumerate(v)), "i int, v double"), "v").collect()
        for r in got:
            want = "small" if r.v is None or r.v != r.v else "large" if r.v >= s[2 * len(s) // 3] else "mid" if r.v >= s[len(s) // 3] else "small"
            assert r.tier == want
        assert len(got) == n


def test_false_discoveries(spark):
    g = random.Random(4)
    for v in ([], [None], [0.001], [g.choice([0.001, 0.02, 0.5, None, g.random() ** 3]) for _ in range(700)]):
        s = sorted(x for x in v if x is not None)
        bound = max((p for k, p in enumerate(s, 1) if p <= 0.05 * sum(x <= p for x in s) / len(v)), default=None)
        got = X.bh_fdr(spark.createDataFrame(list(enumerate(v)), "i int, p double"), "p", 0.05).collect()
        assert len(got) == len(v) and all(r.passed == (bound is not None and r.p is not None and r.p <= bound) for r in got)


def test_versions_appear_whole(spark, tmp_path):
    v = P.Versions(spark, f"file://{tmp_path}/t")
    v.commit(spark.range(3))
    v.commit(spark.range(5))
    with pytest.raises(Exception):
        v.commit(spark.range(9).selectExpr("if(id = 8, raise_error('no'), id) as id"))
    assert v.read().count() == 5


def test_conform_adds_and_drops(spark):
    got = P.conform(spark.createDataFrame([("1", "x", 2)], "b string, a string, c int"), "a string, b double, d date")
    assert got.dtypes == [("a", "string"), ("b", "double"), ("d", "date")] and tuple(got.first()) == ("x", 1.0, None)
