"""The dealt core operators on small inputs with nulls, ties, repeats, empty tables and clashing names."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import spikes, units
from tidemark.operators.grid import regular_grid
from tidemark.operators.history import latest_snapshots, versions
from tidemark.operators.orphans import bloom, orphans, probe, words_for
from tidemark.operators.trailing import trailing_totals

D = dt.date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_grid_fills_marks_and_extends(spark):
    df = spark.createDataFrame([("a", 1, 10.0, "x"), ("a", 3, 30.0, "y"), ("a", 12, 5.0, None), ("b", 4, None, None), ("c", None, 1.0, None)], "k string, t int, v double, _next string")
    got = rows(regular_grid(df.select("k", "t", "v"), ["k"], "t", ["v"], fill_within=3))
    assert got[:3] == [("a", 1, 10.0, "recorded"), ("a", 2, 20.0, "interpolated"), ("a", 3, 30.0, "recorded")]
    assert got[3] == ("a", 4, None, "missing") and got[11] == ("a", 12, 5.0, "recorded") and got[12] == ("b", 4, None, "recorded")
    assert len(got) == 13
    assert rows(regular_grid(df, ["k"], "t"))[1][-1] == "interpolated"  # a column named like an inner one
    wide = rows(regular_grid(df.where("k = 'b'").select("k", "t"), ["k"], "t", start=F.lit(2), end=F.lit(5)))
    assert [r[1:] for r in wide] == [(2, "missing"), (3, "missing"), (4, "recorded"), (5, "missing")]
    assert rows(regular_grid(df.limit(0), ["k"], "t", ["v"])) == []


def test_trailing_totals_against_brute_force(spark):
    rng = random.Random(3)
    data = [(k, D(2024, 1, 1) + dt.timedelta(days=rng.randrange(60)), rng.choice([None, math.nan, 0.1, 0.2, 7.3, math.inf])) for k in "ab" for _ in range(30)] + [("n", None, 1.0)]
    got = {(r.k, r.d): r for r in trailing_totals(spark.createDataFrame(data, "k string, d date, v double"), ["k"], "d", ["v"], (7, 30)).collect()}
    for k in "ab":
        own = [(d, v) for x, d, v in data if x == k]
        first, last = min(d for d, _ in own), max(d for d, _ in own)
        for i in range((last - first).days + 1):
            day = first + dt.timedelta(days=i)
            for w in (7, 30):
                near = [(d, v) for d, v in own if 0 <= (day - d).days < w]
                vals = [v for _, v in near if v is not None and math.isfinite(v)]
                r = got.pop((k, day)) if w == 30 else got[(k, day)]
                assert r[f"n_{w}"] == len({d for d, _ in near})
                assert (r[f"sum_v_{w}"] is None) == (not vals)
                if vals:
                    assert abs(r[f"sum_v_{w}"] - sum(vals)) < 1e-9 and abs(r[f"avg_v_{w}"] - sum(vals) / len(vals)) < 1e-9
    assert not got
    assert trailing_totals(spark.createDataFrame([], "k string, d date, v double"), ["k"], "d", ["v"]).count() == 0


def test_history_over_many_snapshots(spark):
    rng = random.Random(1)
    data = []
    for k in "ab":
        for i in range(150):  # more than two words of bits
            data.append((k, D(2024, 1, 1) + dt.timedelta(days=2 * i), rng.choice(["x", "x", "x", "y", None]), rng.choice([1.0, 1.0, 1.0, 2.0, None]), i))
    data += [("a", D(2024, 1, 1), "z", 9.0, -1), ("c", D(2024, 5, 1), None, None, 0), ("c", D(2024, 5, 3), "q", None, 0), ("d", None, "q", 1.0, 0)]
    s = latest_snapshots(spark.createDataFrame(data, "k string, d date, a string, b double, o int"), ["k"], "d", ["a", "b"], ["o"])
    got = rows(versions(s, ["k"], "d", {"a": F.col("a"), "b": F.col("b")}).select("k", "valid_from", "a", "b"))
    want = []
    for k in "abc":
        last, best = None, {}
        for x, d, a, b, o in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[4])):
            best[d] = (a, b)
        for d in sorted(best):
            a, b = best[d]
            now = (a if a is not None else last and last[0], b if b is not None else last and last[1])
            if last is None or now != last:
                want.append((k, d, *now))
            last = now
    assert sorted(got, key=str) == sorted(want, key=str)
    ends = versions(s, ["k"], "d", {"a": F.col("a"), "b": F.col("b")}).where("k = 'c'").orderBy("valid_from").select("valid_to").collect()
    assert [r[0] for r in ends] == [D(2024, 5, 2), None]
    assert versions(s.limit(0), ["k"], "d", {"a": F.col("a")}).count() == 0


def test_orphans(spark):
    kids = spark.createDataFrame([(1, "a", D(2024, 1, 5), True), (2, "a", D(2023, 1, 1), True), (3, "a", D(2025, 1, 1), True), (4, "zz", D(2024, 1, 5), True), (5, None, D(2024, 1, 5), True), (6, None, None, False), (7, "a", None, True), (8, "zz", None, True), (8, "zz", None, True)], "id int, c string, d date, has_ref boolean")
    par = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 6, 1), True), ("b", None, None, True)], "c string, since date, upto date, known boolean")
    got = rows(orphans(kids, "c", "d", par, ["id"]).select("id", "why"))
    assert got == [(2, "not yet"), (3, "closed"), (4, "no such key"), (5, "no such key"), (8, "no such key"), (8, "no such key")]
    assert orphans(kids.limit(0), "c", "d", par, ["id"]).count() == 0
    assert {r.why for r in orphans(kids, "c", "d", par.limit(0), ["id"]).collect()} == {"no such key"}


def test_orphans_of_a_heavy_key(spark):
    day = D(2024, 1, 5)
    data = [(i, "hot" if i % 3 else f"k{i}", D(2024, 1, 1 + i % 9), True) for i in range(900)]
    kids = spark.createDataFrame(data, "id int, c string, d date, has_ref boolean")
    par = spark.createDataFrame([("hot", day, None, True)] + [(f"k{i}", D(2023, 1, 1), day, True) for i in range(0, 900, 6)], "c string, since date, upto date, known boolean")
    want = sorted((i, "not yet" if c == "hot" else "closed" if i % 6 == 0 else "no such key") for i, c, d, _ in data if (c == "hot" and d < day) or (c != "hot" and (i % 6 or d > day)))
    assert rows(orphans(kids, "c", "d", par, ["id"]).select("id", "why")) == want


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as c")
    f = bloom(keys.union(keys), "c", 512)
    assert f.count() <= 512
    assert probe(keys, "c", f, 512).where("not maybe").count() == 0
    words = words_for(keys, "c")
    other = probe(spark.range(5000).selectExpr("concat('o', id) as c"), "c", bloom(keys, "c", words), words)
    assert other.where("maybe").count() < 100  # most strangers are proven to be


def test_compositions_and_cycles():
    c = units.compositions(units.EDGES, units.CANONICAL)
    assert c["li"][0] == "yuan" and math.isclose(c["li"][1], 0.001) and math.isclose(c["wan"][1], 10000) and math.isclose(c["bp"][1], 1e-4)
    deg = units.compositions((units.Edge("f", "c", 5 / 9, -160 / 9), units.Edge("c", "k", 1.0, 273.15)), ("k",))
    assert math.isclose(212 * deg["f"][1] + deg["f"][2], 373.15)
    with pytest.raises(ValueError):
        units.compositions((*units.EDGES, units.Edge("li", "yuan", 0.002)), units.CANONICAL)


NOTES = {
    "vol(手); px: fen": ("fen", "lot"),
    "px in yuan, vol, unit 10,000 shares (as agreed)": ("yuan", "wan"),
    "单位 成交量:股 / px in yuan": ("yuan", "share"),
    "units - prices in 1/100 yuan, Vol. in Losen": ("fen", "lot"),
    "PRICES IN 1/1000 YUAN": ("li", None),
    "Vol. in Tsd. Stück。": (None, "kshare"),
    "volume in k shares": (None, "kshare"),
    "价格单位:厘 / 成交量:千股": ("li", "kshare"),
    "vol in 10k shares; Kurs in Fen": ("fen", "wan"),
    "volume = single shares, 价格单位:元": ("yuan", "share"),
    "fen-based billing of this feed ends soon": (None, None),
    "holder sold 300 thousand shares": (None, None),
    "高管增持1.2万股公告": (None, None),
    "5 lots crossed at open": (None, None),
    "": (None, None),
    None: (None, None),
}


def test_notes(spark):
    df = spark.createDataFrame([(k,) for k in NOTES], "x string")
    got = {r.x: (r.p, r.v) for r in df.select("x", units.price_unit(F.col("x")).alias("p"), units.volume_unit(F.col("x")).alias("v")).collect()}
    assert got == NOTES


def test_true_levels_finds_silent_stretches_and_ignores_spikes():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.cumsum(rng.normal(0, 0.01, 120)), np.cumsum(rng.normal(0, 0.01, 100))])
    truth = np.zeros(220, int)
    truth[30:45], truth[180:210] = 3, 2
    x = x + truth
    x[[60, 61, 190]] += [1, 1, -1]
    start = np.repeat([0, 120], [120, 100])
    got = units.true_levels(x, np.zeros(220), start, [0, 2, 3])
    assert (got == truth).all()
    assert len(units.true_levels(np.zeros(0), np.zeros(0), np.zeros(0, int), [0])) == 0
    assert (units.true_levels(np.array([0.0, 1.0]), np.array([2.0, 2.0]), np.array([0, 0]), [0, 2, 3]) == 2).all()


def test_robust_pca_recovers_where_theory_says_so():
    rng = np.random.default_rng(1)
    low = np.outer(rng.normal(size=400), rng.normal(size=60))
    sparse = np.where(rng.random((400, 60)) < 0.03, rng.choice([-20.0, 20.0], (400, 60)), 0)
    a, s = spikes.robust_pca(low + sparse, 60)
    assert np.abs(a - low).max() < 0.01 and np.abs(s - sparse).max() < 0.01


def test_robust_pca_of_few_columns_loses_nothing():
    """Few columns needn't be told apart exactly; what the search relies on is that a spike is in one of the parts."""
    rng = np.random.default_rng(2)
    m = np.outer(rng.normal(size=400), rng.normal(size=9)) + np.where(rng.random((400, 9)) < 0.03, 20.0, 0)
    a, s = spikes.robust_pca(m, 60)
    assert np.abs(m - a - s).max() < 0.01
    assert spikes.robust_pca(np.zeros((0, 9)))[0].shape == (0, 9)


def _judge(series, ref, hi, lo, active):
    """The rules said plainly."""
    up, dn, stuck = [math.inf] * len(ref), [-math.inf] * len(ref), [False] * len(ref)
    for s in set(series):
        ix = [i for i in range(len(ref)) if series[i] == s]
        known = [ref[i] for i in ix if math.isfinite(ref[i])]
        moves = [abs(b / a - 1) for a, b in zip(known, known[1:])]
        moves = [0 if m < 1e-9 else m for m in moves]
        if not moves or 2 * sum(m == 0 for m in moves) > len(moves) or np.median(moves) == 0:
            continue
        m = float(np.median(moves))
        for j in range(len(ix)):
            for n in (1, 2, 3):
                for a in range(j - n + 1, j + 1):
                    z = a + n - 1
                    before = [ref[i] for i in ix[: max(a, 0)] if math.isfinite(ref[i])]
                    after = [ref[i] for i in ix[z + 1 :] if math.isfinite(ref[i])]
                    if a < 0 or z >= len(ix) or not before or not after:
                        continue
                    o, u = max(before[-1], after[0]) * (1 + 12 * m), min(before[-1], after[0]) * (1 - 12 * m)
                    if all(hi[ix[k]] > o for k in range(a, z + 1)):
                        up[ix[j]] = min(up[ix[j]], o)
                    if all(lo[ix[k]] < u for k in range(a, z + 1)):
                        dn[ix[j]] = max(dn[ix[j]], u)
        run = []
        for i in ix + [None]:
            if i is not None and run and math.isfinite(ref[i]) and active[i] and abs(ref[i] / ref[run[-1]] - 1) < 1e-9:
                run.append(i)
                continue
            if len(run) >= 10:
                for k in run:
                    stuck[k] = True
            run = [i] if i is not None and math.isfinite(ref[i]) and active[i] else []
    return up, dn, stuck


@pytest.mark.parametrize("seed", range(6))
def test_judge_days_against_the_rules(seed):
    rng = np.random.default_rng(seed)
    series, ref = np.repeat([1, 2, 3, 4], 70), np.concatenate([20 * np.exp(np.cumsum(rng.normal(0, 0.01, 70))) for _ in range(4)])
    ref[210:280] = 5.0  # never moves
    ref[80:95] = ref[80]  # stuck
    hi, lo = ref * 1.005, ref * 0.995
    for i in rng.integers(3, 200, 12):
        f, n = rng.choice([2.0, 0.4, 10.0]), int(rng.integers(1, 4))
        hi[i : i + n] *= max(f, 1)
        lo[i : i + n] *= min(f, 1)
        if rng.random() < 0.6:
            ref[i : i + n] *= f
            hi, lo = np.maximum(hi, ref), np.minimum(lo, ref)
    ref[rng.integers(0, 280, 8)] = np.nan
    active = rng.random(280) < 0.98
    up, dn, stuck = spikes.judge_days(series, ref, hi, lo, active)
    u, d, s = _judge(series, ref, hi, lo, active)
    hit, want = (hi > up) | (lo < dn), (hi > np.array(u)) | (lo < np.array(d))
    assert (hit == want).all() and (stuck == np.array(s)).all()
    assert np.allclose(up[want & np.isfinite(u)], np.array(u)[want & np.isfinite(u)])


def test_judge_nothing():
    z = np.zeros(0)
    assert all(len(x) == 0 for x in spikes.judge_days(z, z, z, z, z.astype(bool)))
    nan = np.full(3, np.nan)
    up, dn, stuck = spikes.judge_days(np.ones(3), nan, nan, nan, np.ones(3, bool))
    assert np.isinf(up).all() and not stuck.any()


def _market(tmp, n=60, extra=()):
    """A small folder of tables: feed f1 in yuan, f2 silent in fen; code sh600001 in both, sh600002 only in f2."""
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(n + 20)]
    rng = np.random.default_rng(5)
    price = {c: np.round(20 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), 2) for c in ("sh600001", "sh600002")}
    out, k = [], 0
    for i in range(n):
        for src, code, f in (("f1", "sh600001", 1), ("f2", "sh600001", 100), ("f2", "sh600002", 100)):
            p = float(price[code][i] * f)
            k += 1
            out.append((k, code, days[i].isoformat(), p, p * 1.01, p * 0.99, p, 1000.0, src, None, dt.datetime(2024, 6, 1)))
    out += [(k + 1 + j, *r) for j, r in enumerate(extra)]
    cols = ["bar_id", "code", "date", "open", "high", "low", "close", "vol", "src", "note", "fetched_at"]
    b = pd.DataFrame(out, columns=cols)
    b["fetched_at"] = b["fetched_at"].astype("datetime64[us]")
    b.to_parquet(f"{tmp}/daily_bars.parquet")
    pd.DataFrame({"src": ["f1", "f2"], "since": ["2024-01-01"] * 2, "desk": [None, "x"], "unit_note": ["px in yuan; vol in shares", None]}).to_parquet(f"{tmp}/feeds.parquet")
    pd.DataFrame({"cal_day": [d.isoformat() for d in days], "is_open": [True] * len(days)}).to_parquet(f"{tmp}/trade_days.parquet")
    a = pd.DataFrame({"adj_id": [1, 2, 3, 4, 5], "code": ["sh600001"] * 4 + [None], "k": [0.2, 20.1, None, 0.21, np.nan], "k_text": [None, None, "2050 bp", "21%", "n/a"], "ts": [1.7e9] * 5})
    a.to_parquet(f"{tmp}/adjust.parquet")
    return str(tmp), k


def test_units_of_a_silent_feed_and_of_single_rows(spark, tmp_path):
    t = dt.datetime(2024, 6, 1)
    extra = [("sh600001", "2024-01-05", 2000.0, 2000.0, 2000.0, 2000.0, 10.0, "f1", "Kurs in Fen; vol in lots", t), ("sh600001", "2024-01-05", None, None, None, None, 0.0, "f2", None, t), ("???", "2024-01-05", 1.0, 1.0, 1.0, 1.0, 5.0, "f2", None, t), (None, None, math.nan, 1.0, 1.0, math.inf, None, "f9", None, t)]
    d, k = _market(tmp_path, extra=extra)
    got = {(r.tab, r.row_id, r.field) for r in units.unit_cases(spark, d).collect()}
    want = {("daily_bars", i, "close") for i in range(1, k + 1) if i % 3 != 1}
    want |= {("daily_bars", k + 1, "close"), ("daily_bars", k + 1, "vol"), ("daily_bars", k + 3, "close"), ("adjust", 2, "k"), ("adjust", 3, "k")}
    assert got == want
    c = {r.bar_id: r for r in units.common_bars(spark, d).collect()}
    assert abs(c[2].close - c[1].close) < 1e-9 and c[k + 1].close == 20.0 and c[k + 1].vol == 1000.0 and c[k + 2].close is None
    assert {r.adj_id: round(r.k, 6) for r in units.common_factors(spark, d).collect()} == {1: 0.2, 2: 0.201, 3: 0.205, 4: 0.21}


def test_spike_rows_with_corrections(spark, tmp_path):
    t = dt.datetime(2024, 6, 2)
    extra = [("sh600001", "2024-01-20", 20.0, 900.0, 19.0, 20.0, 10.0, "f1", None, dt.datetime(2024, 5, 1)), ("sh600001", "bad", 20.0, 5.0, 19.0, 20.0, 10.0, "f1", None, t), (None, "2024-01-20", -1.0, None, None, None, None, "f1", None, t)]
    d, k = _market(tmp_path, extra=extra)
    got = {r.bar_id: r.why for r in spikes.spike_rows(spark, d).collect()}
    assert got == {k + 1: "spike", k + 2: "impossible", k + 3: "impossible"}


def test_spike_rows_of_no_bars(spark, tmp_path):
    d, _ = _market(tmp_path)
    pq.write_table(pq.read_table(f"{d}/daily_bars.parquet").slice(0, 0), f"{d}/daily_bars.parquet")
    assert spikes.spike_rows(spark, d).count() == 0
    assert {r.tab for r in units.unit_cases(spark, d).collect()} == {"adjust"}
