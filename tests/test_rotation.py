"""Rotations against a plain loop over a matrix of prices."""

import datetime as dt
import random

import pytest

from tidemark.operators import rotation as R

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]


def market(seed=5):
    g = random.Random(seed)
    rows = {}
    for c in range(12):
        p = g.uniform(10, 30)
        for t, _ in enumerate(DAYS):
            p *= g.uniform(0.95, 1.055)
            if g.random() < (0.5 if c == 3 and t > 40 else 0.05):
                continue
            rows[c, t] = (p * g.uniform(0.99, 1.01), p, g.choice([None, g.random(), g.random()]), g.random() < 0.1, g.random() < 0.05, g.random() < 0.05)
        if c == 7:
            rows = {k: v for k, v in rows.items() if k[0] != 7 or k[1] < 30}
    mask = [g.random() < 0.8 for _ in DAYS]
    return rows, mask


def plain(rows, mask, r):
    """Worth of each day from the first on which anything could be bought."""
    cash, pos, gone, out = 1e6, {}, {}, []
    before = {}  # code -> score and exit of its last bar
    began = None
    for t in range(len(DAYS)):
        here = {c: rows[c, t] for c in range(12) if (c, t) in rows}
        can = sorted((c for c in here if before.get(c, (None,))[0] is not None and not here[c][4]), key=lambda c: (-before[c][0], c))
        if began is None and can:
            began = t
        if began is None:
            before.update({c: (h[2], h[3]) for c, h in here.items()})
            continue
        k = t - began
        for c in sorted(pos):
            p = pos[c]
            if c not in here:
                p["miss"] += 1
                if p["miss"] >= 20:
                    cash += p["n"] * p["last"] * 0.999
                    gone[c] = k
                    del pos[c]
                continue
            p["miss"] = 0
            low = (r.stop is not None and p["last"] <= p["cost"] * (1 - r.stop)) or (r.trail is not None and p["last"] <= p["peak"] * (1 - r.trail))
            p["last"] = here[c][1]
            p["peak"] = max(p["peak"], p["last"])
            leave = low or (k % r.every == 0 and (k - p["t"] >= r.hold or before[c][1])) or (r.masked and r.off_sells and not mask[t])
            if leave and not here[c][5]:
                cash += p["n"] * (here[c][0] if r.at_open else here[c][1]) * 0.999
                gone[c] = k
                del pos[c]
        if k % r.every == 0 and (mask[t] or not r.masked):
            for c in can:
                if len(pos) == r.top:
                    break
                if c in pos or (r.pause and c in gone and k - gone[c] < r.pause):
                    continue
                price = here[c][0 if r.at_open else 1] * 1.001
                n = int((cash + sum(p["n"] * p["last"] for p in pos.values())) / r.top / price / 100) * 100
                if n and n * price <= cash:
                    cash -= n * price
                    pos[c] = {"n": n, "cost": price, "t": k, "last": here[c][1], "peak": here[c][1], "miss": 0}
        out.append((DAYS[t], (cash + sum(p["n"] * p["last"] for p in pos.values())) / 1e6))
        before.update({c: (h[2], h[3]) for c, h in here.items()})
    return out


RULES = [R.Rotation("open", 3, 5), R.Rotation("close", 4, 8, at_open=False), R.Rotation("mask", 3, 5, masked=True), R.Rotation("flat", 3, 30, masked=True, off_sells=True), R.Rotation("stops", 4, 40, stop=0.04, trail=0.06, pause=6), R.Rotation("weekly", 3, 10, every=5)]


def test_rotations_against_a_loop(spark):
    rows, mask = market()
    data = [("k", c, DAYS[t], *x[:4], *x[4:], mask[t]) for (c, t), x in rows.items()]
    df = spark.createDataFrame(data, "kind string, code int, date date, open double, close double, score double, exit boolean, lim_up boolean, lim_dn boolean, on boolean")
    got = {}
    for r in R.rotate(R.candidates(df, 12), {"k": RULES}).collect():
        got.setdefault(r["name"], {})[r.date] = r.v
    for rule in RULES:
        want = plain(rows, mask, rule)
        assert len(want) > 60 and set(got[rule.name]) == {d for d, _ in want}
        assert [got[rule.name][d] for d, _ in want] == pytest.approx([v for _, v in want])
    assert R.rotate(R.candidates(df.limit(0), 12), {"k": RULES}).count() == 0
