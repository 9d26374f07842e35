"""Days of bars in p1, p3 and p6, and the grid and the totals, against plain loops; dates null, empty, unreadable, early and late."""

import datetime as dt

import pytest
from pyspark.sql import SparkSession

from tidemark.plans import registry
from tidemark.sources import tables

D = dt.date
DAYS = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
OPEN = {d for d in DAYS if d.weekday() < 5 and d != D(2024, 1, 10)}
BARS = [  # code, date, src
    *[("sh600001", str(d), "a") for d in DAYS[:5]],
    ("sh600001", "2024-01-10", "a"),
    ("sh600001", "2024-02-05 09:30", "a"),
    ("600001", "20240205", "a"),
    *[("sh600001", x, "a") for x in (None, "", "  ", "n/a", "2024-13-01", "2024-02-31", "tomorrow")],
    ("sh600001", "2024-01-04", "b"),
    ("sh600001", None, "b"),
    ("sh600002", "2023-12-30", "a"),
    ("sh600002", "2024-01-07", "a"),
    ("sh600002", "2024-02-28", "a"),
    ("sh600002", "2031-01-01", "a"),
    ("sh600003", None, "a"),
    ("nonsense", "2024-01-03", "a"),
    (None, "2024-01-03", "a"),
    ("sh600001", "2024-01-03", None),
]
READ = {"20240205": D(2024, 2, 5), "2024-02-05 09:30": D(2024, 2, 5)}


def day_of(text):
    try:
        d = READ.get(text) or dt.datetime.strptime(text or "", "%Y-%m-%d").date()
    except ValueError:
        return None
    return max((o for o in OPEN if o <= d), default=None)


def form(code):
    return {"600001": "sh600001"}.get(code, code if code and code.startswith("sh6") else None)


def series():
    out = {}
    for c, d, s in BARS:
        if form(c) and s and day_of(d):
            out.setdefault((s, form(c)), set()).add(day_of(d))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("days"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    t = dt.datetime(2024, 3, 1)
    put([(i, c, d, 10.0, 10.0, 10.0, 10.0 + i, 100.0 + i, s, None, t) for i, (c, d, s) in enumerate(BARS)], "bar_id long, code string, date string, open double, high double, low double, close double, vol double, src string, note string, fetched_at timestamp", "daily_bars")
    put([(str(d), d in OPEN) for d in DAYS], "cal_day string, is_open boolean", "trade_days")
    put([("a", "2020-01-01", "x", "price: yuan; vol: shares"), ("b", "2020-01-01", "x", "price: yuan; vol: shares")], "src string, since string, desk string, unit_note string", "feeds")
    put([(1, "sh600001", "n", "i", 1.0, "t", "2024-01-03", t), (2, "sh600002", "n", "i", 1.0, "t", "2023-01-03", t)], "snap_id long, code string, name string, industry string, mktcap double, tier string, updated string, loaded_at timestamp", "stocks")
    put([(1, "sh600002", "2024-01-31", 0.0)], "dl_id long, code string, last_date string, ts double", "delisted")
    put([(1, "sh600001", 1.0, None, None), (2, "sh600001", 1.0, None, 1.0), (3, None, 1.0, None, None), (4, "sh699999", 1.0, None, None)], "adj_id long, code string, k double, k_text string, ts double", "adjust")
    return at


def rows(spark, name, folder):
    return sorted(map(tuple, registry.queries()[name](spark, folder).collect()), key=str)


def test_missing_open_days(spark, folder):
    want = [(s, c, str(o)) for (s, c), got in series().items() for o in OPEN if min(got) < o < max(got) and o not in got]
    assert len(want) > 20 and rows(spark, "p1_found", folder) == sorted(want)


def test_grid_ends_with_its_series(spark, folder):
    want = sorted((s, c, str(o), o in got) for (s, c), got in series().items() for o in OPEN if min(got) <= o <= max(got))
    assert [(*r[:3], r[4] == "recorded") for r in rows(spark, "p1_grid", folder)] == want


def each_day(got):
    return [min(got) + dt.timedelta(days=i) for i in range((max(got) - min(got)).days + 1)]


def test_idle_weeks(spark, folder):
    want = [(s, c, str(x)) for (s, c), got in series().items() for x in each_day(got) if not any(0 <= (x - g).days < 7 for g in got)]
    assert len(want) > 20 and rows(spark, "p3_found", folder) == sorted(want)


def test_totals_of_each_day(spark, folder):
    last = {}
    for i, (c, d, s) in enumerate(BARS):
        if form(c) and s and day_of(d):
            last[s, form(c), day_of(d)] = (10.0 + i, 100.0 + i)  # fetched at one time: the highest id counts
    got = {(r.src, r.code, r.day): r for r in registry.queries()["p3_totals"](spark, folder).collect()}
    for (s, c), days in series().items():
        for x in each_day(days):
            r = got.pop((s, c, str(x)))
            for w in (7, 30):
                near = [last[s, c, g] for g in days if 0 <= (x - g).days < w]
                assert r[f"n_{w}"] == len(near)
                for k, v in ((0, "close"), (1, "vol")):
                    total = sum(n[k] for n in near) if near else None
                    assert r[f"sum_{v}_{w}"] == pytest.approx(total) and r[f"avg_{v}_{w}"] == pytest.approx(total and total / len(near))
    assert not got


def test_orphans_need_a_day_for_a_period(spark, folder):
    since, upto = {"sh600001": D(2024, 1, 3), "sh600002": D(2023, 1, 3)}, {"sh600002": D(2024, 1, 31)}
    want = []
    for i, (c, d, s) in enumerate(BARS):
        day, f = day_of(d), form(c)
        if c is not None and (f not in since or (day and (day < since[f] or day > upto.get(f, day)))):
            want.append(("daily_bars", i))
    want += [("adjust", 2), ("adjust", 4)]
    assert rows(spark, "p6_found", folder) == sorted(want, key=str)


def test_a_calendar_that_is_none_is_refused(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "MOST_DAYS", 10)
    with pytest.raises(Exception, match="more than 10 days"):
        tables.calendar(spark, folder).collect()


class Far:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, other=None: other)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Far)


def test_release_deletes_what_was_cut(spark):
    assert isinstance(spark, SparkSession)
    path = tables.cut(spark.range(3), "gone").inputFiles()[0]
    tables.release(spark)
    import os

    assert not os.path.exists(path.removeprefix("file:"))
