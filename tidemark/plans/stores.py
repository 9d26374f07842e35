"""Queries for stores, caches and reports (SRC, SNK, LKP, UDF, DUP), beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import normal_code
from tidemark.operators import windows as I
from tidemark.plans.declare import declare
from tidemark.plans.problems_sql import code_ctes
from tidemark.sources import stores as P
from tidemark.sources.tables import shared_path, table
from tidemark.sources.views import BOUNDED_SQL, FACTORS_SQL, INSTRUMENTS_SQL, bars_bounded, factors, instruments

QUERIES, SQL, query = declare()
BOUND = f"WITH {BOUNDED_SQL}, bars AS (SELECT * FROM bounded)"
TODAY = "1998-08-02"


@query("SELECT code, name, industry, mktcap, tier, updated, CAST(NULL AS VARCHAR) AS board FROM stocks")
def src_1_declared_schema(spark, d):
    """A table read into its declared schema, to which a column was added since it was written."""
    return P.conform(table(spark, d, "stocks"), P.SCHEMAS["instruments"])


@query(f"{BOUND} SELECT code, date, close FROM bars WHERE date < DATE '1998-01-01'")
def src_2_committed_version(spark, d):
    """What readers see after one version was published and the next failed while it was written."""
    v = P.Versions(spark, shared_path(spark, "versions"))
    b = bars_bounded(spark, d).select("code", "date", "close")
    v.commit(b.where("date < date'1998-01-01'"))
    try:
        v.commit(b.where(F.assert_true(F.col("close") < 0, F.lit("broken off")).isNull()))
    except Exception as e:  # noqa: BLE001
        if "broken off" not in str(e):
            raise
    return v.read()


_PLAN = f"u AS (SELECT code FROM inst), h AS (SELECT code, count(*) AS n, max(date) AS last FROM bars WHERE code % 5 <> 0 AND (code % 3 <> 0 OR date < DATE '1998-01-01') AND (code % 7 <> 1 OR date < DATE '1992-03-01') AND date <= DATE '{TODAY}' GROUP BY code), f AS (SELECT code FROM inst WHERE code % 11 = 0)"


@query(f"{BOUND}, {INSTRUMENTS_SQL}, {_PLAN} SELECT u.code, CASE WHEN n >= 60 THEN last END AS since, CASE WHEN n IS NULL THEN 'new' WHEN n < 60 THEN 'short' ELSE 'stale' END AS why FROM u LEFT JOIN h USING (code) WHERE code NOT IN (SELECT code FROM f) AND (n IS NULL OR n < 60 OR last < DATE '{TODAY}')")
def src_13_15_dup_4_fetch_plan(spark, d):
    """Which codes a prefetch or backfill asks for, and from which day: some lack, some are short, some stale, some failed."""
    b = bars_bounded(spark, d).where(f"code % 5 <> 0 and (code % 3 <> 0 or date < date'1998-01-01') and (code % 7 <> 1 or date < date'1992-03-01') and date <= date'{TODAY}'")
    u = instruments(spark, d).select("code")
    failed = u.where("code % 11 = 0").withColumn("failed_on", F.lit("1998-08-01").cast("date")).union(u.where("code % 13 = 0").withColumn("failed_on", F.lit("1998-01-01").cast("date")))
    return P.fetch_plan(u, b, failed, TODAY, 60, 7)


_CACHED = "ca AS (SELECT code, date, close FROM bars WHERE code % 4 = 0 AND date <= DATE '1998-08-01' OR code % 4 <> 0 AND code % 5 <> 0 AND date < DATE '1998-01-01')"
_FETCHED = "fe AS (SELECT code, date, CASE WHEN code % 3 = 0 THEN close * 1.1 ELSE close END AS close FROM bars WHERE date BETWEEN DATE '1997-06-01' AND DATE '1998-08-01' AND code % 7 <> 0)"


@query(f"""{BOUND}, {_CACHED}, {_FETCHED}, l AS (SELECT code, max(date) AS last FROM ca GROUP BY code), g AS (SELECT DISTINCT code, true AS got FROM fe),
m AS (SELECT code, avg(fe.close / ca.close) AS ratio FROM ca JOIN fe USING (code, date) GROUP BY code),
s AS (SELECT code, CASE WHEN DATE '{TODAY}' - last <= 30 THEN 'fresh' WHEN got IS NULL THEN 'stale' WHEN abs(ratio - 1) > 0.01 THEN 'rebased' ELSE 'merged' END AS state FROM l FULL JOIN g USING (code) LEFT JOIN m USING (code)),
o AS (SELECT code, date, close, state, 0 AS o FROM ca JOIN s USING (code) WHERE state <> 'rebased' UNION ALL SELECT code, date, close, state, 1 FROM fe JOIN s USING (code) WHERE state IN ('rebased', 'merged')),
r AS (SELECT code, date, arg_max(close, o) AS close, any_value(state) AS state FROM o GROUP BY ALL)
SELECT code, state, count(*) AS bars, min(date) AS since, max(date) AS last, round(sum(close), 4) AS total FROM r GROUP BY ALL""")
def src_6_read_through(spark, d):
    """Per code, what a reader gets through the cache: some codes are fresh, some can't be fetched, some have a new base."""
    b = bars_bounded(spark, d).select("code", "date", "close")
    cached = b.where("code % 4 = 0 and date <= date'1998-08-01' or code % 4 <> 0 and code % 5 <> 0 and date < date'1998-01-01'")
    fetched = b.where("date between date'1997-06-01' and date'1998-08-01'").withColumn("close", F.when(F.col("code") % 3 == 0, F.col("close") * 1.1).otherwise(F.col("close")))
    failed = instruments(spark, d).select("code").where("code % 7 = 0")
    r = P.read_through(cached, fetched, failed, TODAY, 30)
    return r.groupBy("code", "state").agg(F.count("*").alias("bars"), F.min("date").alias("since"), F.max("date").alias("last"), F.round(F.sum("close"), 4).alias("total"))


@query(f"""WITH {code_ctes("nb", "stocks", "snap_id, name, mktcap, updated")}, p AS (SELECT nc AS code, name, mktcap, snap_id FROM nb WHERE nc IS NOT NULL),
u AS (SELECT code, max(snap_id) AS snap_id, arg_max(mktcap, snap_id) FILTER (mktcap IS NOT NULL) AS mktcap FROM p GROUP BY code),
k AS (SELECT code, left(code, 2) AS exchange, mktcap FROM u), b AS (SELECT list_sort(list(mktcap) FILTER (mktcap IS NOT NULL AND NOT isnan(mktcap))) AS c FROM k)
SELECT code, exchange, mktcap, CASE WHEN mktcap IS NULL OR isnan(mktcap) THEN 'small' WHEN mktcap >= c[2 * len(c) // 3 + 1] THEN 'large' WHEN mktcap >= c[len(c) // 3 + 1] THEN 'mid' ELSE 'small' END AS tier FROM k, b""")
def src_16_universe_refresh(spark, d):
    """Pages of a listing (snapshots, in pages of 500) put together: one row a code with its exchange, its last known
    capital and its tercile."""
    pages = table(spark, d, "stocks").select(normal_code(F.col("code")).alias("code"), "mktcap", "snap_id", F.floor(F.col("snap_id") / 500).alias("page")).where("code is not null")
    one = pages.groupBy("code", "page").agg(F.max_by("mktcap", F.when(F.col("mktcap").isNotNull(), F.col("snap_id"))).alias("mktcap"))
    u = one.groupBy("code").agg(F.max_by("mktcap", F.when(F.col("mktcap").isNotNull(), F.col("page"))).alias("mktcap"))
    from tidemark.sources.views import tercile

    return tercile(u.select("code", F.left("code", F.lit(2)).alias("exchange"), "mktcap"), "mktcap")


@query(f"""{BOUND}, {INSTRUMENTS_SQL}, m AS (SELECT industry, min(code) AS board FROM inst GROUP BY industry), c AS (SELECT code, date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS pct FROM bars)
SELECT m.industry, board, date, round(pct, 8) AS pct FROM m JOIN c ON c.code = m.board WHERE pct IS NOT NULL""")
def src_23_sector_context(spark, d):
    """Per industry, its board's daily change: the industry is looked up, the change lags one row."""
    m = instruments(spark, d).groupBy("industry").agg(F.min("code").alias("board"))
    c = bars_bounded(spark, d).select(F.col("code").alias("board"), "date", F.round(I.change(F.col("close"), 1, I.seq()), 8).alias("pct")).where("pct is not null")
    return c.join(m, "board").select("industry", "board", "date", "pct")


@query(f"""{BOUND}, {INSTRUMENTS_SQL}, o AS (SELECT tier, code, count(*) AS n, max(date) AS last FROM bars JOIN inst USING (code) GROUP BY ALL),
g AS (SELECT tier, string_agg(code::varchar, ',' ORDER BY code::varchar) AS codes, sum(n) AS n, max(last) AS last FROM o GROUP BY tier)
SELECT tier, md5(codes || '|60|' || strftime(last, '%Y-%m-%d') || '|' || n::bigint::varchar || '|4') AS sig, tier = 'mid' AS hit FROM g""")
def src_28_result_cache(spark, d):
    """Per tier, the signature of its inputs, and whether a stored result has the same; only one tier's was stored so."""
    b = bars_bounded(spark, d).join(instruments(spark, d).select("code", "tier"), "code")
    now = P.signature(b, ["tier"], "code", "date", 60, 4)
    stored = P.signature(b.where("tier = 'mid' or date < date'1998-01-01'"), ["tier"], "code", "date", 60, 4).select("sig", F.lit(True).alias("hit"))
    return now.join(stored, "sig", "left").select("tier", "sig", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(f"{BOUND}, {INSTRUMENTS_SQL}, {FACTORS_SQL}, l AS (SELECT code, arg_max(close, date) AS close, count(*) AS n FROM bars GROUP BY code HAVING count(*) >= 60) SELECT code, n, round(mktcap / (close * k), 6) AS shares FROM l JOIN inst USING (code) JOIN fac USING (code)")
def src_30_implied_shares(spark, d):
    """Shares implied by the capital and the last adjusted close, of codes with at least 60 bars."""
    last = bars_bounded(spark, d).groupBy("code").agg(F.max_by("close", "date").alias("close"), F.count("*").alias("n")).where("n >= 60")
    j = last.join(instruments(spark, d).select("code", "mktcap"), "code").join(factors(spark, d), "code")
    return j.select("code", "n", F.round(F.try_divide("mktcap", F.col("close") * F.col("k")), 6).alias("shares"))


@query(f"{BOUND}, {INSTRUMENTS_SQL}, x AS (SELECT date, avg(close) AS idx FROM bars WHERE code % 2 = 0 GROUP BY date), c AS (SELECT code, count(*) AS n, min(date) AS since, max(date) AS last FROM bars GROUP BY code HAVING count(*) >= 40 AND max(date) >= DATE '1998-01-01') SELECT b.code, name, industry, n, b.date, round(close, 8) AS close, round(idx, 8) AS idx FROM bars b JOIN c USING (code) JOIN inst USING (code) LEFT JOIN x ON x.date = b.date")
def src_31_sim_17_panel_load(spark, d):
    """Bars of all codes that are long and late enough, with what is known of the code and the index of the day."""
    b = bars_bounded(spark, d)
    long = b.groupBy("code").agg(F.count("*").alias("n"), F.max("date").alias("last")).where("n >= 40 and last >= date'1998-01-01'")
    idx = b.where(F.col("code") % 2 == 0).groupBy("date").agg(F.avg("close").alias("idx"))
    j = b.join(long.select("code", "n"), "code").join(instruments(spark, d).select("code", "name", "industry"), "code").join(idx, "date", "left")
    return j.select("code", "name", "industry", "n", "date", F.round("close", 8).alias("close"), F.round("idx", 8).alias("idx"))


_TIERS = f"{BOUND}, {INSTRUMENTS_SQL}, t AS (SELECT tier, count(*) AS n, avg(close) AS mean FROM bars JOIN inst USING (code) GROUP BY tier)"


def _tiers(spark, d):
    return bars_bounded(spark, d).join(instruments(spark, d).select("code", "tier"), "code").groupBy("tier").agg(F.count("*").alias("n"), F.avg("close").alias("mean"))


@query(_TIERS + " SELECT 1::bigint AS line_no, '| tier | n | mean |' AS line UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY tier) + 2, '| ' || tier || ' | ' || n || ' | ' || printf('%.4f', mean) || ' |' FROM t")
def snk_3_markdown_report(spark, d):
    return P.report_lines(_tiers(spark, d), ["tier"])


@query(_TIERS + " SELECT 1::bigint AS line_no, 'tier  n  mean' AS line UNION ALL SELECT 2, '-------------' UNION ALL SELECT row_number() OVER (ORDER BY tier) + 2, tier || '  ' || n || '  ' || printf('%.4f', mean) FROM t")
def snk_4_text_report(spark, d):
    return P.report_lines(_tiers(spark, d), ["tier"], markdown=False)


@query("SELECT *, CASE WHEN ts IS NULL OR age > 4 * 86400 THEN 'fail' WHEN age > 86400 THEN 'refresh' ELSE 'keep' END AS todo FROM (SELECT user_id AS name, max(ts) AS ts, epoch(date_trunc('second', (SELECT max(ts) FROM events)))::bigint - epoch(date_trunc('second', max(ts)))::bigint AS age FROM events GROUP BY user_id)")
def lkp_2_freshness(spark, d):
    """Per source of events, the age of its newest and what to do."""
    e = table(spark, d, "events")
    stamps = e.groupBy(F.col("user_id").alias("name")).agg(F.max("ts").alias("ts"))
    return P.freshness(stamps, e.agg(F.max("ts")).scalar(), 86400.0)


_RULES = "pr(preset, rule, value) AS (VALUES ('balanced', 'buy', 2.0), ('balanced', 'stop', 1.5), ('aggressive', 'buy', 1.0), ('aggressive', 'stop', 2.5), ('conservative', 'buy', 3.0), ('conservative', 'stop', 1.5))"


@query(f"WITH {INSTRUMENTS_SQL}, {_RULES} SELECT code, preset, rule, CASE WHEN tier = 'large' AND rule = 'stop' THEN 9.0::double WHEN code % 10 = 0 AND rule = 'buy' THEN 5.0::double ELSE value::double END AS value FROM inst JOIN pr ON pr.preset = CASE tier WHEN 'small' THEN 'aggressive' WHEN 'odd' THEN 'conservative' ELSE 'balanced' END")
def lkp_4_udf_5_rules_in_force(spark, d):
    """The rules in force per code: its tier's preset (balanced where that is none), with overrides per tier and code."""
    from tidemark.operators.signals import PRESETS

    rules = spark.createDataFrame([(n, k, float(v)) for n, r in PRESETS.items() for k, v in (("buy", r.buy_th), ("stop", r.atr_mult))], "preset string, rule string, value double")
    inst = instruments(spark, d).select("code", "tier", F.when(F.col("tier") == "small", "aggressive").otherwise("balanced").alias("preset"))
    own = spark.createDataFrame([("large", "stop", 9.0)], "tier string, rule string, by_tier double")
    j = inst.join(F.broadcast(rules), "preset").join(F.broadcast(own), ["tier", "rule"], "left")
    by_code = F.when((F.col("code") % 10 == 0) & (F.col("rule") == "buy"), 5.0)
    return j.select("code", "preset", "rule", F.coalesce("by_tier", by_code, "value").alias("value"))


@query(f"WITH {code_ctes('nb', 'daily_bars', 'bar_id')} SELECT DISTINCT nc AS code, CASE left(nc, 2) WHEN 'sh' THEN '0' ELSE '1' END || right(nc, 6) AS plain, CASE left(nc, 2) WHEN 'sh' THEN '1.' ELSE '0.' END || right(nc, 6) AS dotted FROM nb WHERE nc IS NOT NULL")
def dup_5_vendor_symbols(spark, d):
    """Codes in the forms two vendors use: 0 or 1 before the digits, and 1. or 0."""
    c = table(spark, d, "daily_bars").select(normal_code(F.col("code")).alias("code")).where("code is not null").distinct()
    sh, digits = F.left("code", F.lit(2)) == "sh", F.right("code", F.lit(6))
    return c.select("code", F.concat(F.when(sh, "0").otherwise("1"), digits).alias("plain"), F.concat(F.when(sh, "1.").otherwise("0."), digits).alias("dotted"))


_YEAR = "CAST(year(date) AS INT)"


@query(f"""{BOUND}, i AS (SELECT date, avg(close) AS v FROM bars GROUP BY date), b AS (SELECT *, lag(v) OVER (ORDER BY date) AS before FROM i),
s AS (SELECT {_YEAR} AS y, coalesce(arg_min(before, date), arg_min(v, date)) AS base, arg_max(v, date) AS v, count(*) AS days FROM b GROUP BY y),
p AS (SELECT {_YEAR} AS y, date, v / max(greatest(v, base)) OVER (PARTITION BY {_YEAR} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT b.date, b.v, s.base FROM b JOIN s ON s.y = {_YEAR}))
SELECT s.y AS year, days, round(v / base - 1, 6) AS total, round(pow(v / base, 252.0 / days) - 1, 6) AS ann, round(min(dd), 6) AS mdd FROM s JOIN p ON p.y = s.y GROUP BY ALL""")
def bt_22_23_calendar_segments(spark, d):
    """Every year of one continuous curve, its base the value before the year: return, a year's rate, deepest fall."""
    y = F.year("date")
    i = bars_bounded(spark, d).groupBy("date").agg(F.avg("close").alias("v"))
    b = i.withColumn("before", F.lag("v").over(W.orderBy("date"))).withColumn("year", y)  # one row a day
    s = b.groupBy("year").agg(F.coalesce(F.min_by("before", "date"), F.min_by("v", "date")).alias("base"), F.max_by("v", "date").alias("z"), F.count("*").alias("days"))
    w = W.partitionBy("year").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    fall = b.join(s, "year").withColumn("dd", F.col("v") / F.max(F.greatest("v", "base")).over(w) - 1).groupBy("year").agg(F.min("dd").alias("mdd"))
    return s.join(fall, "year").select("year", "days", F.round(F.col("z") / F.col("base") - 1, 6).alias("total"), F.round(F.pow(F.col("z") / F.col("base"), 252.0 / F.col("days")) - 1, 6).alias("ann"), F.round("mdd", 6).alias("mdd"))
