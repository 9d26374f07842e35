"""Queries for scalar functions and predicates (SCL), and for the relational statements (SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import market as M
from tidemark.functions.text import normal_code, readable_day
from tidemark.operators import windows as I
from tidemark.plans.declare import declare
from tidemark.plans.problems_sql import code_ctes, day_of
from tidemark.sources.tables import table
from tidemark.sources.views import BOUNDED_SQL, FACTORS_SQL, INDEX_SQL, INSTRUMENTS_SQL, RAW_SQL, bars_bounded, bars_raw, factors, index_close, instruments

QUERIES, SQL, query = declare()
BARS, BOUNDED = f"WITH {RAW_SQL}", f"WITH {BOUNDED_SQL}"
NC = f"WITH {code_ctes('n', 'stocks', 'snap_id, name, updated, industry, mktcap')}, s AS (SELECT snap_id, nc AS code, name, industry, mktcap, {day_of('updated')} AS day FROM n WHERE nc IS NOT NULL)"


def stock_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stocks").select("snap_id", normal_code(F.col("code")).alias("code"), "name", "industry", "mktcap", readable_day(F.col("updated")).alias("day")).where("code is not null")


def distinct_codes(spark: SparkSession, d: str) -> DataFrame:
    return stock_codes(spark, d).select("code").distinct()


@query(f"WITH {code_ctes('n', 'daily_bars', 'bar_id')} SELECT raw_code, min(nc) AS code, count(*) AS n FROM n WHERE raw_code IS NOT NULL GROUP BY raw_code")
def scl_1_normalize_code(spark, d):
    t = table(spark, d, "daily_bars").where("code is not null").groupBy("code").agg(F.count("*").alias("n"))
    return t.select(F.col("code").alias("raw_code"), normal_code(F.col("code")).alias("code"), "n")


@query("SELECT coalesce(regexp_full_match(code, '(sh|sz|bj)[0-9]{6}'), false) AS valid, count(*) AS n FROM daily_bars GROUP BY 1")
def scl_2_valid_code(spark, d):
    return table(spark, d, "daily_bars").groupBy(F.coalesce(F.col("code").rlike("^(sh|sz|bj)[0-9]{6}$"), F.lit(False)).alias("valid")).agg(F.count("*").alias("n"))


_ETF = "substr(code, 3, 2) IN ('51', '56', '58', '15', '16', '18')"


@query(NC + f" SELECT DISTINCT code, {_ETF} AS etf, {_ETF} OR regexp_matches(code, '^(sh000|sz399|bj899)') AS etf_or_index FROM s")
def scl_3_5_etf_or_index(spark, d):
    c = F.col("code")
    return distinct_codes(spark, d).select("code", M.is_etf(c).alias("etf"), M.is_etf_or_index(c).alias("etf_or_index"))


@query(NC + " SELECT snap_id, coalesce(regexp_matches(lower(name), '货币|现金|添益|保证金|money'), false) OR substr(code, 1, 6) IN ('sh5116', 'sh5117', 'sh5118', 'sh5119', 'sz1590') AS money FROM s")
def scl_4_money_etf(spark, d):
    return stock_codes(spark, d).select("snap_id", M.is_money_etf(F.col("code"), F.col("name")).alias("money"))


_BOARD = f"CASE WHEN code LIKE 'bj%' THEN 'bse' WHEN {_ETF} THEN 'etf' WHEN substr(code, 3, 2) = '68' THEN 'star' WHEN code LIKE 'sz30%' THEN 'chinext' WHEN regexp_matches(code, '^(sh60|sz00)') THEN 'main' ELSE 'other' END"


@query(NC + f" SELECT DISTINCT code, {_BOARD} AS board, {_BOARD} IN ('main', 'chinext') AS allowed FROM s")
def scl_6_board_permission(spark, d):
    b = M.board(F.col("code"))
    return distinct_codes(spark, d).select("code", b.alias("board"), b.isin("main", "chinext").alias("allowed"))


@query(NC + f" SELECT DISTINCT code, regexp_matches(code, '^(sh60|sh68|sz00|sz30)') AS in_all, {_BOARD} = 'main' AS in_main, code LIKE 'sz30%' AS in_chinext, {_ETF} AS in_etf, regexp_matches(code, '^(sh60|sh68|sz00|sz30)') OR {_ETF} AS in_all_etf FROM s")
def scl_7_universe(spark, d):
    return distinct_codes(spark, d).select("code", *[M.universe(F.col("code"), u).alias(f"in_{u}") for u in ("all", "main", "chinext", "etf", "all_etf")])


@query(NC + " SELECT snap_id, CASE WHEN day < DATE '1996-12-16' THEN NULL WHEN code LIKE 'bj%' THEN 30 WHEN substr(code, 3, 2) = '68' THEN 20 WHEN substr(code, 3, 2) = '30' THEN CASE WHEN day >= DATE '2020-08-24' THEN 20 ELSE 10 END WHEN coalesce(name LIKE '%ST%', false) AND day < DATE '2026-07-06' THEN 5 ELSE 10 END::INTEGER AS lim, CASE WHEN regexp_matches(code, '^(sz30|sh68)') THEN 0.2 ELSE 0.1 END::DOUBLE AS lim_simple FROM s")
def scl_8_9_limit_pct(spark, d):
    return stock_codes(spark, d).select("snap_id", M.limit_pct(F.col("code"), F.col("day"), F.coalesce(F.col("name").like("%ST%"), F.lit(False))).alias("lim"), M.limit_simple(F.col("code")).alias("lim_simple"))


_FIN = "(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low)"


@query(f"SELECT coalesce({_FIN}, false) AS ok, coalesce({_FIN} AND high >= greatest(open, close) AND low <= least(open, close), false) AS strict, count(*) AS n FROM daily_bars GROUP BY 1, 2")
def scl_10_11_bar_valid(spark, d):
    o = [F.col(c) for c in ("open", "high", "low", "close")]
    return table(spark, d, "daily_bars").groupBy(M.bar_ok(*o).alias("ok"), M.bar_strict(*o).alias("strict")).agg(F.count("*").alias("n"))


@query(f"""{BOUNDED}, r AS (SELECT code, date, abs(close / lag(close) OVER w - 1) * 100 > 13 AS b, lag(close) OVER w AS p FROM bounded WINDOW w AS (PARTITION BY code ORDER BY date)),
x AS (SELECT code, coalesce(b, false) AS b, coalesce(b AND lag(b) OVER (PARTITION BY code ORDER BY date), false) AS two, count(*) OVER (PARTITION BY code) AS n FROM r)
SELECT code, max(n) >= 30 AND bool_or(b) AS anomalous_stock, max(n) >= 30 AND bool_or(two) AS anomalous_etf FROM x GROUP BY code""")
def scl_12_anomalous_series(spark, d):
    """At least 30 bars and a return beyond the limit plus 3 points: any for a stock, two in a row for a fund."""
    w = I.seq()
    x = bars_bounded(spark, d).withColumn("b", F.coalesce(F.abs(F.col("close") / F.lag("close").over(w) - 1) * 100 > 13, F.lit(False))).withColumn("two", F.col("b") & F.coalesce(F.lag("b").over(w), F.lit(False)))
    n = F.count("*") >= 30
    return x.groupBy("code").agg((n & F.bool_or("b")).alias("anomalous_stock"), (n & F.bool_or("two")).alias("anomalous_etf"))


_VR = "CASE WHEN row_number() OVER w >= 20 AND avg(vol) OVER (w ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) > 0 THEN avg(vol) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(vol) OVER (w ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) END"


@query(f"{BARS}, v AS (SELECT code, date, {_VR} AS vr FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) SELECT code, date, round(vr + 1e-9, 4) AS vr, CASE WHEN vr IS NULL THEN '?' WHEN vr > 1.2 THEN 'expand' WHEN vr < 0.8 THEN 'shrink' ELSE 'flat' END AS regime FROM v")
def scl_13_14_volume_regime(spark, d):
    v = bars_raw(spark, d).select("code", "date", I.volume_ratio(I.seq()).alias("vr"))
    return v.select("code", "date", F.round(F.col("vr") + 1e-9, 4).alias("vr"), M.vol_regime(F.col("vr")).alias("regime"))


@query("SELECT o_orderkey AS k, CASE WHEN abs(x) >= 1e8 THEN printf('%.2f', x / 1e8) || '亿' WHEN abs(x) >= 1e4 THEN printf('%.2f', x / 1e4) || '万' ELSE printf('%.0f', x) END AS txt FROM (SELECT o_orderkey, floor(o_totalprice) * 4 AS x FROM orders)")
def scl_15_amount_text(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), M.amount_text(F.floor("o_totalprice").cast("double") * 4).alias("txt"))


_HM = "(hour(ts) * 100 + minute(ts))"


@query(f"SELECT event_id, CASE WHEN {_HM} < 915 THEN 'pre-open' WHEN {_HM} < 930 THEN 'auction' WHEN {_HM} <= 1130 THEN 'trading' WHEN {_HM} < 1300 THEN 'lunch' WHEN {_HM} < 1500 THEN 'trading' ELSE 'closed' END AS phase FROM events")
def scl_16_market_phase(spark, d):
    return table(spark, d, "events").select("event_id", M.market_phase(F.hour("ts") * 100 + F.minute("ts")).alias("phase"))


_PW = "CASE WHEN dayofweek(x) = 1 THEN x - 3 WHEN dayofweek(x) = 0 THEN x - 2 ELSE x - 1 END"


@query(f"SELECT event_id, {_PW} AS prev_weekday, CASE WHEN dayofweek(x) NOT IN (0, 6) AND {_HM} >= 1505 THEN x ELSE {_PW} END AS completed FROM (SELECT event_id, ts, CAST(ts AS DATE) AS x FROM events)")
def scl_17_weekdays(spark, d):
    return table(spark, d, "events").select("event_id", M.previous_weekday(F.to_date("ts")).alias("prev_weekday"), M.last_completed(F.col("ts")).alias("completed"))


@query(f"""{BOUNDED}, r AS (SELECT code, date, ln(close / lag(close) OVER (PARTITION BY code ORDER BY date)) AS r FROM bounded),
m AS (SELECT code, median(r) AS med FROM r GROUP BY code), a AS (SELECT r.code, median(abs(r - med)) AS mad FROM r JOIN m USING (code) GROUP BY r.code)
SELECT r.code, date, round(r, 6) AS r, round(least(greatest(r, med - 5 * CASE WHEN mad = 0 THEN 0.1 ELSE mad END), med + 5 * CASE WHEN mad = 0 THEN 0.1 ELSE mad END), 6) AS clamped FROM r JOIN m USING (code) JOIN a USING (code) WHERE r IS NOT NULL""")
def scl_18_clamped_log_return(spark, d):
    r = bars_bounded(spark, d).select("code", "date", I.log_return(I.seq()).alias("r")).where("r is not null")
    m = r.groupBy("code").agg(F.median("r").alias("med"))
    j = r.join(m, "code")
    a = j.groupBy("code").agg(F.median(F.abs(F.col("r") - F.col("med"))).alias("mad"))
    reach = 5 * F.when(F.col("mad") == 0, 0.1).otherwise(F.col("mad"))
    return j.join(a, "code").select("code", "date", F.round("r", 6).alias("r"), F.round(F.least(F.greatest(F.col("r"), F.col("med") - reach), F.col("med") + reach), 6).alias("clamped"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), z AS (SELECT vec_id, v, list_avg(v) AS m, list_stddev_pop(v) AS s FROM e)
SELECT vec_id, round((v[1] - m) / greatest(s, 1e-12), 5) AS z1, round((v[2] - m) / greatest(s, 1e-12), 5) AS z2, len(v) AS n FROM z""")
def scl_19_znorm(spark, d):
    from tidemark.operators.similarity import znorm

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("z", znorm(F.col("v")))
    return e.select("vec_id", F.round(F.col("z")[0], 5).alias("z1"), F.round(F.col("z")[1], 5).alias("z2"), F.size("v").cast("long").alias("n"))


@query(f"{BARS} SELECT code, date, " + ", ".join(f"round(CASE WHEN high - low <= 1e-9 THEN {z} ELSE ({x}) / nullif(high - low, 0) END, 4) AS {n}" for n, x, z in (("body", "close - open", "0.0"), ("upper", "high - greatest(open, close)", "0.0"), ("lower", "least(open, close) - low", "0.0"), ("place", "close - low", "0.5"))) + " FROM bars")
def scl_20_candle(spark, d):
    o = [F.col(c) for c in ("open", "high", "low", "close")]
    return bars_raw(spark, d).select("code", "date", *[F.round(x, 4).alias(n) for n, x in zip(("body", "upper", "lower", "place"), M.candle(*o))])


@query(f"""{BARS}, v AS (SELECT code, date, row_number() OVER w AS i, avg(vol) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, avg(vol) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS b,
 lag(close, 0) OVER w / lag(close, 4) OVER w - 1 AS w0, lag(close, 5) OVER w / lag(close, 9) OVER w - 1 AS w1 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, round(CASE WHEN i >= 10 AND a > 0 AND b > 0 THEN ln(a / b) END, 4) AS volchg, round(w0, 4) AS week0, round(w1, 4) AS week1 FROM v""")
def scl_21_22_volume_change_weekly(spark, d):
    w = I.seq()
    a, b = F.avg("vol").over(I.frame(w, 5)), F.avg("vol").over(I.frame(w, 5, 5))
    week = lambda k: F.lag("close", 5 * k).over(w) / F.lag("close", 5 * k + 4).over(w) - 1
    return bars_raw(spark, d).select("code", "date", F.round(F.when((F.row_number().over(w) >= 10) & (a > 0) & (b > 0), F.ln(a / b)), 4).alias("volchg"), F.round(week(0), 4).alias("week0"), F.round(week(1), 4).alias("week1"))


@query(f"""{BOUNDED}, x AS (SELECT code, date, close, close - lag(close) OVER w AS dc, ln(close / lag(close) OVER w) AS r FROM bounded WINDOW w AS (PARTITION BY code ORDER BY date)),
y AS (SELECT code, date, row_number() OVER w AS i, sum(greatest(dc, 0)) OVER (w ROWS 13 PRECEDING) AS up, sum(greatest(-dc, 0)) OVER (w ROWS 13 PRECEDING) AS dn, CASE WHEN count(r) OVER (w ROWS 9 PRECEDING) >= 10 THEN stddev_pop(r) OVER (w ROWS 9 PRECEDING) END AS sd, lead(close, 5) OVER w / close - 1 AS f FROM x WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, round(CASE WHEN i <= 14 OR (up < 1e-9 AND dn < 1e-9) THEN NULL WHEN dn < 1e-9 THEN 100 ELSE 100 * up / (up + dn) END, 3) AS rsi14, round(sd, 5) AS vola10, round(f * 100, 4) AS fwd5 FROM y""")
def scl_23_24_25_rsi_vola_forward(spark, d):
    w = I.seq()
    x = bars_bounded(spark, d).withColumn("r", I.log_return(w)).withColumn("_d", F.col("close") - F.lag("close").over(w))
    up, dn = F.sum(F.greatest("_d", F.lit(0.0))).over(I.frame(w, 14)), F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(I.frame(w, 14))
    rsi = F.when(F.row_number().over(w) > 14, F.when((up < 1e-9) & (dn < 1e-9), None).when(dn < 1e-9, 100.0).otherwise(100 * up / (up + dn)))
    return x.select("code", "date", F.round(rsi, 3).alias("rsi14"), F.round(I.roll(F.stddev_pop, F.col("r"), 10, w), 5).alias("vola10"), F.round((F.lead("close", 5).over(w) / F.col("close") - 1) * 100, 4).alias("fwd5"))


@query("SELECT o_orderkey AS k, round(greatest(o_totalprice * 0.00025, 5) + o_totalprice * 0.00001 + CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 0.0005 ELSE 0 END, 2) AS fee FROM orders")
def scl_26_fee(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), M.fee(F.col("o_totalprice"), F.col("o_orderstatus") == "O").alias("fee"))


@query("SELECT o_orderkey AS k, round(CASE WHEN a <= 90 THEN 1.0::DOUBLE ELSE greatest(0.3::DOUBLE, 1 - (a - 90)::DOUBLE / 365 * 0.5) END, 6) AS w FROM (SELECT o_orderkey, DATE '1998-12-31' - CAST(o_orderdate AS DATE) AS a FROM orders)")
def scl_27_decay_weight(spark, d):
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.round(M.decay_weight(age), 6).alias("w"))


@query(f"{BOUNDED}, bars AS (SELECT * FROM bounded), {INDEX_SQL}, r AS (SELECT date, (idx / lag(idx) OVER (ORDER BY date) - 1) * 100 AS p FROM idx) SELECT b.code, count(*) AS n, count(*) FILTER (WHERE p < -1.5) AS weak FROM bounded b LEFT JOIN r USING (date) GROUP BY b.code")
def scl_28_weak_market_day(spark, d):
    b = bars_bounded(spark, d)
    r = index_close(b).select("date", ((F.col("idx") / F.lag("idx").over(W.orderBy("date")) - 1) * 100).alias("p"))  # one row a day
    return b.join(r, "date", "left").groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("p") < -1.5).alias("weak"))


@query(f"""WITH {INSTRUMENTS_SQL}, f AS (SELECT DISTINCT code, lower(regexp_replace(name, '[^A-Za-z]', '', 'g')) AS short FROM inst), i AS (SELECT DISTINCT lower(regexp_replace(industry, '[^A-Za-z]', '', 'g')) AS ind FROM inst)
SELECT p_partkey AS part, arg_max(w, (length(w), w)) AS industry FROM part, (SELECT unnest(['economy', 'small', 'promo', 'standard', 'eco']) AS w) x WHERE contains(regexp_replace(lower(p_type), '[^a-z]', '', 'g'), w) AND length(w) >= 2 GROUP BY p_partkey""")
def scl_29_name_match(spark, d):
    """The longest of a fixed list of words that the normalised name holds, by exploding the list beside each row."""
    words = ("economy", "small", "promo", "standard", "eco")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.regexp_replace(F.lower("p_type"), "[^a-z]", "").alias("t"))
    held = F.filter(F.array(*[F.lit(x) for x in words]), lambda x: F.col("t").contains(x))
    best = F.array_max(F.transform(held, lambda x: F.struct(F.length(x).alias("l"), x.alias("w"))))
    return p.select("part", best["w"].alias("industry")).where("industry is not null")


@query("SELECT p_partkey AS k, p_name AS name FROM part WHERE contains(lower(p_name), 're') ORDER BY starts_with(lower(p_name), 're') DESC, p_partkey LIMIT 12")
def scl_30_autocomplete(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    low = F.lower("name")
    return p.where(low.contains("re")).orderBy(low.startswith("re").desc(), "k").limit(12)


@query("SELECT p_partkey AS k, md5(p_name || '|' || p_brand) AS h FROM part")
def scl_31_prompt_hash(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.md5(F.concat_ws("|", "p_name", "p_brand")).alias("h"))


# ---- statements ------------------------------------------------------------------------------------------------


@query(f"{BARS} SELECT date, open, high, low, close, coalesce(vol, 0) AS vol FROM bars WHERE code = 3")
def sql_1_src_3_single_key_scan(spark, d):
    return bars_raw(spark, d).where("code = 3").fillna(0, ["vol"]).select("date", "open", "high", "low", "close", "vol").orderBy("date")


@query(f"{BARS} SELECT count(*) AS n FROM bars WHERE code = 3")
def sql_2_qa_3_bar_count(spark, d):
    return bars_raw(spark, d).where("code = 3").agg(F.count("*").alias("n"))


@query(f"{BARS} SELECT code, date, close FROM bars WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def sql_3_src_4_multi_key_scan(spark, d):
    keys = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("code"))
    return bars_raw(spark, d).join(keys, "code", "left_semi").select("code", "date", "close")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low, false)) AS dropped FROM daily_bars")
def sql_4_5_qa_2_sanitize(spark, d):
    ok = M.bar_ok(*[F.col(c) for c in ("open", "high", "low", "close")])
    return table(spark, d, "daily_bars").agg(F.count("*").alias("n"), F.count_if(~ok).alias("dropped"))


@query(f"{BARS} SELECT code, count(*) AS n, max(date) AS last FROM bars GROUP BY code")
def sql_6_agg_1_count_max(spark, d):
    return bars_raw(spark, d).groupBy("code").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@query(NC + " SELECT DISTINCT code FROM s WHERE code NOT LIKE 'bj%'")
def sql_7_not_like(spark, d):
    return distinct_codes(spark, d).where(~F.col("code").startswith("bj")).orderBy("code")


@query("SELECT count(*) AS n FROM adjust WHERE ts > 1700000000")
def sql_8_ts_filter(spark, d):
    return table(spark, d, "adjust").where("ts > 1700000000").agg(F.count("*").alias("n"))


@query(NC + " SELECT snap_id FROM s WHERE substr(code, 3, 2) IN ('60', '68', '00', '30')")
def sql_9_prefix_delete(spark, d):
    return stock_codes(spark, d).where(F.substring("code", 3, 2).isin("60", "68", "00", "30")).select("snap_id")


@query(f"WITH {INSTRUMENTS_SQL} SELECT code, industry FROM inst WHERE industry = 'NATION_3' AND code <> 5 AND CAST(code AS VARCHAR) NOT LIKE '9%'")
def sql_10_industry_filter(spark, d):
    return instruments(spark, d).where("industry = 'NATION_3' and code != 5 and cast(code as string) not like '9%'").select("code", "industry")


@query(f"{BARS}, {INSTRUMENTS_SQL} SELECT code, tier FROM inst WHERE tier = 'mid' AND code IN (SELECT DISTINCT code FROM bars)")
def sql_11_tier_filter_distinct(spark, d):
    seen = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("code")).distinct()
    return instruments(spark, d).where("tier = 'mid'").join(seen, "code", "left_semi").select("code", "tier")


@query(f"{BARS} SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 250")
def sql_12_latest_dates(spark, d):
    return bars_raw(spark, d).select("date").distinct().orderBy(F.desc("date")).limit(250)


@query(f"{BARS} SELECT code, date, close FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'")
def sql_13_date_range(spark, d):
    return bars_raw(spark, d).where("date between date'1995-01-01' and date'1995-03-31'").select("code", "date", "close")


@query(f"{BARS}, m AS (SELECT max(date) - 10 AS since FROM bars) SELECT code, count(*) AS n, max(date) AS last FROM bars GROUP BY code HAVING count(*) >= 250 AND max(date) >= (SELECT since FROM m)")
def sql_14_having_scalar(spark, d):
    b = bars_raw(spark, d)
    last = b.agg(F.max("date")).first()[0]
    return b.groupBy("code").agg(F.count("*").alias("n"), F.max("date").alias("last")).where((F.col("n") >= 250) & (F.col("last") >= F.date_sub(F.lit(last).cast("date"), 10)))


@query(f"{BARS} SELECT code, date, rn FROM (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 40")
def sql_15_latest_per_code(spark, d):
    return bars_raw(spark, d).select("code", "date", F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))).cast("long").alias("rn")).where("rn <= 40")


@query(NC + " SELECT code, count(*) AS n FROM s GROUP BY code HAVING count(*) >= 3 AND regexp_matches(code, '^(sh6|sz0|sz3)')")
def sql_16_having_prefix(spark, d):
    return stock_codes(spark, d).where(F.col("code").rlike("^(sh6|sz0|sz3)")).groupBy("code").agg(F.count("*").alias("n")).where("n >= 3")


@query(f"{BARS}, r AS (SELECT date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM bars) SELECT date, count(r) AS n, round(avg(r), 6) AS ret FROM r GROUP BY date HAVING count(r) > 0")
def sql_17_market_return(spark, d):
    r = bars_raw(spark, d).select("date", I.change(F.col("close"), 1, I.seq()).alias("r"))
    return r.groupBy("date").agg(F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("ret")).where("n > 0")


@query(f"{BARS} SELECT count(*) AS n, max(date) AS last, count(DISTINCT code) AS codes FROM bars")
def sql_18_26_fingerprint(spark, d):
    return bars_raw(spark, d).agg(F.count("*").alias("n"), F.max("date").alias("last"), F.countDistinct("code").alias("codes"))


@query(f"{BARS} SELECT date, close FROM bars WHERE code = 7 ORDER BY date DESC LIMIT 90")
def sql_19_22_tail_limit(spark, d):
    return bars_raw(spark, d).where("code = 7").orderBy(F.desc("date")).limit(90).select("date", "close").orderBy("date")


@query(f"{BARS} SELECT code, date, CASE WHEN date = max(date) OVER (PARTITION BY code) THEN close * 2 ELSE close END AS close FROM bars")
def sql_20_update_last(spark, d):
    last = F.max("date").over(W.partitionBy("code"))
    return bars_raw(spark, d).select("code", "date", F.when(F.col("date") == last, F.col("close") * 2).otherwise(F.col("close")).alias("close"))


@query(f"{BARS} SELECT code, count(*) AS n, max(date) AS last FROM (SELECT *, max(date) OVER (PARTITION BY code) AS m FROM bars) WHERE date < m GROUP BY code")
def sql_21_delete_last(spark, d):
    b = bars_raw(spark, d).withColumn("m", F.max("date").over(W.partitionBy("code"))).where("date < m")
    return b.groupBy("code").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@query(f"WITH {INSTRUMENTS_SQL} SELECT DISTINCT industry FROM inst")
def sql_23_distinct_industry(spark, d):
    return instruments(spark, d).select("industry").distinct().orderBy("industry")


@query(f"{BARS} SELECT code, c FROM (SELECT code, count(*) AS c FROM bars GROUP BY code) WHERE c >= 500 AND c <= 560")
def sql_24_having_alias(spark, d):
    return bars_raw(spark, d).groupBy("code").agg(F.count("*").alias("c")).where("c >= 500 and c <= 560")


@query("SELECT key, val FROM (SELECT user_id AS key, value AS val, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def sql_25_snk_1_upsert(spark, d):
    """Latest value wins per key, without sorting a key's rows."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("val"))


@query(f"{BARS}, {FACTORS_SQL} SELECT code, date, round(close * k, 6) AS close, rn FROM (SELECT b.code, date, close, coalesce(k, 1.0) AS k, row_number() OVER (PARTITION BY b.code ORDER BY date DESC) AS rn FROM bars b LEFT JOIN fac USING (code)) WHERE rn <= 30")
def src_5_jn_2_adjusted_tail(spark, d):
    b = bars_raw(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))).cast("long")).where("rn <= 30")
    return b.join(factors(spark, d), "code", "left").select("code", "date", F.round(F.col("close") * F.coalesce("k", F.lit(1.0)), 6).alias("close"), "rn")
