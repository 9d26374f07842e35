"""Scalar rules on codes, bars and clocks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters 3 and 4 of exchange-traded funds' codes, and the boards told by them.
ETF = ("51", "56", "58", "15", "16", "18")
INDEX = "^(sh000|sz399|bj899)"
MONEY_WORDS = "货币|现金|添益|保证金|money"
MONEY_PREFIXES = ("sh5116", "sh5117", "sh5118", "sh5119", "sz1590")


def is_etf(code: Column) -> Column:
    return F.substring(code, 3, 2).isin(*ETF)


def is_etf_or_index(code: Column) -> Column:
    return is_etf(code) | code.rlike(INDEX)


def is_money_etf(code: Column, name: Column) -> Column:
    """By a word in the name or by the prefix of the code, exchange included; a null name has no word."""
    return F.coalesce(F.lower(name).rlike(MONEY_WORDS), F.lit(False)) | F.substring(code, 1, 6).isin(*MONEY_PREFIXES)


def board(code: Column) -> Column:
    return F.when(code.startswith("bj"), "bse").when(is_etf(code), "etf").when(F.substring(code, 3, 2) == "68", "star").when(code.startswith("sz30"), "chinext").when(code.rlike("^(sh60|sz00)"), "main").otherwise("other")


def universe(code: Column, which: str) -> Column:
    """Membership in all, main, chinext, etf or all_etf."""
    stock = code.rlike("^(sh60|sh68|sz00|sz30)")
    return {"all": stock, "main": board(code) == "main", "chinext": code.startswith("sz30"), "etf": is_etf(code), "all_etf": stock | is_etf(code)}[which]


def limit_pct(code: Column, date: Column, special: Column) -> Column:
    """Daily limit in percent as of the date; null before limits began. special: the stock is under special treatment."""
    two = F.substring(code, 3, 2)
    return (
        F.when(date < F.lit("1996-12-16").cast("date"), None)
        .when(code.startswith("bj"), 30)
        .when(two == "68", 20)
        .when(two == "30", F.when(date >= F.lit("2020-08-24").cast("date"), 20).otherwise(10))
        .when(special & (date < F.lit("2026-07-06").cast("date")), 5)
        .otherwise(10)
        .cast("int")
    )


def limit_simple(code: Column) -> Column:
    return F.when(code.rlike("^(sz30|sh68)"), 0.20).otherwise(0.10)


def bar_ok(o: Column, h: Column, low: Column, c: Column) -> Column:
    """All prices given and above zero, high not below low; null prices make it false."""
    return F.coalesce((o > 0) & (h > 0) & (low > 0) & (c > 0) & (h >= low), F.lit(False))


def bar_strict(o: Column, h: Column, low: Column, c: Column) -> Column:
    return bar_ok(o, h, low, c) & F.coalesce((h >= F.greatest(o, c)) & (low <= F.least(o, c)), F.lit(False))


def vol_regime(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "?").when(ratio > 1.2, "expand").when(ratio < 0.8, "shrink").otherwise("flat")


def amount_text(x: Column) -> Column:
    """Scaled by 1e8 or 1e4 with two decimals; small numbers without decimals."""
    a = F.abs(x)
    return F.when(x.isNull(), "-").when(a >= 1e8, F.concat(F.format_string("%.2f", x / 1e8), F.lit("亿"))).when(a >= 1e4, F.concat(F.format_string("%.2f", x / 1e4), F.lit("万"))).otherwise(F.format_string("%.0f", x))


def market_phase(hhmm: Column) -> Column:
    """Phase of the trading day for a time as a number HHMM."""
    return F.when(hhmm < 915, "pre-open").when(hhmm < 930, "auction").when(hhmm <= 1130, "trading").when(hhmm < 1300, "lunch").when(hhmm < 1500, "trading").otherwise("closed")


def previous_weekday(date: Column) -> Column:
    back = F.when(F.dayofweek(date) == 2, 3).when(F.dayofweek(date) == 1, 2).otherwise(1)
    return F.date_sub(date, back)


def last_completed(ts: Column) -> Column:
    """The last trading day (weekends skipped) whose data is complete at ts: that day from 15:05 on, else the weekday before."""
    day, hm = F.to_date(ts), F.hour(ts) * 100 + F.minute(ts)
    weekend = F.dayofweek(day).isin(1, 7)
    return F.when(~weekend & (hm >= 1505), day).otherwise(previous_weekday(day))


def decay_weight(age_days: Column) -> Column:
    return F.when(age_days <= 90, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (age_days - 90) / 365 * 0.5))


def fee(amount: Column, selling: Column, rate: float = 2.5e-4, least: float = 5.0, transfer: float = 1e-5, stamp: float = 5e-4) -> Column:
    """Commission with a least amount, transfer fee, and stamp duty when selling; two decimals."""
    return F.round(F.greatest(amount * rate, F.lit(least)) + amount * transfer + F.when(selling, amount * stamp).otherwise(0), 2)


def candle(o: Column, h: Column, low: Column, c: Column) -> list[Column]:
    """body, upper, lower shadow over the range, and the close's place in it; (0, 0, 0, 0.5) without a range."""
    r = h - low
    flat = r <= 1e-9
    pick = lambda x, v: F.when(flat, v).otherwise(x / F.when(~flat, r))
    return [pick(c - o, 0.0), pick(h - F.greatest(o, c), 0.0), pick(F.least(o, c) - low, 0.0), pick(c - low, 0.5)]
