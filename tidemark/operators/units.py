"""Quantities recorded in different units.

Conversions are edges of a small graph; the shortest compositions to a canonical unit are computed once and joined on
the unit. Which unit a value is in follows, in this order, from the row's own note, from the values of its series, and
from its feed's note.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.functions.text import normal_code, readable_day
from tidemark.sources.tables import bars, table


@dataclass(frozen=True)
class Edge:
    """value in `to` = scale * value in `of` + offset."""

    of: str
    to: str
    scale: float
    offset: float = 0.0


# How the units of prices, volumes and factors relate.
EDGES = (
    Edge("fen", "yuan", 0.01),
    Edge("li", "fen", 0.1),
    Edge("li", "yuan", 0.001),
    Edge("lot", "share", 100.0),
    Edge("kshare", "share", 1000.0),
    Edge("wan", "kshare", 10.0),
    Edge("wan", "share", 10000.0),
    Edge("percent", "ratio", 0.01),
    Edge("permille", "percent", 0.1),
    Edge("bp", "percent", 0.01),
    Edge("bp", "ratio", 0.0001),
)
CANONICAL = ("yuan", "share", "ratio")
#: Powers of ten by which a value in a unit exceeds the one in the canonical unit.
PRICE_LEVELS = {"yuan": 0, "fen": 2, "li": 3}
VOLUME_LEVELS = {"share": 0, "lot": -2, "kshare": -3, "wan": -4}
FACTOR_LEVELS = {"ratio": 0, "percent": 2, "permille": 3, "bp": 4}
#: Days that a change of unit nobody wrote down must last for it to be told from a spike is over half of this.
SPAN = 9
JUMP = 0.6


def compositions(edges: tuple[Edge, ...], targets: tuple[str, ...]) -> dict[str, tuple[str, float, float]]:
    """unit -> (target, scale, offset) along the path with the fewest edges, either way along an edge.

    Raises ValueError where two paths disagree (a cycle whose composition isn't the identity) or a unit reaches two
    targets. A unit that reaches none is left out.
    """
    out: dict[str, tuple[str, float, float]] = {}
    near: dict[str, list[tuple[str, float, float]]] = {}
    for e in edges:
        if not e.scale:
            raise ValueError(f"{e} can't be turned round")
        near.setdefault(e.of, []).append((e.to, e.scale, e.offset))
        near.setdefault(e.to, []).append((e.of, 1 / e.scale, -e.offset / e.scale))
    for t in targets:
        # f[u]: value in t = a * value in u + b
        f, todo = {t: (1.0, 0.0)}, deque([t])
        while todo:
            v = todo.popleft()
            for u, s, o in near.get(v, []):  # v -> u: value in u = s * value in v + o, so turn it round
                a, b = f[v][0] / s, f[v][1] - f[v][0] * o / s
                if u not in f:
                    f[u] = (a, b)
                    todo.append(u)
        for e in edges:
            if e.of in f:
                a, b = f[e.to][0] * e.scale, f[e.to][0] * e.offset + f[e.to][1]
                if not np.allclose((a, b), f[e.of], rtol=1e-9, atol=1e-12):
                    raise ValueError(f"the paths from {e.of} to {t} disagree: {(a, b)} and {f[e.of]}")
        for u, (a, b) in f.items():
            if u in out:
                raise ValueError(f"{u} reaches {out[u][0]} and {t}")
            out[u] = (t, a, b)
    return out


def conversions(spark: SparkSession, edges: tuple[Edge, ...] = EDGES, targets: tuple[str, ...] = CANONICAL) -> DataFrame:
    """unit, target, scale, shift: a row for each unit of the graph, so its broadcast is bounded by the graph."""
    rows = [(u, t, float(f"{a:.12g}"), float(f"{b:.12g}")) for u, (t, a, b) in compositions(edges, targets).items()]
    return F.broadcast(spark.createDataFrame(rows, "unit string, target string, scale double, shift double"))


def convert(df: DataFrame, unit: str, values: list[str], table_: DataFrame, keep: bool = True) -> DataFrame:
    """values in the canonical unit, by an equi-join on the unit; an unknown or null unit makes them null."""
    c = table_.select(F.col("unit").alias("_u"), F.col("scale").alias("_s"), F.col("shift").alias("_o"))
    out = df.join(c, F.col(unit) == F.col("_u"), "left").withColumns({v: F.col(v) * F.col("_s") + F.col("_o") for v in values}).drop("_u", "_s", "_o")
    return out if keep else out.drop(unit)


# ---- units in texts --------------------------------------------------------------------------------------------

# The words for units in notes, for prices and for volumes, each after the word for what is measured.
_PRICE, _VOLUME = r"\b(?:px|prices?|kurs)\b|价格", r"\bvol(?:ume)?\b|成交量"
_PRICE_WORDS = (("li", r"1/1000 yuan|厘|\bli\b"), ("fen", r"1/100 yuan|分|\bfen\b"), ("yuan", r"元|\byuan\b|\bcny\b"))
_VOLUME_WORDS = (("wan", r"万|\bwan\b|\b10k\b|10,000"), ("kshare", r"千|\bthousand\b|\btsd\b|\bk shares"), ("lot", r"手|\blots?\b|\blosen\b"), ("share", r"股|\bshares?\b|stück"))
_FACTOR_WORDS = (("percent", r"%|percent|pct|百分之"), ("permille", r"‰|per mille"), ("bp", r"\bbp\b|basis point|万分之"))


def _worded(text: Column, subject: str, other: str, words: tuple) -> Column:
    """The unit in the part of the text about `subject`: it ends at ; / 。 or where `other` is spoken of."""
    low, out = F.lower(text), None
    for unit, rx in words:
        hit = low.rlike(rf"(?:{subject})(?:(?!{other})[^;/。；])*?(?:{rx})")
        out = F.when(hit, unit) if out is None else out.when(hit, unit)
    return F.when(text.isNotNull(), out)


def price_unit(text: Column) -> Column:
    return _worded(text, _PRICE, _VOLUME, _PRICE_WORDS)


def volume_unit(text: Column) -> Column:
    return _worded(text, _VOLUME, _PRICE, _VOLUME_WORDS)


def level(unit: Column, levels: dict[str, int]) -> Column:
    out = None
    for u, k in levels.items():
        out = F.when(unit == u, k) if out is None else out.when(unit == u, k)
    return out.cast("int")


def unit_at(lev: Column, levels: dict[str, int]) -> Column:
    out = None
    for u, k in levels.items():
        out = F.when(lev == k, u) if out is None else out.when(lev == k, u)
    return out


# ---- bars: what the notes say ----------------------------------------------------------------------------------


def fine(v: str) -> Column:
    """Not null, NaN, infinite or zero."""
    c = F.col(v)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")) & (c != 0), F.lit(False))


def feed_periods(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feeds").select(F.col("src").alias("f_src"), readable_day(F.col("since")).alias("per"), level(price_unit(F.col("unit_note")), PRICE_LEVELS).alias("exp_p"), level(volume_unit(F.col("unit_note")), VOLUME_LEVELS).alias("exp_v")).where("per is not null")
    return f.withColumn("until", F.lead("per").over(W.partitionBy("f_src").orderBy("per")))


def noted_bars(spark: SparkSession, d: str, *columns: str, **more: Column) -> DataFrame:
    """bars with own_p, own_v (levels by the row's own note) and per, exp_p, exp_v (feed's period and its levels).

    Codes, dates and notes are read here and nowhere else: write the result (`cut`) and derive all from it.
    """
    need = list(dict.fromkeys(["src", "note", "fetched_at", *columns]))
    b = bars(spark, d, *[c for c in need if c not in ("day", "day_no")]).withColumns({"own_p": level(price_unit(F.col("note")), PRICE_LEVELS), "own_v": level(volume_unit(F.col("note")), VOLUME_LEVELS), "at": F.coalesce("day", F.to_date("fetched_at")), **more})
    f = feed_periods(spark, d)
    on = (F.col("src") == F.col("f_src")) & (F.col("at") >= F.col("per")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    return b.join(f, on, "left").select("src", "code", "day_no", "own_p", "own_v", "per", "exp_p", "exp_v", *[c for c in dict.fromkeys([*columns, *more]) if c not in ("src", "code", "day_no")])


def _nearest(x: Column, levels: dict[str, int]) -> Column:
    """The nearest of the levels, the lower one on a tie; null for null."""
    return F.when(x.isNotNull(), F.array_min(F.transform(F.array(*[F.lit(v) for v in sorted(levels.values())]), lambda v: F.struct(F.abs(x - v).alias("far"), v.alias("v"))))["v"])


def feed_levels(noted: DataFrame) -> DataFrame:
    """per feed period whose note is silent on price or volume: lev_p, lev_v as the values show them.

    Codes that several feeds record are compared day by day with the median of the feeds whose notes speak; the level
    most days agree on is the feed's. Null where nothing can be compared. noted: written rows of noted_bars.
    """
    logs = {"lp": F.when(F.col("own_p").isNull() & fine("close"), F.log10(F.abs("close"))), "lv": F.when(F.col("own_v").isNull() & fine("vol"), F.log10(F.abs("vol")))}
    rows = noted.where("per is not null and code is not null and day_no is not null").select("src", "code", "day_no", "per", "exp_p", "exp_v", "close", "vol", "own_p", "own_v")
    part = lambda some: rows.where(some).withColumns(logs).drop("close", "vol", "own_p", "own_v")
    theirs = part("exp_p is null or exp_v is null")
    shared = theirs.select("code").distinct()
    spoken = part("exp_p is not null or exp_v is not null").join(shared, "code", "left_semi")
    known = spoken.groupBy("code", "day_no").agg(F.percentile_approx(F.col("lp") - F.col("exp_p"), 0.5).alias("cp"), F.percentile_approx(F.col("lv") - F.col("exp_v"), 0.5).alias("cv"))
    votes = theirs.join(known, ["code", "day_no"]).select("src", "per", F.when(F.col("exp_p").isNull(), _nearest(F.col("lp") - F.col("cp"), PRICE_LEVELS)).alias("vp"), F.when(F.col("exp_v").isNull(), _nearest(F.col("lv") - F.col("cv"), VOLUME_LEVELS)).alias("vv"))
    count = [F.sum((F.col("vp") == v).cast("int")).alias(f"p{i}") for i, v in enumerate(PRICE_LEVELS.values())] + [F.sum((F.col("vv") == v).cast("int")).alias(f"v{i}") for i, v in enumerate(VOLUME_LEVELS.values())]
    most = lambda x, levels: F.array_max(F.array(*[F.struct(F.coalesce(f"{x}{i}", F.lit(0)).alias("n"), F.lit(-abs(v)).alias("o"), F.lit(v).alias("v")) for i, v in enumerate(levels.values())]))
    best = votes.groupBy("src", "per").agg(*count).select(F.col("src").alias("m_src"), F.col("per").alias("m_per"), most("p", PRICE_LEVELS).alias("p"), most("v", VOLUME_LEVELS).alias("v"))
    return best.select("m_src", "m_per", F.when(F.col("p.n") > 0, F.col("p.v")).alias("lev_p"), F.when(F.col("v.n") > 0, F.col("v.v")).alias("lev_v"))


def expected_bars(spark: SparkSession, d: str, *columns: str, **more: Column) -> DataFrame:
    """noted_bars, written once, with the silent notes' levels filled: from values, else the canonical unit."""
    from tidemark.sources.tables import cut

    noted = cut(noted_bars(spark, d, *dict.fromkeys(["close", "vol", *columns]), **more), "noted")
    m = cut(feed_levels(noted), "feeds")
    j = noted.join(m, (F.col("src") == F.col("m_src")) & (F.col("per") == F.col("m_per")), "left")
    return j.withColumns({"exp_p": F.coalesce("exp_p", "lev_p", F.lit(0)), "exp_v": F.coalesce("exp_v", "lev_v", F.lit(0))}).drop("m_src", "m_per", "lev_p", "lev_v", "per")


# ---- bars: what the values of a series say ---------------------------------------------------------------------


def true_levels(x: np.ndarray, e: np.ndarray, start: np.ndarray, levels: list[int]) -> np.ndarray:
    """The level of each reading of many series laid end to end.

    x: log10 of the values over what is expected (x is level where the expectation e holds), finite; start: index
    at which the reading's series starts. A running median over SPAN readings drops spikes; where it jumps, the unit
    may have changed. Jumps are summed, the sum at which most readings of a series lie is where the expectation
    holds, and each stretch gets the level nearest to its sum. The exact reading at which a stretch begins is the
    one that splits the readings about the jump best.
    """
    n = len(x)
    if not n:
        return np.zeros(0, int)
    i = np.arange(n)
    first = np.flatnonzero(i == start)
    size = np.diff(np.append(first, n))
    last = np.repeat(first + size - 1, size)
    low = np.clip(i - SPAN // 2, start, np.maximum(start, last - SPAN + 1))
    m = np.median(x[np.minimum(low[:, None] + np.arange(SPAN), last[:, None])], axis=1)
    step = np.diff(m, prepend=m[0])
    step[first] = 0
    at = np.flatnonzero(np.abs(step) > JUMP)
    moved = np.zeros(n)
    for b in at:  # a few in a series
        a, z = max(start[b], b - SPAN // 2), min(last[b], b + SPAN // 2)
        gain = np.abs(x[a : z + 1] - m[b - 1]) - np.abs(x[a : z + 1] - m[b])
        cost = np.concatenate([[0.0], np.cumsum(-gain)])  # of the split before each reading, from a to z + 1
        k = a + int(np.argmax(cost))
        k = min(max(k, a), z)
        moved[k] += step[b]
    total = np.cumsum(moved)
    total -= np.repeat(total[first] - moved[first], size)
    which = np.repeat(np.arange(len(first)), size)
    whole = np.round(total).astype(int)
    key = which * 64 + whole + 32
    ids, counts = np.unique(key, return_counts=True)
    order = np.lexsort((counts, ids // 64))
    best = np.zeros(len(first), int)
    best[ids[order] // 64] = ids[order] % 64 - 32  # the last of a series has the most readings
    mean = np.bincount(which, np.where(whole == best[which], total, 0)) / np.maximum(np.bincount(which, whole == best[which]), 1)
    off = total - mean[which]
    choice = np.array(levels)
    return choice[np.argmin(np.abs((e + off)[:, None] - choice[None, :]), axis=1)]


def day_levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """pdf: rows of whole series sorted by series and day_no with lp, lpn, lv, lvn, exp_p, exp_v and `series` (a number).

    Returns lev_p and lev_v for each row. A day without a usable value takes the level of the day before, or the
    first known; a series without any has what its feed says.
    """
    out = {}
    for q, own, other, exp, levels in (("p", "lp", "lpn", "exp_p", PRICE_LEVELS), ("v", "lv", "lvn", "exp_v", VOLUME_LEVELS)):
        e = pdf[exp].to_numpy(float)
        x = pdf[own].to_numpy(float) - e
        x = np.where(np.isfinite(x), x, pdf[other].to_numpy(float))
        ok = np.isfinite(x)
        s = pdf["series"].to_numpy()[ok]
        start = np.flatnonzero(np.diff(s, prepend=s[:1] - 1)) if len(s) else np.zeros(0, int)
        begin = np.repeat(start, np.diff(np.append(start, len(s))))
        lev = np.full(len(pdf), np.nan)
        lev[ok] = true_levels(x[ok], e[ok], begin, list(levels.values())) - e[ok]
        g = pd.Series(lev).groupby(pdf["series"].to_numpy())
        out[f"lev_{q}"] = (g.ffill().fillna(g.bfill()).fillna(0).to_numpy() + e).astype(int)
    return pd.DataFrame(out, index=pdf.index)


def block_of(code: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(code), blocks).cast("int")


#: Series in a block that one task handles at once: a series has at most one row a day, so a block is bounded.
SERIES_IN_BLOCK = 64


def in_blocks(days: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds `block`: a source's series are spread over as many blocks as keep each at about SERIES_IN_BLOCK series.

    rows: what is cheap to read and has the src and code of all days.
    """
    n = rows.groupBy("src").agg(F.ceil(F.approx_count_distinct("code") / SERIES_IN_BLOCK).alias("_n")).withColumnRenamed("src", "_s")
    return days.join(n, F.col("src") == F.col("_s")).withColumn("block", block_of(F.col("code"), F.greatest("_n", F.lit(1)))).drop("_n", "_s")


def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["src", "code", "day_no"], kind="stable", ignore_index=True)
    new = (pdf["src"] != pdf["src"].shift()) | (pdf["code"] != pdf["code"].shift())
    pdf["series"] = new.cumsum().to_numpy()
    return pdf


def _segments(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = numbered(pdf)
    lev = day_levels(pdf)
    s, p, v, day = pdf["series"].to_numpy(), lev["lev_p"].to_numpy(), lev["lev_v"].to_numpy(), pdf["day_no"].to_numpy()
    other = (p != pdf["exp_p"].to_numpy()) | (v != pdf["exp_v"].to_numpy())
    new = np.flatnonzero((np.diff(s, prepend=-1) != 0) | (np.diff(p, prepend=99) != 0) | (np.diff(v, prepend=99) != 0) | (np.diff(other.astype(int), prepend=-1) != 0))
    end = np.append(new[1:], len(s)) - 1
    new, end = new[other[new]], end[other[new]]
    return pd.DataFrame({"src": pdf["src"].to_numpy()[new], "code": pdf["code"].to_numpy()[new], "a": day[new], "z": day[end], "lev_p": p[new], "lev_v": v[new]})


SEGMENT = "src string, code string, a int, z int, lev_p int, lev_v int"


def series_days(rows: DataFrame) -> DataFrame:
    """One row per series and day: logs of its values without (lp, lv) and with (lpn, lvn) a note of their own."""
    lp, lv = F.when(fine("close"), F.log10(F.abs("close"))), F.when(fine("vol"), F.log10(F.abs("vol")))
    pick = lambda x, own, has: F.max(F.when(F.col(own).isNotNull() if has else F.col(own).isNull(), x - (F.col(own) if has else 0)))
    return rows.groupBy("src", "code", "day_no").agg(pick(lp, "own_p", False).alias("lp"), pick(lp, "own_p", True).alias("lpn"), pick(lv, "own_v", False).alias("lv"), pick(lv, "own_v", True).alias("lvn"), F.max("exp_p").alias("exp_p"), F.max("exp_v").alias("exp_v"))


def in_series() -> Column:
    return F.expr("code is not null and day_no is not null and src is not null")


def segments(rows: DataFrame) -> DataFrame:
    """Stretches of days of a series in units other than expected: src, code, a, z (day numbers), lev_p, lev_v."""
    own = rows.where(in_series())
    days = in_blocks(series_days(own).withColumns({c: F.col(c).cast("float") for c in ("lp", "lpn", "lv", "lvn")}), own)
    return days.groupBy("src", "block").applyInPandas(_segments, SEGMENT)


def levelled(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """bars with lev_p and lev_v, the levels their values are in by all that is known."""
    from tidemark.sources.tables import cut

    rows = expected_bars(spark, d, "bar_id", *columns)
    seg = cut(segments(rows), "segments").select(F.col("src").alias("g_src"), F.col("code").alias("g_code"), "a", "z", "lev_p", "lev_v")
    on = (F.col("src") == F.col("g_src")) & (F.col("code") == F.col("g_code")) & F.col("day_no").between(F.col("a"), F.col("z"))
    lev = lambda q: F.coalesce(f"own_{q}", f"lev_{q}", f"exp_{q}")
    return rows.join(seg, on, "left").withColumns({"lev_p": lev("p"), "lev_v": lev("v")}).drop("g_src", "g_code", "a", "z", "own_p", "own_v", "exp_p", "exp_v")


def common_bars(spark: SparkSession, d: str) -> DataFrame:
    """All bars in common units: bar_id, src, code, day, day_no, fetched_at, open, high, low, close, vol.

    Null, NaN and infinite values stay as they are. A bar outside of any series has what its own note, else its
    feed's note for its day (for its fetching day where it has none) says, else the common unit.
    """
    b = levelled(spark, d, "day", "open", "high", "low", "fetched_at").withColumns({"_pu": unit_at(F.col("lev_p"), PRICE_LEVELS), "_vu": unit_at(F.col("lev_v"), VOLUME_LEVELS)})
    c = conversions(spark)
    out = convert(convert(b, "_pu", ["open", "high", "low", "close"], c), "_vu", ["vol"], c)
    return out.select("bar_id", "src", "code", "day", "day_no", "fetched_at", "open", "high", "low", "close", "vol")


# ---- factors ---------------------------------------------------------------------------------------------------


def factor_units(spark: SparkSession, d: str) -> DataFrame:
    """adjust with v (k, or the number in k_text if k is null) and unit.

    A unit in k_text counts if its number is the value; a value that is already that number's ratio is a ratio. The
    others get the unit that brings them nearest to the median of their code's sure values (in a text's unit, or at
    most 1.5); a code without any, the first unit in which they are at most 1.5.
    """
    number = F.regexp_extract("k_text", r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    said = None
    for u, rx in _FACTOR_WORDS:
        hit = F.lower("k_text").rlike(rx)
        said = F.when(hit, u) if said is None else said.when(hit, u)
    a = table(spark, d, "adjust").select("adj_id", normal_code(F.col("code")).alias("code"), F.coalesce("k", number).alias("v"), number.alias("number"), said.alias("said"))
    conv = conversions(spark).select(F.col("unit").alias("_u"), "scale")
    a = a.where(fine("v")).join(conv, F.col("said") == F.col("_u"), "left").drop("_u")
    near = lambda x, y: F.abs(x - y) <= 1e-6 * F.abs(y)
    a = a.withColumn("sure", F.when(near(F.col("v"), F.col("number")), F.col("said")).when(near(F.col("v"), F.col("number") * F.col("scale")), F.lit("ratio")))
    lv = F.log10(F.abs("v"))
    ratio = F.when(F.col("sure").isNotNull(), lv - level(F.col("sure"), FACTOR_LEVELS)).when(F.abs("v") <= 1.5, lv)
    mid = a.where("code is not null").groupBy("code").agg(F.percentile_approx(ratio, 0.5).alias("mid")).withColumnRenamed("code", "_c")
    by = _nearest(lv - F.col("mid"), FACTOR_LEVELS)
    alone = F.when(F.abs("v") <= 1.5, 0).when(F.abs("v") <= 150, 2).when(F.abs("v") <= 1500, 3).otherwise(4)
    j = a.join(mid, F.col("code") == F.col("_c"), "left").withColumn("unit", F.coalesce("sure", unit_at(F.coalesce(by, alone), FACTOR_LEVELS)))
    return j.select("adj_id", "code", "v", "unit")


def common_factors(spark: SparkSession, d: str) -> DataFrame:
    return convert(factor_units(spark, d), "unit", ["v"], conversions(spark)).withColumnRenamed("v", "k")


def unit_cases(spark: SparkSession, d: str) -> DataFrame:
    """tab, row_id, field of every stored value whose conversion to its canonical unit isn't the identity."""
    conv = conversions(spark).select(F.col("unit").alias("_u"), ((F.col("scale") != 1) | (F.col("shift") != 0)).alias("other"))
    b = levelled(spark, d).select("bar_id", F.explode(F.array(F.struct(F.lit("close").alias("field"), F.when(fine("close"), unit_at(F.col("lev_p"), PRICE_LEVELS)).alias("unit")), F.struct(F.lit("vol").alias("field"), F.when(fine("vol"), unit_at(F.col("lev_v"), VOLUME_LEVELS)).alias("unit")))).alias("x"))
    x = b.select(F.lit("daily_bars").alias("tab"), F.col("bar_id").alias("row_id"), "x.field", "x.unit")
    k = factor_units(spark, d).select(F.lit("adjust").alias("tab"), F.col("adj_id").alias("row_id"), F.lit("k").alias("field"), "unit")
    return x.union(k).join(conv, F.col("unit") == F.col("_u")).where("other").select("tab", "row_id", "field")
