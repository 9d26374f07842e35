"""Feeds' payload formats, report sinks, and configuration: parsing with explicit schemas, no inference."""

from __future__ import annotations

import configparser
import json
import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ("date", "open", "close", "high", "low", "vol")


def _typed(parts: Column, order: tuple[str, ...] = ROW) -> list[Column]:
    cast = lambda i, c: parts[i].try_cast("date" if c == "date" else "double").alias(c)
    return [cast(i, c) for i, c in enumerate(order)]


def _kept(df: DataFrame) -> DataFrame:
    """Rows with a date and a close above zero; a null volume is 0."""
    return df.where("date is not null and close > 0").fillna(0.0, ["vol"])


def arrays_json(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Payloads like {"day": [["2024-01-02", "1.0", ...], ...]}: a row for each inner array; malformed ones are dropped."""
    x = df.select(*keep, F.explode(F.from_json(payload, "day array<array<string>>")["day"]).alias("r"))
    return _kept(x.where(F.size("r") >= 6).select(*keep, *_typed(F.col("r"))))


def lines_json(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Payloads like {"klines": ["2024-01-02,1.0,...", ...]}."""
    x = df.select(*keep, F.explode(F.from_json(payload, "klines array<string>")["klines"]).alias("s"))
    return _kept(x.select(*keep, *_typed(F.split("s", ","))))


def loose_json(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Payloads like [{day:"2024-01-02",open:"1.0",...}] with bare keys."""
    schema = "array<struct<day:string,open:string,close:string,high:string,low:string,volume:string>>"
    x = df.select(*keep, F.explode(F.from_json(payload, schema, {"allowUnquotedFieldNames": "true"})).alias("r"))
    return _kept(x.select(*keep, F.col("r.day").try_cast("date").alias("date"), *[F.col(f"r.{c}").try_cast("double").alias(c) for c in ("open", "close", "high", "low")], F.col("r.volume").try_cast("double").alias("vol")))


def allow_charsets(spark) -> None:
    """Let the session read and write charsets beyond the Unicode ones, such as GBK."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def reversed_csv(spark, path: str, encoding: str = "GBK", code: int | None = None) -> DataFrame:
    """Files with a header, newest first, prices in fields 3 to 6 (close, high, low, open) and volume in field 11; the
    code in field `code`, if files hold more than one."""
    allow_charsets(spark)
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    c = raw.columns
    pick = {"date": 0, "close": 3, "high": 4, "low": 5, "open": 6, "vol": 11}
    cast = [F.col(f"`{c[i]}`").try_cast("date" if n == "date" else "double").alias(n) for n, i in pick.items()]
    key = [] if code is None else [F.col(f"`{c[code]}`").try_cast("long").alias("code")]
    return _kept(raw.select(*key, *cast)).select(*["code"] * len(key), *ROW)


def quote(payload: Column) -> list[Column]:
    """name, price, prev_close, open, high, low, time of a text of fields parted by ~."""
    p = F.split(payload, "~")
    at = {"name": 1, "price": 3, "prev_close": 4, "open": 5, "time": 30, "high": 33, "low": 34}
    return [F.get(p, i).alias(n) if n in ("name", "time") else F.get(p, i).try_cast("double").alias(n) for n, i in at.items()]


def quotes(df: DataFrame, payload: str) -> DataFrame:
    """Many quotes in one text: v_CODE="..."; parts without a code or price are left out."""
    x = df.select(F.explode(F.split(payload, ";")).alias("s")).select(F.regexp_extract("s", r'v_(\w+)="', 1).alias("code"), *quote(F.regexp_extract("s", r'"([^"]*)"', 1)))
    return x.where("code != '' and price is not null")


def to_report(df: DataFrame, name: str = "report") -> DataFrame:
    """One JSON text a row; NaN and infinite numbers become null."""
    clean = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias(name))


def to_markdown(df: DataFrame, rows: int = 200, digits: int = 4) -> str:
    """The first rows of a small result as a table; more rows than `rows` raise ValueError, none are dropped silently."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report of more than {rows} rows; aggregate first or write a file")
    show = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in got])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def view_slice(bars: DataFrame, show: int, pan: int = 0) -> DataFrame:
    """The `show` bars of each code that end `pan` bars before its last."""
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("code").orderBy(F.desc("date")))
    return bars.withColumn("_rn", rn).where(F.col("_rn").between(pan + 1, pan + show)).drop("_rn")


@dataclass(frozen=True)
class Settings:
    """Settings with the ranges to which a file's values are held."""

    window: int = 10
    topk: int = 10
    candidates: int = 50
    buy: int = 2
    sell: int = -2
    cooldown: int = 5


RANGES = {"window": (5, 30), "topk": (3, 30), "candidates": (10, 100), "buy": (1, 10), "sell": (-10, -1), "cooldown": (0, 60)}


def load_settings(path: str | None) -> Settings:
    """From an INI file's [predict] section; values out of range are clamped, unreadable or missing ones default."""
    p = configparser.ConfigParser()
    if path:
        p.read(path, encoding="utf-8")
    got = {}
    for f in fields(Settings):
        try:
            lo, hi = RANGES[f.name]
            got[f.name] = min(hi, max(lo, int(p.get("predict", f.name))))
        except (configparser.Error, ValueError):
            pass
    return Settings(**got)


def save_settings(path: str, s: Settings) -> None:
    p = configparser.ConfigParser()
    p["predict"] = {f.name: str(getattr(s, f.name)) for f in fields(Settings)}
    with open(path, "w", encoding="utf-8") as out:
        p.write(out)


def signature(parts: dict) -> str:
    """A hash by which a stored result is known to fit its inputs."""
    import hashlib

    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()
