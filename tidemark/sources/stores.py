"""Stores of bars: declared schemas, versions that appear whole or not at all, and what to fetch next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tables of a store with their columns; a column added later goes to the end.
SCHEMAS = {
    "daily_bars": "code string, date date, open double, high double, low double, close double, vol double",
    "instruments": "code string, name string, industry string, mktcap double, tier string, updated string, board string",
    "adjust": "code string, k double, ts double",
    "delisted": "code string, last_date string, ts double",
    "settings": "name string, value string, ts double",
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of the schema, in its order and types; columns it lacks are null, others are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in T.StructType.fromDDL(schema).fields])


class Versions:
    """A table in the shared folder whose new versions are written aside and published by renaming one small file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def commit(self, df: DataFrame) -> None:
        """Publish df; whatever fails before the last line leaves the version before as it was."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}")
        fs, folder = self._fs(f"{self.path}/published")
        fs.mkdirs(folder)
        number = len(fs.listStatus(folder)) + 1
        fs.mkdirs(self._fs(f"{self.path}/published/{number:012d}-{name}")[1])

    def read(self) -> DataFrame:
        fs, folder = self._fs(f"{self.path}/published")
        last = max(s.getPath().getName() for s in fs.listStatus(folder))
        return self.spark.read.parquet(f"{self.path}/{last.split('-')[1]}")


def fetch_plan(universe: DataFrame, stored: DataFrame, failed: DataFrame, today: str, least: int, ttl_days: int) -> DataFrame:
    """code, since, why of what must be fetched: 'new' and 'short' codes from the beginning (since is null), 'stale' ones
    from their last day. Codes that failed within ttl_days are left out.

    universe: code. stored: code, date. failed: code, failed_on. Only one row a code of each is shuffled.
    """
    have = stored.groupBy("code").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    day = F.lit(today).cast("date")
    why = F.when(F.col("n").isNull(), "new").when(F.col("n") < least, "short").when(F.col("last") < day, "stale")
    recent = failed.where(F.datediff(day, "failed_on") < ttl_days).select("code").distinct()
    out = universe.join(recent, "code", "left_anti").join(have, "code", "left").withColumn("why", why).where("why is not null")
    return out.select("code", F.when(F.col("why") == "stale", F.col("last")).alias("since"), "why")


def read_through(cached: DataFrame, fetched: DataFrame, failed: DataFrame, today: str, fresh_days: int, tolerance: float = 0.01) -> DataFrame:
    """The bars a reader gets: code, date, close, state.

    A code whose last cached day is at most fresh_days before today is served from the cache ('fresh'); so is a stale one
    whose fetch failed or brought nothing ('stale'). Else its fetched bars go over the cached ones ('merged'), unless on the days
    both hold the mean ratio of closes is off by more than the tolerance: then prices have a new base, and the fetched bars
    replace all ('rebased').
    """
    last = cached.groupBy("code").agg(F.max("date").alias("last"))
    ok = fetched.join(failed.select("code").distinct(), "code", "left_anti")
    both = cached.select("code", "date", F.col("close").alias("old")).join(ok.select("code", "date", "close"), ["code", "date"])
    moved = both.where("old > 0").groupBy("code").agg(F.avg(F.col("close") / F.col("old")).alias("ratio"))
    codes = last.join(ok.select("code").distinct().withColumn("got", F.lit(True)), "code", "full").join(moved, "code", "left")
    fresh = F.datediff(F.lit(today).cast("date"), "last") <= fresh_days
    state = F.when(fresh, "fresh").when(F.col("got").isNull(), "stale").when(F.abs(F.col("ratio") - 1) > tolerance, "rebased").otherwise("merged")
    s = codes.select("code", state.alias("state"))
    old = cached.select("code", "date", "close", F.lit(0).alias("_o")).join(s.where("state != 'rebased'"), "code")
    new = ok.select("code", "date", "close", F.lit(1).alias("_o")).join(s.where("state in ('rebased', 'merged')"), "code")
    return old.union(new).groupBy("code", "date").agg(F.max_by(F.struct("close", "state"), "_o").alias("x")).select("code", "date", "x.close", "x.state")


def freshness(stamps: DataFrame, now, ttl: float) -> DataFrame:
    """stamps (name, ts) with age in seconds and what to do: 'keep' within ttl, 'refresh' beyond it, 'fail' beyond four
    times of it (until then a failed refresh is tolerated)."""
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    return stamps.withColumn("age", age).withColumn("todo", F.when(F.col("ts").isNull() | (age > 4 * ttl), "fail").when(age > ttl, "refresh").otherwise("keep"))


def signature(parts: DataFrame, by: list[str], code: str, date: str, least: int, version: int) -> DataFrame:
    """by, sig: a hash of a group's codes, the number and the last day of its rows, the least length and the version. A
    stored result fits its inputs if the hash does. The codes are hashed one row a code."""
    one = parts.groupBy(*by, code).agg(F.count("*").alias("n"), F.max(date).alias("last"))
    g = one.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.col(code).cast("string"))), ",").alias("codes"), F.sum("n").alias("n"), F.max("last").alias("last"))
    return g.select(*by, F.md5(F.concat_ws("|", "codes", F.lit(str(least)), F.date_format("last", "yyyy-MM-dd"), F.col("n").cast("string"), F.lit(str(version)))).alias("sig"))


def report_lines(df: DataFrame, order: list[str], digits: int = 4, markdown: bool = True) -> DataFrame:
    """line_no, line: a table's head and rows as text, numbered in order; df is a report, aggregated before."""
    from pyspark.sql import Window as W

    cells = [F.coalesce(F.format_string(f"%.{digits}f", c) if t == "double" else F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")) if markdown else F.concat_ws("  ", *cells)
    rows = df.select((F.row_number().over(W.orderBy(*order)) + 2).cast("long").alias("line_no"), body.alias("line"))
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)] if markdown else ["  ".join(df.columns), "-" * len("  ".join(df.columns))]
    return df.sparkSession.createDataFrame(list(enumerate(head, 1)), "line_no long, line string").union(rows)
