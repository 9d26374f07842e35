"""Reading the tables, and cutting a plan at a written table."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import normal_code, readable_day

#: A calendar has one row a day; one with more rows than this is no calendar, and reading it fails. So its broadcast is safe.
MOST_DAYS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set a temporary one serves a local master; others raise ValueError."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `release` deletes what is there."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df into the shared folder and read it back, so that nothing before it is computed twice."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that was cut in this session; call it when the results made of it have been taken."""
    mine = [x for x in _made if x[0] is spark]
    for x in mine:
        where = spark._jvm.org.apache.hadoop.fs.Path(x[1])
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        _made.remove(x)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _made}.values():
        try:
            release(spark)
        except Exception:  # noqa: BLE001, the session may have ended before
            continue


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every calendar day with the open day that counts for it, and that day's number among open days (day_no).

    A closed day before the first open day has no open day.
    """
    days = table(spark, sf_dir, "trade_days").select(F.to_date("cal_day").alias("cal"), "is_open").where("cal is not null").groupBy("cal").agg(F.bool_or(F.coalesce("is_open", F.lit(False))).alias("is_open"))
    # One row a day: this window without a partition is as long as the calendar, not as the data.
    w = W.orderBy("cal").rowsBetween(W.unboundedPreceding, 0)
    long = F.raise_error(F.lit(f"trade_days holds more than {MOST_DAYS} days")).cast("date")
    cal = F.when(F.count("*").over(w) > MOST_DAYS, long).otherwise(F.col("cal")).alias("cal")
    return days.select(cal, "is_open", F.max(F.when(F.col("is_open"), F.col("cal"))).over(w).alias("day"), F.sum(F.col("is_open").cast("int")).over(w).cast("int").alias("day_no"))


def open_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).where("is_open").select("day", "day_no")


def with_day(df: DataFrame, spark: SparkSession, sf_dir: str, read: str = "read_day") -> DataFrame:
    """Adds day and day_no for the date in `read`: the open day on or before it; past the calendar's end its last open day.

    A null date, and one before the calendar's first open day, has none.
    """
    cal = F.broadcast(calendar(spark, sf_dir).select(F.col("cal").alias("_cal"), "day", "day_no").where("day is not null"))
    end = table(spark, sf_dir, "trade_days").agg(F.max(F.to_date("cal_day"))).scalar()
    at = F.when(F.col(read).isNotNull(), F.least(F.col(read), end))  # least alone would skip a null date
    return df.withColumn("_at", at).join(cal, F.col("_at") == F.col("_cal"), "left").drop("_cal", "_at")


def bars(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """daily_bars with code in normal form and the day of the bar, both null where there is none."""
    raw = table(spark, sf_dir, "daily_bars")
    read = raw.select(*[c for c in columns if c not in ("code", "date")], F.col("code").alias("raw_code"), normal_code(F.col("code")).alias("code"), readable_day(F.col("date")).alias("read_day"))
    return with_day(read, spark, sf_dir)


def series_bars(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The bars that belong to a series: code in normal form, a source and a day."""
    return bars(spark, sf_dir, "src", *[c for c in columns if c != "src"]).where("code is not null and src is not null and day is not null")
