"""Ticks to bars, in Structured Streaming and in batch by the same expressions."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import shared_path

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def tick_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The event table as a stream of files."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    s = raw.parquet(f"{sf_dir}/events.parquet")
    return s.select("event_id", F.col("user_id").alias("code"), "ts", F.col("value").alias("price"))


def bars_of(ticks: DataFrame, width: str = "1 day", late: str | None = None, slide: str | None = None) -> DataFrame:
    """code, start, open, high, low, close, n of each window; ticks without a price or time don't count.

    On a stream, late: ticks later than this behind the newest are dropped and old windows forgotten.
    """
    t = ticks.where("price is not null and ts is not null and code is not null")
    if late:
        t = t.withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    g = t.groupBy("code", F.window("ts", width, slide) if slide else F.window("ts", width))
    b = g.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n"))
    return b.select("code", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def sessions_of(ticks: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """code, start, n, total of each run of ticks no further apart than the gap."""
    t = ticks.where("ts is not null and code is not null")
    if late:
        t = t.withWatermark("ts", late)
    s = t.groupBy("code", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("price").alias("total"))
    return s.select("code", F.col("session_window.start").alias("start"), "n", "total")


def drain(stream: DataFrame, keys: list[str], name: str = "bars") -> DataFrame:
    """Run a stream over all that is there, and return the last state of each key.

    Each batch's updates are written to the shared folder under its number, so a batch that is repeated after a loss
    replaces itself; the result is the newest update of a key. Nothing is gathered on the driver.
    """
    spark = stream.sparkSession
    root = shared_path(spark, name)

    def upsert(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/part={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    all_ = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    return all_.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def roll_over(ticks: DataFrame) -> DataFrame:
    """code, ts of the ticks on which a code's day changes: the ones that call for a new analysis."""
    from pyspark.sql import Window as W

    day = F.to_date("ts")
    before = F.lag(day).over(W.partitionBy("code").orderBy("ts", "event_id"))
    return ticks.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.col("_b") != day)).select("code", "ts")


def over_limit(ticks: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """code, ts, n of ticks that are beyond `most` within the trailing seconds, that tick included."""
    from pyspark.sql import Window as W

    w = W.partitionBy("code").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return ticks.withColumn("n", F.count("*").over(w)).where(F.col("n") > most).select("code", "ts", "n")
