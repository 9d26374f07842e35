"""History of changing entity attributes, from periodic snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_snapshots(snaps: DataFrame, keys: list[str], day: str, attributes: list[str], order: list[str]) -> DataFrame:
    """One snapshot per key and day: the one that is last by `order` (the last of them must make it unique)."""
    best = F.max_by(F.struct(*attributes), F.struct(*order))
    return snaps.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(best.alias("_s")).select(*keys, day, *[F.col(f"_s.{a}").alias(a) for a in attributes])


def versions(snaps: DataFrame, keys: list[str], day: str, attributes: dict[str, Column]) -> DataFrame:
    """One row per version of a key: valid_from, valid_to (null: still valid), the attributes as then known.

    snaps: one row per key and day. attributes: name -> the expression by which values are compared. A null says
    nothing new, the last known value stays; a first known value after nulls makes a version. Every key starts one
    at its first snapshot. Snapshots of a key are numbered; each (key, attribute, value hash) has a bitmap of 64-bit
    words with a bit for every snapshot that shows the value. A run of bits is a time the value held; where a run
    begins a version begins. Skipped snapshots have no number, so gaps need no care.
    """
    names = list(attributes)
    w = W.partitionBy(*keys).orderBy(day)
    seen = w.rowsBetween(W.unboundedPreceding, 0)
    known = snaps.select(*keys, day, (F.row_number().over(w) - 1).alias("_i"), *[F.last(F.col(a), ignorenulls=True).over(seen).alias(a) for a in names])
    forms = F.array(*[F.struct(F.lit(k).alias("a"), F.xxhash64(attributes[a]).alias("h"), attributes[a].isNotNull().alias("known")) for k, a in enumerate(names)])
    bits = known.select(*keys, "_i", F.explode(forms).alias("x")).where("x.known").select(*keys, "x.a", "x.h", F.floor(F.col("_i") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, _i % 64)").alias("bit"))
    words = bits.groupBy(*keys, "a", "h", "word").agg(F.bit_or("bit").alias("bits"))
    # A run goes on across words if the word before is the next lower one and its top bit is set.
    before = W.partitionBy(*keys, "a", "h").orderBy("word")
    carry = F.when((F.lag("word").over(before) == F.col("word") - 1) & (F.lag("bits").over(before) < 0), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    starts = words.withColumn("carry", carry).select(*keys, "word", F.expr("bits & ~(shiftleft(bits, 1) | carry)").alias("first"))
    begun = starts.where("first != 0").select(*keys, F.col("word"), F.explode(F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(first, b) & 1L) = 1L)")).alias("b"))
    at = begun.select(*keys, (F.col("word") * 64 + F.col("b")).alias("_i")).union(known.where("_i = 0").select(*keys, "_i")).distinct()
    made = known.join(at, [*keys, "_i"], "left_semi")
    out = made.withColumn("valid_to", F.date_sub(F.lead(day).over(w), 1))
    return out.select(*keys, F.col(day).alias("valid_from"), "valid_to", *names)
