"""The queries p7 to p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import truncation_sql
from tidemark.llm.bpe import token_counts, token_ids
from tidemark.llm.packing import pack
from tidemark.llm.truncation import endings, truncated
from tidemark.sources.tables import cut, table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def _bins(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    return [tuple(r) for r in table(spark, d, "bin_sizes").select("bin_id", "token_capacity").distinct().collect()]  # a fixed table


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(token_counts(table(spark, d, "documents"), "doc_id", "text"), "sizes")
    return pack(spark, sizes, "doc_id", "n_tokens", _bins(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text above the capacity, with its container in each size of bin_sizes."""
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per size: containers, tokens, the fewest containers any packing needs, and the share of room that is filled."""
    one = _packed(spark, d).groupBy("bin_id", "token_capacity", "container").agg(F.sum("n_tokens").alias("t"))
    out = one.groupBy("bin_id", "token_capacity").agg(F.count_if(F.col("t") > 0).alias("containers"), F.sum("t").alias("tokens"))
    return out.select("*", F.ceil(F.col("tokens") / F.col("token_capacity")).alias("fewest"), F.round(F.try_divide("tokens", F.col("containers") * F.col("token_capacity")), 6).alias("fill"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    ends = cut(endings(table(spark, d, "documents"), "doc_id", "text", ["source"]), "endings")
    return truncated(ends, "doc_id", ["source"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("cut").select("doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut texts per source, of the texts that can be judged."""
    return _judged(spark, d).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))


QUERIES = {f.__name__: f for f in (p7_ids, p8_containers, p8_fill, p9_found, p9_report)}
#: p7 and p8 can't be said in SQL; see tests/llm for their brute-force checks.
SQL: dict[str, str] = truncation_sql.SQL
