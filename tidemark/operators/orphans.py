"""References to records that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import cut

#: Bits of the filter for each parent key: of strangers, about one in a hundred passes with this many and four probes.
BITS_A_KEY = 16
#: Words of 64 bits in the filter: at least, and at most, which at 16 bytes a row bounds its broadcast by 64 MB (16 million
#: keys; with more of them it only lets more through).
FEWEST, MOST = 1 << 10, 1 << 22
PROBES = 4
#: A key with at least this share of the references is heavy; there are at most 1 / HEAVY of them.
HEAVY = 1 / 64


def words_for(keys: DataFrame, key: str) -> Column:
    """The number of words for the distinct keys, as a column of one value."""
    n = keys.agg(F.approx_count_distinct(key).alias("n")).select(F.ceil(F.col("n") * BITS_A_KEY / 64).cast("int")).scalar()
    return F.greatest(F.lit(FEWEST), F.least(n, F.lit(MOST)))


def _place(key: Column, words: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), words if isinstance(words, Column) else F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """PROBES bits of a word, all from one second hash."""
    h = F.xxhash64(key, F.lit(7))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    return reduce(Column.bitwiseOR, bits)


def bloom(keys: DataFrame, key: str, words: Column | int) -> DataFrame:
    """A blocked Bloom filter as a table (word, bits) of at most `words` rows: all bits of a key are in one word.

    Null keys are left out. With many more keys than bits it only lets more through, which the exact join then judges.
    """
    k = keys.select(F.col(key).alias("_k")).where("_k is not null").select("_k", _place(F.col("_k"), words).alias("word"))
    return k.groupBy("word").agg(F.bit_or(_mask(F.col("_k"))).alias("bits"))


def probe(children: DataFrame, key: str, filt: DataFrame, words: Column | int) -> DataFrame:
    """Adds `maybe`: false proves that the key isn't among the filter's. A null key is false."""
    hit = F.col("bits").isNotNull() & (F.col("bits").bitwiseAND(_mask(F.col(key))) == _mask(F.col(key)))
    placed = children.withColumn("_at", _place(F.col(key), words))
    return placed.join(F.broadcast(filt), F.col("_at") == F.col("word"), "left").withColumn("maybe", F.coalesce(F.col(key).isNotNull() & hit, F.lit(False))).drop("word", "bits", "_at")


def orphans(children: DataFrame, key: str, day: str, parents: DataFrame, extra: list[str]) -> DataFrame:
    """The rows of children that refer to no valid parent, with `why`.

    parents: key, since (first day known, or null) and upto (last valid day, or null), one row a key; they need not
    be known (`known` false) when only their end is. Rows whose `has_ref` is false refer to nothing and never are a
    case. why: 'no such key' (form or key unknown), 'not yet' (day before since), 'closed' (day after upto). A row
    without a day is only judged by its key.

    Rows that the filter proves to be orphans go straight into the result. The others are joined: the rows of heavy keys
    with the few parents of these, which are broadcast, the rest by a shuffle, in which no key is heavy.
    """
    known = parents.where("known")
    words = words_for(known, key)
    tested = cut(probe(children.where("has_ref").select(*extra, key, day), key, bloom(known, key, words), words), "references")
    maybe = tested.where("maybe")
    heavy = maybe.groupBy(F.col(key).alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") >= F.greatest(F.lit(2.0), HEAVY * maybe.agg(F.count("*")).scalar())).select("_h")
    heavy = cut(heavy, "heavy")  # at most 1 / HEAVY rows, read four times
    p = parents.select(F.col(key).alias("_p"), "known", "since", "upto")
    d = F.col(day)
    why = F.when(~F.coalesce("known", F.lit(False)), "no such key").when(d < F.col("since"), "not yet").when(d > F.col("upto"), "closed")
    joined = []
    for rows, few in ((maybe.join(F.broadcast(heavy), F.col(key) == F.col("_h"), "left_semi"), F.broadcast(p.join(F.broadcast(heavy), F.col("_p") == F.col("_h"), "left_semi"))), (maybe.join(F.broadcast(heavy), F.col(key) == F.col("_h"), "left_anti"), p.hint("shuffle_hash"))):
        joined.append(rows.join(few, F.col(key) == F.col("_p"), "left").select(*extra, key, day, why.alias("why")).where("why is not null"))
    proven = tested.where("not maybe").select(*extra, key, day, F.lit("no such key").alias("why"))
    return proven.union(joined[0]).union(joined[1])
