"""Block keys, and how many rows of either side fall in each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_key(day: Column) -> Column:
    return F.year(day).cast("string")


def sound_key(name: Column, day: Column) -> Column:
    """How the name sounds, and the year."""
    return F.concat_ws("|", F.soundex(name), F.year(day).cast("string"))


def place_key(postcode: Column, name: Column, day: Column) -> Column:
    """The first three signs of the postcode, how the name sounds, and the year."""
    return F.concat_ws("|", F.substring(postcode, 1, 3), F.soundex(name), F.year(day).cast("string"))


def tagged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two tables with the same columns, and side: 'a' or 'b'."""
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


def ladder(rows: DataFrame, is_a: Column, is_b: Column, keys: dict[str, Column]) -> DataFrame:
    """granularity, bucket, n_b, m_b and work = n_b * m_b for each block that both sides have, for several keys, from coarse to fine.

    is_a and is_b tell the sides' rows apart; a row may be on both. One pass over rows and one exchange serve all keys; rows are
    counted before they move.
    """
    each = F.inline(F.array(*(F.struct(F.lit(name).alias("granularity"), key.alias("bucket")) for name, key in keys.items())))
    spread = rows.filter(is_a | is_b).select(is_a.alias("__a"), is_b.alias("__b"), each).filter(F.col("bucket").isNotNull())
    counted = spread.groupBy("granularity", "bucket").agg(F.count_if("__a").alias("n_b"), F.count_if("__b").alias("m_b"))
    return counted.filter("n_b > 0 and m_b > 0").withColumn("work", F.col("n_b") * F.col("m_b"))
