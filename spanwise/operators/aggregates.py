"""Aggregates, among them group-by over declared domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def total(value: Column) -> Column:
    """A sum of whole numbers as decimal(38,0), which no number of rows overflows."""
    return F.sum(value.cast("decimal(20,0)")).cast("decimal(38,0)")


def count_if(predicate: Column) -> Column:
    return F.count_if(predicate)


def sum_if(predicate: Column, value: Column) -> Column:
    """Sum of whole numbers where the predicate holds, as total(); 0 where it never does."""
    return F.coalesce(total(F.when(predicate, value)), F.lit(0).cast("decimal(38,0)"))


def average_parts(name: str, value: Column) -> list[Column]:
    """An average as its parts and their quotient."""
    return [total(value).alias(f"sum_{name}"), F.count(value).alias(f"count_{name}"), (total(value).cast("double") / F.count(value)).alias(f"avg_{name}")]


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percentiles(counted: DataFrame, key: str, value: str, shares: dict[str, float], width: int | None = None) -> DataFrame:
    """Exact, interpolated percentiles of each key's values, from rows (key, value, n) with distinct values: key and a column for each share.

    With a width, whole-number values are first counted in ranges of that width; only the values of the ranges that hold a wanted rank
    are then put in order, so no task orders all values of a key. Null values are left out.
    """
    known = counted.filter(F.col(value).isNotNull())
    size = known.groupBy(key).agg(F.sum("n").alias("size"))
    names = list(shares)
    place = F.explode(F.array(*(F.struct(F.lit(k).alias("share"), (F.lit(shares[name]) * (F.col("size") - 1)).alias("at")) for k, name in enumerate(names))))
    ranks = size.select(key, place.alias("p")).select(key, "p.*").withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at"))))
    ranks = ranks.select(key, "share", "at", "rank").distinct()
    if width:
        bucket = F.floor(F.col(value) / width)
        upto = Window.partitionBy(key).orderBy("bucket")
        coarse = known.groupBy(key, bucket.alias("bucket")).agg(F.sum("n").alias("n"))
        coarse = coarse.withColumn("to", F.sum("n").over(upto)).withColumn("from", F.col("to") - F.col("n")).drop("n")
        hit = coarse.join(ranks, key).filter("rank >= `from` and rank < `to`")
        hit = hit.groupBy(key, "bucket", "from").agg(F.collect_set("share"))  # at most two ranges for each share
        known = known.withColumn("bucket", bucket).join(hit.select(key, "bucket", "from"), [key, "bucket"])
        inner = Window.partitionBy(key, "bucket").orderBy(value)
        ordered = known.withColumn("to", F.col("from") + F.sum("n").over(inner))
    else:
        ordered = known.withColumn("to", F.sum("n").over(Window.partitionBy(key).orderBy(value)))
    ordered = ordered.select(key, F.col(value).cast("double").alias("v"), (F.col("to") - F.col("n")).alias("first"), F.col("to").alias("last"))
    found = ordered.join(ranks, key).filter("rank >= first and rank < last")
    ends = found.groupBy(key, "share", "at").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    mixed = F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo"))
    return ends.groupBy(key).agg(*(F.max(F.when(F.col("share") == k, mixed)).alias(name) for k, name in enumerate(names)))


def domain(spark: SparkSession, values: dict[str, Sequence]) -> DataFrame:
    """Every combination of the declared values, in order, the last column fastest; `domain_order` counts them from 0."""
    rows: list[tuple] = [()]
    for column in values.values():
        rows = [(*r, v) for r in rows for v in column]
    if not rows:
        raise ValueError("every declared column needs a value")
    names = list(values)
    literals = [F.struct(F.lit(k).cast("long").alias("domain_order"), *(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for k, r in enumerate(rows)]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*literals)))


def group_by_domain(df: DataFrame, values: dict[str, Sequence], aggregates: dict[str, Column]) -> DataFrame:
    """Groups over declared values: each combination has a row, with 0 where nothing falls in it; other values drop out.

    Aggregates must be sums or counts. The declared domain is a literal of the query, so broadcasting it is safe.
    """
    keys = list(values)
    grouped = df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    # the groups of declared values are at most as many as the domain
    declared = F.broadcast(domain(df.sparkSession, values))
    hit = grouped.join(declared, keys, "left_semi")
    joined = declared.join(hit, keys, "left")
    return joined.select("domain_order", *keys, *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in aggregates))
