"""Band joins: pairs of rows with abs(a - b) <= delta, within equal block keys if there are any.

Rows are never compared all against all. Values are cut into bins of 2 * delta + 1; a's rows go to the one or two bins
that the band around their value meets and b's rows to the bin of theirs, so a pair meets in just one bin and the join
is an equi-join on block keys and bin. A hot block is so dealt out over its bins.

For COUNT and SUM aggregates the rows need not meet at all: each side is first reduced to one row for each block and value
("histogram"), or both are, together, and sums over a range frame replace the join ("window"). Sides that are parts of
one table (band_within) are read in one pass by the latter, and each with its own filter in the scan by the others.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, HISTOGRAM, WINDOW, NESTED = "rows", "histogram", "window", "nested"
#: Rows for each distinct (block, value) from which reducing first pays.
DENSE = 2.0
#: Distinct values in a block up to which a range frame over the block is one task's work.
FRAME = 1_000_000


class Side(NamedTuple):
    """A side of the join: its rows, the column compared, and the one summed (1 for each row if none)."""

    rows: DataFrame
    value: str
    payload: str | None = None


def _sum(*factors: str) -> Column:
    """The sum of a product of counts or sums, as decimal(38,0), which no number of rows overflows; 0 of no rows."""
    product = F.col(factors[0]).cast("decimal(20,0)")
    for f in factors[1:]:
        product = (product * F.col(f).cast("decimal(18,0)")).cast("decimal(38,0)")
    return F.coalesce(F.sum(product), F.lit(0)).cast("decimal(38,0)")


def _side(side: Side, keys: list[str], in_a: bool) -> DataFrame:
    """k0, k1 ..., v, whether the row is a's and whether it is b's, and the payload as either."""
    payload = F.col(side.payload).cast("long") if side.payload else F.lit(1).cast("long")
    return side.rows.select(
        *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(side.value).cast("long").alias("v"),
        F.lit(in_a).alias("in_a"), F.lit(not in_a).alias("in_b"), payload.alias("pa"), payload.alias("pb"),
    )


def _aggregated(rows: DataFrame, n_keys: int, delta: int, strategy: str) -> DataFrame:
    """band_aggregate over the rows of _side, of both sides."""
    if delta < 0:
        raise ValueError("delta must not be negative")
    own = [f"k{i}" for i in range(n_keys)]
    out = lambda *c: [x.alias(n) for n, x in zip(("pairs", "sum_a", "sum_b"), c, strict=True)]
    known = rows.filter(" and ".join(f"{c} is not null" for c in ("v", *own)))
    if strategy in (ROWS, NESTED):
        left, right = known.filter("in_a").select(*own, F.col("v").alias("va"), "pa"), known.filter("in_b").select(*(F.col(k).alias(f"b{k}") for k in own), F.col("v").alias("vb"), "pb")
        on = F.abs(F.col("va") - F.col("vb")) <= delta if strategy == NESTED else F.col("va").between(F.col("vb") - delta, F.col("vb") + delta)
        for k in own:
            on = on & (F.col(k) == F.col(f"b{k}"))
        if strategy == ROWS:
            if not n_keys:
                raise ValueError("without block keys all rows of a bin would meet: reduce them first")
            left, right = _binned(left, right, "va", "vb", delta)
            on = on & (F.col("bin_a") == F.col("bin_b"))
        return left.join(right, on).agg(*out(F.count("*").cast("decimal(38,0)"), _sum("pa"), _sum("pb")))
    if strategy == HISTOGRAM:
        return _met(known, own, delta).agg(*out(_sum("na", "nb"), _sum("sa", "nb"), _sum("sb", "na")))
    if strategy == WINDOW:
        if not n_keys:
            raise ValueError("a range frame needs block keys: without them it is one task")
        both = known.groupBy(*own, "v").agg(
            F.count_if("in_a").alias("na"), F.sum(F.when(F.col("in_a"), F.col("pa"))).alias("sa"), F.count_if("in_b").alias("nb"), F.sum(F.when(F.col("in_b"), F.col("pb"))).alias("sb")
        )
        frame = Window.partitionBy(*own).orderBy("v").rangeBetween(-delta, delta)
        near = both.withColumns({"nb": F.sum("nb").over(frame), "sb": F.coalesce(F.sum("sb").over(frame), F.lit(0))}).filter("na > 0")
        return near.agg(*out(_sum("na", "nb"), _sum("sa", "nb"), _sum("sb", "na")))
    raise ValueError(f"unknown strategy {strategy!r}")


def _met(known: DataFrame, own: list[str], delta: int) -> DataFrame:
    """The values of both sides that are within the band, each with its rows (na, nb) and payload (sa, sb)."""
    left = known.filter("in_a").groupBy(*own, F.col("v").alias("va")).agg(F.count("*").alias("na"), F.sum("pa").alias("sa"))
    right = known.filter("in_b").groupBy(*(F.col(k).alias(f"b{k}") for k in own), F.col("v").alias("vb")).agg(F.count("*").alias("nb"), F.sum("pb").alias("sb"))
    left, right = _binned(left, right, "va", "vb", delta)
    on = (F.col("bin_a") == F.col("bin_b")) & F.col("va").between(F.col("vb") - delta, F.col("vb") + delta)
    for k in own:
        on = on & (F.col(k) == F.col(f"b{k}"))
    return left.join(right, on)


def _binned(left: DataFrame, right: DataFrame, va: str, vb: str, delta: int) -> tuple[DataFrame, DataFrame]:
    """left in the one or two bins that the bands of its values meet (bin_a), right in its values' own (bin_b)."""
    width = 2 * delta + 1
    first, last = F.floor((F.col(va) - delta) / width), F.floor((F.col(va) + delta) / width)
    return left.withColumn("bin_a", F.explode(F.sequence(first, last))), right.withColumn("bin_b", F.floor(F.col(vb) / width))


def band_pairs(a: DataFrame, b: DataFrame, a_value: str, b_value: str, delta: int, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """The pairs themselves, with the columns of both sides, whose names must differ. Null values and keys pair with nothing."""
    if delta < 0:
        raise ValueError("delta must not be negative")
    taken = {c.lower() for c in (*a.columns, *b.columns)}
    bin_a, bin_b = (next(n for n in (f"__{x}" + "_" * k for k in range(len(taken) + 1)) if n not in taken) for x in ("bin_a", "bin_b"))
    width = 2 * delta + 1
    value = F.col(a_value).cast("long")
    left = a.filter(F.col(a_value).isNotNull()).withColumn(bin_a, F.explode(F.sequence(F.floor((value - delta) / width), F.floor((value + delta) / width))))
    right = b.filter(F.col(b_value).isNotNull()).withColumn(bin_b, F.floor(F.col(b_value).cast("long") / width))
    on = F.col(bin_a) == F.col(bin_b)
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    pairs = left.join(right, on & F.col(a_value).between(F.col(b_value) - delta, F.col(b_value) + delta))
    return pairs.drop(bin_a, bin_b)


def band_aggregate(a: Side, b: Side, delta: int, a_keys: list[str] = (), b_keys: list[str] = (), strategy: str = HISTOGRAM) -> DataFrame:
    """One row: pairs, sum_a and sum_b (the payloads of a's and b's row, each summed over the pairs); 0 if there are none.

    Numbers are decimal(38,0). Null values and keys pair with nothing. Any strategy gives the same result; `rows` needs block
    keys. `nested` compares all rows with all and is only there to be measured against.
    """
    return _aggregated(_side(a, list(a_keys), True).unionByName(_side(b, list(b_keys), False)), len(a_keys), delta, strategy)


def _parts(rows: DataFrame, is_a: Column, is_b: Column, value: str, payload: str | None, keys: list[str] = ()) -> DataFrame:
    """As _side, of both sides, for two parts of one table."""
    held = F.col(payload).cast("long") if payload else F.lit(1).cast("long")
    return rows.filter(is_a | is_b).select(
        *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(value).cast("long").alias("v"),
        F.coalesce(is_a, F.lit(False)).alias("in_a"), F.coalesce(is_b, F.lit(False)).alias("in_b"), held.alias("pa"), held.alias("pb"),
    )


def band_within(
    rows: DataFrame, is_a: Column, is_b: Column, value: str, payload: str | None, delta: int, keys: list[str] = (), strategy: str = HISTOGRAM
) -> DataFrame:
    """band_aggregate of two parts of one table, told apart by is_a and is_b (a row may be in both)."""
    return _aggregated(_parts(rows, is_a, is_b, value, payload, keys), len(keys), delta, strategy)


def band_recall(rows: DataFrame, is_a: Column, is_b: Column, value: str, delta: int, block: Callable[[Column], Column]) -> DataFrame:
    """One row: all_pairs within the band, kept_pairs whose values have the same block, and recall_lost, the share of the others (null of
    no pairs). Histograms of both sides meet once."""
    met = _met(_parts(rows, is_a, is_b, value, None).filter(F.col("v").isNotNull()), [], delta)
    same = met.withColumn("kept", F.when(block(F.col("va")) == block(F.col("vb")), F.col("na")).otherwise(0))
    sums = same.agg(_sum("na", "nb").alias("all_pairs"), _sum("kept", "nb").alias("kept_pairs"))
    return sums.withColumn("recall_lost", 1 - F.try_divide(F.col("kept_pairs").cast("double"), F.col("all_pairs").cast("double")))


def statistics(a: Side, b: Side, a_keys: list[str] = (), b_keys: list[str] = ()) -> tuple[dict[str, int], dict[str, int]]:
    """Rows and (about) distinct block-value pairs of both sides, in one pass over each."""
    tagged = [side.rows.select(F.lit(k).alias("side"), F.struct(*(F.col(x).alias(f"k{i}") for i, x in enumerate(keys)), F.col(side.value).alias("v")).alias("at")) for k, (side, keys) in enumerate(((a, a_keys), (b, b_keys)))]
    rows = tagged[0].unionByName(tagged[1]).groupBy("side").agg(F.count("*"), F.approx_count_distinct("at")).collect()
    found = {r[0]: {"rows": r[1], "distinct": r[2]} for r in rows}
    return tuple(found.get(k, {"rows": 0, "distinct": 0}) for k in (0, 1))


def choose(a: dict[str, int], b: dict[str, int], blocked: bool, delta: int) -> str:
    """The strategy for sides with these statistics: reduce first if values repeat or there are no blocks; range frames only
    where a value meets so many others that a join of histograms would still make more rows than it reads."""
    rows, distinct = a["rows"] + b["rows"], max(1, a["distinct"] + b["distinct"])
    if blocked and rows < DENSE * distinct:
        return ROWS
    if blocked and delta >= 64 and distinct <= FRAME:
        return WINDOW
    return HISTOGRAM
