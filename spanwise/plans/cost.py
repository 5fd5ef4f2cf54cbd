"""What a bucket costs: comparisons, rotations, memory and time, for each way of laying it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a comparison and of a rotation, and rotations in a reduction.
COMPARE, ROTATE, REDUCE = 175.0, 0.112, 15
#: Stands for a layout that does not fit.
INFEASIBLE = 1 << 62


def _column(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def floor_div(a: Column | int, b: Column | int) -> Column:
    """Whole-number division, exact for all longs (and decimals without a fraction); a and b are not negative."""
    return F.call_function("div", _column(a), _column(b))


def ceil_div(a: Column | int, b: Column | int) -> Column:
    a, b = _column(a), _column(b)
    return floor_div(a, b) + (a % b > 0).cast("long")


def batches(outer: Column, inner: Column, slots: Column | int) -> Column:
    """Vectors that the outer side fills when the inner side is repeated as often as fits, once at least."""
    return ceil_div(outer, 2 * F.greatest(F.lit(1).cast("long"), floor_div(floor_div(slots, 2), inner)))


def feasible_batches(outer: Column, inner: Column, slots: int) -> Column:
    """The same, but INFEASIBLE if the inner side is longer than a row."""
    return F.when(inner > slots // 2, F.lit(INFEASIBLE)).otherwise(batches(outer, inner, slots))


def tiled(df: DataFrame, slots: int, compare: float = COMPARE, rotate: float = ROTATE) -> DataFrame:
    """Adds inner, outer, batches, comparisons, cost_minmax (the smaller side inside) and feasible."""
    inner, outer = F.least("n_b", "m_b"), F.greatest("n_b", "m_b")
    made = df.withColumns({"inner": inner, "outer": outer}).withColumn("batches", batches(F.col("outer"), F.col("inner"), slots))
    made = made.withColumn("comparisons", 2 * F.col("batches"))
    return made.withColumns({"cost_minmax": cost(F.col("batches"), compare, rotate), "feasible": F.col("inner") <= slots // 2})


def cost(n_batches: Column, compare: float = COMPARE, rotate: float = ROTATE) -> Column:
    """Two comparisons and one reduction a batch."""
    return 2 * n_batches * F.lit(compare) + REDUCE * F.lit(rotate) * n_batches


def forced(df: DataFrame, slots: int, compare: float = COMPARE, rotate: float = ROTATE) -> DataFrame:
    """Adds cost_a_outer and cost_b_outer."""
    return df.withColumns({"cost_a_outer": cost(batches(F.col("n_b"), F.col("m_b"), slots), compare, rotate), "cost_b_outer": cost(batches(F.col("m_b"), F.col("n_b"), slots), compare, rotate)})


def best_orientation(df: DataFrame, slots: int) -> DataFrame:
    """Adds outer_side, batches_best and cost_best_orientation: sides are swapped only where that saves batches."""
    a, b = feasible_batches(F.col("n_b"), F.col("m_b"), slots), feasible_batches(F.col("m_b"), F.col("n_b"), slots)
    made = df.withColumns({"outer_side": F.when(b < a, "B").otherwise("A"), "batches_best": F.least(a, b)})
    return made.withColumn("cost_best_orientation", F.when(F.col("batches_best") < INFEASIBLE, cost(F.col("batches_best"))))


def naive_cost(df: DataFrame, slots: int, compare: float = COMPARE) -> DataFrame:
    """Adds cost_naive: every outer row against every vector of the inner side, without reductions."""
    return df.withColumn("cost_naive", 2 * F.greatest("n_b", "m_b") * ceil_div(F.least("n_b", "m_b"), slots) * F.lit(compare))


def log2_up(x: Column) -> Column:
    """Least k with 2^k >= x, exact for whole numbers."""
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1))).cast("long")


def operations(outer: Column, inner: Column, slots: int) -> dict[str, Column]:
    """Counts for one vector of the outer value repeated against each vector of the inner side.

    An outer value is replicated (log2 of the slots, and one, rotations and additions). Each inner vector takes two
    comparisons and a product, one plain product more if it is not full, and a reduction over its own length.
    """
    whole, part = floor_div(inner, slots), inner % slots
    chunks = whole + (part > 0).cast("long")
    spread = (slots - 1).bit_length() + 1
    reduced = whole * spread + F.when(part > 0, log2_up(part) + 1).otherwise(0)
    turns = outer * (spread + reduced)
    return {"comparisons": 2 * outer * chunks, "products": outer * chunks, "plain_products": outer * (part > 0).cast("long"), "rotations": turns, "additions": turns}


def naive_counts(df: DataFrame, slots: int) -> DataFrame:
    """Adds the operation counts of the naive layout (A outside) and of the fixed one (the smaller side outside)."""
    for name, outer, inner in (("naive", F.col("n_b"), F.col("m_b")), ("fixed", F.least("n_b", "m_b"), F.greatest("n_b", "m_b"))):
        df = df.withColumns({f"{name}_{k}": c.cast("long") for k, c in operations(outer, inner, slots).items()})
    return df


def seconds(df: DataFrame, prefix: str, prices: dict[str, float]) -> Column:
    """Time as the sum of counts by price; counts are columns prefix_name."""
    total = F.lit(0.0)
    for name, price in prices.items():
        total = total + F.col(f"{prefix}_{name}") * F.lit(price)
    return total


def memory(df: DataFrame, slots: int) -> DataFrame:
    """Adds vectors held by each layout: naive, fixed, tiled (all batches kept) and fused (one at a time). Those of the last two
    are null where neither side fits a row."""
    inner, outer = F.least("n_b", "m_b"), F.greatest("n_b", "m_b")
    least = F.least(feasible_batches(F.col("n_b"), F.col("m_b"), slots), feasible_batches(F.col("m_b"), F.col("n_b"), slots))
    n = F.when(least < INFEASIBLE, least)
    layout = {"naive": F.col("n_b") + ceil_div(F.col("m_b"), slots), "fixed": inner + ceil_div(outer, slots), "tiled": 1 + n, "fused": 1 + n}
    work = {"naive": F.lit(6), "fixed": F.lit(6), "tiled": 6 + n, "fused": F.when(n.isNotNull(), 6)}
    return df.withColumns({f"{k}_layout": layout[k] for k in layout} | {f"{k}_work": work[k] for k in work} | {f"{k}_resident": layout[k] + work[k] for k in layout})


def gate(speedup: Column) -> Column:
    """A word for a speed-up."""
    return F.when(speedup >= 20, "STRONG").when(speedup >= 10, "GOOD").when(speedup >= 5, "OK").when(speedup >= 2, "MARGINAL").otherwise("WEAK")


def rotation_steps(slots: int) -> list[int]:
    """0 and the powers of two below half the slots: the rotations a reduction needs."""
    return [0, *(1 << k for k in range((slots // 2).bit_length() - 1))]
