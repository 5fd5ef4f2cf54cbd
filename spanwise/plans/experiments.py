"""Experiments over bucket sizes: granularity sweeps, co-packing, grouping, orientation, predicate classes, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.operators.aggregates import percentiles
from spanwise.plans import cost

GAMMAS = (0, 1, 5, 15, 30)


def shapes(buckets: DataFrame) -> DataFrame:
    """(granularity, n_b, m_b, buckets): how many buckets have which sizes. What costs depend on, and far fewer rows than buckets."""
    return buckets.groupBy("granularity", "n_b", "m_b").agg(F.count("*").alias("buckets"))


def total(value: Column) -> Column:
    """A sum of whole numbers that no number of rows overflows."""
    return F.sum(value.cast("decimal(38,0)")).cast("decimal(38,0)")


def sweep(buckets: DataFrame, slots: tuple[int, ...], factors: tuple[float, ...], compare: float = cost.COMPARE, rotate: float = cost.ROTATE) -> DataFrame:
    """Comparisons, tiled and naive cost and speed-up for each granularity, vector size and factor on the comparison.

    Buckets are read once, as shapes; batches are summed for each vector size, and prices only enter the few sums.
    """
    inner, outer, s = F.least("n_b", "m_b"), F.greatest("n_b", "m_b"), F.col("slots")
    sized = shapes(buckets).withColumn("slots", F.explode(F.array(*(F.lit(x) for x in slots))))
    each = sized.select("granularity", "slots", "buckets", cost.batches(outer, inner, s).alias("batches"), (outer * cost.ceil_div(inner, s)).alias("vectors"))
    many = F.col("buckets").cast("decimal(19,0)")
    totals = each.groupBy("granularity", "slots").agg(*(total(F.col(c).cast("decimal(19,0)") * many).cast("long").alias(c) for c in ("batches", "vectors")))
    priced = totals.withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    price = F.col("factor") * compare
    priced = priced.withColumns({"comparisons": 2 * F.col("batches"), "tiled": 2 * F.col("batches") * price + F.col("batches") * (cost.REDUCE * rotate), "naive": 2 * F.col("vectors") * price})
    return priced.withColumn("speedup", F.try_divide("naive", "tiled")).drop("vectors")


def winners(swept: DataFrame) -> DataFrame:
    """The cheapest granularity of each cell of a sweep; the first by name of equals."""
    return swept.groupBy("slots", "factor").agg(F.min_by("granularity", F.struct("tiled", "granularity")).alias("granularity"), F.min("tiled").alias("tiled"))


def packing(buckets: DataFrame, slots: int, gammas: tuple[int, ...] = GAMMAS, compare: float = cost.COMPARE, rotate: float = cost.ROTATE) -> DataFrame:
    """Cost with buckets of fewer pairs than slots packed together, for each number of extra rotations a vector takes."""
    tiny = F.col("n_b") * F.col("m_b") < slots
    sums = cost.tiled(buckets, slots).groupBy("granularity").agg(
        F.count_if(tiny).alias("tiny"), F.count_if(~tiny).alias("large"),
        F.coalesce(total(F.when(tiny, F.col("n_b") * F.col("m_b"))).cast("long"), F.lit(0)).alias("tiny_pairs"),
        F.coalesce(total(F.when(~tiny, F.col("batches"))).cast("long"), F.lit(0)).alias("large_batches"),
    )
    each = sums.withColumn("gamma", F.explode(F.array(*map(F.lit, gammas)))).withColumn("packed", cost.ceil_div(F.col("tiny_pairs"), slots))
    large = 2 * F.col("large_batches") * F.lit(compare) + F.col("large_batches") * F.lit(cost.REDUCE * rotate)
    alone = F.col("tiny") * F.lit(2 * compare + cost.REDUCE * rotate)
    return each.withColumns({"cost_packed": F.col("packed") * (2 * compare + F.col("gamma") * rotate) + large, "cost_alone": alone + large})


def grouping(buckets: DataFrame, slots: int) -> DataFrame:
    """Vectors for tiny buckets if any may share one (greedy), or only those with the same smaller side (by shape)."""
    tiny = buckets.withColumns({"inner": F.least("n_b", "m_b"), "pairs": F.col("n_b") * F.col("m_b")}).filter(F.col("pairs") < slots)
    shapes = tiny.groupBy("granularity", "inner").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("buckets"))
    shapes = shapes.withColumn("vectors", cost.ceil_div(F.col("pairs"), slots))
    found = shapes.groupBy("granularity").agg(F.sum("pairs").alias("pairs"), F.sum("buckets").alias("buckets"), F.count("*").alias("shapes"), F.sum("vectors").alias("by_shape"))
    found = found.withColumn("greedy", cost.ceil_div(F.col("pairs"), slots))
    used = lambda c: F.col("pairs") / (F.col(c) * slots)
    return found.withColumns({"greedy_used": used("greedy"), "by_shape_used": used("by_shape"), "by_shape_padding": 1 - used("by_shape")})


def orientation_tail(buckets: DataFrame, slots: int, aspect: float = 2.0) -> DataFrame:
    """How much choosing the outer side matters for large, lopsided buckets: a row for each granularity.

    large counts buckets of at least `slots` pairs, lopsided those of them whose larger side is `aspect` times the smaller
    one; lopsided_work is their share of all pairs in per cent, flip_rate the share of them that are cheaper with B outside.
    speedup is the dearer by the cheaper side, speedup_weighted the cost with A outside by that with the better side outside.
    Without lopsided buckets speed-ups are 1 and the rest is 0.
    """
    pairs = F.col("n_b").cast("decimal(19,0)") * F.col("m_b").cast("decimal(19,0)")
    many = F.col("buckets")
    large = pairs >= slots
    both = cost.forced(shapes(buckets), slots).withColumns({"pairs": pairs * many, "large": large, "lop": large & (F.greatest("n_b", "m_b") >= aspect * F.least("n_b", "m_b"))})
    a, b = F.col("cost_a_outer"), F.col("cost_b_outer")
    worse, better, flip = F.greatest(a, b), F.least(a, b), b < a
    only = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    lop = F.col("lop")
    sums = both.groupBy("granularity").agg(
        only(F.col("large"), many).alias("large"), only(lop, many).alias("lopsided"),
        F.coalesce(F.try_divide(100 * only(lop, F.col("pairs")).cast("double"), F.sum("pairs").cast("double")), F.lit(0.0)).alias("lopsided_work"),
        F.coalesce(F.try_divide(only(lop & flip, many).cast("double"), only(lop, many).cast("double")), F.lit(0.0)).alias("flip_rate"),
        F.coalesce(F.try_divide(F.sum(F.when(lop, a * many)), F.sum(F.when(lop, better * many))), F.lit(1.0)).alias("speedup_weighted"),
        F.coalesce(F.max(F.when(lop, worse / better)), F.lit(1.0)).alias("speedup_max"),
        (only(lop & flip, (a - b) * many) / 3600).cast("double").alias("saved_hours"),
    )
    levels = both.filter(lop).groupBy("granularity", (worse / better).alias("speedup")).agg(F.sum(many).alias("n"))
    middle = percentiles(levels, "granularity", "speedup", {"speedup_median": 0.5, "speedup_p95": 0.95})
    return sums.join(middle, "granularity", "left").fillna(1.0, ["speedup_median", "speedup_p95"])


def crosscut(buckets: DataFrame, classes: int) -> DataFrame:
    """Classes that have nothing to do with size: by a hash of the bucket."""
    return buckets.withColumn("class", (F.conv(F.substring(F.md5(F.col("bucket").cast("string")), 1, 8), 16, 10).cast("long") % classes).cast("int"))


def aligned(buckets: DataFrame, classes: int) -> DataFrame:
    """Classes by rank of work, of equal numbers of buckets.

    Buckets of equal work follow each other by a hash and then by name. Ranks are counted in two steps, over (work, part of
    the hash) and within, so that neither all buckets nor the many with little work are sorted in one task.
    """
    salted = buckets.withColumn("__salt", F.substring(F.md5(F.col("bucket").cast("string")), 1, 3))
    total = buckets.groupBy("granularity").agg(F.count("*").alias("__all"))
    levels = salted.groupBy("granularity", "work", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("granularity").orderBy(F.desc("work"), "__salt").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("granularity", "work", "__salt").orderBy("bucket")
    ranked = salted.withColumn("__in", F.row_number().over(inside) - 1).join(levels, ["granularity", "work", "__salt"]).join(total, "granularity")
    rank = F.col("__before") + F.col("__in")
    return ranked.withColumn("class", F.least(F.lit(classes - 1), F.floor(rank * classes / F.col("__all"))).cast("int")).select(*buckets.columns, "class")


def proportional(buckets: DataFrame, shares: tuple[float, ...] = (0.3, 0.4, 0.3)) -> DataFrame:
    """Classes by lot with given shares; the lot is a hash of the bucket."""
    lot = F.conv(F.substring(F.md5(F.concat(F.lit("p"), F.col("bucket").cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    out, edge = F.lit(len(shares) - 1), 0.0
    for k in reversed(range(len(shares) - 1)):
        out = F.when(lot < round(sum(shares[: k + 1]), 9), k).otherwise(out)
    return buckets.withColumn("class", out.cast("int"))


def class_costs(classed: DataFrame, slots: int, gamma: int = 5) -> DataFrame:
    """The obvious partition: packed vectors and large batches of each class on its own, and the time they take. gamma: extra
    rotations of a packed vector."""
    tiny = F.col("n_b") * F.col("m_b") < slots
    sums = cost.tiled(classed, slots).groupBy("granularity", "class").agg(
        F.coalesce(total(F.when(tiny, F.col("n_b") * F.col("m_b"))).cast("long"), F.lit(0)).alias("tiny_pairs"),
        F.coalesce(total(F.when(~tiny, F.col("batches"))).cast("long"), F.lit(0)).alias("large_batches"),
    )
    made = sums.withColumn("packed", cost.ceil_div(F.col("tiny_pairs"), slots))
    each = F.lit(2 * cost.COMPARE + cost.REDUCE * cost.ROTATE)
    return made.withColumn("seconds", F.col("packed") * F.lit(2 * cost.COMPARE + gamma * cost.ROTATE) + F.col("large_batches") * each)


def merged_classes(costs: DataFrame, slots: int) -> DataFrame:
    """Vectors for tiny buckets by class, and after merging each class into the next where that saves one.

    A class's pool moves on if the two pools together need fewer vectors than apart. The fold runs over the few
    classes of a granularity, inside one expression.
    """
    pools = costs.groupBy("granularity").agg(F.transform(F.sort_array(F.collect_list(F.struct("class", "tiny_pairs"))), lambda x: x["tiny_pairs"]).alias("pools"))
    up = lambda x: F.floor((x + (slots - 1)) / slots)
    start = F.struct(F.lit(0).cast("long").alias("pool"), F.lit(0).cast("long").alias("vectors"), F.lit(0).cast("long").alias("merges"))

    def step(acc: Column, x: Column) -> Column:
        together = (acc["pool"] > 0) & (up(acc["pool"]) + up(x) > up(acc["pool"] + x))
        return F.struct(
            F.when(together, acc["pool"] + x).otherwise(x).cast("long").alias("pool"),
            F.when(together, acc["vectors"]).otherwise(acc["vectors"] + up(acc["pool"])).cast("long").alias("vectors"),
            (acc["merges"] + together.cast("long")).alias("merges"),
        )

    folded = pools.withColumn("f", F.aggregate("pools", start, step))
    return folded.select("granularity", F.size("pools").alias("classes"), F.aggregate(F.transform("pools", up), F.lit(0).cast("long"), lambda a, x: a + x).alias("apart"), (F.col("f.vectors") + up(F.col("f.pool"))).alias("merged"), F.col("f.merges").alias("merges"))


def merge_bound(classes: int, vectors: Column) -> dict[str, Column]:
    """What merging can save at most, as a share of all vectors: one vector for each merge, or each class."""
    return {"by_merges": (classes - 1) / vectors, "by_classes": classes / vectors}


def breakdown(buckets: DataFrame, slots: int) -> DataFrame:
    """Buckets and comparisons of tiny (fewer pairs than slots) and large buckets, and their share of a granularity's."""
    size = F.when(F.col("n_b") * F.col("m_b") < slots, "tiny").otherwise("large").alias("size")
    found = cost.tiled(buckets, slots).groupBy("granularity", size).agg(F.count("*").alias("buckets"), F.sum("comparisons").alias("comparisons"))
    return found.withColumn("share", F.col("comparisons") / F.sum("comparisons").over(Window.partitionBy("granularity")))


def leakage(spark: SparkSession, widths: tuple[int, ...], n: int = 100_000, days: int = 3650, delta: int = 30, slots: int = 32768, gamma: int = 5) -> DataFrame:
    """For blocks of `width` days over two evenly spread sides of n rows: n_blocks, rows and pairs of a block (rounded), regime,
    vectors, hours, leakage (the blocks that show), and the formula's bound on recall lost.

    A block without pairs is empty and costs nothing; blocks of fewer pairs than slots are packed together; all others are tiled
    one by one.
    """
    w, long = F.col("width"), lambda c: c.cast("long")
    rows = F.lit(n).cast("double") * w / F.lit(float(days))
    made = spark.createDataFrame([(x,) for x in widths], "width int")
    made = made.withColumns({"n_blocks": F.greatest(F.lit(1).cast("long"), cost.floor_div(F.lit(days).cast("long"), w.cast("long"))), "n_block": long(F.bround(rows)), "work": long(F.bround(rows * rows))})
    work, blocks = F.col("work"), F.col("n_blocks")
    regime = F.when(work == 0, "empty").when(work < slots, "tiny").otherwise("large")
    vectors = F.when(work == 0, 0).when(work < slots, cost.ceil_div(blocks * work, slots)).otherwise(blocks * cost.batches(F.col("n_block"), F.col("n_block"), slots))
    made = made.withColumns({"regime": regime, "vectors": long(vectors)})
    packed = F.col("vectors") * F.lit(2 * cost.COMPARE + gamma * cost.ROTATE)
    seconds = F.when(work == 0, 0.0).when(work < slots, packed).otherwise(cost.cost(F.col("vectors")))
    return made.withColumns({"hours": seconds / 3600, "leakage": blocks, "recall_loss_bound": F.least(F.lit(1.0), F.lit(2.0 * delta) / w)})


def plan_flips(levels: DataFrame) -> DataFrame:
    """Whether the regime is not the same at all levels."""
    return levels.agg(F.countDistinct("regime").alias("regimes"), (F.countDistinct("regime") > 1).alias("flips"))


#: Gap between groupings (per cent) below which grouping does not matter, and gain of orientation below which that is small.
SMALL_GAP, SMALL_GAIN = 5.0, 1.05


def decision(packed: DataFrame, grouped: DataFrame, tail: DataFrame, medium: str = "medium", fine: str = "fine") -> DataFrame:
    """One row: what the results of packing(), grouping() and orientation_tail() say together.

    The cheapest granularity with packing at gamma 0 and 15, and without packing, with their hours; the largest gap between
    grouping by shape and greedily, in per cent of the greedy comparisons; the best weighted gain of orientation and the most hours
    a granularity saves by it; and the scenario: 2 (a kernel only) if fine wins at gamma 0 while grouping and orientation matter
    little; else 1 (a planner) if medium wins at both gammas and orientation matters; else 3 (uncertain). Of equal costs the
    granularity first by name wins.
    """
    won = lambda name, value, gamma: [
        F.min_by(F.when(F.col("gamma") == gamma, F.col("granularity")), F.when(F.col("gamma") == gamma, F.struct(value, "granularity"))).alias(f"{name}_winner"),
        (F.min(F.when(F.col("gamma") == gamma, F.col(value))) / 3600).alias(f"{name}_hours"),
    ]
    costs = packed.agg(*won("g0", "cost_packed", 0), *won("g15", "cost_packed", 15), *won("unpacked", "cost_alone", 0))
    gap = F.when(F.col("greedy") > 0, (F.col("by_shape") - F.col("greedy")) / F.col("greedy") * 100)
    gaps = grouped.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("grouping_gap"))
    gains = tail.agg(F.max("speedup_weighted").alias("orientation_gain"), F.max("saved_hours").alias("orientation_hours"))
    one = costs.crossJoin(F.broadcast(gaps)).crossJoin(F.broadcast(gains))  # one row each
    trivial, small = F.col("grouping_gap") < SMALL_GAP, F.col("orientation_gain") < SMALL_GAIN
    swings = (F.col("g0_winner") != medium) | (F.col("g15_winner") != medium)
    scenario = F.when((F.col("g0_winner") == fine) & trivial & small, 2).when(~swings & ~small, 1).otherwise(3)
    return one.withColumn("scenario", scenario)


def measured(runs: DataFrame, slots: int, compare: float = cost.COMPARE) -> DataFrame:
    """For rows (n_b, m_b, wall): comparisons of the better orientation, the time that they alone predict, and measured by predicted."""
    made = cost.best_orientation(runs, slots).withColumn("comparisons", 2 * F.col("batches_best"))
    made = made.withColumn("predicted", F.col("comparisons") * F.lit(compare))
    return made.select(*runs.columns, "comparisons", "predicted", F.try_divide("wall", "predicted").alias("ratio"))


def scaling(runs: DataFrame) -> DataFrame:
    """For rows (workers, wall): speed-up over one worker, efficiency, and throughput an hour."""
    one = runs.filter(F.col("workers") == 1).agg(F.min("wall").alias("wall_1"))
    made = runs.crossJoin(F.broadcast(one))
    n = F.col("workers")
    return made.withColumns({"speedup": F.col("wall_1") / F.col("wall"), "efficiency": F.col("wall_1") / (n * F.col("wall")), "throughput": n * 3600 / F.col("wall")}).drop("wall_1")
