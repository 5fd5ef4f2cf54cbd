"""Mixing sources to target weights by nested hash thresholds.

Every document has a fixed hash. A source whose target is k times its size and a rest is taken k times whole, and
documents whose hash lies under the source's threshold once more. The threshold is found from histograms: sizes are
summed by source and hash bucket, the bucket in which the budget runs out is the boundary, and only that bucket is
divided again. No document is sorted or moved. A larger budget has a higher threshold, so mixes are nested.

Sources may be as many as hosts of the web: they stay a table. Their order and the filling of targets are prefix sums over
sorted partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm import common

#: Bits of the hash, and bits that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
#: Weights of the sources by code point, repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more often than this.
MOST = 3
#: Sources up to which their table is broadcast; more are joined by a shuffle.
FEW_SOURCES = 100_000


def n_words(text_col: str) -> Column:
    """Words of a text: runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(id_col: str, seed: str) -> Column:
    """The first 60 bits of the MD5 of seed and id; equal ids, and all null ids, share theirs."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df, stored in this order, with the sums over all rows before each, by name.

    Rows are sorted into partitions by range. Only sums by partition, as many rows as there are partitions, meet in one task.
    """
    placed = df.withColumns({f"__{k}": c.cast("decimal(38,0)") for k, c in sums.items()}).orderBy(*order)
    placed = common.stored(placed.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}), "sorted")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    parts = placed.groupBy("__part").agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums))
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__{k}").over(before), zero).alias(f"__to_{k}") for k in sums))
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(F.broadcast(parts), "__part")  # a row for each partition
    return found.select(*df.columns, *((F.col(f"__to_{k}") + F.coalesce(F.sum(f"__{k}").over(inside), zero)).cast("decimal(38,0)").alias(k) for k in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Stored (source, size, target) for rows (source, size): shares of all sizes by weights that repeat in the order of the
    sources (null last), none above `most` times its size; what is over is shared again by weight.

    In the order of most * size / weight, sources are filled as long as what is left gives them that much; once one is not,
    none after it is, and these share the rest.
    """
    ranked = prefix_sums(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("decimal(38,0)")).withColumn("full", (most * F.col("size")).cast("decimal(38,0)"))
    weighed = common.stored(weighed, "weighed")
    whole = weighed.agg(F.sum("size").cast("decimal(38,0)").alias("total"), F.sum("weight").cast("decimal(38,0)").alias("weights"))
    filled = prefix_sums(weighed, [(F.col("full").cast("double") / F.col("weight").cast("double")), F.col("rank")], {"given": F.col("full"), "heavy": F.col("weight")})
    filled = filled.crossJoin(F.broadcast(whole))  # one row
    filled = filled.withColumns({"rest": (F.col("total") - F.col("given")).cast("decimal(38,0)"), "left": (F.col("weights") - F.col("heavy")).cast("decimal(38,0)")})
    short = F.col("full").cast("decimal(20,0)") * F.col("left").cast("decimal(18,0)") > F.col("rest").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")
    order = F.struct(F.col("full").cast("double") / F.col("weight").cast("double"), "rank")
    filled = common.stored(filled.withColumns({"short": short, "order": order}), "filled")
    edge = filled.filter("short").agg(F.min("order").alias("edge"), F.min_by("rest", "order").alias("edge_rest"), F.min_by("left", "order").alias("edge_left"))
    share = (F.col("edge_rest") * F.col("weight")).cast("double") / F.col("edge_left").cast("double")
    target = F.when(F.col("edge").isNull() | (F.col("order") < F.col("edge")), F.col("full").cast("double")).otherwise(share)
    return common.stored(filled.crossJoin(F.broadcast(edge)).select("source", "size", target.alias("target")), "targets")  # one row


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table of sources, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= (FEW_SOURCES if most is None else most) else df


def thresholds(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(light, cuts): the stored id, source, size and hash of each document; and for each source (source) its source_size, target,
    whole copies, cut, and how many words the documents at the cut have (tied) and give."""
    light = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), hashed(id_col, seed).alias("hash"))
    light = common.stored(light, "mix")
    sizes = common.stored(light.groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    copies = F.when(F.col("size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("size")))).otherwise(0).cast("long")
    plan = targets(sizes, weights, most).withColumn("copies", copies)
    plan = plan.withColumn("budget", F.least("size", F.floor(F.col("target") - F.col("copies") * F.col("size") + 0.5)).cast("long"))
    plan = common.stored(plan.select("source", F.col("size").alias("source_size"), "target", "copies", "budget"), "plan")
    state, shift = few(common.stored(plan.filter("budget > 0").select(F.col("source").alias("of"), "budget", F.lit(0).cast("long").alias("prefix")), "open")), HASH_BITS
    inside, done = light.filter("size > 0").select("source", "size", "hash"), []
    while shift:
        here = (F.shiftright("hash", shift) == F.col("prefix")) if shift < HASH_BITS else F.lit(True)
        inside = inside.join(state, F.col("source").eqNullSafe(F.col("of"))).filter(here).select("source", "size", "hash", "budget")
        if shift < HASH_BITS:  # of the boundary buckets only
            inside = common.stored(inside, "inside")
        shift -= LEVEL_BITS
        bucket = inside.groupBy("source", "budget", F.shiftright("hash", shift).alias("b"))
        bucket = bucket.agg(F.sum("size").alias("sum"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        to = F.sum("sum").over(Window.partitionBy("source").orderBy("b"))
        edges = bucket.withColumn("to", to).filter("to > budget and to - sum <= budget")  # one for each source at most
        edges = common.stored(edges.select(F.col("source").alias("of"), "b", "sum", "lo", "hi", (F.col("budget") - F.col("to") + F.col("sum")).alias("left")), "edges")
        done.append(edges.filter("lo = hi").select("of", F.col("lo").alias("cut"), F.col("sum").alias("tied"), F.col("left").alias("give")))
        more = edges.filter("lo < hi").select("of", F.col("left").alias("budget"), F.col("b").alias("prefix"))
        if not shift or more.isEmpty():
            break
        state, inside = few(more), inside.select("source", "size", "hash")
    cuts = plan.join(reduce(DataFrame.unionByName, done), F.col("source").eqNullSafe(F.col("of")), "left")
    all_of_it = F.when(F.col("budget") > 0, F.lit(1 << HASH_BITS)).otherwise(0)  # no bucket in which the budget runs out
    zero = F.lit(0).cast("long")
    cuts = cuts.select("source", "source_size", "target", "copies", F.coalesce("cut", all_of_it).alias("cut"), F.coalesce("tied", zero).alias("tied"), F.coalesce("give", zero).alias("give"))
    return light, common.stored(cuts, "cuts")


def mix_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = "", weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """How many words the mix takes of each document: id_col, size, source_size, target and taken.

    The document at a source's threshold gives just the words that are missing, so a source's words differ from its
    target by less than one, and by less than one for each document where several share that hash (repeated rows and
    null ids do). Documents without words give 0; a source without words has target 0; an empty table gives no rows.
    """
    light, cuts = thresholds(docs, id_col, text_col, source_col, seed, weights, most)
    part = F.when(F.col("hash") < F.col("cut"), F.col("size")).when((F.col("hash") == F.col("cut")) & (F.col("tied") > 0), F.expr("(size * give) div tied"))
    found = light.join(few(cuts.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    taken = F.col("copies") * F.col("size") + F.coalesce(part, F.lit(0))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = "", weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """The mixed corpus: whole documents, repeated as often as the mix takes them, with the columns of docs.

    Documents at a source's threshold are taken if that comes nearer to the target. Documents without words, null texts
    among them, follow the copies of their source and their hash like any other; null ids share a hash, null sources are
    a source, repeated rows are each taken, an empty table gives no rows. No document moves between tasks unless there
    are more than FEW_SOURCES sources.
    """
    _, cuts = thresholds(docs, id_col, text_col, source_col, seed, weights, most)
    own = {c: common.free_name(docs, c) for c in (*cuts.columns, "hash", "times", "copy")}
    col = {c: F.col(name) for c, name in own.items()}
    cuts = cuts.select(*(F.col(c).alias(own[c]) for c in cuts.columns))
    more = (col["hash"] < col["cut"]) | ((col["hash"] == col["cut"]) & (2 * col["give"] >= col["tied"]) & (col["tied"] > 0))
    marked = docs.withColumn(own["hash"], hashed(id_col, seed)).join(few(cuts), F.col(source_col).eqNullSafe(col["source"]))
    repeated = marked.withColumn(own["times"], (col["copies"] + more.cast("int")).cast("int")).filter(col["times"] > 0)
    return repeated.withColumn(own["copy"], F.explode(F.sequence(F.lit(1), col["times"]))).select(*docs.columns)
