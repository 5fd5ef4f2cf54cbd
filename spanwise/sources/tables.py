"""Tables of a data directory, with the columns that queries need and the data lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanwise.functions.values import cents

# Domains of the benchmark's enumerations.
SHIP_MODES = ["REG AIR", "AIR", "RAIL", "TRUCK", "MAIL", "FOB", "SHIP"]
SHIP_INSTRUCTIONS = ["DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN"]
CONTAINER_SIZES = ["SM", "LG", "MED", "JUMBO", "WRAP"]
CONTAINER_KINDS = ["CASE", "BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM"]


#: Schemas by path and the path's time of change, so that a table's footers are read once and not for every query.
_schemas: dict[str, tuple[int, StructType]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    changed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()
    if path in _schemas and _schemas[path][0] == changed:
        return spark.read.schema(_schemas[path][1]).parquet(path)
    read = spark.read.parquet(path)
    _schemas[path] = (changed, read.schema)
    return read


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with whole-number money, dates, and commit and receipt dates, ship mode and instructions from its keys."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "shipdate": day, "commitdate": F.date_add(day, ((key * 7 + line * 3) % 61 - 30).cast("int")),
            "receiptdate": F.date_add(day, (1 + (key * 5 + line) % 30).cast("int")),
            "shipmode": _pick(SHIP_MODES, (key + line) % 7), "shipinstruct": _pick(SHIP_INSTRUCTIONS, (F.col("l_partkey") + line) % 4),
            "price": cents(F.col("l_extendedprice")), "disc": cents(F.col("l_discount")), "tax": cents(F.col("l_tax")), "qty": F.col("l_quantity").cast("long"),
        }
    )


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with a container from its key."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").withColumn("container", F.concat_ws(" ", _pick(CONTAINER_SIZES, key % 5), _pick(CONTAINER_KINDS, F.floor(key / 5) % 8)))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("orderdate", F.col("o_orderdate").cast("date"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the day number since 1970 and a payload of 1 to 100 from the key."""
    return table(spark, sf_dir, "events").withColumns({"day": F.unix_date(F.col("ts").cast("date")), "payload": F.col("event_id") % 100 + 1})


def date_band(spark: SparkSession, n: int, step: int, name: str) -> DataFrame:
    """n rows with a day that walks through ten years by `step`, and a payload."""
    return spark.range(n).select((10000 + F.col("id") * step % 3650).alias(name), (F.col("id") % 100 + 1).alias(f"{name}_payload"))


def uniform_band(spark: SparkSession, n: int, name: str, seed: int = 42, values: int = 64) -> DataFrame:
    """n rows with a value from 0 to values-1 drawn at random, and a payload."""
    return spark.range(n).select(F.floor(F.rand(seed) * values).cast("long").alias(name), (F.col("id") % 100 + 1).alias(f"{name}_payload"))


def bucket_sizes(spark: SparkSession, path: str, granularity: str) -> DataFrame:
    """Bucket sizes from CSV files with the columns n_b and m_b."""
    read = spark.read.schema("n_b long, m_b long").option("header", True).option("enforceSchema", False).csv(path)
    return read.select(F.lit(granularity).alias("granularity"), "n_b", "m_b")


def zipf_exponent(buckets: int, most: float, total: float) -> float:
    """The exponent g for which the sum of most * k^-g over k = 1..buckets is total, by bisection on the sum's integral."""
    import math

    def integral(g: float) -> float:
        return math.log(buckets) + 0.5772156649 if abs(g - 1) < 1e-9 else 1 + (buckets ** (1 - g) - 1) / (1 - g)

    low, high = 1e-6, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if most * integral(middle) > total else (low, middle)
    return (low + high) / 2


def zipf_buckets(spark: SparkSession, granularity: str, buckets: int, total_pairs: float, most_n: int, most_m: int) -> DataFrame:
    """Bucket sizes that fall with rank as a power law, and whose products add up to about total_pairs."""
    half = zipf_exponent(buckets, float(most_n) * most_m, total_pairs) / 2
    size = lambda most: F.greatest(F.lit(1), F.round(most * F.pow(F.col("id"), F.lit(-half)))).cast("long")
    return spark.range(1, buckets + 1).select(F.lit(granularity).alias("granularity"), F.col("id").alias("bucket"), size(most_n).alias("n_b"), size(most_m).alias("m_b"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """One row of doubles from a text of key=value lines; lines without '=' are passed over."""
    pairs = spark.read.text(path).filter(F.contains("value", F.lit("="))).select(F.split("value", "=", 2).alias("kv"))
    cells = {r[0].strip(): float(r[1]) for r in pairs.select(F.col("kv")[0], F.col("kv")[1]).collect()}  # one row for each primitive
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"`{k}` double" for k in cells))


def write_calibration(row: dict[str, float], spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(f"{k}={v:.9f}",) for k, v in row.items()], "value string").coalesce(1).write.mode("overwrite").text(path)


# Columns of the results file, in order.
RESULT_COLUMNS = (
    "n_b m_b total_slots row_slots ct_mb gt_count dateband backend cmp_tot he_rot he_mul_ct he_mul_pt he_add_ct he_sub_ct "
    "wall_actual_s wall_extrap_s peak_cts peak_mem_mb correct sum_fhe sum_gt layout_cts work_cts mat_cts resident_cts"
).split()


def append_results(df: DataFrame, path: str) -> None:
    """Adds a run's results to a folder of CSV files with RESULT_COLUMNS; those that df has not are empty, others are an error."""
    if unknown := set(df.columns) - set(RESULT_COLUMNS):
        raise ValueError(f"no columns of the results file: {sorted(unknown)}")
    every = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS))
    every.write.mode("append").option("header", True).csv(path)
