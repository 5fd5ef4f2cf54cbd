"""What the text operators share: the shared folder, tables that cut lineage, and Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.session import session_dir, shared_dir  # noqa: F401

#: Rows an Arrow batch may hold. Long texts make few-row batches heavy, so it is far below Spark's default.
BATCH_ROWS = 512
#: Bytes an Arrow batch may hold, where this Spark version knows the setting.
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Sets the Arrow batch limits that keep Python workers small whatever the length of texts."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        spark.conf.set(key, str(value))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name, from stem, that df does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    Later jobs start from the table, so a lost executor costs only the tasks it was running, and what was
    decided (row numbers, partition ids) cannot come out differently when a stage runs again.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_batches(
    df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str
) -> DataFrame:
    """Runs fn over the Arrow batches of the named columns; fn yields a dict of lists or arrays for each output batch.

    Only `columns` reach Python, so extra columns cost nothing and cannot clash with what the operator adds.
    """
    prepare(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in fn(batches):
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(k).type) for k, v in made.items()]
            yield pa.RecordBatch.from_arrays([a.cast(arrow.field(k).type) if a.type != arrow.field(k).type else a for k, a in zip(made, arrays, strict=True)], schema=pa.schema([arrow.field(k) for k in made]))

    return df.select(*columns).mapInArrow(run, out)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


#: A key is hot if it has more than one in so many of the rows; there are fewer such keys than this.
HOT_SHARE = 1000


def split_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of two stored tables on a key of which a few values may hold most of left's rows; right has a key once.

    Keys with more than 1/HOT_SHARE of left's rows are fewer than HOT_SHARE at any size, so their right rows are
    broadcast. All others are joined by a shuffle in which no key can weigh much.
    """
    total = left.count()
    hot = [r[0] for r in left.groupBy(key).count().filter((F.col("count") > total / HOT_SHARE) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(right, key, "left")
    chosen = F.col(key).isin(hot)
    warm = left.filter(chosen).join(F.broadcast(right.filter(chosen)), key, "left")
    return warm.unionByName(left.filter(~chosen | F.col(key).isNull()).join(right.filter(~chosen), key, "left"))


def clear(spark: SparkSession) -> None:
    """Deletes this session's intermediate tables in the shared folder. DataFrames that read them can't be used any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
