import datetime

import pytest
from pyspark.sql import functions as F

from spanwise.functions import predicates as p
from spanwise.functions import values
from spanwise.operators import aggregates as agg


def test_predicate_identities(spark):
    df = spark.createDataFrame([(a, b) for a in (None, 1, 2, 3) for b in (None, 1, 2, 3)], "a long, b long")
    for r in df.select("a", "b", p.lt("a", "b").alias("lt"), p.gt("b", "a").alias("gt"), p.lte("a", "b").alias("lte"), p.eq("a", "b").alias("eq"), p.gte("a", "b").alias("gte")).collect():
        if None in (r["a"], r["b"]):
            assert (r["lt"], r["gt"], r["lte"], r["eq"], r["gte"]) == (None,) * 5
        else:
            assert r["lt"] == r["gt"] == (r["a"] < r["b"]) and r["lte"] == (r["lt"] or r["eq"]) and r["gte"] == (not r["lt"])


def test_sets_and_ranges(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "a long")
    keep = lambda c: [r[0] for r in df.filter(c).collect()]
    assert keep(p.between("a", F.lit(1), F.lit(3))) == [1, 2, 3]
    assert keep(p.in_set("a", [3, 1, 3])) == [1, 3] and keep(p.in_set("a", [])) == []
    assert keep(p.band("a", F.lit(2), 1)) == [1, 2, 3] and keep(p.negated(p.in_set("a", [0]))) == [1, 2, 3, 4]
    assert keep(p.all_of()) == [0, 1, 2, 3, 4] and keep(p.any_of()) == []


def test_days(spark):
    days = [datetime.date(1994, 1, 1), datetime.date(2000, 1, 1), datetime.date(2004, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select(values.days_since_2000(F.col("d")), values.from_days_2000(values.days_since_2000(F.col("d")))).collect()
    assert [r[0] for r in rows] == [-2191, 0, 1520] and [r[1] for r in rows] == days


def test_modular(spark):
    r = spark.range(1).select(
        values.mod_p(F.lit(919106)).alias("m"), values.mod_signed(F.lit(65536)).alias("s"), values.mod_less(F.lit(10), F.lit(20)).alias("l"), values.mod_less(F.lit(0), F.lit(40000)).alias("w"),
        values.vector_rotate(F.array(*map(F.lit, range(5))), 7).alias("r"), values.vector_rotate(F.array(*map(F.lit, range(5))), -1).alias("q"), values.vector_sub(F.array(F.lit(1)), F.array(F.lit(2))).alias("d"),
        values.vector_rotate(F.array().cast("array<int>"), 3).alias("e"),
    ).first()
    assert (r["m"], r["s"], r["l"], r["w"]) == (1588, -1, True, False)
    assert r["r"] == [2, 3, 4, 0, 1] and r["q"] == [4, 0, 1, 2, 3] and r["d"] == [65536] and r["e"] == []


def test_domain_order_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("z", 1, 7)], "x string, y int, v long")
    rows = agg.group_by_domain(df, {"x": ["b", "a"], "y": [1, 2]}, {"n": F.count("*"), "s": F.sum("v")}).orderBy("domain_order").collect()
    assert [tuple(r) for r in rows] == [(0, "b", 1, 0, 0), (1, "b", 2, 0, 0), (2, "a", 1, 2, 11), (3, "a", 2, 0, 0)]


@pytest.mark.parametrize("rows", [[], [(0, 0)]])
def test_ratio_of_nothing(spark, rows):
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.agg(agg.sum_if(F.col("a") > 0, F.col("b")).alias("s")).first()[0] == 0
    assert df.select(agg.ratio(F.col("a"), F.col("b"))).collect() in ([], [(None,)])


def test_schemas_follow_the_files(spark, tmp_path):
    import time

    from spanwise.sources import tables

    def write(df):
        df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))

    write(spark.range(3))
    assert [tables.table(spark, str(tmp_path), "t").columns for _ in range(2)] == [["id"]] * 2
    time.sleep(1.1)
    write(spark.range(4).withColumnRenamed("id", "other"))
    assert tables.table(spark, str(tmp_path), "t").columns == ["other"] and tables.table(spark, str(tmp_path), "t").count() == 4
