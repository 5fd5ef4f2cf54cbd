import random

import pytest
from pyspark.sql import functions as F

from spanwise.operators import aggregates as agg
from spanwise.operators import bandjoin as bj
from spanwise.sources import tables

#: Pairs, sum of the first payload, sum of the second, for n and m rows of the date fixture with a band of 30 days.
GOLDEN = {(8, 6): (36, 166, 123), (32, 32): (172, 2913, 1925), (256, 512): (2828, 129625, 140371), (512, 256): (2224, 111908, 101855), (1974, 1028): (33814, 1694135, 1672179)}


@pytest.mark.parametrize("strategy", [bj.NESTED, bj.HISTOGRAM])
@pytest.mark.parametrize("n,m", GOLDEN)
def test_golden(spark, n, m, strategy):
    a, b = bj.Side(tables.date_band(spark, n, 7, "x"), "x", "x_payload"), bj.Side(tables.date_band(spark, m, 11, "y"), "y", "y_payload")
    assert tuple(bj.band_aggregate(a, b, 30, strategy=strategy).first()) == GOLDEN[n, m]


@pytest.mark.parametrize("seed", range(4))
def test_strategies_agree(spark, seed):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.1 else v
    make = lambda n: [(maybe(rng.randrange(3)), maybe(rng.randint(-40, 40)), rng.randint(1, 9)) for _ in range(n)]
    rows_a, rows_b, delta = make(120), make(90), rng.choice([0, 1, 7])
    a = bj.Side(spark.createDataFrame(rows_a, "k long, v long, p long"), "v", "p")
    b = bj.Side(spark.createDataFrame(rows_b, "k long, v long, p long"), "v", "p")
    met = [(x, y) for x in rows_a for y in rows_b if None not in (x[0], x[1], y[0], y[1]) and x[0] == y[0] and abs(x[1] - y[1]) <= delta]
    want = (len(met), sum(x[2] for x, _ in met), sum(y[2] for _, y in met))
    for strategy in (bj.ROWS, bj.HISTOGRAM, bj.WINDOW, bj.NESTED):
        assert tuple(bj.band_aggregate(a, b, delta, ["k"], ["k"], strategy).first()) == want, strategy
    both = a.rows.withColumn("s", F.lit("a")).unionByName(b.rows.withColumn("s", F.lit("b")))
    for strategy in (bj.ROWS, bj.HISTOGRAM, bj.WINDOW, bj.NESTED):
        assert tuple(bj.band_within(both, F.col("s") == "a", F.col("s") == "b", "v", "p", delta, ["k"], strategy).first()) == want, strategy


def test_band_ends_belong(spark):
    a, b = spark.createDataFrame([(0, 10)], "i long, x long"), spark.createDataFrame([(j, j) for j in range(30)], "j long, y long")
    assert sorted(r["y"] for r in bj.band_pairs(a, b, "x", "y", 4).collect()) == list(range(6, 15))


def test_empty_side_and_bad_band(spark):
    a = bj.Side(spark.createDataFrame([], "x long"), "x")
    b = bj.Side(spark.createDataFrame([(1,)], "x long"), "x")
    for strategy in (bj.HISTOGRAM, bj.NESTED):
        assert tuple(bj.band_aggregate(a, b, 1, strategy=strategy).first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        bj.band_aggregate(a, b, 1, strategy=bj.ROWS)
    with pytest.raises(ValueError):
        bj.band_aggregate(a, b, -1)
    with pytest.raises(ValueError):
        bj.band_aggregate(a, b, 1, strategy=bj.WINDOW)


def test_no_nested_loop(spark):
    a, b = tables.date_band(spark, 100, 7, "x"), tables.date_band(spark, 100, 11, "y")
    for df in (bj.band_pairs(a, b, "x", "y", 30), bj.band_aggregate(bj.Side(a, "x"), bj.Side(b, "y"), 30)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_choice():
    few, many = {"rows": 1000, "distinct": 900}, {"rows": 100_000, "distinct": 900}
    assert bj.choose(few, few, True, 3) == bj.ROWS and bj.choose(few, few, False, 3) == bj.HISTOGRAM
    assert bj.choose(many, many, False, 300) == bj.HISTOGRAM
    assert bj.choose(many, many, True, 300) == bj.WINDOW


def test_sums_beyond_a_long(spark):
    """Histograms with counts near 2^31 on both sides: pairs near 2^62, and sums beyond 2^63."""
    big = 1 << 31
    counted = spark.createDataFrame([(0, big, big * 50, big, big * 60)], "v long, na long, sa long, nb long, sb long")
    row = counted.agg(bj._sum("na", "nb").alias("pairs"), bj._sum("sa", "nb").alias("sum_a")).first()
    assert row["pairs"] == 1 << 62 and row["sum_a"] == 50 << 62
    near = spark.createDataFrame([((1 << 62) + k,) for k in range(3)], "x long")
    assert near.agg(agg.total(F.col("x"))).first()[0] == (3 << 62) + 3
    side = bj.Side(spark.createDataFrame([(1, (1 << 62) + 1)] * 3, "v long, p long"), "v", "p")
    with pytest.raises(Exception, match="OVERFLOW"):  # of one block and value a sum is a long still
        bj.band_aggregate(side, side, 1).collect()


def test_one_table_is_read_once(spark, sf_dir):
    from spanwise import registry

    for name, scans in (("bj_window", 1), ("bj_global_hist", 2), ("bj_block_hist", 2)):
        df = registry.QUERIES[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == scans and (scans == 1 or "EqualTo(event_type,click)" in plan), plan


def test_statistics(spark):
    a = bj.Side(spark.createDataFrame([(1, 1), (1, 1), (2, 5)], "k long, v long"), "v")
    b = bj.Side(spark.createDataFrame([], "j long, w long"), "w")
    assert bj.statistics(a, b, ["k"], ["j"]) == ({"rows": 3, "distinct": 2}, {"rows": 0, "distinct": 0})


def test_clashing_names(spark):
    a, b = spark.createDataFrame([(5, 7)], "x long, __bin_a long"), spark.createDataFrame([(6, 8)], "y long, __bin_b long")
    assert [tuple(r) for r in bj.band_pairs(a, b, "x", "y", 1).collect()] == [(5, 7, 6, 8)]


def test_recall_of_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, *range(40)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "s string, v long")
    met = [(x, y) for s, x in rows for t, y in rows if s == "a" and t == "b" and None not in (x, y) and abs(x - y) <= 3]
    kept = sum(x // 7 == y // 7 for x, y in met)
    r = bj.band_recall(df, F.col("s") == "a", F.col("s") == "b", "v", 3, lambda v: F.floor(v / 7)).first()
    assert (r["all_pairs"], r["kept_pairs"]) == (len(met), kept) and r["recall_lost"] == pytest.approx(1 - kept / len(met))
    none = bj.band_recall(df, F.col("s") == "x", F.col("s") == "b", "v", 3, lambda v: v).first()
    assert tuple(none) == (0, 0, None)
