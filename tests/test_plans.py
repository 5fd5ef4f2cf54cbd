import pytest
from pyspark.sql import functions as F

from spanwise.plans import cost, experiments
from spanwise.sources import tables

S = 32768


def one(spark, n, m):
    return spark.createDataFrame([("g", "b", n, m, n * m)], "granularity string, bucket string, n_b long, m_b long, work long")


@pytest.mark.parametrize("n,m,comparisons,naive,fixed,naive_turns,fixed_turns", [(256, 512, 8, 512, 512, 6656, 6656), (512, 256, 8, 1024, 512, 12800, 6656), (1974, 1028, 130, 3948, 2056, 55272, 28784)])
def test_published_counts(spark, n, m, comparisons, naive, fixed, naive_turns, fixed_turns):
    made = cost.best_orientation(cost.naive_counts(one(spark, n, m), S), S).first()
    assert 2 * made["batches_best"] == comparisons
    assert (made["naive_comparisons"], made["fixed_comparisons"], made["naive_rotations"], made["fixed_rotations"]) == (naive, fixed, naive_turns, fixed_turns)


def test_orientation_follows_batches(spark):
    assert cost.best_orientation(one(spark, 1974, 1028), S).first()["outer_side"] == "B"
    assert cost.best_orientation(one(spark, 256, 512), S).first()["outer_side"] == "A"
    assert cost.tiled(one(spark, 1974, 1028), S).first()["batches"] == 66
    assert cost.tiled(one(spark, 20000, 20000), S).first()["feasible"] is False
    assert cost.best_orientation(one(spark, 20000, 20000), S).first()["cost_best_orientation"] is None


def test_published_seconds(spark):
    prices = {"comparisons": 174.972667795, "rotations": 0.111914570, "products": 0.351767512, "plain_products": 0.001065108, "additions": 0.000702634}
    made = cost.naive_counts(one(spark, 256, 512), S)
    assert abs(made.select(cost.seconds(made, "naive", prices)).first()[0] - 90425.9) < 5


def test_memory(spark):
    none = cost.memory(one(spark, 20_000, 20_000), S).first()
    assert none["naive_resident"] == 20_007 and none["fixed_resident"] == 20_007 and none["tiled_resident"] is None and none["fused_resident"] is None
    made = cost.memory(one(spark, 1974, 1028), S).first()
    assert made["tiled_resident"] == 1 + 65 + 6 + 65 and made["naive_resident"] == 1974 + 1 + 6


def test_leakage(spark):
    """Against the published frontier."""
    rows = {r["width"]: r for r in experiments.leakage(spark, (3650, 7, 1)).collect()}
    assert [(rows[w]["n_blocks"], rows[w]["n_block"], rows[w]["work"], rows[w]["regime"]) for w in (3650, 7, 1)] == [(1, 100_000, 10**10, "large"), (521, 192, 36_780, "large"), (3650, 27, 751, "tiny")]
    assert [round(rows[w]["hours"], 1) for w in (3650, 7, 1)] == [4884.4, 101.8, 8.2] and [rows[w]["leakage"] for w in (3650, 7, 1)] == [1, 521, 3650]
    assert [round(rows[w]["recall_loss_bound"], 4) for w in (3650, 7, 1)] == [0.0164, 1.0, 1.0]
    empty = experiments.leakage(spark, (1,), n=100).first()
    assert (empty["regime"], empty["vectors"], empty["hours"]) == ("empty", 0, 0.0)


def test_published_packing(spark):
    """Totals of tiny pairs as published; one large bucket beside them."""
    want = {"coarse": (25_708, 1), "medium": (269_901_954, 8237), "fine": (102_058_747, 3115)}
    rows = [(g, 1, 32_000, "t") for g, (pairs, _) in want.items() for _ in range(pairs // 32_000)] + [(g, 1, pairs % 32_000, "t") for g, (pairs, _) in want.items()]
    buckets = spark.createDataFrame([(g, str(k), n, m) for k, (g, n, m, _) in enumerate(rows)], "granularity string, bucket string, n_b long, m_b long")
    made = {(r["granularity"], r["gamma"]): r for r in experiments.packing(buckets, S).collect()}
    for g, (_, vectors) in want.items():
        assert made[g, 0]["packed"] == vectors and made[g, 0]["cost_packed"] == vectors * 350
    assert [round(made["medium", gamma]["cost_packed"] / 3600, 4) for gamma in (0, 1, 5, 15, 30)] == [800.8194, 801.0757, 802.1008, 804.6634, 808.5073]
    assert [round(made["fine", gamma]["cost_packed"] / 3600, 4) for gamma in (0, 30)] == [302.8472, 305.7546]
    greedy = {r["granularity"]: r["greedy"] for r in experiments.grouping(buckets, S).collect()}
    assert greedy == {g: v for g, (_, v) in want.items()}


def test_orientation_tail(spark):
    """Against the formulas in plain Python; the weighted gain compares A outside with the better side, not worse with better."""
    sizes = [("g", 300, 40), ("g", 40, 300), ("g", 500, 100), ("g", 7, 9), ("h", 3, 4), ("h", 100, 90)]
    buckets = spark.createDataFrame([(g, str(k), n, m) for k, (g, n, m) in enumerate(sizes * 2)], "granularity string, bucket string, n_b long, m_b long")
    slots = 256
    price = lambda outer, inner: -(-outer // (2 * max(1, slots // 2 // inner))) * (350 + 15 * 0.112)
    rows = {r["granularity"]: r for r in experiments.orientation_tail(buckets, slots).collect()}
    lop = [(n, m) for g, n, m in sizes if g == "g" and n * m >= slots and max(n, m) >= 2 * min(n, m)]
    a, b = [price(n, m) for n, m in lop], [price(m, n) for n, m in lop]
    g = rows["g"]
    assert (g["large"], g["lopsided"]) == (6, 6) and g["flip_rate"] == pytest.approx(sum(y < x for x, y in zip(a, b, strict=True)) / 3)
    assert g["speedup_weighted"] == pytest.approx(sum(a) / sum(map(min, a, b))) and g["speedup_max"] == pytest.approx(max(max(x, y) / min(x, y) for x, y in zip(a, b, strict=True)))
    assert g["saved_hours"] == pytest.approx(2 * sum(max(0, x - y) for x, y in zip(a, b, strict=True)) / 3600)
    assert g["lopsided_work"] == pytest.approx(100 * sum(n * m for n, m in lop) / sum(n * m for x, n, m in sizes if x == "g"))
    h = rows["h"]
    assert (h["large"], h["lopsided"], h["lopsided_work"], h["flip_rate"], h["speedup_weighted"], h["speedup_median"], h["speedup_p95"], h["speedup_max"], h["saved_hours"]) == (2, 0, 0, 0, 1, 1, 1, 1, 0)


def scenario(spark, costs, gap, gain):
    packed = spark.createDataFrame([(g, gamma, c, 10.0 * c) for gamma, row in costs.items() for g, c in row.items()], "granularity string, gamma int, cost_packed double, cost_alone double")
    grouped = spark.createDataFrame([("medium", 1000, int(1000 + 10 * gap)), ("fine", 0, 5)], "granularity string, greedy long, by_shape long")
    tail = spark.createDataFrame([("medium", gain, 3.0), ("fine", 1.0, 0.0)], "granularity string, speedup_weighted double, saved_hours double")
    return experiments.decision(packed, grouped, tail).first()


def test_decision(spark):
    medium, fine = {0: {"medium": 3600.0, "fine": 7200.0}, 15: {"medium": 3600.0, "fine": 7200.0}}, {0: {"medium": 7200.0, "fine": 3600.0}, 15: {"medium": 3600.0, "fine": 7200.0}}
    r = scenario(spark, fine, 4.9, 1.04)
    assert (r["g0_winner"], r["g0_hours"], r["g15_winner"], r["unpacked_hours"], r["scenario"]) == ("fine", 1.0, "medium", 10.0, 2)
    assert r["grouping_gap"] == pytest.approx(4.9) and (r["orientation_gain"], r["orientation_hours"]) == (1.04, 3.0)
    assert scenario(spark, medium, 9.0, 1.05)["scenario"] == 1
    assert [scenario(spark, *x)["scenario"] for x in ((fine, 5.0, 1.04), (fine, 4.0, 1.05), (medium, 4.0, 1.04))] == [3, 3, 3]


def test_published_measurements(spark):
    runs = spark.createDataFrame([(256, 512, 1286.99), (1974, 1028, 20961.98)], "n_b long, m_b long, wall double")
    rows = experiments.measured(runs, S, 174.972667795).collect()
    assert [r["comparisons"] for r in rows] == [8, 130] and [round(r["ratio"], 3) for r in rows] == [0.919, 0.922]


def test_class_seconds(spark):
    buckets = spark.createDataFrame([("g", "a", 2, 3, 0), ("g", "b", 200, 300, 0), ("g", "c", 4, 5, 1)], "granularity string, bucket string, n_b long, m_b long, class int")
    rows = {r["class"]: r for r in experiments.class_costs(buckets, 64).collect()}
    assert rows[1]["seconds"] == pytest.approx(350 + 5 * 0.112) and rows[0]["large_batches"] == 150 and rows[0]["seconds"] == pytest.approx(350.56 + 150 * 351.68)


def test_division_is_exact(spark):
    big = (1 << 62) + 1
    r = spark.createDataFrame([(big, 3)], "a long, b long").select(cost.floor_div(F.col("a"), F.col("b")), cost.ceil_div(F.col("a"), 2), cost.ceil_div(F.lit(0).cast("long"), 7)).first()
    assert tuple(r) == (big // 3, (1 << 61) + 1, 0)


def test_buckets_are_read_once(spark, sf_dir):
    from spanwise import registry

    for name in ("pl_sweep", "bk_granularity_ladder", "pl_copack", "pl_breakdown"):
        df = registry.QUERIES[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1, name


def test_filters_reach_the_scan(spark, sf_dir):
    from spanwise import registry

    kept = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = registry.QUERIES["q6"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", kept)
    pushed = plan[plan.index("PushedFilters") :]
    assert all(x in pushed for x in ("LessThan(l_quantity,24.0)", "GreaterThanOrEqual(l_discount,0.04)", "LessThanOrEqual(l_discount,0.08)", "GreaterThanOrEqual(l_shipdate"))


@pytest.mark.parametrize("width", [None, 1, 3, 1000])
def test_percentiles(spark, width):
    import numpy as np

    from spanwise.operators import aggregates as agg

    rng = np.random.default_rng(4)
    rows = [(str(rng.integers(3)), int(v)) for v in rng.integers(-50, 50, 400)] + [("one", 7)]
    counted = spark.createDataFrame(rows, "k string, v long").groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in agg.percentiles(counted, "k", "v", {"lo": 0.0, "mid": 0.5, "hi": 0.95}, width).collect()}
    for k in {k for k, _ in rows}:
        assert got[k] == pytest.approx(tuple(np.percentile([v for x, v in rows if x == k], [0, 50, 95])))


def test_merging(spark):
    costs = spark.createDataFrame([("g", k, x) for k, x in enumerate([40, 20, 70, 64])], "granularity string, class int, tiny_pairs long")
    r = experiments.merged_classes(costs, 64).first()
    assert (r["classes"], r["apart"], r["merged"], r["merges"]) == (4, 5, 4, 1)


def test_rotation_steps_and_gate(spark):
    assert len(cost.rotation_steps(S)) == 15 and cost.rotation_steps(S)[-1] == 8192
    words = [r[0] for r in spark.createDataFrame([(x,) for x in (25.0, 10.0, 5.0, 2.0, 1.0)], "x double").select(cost.gate(F.col("x"))).collect()]
    assert words == ["STRONG", "GOOD", "OK", "MARGINAL", "WEAK"]


def test_zipf_total(spark):
    r = tables.zipf_buckets(spark, "medium", 216_197, 1.37e9, 1974, 1028).agg(F.sum(F.col("n_b") * F.col("m_b")), F.max("n_b"), F.max("m_b"), F.count("*")).first()
    assert tuple(r)[1:] == (1974, 1028, 216_197) and abs(r[0] - 1.37e9) < 0.15 * 1.37e9


def test_files(spark, tmp_path):
    tables.write_calibration({"lt_s": 1.5, "rot_s": 0.25}, spark, str(tmp_path / "c"))
    assert tables.calibration(spark, str(tmp_path / "c")).first().asDict() == {"lt_s": 1.5, "rot_s": 0.25}
    (tmp_path / "b.csv").write_text("n_b,m_b\n3,4\n")
    assert tuple(tables.bucket_sizes(spark, str(tmp_path / "b.csv"), "fine").first()) == ("fine", 3, 4)
    for k in range(2):
        tables.append_results(spark.createDataFrame([("naive", k, 4)], "backend string, cmp_tot long, n_b long"), str(tmp_path / "r"))
    found = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert found.columns == tables.RESULT_COLUMNS and sorted((r["n_b"], r["backend"], r["cmp_tot"], r["correct"]) for r in found.collect()) == [("4", "naive", "0", None), ("4", "naive", "1", None)]
    with pytest.raises(ValueError):
        tables.append_results(spark.range(1), str(tmp_path / "r"))


def test_uniform_values(spark):
    r = tables.uniform_band(spark, 20_000, "x").agg(F.min("x"), F.max("x"), F.avg("x"), F.countDistinct("x"), F.max("x_payload")).first()
    assert (r[0], r[1], r[3], r[4]) == (0, 63, 64, 100) and abs(r[2] - 31.5) < 0.6
    a, b = (tables.uniform_band(spark, 100, "x").collect() for _ in range(2))
    assert a == b
