import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanwise.llm import mixing


def water_fill(sizes, weights, most):
    """Shares again and again until no source is above its most."""
    target, fixed = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = sum(sizes) - sum(most * s for s, f in zip(sizes, fixed, strict=True) if f)
        left = sum(w for w, f in zip(weights, fixed, strict=True) if not f)
        target = [most * s if f else rest * w / left for s, w, f in zip(sizes, weights, fixed, strict=True)]
        over = [k for k, s in enumerate(sizes) if not fixed[k] and target[k] >= most * s]
        if not over or all(fixed[k] or k in over for k in range(len(sizes))):
            return [min(t, most * s) for t, s in zip(target, sizes, strict=True)]
        for k in over:
            fixed[k] = True


def plain_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{k:03d}", n) for k, n in enumerate(sizes)], "source string, size long")
    return [r["target"] for r in sorted(mixing.targets(rows.repartition(3)).collect())]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 1000, 10, 2000], [0, 0, 9], [1, 2, 3, 4, 5, 6, 700], [0], [], [10**15, 1, 10**12, 7, 10**14], list(range(40))])
def test_targets(spark, sizes):
    weights = [(1, 2, 3)[k % 3] for k in range(len(sizes))]
    got = plain_targets(spark, sizes)
    if sum(sizes):
        assert got == pytest.approx(water_fill(sizes, weights, 3))
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s for t, s in zip(got, sizes, strict=True))


def test_more_sources_than_are_broadcast(spark):
    n = 120_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("h"), F.col("id") % (n - 5000)).alias("source"), F.expr("repeat('w ', int(1 + id % 7 + if(id = 3, 5000, 0)))").alias("text"))
    made = mixing.mix_words(docs)
    r = made.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).first()
    assert r["n"] == n and r["over"] <= 0 and abs(r["size"] - r["taken"]) < 0.05 * r["size"]
    by_source = docs.select("doc_id", "source").join(made, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    assert by_source.agg(F.max(F.abs(F.col("taken") - F.col("target")))).first()[0] <= 1


@pytest.mark.parametrize("limit", [0, 100_000])
def test_tables_of_sources_joined_either_way(documents, monkeypatch, limit):
    want = sorted(map(repr, mixing.mix_words(documents).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", limit)
    assert sorted(map(repr, mixing.mix_words(documents).collect())) == want


def test_clashing_names(spark):
    names = ["__hash", "__cut", "__source", "__copies", "__times", "__copy", "hash", "cut", "of", "size"]
    docs = spark.createDataFrame([(k, "a b c d"[: 1 + k % 7], f"s{k % 3}", *range(k, k + len(names))) for k in range(60)], ["doc_id", "text", "source", *names])
    plain = sorted(r["doc_id"] for r in mixing.mix(docs.select("doc_id", "text", "source")).collect())
    rows = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == plain and all(r["__hash"] == r["doc_id"] and r["size"] == r["doc_id"] + 9 for r in rows)


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_words_taken(table, request):
    docs = request.getfixturevalue(table)
    rows = mixing.mix_words(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    if table == "documents":
        assert mixing.mix_words(docs).count() == docs.count()
        assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_words(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()))


def test_repeated_rows_share_the_threshold(spark):
    docs = spark.createDataFrame([(1, "a b c", s) for s in ("x", "y", "z") for _ in range(40)], "doc_id long, text string, source string")
    sums = defaultdict(int)
    for r in mixing.mix_words(docs).collect():
        sums[r["target"]] += r["taken"]
        assert r["taken"] <= 9
    assert all(0 <= t - s <= 40 for t, s in sums.items())


def test_mix_keeps_columns_and_repeats_whole_documents(documents):
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    words = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_words(documents).collect()}
    assert max(times.values()) <= 3
    near = [d for d, (s, t) in words.items() if s and t % s == 0 and times.get(d, 0) != t // s]
    assert len(near) <= 20


def test_larger_budgets_are_nested(documents):
    cuts = [mixing.thresholds(documents, "doc_id", "text", "source", "", w, 3)[1].collect() for w in ((1, 1, 1), (1, 1, 2))]
    budget = [{r["source"]: (r["copies"], r["cut"]) for r in c} for c in cuts]
    share = [{r["source"]: r["target"] for r in c} for c in cuts]
    assert all((budget[0][s] <= budget[1][s]) == (share[0][s] <= share[1][s]) or budget[0][s] == budget[1][s] for s in share[0])


def test_empty(no_docs):
    assert mixing.mix_words(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []
