import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanwise.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = sum(any(windows[tuple(w[j : j + 5])] > 1 for j in range(max(0, k - 4), min(k, len(w) - 5) + 1)) for k in range(len(w)))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), repeated, len(w) < 10 or 100 * repeated > 20 * len(w))


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_base_against_brute_force(table, request):
    docs = request.getfixturevalue(table)
    want = sorted(repr((r["doc_id"], *brute(r["text"]))) for r in docs.select("doc_id", "text").collect())
    assert want == sorted(repr(tuple(r)[:-1]) for r in quality.judge(docs).collect())


@pytest.mark.parametrize("seed", range(8))
def test_windows_of_long_texts(seed):
    import random

    rng = random.Random(seed)
    words = [b"w%d" % rng.randrange(4 + 10 * (seed % 4)) for _ in range(rng.randrange(5, 300))]
    assert quality.repeated_in_windows(words) == brute(" ".join(x.decode() for x in words))[4]


def test_labels(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "id")
    rows = quality.judge(documents).join(labels, F.col("doc_id") == F.col("id")).collect()
    wrong = [r for r in rows if not r["base_failed"] and r["kept"] != (r["quality"] == 1)]
    assert len(wrong) <= 0.01 * len(rows)


def test_order_never_changes_the_verdict(documents):
    texts = [(r["text"] or "").encode() for r in documents.collect()]
    for t in texts:
        d = quality.Document(t)
        assert (quality.verdict(d, quality.RULES) is None) == (quality.verdict(d, quality.RULES[::-1]) is None)


def test_order_by_rejections_per_cost(spark):
    import time

    slow = quality.Rule("slow", lambda d: bool(time.sleep(0.001)) or True)
    fast, idle = quality.Rule("fast", lambda d: d.text == b"x"), quality.Rule("idle", lambda d: False)
    docs = spark.createDataFrame([(k, "xy"[k % 2]) for k in range(20)], "doc_id long, text string")
    assert [r.name for r in quality.ordered(docs, (idle, slow, fast))] == ["fast", "slow", "idle"]
    assert quality.ordered(docs.limit(0), (idle, slow)) == (idle, slow)


def test_order_counts_shared_measures_and_what_is_left():
    """The second rule by itself rejects more for its cost than the third, but all of that the first has rejected already."""
    rejected = quality.Counter({0b011: 50, 0b100: 10, 0b000: 40})
    found = quality.Costs([1.0, 1.5, 1.0], [frozenset("a"), frozenset("a"), frozenset("ab")], {"a": 0.01, "b": 0.001}, rejected)
    assert quality.by_worth(found) == [0, 2, 1]
    alone = quality.Costs([0.0, 0.0], [frozenset("a"), frozenset("b")], {"a": 1.0, "b": 0.5}, quality.Counter({0b11: 4}))
    assert quality.by_worth(alone) == [1, 0]


def test_costs_of_measures_are_told_apart():
    found = quality.costs([b"some words here " * 200] * 3, quality.RULES)
    assert {"words", "n_repeat_words"} <= set(found.measures) and found.used[0] == {"words"} and "words" in found.used[1]
    assert sum(found.rejected.values()) == 3 and found.plus(found).rejected == quality.Counter({k: 2 * n for k, n in found.rejected.items()})
    assert found.measures["n_repeat_words"] > 0 and all(x > -1e-3 for x in found.own)


def test_sample_reads_a_few_files(spark, documents, tmp_path):
    documents.repartition(40).write.parquet(str(tmp_path / "d"))
    many = spark.read.parquet(str(tmp_path / "d"))
    texts = quality.sampled(many, sample=16)
    assert texts.count() == 16 and len(texts.inputFiles()) == 8 and len(quality.ordered(many)) == len(quality.RULES)
    named = many.withColumnRenamed("text", "body")
    assert 0 < quality.sampled(named, "body", 100).count() <= 200


def test_kept_passes_columns_on(odd_docs, no_docs):
    got = quality.kept(odd_docs)
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(odd_docs).collect()}
    assert got.columns == odd_docs.columns and {r["doc_id"] for r in got.collect()} == {d for d, k in judged.items() if k}
    assert quality.kept(no_docs).collect() == [] and quality.judge(no_docs).collect() == []


def test_rules():
    clean = "It was a bright cold day in April and the clocks were striking thirteen as he went home"
    reject = lambda t: quality.verdict(quality.Document(t.encode()), quality.RULES)
    assert reject(clean) is None and reject("few words") == "too few words"
    assert reject("### " + clean.replace(" ", "*** ")) == "symbols" and reject(clean.upper()) == "shouting"
    assert reject("11 22 33 44 55 66 77 88 99 100 110 120") == "no letters"
    assert reject(" ".join(f"{w} {w}" for w in clean.split())) == "stuttering"
