import zlib

import numpy as np
import pytest

import corpus_pipeline
from spanwise.llm import mixing, packing, pii, quality
from tests.llm.test_packing import brute
from tests.llm.test_simhash import groups


def test_stages_against_brute_force(spark, documents, sf_dir):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        seen[name] = out.collect()
        docs = spark.createDataFrame(seen[name], out.schema)
        if name != "packing":
            assert out.columns == documents.columns
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    good = sorted(d for d, t in texts.items() if quality.verdict(quality.Document((t or "").encode()), quality.RULES) is None)
    assert sorted(r["doc_id"] for r in seen["quality rules"]) == good
    items = [(d, {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.lower().split()) - 4))}) for d, t in ((d, texts[d]) for d in good)]
    stay = {r["doc_id"] for r in seen["near-duplicates"]}
    assert stay <= set(good)
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    exact = set(groups([(d, texts[d]) for d in good], lambda a, b: a == b))
    assert stay <= exact  # copies go, and of a group the smallest stays
    brute_stay = set(groups(items, similar))
    assert len(stay ^ brute_stay) <= 0.01 * len(good)
    known = pii.Pseudonyms(pii.key_of(documents, None))
    assert {r["doc_id"]: r["text"] for r in seen["pseudonyms"]} == {r["doc_id"]: pii.replaced(texts[r["doc_id"]], known)[0] for r in seen["near-duplicates"]}
    assert all(r["n_chars"] == len(r["text"]) for r in seen["pseudonyms"])
    mixed = spark.createDataFrame(seen["mixture"], documents.schema)
    want = sorted((d, s, ids[s : s + 2048].tolist()) for d, ids in brute(mixed) for s in range(0, len(ids), 2048))
    assert want == sorted((r["doc_id"], r["start"], r["ids"]) for r in seen["packing"])
    sequences = {}
    for r in seen["packing"]:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["ids"]))
    whole = [sum((ids for _, ids in sorted(x)), []) for x in sequences.values()]
    assert max(map(len, whole)) <= 2048 and sorted(sum(whole, [])) == sorted(sum((ids.tolist() for _, ids in brute(mixed)), []))
    words = mixing.mix_words(spark.createDataFrame(seen["pseudonyms"], documents.schema)).agg({"target": "sum"}).first()
    assert words[0] > 0 and len(seen["mixture"]) > 0


def test_run_is_the_stages_in_turn(spark, sf_dir):
    a, b = (sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_tables_pass_every_stage(spark, table, request, sf_dir):
    docs = request.getfixturevalue(table)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
    assert (docs.columns[:2] == ["doc_id", "start"]) and (table == "odd_docs") == bool(rows) and packing.CAPACITY == 2048
