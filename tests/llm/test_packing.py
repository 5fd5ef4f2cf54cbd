import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanwise.llm import packing
from spanwise.llm.queries import tokenizer_path


def brute(docs):
    tok = Tokenizer.from_file(tokenizer_path())
    return [(r["doc_id"], np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_every_id_once(table, request):
    docs = request.getfixturevalue(table)
    want = defaultdict(int)
    for doc, ids in brute(docs):
        for start in range(0, len(ids), 2048):
            own = ids[start : start + 2048]
            want[doc, start, len(own), zlib.crc32(own.tobytes()), len(ids)] += 1
    rows = packing.packed_documents(docs, tokenizer_path()).collect()
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    assert got == want
    packs = defaultdict(list)
    for r in rows:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for pack in packs.values():
        at = 0
        for offset, length in sorted(pack):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(r["length"] for r in rows)
    assert len(packs) * 2048 - used < max(2048, 0.05 * used)


def test_ids_of_pieces(odd_docs):
    rows = packing.pieces(odd_docs, tokenizer_path(), capacity=100).collect()
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 100 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_empty(no_docs):
    assert packing.packed_documents(no_docs, tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 65), 20, replace=False), rng.integers(1, 5000, 20), strict=True)}
    patterns = packing.shortest_pack_first(histogram, 64)
    held = defaultdict(int)
    for count, pattern in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            held[k] += count * n
    assert held == histogram
    rows = packing.plan_rows(patterns)
    for length, n in histogram.items():
        own = sorted((r[1], r[2]) for r in rows if r[0] == length)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == n


def test_pack_refuses_other_lengths_and_keeps_columns(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,)], "length long"))
    rows = packing.pack(spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 5, 2)], "x string, length long, offset long"), 10).collect()
    assert sorted((r["x"], r["sequence_id"], r["offset"]) for r in rows) in ([("a", 0, 0), ("a", 0, 5), ("a", 1, 0)], [("a", 0, 0), ("a", 1, 0), ("a", 1, 5)])


def test_word_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    encode, tok = packing.WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    text = "the quick brown fox's jumps, over 12 lazy dogs... the quick İß ﬁ 日本語 é it's"
    assert b"".join(encode[w] for w in text.encode().split()) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_every_character():
    """Planes 0 to 3 and 14, alone between letters: all assigned characters, many that are not, and what Unicode versions differ in."""
    encode, tok = packing.WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    points = [p for p in [*range(33, 0x33480), *range(0xE0000, 0xE0200)] if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 20_000):
        some = [f"a{chr(p)}b" for p in points[at : at + 20_000]]
        for text, made in zip(some, tok.encode_batch(some, add_special_tokens=False), strict=True):
            assert b"".join(encode[w] for w in text.encode().split()) == np.array(made.ids, "<u4").tobytes(), ascii(text)


def test_ids_of_random_strings():
    rng = np.random.default_rng(5)
    encode, tok = packing.WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    pools = [[*range(32, 127)], [*range(0x80, 0x250)], [*range(0x300, 0x370)], [*range(0x370, 0x600)], [*range(0x1E00, 0x2100)], [*range(0x3000, 0x3100)], [0x558, 0x1C, 0x85, 0xA0, 0x2028, 0x3A3, 0x130, 0x1F600, 0xFB01, 0x0D, 0x09]]
    for _ in range(3000):
        text = "".join(chr(int(rng.choice(pools[rng.choice(len(pools), p=(0.4, 0.2, 0.08, 0.08, 0.08, 0.08, 0.08))]))) for _ in range(rng.integers(1, 25)))
        want = np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(encode[w] for w in text.encode().split()) == want, ascii(text)


def test_ids_travel_if_asked_for(spark, odd_docs):
    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.packed_documents(odd_docs, tokenizer_path(), with_ids=True).collect()
    light = packing.packed_documents(odd_docs, tokenizer_path()).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, (tuple(r)[:5] for r in light)))
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    docs = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    for doc, text in docs.items():
        parts = {r["start"]: list(r["ids"]) for r in rows if r["doc_id"] == doc}
        assert sum((parts[k] for k in sorted(parts)), []) == [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_clashing_names(spark):
    items = spark.createDataFrame([(5, 1, 2, 3), (5, 4, 5, 6)], "length long, __item long, __rank long, __salt long")
    assert sorted(tuple(r) for r in packing.pack(items, 10).collect()) == [(5, 1, 2, 3, 0, 0), (5, 4, 5, 6, 0, 5)]
