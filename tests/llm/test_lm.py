import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import lm, words


def words_of(text):
    return [*(text or "").encode().lower().split(), None]


def is_held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def brute(docs):
    rows = [(r["doc_id"], words_of(r["text"])) for r in docs.select("doc_id", "text").collect()]
    held = [is_held(d) for d, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(d, h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 5)) for (d, t), h in zip(rows, held, strict=True)]


@pytest.mark.parametrize("frequent", [1 << 18, 64])
@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_base_against_brute_force(table, frequent, request, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = request.getfixturevalue(table)
    rows = lm.scored_corpus(docs).collect()
    got = sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))) for r in rows)
    assert got == sorted(map(repr, brute(docs)))
    assert all(r["score"] < 0 for r in rows)


class Slow:
    """The model in plain Python, from the same tables: probability of a word after others."""

    def __init__(self, counts, tables):
        self.counts, self.tables, self.total = counts, tables, sum(counts.values())
        by_class = {}
        for w, n in counts.items():
            by_class.setdefault(self.parts(w)[1], []).append((-n, self.parts(w)[2], w))
        self.slots, self.rest = {}, {}
        self.class_total = {c: sum(-n for n, _, _ in x) for c, x in by_class.items()}
        for c, x in by_class.items():
            ranked = [w for _, _, w in sorted(x, key=lambda y: y[:2])]
            self.slots |= {w: k + 1 for k, w in enumerate(ranked[: lm.SLOTS - 1])}
            self.rest[c] = ranked[lm.SLOTS - 1 :]

    def parts(self, word):
        """The word's coarse class, class and hash, by the operator's own tokens."""
        if word is None:
            return 0, 0, 0
        t = lm.tokens([(0, word, 0, False)])
        return int(t.coarse[0]), int(t.cls[0]), int(t.hash[0])

    def softmax(self, table, found, offset):
        x = [sum(float(table[r, k]) for r in found) + offset[k] for k in range(table.shape[1])]
        z = sum(math.exp(v) for v in x)
        return [math.exp(v) / z for v in x]

    def probability(self, before, word, unknown_class=None):
        """Of a word after the words before it; unknown_class: of one word of that class that training text has not."""
        piece = b" ".join([*before, word if word is not None else b"x"])
        t = lm.tokens([(0, piece, 0, word is None)])
        at = len(before)
        if word is None:  # the token x stands where the end stands: same context
            t = lm.tokens([(0, b" ".join(before), 0, True)])
        c = unknown_class if unknown_class is not None else int(t.cls[at])
        t = t._replace(cls=np.where(np.arange(len(t.cls)) == at, c, t.cls))
        class_rows, slot_rows = lm.rows(t)
        known = self.class_total
        prior = [math.log((known.get(k, 0) + 1) / (self.total + lm.CLASSES)) for k in range(lm.CLASSES)]
        p = self.softmax(self.tables[0], class_rows[:, at], prior)[c]
        inside = {0: sum(self.counts[w] for w in self.rest.get(c, []))} | {k: self.counts[w] for w, k in self.slots.items() if self.parts(w)[1] == c}
        weight = [inside[k] + 0.5 if k in inside else None for k in range(lm.SLOTS)]
        whole = sum((inside.get(k, 0) + 0.5) for k in range(lm.SLOTS))
        q = self.softmax(self.tables[1], slot_rows[:, at], [-1e4 if x is None else math.log(x / whole) for x in weight])
        slot = 0 if unknown_class is not None else self.slots.get(word, 0)
        share = 1.0 if slot else ((0 if unknown_class is not None else self.counts[word]) + 1) / (inside[0] + len(self.rest.get(c, [])) + 1)
        return p * q[slot] * share


@pytest.fixture()
def small_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLOTS", 4)
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", None, "the the the mat on cat dog log xylophone", "unseen words sit here", "The cat", "on on on on sat bat rat hat fat pat vat that what at"]
    docs = spark.createDataFrame([(k, t, k >= 6) for k, t in enumerate(texts * 3)], "doc_id long, text string, held_out boolean").withColumn("held_out", F.col("doc_id") % 9 == 6)
    counted = lm.gather(docs, "text", "held_out")
    known = lm.vocabulary(counted)
    return docs, counted, known, lm.train(docs, "text", "held_out", known)


def test_score_against_plain_python(small_model):
    docs, counted, known, tables = small_model
    assert all(np.abs(w).max() > 0 for w in tables)
    rows = docs.collect()
    counts = Counter(w for r in rows if not r["held_out"] for w in words_of(r["text"]))
    slow = Slow(counts, tables)
    assert (known.total, known.distinct) == (sum(counts.values()), len(counts))
    got = {r["doc_id"]: r["score"] for r in lm.scores(docs, counted, known, tables, "held_out", "doc_id", "text").collect()}
    for r in rows[:9]:
        t = words_of(r["text"])
        want = sum(math.log10(slow.probability(t[:k], w)) for k, w in enumerate(t))
        assert got[r["doc_id"]] == pytest.approx(want, rel=1e-4, abs=1e-4), r


def test_probabilities_add_up(small_model):
    docs, _, _, tables = small_model
    counts = Counter(w for r in docs.collect() if not r["held_out"] for w in words_of(r["text"]))
    slow = Slow(counts, tables)
    for before in ([], [b"the"], [b"cat", b"sat", b"on"], [b"new", b"words"]):
        known = sum(slow.probability(before, w) for w in counts)
        unknown = sum(slow.probability(before, b"x", c) for c in range(lm.CLASSES))
        assert known + unknown == pytest.approx(1, abs=1e-4)


def test_model_beats_counts_on_held_out_text(documents):
    rows = [r for r in lm.scored_corpus(documents).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert gain * math.log2(10) > 0.4  # bits a token


def test_reruns_agree(documents):
    a, b = (sorted((r["doc_id"], r["score"]) for r in lm.scored_corpus(documents).collect()) for _ in range(2))
    assert a == b


def test_empty(no_docs):
    assert lm.scored_corpus(no_docs).collect() == []


def test_many_trainers_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "PARTS", 1)
    sent = spark.createDataFrame([(0, np.full(3, 2.0**k, np.float32).tobytes(), k) for k in range(7)], "part int, data binary, grp int")
    groups = 7
    while groups > lm.FAN:
        sent, groups = lm.added(sent), -(-groups // lm.FAN)
    (row,) = lm.added(sent).collect()
    assert np.frombuffer(row["data"], np.float32).tolist() == [127.0] * 3


def test_keys_are_exact():
    thue = [0]
    while len(thue) < 1024:
        thue += [1 - x for x in thue]
    a, b = (bytes(97 + (x ^ y) for x in thue) for y in (0, 1))
    told = [a, b, b"a" * 14, b"a" * 15, b"a" * 14 + b"b", b"x", b"x\0", b"\0x", b"abcdefgh", b"abcdefghi", a, b"x"]
    t = lm.tokens([(0, b" ".join(told), 0, True)])
    seen = list(zip(t.first.tolist(), t.second.tolist(), strict=True))
    assert len(set(seen)) == len(set(told)) + 1 and seen[0] == seen[10] and seen[5] == seen[11] and seen[-1] == (0, 0)
    assert len(set(t.hash.tolist())) == len(set(told)) + 1


def test_pieces_of_a_long_text_are_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    text = b" ".join(bytes(rng.integers(97, 105, rng.integers(1, 20)).tolist()) for _ in range(3000)) + b" " + b"z" * 900
    whole = lm.tokens([(0, text, 0, True)])
    for size in (1, 50, 333, 5000):
        parts = [lm.tokens(g) for g in words.groups([text], lm.ORDER, size)]
        for k in (0, 1, 2, 3):
            assert np.array_equal(np.concatenate([p[k][p.counts] for p in parts]), whole[k])
        for k in (0, 1):
            assert np.array_equal(np.concatenate([lm.rows(p)[k][:, p.counts] for p in parts], axis=1), lm.rows(whole)[k])
    assert [x[:2] for x in words.pieces([b"a b", b""], 3, 100)] == [(0, b"a b"), (1, b"")]


def test_run_sums():
    rng = np.random.default_rng(0)
    first = np.concatenate(([0], np.sort(rng.choice(np.arange(1, 500), 60, replace=False))))
    x = rng.normal(size=(500, 3))
    assert np.allclose(lm.run_sums(x.copy(), first), np.add.reduceat(x, first, axis=0))


def test_words_and_contexts():
    group = [(0, b"A b  a\tc", 0, True), (1, b"", 0, True), (2, b"b", 0, True)]
    t = lm.tokens(group)
    assert t.text.tolist() == [0, 0, 0, 0, 0, 1, 2, 2] and t.counts.all()
    assert t.cls[[4, 5, 7]].tolist() == [0, 0, 0] and t.hash[0] == t.hash[2] != t.hash[1] == t.hash[6]
    pairs = lm.rows(t)[0][:2].T
    c = t.coarse
    assert pairs[0, 0] == pairs[5, 0] == pairs[6, 0] == 0 and pairs[2, 0] == c[1] * lm.COARSE + c[0] and pairs[3, 1] == lm.COARSE**2 + c[1] * lm.COARSE + c[0]
