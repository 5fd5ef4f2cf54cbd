import itertools
import zlib

import numpy as np
import pytest

from spanwise.llm import language


def best_path(scores, penalty):
    def worth(path):
        return sum(scores[k][x] for k, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))

    return max(map(worth, itertools.product(range(len(scores[0])), repeat=len(scores)))), worth


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_best(seed):
    rng = np.random.default_rng(seed)
    sizes = [4, 1, 6, 3]
    scores = rng.normal(size=(sum(sizes), 3)) * 2
    doc = np.repeat([0, 1, 3, 4], sizes)  # document 2 has no words
    labels = language.viterbi(scores, doc, 5, 1.0)
    for d in (0, 1, 3, 4):
        own = scores[doc == d].tolist()
        most, worth = best_path(own, 1.0)
        assert worth(labels[doc == d].tolist()) == pytest.approx(most)


@pytest.mark.parametrize("seed", range(6))
def test_long_texts_in_blocks_are_labelled_as_well(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(language, "BLOCK", int(rng.integers(1, 12)))
    monkeypatch.setattr(language, "HELD", 40)
    n, labels = int(rng.integers(1, 80)), int(rng.integers(1, 5))
    scores, doc = rng.normal(size=(n, labels)) * 2, np.zeros(n, np.int64)
    whole = language.viterbi(scores, doc, 1, 1.0)
    monkeypatch.setattr(language, "LONG", 0)
    parts = language.viterbi(scores, doc, 1, 1.0)

    def worth(path):
        return scores[np.arange(n), path].sum() - (path[1:] != path[:-1]).sum()

    assert worth(parts) == pytest.approx(worth(whole))
    assert np.array_equal(whole, parts)  # no ties here


def test_many_languages(spark):
    rows = [(k, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{'xyz'[j % 3]}" for j in range(30)), f"l{k:03d}") for k in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predict(docs, language.fit(docs)).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id']:03d}" for r in got) > 250


def test_a_long_text(spark, model):
    text = f"{EN} " * 3000 + f"{ES} " * 3000
    (row,) = language.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(s["lang"], s["words"]) for s in row["spans"]] == [("en", 39_000), ("es", 42_000)]


def test_held_out_accuracy(documents):
    rows = language.identified(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


EN, RU = "the cat sat on the mat and the dog ran to the house", "кошка сидела на коврике и собака бежала к дому"
ES = "el gato se sienta en la alfombra y el perro corre a la casa"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate([(EN, "en"), (RU, "ru"), (ES, "es")] * 8)]
    return language.fit(spark.createDataFrame([*rows, (99, "null language", None), (98, None, "en")], "doc_id long, text string, lang string"))


def test_word_scores_against_plain_python(model):
    """Counts, smoothing and sums in plain Python, from the texts that were learnt from."""

    def words_of(text):
        return "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).encode().split()

    def buckets(word):
        padded = b" " + word + b" "
        for k in range(1, len(padded) - 1):
            key = padded[k - 1] << 16 | padded[k] << 8 | padded[k + 1]
            yield (key * 2654435761 % (1 << 32)) >> (32 - language.BITS)

    tables = []
    for text in (EN, ES, RU):  # in the order of their names
        counts = {}
        for word in words_of(text) * 8:
            for b in buckets(word):
                counts[b] = counts.get(b, 0) + 1
        whole = sum(counts.values()) + 0.5 * (1 << language.BITS)
        tables.append(lambda b, counts=counts, whole=whole: np.log((counts.get(b, 0) + 0.5) / whole))
    text = "The cat, el perro; кошка kata 12 collar"
    doc, sizes, scores = language.word_scores(model, ["".encode(), text.encode()])
    assert doc.tolist() == [1] * 7 and sizes.tolist() == [len(w) for w in words_of(text)]
    for word, got in zip(words_of(text), scores, strict=True):
        sums = [sum(float(t(b)) for b in buckets(word)) for t in tables]
        cyrillic = word[0] > 0xC8
        allowed = [not cyrillic, not cyrillic, cyrillic]
        want = [max(x - max(sums), -30.0) if a else -60.0 for x, a in zip(sums, allowed, strict=True)]
        assert got.tolist() == pytest.approx(want, abs=1e-3)


def test_scripts_and_mixed_text(spark, model):
    texts = [EN, RU, ES, f"{EN} {EN} {ES} {ES}", "соба cat кот", "123 456", "", None, "日本語", "ñ"]
    rows = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert [got[k]["lang_pred"] for k in range(3)] == ["en", "ru", "es"]
    assert [s["lang"] for s in got[3]["spans"]] == ["en", "es"] and 0.4 < got[3]["score"] < 0.6
    assert [got[k]["lang_pred"] for k in (5, 6, 7)] == ["und"] * 3 and got[7]["score"] == 0.0
    assert got[4]["lang_pred"] in ("en", "ru") and got[8]["lang_pred"] in ("en", "es", "ru") and got[9]["lang_pred"] in ("en", "es", "ru")


def test_odd_documents(odd_docs, no_docs):
    rows = language.identified(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["lang_pred"] in ("en", "fr", "und") for r in rows)
    assert language.identified(no_docs).collect() == []


def test_nothing_learnt(odd_docs):
    blank = odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 0)).filter("doc_id < 0")
    rows = language.predict(odd_docs, language.fit(blank)).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
