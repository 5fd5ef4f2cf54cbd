"""Language identification: script ranges narrow the candidates, Viterbi labels the words.

A model has, for each language, log-probabilities of byte trigrams within and at the edges of words, and the share of
each script among its words. A word is scored for the languages that use its script. The best sequence of labels, with
a penalty for each switch, divides a text into spans of one language; the language with the most letters names it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import common, words

#: Trigram buckets as a power of two, the penalty (in nats) of a switch, and the least share of a script that makes a language a candidate.
BITS, PENALTY, LEAST_SHARE = 16, 12.0, 0.002
#: Texts that are learnt from, for each language; chosen by hash, so the bound holds on average.
TRAIN_TEXTS = 4000
#: Bytes of text labelled at once, words from which on a text is labelled in blocks, words of a block, and numbers that blocks may take at once.
GROUP_BYTES, LONG, BLOCK, HELD = 4 << 20, 8192, 512, 1 << 22
UNKNOWN = "und"

# First and last code point of script ranges.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
NAMES = ["none", *SCRIPTS, "other"]


def _script_table() -> np.ndarray:
    """Script by the first two bytes of a UTF-8 character; for ASCII by the first alone."""
    table = np.zeros(1 << 16, np.uint8)
    table[0xC300:] = len(NAMES) - 1
    by_lead = {}
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            for point in range(lo, hi + 1, 1 if hi < 0x800 else 64):
                lead = chr(point).encode()[:2]
                by_lead[lead] = k
    for lead, k in by_lead.items():
        if len(lead) == 1:
            table[lead[0] << 8 : (lead[0] + 1) << 8] = k
        else:
            table[int.from_bytes(lead, "big")] = k
    return table


SCRIPT = _script_table()
#: What is no letter becomes a space, so that words are runs of letters.
CLEAN = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256))


class Model(NamedTuple):
    languages: list[str]
    trigrams: np.ndarray  # language, bucket
    scripts: np.ndarray  # script, language: whether it is a candidate


class Words(NamedTuple):
    bucket: np.ndarray  # of each byte
    start: np.ndarray  # of each word
    size: np.ndarray
    script: np.ndarray
    doc: np.ndarray


def analysed(texts: list[bytes], bits: int = BITS) -> Words:
    """Trigram buckets and words of many texts at once."""
    clean = [t.decode("utf-8", "replace").lower().encode().translate(CLEAN) for t in texts]
    data = np.frombuffer(b" " + b" ".join(clean) + b"  ", np.uint8)
    begin = np.cumsum([1, *(len(t) + 1 for t in clean)])
    solid = data != 32
    edge = np.flatnonzero(np.diff(solid))
    start, end = edge[::2] + 1, edge[1::2] + 1
    here = data.astype(np.uint32)
    key = np.zeros(len(data), np.uint32)
    key[1:-1] = here[:-2] << 16 | here[1:-1] << 8 | here[2:]
    bucket = (key * np.uint32(2654435761)) >> np.uint32(32 - bits)
    pair = here[start] << 8 | here[np.minimum(start + 1, len(data) - 1)]
    return Words(bucket, start, end - start, SCRIPT[pair], np.searchsorted(begin, start, "right") - 1)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", texts: int = TRAIN_TEXTS) -> Model:
    """Learns from about `texts` of each language's documents. What reaches the driver, and later each worker, is a table of
    2^BITS numbers for each language, however many documents there are. Null labels and null texts teach nothing."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = sorted((r[0], r[1]) for r in labelled.groupBy(lang_col).count().collect())  # a row for each language
    languages = [x for x, _ in found]
    number = {x: k for k, x in enumerate(languages)}
    bits = BITS
    if not languages:
        return Model([], np.zeros((0, 1 << bits), np.float32), np.zeros((len(NAMES), 0), bool))
    spark = docs.sparkSession
    of, part = common.free_name(docs, "lang"), common.free_name(docs, "share")
    share = F.broadcast(spark.createDataFrame([(x, min(1.0, texts / n)) for x, n in found], f"`{of}` string, `{part}` double"))
    lot = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("lot")), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.join(share, F.col(lang_col) == F.col(of)).filter(lot < F.col(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        trigrams, scripts = np.zeros((len(languages), 1 << bits), np.int64), np.zeros((len(languages), len(NAMES)), np.int64)
        for batch in batches:
            spoken = batch.column(1).to_pylist()
            grouped: dict[str, list[bytes]] = {}
            for text, x in zip(common.utf8(batch.column(0)), spoken, strict=True):
                grouped.setdefault(x, []).append(text)
            for x, own in grouped.items():
                w = analysed(own, bits)
                inner = np.repeat(w.start - np.cumsum(w.size) + w.size, w.size) + np.arange(w.size.sum())
                trigrams[number[x]] += np.bincount(w.bucket[inner], minlength=1 << bits)
                scripts[number[x]] += np.bincount(w.script, w.size, len(NAMES)).astype(np.int64)
        lang, bucket = np.nonzero(trigrams)
        yield {"kind": np.zeros(len(lang), np.int8), "lang": lang, "at": bucket, "n": trigrams[lang, bucket]}
        lang, script = np.nonzero(scripts)
        yield {"kind": np.ones(len(lang), np.int8), "lang": lang, "at": script, "n": scripts[lang, script]}

    made = common.map_batches(chosen, [text_col, lang_col], run, "kind byte, lang int, at int, n long")
    sums = made.groupBy("kind", "lang", "at").agg(F.sum("n").alias("n")).toArrow()
    kinds, langs, places, n = (sums.column(k).to_numpy() for k in range(4))
    trigrams, scripts = np.zeros((len(languages), 1 << bits)), np.zeros((len(languages), len(NAMES)))
    for kind, table in ((0, trigrams), (1, scripts)):
        own = kinds == kind
        table[langs[own], places[own]] = n[own]
    trigrams = np.log((trigrams + 0.5) / (trigrams.sum(axis=1, keepdims=True) + 0.5 * (1 << bits)))
    return Model(languages, trigrams.astype(np.float32), (scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T.copy())


def switched(value: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values after a possible switch, where staying is as good, and the label that a switch comes from. The last axis is labels."""
    leader = value.argmax(axis=-1)
    other = np.take_along_axis(value, leader[..., None], -1) - penalty
    return np.maximum(value, other), value >= other, leader


def stepped(scores: np.ndarray, first: np.ndarray, length: np.ndarray, value: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Runs of words that step together, the longest first: for each word where staying was as good, and the leader before it. value:
    before each run's first word, in place after its last."""
    stay, leader = np.ones(scores.shape, bool), np.zeros(len(scores), np.int32)
    alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    for t, k in enumerate(alive):
        at = first[:k] + t
        if t:
            value[:k], stay[at], leader[at] = switched(value[:k], penalty)
        value[:k] += scores[at]
    return stay, leader


def traced(stay: np.ndarray, leader: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The labels that lead to each run's last state."""
    label = np.zeros(len(stay), np.int32)
    alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    for t in range(len(alive) - 1, -1, -1):
        at, now = first[: alive[t]] + t, state[: alive[t]]
        label[at] = now
        state[: alive[t]] = np.where(stay[at, now], now, leader[at])
    return label


def in_blocks(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of one long text, exactly, in blocks that step together.

    For each block and each label of its first word, the best value of each label of its last one; then the best labels at
    the blocks' ends, block by block; then each block's labels between them. This takes as many times the work as there
    are labels, but the steps of one block only.
    """
    n, labels = scores.shape
    first = np.arange(0, n, BLOCK)
    length = np.minimum(BLOCK, n - first)
    many = max(1, HELD // labels**2)
    through = np.empty((len(first), labels, labels))
    for at in range(0, len(first), many):
        value = np.where(np.eye(labels, dtype=bool), 0.0, -np.inf)[None].repeat(len(first[at : at + many]), axis=0)
        for t in range(length[at]):
            k = int((length[at : at + many] > t).sum())
            if t:
                value[:k] = switched(value[:k], penalty)[0]
            value[:k] += scores[first[at : at + k] + t][:, None, :]
        through[at : at + many] = value
    begins, ends = np.zeros((len(first), labels), np.int64), np.zeros(len(first), np.int64)
    before, stays, leaders = np.zeros(labels), [], []
    for k in range(len(first)):
        start, stay, leader = switched(before, penalty) if k else (before, np.ones(labels, bool), np.int64(0))
        stays.append(stay), leaders.append(int(leader))
        whole = start[:, None] + through[k]
        begins[k], before = whole.argmax(axis=0), whole.max(axis=0)
    state, starts = int(before.argmax()), np.zeros(len(first), np.int64)
    for k in range(len(first) - 1, -1, -1):
        ends[k], starts[k] = state, begins[k, state]
        state = int(starts[k]) if stays[k][starts[k]] else leaders[k]
    value = np.where(np.arange(labels) == starts[:, None], 0.0, -np.inf)
    stay, leader = stepped(scores, first, length, value, penalty)
    return traced(stay, leader, first, length, ends.copy())


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word: the sum of scores less the penalty for each switch is largest. All texts step together, but
    those of more than LONG words."""
    bound = np.searchsorted(doc, np.arange(n_docs + 1))
    label = np.zeros(len(scores), np.int32)
    for k in np.flatnonzero(np.diff(bound) > LONG):
        label[bound[k] : bound[k + 1]] = in_blocks(scores[bound[k] : bound[k + 1]].astype(np.float64), penalty)
    short = np.flatnonzero((np.diff(bound) <= LONG) & (np.diff(bound) > 0))
    order = short[np.argsort(-np.diff(bound)[short], kind="stable")]
    first, length = bound[:-1][order], np.diff(bound)[order]
    value = np.zeros((len(order), scores.shape[1]))
    stay, leader = stepped(scores, first, length, value, penalty)
    made = traced(stay, leader, first, length, value.argmax(axis=1))
    own = np.repeat(np.diff(bound) <= LONG, np.diff(bound))
    label[own] = made[own]
    return label


def word_scores(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its text, its size, and its score in each language: the sum of its trigrams' log-probabilities less that of the
    best language, -30 at least; -60 in languages that do not use its script, unless none does. A piece of a long text at a time."""
    languages, bits = len(model.languages), int(model.trigrams.shape[1]).bit_length() - 1
    made = []
    for group in words.groups(texts, 0):
        w = analysed([piece for _, piece, _, _ in group], bits)
        scores, end = np.empty((len(w.start), languages), np.float32), w.start + w.size
        for k in range(languages):
            sums = np.concatenate(([0.0], np.cumsum(model.trigrams[k][w.bucket], dtype=np.float64)))
            scores[:, k] = sums[end] - sums[w.start]
        scores -= scores.max(axis=1, keepdims=True)
        allowed = model.scripts[w.script]
        allowed[~allowed.any(axis=1)] = True
        own = np.array([k for k, *_ in group], np.int64)
        made.append((own[w.doc], w.size, np.where(allowed, np.maximum(scores, -30.0), -60.0)))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Spans and the language of every text.

    Returns id_col, lang_pred, score and spans (lang, words, bytes) in text order. score is the share of the letters
    (as UTF-8 bytes) in spans of lang_pred. A text that is null or has no letters is `und` with score 0 and has no
    spans, as is every text if nothing was learnt. Ties go to the language that sorts first. Repeated rows give
    repeated results; null ids stay null; an empty table gives none; other columns are left out.
    """
    languages = model.languages
    shared = docs.sparkSession.sparkContext.broadcast(model)
    group = GROUP_BYTES * 16 // max(16, len(languages))  # a number for each word and language

    def has_letter(text: bytes) -> bool:
        return any(any(map(str.isalpha, piece.decode("utf-8", "replace"))) for _, piece, _, _ in words.pieces([text], 0))

    def label(texts: list[bytes]) -> list[tuple[str, float, list]]:
        n = len(texts)
        out: list[tuple[str, float, list]] = [(UNKNOWN, 0.0, [])] * n
        if not n or not languages:
            return out
        doc, sizes, scores = word_scores(shared.value, texts)
        if not len(doc):
            return out
        labels = viterbi(scores, doc, n, penalty)
        new = np.ones(len(labels), bool)
        new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        many = np.diff(np.concatenate((begin, [len(labels)])))
        size = np.add.reduceat(sizes, begin)
        weight = np.bincount(doc * len(languages) + labels, sizes, n * len(languages)).reshape(n, -1)
        best, total = weight.argmax(axis=1), weight.sum(axis=1)
        spans: list[list] = [[] for _ in range(n)]
        for d, x, many_words, octets in zip(doc[begin].tolist(), labels[begin].tolist(), many.tolist(), size.tolist(), strict=True):
            spans[d].append({"lang": languages[x], "words": many_words, "bytes": octets})
        for d in np.flatnonzero(total).tolist():
            if has_letter(texts[d]):
                out[d] = (languages[best[d]], float(weight[d, best[d]] / total[d]), spans[d])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting, ids, held = [], [], 0

        def close() -> dict:
            made = label(waiting)
            return {id_col: pa.concat_arrays(ids), "lang_pred": [m[0] for m in made], "score": [m[1] for m in made], "spans": [m[2] for m in made]}

        for batch in batches:
            texts = common.utf8(batch.column(1))
            waiting += texts
            ids.append(batch.column(0))
            held += sum(map(len, texts))
            if held >= group:
                yield close()
                waiting, ids, held = [], [], 0
        if ids:
            yield close()

    schema = f"`{id_col}` {common.type_of(docs, id_col)}, lang_pred string, score double, spans array<struct<lang:string,words:long,bytes:long>>"
    return common.map_batches(docs, [id_col, text_col], run, schema)


def identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """op9: learns from labelled documents whose crc32(doc_id as text) mod 4 is not 2, labels all."""
    learnt = docs.select("doc_id", "text", "lang").filter(common.id_remainder("doc_id", folds) != held)
    made = predict(docs, fit(learnt))
    return made.select("doc_id", (common.id_remainder("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "spans")
