"""A hashed maximum-entropy language model with a class-factored softmax, and exact word counts beside it.

A word's class is a hash of its last two bytes, which tell much about language and kind of word. The most frequent
words of each class have a slot of their own in it; all its other words share slot 0. The probability of a word, given
the words before it, is that of its class, by a softmax over all classes, times that of its slot, by a softmax over the
slots of the class; in slot 0 a word has its share of the counts, with one more for words never seen.

Both softmaxes are log-linear in hashed features: for classes the word before (bigram), the word before that (skip),
both (trigram), and pairs of coarse classes of the last three words; for slots the word before and the coarse classes of
the last two, each with the class. A feature names a row of a hashed table, which has a weight for each class or slot.
Tokens are so scored as batches of sparse rows, a few row numbers for each token.

Training covers every training token once, in ROUNDS parts by a hash of the text. In a round, trainers each update a
copy of the weights by the gradient over blocks of their tokens; then the copies are averaged, each row by how often each
trainer met it. The gradient's observed half is exact. Its expected half is computed at one in SHARE positions of a
block and counts SHARE times. Weights have a fixed size; trainers grow with the corpus, and what they send is added up on
executors, so that only one table a round passes through the driver.

Counts of single words grow with the corpus and stay distributed. Words with at least one in FREQUENT of all tokens
are no more than FREQUENT; they are broadcast. All rarer words meet their counts in a shuffle, where none of them is
frequent enough to weigh.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import common, words

#: Classes, slots in each class, coarse classes, and how many words back the model looks.
CLASSES, SLOTS, COARSE, ORDER = 128, 32, 32, 3
#: Rows of the tables of classes and of slots, as powers of two.
CLASS_BITS, SLOT_BITS = 14, 15
FREQUENT, BUCKET_BITS = 1 << 20, 18
#: Parts of the training text, tokens of a block, tokens scored at once, positions for each one whose expectation is computed, and the step.
ROUNDS, BLOCK, SCORED, SHARE, RATE = 2, 1 << 14, 1 << 11, 8, 0.2
#: Trainers up to which each has at least FEW tokens; beyond them each has MANY. Trainers that are added up at once, and parts of the tables.
TRAINERS, FEW, MANY, FAN, PARTS = 16, 1 << 20, 1 << 27, 32, 16
#: Bound of a weight after a round, and of a sum of weights.
WEIGHT, LOGIT = 12.0, 80.0
#: Distinct words a task gathers before it passes them on.
GATHER = 1 << 20

_KEYS = np.random.default_rng(20240229).integers(1, 1 << 64, 8, np.uint64) | np.uint64(1)


class Tokens(NamedTuple):
    """Tokens of several pieces of texts, the ends of texts included: their key (0, 0 for an end), class, coarse class, a hash,
    the number of the token in its piece, of its text, and whether it counts or only stands before those that do."""

    first: np.ndarray
    second: np.ndarray
    cls: np.ndarray
    coarse: np.ndarray
    hash: np.ndarray
    place: np.ndarray
    text: np.ndarray
    counts: np.ndarray


def tokens(group: list[tuple[int, bytes, int, bool]]) -> Tokens:
    """Tokens of a group of pieces (see words.pieces). A-Z is lower-cased."""
    raw, begin = words.joined([piece.lower() for _, piece, _, _ in group])
    data = np.frombuffer(raw, np.uint8)
    start, end = words.bounds(data)
    last = data[end - 1].astype(np.uint32) | np.where(end - start > 1, data[end - 2], 0).astype(np.uint32) << 8
    last = (last * np.uint32(2654435761)) >> np.uint32(12)
    cls, coarse = 1 + last % np.uint32(CLASSES - 1), 1 + last % np.uint32(COARSE - 1)
    first, second = words.keys(raw, start, end, cls)
    of = np.searchsorted(begin, start, "right") - 1
    closes = np.array([ends for *_, ends in group], np.int64)
    bound = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(group)) + closes)))
    at = np.arange(len(of)) + (np.cumsum(closes) - closes)[of]

    def spread(x: np.ndarray, kind) -> np.ndarray:
        out = np.zeros(bound[-1], kind)
        out[at] = x
        return out

    size = np.diff(bound)
    place = np.arange(bound[-1]) - np.repeat(bound[:-1], size)
    hashed = words.mixed(first * _KEYS[0] ^ words.mixed(second))
    return Tokens(
        spread(first, np.uint64), spread(second, np.uint64), spread(cls, np.int64), spread(coarse, np.int64), spread(hashed, np.uint64), place,
        np.repeat(np.array([k for k, *_ in group], np.int64), size), place >= np.repeat(np.array([n for _, _, n, _ in group], np.int64), size),
    )


def token_groups(texts: list[bytes]) -> Iterator[Tokens]:
    """Tokens of texts of any length, about a megabyte at a time."""
    return map(tokens, words.groups(texts, ORDER))


def rows(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """For each feature and token its row in the table of classes, and in that of slots."""

    def back(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[k:] = x[:-k]
        out[t.place < k] = 0
        return out

    def place(key: np.ndarray, base: int, bits: int) -> np.ndarray:
        return base + ((words.mixed(key) >> np.uint64(32)) * np.uint64((1 << bits) - base) >> np.uint64(32)).astype(np.int64)

    c1, c2, c3 = (back(t.coarse, k) for k in (1, 2, 3))
    w1, w2 = back(t.hash, 1), back(t.hash, 2)
    pairs = COARSE * COARSE
    classes = [c1 * COARSE + c2, pairs + c2 * COARSE + c3]
    classes += [place(key, 2 * pairs, CLASS_BITS) for key in (w1 * _KEYS[1], w2 * _KEYS[2], w1 * _KEYS[3] + w2 * _KEYS[4])]
    own = t.cls * COARSE
    slots = [own + c1, CLASSES * COARSE + own + c2, place(w1 * _KEYS[5] + t.cls.astype(np.uint64) * _KEYS[6], 2 * CLASSES * COARSE, SLOT_BITS)]
    return np.stack(classes), np.stack(slots)


def logits(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each token the sum of the rows found."""
    x, other = weights.take(found[0], axis=0), None
    for row in found[1:]:
        other = weights.take(row, axis=0, out=other, mode="clip")
        x += other
    return x


def probabilities(weights: np.ndarray, found: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Of every column, for each token: offset and the weights of the rows found, normalised."""
    x = logits(weights, found)
    x += offset
    np.minimum(x, LOGIT, out=x)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def with_offsets(tables: list[np.ndarray], offset: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """The tables with offsets in the rows of their first feature, of which every token has one."""
    classes, slots = (w.astype(np.float32) for w in tables)
    classes[: COARSE * COARSE] += offset
    slots[: CLASSES * COARSE] += np.repeat(inside, COARSE, axis=0)
    return [classes, slots]


def log_probability(weights: np.ndarray, found: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the target's probability, for each token. weights are from with_offsets(); bounded, so no sum overflows."""
    x = logits(weights, found)
    own = x[np.arange(len(target)), target]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], np.float32))


def run_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of x's rows that begin at `first`. Folds each run in halves; x is overwritten."""
    if not len(x):
        return x
    size = np.diff(np.append(first, len(x)))
    start, size = first[size > 1], size[size > 1]
    while len(start):
        half = size // 2
        inner = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)
        left = np.repeat(start, half) + inner
        x[left] += x[left + np.repeat(size - half, half)]
        size = size - half
        start, size = start[size > 1], size[size > 1]
    return x[first]


def update(weights: np.ndarray, squares: np.ndarray, found: np.ndarray, target: np.ndarray, offset: np.ndarray, picked: np.ndarray, rate: float) -> None:
    """One step, in place, against the gradient over a block: the target's weights up for each token, all others down by
    what the model expects at the picked positions. Each weight has a step of its own by its squared gradients (Adagrad)."""
    expected = probabilities(weights, found[:, picked], offset)
    expected *= SHARE
    flat, flat_squares = weights.reshape(-1), squares.reshape(-1)
    for every in found:
        row = every[picked]
        order = np.argsort(row, kind="stable")
        row = row[order]
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        first = np.flatnonzero(new)
        own, gradient = row[first], run_sums(expected[order], first)
        squares[own] += gradient * gradient
        hit = every * weights.shape[1] + target
        np.add.at(flat_squares, hit, np.float32(1))
        np.add.at(flat, hit, rate / np.sqrt(flat_squares[hit]))
        weights[own] -= rate * gradient / np.sqrt(squares[own])


class Vocabulary(NamedTuple):
    """Counts of the training text that have a bounded size: all tokens, distinct words, tokens and words by class, and the
    frequent words, sorted by hash, with their slots; how many slots a class has; and where the words begin whose hash has
    the same first bits."""

    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    first: np.ndarray
    second: np.ndarray
    count: np.ndarray
    hash: np.ndarray
    slot: np.ndarray
    slots: int
    buckets: np.ndarray

    def place(self, t: Tokens) -> np.ndarray:
        """Each token's place among the frequent words; -1 if it is none of them."""
        found = np.full(len(t.hash), -1)
        if not len(self.hash):
            return found
        bucket = t.hash >> np.uint64(64 - BUCKET_BITS)
        at = self.buckets[bucket]
        many = self.buckets[bucket + np.uint64(1)] - at
        left = np.flatnonzero(many)
        while len(left):  # as often as the fullest bucket has words
            here = at[left]
            hit = (self.first[here] == t.first[left]) & (self.second[here] == t.second[left])
            found[left[hit]] = here[hit]
            at[left] += 1
            many[left] -= 1
            left = left[~hit & (many[left] > 0)]
        return found

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of the classes' shares, and of the slots' shares in their class; slots without a word have next to none."""
        classes = np.log((self.class_total + 1) / (self.total + CLASSES))
        cls = (self.second >> np.uint64(56)).astype(np.int64)
        inside = np.zeros((CLASSES, self.slots))
        own = self.slot > 0
        inside[cls[own], self.slot[own]] = self.count[own]
        inside[:, 0] = self.class_total - inside.sum(axis=1)
        used = np.zeros((CLASSES, self.slots), bool)
        used[cls[own], self.slot[own]] = used[:, 0] = True
        shares = (inside + 0.5) / (inside + 0.5).sum(axis=1, keepdims=True)
        return classes.astype(np.float32), np.where(used, np.log(shares), -1e4).astype(np.float32)

    def shared(self) -> np.ndarray:
        """log10 of what a class's words without a slot divide: their tokens, one for each of them, and one for the unknown."""
        cls, own = (self.second >> np.uint64(56)).astype(np.int64), self.slot > 0
        inside = self.class_total - np.bincount(cls[own], self.count[own], CLASSES)
        return np.log10(inside + self.class_distinct - np.bincount(cls[own], minlength=CLASSES) + 1)


def gather(docs: DataFrame, text_col: str, held_col: str) -> DataFrame:
    """(first, second, n): how often each word, the ends included, is in training text. Stored."""

    def merged(parts: list[tuple]) -> tuple:
        first, second, hashed, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashed)
        first, second, hashed = first[order], second[order], hashed[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        return first[at], second[at], hashed[at], np.add.reduceat(counts[order], at) if len(at) else counts

    def table(first, second, _, counts) -> dict:
        return {"first": first.view(np.int64), "second": second.view(np.int64), "n": counts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            texts = [t for t, out in zip(common.utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True) if not out]
            for t in token_groups(texts):
                own = t.counts
                parts.append(merged([(t.first[own], t.second[own], t.hash[own], np.ones(own.sum(), np.int64))]))
                held += len(parts[-1][0])
                if held >= GATHER:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held >= GATHER // 2:
                        yield table(*parts[0])
                        parts, held = [], 0
        if parts:
            yield table(*merged(parts))

    made = common.map_batches(docs, [text_col, held_col], run, "first long, second long, n long")
    return common.stored(made.groupBy("first", "second").agg(F.sum("n").alias("n")), "words")


def vocabulary(counted: DataFrame) -> Vocabulary:
    """What fits the driver at any size: sums by class, and the words that are at least one in FREQUENT of all tokens."""
    by_class = counted.groupBy(F.shiftrightunsigned("second", 56).cast("int").alias("c")).agg(F.sum("n"), F.count("*")).collect()  # CLASSES rows
    class_total, class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for c, n, v in by_class:
        class_total[c], class_distinct[c] = n, v
    total = int(class_total.sum())
    least = max(1, -(-total // FREQUENT))  # no more than FREQUENT words have this count
    frequent = counted.filter(F.col("n") >= least).toArrow()
    first, second, count = (frequent.column(k).to_numpy() for k in range(3))
    first, second = first.view(np.uint64), second.view(np.uint64)
    hashed = words.mixed(first * _KEYS[0] ^ words.mixed(second))
    hashed[(first == 0) & (second == 0)] = 0  # as in tokens()
    order = np.argsort(hashed, kind="stable")
    first, second, count, hashed = first[order], second[order], count[order], hashed[order]
    cls = (second >> np.uint64(56)).astype(np.int64)
    ranked = np.lexsort((hashed, -count, cls))  # the most frequent of each class first, by hash among equals
    rank = np.empty(len(cls), np.int64)
    rank[ranked] = np.arange(len(cls)) - np.searchsorted(cls[ranked], cls[ranked])
    slot = np.where(rank < SLOTS - 1, rank + 1, 0)
    buckets = np.searchsorted(hashed >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64)).astype(np.int32)
    return Vocabulary(total, int(class_distinct.sum()), class_total, class_distinct, first, second, count, hashed, slot, SLOTS, buckets)


def shapes() -> list[tuple[int, int]]:
    return [(1 << CLASS_BITS, CLASSES), (1 << SLOT_BITS, SLOTS)]


def packed(tables: list[np.ndarray], met: list[np.ndarray]) -> Iterator[dict]:
    """Tables, each row times how often it was met, and these counts, as PARTS rows (part, data)."""
    for part in range(PARTS):
        own = [np.concatenate((n[part::PARTS, None], n[part::PARTS, None] * w[part::PARTS]), axis=1).astype(np.float32).tobytes() for w, n in zip(tables, met, strict=True)]
        yield {"part": [part], "data": [b"".join(own)]}


def added(sent: DataFrame) -> DataFrame:
    """(part, data, grp) added up over FAN neighbouring groups of each part, in order, so that reruns agree to the bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, group, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own, key = np.frombuffer(data.as_buffer(), np.float32), (part, group // FAN)
                sums[key] = sums[key] + own if key in sums else own.copy()
        for (part, group), total in sums.items():
            yield {"part": [part], "grp": [group], "data": [total.tobytes()]}

    dealt = sent.repartition("part", F.expr(f"grp div {FAN}")).sortWithinPartitions("part", "grp")
    return common.map_batches(dealt, ["part", "grp", "data"], run, "part int, grp int, data binary")


def train(docs: DataFrame, text_col: str, held_col: str, known: Vocabulary) -> list[np.ndarray]:
    """The tables of classes and of slots, from all tokens of texts whose held_col is false."""
    tables = [np.zeros(shape, np.float32) for shape in shapes()]
    if not known.total:
        return tables
    spark = docs.sparkSession
    trainers = max(1, min(TRAINERS, known.total // ROUNDS // FEW), known.total // ROUNDS // MANY)
    part = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(ROUNDS))
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((known, tables))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[dict]:
            from pyspark import TaskContext

            known, start = shared.value
            # numpy's fast add.at asks for its own dtype object, which an array that was sent does not have
            tables, squares = [w.astype(np.float32) for w in start], [np.ones(w.shape, np.float32) for w in start]
            met = [np.zeros(len(w)) for w in start]
            offset, inside = known.offsets()
            lot = np.random.default_rng(TaskContext.get().partitionId())
            for batch in batches:
                for t in token_groups(common.utf8(batch.column(0))):
                    places = known.place(t)
                    slot = np.where(places >= 0, known.slot[places] if len(known.slot) else 0, 0)
                    found = rows(t)
                    own = np.flatnonzero(t.counts)
                    for at in range(0, len(own), BLOCK):
                        some = own[at : at + BLOCK]
                        picked = np.arange(lot.integers(SHARE), len(some), SHARE)
                        for w, s, f, target, shift in zip(tables, squares, found, (t.cls, slot), (offset, inside[t.cls[some[picked]]]), strict=True):
                            update(w, s, f[:, some], target[some], shift, picked, RATE)
                    for n, f in zip(met, found, strict=True):
                        n += np.bincount(f[:, own].ravel(), minlength=len(n))
            group = TaskContext.get().partitionId()
            if any(n.any() for n in met):
                for row in packed(tables, met):
                    yield row | {"grp": [group]}

        chosen = docs.filter((part == round_) & ~F.coalesce(F.col(held_col), F.lit(False))).select(text_col).coalesce(trainers)
        sent = common.map_batches(chosen, [text_col], run, "part int, data binary, grp int")
        groups = trainers
        while groups > FAN:
            sent, groups = added(sent), -(-groups // FAN)
        for row in added(sent).select("part", "data").toLocalIterator():  # one table in all
            flat, at = np.frombuffer(row["data"], np.float32), 0
            for w in tables:
                own = w[row["part"] :: PARTS]
                block = flat[at : at + own.shape[0] * (own.shape[1] + 1)].reshape(own.shape[0], -1)
                at += block.size
                seen = block[:, 0] > 0
                own[seen] = np.clip(block[seen, 1:] / block[seen, :1], -WEIGHT, WEIGHT)
        shared.destroy()
    return tables


def score_documents(docs: DataFrame, held_col: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text by a model of the texts whose held_col is false.

    Returns id_col, held_col, n_tokens (words and one end), n_known (those that training text has), train_tokens,
    base_score (log10 probability by word counts plus one) and score (that by the model). A null or empty text is its
    end alone. Repeated rows are scored, and learnt from, as often as they occur; null ids stay null; without any
    training text all words are unknown. An empty table gives no rows. Texts of any length are read whole, piece by piece.
    """
    counted = gather(docs, text_col, held_col)
    known = vocabulary(counted)
    return scores(docs, counted, known, train(docs, text_col, held_col, known), held_col, id_col, text_col)


def scores(docs: DataFrame, counted: DataFrame, known: Vocabulary, tables: list[np.ndarray], held_col: str, id_col: str, text_col: str) -> DataFrame:
    """score_documents by a given model: stored counts of words, the frequent ones, and the tables."""
    shared = docs.sparkSession.sparkContext.broadcast((known, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        known, tables = shared.value
        classes, inside = with_offsets(tables, *known.offsets())
        divided = known.shared()
        gain = np.append(np.log10(known.count + 1.0), 0.0)  # the last for place -1
        slots = np.append(known.slot, 0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            size = batch.num_rows
            n, found, seen, model = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            rare: list[tuple] = []
            for t in token_groups(common.utf8(batch.column(1))):
                place = known.place(t)
                slot, own = slots[place], t.counts
                class_rows, slot_rows = rows(t)
                logs = np.empty(len(t.cls))
                for at in range(0, len(logs), SCORED):
                    cut = slice(at, at + SCORED)
                    logs[cut] = log_probability(classes, class_rows[:, cut], t.cls[cut])
                    logs[cut] += log_probability(inside, slot_rows[:, cut], slot[cut])
                logs = logs / math.log(10) + np.where(slot == 0, gain[place] - divided[t.cls], 0.0)
                n += np.bincount(t.text[own], minlength=size)
                found += np.bincount(t.text[own], place[own] >= 0, size).astype(np.int64)
                seen += np.bincount(t.text[own], gain[place[own]], size)
                model += np.bincount(t.text[own], logs[own], size)
                own = own & (place < 0)
                rare.append((t.text[own], t.hash[own], t.first[own], t.second[own]))
            text, hashed, first, second = (np.concatenate(x) for x in zip(*rare, strict=True))
            order = np.lexsort((hashed, text))
            text, first, second = text[order], first[order], second[order]
            new = np.ones(len(text), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(text)))
            cut = np.searchsorted(text[at], np.arange(size + 1))
            pairs = pa.StructArray.from_arrays([pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64)), pa.array(times)], ["first", "second", "times"])
            yield {
                "__row": row + np.arange(size), id_col: batch.column(0), held_col: batch.column(2), "n_tokens": n, "__known": found, "__seen": seen, "__model": model,
                "__rare": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pairs),
            }
            row += size

    kind = common.type_of(docs, id_col)
    schema = f"__row long, `{id_col}` {kind}, `{held_col}` boolean, n_tokens long, __known long, __seen double, __model double, __rare array<struct<first:long,second:long,times:long>>"
    local = common.stored(common.map_batches(docs, [id_col, text_col, held_col], run, schema), "scored")
    rare = local.select("__row", F.inline("__rare"))
    met = rare.join(counted, ["first", "second"])
    sums = met.groupBy("__row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("__more"), F.sum("times").alias("__found"))
    more, found = F.coalesce("__more", F.lit(0.0)), F.coalesce("__found", F.lit(0))
    return local.drop("__rare").join(sums, "__row", "left").select(
        id_col, held_col, "n_tokens", (F.col("__known") + found).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("__seen") + more - F.col("n_tokens") * F.lit(math.log10(known.total + known.distinct + 1))).alias("base_score"), (F.col("__model") + more).alias("score"),
    )


def scored_corpus(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """op5: learns from documents whose crc32(doc_id as text) mod 7 is not 2, scores all."""
    marked = docs.select("doc_id", "text", (common.id_remainder("doc_id", folds) == held).alias("held_out"))
    return score_documents(marked)
