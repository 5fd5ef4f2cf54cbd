"""Quality rules as a short-circuit cascade.

Each rule looks at one document and may reject it. On a sample the operator measures what each rule and each measure that
rules share cost, and which documents each rule rejects. The cascade begins with the rule that rejects most for its cost; each
next one is that which rejects most of the documents still left for what it costs once the measures before it are
there. A document is then judged until the first rule rejects it. The order changes the time only: a document is kept
if no rule rejects it.
"""

from __future__ import annotations

import pickle
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import common

WINDOW = 5
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
LEADING = bytes(b for b in range(256) if b & 0xC0 != 0x80)
#: Documents whose rules are timed, about, and files that they come from.
SAMPLE, PARTITIONS = 400, 8
#: Words from which on a text's windows are counted by numbers.
LONG = 50_000


def repeated_in_windows(words: list[bytes]) -> int:
    """Words in windows found twice or more, by numbers for words and windows, which take less room than tuples."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    window = ids[: len(ids) - WINDOW + 1]
    for k in range(1, WINDOW):
        _, window = np.unique(window * len(number) + ids[k : len(ids) - WINDOW + 1 + k], return_inverse=True)
    hit = np.bincount(window)[window] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


class Document:
    """A text with the measures that rules use; each is computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def decoded(self) -> list[str]:
        return [w.decode("utf-8", "replace") for w in self.words]

    @cached_property
    def word_chars(self) -> int:
        solid = self.text.translate(None, WHITE)
        return len(solid) if solid.isascii() else len(solid) - len(solid.translate(None, LEADING))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) > LONG:
            return repeated_in_windows(w)
        windows = list(zip(*(w[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        hit = np.fromiter((counts[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(w), bool)
        for k in range(WINDOW):
            covered[k : k + len(hit)] |= hit
        return int(covered.sum())

    @cached_property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < 10 or 100 * self.n_repeat_words > 20 * n


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Document], bool]


def shouted(d: Document) -> bool:
    """More than three in ten words are upper case, of those with letters that have a case, or end in two exclamation marks."""
    return 10 * sum((len(w) > 1 and w.isupper()) or w.endswith("!!") for w in d.decoded) > 3 * len(d.words)


def without_letters(d: Document) -> bool:
    """Fewer than three in ten words have a letter."""
    return 10 * sum(any(map(str.isalpha, w)) for w in d.decoded) < 3 * len(d.words)


def stuttered(d: Document) -> bool:
    """More than three in ten words equal the word before them."""
    return 10 * sum(map(bytes.__eq__, d.words, d.words[1:])) > 3 * len(d.words)


RULES = (
    Rule("too few words", lambda d: len(d.words) < 10),
    Rule("repeated passages", lambda d: 100 * d.n_repeat_words > 20 * len(d.words)),
    Rule("symbols", lambda d: 10 * d.n_symbols > len(d.words)),
    Rule("stuttering", stuttered),
    Rule("repeated lines", lambda d: 10 * d.n_dup_lines > 5 * len(d.lines)),
    Rule("word lengths", lambda d: not 2 * len(d.words) <= d.word_chars <= 20 * len(d.words)),
    Rule("shouting", shouted),
    Rule("no letters", without_letters),
)


#: What rules may share.
MEASURES = ("words", "decoded", "word_chars", "n_symbols", "lines", "n_dup_lines", "n_repeat_words")


def _timed(name: str) -> cached_property:
    measure = getattr(Document, name).func

    def value(self):
        began = time.perf_counter()
        self.inner.append(0.0)
        found = measure(self)
        took = time.perf_counter() - began
        within = self.inner.pop()
        if self.inner:
            self.inner[-1] += took
        self.spent[name] = took - within
        return found

    made = cached_property(value)
    made.__set_name__(None, name)
    return made


class Timed(Document):
    """A document that knows how long each of its measures took, without those that it used."""

    def __init__(self, text: bytes):
        super().__init__(text)
        self.spent: dict[str, float] = {}
        self.inner: list[float] = []


for _name in MEASURES:
    setattr(Timed, _name, _timed(_name))


class Costs(NamedTuple):
    """By rule: its seconds without measures, and the measures it used. By measure: its seconds each time. And how many documents
    were rejected by which rules (as bits)."""

    own: list[float]
    used: list[frozenset[str]]
    measures: dict[str, float]
    rejected: Counter

    def plus(self, other: Costs) -> Costs:
        own, used = [a + b for a, b in zip(self.own, other.own, strict=True)], [a | b for a, b in zip(self.used, other.used, strict=True)]
        return Costs(own, used, {k: max(self.measures.get(k, 0.0), v) for k, v in (self.measures | other.measures).items()}, self.rejected + other.rejected)


def costs(texts: Iterable[bytes], rules: tuple[Rule, ...]) -> Costs:
    """What the rules cost and reject, each on a document of its own."""
    own, used, spent, times, rejected = [0.0] * len(rules), [frozenset()] * len(rules), Counter(), Counter(), Counter()
    for text in texts:
        bits = 0
        for k, rule in enumerate(rules):
            document = Timed(text)
            began = time.perf_counter()
            bits |= bool(rule.rejects(document)) << k
            own[k] += time.perf_counter() - began - sum(document.spent.values())
            used[k] |= document.spent.keys()
            spent.update(document.spent)
            times.update(document.spent.keys())
        rejected[bits] += 1
    return Costs(own, used, {k: spent[k] / times[k] for k in spent}, rejected)


def by_worth(found: Costs) -> list[int]:
    """The rules, each next one that with the most rejections of what is left by cost, given the measures that are there."""
    left, ready, order, many = dict(found.rejected), set(), [], sum(found.rejected.values())

    def worth(k: int) -> float:
        cost = max(found.own[k], 0.0) + many * sum(found.measures.get(m, 0.0) for m in found.used[k] - ready)
        return sum(n for bits, n in left.items() if bits >> k & 1) / max(cost, 1e-9)

    open_ = list(range(len(found.own)))
    while open_:
        best = max(open_, key=lambda k: (worth(k), -k))
        open_.remove(best)
        order.append(best)
        ready |= found.used[best]
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def sampled(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Texts to time the rules on, about `sample`: the first ones of a few files spread over the table, so that the rest is not read.

    Where docs does not come from Parquet files that have the column, rows are drawn from all of it.
    """
    files = sorted(docs.inputFiles())
    chosen = [files[k] for k in sorted({k * len(files) // PARTITIONS for k in range(PARTITIONS)})] if files else []
    if chosen and all(f.endswith(".parquet") for f in chosen):
        read = [docs.sparkSession.read.parquet(f) for f in chosen]
        if all(text_col in r.columns for r in read):
            return reduce(DataFrame.unionByName, [r.select(text_col).limit(-(-sample // len(read))) for r in read])
    total = docs.select(F.lit(1)).count()
    return docs.select(text_col).sample(min(1.0, sample / max(total, 1)), seed=7)


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules in the order of the cascade, estimated on sampled(). Sums reach the driver. Without texts the order stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        texts = [t for batch in batches for t in common.utf8(batch.column(0))]
        if texts:
            yield {"found": [pickle.dumps(costs(texts, rules))]}

    found = common.map_batches(sampled(docs, text_col, sample), [text_col], run, "found binary").collect()  # a row for each file
    return tuple(rules[k] for k in by_worth(reduce(Costs.plus, [pickle.loads(r[0]) for r in found]))) if found else rules


def verdict(document: Document, cascade: tuple[Rule, ...]) -> str | None:
    """The first rule of the cascade that rejects the document."""
    return next((r.name for r in cascade if r.rejects(document)), None)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base measures and the verdict for every document.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept (false if the base
    fails or a rule rejects). A null text has no words and fails. Repeated rows are judged each, null ids stay null, an
    empty table gives no rows; other columns are left out.
    """
    cascade = ordered(docs, rules, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [Document(t) for t in common.utf8(batch.column(1))]
            yield {
                id_col: batch.column(0), "n_words": [len(d.words) for d in found], "word_chars": [d.word_chars for d in found],
                "n_symbols": [d.n_symbols for d in found], "n_dup_lines": [d.n_dup_lines for d in found],
                "n_repeat_words": [d.n_repeat_words for d in found], "base_failed": [d.base_failed for d in found],
                "kept": [not d.base_failed and verdict(d, cascade) is None for d in found],
            }

    schema = f"`{id_col}` {common.type_of(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return common.map_batches(docs, [id_col, text_col], run, schema)


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns; each is judged until the first rule that rejects it.

    Null and empty texts have too few words and go; null ids and repeated rows are judged like any other; an empty table
    gives no rows.
    """
    common.prepare(docs.sparkSession)
    cascade = ordered(docs, rules, text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [verdict(Document(t), cascade) is None for t in common.utf8(batch.column(place))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
