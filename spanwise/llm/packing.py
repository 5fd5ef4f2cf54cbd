"""Packing documents into fixed-length training sequences: shortest-pack-first over the length histogram.

Documents become pieces of at most `capacity` token ids. Only the histogram of piece lengths, which has at most
`capacity` rows at any input size, reaches the driver. There lengths are placed longest first, each into the open
packs with the most room; what is kept is a pattern (how many pieces of which lengths) and how many packs have it.
Pieces then find their pack by their rank among the pieces of their length.

Size of the plan: placing a length either moves a whole group of equal packs or splits one group, so there are at
most about two groups for each length; a pack holds at most 63 different lengths, as 1+2+...+64 > 2048. The plan that
is broadcast is so bounded by the capacity and not by the data.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm import common

CAPACITY = 2048
#: Words a Python worker remembers, over all its tasks, before it starts anew.
CACHE = 400_000


class WordEncoder(dict):
    """UTF-8 words (runs without ASCII white space) to the bytes of their token ids, little-endian unsigned 32-bit.

    The tokenizer drops white space and merges never cross it, so a text's ids are its words' ids in turn. Words
    repeat, so they are kept. Words of plain characters are normalised and split here and go straight to the tokenizer's
    model, all others through the tokenizer. ASCII is plain; any other character is if the tokenizer itself, when the
    character is first met, gives the same ids as the short way, for Unicode's tables differ between versions.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.pieces: dict[str, bytes] = {}
        self.plain: set[str] = set(map(chr, range(128)))
        self.odd: set[str] = set()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self.pieces.clear()
        text = word.decode("utf-8", "replace")
        if b"<|" in word or not (text.isascii() or self.is_plain(text)):  # "<|" may begin a special token's text
            ids = self.by_tokenizer(text)
        else:
            ids = self.short_way(text)
        self[word] = ids
        return ids

    def by_tokenizer(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def short_way(self, text: str) -> bytes:
        text = "".join(c.lower() for c in unicodedata.normalize("NFC", text)) if not text.isascii() else text.lower()
        if text.isalpha():  # most words: letters alone, or letters and a sign after them
            found = (text,)
        elif text[:-1].isalpha() and text[-1] in ".,;:!?)":
            found = (text[:-1], text[-1])
        else:
            found = self.split(text)
        return b"".join([self.pieces.get(p) or self.piece(p) for p in found])

    def is_plain(self, text: str) -> bool:
        if self.plain.issuperset(text):
            return True
        for c in set(text) - self.plain - self.odd:
            # between letters, doubled, and after a digit: tells letters, numbers, marks, white space and all else apart
            probes = (f"a{c}{c}b", f"a{c}{c}b1{c}", f"{c}.")
            (self.plain if all(self.by_tokenizer(p) == self.short_way(p) for p in probes) else self.odd).add(c)
        return self.plain.issuperset(text)

    def piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isprintable() else "".join(self.letters[b] for b in piece.encode())
        ids = self.pieces[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(mapped)])
        return ids


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer; the next task finds its words again."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = True
) -> DataFrame:
    """Cuts every document's token ids, with end_id after them, into pieces of at most `capacity`.

    Returns id_col, start (ids of the document before the piece), length, doc_tokens, the crc32 of the ids and, if
    with_ids, the ids. A null or empty text is a piece of end_id alone; a null id stays null; repeated rows give repeated
    pieces; an empty table gives none. Other columns of docs are left out.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        get = encoder(tokenizer).__getitem__
        for batch in batches:
            rows, starts, lengths, totals, crcs, ids = [], [], [], [], [], []
            for i, text in enumerate(common.utf8(batch.column(1))):
                whole = b"".join(map(get, text.split())) + end
                total = len(whole) // 4
                if with_ids:
                    ids.append(whole)
                for start in range(0, total, capacity):
                    own = whole[4 * start : 4 * (start + capacity)]
                    rows.append(i), starts.append(start), lengths.append(len(own) // 4), totals.append(total)
                    crcs.append(zlib.crc32(own))
            made = {id_col: batch.column(0).take(pa.array(rows, pa.int64())), "start": starts, "length": lengths, "doc_tokens": totals, "ids_crc32": crcs}
            if with_ids:
                ends = np.cumsum([0, *lengths]).astype(np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield made

    schema = f"`{id_col}` {common.type_of(docs, id_col)}, start long, length long, doc_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return common.map_batches(docs, [id_col, text_col], run, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns for pieces counted by length: (packs, {length: pieces of it in each pack})."""
    room: dict[int, list[list]] = {}
    heights = np.zeros(capacity + 1, bool)  # which amounts of room some open pack has
    closed = []

    def put(count: int, pattern: dict, left: int) -> None:
        if left:
            room.setdefault(left, []).append([count, pattern])
            heights[left] = True
        else:
            closed.append((count, pattern))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            most = capacity - int(np.argmax(heights[::-1])) if heights.any() else 0
            if most < length:
                put(math.ceil(todo / (capacity // length)), {}, capacity)  # as many new packs as these pieces fill
                continue
            count, pattern = group = room[most][-1]
            used = min(count, todo)
            group[0] -= used
            if not group[0]:
                room[most].pop()
                heights[most] = bool(room[most])
            put(used, {**pattern, length: pattern.get(length, 0) + 1}, most - length)
            todo -= used
    merged: dict[tuple, int] = {}
    for count, pattern in [*closed, *(tuple(g) for left in sorted(room) for g in room[left])]:
        if pattern:
            key = tuple(pattern.items())
            merged[key] = merged.get(key, 0) + count
    return [(count, dict(key)) for key, count in merged.items()]


def plan_rows(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces of this length in a pack, first sequence, offset in the sequence)."""
    rows, ranks, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, many in pattern.items():
            first = ranks.get(length, 0)
            rows.append((length, first, count * many, many, sequence, offset))
            ranks[length] = first + count * many
            offset += length * many
        sequence += count
    return rows


def pack(items: DataFrame, capacity: int = CAPACITY, length_col: str = "length", heavy: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id and offset to items that each have a length from 1 to capacity.

    Items of a sequence follow each other without gaps from offset 0. Ties and repeated rows are told apart by their
    place in the stored table, so every row is placed once; an empty table gives no rows. Columns of items with the
    names it adds are replaced. A length outside 1..capacity or null is an error. Columns named in `heavy` stay out of
    the ranking and are joined to its result.
    """
    spark = items.sparkSession
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    light = [c for c in kept if c not in heavy]
    own = {c: common.free_name(items, c) for c in ("item", "salt", "n", "before", "rank", "length", "first", "ranks", "many", "sequence", "at")}
    item, salt, rank, n, prior = (own[c] for c in ("item", "salt", "rank", "n", "before"))
    table = common.stored(items.select(*kept, F.monotonically_increasing_id().alias(item)), "pieces")
    counted = {r[0]: r[1] for r in table.groupBy(length_col).count().collect()}  # at most `capacity` lengths
    if bad := [x for x in counted if x is None or not 1 <= x <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    plan = plan_rows(shortest_pack_first(counted, capacity))
    salts = max(1, math.isqrt(max(counted.values(), default=0)))  # of one length, as many groups as rows in each
    salted = table.select(*light, item, F.pmod(F.xxhash64(item), F.lit(salts)).alias(salt))
    before = Window.partitionBy(length_col).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    group = salted.groupBy(length_col, salt).agg(F.count("*").alias(n))
    group = group.select(length_col, salt, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(prior))
    inner = Window.partitionBy(length_col, salt).orderBy(item)
    ranked = salted.withColumn(rank, F.row_number().over(inner).cast("long") - 1).join(group, [length_col, salt])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(prior))
    names = ("length", "first", "ranks", "many", "sequence", "at")
    slots = spark.createDataFrame(plan, ", ".join(f"`{own[c]}` long" for c in names))
    length, first, ranks, many, sequence, at = (F.col(own[c]) for c in names)
    place = F.col(rank) - first
    hit = (F.col(length_col) == length) & (place >= 0) & (place < ranks)
    placed = ranked.join(F.broadcast(slots), hit).select(  # the plan's size is bounded by the capacity
        *light, item, (sequence + F.call_function("div", place, many)).alias("sequence_id"), (at + place % many * length).alias("offset")
    )
    if heavy:
        placed = placed.join(table.select(item, *heavy), item)
    return placed.select(*kept, "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs all documents: for each piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset, and its ids if asked for.

    Null and empty texts, null ids, repeated rows, empty tables and other columns are as in pieces() and pack().
    """
    cut = pieces(docs, tokenizer, capacity=capacity, with_ids=with_ids)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return pack(cut, capacity, heavy=("ids",) * with_ids).select(*names)
