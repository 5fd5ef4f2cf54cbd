"""SimHash near-duplicates with BK-trees.

Each document has a 64-bit fingerprint of its word shingles; fingerprints within `radius` bits are linked, and linked
documents form groups. Two 64-bit values that differ in at most 3 bits agree in at least two of five blocks of bits, so
equal values of a pair of blocks (ten pairs, 25 or 26 bits each) bring every link together in some shard. A shard with
more than CROWDED fingerprints is divided in the same way by its members' other bits, and once more, after which
15 bits are left; so no shard has more than 2^15 fingerprints, whatever the corpus, and no link is lost. In each
shard the fingerprints form a BK-tree: a node's children are keyed by their Hamming distance to it, and a search
follows only edges within the radius of the distance it has found.

The trees travel by the shuffle that forms the shards and not by a broadcast from the driver, as together they are as
large as the corpus's fingerprints. Copies are one fingerprint before that, and a shard passes on a spanning
forest of its links and not its pairs, so groups of any size stay linear in rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm import common

WIDTH, SEED, RADIUS = 3, 42, 3
#: Bits of the five blocks: of the fingerprint, of what is left of it when two blocks are equal, and of what is then left.
LEVELS = ((13, 13, 13, 13, 12), (8, 8, 8, 8, 7), (5, 5, 5, 5, 4))
#: Distinct fingerprints from which on a shard is divided.
CROWDED = 1 << 12
#: Shingles whose bits are counted at once, search states that a block of queries may make, and rows read ahead of a shard.
SLICE, FRONTIER, READ_AHEAD = 1 << 16, 1 << 20, 200_000
#: For near-duplicates by similarity: words in a shingle, 64-bit fingerprints that are compared, and of their 512 bits those in which
#: candidates may differ.
NEAR_WIDTH, NEAR_WORDS, NEAR_RADIUS = 5, 8, 104
#: Sketches and texts that one task compares within a shard; larger shards are dealt out and what is left of each part meets again.
SKETCHES, TEXTS = 1 << 15, 1 << 9
#: Two sets are similar if they share SIMILAR[0] parts in SIMILAR[1] of what either has; shingles compared at once.
SIMILAR, COMPARED = (4, 5), 1 << 21
#: Exact search for links between groups: bits of a parity sketch at most, nodes of a shingle that one task compares, shingles counted at
#: once, how often one must then be met to be listed, and the most frequent ones that every task knows.
PARITY_BITS, MEETING, COUNTED, OFTEN, FREQUENT = 1 << 15, 1 << 12, 1 << 21, 3, 1 << 16
#: Bands of minima of the five-word shingles that bring candidates together, minima in a band, and each minimum's multiplier.
BANDS, BAND_ROWS = 16, 4
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)


#: For each value of a byte, its bits, the lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_values(words: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of width words, repeats included; of all words together if they are fewer; none of no words."""
    from xxhash import xxh64_intdigest

    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - width + 1)


def majority(values: np.ndarray) -> int:
    """The bits that are set in more than half of the values; 0 for none."""
    counts = np.zeros((8, 256), np.int64)
    place = np.arange(8) * 256
    for at in range(0, len(values), SLICE):
        octets = values[at : at + SLICE].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        counts += np.bincount((octets + place).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits((2 * (counts @ BITS) > len(values)).ravel(), bitorder="little").view("<u8")[0])


def fingerprint(words: list[bytes], width: int = WIDTH, seed: int = SEED) -> int:
    return majority(shingle_values(words, width, seed))


def remixed(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of further hash values; the 0-th is the value itself."""
    if not k:
        return values
    h = (values ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """id_col and the fingerprint as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            made = [fingerprint(t.lower().split(), width, seed) for t in common.utf8(batch.column(1))]
            yield {id_col: batch.column(0), "fp": np.array(made, np.uint64).view(np.int64)}

    return common.map_batches(docs, [id_col, text_col], run, f"`{id_col}` {common.type_of(docs, id_col)}, fp long")


class Forest:
    """BK-trees over runs of equal keys. Keys are sorted; values, one row of 64-bit words each, are distinct in a run."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        n = len(values)
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if n else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        self.values, self.root = values, starts[np.cumsum(first) - 1] if n else starts
        self.parent, self.edge, self.levels = np.full(n, -1), np.zeros(n, np.int64), []
        todo = np.flatnonzero(~first)
        under = self.root[todo]
        while len(todo):  # each round hangs one more node for each distance under each node that it reaches
            d = self.distance(todo, under)
            order = np.lexsort((todo, d, under))
            todo, under, d = todo[order], under[order], d[order]
            new = np.concatenate(([True], (under[1:] != under[:-1]) | (d[1:] != d[:-1])))
            child = todo[new][np.cumsum(new) - 1]
            self.parent[todo[new]], self.edge[todo[new]] = under[new], d[new]
            self.levels.append(todo[new])
            todo, under = todo[~new], child[~new]
        self.children = np.argsort(self.parent, kind="stable")[len(starts) :]
        self.first = np.searchsorted(self.parent[self.children], np.arange(n + 1))

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.values[a] ^ self.values[b]).sum(axis=1, dtype=np.int64)

    def uniform(self, group: np.ndarray) -> np.ndarray:
        """For each node the group that its whole subtree belongs to, or -1. A level is complete before the one above."""
        lo, hi = group.copy(), group.copy()
        for nodes in reversed(self.levels):
            np.minimum.at(lo, self.parent[nodes], lo[nodes])
            np.maximum.at(hi, self.parent[nodes], hi[nodes])
        return np.where(lo == hi, lo, -1)

    def near(self, queries: np.ndarray, radius: int, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius and not in one group yet, each query searched in its own tree.

        Follows only edges within the radius of the distance found, and leaves out subtrees of the query's own group.
        """
        whole = self.uniform(group)
        q, node = queries, self.root[queries]
        while len(q):
            other = whole[node] != group[q]
            q, node = q[other], node[other]
            d = self.distance(q, node)
            hit = d <= radius
            yield q[hit], node[hit]
            many = self.first[node + 1] - self.first[node]
            at = np.repeat(self.first[node] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            child, q, d = self.children[at], np.repeat(q, many), np.repeat(d, many)
            follow = np.abs(self.edge[child] - d) <= radius
            q, node = q[follow], child[follow]


def joined_groups(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups, named by their least member, after a's and b's have been joined pair by pair."""
    while True:
        x, y = group[a], group[b]
        apart = x != y
        if not apart.any():
            return group
        a, b = a[apart], b[apart]
        np.minimum.at(group, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(short := group[group], group):
            group = short


class Runs:
    """Runs of equal keys without a tree, for radii at which a tree would leave out nothing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        self.values, self.root, self.end = values, starts[run], np.append(starts[1:], len(keys))[run]

    def near(self, queries: np.ndarray, radius: int, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, later node of its run) within the radius and not in one group yet, some queries at a time."""
        many = self.end[queries] - queries - 1
        upto, at = np.cumsum(many), 0
        while at < len(queries):
            done = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + FRONTIER // self.values.shape[1], "right")))
            own, n = queries[at:end], many[at:end]
            q = np.repeat(own, n)
            node = q + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            other = group[node] != group[q]
            q, node = q[other], node[other]
            hit = np.bitwise_count(self.values[q] ^ self.values[node]).sum(axis=1, dtype=np.int64) <= radius
            yield q[hit], node[hit]
            at = end


def spanning(keys: np.ndarray, values: np.ndarray, radius: int, kind: type = Forest) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within each run of equal keys, as positions: (least member, other member).

    Queries come in growing blocks. A large group is found by its first queries, and then the others pass it by.
    """
    shared = np.zeros(len(keys), bool)
    shared[1:] = keys[1:] == keys[:-1]
    shared[:-1] |= shared[1:]
    own = np.flatnonzero(shared)
    if not len(own):
        return own, own
    values = values[own].reshape(len(own), -1)
    forest, group = kind(keys[own], values), np.arange(len(own))
    # the first queries of every run before the second ones, and so on: all runs shrink alike
    rank = np.arange(len(own)) - forest.root
    order = np.argsort(rank, kind="stable")
    sizes = np.bincount(forest.root, minlength=len(own))[forest.root][order]
    work, at, block = np.concatenate(([0], np.cumsum(sizes))), 0, FRONTIER >> 5
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(work, work[at] + block, "right")) - 1)
        for q, node in forest.near(order[at:end], radius, group):
            group = joined_groups(group, q, node)
        at, block = end, min(2 * block, FRONTIER)
    other = np.flatnonzero(group != np.arange(len(own)))
    return own[group[other]], own[other]


def sharded(shards: DataFrame, columns: list[str], fn, schema: str, ahead: int = READ_AHEAD) -> DataFrame:
    """Runs fn over whole shards: rows with equal `key` meet, sorted, and reach fn in lists of batches that end with a shard.

    A task holds about `ahead` rows, or its largest shard if that has more.
    """
    spread = shards.select("key", *columns).repartition(common.shuffle_partitions(shards.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table, held = None, []

        def close(last: bool):
            nonlocal table, held
            whole = pa.Table.from_batches(([] if table is None else table.to_batches()) + held)
            held = []
            keys = whole.column(0).to_numpy()
            end = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
            table = whole.slice(end)
            return fn(keys[:end], whole.slice(0, end))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ahead:
                yield close(False)
        if held or table is not None:
            yield close(True)

    return common.map_batches(spread, ["key", *columns], run, schema)


def subkeys(key: Column, rest: Column, widths: tuple[int, ...]) -> Column:
    """For each pair of rest's five blocks: key, lengthened by the pair and the two blocks, and the other three blocks as rest."""
    starts = [sum(widths[:k]) for k in range(5)]
    block = [F.shiftrightunsigned(rest, lo).bitwiseAND((1 << bits) - 1) for lo, bits in zip(starts, widths, strict=True)]
    wide, found = widths[0], []
    for k, (i, j) in enumerate(combinations(range(5), 2)):
        own = F.lit(k << 2 * wide).cast("long") + F.shiftleft(block[i], wide) + block[j]
        left, at = F.lit(0).cast("long"), 0
        for m in set(range(5)) - {i, j}:
            left, at = left + F.shiftleft(block[m], at), at + widths[m]
        found.append(F.struct(F.shiftleft(key, 2 * wide + 4).bitwiseOR(own).alias("key"), left.alias("rest")))
    return F.array(*found)


def links(prints: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """A spanning set of links (a, b) between distinct fingerprints (column fp) at most `radius` bits apart."""
    if radius > 3:
        raise ValueError("five blocks of which two agree find every link up to three bits only")

    def run(keys: np.ndarray, rows: pa.Table) -> dict:
        fp = rows.column(1).to_numpy()
        a, b = spanning(keys, fp.view(np.uint64), radius)
        return {"a": fp[a], "b": fp[b]}

    rows, made = prints.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp"), []
    for level, widths in enumerate(LEVELS):
        rows = rows.select("fp", F.inline(subkeys(F.col("key"), F.col("rest"), widths)))
        whole = rows
        if level + 1 < len(LEVELS):
            full = common.stored(rows.groupBy("key").count().filter(F.col("count") > crowded).select("key"), "crowded")
            if divided := not full.isEmpty():
                whole = rows.join(full, "key", "left_anti")
        else:
            divided = False
        made.append(sharded(whole, ["fp"], run, "a long, b long"))
        if not divided:
            break
        rows = common.stored(rows.join(full, "key", "left_semi"), "divided")
    return reduce(DataFrame.unionByName, made).distinct()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The distinct five-word shingles, sorted; one value of its own for no words."""
    return np.unique(shingle_values(words, NEAR_WIDTH)) if words else np.zeros(1, np.uint64)


def bands(values: np.ndarray) -> np.ndarray:
    """BANDS keys, each of BAND_ROWS minima over the values: two sets share one with the probability of their similarity to that power.

    They are at least 2^62, above all keys of blocks.
    """
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(values), SLICE // 16):
        np.minimum(least, (values[at : at + SLICE // 16, None] * MULTIPLIERS).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BAND_ROWS, BANDS):
        key = remixed(key ^ row, 1)
    return (key >> np.uint64(2) | np.uint64(1 << 62)).view(np.int64)


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, `print` (a digest of the set of five-word shingles), `near` (NEAR_WORDS 64-bit fingerprints of that set, as bytes; the
    first is the set's SimHash) and `bands` (keys of its minima). A few rows carry, in `often` and `times`, the shingles that
    several sets among the rows before have, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, sets, counted = None, {}, 0
        for batch in batches:
            prints, near, minima = [], [], []
            for text in common.utf8(batch.column(1)):
                values = shingle_set(text.lower().split())
                prints.append(hashlib.blake2b(values.tobytes(), digest_size=16).hexdigest())
                near.append(np.array([majority(remixed(values, k)) for k in range(NEAR_WORDS)], "<u8"))
                minima.append(bands(values))
                if prints[-1] not in sets:
                    sets[prints[-1]], counted = values, counted + len(values)
            if held:
                yield held
            first, none = np.array([x[0] for x in near], np.uint64).view(np.int64), [None] * len(prints)
            held = {id_col: batch.column(0), "print": prints, "fp": first, "near": [x.tobytes() for x in near], "bands": [m.tolist() for m in minima], "often": none, "times": none}
            if counted >= COUNTED and prints:
                held, sets, counted = held | repeated(sets, len(prints)), {}, 0
        if held:
            yield held | repeated(sets, len(held["print"])) if sets and held["print"] else held

    kinds = "print string, fp long, near binary, bands array<long>, often array<long>, times array<long>"
    return common.map_batches(docs, [id_col, text_col], run, f"`{id_col}` {common.type_of(docs, id_col)}, {kinds}")


def repeated(sets: dict[str, np.ndarray], rows: int) -> dict:
    """The shingles that OFTEN or more of the sets have, and in how many, as columns of so many rows, in the first."""
    values, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    some = times >= OFTEN
    return {"often": [values[some].view(np.int64)] + [None] * (rows - 1), "times": [times[some]] + [None] * (rows - 1)}


def centres(members: DataFrame, prints: DataFrame) -> DataFrame:
    """Stored (key, pivot): the node of each key whose wide fingerprint is nearest to the majority of the key's, bit by bit; the least
    of equals. members: stored (key, node, parts); the majority is taken over one in `parts` nodes, by lot."""

    def majorities(keys: np.ndarray, rows: pa.Table) -> dict:
        bits = np.unpackbits(np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(len(keys), -1), axis=1)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.int64) if len(keys) else bits[:0]
        centre = np.packbits(2 * sums > np.diff(np.append(first, len(keys)))[:, None], axis=1)
        return {"key": keys[first], "centre": [x.tobytes() for x in centre]}

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            yield {"key": batch.column(0), "node": batch.column(1), "d": np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)}

    some = members.filter(F.pmod(F.xxhash64("node", F.lit("centre")), F.col("parts")) == 0).join(prints, "node")
    middle = common.stored(sharded(some, ["near"], majorities, "key long, centre binary"), "centres")
    each = common.map_batches(members.join(prints, "node").join(middle, "key"), ["key", "node", "near", "centre"], distances, "key long, node long, d long")
    return common.stored(each.groupBy("key").agg(F.min(F.struct("d", "node")).alias("m")).select("key", F.col("m.node").alias("pivot")), "pivots")


def linked(
    shards: DataFrame, payload: DataFrame, column: str, prints: DataFrame, limit: int, roots: Callable[[np.ndarray, pa.ChunkedArray], np.ndarray],
) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) between nodes that roots() puts into one group, and what is left. shards: stored (key, node); payload: (node,
    column); prints: (node, near).

    roots() gets sorted keys and the column and returns for each row the position of the first row of its group. A
    shard of more than `limit` nodes is dealt out by lot, and the node in its middle (see centres) goes to every part, so that copies
    of one text, which may be less like one another than like that text, are linked by it. The first node of each group
    of each part then meets those of the other parts, again and again while there are too many and each round leaves out a quarter at
    least. So no task holds more than about `limit` nodes of a shard. A node that left such a shard was linked to one that
    stayed. Where the rounds ended because nodes are too unlike one another, those that stayed are left, as (key, node).
    """
    made, level = [], 0
    while True:
        full = common.stored(shards.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("key", F.ceil(F.col("n") / limit).alias("parts")), "full")
        last = full.isEmpty()
        if last:
            dealt = shards.select("key", "node", F.lit(None).cast("long").alias("whole"))
        else:
            members = common.stored(shards.join(full, "key"), "members")
            before = members.count()
            of = lambda number: F.xxhash64("key", number).alias("key")
            parts = members.select(of(F.pmod(F.xxhash64("node", F.lit(level)), F.col("parts"))), "node", F.col("key").alias("whole"))
            none = F.lit(None).cast("long").alias("whole")
            middle = centres(members, prints).join(full, "key").select("key", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
            small = shards.join(full, "key", "left_anti").select("key", "node", none)
            dealt = small.unionByName(parts).unionByName(middle.select(of(F.col("part")), F.col("pivot").alias("node"), none))

        def run(keys: np.ndarray, rows: pa.Table) -> dict:
            node, whole = rows.column(1).to_numpy(), rows.column(2).combine_chunks()
            root = node[roots(keys, rows.column(3))]
            own = (node != root) | whole.is_valid().to_numpy(zero_copy_only=False)
            return {"a": root[own], "b": node[own], "whole": whole.filter(pa.array(own))}

        rows = dealt.join(payload, "node")
        out = common.stored(sharded(rows, ["node", "whole", column], run, "a long, b long, whole long", min(limit, READ_AHEAD)), "linked")
        made.append(out.filter("a <> b").select("a", "b"))
        if last:
            return reduce(DataFrame.unionByName, made).distinct(), None
        left = common.stored(out.filter("a = b and whole is not null").select(F.col("whole").alias("key"), F.col("a").alias("node")).distinct(), "left")
        shards, level = left, level + 1
        if 4 * left.count() > 3 * before:
            return reduce(DataFrame.unionByName, made).distinct(), left


def met(nodes: DataFrame) -> DataFrame:
    """Stored (key, node): the bands that several nodes have, each with its nodes. Light rows only."""

    def run(keys: np.ndarray, rows: pa.Table) -> dict:
        shared = np.zeros(len(keys), bool)
        shared[1:] = keys[1:] == keys[:-1]
        shared[:-1] |= shared[1:]
        return {"key": keys[shared], "node": rows.column(1).to_numpy()[shared]}

    return common.stored(sharded(nodes.select(F.explode("bands").alias("key"), "node"), ["node"], run, "key long, node long"), "met")


def sketch_roots(keys: np.ndarray, near: pa.ChunkedArray, radius: int = NEAR_RADIUS) -> np.ndarray:
    """For linked(): groups of equal keys whose wide fingerprints are connected by differences of at most `radius` bits."""
    values = np.frombuffer(b"".join(near.to_pylist()), np.uint64).reshape(-1, NEAR_WORDS)
    a, b = spanning(keys, values, radius, Runs)
    root = np.arange(len(keys))
    root[b] = a
    return root


def text_roots(keys: np.ndarray, texts: pa.ChunkedArray) -> np.ndarray:
    """For linked(): groups of equal keys connected by exact similarity of the texts' sets of shingles."""
    texts = common.utf8(texts)
    root = np.arange(len(keys))
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(edges, edges[1:], strict=False):
        root[a:b] = a + similar_groups([shingle_set(t.lower().split()) for t in texts[a:b]])
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge (a, b): root is the smallest node it is connected with.

    Alternating star contractions: every node's larger neighbours, then every node's smaller ones, are hung under the
    least neighbour, until each node hangs under its root. Each step is stored. Minima are combined before the
    shuffle, and the joins read stored tables on both sides, so Spark can split a hub's rows over tasks.
    """
    edges = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())

    def step(df: DataFrame, both: bool) -> DataFrame:
        around = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else df
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = common.stored(least, "least")
        joined = around.join(least, "u")
        if both:  # larger neighbours
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # smaller neighbours, and the node itself
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return common.stored(out.filter("u <> v").distinct(), "edges")

    before = None
    while before != (before := state(edges)):
        edges = step(step(edges, True), False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def similar_groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the position of the first one that it is connected with by pairs of exact similarity SIMILAR or more.

    A set is compared with those that no group has taken yet, so a group of near copies of one another is found by its first.
    """
    part, whole = SIMILAR
    sizes = np.array([len(x) for x in sets])
    first = np.concatenate(([0], np.cumsum(sizes)))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked, group, left = np.zeros(len(values), bool), np.full(len(sets), -1), np.arange(len(sets))
    while len(left):
        start, todo = left[0], [left[0]]
        group[start], left = start, left[1:]
        while todo and len(left):
            q = todo.pop()
            marked[ids[first[q] : first[q + 1]]] = True
            fit = left[whole * np.minimum(sizes[left], sizes[q]) >= part * np.maximum(sizes[left], sizes[q])]
            ends = np.cumsum(sizes[fit])
            at = 0
            while at < len(fit):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + COMPARED)))
                some = fit[at:end]
                begin = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                shared = np.add.reduceat(marked[ids[np.repeat(first[some] - begin, sizes[some]) + np.arange(sizes[some].sum())]], begin, dtype=np.int64)
                hit = some[whole * shared >= part * (sizes[q] + sizes[some] - shared)]
                group[hit], at = start, end
                todo.extend(hit)
            marked[ids[first[q] : first[q + 1]]] = False
            left = left[group[left] < 0]
    return group


def confirmed(candidates: DataFrame, shards: DataFrame, prints: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between candidates (node, root: its component) by exact similarity.

    The texts of a component meet in one shard, so a pair that might be similar is compared; of a component of more than
    TEXTS nodes they meet in parts. What is left of a large component whose nodes are unlike one another meets by the bands
    that brought it together (shards).
    """
    every = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
    every = common.stored(every.select(F.col("root").alias("key"), "node"), "every")
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    texts = common.stored(texts.join(every.select("node"), "node"), "texts")  # of candidates: later joins read no others
    found, left = linked(every, texts, "text", prints, TEXTS, text_roots)
    if left is None:
        return found
    rest = common.stored(shards.join(left.select("node").distinct(), "node", "left_semi").select("key", "node"), "rest")
    return found.unionByName(linked(rest, texts, "text", prints, TEXTS, text_roots)[0]).distinct()


def frequent(prints: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles met in most sets, by value, and in how many they were met: at most FREQUENT, from the lists in wide prints.

    They only say which shingles are looked up last, so what the lists leave out costs time and loses no link.
    """
    each = prints.filter("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("n"))
    each = common.stored(each.select("often", "n", F.floor(8 * F.log2("n")).alias("size")), "often")
    least, many = 1 << 10, 0
    for size, n in sorted(each.groupBy("size").count().collect(), reverse=True):
        if (many := many + n) > FREQUENT:
            break
        least = size
    table = each.filter(F.col("size") >= least).select("often", "n").toArrow()
    values, times = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(values)
    return values[order], times[order]


def prefix(values: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, frequent ones last: two sets that are similar have one of these in common.

    A similar set shares ceil(n * part / whole) of n shingles at least, so of those it shares the first in any order that is the
    same for all sets stands no later than this.
    """
    part, whole = SIMILAR
    if len(often):
        at = np.minimum(np.searchsorted(often, values), len(often) - 1)
        values = values[np.argsort(np.where(often[at] == values, times[at], 0), kind="stable")]
    return values[: len(values) + (-part * len(values) // whole) + 1]


def parity(values: np.ndarray) -> bytes:
    """Bits, two to four for each shingle (64 and PARITY_BITS are the limits), that tell if an odd number of shingles falls on each.

    Two sets differ in as many shingles at least as these differ in bits. Half as many bits are the halves' exclusive or.
    """
    bits = min(PARITY_BITS, max(64, 1 << (2 * len(values) - 1).bit_length()))
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def marks(docs: DataFrame, id_col: str, text_col: str, often: np.ndarray, times: np.ndarray) -> DataFrame:
    """node (the id), size of the set of shingles, its parity sketch, and its prefix as keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(t.lower().split()) for t in common.utf8(batch.column(1))]
            keys = [prefix(x, often, times).view(np.int64) for x in sets]
            yield {"node": batch.column(0), "size": [len(x) for x in sets], "parity": [parity(x) for x in sets], "keys": keys}

    return common.map_batches(docs, [id_col, text_col], run, "node long, size long, parity binary, keys array<long>")


def apart(rows: DataFrame) -> DataFrame:
    """Stored (key, node): of rows (key, node, root) those whose key has several roots. Light rows only."""

    def run(keys: np.ndarray, rows: pa.Table) -> dict:
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        root = rows.column(2).to_numpy()
        several = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first) if len(keys) else np.zeros(0, bool)
        own = np.repeat(several, np.diff(np.append(first, len(keys))))
        return {"key": keys[own], "node": rows.column(1).to_numpy()[own]}

    return common.stored(sharded(rows, ["node", "root"], run, "key long, node long"), "apart")


def close_pairs(keys: np.ndarray, root: np.ndarray, size: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions with equal keys and different roots that sizes and parity sketches do not show to be dissimilar."""
    part, whole = SIMILAR
    order = np.lexsort((size, keys))
    keys, root, size = keys[order], root[order], size[order]
    run = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1]))) << 40
    many = np.searchsorted(run + size, run + size * whole // part, "right") - np.arange(len(keys)) - 1
    width = np.array([len(sketches[k]) for k in order])
    table = lambda rows, w: np.frombuffer(b"".join(sketches[order[k]] for k in rows), np.uint64).reshape(len(rows), w // 8)
    tables, place = {}, {}
    for w in np.unique(width).tolist():  # sketches of this width, and those of twice as much, folded
        own, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        wide = table(twice, 2 * w)
        tables[w], place[w] = np.concatenate((table(own, w), wide[:, : w // 8] ^ wide[:, w // 8 :])), np.zeros(len(keys), np.int64)
        place[w][np.concatenate((own, twice))] = np.arange(len(own) + len(twice))
    upto, at = np.cumsum(many), 0
    while at < len(keys):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FRONTIER, "right")))
        n = many[at:end]
        q = np.repeat(np.arange(at, end), n)
        node = q + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = root[q] != root[node]
        q, node = q[other], node[other]
        common_width = np.minimum(width[q], width[node])
        for w in np.unique(common_width).tolist():
            own = np.flatnonzero(common_width == w)
            step = FRONTIER * 8 // w
            for x in (own[k : k + step] for k in range(0, len(own), step)):
                a, b = q[x], node[x]
                d = np.bitwise_count(tables[w][place[w][a]] ^ tables[w][place[w][b]]).sum(axis=1, dtype=np.int64)
                hit = (whole + part) * d <= (whole - part) * (size[a] + size[b])
                yield order[a[hit]], order[b[hit]]
        at = end


def dealt_out(shards: DataFrame, rooted: DataFrame) -> DataFrame:
    """shards (stored: key, node) with those of more than MEETING nodes replaced by blocks, in which each two nodes of different roots meet.

    A root with many nodes of a shard makes parts of its own, the other roots share parts. Every part meets every other, and
    itself if several roots share it, but not the other parts of its root.
    """
    half = MEETING // 2
    full = common.stored(shards.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > MEETING).select("key"), "full")
    if full.isEmpty():
        return shards
    hot = common.stored(shards.join(full, "key").join(rooted, "node"), "hot")
    each = common.stored(hot.groupBy("key", "root").agg(F.count("*").alias("n")), "each")
    small = each.filter(F.col("n") <= half).groupBy("key").agg(F.ceil(F.sum("n") / half).alias("parts"))
    own = F.when(F.col("n") > half, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / half)))).otherwise(F.pmod(F.xxhash64("root"), F.col("parts")))
    members = hot.join(each, ["key", "root"]).join(small, "key", "left").select("key", "node", own.alias("part"), F.when(F.col("n") > half, F.col("root")).alias("whole"))
    members = common.stored(members, "members")
    parts = common.stored(members.select("key", "part", "whole").distinct(), "parts")
    other = parts.select("key", F.col("part").alias("with"), F.col("whole").alias("with_whole"))
    met_by = parts.join(other, "key").filter(F.col("whole").isNull() | F.col("with_whole").isNull() | (F.col("whole") != F.col("with_whole")))
    blocks = met_by.select("key", "part", F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with")).alias("block"))
    dealt = members.join(blocks.distinct(), ["key", "part"]).select(F.col("block").alias("key"), "node")
    return shards.join(full, "key", "left_anti").unionByName(dealt)


def similar_pairs(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored: of the pairs (stored: a, b, distinct) those whose sets are similar. A task compares a node with about TEXTS others."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / TEXTS).alias("parts"))
    stars = common.stored(pairs.join(many, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("key"), "a", "b"), "stars")
    middles = stars.select("key", F.col("a").alias("node"), F.lit(True).alias("middle")).distinct()
    ends = common.stored(middles.unionByName(stars.select("key", F.col("b").alias("node"), F.lit(False).alias("middle"))), "ends")
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    texts = common.stored(texts.join(ends.select("node").distinct(), "node"), "texts")

    def run(keys: np.ndarray, rows: pa.Table) -> dict:
        part, whole = SIMILAR
        node, middle = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        sets, found = [shingle_set(t.lower().split()) for t in common.utf8(rows.column(3))], []
        for k in np.flatnonzero(middle):
            start, end = np.searchsorted(keys, keys[k], "left"), np.searchsorted(keys, keys[k], "right")
            for m in start + np.flatnonzero(~middle[start:end]):
                shared = len(np.intersect1d(sets[k], sets[m], assume_unique=True))
                if whole * shared >= part * (len(sets[k]) + len(sets[m]) - shared):
                    found.append((node[k], node[m]))
        return {"a": [a for a, _ in found], "b": [b for _, b in found]}

    return common.stored(sharded(ends.join(texts, "node"), ["node", "middle", "text"], run, "a long, b long", TEXTS), "similar")


def missed(docs: DataFrame, id_col: str, text_col: str, prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """Stored links (a, b): all pairs of nodes of different groups whose sets are similar. rooted: stored (node, root).

    Similar sets have a shingle of their prefixes in common, so nodes meet by these. Shingles that one group alone has are
    left out, so a group of copies is not compared with itself. Pairs that the parity sketches leave are confirmed by the
    sets themselves. Nothing here may lose a pair.
    """
    marked = common.stored(marks(docs, id_col, text_col, *frequent(prints)).join(rooted, "node"), "marked")
    shards = dealt_out(apart(marked.select(F.explode("keys").alias("key"), "node", "root")), rooted)

    def run(keys: np.ndarray, rows: pa.Table) -> dict:
        node, found = rows.column(1).to_numpy(), [np.zeros((0, 2), np.int64)]
        if len(keys):
            for a, b in close_pairs(keys, rows.column(2).to_numpy(), rows.column(3).to_numpy(), rows.column(4).to_pylist()):
                found.append(np.unique(np.sort(np.stack((node[a], node[b]), axis=1), axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return {"a": pairs[:, 0], "b": pairs[:, 1]}

    rows = shards.join(marked.select("node", "root", "size", "parity"), "node")
    close = sharded(rows, ["node", "root", "size", "parity"], run, "a long, b long", 4 * MEETING)
    return similar_pairs(common.stored(close.distinct(), "close"), docs, id_col, text_col)


def grouped(prints: DataFrame, member: str, radius: int = RADIUS) -> DataFrame:
    """Stored rows (member, fp) with `first`, the smallest member of everything reachable by links.

    Null members do not count as smallest unless a group has no other; an empty table gives no rows.
    """
    distinct = common.stored(prints.groupBy("fp").agg(F.min(member).alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = common.stored(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    first = common.stored(rooted.groupBy("root").agg(F.min("least").alias("first")), "first")
    named = common.stored(rooted.join(first, "root").select("fp", "first"), "named")
    return common.split_join(prints, named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Every document's fingerprint as 16 hex digits and component_id, the smallest id reachable by links.

    Documents without words have fingerprint zero and are linked like any other. Repeated rows stay; an empty table
    gives none; null ids stay null and name a component only if it has no other id.
    """
    prints = common.stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return grouped(prints, id_col, radius).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, first): the smallest id of the group of documents connected by pairs with a Jaccard similarity of 0.8 or
    more between their sets of five-word shingles.

    Every link is confirmed by the sets themselves, so nothing below 0.8 is linked, and no pair of 0.8 or more is left apart: most groups
    are found by a search that may miss pairs and compares large bands and components in parts, and what it left in different
    groups then meets by an exact search (missed). Candidates of the first are pairs whose SimHash fingerprints of that set differ in at most RADIUS bits, found by BK-trees, and pairs that share one of BANDS bands of minima
    of the set and whose wide fingerprints differ in at most NEAR_RADIUS of 512 bits. At 0.8 two documents share no band
    with a probability of (1 - 0.8^4)^16, 0.0002, wherever their differences are; the share of bits in which two fingerprints
    differ is the angle between the sets, in units of half a turn, 0.151 at a similarity of 0.8, and NEAR_RADIUS is over
    three standard deviations more. At such a radius a BK-tree leaves out no edge, so wide fingerprints are compared without
    one, within a band only. id_col must be unique, and a long. Null and empty texts are one group; an empty table
    gives no rows; other columns are left out.
    """
    prints = common.stored(wide_fingerprints(docs, id_col, text_col), "fingerprints")
    # one node for each set of shingles, with the columns of its least id
    least = prints.groupBy("print").agg(F.min(F.struct(F.col(id_col).alias("node"), "fp", "near", "bands")).alias("least"))
    nodes = common.stored(least.select("print", "least.*"), "nodes")
    close = links(nodes.select("fp").distinct())
    first = nodes.groupBy("fp").agg(F.min("node").alias("of"))
    by_tree = close.join(first, F.col("a") == F.col("fp")).select(F.col("of").alias("a"), "b").join(first, F.col("b") == F.col("fp")).select("a", F.col("of").alias("b"))
    same = nodes.join(first, "fp").filter("node <> of").select(F.col("of").alias("a"), F.col("node").alias("b"))
    shards = met(nodes)
    sketches = nodes.select("node", "near")
    by_bands, _ = linked(shards, sketches, "near", sketches, SKETCHES, sketch_roots)
    candidates = common.stored(components(by_tree.unionByName(same).unionByName(by_bands)), "candidates")
    roots = common.stored(components(confirmed(candidates, shards, sketches, docs, id_col, text_col)), "confirmed")
    rooted = common.stored(nodes.join(roots, "node", "left").select("print", "node", F.coalesce("root", "node").alias("root")), "rooted")
    more = missed(docs, id_col, text_col, prints, rooted.select("node", "root"))
    of = lambda end: rooted.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    tops = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = common.stored(rooted.join(tops, "root", "left").select("print", F.coalesce("top", "root").alias("first")), "named")
    # copies: as many rows as documents may share one set
    return common.split_join(prints.select(id_col, "print"), named, "print").select(id_col, "first")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates (see near_groups), that of the smallest id (null ids last), with the columns of docs.

    Rows are numbered in a stored table first, so that of repeated rows one stays, and ranks by id take the number's place
    where groups are formed. Null and empty texts are one group; an empty table gives no rows.
    """
    row = common.free_name(docs, "row")
    rows = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = common.stored(near_groups(rows, row, text_col), "groups")
    ids = rows.select(row, F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("member"))
    kept = groups.join(ids, row).groupBy("first").agg(F.min("member").alias("least")).select(F.col("least.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
