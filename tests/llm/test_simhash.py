import random

import numpy as np
import pytest
import xxhash

from spanwise.llm import simhash


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, linked):
    """Of (member, value) pairs, the smallest member reachable from each."""
    root = list(range(len(items)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i][1], items[j][1]):
                root[find(i)] = find(j)
    least = {}
    for k, (member, _) in enumerate(items):
        r = find(k)
        least[r] = min((x for x in (least.get(r), member) if x is not None), default=None)
    return [least[find(k)] for k in range(len(items))]


def near(a, b):
    return (a ^ b).bit_count() <= 3


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_query_against_brute_force(table, request):
    docs = request.getfixturevalue(table)
    items = [(r["doc_id"], brute_print(r["text"])) for r in docs.select("doc_id", "text").collect()]
    want = sorted(repr((m, f"{v:016x}", g)) for (m, v), g in zip(items, groups(items, near), strict=True))
    assert want == sorted(repr(tuple(r)) for r in simhash.near_duplicates(docs).collect())


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_dense_groups(spark, seed):
    rng = random.Random(seed)
    values = set()
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            values.add(v)
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
    items = list(enumerate(sorted(values)))
    df = spark.createDataFrame([(m, v - (1 << 64) if v >> 63 else v) for m, v in items], "m long, fp long")
    got = {r["m"]: r["first"] for r in simhash.grouped(simhash.common.stored(df, "t"), "m").collect()}
    assert [got[m] for m, _ in items] == groups(items, near)


def test_tree_search_finds_all_in_each_run():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 4, 400))
    values = np.unique(rng.integers(0, 2**12, 4000, dtype=np.uint64))[:400]
    rng.shuffle(values)
    forest = simhash.Forest(keys, values.reshape(-1, 1))
    found = {(int(q), int(n)) for a, b in forest.near(np.arange(400), 2, np.arange(400)) for q, n in zip(a, b, strict=True)}
    assert found | {(i, i) for i in range(400)} == {(i, j) for i in range(400) for j in range(400) if keys[i] == keys[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 2}


def test_shards_come_whole_over_batches(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    rows = [(base ^ (k << 40),) for k in range(512)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    links = simhash.links(spark.createDataFrame(rows, "fp long")).collect()
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    assert len({find(r[0]) for r in rows}) == 1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


@pytest.mark.parametrize("frontier", [1 << 20, 1 << 6])
def test_spanning_links_of_wide_values(frontier, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (12, 2), dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (12, 2), dtype=np.uint64)) for _ in range(25)]), axis=0)
    keys = np.sort(rng.integers(0, 5, len(values)))
    a, b = simhash.spanning(keys, values, 3)
    items = list(enumerate((int(k), int(v[0]) | int(v[1]) << 64) for k, v in zip(keys, values, strict=True)))
    want = groups(items, lambda x, y: x[0] == y[0] and (x[1] ^ y[1]).bit_count() <= 3)
    got = list(range(len(values)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        got[y] = x
    assert got == want


def changed(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words)


def test_similar_documents_are_one_group(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        for share in (0.0, 0.0, 0.01, 0.02):
            want[len(rows)] = g
            rows.append((len(rows), changed(rng, words, share)))
    for g in range(60):  # half of the words of another: not near
        words = rows[4 * g][1].split()
        want[len(rows)] = 60 + g
        rows.append((len(rows), changed(rng, words, 0.3)))
    got = {r["id"]: r["first"] for r in simhash.near_groups(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    close = far = 0
    for i in range(len(rows)):
        for j in range(i):
            similar = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if similar >= 0.8:
                close += got[i] != got[j]
            if want[i] != want[j]:
                far += got[i] == got[j]
    assert far == 0 and close <= 3


def contiguous(rng, kind, low, high):
    """Two texts of which one has a passage appended or replaced, with a similarity of five-word shingles in [low, high)."""
    while True:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(80, 400))]
        n = int(len(words) * rng.uniform(0.02, 0.3))
        new = [f"new{rng.randrange(10**6)}" for _ in range(n)]
        at = rng.randrange(len(words) - n)
        a, b = " ".join(words), " ".join(words + new if kind == "appended" else words[:at] + new + words[at + n :])
        x, y = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
        if low <= len(x & y) / len(x | y) < high:
            return a, b


@pytest.mark.parametrize("kind", ["appended", "replaced"])
def test_contiguous_edits_are_found(spark, kind):
    rng = random.Random(11)
    texts = [t for k in range(120) for t in contiguous(rng, kind, 0.8 + 0.05 * (k % 2), 0.85 + 0.05 * (k % 2))]
    got = {r["id"]: r["first"] for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(120)) >= 118 and all(got[2 * k] == 2 * k for k in range(120))


def test_links_are_confirmed_by_exact_similarity(spark):
    rng = random.Random(12)
    texts = [t for k in range(100) for t in contiguous(rng, ("appended", "replaced")[k % 2], (0.72, 0.8)[k % 4 // 2], (0.8, 0.85)[k % 4 // 2])]
    got = {r["id"]: r["first"] for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()}
    linked = [got[2 * k] == got[2 * k + 1] for k in range(100)]
    assert not any(linked[k] for k in range(100) if k % 4 < 2) and sum(linked) >= 49


@pytest.mark.parametrize("compared", [1 << 21, 50])
def test_similar_groups_against_brute_force(monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1000, 40, dtype=np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate((x[rng.random(len(x)) > 0.1], rng.integers(0, 1000, rng.integers(0, 6), dtype=np.uint64)))) for x in sets * 8]
    want = groups([(k, set(x.tolist())) for k, x in enumerate(sets)], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert simhash.similar_groups(sets).tolist() == want and 20 < len(set(want)) < 180


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [0, 3, 4, 5, 7, 8, 9, 10, 11]
    assert kept.filter("doc_id is null").count() == 1
    assert simhash.deduplicate(no_docs).collect() == [] and simhash.near_duplicates(no_docs).collect() == []


def test_radius_beyond_the_blocks(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_a_hot_shard_is_divided(spark, monkeypatch):
    rng = random.Random(8)
    values = {(rng.getrandbits(38) << 26) | 0x2ABCDEF for _ in range(1500)}  # the first two blocks are those of all
    for v in sorted(values)[:200]:
        for _ in range(3):
            v ^= 1 << rng.randrange(26, 64)
            values.add(v)
    items = list(enumerate(sorted(values)))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for _, v in items], "fp long")
    seen = []
    whole = simhash.sharded

    def watched(shards, *rest):
        seen.append(max((r["count"] for r in shards.groupBy("key").count().collect()), default=0))
        return whole(shards, *rest)

    monkeypatch.setattr(simhash, "sharded", watched)
    found = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(df, crowded=100).collect()}
    assert len(seen) > 1 and max(seen) <= 100
    root = {v: v for _, v in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    want = groups(items, near)
    by_root = {}
    for (k, v), g in zip(items, want, strict=True):
        assert by_root.setdefault(find(v), g) == g
    assert len(by_root) == len(set(want))


@pytest.mark.parametrize("widths", simhash.LEVELS)
def test_every_pair_of_three_bits_shares_a_key(spark, widths):
    rng, bits = random.Random(1), sum(widths)
    pairs = []
    for k in range(300):
        v = w = rng.getrandbits(bits)
        for b in rng.sample(range(bits), 3):
            w ^= 1 << b
        pairs += [(2 * k, v), (2 * k + 1, w)]
    df = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in pairs], "k long, v long")
    made = df.select("k", "v", simhash.F.inline(simhash.subkeys(simhash.F.lit(3).cast("long"), simhash.F.col("v"), widths))).collect()
    keys = {}
    for r in made:
        keys.setdefault(r["k"], set()).add(r["key"])
        assert 0 <= r["rest"] < 1 << (39, 24, 15)[simhash.LEVELS.index(widths)]
    assert all(len(keys[k]) == 10 and keys[2 * (k // 2)] & keys[2 * (k // 2) + 1] for k in keys)


def test_hot_bands_and_large_components_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SKETCHES", 20)
    monkeypatch.setattr(simhash, "TEXTS", 20)
    rng = random.Random(6)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [changed(rng, words, 0.003) for _ in range(200)]  # near copies of one text
    texts += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(50)) for _ in range(30)]
    got = {r["id"]: r["first"] for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()}
    assert len({got[k] for k in range(200)}) == 1 and [got[k] for k in range(200, 230)] == list(range(200, 230))


def test_recall_of_a_query_set_against_all(spark, sf_dir):
    """Ids divisible by 50 against all rows: of the pairs with a similarity of 0.8 or more, nine in ten at least are in one group."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"])
    sets = {r["doc_id"]: frozenset(simhash.shingle_set((r["text"] or "").lower().encode().split()).tolist()) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["first"] for r in simhash.near_groups(docs).collect()}
    pairs = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(pairs) > 3 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_unlike_texts_of_a_large_component_meet_by_bands(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TEXTS", 12)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    texts += [changed(rng, t.split(), 0.004) for t in texts[:20]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    candidates = simhash.common.stored(spark.createDataFrame([(k, 0) for k in range(1, 80)], "node long, root long"), "c")
    bands = simhash.common.stored(spark.createDataFrame([(1000 + k % 60, k) for k in range(80)], "key long, node long"), "b")
    prints = simhash.wide_fingerprints(rows, "id", "text").select(simhash.F.col("id").alias("node"), "near")
    found = simhash.confirmed(candidates, bands, prints, rows, "id", "text").collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in found} == {(k, 60 + k) for k in range(20)}


def test_copies_that_only_their_original_links(spark, monkeypatch):
    """Each copy is similar to the original, hardly any to another: parts without the original would leave them apart."""
    monkeypatch.setattr(simhash, "TEXTS", 16)
    rng = random.Random(14)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = []
    for k in range(150):
        at = rng.randrange(360)
        texts.append(" ".join(words[:at] + [f"new{k}x{j}" for j in range(40)] + words[at + 40 :]))
    texts.insert(70, " ".join(words))
    sets = [set(simhash.shingle_set(t.encode().split()).tolist()) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(k, 70) >= 0.8 for k in range(151)) and sum(alike(a, a + 1) < 0.8 for a in range(150)) > 100
    got = simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()
    assert {r["first"] for r in got} == {0}


def test_a_chain_longer_than_a_part_is_one_group(spark, monkeypatch):
    """Each text is similar to its neighbours only: in parts most pairs are apart, and no node stands for another."""
    monkeypatch.setattr(simhash, "TEXTS", 8)
    rng = random.Random(21)
    words, texts = [f"w{rng.randrange(5000)}" for _ in range(400)], []
    for k in range(80):
        at = 40 * (k % 10)
        words = words[:at] + [f"new{k}x{j}" for j in range(30)] + words[at + 30 :]
        texts.append(" ".join(words))
    sets = [set(simhash.shingle_set(t.encode().split()).tolist()) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(k, k + 1) >= 0.8 for k in range(79)) and all(alike(k, k + 2) < 0.8 for k in range(78))
    got = simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()
    assert {r["first"] for r in got} == {0}


@pytest.mark.parametrize("meeting", [1 << 12, 8])
def test_pairs_that_share_no_band_are_found(spark, monkeypatch, meeting):
    met = simhash.met
    monkeypatch.setattr(simhash, "met", lambda nodes: met(nodes.filter("node < 0")))
    monkeypatch.setattr(simhash, "MEETING", meeting)
    rng = random.Random(22)
    start = " ".join(f"common{k}" for k in range(12))  # in the prefixes of many texts
    texts = [f"{start} {t}" if k % 2 else t for k in range(60) for t in contiguous(rng, ("appended", "replaced")[k % 2], (0.7, 0.81)[k % 4 // 2], (0.79, 0.9)[k % 4 // 2])]
    texts += ["", None, "one two", "one two three four five six", "one two three four five six seven", " ".join(f"v{k}" for k in range(12)), " ".join(f"v{k}" for k in range(13))]
    texts += [f"{start} end{k}" for k in range(40)] + [f"{start} end{k} more{k}" for k in range(40)]
    got = {r["id"]: r["first"] for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()}
    items = [(k, set(simhash.shingle_set((t or "").encode().split()).tolist())) for k, t in enumerate(texts)]
    want = groups(items, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert [got[k] for k in range(len(texts))] == want and 30 < len(set(want)) < 180


def similar_sets(rng, n):
    base = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)) for _ in range(n)]
    return base + [np.unique(np.concatenate((x[rng.random(len(x)) > share], rng.integers(0, 1 << 63, int(len(x) * share), dtype=np.uint64)))) for x in base for share in (0.02, 0.08, 0.1, 0.12)]


@pytest.mark.parametrize("listed", [0, 50, 4000])
def test_prefixes_and_parities_lose_no_similar_pair(listed, monkeypatch):
    monkeypatch.setattr(simhash, "PARITY_BITS", 256)
    monkeypatch.setattr(simhash, "FRONTIER", 1 << 8)
    rng = np.random.default_rng(4)
    sets = [x for x in similar_sets(rng, 40) if len(x)]
    often = np.sort(rng.permutation(np.unique(np.concatenate(sets)))[:listed])
    times = rng.integers(3, 9, len(often))
    prefixes = [set(simhash.prefix(x, often, times).tolist()) for x in sets]
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert len(similar) > 50 and all(prefixes[i] & prefixes[j] for i, j in similar)
    rows = sorted((key, i) for i, p in enumerate(prefixes) for key in p)
    keys, at = (np.array(x) for x in zip(*rows, strict=True))
    sketches = [simhash.parity(x) for x in sets]
    size = np.array([len(x) for x in sets])
    found = {tuple(sorted(p)) for a, b in simhash.close_pairs(keys, at, size[at], [sketches[k] for k in at]) for p in zip(at[a].tolist(), at[b].tolist(), strict=True)}
    assert similar <= found


def test_roots_of_a_large_shard_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEETING", 10)
    root = lambda n: 0 if n < 60 else n - n % 3
    shards = simhash.common.stored(spark.createDataFrame([(7, n) for n in range(100)] + [(8, n) for n in range(5)], "key long, node long"), "s")
    rooted = simhash.common.stored(spark.createDataFrame([(n, root(n)) for n in range(100)], "node long, root long"), "r")
    blocks = {}
    for r in simhash.dealt_out(shards, rooted).collect():
        blocks.setdefault(r["key"], []).append(r["node"])
    assert sorted(blocks.pop(8)) == list(range(5))
    together = {(a, b) for x in blocks.values() for a in x for b in x if a < b}
    assert all((a, b) in together for b in range(100) for a in range(b) if root(a) != root(b))
    assert max(map(len, blocks.values())) <= 30 and sum((a, b) in together for b in range(60) for a in range(b)) < 600
