import hashlib
import zlib

import pytest

from spanwise.llm import common, media


def test_round_trip():
    for text in (b"", b"x", b"y" * 64, bytes(range(256))):
        p = media.payload(text)
        assert len(p) % 64 == 0 < len(p) and p.startswith(text) and not p[len(text) :].strip(b"\0")
        assert media.from_wav(media.to_wav(p)) == p
    assert media.from_wav(media.to_wav(b"odd")) == b"odd"
    with pytest.raises(ValueError):
        media.from_wav(media.to_wav(b"abcd" * 16)[:-1])


def interleaved(text):
    """Where the payload stands among the document's lines."""
    lines = [" ".join(x.split()) for x in text.split("\n")]
    before, after = [x for x in lines[:1] if x], [x for x in lines[1:] if x]
    crc = lambda x: zlib.crc32("\n".join(x).encode())
    return len(before), len(before) + 1 + len(after), zlib.crc32(lines[0].encode()), crc(before), crc(after)


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_query_against_brute_force(table, request):
    docs = request.getfixturevalue(table)
    want = []
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44, hashlib.sha256(media.to_wav(p)).hexdigest(), media.feature(p), *interleaved(r["text"] or "")))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_elements", "caption_crc32", "before_crc32", "after_crc32"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in media.media_features(docs).select(*names).collect())


def test_empty(no_docs):
    assert media.media_features(no_docs).collect() == []


def test_sequence_keeps_order_and_captions(spark):
    a, b = "a" * 64, "b" * 64
    page = f'<p>one</p><figure><img src="sha256:{a}"><figcaption>first &amp; best</figcaption></figure><p>two <img src="media:sha256/{b}"> three</p><img src="x.png">'
    parts = media.sequence(page)
    assert [(x["kind"], x["text"] or x["digest"], x["caption"]) for x in parts] == [("text", "one", None), ("media", a, "first & best"), ("text", "two", None), ("media", b, None), ("text", "three", None), ("media", None, None)]
    assert parts[-1]["source"] == "x.png"
    sequences = media.interleave(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", "html")
    contents = spark.createDataFrame([(b, 64, 108, "f")], "digest string, payload_bytes long, media_bytes long, feature string")
    resolved = media.resolve(media.references(sequences, "id"), contents)
    whole = {r["id"]: r["elements"] for r in media.assemble(sequences, resolved.withColumn("n_bytes", resolved["payload_bytes"]), "id").collect()}
    assert whole[2] == [] and [x["position"] for x in whole[1]] == [0, 1, 2, 3, 4, 5]
    assert whole[1][3]["payload"]["feature"] == "f" and whole[1][1]["payload"]["feature"] is None and whole[1][1]["caption"] == "first & best"


def test_hot_keys_join_like_others(spark):
    left = common.stored(spark.createDataFrame([(None if k % 10 == 0 else "h" if k % 3 else str(k), k) for k in range(600)], "key string, v long"), "left")
    right = common.stored(spark.createDataFrame([("h", 1), ("1", 2), ("3", 3)], "key string, w long"), "right")
    assert sorted(map(repr, common.split_join(left, right, "key").collect())) == sorted(map(repr, left.join(right, "key", "left").collect()))


@pytest.mark.parametrize("page,want", [
    ("<figure><figcaption>c</figcaption><img src=1.png></figure>", [("1.png", "c")]),
    ("<figure><img src=1.png><figcaption>c <b>d</b></figcaption><img src='2.png'></figure><img src=3.png>", [("1.png", "c d"), ("2.png", "c d"), ("3.png", None)]),
    ("<figure><img src=1.png></figure><figure><figcaption>c</figcaption></figure>", [("1.png", None), "c"]),
    ("<figure><img src=1.png><figcaption>never closed", [("1.png", "never closed")]),
    ("<img alt=none><video><source src=v.webm data-bytes=12></video>", [("v.webm", None)]),
])
def test_captions(page, want):
    assert [(x["source"], x["caption"]) if x["kind"] == "media" else x["text"] for x in media.sequence(page)] == want
