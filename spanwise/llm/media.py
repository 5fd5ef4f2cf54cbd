"""Media columns: interleaved document sequences.

A page's HTML yields one ordered list of text and media references. A reference names its payload by digest; payloads
lie in a store, a Parquet table of stored bytes keyed by digest. Joining the references with what was read back from
the store resolves them; position and caption travel with each reference, so order and captions stay aligned.

Payloads are stored as 8-bit mono WAV: a header of 44 bytes, then one sample for each byte.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm import common

BLOCK = 64
RATE = 8000
HEADER = 44

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
SOURCE = re.compile(r"""\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
DIGEST = re.compile(r"(?:media:)?sha256[:/]([0-9a-f]{64})\Z")
LENGTH = re.compile(r"""\bdata-bytes\s*=\s*["']?(\d{1,18})\b""")
BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr section article figure figcaption blockquote pre ul ol table br hr".split())
MEDIA = frozenset("img audio video source embed".split())


def payload(text: bytes) -> bytes:
    """Text padded with zero bytes to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def to_wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono WAV with one sample for each byte."""
    odd = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + bytes(odd)


def from_wav(stored: bytes) -> bytes:
    """The samples of an 8-bit mono WAV; ValueError if the bytes are anything else or were cut short."""
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", stored[:HEADER])
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(stored) < HEADER + n:
        raise ValueError("not a whole 8-bit mono WAV")
    return stored[HEADER : HEADER + n]


def feature(samples: bytes) -> str:
    """Mean, root mean square and zero crossings of the signal around 128, and its energy in eight equal spans."""
    wave = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    energy = wave * wave
    edges = np.linspace(0, len(wave), 9).astype(int)
    spans = [int(energy[a:b].sum()) for a, b in zip(edges, edges[1:], strict=False)]
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    root = int(round(1000 * float(np.sqrt(energy.mean())))) if len(wave) else 0
    return f"sum={int(wave.sum())};rms={root};zc={crossings};e=" + ",".join(map(str, spans))


def store(items: DataFrame, text_col: str = "text") -> DataFrame:
    """Writes the payload of every row to the media store and returns the stored table: digest, media.

    The digest is the payload's SHA-256, so equal texts have equal rows. A null text is stored as an empty one, that
    is as 64 zero bytes; an empty table makes an empty store. Repeated texts are stored as often as they occur:
    finding them first would move every payload, and readers below keep one row for each digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = common.utf8(batch.column(0))
            raw = [payload(t) for t in texts]
            yield {"digest": [hashlib.sha256(p).hexdigest() for p in raw], "media": [to_wav(p) for p in raw]}

    return common.stored(common.map_batches(items, [text_col], run, "digest string, media binary"), "media")


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, one row for each digest: payload and media digests, sizes and features.

    A row whose bytes no longer match its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            digests, media = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw = [from_wav(m) for m in media]
            sums = [hashlib.sha256(p).hexdigest() for p in raw]
            if sums != digests:
                raise ValueError("stored media do not match their digests")
            yield {
                "digest": digests, "payload_bytes": [len(p) for p in raw], "payload_sha256": sums,
                "tail_crc32": [zlib.crc32(p[-BLOCK:]) for p in raw], "media_bytes": [len(m) for m in media],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "feature": [feature(p) for p in raw],
            }

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.map_batches(stored, ["digest", "media"], run, schema).dropDuplicates(["digest"])


def sequence(page: str) -> list[dict]:
    """A page's texts and media references in order.

    A reference has its source, the digest if the source names one, and the length in bytes if the tag tells it. A figure's
    caption, wherever in the figure it stands, is kept with each of the figure's references; one without a reference is text.
    """
    parts: list[dict] = []
    words: list[str] = []
    told: list[str] | None = None  # a caption that is open
    caption, figure, depth = "", [], 0
    skip, at = "", 0

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            parts.append({"kind": "text", "text": text, "source": None, "digest": None, "length": None, "caption": None})

    def close_caption() -> None:
        nonlocal told, caption
        if told is not None:
            caption = " ".join([caption, *"".join(told).split()]).strip()
            told = None

    def close_figure() -> None:
        nonlocal caption
        close_caption()
        for x in figure:
            x["caption"] = caption or None
        if caption and not figure:
            words.append(caption)
        flush()
        figure.clear()
        caption = ""

    def add(raw: str) -> None:
        if not skip:
            (words if told is None else told).append(html.unescape(raw))

    for m in TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if skip:
            skip = "" if m[1] and tag == skip else skip
        elif tag in ("script", "style") and not m[1]:
            skip = tag
        elif tag == "figcaption":
            if m[1]:
                close_caption()
            else:
                flush()
                told = []
        elif tag in MEDIA and not m[1]:
            if source := SOURCE.search(m[3]):
                close_caption()
                flush()
                name = html.unescape(source[1] or source[2] or source[3] or "")
                digest, length = DIGEST.match(name), LENGTH.search(m[3])
                parts.append({"kind": "media", "text": None, "source": name, "digest": digest and digest[1], "length": length and int(length[1]), "caption": None})
                if depth:
                    figure.append(parts[-1])
        elif tag == "figure":
            close_figure()
            depth = 0 if m[1] else 1
        elif tag in BREAKS:
            if told is None:
                flush()
            else:
                told.append(" ")
    add(page[at:])
    close_figure()
    return parts


def interleave(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Parses pages into sequences: id_col and elements, an array of (position, kind, text, source, digest, length, caption).

    Null or empty html has no elements; a reference without a digest stays in its place, with a null digest. Repeated rows
    give repeated sequences, null ids stay null, an empty table gives none, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            made = [[{"position": k, **x} for k, x in enumerate(sequence(p.decode("utf-8", "replace")))] for p in common.utf8(batch.column(1))]
            yield {id_col: batch.column(0), "elements": made}

    schema = f"`{id_col}` {common.type_of(pages, id_col)}, elements array<struct<position:int,kind:string,text:string,source:string,digest:string,length:long,caption:string>>"
    return common.map_batches(pages, [id_col, html_col], run, schema)


def references(sequences: DataFrame, id_col: str) -> DataFrame:
    """A row for each media reference: id_col, position, digest, length, caption, how many elements its sequence has, and the crc32 of
    the texts before and after it (joined by line ends)."""

    def texts(kept) -> Column:
        return F.crc32(F.array_join(F.transform(F.filter("elements", kept), lambda y: y["text"]), "\n").cast("binary"))

    media = F.filter("elements", lambda x: x["kind"] == "media")
    row = F.transform(media, lambda x: F.struct(*(x[k].alias(k) for k in ("position", "digest", "length", "caption"))))
    each = sequences.select(id_col, "elements", F.inline(row))
    before = texts(lambda y: (y["kind"] == "text") & (y["position"] < F.col("position")))
    after = texts(lambda y: (y["kind"] == "text") & (y["position"] > F.col("position")))
    return each.select(id_col, "position", "digest", "length", "caption", F.size("elements").alias("n_elements"), before.alias("before_crc32"), after.alias("after_crc32"))


def resolve(refs: DataFrame, contents: DataFrame) -> DataFrame:
    """References with what their digests hold; a reference whose payload is missing keeps nulls.

    Only light rows move. Both tables are stored first, as a digest may have many references: those of the most
    frequent digests take their payload from a broadcast of bounded size, all others meet theirs in a shuffle.
    """
    return common.split_join(common.stored(refs, "references"), common.stored(contents, "contents"), "digest")


def assemble(sequences: DataFrame, resolved: DataFrame, id_col: str) -> DataFrame:
    """Puts resolved payload columns back into the sequences' media elements, in order.

    id_col must be unique and not null; a reference whose payload is missing has a null payload; a sequence without media stays
    as it is, and an empty table gives no rows.
    """
    found = F.struct("position", F.struct("payload_bytes", "media_bytes", "feature").alias("p"))
    payloads = resolved.groupBy(id_col).agg(F.map_from_entries(F.collect_list(found)).alias("payloads"))
    names = ("position", "kind", "text", "source", "caption", "digest", "length")
    whole = F.transform("elements", lambda x: F.struct(*(x[k].alias(k) for k in names), F.col("payloads")[x["position"]].alias("payload")))
    return sequences.join(payloads, id_col, "left").select(id_col, whole.alias("elements"))


def document_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as a page: a paragraph for each line and, after the first, a figure that names the whole text's payload by
    digest, with its length and the first line as caption."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            made = []
            for t in common.utf8(batch.column(1)):
                first, _, rest = html.escape(t.decode("utf-8", "replace")).partition("\n")
                named = f'<audio src="media:sha256/{hashlib.sha256(payload(t)).hexdigest()}" data-bytes="{len(t)}"></audio>'
                made.append(f"<p>{first}</p><figure>{named}<figcaption>{first}</figcaption></figure><p>{rest.replace(chr(10), '</p><p>')}</p>")
            yield {id_col: batch.column(0), "html": made}

    return common.map_batches(docs, [id_col, text_col], run, f"`{id_col}` {common.type_of(docs, id_col)}, html string")


def media_features(docs: DataFrame) -> DataFrame:
    """op3: stores every document's text as media, parses its page, resolves the reference and returns the features, with the
    reference's place in the sequence: position, n_elements, caption_crc32, before_crc32 and after_crc32.

    Repeated rows give repeated results; null and empty texts are 64 zero bytes; null ids stay null; an empty table gives no rows.
    """
    contents = read_back(store(docs))
    refs = references(interleave(document_pages(docs), "doc_id", "html"), "doc_id")
    refs = refs.withColumn("caption_crc32", F.crc32(F.coalesce("caption", F.lit("")).cast("binary"))).drop("caption")
    return resolve(refs, contents).select(
        "doc_id", F.col("length").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "position", "n_elements", "caption_crc32", "before_crc32", "after_crc32",
    )
