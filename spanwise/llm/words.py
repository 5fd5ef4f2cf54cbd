"""Words of many texts at once, as numpy arrays: bounds, exact keys and hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: ASCII white space, as in [\\x20\\x09-\\x0D].
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
SPACE = re.compile(rb"[\x20\x09-\x0D]")

#: Bytes of a text that are looked at together, and bytes of a word that its key holds as they are.
PIECE, SHORT = 1 << 20, 14
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """64 bits of which each depends on all bits of h; different h give different results."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    space = SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    return edge[::2], edge[1::2]


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts in one, a space after each and room for reading eight bytes anywhere; and where each begins, with the end of the last."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return b" ".join([*texts, b" " * 16]), np.concatenate(([0], np.cumsum(lengths)))


def keys(raw: bytes, start: np.ndarray, end: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each word, equal if and only if word and tag (a byte) are.

    A word of up to 14 bytes is its key, with its length. A longer one is known by 112 bits of XXH3, so that any two of n
    distinct long words share a key with a probability of n^2 / 2^113. raw is from joined().
    """
    from xxhash import xxh3_128_intdigest

    size = end - start
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    first = eight[start] & _MASK[np.minimum(size, 8)]
    second = eight[start + 8] & _MASK[np.clip(size - 8, 0, SHORT - 8)]
    second |= np.minimum(size, SHORT + 1).astype(np.uint64) << np.uint64(48)
    for k in np.flatnonzero(size > SHORT).tolist():
        digest = xxh3_128_intdigest(raw[start[k] : end[k]])
        first[k] = digest & 0xFFFFFFFFFFFFFFFF
        second[k] = digest >> 80 | (SHORT + 1) << 48
    return first, second | tag.astype(np.uint64) << np.uint64(56)


def pieces(texts: Iterable[bytes], before: int, size: int = PIECE) -> Iterator[tuple[int, bytes, int, bool]]:
    """Texts cut at white space into pieces of about `size` bytes: (number of the text, piece, words of the piece that are
    only there as what stood before, whether the text ends here). Words are never cut, however long."""
    for k, text in enumerate(texts):
        at, known = 0, []
        while len(text) - at > size and (found := SPACE.search(text, at + size)):
            piece = b" ".join([*known, text[at : found.start()]])
            yield k, piece, len(known), False
            at, known = found.start(), piece.split()[-before:] if before else []
        yield k, b" ".join([*known, text[at:]]) if at else text, len(known), True


def groups(texts: Iterable[bytes], before: int, size: int = PIECE) -> Iterator[list[tuple[int, bytes, int, bool]]]:
    """pieces() in lists of about `size` bytes."""
    held, total = [], 0
    for piece in pieces(texts, before, size):
        held.append(piece)
        total += len(piece[1]) + 1
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
