"""Format-preserving pseudonyms for personal data.

Each kind of value is found by a pattern and confirmed by its own check (calendar, Luhn, ranges, check digits). A value
is read as a number within its format, that number is permuted by a keyed Feistel network (with cycle walking where
the format's size is no power of four), and the result is written in the same format. Equal values so get equal
pseudonyms in all documents, different values different ones, and only who has the key can go back.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanwise.llm import common

ROUNDS = 8
#: Setting that holds the key. There is no default: who has the key can go back.
KEY_SETTING = "spark.spanwise.pii.key"
#: Values a task remembers the pseudonyms of, and groups of digits of one run that are looked at together.
CACHE, STRETCH = 100_000, 500


def permuted(number: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network, walked until it lands within size."""
    if size < 2:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def mixed(r: int, x: int) -> int:
        data = b"%d:%d:" % (r, size) + kind.encode() + x.to_bytes(width, "big")
        out = b"".join(hashlib.blake2b(data, key=key, digest_size=64, salt=b"%d" % part).digest() for part in range(width // 64 + 1))
        return int.from_bytes(out[:width], "big") & mask

    while True:
        left, right = number >> half, number & mask
        if back:
            for r in reversed(range(ROUNDS)):
                left, right = right ^ mixed(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ mixed(r, right)
        number = left << half | right
        if number < size:
            return number


# The alphabets that keep a character's kind.
LATIN = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
ALPHABETS = [LATIN, LATIN.upper(), "0123456789", ACCENTED, "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
PLACE = {c: (k, a) for a in ALPHABETS for k, c in enumerate(a)}
HEX = {c: (k, "0123456789abcdef") for k, c in enumerate("0123456789abcdef")}


def by_characters(text: str, key: bytes, kind: str, back: bool, place: dict = PLACE) -> str:
    """Permutes all texts with the same kinds of characters in the same places; other characters stay."""
    number, size = 0, 1
    for c in text:
        if c in place:
            k, alphabet = place[c]
            number, size = number * len(alphabet) + k, size * len(alphabet)
    shape = "".join(place[c][1][0] if c in place else c for c in text)
    number = permuted(number, size, key, f"{kind}/{shape}", back)
    out = []
    for c in reversed(text):
        if c in place:
            alphabet = place[c][1]
            number, k = divmod(number, len(alphabet))
            c = alphabet[k]
        out.append(c)
    return "".join(reversed(out))


def refill(text: str, digits: str) -> str:
    """The text with its digits replaced in turn."""
    source = iter(digits)
    return "".join(next(source) if c.isdigit() else c for c in text)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> int:
    """Check digit for the digits before it."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = only_digits(text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    own = digits[:-1]
    while True:  # one digit repeated is no card: walk on
        own = f"{permuted(int(own), 10 ** len(own), key, 'card', back):0{len(own)}d}"
        if len(set(full := own + str(luhn(own)))) > 1:
            return refill(text, full)


def social(text: str, key: bytes, back: bool) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = only_digits(text)
    if not valid(digits):
        return None
    while True:
        digits = f"{permuted(int(digits), 10**9, key, 'social', back):09d}"
        if valid(digits):
            return refill(text, digits)


def phone(text: str, key: bytes, back: bool) -> str | None:
    """All digits but those of a country code set off by a sign or a space."""
    digits = only_digits(text)
    if not 7 <= len(digits) <= 15:
        return None
    head = re.match(r"\+?\d{1,3}(?=[ .(-])", text) if len(digits) > 10 else None
    rest = text[head.end() :] if head else text
    own = only_digits(rest)
    return (head[0] if head else "") + refill(rest, f"{permuted(int(own), 10 ** len(own), key, f'phone{len(own)}', back):0{len(own)}d}")


def ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    number = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4", back)
    return ".".join(map(str, number.to_bytes(4, "big")))


def mac(text: str, key: bytes, back: bool) -> str | None:
    plain = re.sub("[:-]", "", text)
    if plain != plain.lower() and plain != plain.upper():
        return None
    made = iter(f"{permuted(int(plain, 16), 1 << 48, key, 'mac', back):012{'x' if plain == plain.lower() else 'X'}}")
    return "".join(c if c in ":-" else next(made) for c in text)


def iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")

    def rest(x: str) -> int:
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    if not 15 <= len(plain) <= 34 or rest(plain) != 1:
        return None
    own = by_characters(plain[4:], key, "iban" + plain[:2], back)
    made = iter(f"{plain[:2]}{98 - rest(plain[:2] + '00' + own):02d}{own}")
    return "".join(c if c == " " else next(made) for c in text)


FIRST, LAST = date(1000, 1, 1).toordinal(), date(2999, 12, 31).toordinal()


def parsed(text: str, order: str) -> date | None:
    numbers = dict(zip(order, map(int, re.findall(r"\d+", text)), strict=True))
    try:
        day = date(numbers["y"], numbers["m"], numbers["d"])
    except ValueError:
        return None
    return day if FIRST <= day.toordinal() <= LAST else None


def calendar(text: str, key: bytes, back: bool) -> str | None:
    """Year first, or day first, or, where that is no date, month first. Each kind is permuted within itself."""
    orders = ("ymd",) if re.match(r"\d{4}\D", text) else ("dmy", "mdy")
    kind, day = next(((o, d) for o in orders if (d := parsed(text, o))), (None, None))
    if day is None:
        return None
    padded = not re.search(r"(?<!\d)\d(?!\d)", text)
    while True:
        day = date.fromordinal(FIRST + permuted(day.toordinal() - FIRST, LAST - FIRST + 1, key, "date" + kind, back))
        made = {"y": f"{day.year:04d}", "m": f"{day.month:02d}" if padded else str(day.month), "d": f"{day.day:02d}" if padded else str(day.day)}
        values = iter(made[k] for k in kind)
        out = re.sub(r"\d+", lambda _: next(values), text)
        # walk on over what would read as another format or kind
        if (padded or re.search(r"(?<!\d)\d(?!\d)", out)) and next((o for o in orders if parsed(out, o)), None) == kind:
            return out


def email(text: str, key: bytes, back: bool) -> str | None:
    """Name and host apart, so that a host's addresses stay linked; the top domain stays."""
    name, _, host = text.rpartition("@")
    host, _, top = host.rpartition(".")
    return f"{by_characters(name, key, 'name', back)}@{by_characters(host, key, 'host', back)}.{top}"


def secret(text: str, key: bytes, back: bool) -> str | None:
    """Values after a label such as password, and access keys of a known form."""
    if re.fullmatch("[0-9a-f]{8,}", text):
        return by_characters(text, key, "hex", back, HEX)
    if re.fullmatch("(?:AKIA|ASIA)[0-9A-Z]{16}", text):
        base = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return text[:4] + by_characters(text[4:], key, "access", back, {c: (k, base) for k, c in enumerate(base)})
    return by_characters(text, key, "secret", back)


class Kind(NamedTuple):
    name: str
    pattern: re.Pattern
    pseudonym: Callable[[str, bytes, bool], str | None]


LABELS = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
#: In order of precedence where matches overlap. Where a pattern has named groups, the one that matched is the value: after
#: a label, what is quoted or has a digit.
KINDS = (
    Kind("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}"), email),
    Kind("secret", re.compile(rf"(?i:(?<![a-z]){LABELS})[\"']?\s?[:=]\s?(?:[\"'](?P<v>[^\s\"']{{8,}})[\"']|(?P<u>(?=[A-Za-z_+/-]*\d)[A-Za-z0-9_+/-]{{8,}}))|(?<![A-Za-z0-9])(?P<w>(?:AKIA|ASIA)[0-9A-Z]{{16}})(?![A-Za-z0-9])"), secret),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban),
    Kind("mac", re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}(?![\w:-])"), mac),
    Kind("date", re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?!(?!T\d\d:?\d\d)\w|[-/.]\d)"), calendar),
    Kind("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), ipv4),
    Kind("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,}(?!\w|[-.]\d)"), card),
    Kind("social", re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?!\w|[-.]\d)"), social),
    Kind("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\w|[-.]\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{1,4}){2,6}(?!\w|[-.]\d)|(?<![\w.+-])(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}(?!\w|[-.]\d)"), phone),
)
CLUE = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|key|auth)")


class Pseudonyms(dict):
    """Of (kind number, value) to pseudonym, None where the value fails its check."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back

    def __missing__(self, item: tuple[int, str]) -> str | None:
        if len(self) >= CACHE:
            self.clear()
        made = self[item] = KINDS[item[0]].pseudonym(item[1], self.key, self.back)
        return made


def card_places(run: str) -> Iterator[tuple[int, int]]:
    """Where a card may be in a run of digit groups: 13 to 19 digits from the start of a group to the end of one.

    The whole run comes first, then single groups, then the longer before the shorter ones; a run of very many groups is
    looked at in overlapping stretches, one after the other.
    """
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    if len(groups) > 2 * STRETCH:
        for at in range(0, len(groups), STRETCH):
            some = groups[at : at + STRETCH + 19]
            yield from ((some[0][0] + a, some[0][0] + b) for a, b in card_places(run[some[0][0] : some[-1][1]]))
        return
    places = []
    for k, (start, _) in enumerate(groups):
        digits = 0
        for j in range(k, len(groups)):
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits >= 13:
                places.append((j - k + 1 < len(groups), j > k, -digits, start, groups[j][1]))
    yield from ((start, end) for *_, start, end in sorted(places))


def replaced(text: str, known: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and each one's kind, start and length in the result (code points)."""
    if not CLUE.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []  # sorted, and none overlaps another
    for k, kind in enumerate(KINDS):
        if kind.name == "email" and "@" not in text:
            continue
        for m in kind.pattern.finditer(text):
            group = m.lastgroup or 0  # only secrets have named groups
            start, end = m.span(group)
            for a, b in card_places(m[0]) if kind.name == "card" else ((0, end - start),):
                at = bisect_left(found, (start + b,))
                if at and found[at - 1][1] > start + a:
                    continue
                if (made := known[k, text[start + a : start + b]]) is not None:
                    found.insert(at, (start + a, start + b, kind.name, made))
    if not found:
        return text, []
    out, spans, at, size = [], [], 0, 0
    for start, end, name, made in found:
        out += [text[at:start], made]
        size += start - at
        spans.append((name, size, len(made)))
        size += len(made)
        at = end
    return "".join([*out, text[at:]]), spans


def key_of(docs: DataFrame, key: str | None) -> bytes:
    """The given key, or the session's, of any length; without one it is an error."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: set {KEY_SETTING}")
    return hashlib.blake2b(key.encode()).digest()


def session_key(spark: SparkSession) -> str:
    """The session's key. Where none is set, one is drawn that only this session has: pseudonyms then link its own results, and
    nobody can go back."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymised(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text with its personal data replaced.

    Returns id_col, text_col, n_chars (code points of the result), n_found and found (kind, start, length in the
    result, in order). Null texts stay null with nothing found; empty texts stay empty. Repeated rows give repeated
    results, null ids stay null, an empty table gives none; other columns are left out.
    """
    secret_key = key_of(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = Pseudonyms(secret_key)
        for batch in batches:
            made = [(None, []) if t is None else replaced(t, known) for t in batch.column(1).to_pylist()]
            yield {
                id_col: batch.column(0), text_col: [t for t, _ in made], "n_chars": [len(t or "") for t, _ in made], "n_found": [len(s) for _, s in made],
                "found": [[{"kind": k, "start": a, "length": n} for k, a, n in s] for _, s in made],
            }

    schema = f"`{id_col}` {common.type_of(docs, id_col)}, `{text_col}` string, n_chars long, n_found long, found array<struct<kind:string,start:long,length:long>>"
    return common.map_batches(docs, [id_col, text_col], run, schema)


def replaced_in(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in text_col; all other columns, whatever their names, stay as they are.

    Null and empty texts stay; repeated rows give repeated results; an empty table gives none.
    """
    common.prepare(docs.sparkSession)
    secret_key, place = key_of(docs, key), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pseudonyms(secret_key)
        for batch in batches:
            texts = pa.array([None if t is None else replaced(t, known)[0] for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([texts if k == place else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
