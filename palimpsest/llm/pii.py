"""PII (operator 4): format-preserving Feistel pseudonyms.

Numbers and dates that hold a validity check are permuted within their format by a keyed Feistel network, walked until
the result is valid again. Equal values have equal pseudonyms in every document, different values different
ones, and nothing is stored: the key alone undoes the permutation.

    card    13 to 19 digits, whole or in the usual groups with blanks or hyphens, valid check digit: permuted but for the check digit, which follows
    phone   +1 and ten digits in the usual writings: the ten digits, valid area and exchange codes stay valid
    date    YYYY-MM-DD, DD.MM.YYYY, MM/DD/YYYY of 1900 to 2099: permuted among the days; the three writings of a day agree
    ssn     NNN-NN-NNNN with assigned area, group and serial numbers
    ip      four numbers of 0 to 255, addresses of private networks and others apart
    iban    valid check digits: letters and digits of the account permuted, check digits follow
    email   letters and digits of the local part and of the domain's labels before the last permuted, each by its kind
    secret  32 and more hexadecimal digits assigned to a token, secret, key or password (letters of both cases come out small)

Digits that fail the check (16 digits of a wrong check digit, month 13) are left alone.

The scan takes whole texts. Batches are searched as bytes for digits and at signs first; only texts that have one are
decoded and matched. There is no shuffle.

Defined cases: null texts stay null and empty ones empty, with no replacements; repeated rows are treated alike; a null doc_id
stays null; a value that runs on into further digits or letters is no value; matches do not overlap, the leftmost
counts; where two kinds begin at one place, the first of secret, email, iban, phone, date, ssn, ip, card counts; an empty table gives no rows; extra columns are ignored by the query and kept unchanged by `pseudonymized`.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .tokens import utf8

ROUNDS = 8
#: The session setting that names the secret key of the registered query.
SETTING = "spark.palimpsest.pii.key"
KINDS = ("card", "phone", "date", "ssn", "ip", "iban", "email", "secret")
_FIND = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<secret>(?:(?<=[\"'])|(?<=[=: ]))[0-9a-fA-F]{32,}(?!\w))"
    r"|(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w@]))"
    r"|(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<phone>\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}(?!\w))"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?!\w)|[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\w/]))"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))"
    r"|(?P<card>(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?!\w|-[0-9]))"
    r")"
)
_NAMED = re.compile(r"(?i)(?:token|secret|key|passw(?:or)?d|pwd)\s*[=:]\s*[\"']?$")


class Feistel:
    """A keyed permutation of 0..n-1, and its inverse."""

    def __init__(self, n: int, name: str, key: bytes):
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask, self.bytes = (1 << self.half) - 1, (self.half + 7) // 8
        self.seed = hashlib.blake2b(f"{name}/{n}".encode(), key=key, digest_size=16).digest()

    def _f(self, r: int, x: int) -> int:
        data = bytes([r]) + x.to_bytes(self.bytes, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.seed, digest_size=min(64, self.bytes)).digest(), "big") & self.mask

    def _once(self, x: int, back: bool) -> int:
        left, right = x >> self.half, x & self.mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ self._f(r, left), left) if back else (right, left ^ self._f(r, right))
        return (left << self.half) | right

    def __call__(self, x: int, back: bool = False, fits: Callable[[int], bool] = lambda _: True) -> int:
        """The image of x; with `fits`, of the permutation of the numbers that are like x in it."""
        want = fits(x)
        while True:
            x = self._once(x, back)
            if x < self.n and fits(x) == want:
                return x


@functools.lru_cache(4096)
def feistel(n: int, name: str, key: bytes) -> Feistel:
    return Feistel(n, name, key)


def check_digit(payload: str) -> str:
    """The digit that makes payload + digit valid (Luhn)."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def refill(shape: str, chars: str, kind: str) -> str:
    """shape with its characters that match `kind`, in order, replaced by chars."""
    own = iter(chars)
    return re.sub(kind, lambda _: next(own), shape)


def card(s: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if check_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    # numbers of one digit only are no card, so none may come out
    one_digit = lambda x: len(set((p := str(x).zfill(n)) + check_digit(p))) == 1
    payload = str(feistel(10**n, "card", key)(int(digits[:-1]), back, one_digit)).zfill(n)
    return refill(s, payload + check_digit(payload), r"\d")


def phone(s: str, key: bytes, back: bool) -> str:
    digits = re.sub(r"\D", "", s)[1:]
    valid = lambda x: x // 10**9 >= 2 and x // 10**6 % 10 >= 2
    out = str(feistel(10**10, "phone", key)(int(digits), back, valid)).zfill(10)
    return refill(s, "1" + out, r"\d")


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(s: str, key: bytes, back: bool) -> str | None:
    y, m, d = (s[:4], s[5:7], s[8:]) if s[4] == "-" else (s[6:], s[3:5], s[:2]) if s[2] == "." else (s[6:], s[:2], s[3:5])
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + feistel(LAST_DAY - FIRST_DAY + 1, "date", key)(day - FIRST_DAY, back))
    return f"{new:%Y-%m-%d}" if s[4] == "-" else f"{new:%d.%m.%Y}" if s[2] == "." else f"{new:%m/%d/%Y}"


def ssn(s: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    valid = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 > 0 and x % 10**4 > 0
    x = area * 10**6 + group * 10**4 + serial
    if not valid(x):
        return None
    return refill(s, str(feistel(10**9, "ssn", key)(x, back, valid)).zfill(9), r"\d")


def ip(s: str, key: bytes, back: bool) -> str | None:
    four = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in four):
        return None
    x = int.from_bytes(bytes(map(int, four)), "big")
    private = lambda x: x >> 24 in (10, 127) or x >> 20 == 0xAC1 or x >> 16 in (0xC0A8, 0xA9FE)
    if private(x):  # too few of them for a walk through all addresses: their host bits are permuted
        bits = 24 if x >> 24 in (10, 127) else 20 if x >> 20 == 0xAC1 else 16
        x = (x >> bits << bits) | feistel(1 << bits, "ip-private", key)(x & ((1 << bits) - 1), back)
    else:
        x = feistel(1 << 32, "ip", key)(x, back, private)
    return ".".join(map(str, x.to_bytes(4, "big")))


LETTERS = {**{c: "0123456789" for c in "0123456789"}, **{c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}


def characters(s: str, name: str, key: bytes, back: bool) -> str:
    """Letters and digits permuted together, each within its kind; all else stays."""
    x, n = 0, 1
    for c in s:
        if kind := LETTERS.get(c):
            x, n = x * len(kind) + kind.index(c), n * len(kind)
    if n == 1:
        return s
    x = feistel(n, name + re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s))), key)(x, back)
    out = []
    for c in reversed(s):
        if kind := LETTERS.get(c):
            x, i = divmod(x, len(kind))
            c = kind[i]
        out.append(c)
    return "".join(reversed(out))


def email(s: str, key: bytes, back: bool) -> str:
    local, _, domain = s.rpartition("@")
    labels, _, top = domain.rpartition(".")
    return f"{characters(local, 'local', key, back)}@{characters(labels, 'domain', key, back)}.{top}"


def iban_value(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))


def iban(s: str, key: bytes, back: bool) -> str | None:
    plain = s.replace(" ", "")
    # of several numbers with the same remainder only 02 to 98 are check digits
    if not 15 <= len(plain) <= 34 or not 2 <= int(plain[2:4]) <= 98 or iban_value(plain) % 97 != 1:
        return None
    account = characters(plain[4:], "iban" + plain[:2], key, back)
    return refill(s, plain[:2] + f"{98 - iban_value(plain[:2] + '00' + account) % 97:02d}" + account, "[A-Z0-9]")


def secret(s: str, key: bytes, back: bool) -> str:
    # letters keep their case where it is one; a mixed value is written in small letters and is no value by itself
    out = f"{feistel(16 ** len(s), 'secret', key)(int(s, 16), back):x}".zfill(len(s))
    return out.upper() if s == s.upper() and s != s.lower() else out


CHANGES: dict[str, Callable[[str, bytes, bool], str | None]] = {"card": card, "phone": phone, "date": date, "ssn": ssn, "ip": ip, "iban": iban, "email": email, "secret": secret}


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, list[str]]:
    """The text with pseudonyms (or, back, with the original values), and the kinds of the values."""
    out, kinds, done, at = [], [], 0, 0
    while m := _FIND.search(text, at):
        kind, value = m.lastgroup, m[0]
        new = None if kind == "secret" and not _NAMED.search(text[max(0, m.start() - 24) : m.start()]) else CHANGES[kind](value, key, back)
        if new is None:
            # a value that fails its check may hide one that begins later: a number after another
            at = m.start() + max(1, len(re.match(r"\w+", value)[0]) if value[0] != "+" else 1)
            continue
        out += [text[done : m.start()], new]
        kinds.append(kind)
        done = at = m.end()
    return ("".join([*out, text[done:]]) if kinds else text), kinds


def has_marks(column: pa.Array) -> np.ndarray:
    """Which texts have a digit or an at sign: all that a pattern can match, but for secrets of letters alone, which stay."""
    data, offsets = utf8(column)
    mark = ((data >= 48) & (data <= 57)) | (data == 64)
    total = np.concatenate([[0], np.cumsum(mark)])
    return np.diff(total[offsets]) > 0 if len(offsets) > 1 else np.zeros(len(column), bool)


def pseudonymized(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with pseudonyms in `text`; columns unchanged."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts, _ = changed(column, key, back)
            yield batch.set_column(at, batch.schema.field(at), texts.cast(column.type))

    return docs.mapInArrow(run, docs.schema)


def changed(column: pa.Array, key: bytes, back: bool) -> tuple[pa.Array, dict[int, list[str]]]:
    """The column with pseudonyms, and the kinds by row where there are any."""
    found: dict[int, tuple[str, list[str]]] = {}
    for i in np.flatnonzero(has_marks(column)).tolist():
        new, kinds = replaced(column[i].as_py(), key, back)
        if kinds:
            found[i] = (new, kinds)
    if not found:
        return column, {}
    mask = np.zeros(len(column), bool)
    mask[list(found)] = True
    rows = sorted(found)
    return pc.replace_with_mask(column, pa.array(mask), pa.array([found[i][0] for i in rows], column.type)), {i: found[i][1] for i in rows}


PSEUDONYMS = "doc_id long, text string, " + ", ".join(f"n_{k} int" for k in KINDS)


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """PSEUDONYMS: every document's text with pseudonyms, and how many values of each kind were replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = changed(batch.column(1), key, False)
            counts = np.zeros((len(KINDS), batch.num_rows), np.int32)
            for i, own in kinds.items():
                for k in own:
                    counts[KINDS.index(k), i] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, *map(pa.array, counts)], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PSEUDONYMS)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal numbers, dates and addresses."""
    # a session without a key of its own gets one that anybody can read here: right for tests, never for data
    key = spark.conf.get(SETTING, "public test key").encode()
    return pseudonyms(load(spark, sf_dir, "documents").select("doc_id", "text"), key)
