"""Levenshtein distance of long texts: exact, by rows of bits within a band that grows until it holds the distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def without_ends(a: str, b: str) -> tuple[str, str]:
    """Both texts without the beginning and the end that they have in common, which cost nothing."""
    k = shared(lambda n: a[:n] == b[:n], min(len(a), len(b)))
    a, b = a[k:], b[k:]
    k = shared(lambda n: a[len(a) - n :] == b[len(b) - n :], min(len(a), len(b)))
    return a[: len(a) - k], b[: len(b) - k]


def shared(same, most: int) -> int:
    """The greatest n up to `most` for which same(n) holds, as it does for all below."""
    low, high = 0, most
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if same(n) else (low, n - 1)
    return low


def levenshtein(a: str, b: str) -> int:
    """Least number of characters inserted, deleted or replaced between a and b."""
    old, new = without_ends(*((a, b) if len(a) >= len(b) else (b, a)))
    if not new:
        return len(old)
    # a path that leaves the diagonals -slack .. gap + slack has slack + 1 more characters inserted, and deleted, than it must
    gap, slack = len(old) - len(new), 32 + len(old) // 100
    while True:
        low, high = min(slack, len(new)), min(gap + slack, len(old) - 1)
        d = within_band(old, new, low, high)
        if d <= gap + 2 * slack + 1 or (low == len(new) and high == len(old) - 1):
            return d
        # d is reached by a path: a band that holds it is wide enough
        slack = min(2 * slack, (d - gap) // 2)


def within_band(old: str, new: str, low: int, high: int) -> int:
    """Least cost by paths that are at most `low` rows before and `high` behind the diagonal; old is as long as new or longer, high less than its length.

    Hyyrö's bit-parallel band: bit r of a column stands for row column - low + r; the value is carried along the lowest diagonal, then along the last row.
    """
    n, width = len(old), low + high + 1
    full, last = (1 << width) - 1, width - 1
    codes = np.frombuffer(old.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") << low for c in np.unique(codes)}
    # whether a row is one more, or one less, than the row before it
    more, less = full ^ ((1 << low) - 1), 0
    value, step = high, max(256, width)
    near = (1 << (width + step)) - 1
    for start in range(0, len(new), step):
        window = {c: (bits >> start) & near for c, bits in places.items()}
        for j, c in enumerate(new[start : start + step]):
            same = (window.get(c, 0) >> j) & full
            level = ((((same & more) + more) ^ more) | same | less) & full
            right_more, right_less = less | (full ^ (level | more)), level & more
            end = n - 1 - start - j + low
            if end >= last:
                value += not (level >> last) & 1
            else:
                value += ((right_more >> end) & 1) - ((right_less >> end) & 1)
            level >>= 1
            more, less = right_less | (full ^ (level | right_more)), level & right_more
    return value


@F.pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """F.levenshtein, which holds and fills the whole table, for long texts."""
    return pd.Series([None if x is None or y is None else levenshtein(x, y) for x, y in zip(a, b)], dtype="Int64")
