"""Line diffs: Arrow-batched Python, called for changed texts only."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: From so many characters on, a diff without matching inside lines is used.
LONG = 8000


def line_diffs(before: list[str], after: list[str]) -> list[str]:
    """Lines led by '  ', '- ' or '+ '; of a line that changed, the new form comes before the old one."""
    long = max(sum(map(len, x)) + len(x) for x in (before, after)) > LONG
    out: list[str] = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [f"  {x}" for x in before[a:b]]
            continue
        old, new = [f"- {x}" for x in before[a:b]], [f"+ {x}" for x in after[c:d]]
        if tag == "replace" and not long:
            out += paired(before[a:b], after[c:d])
        else:
            out += old + new if tag == "replace" and len(new) < len(old) else new + old
    return out


def paired(before: list[str], after: list[str], least: float = 0.75) -> list[str]:
    """A replaced block: its most similar pair of lines splits it, unlike blocks are listed whole."""
    best, at = least, None
    for i, x in enumerate(before):
        for j, y in enumerate(after):
            m = difflib.SequenceMatcher(None, x, y)
            if m.real_quick_ratio() > best and m.quick_ratio() > best and m.ratio() > best:
                best, at = m.ratio(), (i, j)
    if at is None:
        old, new = [f"- {x}" for x in before], [f"+ {x}" for x in after]
        return old + new if len(new) < len(old) else new + old
    i, j = at
    return paired(before[:i], after[:j], least) + [f"+ {after[j]}", f"- {before[i]}"] + paired(before[i + 1 :], after[j + 1 :], least)


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


@F.pandas_udf(ArrayType(StringType()))
def diff_rows(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([line_diffs(_lines(a), _lines(b)) for a, b in zip(before, after)])


OP = StructType([StructField("tag", StringType()), *(StructField(c, IntegerType()) for c in "abcd")])
OPS = {"delete": "D", "insert": "A", "replace": "R", "equal": " "}


@F.pandas_udf(ArrayType(OP))
def diff_ops(before: pd.Series, after: pd.Series) -> pd.Series:
    """Ranges of lines that were added (A), deleted (D), replaced (R) or kept."""
    return pd.Series([[{"tag": OPS[t], "a": a, "b": b, "c": c, "d": d} for t, a, b, c, d in difflib.SequenceMatcher(None, _lines(x), _lines(y), autojunk=False).get_opcodes()] for x, y in zip(before, after)])
