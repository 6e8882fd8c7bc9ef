"""Functions over Python source and typed text that have no built-in form."""

from __future__ import annotations

import ast
import difflib
import sys
import textwrap

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from .diff import line_diffs


def parsed(code: str) -> ast.Module:
    """The syntax tree; a SyntaxError whatever the parser fails by: null characters, or texts that overflow its stack (MemoryError, RecursionError)."""
    try:
        return ast.parse(code)
    except (ValueError, MemoryError, RecursionError) as fault:
        raise SyntaxError(str(fault)) from fault


def printed(tree: ast.AST) -> str:
    """ast.unparse of trees as deep as the parser makes them; the printer's recursion is Python's own, without C frames."""
    limit = sys.getrecursionlimit()
    try:
        return ast.unparse(tree)
    except RecursionError:
        sys.setrecursionlimit(max(limit, 200_000))
        return ast.unparse(tree)
    finally:
        sys.setrecursionlimit(limit)


def normalized(code: str) -> str:
    """The code as its syntax tree prints it, without doc strings (but those of async functions) and with sorted keyword arguments; unparsable code as it is.

    Arguments within the arguments of a call keep their order. Code too deep for Python's parser counts as unparsable.
    """
    try:
        tree = parsed(textwrap.dedent(code))
    except SyntaxError:
        return code
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef)):
            first = node.body[0] if node.body else None
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                node.body = node.body[1:] or ([] if isinstance(node, ast.Module) else [ast.Pass()])
        elif isinstance(node, ast.Call):
            node.keywords.sort(key=lambda k: str(k.arg))
            continue
        todo.extend(ast.iter_child_nodes(node))
    return printed(tree)


@F.pandas_udf(StringType())
def _normalized(code: pd.Series) -> pd.Series:
    return code.map(normalized, na_action="ignore")


def code_equal(a: Column, b: Column) -> Column:
    """Equal texts, or equal syntax trees. Filter equal texts out first where most are: the Python part runs for every row."""
    return (a == b) | (_normalized(a) == _normalized(b))


def keystrokes(before: str, after: str, jump: int = 4) -> int:
    """Least cost of typing `before` into `after`, by the rules of block_keystrokes."""
    return block_keystrokes([(before, after)], jump)[0]


def block_keystrokes(pairs: list[tuple[str, str]], jump: int = 4) -> list[int]:
    """Keystrokes from one text to another, for many pairs at once; the cursor starts `jump` or more away.

    Typing or deleting a character costs 1, deleting a range 2 and the cursor's way over it, moving the cursor its way,
    at most `jump`. Rows of the table are computed for a lot of pairs of like size together.
    """
    out = [0] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])), reverse=True)
    while order:
        lot = order[: max(1, CELLS // (len(pairs[order[0]][1]) + 1))]
        order = order[len(lot) :]
        lot.sort(key=lambda k: len(pairs[k][0]), reverse=True)
        for k, cost in zip(lot, _block_lot([pairs[k] for k in lot], jump)):
            out[k] = cost
    return out


#: Cells of a row of the table over all pairs of a lot.
CELLS = 1 << 15


def _block_lot(pairs: list[tuple[str, str]], jump: int) -> list[int]:
    """pairs: the longest first texts first. Tables run from the texts' ends, as the cursor is behind."""
    n, m = [len(a) for a, _ in pairs], [len(b) for _, b in pairs]
    kind, inf = (np.int16, 16_000) if max(n) + max(m) < 7000 else (np.int32, 1 << 29)
    codes = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1]
    old, new = np.zeros((len(pairs), max(n)), np.uint32), np.full((len(pairs), max(m)), 1 << 31, np.uint32)
    for p, (a, b) in enumerate(pairs):
        old[p, : n[p]], new[p, : m[p]] = codes(a), codes(b)
    j = np.arange(max(m) + 1, dtype=kind)
    # kept[c], gone[c]: least cost with the cursor c away, outside and inside a range that is being deleted
    kept = np.stack([np.tile(j + (j > 0) * kind(c), (len(pairs), 1)) for c in range(jump + 1)])
    gone = np.stack([np.tile(j + kind(1 + c), (len(pairs), 1)) for c in range(jump + 1)])
    gone[0, :, 1:] = inf
    out, live = [0] * len(pairs), len(pairs)
    for i in range(max(n) + 1):
        if i:
            unlike = np.where(new[:live] == old[:live, i - 1, None], kind(0), kind(inf))
            after_kept, after_gone = np.empty_like(kept), np.empty_like(gone)
            after_gone[0] = gone[min(1, jump)]
            edit = np.minimum(kept[0], after_gone[0]) + kind(1)
            first = edit.copy()
            np.minimum(first[:, 1:], kept[min(1, jump), :, :-1] + unlike, out=first[:, 1:])
            after_kept[0] = np.minimum.accumulate(first - j, axis=1) + j
            np.minimum(edit[:, 1:], after_kept[0, :, :-1] + kind(1), out=edit[:, 1:])
            for c in range(1, jump + 1):
                far = min(c + 1, jump)
                after_kept[c] = edit + kind(c)
                np.minimum(after_kept[c, :, 1:], kept[far, :, :-1] + unlike, out=after_kept[c, :, 1:])
                after_gone[c] = np.minimum(gone[far], after_kept[0] + kind(1 + c))
            kept, gone = after_kept, after_gone
        while live and n[live - 1] == i:
            live -= 1
            out[live] = int(kept[jump, live, m[live]])
        kept, gone = kept[:, :live], gone[:, :live]
    return out


def touched(before: list[str], after: list[str]) -> tuple[list[str], list[str]]:
    """The lines from the first to the last that a diff touches, before and after."""
    at, rows = 0, []
    for row in line_diffs(before, after):
        if row[0] != " ":
            rows.append(at)
        at += row[0] != "+"
    if not rows:
        return [], []
    a, b = rows[0], rows[-1] + 1
    return before[a:b], after[a : len(after) - max(0, len(before) - b)]


def text_keystrokes(pairs: list[tuple[str, str]], jump: int = 4) -> list[int]:
    """Keystrokes of whole texts: by opcodes of the touched lines, with replaced blocks costed by character."""
    out, blocks = [], []
    for k, (x, y) in enumerate(pairs):
        old, new = ("\n".join(side).splitlines() for side in touched(x.split("\n") if x else [], y.split("\n") if y else []))
        total = 0
        for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes():
            if tag == "delete":
                total += min(2 * (b - a), jump + 2) + jump
            elif tag == "insert":
                total += len("\n".join(new[c:d])) + jump
            elif tag == "replace":
                blocks.append((k, ("\n".join(old[a:b]), "\n".join(new[c:d]))))
        out.append(total)
    for (k, _), cost in zip(blocks, block_keystrokes([b for _, b in blocks], jump)):
        out[k] += cost
    return out


@F.pandas_udf(IntegerType())
def keystroke_cost(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(text_keystrokes([(a or "", b or "") for a, b in zip(before, after)]), dtype="int32")
