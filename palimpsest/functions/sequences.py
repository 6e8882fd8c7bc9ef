"""Token sequences of functions.tokens as Python lists, for whole diffs: a pass over a list costs a token far less than an array expression does.

The rules are those of the functions of the same names in tokens.py, which tests compare.
"""

from __future__ import annotations

import hashlib
import re

from .tokens import ADD, BOS, DEL, EOS, MARKS, NL, PAD

Tokens = list[str]
_pieces = re.compile("[A-Za-z0-9_]+|[^A-Za-z0-9_]").findall
_CUT = "\u001f"
_DEL_THEN = re.compile(f"{DEL}{_CUT}(?!<[0-9]+>)")
_MARKS = {f"<{i}>" for i in range(MARKS)} | {f"<{i:02}>" for i in range(MARKS)}


def md5(tokens: Tokens) -> str:
    return hashlib.md5(_CUT.join(tokens).encode()).hexdigest()


def joined(segments: list[Tokens]) -> Tokens:
    out: Tokens = []
    for k, s in enumerate(segments):
        if k:
            out.append(NL)
        out += s
    return out


def parted(tokens: Tokens) -> list[Tokens]:
    """Lines; none of an empty sequence."""
    if not tokens:
        return []
    out, start = [], 0
    for end in [k for k, t in enumerate(tokens) if t == NL]:
        out.append(tokens[start:end])
        start = end + 1
    return [*out, tokens[start:]]


def encode_diff(diff: list[str]) -> Tokens:
    head = {"+": [ADD], "-": [DEL]}
    return joined([head.get(d[:1], []) + _pieces(d[1:]) for d in diff])


def change_of(tokens: Tokens) -> tuple[str, str]:
    """(before, after)"""
    lines = [(x[0] if x and x[0] in (ADD, DEL) else "", x) for x in parted(tokens)]
    text = [(tag, "".join(x[1:] if tag else x)) for tag, x in lines]
    return "\n".join(t for tag, t in text if tag != ADD), "\n".join(t for tag, t in text if tag != DEL)


def original_and_actions(tokens: Tokens) -> tuple[list[Tokens], list[list[Tokens]]]:
    lines, acts, held = [], [], []
    for x in parted(tokens):
        first = x[0] if x else ""
        if first == ADD:
            held.append(x)
            continue
        lines.append(x[1:] if first == DEL else x)
        acts.append([*held, [DEL]] if first == DEL else held)
        held = []
    return lines, [*acts, held]


def delta_of(tokens: Tokens) -> tuple[Tokens, dict[int, list[Tokens]]]:
    lines, acts = original_and_actions(tokens)
    return joined(lines), {i: a for i, a in enumerate(acts) if a}


def input_output(tokens: Tokens) -> tuple[Tokens, Tokens]:
    lines, acts = original_and_actions(tokens)
    output: Tokens = []
    for i, some in enumerate(acts[:MARKS]):
        output.append(f"<{i}>")
        for a in some:
            output += a
            if a[0] == ADD:
                output.append(NL)
    return joined([[f"<{i}>", *x] if i < MARKS else x for i, x in enumerate([*lines, []])]), output


def inlined(tokens: Tokens, output: Tokens) -> Tokens:
    """The input with the output's segments in place of their marks."""
    segments: dict[str, Tokens] = {}
    now: Tokens = []
    for t in output:
        if t in _MARKS:
            now = segments[t] = []
        elif t not in (PAD, BOS, EOS):
            now.append(t)
    out: Tokens = []
    for t in tokens:
        if t in _MARKS:
            out += segments.get(t, [])
        else:
            out.append(t)
    return out


def applied(tokens: Tokens, delta: dict[int, list[Tokens]], keep_deleted: bool = True) -> Tokens:
    out, lines = [], parted(tokens)
    for i, x in enumerate([*lines, None]):
        acts = delta.get(i, [])
        out += [a if keep_deleted else a[1:] for a in acts if a[0] == ADD]
        if x is not None:
            gone = any(a[0] == DEL for a in acts)
            if not gone or keep_deleted:
                out.append([DEL, *x] if gone else x)
    return joined(out)


def valid_output(output: Tokens) -> bool:
    return not _DEL_THEN.search(_CUT.join(output))


def marks_known(tokens: Tokens, output: Tokens) -> bool:
    return _MARKS.intersection(output) <= set(tokens)
