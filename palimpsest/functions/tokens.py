"""Token sequences of texts and edits, as built-in array expressions.

Tokens are strings. Words and single other characters are tokens of text; lines are joined by NL; ADD and DEL lead the added and deleted
lines of an inline diff; the marks <0> .. <99> name lines of an input and lead the segments of an output. A token delta is
a map from line to actions, arrays of tokens led by ADD or equal to [DEL]. Tokens hold no U+001F, by which sequences are cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, splitlines

NL, ADD, DEL, BOS, EOS, PAD = "<nl>", "<add>", "<del>", "<s>", "</s>", "<pad>"
SPECIAL = (PAD, BOS, EOS, NL, ADD, DEL)
MARKS = 100
_CUT = "\u001f"
_PIECES = "[A-Za-z0-9_]+|[^A-Za-z0-9_]"
#: a mark among tokens joined by _CUT
_MARK = f"(?<![^{_CUT}])<[0-9]{{1,2}}>(?![^{_CUT}])"


def none() -> Column:
    return F.array().cast("array<string>")


def no_lines() -> Column:
    return F.array().cast("array<array<string>>")


def special_id(token: str) -> int:
    """The number of a special token; marks come after the others."""
    return SPECIAL.index(token) if token in SPECIAL else len(SPECIAL) + int(token[1:-1])


def encode_line(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))


def encode(text: Column) -> Column:
    """Tokens of a text, line by line, so that a line break is always NL."""
    return joined(F.transform(splitlines(text), encode_line), NL)


def decode(tokens: Column, pretty: bool = False) -> Column:
    """The text of tokens; pretty: marks are written <mask_n>."""
    text = F.array_join(F.transform(tokens, lambda t: F.when(t == NL, "\n").otherwise(t)), "")
    return F.regexp_replace(text, "<([0-9]+)>", "<mask_$1>") if pretty else text


def joined(segments: Column, separator: str | None = None) -> Column:
    """Segments as one sequence, a separator between them."""
    if separator is None:
        return F.flatten(segments)
    return F.flatten(F.transform(segments, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.array(F.lit(separator)), s))))


def parted(tokens: Column, separator: str = NL) -> Column:
    """Segments between separators; none of an empty sequence."""
    part = lambda s: let(F.regexp_replace(s, f"^{_CUT}|{_CUT}$", ""), lambda t: F.when(t == "", none()).otherwise(F.split(t, _CUT)))
    return let(tokens, lambda ts: F.when(F.size(ts) == 0, no_lines()).otherwise(F.transform(F.split(F.array_join(ts, _CUT), separator, -1), part)))


def line_range(tokens: Column, start: Column, until: Column) -> Column:
    """The tokens of lines start .. until - 1, both brought into the text's range."""
    return let(parted(tokens), lambda ls: let(F.least(F.greatest(start, F.lit(0)), F.size(ls)), lambda a: joined(F.slice(ls, a + 1, F.greatest(F.least(until, F.size(ls)) - a, F.lit(0))), NL)))


def mark(i: Column) -> Column:
    return F.concat(F.lit("<"), i.cast("string"), F.lit(">"))


def is_mark(token: Column) -> Column:
    return token.rlike("^<[0-9]{1,2}>$")


def marks_in(tokens: Column) -> Column:
    """The marks of a sequence, by one pass over its text instead of an expression for every token."""
    return F.regexp_extract_all(F.array_join(tokens, _CUT), F.lit(_MARK), F.lit(0))


def mark_number(token: Column) -> Column:
    return F.when(is_mark(token), F.regexp_extract(token, "[0-9]+", 0).cast("int"))


def renumbered(tokens: Column, seed: Column) -> Column:
    """Tokens with their marks permuted one to one, by a permutation of all marks that the seed chooses."""
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), lambda i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i")))), lambda s: s["i"])
    return let(order, lambda to: F.transform(tokens, lambda t: F.when(is_mark(t), mark(F.element_at(to, mark_number(t) + 1))).otherwise(t)))


def segments(output: Column) -> Column:
    """Array of (mark, tokens) of an output; padding and sequence ends are left out, tokens before the first mark are lost, of equal marks the last counts."""

    def cut(text: Column) -> Column:
        keys, parts = F.regexp_extract_all(text, F.lit("<[0-9]{1,2}>"), F.lit(0)), F.split(text, "<[0-9]{1,2}>", -1)
        part = lambda s: let(F.regexp_replace(s, f"^{_CUT}|{_CUT}$", ""), lambda t: F.when(t == "", none()).otherwise(F.split(t, _CUT)))
        pairs = F.zip_with(keys, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda k, s: F.struct(k.alias("mark"), part(s).alias("tokens")))
        # marks are few: at most MARKS different ones
        return let(keys, lambda ks: F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(ks, i + 2, F.greatest(F.size(ks) - i - 1, F.lit(0))), p["mark"])))

    return let(F.array_join(F.filter(output, lambda t: ~t.isin(PAD, BOS, EOS)), _CUT), cut)


def as_map(pairs: Column) -> Column:
    return F.map_from_entries(pairs)


def encode_diff(diff: Column) -> Column:
    """Tokens of diff lines ('+', '-' or ' ' and the line)."""
    head = lambda d: F.when(F.startswith(d, F.lit("+")), F.array(F.lit(ADD))).when(F.startswith(d, F.lit("-")), F.array(F.lit(DEL))).otherwise(none())
    return joined(F.transform(diff, lambda d: F.concat(head(d), encode_line(F.substring(d, 2, 1 << 30)))), NL)


def diff_of(kind: Column, before: Column, after: Column, modified: Column) -> Column:
    """Diff lines of a change: all added, all deleted, context where nothing changed, else `modified`, the lines' diff."""
    led = lambda text, tag: F.transform(splitlines(text), lambda x: F.concat(F.lit(tag), x))
    return F.when(kind == "A", led(after, "+")).when(kind == "D", led(before, "-")).when(before == after, led(before, " ")).otherwise(modified)


def change_of(tokens: Column) -> Column:
    """(before, after): the texts of an inline diff's two sides."""

    def side(lines: Column, other: str) -> Column:
        mine = F.filter(lines, lambda x: ~first_is(x, other))
        return F.array_join(F.transform(mine, lambda x: F.array_join(F.when(first_is(x, ADD) | first_is(x, DEL), F.slice(x, 2, F.size(x))).otherwise(x), "")), "\n")

    return let(parted(tokens), lambda ls: F.struct(side(ls, ADD).alias("before"), side(ls, DEL).alias("after")))


def first_is(line: Column, token: str) -> Column:
    return F.coalesce(F.get(line, F.lit(0)) == token, F.lit(False))


def input_of_code(tokens: Column) -> Column:
    """Code as input: a mark before each of the first lines, and one on a line of its own at the end for what is appended."""
    return let(F.concat(parted(tokens), F.array(none())), lambda ls: joined(F.transform(ls, lambda x, i: F.when(i < MARKS, F.concat(F.array(mark(i)), x)).otherwise(x)), NL))


def original_and_actions(tokens: Column) -> Column:
    """(input: lines, acts: the actions of each line and, last, those of the end) of an inline diff."""

    def cut(ls: Column, at: Column) -> Column:
        # at: the places of lines that are not added; the adds before each of them lie between it and the one before
        adds = lambda k, until: let(F.coalesce(F.get(at, k - 1), F.lit(-1)), lambda old: F.slice(ls, old + 2, until - old - 1))
        bare = lambda x: F.when(first_is(x, DEL), F.slice(x, 2, F.size(x))).otherwise(x)
        gone = lambda i: F.when(first_is(F.get(ls, i), DEL), F.array(F.array(F.lit(DEL)))).otherwise(no_lines())
        acts = F.transform(at, lambda i, k: F.concat(adds(k, i), gone(i)))
        return F.struct(F.transform(at, lambda i: bare(F.get(ls, i))).alias("input"), F.concat(acts, F.array(adds(F.size(at), F.size(ls)))).alias("acts"))

    places = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(~first_is(x, ADD), i)), lambda i: i.isNotNull())
    return let(parted(tokens), lambda ls: let(places(ls), lambda at: cut(ls, at)))


def delta_of(tokens: Column) -> Column:
    """(original, delta) of an inline diff's tokens."""
    entries = lambda acts: F.filter(F.transform(acts, lambda a, i: F.struct(i.alias("line"), a.alias("acts"))), lambda e: F.size(e["acts"]) > 0)
    return let(original_and_actions(tokens), lambda s: F.struct(joined(s["input"], NL).alias("original"), F.map_from_entries(entries(s["acts"])).alias("delta")))


def input_output(tokens: Column) -> Column:
    """(input, output) of an inline diff: the original's lines led by marks, and for each mark what is added before its line and whether the line goes.

    Lines from MARKS on have no mark, and their output is lost; the input ends with a line for what is appended.
    """
    adds = lambda a: F.flatten(F.transform(a, lambda x: F.when(first_is(x, ADD), F.concat(x, F.array(F.lit(NL)))).otherwise(x)))
    build = lambda s: F.struct(
        joined(F.transform(F.concat(s["input"], F.array(none())), lambda x, i: F.when(i < MARKS, F.concat(F.array(mark(i)), x)).otherwise(x)), NL).alias("input"),
        F.flatten(F.transform(F.slice(s["acts"], 1, MARKS), lambda a, i: F.concat(F.array(mark(i)), adds(a)))).alias("output"),
    )
    return let(original_and_actions(tokens), build)


def inlined(tokens: Column, output: Column, keep: bool = False) -> Column:
    """The input with the output's segments in place of their marks; marks without one go, or stay where `keep`."""

    def swap(m: Column, text: Column) -> Column:
        keys, parts = F.regexp_extract_all(text, F.lit(_MARK), F.lit(0)), F.split(text, _MARK, -1)
        fill = lambda k: F.coalesce(F.array_join(F.try_element_at(m, k), _CUT), k if keep else F.lit(""))
        bare = lambda p: F.regexp_replace(p, f"^{_CUT}|{_CUT}$", "")
        pieces = lambda ps: F.concat(F.array(bare(F.get(ps, F.lit(0)))), F.flatten(F.zip_with(keys, F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), lambda k, p: F.array(fill(k), bare(p)))))
        whole = F.array_join(F.filter(let(parts, pieces), lambda p: p != ""), _CUT)
        return let(whole, lambda w: F.when(w == "", none()).otherwise(F.split(w, _CUT)))

    return let(as_map(segments(output)), lambda m: let(F.array_join(tokens, _CUT), lambda text: swap(m, text)))


def edit_of(tokens: Column, output: Column) -> Column:
    """(before, after) of an input and its output."""
    return change_of(inlined(tokens, output))


def without_unknown(tokens: Column, output: Column) -> Column:
    """The output in the input's order of marks, without segments of marks that the input lacks; unchanged where both have the same marks."""

    def order(segs: Column) -> Column:
        keys = F.array_distinct(marks_in(tokens))
        known = F.transform(segs, lambda s: s["mark"])
        pick = F.flatten(F.transform(F.filter(keys, lambda k: F.array_contains(known, k)), lambda k: F.concat(F.array(k), F.element_at(F.filter(segs, lambda s: s["mark"] == k), 1)["tokens"])))
        return F.when((F.size(F.array_except(keys, known)) == 0) & (F.size(F.array_except(known, keys)) == 0), output).otherwise(pick)

    return let(segments(output), order)


def actions_of(segment: Column) -> Column:
    """The actions in a segment: each is led by ADD or DEL, other text is dropped, a last NL trimmed."""
    text = F.array_join(segment, _CUT)
    pieces = lambda t: F.filter(F.split(t, f"(?={ADD}|{DEL})", -1), lambda p: F.startswith(p, F.lit(ADD)) | F.startswith(p, F.lit(DEL)))
    return F.transform(let(text, pieces), lambda p: F.split(F.regexp_replace(F.regexp_replace(p, f"{_CUT}$", ""), f"{_CUT}{NL}$", ""), _CUT))


def delta_of_output(lines: Column, output: Column) -> Column:
    """The delta of an output whose segments belong, in order, to these lines; the shorter of both ends it, empty segments are left out."""
    pairs = lambda segs: F.zip_with(F.slice(lines, 1, F.least(F.size(lines), F.size(segs))), F.slice(segs, 1, F.least(F.size(lines), F.size(segs))), lambda i, s: F.struct(i.alias("line"), s["tokens"].alias("tokens")))
    return F.map_from_entries(F.transform(F.filter(let(segments(output), pairs), lambda e: F.size(e["tokens"]) > 0), lambda e: F.struct(e["line"].alias("line"), actions_of(e["tokens"]).alias("acts"))))


def lines_of_delta(delta: Column) -> Column:
    """A token delta as text: '+' and the line, or '-'."""
    return F.transform_values(delta, lambda _, acts: F.transform(acts, lambda a: F.when(first_is(a, ADD), F.concat(F.lit("+"), decode(F.slice(a, 2, F.size(a))))).otherwise("-")))


def tokens_of_delta(delta: Column) -> Column:
    """A text delta ('+' and the line, or '-') as tokens."""
    return F.transform_values(delta, lambda _, acts: F.transform(acts, lambda a: F.when(F.startswith(a, F.lit("+")), F.concat(F.array(F.lit(ADD)), encode_line(F.substring(a, 2, 1 << 30)))).otherwise(F.array(F.lit(DEL)))))


def applied(tokens: Column, delta: Column, keep_deleted: bool = True) -> Column:
    """A token delta applied: to the inline diff (deleted lines led by DEL, added ones by ADD), or to the text."""

    def line(acts: Column, x: Column) -> Column:
        adds = F.filter(acts, lambda a: first_is(a, ADD))
        gone = F.exists(acts, lambda a: first_is(a, DEL))
        if keep_deleted:
            return F.concat(adds, F.array(F.when(gone, F.concat(F.array(F.lit(DEL)), x)).otherwise(x)))
        return F.concat(F.transform(adds, lambda a: F.slice(a, 2, F.size(a))), F.when(gone, no_lines()).otherwise(F.array(x)))

    at = lambda i: F.coalesce(F.try_element_at(delta, i.cast("int")), no_lines())
    tail = lambda ls: F.transform(F.filter(at(F.size(ls)), lambda a: first_is(a, ADD)), lambda a: a if keep_deleted else F.slice(a, 2, F.size(a)))
    return let(parted(tokens), lambda ls: joined(F.concat(F.flatten(F.transform(ls, lambda x, i: line(at(i), x))), tail(ls)), NL))


def valid_output(output: Column) -> Column:
    """No DEL is followed by anything but a mark."""
    return ~F.array_join(output, _CUT).rlike(f"{DEL}{_CUT}(?!<[0-9]+>)")


def small_edit(output: Column, most: int = 5) -> Column:
    return F.size(F.filter(output, lambda t: t.isin(ADD, DEL))) <= most


def marks_known(tokens: Column, output: Column) -> Column:
    """Whether the input has all marks of the output."""
    return F.size(F.array_except(marks_in(output), marks_in(tokens))) == 0


def changed_tokens(delta: Column) -> Column:
    """Size of a delta: the tokens of all its actions."""
    return F.aggregate(F.flatten(F.map_values(delta)), F.lit(0), lambda n, a: n + F.size(a))


def changed_lines(delta: Column) -> Column:
    return F.size(F.flatten(F.map_values(delta)))


def compressed(tokens: Column, context: int) -> Column:
    """An inline diff with only the lines within `context` of a change; each run of others is one line of dots."""

    def build(ls: Column) -> Column:
        hit = lambda x: first_is(x, ADD) | first_is(x, DEL)
        near = F.transform(ls, lambda _, i: F.exists(F.slice(ls, F.greatest(i - context, F.lit(0)) + 1, i + context + 1 - F.greatest(i - context, F.lit(0))), hit))
        shown = lambda n: F.filter(F.transform(ls, lambda x, i: F.when(F.get(n, i), x).when((i == 0) | F.get(n, i - 1), F.array(*map(F.lit, "...")))), lambda x: x.isNotNull())
        return joined(let(near, shown), NL)

    return let(parted(tokens), build)


def truncated(section: Column, limit: Column, keep_end: bool = False, ends: bool = True) -> Column:
    """A section cut to its limit: its beginning stays, or its end; the token at the cut becomes EOS or BOS where `ends`."""
    if keep_end:
        kept = F.when(limit <= 0, section if not ends else none()).otherwise(F.slice(section, F.size(section) - F.greatest(limit, F.lit(1)) + 1, F.greatest(limit, F.lit(1))))
        cut = F.concat(F.array(F.lit(BOS)), F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1)))) if ends else kept
    else:
        kept = F.slice(section, 1, F.greatest(limit, F.lit(0)))
        cut = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.lit(EOS))) if ends else kept
    return F.when(F.size(section) <= limit, section).when(limit <= 0, none()).otherwise(cut)


def chunks_with_header(tokens: Column, header: Callable[[Column], Column], header_size: int, size: int, overlap: int, backward: bool = False, ends: bool = True, most: int | None = None) -> Column:
    """Chunks of at most `size` tokens, each led by header(chunk number), header_size tokens long.

    Each chunk after the first begins `overlap` tokens before the end of what has been passed; `backward` goes from the end. The tokens at cuts
    become BOS and EOS where `ends`. As in the rule this follows, a chunk passes size - header - overlap tokens of which the overlap are old ones.
    """
    if size - header_size - overlap <= 0:
        raise ValueError("a chunk must have room for more than its header and overlap")
    first, later = size - header_size, size - header_size - overlap

    def build(tks: Column) -> Column:
        n = F.size(tks)
        count = F.when(n == 0, 0).when(n <= first, 1).otherwise(F.lit(1) + F.ceil((n - first) / later)).cast("int")
        count = F.least(count, F.lit(most)) if most is not None else count

        def chunk(k: Column) -> Column:
            at = F.when(k == 0, 0).otherwise(first + (k - 1) * later).cast("int")
            room, old = F.when(k == 0, first).otherwise(later), F.when(k == 0, 0).otherwise(overlap)
            if backward:
                end = n - (at - old)
                start = F.greatest(end - room, F.lit(0))
            else:
                start = at - old
                end = F.least(start + room, n)
            body = F.slice(tks, start + 1, end - start)
            if ends:
                old_edge, new_edge = k > 0, at + room < n - 1
                left, right = (new_edge, old_edge) if backward else (old_edge, new_edge)
                body = let(body, lambda b: F.transform(b, lambda t, i: F.when(left & (i == 0), BOS).when(right & (i == F.size(b) - 1), EOS).otherwise(t)))
            return F.concat(header(k), body)

        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), chunk)).otherwise(no_lines())

    return let(tokens, build)


def header_tokens(headers: Column, offset: Column, most: int = 128) -> Column:
    """Headers (arrays of tokens) and, where it isn't 0, the offset's line, each ended by NL, cut on the left."""
    line = F.when(offset != 0, F.array(encode_line(F.concat(F.lit("# offset: "), offset.cast("string"))))).otherwise(no_lines())
    return truncated(joined(F.concat(headers, line, F.array(none())), NL), F.lit(most), keep_end=True)


def with_context(tokens: Column, above: Column, below: Column, room: int, overlap: int = 32) -> Column:
    """(input, above, below): context moved into what room the input leaves; what is left of it overlaps the input by `overlap` tokens."""
    spare = F.lit(room) - F.size(tokens)
    # shares of a room that varies: half each, then what is left over to the first
    half = F.floor(spare / 2).cast("int")
    a0, b0 = F.least(F.size(above), half), F.least(F.size(below), half)
    a = a0 + F.least(F.size(above) - a0, spare - a0 - b0)
    b = b0 + F.least(F.size(below) - b0, spare - a - b0)
    up, down = truncated(above, a.cast("int"), keep_end=True), truncated(below, b.cast("int"))
    left_a, left_b = F.size(above) - a, F.size(below) - b
    moved = F.struct(
        F.concat(up, tokens, down).alias("input"),
        F.when(left_a > 0, truncated(above, (left_a + overlap).cast("int"))).otherwise(none()).alias("above"),
        F.when(left_b > 0, truncated(below, (left_b + overlap).cast("int"), keep_end=True)).otherwise(none()).alias("below"),
    )
    return F.when((spare > 0) & (F.size(above) + F.size(below) > 0), moved).otherwise(F.struct(tokens.alias("input"), above.alias("above"), below.alias("below")))


def padded(sequences: Column, pad: Column | str = PAD) -> Column:
    """Sequences filled up to the longest one's length."""
    pad = F.lit(pad) if isinstance(pad, str) else pad
    return let(F.array_max(F.transform(sequences, lambda s: F.size(s))), lambda n: F.transform(sequences, lambda s: F.concat(s, F.array_repeat(pad, (n - F.size(s)).cast("int")))))


def without_padding(tokens: Column, pad: str = PAD) -> Column:
    return F.filter(tokens, lambda t: t != pad)


def wrapped(tokens: Column) -> Column:
    """BOS and EOS around tokens; a BOS that is there already is not doubled."""
    return F.when(first_is(tokens, BOS), tokens).otherwise(F.concat(F.array(F.lit(BOS)), tokens, F.array(F.lit(EOS))))


def round_up(n: Column, to: int = 64) -> Column:
    """Length group: n up to the next multiple."""
    return (F.ceil(n / to) * to).cast("long")
