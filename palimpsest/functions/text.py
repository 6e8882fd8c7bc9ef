"""Text, line and number scalars as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: an expression that a lambda names is else computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def splitlines(text: Column) -> Column:
    """Lines of a text, a trailing empty one included; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def count_lines(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(splitlines(text), lambda x: F.trim(x) != "")).cast("long")


def fix_newline(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def short(text: Column, limit: int = 27) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit("...")))


def show_count(n: Column) -> Column:
    return F.when(n < 1000, n.cast("string")).otherwise(F.format_string("%.1fk", n / 1000))


def with_line_numbers(text: Column, start: int = 1) -> Column:
    return F.array_join(F.transform(splitlines(text), lambda x, i: F.concat(F.lpad((i + start).cast("string"), 4, " "), F.lit(": "), x)), "\n")


def first_lines(text: Column, most: int = 50) -> Column:
    """At most `most` lines, the last of them dots where some are cut."""
    lines = splitlines(text)
    return F.array_join(F.when(F.size(lines) <= most, lines).otherwise(F.concat(F.slice(lines, 1, most - 1), F.array(F.lit("...")))), "\n")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.nullif(b, F.lit(0)))


def retrieval_cost(refs: Column, query: Column, output: Column) -> Column:
    """Cost of attending from a query of a size to references and output."""
    return (refs + query) * (query + output) / 256 + refs + query + 2 * output


def module_name(path: Column) -> Column:
    """src/a/b.py is a.b, and a package's __init__.py the package."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "^src/", "")
    return F.replace(F.regexp_replace(bare, "/?__init__$", ""), F.lit("/"), F.lit("."))


def dotted(path: Column) -> Column:
    return F.split(path, r"\.", -1)


def interleaved(segments: Column, separators: Column) -> Column:
    """Segments with the n-th separator after the n-th segment; null where there isn't one separator less than segments."""
    whole = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(segments, 1, F.size(separators)), separators, lambda a, b: F.array(a, b))), ""), F.element_at(segments, -1))
    return F.when(F.size(separators) == F.size(segments) - 1, whole)


def lines_of(lines: Column) -> Column:
    """Lines as a text in which each ends with a line break."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def position(line: Column, column: Column) -> Column:
    return F.concat_ws(":", line.cast("string"), column.cast("string"))


def code_range(start_line: Column, start: Column, end_line: Column, end: Column) -> Column:
    """A range of code for people: columns are counted from 1."""
    return F.concat(F.lit("["), position(start_line, start + 1), F.lit("--"), position(end_line, end + 1), F.lit("]"))


def valid_range(start: Column, until: Column) -> Column:
    """(start, until) of lines, half open; null where it ends before it starts."""
    return F.when(start <= until, F.struct(start.alias("start"), until.alias("until")))


def sections(named: list[tuple[str, Column]], rule: str = "=" * 40) -> Column:
    """Titled sections, a rule above each."""
    return F.concat_ws("\n", *(x for title, content in named for x in (F.lit(rule), F.lit(f"{title}:"), content)))


def shown_map(pairs: Column, digits: int = 5) -> Column:
    """A map from names to numbers, a line each, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit(": "), F.round(e["value"], digits).cast("string"))), "\n")


def merged(maps: list[Column]) -> Column:
    """One map of several; of a key that more than one has, the last counts."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(m, k)), m)
    return out


def picked(pairs: Column, keys: Column) -> Column:
    """The part of a map under some keys."""
    return F.map_filter(pairs, lambda k, _: F.array_contains(keys, k))


def added_up(a: Column, b: Column) -> Column:
    """Maps from names to numbers, added."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def is_sorted(values: Column) -> Column:
    """Whether no value is below the one before it."""
    return F.forall(F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a <= b), lambda ok: ok)


def without_nulls(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def only(values: Column) -> Column:
    """The single element; null where there are none or several."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def replaced_at(text: Column, replaces: Column) -> Column:
    """The text with ranges replaced: replaces is an array of (start, until, priority, new), places in characters from 0, ranges that do not overlap.

    Of replacements that start at one place the lower priority comes first.
    """
    order = F.array_sort(F.transform(replaces, lambda r: F.struct(r["start"].alias("start"), r["priority"].alias("priority"), r["until"].alias("until"), r["new"].alias("new"))))
    state = "struct<at:int,out:string>"

    def build(t: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            gap = F.substring(t, s["at"] + 1, F.greatest(r["start"] - s["at"], F.lit(0)))
            return F.struct(F.greatest(r["until"], s["at"]).cast("int").alias("at"), F.concat(s["out"], gap, r["new"]).alias("out")).cast(state)

        return F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state), step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t))))

    return let(text, build)


def shown_change(kind: Column, name: Column, before: Column, after: Column, diff: Column) -> Column:
    """A change for people: its kind and name, then the indented text or diff."""
    body = F.when(kind == "A", after).when(kind == "D", before).otherwise(diff)
    title = F.when(kind == "A", "Added: ").when(kind == "D", "Deleted: ").when(before == after, "Unchanged: ").otherwise("Modified: ")
    shown = F.concat(title, name, F.lit("\n"), F.array_join(F.transform(F.split(body, "\n", -1), lambda x: F.when(F.trim(x) == "", x).otherwise(F.concat(F.lit("  "), x))), "\n"))
    return F.when((kind == "M") & (before == after), F.concat(title, name)).otherwise(shown)
