"""From version histories to edit problems: changed spans of every commit, their context, and their token form.

Parsing and diffing are Arrow-batched functions of one module's change; everything between rows is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.code import normalized, parsed
from ..functions.diff import diff_rows, line_diffs
from ..functions.text import count_lines
from .changes import version_changes
from .retrieval import ranked_context
from .scopes import module_order, spans_of

#: 'unparsed' is the kind of a module that is not Python; its change is not searched.
COMMIT_SPANS = "project string, seq long, module string, path string, kind string, nth int, change string, start int, until int, before string, after string, headers array<string>"


def original_and_delta(before: str, after: str) -> tuple[list[str], dict[int, list[str]]]:
    """The lines of a text and its delta to another one, actions as '+line' or '-'."""
    lines, delta, held = [], {}, []
    for row in line_diffs(before.split("\n") if before else [], after.split("\n") if after else []):
        if row[0] == "+":
            held.append("+" + row[2:])
            continue
        acts = held + ["-"] * (row[0] == "-")
        if acts:
            delta[len(lines)] = acts
        lines.append(row[2:])
        held = []
    if held:
        delta[len(lines)] = held
    return lines, delta


def after_edit(lines: list[str], delta: dict[int, list[str]]) -> str:
    out = []
    for k in range(len(lines) + 1):
        acts = delta.get(k, [])
        out += [a[1:] for a in acts if a[0] == "+"]
        if k < len(lines) and "-" not in acts:
            out.append(lines[k])
    return "\n".join(out)


def scopes_of(code: str) -> dict[str, dict]:
    """path -> header and spans [(kind, nth, start, until, code)] of every scope."""
    out: dict[str, dict] = {"": {"header": "", "spans": []}}
    for path, kind, nth, a, b, text in spans_of(code):
        scope = out.setdefault(path, {"header": "", "spans": []})
        if kind == "header":
            scope["header"] = text
        else:
            scope["spans"].append((kind, nth, a, b, text))
    return out


def ancestors(path: str) -> list[str]:
    """The scopes around a path and itself, outermost first."""
    parts = path.split(".") if path else []
    return ["", *(".".join(parts[: i + 1]) for i in range(len(parts)))]


def spans_of_change(before: str | None, after: str | None, syntax_only: bool = True, unchanged: bool = False) -> list[tuple]:
    """(path, kind, nth, change, start, until, before, after, headers) of the spans of a module's change, by their first lines.

    Scopes pair by path. In a pair, all statements are compared as one text, so statements that move between spans are followed; a pair with the same syntax tree
    has no changes unless syntax_only is off. Spans of scopes that one side lacks are added or deleted whole.
    """
    old, new = (scopes_of(x) if x is not None else {} for x in (before, after))
    out = []
    for path in dict.fromkeys([*old, *new]):
        mine = old.get(path) or new.get(path)
        side = old if path in old else new
        headers = [side[p]["header"] for p in ancestors(path) if side.get(p, {}).get("header")]
        if path not in old or path not in new:
            change = "A" if path not in old else "D"
            out += [(path, kind, nth, change, a, b, None if change == "A" else text, text if change == "A" else None, headers) for kind, nth, a, b, text in mine["spans"]]
            continue
        x, y = ("".join(s[4] for s in scope[path]["spans"]) for scope in (old, new))
        if not unchanged and (x == y or (syntax_only and normalized(x) == normalized(y))):
            continue
        lines, delta = original_and_delta(x, y)
        at = 0
        for k, (kind, nth, a, b, text) in enumerate(mine["spans"]):
            own = text[:-1].split("\n")
            n = len(own)
            end = at + n + (k == len(mine["spans"]) - 1)
            part = {i - at: acts for i, acts in delta.items() if at <= i < end}
            if part:
                out.append((path, kind, nth, "M", a, b, text, after_edit(own, {min(i, n): acts for i, acts in part.items()}).rstrip("\n") + "\n", headers))
            elif unchanged:
                out.append((path, kind, nth, "M", a, b, text, text, headers))
            at += n
        if not mine["spans"] and new[path]["spans"]:
            out += [(path, kind, nth, "A", a, b, None, text, headers) for kind, nth, a, b, text in new[path]["spans"]]
    return sorted(out, key=lambda r: (r[4], r[0], r[1], r[2]))


def parses(code: str | None) -> bool:
    try:
        parsed(code or "")
    except SyntaxError:
        return False
    return True


def commit_spans(versions: DataFrame, syntax_only: bool = True) -> DataFrame:
    """COMMIT_SPANS of version rows (project, path, seq, content): the changed spans of every commit.

    A module that does not parse on either side gives one row of kind 'unparsed', so that what is left out shows. Unchanged versions are not parsed.
    """
    changed = version_changes(versions).where("NOT unchanged").select("project", "seq", "path", "before", "after")

    def run(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in COMMIT_SPANS.split(", ")]
        for lot in lots:
            rows = []
            for project, seq, path, before, after in lot.itertuples(index=False):
                if parses(before) and parses(after):
                    rows += [(project, seq, path, *s) for s in spans_of_change(before, after, syntax_only)]
                else:
                    rows.append((project, seq, path, "", "unparsed", 0, "M" if before is not None and after is not None else "A" if before is None else "D", 1, 1, None, None, []))
            yield pd.DataFrame(rows, columns=names)

    return changed.select(F.col("project").cast("string"), F.col("seq").cast("long"), F.col("path").cast("string"), "before", "after").mapInPandas(run, COMMIT_SPANS)


def ordered_modules(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, module, place): modules with what they import first. imports (project, src, dst), modules (project, module); a project's graph is one group."""
    edges = imports.select("project", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(modules.select("project", F.col("module").alias("a"), F.lit(None).cast("string").alias("b")))

    def run(lot: pd.DataFrame) -> pd.DataFrame:
        order = module_order([(a, b) for a, b in zip(lot["a"], lot["b"]) if b is not None], sorted(set(lot["a"])))
        return pd.DataFrame({"project": lot["project"].iloc[0], "module": order, "place": range(len(order))})

    return edges.groupBy("project").applyInPandas(run, "project string, module string, place int")


def admissible(spans: DataFrame, max_chars: int = 6000, max_lines: int = 500, functions_only: bool = False) -> DataFrame:
    """The spans that make problems: modified ones of which neither side is too large."""
    fits = F.col("change") == "M"
    for c in ("before", "after"):
        fits &= (F.length(c) <= max_chars) & (count_lines(F.col(c)) <= max_lines)
    return spans.where(fits & (F.col("kind") == "body") if functions_only else fits)


def span_key() -> Column:
    """Names a span within its commit."""
    return F.concat_ws("/", "module", "path", "kind", F.col("nth").cast("string"))


def problems(spans: DataFrame, order: DataFrame | None = None, used: DataFrame | None = None, max_chars: int = 6000, max_lines: int = 500) -> tuple[DataFrame, DataFrame]:
    """(problems, context) of COMMIT_SPANS.

    problems: (project, seq, uid, module, path, change, start, until, edit_lines, before, after, headers), one for each admissible span; edit_lines counts its lines and the
    place after them. context: (project, seq, uid, item, score, rank): for each problem the spans of its commit that come before it in
    the order of modules and lines, ranked; `used` (project, seq, uid, item) marks the ones it uses. Spans of one commit meet on (project, seq); that no commit is
    large is for the history's filter to see to.
    """
    rows = spans.where("kind != 'unparsed'").withColumn("uid", span_key())
    rows = rows.join(order, ["project", "module"], "left").withColumn("place", F.coalesce("place", F.lit(0))) if order is not None else rows.withColumn("place", F.lit(0))
    # place in the commit: modules in order, then lines
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("project", "seq").orderBy("place", "module", "start", "uid")))
    out = admissible(rows, max_chars, max_lines)
    t = out.select("project", "seq", "uid", F.col("module").alias("t_module"), F.col("start").alias("t_start"), F.col("until").alias("t_until"), F.col("at").alias("t_at"))
    i = rows.select("project", "seq", F.col("uid").alias("item"), "module", "start", "until", "at", (F.length(F.coalesce("before", F.lit(""))) + F.length(F.coalesce("after", F.lit("")))).alias("length"))
    pairs = t.join(i, ["project", "seq"]).where("at < t_at")
    if used is not None:
        pairs = pairs.join(used.select("project", "seq", "uid", "item", F.lit(True).alias("used")), ["project", "seq", "uid", "item"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    else:
        pairs = pairs.withColumn("used", F.lit(False))
    pairs = pairs.select(F.struct("project", "seq", "uid").alias("target"), "item", (F.col("module") == F.col("t_module")).alias("same_module"), "start", "until", "t_start", "t_until", "used", "length", F.col("at").alias("seq"))
    context = ranked_context(pairs).select("target.*", "item", "score", "rank")
    edit = (count_lines(F.regexp_replace("before", "\n$", "")) + 1).alias("edit_lines")
    return out.select("project", "seq", "uid", "module", "path", "change", "start", "until", edit, "before", "after", "headers"), context


def change_tokens(change: Column, before: Column, after: Column) -> Column:
    """Inline diff tokens of a change; only modified texts are diffed in Python."""
    return K.encode_diff(K.diff_of(change, before, after, F.transform(diff_rows(before, after), lambda d: F.concat(F.left(d, F.lit(1)), F.substring(d, 3, 1 << 30)))))


TOKEN_LIMITS = {"query": 512, "output": 256, "scope": 128, "ref": 512, "refs": 8192, "overlap": 32}


def tokenized(found: DataFrame, context: DataFrame, spans: DataFrame, limits: dict[str, int] = TOKEN_LIMITS) -> DataFrame:
    """(project, seq, uid, header, input, output, references, truncated) of problems and their context.

    Headers lose their left end, input and output their right one. References are chunks of the context's inline diffs, each led by its place in the ranking's order,
    taken by rank until their tokens exceed `refs`; truncated tells whether some were left out or the input was cut.
    """
    key = ["project", "seq", "uid"]
    io = K.input_output(F.col("tokens"))
    trimmed = lambda c: F.regexp_replace(c, "\n$", "")
    head = K.header_tokens(F.transform("headers", lambda h: K.encode(F.regexp_replace(h, "\n$", ""))), F.col("start") - 1, limits["scope"])
    main = found.withColumn("tokens", change_tokens(F.col("change"), trimmed("before"), trimmed("after"))).select(*key, head.alias("header"), io.alias("io"))
    main = main.select(*key, "header", K.truncated(F.col("io.input"), F.lit(limits["query"])).alias("input"), (F.size("io.input") > limits["query"]).alias("cut"), K.truncated(F.col("io.output"), F.lit(limits["output"])).alias("output"))
    texts = spans.where("kind != 'unparsed'").select("project", "seq", span_key().alias("item"), "path", change_tokens(F.col("change"), trimmed(F.coalesce("before", F.lit(""))), trimmed(F.coalesce("after", F.lit("")))).alias("tokens"))
    chunks = texts.select("project", "seq", "item", F.posexplode(K.chunks_with_header(F.col("tokens"), lambda k: F.array(F.lit("#"), k.cast("string"), F.lit(K.NL)), 3, limits["ref"], limits["overlap"])).alias("k", "chunk"))
    refs = context.join(chunks, ["project", "seq", "item"]).withColumn("total", F.sum(F.size("chunk")).over(Window.partitionBy(*key).orderBy("rank", "k")))
    kept = refs.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("total") <= limits["refs"], F.struct("rank", "k", "item", "chunk")))), lambda r: F.struct(r["item"].alias("name"), r["chunk"].alias("tokens"))).alias("references"), (F.max("total") > limits["refs"]).alias("over"))
    none = F.array().cast("array<struct<name:string,tokens:array<string>>>")
    return main.join(kept, key, "left").select(*key, "header", "input", "output", F.coalesce("references", none).alias("references"), (F.col("cut") | F.coalesce("over", F.lit(False))).alias("truncated"))


def problem_stats(tokenized_problems: DataFrame) -> DataFrame:
    """(name, mean, median, least, most) of the sizes of token problems."""
    sizes = {"input": F.size("input"), "output": F.size("output"), "header": F.size("header"), "references": F.size("references"), "reference_tokens": F.aggregate("references", F.lit(0), lambda n, r: n + F.size(r["tokens"]))}
    rows = tokenized_problems.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("long").alias("n")) for k, v in sizes.items()))).alias("s")).select("s.*")
    return rows.groupBy("name").agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))


def negatives(spans: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A share of the unchanged spans (before = after), by hash; changed ones all stay."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "project", "seq", span_key()), F.lit(1_000_003))
    return spans.where((~F.col("before").eqNullSafe(F.col("after"))) | (draw < share * 1_000_003))


def current_side(spans: DataFrame) -> DataFrame:
    """Spans as they are now: the later text as unchanged, deleted ones left out."""
    return spans.where("change != 'D'").withColumns({"change": F.lit("M"), "before": F.col("after")})


def completion_contexts(lines: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(id, line, left, text, right): fill-in problems: the text before and after each target line, at most `most` characters on either side, nearest first.

    targets (id, line, text): the line's own text is what is to be filled in. A text is gathered once, whatever its number of targets.
    """
    text = F.array_sort(F.collect_list(F.struct("line", "text")))
    whole = lines.groupBy("id").agg(F.transform(text, lambda x: x["text"]).alias("all"))
    rows = targets.join(whole, "id")
    left = F.array_join(F.transform(F.slice("all", 1, F.col("line").cast("int")), lambda x: F.concat(x, F.lit("\n"))), "")
    right = F.array_join(F.transform(F.slice("all", F.col("line").cast("int") + 2, F.size("all")), lambda x: F.concat(F.lit("\n"), x)), "")
    return rows.select("id", "line", F.right(left, F.lit(most)).alias("left"), "text", F.left(right, F.lit(most)).alias("right"))
