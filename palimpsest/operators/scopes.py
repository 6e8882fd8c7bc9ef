"""Python source as rows: statement spans of scopes, imports, line usages. Parsing is Arrow-batched; all else is relational."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import parsed

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
SPANS = "module string, path string, kind string, nth int, start int, until int, code string"


def _first(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def spans_of(code: str) -> list[tuple[str, str, int, int, int, str]]:
    """(path, kind, nth, start, until, code): headers, function bodies and runs of plain statements, lines from 1, half open."""
    try:
        tree = parsed(code)
    except SyntaxError:
        return []
    lines, out = code.split("\n"), []
    text = lambda a, b: "\n".join(lines[a - 1 : b - 1]).strip("\n") + "\n"

    def walk(path: str, body: list[ast.stmt], function: bool) -> None:
        if function:
            a, b = _first(body[0]), body[-1].end_lineno + 1
            out.append((path, "body", 0, a, b, text(a, b)))
            return
        nth, run = 0, []

        def close() -> None:
            nonlocal nth, run
            if run:
                a, b = run[0].lineno, run[-1].end_lineno + 1
                out.append((path, "statements", nth, a, b, text(a, b)))
                nth, run = nth + 1, []

        last = {n.name: n for n in body if isinstance(n, DEFS)}
        for node in body:
            if isinstance(node, DEFS):
                close()
                if last[node.name] is not node:
                    continue  # of equal names in a scope the last counts
                own = f"{path}.{node.name}" if path else node.name
                a, b = _first(node), _first(node.body[0])
                if a == b:
                    b = a + 1
                out.append((own, "header", 0, a, b, text(a, b)))
                walk(own, node.body, not isinstance(node, ast.ClassDef))
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                close()
            else:
                run.append(node)
        close()

    walk("", tree.body, False)
    return out


def spans(modules: DataFrame) -> DataFrame:
    """SPANS of modules (module, code)."""

    def run(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in lots:
            rows = [(m, *s) for m, c in lot.itertuples(index=False) if c for s in spans_of(c)]
            yield pd.DataFrame(rows, columns=["module", "path", "kind", "nth", "start", "until", "code"])

    return modules.select("module", "code").mapInPandas(run, SPANS)


def changed_spans(before: DataFrame, after: DataFrame) -> DataFrame:
    """(module, path, kind, nth, change, start, before, after): spans that differ, by scope and place; lines are those before the change."""
    key = ["module", "path", "kind", "nth"]
    a = before.select(*key, F.col("start").alias("a_start"), F.col("code").alias("before"))
    b = after.select(*key, F.col("start").alias("b_start"), F.col("code").alias("after"))
    both = a.join(b, key, "full_outer").where("NOT (before <=> after)")
    change = F.when(F.col("before").isNull(), "A").when(F.col("after").isNull(), "D").otherwise("M")
    return both.select(*key, change.alias("change"), F.coalesce("a_start", "b_start").alias("start"), "before", "after")


def imports_of(module: str, code: str) -> list[str]:
    try:
        tree = parsed(code)
    except SyntaxError:
        return []
    out = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            base = module.split(".")[: -node.level] if node.level else []
            name = ".".join([*base, *([node.module] if node.module else [])])
            out.add(name)
            out |= {f"{name}.{a.name}" if name else a.name for a in node.names}
    return sorted(x for x in out if x)


def imports(modules: DataFrame) -> DataFrame:
    """(src, dst): modules of the same project that a module imports."""

    @F.pandas_udf("array<string>")
    def found(module: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([imports_of(m, c or "") for m, c in zip(module, code)])

    pairs = modules.select(F.col("module").alias("src"), F.explode(found("module", "code")).alias("dst"))
    return pairs.join(modules.select(F.col("module").alias("dst")).distinct(), "dst", "left_semi").where("src != dst").select("src", "dst").distinct()


def module_order(edges: list[tuple[str, str]], modules: list[str]) -> list[str]:
    """Modules with what they import first; names in order, cycles tolerated. One project's graph, so a grouped function's size."""
    needs: dict[str, list[str]] = {m: [] for m in modules}
    for a, b in edges:
        if a in needs and b in needs:
            needs[a].append(b)
    out, seen = [], set()
    for root in sorted(modules):
        stack = [(root, iter(sorted(needs[root])))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            for m in rest:
                if m not in seen:
                    seen.add(m)
                    stack.append((m, iter(sorted(needs[m]))))
                    break
            else:
                out.append(node)
                stack.pop()
    return out


def usages_of(module: str, code: str) -> list[tuple[int, str]]:
    """(line, full name) of names that resolve to members of this module or to imports, by lexical scope."""
    try:
        tree = parsed(code)
    except SyntaxError:
        return []
    names: dict[str, str] = {}
    for node in tree.body:
        if isinstance(node, DEFS):
            names[node.name] = f"{module}.{node.name}"
        elif isinstance(node, ast.Assign):
            names |= {t.id: f"{module}.{t.id}" for t in node.targets if isinstance(t, ast.Name)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names |= {(a.asname or a.name.split(".")[0]): (a.name if a.asname else a.name.split(".")[0]) for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            base = ".".join([*(module.split(".")[: -node.level] if node.level else []), *([node.module] if node.module else [])])
            names |= {(a.asname or a.name): f"{base}.{a.name}" for a in node.names}
    found = set()

    def visit(node: ast.AST, owner: str | None, hidden: frozenset[str]) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = node.args
            hidden |= {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]}
        if isinstance(node, ast.ClassDef):
            owner = f"{module}.{node.name}"
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) and node.id in names and node.id not in hidden:
            found.add((node.lineno, names[node.id]))
        elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            if node.value.id == "self" and owner:
                found.add((node.lineno, f"{owner}.{node.attr}"))
            elif node.value.id in names and node.value.id not in hidden:
                found.add((node.lineno, f"{names[node.value.id]}.{node.attr}"))
        for child in ast.iter_child_nodes(node):
            visit(child, owner, hidden)

    visit(tree, None, frozenset())
    return sorted(found)


def usages(modules: DataFrame) -> DataFrame:
    """(module, line, name)"""

    def run(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in lots:
            yield pd.DataFrame([(m, *u) for m, c in lot.itertuples(index=False) if c for u in usages_of(m, c)], columns=["module", "line", "name"])

    return modules.select("module", "code").mapInPandas(run, "module string, line int, name string")


def usage_lookup(targets: DataFrame, used: DataFrame) -> DataFrame:
    """(target, name, line): definitions that the lines (target, module, start, until) use, each once with its first line; own ones left out."""
    hits = targets.join(used, "module").where("line >= start AND line < until")
    other = hits.where(~F.startswith("name", F.concat("module", F.lit("."))))
    return other.withColumn("nth", F.row_number().over(Window.partitionBy("target", "name").orderBy("line"))).where("nth = 1").select("target", "name", "line")
