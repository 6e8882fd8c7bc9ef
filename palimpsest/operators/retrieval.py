"""Lookups of context: spans by point, modules by prefix, ranking, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.tokens import segments


def spans_at(points: DataFrame, spans: DataFrame, stretch: int = 64) -> DataFrame:
    """points (id, line) with the span (start, until) of the same id that holds them, the narrowest first.

    An equi-join on (id, stretch of lines): spans are listed under every stretch they touch.
    """
    reach = spans.select("id", "start", "until", F.explode(F.sequence(F.expr(f"start DIV {stretch}"), F.expr(f"(until - 1) DIV {stretch}"))).alias("_s"))
    found = points.withColumn("_s", F.expr(f"line DIV {stretch}")).join(reach, ["id", "_s"]).where("line >= start AND line < until")
    best = F.min_by(F.struct("start", "until"), F.struct(F.col("until") - F.col("start"), "start")).alias("_b")
    return found.groupBy("id", "line").agg(best).select("id", "line", "_b.start", "_b.until")


def longest_module(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module, rest): the longest module that is a proper dotted prefix of the path; modules: (module)."""
    segs = F.split("path", r"\.")
    prefixes = paths.select("path", F.explode(F.sequence(F.lit(1), F.greatest(F.size(segs) - 1, F.lit(1)))).alias("k")).withColumn("module", F.array_join(F.slice(F.split("path", r"\."), 1, F.col("k")), "."))
    hits = prefixes.where(F.col("module") != F.col("path")).join(modules.select("module").distinct(), "module")
    best = hits.groupBy("path").agg(F.max_by("module", "k").alias("module"))
    return best.withColumn("rest", F.expr("substring(path, length(module) + 2)"))


def ranked_context(pairs: DataFrame) -> DataFrame:
    """Context of each target by score: distance (at most 1000, that of other modules), less 2000 if used, plus length; ties newest first.

    The distance is the lesser one of opposite ends, whatever their order, so spans that overlap are as far apart as those ends.

    pairs: (target, item, same_module, start, until, t_start, t_until, used, length, seq).
    """
    gap = F.least(F.abs(F.col("start") - F.col("t_until")), F.abs(F.col("t_start") - F.col("until")), F.lit(1000))
    score = F.when(F.col("same_module"), gap).otherwise(1000) - F.when(F.col("used"), 2000).otherwise(0) + F.col("length")
    scored = pairs.select("target", "item", score.cast("long").alias("score"), "seq")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("score", F.desc("seq"), "item"))).drop("seq")


def within_budget(df: DataFrame, by: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """The rows of each group until their sizes exceed the budget; the first row that does ends it."""
    return df.withColumn("used", F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def chunked(tokens: Column, size: int, overlap: int) -> Column:
    """Chunks of `size` tokens, each beginning `overlap` tokens before the last one's end."""
    step = size - overlap

    def cut(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + overlap < F.size(t)))
        return F.when(F.size(t) > 0, F.transform(starts, lambda s: F.slice(t, s + 1, size)))

    return let(tokens, cut)


def shares(total: int, sizes: list[Column]) -> list[Column]:
    """Room for each of several sections: equal shares, what short ones leave goes to the earlier others."""
    each = total // len(sizes)
    spare = F.lit(total)
    for s in sizes:
        spare = spare - F.least(s, F.lit(each))
    out = []
    for s in sizes:
        more = F.least(F.greatest(s - each, F.lit(0)), spare)
        out.append(F.least(s, F.lit(each)) + more)
        spare = spare - more
    return out


def output_segments(tokens: Column) -> Column:
    """Tokens after each mark `<n>` up to the next, as (mark, tokens); text before the first is lost, the last of equal marks counts."""
    return segments(tokens)
