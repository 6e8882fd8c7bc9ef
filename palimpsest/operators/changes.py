"""Versions of texts, paired into changes.

A change is a row (kind, before, after): 'A' added, 'D' deleted, 'M' modified. Inputs are version rows
(project, path, seq, content); a null content is a deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_lines


def version_pairs(versions: DataFrame) -> DataFrame:
    """Each version with the one before it: one shuffle, on (project, path)."""
    by = Window.partitionBy("project", "path").orderBy("seq")
    return versions.withColumn("before", F.lag("content").over(by)).withColumnRenamed("content", "after")


def kind(before: Column, after: Column) -> Column:
    return F.when(before.isNull() & after.isNull(), None).when(before.isNull(), "A").when(after.isNull(), "D").otherwise("M")


def version_changes(versions: DataFrame) -> DataFrame:
    """(project, path, seq, kind, before, after, unchanged)"""
    pairs = version_pairs(versions).withColumn("kind", kind(F.col("before"), F.col("after"))).where("kind IS NOT NULL")
    return pairs.select("project", "path", "seq", "kind", "before", "after", F.col("before").eqNullSafe(F.col("after")).alias("unchanged"))


def inverse(changes: DataFrame) -> DataFrame:
    """The change back: added and deleted trade places."""
    turned = F.when(F.col("kind") == "A", "D").when(F.col("kind") == "D", "A").otherwise(F.col("kind"))
    return changes.withColumns({"kind": turned, "before": F.col("after"), "after": F.col("before")})


def with_views(changes: DataFrame) -> DataFrame:
    """Adds earlier and later: the side that exists, before first or after first."""
    return changes.withColumns({"earlier": F.coalesce("before", "after"), "later": F.coalesce("after", "before")})


def named_changes(old: DataFrame, new: DataFrame, name: list[str]) -> DataFrame:
    """(name..., kind, before, after) of two relations (name..., value): one full outer join."""
    a, b = old.withColumnRenamed("value", "before").withColumn("_a", F.lit(1)), new.withColumnRenamed("value", "after").withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "A").when(F.col("_b").isNull(), "D").otherwise("M")
    return a.join(b, name, "full_outer").select(*name, side.alias("kind"), "before", "after")


def admitted(changes: DataFrame, max_chars: int = 6000, max_lines: int = 500) -> DataFrame:
    """Modified texts of which neither side is too large."""
    fits = F.lit(True)
    for c in ("before", "after"):
        fits &= (F.length(c) <= max_chars) & (count_lines(F.col(c)) <= max_lines)
    return changes.where((F.col("kind") == "M") & fits)


def earlier_changes(changes: DataFrame) -> DataFrame:
    """Each change with the seqs of the project's earlier ones, newest first."""
    by = Window.partitionBy("project").orderBy("seq", "path").rowsBetween(Window.unboundedPreceding, -1)
    return changes.withColumn("earlier", F.reverse(F.collect_list("seq").over(by)))
