"""The line-delta algebra in long form.

Texts are rows (id, line, text), lines numbered from 0. A delta is rows (id, line, act, op, text): at a line, adds
(op '+') in the order of act, then at most one delete (op '-', the last act). Adds come before the line; adds at
the number of lines come at the end. Diff rows are (id, line, act, tag, text): tag ' ', '+' or '-', in the order of (line, act).
Everything but point joins happens on one partitioning by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE = 1 << 30
KEY = ("id", "line", "act")


def _by(*order: str) -> Window:
    return Window.partitionBy("id").orderBy(*order)


def apply_to_change(lines: DataFrame, delta: DataFrame) -> DataFrame:
    """Diff rows: deleted lines stay, marked '-'; adds are marked '+'."""
    base = lines.select("id", "line", F.lit(BASE).alias("act"), F.lit(" ").alias("op"), "text")
    rows = base.unionByName(delta.select("id", "line", "act", "op", "text")).repartition("id")
    gone = F.max(F.col("op") == "-").over(Window.partitionBy("id", "line"))
    return rows.withColumn("gone", gone).where("op != '-'").select("id", "line", "act", F.when(F.col("op") == "+", "+").when(F.col("gone"), "-").otherwise(" ").alias("tag"), "text")


def apply_to_input(lines: DataFrame, delta: DataFrame) -> DataFrame:
    """(id, pos, text): the text after the delta, deleted lines left out."""
    kept = apply_to_change(lines, delta).where("tag != '-'")
    return kept.select("id", (F.row_number().over(_by("line", "act")) - 1).alias("pos"), "text")


def positions(diff: DataFrame) -> DataFrame:
    """Diff rows with their place `pos` in the inline diff."""
    return diff.withColumn("pos", F.row_number().over(_by("line", "act")) - 1)


def delta_of_diff(diff: DataFrame) -> DataFrame:
    """The delta of inline diff rows (id, pos, tag, text): the inverse of apply_to_change."""
    before = F.coalesce(F.sum(F.when(F.col("tag") != "+", 1).otherwise(0)).over(_by("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    changed = diff.withColumn("line", before).where("tag != ' '")
    act = F.row_number().over(Window.partitionBy("id", "line").orderBy("pos")) - 1
    return changed.select("id", "line", act.alias("act"), F.col("tag").alias("op"), F.when(F.col("tag") == "-", "").otherwise(F.col("text")).alias("text"))


def restricted(delta: DataFrame, start: int, until: int) -> DataFrame:
    return delta.where((F.col("line") >= start) & (F.col("line") < until))


def shifted(delta: DataFrame, lines: int) -> DataFrame:
    return delta.withColumn("line", F.col("line") + lines)


def for_keys(delta: DataFrame, keys: DataFrame) -> DataFrame:
    return delta.join(keys.select(*KEY), list(KEY), "left_semi")


def change_groups(delta: DataFrame) -> DataFrame:
    """delta with grp: an add and the delete of its line, or a run of deletes of neighbouring lines, or one action."""
    by = _by("line", "act")
    gap = F.col("line") - F.lag("line").over(by)
    rows = delta.withColumn("paired", F.coalesce((F.col("op") == "-") & (F.lag("op").over(by) == "+") & (gap == 0), F.lit(False)))
    rows = rows.withColumn("solo", (F.col("op") == "-") & ~F.col("paired"))
    goes_on = F.col("paired") | F.coalesce(F.col("solo") & F.lag("solo").over(by) & gap.between(0, 1), F.lit(False))
    rows = rows.withColumn("new", F.when(goes_on, 0).otherwise(1))
    return rows.withColumn("grp", F.sum("new").over(by)).drop("paired", "solo", "new")


def _before(value) -> F.Column:
    return F.coalesce(F.sum(value).over(_by("line", "act").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def decompose_for_input(delta: DataFrame) -> DataFrame:
    """delta (with a boolean `first`) with new_line: the lines of the rest once the first part is applied to the input."""
    moved = _before(F.when(F.col("first"), F.when(F.col("op") == "+", 1).otherwise(-1)).otherwise(0))
    return delta.withColumn("new_line", F.when(F.col("first"), F.col("line")).otherwise(F.col("line") + moved))


def decompose_for_change(delta: DataFrame) -> DataFrame:
    """As decompose_for_input, for the inline diff: deletes do not shift, but rest adds pass over the run of first deletes below them."""
    adds = _before(F.when(F.col("first") & (F.col("op") == "+"), 1).otherwise(0))
    first_add = F.max(F.col("first") & (F.col("op") == "+")).over(Window.partitionBy("id", "line"))
    # adds above a first add of their own line stay with it
    last_add = F.max(F.when(F.col("first") & (F.col("op") == "+"), F.col("act"))).over(Window.partitionBy("id", "line"))
    rows = delta.withColumns({"_adds": adds, "_add_here": first_add, "_free": F.coalesce(F.col("act") > last_add, F.lit(True))})
    # a run: lines whose delete is in the first part, one after another, cut before lines with a first add
    dels = rows.where("first AND op = '-'").select("id", "line", "_add_here")
    new = F.when((F.col("line") == F.lag("line").over(_by("line")) + 1) & ~F.col("_add_here"), 0).otherwise(1)
    dels = dels.withColumn("_new", new).withColumn("_run", F.sum("_new").over(_by("line")))
    ends = dels.withColumn("_end", F.max("line").over(Window.partitionBy("id", "_run"))).select("id", "line", (F.col("_end") - F.col("line") + 1).alias("_ride"))
    out = rows.join(ends, ["id", "line"], "left")
    return out.withColumn("new_line", F.when(F.col("first"), F.col("line")).otherwise(F.col("line") + F.col("_adds") + F.when(F.col("_free"), F.coalesce("_ride", F.lit(0))).otherwise(0))).drop("_adds", "_add_here", "_free", "_ride")


def new_line_ids(lines: DataFrame, delta: DataFrame, edited: F.Column) -> DataFrame:
    """(id, line, new_id): where edited lines and what is inserted before them lie in the inline diff."""
    return positions(apply_to_change(lines, delta)).where((F.col("tag") != "-") & edited).select("id", "line", F.col("pos").alias("new_id"))


def source_lines(lines: DataFrame, delta: DataFrame) -> DataFrame:
    """(id, diff_line, source_line): lines of the inline diff as lines of the text after it."""
    kept = positions(apply_to_change(lines, delta)).where("tag != '-'")
    return kept.select("id", F.col("pos").alias("diff_line"), (F.row_number().over(_by("pos")) - 1).alias("source_line"))


def sizes(delta: DataFrame) -> DataFrame:
    """(id, n_actions, n_chars)"""
    return delta.groupBy("id").agg(F.count(F.lit(1)).alias("n_actions"), F.sum(F.length("text") + 1).alias("n_chars"))


def compressed(diff: DataFrame, context: int = 2) -> DataFrame:
    """(id, pos, text): diff rows (id, pos, tag, text) near a change; each omitted run is one row of dots at its first place."""
    near = F.max(F.col("tag") != " ").over(_by("pos").rowsBetween(-context, context))
    rows = diff.withColumn("near", near)
    first = F.coalesce(F.lag("near").over(_by("pos")), F.lit(True))
    return rows.withColumn("opens", first).where("near OR opens").select("id", "pos", F.when(F.col("near"), F.concat("tag", "text")).otherwise("...").alias("text"))


def accepted_groups(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(id, grp, n, accepted): change groups of the gold delta that the prediction has whole."""
    other = predicted.select(*KEY, F.col("op").alias("_op"), F.col("text").alias("_text"))
    both = change_groups(gold).join(other, list(KEY), "left")
    same = (F.col("op").eqNullSafe(F.col("_op"))) & (F.col("text").eqNullSafe(F.col("_text")))
    return both.groupBy("id", "grp").agg(F.count(F.lit(1)).alias("n"), F.bool_and(same).alias("accepted"))


def completion_targets(delta: DataFrame, least: int = 6) -> DataFrame:
    """(id, line, text): the last change group's add, where the group has at most two actions and is led by an add of some length."""
    by = Window.partitionBy("id")
    rows = change_groups(delta).withColumn("last", F.max("grp").over(by)).where("grp = last").withColumn("n", F.count(F.lit(1)).over(by))
    return rows.where((F.col("n") <= 2) & (F.col("op") == "+") & (F.length("text") >= least)).select("id", "line", "text")


def windows(lines: DataFrame, delta: DataFrame, size: int = 30, most: int = 4, empty: bool = True) -> DataFrame:
    """(id, start, until, n_changes): windows of edit lines, the first `most` of each text; without `empty` those with a change only.

    The last edit line is the one after the text, where lines are appended; windows are cut from line 0 on.
    """
    cut = (F.floor(F.col("line") / size) * size).cast("long")
    count = lines.groupBy("id").agg((F.max("line") + 2).cast("long").alias("n"))
    spans = count.select("id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) DIV {size}").cast("int"))).alias("w"))
    spans = spans.select("id", (F.col("w") * size).cast("long").alias("start"), F.least((F.col("w") + 1) * size, F.col("n")).cast("long").alias("until"))
    changes = delta.groupBy("id", cut.alias("start")).agg(F.count(F.lit(1)).alias("n_changes"))
    both = spans.join(changes, ["id", "start"], "left" if empty else "inner").withColumn("n_changes", F.coalesce("n_changes", F.lit(0)))
    return both.withColumn("nth", F.row_number().over(_by("start"))).where(F.col("nth") <= most).drop("nth")


def inlined_windows(lines: DataFrame, delta: DataFrame, size: int = 30, most: int = 4, ratio: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows after some change groups were put into the text: (new inline diff lines, rest delta, windows with the most groups).

    Of a text with two groups at least, each group is put in with a probability of ratio times the square of a draw of the text; draws are hashes of (seed, id, group).
    Windows hold the lines of `size` lines of the old text, at their places in the new one: (id, start, line_ids, n_groups); ties go to the first.
    """
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / (1 << 30)
    groups = change_groups(delta)
    last = F.max("grp").over(Window.partitionBy("id"))
    marked = groups.withColumn("first", (last >= 2) & (draw(F.col("id"), F.col("grp")) <= ratio * F.pow(draw(F.col("id"), F.lit(-1)), F.lit(2.0))))
    moved = decompose_for_change(marked)
    first = moved.where("first").select("id", "line", "act", "op", "text")
    act = F.row_number().over(Window.partitionBy("id", "new_line").orderBy("line", "act")) - 1
    rest = moved.where("NOT first").withColumn("act", act).select("id", F.col("new_line").alias("line"), "act", "op", "text")
    new = positions(apply_to_change(lines, first)).select("id", F.col("pos").alias("line"), "tag", "text", F.col("line").alias("was"))
    kept = new.where("tag != '-' AND tag != '+'").select("id", "was", "line")
    # the place after the text belongs to the last window
    tail = new.groupBy("id").agg((F.max("was") + 1).alias("was"), (F.max("line") + 1).alias("line"))
    members = kept.unionByName(tail).withColumn("start", (F.floor(F.col("was") / size) * size).cast("long"))
    spans = members.groupBy("id", "start").agg(F.sort_array(F.collect_list("line")).alias("line_ids"))
    hits = change_groups(rest).join(members.select("id", "start", "line"), ["id", "line"]).groupBy("id", "start").agg(F.countDistinct("grp").alias("n_groups"))
    out = spans.join(hits, ["id", "start"], "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n_groups"), "start"))).where(F.col("nth") <= most).drop("nth")
    return new.drop("was"), rest, out


def completions(lines: DataFrame, delta: DataFrame, least: int = 6, additions: bool = True, modifications: bool = True) -> tuple[DataFrame, DataFrame]:
    """Completion problems: (context: inline diff rows (id, pos, tag, text); targets: (id, line, text, kind)).

    The target is the last change group's add, of a group of at most two actions that is led by an add of `least` characters; kind is 'add', or 'mod' where a
    delete follows. All changes before it, and that delete, are applied to the context; line is the target's place in the context.
    """
    rows = change_groups(delta)
    top = rows.withColumn("last", F.max("grp").over(Window.partitionBy("id"))).where("grp = last")
    group = top.groupBy("id", "grp").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("line", "act", "op", "text"), F.struct("line", "act")).alias("head"), F.max_by("op", F.struct("line", "act")).alias("end"))
    ok = F.lit(False)
    if additions:
        ok |= F.col("end") == "+"
    if modifications:
        ok |= F.col("end") == "-"
    good = group.where((F.col("n") <= 2) & (F.col("head.op") == "+") & ok & (F.length("head.text") >= least)).select("id", F.col("grp").alias("last"), "end")
    mine = rows.join(good, "id").withColumn("first", (F.col("grp") < F.col("last")) | ((F.col("grp") == F.col("last")) & (F.col("op") == "-")))
    moved = decompose_for_change(mine.select("id", "line", "act", "op", "text", "grp", "first", "end"))
    first = moved.where("first").select("id", "line", "act", "op", "text")
    context = positions(apply_to_change(lines.join(good.select("id"), "id", "left_semi"), first)).select("id", "pos", "tag", "text")
    target = moved.where("NOT first").withColumn("nth", F.row_number().over(_by("line", "act"))).where("nth = 1")
    return context, target.select("id", F.col("new_line").alias("line"), "text", F.when(F.col("end") == "+", "add").otherwise("mod").alias("kind"))
