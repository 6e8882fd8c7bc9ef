"""Scoring predicted edits: gains by cost model, exact matches, choices of edits, and the simulation of several rounds.

Deltas and lines have the long form of operators.delta. What happens within one text (a simulation's rounds) is a grouped function of that text;
all else is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import code_equal, keystroke_cost, text_keystrokes
from ..functions.distance import edit_distance
from ..functions.text import safe_div
from . import delta as D

Diff = list[tuple[str, str]]
#: line -> actions (op, text), adds first, then at most one delete
Edit = dict[int, list[tuple[str, str]]]
Key = tuple[int, int]


def touched_texts(lines: DataFrame, delta: DataFrame) -> DataFrame:
    """(id, before, after): the lines from the first to the last that a delta names, before and after it."""
    ends = delta.groupBy("id").agg(F.min("line").alias("_a"), F.max("line").alias("_b"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "act", c))), lambda x: x[c]), "\n")
    rows = D.apply_to_change(lines, delta).join(ends, "id").where("line BETWEEN _a AND _b")
    old = F.when(F.col("tag") != "+", F.col("text")).alias("old")
    new = F.when(F.col("tag") != "-", F.col("text")).alias("new")
    return rows.select("id", "line", "act", old, new).groupBy("id").agg(text("old").alias("before"), text("new").alias("after"))


def edit_gains(lines: DataFrame, delta: DataFrame) -> DataFrame:
    """(id, diff_lines, levenshtein, keystrokes): what a delta saves, by cost model; the last two over the lines that it touches."""
    sizes = delta.groupBy("id").agg(F.count(F.lit(1)).alias("diff_lines"))
    both = touched_texts(lines, delta).select("id", edit_distance("before", "after").alias("levenshtein"), keystroke_cost("before", "after").cast("long").alias("keystrokes"))
    return sizes.join(both, "id")


def exact_matches(lines: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(id, correct): whether a prediction gives the gold text, or code of the same syntax tree. A text without predicted actions is predicted unchanged."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    a = D.apply_to_input(lines, gold).groupBy("id").agg(text.alias("a"))
    b = D.apply_to_input(lines, predicted).groupBy("id").agg(text.alias("b"))
    both = lines.select("id").distinct().join(a, "id", "left").join(b, "id", "left").select("id", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))
    # only texts that differ are parsed
    same = both.where("a = b").select("id", F.lit(True).alias("correct"))
    return same.unionByName(both.where("a != b").select("id", code_equal(F.col("a"), F.col("b")).alias("correct")))


def group_costs(delta: DataFrame, cost: Column) -> DataFrame:
    """(id, grp, cost): the summed cost of the actions of each change group."""
    return D.change_groups(delta).groupBy("id", "grp").agg(F.sum(cost).alias("cost"))


def least_effort(delta: DataFrame, cost: Column) -> DataFrame:
    """(id, grp, cost): each text's cheapest change group, the first of equal ones."""
    return group_costs(delta, cost).groupBy("id").agg(F.min_by(F.struct("grp", "cost"), F.struct("cost", "grp")).alias("b")).select("id", "b.grp", "b.cost")


def most_uncertain(delta: DataFrame, loss: Column) -> DataFrame:
    """(id, grp, cost): each text's change group of the greatest summed loss, the first of equal ones."""
    return group_costs(delta, loss).groupBy("id").agg(F.min_by(F.struct("grp", "cost"), F.struct(-F.col("cost"), F.col("grp"))).alias("b")).select("id", "b.grp", "b.cost")


def output_ranges(lines: DataFrame, delta: DataFrame, size: Column) -> DataFrame:
    """(id, grp, start, stop): where the output of each change group lies in the sequence of all output, the sequence's start token counted.

    The output has a mark for each edit line and one for the line after the text, then that line's actions; `size` is an action's tokens, an
    added line has one more, its end. A group's range begins after the marks of its first line and of those before it.
    """
    ends = lines.groupBy("id").agg((F.max("line") + 1).alias("line"))
    marks = lines.select("id", "line").unionByName(ends).select("id", "line", F.lit(-1).alias("act"), F.lit(None).cast("long").alias("grp"), F.lit(1).cast("long").alias("n"))
    acts = D.change_groups(delta).select("id", "line", "act", "grp", (size + F.when(F.col("op") == "+", 1).otherwise(0)).cast("long").alias("n"))
    rows = marks.unionByName(acts).withColumn("stop", F.lit(1) + F.sum("n").over(Window.partitionBy("id").orderBy("line", "act")))
    return rows.where("grp IS NOT NULL").groupBy("id", "grp").agg(F.min(F.col("stop") - F.col("n")).alias("start"), F.max("stop").alias("stop"))


def groups_of(edit: Edit) -> list[list[Key]]:
    """Change groups of one edit: an add and the delete of its line, a run of deletes, or one action."""
    out: list[list[Key]] = []
    last: tuple[int, str, bool] | None = None
    for line in sorted(edit):
        for act, (op, _) in enumerate(edit[line]):
            paired = op == "-" and last is not None and last[0] == line and last[1] == "+"
            solo = op == "-" and not paired
            if paired or (solo and last is not None and last[2] and line - last[0] in (0, 1)):
                out[-1].append((line, act))
            else:
                out.append([(line, act)])
            last = (line, op, solo)
    return out


def part_of(edit: Edit, keys: set[Key], wanted: bool = True) -> Edit:
    some = {line: [a for k, a in enumerate(acts) if ((line, k) in keys) == wanted] for line, acts in edit.items()}
    return {line: acts for line, acts in some.items() if acts}


def put_in(diff: Diff, edit: Edit) -> Diff:
    """An edit applied to inline diff lines (tag, text)."""
    out: Diff = []
    for line in range(len(diff) + 1):
        acts = edit.get(line, [])
        out += [("+", text) for op, text in acts if op == "+"]
        if line < len(diff):
            out.append(("-", diff[line][1]) if any(op == "-" for op, _ in acts) else diff[line])
    return out


def rest_after(edit: Edit, keys: set[Key]) -> Edit:
    """The actions that are not in keys, at their places in the inline diff that those of keys make."""
    first = part_of(edit, keys)
    gone = {line for line, acts in first.items() if any(op == "-" for op, _ in acts)}
    adding = {line for line, acts in first.items() if any(op == "+" for op, _ in acts)}
    out: Edit = {}
    before = 0
    for line in sorted(edit):
        last_add = max((k for k, (op, _) in enumerate(edit[line]) if op == "+" and (line, k) in keys), default=-1)
        ride = 0
        if line in gone:
            end = line
            while end + 1 in gone and end + 1 not in adding:
                end += 1
            ride = end - line + 1
        for k, (op, text) in enumerate(edit[line]):
            if (line, k) in keys:
                before += op == "+"
            else:
                out.setdefault(line + before + (ride if k > last_add else 0), []).append((op, text))
    return out


MODELS = ("diff_lines", "keystrokes")


def gain_of(diff: Diff, edit: Edit, models: tuple[str, ...] = MODELS) -> dict[str, int]:
    """Gains of one edit of an inline diff, by cost model; only those asked for are computed."""
    if not edit:
        return dict.fromkeys(models, 0)
    return {model: (changed_count(edit) if model == "diff_lines" else typed_keys(diff, edit)) for model in models}


def changed_count(edit: Edit) -> int:
    return sum(map(len, edit.values()))


def typed_keys(diff: Diff, edit: Edit) -> int:
    """Keystrokes over the lines from the first to the last that the edit names."""
    a, b = min(edit), max(edit)
    part = diff[a : b + 1]
    old = "\n".join(t for tag, t in part if tag != "-")
    new = "\n".join(t for tag, t in put_in(part, {k - a: v for k, v in edit.items()}) if tag != "-")
    return text_keystrokes([(old, new)])[0]


def rounds_of(diff: Diff, edit: Edit, predict: Callable[[Diff, Edit], Edit], strategy: str, most: int, models: tuple[str, ...] = MODELS) -> dict[str, tuple[int, int, int, int]]:
    """(label, first, total gain, rounds) of one text, by each of the cost models.

    In each round the groups that the prediction has whole are accepted; where there are none, one group is made by hand and counts
    against the gain: the first, or that of the least keystrokes. What is left after the last round is made by hand too.
    """
    label = gain_of(diff, edit, models)
    gains, first, rounds = dict(label), dict.fromkeys(label, 0), 0
    while edit and rounds < most:
        rounds += 1
        guess = predict(diff, edit)
        right = [g for g in groups_of(guess) if all(line in edit and act < len(edit[line]) and edit[line][act] == guess[line][act] for line, act in g)]
        keys = {k for g in right for k in g}
        if not keys:
            groups = groups_of(edit)
            pick = groups[0] if strategy == "pick_first" else min(groups, key=lambda g: typed_keys(diff, part_of(edit, set(g))))
            keys = set(pick)
            for name, g in gain_of(diff, part_of(edit, keys), models).items():
                gains[name] -= g
        elif rounds == 1:
            first = gain_of(diff, part_of(edit, keys), models)
        diff, edit = put_in(diff, part_of(edit, keys)), rest_after(edit, keys)
    for name, g in gain_of(diff, edit, models).items():
        gains[name] -= g
    return {name: (label[name], first[name], gains[name], rounds) for name in label}


ROUNDS = "id long, model string, label_gain long, first_gain long, total_gain long, rounds int"


def multi_round(lines: DataFrame, delta: DataFrame, predict: Callable[[Diff, Edit], Edit], strategy: str = "pick_first", most: int = 6, models: tuple[str, ...] = MODELS) -> DataFrame:
    """ROUNDS: the simulated gains of every text with a delta, by each of the cost models. predict(inline diff, what is left) stands for the model.

    Lines and actions stream by sorted; a task holds one text and one Arrow batch.
    """
    if strategy not in ("pick_first", "least_effort"):
        raise ValueError("strategy must be pick_first or least_effort")
    if not models or set(models) - set(MODELS):
        raise ValueError(f"models must be some of {', '.join(MODELS)}")
    columns = ("id", "line", "act", "op", "text")
    base = lines.select("id", F.col("line").cast("long").alias("line"), F.lit(D.BASE).alias("act"), F.lit(None).cast("string").alias("op"), "text")
    acts = delta.select("id", F.col("line").cast("long").alias("line"), F.col("act").cast("int").alias("act"), "op", "text")
    rows = base.unionByName(acts).repartition("id").sortWithinPartitions("id", "line", "act")

    def run(lots: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for lot in lots for row in zip(*(lot.column(c).to_pylist() for c in columns)))
        out: list[tuple] = []
        for id_, group in groupby(stream, key=lambda r: r[0]):
            diff: Diff = []
            edit: Edit = {}
            for _, line, _, op, text in group:
                if op is None:
                    diff.append((" ", text))
                else:
                    edit.setdefault(line, []).append((op, text))
            if edit:
                out += [(id_, name, *v) for name, v in rounds_of(diff, edit, predict, strategy, most, models).items()]
            if len(out) >= 1000:
                yield rounds_batch(out)
                out = []
        if out:
            yield rounds_batch(out)

    return rows.mapInArrow(run, ROUNDS)


def rounds_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    names = [c.split()[0] for c in ROUNDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def strategy_report(results: DataFrame, by: list[str]) -> DataFrame:
    """Gain ratios and mean rounds of ROUNDS rows, by group."""
    sums = results.groupBy(*by).agg(F.sum("label_gain").alias("label_gain"), F.sum("first_gain").alias("first"), F.sum("total_gain").alias("total"), F.avg("rounds").alias("rounds"))
    return sums.select(*by, "label_gain", safe_div(F.col("first"), F.col("label_gain")).alias("first_ratio"), safe_div(F.col("total"), F.col("label_gain")).alias("total_ratio"), "rounds")


def ablation_report(scores: DataFrame, base: str) -> DataFrame:
    """(variant, n, accuracy, above): accuracy of each variant of scores (variant, key, correct) over the keys that all variants have, and how far it is above the base's."""
    variants = scores.select("variant").distinct().count()
    common = scores.groupBy("key").agg(F.countDistinct("variant").alias("v")).where(F.col("v") == variants).select("key")
    acc = scores.join(common, "key", "left_semi").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    # one row
    mine = acc.where(F.col("variant") == base).select(F.col("accuracy").alias("_base"))
    return acc.crossJoin(F.broadcast(mine)).select("variant", "n", "accuracy", (F.col("accuracy") - F.col("_base")).alias("above"))


def loss_metrics(df: DataFrame, by: list[str], loss: Column, tokens: Column, probability: Column) -> DataFrame:
    """(loss_per_token, loss_per_example, probability_per_example): weighted means of summed losses."""
    sums = df.groupBy(*by).agg(F.sum(loss).alias("_l"), F.sum(tokens).alias("_t"), F.count(F.lit(1)).alias("n"), F.sum(probability).alias("_p"))
    return sums.select(*by, "n", safe_div(F.col("_l"), F.col("_t")).alias("loss_per_token"), (F.col("_l") / F.col("n")).alias("loss_per_example"), (F.col("_p") / F.col("n")).alias("probability_per_example"))


def dynamic_batches(df: DataFrame, by: str, order: list[str], cost: Column, limit: float, most: int) -> DataFrame:
    """df with `batch`: within each group rows are batched in order, a batch ending before its cost would exceed the limit or its rows `most`.

    A row whose own cost exceeds the limit is a batch by itself. Rows stream by sorted; a task holds one Arrow batch, whatever its group's size.
    """
    rows = df.withColumn("_cost", cost.cast("double")).repartition(by).sortWithinPartitions(by, *order)
    names = df.columns

    def run(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, held, n = object(), 0, 0.0, 0
        for lot in lots:
            numbers = []
            for group, c in zip(lot[by], lot["_cost"]):
                if group != now:
                    now, batch, held, n = group, 0, 0.0, 0
                if n and (held + c > limit or n >= most):
                    batch, held, n = batch + 1, 0.0, 0
                held, n = held + c, n + 1
                numbers.append(batch)
            yield lot[names].assign(batch=numbers)

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "batch long"]))


def estimated_batches(n_rows: int, sampled: int, out_of_sample: int, size: int) -> int:
    """How many batches all rows will make, from how many problems a sample made; a little low, so that nobody waits for more."""
    return max(1, int(n_rows / max(1, sampled) * max(1, out_of_sample // size) * 0.99))


def packed(df: DataFrame, batch: list[str], query: str, references: str, labels: str) -> DataFrame:
    """(batch..., queries, references, reference_lists, labels): references of a batch listed once each, and for each query their places in that list.

    Rows of a batch are ordered by query; a batch is of bounded size by its making.
    """
    rows = df.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct(F.col(query).alias("q"), F.col(references).alias("r"), F.col(labels).alias("l")))).alias("x"))
    rows = rows.withColumn("references", F.array_distinct(F.flatten(F.transform("x", lambda e: e["r"]))))
    lists = F.transform("x", lambda e: F.transform(e["r"], lambda r: (F.array_position(F.col("references"), r) - 1).cast("int")))
    return rows.select(*batch, F.transform("x", lambda e: e["q"]).alias("queries"), "references", lists.alias("reference_lists"), F.transform("x", lambda e: e["l"]).alias("labels"))
