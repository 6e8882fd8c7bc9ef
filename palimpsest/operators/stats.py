"""Aggregations: descriptive statistics, grouped accuracy, gains, bootstrap, marginalised predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_div


def scalar_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, exact median, min, max and count of a column by group."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"))


def weighted_mean(df: DataFrame, by: list[str], value: Column, weight: Column) -> DataFrame:
    """Sum over weight, NaN where there is no weight; partial sums merge on the map side."""
    return df.groupBy(*by).agg(F.sum(value).alias("total"), F.sum(weight).alias("weight")).withColumn("mean", safe_div(F.col("total"), F.col("weight")))


def grouped_accuracy(df: DataFrame, key: str, correct: Column) -> DataFrame:
    """(key, n_correct, n_total, accuracy), and a row of null key for all: one pass with a rollup."""
    return df.rollup(key).agg(F.sum(correct.cast("int")).alias("n_correct"), F.count(F.lit(1)).alias("n_total")).withColumn("accuracy", safe_div(F.col("n_correct").cast("double"), F.col("n_total").cast("double")))


def recall_by_label(df: DataFrame, predicted: str, truth: str, top_k: int) -> DataFrame:
    """(label, n, recall) of the most frequent labels; ties by label."""
    rows = df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("label"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(predicted).eqNullSafe(F.col(truth))).cast("double")).alias("recall"))
    return found.orderBy(F.desc("n"), "label").limit(top_k)


def running_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n, running): distinct values and how many rows are at most that large.

    The global running sum is over distinct values only, ordered after the counting.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("running", F.sum("n").over(Window.orderBy(value)))


def running_mean(df: DataFrame, by: str, order: list[str], value: str, scale: int | None = None) -> DataFrame:
    """scale: decimal places of the values, where they are decimal; their sums are then exact."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value) if scale is None else F.col(value).cast(f"decimal(28,{scale})")
    return df.withColumn("running_mean", F.sum(v).over(w).cast("double") / F.count(v).over(w))


def moving_average(values: Column, alpha: float) -> Column:
    """Exponential average of an ordered array; the first value starts it."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda m, x: m * (1 - alpha) + x * alpha)


def gain_ratios(df: DataFrame, by: list[str]) -> DataFrame:
    """Sums of gains over the sum of label gains, by group."""
    sums = df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("label_gain", "first_gain", "total_gain")), F.avg("rounds").alias("rounds"))
    return sums.select(*by, "label_gain", safe_div(F.col("first_gain"), F.col("label_gain")).alias("first_ratio"), safe_div(F.col("total_gain"), F.col("label_gain")).alias("total_ratio"), "rounds")


def marginalized(df: DataFrame, by: list[str], norm: Column, weight: Column, score: Column, member: str) -> DataFrame:
    """Samples grouped by their normal form, ranked by weight, then best score, then form; the best-scored member stands for a group."""
    named = df.withColumns({"form": norm, "_w": weight, "_s": score})
    groups = named.groupBy(*by, "form").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("_w").alias("weight"), F.max("_s").alias("score"), F.max_by(member, F.struct("_s", -F.col(member))).alias("member"))
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), F.desc("score"), "form")))


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit words whose bits depend on all bits of the given ones."""
    for k in (0xD6E8FEB86659FD93, 0xCF5B2E3A1D9C8B47):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(k)
    return h ^ (h >> np.uint64(29))


def resampled_means(df: DataFrame, value: str, rounds: int, seed: int) -> DataFrame:
    """(b, mean): means of Poisson resamples, summed in the scan: the weight of row r in round b depends on (seed, row key, b) only, by a hash.

    df: (key, value). Each task returns a row a round, so what is shuffled does not grow with the rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(rounds), np.zeros(rounds)
        steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
        marks = _mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for lot in batches:
            keys, values = lot.iloc[:, 0].to_numpy(np.int64).view(np.uint64), lot.iloc[:, 1].to_numpy(float)
            for i in range(0, len(keys), 256):
                # one hash for each (row, round), turned to a Poisson(1) draw by the distribution's steps
                w = np.searchsorted(steps, _mixed(_mixed(keys[i : i + 256, None] + np.uint64(seed)) ^ marks[None]) / 2.0**64, "right")
                total += values[i : i + 256] @ w
                weight += w.sum(axis=0)
        yield pd.DataFrame({"b": np.arange(rounds), "t": total, "w": weight})

    sums = df.where(F.col(value).isNotNull()).select("key", F.col(value).cast("double")).mapInPandas(run, "b int, t double, w double")
    return sums.groupBy("b").agg(F.sum("t").alias("t"), F.sum("w").alias("w")).where("w > 0").select("b", (F.col("t") / F.col("w")).alias("mean"))


def bootstrap_interval(df: DataFrame, value: str, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """(low, high): the 95 % interval of the mean."""
    means = resampled_means(df, value, rounds, seed)
    return means.agg(F.sort_array(F.collect_list("mean")).alias("m")).select(F.element_at("m", int(0.025 * rounds) + 1).alias("low"), F.element_at("m", int(0.975 * rounds) + 1).alias("high"))


def bootstrap_compare(df: DataFrame, this: str, that: str, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """(p): the share of paired resamples in which the mean of `this` is at least that of `that`."""
    gap = df.select("key", (F.col(this).cast("double") - F.col(that).cast("double")).alias("gap"))
    return resampled_means(gap, "gap", rounds, seed).agg(F.avg((F.col("mean") >= 0).cast("double")).alias("p"))
