"""Datasets: histories, signatures, duplicates, splits, samples, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(commits: DataFrame, most: int = 1000) -> DataFrame:
    """(project, id, depth): commits from the newest (depth 0) back, at most `most`; commits: (project, seq, id)."""
    by = Window.partitionBy("project").orderBy(F.desc("seq"), F.desc("id"))
    return commits.withColumn("depth", F.row_number().over(by) - 1).where(F.col("depth") < most).select("project", "id", "depth")


def signatures(messages: DataFrame, n: int = 30) -> DataFrame:
    """(project, signature): a project's first n messages in order; messages: (project, seq, message)."""
    by = Window.partitionBy("project").orderBy("seq")
    first = messages.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", "message"))), lambda x: x["message"])
    return first.groupBy("project").agg(F.md5(F.array_join(ordered, "\x1f")).alias("signature"))


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row of each group, and how many it stands for."""
    w = Window.partitionBy(*by)
    return df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("nth", F.row_number().over(w.orderBy(*order))).where("nth = 1").drop("nth")


def frequent(df: DataFrame, by: str, least: int) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def split_by_hash(df: DataFrame, key: Column, test: float = 0.05, valid: float = 0.05) -> DataFrame:
    """df with `split`, by a hash of the key alone: no sort, no shuffle, stable as the data grows."""
    slot = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(slot < test, "test").when(slot < test + valid, "valid").otherwise("train"))


def ranked_split(df: DataFrame, key: Column, test: int, valid: int) -> DataFrame:
    """df with `split` of exact sizes: the first rows by hash of the key are test, the next valid."""
    rank = F.row_number().over(Window.orderBy(F.md5(key.cast("string"))))
    return df.withColumn("rank", rank).withColumn("split", F.when(F.col("rank") <= test, "test").when(F.col("rank") <= test + valid, "valid").otherwise("train")).drop("rank")


def hashed_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """n rows by hash of the key."""
    return df.orderBy(F.md5(key.cast("string")), key).limit(n)


def batches(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """df with `batch`: consecutive lots of `size` rows of each group, the last one may be short."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))
