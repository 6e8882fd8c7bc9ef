"""Version histories: reading a repository with git, storing versions as partitioned Parquet."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "project string, seq long, id string, parents array<string>, time timestamp, message string"
VERSIONS = "project string, path string, seq long, content string"


def _git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def commits(spark: SparkSession, folders: list[str], most: int = 1000) -> DataFrame:
    """COMMITS of each repository from its head back, at a merge along the last parent; oldest first, at most the oldest `most`.

    One task a repository; a folder that git cannot read gives no rows.
    """

    def run(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in lots:
            for folder in lot["folder"]:
                try:
                    log = _git(folder, "log", "--format=%H%x1f%P%x1f%ct%x1f%s%x1e")
                except (OSError, subprocess.CalledProcessError):
                    continue
                every = [r.strip("\n").split("\x1f") for r in log.split("\x1e") if r.strip()]
                known, rows, at = {r[0]: r for r in every}, [], every[0][0] if every else None
                while at in known:
                    rows.append(known[at])
                    at = known[at][1].split()[-1] if known[at][1] else None
                rows = rows[::-1][:most]
                yield pd.DataFrame({"project": folder, "seq": range(len(rows)), "id": [r[0] for r in rows], "parents": [r[1].split() for r in rows], "time": [pd.Timestamp(int(r[2]), unit="s") for r in rows], "message": [r[3] for r in rows]})

    return spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders))).mapInPandas(run, COMMITS)


def file_versions(found: DataFrame, suffix: str = ".py") -> DataFrame:
    """VERSIONS of the files that each commit (COMMITS) touched against its last parent; null content where it deleted one.

    A file that git cannot show (a submodule, a broken object) gives no row.
    """

    def run(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in lots:
            out = []
            for folder, seq, commit, parents in lot[["project", "seq", "id", "parents"]].itertuples(index=False):
                sides = [parents[-1], commit] if len(parents) else ["--root", commit]
                names = _git(folder, "diff-tree", "-r", "-z", "--no-commit-id", "--name-status", "--no-renames", *sides).split("\0")
                for status, path in zip(names[::2], names[1::2]):
                    if path.endswith(suffix):
                        try:
                            out.append((folder, path, seq, None if status == "D" else _git(folder, "show", f"{commit}:{path}")))
                        except subprocess.CalledProcessError:
                            continue
            yield pd.DataFrame(out, columns=["project", "path", "seq", "content"])

    return found.mapInPandas(run, VERSIONS)


def save(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, one folder for each value of `by`, rows of a value gathered first so that files stay few."""
    (df.repartition(*by) if by else df).write.mode("overwrite").partitionBy(*by).parquet(path)


def load(spark: SparkSession, path: str, **where: str) -> DataFrame:
    """What save wrote; conditions on partition columns prune folders."""
    df = spark.read.parquet(path)
    for column, value in where.items():
        df = df.where(F.col(column) == value)
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; lines that do not parse give nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
