"""Line dedup (operator 10): a suffix array over line-ID sequences, built by prefix doubling.

Every document is the sequence of its non-blank lines. Ranks of suffixes by their first 1, 2, 4, ...
lines are doubled until `min_lines` lines are sorted: the rank at depth 2k orders the pairs
(rank at p, rank at p + k). A rank is the suffix-array position at which its group of suffixes
begins, so equal ranks are neighbours in the suffix array and each group of equal rank is one
interval of longest-common-prefix >= the depth. Only suffixes that share their prefix with another
one stay active: a prefix that is unique cannot be repeated at a greater depth. An interval of
LCP >= min_lines is a repeated run; its earliest member (by doc_id, then position) stays, every
later member is deleted. Overlapping members merge into maximal runs, so sorting deeper than
min_lines would split intervals further but delete the same lines.

Defined cases: rows without doc_id or without text are not searched and never changed; blank lines
are no part of a run and are never deleted by themselves (those between the lines of a deleted run go
with it); an empty text has no lines; rows that repeat both doc_id and text count as one document;
rows that share a doc_id but not a text are separate documents, ordered by a hash of the text; when a
run overlaps its own earlier occurrence (A A A A) the later lines go and the first occurrence of every
line survives. Other columns, whatever their names, are ignored by the search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, stage, unused

MIN_LINES = 3


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line_no, h): non-blank lines, numbered in their document."""
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("ls"))
    kept = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("line_no"), F.xxhash64(x).alias("h"), (F.trim(x) == "").alias("blank"))), lambda x: ~x["blank"])
    return lines.select("doc_id", "th", F.posexplode(kept).alias("pos", "l")).select("doc_id", "th", "pos", "l.line_no", "l.h")


def suffix_ranks(keyed: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rank, first_doc, first_th, first_pos) of each key that more than one suffix has.

    Keys are range-partitioned in suffix order; a rank is the number of suffixes before the key.
    """
    spark = keyed.sparkSession
    place = F.struct("doc_id", "th", "pos")
    keys = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("n > 1 AND first != last")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = stage(keys.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "lines-keys")
    before = keys.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # one row for each shuffle partition, so its size is bounded by the session's setting
    return ranked.join(F.broadcast(before), "part").select(*by, (F.col("base") + F.col("inner")).alias("rank"), "first")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, th, first_line, last_line): maximal runs of lines that go, as numbers of lines from 0."""
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    lines = stage(line_rows(docs), "lines")
    keys = suffix_ranks(lines, ["h"])
    at = lines.join(keys, "h").select("doc_id", "th", "pos", "rank", "first")
    depth = 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)  # the last doubling overlaps itself, so that the depth is exact
        ahead = Window.partitionBy("doc_id", "th").orderBy("pos").rangeBetween(step, step)
        # the rank `step` lines on; none: the prefix of depth + step lines is unique or runs past the end
        pairs = at.select("doc_id", "th", "pos", F.col("rank").alias("r1"), F.first("rank").over(ahead).alias("r2"))
        pairs = stage(pairs.where("r2 IS NOT NULL"), "lines-pairs")
        at = pairs.join(suffix_ranks(pairs, ["r1", "r2"]), ["r1", "r2"]).select("doc_id", "th", "pos", "rank", "first")
        depth += step
    later = at.where(F.struct("doc_id", "th", "pos") > F.col("first")).select("doc_id", "th", "pos").distinct()
    by = Window.partitionBy("doc_id", "th").orderBy("pos")
    islands = later.withColumn("new", (F.col("pos") > F.lag("pos").over(by) + min_lines).cast("int")).withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(by))
    runs = islands.groupBy("doc_id", "th", "island").agg(F.min("pos").alias("a"), (F.max("pos") + (min_lines - 1)).alias("b"))
    # positions among non-blank lines back to line numbers
    ends = runs.select("doc_id", "th", "island", F.explode(F.array("a", "b")).alias("pos"))
    spots = lines.select("doc_id", "th", "pos", "line_no").distinct()
    return ends.join(spots, ["doc_id", "th", "pos"]).groupBy("doc_id", "th", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).drop("island")


def without_runs(text: Column, runs: Column) -> Column:
    """The text without the lines that the runs (array of first_line, last_line) cover."""
    cut = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.exists(runs, lambda r: (i >= r["first_line"]) & (i <= r["last_line"])))
    return F.array_join(cut, "\n")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with repeated runs deleted from `text`; a document of which nothing is left goes.

    Columns and all other rows are unchanged; `n_chars`, where docs has it, follows the new text.
    """
    doc, th, runs, key = (unused(name, docs.columns) for name in ("doc_of_run", "text_of_run", "runs", "text_key"))
    found = repeated_runs(docs.select("doc_id", "text"), min_lines).groupBy(F.col("doc_id").alias(doc), F.col("th").alias(th)).agg(F.collect_list(F.struct("first_line", "last_line")).alias(runs))
    mark = docs.withColumn(key, F.xxhash64("text"))
    both = mark.join(found, (F.col("doc_id") == F.col(doc)) & (F.col(key) == F.col(th)), "left")
    both = both.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(without_runs(F.col("text"), F.col(runs))))
    both = both.where(F.col(runs).isNull() | (F.trim(F.regexp_replace("text", "\n", " ")) != ""))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(runs).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return both.select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line runs that go from documents: doc_id, first_line, last_line, n_lines."""
    runs = repeated_runs(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.select("doc_id", F.col("first_line").cast("long"), F.col("last_line").cast("long"), (F.col("last_line") - F.col("first_line") + 1).cast("long").alias("n_lines"))


def runs_sql(table: str = "documents", m: int = MIN_LINES) -> str:
    """The runs as one SQL text: windows of m lines that occur earlier, merged."""
    leads = ", ".join(f"lead(line, {k}) OVER d AS l{k}" for k in range(1, m))
    cols = ", ".join(["line", *(f"l{k}" for k in range(1, m))])
    same = reduce(lambda a, b: f"{a} AND {b}", (f"l{k} IS NOT NULL" for k in range(1, m)), "true")
    return f"""
    WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {table}),
    ls AS (SELECT doc_id, line, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos FROM raw WHERE trim(line) <> ''),
    w AS (SELECT doc_id, pos, {"line" if m == 1 else f"line, {leads}"} FROM ls WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
    f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY {cols} ORDER BY doc_id, pos) AS nth FROM w WHERE {same}),
    lat AS (SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {m} THEN 1 ELSE 0 END AS fresh FROM f WHERE nth > 1),
    isl AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM lat),
    runs AS (SELECT doc_id, island, min(pos) AS a, max(pos) + {m - 1} AS b FROM isl GROUP BY ALL)
    SELECT r.doc_id, x.line_no::BIGINT AS first_line, y.line_no::BIGINT AS last_line, (y.line_no - x.line_no + 1)::BIGINT AS n_lines
    FROM runs r JOIN ls x ON x.doc_id = r.doc_id AND x.pos = r.a JOIN ls y ON y.doc_id = r.doc_id AND y.pos = r.b"""
