"""The driver's tables in the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import splitlines
from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as version histories: a role's turns are the versions of one text."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("project"), F.col("role").alias("path"), F.col("turn").alias("seq"), F.col("text").alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").alias("id"), F.posexplode(splitlines(F.col("text"))).alias("line", "text"))


def script(rows: DataFrame) -> DataFrame:
    """A delta by arithmetic on lines: deletes every seventh, inserts before every fifth of a text's lines. No shuffle."""
    at = F.col("id") + F.col("line")
    add, gone = at % 5 == 0, at % 7 == 0
    action = lambda act, op, text: F.struct(act.cast("int").alias("act"), F.lit(op).alias("op"), text.alias("text"))
    adds = F.when(add, F.array(action(F.lit(0), "+", F.concat(F.lit("+ins "), F.col("line").cast("string"))))).otherwise(F.array().cast("array<struct<act:int,op:string,text:string>>"))
    dels = F.when(gone, F.array(action(add.cast("int"), "-", F.lit("")))).otherwise(F.array().cast("array<struct<act:int,op:string,text:string>>"))
    return rows.select("id", "line", F.explode(F.concat(adds, dels)).alias("a")).select("id", "line", "a.*")


#: The same in SQL: l (id, line, text) and d (id, line, act, op, text).
SCRIPT = """l AS (SELECT doc_id AS id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text <> ''),
d AS (SELECT id, line, 0 AS act, '+' AS op, '+ins ' || line AS text FROM l WHERE (id + line) % 5 = 0
  UNION ALL SELECT id, line, CASE WHEN (id + line) % 5 = 0 THEN 1 ELSE 0 END, '-', '' FROM l WHERE (id + line) % 7 = 0)"""
#: Diff rows by joins: c (id, line, act, tag, text, pos).
DIFF = SCRIPT + """,
c0 AS (SELECT id, line, act, '+' AS tag, text FROM d WHERE op = '+'
  UNION ALL SELECT id, line, 99, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.id = l.id AND d.line = l.line AND d.op = '-') THEN '-' ELSE ' ' END, text FROM l),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, act) - 1 AS pos FROM c0)"""
#: v: versions with the one before.
PAIRS = "v AS (SELECT conv_id, role, turn, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before, text AS after FROM conversations)"
