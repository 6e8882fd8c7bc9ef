"""Queries over versions and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.code import keystroke_cost
from ..functions.diff import diff_ops, diff_rows
from ..operators import changes as C
from ..operators import retrieval as R
from ..registry import query
from .tables import PAIRS, table, versions

LINES = "CASE WHEN {0} = '' THEN 0 ELSE length({0}) - length(replace({0}, chr(10), '')) + 1 END"


@query(f"WITH {PAIRS} SELECT conv_id, role, turn, md5(before) AS before_md5, md5(after) AS after_md5 FROM v")
def version_pairs(spark, sf_dir):
    out = C.version_pairs(versions(spark, sf_dir))
    return out.select(F.col("project").alias("conv_id"), F.col("path").alias("role"), F.col("seq").alias("turn"), F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query(f"WITH {PAIRS}, k AS (SELECT *, CASE WHEN before IS NULL THEN 'A' ELSE 'M' END AS kind FROM v) SELECT kind, count(*)::BIGINT AS n, count(*) FILTER (before = after)::BIGINT AS n_unchanged, sum({LINES.format('after')})::BIGINT AS n_lines, avg({LINES.format('after')})::DOUBLE AS mean_lines, median({LINES.format('after')})::DOUBLE AS median_lines FROM k GROUP BY kind")
def version_changes(spark, sf_dir):
    """Changes between successive versions of every text, counted by kind."""
    rows = C.version_changes(versions(spark, sf_dir)).withColumn("n_lines", T.count_lines(F.col("after")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("unchanged").alias("n_unchanged"), F.sum("n_lines").alias("n_lines"), F.avg("n_lines").alias("mean_lines"), F.median("n_lines").alias("median_lines"))


@query(f"WITH {PAIRS} SELECT conv_id, role, turn, CASE WHEN before IS NULL THEN 'D' ELSE 'M' END AS kind, md5(after) AS before_md5, md5(before) AS after_md5, md5(after) AS earlier_md5 FROM v")
def change_inverse(spark, sf_dir):
    out = C.with_views(C.inverse(C.version_changes(versions(spark, sf_dir))))
    return out.select(F.col("project").alias("conv_id"), F.col("path").alias("role"), F.col("seq").alias("turn"), "kind", F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"), F.md5("earlier").alias("earlier_md5"))


@query(f"WITH {PAIRS} SELECT conv_id, role, turn FROM v WHERE before IS NOT NULL AND length(before) <= 800 AND length(after) <= 800 AND {LINES.format('before')} <= 6 AND {LINES.format('after')} <= 6")
def admit_spans(spark, sf_dir):
    out = C.admitted(C.version_changes(versions(spark, sf_dir)), max_chars=800, max_lines=6)
    return out.select(F.col("project").alias("conv_id"), F.col("path").alias("role"), F.col("seq").alias("turn"))


@query("WITH a AS (SELECT conv_id, role, text FROM conversations WHERE turn = 0), b AS (SELECT conv_id, role, text FROM conversations WHERE turn = 2) SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.role, b.role) AS role, CASE WHEN a.conv_id IS NULL THEN 'A' WHEN b.conv_id IS NULL THEN 'D' ELSE 'M' END AS kind, md5(a.text) AS before_md5, md5(b.text) AS after_md5 FROM a FULL OUTER JOIN b ON a.conv_id = b.conv_id AND a.role = b.role")
def named_changes_full_outer(spark, sf_dir):
    """Turn 0 against turn 2 of every conversation, by (conversation, role)."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.col("text").alias("value"))
    out = C.named_changes(t.where("turn = 0").drop("turn"), t.where("turn = 2").drop("turn"), ["conv_id", "role"])
    return out.select("conv_id", "role", "kind", F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query("SELECT conv_id, turn, count(*) OVER w AS n_prior, string_agg(turn::VARCHAR, ',') OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS prior FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prior_changes_prefix(spark, sf_dir):
    """Each version's earlier ones of the same project, newest first."""
    out = C.earlier_changes(C.version_changes(versions(spark, sf_dir)))
    return out.select(F.col("project").alias("conv_id"), F.col("seq").alias("turn"), F.size("earlier").cast("long").alias("n_prior"), F.when(F.size("earlier") > 0, F.array_join("earlier", ",")).alias("prior"))


@query("""WITH s AS (SELECT conv_id, turn, role, turn * 10 AS a, turn * 10 + 3 AS u, length(text) AS n FROM conversations),
p AS (SELECT t.conv_id, t.turn AS target, i.turn AS item, (CASE WHEN t.role = i.role THEN least(abs(t.a - i.u), abs(i.a - t.u), 1000) ELSE 1000 END - CASE WHEN i.turn % 3 = 0 THEN 2000 ELSE 0 END + i.n)::BIGINT AS score FROM s t JOIN s i ON t.conv_id = i.conv_id AND i.turn < t.turn)
SELECT conv_id, target, item, score, row_number() OVER (PARTITION BY conv_id, target ORDER BY score, item DESC) AS rank FROM p""")
def rank_context(spark, sf_dir):
    """Earlier turns of each turn's conversation, ranked as context: nearest of the same role first, used ones before all."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 3).alias("until"), F.length("text").alias("length"))
    a, b = t.alias("t"), t.alias("i")
    pairs = a.join(b, (F.col("t.conv_id") == F.col("i.conv_id")) & (F.col("i.turn") < F.col("t.turn")))
    pairs = pairs.select(F.struct(F.col("t.conv_id").alias("conv_id"), F.col("t.turn").alias("target")).alias("target"), F.col("i.turn").alias("item"), (F.col("t.role") == F.col("i.role")).alias("same_module"), "i.start", "i.until", F.col("t.start").alias("t_start"), F.col("t.until").alias("t_until"), (F.col("i.turn") % 3 == 0).alias("used"), "i.length", F.col("i.turn").alias("seq"))
    return R.ranked_context(pairs).select("target.conv_id", "target.target", "item", "score", F.col("rank").cast("long").alias("rank"))


@query()
def levenshtein_gain(spark, sf_dir):
    """Edit distance of all version pairs, over the whole texts in characters; lines that did not change add nothing. No SQL: DuckDB counts bytes."""
    rows = C.version_pairs(versions(spark, sf_dir)).where("before IS NOT NULL AND after IS NOT NULL")
    return rows.select(F.col("project").alias("conv_id"), F.col("path").alias("role"), F.col("seq").alias("turn"), F.levenshtein("before", "after").cast("long").alias("gain"))


@query()
def line_diff(spark, sf_dir):
    """Line diffs and ranges of changed lines of all version pairs."""
    rows = C.version_changes(versions(spark, sf_dir)).where("kind = 'M' AND NOT unchanged")
    return rows.select(F.col("project").alias("conv_id"), F.col("path").alias("role"), F.col("seq").alias("turn"), diff_rows("before", "after").alias("diff"), diff_ops("before", "after").alias("ops"))


@query()
def keystroke_gain(spark, sf_dir):
    """Keystrokes from each version's whole text to the next one's."""
    rows = C.version_pairs(versions(spark, sf_dir)).where("before IS NOT NULL")
    return rows.select(F.col("project").alias("conv_id"), F.col("path").alias("role"), F.col("seq").alias("turn"), keystroke_cost("before", "after").alias("keystrokes"))
