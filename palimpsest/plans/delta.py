"""Queries over the delta algebra, on the scripted edit of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delta as D
from ..registry import query
from .tables import DIFF, SCRIPT, lines, script


def both(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows, script(rows)


def ints(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def chosen(delta):
    """Every second action of a text is in the first part."""
    return delta.withColumn("first", F.row_number().over(D._by("line", "act")) % 2 == 0)


@query(f"WITH {SCRIPT} SELECT id, line::BIGINT AS line, act::BIGINT AS act, op, text FROM d")
def delta_keys(spark, sf_dir):
    """The delta read back from the inline diff that it makes."""
    return ints(D.delta_of_diff(D.positions(D.apply_to_change(*both(spark, sf_dir)))), "line", "act")


@query(f"WITH {DIFF} SELECT id, md5(string_agg(text, chr(10) ORDER BY pos)) AS after_md5, count(*)::BIGINT AS n_lines FROM c WHERE tag <> '-' GROUP BY id")
def delta_apply_input(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return D.apply_to_input(*both(spark, sf_dir)).groupBy("id").agg(F.md5(text).alias("after_md5"), F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {DIFF} SELECT id, pos::BIGINT AS pos, tag, text FROM c")
def delta_apply_change(spark, sf_dir):
    return ints(D.positions(D.apply_to_change(*both(spark, sf_dir))).select("id", "pos", "tag", "text"), "pos")


@query(f"WITH {SCRIPT} SELECT id, (line + 10)::BIGINT AS line, act::BIGINT AS act, op, text FROM d WHERE line >= 2 AND line < 6")
def delta_restrict_shift(spark, sf_dir):
    return ints(D.shifted(D.restricted(both(spark, sf_dir)[1], 2, 6), 10), "line", "act")


GROUPS = SCRIPT + """,
g0 AS (SELECT *, coalesce(op = '-' AND lag(op) OVER w = '+' AND lag(line) OVER w = line, false) AS paired FROM d WINDOW w AS (PARTITION BY id ORDER BY line, act)),
g1 AS (SELECT *, op = '-' AND NOT paired AS solo FROM g0),
g2 AS (SELECT *, CASE WHEN paired OR coalesce(solo AND lag(solo) OVER w AND line - lag(line) OVER w IN (0, 1), false) THEN 0 ELSE 1 END AS new FROM g1 WINDOW w AS (PARTITION BY id ORDER BY line, act)),
g AS (SELECT id, line, act, op, text, sum(new) OVER (PARTITION BY id ORDER BY line, act) AS grp FROM g2)"""


@query(f"WITH {GROUPS} SELECT id, line::BIGINT AS line, act::BIGINT AS act, op, text, grp::BIGINT AS grp FROM g")
def delta_change_groups(spark, sf_dir):
    return ints(D.change_groups(both(spark, sf_dir)[1]), "line", "act", "grp")


CHOSEN = SCRIPT + ", s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, act) % 2 = 0 AS first FROM d)"


@query(f"WITH {CHOSEN} SELECT id, line::BIGINT AS line, act::BIGINT AS act, op, first, (line + CASE WHEN first THEN 0 ELSE (SELECT coalesce(sum(CASE WHEN p.op = '+' THEN 1 ELSE -1 END), 0) FROM s p WHERE p.id = s.id AND p.first AND (p.line, p.act) < (s.line, s.act)) END)::BIGINT AS new_line FROM s")
def delta_decompose_input(spark, sf_dir):
    return ints(D.decompose_for_input(chosen(both(spark, sf_dir)[1])).drop("text"), "line", "act", "new_line")


@query(f"""WITH {CHOSEN},
fd AS (SELECT id, line FROM s WHERE first AND op = '-'), fa AS (SELECT id, line FROM s WHERE first AND op = '+'),
ends AS (SELECT x.id, x.line, min(y.line) AS stop FROM fd x JOIN (
    SELECT id, line FROM fd e WHERE NOT EXISTS (SELECT 1 FROM fd n WHERE n.id = e.id AND n.line = e.line + 1 AND NOT EXISTS (SELECT 1 FROM fa WHERE fa.id = n.id AND fa.line = n.line))
  ) y ON x.id = y.id AND y.line >= x.line GROUP BY ALL)
SELECT s.id, s.line::BIGINT AS line, act::BIGINT AS act, op, first, (s.line + CASE WHEN first THEN 0 ELSE (SELECT count(*) FROM s p WHERE p.id = s.id AND p.first AND p.op = '+' AND (p.line, p.act) < (s.line, s.act)) + coalesce(stop - s.line + 1, 0) END)::BIGINT AS new_line
FROM s LEFT JOIN ends ON s.id = ends.id AND s.line = ends.line""")
def delta_decompose_change(spark, sf_dir):
    return ints(D.decompose_for_change(chosen(both(spark, sf_dir)[1])).drop("text"), "line", "act", "new_line")


@query(f"WITH {DIFF} SELECT id, line::BIGINT AS line, pos::BIGINT AS new_id FROM c WHERE tag <> '-' AND line % 3 = 0")
def delta_new_line_ids(spark, sf_dir):
    return ints(D.new_line_ids(*both(spark, sf_dir), F.col("line") % 3 == 0), "line", "new_id")


@query(f"WITH {DIFF} SELECT id, pos::BIGINT AS diff_line, (SELECT count(*) FROM c p WHERE p.id = c.id AND p.tag <> '-' AND p.pos < c.pos)::BIGINT AS source_line FROM c WHERE tag <> '-'")
def line_ids_to_source_lines(spark, sf_dir):
    return ints(D.source_lines(*both(spark, sf_dir)), "diff_line", "source_line")


@query(f"WITH {SCRIPT} SELECT id, count(*)::BIGINT AS n_actions, sum(length(text) + 1)::BIGINT AS n_chars FROM d GROUP BY id")
def delta_sizes(spark, sf_dir):
    return D.sizes(both(spark, sf_dir)[1])


@query(f"""WITH {DIFF}, n AS (SELECT *, EXISTS (SELECT 1 FROM c o WHERE o.id = c.id AND o.tag <> ' ' AND abs(o.pos - c.pos) <= 1) AS near FROM c)
SELECT id, pos::BIGINT AS pos, CASE WHEN near THEN tag || text ELSE '...' END AS text FROM n WHERE near OR pos = 0 OR EXISTS (SELECT 1 FROM n p WHERE p.id = n.id AND p.pos = n.pos - 1 AND p.near)""")
def diff_context_compress(spark, sf_dir):
    return ints(D.compressed(D.positions(D.apply_to_change(*both(spark, sf_dir))), 1), "pos")


@query(f"WITH {GROUPS} SELECT id, grp::BIGINT AS grp, count(*)::BIGINT AS n, bool_and(op = '-' OR (id + line) % 3 <> 0) AS accepted FROM g GROUP BY id, grp")
def accepted_groups(spark, sf_dir):
    """Groups of the script that a prediction has which is wrong in every third add."""
    delta = both(spark, sf_dir)[1]
    guess = delta.withColumn("text", F.when((F.col("op") == "+") & ((F.col("id") + F.col("line")) % 3 == 0), "wrong").otherwise(F.col("text")))
    return ints(D.accepted_groups(delta, guess), "grp")


@query(f"WITH {GROUPS}, z AS (SELECT *, count(*) OVER (PARTITION BY id, grp) AS n, max(grp) OVER (PARTITION BY id) AS top FROM g) SELECT id, line::BIGINT AS line, text FROM z WHERE grp = top AND n <= 2 AND op = '+' AND length(text) >= 6")
def completion_targets(spark, sf_dir):
    return ints(D.completion_targets(both(spark, sf_dir)[1]), "line")


@query(f"""WITH {SCRIPT}, n AS (SELECT id, max(line) + 2 AS n FROM l GROUP BY id), a AS (SELECT id, n, unnest(generate_series(0, (n - 1) // 30)) * 30 AS start FROM n),
b AS (SELECT id, (line // 30) * 30 AS start, count(*) AS n_changes FROM d GROUP BY ALL)
SELECT id, start::BIGINT AS start, least(start + 30, n)::BIGINT AS until, coalesce(n_changes, 0)::BIGINT AS n_changes FROM a LEFT JOIN b USING (id, start) QUALIFY row_number() OVER (PARTITION BY id ORDER BY start) <= 4""")
def split_windows(spark, sf_dir):
    return ints(D.windows(*both(spark, sf_dir)), "n_changes")


@query(f"""WITH {GROUPS}, n AS (SELECT id, max(line) + 2 AS n FROM l GROUP BY id), a AS (SELECT id, unnest(generate_series(0, (n - 1) // 30)) * 30 AS start FROM n),
b AS (SELECT id, (line // 30) * 30 AS start, count(DISTINCT grp) AS n_groups FROM g GROUP BY ALL)
SELECT id, start::BIGINT AS start, coalesce(n_groups, 0)::BIGINT AS n_groups FROM a LEFT JOIN b USING (id, start) QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(n_groups, 0) DESC, start) <= 4""")
def inline_windows(spark, sf_dir):
    """Windows of most changes with nothing put into the text (a ratio of 0), the case that SQL can follow."""
    return ints(D.inlined_windows(*both(spark, sf_dir), ratio=0.0)[2].select("id", "start", "n_groups"), "start", "n_groups")


@query()
def inline_windows_drawn(spark, sf_dir):
    """Windows after groups were drawn into the text."""
    return D.inlined_windows(*both(spark, sf_dir))[2]


@query(f"""WITH {GROUPS}, z AS (SELECT *, count(*) OVER (PARTITION BY id, grp) AS n, max(grp) OVER (PARTITION BY id) AS top, row_number() OVER (PARTITION BY id, grp ORDER BY line, act) AS k, last(op) OVER (PARTITION BY id, grp ORDER BY line, act ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM g)
SELECT z.id, (line + (SELECT count(*) FROM g p WHERE p.id = z.id AND p.op = '+' AND p.grp < z.grp) + CASE WHEN tail = '-' THEN 1 ELSE 0 END)::BIGINT AS line, text, CASE tail WHEN '+' THEN 'add' ELSE 'mod' END AS kind FROM z WHERE grp = top AND n <= 2 AND k = 1 AND op = '+' AND length(text) >= 6""")
def completion_problems(spark, sf_dir):
    """Completion targets at their places in the context to which everything before them was applied."""
    return ints(D.completions(*both(spark, sf_dir))[1], "line")
