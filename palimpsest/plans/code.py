"""Queries over Python source: each message of conversations made into a module, so that the modules' history is the conversation's.

A module has a line of its size and a function for every line of the message; modules of other roles than 'user' import the user's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import splitlines
from ..operators import problems as P
from ..operators import scopes as S
from ..registry import query
from .tables import table


def module_name():
    return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("role"))


def code(text):
    lines = splitlines(text)
    other = F.concat(F.lit("from c"), F.col("conv_id").cast("string"), F.lit(".user import SIZE\n\nN = "))
    head = F.concat(F.when(F.col("role") == "user", F.lit("SIZE = ")).otherwise(other), F.size(lines).cast("string"), F.lit("\n"))
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("\n\ndef f"), i.cast("string"), F.lit("(x):\n    return [SIZE, x, '"), F.left(F.md5(x), F.lit(8)), F.lit("']\n"))), "")
    return F.concat(head, body)


def versions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("project"), F.concat_ws(".", F.lit("m"), "role").alias("path"), F.col("turn").cast("long").alias("seq"), code(F.col("text")).alias("content"))


def modules(spark, sf_dir):
    last = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))
    return last.select(module_name().alias("module"), code(F.col("text")).alias("code"))


#: s (conv_id, role, turn, i, body): the lines of each message as functions; h: the line of its size; v: versions with the one before.
SOURCES = """v AS (SELECT conv_id, role, turn, lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS prev, max(turn) OVER (PARTITION BY conv_id, role) AS last, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS old FROM conversations),
s AS (SELECT conv_id, role, turn, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, '    return [SIZE, x, ''' || md5(unnest(string_split(text, chr(10))))[1:8] || ''']' || chr(10) AS body FROM conversations WHERE text <> ''),
h AS (SELECT conv_id, role, turn, (CASE WHEN role = 'user' THEN 'SIZE = ' ELSE 'N = ' END) || (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END) || chr(10) AS body, CASE WHEN role = 'user' THEN 1 ELSE 3 END AS line FROM conversations)"""
MODULE = "'c' || conv_id || '.' || role"


@query(f"""WITH {SOURCES}, z AS (SELECT s.*, line FROM s JOIN v USING (conv_id, role, turn) JOIN h USING (conv_id, role, turn) WHERE turn = last)
SELECT {MODULE} AS module, '' AS path, 'statements' AS kind, line::BIGINT AS start, (line + 1)::BIGINT AS until, md5(body) AS code_md5 FROM h JOIN v USING (conv_id, role, turn) WHERE turn = last
UNION ALL SELECT {MODULE}, 'f' || i, 'header', line + 3 + 4 * i, line + 4 + 4 * i, md5('def f' || i || '(x):' || chr(10)) FROM z
UNION ALL SELECT {MODULE}, 'f' || i, 'body', line + 4 + 4 * i, line + 5 + 4 * i, md5(body) FROM z""")
def scope_spans(spark, sf_dir):
    rows = S.spans(modules(spark, sf_dir))
    return rows.select("module", "path", "kind", F.col("start").cast("long").alias("start"), F.col("until").cast("long").alias("until"), F.md5("code").alias("code_md5"))


#: k (conv_id, role, turn, path, change, start, before, after): changed spans of each commit.
CHANGED = SOURCES + """,
k0 AS (SELECT conv_id, role, turn, '' AS path, -1 AS i, body FROM h UNION ALL SELECT conv_id, role, turn, 'f' || i, i, body FROM s),
o AS (SELECT v.conv_id, v.role, v.turn, k0.path, k0.i, k0.body FROM v JOIN k0 ON k0.conv_id = v.conv_id AND k0.role = v.role AND k0.turn = v.prev WHERE v.text <> v.old),
w AS (SELECT k0.* FROM k0 JOIN v USING (conv_id, role, turn) WHERE v.old IS NULL OR v.text <> v.old),
k AS (SELECT coalesce(o.conv_id, w.conv_id) AS conv_id, coalesce(o.role, w.role) AS role, coalesce(o.turn, w.turn) AS turn, coalesce(o.path, w.path) AS path,
  CASE WHEN o.body IS NULL THEN 'A' WHEN w.body IS NULL THEN 'D' ELSE 'M' END AS change, o.body AS before, w.body AS after,
  (CASE WHEN coalesce(o.role, w.role) = 'user' THEN 1 ELSE 3 END) + CASE WHEN coalesce(o.i, w.i) < 0 THEN 0 ELSE 4 + 4 * coalesce(o.i, w.i) END AS start
  FROM o FULL JOIN w ON o.conv_id = w.conv_id AND o.role = w.role AND o.turn = w.turn AND o.path = w.path WHERE o.body IS DISTINCT FROM w.body)"""


@query(f"WITH {CHANGED} SELECT conv_id::VARCHAR AS conv_id, turn::BIGINT AS turn, 'm.' || role AS module, path, change, start::BIGINT AS start, md5(before) AS before_md5, md5(after) AS after_md5 FROM k")
def commit_spans(spark, sf_dir):
    """Changed spans of every version of every module."""
    rows = P.commit_spans(versions(spark, sf_dir))
    return rows.select(F.col("project").alias("conv_id"), F.col("seq").alias("turn"), "module", "path", "change", F.col("start").cast("long").alias("start"), F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query(f"""WITH {SOURCES}, z AS (SELECT {MODULE} AS module, turn, '' AS path, body FROM h UNION ALL SELECT {MODULE}, turn, 'f' || i, body FROM s),
e AS (SELECT {MODULE} AS module, min(turn) AS a, max(turn) AS b FROM conversations GROUP BY ALL),
x AS (SELECT z.* FROM z JOIN e ON z.module = e.module AND z.turn = e.a), y AS (SELECT z.* FROM z JOIN e ON z.module = e.module AND z.turn = e.b)
SELECT coalesce(x.module, y.module) AS module, coalesce(x.path, y.path) AS path, CASE WHEN x.body IS NULL THEN 'A' WHEN y.body IS NULL THEN 'D' ELSE 'M' END AS change, md5(x.body) AS before_md5, md5(y.body) AS after_md5
FROM x FULL JOIN y ON x.module = y.module AND x.path = y.path WHERE x.body IS DISTINCT FROM y.body""")
def changed_spans(spark, sf_dir):
    """Spans of every module's first version against its last one; headers have no texts of their own here."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("text"))
    out = S.changed_spans(*(S.spans(m).where("kind != 'header'") for m in (first.select(module_name().alias("module"), code(F.col("text")).alias("code")), modules(spark, sf_dir))))
    return out.select("module", "path", "change", F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query(f"""SELECT DISTINCT {MODULE} AS src, 'c' || conv_id || '.user' AS dst FROM conversations c WHERE role <> 'user' AND EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user')""")
def import_graph(spark, sf_dir):
    return S.imports(modules(spark, sf_dir))


@query(f"""WITH {SOURCES} SELECT {MODULE} || '/f' || i AS target, 'c' || conv_id || '.user.SIZE' AS name, (7 + 4 * i)::BIGINT AS line FROM s JOIN v USING (conv_id, role, turn) WHERE turn = last AND role <> 'user'""")
def usage_lookup(spark, sf_dir):
    """What each function uses of other modules."""
    found = modules(spark, sf_dir)
    targets = S.spans(found).where("kind = 'body'").select(F.concat_ws("/", "module", "path").alias("target"), "module", "start", "until")
    return S.usage_lookup(targets, S.usages(found)).withColumn("line", F.col("line").cast("long"))


@query(f"""WITH {CHANGED}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY start, path) AS nth, length(coalesce(before, '')) + length(coalesce(after, '')) AS n FROM k),
p AS (SELECT t.conv_id, t.turn, t.role, t.path, i.path AS item, least(abs(i.start - t.start - 1), abs(t.start - i.start - 1), 1000) + i.n AS score, i.nth FROM r t JOIN r i ON t.conv_id = i.conv_id AND t.turn = i.turn AND i.nth < t.nth WHERE t.change = 'M')
SELECT conv_id::VARCHAR AS conv_id, turn::BIGINT AS turn, path, item, score::BIGINT AS score, row_number() OVER (PARTITION BY conv_id, turn, path ORDER BY score, nth DESC)::BIGINT AS rank FROM p""")
def problem_context(spark, sf_dir):
    """For each edited span the earlier changed spans of its commit, ranked as context."""
    _, context = P.problems(P.commit_spans(versions(spark, sf_dir)))
    part = lambda c: F.element_at(F.split(c, "/"), 2)
    return context.select(F.col("project").alias("conv_id"), F.col("seq").alias("turn"), part(F.col("uid")).alias("path"), part(F.col("item")).alias("item"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CHANGED} SELECT conv_id::VARCHAR AS conv_id, turn::BIGINT AS turn, path, 2::BIGINT AS edit_lines, (CASE WHEN path = '' THEN 0 ELSE 1 END)::BIGINT AS n_headers, md5(before) AS before_md5 FROM k WHERE change = 'M'")
def edit_problems(spark, sf_dir):
    found, _ = P.problems(P.commit_spans(versions(spark, sf_dir)))
    return found.select(F.col("project").alias("conv_id"), F.col("seq").alias("turn"), "path", F.col("edit_lines").cast("long").alias("edit_lines"), F.size("headers").cast("long").alias("n_headers"), F.md5("before").alias("before_md5"))


@query()
def token_problems(spark, sf_dir):
    """Edit problems in tokens, with their references."""
    spans = P.commit_spans(versions(spark, sf_dir)).persist()
    return P.tokenized(*P.problems(spans), spans)


@query("""WITH l AS (SELECT doc_id AS id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text <> ''), t AS (SELECT * FROM l WHERE (id + line) % 5 = 0)
SELECT id, line::BIGINT AS line, md5(right(coalesce((SELECT string_agg(text || chr(10), '' ORDER BY line) FROM l WHERE l.id = t.id AND l.line < t.line), ''), 200)) AS left_md5, md5(text) AS text_md5, md5(left(coalesce((SELECT string_agg(chr(10) || text, '' ORDER BY line) FROM l WHERE l.id = t.id AND l.line > t.line), ''), 200)) AS right_md5 FROM t""")
def fill_in_problems(spark, sf_dir):
    """Every fifth line of the documents as what is to be filled in."""
    from .tables import lines

    rows = lines(spark, sf_dir)
    out = P.completion_contexts(rows, rows.where((F.col("id") + F.col("line")) % 5 == 0), 200)
    return out.select("id", F.col("line").cast("long").alias("line"), F.md5("left").alias("left_md5"), F.md5("text").alias("text_md5"), F.md5("right").alias("right_md5"))
