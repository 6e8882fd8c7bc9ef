"""Queries over token sequences, on the scripted edit of documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import tokens as K
from ..operators import delta as D
from ..operators import evaluation as E
from ..registry import query
from .delta import GROUPS, both, ints
from .tables import DIFF, SCRIPT, table

TOK = "regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_]')"
MD5 = "md5(array_to_string({}, chr(31)))"
NO = "[]::VARCHAR[]"
#: t (id, x): the tokens of the inline diff of each text.
DIFF_TOKENS = DIFF + f""",
t0 AS (SELECT id, pos, (CASE WHEN pos > 0 THEN ['<nl>'] ELSE {NO} END) || (CASE tag WHEN '+' THEN ['<add>'] WHEN '-' THEN ['<del>'] ELSE {NO} END) || {TOK.format('text')} AS x FROM c),
t AS (SELECT id, flatten(list(x ORDER BY pos)) AS x FROM t0 GROUP BY id)"""
#: n (id, n): lines of each text; io (id, input, output).
IO = DIFF + f""",
n AS (SELECT id, max(line) + 1 AS n FROM l GROUP BY id),
i0 AS (SELECT id, line, (CASE WHEN line > 0 THEN ['<nl>'] ELSE {NO} END) || (CASE WHEN line < 100 THEN ['<' || line || '>'] ELSE {NO} END) || {TOK.format('text')} AS x FROM l
  UNION ALL SELECT id, n, ['<nl>'] || (CASE WHEN n < 100 THEN ['<' || n || '>'] ELSE {NO} END) FROM n),
o0 AS (SELECT id, line, -1 AS act, ['<' || line || '>'] AS x FROM l UNION ALL SELECT id, n, -1, ['<' || n || '>'] FROM n
  UNION ALL SELECT id, line, act, CASE op WHEN '+' THEN ['<add>'] || {TOK.format('text')} || ['<nl>'] ELSE ['<del>'] END FROM d),
io AS (SELECT * FROM (SELECT id, flatten(list(x ORDER BY line)) AS input FROM i0 GROUP BY id) JOIN (SELECT id, flatten(list(x ORDER BY line, act)) AS output FROM o0 WHERE line < 100 GROUP BY id) USING (id))"""


def md5(tokens):
    return F.md5(F.array_join(tokens, "\u001f"))


def diff_tokens(spark, sf_dir):
    """(id, tokens): the inline diff of each document's scripted edit."""
    return diffs(spark, sf_dir).select("id", K.encode_diff(F.col("diff")).alias("tokens"))


def diffs(spark, sf_dir):
    """(id, diff): the lines of the inline diff of each document's scripted edit."""
    rows = D.positions(D.apply_to_change(*both(spark, sf_dir))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("tag", "text").alias("d")))).alias("rows"))
    return rows.select("id", F.transform("rows", lambda r: r["d"]).alias("diff"))


def of_tokens(spark, sf_dir, columns, f):
    """(id, columns...): f of each diff's tokens, a tuple, or None for no row; the tokens stay in Python."""
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(lots):
        for lot in lots:
            rows = [(i, *r) for i, d in zip(lot.column("id").to_pylist(), lot.column("diff").to_pylist()) if (r := f(S.encode_diff(d))) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return diffs(spark, sf_dir).mapInArrow(run, f"id long, {columns}")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text <> '')
SELECT doc_id, sum(len({TOK.format('line')}) + 1)::BIGINT - 1 AS n_tokens, any_value(md5(text)) AS text_md5 FROM l JOIN documents USING (doc_id) GROUP BY doc_id""")
def tokens_roundtrip(spark, sf_dir):
    """Texts encoded and decoded again."""
    t = table(spark, sf_dir, "documents").where("text != ''").select("doc_id", K.encode(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(K.decode(F.col("t"))).alias("text_md5"))


@query(f"WITH {DIFF_TOKENS} SELECT id, len(x)::BIGINT AS n_tokens, {MD5.format('x')} AS tokens_md5 FROM t")
def diff_encoded(spark, sf_dir):
    return diff_tokens(spark, sf_dir).select("id", F.size("tokens").cast("long").alias("n_tokens"), md5("tokens").alias("tokens_md5"))


@query(f"""WITH {DIFF} SELECT a.id, before_md5, coalesce(after_md5, md5('')) AS after_md5 FROM (SELECT id, md5(string_agg(text, chr(10) ORDER BY line)) AS before_md5 FROM l GROUP BY id) a
LEFT JOIN (SELECT id, md5(string_agg(text, chr(10) ORDER BY pos)) AS after_md5 FROM c WHERE tag <> '-' GROUP BY id) b USING (id)""")
def diff_decoded(spark, sf_dir):
    """Both sides of the inline diff's tokens."""
    t = diff_tokens(spark, sf_dir).select("id", K.change_of(F.col("tokens")).alias("c"))
    return t.select("id", F.md5("c.before").alias("before_md5"), F.md5("c.after").alias("after_md5"))


@query(f"WITH {IO} SELECT id, {MD5.format('input')} AS input_md5, {MD5.format('output')} AS output_md5, true AS valid, true AS known FROM io")
def input_output(spark, sf_dir):
    def f(tokens):
        source, output = S.input_output(tokens)
        return S.md5(source), S.md5(output), S.valid_output(output), S.marks_known(source, output)

    return of_tokens(spark, sf_dir, "input_md5 string, output_md5 string, valid boolean, known boolean", f)


@query(f"""WITH {DIFF}, o AS (SELECT id, pos, text FROM c WHERE tag <> '-' AND line < 100 UNION ALL SELECT id, pos, text FROM c WHERE line >= 100 AND act = 99)
SELECT a.id, before_md5, coalesce(after_md5, md5('')) AS after_md5 FROM (SELECT id, md5(string_agg(text, chr(10) ORDER BY line) || chr(10)) AS before_md5 FROM l GROUP BY id) a
LEFT JOIN (SELECT id, md5(string_agg(text, chr(10) ORDER BY pos) || chr(10)) AS after_md5 FROM o GROUP BY id) b USING (id)""")
def output_inlined(spark, sf_dir):
    """The edit that an input and its output stand for; lines from the hundredth on keep their old form."""
    return of_tokens(spark, sf_dir, "before_md5 string, after_md5 string", lambda tokens: tuple(S.md5([text]) for text in S.change_of(S.inlined(*S.input_output(tokens)))))


ACTS = "SELECT id, line::BIGINT AS line, count(*)::BIGINT AS n_acts, md5(string_agg(op || text, chr(10) ORDER BY act)) AS acts_md5 FROM d {} GROUP BY id, line"


def delta_rows(df):
    """(id, line, n_acts, acts_md5) of df (id, delta), by way of the text form and back."""
    back = K.lines_of_delta(K.tokens_of_delta(K.lines_of_delta(F.col("delta"))))
    return df.select("id", F.explode(back).alias("line", "acts")).select("id", F.col("line").cast("long").alias("line"), F.size("acts").cast("long").alias("n_acts"), F.md5(F.array_join("acts", "\n")).alias("acts_md5"))


@query(f"WITH {SCRIPT} {ACTS.format('')}")
def token_delta(spark, sf_dir):
    """The token delta read from the inline diff."""
    return delta_rows(diff_tokens(spark, sf_dir).select("id", K.delta_of(F.col("tokens")).alias("d")).select("id", "d.delta"))


@query(f"WITH {SCRIPT} {ACTS.format('WHERE line < 100')}")
def output_delta(spark, sf_dir):
    """The token delta read from the output."""
    t = diff_tokens(spark, sf_dir).select("id", K.input_output(F.col("tokens")).alias("io"))
    return delta_rows(t.select("id", K.delta_of_output(F.sequence(F.lit(0), F.lit(K.MARKS - 1)), F.col("io.output")).alias("delta")))


@query(f"""WITH {DIFF_TOKENS}, z AS (SELECT id, sum(CASE op WHEN '+' THEN 1 + len({TOK.format('text')}) ELSE 1 END)::BIGINT AS n_tokens, count(*)::BIGINT AS n_lines FROM d GROUP BY id),
a0 AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS r, text FROM c WHERE tag <> '-'), a1 AS (SELECT id, pos, (CASE WHEN r > 1 THEN ['<nl>'] ELSE {NO} END) || {TOK.format('text')} AS x FROM a0),
a AS (SELECT id, flatten(list(x ORDER BY pos)) AS y FROM a1 GROUP BY id)
SELECT t.id, {MD5.format('x')} AS diff_md5, coalesce({MD5.format('y')}, md5('')) AS after_md5, n_tokens, n_lines FROM t LEFT JOIN a USING (id) JOIN z USING (id)""")
def token_delta_applied(spark, sf_dir):
    """Token deltas applied to their originals, both ways, with their sizes."""
    def f(tokens):
        old, delta = S.delta_of(tokens)
        acts = [a for some in delta.values() for a in some]
        return (S.md5(S.applied(old, delta)), S.md5(S.applied(old, delta, keep_deleted=False)), sum(map(len, acts)), len(acts)) if acts else None

    return of_tokens(spark, sf_dir, "diff_md5 string, after_md5 string, n_tokens long, n_lines long", f)


@query(f"""WITH t AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents WHERE text <> '')
SELECT doc_id, CASE WHEN len(t) <= 50 THEN {MD5.format('t')} ELSE {MD5.format("t[1:49] || ['</s>']")} END AS head_md5, CASE WHEN len(t) <= 50 THEN {MD5.format('t')} ELSE {MD5.format("['<s>'] || t[len(t) - 48:len(t)]")} END AS tail_md5 FROM t""")
def truncated_sections(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where("text != ''").select("doc_id", K.encode_line(F.col("text")).alias("t"))
    return t.select("doc_id", md5(K.truncated(F.col("t"), F.lit(50))).alias("head_md5"), md5(K.truncated(F.col("t"), F.lit(50), keep_end=True)).alias("tail_md5"))


def headered_sql(backward: bool) -> str:
    a, b = ("len(t) - (i - old) - room", "len(t) - (i - old)") if backward else ("i - old", "i - old + room")
    left, right = ("i + room < len(t) - 1", "i > 0") if backward else ("i > 0", "i + room < len(t) - 1")
    return f"""WITH t AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents WHERE text <> ''),
k AS (SELECT doc_id, t, unnest(generate_series(0, CASE WHEN len(t) <= 62 THEN 0 ELSE ((len(t) - 62 + 45) // 46) END)) AS k FROM t WHERE len(t) > 0),
p AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE 62 + (k - 1) * 46 END AS i, CASE WHEN k = 0 THEN 62 ELSE 46 END AS room, CASE WHEN k = 0 THEN 0 ELSE 16 END AS old FROM k),
q AS (SELECT doc_id, k, greatest({a}, 0) AS a, least({b}, len(t)) AS b, t, {left} AS l, {right} AS r FROM p),
s AS (SELECT doc_id, k, t[a + 1:b] AS body, l, r FROM q),
e AS (SELECT doc_id, k, list_transform(body, lambda x, j: CASE WHEN l AND j = 1 THEN '<s>' WHEN r AND j = len(body) THEN '</s>' ELSE x END) AS body FROM s)
SELECT doc_id, k::BIGINT AS chunk, {MD5.format("['#', k::VARCHAR] || body")} AS chunk_md5 FROM e"""


def headered(spark, sf_dir, backward):
    """Chunks of 64 tokens with a header of two that overlap by 16, sequence ends at their cuts."""
    head = lambda k: F.array(F.lit("#"), k.cast("string"))
    t = table(spark, sf_dir, "documents").where("text != ''").select("doc_id", F.posexplode(K.chunks_with_header(K.encode_line(F.col("text")), head, 2, 64, 16, backward)).alias("chunk", "c"))
    return t.select("doc_id", F.col("chunk").cast("long").alias("chunk"), md5("c").alias("chunk_md5"))


@query(headered_sql(False))
def chunks_headered(spark, sf_dir):
    return headered(spark, sf_dir, False)


@query(headered_sql(True))
def chunks_backward(spark, sf_dir):
    return headered(spark, sf_dir, True)


@query(f"""WITH t AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents WHERE text <> ''), s AS (SELECT doc_id, t[41:80] AS m, t[1:40] AS a, t[81:len(t)] AS b FROM t),
h AS (SELECT *, 96 - len(m) AS spare FROM s), g AS (SELECT *, least(len(a), spare // 2) AS a0, least(len(b), spare // 2) AS b0 FROM h),
f AS (SELECT *, a0 + least(len(a) - a0, spare - a0 - b0) AS ka FROM g), e AS (SELECT *, b0 + least(len(b) - b0, spare - ka - b0) AS kb FROM f),
x AS (SELECT *, len(a) - ka AS la, len(b) - kb AS lb FROM e)
SELECT doc_id, {MD5.format("(CASE WHEN la <= 0 THEN a WHEN ka <= 0 THEN " + NO + " ELSE ['<s>'] || a[len(a) - ka + 2:len(a)] END) || m || (CASE WHEN lb <= 0 THEN b WHEN kb <= 0 THEN " + NO + " ELSE b[1:kb - 1] || ['</s>'] END)")} AS input_md5,
(CASE WHEN la > 0 THEN least(len(a), la + 8) ELSE 0 END)::BIGINT AS n_above, (CASE WHEN lb > 0 THEN least(len(b), lb + 8) ELSE 0 END)::BIGINT AS n_below FROM x""")
def context_inlined(spark, sf_dir):
    """The middle of each text as input with room for 96 tokens, what comes before and after as its context."""
    t = table(spark, sf_dir, "documents").where("text != ''").select("doc_id", K.encode_line(F.col("text")).alias("t"))
    t = t.select("doc_id", F.slice("t", 41, 40).alias("m"), F.slice("t", 1, 40).alias("a"), F.when(F.size("t") > 80, F.expr("slice(t, 81, size(t) - 80)")).otherwise(K.none()).alias("b"))
    t = t.select("doc_id", K.with_context(F.col("m"), F.col("a"), F.col("b"), 96, 8).alias("c"))
    return t.select("doc_id", md5("c.input").alias("input_md5"), F.size("c.above").cast("long").alias("n_above"), F.size("c.below").cast("long").alias("n_below"))


@query(f"""WITH {GROUPS}, z AS (SELECT id, grp, sum(length(text) + 1) AS cost FROM g GROUP BY ALL)
SELECT a.id, a.grp::BIGINT AS least_grp, a.cost::BIGINT AS least_cost, b.grp::BIGINT AS most_grp, b.cost::BIGINT AS most_cost
FROM (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, grp) = 1) a JOIN (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost DESC, grp) = 1) b USING (id)""")
def chosen_groups(spark, sf_dir):
    """The change group of least and of greatest cost of each text."""
    delta, cost = both(spark, sf_dir)[1], F.length("text") + 1
    a = E.least_effort(delta, cost).select("id", F.col("grp").alias("least_grp"), F.col("cost").alias("least_cost"))
    b = E.most_uncertain(delta, cost).select("id", F.col("grp").alias("most_grp"), F.col("cost").alias("most_cost"))
    return ints(a.join(b, "id"), "least_grp", "least_cost", "most_grp", "most_cost")


@query(f"""WITH {GROUPS}, m AS (SELECT id, line FROM l UNION ALL SELECT id, max(line) + 1 FROM l GROUP BY id),
z AS (SELECT id, line, -1 AS act, NULL AS grp, 1 AS n FROM m UNION ALL SELECT id, line, act, grp, CASE op WHEN '+' THEN len({TOK.format('text')}) + 2 ELSE 1 END FROM g),
s AS (SELECT *, 1 + sum(n) OVER (PARTITION BY id ORDER BY line, act) AS stop FROM z)
SELECT id, grp::BIGINT AS grp, min(stop - n)::BIGINT AS start, max(stop)::BIGINT AS stop FROM s WHERE grp IS NOT NULL GROUP BY id, grp""")
def group_output_ranges(spark, sf_dir):
    lines, delta = both(spark, sf_dir)
    size = F.when(F.col("op") == "+", F.size(K.encode_line(F.col("text"))) + 1).otherwise(1)
    return ints(E.output_ranges(lines, delta, size), "grp", "start", "stop")


WRONG = "op = '+' AND try_cast(substr(text, 6) AS INT) % 3 = 0"


def guess(diff, edit):
    """A prediction that has all adds of a number divisible by 3 wrong."""
    return {line: [(op, "wrong" if op == "+" and int(text[5:]) % 3 == 0 else text) for op, text in acts] for line, acts in edit.items()}


@query(f"""WITH {GROUPS}, z AS (SELECT id, grp, count(*) AS n, bool_or({WRONG}) AS wrong FROM g GROUP BY ALL),
s AS (SELECT id, sum(n) AS label, coalesce(sum(n) FILTER (NOT wrong), 0) AS ok, count(*) FILTER (wrong) AS r, count(*) FILTER (NOT wrong) AS a FROM z GROUP BY id)
SELECT id, 'diff_lines' AS model, label::BIGINT AS label_gain, ok::BIGINT AS first_gain, ok::BIGINT AS total_gain, least(6, r + CASE WHEN a > 0 THEN 1 ELSE 0 END)::BIGINT AS rounds FROM s""")
def multi_round_gain(spark, sf_dir):
    """Six rounds at most of a model that has every third add wrong, gains in changed lines."""
    return ints(E.multi_round(*both(spark, sf_dir), guess, models=("diff_lines",)), "rounds")


@query()
def edit_gain_models(spark, sf_dir):
    """Gains of the scripted edits by cost model."""
    return E.edit_gains(*both(spark, sf_dir))


@query(f"""WITH {SCRIPT} SELECT id, NOT coalesce(bool_or({WRONG}), false) AS correct FROM (SELECT DISTINCT id FROM l) LEFT JOIN d USING (id) GROUP BY id""")
def exact_match(spark, sf_dir):
    """Whether a prediction that has every third add wrong gives the edited text."""
    lines, delta = both(spark, sf_dir)
    wrong = (F.col("op") == "+") & (F.substring("text", 6, 20).cast("int") % 3 == 0)
    return E.exact_matches(lines, delta, delta.withColumn("text", F.when(wrong, "wrong").otherwise(F.col("text"))))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, 1 + n_chars::DOUBLE / 100 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
b AS (SELECT source, doc_id, r, cost AS held, 1 AS n, 0 AS batch FROM o WHERE r = 1
  UNION ALL SELECT o.source, o.doc_id, o.r, CASE WHEN b.held + o.cost > 50 OR b.n >= 8 THEN o.cost ELSE b.held + o.cost END, CASE WHEN b.held + o.cost > 50 OR b.n >= 8 THEN 1 ELSE b.n + 1 END, CASE WHEN b.held + o.cost > 50 OR b.n >= 8 THEN b.batch + 1 ELSE b.batch END
  FROM b JOIN o ON o.source = b.source AND o.r = b.r + 1)
SELECT source, doc_id, batch::BIGINT AS batch FROM b""")
def dynamic_batches(spark, sf_dir):
    """Documents of each source in batches of a bounded cost and of eight at most."""
    t = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return E.dynamic_batches(t, "source", ["doc_id"], 1 + F.col("n_chars").cast("double") / 100, 50.0, 8).select("source", "doc_id", "batch")


@query("""WITH s AS (SELECT label_v AS variant, doc_id AS key, CASE label_v WHEN 'base' THEN quality WHEN 'no_signatures' THEN 1 - toxic ELSE (quality + toxic) % 2 END AS correct FROM labels, (VALUES ('base'), ('no_signatures'), ('no_changes')) v(label_v)),
a AS (SELECT variant, count(*)::BIGINT AS n, avg(correct) AS accuracy FROM s GROUP BY 1) SELECT variant, n, round(accuracy, 8) AS accuracy, round(accuracy - (SELECT accuracy FROM a WHERE variant = 'base'), 8) AS above FROM a""")
def ablation(spark, sf_dir):
    t = table(spark, sf_dir, "labels")
    kinds = {"base": F.col("quality"), "no_signatures": 1 - F.col("toxic"), "no_changes": (F.col("quality") + F.col("toxic")) % 2}
    rows = t.select(F.col("doc_id").alias("key"), F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.cast("int").alias("correct")) for k, v in kinds.items()))).alias("s")).select("key", "s.*")
    return E.ablation_report(rows, "base").withColumns({c: F.round(c, 8) for c in ("accuracy", "above")})
