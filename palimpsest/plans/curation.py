"""Queries over datasets, retrieval and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as K
from ..operators import retrieval as R
from ..registry import query
from .tables import table

TOKENS = "regexp_extract_all(text, '[A-Za-z0-9_]+')"


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders),
w AS (SELECT o_custkey, o_orderkey, parent, 0 AS depth FROM o WHERE back = 1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.parent, depth + 1 FROM w JOIN o ON o.o_orderkey = w.parent AND o.o_custkey = w.o_custkey WHERE depth < 9)
SELECT o_custkey, o_orderkey, depth::BIGINT AS depth FROM w""")
def history_walk(spark, sf_dir):
    """Each customer's orders as a chain of commits, from the newest back, ten at most."""
    t = table(spark, sf_dir, "orders")
    out = K.history(t.select(F.col("o_custkey").alias("project"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_orderkey").alias("id")), 10)
    return out.select(F.col("project").alias("o_custkey"), F.col("id").alias("o_orderkey"), F.col("depth").cast("long").alias("depth"))


@query("""WITH s AS (SELECT conv_id, md5(string_agg(text, chr(31) ORDER BY turn)) AS signature FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 30) GROUP BY 1)
SELECT min(conv_id) AS conv_id, signature, count(*)::BIGINT AS n FROM s GROUP BY signature""")
def repo_signature_dedupe(spark, sf_dir):
    """Conversations as repositories: those whose first 30 messages are the same count once."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project"), F.col("turn").alias("seq"), F.col("text").alias("message"))
    return K.first_of_each(K.signatures(t), ["signature"], ["project"]).select(F.col("project").alias("conv_id"), "signature", "n")


@query("SELECT doc_id, CASE WHEN r <= 50 THEN 'test' WHEN r <= 100 THEN 'valid' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) AS r FROM documents)")
def split_assign(spark, sf_dir):
    return K.ranked_split(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 50, 50)


@query("SELECT doc_id, CASE WHEN h < 0.05 THEN 'test' WHEN h < 0.1 THEN 'valid' ELSE 'train' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM documents)")
def split_by_hash(spark, sf_dir):
    return K.split_by_hash(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def random_subset(spark, sf_dir):
    """A sample of a fixed size: the limit is the feature."""
    return K.hashed_sample(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 100)


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) >= 10")
def repo_filter(spark, sf_dir):
    return K.frequent(table(spark, sf_dir, "orders"), "o_custkey", 10)


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM documents GROUP BY md5(text)")
def unique_first_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("k")


@query("SELECT doc_id AS uid FROM documents INTERSECT SELECT item_id FROM benchmark")
def uid_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid")).intersect(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("uid")))


@query("SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16)::BIGINT AS batch FROM documents")
def batch_fixed(spark, sf_dir):
    return K.batches(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 16)


@query(f"SELECT doc_id, source, used::BIGINT AS used FROM (SELECT doc_id, source, sum(len({TOKENS})) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 8192")
def budget_prefix(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(T.tokens(F.col("text"))).alias("n"))
    return R.within_budget(t, ["source"], ["doc_id"], F.col("n"), 8192).select("doc_id", "source", "used")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 48)) AS a FROM t WHERE len(w) > 0)
SELECT doc_id, (a // 48)::BIGINT AS chunk, md5(array_to_string(w[a + 1:a + 64], ' ')) AS chunk_md5, len(w[a + 1:a + 64])::BIGINT AS n_tokens FROM s WHERE a = 0 OR a + 16 < len(w)""")
def chunks_fixed(spark, sf_dir):
    """Chunks of 64 tokens that overlap by 16."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(R.chunked(T.tokens(F.col("text")), 64, 16)).alias("chunk", "c"))
    return t.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5(F.array_join("c", " ")).alias("chunk_md5"), F.size("c").cast("long").alias("n_tokens"))


@query(f"""WITH t AS (SELECT doc_id, len({TOKENS}) AS a, len(regexp_extract_all(reverse(text), '[A-Za-z0-9_]+')) % 97 AS b FROM documents),
f AS (SELECT *, 100 - least(a, 50) - least(b, 50) AS spare FROM t), g AS (SELECT *, least(greatest(a - 50, 0), spare) AS more FROM f)
SELECT doc_id, (least(a, 50) + more)::BIGINT AS a_kept, (least(b, 50) + least(greatest(b - 50, 0), spare - more))::BIGINT AS b_kept FROM g""")
def truncate_two_sections(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("a"), (F.size(T.tokens(F.reverse("text"))) % 97).alias("b"))
    a, b = R.shares(100, [F.col("a"), F.col("b")])
    return t.select("doc_id", a.cast("long").alias("a_kept"), b.cast("long").alias("b_kept"))


@query("""WITH p AS (SELECT doc_id AS id, (doc_id * 7) % 40 AS line FROM documents), s AS (SELECT doc_id AS id, unnest([0, 10, 12, 20]) AS a, unnest([10, 20, 15, 30]) AS u FROM documents)
SELECT p.id, line, a::BIGINT AS start, u::BIGINT AS until FROM p JOIN s ON p.id = s.id AND line >= a AND line < u QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY u - a, a) = 1""")
def point_in_span(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    spans = t.select("id", F.explode(F.expr("array(struct(0L AS start, 10L AS until), struct(10L AS start, 20L AS until), struct(12L AS start, 15L AS until), struct(20L AS start, 30L AS until))")).alias("s")).select("id", "s.*")
    return R.spans_at(t.withColumn("line", (F.col("id") * 7) % 40), spans)


@query("""WITH m AS (SELECT r_name AS module FROM region UNION SELECT r_name || '.' || n_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0),
p AS (SELECT DISTINCT r_name || '.' || n_name || '.' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT path, module, substr(path, length(module) + 2) AS rest FROM p JOIN m ON starts_with(path, module || '.') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(module) DESC) = 1""")
def longest_prefix_module(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    rn = r.join(n, r["r_regionkey"] == n["n_regionkey"])
    modules = r.select(F.col("r_name").alias("module")).unionByName(rn.where("n_nationkey % 2 = 0").select(F.concat_ws(".", "r_name", "n_name").alias("module")))
    paths = c.join(rn, c["c_nationkey"] == rn["n_nationkey"]).select(F.concat_ws(".", "r_name", "n_name", "c_name").alias("path")).distinct()
    return R.longest_module(paths, modules)
