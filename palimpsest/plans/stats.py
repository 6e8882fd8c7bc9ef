"""Queries over aggregations and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as S
from ..registry import query
from ..streaming import online as O
from .tables import table

TOKENS = "len(regexp_extract_all(text, '[A-Za-z0-9_]+'))"
NAN = "'NaN'::DOUBLE"


@query("SELECT lang, avg(n)::DOUBLE AS mean, median(n)::DOUBLE AS median, min(n)::BIGINT AS low, max(n)::BIGINT AS high, count(n)::BIGINT AS n FROM (SELECT lang, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n FROM documents) GROUP BY lang")
def line_stats(spark, sf_dir):
    return S.scalar_stats(table(spark, sf_dir, "documents").select("lang", T.count_lines(F.col("text")).alias("v")), ["lang"], "v")


@query("SELECT source, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::BIGINT AS loc FROM documents GROUP BY source")
def nonblank_loc(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.nonblank_lines(F.col("text"))).alias("loc"))


@query(f"SELECT source, avg(n)::DOUBLE AS mean, median(n)::DOUBLE AS median, min(n)::BIGINT AS low, max(n)::BIGINT AS high, count(n)::BIGINT AS n FROM (SELECT source, {TOKENS} AS n FROM documents) GROUP BY source")
def token_stats(spark, sf_dir):
    return S.scalar_stats(table(spark, sf_dir, "documents").select("source", F.size(T.tokens(F.col("text"))).cast("long").alias("v")), ["source"], "v")


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity), 2) AS total, sum(l_quantity)::DOUBLE AS weight, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    out = S.weighted_mean(t, ["l_returnflag"], F.col("l_extendedprice") * F.col("l_quantity"), F.col("l_quantity"))
    return out.select("l_returnflag", F.round("total", 2).alias("total"), "weight", F.round("mean", 6).alias("mean"))


JUDGED = "(SELECT lang, quality = 1 AS hit, quality, toxic FROM labels JOIN documents USING (doc_id))"


def judged(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query(f"SELECT lang, sum(hit::INT)::BIGINT AS n_correct, count(*)::BIGINT AS n_total, sum(hit::INT) / count(*)::DOUBLE AS accuracy FROM {JUDGED} GROUP BY ROLLUP (lang)")
def accuracy_grouping_sets(spark, sf_dir):
    return S.grouped_accuracy(judged(spark, sf_dir), "lang", F.col("quality") == 1)


@query("SELECT quality AS label, count(*)::BIGINT AS n, avg((1 - toxic = quality)::INT)::DOUBLE AS recall FROM labels WHERE quality IS NOT NULL GROUP BY quality ORDER BY n DESC, label LIMIT 2")
def accuracy_by_labels(spark, sf_dir):
    return S.recall_by_label(table(spark, sf_dir, "labels").withColumn("guess", 1 - F.col("toxic")), "guess", "quality", 2)


@query("SELECT l_quantity, n::BIGINT AS n, (sum(n) OVER (ORDER BY l_quantity))::BIGINT AS running FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)")
def ecdf(spark, sf_dir):
    return S.running_counts(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT event_id, user_id, (sum(value::DECIMAL(18, 2)) OVER w)::DOUBLE / count(*) OVER w AS running_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_mean(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return S.running_mean(t, "user_id", ["ts", "event_id"], "value", 2).select("event_id", "user_id", "running_mean")


@query("""SELECT l_linestatus AS model, sum(l_quantity)::DOUBLE AS label_gain, round(sum(l_quantity - l_discount * 10) / sum(l_quantity), 8) AS first_ratio, round(sum(l_quantity - l_tax) / sum(l_quantity), 8) AS total_ratio, avg(l_linenumber)::DOUBLE AS rounds FROM lineitem GROUP BY 1""")
def gain_ratio(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    gains = t.select(F.col("l_linestatus").alias("model"), F.col("l_quantity").alias("label_gain"), (F.col("l_quantity") - F.col("l_discount") * 10).alias("first_gain"), (F.col("l_quantity") - F.col("l_tax")).alias("total_gain"), F.col("l_linenumber").alias("rounds"))
    return S.gain_ratios(gains, ["model"]).withColumns({c: F.round(c, 8) for c in ("first_ratio", "total_ratio")})


@query("""WITH g AS (SELECT conv_id, lower(text) AS form, count(*)::BIGINT AS n_samples, sum(1.0 / (1 + turn))::DOUBLE AS weight, max(length(text))::BIGINT AS score, arg_max(turn, length(text) * 1000 - turn)::BIGINT AS member FROM conversations GROUP BY 1, 2)
SELECT conv_id, form, n_samples, round(weight, 6) AS weight, score, member, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, score DESC, form)::BIGINT AS rank FROM g""")
def marginalize(spark, sf_dir):
    """Turns of a conversation as samples, grouped by their whole text in lower case."""
    t = table(spark, sf_dir, "conversations")
    out = S.marginalized(t, ["conv_id"], F.lower("text"), 1 / (1 + F.col("turn")).cast("double"), F.length("text").cast("long"), "turn")
    return out.select("conv_id", "form", "n_samples", F.round("weight", 6).alias("weight"), "score", "member", F.col("rank").cast("long").alias("rank"))


@query()
def bootstrap_ci(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("v"))
    return S.bootstrap_interval(t, "v", rounds=1000)


@query()
def bootstrap_pvalue(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality", "toxic")
    return S.bootstrap_compare(t, "toxic", "quality", rounds=1000)


@query("SELECT event_id, user_id AS project, CASE WHEN ts2 < max(ts2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'skipped' ELSE 'ok' END AS status FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS ts2 FROM events)")
def latest_request(spark, sf_dir):
    """Events as requests by user, every fourth a day late."""
    t = table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 4 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    return O.latest_requests(t.select(F.col("user_id").alias("project"), late.alias("ts"), F.col("event_id").alias("seq"))).select(F.col("seq").alias("event_id"), "project", "status")


@query("SELECT event_id, user_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS miss FROM events")
def stamp_cache_misses(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("stamp"))
    return O.stamp_misses(t).select(F.col("seq").alias("event_id"), F.col("key").alias("user_id"), "miss")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    return O.windowed_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))
