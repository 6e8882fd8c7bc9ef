"""URL filter (operator 8): empirical-Bayes reputation of hosts.

A labelled page is bad if its label has quality 0 or toxic 1. Outcomes add up by host, registered domain and
public suffix. The badness of suffixes varies around the overall rate, that of a suffix' domains around the
suffix' estimate, and that of a domain's hosts around the domain's: beta-binomial priors, whose concentrations are
estimated by moments level by level. Estimates go down the levels: a suffix is shrunk to the overall rate, a domain to its
suffix, a host to its domain, each by as much as its own labels are few. A host's posterior is a beta
distribution; its pages go if the posterior's lower bound, mean - `z` deviations, is above `worst`: doubt keeps a page.

A registered domain is the public suffix and one label before it. Suffixes are the last label, or the last two
where SECOND_LEVEL has them (a parameter's default, in place of the full public list).

Defined cases: null URLs and those without a host are kept, with null host and estimates; host names count in lower case, without
user, port or trailing dot; numeric addresses and names of one label are their own domain and suffix; labels
without page, or with neither quality nor toxic, do not count; of several labels of a page each counts; repeated pages are decided alike, each a row; a host without labels has its
domain's estimate, and so on up; without any label, the rate is 0.5 with a wide posterior and every page is kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

Z, WORST, LEAST_STRENGTH, MOST_STRENGTH = 1.645, 0.3, 2.0, 1000.0
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.ar", "co.in", "co.kr", "co.za", "com.tr", "com.tw")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def with_hosts(pages: DataFrame, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """(page_id, host, domain, suffix)."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    named = pages.select("page_id", F.regexp_replace(host, r"\.$", "").alias("host")).withColumn("host", F.when(F.col("host") != "", F.col("host")))
    bits = F.split("host", r"\.")
    own = F.col("host").rlike(r"^[0-9.]+$") | ~F.col("host").contains(".")
    two = F.concat_ws(".", F.element_at(bits, -2), F.element_at(bits, -1))
    suffix = F.when(own, F.col("host")).when(two.isin(*second_level), two).otherwise(F.element_at(bits, -1))
    named = named.withColumn("suffix", suffix)
    inner = F.size(F.split("suffix", r"\."))
    domain = F.when(own | (F.size(bits) <= inner), F.col("host")).otherwise(F.concat_ws(".", F.slice(bits, F.greatest(F.size(bits) - inner, F.lit(1)), inner + 1)))
    return named.withColumn("domain", domain)


def strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row with m, the concentration of a beta prior around `mean`, by moments over groups (bad, n, mean)."""
    # E[sum n (rate - mean)^2] = sum mean (1 - mean) (1 + (n - 1) / (m + 1))
    seen = groups.where("n > 0")
    moved = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(mean), 2))
    level = F.sum(F.col(mean) * (1 - F.col(mean)))
    extra = F.sum(F.col(mean) * (1 - F.col(mean)) * (F.col("n") - 1))
    row = seen.agg(moved.alias("moved"), level.alias("level"), extra.alias("extra"))
    over = F.col("moved") - F.col("level")
    return row.select(F.when(F.col("moved").isNull(), LEAST_STRENGTH).when(over > 0, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), F.col("extra") / over - 1))).otherwise(F.lit(MOST_STRENGTH)).alias("m"))


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad, a, b): the beta posterior of each host's bad rate."""
    named = with_hosts(pages).where("host IS NOT NULL")
    known = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("page"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("is_bad"))
    outcomes = named.join(known, named["page_id"] == known["page"], "left")
    hosts = outcomes.groupBy("host", "domain", "suffix").agg(F.count("is_bad").alias("n"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad")).select(F.when(F.col("all_n") > 0, (F.col("all_bad") + 0.5) / (F.col("all_n") + 1)).otherwise(0.5).alias("up"))

    def shrunk(level: DataFrame) -> DataFrame:
        """level with the concentration m and its own estimate."""
        out = level.crossJoin(strength(level, "up"))
        return out.withColumn("est", (F.col("m") * F.col("up") + F.col("bad")) / (F.col("m") + F.col("n")))

    top = shrunk(suffixes.crossJoin(whole))
    middle = shrunk(domains.join(top.select("suffix", F.col("est").alias("up")), "suffix"))
    low = shrunk(hosts.join(middle.select("domain", "suffix", F.col("est").alias("up")), ["domain", "suffix"]))
    m, up = F.col("m"), F.col("up")
    return low.select("host", "domain", "suffix", "n", "bad", (m * up + F.col("bad")).alias("a"), (m * (1 - up) + F.col("n") - F.col("bad")).alias("b"))


def url_decisions(pages: DataFrame, labels: DataFrame, z: float = Z, worst: float = WORST) -> DataFrame:
    """A row for each page: its host's estimated bad rate, the lower bound, and whether it is kept."""
    a, b = F.col("a"), F.col("b")
    rated = reputation(pages, labels).withColumn("rate", a / (a + b)).withColumn("low", F.col("rate") - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    named = with_hosts(pages)
    both = named.join(rated.select("host", "n", "rate", "low"), "host", "left")
    return both.select("page_id", "host", "domain", "suffix", F.col("n").cast("long").alias("n_labels"), F.round("rate", 6).alias("bad_rate"), F.round("low", 6).alias("bad_low"), (F.col("low").isNull() | (F.round("low", 6) <= worst)).alias("keep"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host's reputation; labels are those of the documents of the same id."""
    return url_decisions(load(spark, sf_dir, "pages").select("page_id", "url"), load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def reputation_sql(z: float = Z, worst: float = WORST) -> str:
    two = ", ".join(f"'{s}'" for s in SECOND_LEVEL)

    def shrunk(name: str, source: str, up: str) -> str:
        return f"""{name}_up AS ({up}),
    {name}_m AS (SELECT CASE WHEN moved IS NULL THEN {LEAST_STRENGTH}::DOUBLE WHEN moved - lev > 0 THEN greatest({LEAST_STRENGTH}::DOUBLE, least({MOST_STRENGTH}::DOUBLE, extra / (moved - lev) - 1)) ELSE {MOST_STRENGTH}::DOUBLE END AS m FROM
        (SELECT sum(n * (bad / n - up) * (bad / n - up)) AS moved, sum(up * (1 - up)) AS lev, sum(up * (1 - up) * (n - 1)) AS extra FROM {name}_up WHERE n > 0)),
    {name}_e AS (SELECT u.*, m, (m * up + bad) / (m + n) AS est FROM {name}_up u, {name}_m)"""

    return f"""
    WITH h0 AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.$', ''), '') AS host FROM pages),
    h1 AS (SELECT *, string_split(host, '.') AS bits, regexp_matches(host, '^[0-9.]+$') OR NOT contains(host, '.') AS own FROM h0),
    h2 AS (SELECT *, CASE WHEN own THEN host WHEN bits[-2] || '.' || bits[-1] IN ({two}) THEN bits[-2] || '.' || bits[-1] ELSE bits[-1] END AS suffix FROM h1),
    named AS (SELECT page_id, host, suffix, CASE WHEN own OR len(bits) <= len(string_split(suffix, '.')) THEN host ELSE array_to_string(bits[len(bits) - len(string_split(suffix, '.')):], '.') END AS domain FROM h2),
    known AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS is_bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL),
    hosts AS (SELECT host, domain, suffix, count(is_bad)::DOUBLE AS n, coalesce(sum(is_bad), 0)::DOUBLE AS bad FROM named LEFT JOIN known ON page_id = doc_id WHERE host IS NOT NULL GROUP BY ALL),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
    whole AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) ELSE 0.5::DOUBLE END AS up FROM suffixes),
    {shrunk("s", "suffixes", "SELECT x.*, up FROM suffixes x, whole")},
    {shrunk("d", "domains", "SELECT x.*, s.est AS up FROM domains x JOIN s_e s USING (suffix)")},
    {shrunk("h", "hosts", "SELECT x.*, d.est AS up FROM hosts x JOIN d_e d USING (domain, suffix)")},
    ab AS (SELECT host, n, m * up + bad AS a, m * (1 - up) + n - bad AS b FROM h_e),
    rated AS (SELECT host, n, a / (a + b) AS rate, a / (a + b) - {z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab)
    SELECT page_id, p.host, domain, suffix, n::BIGINT AS n_labels, round(rate, 6) AS bad_rate, round(low, 6) AS bad_low, low IS NULL OR round(low, 6) <= {worst}::DOUBLE AS keep
    FROM named p LEFT JOIN rated r ON p.host = r.host"""
