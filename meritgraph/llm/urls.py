"""URL filters: host-suffix and path-prefix expressions against a rule list. DataFrame functions only.

A URL expands into one expression for each suffix of its host at a dot and each path length that some rule has: only
those can equal a rule. Expressions and rules meet by an equi-join on a short hash prefix (the first bytes of the
digest); the full SHA-256 digests then confirm, and the longest rule wins (ties: the longer host, then block).

Null URLs and those without ``://`` have an empty host and path, fit no rule and get ``default``. Repeated rows are
judged alike and kept as often as they occur, hot URLs and hosts collapse before the shuffle, and an empty rule list
leaves every URL with ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgraph.llm.common import UPPER, LOWER, table

#: (action, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
PREFIX_HEX = 8
#: Rule lists are broadcast up to this many rows; beyond it both sides are shuffled, salted on the URLs' side.
BROADCAST_RULES = 100_000
SALTS = 16


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (action, rule_host, rule_path, digest, prefix); for lists that are too long for a literal, read them
    from a table with the first three columns and pass them through ``digested``."""
    return digested(spark.createDataFrame(rules, "action string, rule_host string, rule_path string"))


def digested(rules: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat(F.translate(F.col("rule_host"), UPPER, LOWER), F.col("rule_path")), 256)
    return rules.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """A row for each row of ``pages`` (page_id, url): page_id, host, path, rule (null if none fits), verdict."""
    spark = pages.sparkSession
    sizes = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    flat = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    flat = flat.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    lengths = F.array(*map(F.lit, sorted(sizes.lengths))).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    asked = flat.withColumn("expression", F.explode_outer(expressions)).withColumn("asked", F.sha2("expression", 256))
    asked = asked.withColumn("asked_prefix", F.substring("asked", 1, PREFIX_HEX))
    confirmed = (F.col("asked_prefix") == F.col("prefix")) & (F.col("asked") == F.col("digest"))
    if sizes.n <= BROADCAST_RULES:
        met = asked.join(F.broadcast(rules), confirmed, "left")
    else:  # a hot expression (a common host) is spread over the salts
        salted = rules.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = asked.withColumn("own_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        met = met.join(salted, confirmed & (F.col("own_salt") == F.col("salt")), "left")
    found = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(found).alias("length"), F.length("rule_host").alias("host_length"), F.col("action"), found.alias("rule"))
    best = met.groupBy("page_id", "host", "path", "copies").agg(F.max(F.when(found.isNotNull(), rank)).alias("best"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP5_SQL = r"""
WITH rules(action, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, row_number() OVER () AS n FROM u),
m AS (SELECT p.*, rule_host || rule_path AS rule, action, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, action DESC) AS k
      FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
