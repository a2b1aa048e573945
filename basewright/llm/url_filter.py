"""URL filters by hashed host-suffix and path-prefix expressions.

A URL is expanded into every host suffix at a label boundary and every path prefix after a slash, joined to
expressions; rules are such expressions. Both sides are joined on the first four bytes of SHA-256, the rest of the
digest is compared after the join, and of a URL's confirmed rules the longest decides. A rule can only fit where
its numbers of labels and of slashes occur, so only those expansions are made. Everything is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import table

#: Rules are broadcast up to this number, and joined by salted shuffle beyond it.
MOST_SENT = 100_000
SALTS = 16
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _expressions(rules: DataFrame) -> Column:
    """Host suffixes times path prefixes of columns host and path, at the depths at which ``rules`` has any."""
    labels = [r[0] for r in rules.select(F.size(F.split("host", "\\.", -1)).alias("n")).distinct().collect()]
    plain = rules.where(F.col("path").endswith("/"))
    slashes = [r[0] for r in plain.select(F.expr("length(path) - length(replace(path, '/', ''))").alias("n")).distinct().collect()]
    lengths = [r[0] for r in rules.where(~F.col("path").endswith("/")).select(F.length("path").alias("n")).distinct().collect()]
    hosts = F.array_distinct(F.array(*(F.when(F.size(F.split("host", "\\.", -1)) >= n, F.substring_index("host", ".", -n)) for n in sorted(labels))))
    paths = [F.when(F.expr("length(path) - length(replace(path, '/', ''))") >= n, F.concat(F.substring_index("path", "/", n), F.lit("/"))) for n in sorted(slashes)]
    paths += [F.when(F.length("path") >= n, F.expr(f"left(path, {n})")) for n in sorted(lengths)]
    paths = F.array_distinct(F.array(*paths))
    both = F.flatten(F.transform(F.filter(hosts, lambda h: h.isNotNull()), lambda h: F.transform(F.filter(paths, lambda p: p.isNotNull()), lambda p: F.struct(h.alias("host"), p.alias("path")))))
    return both


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most_sent: int = MOST_SENT) -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule (null if none fits), verdict.

    rules(host, path, verdict): a rule fits its host and all subdomains if the URL's path starts with its path (null:
    empty). The longest host, then the longest path wins; of equal rules with different verdicts, block does. Rules
    with a null host or verdict are dropped. Hosts of rules are lower-cased. Null URLs have empty host and path.
    Repeated pages are judged each for itself; other columns are ignored; empty tables are no special case.
    """
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).getField("verdict").alias("rule_verdict"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    n_rules = rules.count()
    if n_rules == 0:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hashed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "rule_verdict", _digest(F.col("host"), F.col("path")).alias("rule_digest"))
    hashed = hashed.withColumn("rule_prefix", F.left("rule_digest", F.lit(8)))
    # An expression of each URL without one keeps it: explode_outer of an empty list is a null one.
    spread = urls.withColumn("x", F.explode_outer(_expressions(rules)))
    spread = spread.withColumn("digest", _digest(F.col("x.host"), F.col("x.path"))).withColumn("prefix", F.left("digest", F.lit(8)))
    if n_rules <= most_sent:
        joined = spread.join(F.broadcast(hashed), F.col("prefix") == F.col("rule_prefix"), "left")
    else:  # a popular host's expressions go to as many tasks as there are salts; missing prefixes are spread as they are
        hashed = hashed.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = spread.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        joined = spread.join(hashed, (F.col("prefix") == F.col("rule_prefix")) & (F.col("salt") == F.col("rule_salt")), "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule_host").alias("h"), F.length("rule_path").alias("p"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"))
    best = joined.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(confirmed).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://(.*)$', 1, 's') ELSE '' END AS r FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1, 's') AS path FROM rest
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
       (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h) DESC, length(p) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h) DESC, length(p) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""
