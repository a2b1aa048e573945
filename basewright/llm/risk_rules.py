"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose metric is above a cutoff. Cutoffs are taken from a
grid fixed beforehand, from the mildest on. On labelled good documents, per stratum and rule, a cutoff is certified
if the exact binomial probability of so few false rejections, were the true rate the permitted one, is at most the
level; the strictest cutoff before the first that fails is used, a sequence that needs no correction of its own.
The level is divided by the number of strata and rules (Bonferroni), the permitted rate by the number of rules, so
with probability 1 - DELTA no stratum loses more than ALPHA of its good documents. Without enough labels nothing is
certified and the rule rejects nothing there. Everything is built-in expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import SPACE, table, text_or_empty, written

ALPHA, DELTA = 0.03, 0.05
#: Rule: cutoffs from the mildest on; the metrics are in ``metrics``.
GRID = {
    "symbol_share": (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05),
    "capital_share": (0.95, 0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "dup_line_share": (0.9, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
    "mean_word_chars": (30.0, 20.0, 15.0, 12.0, 10.0),
}


def text_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals; no shuffle.

    Windows of five words are compared by 64-bit hashes within a text. An expression that an inner function reads
    for each element is bound by a one-element transform, so that it is computed once a row.
    """
    text = F.col("_text")
    docs = docs.withColumn("_text", text_or_empty())
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.regexp_replace(text, SPACE, "")

    def bind(value: Column, f) -> Column:
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def windows(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5))))
        return F.when(n >= 5, each).otherwise(F.array().cast("array<bigint>"))

    def covered(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda j, d: F.coalesce(F.get(s, j + d)["k"] == F.get(s, j)["k"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, F.lit(1)) | F.when(j > 0, same(j, F.lit(-1))).otherwise(False))
            return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(bind(pairs, twice), start, step, lambda a: a["n"])

    docs = docs.withColumn("_words", words).withColumn("_lines", lines)
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
            "n_repeat_words": bind(bind(F.transform("_words", lambda w: F.xxhash64(w)), windows), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k))).cast("long"),
        }
    )
    return docs.drop("_text", "_words", "_lines")


def metrics() -> dict[str, Column]:
    """The rules' metrics over the columns of ``text_stats``; 0 (no rule applies) where a text has no word."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbol_share": share("n_symbols", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "mean_word_chars": share("word_chars", "n_words"),
    }


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, taken back by eight factors; about 1e-12."""
    y = x + 8
    inverse = 1 / y
    series = inverse / 12 - F.pow(inverse, 3) / 360 + F.pow(inverse, 5) / 1260 - F.pow(inverse, 7) / 1680
    stirling = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return stirling - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact to rounding.

    Terms are summed from k downwards as multiples of the first, as many as can matter: below the mean they fall at
    least geometrically, and 60 standard deviations below k are less than 1e-300 of the sum.
    """
    x = k.cast("double")
    first = log_gamma(n + 1.0) - log_gamma(x + 1.0) - log_gamma(n - x + 1.0) + x * math.log(p) + (n - x) * math.log1p(-p)
    terms = F.least(k.cast("long"), F.ceil(F.sqrt(n * p * (1 - p)) * 60).cast("long") + 60)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, j: Column) -> Column:
        i = x - j + 1  # from the term of i to that of i - 1
        t = a["t"] * i / (n - i + 1) * ((1 - p) / p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, start, step, lambda a: a["s"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(first + F.log(total)))


def certified(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): certified cutoffs from ``good(stratum, <metrics>)``, rows that must not be rejected."""
    rules = list(GRID)
    counts = [F.count(F.when(F.col(r) > c, 1)).alias(f"{r}:{i}") for r in rules for i, c in enumerate(GRID[r])]
    sums = good.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    entries = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}:{i}").alias("k")) for r in rules for i, c in enumerate(GRID[r])))
    strata = sums.agg(F.count("*").alias("strata"))
    rows = sums.select("stratum", "n", F.explode(entries).alias("e")).select("stratum", "n", "e.*").join(F.broadcast(strata))  # strata: one row
    passed = binomial_tail(F.col("k"), F.col("n").cast("double"), alpha / len(rules)) <= delta / (len(rules) * F.col("strata"))
    rows = rows.withColumn("passed", passed)
    failed = F.min(F.when(~F.col("passed"), F.col("i"))).alias("failed")
    first = rows.groupBy("stratum", "rule").agg(failed, F.collect_list(F.struct("i", "cutoff")).alias("all"))  # a row for each cutoff of the grid
    used = F.array_max(F.filter("all", lambda e: F.col("failed").isNull() | (e["i"] < F.col("failed"))))
    return first.select("stratum", "rule", used["cutoff"].alias("cutoff")).where("cutoff IS NOT NULL")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: doc_id, the base counts, base_failed, kept, rejected_by.

    Strata are languages (null: empty). labels(doc_id, quality): rows with quality 1 are good; of several for an id
    any good one counts. Base-failed documents are rejected whatever the rules say and take no part in certifying.
    Null text has no words. Null ids have no label. Repeated rows are judged each for itself; empty tables are no
    special case. Other columns are ignored.
    """
    cast = F.col("doc_id").cast("long").alias("doc_id")
    stats = text_stats(docs.select(cast, "text", F.coalesce("lang", F.lit("")).alias("stratum"))).drop("text")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).withColumns(metrics())
    stats = written(stats)  # read twice: to certify and to judge
    good_ids = labels.where("quality = 1").select(cast).distinct()
    good = stats.where(~F.col("base_failed")).join(good_ids, "doc_id", "left_semi")
    limits = certified(good.select("stratum", *GRID), alpha, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))  # one entry a rule
    stats = stats.join(limits, "stratum", "left")
    broken = F.array_compact(F.array(*(F.when(F.col(r) > F.col("limits")[r], F.lit(r)) for r in GRID)))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), broken.alias("rejected_by"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by")


#: Of the second query: a share of false rejections at which rules act on small tables as well.
LOOSE_ALPHA = 0.4


def quality_rules_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a looser level, so that the rules' verdicts are compared where few labels would let none act."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), LOOSE_ALPHA).drop("rejected_by")


def _oracle(alpha: float) -> str:
    """The query in DuckDB SQL, with binomial sums term by term."""
    rules = list(GRID)
    grid = ", ".join(f"('{r}', {i}, {float(c)!r}::DOUBLE)" for r in rules for i, c in enumerate(GRID[r]))
    p, level = alpha / len(rules), f"{DELTA!r} / ({len(rules)} * (SELECT count(DISTINCT stratum) FROM good))"
    space = r"[\x20\x09-\x0D]+"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, list_filter(string_split_regex(text, '{space}'), lambda w: w <> '') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
b AS (SELECT doc_id, stratum, words, len(words) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals FROM a),
w AS (SELECT doc_id, i, words[i : i + 4] AS win FROM (SELECT doc_id, words, unnest(range(1, n_words - 3)) AS i FROM b WHERE n_words >= 5)),
twice AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM twice) GROUP BY 1),
s AS (SELECT b.* EXCLUDE (words), coalesce(n_repeat_words, 0) AS n_repeat_words FROM b LEFT JOIN covered USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_share, CASE WHEN word_chars > 0 THEN n_capitals::DOUBLE / word_chars ELSE 0 END AS capital_share,
  CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars FROM s),
long AS (SELECT doc_id, stratum, base_failed, unnest([{", ".join(f"{{'rule': '{r}', 'x': {r}}}" for r in rules)}], recursive := true) FROM m),
good AS (SELECT * FROM long WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
grid(rule, i, cutoff) AS (VALUES {grid}),
k AS (SELECT stratum, g.rule, i, cutoff, count(*) AS n, count(*) FILTER (WHERE x > cutoff) AS k FROM good JOIN grid g USING (rule) GROUP BY ALL),
ok AS (SELECT *, k < n * {p!r} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r})))) <= {level} AS passed FROM k),
used AS (SELECT stratum, rule, arg_max(cutoff, i) AS cutoff FROM (SELECT *, min(CASE WHEN NOT passed THEN i END) OVER (PARTITION BY stratum, rule) AS failed FROM ok) WHERE failed IS NULL OR i < failed GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM long JOIN used USING (stratum, rule) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""


ORACLE_SQL, LOOSE_SQL = _oracle(ALPHA), _oracle(LOOSE_ALPHA)
