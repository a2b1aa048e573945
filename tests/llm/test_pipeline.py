import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import brute, shingle_set

import corpus_pipeline
from basewright.llm import containment, kneser_ney, lsh_forest, mixing, tokens
from basewright.llm.common import written

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DIR))
        assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(set(ids)) == len(ids) and set(ids) < before, name
        before = set(ids)
        if name == "near_duplicates":
            assert lsh_forest.near_duplicates(docs).where("n_links > 0 OR n_copies > 1").count() == 0
        if name == "decontaminate":
            assert containment.contained_items(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(before)
    assert out.columns == tokens.token_output(docs).columns


def planted(spark, path):
    """Clean prose and cases for each stage; (rows, ids of rows that each stage has to drop)."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda n=80: " ".join(word() for _ in range(n))
    rows = [(i, text(), "en") for i in range(400)]
    item = text(30)
    rows += [(1000, "$#@ " * 60, "en")]  # junk
    base = text().split()
    rows += [(1100, " ".join(base), "en"), (1101, " ".join(base), "en"), (1102, " ".join([*base[:-1], "changed"]), "en")]  # copies
    rows += [(None, text(20) + " " + item, "en"), (None, text(), "en"), (1, text(), "en"), (1, text(20) + " " + item, "en")]  # leaks beside clean rows of the same id
    rows += [(1200, None, None), (1201, "", "en"), (None, None, None)]
    rows = [(*r, f"rate {k}", k, "x") for k, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string, _key long, n_tokens string")
    docs = docs.withColumns({c: F.col("_key") for c in ("limit", "kept", "perplexity", "posterior", "_tokens", "_keys", "_id", "_row", "row", "text_key", "class_id", "_leak")})
    labels = [(i, 1, 0) for i in range(300)] + [(1000, 0, 0), (None, 1, 0), (1, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, ""), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs.repartition(3)


def test_planted_cases_by_brute_force(spark, tmp_path):
    docs = planted(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    had = {r["_key"]: r for r in docs.collect()}
    item = shingle_set(spark.read.parquet(f"{tmp_path}/benchmark.parquet").where("item_id = 1").first()["text"])
    leaky = lambda r: len(shingle_set(r["text"]) & item) >= 0.8 * len(item)

    def apply(name, rows):
        out = stages[name](spark, rows, str(tmp_path))
        assert out.columns == rows.columns and [f.dataType for f in out.schema] == [f.dataType for f in rows.schema]
        got = out.collect()
        assert all(r == had[r["_key"]] for r in got) and len({r["_key"] for r in got}) == len(got)
        return {r["_key"] for r in got}

    kept = apply("quality", docs)
    lost = [had[k]["doc_id"] for k in set(had) - kept]
    assert 1000 in lost and len(lost) <= 1 + 0.01 * len(had)  # the limit is a quantile of trusted text
    groups = brute([(k, r["text"]) for k, r in had.items()])
    least = {}
    for k, r in had.items():
        at = "empty" if not r["text"] else groups[k][0]
        least[at] = min(least.get(at, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    kept = apply("near_duplicates", docs)
    assert sorted(str((had[k]["doc_id"] is None, had[k]["doc_id"] or 0)) for k in kept) == sorted(map(str, least.values()))
    assert apply("decontaminate", docs) == {k for k, r in had.items() if not leaky(r)}
    kept = apply("mix", docs)
    assert len(kept) > 0.9 * len(had)
    out = stages["token_files"](spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in had.values())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_quality_is_fitted_on_all_trusted_documents(spark, tmp_path, monkeypatch):
    n, seen = 20_300, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"))
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")

    def classify(docs, trusted):
        seen.append(trusted.distinct().count())
        return docs.withColumn("kept", F.lit(True))

    monkeypatch.setattr(kneser_ney, "classify", classify)
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == n and seen == [n]


def test_mixing_is_fitted_on_all_labelled_documents(spark, tmp_path, monkeypatch):
    n, seen = 20_300, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "null"), (n + 5, "no label")], "doc_id long, text string"))
    labels = docs.where("doc_id IS NULL OR doc_id < 20300").select("doc_id", F.expr("int(doc_id % 3 > 0)").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    def fit_classifier(labelled, n_domains):
        seen.append({r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()})
        return np.zeros((mixing.BUCKETS, n_domains))

    monkeypatch.setattr(mixing, "fit_classifier", fit_classifier)
    corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert seen == [{0: n - 6767, 2: 6767}]
