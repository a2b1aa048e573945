import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from basewright.llm import reversed_search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, best=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        found = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item_id, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:best])]
    return Counter(out)


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "straße", "été", "x1", "日本語", "a-b", "ÀB", *("w%d" % i for i in range(60))]
    text = lambda most: " ".join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=rng.randrange(1, most)))
    docs = [(i * 3, text(80)) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, " .,;\n"), (None, docs[7][1]), (21, docs[7][1]), (21, docs[7][1]), (2003, "w1 " * 30_000)]
    rng.shuffle(docs)
    items = [(i, text(20)) for i in range(25)] + [(100, None), (101, ""), (102, "?!"), (103, "unseen-words-only zzz"), (3, "w1 w2"), (4, docs[3][1]), (4, docs[3][1]), (None, "w3 x1")]
    return docs, items


def got(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_ranks_and_scores_against_all_pairs(spark):
    docs, items = corpus()
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    want = brute(docs, items)
    assert got(reversed_search.search(left, right)) == want
    assert got(reversed_search.search(left, right, most_postings=40)) == want  # an index of many blocks
    assert got(reversed_search.search(left, right, best=3)) == brute(docs, items, 3)


def test_many_postings_at_a_time_are_cut(spark, monkeypatch):
    docs, items = corpus(1, 40)
    monkeypatch.setattr(reversed_search, "CELLS", 50)
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert got(reversed_search.search(left, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = corpus(2, 30)
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert not got(reversed_search.search(left.limit(0), right))
    assert not got(reversed_search.search(left, right.limit(0)))
    assert not got(reversed_search.search(left.withColumn("text", F.lit(None).cast("string")), right))
    names = ("item", "terms", "codes", "counts", "n", "at", "rank", "score", "block", "df")
    clash = got(reversed_search.search(left.withColumns(dict.fromkeys((*names, "item_id"), F.lit("x"))), right.withColumns(dict.fromkeys((*names, "doc_id"), F.lit("y")))))
    assert clash == brute(docs, items)
