import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.llm import repeats


def brute(docs, window):
    """Sorted (id, words, removed, kept) by definition; null ids are greatest."""
    least = {}
    order = lambda i: float("inf") if i is None else i
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(order(i), least.get(key, order(i)))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        out.append((order(i), len(w), len(gone), " ".join(x.decode() for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def corpus(seed, window, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "γ", "d", "日本", "x%d" % rng.randrange(300)])
    passages = [[word() for _ in range(window + rng.randrange(-2, 3 * window))] for _ in range(6)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [word() for _ in range(rng.randrange(0, 2 * window))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(0, window)
                parts += p[a : a + rng.randrange(window // 2, 3 * window)]
        docs.append((rng.randrange(10 * n), rng.choice([" ", "\n", "\t  "]).join(parts)))
    docs += [(5000 + i, docs[3][1]) for i in range(20)]  # exact copies
    docs += [(6000, None), (6001, ""), (6002, " \n"), (None, docs[4][1]), (None, docs[4][1]), (None, "only here " * window)]
    docs += [docs[7], docs[7], (docs[7][0], docs[8][1]), (6003, "same " * 400), (6004, "same " * 300), (6005, "same " * (window - 1))]
    rng.shuffle(docs)
    return docs


def got(df):
    return sorted((float("inf") if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("window", [2, 7, 50])
def test_kept_words_against_definition(spark, window):
    docs = corpus(window, window)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(repeats.remove_repeats(df, window)) == brute(docs, window)


def test_small_chunks_and_a_full_filter_lose_nothing(spark, monkeypatch):
    docs = corpus(11, 10)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, 10)
    assert got(repeats.remove_repeats(df, 10, most_bits=8)) == want  # every window passes the filter
    monkeypatch.setattr(repeats, "CHUNK_WORDS", 300)
    assert got(repeats.remove_repeats(df, 10)) == want
    monkeypatch.setattr(repeats, "SHARDS", 1)
    assert got(repeats.remove_repeats(df, 10)) == want


def test_shared_blocks_in_no_shared_window(spark):
    shared = " ".join("s%d" % k for k in range(6))
    docs = [(i, " ".join("d%d-%d" % (i, k) for k in range(7 * i)) + " " + shared + " end%d" % i) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(repeats.remove_repeats(df, 10)) == brute(docs, 10)


def test_spans_are_the_removed_words(spark):
    docs = corpus(12, 10)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in repeats.remove_repeats(df, 10).where("size(spans) > 0").collect():
        assert r["n_removed"] == sum(s["stop"] - s["start"] for s in r["spans"])
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))  # as long as can be
        assert all(s["stop"] - s["start"] >= 10 for s in r["spans"])


def test_rolling_hashes_tell_windows_apart():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 30, dtype=np.uint64)[rng.integers(0, 30, 4000)]
    for which in (0, 1):
        for n in (1, 3, 25):
            seen = {}
            for k, x in enumerate(repeats.rolling(h, n, which).tolist()):
                assert seen.setdefault(x, tuple(h[k : k + n])) == tuple(h[k : k + n])
            assert len(seen) == len({tuple(h[k : k + n]) for k in range(len(h) - n + 1)})


def test_empty_tables_and_clashing_columns(spark):
    docs = corpus(13, 5, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert repeats.remove_repeats(df.limit(0)).collect() == []
    assert len(repeats.remove_repeats(df.withColumn("text", F.lit(None).cast("string"))).where("n_words = 0 AND kept = ''").collect()) == len(docs)
    names = ("order", "text_key", "spans", "found", "start", "stop", "shard", "kept", "key")
    assert got(repeats.remove_repeats(df.withColumns(dict.fromkeys(names, F.lit("x"))), 5)) == brute(docs, 5)
