import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from basewright.llm import common, containment, lsh_forest
from basewright.llm.common import SIMILARITY


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    docs, shared = [], " ".join(word() for _ in range(60))
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = base[:]
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy) + (" " + shared if rng.random() < 0.3 else ""))
    docs += [docs[0]] * 3 + ["", None, "", "one two", "one  two", "one two three four five"]
    return list(enumerate(docs))


def brute(docs):
    texts = sorted({t or "" for _, t in docs})
    sets = {t: shingle_set(t) for t in texts}
    links = {t: [u for u in texts if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= SIMILARITY * len(sets[t] | sets[u])] for t in texts}
    root = {}
    for t in texts:
        if t not in root:
            todo, root[t] = [t], t
            while todo:
                for u in links[todo.pop()]:
                    if u not in root:
                        root[u] = t
                        todo.append(u)
    least = {}
    for i, t in docs:
        k = root[t or ""]
        least[k] = min(least.get(k, i), i)
    return {i: (least[root[t or ""]], len(links[t or ""])) for i, t in docs}


def test_join_against_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    for block in (lsh_forest.BLOCK_BYTES, 4096):  # in one block, and in blocks of two texts
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in lsh_forest.near_duplicates(df, block_bytes=block).collect()}
        assert got == want
    copies = {r["doc_id"]: (r["copy_id"], r["n_copies"]) for r in lsh_forest.near_duplicates(df).collect()}
    assert copies[0] == (0, 4)
    kept = lsh_forest.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for c, _ in want.values()})


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(300):
        copy = base[:]
        copy[rng.randrange(80)] = f"x{i}"
        docs.append((i, " ".join(copy)))
    got = lsh_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=100_000).collect()
    want = brute(docs)
    assert {r["class_id"] for r in got} == {0}
    missed = sum(w for _, w in want.values()) - sum(r["n_links"] for r in got)
    assert 0 <= missed <= 0.005 * sum(w for _, w in want.values())


def test_rows_that_repeat_id_and_text_are_sent_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(80)]
    docs = [(None, " ".join(words))] * 500 + [(1, " ".join([*words[:-1], "x"]))] * 300
    sent = []
    verify = lsh_forest.verify

    def counted(units, *rest):
        sent.append(units.groupBy("tree", "prefix", "low", "high").count().agg(F.max("count")).first()[0])
        return verify(units, *rest)

    monkeypatch.setattr(lsh_forest, "verify", counted)
    got = lsh_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sent == [2] and len(got) == 800
    assert {(r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in got} == {(None, 1, 500, 1), (1, 1, 300, 1)}


def test_pairs_belong_to_the_tree_they_meet_deepest_in():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2, (40, 3, 4))
    labels = np.stack([[[hash(tuple(v[:k])) & 0xFFFFFFFF for k in (2, 3, 4)] for v in x] for x in values]).astype(np.uint64)
    common = lambda x, y: next((k for k in range(4) if x[k] != y[k]), 4)
    levels = [lsh_forest.meeting_levels(labels, labels, t) for t in range(3)]
    for i in range(40):
        for j in range(40):
            each = [max(0, common(values[i, t], values[j, t]) - 1) for t in range(3)]
            want = [0, 0, 0]
            want[each.index(max(each))] = max(each)
            assert [int(x[i, j]) for x in levels] == want


def test_prefixes_are_shortened_until_enough_is_known(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    near, far = [], []
    for i in range(120):  # 7,140 pairs at 0.95 or so
        copy = base[:]
        copy[rng.randrange(400)] = f"x{i}"
        near.append((i, " ".join(copy)))
    for i in range(200, 212):  # and some near the threshold
        copy = base[:]
        for _ in range(6):
            copy[rng.randrange(400)] = f"y{i}{rng.random()}"
        far.append((i, " ".join(copy)))
    for docs in (near, near + far):
        want = brute(docs)
        got = lsh_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        missed = sum(w for _, w in want.values()) - sum(r["n_links"] for r in got)
        assert 0 <= missed <= 0.004 * sum(w for _, w in want.values())


def test_depth_and_edges(spark):
    assert 1 - (1 - 0.8 ** lsh_forest.prefix_depth()) ** lsh_forest.TREES >= lsh_forest.RECALL
    assert lsh_forest.prefix_depth(0.8, 12, 8, 0.9999999) < lsh_forest.prefix_depth(0.8, 12, 8, 0.5)
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "only null"), (7, "a b c d e f")], "doc_id long, text string")
    got = lsh_forest.near_duplicates(docs).collect()
    assert len(got) == 5 and {r["class_id"] for r in got} == {7, None}
    clashing = docs.withColumns({c: F.lit(c) for c in ("_text_key", "_key", "_id", "key", "id", "row", "row_id", "text_key", "a.b")})
    kept = lsh_forest.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["row"], r["a.b"]) for r in kept.collect()) == [(0, "only null", "row", "a.b"), (7, "a b c d e f", "row", "a.b")]
    assert lsh_forest.near_duplicates(docs.limit(0)).count() == 0 and lsh_forest.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(20)] + [(bytes([40]), bytes([41])), (bytes([50]), bytes([50]))]
    got = dict((bytes(r["key"])[0], bytes(r["root"])[0]) for r in lsh_forest.components(spark.createDataFrame(edges, "key binary, root binary")).collect())
    assert got == {**dict.fromkeys(range(1, 21), 0), 41: 40}


def contained(docs, items, least_run=1):
    out = set()
    for i, t in docs:
        w = (t or "").encode().split()
        for j, x in items:
            item = shingle_set(x)
            n = len((x or "").encode().split())
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if least_run <= n < 5 else shingle_set(t)
            if item and len(item & own) >= 0.8 * len(item):
                out.add((i, j, len(item & own), len(item)))
    return out


def test_containment_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    items = [(j, " ".join(word() for _ in range(n))) for j, n in enumerate([3, 5, 6, 9, 17, 40, 41, 90, 200, 12])] + [(10, ""), (11, None), (12, "only four words here")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.choice([0, 4, 50, 900]))]
        if i % 2:
            item = items[i % 10][1].split()
            if i % 4 == 1 and len(item) > 30:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(w) + 1)
            w = w[:at] + item + w[at:]
        docs.append((i, " ".join(w)))
    docs += [(100, items[5][1]), (101, None), (102, "only four words here"), (103, "x only four words here"), (104, " ".join(items[7][1].split()[:40]) + " gap " + " ".join(items[7][1].split()[40:]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for bits in (containment.MOST_BITS, 8):  # and with a filter that holds nearly everything
        got = [(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in containment.contained_items(d, b, most_bits=bits).collect()]
        assert len(got) == len(set(got)) and set(got) == contained(docs, items)
    short = [(20, "a"), (21, "b  c"), (22, "one"), (23, "nowhere to be"), (24, "one two three four"), *items]
    more = [*docs, (200, "one two three four"), (201, "x one two\tthree four y one"), (202, "one"), (203, "two one"), (204, "b c"), (205, "c b c a"), (206, "one two three")]
    d2, b2 = spark.createDataFrame(more, "doc_id long, text string").repartition(3), spark.createDataFrame(short, "item_id long, text string")
    for least in (1, 3, 5):
        for some in (b2, b2.where("item_id >= 20")):
            got = [(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in containment.contained_items(d2, some, least_run=least).collect()]
            want = contained(more, [x for x in short if some is b2 or x[0] >= 20], least)
            assert len(got) == len(set(got)) and set(got) == want and {(202, 22, 1, 1), (200, 24, 1, 1)} < want
    again = spark.createDataFrame([(None, items[5][1]), (None, items[5][1]), (None, "clean " * 20), (7, items[6][1]), (7, "clean " * 20)], "doc_id long, text string").withColumn("row", F.lit(1))
    twins = spark.createDataFrame([(None, items[5][1]), (8, items[5][1]), (8, items[6][1])], "item_id long, text string")
    got = sorted(str((r["doc_id"], r["item_id"])) for r in containment.contained_items(again, twins).collect())
    assert got == ["(7, 8)", "(None, 8)", "(None, 8)", "(None, None)", "(None, None)"]
    assert containment.contained_items(d, b.limit(0)).count() == 0 and containment.contained_items(d.limit(0), b).count() == 0


def test_texts_are_handed_to_python_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, inner = spark.conf.get(name), [], common.written
    monkeypatch.setattr(containment, "written", lambda df: seen.append(int(spark.conf.get(name).rstrip("b"))) or inner(df))
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i}") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert containment.contained_items(docs, items).count() == 20
    assert seen[-1] <= 1 << 21 and spark.conf.get(name) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    with common.small_batches(spark):
        texts = spark.range(0, 100, 1, 1).select(F.expr("repeat('x', 100000)"))
        got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(got) >= 4 and max(got) < 1 << 22 and spark.conf.get(name) == before
