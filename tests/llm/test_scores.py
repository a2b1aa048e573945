import functools
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basewright.llm import brown, kneser_ney, mixing, risk_rules


def texts(n, seed=0):
    rng = random.Random(seed)
    vocab = [["ka", "ke", "ki", "ko", "ku", "kaka"], ["le", "la", "lo", "li", "lulu"]]
    return [" ".join(rng.choice(vocab[i % 2]) if rng.random() < 0.95 else f"r{rng.randrange(40)}{i % 2}" for _ in range(rng.randrange(1, 60))) for i in range(n)]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def brown_words(t):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w]


def brown_brute(docs, m, type_of):
    """Scores by definition, given the classes that the exchange found."""
    end = len(m.mass) - 1
    kind = lambda w: type_of.get(w, m.n_core + zlib.crc32(w.decode()[-3:].encode()) % brown.ENDINGS)
    classes = lambda w: [m.of_type[end]] * 2 + [m.of_type[kind(x)] for x in w] + [m.of_type[end]]
    train = [brown_words(t) for i, t in docs if not held(i)]
    c = Counter(x for w in train for x in w)
    mass, once, width = Counter(), Counter(), int(m.of_type[end]) + 1
    for x, n in c.items():
        mass[kind(x)] += n
        once[kind(x)] += (n == 1) * (x not in type_of)
    in_class = Counter()
    for t in range(end):
        in_class[m.of_type[t]] += mass[t] + 0.5
    trigrams = np.zeros((width, width, width), int)
    for w in train:
        path = classes(w)
        for x in zip(path, path[1:], path[2:]):
            trigrams[x] += 1
    steps, out = brown.transitions(trigrams), []
    for i, t in docs:
        w = brown_words(t)
        path = classes(w)
        value = sum(steps[x] for x in zip(path, path[1:], path[2:]))
        for x in w:
            t = kind(x)
            value += math.log10((mass[t] + 0.5) / in_class[m.of_type[t]])
            if x not in type_of:
                unknown = (once[t] + 0.5) / (mass[t] + 1) if mass[t] else 1
                value += math.log10((1 - unknown) * c[x] / mass[t] if c[x] else unknown)
        out.append((i, value))
    return out


def test_brown_scores(spark):
    docs = [(i, t) for i, t in enumerate(texts(300))] + [(1000, None), (1001, ""), (1002, "KA KaÉ ka\u0085x"), (5, "repeated id"), (1003, "ka ka ka le le novel " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).repartition(3)
    c = Counter(w for i, t in docs if not held(i) for w in [*brown_words(t), None])
    total, distinct = sum(c.values()), len(c)
    want = Counter()
    for i, t in docs:
        w = [*brown_words(t), None]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)] += 1
    all_scores = []
    for most_sent in (brown.MOST_SENT, 5):  # all words of the core sent, and most of them joined
        m, scores = brown.fit_and_score(df, 4, 3, 0.095, most_sent, brown.TOLERANCE)
        assert m.whole == (most_sent > 5) and 0 < m.n_head < 11 < m.n_core
        got = scores.collect()
        assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
        type_of = {bytes(w): t for w, _, t in m.top} | {bytes(r["word"]): r["type"] for r in m.lexicon.where("type IS NOT NULL").collect()}
        assert set(type_of) == {w for w, n in c.items() if w and n >= 3} and sorted(type_of.values()) == list(range(m.n_core))
        assert Counter((i, round(v, 3)) for i, v in brown_brute(docs, m, type_of)) == Counter((r["doc_id"], round(r["score"], 3)) for r in got)
        out = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) and all(r["score"] < 0 for r in got)
        all_scores.append(Counter((r["doc_id"], round(r["score"], 3)) for r in got))
    assert all_scores[0] == all_scores[1]


def test_brown_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert brown.score(empty, classes=2).count() == 0
    i = next(i for i in range(100) if held(i))
    r = brown.score(spark.createDataFrame([(i, "a b")], "doc_id long, text string"), classes=2).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])


def test_exchange_of_middle_words_against_plain_counts(spark):
    rng = np.random.default_rng(2)
    n, first, width = 40, 4, 4  # types 4 .. 33 are the middle, 39 the end
    fixed = np.append(rng.integers(0, width - 1, n - 1), width - 1).astype(np.uint8)
    seqs = [rng.choice(n - 1, rng.integers(0, 30), p=np.r_[np.full(20, 1.5), np.full(19, 0.5)] / 39.5).astype(np.int32) for _ in range(200)]
    coded = spark.createDataFrame([(bytearray(x.tobytes()),) for x in seqs], "codes binary").repartition(3)
    middle = brown.Middle(first, 30, 100)
    middle.parts, middle.size = 4, 8
    near, between = brown.count_neighbours(coded, fixed, middle, width)
    flat = np.concatenate([[n - 1], *(np.append(x, n - 1) for x in seqs)])
    values = lambda of: np.bincount(of[flat[:-1]].astype(int) * width + of[flat[1:]], minlength=width * width).reshape(width, width)
    seen = []
    inner = brown.Rounds.ended

    def spy(self, matrix, now):
        assert (matrix == values(now)).all()
        seen.append(brown.likelihood(matrix))
        return inner(self, matrix, now)

    brown.Rounds.ended = spy
    try:
        best = brown.exchange_middle(near, between, fixed, middle, width, tolerance=1e-4)
    finally:
        brown.Rounds.ended = inner
    assert brown.likelihood(values(best)) == max(seen) > seen[0] and len(seen) > 2
    assert (best[:first] == fixed[:first]).all() and (best[34:] == fixed[34:]).all() and (best[first:34] < width - 1).all()


def test_exchange_gain_is_the_likelihood_change():
    rng = np.random.default_rng(0)
    n, classes = 12, 3
    big = rng.integers(0, 20, (n, n))
    own = np.append(rng.integers(0, classes, n - 1), classes)

    def value(of):
        m = np.zeros((classes + 1, classes + 1))
        np.add.at(m, (of[:, None].repeat(n, 1), of[None, :].repeat(n, 0)), big)
        return m, brown._xlogx(m).sum() - brown._xlogx(m.sum(0)).sum() - brown._xlogx(m.sum(1)).sum()

    m, before = value(own)
    for w in range(n - 1):
        others = np.arange(n) != w
        left, right = (np.bincount(own[others], x[others], classes + 1) for x in (big[:, w], big[w, :]))
        to, gain = brown.best_classes(own[w], left, right, big[w, w], m)
        after = [value(np.where(np.arange(n) == w, c, own))[1] for c in range(classes)]
        assert gain == pytest.approx(max(after) - before, abs=1e-6) and after[to] == pytest.approx(max(after))


def test_transitions_are_distributions():
    p = 10 ** brown.transitions(np.random.default_rng(1).poisson(0.5, (5, 5, 5)))
    assert np.allclose(p.sum(2), 1, atol=0.02) and (p > 0).all()


def kn_brute(train, order):
    """Interpolated modified Kneser-Ney by definition: P(c | context) as a function."""
    grams = {order: Counter()}
    for t in train:
        p = kneser_ney.START * (order - 1) + t + kneser_ney.END
        grams[order].update(p[i : i + order] for i in range(len(p) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def discount(k):
        n = Counter(min(c, 5) for c in grams[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [min(max(j - (j + 1) * y * n[j + 1] / n[j] if n[j] else 0.5, 0.05), j - 0.05) for j in (1, 2, 3)]

    d = {k: discount(k) for k in grams}

    def p(g):
        if not g:
            return 1 / (len(grams[1]) + 1)
        k, context = len(g), g[:-1]
        seen = {x: c for x, c in grams[k].items() if x[:-1] == context}
        if not seen:
            return p(g[1:])
        total = sum(seen.values())
        weight = sum(d[k][min(c, 3) - 1] for c in seen.values()) / total
        return (max(seen[g] - d[k][min(seen[g], 3) - 1], 0) / total if g in seen else 0) + weight * p(g[1:])

    return p


def test_kneser_ney_against_the_definition(spark, monkeypatch):
    train = texts(12, 3)
    tests = ["ka le", "", None, "zzz", "KAé ka", train[0], "lo ka zu " * 400]
    monkeypatch.setattr(kneser_ney, "MOST_POSITIONS", 1000)
    p = functools.cache(kn_brute(train, 5))
    small = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    in_parts = kneser_ney.Scorer(*small.sent.value[1:])([t or "" for t in tests])[0]
    want = []
    for t in tests:
        x = kneser_ney.START * 4 + (t or "") + kneser_ney.END
        want.append(sum(math.log(p(x[i - 4 : i + 1])) for i in range(4, len(x))))
    assert np.allclose(in_parts, want, rtol=1e-5)
    df = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string").withColumn("log_p", F.lit("clash"))
    for most in (1 << 20, 60):  # all entries broadcast, and most through the join
        model = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string"), most_sent=most)
        assert model.rest == (most == 60)
        got = kneser_ney.score_texts(df, model).orderBy("doc_id").collect()
        assert np.allclose([r["log_p"] for r in got], want, rtol=1e-5)


def test_classifier_separates_and_keeps(spark):
    good = [(i, t, "x") for i, t in enumerate(texts(300, 5))]
    junk = [(1000 + i, "Q#W$ " * 30, "x") for i in range(20)]
    df = spark.createDataFrame([*good, *junk, (2000, None, None)], "doc_id long, text string, lang string").withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in kneser_ney.quality(df, labels).collect()}
    assert len(got) == 321 and not any(got[1000 + i] for i in range(20))
    assert sum(got[i] for i in range(200, 300)) >= 97
    none = kneser_ney.quality(df, labels.limit(0)).collect()
    assert len(none) == 321 and all(r["kept"] for r in none)
    assert kneser_ney.quality(df.limit(0), labels).count() == 0


def test_all_trusted_documents_are_used(spark):
    n = 20_500
    docs = [(i, f"t{i}", "x") for i in range(n)] + [(7, "again", None), (n, "bad", "x"), (n + 1, "toxic", "x"), (n + 2, "none", "x"), (None, "null", "x")]
    labels = [(i, 1, 0) for i in range(n)] + [(3, 1, 0), (n, 0, 0), (n + 1, 1, 1), (None, 1, 0), (n + 9, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id int, text string, lang string").repartition(4)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Counter((r["text"], r["lang"]) for r in kneser_ney.trusted_documents(df, frame).collect())
    assert got == Counter((t, g) for _, t, g in docs[: n + 1])
    assert kneser_ney.trusted_documents(df, frame.limit(0)).count() == 0


@pytest.mark.parametrize("most_bits", [26, 10, 6])  # sparse filters, crowded ones, and full ones
def test_trusted_texts_are_not_shuffled(spark, monkeypatch, most_bits):
    monkeypatch.setattr(kneser_ney, "MOST_ID_BITS", most_bits)
    docs = [(i, f"t{i}", "x" if i % 2 else None) for i in range(600)] + [(4, "again", "x"), (5, "again", "x"), (None, "null", "x"), (2, None, "x")]
    df = spark.createDataFrame(docs, "doc_id int, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 1), 0) for i in range(600)] + [(2, 1, 0), (7, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = kneser_ney.trusted_documents(df, labels)
        got = Counter((r["text"], r["lang"]) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    trusted = {i for i in range(600) if i % 3 == 1} | {2}
    assert got == Counter((t, g) for i, t, g in docs if i in trusted)
    assert "Exchange" not in plan and "Join" not in plan


def test_quantiles_against_sorted_values(spark):
    rng = random.Random(4)
    groups = {"a": [-rng.random() * 6 for _ in range(900)], "b": [-0.25] * 70 + [-3.0], "": [-1.5], "c": [-rng.randrange(9) / 4 for _ in range(401)], "d": [-2 - i / 1e7 for i in range(333)]}
    rows = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x], "lang string, value double").repartition(5)
    for share in (0.005, 0.5, 0.0, 1.0):
        got = {(r["every"], r["lang"]): (r["n"], r["lowest"]) for r in kneser_ney.quantiles(rows, share).collect()}
        want = {(False, g): x for g, x in groups.items()} | {(True, ""): sum(groups.values(), [])}
        assert got == {g: (len(x), pytest.approx(np.quantile(x, share), abs=1e-12)) for g, x in want.items()}


def rule_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_rule_statistics(spark):
    rng = random.Random(2)
    cases = [None, "", " \n\t", "a", "a b c d", "a b c d e", "x " * 50, "a b c d e f a b c d e g", "é| #ü x <b>&amp;\n\n \nq\nq\nq \n", "l1\nl2\nl1\nl1", "#" * 1000]
    cases += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    cases.append(" ".join(str(i) for i in range(30_000)) + " 1 2 3 4 5")
    got = risk_rules.text_stats(spark.createDataFrame(list(enumerate(cases)), "i int, text string")).orderBy("i").collect()
    for t, r in zip(cases, got, strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == rule_stats(t)


def test_binomial_tail(spark):
    cases = [(k, n) for n in (30, 300, 5000, 60000) for k in {0, 1, n // 100, int(n * 0.019), n // 2}]
    df = spark.createDataFrame([(k, float(n)) for k, n in cases], "k long, n double")
    for r in df.select("k", "n", risk_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("t")).collect():
        n = int(r["n"])
        lg = math.lgamma
        want = math.fsum(math.exp(lg(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(r["k"] + 1))
        assert r["t"] == (1.0 if r["k"] >= n * 0.02 else pytest.approx(want, rel=1e-7))


def test_rules_are_certified_only_with_enough_labels(spark):
    clean = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    docs = [(i, clean(i), "big") for i in range(1500)] + [(5000 + i, clean(i) + " # # # #", "big") for i in range(5)] + [(6000, clean(1) + " # # # #", "small"), (7000, None, None), (7001, "too short", "big")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(6000, 1), (5000, 0), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in risk_rules.judge(df, labels).collect()}
    assert len(got) == len(docs) and all(got[i]["kept"] for i in range(1500))
    assert not any(got[5000 + i]["kept"] for i in range(5)) and got[6000]["kept"]
    assert got[7000]["base_failed"] and not got[7000]["kept"] and got[7001]["base_failed"]
    assert risk_rules.judge(df, labels.limit(0)).where("kept").count() == 1506
    assert risk_rules.judge(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("piece", [1 << 18, 40])
def test_features_against_plain_words(monkeypatch, piece):
    monkeypatch.setattr(mixing, "PIECE", piece)
    rng = random.Random(11)
    words = ["a", "A", "(a)", "Kat,", "kat", "...", "...a", "x1-y", "X1-Y!", "Él", "él", "\x00", "漢字", "don't", "q" * 90, "\x1f\x85", "?"]
    some = [None, "", " \n", *words, *(rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice([" ", "\t", "\r\n ", "\x0b\x0c"]) for _ in range(rng.randrange(1, 80))) for _ in range(150))]
    rows = [x for part in mixing.text_features(iter([pa.array(some[:100]), pa.array([], pa.string()), pa.array(some[100:])])) for x in part.to_pylist()]
    bare = lambda w: w.lower().strip(b".,;:!?\"'()")
    kind = lambda w: frozenset("a" if c >= 128 or 97 <= c <= 122 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else c for c in w)
    last = mixing.BUCKETS - 1024
    of = {t: np.frombuffer(r["at"], np.uint16).tolist() for t, r in zip(some, rows)}
    word_at, kind_at = ({f(w.encode()): of[w][i] for w in words} for f, i in ((bare, 0), (kind, 1)))
    assert len(set(word_at.values())) == len(word_at) and len(set(kind_at.values())) == len(kind_at)
    for t, r in zip(some, rows, strict=True):
        each = (t or "").encode().split()
        assert r["tokens"] == len(each)
        shares = Counter(kind_at[kind(w)] for w in each)
        found = {word_at[bare(w)] for w in each}
        assert np.frombuffer(r["at"], np.uint16).tolist() == [*sorted(found), *sorted(shares), mixing.BUCKETS - 1]
        assert max(found, default=0) < last <= min(shares, default=last)
        want = [*(8 * shares[k] / len(each) for k in sorted(shares)), 1 + 4 * (1 - len(found) / len(each) if each else 0)]
        assert np.allclose(np.frombuffer(r["weight"], np.float32), want, rtol=1e-6)


def test_features_take_no_python_call_a_word():
    rows = pa.array([" ".join(f"w{i}x{k}" for k in range(100)) for i in range(500)])
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        out = list(mixing.text_features(iter([rows])))
    finally:
        sys.setprofile(None)
    assert sum(x["tokens"] for x in out[0].to_pylist()) == 50_000
    assert calls["call"] + calls["c_call"] < 10_000


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 3, 400)
    n = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_tokens long, _posterior array<double>")
    present = (n[:, None] * p).sum(0)
    targets = present * np.array([1.5, 0.5, 0.2])
    past, reached = mixing.fit_rates(members, present, targets, ridge=1e-4, tolerance=1e-7)
    assert np.allclose(reached, targets, rtol=0.02)
    r = np.ones(400)
    for size, d in past:
        r = np.maximum(0, r - size * (p @ d + 1e-4 * (r - 1)))
    got = np.array([x[0] for x in members.select(mixing.rate_after(past, 1e-4, None)).collect()])
    assert r.max() > 1  # no bound but 0
    assert np.allclose(np.sort(got), np.sort(r)) and (got >= 0).all()


def test_rates_meet_targets_with_production_parameters(spark):
    rng = np.random.default_rng(1)
    own = rng.choice(4, 2000, p=[0.8, 0.1, 0.09, 0.01])
    p = 0.15 * np.eye(4)[own] + 0.85 * rng.dirichlet([80, 10, 9, 1], 2000)  # domains overlap, one is rare
    n = rng.integers(1, 500, 2000)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_tokens long, _posterior array<double>")
    present = (n[:, None] * p).sum(0)
    targets = (n * np.where(own == 0, 0.95, 0.4)) @ p  # met by rates within the bounds
    past, reached = mixing.fit_rates(members, present, targets, max_rate=1.0)
    r = np.ones(2000)
    for size, d in past:
        r = np.clip(r - size * (p @ d + mixing.RIDGE * (r - 1)), 0, 1)
    assert np.allclose(reached, (r * n) @ p) and np.allclose(reached, targets, rtol=0.01)  # RIDGE holds the rest back
    deviation = (reached - targets) / present
    gradient = p @ deviation + mixing.RIDGE * (r - 1)
    assert np.abs(np.clip(r - gradient, 0, 1) - r).max() < 1e-5
    with pytest.raises(ArithmeticError):
        mixing.fit_rates(members, present, targets, max_rate=1.0, steps=2)


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    docs = [(i, " ".join(word() for _ in range(30)) + " idiot trash" * (i % 4 == 0) + " spam junk" * (i % 5 == 0)) for i in range(600)]
    labels = [(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    r = mixing.mix(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).first()
    assert np.allclose(r["expected_share"], r["target_share"], atol=0.002)


def test_mixing_and_applying(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    docs = [(i, " ".join(word() for _ in range(30)) + (" idiot trash" if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rate", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in mixing.mix(df, labels, max_rate=1.0).collect()}
    rest = [i for i in range(1, 400, 2)]
    assert len(got) == 402 and np.mean([got[i]["rate"] for i in rest]) > 0.95
    assert np.mean([got[i]["rate"] for i in range(0, 400, 4)]) < 0.5
    assert got[900]["n_tokens"] == 0
    kept = mixing.apply_rates(mixing.mix(df, labels, max_rate=1.0)).select("doc_id", "text").collect()
    assert len({r["doc_id"] for r in kept}) == len(kept) < 402
    flat = mixing.mix(df, labels.limit(0)).select("posterior").first()[0]
    assert np.allclose(flat, 0.25)
    assert mixing.mix(df.limit(0), labels).count() == 0
    twice = spark.createDataFrame([(1, "a", 2.0), (2, "b", 0.0), (3, "c", 1.0)], "doc_id long, text string, rate double")
    assert sorted(r["doc_id"] for r in mixing.apply_rates(twice).collect()) == [1, 1, 3]


def test_loss_and_its_least_value(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((300, 12)) < 0.3, rng.random((300, 12)), 0).astype(np.float32)
    x[:, 11] = 1
    domain = rng.integers(0, 3, 300)
    rows = [(int(d), np.flatnonzero(r).astype(np.uint16).tobytes(), r[r > 0].tobytes()) for d, r in zip(domain, x, strict=True)]
    rows = spark.createDataFrame(rows, "domain int, at binary, value binary").repartition(3).cache()

    def plain(w):
        p = np.exp(x @ w) / np.exp(x @ w).sum(1, keepdims=True)
        return -np.log(p[np.arange(300), domain]).sum(), x.T @ (p - np.eye(3)[domain])

    w = rng.normal(size=(12, 3))
    for got, want in zip(mixing._loss(rows, w), plain(w), strict=True):
        assert np.allclose(got, want, rtol=1e-5, atol=1e-5)
    whole = lambda w: (plain(w)[0] / 300 + 0.005 * (w**2).sum(), plain(w)[1] / 300 + 0.01 * w)
    least = mixing.minimise(whole, np.full((12, 3), 1.0), 1e-12)
    assert np.abs(whole(least)[1]).max() < 1e-5
    with pytest.raises(ArithmeticError):
        mixing.minimise(whole, np.full((12, 3), 1.0), 1e-12, steps=2)
