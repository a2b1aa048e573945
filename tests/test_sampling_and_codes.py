import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.functions import numbers, sequences
from basewright.operators import coding, sampling
from basewright.plans.queries import QUERIES
from basewright.sources.genome import tile_scaffolds


def trim(lo, hi, point, most):
    c5, c3 = point - lo + 1, hi - point + 1
    while c5 + c3 - 1 > most:
        if c5 >= c3:
            c5 -= 1
        else:
            c3 -= 1
    return point - c5 + 1, point + c3 - 1


def test_sample_window_against_a_loop(spark):
    rng, cases, want = random.Random(3), [], []
    for i in range(400):
        lo = rng.randrange(1, 50)
        hi = lo + rng.randrange(0, 80)
        p = rng.randrange(lo, hi + 1)
        before = rng.choice([None, rng.randrange(lo, p)]) if p > lo else None
        after = rng.choice([None, rng.randrange(p + 1, hi + 1)]) if p < hi else None
        cases.append((i, lo, hi, p, before, after))
        if before is None and after is None and 10 < hi - lo + 1 < 30:
            want.append((lo, hi))
            continue
        s, e = (before + 1 if before is not None else lo), (after - 1 if after is not None else hi)
        want.append(None if e - s + 1 < 10 else trim(s, e, p, 30))
    df = spark.createDataFrame(cases, "i int, lo long, hi long, p long, b long, a long")
    c = {x: F.col(x) for x in ("lo", "hi", "p", "b", "a")}
    got = df.select("i", sampling.sample_window(c["lo"], c["hi"], c["p"], c["b"], c["a"], 10, 30).alias("w")).orderBy("i").collect()
    assert [None if r["w"] is None else tuple(r["w"]) for r in got] == want


def test_samples_do_not_overlap_and_fit(spark):
    rng = random.Random(5)
    seq = {str(i): "".join(rng.choice("ACGT") for _ in range(rng.randrange(30, 700))) for i in range(20)}
    tiles = tile_scaffolds(spark.createDataFrame(list(seq.items()), "id string, sequence string"), 64)
    parts = spark.createDataFrame([("p" if i % 2 else "q", k, 1, len(s), "-" if i % 2 else None) for i, (k, s) in enumerate(seq.items())], "partition string, seqid string, start long, end long, strand string")
    got = sampling.sample_partitions(parts, tiles, 800, 30, 90, tile=64).collect()
    by = {}
    for r in got:
        n = r["end"] - r["start"] + 1
        assert 30 <= n <= 90 and len(r["sequence"]) == n
        raw = seq[r["seqid"]][r["start"] - 1 : r["end"]]
        assert r["sequence"] == (raw if r["orientation"] == "+" else raw[::-1].translate(str.maketrans("ACGT", "TGCA")))
        by.setdefault(r["seqid"], []).append((r["start"], r["end"]))
    for spans in by.values():
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    for p in "pq":
        lengths = [r["end"] - r["start"] + 1 for r in got if r["partition"] == p]
        assert 800 <= sum(lengths) < 800 + 90
    split = {}
    for r in sampling.split_obs_sets(spark.createDataFrame(got)).collect():
        split.setdefault((r["partition"], r["split"]), []).append(r["end"] - r["start"] + 1)
    assert sum(split["p", "train"]) <= 450 and len(split) == 4


@pytest.mark.parametrize("args", [(0, 5, 10), (5, 0, 10), (5, 10, 10)])
def test_sampling_limits(spark, args):
    with pytest.raises(ValueError):
        sampling.sample_partitions(None, None, *args)


def test_golden_codes(spark):
    assert coding.code_bases("ACGT" * 4, 0).tolist() == [1, 2, 3, 4] * 4
    assert coding.code_bases("ACGT" * 4, 2).tolist() == [37, 58, 15, 20] * 3 + [37, 58]
    assert coding.code_bases("TTTTTTT", 2).tolist() == [64] * 5 and coding.code_bases("AC", 2).size == 0
    table = {r["kmer"]: r["code"] for r in coding.compound_alphabet(spark, 2).collect()}
    assert len(table) == 64 and table["AAA"] == 1 and table["ACG"] == 37 and table["TTT"] == 64
    rows = spark.createDataFrame([("x", 2, "ACGTACGT"), ("y", 0, "TT"), ("z", 1, None)], "id string, order int, seq string")
    got = {r["id"]: r["codes"] for r in coding.code_sequences(rows).collect()}
    assert got == {"x": [37, 58, 15, 20, 37, 58], "y": [4, 4], "z": None}
    code = spark.range(1).select(sequences.kmer_code(F.lit("ACG")).alias("a"), sequences.kmer_code(F.lit("ANG")).alias("b")).first()
    assert tuple(code) == (37, None)


def test_identifiers_and_mask(spark):
    df = spark.createDataFrame([("CM002885.2.1",), ("CM002909.2",), ("NC_1",), ("CM0",)], "s string")
    assert [r[0] for r in df.select(sequences.rectify_identifier(F.col("s"))).collect()] == ["1", "25", "NC_1", "CM0"]
    df = spark.createDataFrame([("ACGT" * 6,), ("ACGT" * 5 + "AACG",), ("ACGTN" * 5,), ("ACGT" * 4,), ("",)], "s string")
    assert [r[0] for r in df.select(sequences.mask_check(F.col("s"))).collect()] == [True, False, False, False, False]


def test_windows_that_pass_against_each_window(spark):
    rng = random.Random(5)
    rows = ["".join(c * rng.choice([1, 1, 2, 3, 4, 5, 6, 30]) for c in rng.choices("ACGTACGTACGTN" if i % 2 else "ACGT", k=rng.choice([1, 3, 15, 30, 80]))) for i in range(60)]
    rows += ["ACGT" * n for n in (1, 4, 5, 12, 13, 25)] + ["A" * 49, "A" * 120, "N" * 60, "ACGT" * 20 + "AAAAA" + "CGTA" * 20, "ACGT" * 10 + "N" + "AAAAACCCCC" + "ACGT" * 13]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    for size in (20, 25, 50):
        each = df.select("i", "s", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("s") - (size - 1)))).alias("at"))
        each = each.withColumn("w", F.col("s").substr(F.col("at"), F.lit(size))).groupBy("i").agg(F.count_if(sequences.mask_check(F.col("w"))).alias("want"))
        got = df.withColumn("got", sequences.windows_passing(F.col("s"), size)).join(each, "i").collect()
        assert len(got) == len(rows) and all(r["got"] == r["want"] for r in got)
        assert sum(r["got"] for r in got) > 100


def test_windows_are_counted_and_not_made(spark):
    plan = QUERIES["mask_check_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # a row a window is fifty times the bases


def test_numbers(spark):
    inf = math.inf
    df = spark.createDataFrame([([0.1, 0.1, 0.1],), ([1.0, -inf],), ([-inf, inf],)], "x array<double>")
    got = [r[0] for r in df.select(numbers.lps_array(F.col("x"))).collect()]
    assert got[0] == pytest.approx(0.3) and got[1] == got[2] == -inf
    df = spark.createDataFrame([([0.0, 0.0],), ([-inf, -inf],), ([-1000.0, -1001.0],)], "x array<double>")
    got = [r[0] for r in df.select(numbers.logsumexp(F.col("x"))).collect()]
    assert got[0] == pytest.approx(math.log(2)) and got[1] == -inf and got[2] == pytest.approx(-1000 + math.log(1 + math.exp(-1)))
    df = spark.createDataFrame([([0.7, 0.1, 0.1, 0.1],), ([0.25] * 4,), ([1.0, 0.0, 0.0, 0.0],)], "p array<double>")
    got = [r[0] for r in df.select(numbers.symbol_information(F.col("p"), 0.0)).collect()]
    assert np.allclose([x["score"] for x in got[0]], [0.22512712, 0.03216102, 0.03216102, 0.03216102], atol=1e-8)
    assert np.allclose([x["score"] for x in got[1]], 0) and got[2][0]["tier"] == "strong" and got[2][0]["score"] == pytest.approx(1)
    df = spark.createDataFrame([(0.0,), (1.0,), (0.75,)], "p double")
    assert [r[0] for r in df.select(numbers.mean_run_length(F.col("p"))).collect()] == [0, inf, 4]
    assert df.select(numbers.mean_run_length(F.col("p"), 2000)).collect()[2][0] == pytest.approx(4, rel=0.1)
