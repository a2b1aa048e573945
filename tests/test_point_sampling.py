"""Windows at random points, cuts at a budget, and diagnostics, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.operators import intervals, kernels, locate, sampling
from basewright.sources.genome import tile_scaffolds

PARTS = "partition string, seqid string, start long, end long, strand string"


def window(lo, hi, point, taken, least, most):
    """sample_window by its words, of the windows taken in the feature."""
    if any(a <= point <= b for a, b in taken):
        return None
    before, after = max((b for _, b in taken if b < point), default=None), min((a for a, _ in taken if a > point), default=None)
    if not taken and least < hi - lo + 1 < most:
        return lo, hi
    start, end = (lo if before is None else before + 1), (hi if after is None else after - 1)
    if end - start + 1 < least:
        return None
    if end - start + 1 <= most:
        return start, end
    c5, c3, total = point - start + 1, end - point + 1, most + 1
    low, high = total // 2, total - total // 2
    k5, k3 = (total - c3, c3) if c3 <= high else (c5, total - c5) if c5 <= low else (low, high)
    return point - k5 + 1, point + k3 - 1


def passes(s):
    n = len(s) // 10
    return set(s) <= set("ACGT") and not any(b * n in s for b in "ACGT")


def test_points_are_taken_in_turn(spark):
    checked, rng = True, random.Random(8)
    seq = {str(i): "".join(rng.choice("ACGTTTTN" if i == 3 else "ACGT") for _ in range(rng.choice([15, 40, 300, 900]))) for i in range(8)}
    parts = []
    for k, s in seq.items():
        cut = len(s) // 3
        parts += [("p", k, 1, cut, "+"), ("p", k, cut + 3, len(s), "-"), ("q", k, 2, len(s), None)]
    rng.shuffle(parts)
    meta = intervals.add_metacoordinates(spark.createDataFrame(parts, PARTS))
    features = [r.asDict() for r in meta.collect()]
    totals = {p: max(f["meta_end"] for f in features if f["partition"] == p) for p in "pq"}
    points = [(p, rng.randrange(1, totals[p] + 1), d) for p in "pq" for d in rng.sample(range(1000), 80)]
    want, taken = set(), {}
    for p, point, d in sorted(points, key=lambda x: x[2]):
        f = next(f for f in features if f["partition"] == p and f["meta_start"] <= point <= f["meta_end"])
        held = taken.setdefault((p, f["seqid"], f["start"]), [])
        w = window(f["start"], f["end"], f["start"] + point - f["meta_start"], held, 20, 45)
        if w and (not checked or passes(seq[f["seqid"]][w[0] - 1 : w[1]])):
            held.append(w)
            want.add((p, f["seqid"], *w, d))
    tiles = tile_scaffolds(spark.createDataFrame(list(seq.items()), "id string, sequence string"), 64) if checked else None
    df = spark.createDataFrame(points, "partition string, point long, draw long").repartition(3)
    got = sampling.windows_at_points(df, meta, tiles, 20, 45, tile=64).collect()
    assert {(r["partition"], r["seqid"], r["start"], r["end"], r["draw"]) for r in got} == want and len(got) == len(want)
    if checked:
        for r in got:
            raw = seq[r["seqid"]][r["start"] - 1 : r["end"]]
            assert r["sequence"] == (raw if r["orientation"] == "+" else raw[::-1].translate(str.maketrans("ACGT", "TGCA")))
    assert sampling.windows_at_points(df.limit(0), meta, tiles, 20, 45, tile=64).count() == 0


def test_samples_at_points_reach_the_budget_or_all_there_is(spark):
    rng = random.Random(2)
    seq = {str(i): "".join(rng.choice("ACGT") for _ in range(400)) for i in range(6)}
    tiles = tile_scaffolds(spark.createDataFrame(list(seq.items()), "id string, sequence string"), 64)
    parts = intervals.add_metacoordinates(spark.createDataFrame([("big" if k != "0" else "small", k, 1, len(s), None) for k, s in seq.items()], PARTS))
    got = sampling.sample_points(parts, tiles, 500, 20, 120, tile=64).collect()
    by = {}
    for r in got:
        by.setdefault((r["partition"], r["seqid"]), []).append((r["start"], r["end"]))
    for spans in by.values():
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and all(20 <= b - a + 1 <= 120 for a, b in spans)
    sums = {p: sum(r["end"] - r["start"] + 1 for r in got if r["partition"] == p) for p in ("big", "small")}
    assert 500 <= sums["big"] < 620 and 200 < sums["small"] <= 400
    assert len({r["start"] % 120 for r in got}) > 2  # not at fixed places


@pytest.mark.parametrize("kind", ["far", "tied"])
def test_cuts_with_skewed_keys(spark, kind, monkeypatch):
    monkeypatch.setattr(sampling, "SPLITTERS", 8)
    rng = random.Random(3)
    key = {"far": lambda: 1e300 if rng.random() < 0.02 else rng.random(), "tied": lambda: rng.choice([1.0, 1.0, 1.0, 2.0]), "plain": rng.random}[kind]
    rows = [(p, str(rng.randrange(4)), 100 * i, 100 * i + rng.randrange(0, 60), None, float(key())) for i, p in enumerate(rng.choices("pq", k=600))]
    df = spark.createDataFrame(rows, f"{PARTS}, k double").repartition(4)
    for budget in (900, 10**6) if kind == "far" else (5000,):
        want = []
        for p in "pq":
            total = 0
            for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[5], r[1], r[2])):
                if total >= budget:
                    break
                total += r[3] - r[2] + 1
                want.append(r)
        assert sorted(map(tuple, sampling.take_budget(df, budget, F.col("k")).collect())) == sorted(want)
    want = {}
    for p in "pq":
        some = sorted((r for r in rows if r[0] == p), key=lambda r: (r[5], r[1], r[2]))
        half, total = sum(r[3] - r[2] + 1 for r in some) // 2, 0
        for r in some:
            total += r[3] - r[2] + 1
            want[r] = "train" if total <= half else "test"
    assert {tuple(r)[:-1]: r["split"] for r in sampling.split_obs_sets(df, key=F.col("k")).collect()} == want


def test_budget_goes_through_all_rows_before_its_cut_only(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(sampling, "written", lambda df, f=sampling.written: kept.append(f(df)) or kept[-1])
    rows = [("p", "s", 10 * i, 10 * i + 9, None, float(i * 7919 % 4001)) for i in range(4000)]
    taken = sampling.take_budget(spark.createDataFrame(rows, f"{PARTS}, k double"), 1000, F.col("k")).collect()
    assert sorted(map(tuple, taken)) == sorted(sorted(rows, key=lambda r: r[5])[:100])
    assert [df.count() for df in kept][0] == 4000 and max(df.count() for df in kept[1:]) < 400


def test_split_of_tied_keys_follows_numbers(spark):
    rows = [("p" if i % 3 else None, i, 1, 1 + 7 * i % 50, i % 2) for i in range(90, 130)] + [("p", 101, 1, 33, 1), ("p", None, 1, 9, None)]
    df = spark.createDataFrame(rows, "partition string, seqid long, start long, end long, k int").repartition(3)
    want = set()
    for p in ("p", None):
        some = [r for r in rows if r[0] == p]
        at = lambda r: (r[4] is None, r[4] or 0, r[1] or 0)
        half = sum(r[3] for r in some) // 2
        want |= {(*r, "train" if sum(x[3] for x in some if at(x) <= at(r)) <= half else "test") for r in some}  # noqa: B023
    assert set(map(tuple, sampling.split_obs_sets(df, key=F.col("k")).collect())) == want


def test_regions_that_repeat_are_fetched_as_often(spark):
    tiles = tile_scaffolds(spark.createDataFrame([("s", "ACGTACGTAC" * 3)], "id string, sequence string"), 8)
    regions = spark.createDataFrame([("s", 3, 21, "+")] * 3 + [("s", 5, 6, "-"), ("s", 5, 6, "-"), ("s", 4, 4, "+")], "seqid string, start long, end long, strand string")
    got = sorted((r["start"], r["sequence"]) for r in locate.fetch_sequence(regions, tiles, tile=8).collect())
    assert got == [(3, ("ACGTACGTAC" * 3)[2:21])] * 3 + [(4, "T")] + [(5, "GT")] * 2


def test_spectrum_of_known_series():
    # the constant published for 25 pairs and a quadratic: exp of minus half the variance of the value at zero
    at = np.vander((4 * np.arange(1, 26) - 1) / 2.0, 3, increasing=True)
    assert np.exp(-(np.pi**2 / 6 - 1) * np.linalg.inv(at.T @ at)[0, 0] / 2) == pytest.approx(0.882, abs=0.002)
    rng = np.random.default_rng(3)
    for phi in (0.0, 0.5, -0.4, 0.8):
        found = []
        for _ in range(60):
            x, e = np.zeros(4000), rng.normal(size=4000)
            for t in range(1, 4000):
                x[t] = phi * x[t - 1] + e[t]
            found.append(kernels.spectrum_at_zero(x))
        assert np.mean(found) == pytest.approx(1 / (1 - phi) ** 2, rel=0.15)
    assert kernels.spectrum_at_zero(np.ones(50)) == 0 and kernels.spectrum_at_zero(np.array([1.0, 2.0])) > 0
