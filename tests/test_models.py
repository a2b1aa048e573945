import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.operators import coding, hmm, jobs, kernels, locate, reports
from basewright.plans import queries, views
from basewright.sources.genome import read_chain_steps, write_chain_steps

CODES = [4, 3, 3, 2, 3, 2, 1, 1, 2, 3, 3, 3, 4, 4, 2, 3, 2, 3, 4, 3, 2]
START = kernels.Model.of([0.5, 0.5], [[0.5, 0.5], [0.5, 0.5]], [[0.25] * 4, [0.7, 0.1, 0.1, 0.1]])
OBS = "obs_id string, order int, seq_id long, codes array<int>"


def brute(m, seq):
    """Plain log-space forward and backward messages, and expected counts."""
    with np.errstate(divide="ignore"):
        la, lA, lB = np.log(m.a), np.log(m.A), np.log(m.B)
    x, k = np.array(seq) - 1, len(m.a)
    lse = lambda v, axis: np.logaddexp.reduce(v, axis=axis)
    f, b = np.zeros((len(x), k)), np.zeros((len(x), k))
    f[0] = la + lB[:, x[0]]
    for t in range(1, len(x)):
        f[t] = lse(f[t - 1][:, None] + lA, 0) + lB[:, x[t]]
    for t in range(len(x) - 2, -1, -1):
        b[t] = lse(lA + (lB[:, x[t + 1]] + b[t + 1])[None, :], 1)
    log_p = lse(f[-1], 0)
    gamma = np.exp(f + b - log_p)
    xi = sum(np.exp(f[t][:, None] + lA + (lB[:, x[t + 1]] + b[t + 1])[None, :] - log_p) for t in range(len(x) - 1))
    symbols = np.stack([[gamma[x == s, i].sum() for s in range(m.B.shape[1])] for i in range(k)])
    return log_p, gamma, xi, symbols


def models(spark, m, **key):
    chain = {"obs_id": "x", "K": len(m.a), "order": 0, "replicate": 1} | key
    return spark.createDataFrame([(*chain.values(), m.a.tolist(), m.A.tolist(), m.B.tolist())], jobs.MODELS)


def test_kernels_against_log_space():
    rng = np.random.default_rng(0)
    m = kernels.Model.of(*jobs.default_model(3, 1, rng))
    seqs = [rng.integers(1, 17, n) for n in (1, 2, 7, 40, 3)]
    wanted = [brute(m, s) for s in seqs]
    assert np.allclose(kernels.log_likelihood(m, seqs), [w[0] for w in wanted])
    for g, w in zip(kernels.posteriors(m, seqs), wanted, strict=True):
        assert np.allclose(g, w[1])
    c = kernels.expected_counts(m, seqs)
    assert np.allclose(c.moves, sum(w[2] for w in wanted)) and np.allclose(c.symbols, sum(w[3] for w in wanted))
    assert np.allclose(c.first, sum(w[1][0] for w in wanted)) and c.n == 5


def test_golden_em_step(spark):
    one = spark.createDataFrame([("x", 0, 1, CODES)], OBS)
    r = hmm.em_step(one, models(spark, START)).first()
    assert r["log_p"] == pytest.approx(-34.6052977460, abs=1e-8)
    assert np.allclose(r["initial"], [0.71428571, 0.28571429], atol=1e-8)
    assert np.allclose(r["transition"], [[0.68133818, 0.31866182], [0.64456596, 0.35543404]], atol=1e-8)
    assert np.allclose(r["emission"], [[0.03733333, 0.304, 0.456, 0.20266667], [0.21350763, 0.24836601, 0.37254902, 0.16557734]], atol=1e-8)
    new = kernels.Model.of(r["initial"], r["transition"], r["emission"])
    assert hmm.set_log_likelihood(one, models(spark, new)).first()["log_p"] == pytest.approx(-26.4424557199, abs=1e-8)
    twice = spark.createDataFrame([("x", 0, 1, CODES), ("x", 0, 2, CODES)], OBS)
    again = hmm.em_step(twice, models(spark, START)).first()
    assert np.allclose(again["transition"], r["transition"]) and np.allclose(again["emission"], r["emission"])
    two = spark.createDataFrame([("x", 0, 1, CODES), ("x", 0, 2, [1, 2, 3, 4] * 5 + [1])], OBS)
    r = hmm.em_step(two, models(spark, START)).first()
    assert r["log_p"] == pytest.approx(-65.2164801716, abs=1e-8)
    assert np.allclose(r["initial"], [0.4887218, 0.5112782], atol=1e-7)
    assert np.allclose(r["transition"], [[0.6335365, 0.3664635], [0.63847764, 0.36152236]], atol=1e-7)
    assert np.allclose(r["emission"], [[0.07977208, 0.2977208, 0.37891738, 0.24358974], [0.37764933, 0.20134875, 0.25626204, 0.16473988]], atol=1e-7)


def test_positional_scores_sum_to_the_total_for_one_state(spark):
    m = kernels.Model.of([1.0], [[1.0]], [[0.4, 0.3, 0.2, 0.1]])
    obs = spark.createDataFrame([("x", 0, 1, [1, 2, 3, 4])], OBS)
    total = math.log(0.4 * 0.3 * 0.2 * 0.1)
    assert sum(hmm.positional_log_likelihood(obs, models(spark, m)).first()["log_lh"]) == pytest.approx(total)
    assert hmm.obs_log_likelihood(obs, models(spark, m)).first()["log_p"] == pytest.approx(total)
    gamma = hmm.state_posteriors(obs, models(spark, START)).first()["gamma"]
    assert np.allclose(np.sum(gamma, 1), 1)


def test_background_likelihood_of_both_strands(spark):
    seq = "ACGTTGCAAC"
    positions = spark.createDataFrame([(1, seq)], "pos_id long, sequence string")
    runs = spark.createDataFrame([(1, 1, 5, 3, -1), (1, 6, 9, 1, 0), (1, 10, 10, 3, 1)], "pos_id long, run_start long, run_end long, partition_code int, strand int")
    frags = locate.fragment_by_partition(positions, runs)
    p = [0.4, 0.3, 0.2, 0.1]
    ms = models(spark, kernels.Model.of([1.0], [[1.0]], [p]), obs_id="exon").unionByName(models(spark, kernels.Model.of([1.0], [[1.0]], [p[::-1]]), obs_id="intergenic"))
    got = {r["position"]: r["log_lh"] for r in hmm.background_likelihood(frags, ms).collect()}
    want = {i + 1: math.log(p[3 - "ACGT".index(b)]) for i, b in enumerate(seq[:9])} | {10: math.log(p[1])}
    assert got == pytest.approx(want)
    wide = models(spark, kernels.Model.of([1.0], [[1.0]], [[1 / 16] * 16]), obs_id="exon", order=1)
    with pytest.raises(Exception, match="0 models for intergenic"):
        hmm.background_likelihood(frags, wide, 1).collect()
    with pytest.raises(Exception, match="2 models for exon"):
        hmm.background_likelihood(frags, ms.unionByName(ms)).collect()
    wide = wide.unionByName(models(spark, kernels.Model.of([1.0], [[1.0]], [[1 / 16] * 16]), obs_id="intergenic", order=1))
    assert sorted(r["position"] for r in hmm.background_likelihood(frags, wide, 1).collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_training_steps_and_resumption(spark, tmp_path):
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("ACGT"), 60, p=[0.4, 0.4, 0.1, 0.1])) + "".join(rng.choice(list("ACGT"), 60, p=[0.1, 0.1, 0.4, 0.4])) for _ in range(6)]
    obs = spark.createDataFrame([("x", i, s) for i, s in enumerate(seqs)], "obs_id string, seq_id long, seq string")
    grid = jobs.job_grid(obs, (1, 2), (0, 1), 2)
    coded = coding.code_job_obs(grid, obs)
    assert coded.count() == 12 and grid.count() == 8
    path, initial = str(tmp_path / "steps"), jobs.init_models(grid)
    none = spark.createDataFrame([], hmm.STEPS)
    first = hmm.train(grid, coded, none, initial, 1e9, 40, lambda s: write_chain_steps(s, path))
    steps = read_chain_steps(spark, path).persist()
    assert steps.count() == first.count()
    assert not jobs.validate_models(steps).where("size(violations) > 0").count()
    assert jobs.validate_chain_steps(steps).where("NOT valid_chain OR NOT valid_step").count() == 0
    by = {}
    for r in steps.orderBy("iterate").collect():
        by.setdefault((r["K"], r["order"], r["replicate"]), []).append(r)
    for chain in by.values():
        assert [r["iterate"] for r in chain] == [1, 2, 3] and not chain[1]["converged"] and chain[2]["converged"]
        assert chain[0]["delta"] == 0 and chain[0]["log_p"] == pytest.approx(chain[1]["log_p"])
    more = hmm.train(grid, coded, steps, initial, 0.1, 40)
    assert more.agg(F.min("iterate")).first()[0] == 4
    both = steps.unionByName(more).persist()
    for chain in by:
        lp = [r["log_p"] for r in both.where((F.col("K") == chain[0]) & (F.col("order") == chain[1]) & (F.col("replicate") == chain[2])).orderBy("iterate").collect()]
        assert all(b >= a - 1e-6 for a, b in zip(lp, lp[1:]))
    plan = {r["action"] for r in jobs.plan_training(grid, both, 0.1).collect()}
    if plan == {"skip"}:
        with pytest.raises(ValueError, match="no job"):
            hmm.train(grid, coded, both, initial, 0.1, 40)
    out = reports.generate_reports(both, coded, obs)
    chains = out["chains"].collect()
    assert len(chains) == 8 and all(len(r["run_lengths"]) == r["K"] for r in chains)
    naive = -720 * math.log(4)
    assert all(r["naive_log_p"] == pytest.approx(naive) for r in chains)
    best = out["partitions"].collect()
    assert len(best) == 1 and best[0]["test_log_p"] == max(r["test_log_p"] for r in chains) and best[0]["replicates"] == [1, 2]
    assert out["states"].count() == best[0]["K"] and {r["status"] for r in reports.convergence_diagnostic(reports.chain_trajectories(both)).collect()} <= {"ok", "short", "error"}
    with pytest.raises(ValueError, match="two steps"):
        reports.generate_reports(both.where("iterate = 1"), coded, obs)


def test_state_matching(spark):
    b1 = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1]]
    b2 = [[0.12, 0.1, 0.68, 0.1], [0.69, 0.11, 0.1, 0.1], [0.1, 0.6, 0.15, 0.15]]
    row = lambda rep, b: ("x", 3, 0, rep, 1, [1 / 3] * 3, [[0.8, 0.1, 0.1], [0.1, 0.7, 0.2], [0.2, 0.2, 0.6]], b, -5.0, 0.0, True)
    steps = spark.createDataFrame([row(1, b1), row(2, b2)], hmm.STEPS)
    matches = reports.match_states(steps)
    got = {r["state"]: (r["rank"], r["other"]) for r in matches.collect()}
    assert got == {1: (1, 2), 3: (2, 1), 2: (3, 3)}
    symbols = [r["symbol"] for r in reports.rank_symbols(steps, matches).where("state = 2").orderBy("rank").collect()]
    assert symbols == [1, 3, 4, 2]
    report = {(r["replicate"], r["state"]): r["autotransition"] for r in reports.replicate_report(steps).collect()}
    assert report == {(1, 1): 0.8, (1, 2): 0.7, (1, 3): 0.6, (2, 1): 0.7, (2, 2): 0.6, (2, 3): 0.8}
    coords = {r["replicate"]: (r["x"], r["y"], r["z"]) for r in reports.matched_state_coords(steps).collect()}
    assert coords == {1: (0.7, 0.1, 0.1), 2: (0.69, 0.1, 0.12)}
    alone = reports.match_states(steps.where("replicate = 1")).collect()
    assert [(r["state"], r["other"]) for r in alone] == [(1, 1), (2, 2), (3, 3)]
    with pytest.raises(ValueError):
        reports.replicate_report(steps.unionByName(steps.withColumn("order", F.lit(1))))


def test_counts_with_kept_and_remade_messages_agree():
    rng = np.random.default_rng(4)
    m = kernels.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3))
    seqs = [rng.integers(1, 5, n) for n in (1, 2, 63, 64, 65, 129, 5000, 5000, 40, 700)]
    a, b = kernels.expected_counts(m, seqs), kernels.expected_counts_whole(m, seqs)
    assert np.allclose(a.first, b.first) and np.allclose(a.moves, b.moves) and np.allclose(a.symbols, b.symbols) and a.n == b.n == 10
    assert np.isclose(a.log_p, b.log_p) and np.isclose(a.symbols.sum(), sum(map(len, seqs)))


def test_steps_go_to_the_table(spark, tmp_path):
    obs = spark.createDataFrame([("p", 0, 1, [4, 3, 3, 2, 3, 2, 1, 1, 2, 3, 3]), ("p", 0, 2, [1, 2, 3, 4, 1, 2])], "obs_id string, order int, seq_id long, codes array<int>")
    grid = jobs.job_grid(obs.select("obs_id"), (1, 2), (0,), 1)
    none = spark.createDataFrame([], hmm.STEPS)
    whole = lambda o, m: hmm.expected_counts(o, m, kernels.expected_counts_whole)
    kept = hmm.train(grid, obs, none, jobs.init_models(grid), max_iterates=4)
    read = hmm.train(grid, obs, none, jobs.init_models(grid), max_iterates=4, em_counts=whole, path=str(tmp_path / "steps"))
    key = lambda df: sorted((r["K"], r["iterate"], round(r["log_p"], 6)) for r in df.collect())
    assert key(kept) == key(read) and len(key(kept)) >= 6


def test_models_jobs_and_diagnostics(spark):
    good = ([0.2, 0.3, 0.2, 0.3], [[0.25] * 4] * 4, [[0.25] * 4] * 4)
    cases = [good, ([0.2, 0.3, 0.2, 0.2], *good[1:]), (good[0], [[0.25] * 4] * 5, good[2]), (*good[:2], [[0.25] * 4] * 3 + [[0.2] * 5]), (*good[:2], [[0.25] * 4] * 5), (good[0], [[0.2] * 4] * 4, good[2])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, initial array<double>, transition array<array<double>>, emission array<array<double>>")
    assert [bool(r["violations"]) for r in jobs.validate_models(df).orderBy("i").collect()] == [False] + [True] * 5
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        jobs.validate_models(df, strict=True).collect()
    grid = jobs.job_grid(spark.createDataFrame([("e",), ("p",), ("i",)], "obs_id string"), (1, 2, 4, 6), (0, 1, 2), 4)
    assert grid.count() == 144 and jobs.code_jobs(grid).count() == 9
    assert jobs.select_jobs(grid, (1, 2), (0, 0)).count() == 24
    black = grid.where("replicate = 1")
    assert jobs.select_jobs(grid, (1, 6), (0, 2), black, grid.where("obs_id = 'e'")).count() == 36
    with pytest.raises(ValueError):
        jobs.select_jobs(grid, (0, 2), (0, 0))
    assert jobs.init_models(grid).where("size(emission[0]) != pow(4, order + 1)").count() == 0
    assert kernels.cramer_von_mises_p(0.461) == pytest.approx(0.05, abs=0.002)
    rng = np.random.default_rng(2)
    assert kernels.heidelberger_welch(5 + rng.normal(size=400) * 0.1)[0]
    assert not kernels.heidelberger_welch(np.linspace(0, 100, 400))[0]
    values = spark.createDataFrame([("k", 1, 2.0), ("k", 1, 1.0), ("k", 3, 1.0)], "key string, symbol int, weight double")
    assert [(r["symbol"], r["p"]) for r in hmm.weighted_categorical_mle(values, 4).orderBy("symbol").collect()] == [(1, 0.75), (2, 0.0), (3, 0.25), (4, 0.0)]


def test_queries_take_whole_texts(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n)) for n in (30, 700, 1500)] + ["a" * 400]
    spark.createDataFrame([(i, "xx", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    m = kernels.Model.of(queries._A2, queries._MOVES2, queries._B2)
    bases = {r["seq_id"]: r["seq"] for r in views.seqs(spark, str(tmp_path)).collect()}
    wanted = {i: brute(m, ["ACGT".index(c) + 1 for c in s]) for i, s in bases.items()}
    assert max(map(len, bases.values())) > 1000
    got = {r["seq_id"]: r["log_p"] for r in queries.QUERIES["obs_log_likelihood"](spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(w[0]) for i, w in wanted.items()}
    gamma = {r["seq_id"]: r for r in queries.QUERIES["state_posteriors"](spark, str(tmp_path)).collect()}
    assert {i: len(next(x for x in r if isinstance(x, list))) for i, r in gamma.items()} == {i: len(s) for i, s in bases.items()}
    assert all(np.allclose(next(x for x in r if isinstance(x, list)), wanted[i][1]) for i, r in gamma.items())
    windows = [s[i : i + 50] for s in (r["seq"] for r in views.seqs(spark, str(tmp_path), views.BASES_N).collect()) for i in range(max(1, len(s) - 49))]
    good = [w for w in windows if set(w) <= set("ACGT") and not any(b * (len(w) // 10) in w for b in "ACGT")]
    (r,) = queries.QUERIES["mask_check_windows"](spark, str(tmp_path)).collect()
    assert (r["n"], r["accepted"]) == (len(windows), len(good))


def test_replicate_sets_are_reported_each_for_itself(spark):
    b1 = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1]]
    b2 = [[0.12, 0.1, 0.68, 0.1], [0.69, 0.11, 0.1, 0.1], [0.1, 0.6, 0.15, 0.15]]
    row = lambda obs, order, rep, it, b: (obs, 3, order, rep, it, [1 / 3] * 3, [[0.8, 0.1, 0.1], [0.1, 0.7, 0.2], [0.2, 0.2, 0.6]], b, -5.0, 0.0, True)
    sets = [[row("x", 0, 1, 1, b1), row("x", 0, 2, 1, b2)], [row("x", 1, 2, 1, b2), row("x", 1, 3, 1, b1)], [row("y", 0, 1, i, b2) for i in (1, 2)]]
    every = spark.createDataFrame([r for s in sets for r in s], hmm.STEPS)
    each = [spark.createDataFrame(s, hmm.STEPS) for s in sets]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(reports.replicate_reports(every)) == sorted(r for s in each for r in rows(reports.replicate_report(s)))
    coords = {tuple(r)[:5]: tuple(r)[5:] for r in reports.matched_state_coords(every).collect()}
    assert coords["x", 3, 0, 2, 1] == (0.69, 0.1, 0.12) and coords["y", 3, 0, 1, 2] == (0.12, 0.69, 0.1)
    coded = spark.createDataFrame([(o, k, 1, [1, 2, 3, 4]) for o in "xy" for k in (0, 1)], OBS)
    obs = spark.createDataFrame([("x", 1, "ACGT"), ("y", 1, "ACGT")], "obs_id string, seq_id long, seq string")
    both = every.unionByName(every.withColumn("iterate", F.col("iterate") + 2))
    got = reports.generate_reports(both, coded, obs)
    best = got["partitions"].select("obs_id", "K", "order")
    want = both.join(best, ["obs_id", "K", "order"], "left_semi").select("obs_id", "order", "replicate", "iterate")
    assert rows(got["replicates"].select(*want.columns).distinct()) == rows(want)


def test_replicate_queries_take_all_steps(spark):
    steps = queries._steps(spark, "/root/testdata/sf0.001")
    chains = lambda df: df.select(*jobs.CHAIN, "iterate").distinct().count()
    assert chains(queries.QUERIES["replicate_report"](spark, "/root/testdata/sf0.001")) == chains(steps)
    assert chains(queries.QUERIES["matched_state_coords"](spark, "/root/testdata/sf0.001")) == chains(steps.where("K >= 3"))


def test_train_query_goes_on_to_convergence_on_a_share_of_the_bases(spark, monkeypatch):
    dir_ = "/root/testdata/sf0.001"
    given = []
    monkeypatch.setattr(hmm, "train", lambda *args, **options: given.append((args, options)))
    queries.QUERIES["train"](spark, dir_)
    ((args, options),) = given
    assert len(args) == 4 and options.keys() <= {"path"}  # the operator's own threshold and limit
    bases = dict(views.seqs(spark, dir_).groupBy("obs_id").agg(F.sum(F.length("seq"))).collect())
    taken = dict(queries._samples(spark, dir_).groupBy("partition").agg(F.sum(F.length("sequence"))).collect())
    assert all(taken[k] >= 0.1 * n for k, n in bases.items()) and max(taken.values()) > 20_000
    assert all(taken[k] <= max(5000, 0.1 * n) + 301 for k, n in bases.items())


def test_few_partial_counts_are_summed_without_a_shuffle(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(p, o, i, rng.integers(1, 5, 30).tolist()) for p in "pq" for o in (0, 1) for i in range(8)]
    obs = spark.createDataFrame(rows, "obs_id string, order int, seq_id long, codes array<int>")
    live = {(p, k, 0, 1): kernels.Model.of(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(4), k)) for p in "pq" for k in (1, 2)}
    few = hmm._step_counts(obs, live)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(hmm, "MOST_PARTIAL_ROWS", 0)
    many = hmm._step_counts(obs, live)
    assert "Exchange" in many._jdf.queryExecution().executedPlan().toString()
    a, b = hmm._assembled(few, live), hmm._assembled(many, live)
    assert a.keys() == b.keys() == live.keys()
    for c in live:
        assert np.isclose(a[c][1], b[c][1]) and all(np.allclose(getattr(a[c][0], x), getattr(b[c][0], x)) for x in "aAB")

    def broken(step, log):
        raise OSError("no space")

    monkeypatch.setattr(hmm, "write_iteration", broken)  # a commit that fails beside the next iteration ends the run
    grid = jobs.job_grid(obs.select("obs_id"), (1,), (0,), 1)
    with pytest.raises(OSError, match="no space"):
        hmm.train(grid, obs, spark.createDataFrame([], hmm.STEPS), jobs.init_models(grid), path=str(tmp_path / "steps"))


def test_a_state_has_its_numbers_side_by_side():
    m = kernels.Model.of([0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]])
    s = kernels.Stretches(m, [np.array([1, 2, 3]), np.array([4] * 600)])
    assert [x[3].shape[1] for x in s.messages()] == [2]  # [steps, K, stretches]
