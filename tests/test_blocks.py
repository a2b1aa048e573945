"""Sequences in blocks, packs of models, the step log, and FASTA files read by lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.operators import blocks, coding, hmm, jobs, kernels
from basewright.sources import genome
from test_models import OBS, models


def model(k, order, seed):
    rng = np.random.default_rng(seed)
    return kernels.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(4 ** (order + 1)), k))


def sequences(seed=0):
    rng = np.random.default_rng(seed)
    return {i: "".join(rng.choice(list("ACGT"), n)) for i, n in enumerate((1, 2, 49, 50, 51, 100, 333, 1))}


def rounded(rows, *names):
    flat = lambda v: tuple(map(flat, v)) if isinstance(v, list) else round(v, 8) if isinstance(v, float) else v
    return sorted(tuple(flat(r[n]) for n in names) for r in rows)


def test_blocks_give_what_whole_sequences_give(spark):
    seqs = sequences()
    rows = spark.createDataFrame([("x", 1, i, s) for i, s in seqs.items()], "obs_id string, order int, seq_id long, seq string")
    whole = coding.code_sequences(rows)
    ms = models(spark, model(3, 1, 1), order=1).unionByName(models(spark, model(1, 1, 2), order=1, replicate=2))
    cut = blocks.cut_blocks(whole, 50).repartition(3)
    assert cut.count() == 15  # of 0, 1, 48, 49, 50, 99, 332 and 0 codes
    likelihood = ("K", "replicate", "seq_id", "log_p")
    assert rounded(hmm.obs_log_likelihood(cut, ms).collect(), *likelihood) == rounded(hmm.obs_log_likelihood(whole, ms).collect(), *likelihood)
    for f, c in ((hmm.state_posteriors, "gamma"), (hmm.positional_log_likelihood, "log_lh")):
        parts = {}
        for r in sorted(f(cut, ms).collect(), key=lambda r: r["block"]):
            parts.setdefault((r["K"], r["seq_id"]), []).extend(r[c])
        want = {(r["K"], r["seq_id"]): r[c] for r in f(whole, ms).collect()}
        assert parts.keys() == want.keys() and all(np.allclose(parts[k], want[k], atol=1e-9) for k in want)
    counts = ("K", "kind", "i", "j", "value")
    assert rounded(hmm.expected_counts(cut, ms).collect(), *counts) == rounded(hmm.expected_counts(whole, ms).collect(), *counts)
    assert rounded(hmm.em_step(cut, ms).collect(), "K", "transition", "log_p") == rounded(hmm.em_step(whole, ms).collect(), "K", "transition", "log_p")


@pytest.mark.parametrize("order", [0, 2])
def test_tiles_are_coded_as_whole_sequences(spark, order):
    seqs = sequences(3)
    tiles = genome.tile_scaffolds(spark.createDataFrame([(str(i), s) for i, s in seqs.items()], "id string, sequence string"), 10).withColumn("obs_id", F.lit("x"))
    got = {}
    last = {}
    for r in blocks.code_tiles(tiles, order).orderBy("seq_id", "block").collect():
        assert r["block"] == (last[r["seq_id"]][0] + 1 if r["seq_id"] in last else 0) and not last.get(r["seq_id"], (0, False))[1]
        got.setdefault(int(r["seq_id"]), []).extend(r["codes"])
        last[r["seq_id"]] = r["block"], r["last"]
    assert {i: c for i, c in got.items() if c} == {i: coding.code_bases(s, order).tolist() for i, s in seqs.items() if len(s) > order}
    assert all(x for _, x in last.values())


def test_stretches_agree_with_step_by_step():
    rng = np.random.default_rng(6)
    for k in (1, 2, 5):
        m = model(k, 0, k)
        seqs = [rng.integers(1, 5, n) for n in (511, 512, 513, 1, 3000, 1024)]
        a, b = kernels.expected_counts(m, seqs), kernels.expected_counts_whole(m, seqs)
        assert np.allclose(a.moves, b.moves, rtol=1e-9) and np.allclose(a.symbols, b.symbols, rtol=1e-9) and np.allclose(a.first, b.first, rtol=1e-9)
        assert np.isclose(a.log_p, b.log_p, rtol=1e-12) and np.isclose(kernels.log_likelihood(m, seqs).sum(), b.log_p, rtol=1e-12)
    # states that never meet, and sequences that cannot be
    apart = kernels.Model.of([1, 0], np.eye(2), [[0.9, 0.05, 0.03, 0.02], [0.02, 0.03, 0.05, 0.9]])
    assert kernels.log_likelihood(apart, [np.full(5000, 4)])[0] == pytest.approx(5000 * np.log(0.02))
    never = kernels.Model.of([1, 0], np.eye(2), [[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]])
    assert kernels.log_likelihood(never, [np.array([1, 3] * 600), np.array([], int)]).tolist() == [-np.inf, 0]


def test_models_go_in_packs(spark, monkeypatch):
    obs = spark.createDataFrame([("x", 0, 1, [1, 2, 3, 4, 4, 1]), ("y", 0, 2, [2, 2, 1])], OBS)
    ms = {(o, 2, 0, r): model(2, 0, r) for o in "xy" for r in (1, 2, 3)}
    counts = ("obs_id", "replicate", "kind", "i", "j", "value")
    want = rounded(hmm.expected_counts(obs, ms).collect(), *counts)
    monkeypatch.setattr(hmm, "MOST_MODEL_BYTES", 300)
    assert len(hmm.packs(ms)) == 3 and max(sum(map(len, p.values())) for p in hmm.packs(ms)) == 2
    assert rounded(hmm.expected_counts(obs, ms).collect(), *counts) == want
    assert hmm.obs_log_likelihood(obs, ms).count() == 6


def test_partitions_hold_like_numbers_of_codes(spark):
    rng = np.random.default_rng(2)
    rows = [("x", 0, i, [1] * int(n)) for i, n in enumerate(np.minimum(2000, rng.pareto(0.8, 3000) * 5))]
    df = spark.createDataFrame(rows, OBS).repartition(1)
    out = coding.balanced(df, 8)
    sums = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.sum(F.size("codes")).alias("n")).collect()]
    assert len(sums) == 8 and max(sums) < 2 * np.median(sums)
    assert rounded(out.collect(), "seq_id", "codes") == rounded(df.collect(), "seq_id", "codes")


def test_a_killed_run_leaves_no_step_twice(spark, tmp_path):
    obs = spark.createDataFrame([("p", 0, 1, [4, 3, 3, 2, 3, 2, 1, 1, 2, 3, 3]), ("p", 0, 2, [1, 2, 3, 4, 1, 2])], OBS)
    grid = jobs.job_grid(obs.select("obs_id"), (1, 2), (0,), 1)
    none, initial, path = spark.createDataFrame([], hmm.STEPS), jobs.init_models(grid), str(tmp_path / "steps")
    key = lambda df: sorted((r["K"], r["iterate"], round(r["log_p"], 8)) for r in df.collect())
    want = key(hmm.train(grid, obs, none, initial, 1e-9, 6))
    made = []

    def killed(step):
        made.append(step)
        if len(made) == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        hmm.train(grid, obs, none, initial, 1e-9, 6, killed, path=path)
    left = genome.read_chain_steps(spark, path)
    assert key(left) == [x for x in want if x[1] <= 3]
    resumed = key(hmm.train(grid, obs, left, initial, 1e-9, 6, path=path))  # goes on after what is there
    assert len({x[:2] for x in resumed}) == len(resumed) and [x for x in resumed if x[0] == 2] == [x for x in want if x[0] == 2]
    assert key(hmm.train(grid, obs, none, initial, 1e-9, 6, path=path)) == want  # replaces all of it
    genome.compact_chain_steps(spark, path, str(tmp_path / "less"))
    assert key(genome.read_chain_steps(spark, str(tmp_path / "less"))) == want
    assert genome.read_chain_steps(spark, str(tmp_path / "nothing")).count() == 0


def test_fasta_records_in_many_splits(spark, tmp_path):
    seqs = sequences(9)
    for name, width in (("a", 7), ("b", 60)):
        text = "".join(f">{name}{i} of {name}\n" + "".join(s[k : k + width].lower() + "\n" for k in range(0, len(s), width)) for i, s in seqs.items())
        (tmp_path / name).write_text(text + ">empty\n" + (">CM002885.2.1 last\nAC GT\r\nNN\n" if name == "b" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = genome.tile_scaffolds(genome.read_fasta(spark, str(tmp_path)), 64)
    names = ("seqid", "tile", "tile_start", "seq")
    want = rounded(want.where("seq != ''").collect(), *names)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        got = genome.read_fasta_tiles(spark, str(tmp_path), 64)
        assert got.rdd.getNumPartitions() >= 1 and rounded(got.collect(), *names) == want
        assert {r["description"] for r in got.collect()} == {"of a", "of b", "last"}
        (tmp_path / "c").write_text("ACGT\n>x\nA\n")
        with pytest.raises(Exception, match="before the first header"):
            genome.read_fasta_tiles(spark, str(tmp_path / "c"), 64).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
