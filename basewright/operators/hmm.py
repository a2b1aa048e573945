"""Likelihoods, expected counts and training of hidden Markov models over coded sequences.

``obs(obs_id, order, seq_id, codes)`` are the coded sequences, or with ``block`` and ``last`` as well blocks of them (of
``blocks.cut_blocks`` or ``blocks.code_tiles``), so that one sequence is many tasks; results of blocks have a block
column. ``models(obs_id, K, order, replicate, initial, transition, emission)`` are as many as the job grid says. They
are sent to every task in packs of bounded size, and all of a pack are served by one pass over the sequences.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewright.operators import kernels
from basewright.operators.coding import balanced, code_sequences
from basewright.operators.intervals import PARTITIONS
from basewright.operators.jobs import CHAIN, plan_training
from basewright.sources.genome import STEPS, Log, begin_run, read_chain_steps, write_iteration
from basewright.sources.shared import written

CHAIN_TYPES = "obs_id string, K int, order int, replicate int"
_CHAIN_FIELDS = [("obs_id", pa.string()), ("K", pa.int32()), ("order", pa.int32()), ("replicate", pa.int32())]
#: Bytes of models in one broadcast, and of the counts a task holds for them; a single model may have more.
MOST_MODEL_BYTES = 64 << 20
#: Partial rows of counts that the driver sums itself; more are summed by a shuffle before.
MOST_PARTIAL_ROWS = 1 << 17
Models = dict[tuple, kernels.Model]


def collected(models: DataFrame | Models) -> Models:
    """Models by chain."""
    if isinstance(models, dict):
        return models
    return {tuple(r[c] for c in CHAIN): kernels.Model.of(r["initial"], r["transition"], r["emission"]) for r in models.select(*CHAIN, "initial", "transition", "emission").collect()}


def packs(models: DataFrame | Models, most: int | None = None) -> list[dict[tuple[str, int], list[tuple[tuple, kernels.Model]]]]:
    """Models by (obs_id, order), in packs of bounded bytes; one pack at least."""
    out, held = [defaultdict(list)], 0
    for chain, m in collected(models).items():
        size = m.a.nbytes + m.A.nbytes + m.B.nbytes
        if held and held + size > (most or MOST_MODEL_BYTES):
            out.append(defaultdict(list))
            held = 0
        out[-1][chain[0], chain[2]].append((chain, m))
        held += size
    return [dict(x) for x in out]


def groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], np.ndarray, list[np.ndarray]]]:
    """((obs_id, order), rows, codes) of a batch of obs_id, order, seq_id, codes; null codes are empty."""
    codes = batch.column(3)
    values, ends = codes.flatten().to_numpy(zero_copy_only=False), np.cumsum(codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    by = defaultdict(list)
    for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        by[key].append(i)
    for key, rows in by.items():
        yield key, np.array(rows), [values[(ends[i - 1] if i else 0) : ends[i]] for i in rows]


def stretches(chain: tuple, model: kernels.Model, sequences: list[np.ndarray], rows: np.ndarray, batch: pa.RecordBatch) -> kernels.Stretches:
    """The sequences' recurrences; blocks (columns block and edges follow) take up the messages at their edges."""
    if batch.num_columns == 4:
        return kernels.Stretches(model, sequences)
    begins = batch.column(4).to_numpy()[rows] == 0
    k = len(model.a)
    enter, leave = np.tile(model.a, (len(rows), 1)), np.full((len(rows), k), 1 / k)
    lists = batch.column(5).take(pa.array(rows))
    edges, owner = lists.flatten(), np.repeat(np.arange(len(rows)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    own = (edges.field("K").to_numpy() == chain[1]) & (edges.field("replicate").to_numpy() == chain[3])
    if own.any():
        some = edges.filter(pa.array(own))
        enter[owner[own]], leave[owner[own]] = (some.field(x).flatten().to_numpy().reshape(-1, k) for x in ("enter", "leave"))
    return kernels.Stretches(model, sequences, begins, enter, leave)


def _columns(obs: DataFrame, pack: dict) -> tuple[DataFrame, list[str]]:
    """What tasks read of ``obs``, blocks with the messages at their edges; and the names that tell a row."""
    if "block" not in obs.columns:
        return obs.select("obs_id", "order", "seq_id", "codes"), ["seq_id"]
    from basewright.operators.blocks import with_edges

    return with_edges(obs, pack).select("obs_id", "order", "seq_id", "codes", "block", "edges"), ["seq_id", "block"]


def _per_sequence(obs: DataFrame, models: DataFrame | Models, column: str, kind: str, f: Callable[[kernels.Model, kernels.Stretches], pa.Array]) -> DataFrame:
    """(chain, seq_id(, block), column) with f's value of each sequence or block."""
    out = []
    for pack in packs(models):
        sent = obs.sparkSession.sparkContext.broadcast(pack)
        rows, key = _columns(obs, pack)
        at = [2, 4][: len(key)]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at, key=key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, some, sequences in groups(batch):
                    for chain, model in sent.value.get(group, ()):
                        values = f(model, stretches(chain, model, sequences, some, batch))
                        columns = [pa.array([x] * len(some), t) for x, (_, t) in zip(chain, _CHAIN_FIELDS, strict=True)]
                        columns += [batch.column(i).take(pa.array(some)) for i in at]
                        yield pa.RecordBatch.from_arrays([*columns, values], [n for n, _ in _CHAIN_FIELDS] + key + [column])

        out.append(rows.mapInArrow(run, ", ".join([CHAIN_TYPES, *(f"{n} {dict(rows.dtypes)[n]}" for n in key), f"{column} {kind}"])))
    return reduce(DataFrame.unionByName, out)


def _lists(s: kernels.Stretches, flat: np.ndarray) -> pa.Array:
    """Values of all positions as a list for each sequence; those of a matrix as lists of its rows."""
    values = pa.array(flat.ravel())
    if flat.ndim == 2:
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), values)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(s.sizes)]).astype(np.int32)), values)


def obs_log_likelihood(obs: DataFrame, models: DataFrame | Models) -> DataFrame:
    """(chain, seq_id, log_p): log P(sequence | model), of blocks that of the whole sequence; 0 for an empty one."""
    if "block" in obs.columns:
        from basewright.operators.blocks import sequence_log_likelihood

        return sequence_log_likelihood(obs, models)
    return _per_sequence(obs, models, "log_p", "double", lambda m, s: pa.array(s.log_likelihood()))


def set_log_likelihood(obs: DataFrame, models: DataFrame | Models) -> DataFrame:
    """(chain, log_p): summed over the sequences of the model's obs set."""
    return obs_log_likelihood(obs, models).groupBy(*CHAIN).agg(F.sum("log_p").alias("log_p"))


def state_posteriors(obs: DataFrame, models: DataFrame | Models) -> DataFrame:
    """(chain, seq_id(, block), gamma): state probabilities of each position, array<array<double>>."""
    return _per_sequence(obs, models, "gamma", "array<array<double>>", lambda m, s: _lists(s, s.posteriors()))


def positional_log_likelihood(obs: DataFrame, models: DataFrame | Models) -> DataFrame:
    """(chain, seq_id(, block), log_lh): log of the probability of each symbol under the state posteriors of its
    position."""
    return _per_sequence(obs, models, "log_lh", "array<double>", lambda m, s: _lists(s, kernels.positional_flat(m, s)))


def expected_counts(obs: DataFrame, models: DataFrame | Models, kernel: Callable | None = None) -> DataFrame:
    """(chain, kind, i, j, value): sums over sequences. kind "a": gamma_1 of state i; "A": moves from i to j; "B":
    symbol j in state i (j from 1); "log_p" and "n": log P and the number of sequences.

    Each task gives one partial row per chain and entry that is not zero; only these are shuffled. kernel: the sums of a
    batch of whole sequences, instead of those of ``kernels.Stretches``, as kernels.expected_counts_whole.
    """
    return _partial_counts(obs, models, kernel).groupBy(*CHAIN, "kind", "i", "j").agg(F.sum("value").alias("value"))


def _partial_counts(obs: DataFrame, models: DataFrame | Models, kernel: Callable | None = None) -> DataFrame:
    """The rows of ``expected_counts`` of each task, not summed."""
    fields = [*_CHAIN_FIELDS, ("kind", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())]
    parts = []
    for pack in packs(models):
        sent = obs.sparkSession.sparkContext.broadcast(pack)
        used = [F.col("obs_id").eqNullSafe(F.lit(o)) & (F.col("order") == n) for o, n in sorted(pack, key=str)]
        rows, _ = _columns(obs.where(reduce(lambda x, y: x | y, used, F.lit(False))), pack)  # what no model is for is not read

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, kernels.Counts] = {}
            for batch in batches:
                for key, some, sequences in groups(batch):
                    for chain, model in sent.value.get(key, ()):
                        if kernel is not None:
                            held[chain] = kernel(model, sequences, held.get(chain))
                        else:
                            held[chain] = stretches(chain, model, sequences, some, batch).counts(held.get(chain))
            for chain, c in held.items():
                k, (i, j) = len(c.first), np.nonzero(c.symbols)
                kinds = ["a"] * k + ["A"] * (k * k) + ["B"] * len(i) + ["log_p", "n"]
                rows_i = np.concatenate([np.arange(k), np.repeat(np.arange(k), k), i, [0, 0]])
                rows_j = np.concatenate([np.zeros(k), np.tile(np.arange(k), k), j + 1, [0, 0]])
                values = np.concatenate([c.first, c.moves.ravel(), c.symbols[i, j], [c.log_p, c.n]])
                columns = [pa.array([x] * len(kinds), t) for x, (_, t) in zip(chain, _CHAIN_FIELDS, strict=True)]
                columns += [pa.array(kinds), pa.array(rows_i.astype(np.int32)), pa.array(rows_j.astype(np.int32)), pa.array(values)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

        parts.append(rows.mapInArrow(run, f"{CHAIN_TYPES}, kind string, i int, j int, value double"))
    return reduce(DataFrame.unionByName, parts)


def _stepped(counts: DataFrame) -> DataFrame:
    """``counts`` with a over the number of sequences, A and B over the sum of their row, others as they are."""
    row = Window.partitionBy(*CHAIN, "kind", F.when(F.col("kind").isin("A", "B"), F.col("i")).otherwise(F.lit(-1)))
    return counts.withColumn("value", F.when(F.col("kind").isin("a", "A", "B"), F.col("value") / F.sum("value").over(row)).otherwise(F.col("value")))


def m_step(counts: DataFrame) -> DataFrame:
    """(chain, kind, i, j, value) of the new model in long form: a over the number of sequences; A and B over the sum of
    their row. Symbols that were not counted have no row."""
    return _stepped(counts.where("kind IN ('a', 'A', 'B')"))


def _assembled(counts: DataFrame, live: Models) -> dict[tuple, tuple[kernels.Model, float]]:
    """New models, as many as there are live chains, and log P of the old ones, from one job. ``counts`` may be partial
    ones of several tasks."""
    out, log_p = {c: kernels.Model(np.zeros_like(m.a), np.zeros_like(m.A), np.zeros_like(m.B)) for c, m in live.items()}, {}
    rows = counts.toArrow()
    i, j, value = (rows[c].to_numpy() for c in ("i", "j", "value"))
    at = defaultdict(list)
    for n, key in enumerate(zip(*(rows[c].to_pylist() for c in (*CHAIN, "kind")), strict=True)):
        at[key].append(n)
    for (*chain, kind), some in at.items():
        m = out[tuple(chain)]
        if kind == "a":
            np.add.at(m.a, i[some], value[some])
        elif kind == "A":
            np.add.at(m.A, (i[some], j[some]), value[some])
        elif kind == "B":
            np.add.at(m.B, (i[some], j[some] - 1), value[some])
        elif kind == "log_p":
            log_p[tuple(chain)] = float(value[some].sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        for c, m in out.items():
            m.a /= m.a.sum()
            m.A = np.nan_to_num(m.A / m.A.sum(1, keepdims=True))
            m.B = np.nan_to_num(m.B / m.B.sum(1, keepdims=True))  # a state that has no symbol has no row
            idle = m.A.sum(1) == 0  # states that were never left, or single symbols, keep their rows
            m.A[idle] = live[c].A[idle]
    return {c: (out[c], log_p[c]) for c in log_p}


def _step_counts(obs: DataFrame, models: Models) -> DataFrame:
    """Counts of one iteration: those of each task where these are few rows, else their sums."""
    rows = obs.rdd.getNumPartitions() * sum(len(m.a) * (1 + len(m.a) + m.B.shape[1]) + 2 for m in models.values())
    return (_partial_counts if rows <= MOST_PARTIAL_ROWS else expected_counts)(obs, models)


class _Commits:
    """Commits iterations to a step log one after the other, each while the next ones are computed."""

    def __init__(self, spark: SparkSession, log: Log):
        self.spark, self.log, self.pool = spark, log, ThreadPoolExecutor(1)
        self.last: Future | None = None

    def add(self, rows: list[tuple]) -> None:
        self.wait()  # one at a time: no iteration is there without those before it, and none are kept
        self.last = self.pool.submit(self._commit, rows)

    def _commit(self, rows: list[tuple]) -> None:
        self.log = write_iteration(self.spark.createDataFrame(rows, STEPS), self.log)

    def wait(self) -> None:
        """Until all are committed; raises what a commit raised."""
        if self.last is not None:
            self.last.result()

    def close(self) -> None:
        self.pool.shutdown(wait=True)


def em_step(obs: DataFrame, models: DataFrame | Models) -> DataFrame:
    """(chain, initial, transition, emission, log_p): the models after one step, and log P under the models before it."""
    live = collected(models)
    rows = [(*c, m.a.tolist(), m.A.tolist(), m.B.tolist(), p) for c, (m, p) in _assembled(expected_counts(obs, live), live).items()]
    return obs.sparkSession.createDataFrame(rows, f"{CHAIN_TYPES}, initial array<double>, transition array<array<double>>, emission array<array<double>>, log_p double")


def train(jobs: DataFrame, obs: DataFrame, steps: DataFrame, initial: DataFrame, delta_thresh: float = 1e-3, max_iterates: int = 5000, sink: Callable[[DataFrame], None] | None = None, em_counts: Callable[[DataFrame, Models], DataFrame] = _step_counts, path: str | None = None) -> DataFrame:
    """All steps made, as a chain-step table; ``sink`` is given each iteration's steps as they come. With a ``path``
    each iteration is committed to the step log there while the next is computed, which is returned as it is read back;
    steps that the log has and ``steps`` has not are replaced, so a run that was killed is repeated from what is given,
    or resumed from what the log has, and no step is there twice.
    em_counts: what gives an iteration's expected counts of (obs, models).

    Each chain goes on until the change of log P is below the threshold or it has max_iterates steps. Its first step
    is the initial model with its log P and delta 0; a later step has the log P of the model before it. The first
    step made, also after a resumption, never counts as converged. Nothing to train, or a chain that has
    max_iterates steps already, is an error.
    """
    spark = obs.sparkSession
    plan = plan_training(jobs, steps, delta_thresh).where("action != 'skip'").join(initial.select(*CHAIN, *(F.col(x).alias(f"new_{x}") for x in ("initial", "transition", "emission"))), CHAIN, "left").collect()
    if not plan:
        raise ValueError("no job is left to train")
    at, models, last = {}, {}, {}
    for r in plan:
        chain = tuple(r[c] for c in CHAIN)
        new = r["action"] == "new"
        models[chain] = kernels.Model.of(*((r["new_initial"], r["new_transition"], r["new_emission"]) if new else (r["initial"], r["transition"], r["emission"])))
        at[chain], last[chain] = (0, None) if new else (r["iterate"], r["log_p"])
        if at[chain] >= max_iterates:
            raise ValueError(f"{chain} has {at[chain]} steps already")
    obs = balanced(obs).persist()
    log = None if path is None else _Commits(spark, begin_run(spark, path, steps))
    out, made = [], set()
    try:
        while models:
            new = _assembled(em_counts(obs, models), models)
            if missing := models.keys() - new.keys():
                raise ValueError(f"no observations for {sorted(missing)[0]}")
            rows = []
            for chain, (model, log_p) in new.items():
                if at[chain] == 0:
                    old = models[chain]
                    at[chain] = 1
                    rows.append((*chain, 1, old.a.tolist(), old.A.tolist(), old.B.tolist(), log_p, 0.0, False))
                    last[chain] = log_p
                    if max_iterates == 1:
                        del models[chain]
                        continue
                at[chain] += 1
                delta = abs(log_p - last[chain])
                done = chain in made and delta < delta_thresh
                made.add(chain)
                rows.append((*chain, at[chain], model.a.tolist(), model.A.tolist(), model.B.tolist(), log_p, delta, done))
                last[chain], models[chain] = log_p, model
                if done or at[chain] >= max_iterates:
                    del models[chain]
            if sink is not None:
                sink(spark.createDataFrame(rows, STEPS))
            if log is not None:
                log.add(rows)
            else:
                out += rows
        if log is not None:
            log.wait()
    finally:
        if log is not None:
            log.close()
    obs.unpersist()
    return spark.createDataFrame(out, STEPS) if path is None else read_chain_steps(spark, path)


def weighted_categorical_mle(values: DataFrame, size: int) -> DataFrame:
    """(key, symbol, p) of ``values(key, symbol, weight)``: the weight of each symbol 1 .. size over all weights."""
    sums = values.groupBy("key", "symbol").agg(F.sum("weight").alias("w"))
    grid = values.select("key").distinct().withColumn("symbol", F.explode(F.sequence(F.lit(1), F.lit(size))))
    rows = grid.join(sums, ["key", "symbol"], "left").fillna(0.0, ["w"])
    return rows.select("key", "symbol", (F.col("w") / F.sum("w").over(Window.partitionBy("key"))).alias("p"))


def background_likelihood(fragments: DataFrame, models: DataFrame | Models, order: int = 0) -> DataFrame:
    """(pos_id, position, log_lh): fragments scored under their partition's model, at sequence positions.

    fragments: of ``fragment_by_partition``, or with block and last as well blocks of them (of
    ``locate.tiled_fragments``), block_start being where a block's codes stand in its fragment's orientation, from 0.
    models: one per partition name in obs_id, all of ``order``; none or several for a partition that occurs are an
    error. The k-mer is scored at its first base in the fragment's orientation; its last ``order`` bases have no row. A
    single last base of a sequence is scored as any other.
    """
    keys = list(models) if isinstance(models, dict) else [tuple(r) for r in models.select(*CHAIN).collect()]
    live, blocks = collected(models), "block" in fragments.columns
    names = F.when(F.col("partition_code") == 1, "intergenic").when(F.col("partition_code") == 2, "periexonic").otherwise("exon")
    place = ["pos_id", "frag_start", "frag_end", "strand", *(["block", "last", "block_start"] if blocks else [])]
    rows = fragments.where(F.length("fragment") > order).withColumn("obs_id", names)
    count = {p: sum(k[0] == p and k[2] == order for k in keys) for p in PARTITIONS}
    # which row fails first is chance, so the error says all
    wrong = F.raise_error(F.lit(", ".join(f"{n} models for {p}" for p, n in count.items()) + f" of order {order}, one is needed for each that occurs"))
    rows = rows.withColumn("obs_id", F.when(F.col("obs_id").isin([p for p, n in count.items() if n == 1]), F.col("obs_id")).otherwise(wrong))
    coded = code_sequences(rows.select("obs_id", F.lit(order).alias("order"), F.struct(*place).alias("seq_id"), F.col("fragment").alias("seq"), *place))
    if blocks:  # a fragment's blocks are told by where it stands
        coded = written(coded.withColumn("seq_id", F.struct("pos_id", "frag_start")))  # gone through four times
    scored = positional_log_likelihood(coded, live)
    if blocks:
        ends = coded.select(F.col("seq_id"), "block", "frag_end", "strand", "block_start")
        scored = scored.join(ends, ["seq_id", "block"])
    at = F.col("seq_id.frag_start"), F.col("frag_end" if blocks else "seq_id.frag_end"), F.col("strand" if blocks else "seq_id.strand")
    shift = F.col("block_start") if blocks else F.lit(0)
    each = scored.select(F.col("seq_id.pos_id").alias("pos_id"), at[0].alias("_from"), at[1].alias("_to"), at[2].alias("_strand"), shift.alias("_shift"), F.posexplode("log_lh").alias("_i", "log_lh"))
    i = F.col("_i") + F.col("_shift")
    return each.select("pos_id", F.when(F.col("_strand") == -1, F.col("_to") - i).otherwise(F.col("_from") + i).alias("position"), "log_lh")
