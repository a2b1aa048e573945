"""Job grids, eligibility, validation, initial models and plans of training."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAIN = ["obs_id", "K", "order", "replicate"]
MODELS = "obs_id string, K int, order int, replicate int, initial array<double>, transition array<array<double>>, emission array<array<double>>"


def job_grid(obs_ids: DataFrame, states: Sequence[int], orders: Sequence[int], replicates: int) -> DataFrame:
    """All chain ids of ``obs_ids(obs_id)`` with the given numbers of states, orders and replicates 1 .."""
    each = lambda xs: F.explode(F.array(*(F.lit(int(x)) for x in xs)))
    rows = obs_ids.select("obs_id").distinct()
    return rows.withColumn("K", each(states)).withColumn("order", each(orders)).withColumn("replicate", each(range(1, replicates + 1)))


def code_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.select("obs_id", "order").distinct()


def select_jobs(jobs: DataFrame, states: tuple[int, int], orders: tuple[int, int], blacklist: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """Jobs within the inclusive ranges, off the blacklist and, if there is one, on the whitelist."""
    if states[0] < 1 or orders[0] < 0:
        raise ValueError("need K >= 1 and order >= 0")
    out = jobs.where(F.col("K").between(*states) & F.col("order").between(*orders))
    if blacklist is not None:
        out = out.join(blacklist.select(*CHAIN), CHAIN, "left_anti")
    return out if whitelist is None else out.join(whitelist.select(*CHAIN), CHAIN, "left_semi")


def _is_distribution(p: Column) -> Column:
    return F.forall(p, lambda x: x >= 0) & (F.abs(F.aggregate(p, F.lit(0.0), lambda s, x: s + x) - 1) < 1e-8)


def validate_models(models: DataFrame, strict: bool = False) -> DataFrame:
    """``models(initial, transition, emission, ...)`` with violations (array<string>); strict: any violation is an error."""
    n = F.size("initial")
    checks = {
        "a is no probability vector": _is_distribution(F.col("initial")),
        "A is not square": (F.size("transition") > 0) & F.forall("transition", lambda r: F.size(r) == F.size(F.col("transition"))),
        "A has a row that is no probability vector": F.forall("transition", _is_distribution),
        "B has rows of unequal lengths": F.forall("emission", lambda r: F.size(r) == F.size(F.element_at("emission", 1))),
        "B has a row that is no probability vector": F.forall("emission", _is_distribution),
        "a, A and B differ in states": (n == F.size("transition")) & (n == F.size("emission")),
    }
    out = models.withColumn("violations", F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()))))
    if strict:
        out = out.withColumn("initial", F.when(F.size("violations") == 0, F.col("initial")).otherwise(F.raise_error(F.array_join("violations", "; "))))
    return out


def validate_chain_steps(steps: DataFrame) -> DataFrame:
    """``steps`` with valid_chain (K >= 1, order >= 0, replicate >= 1) and valid_step (iterate >= 1, log_p <= 0)."""
    return steps.withColumns({"valid_chain": (F.col("K") >= 1) & (F.col("order") >= 0) & (F.col("replicate") >= 1), "valid_step": (F.col("iterate") >= 1) & (F.col("log_p") <= 0)})


def default_model(states: int, order: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a ~ Dirichlet(1/K), rows of A ~ Dirichlet(250 K on the diagonal, 0.1 elsewhere), rows of B ~ Dirichlet(1/S)."""

    def draw(alpha: np.ndarray) -> np.ndarray:
        x = np.maximum(rng.gamma(alpha), 1e-300)
        return x / x.sum()

    size = 4 ** (order + 1)
    moves = np.full((states, states), 0.1) + np.eye(states) * (250.0 * states - 0.1)
    return draw(np.full(states, 1 / states)), np.stack([draw(r) for r in moves]), np.stack([draw(np.full(size, 1 / size)) for _ in range(states)])


def init_models(jobs: DataFrame, seed: int = 1, init: Callable = default_model) -> DataFrame:
    """One model per chain of ``jobs``; ``init(states, order, rng)`` gives (a, A, B), seeded by the chain's key."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            models = [init(r.K, r.order, np.random.default_rng([seed, zlib.crc32(f"{r.obs_id}/{r.K}/{r.order}/{r.replicate}".encode())])) for r in part.itertuples()]
            yield part.assign(initial=[m[0].tolist() for m in models], transition=[m[1].tolist() for m in models], emission=[m[2].tolist() for m in models])

    return jobs.select(*CHAIN).mapInPandas(run, MODELS)


def plan_training(jobs: DataFrame, steps: DataFrame, delta_thresh: float = 1e-3) -> DataFrame:
    """``jobs`` with action: new (no steps), resume (last step unconverged, or its delta above the threshold) or skip;
    and the iterate, log_p and model of the last step."""
    last = steps.groupBy(*CHAIN).agg(F.max_by(F.struct("iterate", "log_p", "delta", "converged", "initial", "transition", "emission"), "iterate").alias("last"))
    rows = jobs.select(*CHAIN).join(last, CHAIN, "left")
    action = F.when(F.col("last").isNull(), "new").when(~F.col("last.converged") | (F.col("last.delta") > delta_thresh), "resume").otherwise("skip")
    return rows.select(*CHAIN, action.alias("action"), "last.iterate", "last.log_p", "last.initial", "last.transition", "last.emission")
