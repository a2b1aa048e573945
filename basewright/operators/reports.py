"""Aggregations and reports over chain-step tables."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewright.functions.numbers import mean_run_length
from basewright.operators.hmm import set_log_likelihood
from basewright.operators.jobs import CHAIN
from basewright.operators.kernels import heidelberger_welch
from basewright.sources.shared import written

REPSET = ["obs_id", "K", "order"]


def naive_log_likelihood(obs: DataFrame) -> DataFrame:
    """(obs_id, naive_log_p): of ``obs(obs_id, seq)`` under one state of uniform bases."""
    return obs.groupBy("obs_id").agg((-F.sum(F.length("seq")) * F.lit(math.log(4))).alias("naive_log_p"))


def latest_step(steps: DataFrame) -> DataFrame:
    """The step of the greatest iterate of each chain."""
    rest = [c for c in steps.columns if c not in CHAIN]
    last = steps.groupBy(*CHAIN).agg(F.max_by(F.struct(*rest), "iterate").alias("last"))
    return last.select(*CHAIN, *(F.col(f"last.{c}") for c in rest))


def convergence_summary(steps: DataFrame) -> DataFrame:
    return latest_step(steps).agg(F.count_if("converged").alias("converged"), F.count_if(~F.col("converged")).alias("unconverged"))


def chain_trajectories(steps: DataFrame) -> DataFrame:
    """(chain, iterate, series, value): log_p, and the diagonal of A as K1, K2, ..."""
    diagonal = F.transform(F.sequence(F.lit(1), F.col("K")), lambda k: F.struct(F.concat(F.lit("K"), k.cast("string")).alias("series"), F.element_at(F.element_at("transition", k), k).alias("value")))
    both = F.concat(F.array(F.struct(F.lit("log_p").alias("series"), F.col("log_p").alias("value"))), diagonal)
    return steps.select(*CHAIN, "iterate", F.explode(both).alias("s")).select(*CHAIN, "iterate", "s.series", "s.value")


def convergence_diagnostic(trajectories: DataFrame) -> DataFrame:
    """(chain, series, status, stationary, start, mean, half_width, half_width_passed): Heidelberger-Welch test of each
    series; "short" below ten steps, "error" if it fails to compute. A series has max_iterates steps at most."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("iterate")["value"].to_numpy(float)
        status, values = "ok", (None, None, None, None, None)
        if len(x) < 10:
            status = "short"
        else:
            try:
                values = heidelberger_welch(x)
                if not math.isfinite(values[2]):
                    raise ValueError("not finite")
            except (ValueError, FloatingPointError):
                status, values = "error", (None, None, None, None, None)
        names = [*CHAIN, "series", "status", "stationary", "start", "mean", "half_width", "half_width_passed"]
        return pd.DataFrame([[*key, status, *values]], columns=names)

    schema = "obs_id string, K int, order int, replicate int, series string, status string, stationary boolean, start int, mean double, half_width double, half_width_passed boolean"
    return trajectories.groupBy(*CHAIN, "series").applyInPandas(one, schema)


def chain_report(steps: DataFrame, test_coded: DataFrame, test_obs: DataFrame) -> DataFrame:
    """Per chain: final model, test log-likelihood, naive log-likelihood, beats_naive, log_p_per_symbol, final delta,
    converged, mean run lengths (in symbols and bases) and diagnostics by series."""
    last = latest_step(steps)
    lh = set_log_likelihood(test_coded, last).withColumnRenamed("log_p", "test_log_p")
    symbols = test_coded.groupBy("obs_id", "order").agg(F.sum(F.size("codes")).alias("n_symbols"))
    runs = F.transform(F.sequence(F.lit(1), F.col("K")), lambda k: mean_run_length(F.element_at(F.element_at("transition", k), k)))
    runs = F.when(F.col("K") > 1, runs).otherwise(F.array(F.lit(math.inf)))
    status = F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "status")))).alias("diagnostics")  # K + 1 entries
    found = convergence_diagnostic(chain_trajectories(steps)).groupBy(*CHAIN).agg(status)
    rows = last.join(lh, CHAIN).join(naive_log_likelihood(test_obs), "obs_id").join(symbols, ["obs_id", "order"]).join(found, CHAIN)
    rows = rows.withColumn("run_lengths", runs)
    return rows.select(
        *CHAIN, "initial", "transition", "emission", "test_log_p", "naive_log_p", (F.col("test_log_p") > F.col("naive_log_p")).alias("beats_naive"), (F.col("test_log_p") / F.col("n_symbols")).alias("log_p_per_symbol"),
        F.col("delta").alias("final_delta"), "converged", "run_lengths", F.transform("run_lengths", lambda x: x * (F.col("order") + 1)).alias("run_bases"), "diagnostics",
    )


def order_report(chains: DataFrame) -> DataFrame:
    """(obs_id, order, converged, failed): (K, test_log_p) pairs of converged and other chains, in order."""
    pair = F.struct("K", "test_log_p")
    lists = [F.array_sort(F.collect_list(F.when(c, pair))).alias(n) for n, c in (("converged", F.col("converged")), ("failed", ~F.col("converged")))]
    return chains.groupBy("obs_id", "order").agg(*lists)


def partition_report(chains: DataFrame) -> DataFrame:
    """Per obs set: naive_log_p, and the best chain by test_log_p (then the least K, order, replicate) with its model and
    the replicates that exist of its K and order."""
    over = Window.partitionBy("obs_id").orderBy(F.desc("test_log_p"), "K", "order", "replicate")
    best = chains.withColumn("_n", F.row_number().over(over)).where("_n = 1")
    sets = chains.groupBy(*REPSET).agg(F.array_sort(F.collect_list("replicate")).alias("replicates"))
    return best.select(*CHAIN, "naive_log_p", "test_log_p", "initial", "transition", "emission").join(sets, REPSET)


def state_distances(steps: DataFrame) -> DataFrame:
    """(repset, replicate, state, other, distance): Euclidean distances of the final emissions of each state of the first
    replicate to each of the other replicates."""
    last = latest_step(steps).select(*CHAIN, F.posexplode("emission").alias("state", "p"))
    first = last.groupBy(*REPSET).agg(F.min("replicate").alias("first"))
    a = last.join(first, REPSET).where("replicate = first").select(*REPSET, "first", F.col("state").alias("own"), F.col("p").alias("p1"))
    pairs = a.join(last, REPSET).where("replicate != first")  # K * K pairs of a replicate
    squares = F.aggregate(F.zip_with("p1", "p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pairs.select(*CHAIN, (F.col("own") + 1).alias("state"), (F.col("state") + 1).alias("other"), F.sqrt(squares).alias("distance"))


def match_states(steps: DataFrame) -> DataFrame:
    """(chain, rank, state, other): states of the first replicate, picked by the least sum of distances to the nearest
    free state of every other replicate (then the least state), and the state each of these matches (of equal ones the
    least); rank is the order of the picks. A set of one replicate matches itself.

    Every pass picks one state of each replicate set: as many passes as the most states.
    """
    left, picks = written(state_distances(steps)), []
    for rank in range(1, (left.agg(F.max("K")).first()[0] or 0) + 1):
        nearest = left.groupBy(*CHAIN, "state").agg(F.min(F.struct("distance", "other")).alias("near"))
        sums = nearest.groupBy(*REPSET, "state").agg(F.sum("near.distance").alias("sum"))
        pick = sums.groupBy(*REPSET).agg(F.min(F.struct("sum", "state")).alias("pick")).select(*REPSET, F.col("pick.state").alias("state"))
        picked = written(nearest.join(pick, [*REPSET, "state"]).select(*CHAIN, F.lit(rank).alias("rank"), "state", F.col("near.other").alias("other")))
        picks.append(picked)
        gone = picked.select(*CHAIN, F.col("state").alias("_state"), F.col("other").alias("_other"))
        left = written(left.join(gone, CHAIN).where("state != _state AND other != _other").select(*left.columns))
    chains = steps.select(*CHAIN).distinct()
    first = chains.groupBy(*REPSET).agg(F.min("replicate").alias("replicate"), F.count("*").alias("n"))
    alone = first.where("n = 1").select(*CHAIN, F.explode(F.sequence(F.lit(1), F.col("K"))).alias("state"))
    return reduce(DataFrame.unionByName, [*picks, alone.select(*CHAIN, F.col("state").alias("rank"), "state", F.col("state").alias("other"))])


def rank_symbols(steps: DataFrame, matches: DataFrame) -> DataFrame:
    """(repset, state, rank, symbol, distance): symbols of each matched state by their summed absolute difference from
    the first replicate, ascending, then by symbol."""
    last = latest_step(steps).select(*CHAIN, F.posexplode("emission").alias("own", "p")).select(*CHAIN, (F.col("own") + 1).alias("own"), F.posexplode("p").alias("s", "p"))
    first = last.groupBy(*REPSET).agg(F.min("replicate").alias("first"))
    ones = last.join(first, REPSET).where("replicate = first").select(*REPSET, F.col("own").alias("state"), "s", F.col("p").alias("p1"))
    others = matches.join(last.withColumnRenamed("own", "other"), [*CHAIN, "other"])
    both = others.join(ones, [*REPSET, "state", "s"]).groupBy(*REPSET, "state", (F.col("s") + 1).alias("symbol")).agg(F.sum(F.abs(F.col("p") - F.col("p1"))).alias("distance"))
    over = Window.partitionBy(*REPSET, "state").orderBy(F.round("distance", 9), "symbol")  # sums of three or more do not have a fixed order
    return both.select(*REPSET, "state", F.row_number().over(over).alias("rank"), "symbol", "distance")


def replicate_report(steps: DataFrame) -> DataFrame:
    """``replicate_reports`` of steps that must be of one obs set, K and order."""
    sets = steps.select(*REPSET).distinct().limit(2).count()
    if sets != 1:
        raise ValueError("a replicate set has one obs set, K and order")
    return replicate_reports(steps)


def replicate_reports(steps: DataFrame) -> DataFrame:
    """(chain, iterate, rank, state, autotransition, emissions): every step of each replicate set (obs set, K and order)
    with states renamed to those of the set's first replicate that they match. A step twice in a replicate is an error."""
    if steps.groupBy(*CHAIN, "iterate").count().where("count > 1").head(1):
        raise ValueError("replicates must be unique")
    matches = match_states(steps)
    first = steps.groupBy(*REPSET).agg(F.min("replicate").alias("first"))
    matches = matches.join(first, REPSET)
    own = matches.select(*REPSET, F.col("first").alias("replicate"), "rank", "state", F.col("state").alias("other")).distinct()
    matches = matches.where("replicate != first").drop("first").unionByName(own)
    each = steps.select(*CHAIN, "iterate", F.posexplode("emission").alias("_k", "emissions"), "transition").withColumn("other", F.col("_k") + 1)
    each = each.withColumn("autotransition", F.element_at(F.element_at("transition", F.col("other")), F.col("other")))
    return each.join(matches, [*CHAIN, "other"]).select(*CHAIN, "iterate", "rank", "state", "autotransition", "emissions")


def matched_state_coords(steps: DataFrame) -> DataFrame:
    """(chain, iterate, x, y, z): at each step the probability of the first symbol in three states: the first three of
    the obs set's first chain, and in its other chains the nearest to each of these in turn by final emissions, no state
    twice."""
    last = latest_step(steps)
    if last.where("K < 3").head(1):
        raise ValueError("states must be three or more")
    first = last.groupBy("obs_id").agg(F.min_by(F.struct(*CHAIN, "emission"), F.struct(*CHAIN)).alias("first"))  # K * 4^(order + 1) numbers
    rows = last.select(*CHAIN, "emission").join(first, "obs_id")
    squares = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

    def nearest(k: int, *taken: Column) -> Column:
        """The free state whose emissions are nearest to those of the first chain's state k, of equal ones the least."""
        each = F.transform("emission", lambda e, i: F.struct(squares(e, F.element_at("first.emission", k)).alias("d"), (i + 1).alias("state")))
        return F.array_min(F.filter(each, lambda x: reduce(lambda c, t: c & (x["state"] != t), taken, F.lit(True))))["state"]

    for k in (1, 2, 3):
        rows = rows.withColumn(f"pick{k}", nearest(k, *(F.col(f"pick{i}") for i in range(1, k))))
    own = reduce(lambda c, x: c & (F.col(x) == F.col(f"first.{x}")), CHAIN, F.lit(True))
    picked = rows.select(*CHAIN, F.when(own, F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array("pick1", "pick2", "pick3")).alias("picks"))
    first = lambda i: F.element_at(F.element_at("emission", F.element_at("picks", i)), 1)
    return steps.join(picked, CHAIN).select(*CHAIN, "iterate", first(1).alias("x"), first(2).alias("y"), first(3).alias("z"))


def generate_reports(steps: DataFrame, test_coded: DataFrame, test_obs: DataFrame) -> dict[str, DataFrame]:
    """Reports by name: chains, orders, partitions, and replicates (every step, matched states and symbols) of each
    partition's best chain, keyed by obs_id.

    Needs steps, at least two of every chain, and test sequences for every obs set.
    """
    counts = steps.groupBy(*CHAIN).agg(F.count("*").alias("n"), F.max("obs_id"))
    if not counts.head(1):
        raise ValueError("no chains to report")
    if counts.where("n < 2").head(1):
        raise ValueError("every chain needs two steps")
    if steps.select("obs_id").distinct().join(test_obs.select("obs_id").distinct(), "obs_id", "left_anti").head(1):
        raise ValueError("an obs set has no test sequences")
    chains = chain_report(steps, test_coded, test_obs).persist()
    partitions = partition_report(chains)
    best = partitions.select(*REPSET)
    sets = steps.join(best, REPSET, "left_semi")
    matches = match_states(sets)
    return {"chains": chains, "orders": order_report(chains), "partitions": partitions, "replicates": replicate_reports(sets), "states": matches, "symbols": rank_symbols(sets, matches), "convergence": convergence_summary(steps)}
