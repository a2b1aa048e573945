"""Long sequences as blocks of codes, each a row, so that one sequence's recurrences are many tasks.

Every block passes messages on by the product of its steps' matrices. The products of a sequence's blocks, a row of
K x K numbers each, are brought together and give the messages at the edges of every block; with these all blocks run
by themselves. Sequences of one block take no such pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.operators import kernels
from basewright.operators.coding import code_sequences
from basewright.operators.jobs import CHAIN
from basewright.sources.shared import merged

#: Codes in one block.
BLOCK = 1 << 16
_EDGES = "obs_id string, K int, order int, replicate int, seq_id {id}, block int, enter array<double>, leave array<double>, log_p double"


def cut_blocks(obs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``obs(obs_id, order, seq_id, codes)`` in blocks: with block, counting from 0, and last. A sequence without codes
    is one empty block; null codes are none."""
    codes = F.coalesce("codes", F.array().cast("array<int>"))
    last = F.greatest(F.ceil(F.size(codes) / size), F.lit(1)).cast("int") - 1
    rows = obs.select("obs_id", "order", "seq_id", codes.alias("codes"), last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("block"))
    return rows.select("obs_id", "order", "seq_id", F.slice("codes", F.col("block") * size + 1, F.lit(size)).alias("codes"), "block", (F.col("block") == F.col("_last")).alias("last"))


def code_tiles(tiles: DataFrame, order: int) -> DataFrame:
    """(obs_id, order, seq_id, codes, block, last) of ``tiles(obs_id, seqid, tile, seq)``, as ``tile_scaffolds`` makes
    them, numbered from 0 without gaps: a tile's codes are the k-mers that start in it, so the next tile's first bases
    are joined to it. Tiles must have at least ``order`` bases, but for a sequence's last; a last one without codes is
    left out. No row ever holds a whole sequence."""
    heads = tiles.select("obs_id", "seqid", (F.col("tile") - 1).alias("tile"), F.left("seq", F.lit(order)).alias("_halo"), F.length("seq").alias("_next"))
    rows = tiles.select("obs_id", "seqid", "tile", "seq").join(heads, ["obs_id", "seqid", "tile"], "left")
    last = F.coalesce(F.col("_next"), F.lit(0)) <= order
    seq = F.concat("seq", F.coalesce("_halo", F.lit("")))
    rows = rows.select("obs_id", F.lit(order).alias("order"), F.col("seqid").alias("seq_id"), seq.alias("seq"), F.col("tile").cast("int").alias("block"), last.alias("last"))
    return code_sequences(rows.where((F.length("seq") > order) | (F.col("block") == 0)))


def _products(blocks: DataFrame, pack: dict) -> DataFrame:
    """(chain, seq_id, block, moves, logs): the transfer product of each block under each model."""
    from basewright.operators.hmm import _CHAIN_FIELDS, CHAIN_TYPES, groups

    sent = blocks.sparkSession.sparkContext.broadcast(pack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, some, sequences in groups(batch):
                begins = batch.column(4).to_numpy()[some] == 0
                for chain, model in sent.value.get(key, ()):
                    moves, logs = kernels.Stretches(model, sequences, begins).products()
                    columns = [pa.array([x] * len(some), t) for x, (_, t) in zip(chain, _CHAIN_FIELDS, strict=True)]
                    columns += [batch.column(i).take(pa.array(some)) for i in (2, 4)]
                    columns += [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x[0].size).cast(pa.list_(pa.float64())) for x in (moves, logs)]
                    yield pa.RecordBatch.from_arrays(columns, [*CHAIN, "seq_id", "block", "moves", "logs"])

    kind = dict(blocks.dtypes)["seq_id"]
    return blocks.select("obs_id", "order", "seq_id", "codes", "block").mapInArrow(run, f"{CHAIN_TYPES}, seq_id {kind}, block int, moves array<double>, logs array<double>")


def _chained(products: DataFrame, pack: dict) -> DataFrame:
    """(chain, seq_id, block, enter, leave, log_p): the messages at each block's edges, and log P of its sequence."""
    sent = products.sparkSession.sparkContext.broadcast({chain: m.a for some in pack.values() for chain, m in some})
    names = [*CHAIN, "seq_id", "block", "enter", "leave", "log_p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = defaultdict(list)
            for r, chain in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                by[chain].append(r)
            for chain, rows in by.items():  # a step serves all sequences of a chain
                a, lists = sent.value[chain], batch.column(5).take(pa.array(rows))
                k, sizes, each = len(a), lists.value_lengths().to_numpy(), lists.flatten()
                moves, logs = each.field("moves").flatten().to_numpy().reshape(-1, k, k), each.field("logs").flatten().to_numpy().reshape(-1, k)
                first, most = np.cumsum(sizes) - sizes, int(sizes.max())
                enter, leave, log_p = np.zeros((len(each), k)), np.full((len(each), k), 1 / k), np.zeros(len(rows))
                now = np.tile(a, (len(rows), 1))
                for j in range(most):
                    live = np.flatnonzero(sizes > j)
                    at = first[live] + j
                    enter[at] = now[live]
                    now[live], more = kernels.push(now[live], moves[at], logs[at])
                    log_p[live] += more
                for j in range(1, most):
                    live = np.flatnonzero(sizes > j)
                    at = first[live] + sizes[live] - j
                    leave[at - 1] = kernels.pull(moves[at], logs[at], leave[at])
                owner = pa.array(np.repeat(rows, sizes))
                columns = [batch.column(i).take(owner) for i in range(5)] + [each.field("block")]
                columns += [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(x.ravel())) for x in (enter, leave)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(log_p, sizes))], names)

    each = F.sort_array(F.collect_list(F.struct("block", "moves", "logs"))).alias("rows")  # K x K numbers for a block of codes
    grouped = products.groupBy(*CHAIN, "seq_id").agg(each)
    return grouped.mapInArrow(run, _EDGES.format(id=dict(products.dtypes)["seq_id"]))


def _single() -> Column:
    return (F.col("block") == 0) & F.col("last")


def block_edges(blocks: DataFrame, pack: dict) -> DataFrame:
    """(chain, seq_id, block, enter, leave, log_p) of the sequences of several blocks."""
    return _chained(_products(blocks.where(~_single()), pack), pack)


def with_edges(blocks: DataFrame, pack: dict) -> DataFrame:
    """``blocks`` with edges, array<struct<K, replicate, enter, leave>>: one for each chain of their obs set and order;
    null for blocks that are whole sequences."""
    edge = F.struct("K", "replicate", "enter", "leave")
    edges = block_edges(blocks, pack).groupBy("obs_id", "order", "seq_id", "block").agg(F.collect_list(edge).alias("edges"))  # one a chain
    single = blocks.where(_single()).withColumn("edges", F.lit(None).cast(edges.schema["edges"].dataType))
    return merged(blocks.where(~_single()), edges, ["obs_id", "order", "seq_id", "block"]).unionByName(single)


def sequence_log_likelihood(blocks: DataFrame, models: DataFrame | dict) -> DataFrame:
    """(chain, seq_id, log_p) of whole sequences, by the products of their blocks."""
    from basewright.operators.hmm import obs_log_likelihood, packs

    several = reduce(DataFrame.unionByName, (block_edges(blocks, pack).where("block = 0").select(*CHAIN, "seq_id", "log_p") for pack in packs(models)))
    return several.unionByName(obs_log_likelihood(blocks.where(_single()).drop("block", "last"), models))
