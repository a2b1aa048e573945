"""Sequences as integer codes of overlapping k-mers, the first base varying fastest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewright.functions.sequences import kmer_of

_INDEX = np.full(256, -1, np.int32)
_INDEX[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def compound_alphabet(spark: SparkSession, order: int) -> DataFrame:
    """(code, kmer) of all 4^(order + 1) k-mers."""
    codes = spark.range(1, 4 ** (order + 1) + 1).withColumnRenamed("id", "code")
    return codes.withColumn("kmer", kmer_of(F.col("code"), order))


def code_bases(seq: str, order: int) -> np.ndarray:
    """Codes of the ``len(seq) - order`` k-mers of a sequence of A, C, G and T; others are an error."""
    index = _INDEX[np.frombuffer(seq.encode(), np.uint8)]
    if (index < 0).any():
        raise ValueError("a sequence to be coded has a base other than A, C, G and T")
    n = len(index) - order
    if n <= 0:
        return np.empty(0, np.int32)
    return 1 + sum(index[i : i + n] << 2 * i for i in range(order + 1))


def code_sequences(sequences: DataFrame) -> DataFrame:
    """``sequences(..., order, seq)`` with codes (array<int>) in place of seq; null where seq is null."""
    order_at, seq_at = sequences.columns.index("order"), sequences.columns.index("seq")
    schema = T.StructType([f if f.name != "seq" else T.StructField("codes", T.ArrayType(T.IntegerType())) for f in sequences.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                orders, seqs = batch.column(order_at).to_pylist(), batch.column(seq_at).to_pylist()
                each = [None if s is None else code_bases(s, o) for o, s in zip(orders, seqs, strict=True)]
                offsets = np.cumsum([0, *(0 if x is None else len(x) for x in each)]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int32), *(x for x in each if x is not None)]).astype(np.int32)
                codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in each]))
                columns = [codes if k == seq_at else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return sequences.mapInArrow(run, schema)


def code_job_obs(jobs: DataFrame, obs: DataFrame) -> DataFrame:
    """(obs_id, order, seq_id, codes) for each (obs_id, order) that ``jobs`` need, once. Sequences with other bases than
    A, C, G and T, or no longer than the order, are left out."""
    need = jobs.select("obs_id", "order").distinct()
    rows = obs.where(~F.col("seq").rlike("[^ACGT]")).join(need, "obs_id").where(F.length("seq") > F.col("order"))
    return code_sequences(rows.select("obs_id", "order", "seq_id", "seq"))


def balanced(coded: DataFrame, parts: int | None = None, buckets: int = 4096) -> DataFrame:
    """``coded(seq_id, codes, ...)`` in partitions of about equal numbers of codes, whatever the sequences' lengths:
    sequences go by a hash into many small buckets, and these, in order, into partitions by running sums of their codes.
    Where ``parts`` is not given there are as many as a shuffle has. A sequence longer than a partition's share stays
    whole; ``blocks.cut_blocks`` cuts such."""
    parts = parts or int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = coded.withColumn("_bucket", F.pmod(F.xxhash64(*(c for c in ("obs_id", "order", "seq_id", "block") if c in coded.columns)), F.lit(buckets)))
    sums = rows.groupBy("_bucket").agg(F.sum(F.coalesce(F.size("codes"), F.lit(0)).cast("long") + 1).alias("_sum"))  # a row a bucket
    over = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("_sum").over(over) - F.col("_sum") / 2
    total = F.sum("_sum").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    part = F.least(F.floor(middle * parts / total), F.lit(parts - 1)).cast("int")
    placed = rows.join(F.broadcast(sums.select("_bucket", part.alias("_part"))), "_bucket")
    return placed.repartitionById(parts, F.col("_part")).select(*coded.columns)
