"""Interval set operations on 1-based, inclusive coordinates.

All of them are one sweep: interval ends become deltas of counters at positions, and running sums of the deltas give
the counters of every atomic segment between two positions. Running sums are taken in two levels, within fixed bins
of positions and over the bins of a key, so that a long chromosome is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewright.sources.shared import merged

BIN = 1 << 20
PARTITIONS = {"intergenic": 1, "periexonic": 2, "exon": 3}


def select_features(features: DataFrame, kind: str, exclude: str = "MT") -> DataFrame:
    """Rows of one type off the excluded scaffold; strand is kept for CDS and gene."""
    strand = ["strand"] if kind in ("CDS", "gene") else []
    return features.where((F.col("type") == kind) & (F.col("seqid") != exclude)).select("seqid", "start", "end", *strand)


def pad_features(features: DataFrame, scaffolds: DataFrame, pad: int) -> DataFrame:
    """Features widened by ``pad`` on both sides within their scaffold."""
    ends = scaffolds.select("seqid", F.col("end").alias("_last"))
    rows = features.join(ends, "seqid")
    return rows.withColumns({"start": F.greatest(F.col("start") - pad, F.lit(1)), "end": F.least(F.col("end") + pad, F.col("_last"))}).drop("_last")


def deltas(intervals: DataFrame, keys: Sequence[str], **counters: Column) -> DataFrame:
    """(keys, pos, counters): each counter added at an interval's start and taken back after its end."""
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("sign")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("sign")))
    rows = intervals.where("start <= end").select(*keys, *(c.cast("long").alias(n) for n, c in counters.items()), F.explode(ends).alias("e"))
    return rows.select(*keys, F.col("e.pos").alias("pos"), *((F.col(n) * F.col("e.sign")).alias(n) for n in counters))


def segments(events: DataFrame, keys: Sequence[str], counters: Sequence[str], bin_size: int = BIN, mark: str | None = None) -> DataFrame:
    """(keys, start, end, counters) between positions at which some counter changes.

    mark: a column of the events whose greatest value at a segment's start is returned as well. Events are shuffled
    once, by key and bin; what is shuffled by key alone is a row a bin.
    """
    keys, counters = list(keys), list(counters)
    changed = " OR ".join(f"{c} != 0" for c in counters)
    e = events.withColumn("bin", F.floor(F.col("pos") / bin_size)).repartition(*keys, "bin")
    marks = [] if mark is None else [F.max(mark).alias(mark)]
    e = e.groupBy(*keys, "bin", "pos").agg(*(F.sum(c).alias(c) for c in counters), *marks).where(changed)
    # bins read all that e has, so that one shuffle of the events serves both
    bins = e.groupBy(*keys, "bin").agg(*(F.sum(c).alias(c) for c in counters), F.min("pos").alias("first"), *([] if mark is None else [F.max(mark).alias("most")]))
    over = Window.partitionBy(*keys).orderBy("bin")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "bin", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in counters), F.lead("first").over(over).alias("following"), *([] if mark is None else ["most"]))
    within = Window.partitionBy(*keys, "bin").orderBy("pos")
    rows = merged(e, bins, [*keys, "bin"])
    out = rows.select(
        *keys, F.col("pos").alias("start"), (F.coalesce(F.lead("pos").over(within), "following") - 1).alias("end"),
        *((F.col(f"{c}_before") + F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0))).alias(c) for c in counters), *([] if mark is None else [F.least(mark, "most").alias(mark)]),
    )
    return out.where(F.col("end").isNotNull())


def coalesce_runs(pieces: DataFrame, keys: Sequence[str], bin_size: int = BIN) -> DataFrame:
    """Disjoint pieces with neighbours joined: where one ends and the next starts, the deltas cancel."""
    return segments(deltas(pieces, keys, n=F.lit(1)), keys, ["n"], bin_size).where("n > 0").drop("n")


def _stranded(pieces: DataFrame, keys: Sequence[str], bin_size: int) -> DataFrame:
    """Coalesced runs of disjoint ``pieces(keys, start, end, plus)`` with the strand of their first base."""
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("n"), F.col("plus").alias("plus")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("n"), F.lit(None).cast("long").alias("plus")))
    events = pieces.withColumn("plus", F.col("plus").cast("long")).select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*")
    runs = segments(events, keys, ["n"], bin_size, "plus").where("n > 0")
    return runs.select(*keys, "start", "end", F.when(F.col("plus") > 0, "+").otherwise("-").alias("strand"))


def _plus() -> Column:
    return F.coalesce(F.col("strand") == "+", F.lit(False)).cast("int")


def merge_intervals(features: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Union of features per scaffold; touching ones merge. A run is ``+`` if a ``+`` feature covers its first base."""
    pieces = segments(deltas(features, ["seqid"], n=F.lit(1), plus=_plus()), ["seqid"], ["n", "plus"], bin_size).where("n > 0")
    return _stranded(pieces, ["seqid"], bin_size)


def subtract_intervals(a: DataFrame, b: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Union of ``a`` less union of ``b``; the strand of a run is that of ``a`` at its first base."""
    events = deltas(a, ["seqid"], a=F.lit(1), plus=_plus(), b=F.lit(0)).unionByName(deltas(b, ["seqid"], a=F.lit(0), plus=F.lit(0), b=F.lit(1)))
    return _stranded(segments(events, ["seqid"], ["a", "plus", "b"], bin_size).where("a > 0 AND b = 0"), ["seqid"], bin_size)


def complement_intervals(scaffolds: DataFrame, b: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Each scaffold from 1 to its end less union of ``b``, unstranded; scaffolds without features are whole."""
    whole = scaffolds.select("seqid", F.lit(1).cast("long").alias("start"), "end")
    events = deltas(whole, ["seqid"], a=F.lit(1), b=F.lit(0)).unionByName(deltas(b, ["seqid"], a=F.lit(0), b=F.lit(1)))
    return coalesce_runs(segments(events, ["seqid"], ["a", "b"], bin_size).where("a > 0 AND b = 0"), ["seqid"], bin_size)


def partition_genome(features: DataFrame, scaffolds: DataFrame, pad: int = 500, bin_size: int = BIN) -> DataFrame:
    """(partition, seqid, start, end, strand) from one sweep over genes, padded, coding sequences and scaffolds.

    exon: union of CDS. intergenic: scaffolds less padded genes, unstranded. periexonic: padded genes less exons.
    """
    if pad < 0:
        raise ValueError("pad must not be negative")
    genes, cds = select_features(features, "gene"), select_features(features, "CDS")
    genes = pad_features(genes, scaffolds, pad)
    zero = dict.fromkeys(("gene", "gene_plus", "cds", "cds_plus", "whole"), F.lit(0))
    scaffold = scaffolds.where("seqid != 'MT'").select("seqid", F.lit(1).cast("long").alias("start"), "end")
    events = deltas(genes, ["seqid"], **{**zero, "gene": F.lit(1), "gene_plus": _plus()})
    events = events.unionByName(deltas(cds, ["seqid"], **{**zero, "cds": F.lit(1), "cds_plus": _plus()}))
    events = events.unionByName(deltas(scaffold, ["seqid"], **{**zero, "whole": F.lit(1)}))
    s = segments(events, ["seqid"], list(zero), bin_size)
    belongs = F.array_compact(
        F.array(
            F.when(F.col("cds") > 0, F.struct(F.lit("exon").alias("partition"), F.col("cds_plus").alias("plus"))),
            F.when((F.col("gene") > 0) & (F.col("cds") == 0), F.struct(F.lit("periexonic").alias("partition"), F.col("gene_plus").alias("plus"))),
            F.when((F.col("whole") > 0) & (F.col("gene") == 0), F.struct(F.lit("intergenic").alias("partition"), F.lit(0).cast("long").alias("plus"))),
        )
    )
    pieces = s.select("seqid", "start", "end", F.explode(belongs).alias("p")).select("p.partition", "seqid", "start", "end", "p.plus")
    runs = _stranded(pieces, ["partition", "seqid"], bin_size)
    return runs.withColumn("strand", F.when(F.col("partition") != "intergenic", F.col("strand")))


def partition_sizes(partitions: DataFrame) -> DataFrame:
    return partitions.groupBy("partition").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


def add_metacoordinates(features: DataFrame, key: str = "partition", bin_size: int = BIN) -> DataFrame:
    """``features`` with meta_start and meta_end, their places in the gapless row of a key's features by (seqid, start,
    end)."""
    rows = features.withColumn("_length", F.col("end") - F.col("start") + 1).withColumn("_bin", F.floor(F.col("start") / bin_size))
    rows = rows.repartition(key, "seqid", "_bin")
    # bins read all that rows have, so that one shuffle serves both
    bins = rows.groupBy(key, "seqid", "_bin").agg(F.sum("_length").alias("_bases"), F.max(F.struct(*features.columns)).alias("_most"))
    before = Window.partitionBy(key).orderBy("seqid", "_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(key, "seqid", "_bin", F.when(F.col("_most").isNotNull(), F.coalesce(F.sum("_bases").over(before), F.lit(0))).alias("_before"))
    within = Window.partitionBy(key, "seqid", "_bin").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = merged(rows, bins, [key, "seqid", "_bin"]).withColumn("meta_end", F.col("_before") + F.sum("_length").over(within))
    return rows.withColumn("meta_start", F.col("meta_end") - F.col("_length") + 1).select(*features.columns, "meta_start", "meta_end")


def scaffold_table(features: DataFrame) -> DataFrame:
    """Scaffolds with metacoordinates: supercontig rows, then chromosome rows, each by (seqid, start)."""
    kinds = [select_features(features, k).select(F.lit(i).alias("_kind"), "seqid", "start", "end") for i, k in enumerate(("supercontig", "chromosome"))]
    rows = add_metacoordinates(kinds[0].unionByName(kinds[1]), "_kind")
    first = rows.where("_kind = 0").agg(F.coalesce(F.max("meta_end"), F.lit(0)).alias("_first"))  # one row
    rows = rows.join(F.broadcast(first)).withColumn("_shift", F.when(F.col("_kind") == 1, F.col("_first")).otherwise(0))
    return rows.select("seqid", "start", "end", (F.col("meta_start") + F.col("_shift")).alias("meta_start"), (F.col("meta_end") + F.col("_shift")).alias("meta_end"))
