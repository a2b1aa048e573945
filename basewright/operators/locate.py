"""Joins of points and intervals, sequence lookup, and masks of positions by partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewright.functions.sequences import reverse_complement
from basewright.operators.intervals import PARTITIONS, coalesce_runs, deltas, segments
from basewright.sources.genome import TILE
from basewright.sources.shared import merged

#: Powers of two of the bin sizes of range joins.
LEVELS = (8, 11, 14, 17, 20, 23, 26, 29)
STRANDED = {"exon": True, "periexonic": True, "intergenic": False}


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose spans overlap, by an equi-join on bins.

    A right row stands in bins of the least level, a power of two, that is no less than its length, so in two at most
    (more only if it is longer than the greatest); a left row looks into the bins it touches at every level. A pair
    is taken in the first bin that both have. Columns of the two sides must differ but for the keys.
    """
    lo, hi = F.col(right_span[0]), F.col(right_span[1])
    level = F.coalesce(*(F.when(hi - lo + 1 <= 1 << x, x) for x in LEVELS), F.lit(LEVELS[-1]))
    size = F.pow(F.lit(2.0), F.col("_level")).cast("long")
    right = right.where(lo <= hi).withColumn("_level", level).withColumn("_bin", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))))
    a, b = F.col(left_span[0]), F.col(left_span[1])
    left = left.where(a <= b).withColumn("_level", F.explode(F.array(*map(F.lit, LEVELS))))
    left = left.withColumn("_bin", F.explode(F.sequence(F.floor(a / size), F.floor(b / size))))
    joined = merged(left, right, [*keys, "_level", "_bin"])
    return joined.where((a <= hi) & (lo <= b) & (F.col("_bin") == F.floor(F.greatest(a, lo) / size))).drop("_level", "_bin")


def locate_metacoord(points: DataFrame, partitions: DataFrame) -> DataFrame:
    """``points(partition, point)`` with the feature of ``partitions`` (with metacoordinates) that holds each, its
    bounds and strand ("0" if the partition has none); found is false, and these null, for points in no feature."""
    spans = partitions.select("partition", "seqid", "start", "end", "meta_start", "meta_end", F.coalesce("strand", F.lit("0")).alias("strand"))
    hit = overlap_join(points.select("partition", "point").distinct(), spans, ["partition"], ("point", "point"), ("meta_start", "meta_end"))
    return merged(points, hit, ["partition", "point"], "left").withColumn("found", F.col("seqid").isNotNull())


def meta_to_scaffold(windows: DataFrame, partitions: DataFrame) -> DataFrame:
    """``windows(partition, meta_from, meta_to)`` with seqid, scaffold_start, scaffold_end, strand."""
    found = locate_metacoord(windows.withColumn("point", F.col("meta_from")), partitions)
    offset = F.col("meta_from") - F.col("meta_start")
    out = found.withColumns({"scaffold_start": F.col("start") + offset, "scaffold_end": F.col("start") + offset + F.col("meta_to") - F.col("meta_from")})
    return out.select(*windows.columns, "seqid", "scaffold_start", "scaffold_end", "strand")


def orientation(strand: Column, seed: int | None, *key: Column) -> Column:
    """``+`` or ``-``: the strand, or for "0" ``+`` if ``seed`` is None and a hash of the key otherwise; an error else."""
    free = F.lit("+") if seed is None else F.when(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(2)) == 0, "+").otherwise("-")
    return F.when(strand.isin("+", "-"), strand).when(strand == "0", free).otherwise(F.raise_error(F.concat(F.lit("no strand: "), F.coalesce(strand, F.lit("null")))))


def fetch_sequence(regions: DataFrame, tiles: DataFrame, seed: int | None = None, tile: int = TILE) -> DataFrame:
    """``regions(seqid, start, end, strand, ...)`` with sequence and orientation; a region that does not lie within its
    scaffold is an error."""
    rows = regions.where("start <= end").select(F.struct(*regions.columns).alias("_row"), "seqid", "start", "end")
    first, last = F.floor((F.col("start") - 1) / tile), F.floor((F.col("end") - 1) / tile)
    spots = rows.withColumn("tile", F.explode(F.sequence(first, last)))
    joined = merged(spots, tiles, ["seqid", "tile"], "left")
    low = F.greatest(F.col("start"), F.col("tile_start"))
    piece = F.substring("seq", (low - F.col("tile_start") + 1).cast("int"), (F.col("end") - low + 1).cast("int"))
    # rows alike in all columns are one group, whose pieces are as many as one row's; how often each tile came tells how many rows
    pieces = joined.groupBy("_row", "seqid", "start", "end").agg(F.collect_set(F.struct("tile", piece.alias("piece"))).alias("_pieces"), F.count("*").alias("_n"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), (F.col("_n") / (last - first + 1)).cast("long")))
    whole = F.array_join(F.transform(F.array_sort("_pieces"), lambda p: p["piece"]), "")
    size = F.col("_row.end") - F.col("_row.start") + 1
    off = F.raise_error(F.concat(F.lit("region off its scaffold: "), F.coalesce("_row.seqid", F.lit("null")), F.lit(":"), F.col("_row.start"), F.lit("-"), F.col("_row.end")))
    out = pieces.withColumn("_copy", copies).select("_row.*", F.when(F.length(whole) == size, whole).otherwise(off).alias("sequence"))
    out = out.withColumn("orientation", orientation(F.col("strand"), seed, F.col("seqid"), F.col("start"), F.col("end")))
    return out.withColumn("sequence", F.when(F.col("orientation") == "-", reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))


def pad_positions(positions: DataFrame, scaffolds: DataFrame, tiles: DataFrame, pad: int, tile: int = TILE) -> DataFrame:
    """``positions(pos_id, seqid, start, end)`` with pad_start, rel_start, seq_offset and the sequence from pad_start
    to end on ``+``. Only the 5' side is padded; sequences with an ambiguous base, and unknown scaffolds, are dropped."""
    if pad < 0:
        raise ValueError("pad must not be negative")
    rows = positions.join(scaffolds.select("seqid"), "seqid", "left_semi").withColumn("pad_start", F.greatest(F.lit(1), F.col("start") - pad))
    rows = rows.withColumn("rel_start", F.col("start") - F.col("pad_start")).withColumn("seq_offset", pad - F.col("rel_start"))
    regions = rows.select("*", F.col("start").alias("_start")).withColumn("start", F.col("pad_start")).withColumn("strand", F.lit("+"))
    out = fetch_sequence(regions, tiles, tile=tile).withColumn("start", F.col("_start"))
    return out.where(~F.col("sequence").rlike("[^ACGT]")).select(*positions.columns, "pad_start", "rel_start", "seq_offset", "sequence")


def partition_mask(positions: DataFrame, partitions: DataFrame, strict: bool = True) -> DataFrame:
    """(pos_id, run_start, run_end, partition_code, strand): runs of one partition and strand (+1, -1; 0 for
    intergenic) along each of ``positions(pos_id, seqid, pad_start, end)``, in offsets from its first base.

    Where partitions overlap, exon goes before periexonic before intergenic. With ``strict`` a base of no partition
    is an error, else it is in no run.
    """
    spans = partitions.select("seqid", "partition", "strand", F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    hits = overlap_join(positions.select("pos_id", "seqid", "pad_start", F.col("end").alias("_end")), spans, ["seqid"], ("pad_start", "_end"), ("_lo", "_hi"))
    hits = hits.select("pos_id", "partition", "strand", (F.greatest("_lo", "pad_start") - F.col("pad_start") + 1).alias("start"), (F.least("_hi", "_end") - F.col("pad_start") + 1).alias("end"))
    is_ = lambda p: (F.col("partition") == p).cast("int")
    plus = F.coalesce(F.col("strand") == "+", F.lit(False)).cast("int")
    counters = {"exon": is_("exon"), "exon_plus": is_("exon") * plus, "peri": is_("periexonic"), "peri_plus": is_("periexonic") * plus, "inter": is_("intergenic")}
    s = segments(deltas(hits, ["pos_id"], **counters), ["pos_id"], list(counters))
    sign = lambda c: F.when(F.col(c) > 0, 1).otherwise(-1)
    code = F.when(F.col("exon") > 0, PARTITIONS["exon"]).when(F.col("peri") > 0, PARTITIONS["periexonic"]).when(F.col("inter") > 0, PARTITIONS["intergenic"])
    strand = F.when(F.col("exon") > 0, sign("exon_plus")).when(F.col("peri") > 0, sign("peri_plus")).otherwise(0)
    pieces = s.select("pos_id", "start", "end", code.alias("partition_code"), strand.alias("strand")).where("partition_code IS NOT NULL")
    runs = coalesce_runs(pieces, ["pos_id", "partition_code", "strand"]).select("pos_id", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "partition_code", "strand")
    if strict:
        have = F.sum(F.col("run_end") - F.col("run_start") + 1).over(Window.partitionBy("pos_id"))
        need = positions.groupBy("pos_id").agg(F.max(F.col("end") - F.col("pad_start") + 1).alias("_need"))
        bad = F.raise_error(F.concat(F.lit("bases in no partition at "), F.col("pos_id").cast("string")))
        whole = merged(runs.withColumn("_have", have), need, "pos_id", "right")
        runs = whole.withColumn("run_start", F.when(F.coalesce("_have", F.lit(0)) == F.col("_need"), F.col("run_start")).otherwise(bad.cast("long"))).select(*runs.columns)
    return runs


def dense_mask(runs: DataFrame) -> DataFrame:
    """(pos_id, position, partition_code, strand), one row a base."""
    return runs.select("pos_id", F.explode(F.sequence("run_start", "run_end")).alias("position"), "partition_code", "strand")


def _fragments(runs: DataFrame) -> DataFrame:
    """(pos_id, frag_start, frag_end, partition_code, strand): longest runs of one partition, with the strand of their
    first base. Runs of a mask are disjoint, so a fragment starts where a run of its own does."""
    pieces = runs.select("pos_id", "partition_code", F.col("run_start").alias("start"), F.col("run_end").alias("end"))
    whole = coalesce_runs(pieces, ["pos_id", "partition_code"]).withColumnsRenamed({"start": "frag_start", "end": "frag_end"})
    first = runs.select("pos_id", F.col("run_start").alias("frag_start"), "strand")
    return merged(whole, first, ["pos_id", "frag_start"]).select("pos_id", "frag_start", "frag_end", "partition_code", "strand")


def fragment_by_partition(positions: DataFrame, runs: DataFrame) -> DataFrame:
    """(pos_id, frag_start, frag_end, partition_code, strand, fragment): longest runs of one partition; the fragment is
    reverse-complemented where the strand at its first base is -1."""
    out = merged(_fragments(runs), positions.select("pos_id", "sequence"), "pos_id")
    piece = F.substring("sequence", F.col("frag_start").cast("int"), (F.col("frag_end") - F.col("frag_start") + 1).cast("int"))
    return out.select("pos_id", "frag_start", "frag_end", "partition_code", "strand", F.when(F.col("strand") == -1, reverse_complement(piece)).otherwise(piece).alias("fragment"))


def tiled_fragments(positions: DataFrame, runs: DataFrame, tiles: DataFrame, order: int = 0, size: int = TILE, tile: int = TILE) -> DataFrame:
    """As ``fragment_by_partition``, but in blocks of ``size`` k-mers in the fragment's orientation, with the ``order``
    bases that the last of them need, fetched from tiles: with block (from 0), last and block_start. ``positions(pos_id,
    seqid, pad_start)`` have no sequence, and no row holds one. Fragments of up to ``order`` bases have no k-mer and
    one block."""
    rows = merged(_fragments(runs), positions.select("pos_id", "seqid", "pad_start"), "pos_id")
    bases = F.col("frag_end") - F.col("frag_start") + 1
    last = F.greatest(F.ceil((bases - order) / size), F.lit(1)).cast("int") - 1
    rows = rows.withColumn("_last", last).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_last")))).withColumn("block_start", F.col("block").cast("long") * size)
    stop = F.least(bases, F.col("block_start") + size + order)  # of the block's bases, from the fragment's first in its orientation
    zero = F.col("pad_start") - 1
    back = F.col("strand") == -1
    start = zero + F.when(back, F.col("frag_end") - stop + 1).otherwise(F.col("frag_start") + F.col("block_start"))
    end = zero + F.when(back, F.col("frag_end") - F.col("block_start")).otherwise(F.col("frag_start") + stop - 1)
    regions = rows.withColumn("_strand", F.col("strand")).select("pos_id", "frag_start", "frag_end", "partition_code", "_strand", "block", (F.col("block") == F.col("_last")).alias("last"), "block_start", "seqid", start.alias("start"), end.alias("end"), F.when(back, "-").otherwise("+").alias("strand"))
    out = fetch_sequence(regions, tiles, tile=tile)
    return out.select("pos_id", "frag_start", "frag_end", "partition_code", F.col("_strand").alias("strand"), "block", "last", "block_start", F.col("sequence").alias("fragment"))
