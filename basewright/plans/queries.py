"""Registered queries of the sequence-model operators, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.functions import numbers, sequences
from basewright.operators import blocks, coding, hmm, intervals, jobs, locate, reports, sampling
from basewright.plans import views
from basewright.sources import genome
from basewright.plans.views import VIEW_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PAD = 500
TILE = 4096
#: Of each partition's bases that are sampled for training and tests, as in the reference's tests.
SHARE = 0.1


def query(sql: str | None = None, *needs: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ctes = [VIEW_SQL[n] if n in VIEW_SQL else n for n in needs]
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


# Intervals

_GENES = """genes AS (SELECT f.seqid, greatest(f."start" - 500, 1) AS "start", least(f."end" + 500, s."end") AS "end", strand FROM v_features f JOIN v_scaffolds s USING (seqid) WHERE type = 'gene' AND f.seqid <> 'MT')"""
_PARTS = """ev AS (
  SELECT seqid, "start" AS pos, 1 AS g, CAST(strand = '+' AS INT) AS gp, 0 AS c, 0 AS cp, 0 AS w FROM genes
  UNION ALL SELECT seqid, "end" + 1, -1, -CAST(strand = '+' AS INT), 0, 0, 0 FROM genes
  UNION ALL SELECT seqid, "start", 0, 0, 1, CAST(strand = '+' AS INT), 0 FROM v_features WHERE type = 'CDS' AND seqid <> 'MT'
  UNION ALL SELECT seqid, "end" + 1, 0, 0, -1, -CAST(strand = '+' AS INT), 0 FROM v_features WHERE type = 'CDS' AND seqid <> 'MT'
  UNION ALL SELECT seqid, 1, 0, 0, 0, 0, 1 FROM v_scaffolds WHERE seqid <> 'MT'
  UNION ALL SELECT seqid, "end" + 1, 0, 0, 0, 0, -1 FROM v_scaffolds WHERE seqid <> 'MT'
), es AS (SELECT seqid, pos, sum(g) AS g, sum(gp) AS gp, sum(c) AS c, sum(cp) AS cp, sum(w) AS w FROM ev GROUP BY ALL),
sg AS (SELECT seqid, pos AS s, lead(pos) OVER o - 1 AS e, sum(g) OVER o AS g, sum(gp) OVER o AS gp, sum(c) OVER o AS c, sum(cp) OVER o AS cp, sum(w) OVER o AS w FROM es WINDOW o AS (PARTITION BY seqid ORDER BY pos)),
pc AS (
  SELECT 'exon' AS "partition", seqid, s, e, CASE WHEN cp > 0 THEN '+' ELSE '-' END AS strand FROM sg WHERE c > 0 AND e IS NOT NULL
  UNION ALL SELECT 'periexonic', seqid, s, e, CASE WHEN gp > 0 THEN '+' ELSE '-' END FROM sg WHERE g > 0 AND c = 0 AND e IS NOT NULL
  UNION ALL SELECT 'intergenic', seqid, s, e, NULL FROM sg WHERE w > 0 AND g = 0 AND e IS NOT NULL
), fl AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY "partition", seqid ORDER BY s) + 1 = s THEN 0 ELSE 1 END AS new FROM pc),
isl AS (SELECT *, sum(new) OVER (PARTITION BY "partition", seqid ORDER BY s) AS n FROM fl),
parts AS (SELECT "partition", seqid, min(s) AS "start", max(e) AS "end", first(strand ORDER BY s) AS strand FROM isl GROUP BY "partition", seqid, n)"""
_NEED_PARTS = ("features", "scaffolds", _GENES, _PARTS)
_META = """meta AS (SELECT *, CAST(sum("end" - "start" + 1) OVER (PARTITION BY "partition" ORDER BY seqid, "start") AS BIGINT) AS meta_end FROM parts),
metas AS (SELECT *, meta_end - ("end" - "start") AS meta_start FROM meta)"""


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.partition_genome(views.features(spark, sf_dir), views.scaffolds(spark, sf_dir), PAD)


@query("""SELECT seqid, "start", "end", strand FROM v_features WHERE type = 'CDS' AND seqid <> 'MT'""", "features")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.select_features(views.features(spark, sf_dir), "CDS")


@query('SELECT * FROM genes', "features", "scaffolds", _GENES)
def pad_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pad_features(intervals.select_features(views.features(spark, sf_dir), "gene"), views.scaffolds(spark, sf_dir), PAD)


@query(
    """SELECT seqid, min("start") AS "start", max("end") AS "end", CASE WHEN max(CASE WHEN "start" = first_start AND strand = '+' THEN 1 ELSE 0 END) = 1 THEN '+' ELSE '-' END AS strand
    FROM (SELECT *, min("start") OVER (PARTITION BY seqid, n) AS first_start FROM (SELECT *, sum(new) OVER (PARTITION BY seqid ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS n
    FROM (SELECT *, CASE WHEN max("end") OVER (PARTITION BY seqid ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= "start" THEN 0 ELSE 1 END AS new FROM v_features WHERE type = 'CDS' AND seqid <> 'MT'))) GROUP BY seqid, n""",
    "features",
)
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(intervals.select_features(views.features(spark, sf_dir), "CDS"))


@query("""SELECT seqid, "start", "end", strand FROM parts WHERE "partition" = 'periexonic'""", *_NEED_PARTS)
def subtract_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.subtract_intervals(pad_features(spark, sf_dir), select_features(spark, sf_dir))


@query("""SELECT seqid, "start", "end" FROM parts WHERE "partition" = 'intergenic'""", *_NEED_PARTS)
def complement_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.complement_intervals(views.scaffolds(spark, sf_dir).where("seqid != 'MT'"), pad_features(spark, sf_dir))


@query("SELECT * FROM parts", *_NEED_PARTS)
def partition_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partitions(spark, sf_dir)


@query("""SELECT "partition", CAST(sum("end" - "start" + 1) AS BIGINT) AS bases FROM parts GROUP BY 1""", *_NEED_PARTS)
def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.partition_sizes(_partitions(spark, sf_dir))


@query('SELECT "partition", seqid, "start", "end", strand, meta_start, meta_end FROM metas', *_NEED_PARTS, _META)
def add_metacoordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.add_metacoordinates(_partitions(spark, sf_dir))


@query(
    """SELECT seqid, CAST(1 AS BIGINT) AS "start", e AS "end", CAST(sum(e) OVER w AS BIGINT) - e + 1 AS meta_start, CAST(sum(e) OVER w AS BIGINT) AS meta_end
    FROM (SELECT 'S' || o_orderkey || '.' || o_custkey || '.' || count(*) AS seqid, o_orderkey % 5000 + 100 AS e, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS k FROM orders GROUP BY o_orderkey, o_custkey) WINDOW w AS (ORDER BY k, seqid)"""
)
def scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("n"))
    name = F.concat(F.lit("S"), "o_orderkey", F.lit("."), "o_custkey", F.lit("."), "n")
    kind = F.when(F.col("o_orderkey") % 10 == 0, "chromosome").otherwise("supercontig")
    return intervals.scaffold_table(rows.select(name.alias("seqid"), kind.alias("type"), F.lit(1).cast("long").alias("start"), (F.col("o_orderkey") % 5000 + 100).alias("end")))


@query(
    """SELECT CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey % 25 + 1 AS VARCHAR) ELSE 'scaffold' || (l_suppkey % 7) END AS id, count(*) AS n FROM lineitem GROUP BY 1"""
)
def rectify_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("CM00"), F.col("l_suppkey") % 25 + 2885, F.lit(".2.1"))).otherwise(F.concat(F.lit("scaffold"), F.col("l_suppkey") % 7))
    return table(spark, sf_dir, "lineitem").groupBy(sequences.rectify_identifier(name).alias("id")).agg(F.count("*").alias("n"))


# Lookups

_POINTS = """points AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'exon' WHEN 1 THEN 'periexonic' ELSE 'intergenic' END AS "partition", (o_custkey * 7919 + o_orderkey) % 400000 + 1 AS point FROM orders)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.element_at(F.array(F.lit("exon"), F.lit("periexonic"), F.lit("intergenic")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", part.alias("partition"), ((F.col("o_custkey") * 7919 + F.col("o_orderkey")) % 400000 + 1).alias("point"))


@query(
    """SELECT p.o_orderkey, p."partition", p.point, seqid, "start", "end", meta_start, meta_end, CASE WHEN seqid IS NOT NULL THEN coalesce(strand, '0') END AS strand, seqid IS NOT NULL AS found
    FROM points p LEFT JOIN metas m ON p."partition" = m."partition" AND p.point BETWEEN meta_start AND meta_end""",
    *_NEED_PARTS, _META, _POINTS,
)
def locate_metacoord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.locate_metacoord(_points(spark, sf_dir), add_metacoordinates(spark, sf_dir))


@query(
    """SELECT p.o_orderkey, p."partition", p.point AS meta_from, p.point + 9 AS meta_to, seqid, "start" + p.point - meta_start AS scaffold_start, "start" + p.point - meta_start + 9 AS scaffold_end, CASE WHEN seqid IS NOT NULL THEN coalesce(strand, '0') END AS strand
    FROM points p LEFT JOIN metas m ON p."partition" = m."partition" AND p.point BETWEEN meta_start AND meta_end""",
    *_NEED_PARTS, _META, _POINTS,
)
def meta_to_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _points(spark, sf_dir).withColumnRenamed("point", "meta_from").withColumn("meta_to", F.col("meta_from") + 9)
    return locate.meta_to_scaffold(windows, add_metacoordinates(spark, sf_dir))


_REGIONS = """regions AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS seqid, seq, 1 + (l_suppkey * 37) % length(seq) AS s, least(length(seq), 1 + (l_suppkey * 37) % length(seq) + CAST(l_quantity AS BIGINT)) AS e, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand
  FROM lineitem JOIN v_seqs ON seq_id = l_partkey)"""


@query(
    """SELECT l_orderkey, l_linenumber, seqid, s AS "start", e AS "end", strand, CASE WHEN strand = '+' THEN substring(seq, s, e - s + 1) ELSE translate(reverse(substring(seq, s, e - s + 1)), 'ACGT', 'TGCA') END AS sequence, strand AS orientation FROM regions""",
    "seqs", _REGIONS,
)
def fetch_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.fetch_sequence(views.doc_regions(spark, sf_dir), views.doc_tiles(spark, sf_dir, TILE), tile=TILE)


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS pos_id, seqid, s AS "start", e AS "end", greatest(1, s - 50) AS pad_start, s - greatest(1, s - 50) AS rel_start, 50 - (s - greatest(1, s - 50)) AS seq_offset, substring(seq, greatest(1, s - 50), e - greatest(1, s - 50) + 1) AS sequence FROM regions""",
    "seqs", _REGIONS,
)
def pad_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = views.doc_regions(spark, sf_dir).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos_id"), "seqid", "start", "end")
    ids = views.seqs(spark, sf_dir).select(F.col("seq_id").cast("string").alias("seqid"))
    return locate.pad_positions(positions, ids, views.doc_tiles(spark, sf_dir, TILE), 50, tile=TILE)


_POS = """pos AS (SELECT o_orderkey AS pos_id, CAST(o_custkey % 9 AS VARCHAR) AS seqid, o_orderkey * 1000 + 1 AS s, o_orderkey * 1000 + 500 + o_custkey % 800 AS e FROM (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY 1))"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("c"))
    return rows.select(F.col("o_orderkey").alias("pos_id"), (F.col("c") % 9).cast("string").alias("seqid"), (F.col("o_orderkey") * 1000 + 1).alias("pad_start"), (F.col("o_orderkey") * 1000 + 500 + F.col("c") % 800).alias("end"))


@query(
    """SELECT pos_id, sum(CASE "partition" WHEN 'exon' THEN n ELSE 0 END)::BIGINT AS exon, sum(CASE "partition" WHEN 'periexonic' THEN n ELSE 0 END)::BIGINT AS periexonic,
    (max(len) - sum(CASE "partition" WHEN 'intergenic' THEN 0 ELSE n END))::BIGINT AS intergenic
    FROM (SELECT pos_id, p."partition", least(pos.e, p."end") - greatest(pos.s, p."start") + 1 AS n, pos.e - pos.s + 1 AS len FROM pos JOIN parts p ON p.seqid = pos.seqid AND p."start" <= pos.e AND p."end" >= pos.s) GROUP BY pos_id""",
    *_NEED_PARTS, _POS,
)
def partition_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = locate.partition_mask(_positions(spark, sf_dir), _partitions(spark, sf_dir), strict=False)
    size = lambda c: F.sum(F.when(F.col("partition_code") == c, F.col("run_end") - F.col("run_start") + 1).otherwise(0))
    return runs.groupBy("pos_id").agg(size(3).alias("exon"), size(2).alias("periexonic"), size(1).alias("intergenic"))


#: Masks give exon before periexonic before intergenic; a base of several of one kind is + if any of them is.
_RUNS = """hits AS (SELECT pos_id, p."partition" AS part, p.strand, greatest(p."start", pos.s) - pos.s + 1 AS s, least(p."end", pos.e) - pos.s + 1 AS e FROM pos JOIN parts p ON p.seqid = pos.seqid AND p."start" <= pos.e AND p."end" >= pos.s),
cuts AS (SELECT DISTINCT pos_id, x FROM (SELECT pos_id, s AS x FROM hits UNION ALL SELECT pos_id, e + 1 FROM hits)),
atoms AS (SELECT pos_id, x AS s, lead(x) OVER (PARTITION BY pos_id ORDER BY x) - 1 AS e FROM cuts),
coded AS (SELECT a.pos_id, a.s, a.e, max(CASE part WHEN 'exon' THEN 3 WHEN 'periexonic' THEN 2 ELSE 1 END) AS code,
  CASE max(CASE part WHEN 'exon' THEN 3 WHEN 'periexonic' THEN 2 ELSE 1 END) WHEN 3 THEN max(CASE WHEN part = 'exon' THEN CASE WHEN strand = '+' THEN 1 ELSE -1 END END) WHEN 2 THEN max(CASE WHEN part = 'periexonic' THEN CASE WHEN strand = '+' THEN 1 ELSE -1 END END) ELSE 0 END AS strand
  FROM atoms a JOIN hits h ON h.pos_id = a.pos_id AND h.s <= a.s AND h.e >= a.e WHERE a.e IS NOT NULL GROUP BY ALL),
edges AS (SELECT *, CASE WHEN lag(e) OVER o + 1 = s AND lag(code) OVER o = code AND lag(strand) OVER o = strand THEN 0 ELSE 1 END AS new FROM coded WINDOW o AS (PARTITION BY pos_id ORDER BY s)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY pos_id ORDER BY s) AS n FROM edges),
runs AS (SELECT pos_id, min(s) AS run_start, max(e) AS run_end, any_value(code)::BIGINT AS partition_code, any_value(strand)::BIGINT AS strand FROM numbered GROUP BY pos_id, n)"""
_FRAGS = """fedges AS (SELECT *, CASE WHEN lag(run_end) OVER o + 1 = run_start AND lag(partition_code) OVER o = partition_code THEN 0 ELSE 1 END AS new FROM runs WINDOW o AS (PARTITION BY pos_id ORDER BY run_start)),
fnumbered AS (SELECT *, sum(new) OVER (PARTITION BY pos_id ORDER BY run_start) AS n FROM fedges),
frags AS (SELECT pos_id, min(run_start) AS frag_start, max(run_end) AS frag_end, any_value(partition_code) AS partition_code, first(strand ORDER BY run_start) AS strand FROM fnumbered GROUP BY pos_id, n),
cutout AS (SELECT f.*, CASE WHEN strand = -1 THEN translate(reverse(substring(seq, frag_start, frag_end - frag_start + 1)), 'ACGT', 'TGCA') ELSE substring(seq, frag_start, frag_end - frag_start + 1) END AS fragment FROM frags f JOIN v_seqs ON seq_id = pos_id)"""
_DOC_POS = """pos AS (SELECT seq_id AS pos_id, CAST(seq_id AS VARCHAR) AS seqid, 1 AS s, length(seq) AS e FROM v_seqs)"""
_NEED_DOCS = ("seqs", "doc_features", "doc_scaffolds", _GENES, _PARTS, _DOC_POS, _RUNS, _FRAGS)


@query("SELECT pos_id, run_start, run_end, partition_code, strand FROM runs", *_NEED_PARTS, _POS, _RUNS)
def partition_mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs and strands of positions on scaffolds."""
    return _wide(locate.partition_mask(_positions(spark, sf_dir), _partitions(spark, sf_dir), strict=False))


def _doc_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as positions."""
    return views.doc_scaffolds(spark, sf_dir).select(F.col("seqid").cast("long").alias("pos_id"), "seqid", F.col("start").alias("pad_start"), "end")


def _doc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = intervals.partition_genome(views.doc_features(spark, sf_dir), views.doc_scaffolds(spark, sf_dir), PAD)
    return views.written(locate.partition_mask(_doc_positions(spark, sf_dir), parts))


@query("SELECT pos_id, frag_start, frag_end, partition_code, strand, md5(fragment) AS digest FROM cutout", *_NEED_DOCS)
def fragment_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of whole documents, which are scaffolds that have features."""
    rows = views.seqs(spark, sf_dir).select(F.col("seq_id").alias("pos_id"), F.col("seq").alias("sequence"))
    return _wide(locate.fragment_by_partition(rows, _doc_runs(spark, sf_dir)).withColumn("digest", F.md5("fragment")).drop("fragment"))


def _doc_blocks(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    return locate.tiled_fragments(_doc_positions(spark, sf_dir), _doc_runs(spark, sf_dir), views.doc_tiles(spark, sf_dir, TILE), order, 1024, TILE)


@query(
    """SELECT pos_id, frag_start, frag_end, partition_code, strand, b AS block, b = greatest(ceil((length(fragment) - 2) / 1024), 1) - 1 AS last, b * 1024 AS block_start, md5(substring(fragment, b * 1024 + 1, 1026)) AS digest
    FROM (SELECT *, unnest(range(greatest(ceil((length(fragment) - 2) / 1024), 1)::BIGINT)) AS b FROM cutout)""",
    *_NEED_DOCS,
)
def tiled_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in blocks of 1,024 3-mers, read from tiles."""
    return _wide(_doc_blocks(spark, sf_dir, 2).withColumn("digest", F.md5("fragment")).drop("fragment"))


# Sampling

_FEATURES = """SELECT "partition", seqid, "start", "end", strand FROM parts"""


@query(
    """SELECT l_orderkey, l_linenumber, lo, hi, point, CASE WHEN b IS NULL AND a IS NULL AND hi - lo + 1 < 90 AND hi - lo + 1 > 20 THEN lo WHEN w < 20 THEN NULL WHEN w > 90 THEN point - k5 + 1 ELSE s END AS win_start,
    CASE WHEN b IS NULL AND a IS NULL AND hi - lo + 1 < 90 AND hi - lo + 1 > 20 THEN hi WHEN w < 20 THEN NULL WHEN w > 90 THEN point + k3 - 1 ELSE e END AS win_end
    FROM (SELECT *, e - s + 1 AS w, CASE WHEN e - point + 1 <= 46 THEN 91 - (e - point + 1) WHEN point - s + 1 <= 45 THEN point - s + 1 ELSE 45 END AS k5, CASE WHEN e - point + 1 <= 46 THEN e - point + 1 WHEN point - s + 1 <= 45 THEN 91 - (point - s + 1) ELSE 46 END AS k3
    FROM (SELECT *, coalesce(b + 1, lo) AS s, coalesce(a - 1, hi) AS e FROM (SELECT l_orderkey, l_linenumber, lo, hi, point, CASE WHEN l_linenumber % 3 = 0 AND point > lo THEN (lo + point) // 2 END AS b, CASE WHEN l_linenumber % 2 = 0 AND point < hi THEN (hi + point + 1) // 2 END AS a
    FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 100 AS lo, l_orderkey * 100 + CAST(l_quantity AS BIGINT) * 4 AS hi, l_orderkey * 100 + l_partkey % (CAST(l_quantity AS BIGINT) * 4 + 1) AS point FROM lineitem))))"""
)
def sample_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.col("l_quantity").cast("long") * 4
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 100).alias("lo"), (F.col("l_orderkey") * 100 + width).alias("hi"), (F.col("l_orderkey") * 100 + F.col("l_partkey") % (width + 1)).alias("point"))
    lo, hi, point = F.col("lo"), F.col("hi"), F.col("point")
    before = F.when((F.col("l_linenumber") % 3 == 0) & (point > lo), F.floor((lo + point) / 2))
    after = F.when((F.col("l_linenumber") % 2 == 0) & (point < hi), F.floor((hi + point + 1) / 2))
    out = rows.withColumn("w", sampling.sample_window(lo, hi, point, before, after, 20, 90))
    return out.select("l_orderkey", "l_linenumber", "lo", "hi", "point", F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"))


@query(
    """SELECT "partition", seqid, "start", "end", strand FROM (SELECT *, coalesce(sum("end" - "start" + 1) OVER (PARTITION BY "partition" ORDER BY ("start" * 7919) % 100003 + 1, seqid, "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts) WHERE before < 20000""",
    *_NEED_PARTS,
)
def take_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.take_budget(_partitions(spark, sf_dir), 20_000, (F.col("start") * 7919) % 100003 + 1)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.seqs(spark, sf_dir)
    parts = docs.select(F.col("obs_id").alias("partition"), F.col("seq_id").cast("string").alias("seqid"), F.lit(1).cast("long").alias("start"), F.length("seq").cast("long").alias("end"), F.lit(None).cast("string").alias("strand"))
    return sampling.sample_partitions(parts, views.doc_tiles(spark, sf_dir, TILE), 5000, 50, 300, tile=TILE, share=SHARE)


@query()
def sample_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)


_DRAWS = """bases AS (SELECT obs_id, CAST(seq_id AS VARCHAR) AS seqid, seq, CAST(sum(length(seq)) OVER (PARTITION BY obs_id ORDER BY CAST(seq_id AS VARCHAR)) AS BIGINT) - length(seq) AS before, CAST(sum(length(seq)) OVER (PARTITION BY obs_id) AS BIGINT) AS total FROM v_seqs),
points AS (SELECT obs_id, d AS draw, 1 + ('0x' || substring(md5(d::VARCHAR), 1, 12))::BIGINT % total AS point FROM (SELECT DISTINCT obs_id, total FROM bases), LATERAL (SELECT unnest(range(0, total // 400 + 1)) AS d)),
placed AS (SELECT b.obs_id, b.seqid, b.seq, length(b.seq) AS hi, p.draw, p.point - b.before AS pt, row_number() OVER (PARTITION BY b.obs_id, b.seqid ORDER BY draw) AS k FROM points p JOIN bases b ON b.obs_id = p.obs_id AND p.point > b.before AND p.point <= b.before + length(b.seq)),
taken(obs_id, seqid, k, starts, ends, s, e, draw) AS (
  SELECT DISTINCT obs_id, seqid, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM placed
  UNION ALL SELECT obs_id, seqid, k, CASE WHEN ok THEN list_append(starts, s) ELSE starts END, CASE WHEN ok THEN list_append(ends, e) ELSE ends END, CASE WHEN ok THEN s END, CASE WHEN ok THEN e END, draw
  FROM (SELECT *, s IS NOT NULL AND NOT (contains(substring(seq, s, e - s + 1), repeat('A', ((e - s + 1) // 10)::INT)) OR contains(substring(seq, s, e - s + 1), repeat('C', ((e - s + 1) // 10)::INT)) OR contains(substring(seq, s, e - s + 1), repeat('G', ((e - s + 1) // 10)::INT)) OR contains(substring(seq, s, e - s + 1), repeat('T', ((e - s + 1) // 10)::INT))) AS ok
  FROM (SELECT *, CASE WHEN inside THEN NULL WHEN b IS NULL AND a IS NULL AND hi < 300 AND hi > 50 THEN 1 WHEN w < 50 THEN NULL WHEN w > 300 THEN pt - k5 + 1 ELSE st END AS s, CASE WHEN b IS NULL AND a IS NULL AND hi < 300 AND hi > 50 THEN hi WHEN w > 300 THEN pt + k3 - 1 ELSE en END AS e
  FROM (SELECT *, en - st + 1 AS w, CASE WHEN en - pt + 1 <= 151 THEN 301 - (en - pt + 1) WHEN pt - st + 1 <= 150 THEN pt - st + 1 ELSE 150 END AS k5, CASE WHEN en - pt + 1 <= 151 THEN en - pt + 1 WHEN pt - st + 1 <= 150 THEN 301 - (pt - st + 1) ELSE 151 END AS k3
  FROM (SELECT *, coalesce(b + 1, 1) AS st, coalesce(a - 1, hi) AS en
  FROM (SELECT p.obs_id, p.seqid, p.seq, p.hi, p.pt, p.k, p.draw, t.starts, t.ends, list_max(list_filter(t.ends, lambda x: x < p.pt)) AS b, list_min(list_filter(t.starts, lambda x: x > p.pt)) AS a, len(list_filter(t.ends, lambda x: x < p.pt)) + len(list_filter(t.starts, lambda x: x > p.pt)) < len(t.starts) AS inside
  FROM taken t JOIN placed p ON p.obs_id = t.obs_id AND p.seqid = t.seqid AND p.k = t.k + 1))))))"""


@query('SELECT obs_id AS "partition", seqid, s AS "start", e AS "end", draw FROM taken WHERE s IS NOT NULL', "seqs", _DRAWS)
def windows_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 to 300 bases round one base in 400, taken in turn and checked."""
    docs = views.seqs(spark, sf_dir)
    parts = views.written(intervals.add_metacoordinates(docs.select(F.col("obs_id").alias("partition"), F.col("seq_id").cast("string").alias("seqid"), F.lit(1).cast("long").alias("start"), F.length("seq").cast("long").alias("end"), F.lit(None).cast("string").alias("strand"))))
    totals = parts.groupBy("partition").agg(F.max("meta_end").alias("total"))
    points = totals.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / 400))))
    points = points.select("partition", (1 + F.conv(F.left(F.md5(F.col("draw").cast("string")), F.lit(12)), 16, 10).cast("long") % F.col("total")).alias("point"), "draw")
    return sampling.windows_at_points(points, parts, views.doc_tiles(spark, sf_dir, TILE), 50, 300, tile=TILE).select("partition", "seqid", "start", "end", "draw")


@query()
def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at random places of a tenth of each partition's bases."""
    docs = views.seqs(spark, sf_dir)
    parts = views.written(intervals.add_metacoordinates(docs.select(F.col("obs_id").alias("partition"), F.col("seq_id").cast("string").alias("seqid"), F.lit(1).cast("long").alias("start"), F.length("seq").cast("long").alias("end"), F.lit(None).cast("string").alias("strand"))))
    return sampling.sample_points(parts, views.doc_tiles(spark, sf_dir, TILE), 5000, 50, 300, tile=TILE, share=SHARE)


@query(
    """SELECT obs_id AS "partition", seq_id, CASE WHEN sum(length(seq)) OVER (PARTITION BY obs_id ORDER BY (seq_id * 31) % 1009, seq_id) <= sum(length(seq)) OVER (PARTITION BY obs_id) // 2 THEN 'train' ELSE 'test' END AS split FROM v_seqs""",
    "seqs",
)
def split_obs_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.seqs(spark, sf_dir).select(F.col("obs_id").alias("partition"), F.col("seq_id").alias("seqid"), F.lit(1).cast("long").alias("start"), F.length("seq").cast("long").alias("end"))
    return sampling.split_obs_sets(rows, key=(F.col("seqid") * 31) % 1009).select("partition", F.col("seqid").alias("seq_id"), "split")


# Files: written from the tables to the shared folder, and read


@query("SELECT CAST(seq_id AS VARCHAR) AS id, 'set ' || obs_id AS description, length(seq) AS n, md5(seq) AS digest FROM v_seqs", "seqs")
def read_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences as FASTA records of 80 bases a line, lower-cased."""
    path = views.shared_path(spark)
    lines = F.regexp_replace(F.lower("seq"), "(.{80})", "$1\n")
    views.seqs(spark, sf_dir).select(F.concat(F.lit(">"), F.col("seq_id"), F.lit(" set "), F.col("obs_id"), F.lit("\n"), lines).alias("value")).write.text(path)
    return genome.read_fasta(spark, path).select("id", "description", F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("digest"))


@query(f"SELECT CAST(seq_id AS VARCHAR) AS seqid, 'set ' || obs_id AS description, t AS tile, t * {TILE} + 1 AS tile_start, md5(substring(seq, t * {TILE} + 1, {TILE})) AS digest FROM (SELECT *, unnest(range((length(seq) + {TILE - 1}) // {TILE})) AS t FROM v_seqs)", "seqs")
def read_fasta_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file read by lines into tiles, whatever the splits' bounds."""
    path = views.shared_path(spark)
    lines = F.regexp_replace(F.lower("seq"), "(.{80})", "$1\n")
    views.seqs(spark, sf_dir).select(F.concat(F.lit(">"), F.col("seq_id"), F.lit(" set "), F.col("obs_id"), F.lit("\n"), lines).alias("value")).write.text(path)
    return genome.read_fasta_tiles(spark, path, TILE).withColumn("digest", F.md5("seq")).drop("seq")


@query('SELECT seqid, type, strand, count(*) AS n, sum("start")::BIGINT AS starts, sum("end")::BIGINT AS ends FROM v_features GROUP BY ALL', "features")
def read_gff3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = views.shared_path(spark)
    dot = F.lit(".")
    rows = views.features(spark, sf_dir).select("seqid", F.lit("made").alias("source"), "type", "start", "end", dot.alias("score"), "strand", dot.alias("phase"), F.lit("ID=x").alias("attributes"))
    rows.write.csv(path, sep="\t")
    return genome.read_gff3(spark, path).groupBy("seqid", "type", "strand").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query("SELECT CAST(seq_id AS VARCHAR) AS seqid, seq_id * 3 + 1 AS pos_start, seq_id * 3 + length(seq) AS pos_end, md5(seq) AS digest FROM v_seqs", "seqs")
def read_position_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = views.shared_path(spark)
    start = F.col("seq_id") * 3 + 1
    head = F.concat(F.lit(">"), F.col("seq_id"), F.lit(" start "), start, F.lit(" end "), start + F.length("seq") - 1)
    views.seqs(spark, sf_dir).select(F.concat(head, F.lit("\n"), "seq").alias("value")).write.text(path)
    return genome.read_position_fasta(spark, path).select("seqid", "pos_start", "pos_end", F.md5("sequence").alias("digest"))


# Sequences and codes


@query(
    """SELECT obs_id, count(*) AS n, count(*) FILTER (WHERE NOT contains(s, 'N') AND length(s) > 0 AND NOT (contains(s, repeat('A', k)) OR contains(s, repeat('C', k)) OR contains(s, repeat('G', k)) OR contains(s, repeat('T', k)))) AS accepted
    FROM (SELECT obs_id, substring(seq, 1, 50) AS s, length(substring(seq, 1, 50)) // 10 AS k FROM v_seqs_n) GROUP BY 1""",
    "seqs_n",
)
def mask_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance of the first 50 bases, the length of a sample, of each sequence."""
    rows = views.seqs(spark, sf_dir, views.BASES_N).withColumn("s", F.left("seq", F.lit(50)))
    return rows.groupBy("obs_id").agg(F.count("*").alias("n"), F.count_if(sequences.mask_check(F.col("s"))).alias("accepted"))


@query(
    """SELECT obs_id, count(*) AS n, count(*) FILTER (WHERE NOT contains(s, 'N') AND NOT (contains(s, repeat('A', k)) OR contains(s, repeat('C', k)) OR contains(s, repeat('G', k)) OR contains(s, repeat('T', k)))) AS accepted
    FROM (SELECT obs_id, s, (length(s) // 10)::INT AS k FROM (SELECT obs_id, substring(seq, i, 50) AS s FROM (SELECT obs_id, seq, unnest(range(1, greatest(2, length(seq) - 48))) AS i FROM v_seqs_n))) GROUP BY 1""",
    "seqs_n",
)
def mask_check_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance of every window of 50 bases of each sequence; a shorter sequence is one window."""
    rows = views.seqs(spark, sf_dir, views.BASES_N)
    n = F.greatest(F.lit(1), F.length("seq") - 49).cast("long")
    return rows.groupBy("obs_id").agg(F.sum(n).alias("n"), F.sum(sequences.windows_passing(F.col("seq"), 50)).alias("accepted"))


_KMERS = """km AS (SELECT obs_id, substring(seq, i, 3) AS kmer FROM (SELECT obs_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM v_seqs WHERE length(seq) > 2))"""


@query(
    """SELECT obs_id, kmer, 1 + (instr('ACGT', kmer[1]) - 1) + 4 * (instr('ACGT', kmer[2]) - 1) + 16 * (instr('ACGT', kmer[3]) - 1) AS code, count(*) AS n FROM km GROUP BY ALL""",
    "seqs", _KMERS,
)
def code_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of order-2 codes by obs set, decoded again to k-mers."""
    rows = views.seqs(spark, sf_dir).select("obs_id", F.lit(2).alias("order"), "seq")
    codes = coding.code_sequences(rows).select("obs_id", F.explode("codes").alias("c")).groupBy("obs_id", F.col("c").cast("long").alias("code")).agg(F.count("*").alias("n"))
    return codes.select("obs_id", sequences.kmer_of(F.col("code"), 2).alias("kmer"), "code", "n")


@query(
    """SELECT obs_id, o AS "order", count(*) AS n_seqs, sum(length(seq) - o)::BIGINT AS n_codes FROM v_seqs, (VALUES (0), (1), (2)) t(o) WHERE length(seq) > o GROUP BY ALL""",
    "seqs",
)
def code_job_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = views.seqs(spark, sf_dir)
    coded = coding.code_job_obs(jobs.job_grid(obs, (1, 2), (0, 1, 2), 2), obs)
    return coded.groupBy("obs_id", "order").agg(F.count("*").alias("n_seqs"), F.sum(F.size("codes").cast("long")).alias("n_codes"))


# Models

_A2, _B2 = [0.6, 0.4], [[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]]
_MOVES2 = [[0.9, 0.1], [0.2, 0.8]]


def _coded(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    rows = views.seqs(spark, sf_dir)
    rows = rows if most is None else rows.withColumn("seq", F.left("seq", F.lit(most)))
    return coding.code_sequences(rows.select("obs_id", F.lit(0).alias("order"), "seq_id", "seq"))


def _models(spark: SparkSession, sf_dir: str, states: int) -> DataFrame:
    """One fixed model for each obs set."""
    lit = lambda x: F.lit(x) if not isinstance(x, list) else F.array(*map(lit, x))
    a, moves, emissions = (_A2, _MOVES2, _B2) if states == 2 else ([1.0], [[1.0]], [_B2[0]])
    rows = views.seqs(spark, sf_dir).select("obs_id").distinct()
    return rows.select("obs_id", F.lit(states).alias("K"), F.lit(0).alias("order"), F.lit(1).alias("replicate"), lit(a).alias("initial"), lit(moves).alias("transition"), lit(emissions).alias("emission"))


@query(
    """SELECT obs_id, seq_id, round(lp + ln(f1 + f2), 6) AS log_p FROM fw WHERE t = length(s)""",
    "seqs",
    """fw AS (
      SELECT obs_id, seq_id, substring(seq, 1, 60) AS s, 1 AS t, 0.6e0 * (0.5e0 - 0.1e0 * instr('ACGT', seq[1])) AS f1, 0.4e0 * (0.1e0 * instr('ACGT', seq[1])) AS f2, 0.0::DOUBLE AS lp FROM v_seqs
      UNION ALL SELECT obs_id, seq_id, s, t + 1, (f1 * 0.9e0 + f2 * 0.2e0) / (f1 + f2) * (0.5e0 - 0.1e0 * instr('ACGT', s[t + 1])), (f1 * 0.1e0 + f2 * 0.8e0) / (f1 + f2) * (0.1e0 * instr('ACGT', s[t + 1])), lp + ln(f1 + f2) FROM fw WHERE t < length(s))""",
)
def obs_log_likelihood_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first 60 bases, a window's length, of each sequence."""
    out = hmm.obs_log_likelihood(_coded(spark, sf_dir, 60), _models(spark, sf_dir, 2))
    return out.select("obs_id", "seq_id", F.round("log_p", 6).alias("log_p"))


@query()
def obs_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each whole sequence, with two states."""
    return hmm.obs_log_likelihood(_coded(spark, sf_dir), _models(spark, sf_dir, 2)).select("obs_id", "seq_id", "log_p")


@query()
def set_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.set_log_likelihood(_coded(spark, sf_dir), _models(spark, sf_dir, 2))


@query()
def state_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.state_posteriors(_coded(spark, sf_dir), _models(spark, sf_dir, 2))


@query(
    """SELECT obs_id, 'B' AS kind, 0::BIGINT AS i, instr('ACGT', c) AS j, round(count(*), 4) AS value FROM (SELECT obs_id, unnest(string_split(seq, '')) AS c FROM v_seqs) WHERE c <> '' GROUP BY ALL
    UNION ALL SELECT obs_id, 'a', 0, 0, round(count(*), 4) FROM v_seqs GROUP BY ALL UNION ALL SELECT obs_id, 'n', 0, 0, round(count(*), 4) FROM v_seqs GROUP BY ALL
    UNION ALL SELECT obs_id, 'A', 0, 0, round(sum(length(seq) - 1), 4) FROM v_seqs GROUP BY ALL
    UNION ALL SELECT obs_id, 'log_p', 0, 0, round(sum(ln(0.5e0 - 0.1e0 * instr('ACGT', c))), 4) FROM (SELECT obs_id, unnest(string_split(seq, '')) AS c FROM v_seqs) WHERE c <> '' GROUP BY ALL""",
    "seqs",
)
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one state, where they are symbol counts."""
    out = hmm.expected_counts(_coded(spark, sf_dir), _models(spark, sf_dir, 1))
    return _wide(out.select("obs_id", "kind", "i", "j", F.round("value", 4).alias("value")))


@query(
    """SELECT obs_id, 'B' AS kind, 0::BIGINT AS i, instr('ACGT', c) AS j, round(count(*) / sum(count(*)) OVER (PARTITION BY obs_id), 8) AS value FROM (SELECT obs_id, unnest(string_split(seq, '')) AS c FROM v_seqs) WHERE c <> '' GROUP BY obs_id, c
    UNION ALL SELECT obs_id, 'a', 0, 0, 1.0 FROM v_seqs GROUP BY ALL UNION ALL SELECT obs_id, 'A', 0, 0, 1.0 FROM v_seqs GROUP BY ALL""",
    "seqs",
)
def m_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.m_step(hmm.expected_counts(_coded(spark, sf_dir), _models(spark, sf_dir, 1)))
    return _wide(out.select("obs_id", "kind", "i", "j", F.round("value", 8).alias("value")))


@query()
def em_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.em_step(_coded(spark, sf_dir), _models(spark, sf_dir, 2))


_FORWARD = """fw AS (
      SELECT obs_id, seq_id, substring(seq, 1, 60) AS s, 1 AS t, 0.6e0 * (0.5e0 - 0.1e0 * instr('ACGT', seq[1])) AS f1, 0.4e0 * (0.1e0 * instr('ACGT', seq[1])) AS f2, 0.0::DOUBLE AS lp FROM v_seqs
      UNION ALL SELECT obs_id, seq_id, s, t + 1, (f1 * 0.9e0 + f2 * 0.2e0) / (f1 + f2) * (0.5e0 - 0.1e0 * instr('ACGT', s[t + 1])), (f1 * 0.1e0 + f2 * 0.8e0) / (f1 + f2) * (0.1e0 * instr('ACGT', s[t + 1])), lp + ln(f1 + f2) FROM fw WHERE t < length(s))"""
_BACKWARD = """bw AS (
      SELECT obs_id, seq_id, substring(seq, 1, 60) AS s, least(60, length(seq)) AS t, 0.5e0 AS b1, 0.5e0 AS b2, 0.5e0 - 0.1e0 * instr('ACGT', seq[least(60, length(seq))]) AS e1, 0.1e0 * instr('ACGT', seq[least(60, length(seq))]) AS e2 FROM v_seqs
      UNION ALL SELECT obs_id, seq_id, s, t - 1, (0.9e0 * e1 * b1 + 0.1e0 * e2 * b2) / (1.1e0 * e1 * b1 + 0.9e0 * e2 * b2), (0.2e0 * e1 * b1 + 0.8e0 * e2 * b2) / (1.1e0 * e1 * b1 + 0.9e0 * e2 * b2), 0.5e0 - 0.1e0 * instr('ACGT', s[t - 1]), 0.1e0 * instr('ACGT', s[t - 1]) FROM bw WHERE t > 1)"""
_GAMMA = "ga AS (SELECT obs_id, seq_id, t, length(s) AS len, fw.s[t] AS x, f1, f2, lp, b1, b2, e1, e2, f1 * b1 / (f1 * b1 + f2 * b2) AS g1 FROM fw JOIN (SELECT seq_id, t, b1, b2, e1, e2 FROM bw) bw USING (seq_id, t))"
_COUNTS2 = """xi AS (SELECT f.obs_id, f.f1 * 0.9e0 * b.e1 * b.b1 AS x00, f.f1 * 0.1e0 * b.e2 * b.b2 AS x01, f.f2 * 0.2e0 * b.e1 * b.b1 AS x10, f.f2 * 0.8e0 * b.e2 * b.b2 AS x11 FROM ga f JOIN ga b ON f.seq_id = b.seq_id AND b.t = f.t + 1),
    ec AS (
      SELECT obs_id, 'a' AS kind, 0::BIGINT AS i, 0::BIGINT AS j, sum(g1) AS value FROM ga WHERE t = 1 GROUP BY ALL UNION ALL SELECT obs_id, 'a', 1, 0, sum(1 - g1) FROM ga WHERE t = 1 GROUP BY ALL
      UNION ALL SELECT obs_id, 'A', 0, 0, sum(x00 / (x00 + x01 + x10 + x11)) FROM xi GROUP BY ALL UNION ALL SELECT obs_id, 'A', 0, 1, sum(x01 / (x00 + x01 + x10 + x11)) FROM xi GROUP BY ALL
      UNION ALL SELECT obs_id, 'A', 1, 0, sum(x10 / (x00 + x01 + x10 + x11)) FROM xi GROUP BY ALL UNION ALL SELECT obs_id, 'A', 1, 1, sum(x11 / (x00 + x01 + x10 + x11)) FROM xi GROUP BY ALL
      UNION ALL SELECT obs_id, 'B', 0, instr('ACGT', x), sum(g1) FROM ga GROUP BY ALL UNION ALL SELECT obs_id, 'B', 1, instr('ACGT', x), sum(1 - g1) FROM ga GROUP BY ALL
      UNION ALL SELECT obs_id, 'n', 0, 0, count(*) FROM ga WHERE t = 1 GROUP BY ALL UNION ALL SELECT obs_id, 'log_p', 0, 0, sum(lp + ln(f1 + f2)) FROM ga WHERE t = len GROUP BY ALL)"""


@query("SELECT obs_id, seq_id, t::BIGINT AS position, round(g1, 6) AS state_1 FROM ga", "seqs", _FORWARD, _BACKWARD, _GAMMA)
def state_posteriors_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first 60 bases, for the SQL beside it; whole sequences: ``state_posteriors``."""
    out = hmm.state_posteriors(_coded(spark, sf_dir, 60), _models(spark, sf_dir, 2))
    each = out.select("obs_id", "seq_id", F.posexplode("gamma").alias("t", "g"))
    return each.select("obs_id", "seq_id", (F.col("t") + 1).cast("long").alias("position"), F.round(F.col("g")[0], 6).alias("state_1"))


@query("SELECT obs_id, seq_id, round(sum(ln(g1 * (0.5e0 - 0.1e0 * instr('ACGT', x)) + (1 - g1) * 0.1e0 * instr('ACGT', x))), 5) AS total FROM ga GROUP BY ALL", "seqs", _FORWARD, _BACKWARD, _GAMMA)
def positional_log_likelihood_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two states, of the first 60 bases."""
    out = hmm.positional_log_likelihood(_coded(spark, sf_dir, 60), _models(spark, sf_dir, 2))
    return out.select("obs_id", "seq_id", F.round(F.aggregate("log_lh", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT obs_id, kind, i, j, round(value, 4) AS value FROM ec", "seqs", _FORWARD, _BACKWARD, _GAMMA, _COUNTS2)
def expected_counts_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two states, of the first 60 bases."""
    out = hmm.expected_counts(_coded(spark, sf_dir, 60), _models(spark, sf_dir, 2))
    return _wide(out.select("obs_id", "kind", "i", "j", F.round("value", 4).alias("value")))


@query(
    "SELECT obs_id, kind, i, j, round(value / sum(value) OVER (PARTITION BY obs_id, kind, CASE WHEN kind = 'a' THEN -1 ELSE i END), 7) AS value FROM ec WHERE kind IN ('a', 'A', 'B')",
    "seqs", _FORWARD, _BACKWARD, _GAMMA, _COUNTS2,
)
def em_step_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-state model after one step on the first 60 bases, entry by entry."""
    m = hmm.em_step(_coded(spark, sf_dir, 60), _models(spark, sf_dir, 2))
    a = m.select("obs_id", F.lit("a").alias("kind"), F.posexplode("initial").alias("i", "value")).withColumn("j", F.lit(0))
    both = [m.select("obs_id", F.lit(k).alias("kind"), F.posexplode(c).alias("i", "row")).select("obs_id", "kind", "i", F.posexplode("row").alias("j", "value")).withColumn("j", F.col("j") + base) for k, c, base in (("A", "transition", 0), ("B", "emission", 1))]
    return _wide(a.unionByName(both[0]).unionByName(both[1]).select("obs_id", "kind", "i", "j", F.round("value", 7).alias("value")))


# Two states over all bases: sequences in pieces of 700, which are more than one stretch of the kernels

_PIECES = """pieces AS (SELECT obs_id, seq_id * 1000 + i AS seq_id, substring(seq, i * 700 + 1, 700) AS s FROM (SELECT *, unnest(range((length(seq) + 699) // 700)) AS i FROM v_seqs))"""
_E1, _E2 = "(0.5e0 - 0.1e0 * instr('ACGT', {0}))", "(0.1e0 * instr('ACGT', {0}))"
_PIECES_FORWARD = f"""fw AS (
      SELECT seq_id, 1 AS t, 0.6e0 * {_E1.format("s[1]")} AS f1, 0.4e0 * {_E2.format("s[1]")} AS f2, 0.0::DOUBLE AS lp FROM pieces
      UNION ALL SELECT seq_id, t + 1, (f1 * 0.9e0 + f2 * 0.2e0) / (f1 + f2) * {_E1.format("s[t + 1]")}, (f1 * 0.1e0 + f2 * 0.8e0) / (f1 + f2) * {_E2.format("s[t + 1]")}, lp + ln(f1 + f2) FROM fw JOIN pieces USING (seq_id) WHERE t < length(s))"""
_PIECES_BACKWARD = f"""bw AS (
      SELECT seq_id, length(s) AS t, 0.5e0 AS b1, 0.5e0 AS b2 FROM pieces
      UNION ALL SELECT seq_id, t - 1, (0.9e0 * e1 * b1 + 0.1e0 * e2 * b2) / (1.1e0 * e1 * b1 + 0.9e0 * e2 * b2), (0.2e0 * e1 * b1 + 0.8e0 * e2 * b2) / (1.1e0 * e1 * b1 + 0.9e0 * e2 * b2)
      FROM (SELECT seq_id, t, b1, b2, {_E1.format("s[t]")} AS e1, {_E2.format("s[t]")} AS e2 FROM bw JOIN pieces USING (seq_id) WHERE t > 1))"""
_PIECES_GAMMA = f"""ga AS (SELECT obs_id, seq_id, t, length(s) AS len, s[t] AS x, f1, f2, lp, b1, b2, {_E1.format("s[t]")} AS e1, {_E2.format("s[t]")} AS e2, f1 * b1 / (f1 * b1 + f2 * b2) AS g1 FROM fw JOIN bw USING (seq_id, t) JOIN pieces USING (seq_id))"""
_NEED_PIECES = ("seqs", _PIECES, _PIECES_FORWARD, _PIECES_BACKWARD, _PIECES_GAMMA)


def _coded_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") + 699) / 700).cast("int") - 1))
    rows = views.seqs(spark, sf_dir).withColumn("_i", at)
    rows = rows.select("obs_id", F.lit(0).alias("order"), (F.col("seq_id") * 1000 + F.col("_i")).alias("seq_id"), F.col("seq").substr(F.col("_i") * 700 + 1, F.lit(700)).alias("seq"))
    return coding.code_sequences(rows)


@query("SELECT obs_id, seq_id, round(lp + ln(f1 + f2), 5) AS log_p FROM fw JOIN pieces USING (seq_id) WHERE t = length(s)", "seqs", _PIECES, _PIECES_FORWARD)
def obs_log_likelihood_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.obs_log_likelihood(_coded_pieces(spark, sf_dir), _models(spark, sf_dir, 2)).select("obs_id", "seq_id", F.round("log_p", 5).alias("log_p"))


@query("SELECT obs_id, seq_id, round(lp + ln(f1 + f2), 5) AS log_p FROM fw JOIN pieces USING (seq_id) WHERE t = length(s)", "seqs", _PIECES, _PIECES_FORWARD)
def obs_log_likelihood_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by products over blocks of 128 codes."""
    rows = _coded_blocks(spark, sf_dir)
    return hmm.obs_log_likelihood(rows, _models(spark, sf_dir, 2)).select("obs_id", "seq_id", F.round("log_p", 5).alias("log_p"))


@query("SELECT obs_id, kind, i, j, round(value, 3) AS value FROM ec", *_NEED_PIECES, _COUNTS2)
def expected_counts_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.expected_counts(_coded_pieces(spark, sf_dir), _models(spark, sf_dir, 2))
    return _wide(out.select("obs_id", "kind", "i", "j", F.round("value", 3).alias("value")))


def _coded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 128 codes, written as they are gone through three times: for products, and as long and short ones."""
    return views.written(blocks.cut_blocks(_coded_pieces(spark, sf_dir), 128))


@query("SELECT obs_id, kind, i, j, round(value, 3) AS value FROM ec", *_NEED_PIECES, _COUNTS2)
def expected_counts_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in blocks of 128 codes, each a row, that take up the messages at their edges."""
    out = hmm.expected_counts(_coded_blocks(spark, sf_dir), _models(spark, sf_dir, 2))
    return _wide(out.select("obs_id", "kind", "i", "j", F.round("value", 3).alias("value")))


@query("SELECT obs_id, seq_id, (t - 1) // 128 AS block, round(sum(g1 * (1 + t % 7)), 5) AS weighted FROM ga GROUP BY ALL", *_NEED_PIECES)
def state_posteriors_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors of the first state in blocks of 128 codes, summed with weights by place."""
    out = hmm.state_posteriors(_coded_blocks(spark, sf_dir), _models(spark, sf_dir, 2))
    t = lambda i: F.col("block") * 128 + i + 1
    total = F.aggregate(F.transform("gamma", lambda g, i: g[0] * (1 + t(i) % 7)), F.lit(0.0), lambda s, x: s + x)
    return _wide(out.select("obs_id", "seq_id", "block", F.round(total, 5).alias("weighted")))


def _split_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, seq_id, seq, split) of the sampled windows, written once for training and tests."""
    path = views.shared_path(spark)
    rows = sampling.split_obs_sets(_samples(spark, sf_dir)).select(F.col("partition").alias("obs_id"), F.xxhash64("seqid", "start").alias("seq_id"), F.col("sequence").alias("seq"), "split")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query()
def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled windows to trained chains: a grid over states and orders, each chain until it converges."""
    return _trained(spark, _split_samples(spark, sf_dir))


def _trained(spark: SparkSession, samples: DataFrame) -> DataFrame:
    obs = samples.where("split = 'train'").drop("split")
    grid = jobs.job_grid(obs, (1, 2), (0, 1), 1)
    none = spark.createDataFrame([], hmm.STEPS)
    return hmm.train(grid, coding.code_job_obs(grid, obs), none, jobs.init_models(grid), path=views.shared_path(spark))


@query(
    """SELECT obs_id, seq_id, length(seq) AS n, round(list_sum(list_transform(string_split(seq, ''), lambda c: ln(0.5e0 - 0.1e0 * instr('ACGT', c)))), 5) AS total FROM v_seqs""",
    "seqs",
)
def positional_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one state: the logs of the emission probabilities, summed."""
    out = hmm.positional_log_likelihood(_coded(spark, sf_dir), _models(spark, sf_dir, 1))
    total = F.aggregate("log_lh", F.lit(0.0), lambda s, x: s + x)
    return out.select("obs_id", "seq_id", F.size("log_lh").cast("long").alias("n"), F.round(total, 5).alias("total"))


def _partition_models(spark: SparkSession, states: int) -> DataFrame:
    """A model for each partition; those of one state have emissions of their own."""
    names = spark.createDataFrame([(p, c) for p, c in intervals.PARTITIONS.items()], "obs_id string, code int")
    lit = lambda x: F.lit(x) if not isinstance(x, list) else F.array(*map(lit, x))
    one = F.array(F.array(*(F.element_at(F.array(*map(F.lit, p)), F.col("code")) for p in zip(*_B1, strict=True))))
    a, moves, emissions = (lit(_A2), lit(_MOVES2), lit(_B2)) if states == 2 else (lit([1.0]), lit([[1.0]]), one)
    return names.select("obs_id", F.lit(states).alias("K"), F.lit(0).alias("order"), F.lit(1).alias("replicate"), a.alias("initial"), moves.alias("transition"), emissions.alias("emission"))


_B1 = [[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4], [0.25, 0.35, 0.15, 0.25]]
_COMPLEMENT = "CASE WHEN strand = -1 THEN translate(c, 'ACGT', 'TGCA') ELSE c END"


@query(
    f"""SELECT pos_id, count(*) AS n, round(sum(ln(list_extract(list_extract({[[float(x) for x in p] for p in _B1]}, partition_code), instr('ACGT', {_COMPLEMENT})))), 4) AS log_lh, round(sum(p * ln(list_extract(list_extract({[[float(x) for x in p] for p in _B1]}, partition_code), instr('ACGT', {_COMPLEMENT})))) / sum(p), 6) AS weighted
    FROM (SELECT pos_id, partition_code, strand, p, seq[p] AS c FROM (SELECT pos_id, partition_code, strand, seq, unnest(range(frag_start, frag_end + 1)) AS p FROM frags JOIN v_seqs ON seq_id = pos_id)) GROUP BY 1""",
    *_NEED_DOCS,
)
def background_likelihood_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every base of every document scored from tiles under its partition's model of one state; summed by document, and
    with its position as weight."""
    scored = hmm.background_likelihood(_doc_blocks(spark, sf_dir, 0), _partition_models(spark, 1))
    p = F.col("position").cast("double")
    return scored.groupBy("pos_id").agg(F.count("*").alias("n"), F.round(F.sum("log_lh"), 4).alias("log_lh"), F.round(F.sum(p * F.col("log_lh")) / F.sum(p), 6).alias("weighted"))


@query()
def background_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two states, from tiles, in blocks that take up the messages at their edges."""
    scored = hmm.background_likelihood(_doc_blocks(spark, sf_dir, 0), _partition_models(spark, 2))
    return scored.groupBy("pos_id").agg(F.count("*").alias("n"), F.round(F.sum("log_lh"), 4).alias("log_lh"))


@query(
    """SELECT k AS key, s AS symbol, round(coalesce(w, 0) / sum(coalesce(w, 0)) OVER (PARTITION BY k), 8) AS p
    FROM (SELECT DISTINCT l_returnflag AS k FROM lineitem), range(1, 9) t(s) LEFT JOIN (SELECT l_returnflag AS k2, l_linenumber + 1 AS s2, sum(l_quantity) AS w FROM lineitem WHERE l_linenumber < 8 GROUP BY ALL) ON k = k2 AND s = s2"""
)
def weighted_categorical_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").where("l_linenumber < 8").select(F.col("l_returnflag").alias("key"), (F.col("l_linenumber") + 1).cast("int").alias("symbol"), F.col("l_quantity").alias("weight"))
    return hmm.weighted_categorical_mle(values, 8).select("key", F.col("symbol").cast("long").alias("symbol"), F.round("p", 8).alias("p"))


# Scalars

_NUMBERS = """nums AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -l_discount AS x, -l_tax AS y, CASE WHEN l_linenumber = 3 THEN '-Infinity'::DOUBLE ELSE -l_quantity END AS z FROM lineitem)"""


@query(
    """SELECT count(*) AS n, count(*) FILTER (WHERE z = '-Infinity'::DOUBLE) AS infinite, round(sum(CASE WHEN z > '-Infinity'::DOUBLE THEN x + y + z ELSE 0 END), 4) AS total, round(sum(CASE WHEN z > '-Infinity'::DOUBLE THEN ln(exp(x) + exp(y) + exp(z)) ELSE ln(exp(x) + exp(y)) END), 4) AS lse FROM nums""",
    _NUMBERS,
)
def log_probability_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.when(F.col("l_linenumber") == 3, numbers.MINUS_INF).otherwise(-F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select((-F.col("l_discount")).alias("x"), (-F.col("l_tax")).alias("y"), z.alias("z"))
    rows = rows.select(numbers.lps(F.col("x"), F.col("y"), F.col("z")).alias("p"), numbers.logsumexp(F.array("x", "y", "z")).alias("lse"))
    infinite = F.col("p") == numbers.MINUS_INF
    return rows.agg(F.count("*").alias("n"), F.count_if(infinite).alias("infinite"), F.round(F.sum(F.when(infinite, 0.0).otherwise(F.col("p"))), 4).alias("total"), F.round(F.sum("lse"), 4).alias("lse"))


_DIST = """dist AS (SELECT l_orderkey, l_linenumber, list_transform(w, lambda x: x / list_sum(w)) AS p FROM (SELECT l_orderkey, l_linenumber, [1.0 + l_partkey % 50, 1.0 + l_suppkey % 3, 1.0 + l_quantity % 7, 1.0] AS w FROM lineitem))"""


def _distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array(1.0 + F.col("l_partkey") % 50, 1.0 + F.col("l_suppkey") % 3, 1.0 + F.col("l_quantity") % 7, F.lit(1.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"))
    return rows.withColumn("p", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda s, y: s + y)))


@query(
    """SELECT symbol, CASE WHEN round(score, 9) < 0.25 THEN 'weak' WHEN round(score, 9) < 0.7 THEN 'medium' ELSE 'strong' END AS tier, count(*) AS n, round(sum(score), 4) AS score
    FROM (SELECT unnest(range(1, 5)) AS symbol, unnest(p) * (2 + list_sum(list_transform(p, lambda x: x * log2(x)))) / 2 AS score FROM dist) WHERE round(score, 9) >= 0.05 GROUP BY ALL""",
    _DIST,
)
def symbol_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distributions(spark, sf_dir).select(F.explode(numbers.symbol_information(F.col("p"))).alias("s"))
    return rows.groupBy(F.col("s.symbol").cast("long").alias("symbol"), F.col("s.tier").alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum("s.score"), 4).alias("score"))


@query("""SELECT l_linenumber, count(*) AS n, round(sum(1 / (1 - l_discount)), 4) AS runs FROM lineitem WHERE l_discount > 0 GROUP BY 1""")
def mean_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_discount > 0")
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(numbers.mean_run_length(F.col("l_discount"))), 4).alias("runs"))


# Chains and reports, over steps made from lineitem

_STEPS = """v_steps AS (
  SELECT *, list_transform(range(1, K + 1), lambda kk: list_transform(range(1, K + 1), lambda jj: CASE WHEN kk = jj THEN 0.5 + (iterate % 4) / 10.0 + 0.5 / K - (iterate % 4) / 10.0 / K ELSE (0.5 - (iterate % 4) / 10.0) / K END)) AS A,
  list_transform(range(1, K + 1), lambda kk: list_transform(range(1, 5), lambda s: (1.0 + (iterate * 7 + replicate * 5 + kk * 3 + s * s * 11) % 13) / list_sum(list_transform(range(1, 5), lambda s: 1.0 + (iterate * 7 + replicate * 5 + kk * 3 + s * s * 11) % 13)))) AS B
  FROM (SELECT l_returnflag AS obs_id, (1 + l_linenumber % 4)::BIGINT AS K, l_suppkey % 3 AS "order", 1 + l_partkey % 3 AS replicate, l_orderkey % 20 + 1 AS iterate, round(-sum(l_extendedprice), 2) AS log_p, round(sum(l_discount), 2) AS delta, round(sum(l_discount), 2) < 0.5 AS converged FROM lineitem GROUP BY ALL))"""
_LAST = "last AS (SELECT * FROM v_steps QUALIFY row_number() OVER (PARTITION BY obs_id, K, \"order\", replicate ORDER BY iterate DESC) = 1)"
_CHAIN = 'obs_id, K, "order", replicate'


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, it = F.col("K"), F.col("iterate")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("obs_id"), (1 + F.col("l_linenumber") % 4).cast("int").alias("K"), (F.col("l_suppkey") % 3).cast("int").alias("order"), (1 + F.col("l_partkey") % 3).cast("int").alias("replicate"), (F.col("l_orderkey") % 20 + 1).cast("int").alias("iterate"))
    rows = rows.agg(F.round(-F.sum("l_extendedprice"), 2).alias("log_p"), F.round(F.sum("l_discount"), 2).alias("delta"))
    states = F.sequence(F.lit(1), k)
    stay = (it % 4) / 10.0
    moves = F.transform(states, lambda i: F.transform(states, lambda j: F.when(i == j, 0.5 + stay + 0.5 / k - stay / k).otherwise((0.5 - stay) / k)))
    weight = lambda i, s: 1.0 + (it * 7 + F.col("replicate") * 5 + i * 3 + s * s * 11) % 13
    total = lambda i: weight(i, 1) + weight(i, 2) + weight(i, 3) + weight(i, 4)
    one, four = F.lit(1), F.sequence(F.lit(1), F.lit(4))
    emissions = F.transform(states, lambda i: F.transform(four, lambda s: weight(i, s) / total(i)))
    return rows.withColumns({"converged": F.col("delta") < 0.5, "initial": F.transform(states, lambda i: one / k), "transition": moves, "emission": emissions})


def _wide(df: DataFrame) -> DataFrame:
    """Integers as SQL has them."""
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})


@query(f"SELECT {_CHAIN}, iterate, log_p, delta, converged FROM last", _STEPS, _LAST)
def latest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(reports.latest_step(_steps(spark, sf_dir)).select(*jobs.CHAIN, "iterate", "log_p", "delta", "converged"))


@query("SELECT count(*) FILTER (WHERE converged) AS converged, count(*) FILTER (WHERE NOT converged) AS unconverged FROM last", _STEPS, _LAST)
def convergence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.convergence_summary(_steps(spark, sf_dir))


@query(
    f"""SELECT {_CHAIN}, iterate, 'log_p' AS series, round(log_p, 6) AS value FROM v_steps
    UNION ALL SELECT {_CHAIN}, iterate, 'K' || kk, round(A[kk][kk], 6) FROM (SELECT *, unnest(range(1, K + 1)) AS kk FROM v_steps)""",
    _STEPS,
)
def chain_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(reports.chain_trajectories(_steps(spark, sf_dir)).withColumn("value", F.round("value", 6)))


@query()
def convergence_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.convergence_diagnostic(reports.chain_trajectories(_steps(spark, sf_dir)))


@query("SELECT obs_id, round(-sum(length(seq)) * ln(4), 4) AS naive_log_p FROM v_seqs GROUP BY 1", "seqs")
def naive_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.naive_log_likelihood(views.seqs(spark, sf_dir)).withColumn("naive_log_p", F.round("naive_log_p", 4))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_step(_steps(spark, sf_dir)).withColumns({"test_log_p": F.col("log_p"), "naive_log_p": F.lit(-1000.0)})


@query("""SELECT obs_id, "order", count(*) FILTER (WHERE converged) AS n_converged, count(*) FILTER (WHERE NOT converged) AS n_failed, round(max(log_p) FILTER (WHERE NOT converged AND K = 2), 2) AS best_failed_2 FROM last GROUP BY ALL""", _STEPS, _LAST)
def order_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.order_report(_chains(spark, sf_dir))
    best = F.array_max(F.transform(F.filter("failed", lambda x: x["K"] == 2), lambda x: x["test_log_p"]))
    return _wide(rows.select("obs_id", "order", F.size("converged").alias("n_converged"), F.size("failed").alias("n_failed"), F.round(best, 2).alias("best_failed_2")))


@query(
    f"""SELECT {_CHAIN}, log_p AS test_log_p, (SELECT count(*) FROM last l WHERE l.obs_id = b.obs_id AND l.K = b.K AND l."order" = b."order") AS n_replicates FROM last b QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY log_p DESC, K, "order", replicate) = 1""",
    _STEPS, _LAST,
)
def partition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.partition_report(_chains(spark, sf_dir))
    return _wide(rows.select(*jobs.CHAIN, "test_log_p", F.size("replicates").alias("n_replicates")))


@query()
def chain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained chains over test windows."""
    samples = _split_samples(spark, sf_dir)
    steps, obs = _trained(spark, samples), samples.where("split = 'test'").drop("split")
    return reports.chain_report(steps, coding.code_job_obs(steps, obs), obs)


@query()
def generate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each report; the made steps have four symbols, which are those of order 0."""
    steps = _steps(spark, sf_dir).where("order = 0")
    letter = F.element_at(F.array(*map(F.lit, "ANR")), (F.pmod("seq_id", F.lit(3)) + 1).cast("int"))
    obs = views.seqs(spark, sf_dir).withColumn("obs_id", letter)
    made = reports.generate_reports(steps, coding.code_job_obs(steps.select(*jobs.CHAIN).distinct(), obs), obs)
    each = [df.agg(F.lit(name).alias("report"), F.count("*").alias("n")) for name, df in made.items()]
    return reduce(DataFrame.unionByName, each)


@query(
    """SELECT b.obs_id, b.K, b."order", b.replicate, s AS state, o AS other, round(sqrt(list_sum(list_transform(list_zip(a.B[s], b.B[o]), lambda x: (x[1] - x[2]) ** 2))), 6) AS distance
    FROM (SELECT * FROM last QUALIFY replicate = min(replicate) OVER (PARTITION BY obs_id, K, "order")) a JOIN last b ON a.obs_id = b.obs_id AND a.K = b.K AND a."order" = b."order" AND a.replicate <> b.replicate, range(1, 5) t(s), range(1, 5) u(o) WHERE s <= a.K AND o <= a.K""",
    _STEPS, _LAST,
)
def state_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(reports.state_distances(_steps(spark, sf_dir)).withColumn("distance", F.round("distance", 6)))


_SET = 'obs_id, K, "order"'
_SQUARES = " + ".join(f"(a.B[s][{i}] - b.B[o][{i}]) * (a.B[s][{i}] - b.B[o][{i}])" for i in range(1, 5))
_PASSES = [
    f"""d0 AS (SELECT b.obs_id, b.K, b."order", b.replicate, s AS state, o AS other, sqrt({_SQUARES}) AS distance
    FROM (SELECT * FROM last QUALIFY replicate = min(replicate) OVER (PARTITION BY {_SET})) a JOIN last b ON a.obs_id = b.obs_id AND a.K = b.K AND a."order" = b."order" AND a.replicate <> b.replicate, range(1, 5) t(s), range(1, 5) u(o) WHERE s <= a.K AND o <= a.K)"""
]
for _r in range(1, 5):  # as many passes as the made steps have states
    _PASSES += [
        f"n{_r} AS (SELECT * FROM d{_r - 1} QUALIFY row_number() OVER (PARTITION BY {_CHAIN}, state ORDER BY distance, other) = 1)",
        f"p{_r} AS (SELECT {_SET}, state FROM (SELECT {_SET}, state, sum(distance) AS total FROM n{_r} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_SET} ORDER BY total, state) = 1)",
        f"m{_r} AS (SELECT {_CHAIN}, {_r}::BIGINT AS rank, state, other FROM n{_r} JOIN p{_r} USING ({_SET}, state))",
        f"d{_r} AS (SELECT d.* FROM d{_r - 1} d JOIN m{_r} m USING ({_CHAIN}) WHERE d.state <> m.state AND d.other <> m.other)",
    ]
_ALONE = f"""matches AS ({" UNION ALL ".join(f"SELECT {_CHAIN}, rank, state, other FROM m{r}" for r in range(1, 5))}
    UNION ALL SELECT {_CHAIN}, s, s, s FROM (SELECT * FROM last QUALIFY count(*) OVER (PARTITION BY {_SET}) = 1), range(1, 5) t(s) WHERE s <= K)"""
_MATCHES = (_STEPS, _LAST, *_PASSES, _ALONE)


@query(f"SELECT {_CHAIN}, rank, state, other FROM matches", *_MATCHES)
def match_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(reports.match_states(_steps(spark, sf_dir)))


@query(
    f"""SELECT {_SET}, state, row_number() OVER (PARTITION BY {_SET}, state ORDER BY round(distance, 9), symbol) AS rank, symbol, round(distance, 6) AS distance FROM (
    SELECT m.obs_id, m.K, m."order", m.state, x AS symbol, sum(abs(l.B[m.other][x] - f.B[m.state][x])) AS distance FROM matches m JOIN last l USING ({_CHAIN})
    JOIN (SELECT * FROM last QUALIFY replicate = min(replicate) OVER (PARTITION BY {_SET})) f ON f.obs_id = m.obs_id AND f.K = m.K AND f."order" = m."order", range(1, 5) u(x) GROUP BY ALL)""",
    *_MATCHES,
)
def rank_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    return _wide(reports.rank_symbols(steps, reports.match_states(steps)).withColumn("distance", F.round("distance", 6)))


@query(
    f"""SELECT v.obs_id, v.K, v."order", v.replicate, iterate, rank, state, round(A[o][o], 6) AS autotransition, round(B[o][1], 6) AS first FROM (
    SELECT m.obs_id, m.K, m."order", m.replicate, rank, state, other AS o FROM matches m UNION ALL SELECT DISTINCT m.obs_id, m.K, m."order", f.replicate, rank, state, state FROM matches m
    JOIN (SELECT {_CHAIN} FROM last QUALIFY replicate = min(replicate) OVER (PARTITION BY {_SET})) f ON f.obs_id = m.obs_id AND f.K = m.K AND f."order" = m."order" WHERE m.replicate <> f.replicate) w JOIN v_steps v USING ({_CHAIN})""",
    *_MATCHES,
)
def replicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.replicate_reports(_steps(spark, sf_dir))
    return _wide(rows.select(*jobs.CHAIN, "iterate", "rank", "state", F.round("autotransition", 6).alias("autotransition"), F.round(F.col("emissions")[0], 6).alias("first")))


_COORDS = (
    "many AS (SELECT * FROM last WHERE K >= 3)",
    f"firsts AS (SELECT obs_id, K AS fk, \"order\" AS fo, replicate AS fr, B AS fb FROM many QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY {_CHAIN}) = 1)",
    f"""far AS (SELECT {_CHAIN}, ref, o, sqrt({" + ".join(f"(fb[ref][{i}] - B[o][{i}]) * (fb[ref][{i}] - B[o][{i}])" for i in range(1, 5))}) AS d, K = fk AND "order" = fo AND replicate = fr AS own FROM many JOIN firsts USING (obs_id), range(1, 4) t(ref), range(1, 5) u(o) WHERE o <= many.K)""",
    f"c1 AS (SELECT {_CHAIN}, own, CASE WHEN own THEN 1 ELSE o END AS o1 FROM far WHERE ref = 1 QUALIFY row_number() OVER (PARTITION BY {_CHAIN} ORDER BY d, o) = 1)",
    f"c2 AS (SELECT {_CHAIN}, o1, CASE WHEN far.own THEN 2 ELSE o END AS o2 FROM far JOIN c1 USING ({_CHAIN}) WHERE ref = 2 AND o <> o1 QUALIFY row_number() OVER (PARTITION BY {_CHAIN} ORDER BY d, o) = 1)",
    f"c3 AS (SELECT {_CHAIN}, o1, o2, CASE WHEN own THEN 3 ELSE o END AS o3 FROM far JOIN c2 USING ({_CHAIN}) WHERE ref = 3 AND o <> o1 AND o <> o2 QUALIFY row_number() OVER (PARTITION BY {_CHAIN} ORDER BY d, o) = 1)",
)


@query(f"SELECT {_CHAIN}, iterate, round(B[o1][1], 6) AS x, round(B[o2][1], 6) AS y, round(B[o3][1], 6) AS z FROM v_steps JOIN c3 USING ({_CHAIN})", _STEPS, _LAST, *_COORDS)
def matched_state_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.matched_state_coords(_steps(spark, sf_dir).where("K >= 3"))
    return _wide(rows.select(*jobs.CHAIN, "iterate", *(F.round(c, 6).alias(c) for c in "xyz")))


@query(
    f"""SELECT {_CHAIN} FROM (SELECT DISTINCT {_CHAIN} FROM v_steps) g WHERE K BETWEEN 2 AND 3 AND "order" BETWEEN 0 AND 1 AND NOT EXISTS (SELECT 1 FROM last l WHERE converged AND l.obs_id = g.obs_id AND l.K = g.K AND l."order" = g."order" AND l.replicate = g.replicate)""",
    _STEPS, _LAST,
)
def select_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    return _wide(jobs.select_jobs(steps.select(*jobs.CHAIN).distinct(), (2, 3), (0, 1), reports.latest_step(steps).where("converged")))


@query("""SELECT l_returnflag AS obs_id, K, o AS "order", r AS replicate FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (1::BIGINT), (2), (4)) t(K), (VALUES (0::BIGINT), (1), (2)) u(o), range(1, 5) v(r)""")
def job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(jobs.job_grid(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("obs_id")), (1, 2, 4), (0, 1, 2), 4))


@query(
    """SELECT l_returnflag AS obs_id, K, o AS "order", r AS replicate, K AS states, (4 ** (o + 1))::BIGINT AS symbols, true AS valid FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (1::BIGINT), (2), (4)) t(K), (VALUES (0::BIGINT), (1), (2)) u(o), range(1, 5) v(r)"""
)
def init_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and validity of the drawn models of a job grid."""
    models = jobs.validate_models(jobs.init_models(jobs.job_grid(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("obs_id")), (1, 2, 4), (0, 1, 2), 4)))
    return _wide(models.select(*jobs.CHAIN, F.size("transition").alias("states"), F.size(F.col("emission")[0]).alias("symbols"), (F.size("violations") == 0).alias("valid")))


@query(f"SELECT {_CHAIN}, iterate, log_p, delta, converged, K AS states FROM v_steps", _STEPS)
def chain_step_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps written and read back."""
    path = views.shared_path(spark)
    genome.write_chain_steps(_steps(spark, sf_dir), path)
    return _wide(genome.read_chain_steps(spark, path).select(*jobs.CHAIN, "iterate", "log_p", "delta", "converged", F.size("emission").alias("states")))


@query(
    """SELECT l_returnflag AS obs_id, o AS "order" FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (0::BIGINT), (1), (2)) u(o)"""
)
def code_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(jobs.code_jobs(job_grid(spark, sf_dir)))


@query(
    f"""SELECT {_CHAIN}, CASE WHEN K % 2 = 0 AND replicate = 2 THEN 'new' WHEN NOT converged OR delta > 0.2 THEN 'resume' ELSE 'skip' END AS action, CASE WHEN NOT (K % 2 = 0 AND replicate = 2) THEN iterate END AS iterate, CASE WHEN NOT (K % 2 = 0 AND replicate = 2) THEN log_p END AS log_p FROM last""",
    _STEPS, _LAST,
)
def plan_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    plan = jobs.plan_training(steps.select(*jobs.CHAIN).distinct(), steps.where("NOT (K % 2 = 0 AND replicate = 2)"), 0.2)
    return _wide(plan.select(*jobs.CHAIN, "action", "iterate", "log_p"))


@query(
    """SELECT valid_chain, valid_step, count(*) AS n FROM (SELECT K >= 1 AND "order" - 1 >= 0 AND replicate >= 1 AS valid_chain, iterate - 2 >= 1 AND log_p + 100000 <= 0 AS valid_step FROM v_steps) GROUP BY ALL""",
    _STEPS,
)
def validate_chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _steps(spark, sf_dir).withColumns({"order": F.col("order") - 1, "iterate": F.col("iterate") - 2, "log_p": F.col("log_p") + 100000})
    return jobs.validate_chain_steps(rows).groupBy("valid_chain", "valid_step").agg(F.count("*").alias("n"))


@query(
    """SELECT v AS violation, count(*) AS n FROM (SELECT unnest(list_concat(CASE WHEN iterate % 3 = 0 THEN ['a is no probability vector'] ELSE [] END, CASE WHEN iterate % 4 = 0 THEN ['B has rows of unequal lengths', 'B has a row that is no probability vector', 'a, A and B differ in states'] ELSE [] END)) AS v FROM v_steps) GROUP BY 1""",
    _STEPS,
)
def validate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.array(F.lit(0.5))
    rows = _steps(spark, sf_dir).withColumns({"initial": F.when(F.col("iterate") % 3 == 0, F.transform("initial", lambda x: x * 2)).otherwise(F.col("initial")), "emission": F.when(F.col("iterate") % 4 == 0, F.array_append("emission", bad)).otherwise(F.col("emission"))})
    return jobs.validate_models(rows).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))
