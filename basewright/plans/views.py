"""Genome-like views of the test tables, the same in Spark and in the DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.sources.shared import shared_path, written  # noqa: F401

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
BASES_N = "".join("N" if c in "qxz" else b for c, b in zip(LETTERS, BASES, strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str, to: str = BASES) -> DataFrame:
    """(obs_id, seq_id, seq): documents' letters as bases."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    rows = table(spark, sf_dir, "documents").where(F.lower("text").rlike("[a-z]"))  # a length would need all letters, twice
    return rows.select(F.col("lang").alias("obs_id"), F.col("doc_id").alias("seq_id"), F.translate(letters, LETTERS, to).alias("seq"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqid, type, start, end, strand) from lineitem."""
    seqid = F.when(F.col("l_suppkey") % 10 == 9, "MT").otherwise((F.col("l_suppkey") % 10).cast("string"))
    kind = F.when(F.col("l_returnflag") == "A", "gene").when(F.col("l_returnflag") == "R", "CDS").otherwise("exon")
    start = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + 1
    width = F.when(kind == "gene", 200 + 40 * F.col("l_quantity")).otherwise(20 + 3 * F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(seqid.alias("seqid"), kind.alias("type"), start.cast("long").alias("start"), (start + width).cast("long").alias("end"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"))


def scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqid, start, end): ten scaffolds that hold all features."""
    last = table(spark, sf_dir, "orders").agg(((F.max("o_orderkey") + 10) * 1000).alias("end"))
    ids = spark.range(10).select(F.when(F.col("id") == 9, "MT").otherwise(F.col("id").cast("string")).alias("seqid"))
    return ids.join(F.broadcast(last)).select("seqid", F.lit(1).cast("long").alias("start"), "end")  # last: one row


def doc_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, seqid, start, end, strand): regions of documents as scaffolds, from lineitem; key numbers equal rows alike."""
    docs = seqs(spark, sf_dir).select(F.col("seq_id").alias("l_partkey"), F.length("seq").alias("n"))
    rows = table(spark, sf_dir, "lineitem").join(docs, "l_partkey")
    start = 1 + (F.col("l_suppkey") * 37) % F.col("n")
    end = F.least(F.col("n"), start + F.col("l_quantity").cast("long"))
    return rows.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("seqid"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"))


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqid, type, start, end, strand): features on documents as scaffolds, those of ``doc_regions``."""
    docs = seqs(spark, sf_dir).select(F.col("seq_id").alias("l_partkey"), F.length("seq").alias("n"))
    kind = F.when(F.col("l_returnflag") == "A", "gene").when(F.col("l_returnflag") == "R", "CDS").otherwise("exon")
    start = 1 + (F.col("l_suppkey") * 37) % F.col("n")
    end = F.least(F.col("n"), start + F.col("l_quantity").cast("long"))
    strand = F.when(F.col("l_linestatus") == "O", "+").otherwise("-")
    return table(spark, sf_dir, "lineitem").join(docs, "l_partkey").select(F.col("l_partkey").cast("string").alias("seqid"), kind.alias("type"), start.cast("long").alias("start"), end.cast("long").alias("end"), strand.alias("strand"))


def doc_scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqid, start, end): documents as scaffolds."""
    return seqs(spark, sf_dir).select(F.col("seq_id").cast("string").alias("seqid"), F.lit(1).cast("long").alias("start"), F.length("seq").cast("long").alias("end"))


def doc_tiles(spark: SparkSession, sf_dir: str, tile: int) -> DataFrame:
    from basewright.sources.genome import tile_scaffolds

    return tile_scaffolds(seqs(spark, sf_dir).select(F.col("seq_id").cast("string").alias("id"), F.col("seq").alias("sequence")), tile)


_V_FEATURES = """v_features AS (
  SELECT CASE WHEN l_suppkey % 10 = 9 THEN 'MT' ELSE CAST(l_suppkey % 10 AS VARCHAR) END AS seqid,
         CASE l_returnflag WHEN 'A' THEN 'gene' WHEN 'R' THEN 'CDS' ELSE 'exon' END AS type,
         CAST(l_orderkey * 1000 + l_linenumber * 100 + 1 AS BIGINT) AS "start",
         CAST(l_orderkey * 1000 + l_linenumber * 100 + 1 + CASE l_returnflag WHEN 'A' THEN 200 + 40 * l_quantity ELSE 20 + 3 * l_quantity END AS BIGINT) AS "end",
         CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem)"""
_V_SCAFFOLDS = """v_scaffolds AS (
  SELECT CASE WHEN i = 9 THEN 'MT' ELSE CAST(i AS VARCHAR) END AS seqid, CAST(1 AS BIGINT) AS "start", (SELECT (max(o_orderkey) + 10) * 1000 FROM orders) AS "end" FROM range(10) t(i))"""
_V_SEQS = f"""v_seqs AS (
  SELECT lang AS obs_id, doc_id AS seq_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents
  WHERE length(regexp_replace(lower(text), '[^a-z]', '', 'g')) > 0)"""
_DOC_FEATURES = """v_features AS (
  SELECT CAST(l_partkey AS VARCHAR) AS seqid, CASE l_returnflag WHEN 'A' THEN 'gene' WHEN 'R' THEN 'CDS' ELSE 'exon' END AS type, 1 + (l_suppkey * 37) % length(seq) AS "start",
         least(length(seq), 1 + (l_suppkey * 37) % length(seq) + CAST(l_quantity AS BIGINT)) AS "end", CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem JOIN v_seqs ON seq_id = l_partkey)"""
_DOC_SCAFFOLDS = """v_scaffolds AS (SELECT CAST(seq_id AS VARCHAR) AS seqid, CAST(1 AS BIGINT) AS "start", length(seq) AS "end" FROM v_seqs)"""
VIEW_SQL = {"doc_features": _DOC_FEATURES, "doc_scaffolds": _DOC_SCAFFOLDS, "features": _V_FEATURES, "scaffolds": _V_SCAFFOLDS, "seqs": _V_SEQS, "seqs_n": _V_SEQS.replace("v_seqs", "v_seqs_n").replace(BASES, BASES_N)}
