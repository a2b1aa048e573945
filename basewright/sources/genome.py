"""Readers of genome files and the chain-step table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewright.functions.sequences import rectify_identifier

TILE = 1 << 16
GFF3 = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
STEPS = "obs_id string, K int, order int, replicate int, iterate int, initial array<double>, transition array<array<double>>, emission array<array<double>>, log_p double, delta double, converged boolean"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence) of FASTA records; line breaks go, letters are upper-cased, ids are rectified."""
    record = F.regexp_replace(F.col("value"), "^>", "")
    head = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    sequence = F.upper(F.regexp_replace(F.regexp_replace(record, r"^[^\r\n]*", ""), r"\s+", ""))
    return rows.select(rectify_identifier(F.regexp_extract(head, r"^(\S*)", 1)).alias("id"), F.regexp_extract(head, r"^\S*\s*(.*)$", 1).alias("description"), sequence.alias("sequence"))


def read_fasta_tiles(spark: SparkSession, path: str, tile: int = TILE) -> DataFrame:
    """(seqid, description, tile, tile_start, seq): as ``tile_scaffolds(read_fasta(...))``, but read line by line, so that
    one record is many tasks and no row ever holds a record.

    A line's record is told by the headers before it: those of its own split of the file, and their number in the splits
    before; its place by running sums of lengths within its split and record, and of the record's splits. A record
    without bases has no tile; bases before a file's first header are an error.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    lines = rows.withColumn("_line", F.monotonically_increasing_id())  # in order within a split
    split, order = ["_file", "_split"], Window.partitionBy("_file", "_split").orderBy("_line")
    lines = lines.withColumn("_head", F.startswith("value", F.lit(">")).cast("int")).withColumn("_base", F.upper(F.regexp_replace(F.when(F.col("_head") == 0, F.col("value")).otherwise(""), r"\s+", "")))
    lines = lines.withColumn("_nth", F.sum("_head").over(order)).withColumn("_n", F.length("_base").cast("long"))
    within = Window.partitionBy(*split, "_nth").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    # a row for each record that a split has a part of; _nth 0 goes on with the record of the split before
    parts = lines.groupBy(*split, "_nth").agg(F.sum("_n").alias("_bases"), F.max(F.when(F.col("_head") == 1, F.col("value"))).alias("_header"))
    over = Window.partitionBy("_file").orderBy("_split", "_nth")
    parts = parts.withColumn("_record", F.sum(F.when(F.col("_header").isNotNull(), 1).otherwise(0)).over(over)).withColumn("_header", F.last("_header", ignorenulls=True).over(over))
    before = Window.partitionBy("_file", "_record").orderBy("_split", "_nth").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_bases").over(before), F.lit(0)))
    rows = lines.where("_n > 0").select(*split, "_nth", "_at", "_n", "_base").join(parts.select(*split, "_nth", "_record", "_header", "_before"), [*split, "_nth"])
    first = F.col("_before") + F.col("_at")
    rows = rows.withColumn("_first", F.when(F.col("_record") > 0, first).otherwise(F.raise_error(F.lit("bases before the first header"))))
    rows = rows.withColumn("tile", F.explode(F.sequence(F.floor(F.col("_first") / tile), F.floor((F.col("_first") + F.col("_n") - 1) / tile))))
    low = F.greatest(F.col("_first"), F.col("tile") * tile)
    piece = F.col("_base").substr((low - F.col("_first") + 1).cast("int"), (F.least(F.col("_first") + F.col("_n"), (F.col("tile") + 1) * tile) - low).cast("int"))
    tiles = rows.groupBy("_file", "_record", "tile").agg(F.first("_header").alias("_header"), F.sort_array(F.collect_list(F.struct(low.alias("at"), piece.alias("piece")))).alias("_pieces"))  # of one tile
    head = F.regexp_replace("_header", "^>", "")
    seq = F.array_join(F.col("_pieces.piece"), "")
    return tiles.select(rectify_identifier(F.regexp_extract(head, r"^(\S*)", 1)).alias("seqid"), F.regexp_extract(head, r"^\S*\s*(.*)$", 1).alias("description"), "tile", (F.col("tile") * tile + 1).alias("tile_start"), seq.alias("seq"))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of a GFF3 file, without comments and directives."""
    return spark.read.csv(path, sep="\t", comment="#", schema=GFF3)


def read_position_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, pos_start, pos_end, sequence) of records headed ``id start S end E ...``, without ``MT``."""
    tokens = F.split("description", r"\s+")
    rows = read_fasta(spark, path).where("id != 'MT'")
    return rows.select(F.col("id").alias("seqid"), tokens[1].cast("long").alias("pos_start"), tokens[3].cast("long").alias("pos_end"), "sequence")


def tile_scaffolds(scaffolds: DataFrame, tile: int = TILE) -> DataFrame:
    """(seqid, tile, tile_start, seq): ``scaffolds(id, sequence)`` in pieces, so that no chromosome stays one row."""
    pieces = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{tile}}}"), F.lit(0))  # one pass; a substring counts from the start each time
    rows = scaffolds.select(F.col("id").alias("seqid"), F.posexplode(pieces).alias("tile", "seq")).withColumn("tile", F.col("tile").cast("long"))
    return rows.select("seqid", "tile", (F.col("tile") * tile + 1).alias("tile_start"), "seq")


# The step log: a directory for each iteration of each run, run=R/start=S/iteration=I. A run that starts at S replaces the
# iterations from S on of all runs before it; a directory counts once its files are committed, which Spark does whole.


class Log(NamedTuple):
    """Where the next iteration of a run goes."""

    path: str
    run: int
    start: int
    iteration: int


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    """STEPS with run and iteration, of iterations that no later run has replaced; None where there is no log."""
    try:
        rows = spark.read.schema(f"{STEPS}, run int, start int, iteration int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    runs = rows.select("run", "start").distinct()  # a row a run
    until = F.min("start").over(Window.orderBy("run").rowsBetween(1, Window.unboundedFollowing))
    rows = rows.join(F.broadcast(runs.select("run", until.alias("_until"))), "run")
    return rows.where(F.col("_until").isNull() | (F.col("iteration") < F.col("_until"))).drop("_until", "start")


def begin_run(spark: SparkSession, path: str, steps: DataFrame | None = None) -> Log:
    """A new run of the log at ``path``, which goes on after ``steps``: iterations that have a step that these have not
    are replaced. Without ``steps`` it goes on after all."""
    rows = _log(spark, path)
    if rows is None:
        return Log(path, 0, 0, 0)
    run, last = rows.agg(F.max("run"), F.max("iteration")).first()
    start = -1 if last is None else last
    if steps is not None:
        key = ["obs_id", "K", "order", "replicate", "iterate"]
        first = rows.join(steps.select(*key), key, "left_anti").agg(F.min("iteration")).first()[0]
        start = start if first is None else first - 1
    runs = spark.read.schema("run int, start int, iteration int").parquet(path).agg(F.max("run")).first()[0]
    return Log(path, max(run or 0, runs or 0) + 1, start + 1, start + 1)


def write_iteration(steps: DataFrame, log: Log) -> Log:
    """Commit the steps of one iteration; written again, it is replaced."""
    steps.coalesce(1).write.mode("overwrite").parquet(f"{log.path}/run={log.run}/start={log.start}/iteration={log.iteration}")
    return log._replace(iteration=log.iteration + 1)


def write_chain_steps(steps: DataFrame, path: str) -> None:
    """Append EM steps to the log at ``path``, as one iteration more."""
    write_iteration(steps, begin_run(steps.sparkSession, path))


def read_chain_steps(spark: SparkSession, path: str) -> DataFrame:
    """The log's steps; an empty table if there is no log."""
    rows = _log(spark, path)
    return spark.createDataFrame([], STEPS) if rows is None else rows.select(*(x.split()[0] for x in STEPS.split(", ")))


def compact_chain_steps(spark: SparkSession, path: str, to: str) -> None:
    """The log at ``path`` in as few files as it has obs sets, as the one iteration of a new log at ``to``."""
    rows = read_chain_steps(spark, path).repartition("obs_id")
    rows.write.parquet(f"{to}/run=0/start=0/iteration=0")
