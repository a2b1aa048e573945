import random

import pytest
from pyspark.sql import functions as F

from basewright.operators import intervals as iv
from basewright.operators import locate, sampling
from basewright.sources.genome import read_fasta, read_gff3, read_position_fasta, tile_scaffolds
from tests.genome import GOLDEN, SEQ, fasta, gff, runs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def genome(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    features = read_gff3(spark, gff(d / "a.gff3"))
    scaffolds = iv.scaffold_table(features)
    parts = iv.partition_genome(features, scaffolds, 250, bin_size=128)
    tiles = tile_scaffolds(read_fasta(spark, fasta(d / "a.fa")), 64)
    return {"features": features, "scaffolds": scaffolds, "parts": parts.persist(), "tiles": tiles}


def test_sources(spark, tmp_path, genome):
    got = {r["id"]: r for r in read_fasta(spark, fasta(tmp_path / "b.fa")).collect()}
    assert got["1"]["sequence"] == SEQ and got["1"]["description"] == "description here"
    assert set(got) == {"1", "other", "MT"}
    (tmp_path / "p.fa").write_text(f">1 start 501 end 641 smt_pos 111\n{SEQ[500:641]}\n>MT start 1 end 2\nAC\n")
    assert rows(read_position_fasta(spark, str(tmp_path / "p.fa"))) == [("1", 501, 641, SEQ[500:641])]
    assert rows(genome["scaffolds"]) == [("1", 1, 1000, 1, 1000)]


def test_golden_partitions(genome):
    got = rows(genome["parts"].select("partition", "start", "end", F.coalesce("strand", F.lit(""))))
    assert got == sorted((p, s, e, d or "") for p, s, e, d in GOLDEN)
    assert dict(rows(iv.partition_sizes(genome["parts"]))) == {"exon": 300, "periexonic": 450, "intergenic": 250}


def test_pad_must_not_be_negative(genome):
    with pytest.raises(ValueError):
        iv.partition_genome(genome["features"], genome["scaffolds"], -1)


@pytest.mark.parametrize("seed", range(4))
def test_sweeps_agree_with_arrays(spark, seed):
    rng = random.Random(seed)
    n = 300
    made = {name: [(str(rng.randrange(2)), s := rng.randrange(1, n - 20), min(n, s + rng.randrange(0, 25)), rng.choice("+-")) for _ in range(rng.choice([0, 5, 25]))] for name in "ab"}
    schema = "seqid string, start long, end long, strand string"
    a, b = (spark.createDataFrame(made[x], schema) for x in "ab")
    scaffolds = spark.createDataFrame([("0", n), ("1", n)], "seqid string, end long")

    def cover(name, seqid, strand=None):
        return [any(s <= p <= e and (strand is None or d == strand) for q, s, e, d in made[name] if q == seqid) for p in range(1, n + 1)]

    merged, less, rest = [], [], []
    for q in "01":
        ca, cp, cb = cover("a", q), cover("a", q, "+"), cover("b", q)
        merged += [(q, s, e, "+" if cp[s - 1] else "-") for s, e, v in runs(ca) if v]
        less += [(q, s, e, "+" if cp[s - 1] else "-") for s, e, v in runs([x and not y for x, y in zip(ca, cb)]) if v]
        rest += [(q, s, e) for s, e, v in runs([not y for y in cb]) if v]
    assert rows(iv.merge_intervals(a, bin_size=32)) == sorted(merged)
    assert rows(iv.subtract_intervals(a, b, bin_size=32)) == sorted(less)
    assert rows(iv.complement_intervals(scaffolds, b, bin_size=32)) == sorted(rest)


def test_metacoordinates_and_points(spark, genome):
    meta = iv.add_metacoordinates(genome["parts"], bin_size=64).persist()
    for name in ("exon", "periexonic", "intergenic"):
        at = 1
        for r in sorted((r for r in meta.collect() if r["partition"] == name), key=lambda r: r["start"]):
            assert r["meta_start"] == at and r["meta_end"] == at + r["end"] - r["start"]
            at = r["meta_end"] + 1
    points = spark.createDataFrame([("exon", p) for p in range(0, 302)], "partition string, point long")
    got = {r["point"]: r for r in locate.locate_metacoord(points, meta).collect()}
    assert not got[0]["found"] and not got[301]["found"] and len(got) == 302
    for r in meta.where("partition = 'exon'").collect():
        for p in range(r["meta_start"], r["meta_end"] + 1):
            assert got[p]["start"] == r["start"] and got[p]["strand"] == r["strand"]
    window = spark.createDataFrame([("exon", 61, 70), ("intergenic", 5, 8)], "partition string, meta_from long, meta_to long")
    got = {r["partition"]: (r["scaffold_start"], r["scaffold_end"], r["strand"]) for r in locate.meta_to_scaffold(window, meta).collect()}
    assert got == {"exon": (601, 610, "-"), "intergenic": (5, 8, "0")}


def test_fetch_sequence(spark, genome):
    regions = spark.createDataFrame([("1", 501, 641, "+"), ("1", 1, 1000, "-"), ("1", 64, 65, "0"), ("1", 700, 700, "+")], "seqid string, start long, end long, strand string")
    got = {(r["start"], r["end"]): r["sequence"] for r in locate.fetch_sequence(regions, genome["tiles"], tile=64).collect()}
    assert got[501, 641] == SEQ[500:641] and got[64, 65] == SEQ[63:65] and got[700, 700] == SEQ[699]
    assert got[1, 1000] == SEQ[::-1].translate(str.maketrans("ACGT", "TGCA"))
    bad = spark.createDataFrame([("1", 1, 5, "?")], regions.schema)
    with pytest.raises(Exception, match="no strand"):
        locate.fetch_sequence(bad, genome["tiles"], tile=64).collect()
    for off in (("1", 990, 1001, "+"), ("1", 2000, 2001, "+"), ("1", 0, 3, "+"), ("none", 1, 2, "+")):
        with pytest.raises(Exception, match="off its scaffold"):
            locate.fetch_sequence(spark.createDataFrame([off], regions.schema), genome["tiles"], tile=64).collect()


@pytest.mark.parametrize(("pad", "want"), [(141, (360, 141, 0)), (350, (151, 350, 0)), (600, (1, 500, 100))])
def test_golden_pads(spark, genome, pad, want):
    positions = spark.createDataFrame([(7, "1", 501, 641)], "pos_id long, seqid string, start long, end long")
    r = locate.pad_positions(positions, genome["scaffolds"], genome["tiles"], pad, tile=64).first()
    assert (r["pad_start"], r["rel_start"], r["seq_offset"]) == want and r["sequence"] == SEQ[want[0] - 1 : 641]


def test_golden_masks_and_fragments(spark, genome):
    positions = spark.createDataFrame([(1, "1", 360, 641, SEQ[359:641]), (2, "1", 151, 641, SEQ[150:641])], "pos_id long, seqid string, pad_start long, end long, sequence string")
    mask = locate.partition_mask(positions, genome["parts"]).persist()
    got = rows(mask)
    assert [r[1:] for r in got if r[0] == 1] == [(1, 151, 2, -1), (152, 211, 3, 1), (212, 241, 2, -1), (242, 282, 3, -1)]
    assert [r[1:4] for r in got if r[0] == 2] == [(1, 100, 1), (101, 360, 2), (361, 420, 3), (421, 450, 2), (451, 491, 3)]
    assert locate.dense_mask(mask).count() == 282 + 491
    frags = {r["frag_start"]: r for r in locate.fragment_by_partition(positions, mask).where("pos_id = 1").collect()}
    assert frags[1]["fragment"] == SEQ[359:510][::-1].translate(str.maketrans("ACGT", "TGCA")) and frags[152]["fragment"] == SEQ[510:570]
    assert frags[242]["frag_end"] == 282
    off = spark.createDataFrame([(1, "1", 900, 1001, "")], positions.schema)
    with pytest.raises(Exception, match="no partition"):
        locate.partition_mask(off, genome["parts"]).collect()


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "seqid string, start long, end long, strand string")
    assert iv.merge_intervals(empty).count() == 0
    assert iv.add_metacoordinates(empty.withColumn("partition", F.lit("x"))).count() == 0


def test_joins_of_growing_tables_stay_out_of_the_driver(spark):
    parts = spark.createDataFrame([("exon", "1", 1, 50, "+"), ("intergenic", "1", 51, 90, None)], "partition string, seqid string, start long, end long, strand string")
    positions = spark.createDataFrame([(1, "1", 10, 70), (2, "1", 60, 90)], "pos_id long, seqid string, pad_start long, end long")
    metas = iv.add_metacoordinates(parts)
    points = spark.createDataFrame([("exon", 7, 0), ("intergenic", 3, 1)], "partition string, point long, draw long")
    tiles = spark.createDataFrame([("1", 0, 1, "ACGT" * 25)], "seqid string, tile long, tile_start long, seq string")
    taken = parts.select("partition", "seqid", F.col("start").alias("lo"), "start", "end")
    near = points.select("partition", F.lit("1").alias("seqid"), F.lit(1).cast("long").alias("lo"), "point", "draw")
    runs = locate.partition_mask(positions, parts)
    made = [metas, runs, locate.locate_metacoord(points, metas), locate.fetch_sequence(parts.fillna("+"), tiles), locate.tiled_fragments(positions, runs, tiles), sampling._beside(near, taken, 20, 64)]
    for df in made:
        assert df.count() > 0 or df is made[-1]
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
