"""Column functions over identifiers, DNA sequences and k-mer codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def rectify_identifier(name: Column) -> Column:
    """Chromosome number of a ``CM00`` scaffold name (characters 5-10 less 2884.2, in decimals); others unchanged."""
    number = F.substring(name, 5, 6).cast("decimal(10,1)") - F.lit("2884.2").cast("decimal(10,1)")
    return F.when(name.startswith("CM00"), number.cast("int").cast("string")).otherwise(name)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTN", "TGCAN")


def mask_check(seq: Column) -> Column:
    """Whether a sequence has no ambiguous base and no run of one base of a tenth of its length (at least one base).

    A sequence of fewer than 20 bases has such a run always: its tenth is one base or none.
    """
    n = F.floor(F.length(seq) / 10)
    runs = [F.contains(seq, F.repeat(F.lit(b), n.cast("int"))) for b in BASES]
    repetitive = runs[0] | runs[1] | runs[2] | runs[3]
    return ~seq.rlike("[^ACGT]") & ~repetitive & (F.length(seq) > 0)


def windows_passing(seq: Column, size: int) -> Column:
    """How many of the windows of ``size`` bases, 20 at least, of a sequence pass ``mask_check``; a shorter sequence is
    one window.

    A window passes if it lies within a stretch without ambiguous bases and without a run of a tenth of its length. Such
    stretches lie between the places that no window may cover: a run of k bases too many is cut so that k - 1 of it stay
    on both sides. So no window is made: the work is that of reading the sequence.
    """
    if size < 20:
        raise ValueError("windows have 20 bases at least")
    k = size // 10
    side = "$1" * (k - 1)
    cut = F.regexp_replace(seq, rf"([{BASES}])\1{{{k - 1},}}", f"{side}|{side}")
    passing = F.aggregate(F.split(cut, f"[^{BASES}]+"), F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.length(x) - (size - 1), F.lit(0)))
    return F.when(F.length(seq) >= size, passing).otherwise(mask_check(seq).cast("long"))


def kmer_code(kmer: Column) -> Column:
    """1 + sum of base * 4^position with the first base varying fastest; null with any base but A, C, G, T."""
    digits = F.translate(F.reverse(kmer), BASES, "0123")
    return F.when(kmer.rlike("^[ACGT]+$"), F.conv(digits, 4, 10).cast("long") + 1)


def kmer_of(code: Column, order: int) -> Column:
    """The k-mer of ``order + 1`` bases that has a code."""
    digits = F.lpad(F.conv((code - 1).cast("string"), 10, 4), order + 1, "0")
    return F.reverse(F.translate(digits, "0123", BASES))
