"""The synthetic scaffold of 1,000 bases that golden cases are stated on, and brute-force helpers."""

import itertools

SEQ = "AT" * 250 + "CG" * 5 + "CAT" * 20 + "CG" * 15 + "CAT" * 20 + "CG" * 20 + "CAT" * 20 + "CG" * 20 + "CAT" * 20 + "CG" * 20 + "CAT" * 20 + "CG" * 12 + "AT" * 8
assert len(SEQ) == 1000
CDS = [(511, 570, "+"), (601, 660, "-"), (701, 760, "-"), (801, 860, "-"), (901, 960, "-")]
EXON = [("exon", s, e, d) for s, e, d in CDS]
PERI = [("periexonic", s, e, "-") for s, e in ((251, 510), (571, 600), (661, 700), (761, 800), (861, 900), (961, 1000))]
GOLDEN = [*EXON, *PERI, ("intergenic", 1, 250, None)]


def gff(path):
    rows = [("chromosome", 1, 1000, "."), ("gene", 501, 1000, "-"), *(("CDS", *c) for c in CDS), ("exon", 501, 570, "+"), ("exon", 901, 975, "-")]
    lines = ["##gff-version 3", "# a comment", *("\t".join(["1", "x", t, str(s), str(e), ".", d, ".", "ID=a"]) for t, s, e, d in rows)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def fasta(path):
    path.write_text(">CM002885.2.1 description here\n" + "\n".join(SEQ[i : i + 80] for i in range(0, 1000, 80)) + "\n>other\nACGT\n>MT x\nAC\n")
    return str(path)


def runs(values):
    """(first, last, value) of the runs of a list, places from 1."""
    out, at = [], 1
    for value, group in itertools.groupby(values):
        n = len(list(group))
        out.append((at, at + n - 1, value))
        at += n
    return out
