"""Column functions on nucleotide and peptide strings. All run inside the JVM; null gives null."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements, in both cases.
_CODES = "ACGTNRYKMSWBDHVacgtnrykmswbdhv"
_COMPLEMENTS = "TGCANYRMKSWVHDBtgcanyrmkswvhdb"
# The amino acids of the standard genetic code for codons in the order T, C, A, G.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def complement(seq: Column) -> Column:
    """Each base's complement, other letters unchanged; only A, C, G, T and N are bases here."""
    return F.translate(seq, "ACGTNacgtn", "TGCANtgcan")


def revcomp(seq: Column) -> Column:
    """The other strand, read forward; all IUPAC codes."""
    return F.reverse(F.translate(seq, _CODES, _COMPLEMENTS))


def _codon_table() -> Column:
    codons = ["".join(c) for c in product("TCAG", repeat=3)]
    return F.create_map(*[F.lit(x) for pair in zip(codons, _AMINO) for x in pair])


def translate_codons(seq: Column, *, start_is_met: bool = False) -> Column:
    """The peptide in frame 1: U counts as T, a codon with any other letter is X, a rest of one or two bases
    is left out. ``start_is_met`` writes M for the first codon."""
    s = F.replace(F.upper(seq), F.lit("U"), F.lit("T"))
    n = F.floor(F.length(s) / 3).cast("int")
    table = _codon_table()
    one = lambda i: F.coalesce(F.try_element_at(table, F.substring(s, i * 3 + 1, F.lit(3))), F.lit("X"))
    peptide = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")).when(n == 0, F.lit(""))
    return F.concat(F.when(F.length(peptide) > 0, F.lit("M")).otherwise(""), F.substring(peptide, 2, 1 << 30)) if start_is_met else peptide


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are among the letters, regardless of case."""
    up = F.upper(seq)
    return F.length(up) - F.length(F.translate(up, letters.upper(), ""))


def gc_percent(seq: Column) -> Column:
    """G and C among the known bases, in percent; null if none is known."""
    known = count_of(seq, "ACGT")
    return F.when(known > 0, 100.0 * count_of(seq, "GC") / known)


def looks_like_cds(seq: Column) -> Column:
    """Whether the sequence can be read as one frame: at least 60 bases, whole codons, no stop before the last."""
    peptide = translate_codons(seq)
    return (F.length(seq) >= 60) & (F.length(seq) % 3 == 0) & (F.instr(F.regexp_replace(peptide, r"\*$", ""), "*") == 0)


def codon_change(reference: Column, position: Column, alt: Column) -> Column:
    """STRUCT<codon INT, ref_aa, alt_aa STRING, synonymous BOOLEAN> of a base exchanged at a 1-based position.

    Null where the codon is cut off by the sequence's end.
    """
    first = F.floor((position - 1) / 3).cast("int") * 3
    codon = F.substring(reference, first + 1, F.lit(3))
    ref_aa, alt_aa = translate_codons(codon), translate_codons(F.overlay(codon, alt, position - first, F.lit(1)))
    return F.when(F.length(codon) == 3, F.struct((first / 3 + 1).cast("int").alias("codon"), ref_aa.alias("ref_aa"), alt_aa.alias("alt_aa"), (ref_aa == alt_aa).alias("synonymous")))


def phred_sum(quality: Column) -> Column:
    """Sum of the Phred scores of a quality string (offset 33)."""
    return F.aggregate(F.filter(F.split(quality, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a + F.ascii(c) - 33)


def pieces(seq: Column, chunk: int, overlap: int) -> Column:
    """ARRAY<STRUCT<piece_offset INT, piece STRING>>: a long sequence in overlapping pieces.

    A piece begins every ``chunk - overlap`` bases until one reaches the end; an overlap that isn't
    smaller than the chunk becomes a quarter of it. A short sequence is one piece.
    """
    step = chunk - (overlap if overlap < chunk else chunk // 4)
    n = F.length(seq)
    last = F.when(n > chunk, F.ceil((n - chunk) / step)).otherwise(0).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("piece_offset"), F.substring(seq, i * step + 1, F.lit(chunk)).alias("piece")))


def aligned_residues(qseq: Column, sseq: Column, sstart: Column, send: Column, *, nucleotide: bool = True) -> Column:
    """ARRAY<STRUCT<position INT, observed, reference STRING, query_offset INT>>: the query's residue at each
    subject position of a gapped alignment.

    Columns with a gap in the subject have no position. A minus-strand nucleotide alignment counts down and
    is complemented back. ``query_offset`` is the number of query residues before the column.
    """
    minus = send < sstart
    n = F.least(F.length(qseq), F.length(sseq))

    def back(c: Column) -> Column:
        up = F.upper(c)
        return F.when(minus, complement(up)).otherwise(up) if nucleotide else up

    letters = lambda c: F.slice(F.split(c, ""), 1, F.greatest(n, F.lit(0)))
    columns = F.transform(F.arrays_zip(letters(qseq).alias("q"), letters(sseq).alias("s")), lambda x, i: F.struct(x["q"].alias("q"), x["s"].alias("s"), i.alias("i")))
    gaps = lambda z, side: F.transform(F.filter(z, lambda x: x[side] == "-"), lambda x: x["i"])

    def walked(o: Column) -> Column:
        """Each column's letters once; what lies before it is its number less the gaps before it."""

        def one(x: Column) -> Column:
            before = lambda g: x["i"] - F.size(F.filter(g, lambda j: j < x["i"]))
            step = F.when(minus, -before(o["sg"])).otherwise(before(o["sg"]))
            return F.struct(
                (sstart + step).cast("int").alias("position"), back(x["q"]).alias("observed"), back(x["s"]).alias("reference"), before(o["qg"]).cast("int").alias("query_offset")
            )

        return F.transform(F.filter(o["z"], lambda x: x["s"] != "-"), one)

    # Arrays of one element hold what is made once for the whole alignment, so the walk is linear but for its gaps.
    zipped = F.array(F.struct(columns.alias("z")))
    with_gaps = F.transform(zipped, lambda o: F.struct(o["z"].alias("z"), gaps(o["z"], "s").alias("sg"), gaps(o["z"], "q").alias("qg")))
    return F.when(n > 0, F.transform(with_gaps, walked)[0])
