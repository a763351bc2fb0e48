"""Column functions over nucleotide strings. All stay in the JVM; nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ambiguity codes and the bases that each stands for.
IUPAC = {"A": "A", "T": "T", "G": "G", "C": "C", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
BASES = "ATGC"
COMPLEMENT = ("ATGCRYSWKMBDHVN", "TACGYRSWMKVHDBN")
# Fixed value: amino acids of the standard code, codons in the order T, C, A, G of each place.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def complement(seq: Column) -> Column:
    return F.translate(seq, *COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def transition(seq: Column) -> Column:
    """A and G, C and T exchanged."""
    return F.translate(seq, "AGCT", "GATC")


def transversion(seq: Column) -> Column:
    """A and C, G and T exchanged."""
    return F.translate(seq, "ACGT", "CATG")


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "T", "U")


def strong_weak(seq: Column) -> Column:
    return F.translate(seq, "ATGC", "WWSS")


def purine_pyrimidine(seq: Column) -> Column:
    return F.translate(seq, "AGCT", "RRYY")


def amino_keto(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "MMKK")


def count_of(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def fraction_of(seq: Column, letters: str) -> Column:
    """Share of ``letters`` among the bases other than N; null for none."""
    return F.try_divide(count_of(seq, letters), F.length(seq) - count_of(seq, "N"))


def gc_fraction(seq: Column) -> Column:
    return fraction_of(seq, "GC")


def is_dna(seq: Column) -> Column:
    return seq.rlike("^[ATGCN]*$")


def is_rna(seq: Column) -> Column:
    return seq.rlike("^[AUGCN]*$")


def is_consensus(seq: Column) -> Column:
    """Bases and ambiguity codes alone."""
    return seq.rlike(f"^[{''.join(IUPAC)}]*$")


def composition_entropy(seq: Column) -> Column:
    """Entropy in bits of the shares of A, T, G and C."""
    total = count_of(seq, BASES)
    out = F.lit(0.0)
    for base in BASES:
        p = F.try_divide(count_of(seq, base), total)
        out = out - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return out


def words(seq: Column, k: int, step: int | None = None) -> Column:
    """Array of the k-letter words from the start on, each ``step`` = k letters after the last; a shorter rest goes."""
    if step not in (None, k):
        raise ValueError("words of another step are kmers")
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{{k}}}"), F.lit(0))


def kmers(seq: Column, k: int) -> Column:
    """Array of (pos, kmer) of every start from 0; linear in the length, as each phase is cut by one scan."""

    def phase(o: Column) -> Column:
        return F.transform(words(F.substr(seq, o + 1), k), lambda w, i: F.struct((o + i * k).alias("pos"), w.alias("kmer")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), phase))


def translate_codons(seq: Column) -> Column:
    """Amino acids of whole codons from the first base on; X for a codon with another letter than T, C, A and G."""

    codons = words(seq, 3)
    return F.array_join(F.transform(codons, lambda c: F.when(c.rlike("^[TCAG]{3}$"), F.substr(F.lit(CODE), F.conv(F.translate(c, "TCAG", "0123"), 4, 10).cast("int") + 1, F.lit(1))).otherwise("X")), "")


def rotations(seq: Column) -> Column:
    doubled = F.concat(seq, seq)
    return F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.substr(doubled, i, F.length(seq)))


def canonical(seq: Column, both_strands: bool = True) -> Column:
    """The least rotation, over both strands if asked for. Meant for motifs: cost grows with the square of the length."""
    one = F.array_min(rotations(seq))
    out = F.least(one, F.array_min(rotations(reverse_complement(seq)))) if both_strands else one
    return F.when(F.length(seq) > 0, out).otherwise(seq)


def sequence_index(seq: Column) -> Column:
    """Number of a short sequence in base 4, digits A, T, G, C; up to 31 letters."""
    return F.conv(F.translate(seq, BASES, "0123"), 4, 10).cast("long")


def index_sequence(index: Column, n: int) -> Column:
    """The sequence of ``n`` letters with that number."""
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, 4), n, "0"), "0123", BASES)


def longest_run(seq: Column, letters: str) -> Column:
    """Length of the longest run of any of ``letters``."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(seq, F.lit(f"[{letters}]+"), F.lit(0)), F.length)), F.lit(0))


def iupac_regex(consensus: str) -> str:
    """Regular expression of a consensus in ambiguity codes."""
    return "".join(c if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in consensus)


def iupac_regex_both(consensus: str) -> str:
    """Regular expression of a consensus or of its reverse complement."""
    other = consensus[::-1].translate(str.maketrans(*COMPLEMENT))
    return iupac_regex(consensus) if other == consensus else f"(?:{iupac_regex(consensus)}|{iupac_regex(other)})"


def base_mask(base: Column) -> Column:
    """Bases of an ambiguity code as bits: A 1, C 2, G 4, T 8."""
    out = F.lit(0)
    for code, bases in IUPAC.items():
        out = F.when(base == code, sum({"A": 1, "C": 2, "G": 4, "T": 8}[b] for b in bases)).otherwise(out)
    return out


def mask_code(mask: Column) -> Column:
    """The ambiguity code of a set of bases; null for none."""
    out = F.lit(None).cast("string")
    for code, bases in IUPAC.items():
        out = F.when(mask == sum({"A": 1, "C": 2, "G": 4, "T": 8}[b] for b in bases), code).otherwise(out)
    return out


def multiplicity(mask: Column) -> Column:
    """How many bases a set holds."""
    return F.bit_count(mask)


def hamming(a: Column, b: Column) -> Column:
    """Places where two strings differ, as far as the shorter goes."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.substr(a, F.lit(1), n), ""), F.split(F.substr(b, F.lit(1), n), ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def one_hot(seq: Column) -> Column:
    """Per base: 0 to 3 for A, T, G, C and 4 for anything else."""
    return F.transform(F.split(F.translate(seq, BASES, "0123"), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(4)))


def rotate(seq: Column, n: int) -> Column:
    """The first ``n`` letters moved to the end."""
    return F.concat(F.substr(seq, F.lit(n + 1)), F.substr(seq, F.lit(1), F.lit(n)))


def pad(seq: Column, n: int, letter: str = "N") -> Column:
    """Filled up at the right to ``n`` letters; a longer one stays whole."""
    return F.when(F.length(seq) < n, F.rpad(seq, n, letter)).otherwise(seq)


def tile(seq: Column, n: int) -> Column:
    """Repeated and cut to ``n`` letters; an empty one stays empty."""
    return F.substr(F.repeat(seq, F.ceil(n / F.greatest(F.length(seq), F.lit(1))).cast("int")), F.lit(1), F.lit(n))


def crop_centre(seq: Column, n: int) -> Column:
    """The middle ``n`` letters, or all of a shorter one."""
    return F.substr(seq, F.floor(F.greatest(F.length(seq) - n, F.lit(0)) / 2).cast("int") + 1, F.lit(n))


def convert(seq: Column, letters: str, to: str) -> Column:
    """Letters of one vocabulary replaced by those at the same places of another."""
    return F.translate(seq, letters, to)


def repeat_phase(seq: Column, unit: str) -> Column:
    """Struct (phase, matches): the shift of the repeated unit that agrees with most bases; the least of equals."""
    k = len(unit)

    def at(o: int) -> Column:
        matches = F.length(seq) - hamming(seq, tile_to(F.lit(unit[o:] + unit[:o]), k, F.length(seq)))
        return F.struct((-matches).cast("long").alias("missing"), F.lit(o).cast("long").alias("phase"))

    best = F.array_min(F.array(*[at(o) for o in range(k)]))
    return F.struct(best["phase"].alias("phase"), (-best["missing"]).alias("matches"))


def tile_to(unit: Column, k: int, n: Column) -> Column:
    """A unit of ``k`` letters repeated over ``n`` letters."""
    return F.substr(F.repeat(unit, F.ceil(n / k).cast("int")), F.lit(1), n)


def zygosity(genotype: Column) -> Column:
    """absent, homozygous or heterozygous, from allele numbers divided by / or |; null where an allele is not known."""
    alleles = F.split(genotype, r"[/|]")
    known = F.forall(alleles, lambda a: a.rlike("^[0-9]+$"))
    return F.when(known, F.when(F.forall(alleles, lambda a: a == "0"), "absent").when(F.size(F.array_distinct(alleles)) == 1, "homozygous").otherwise("heterozygous"))
