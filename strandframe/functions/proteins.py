"""Column functions over codons and proteins. All stay in the JVM; nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bases

# Codons that translation may begin with, and groups of amino acids that may stand for each other.
START_CODONS = ["ATG", "CTG", "GTG", "TTG"]
ALIKE = ["AVLIM", "FWY", "STC", "NQ", "DE", "KRH", "G", "P"]


def first_start(seq: Column, starts: list[str] = START_CODONS, within: int = 100) -> Column:
    """Offset (from 0) of the first whole codon in ``starts`` that begins in the first ``within`` bases; null for none."""
    codons = F.slice(bases.words(seq, 3), F.lit(1), F.lit(-(-within // 3)))
    at = F.array_position(F.transform(codons, lambda c: c.isin(*starts)), F.lit(True))
    return F.when(at > 0, (3 * (at - 1)).cast("int"))


def effect(aa: Column, new_aa: Column) -> Column:
    return F.when(aa == new_aa, "silent").when(new_aa == "*", "nonsense").when(aa == "*", "readthrough").otherwise("missense")


def conservative(aa: Column, new_aa: Column) -> Column:
    """Whether two amino acids are of one group."""
    out = F.lit(False)
    for group in ALIKE:
        out = out | (aa.isin(*group) & new_aa.isin(*group))
    return out


def changes(reference: Column, personal: Column) -> Column:
    """Differences place by place (position from 1, reference, alternate, kind, notation), and one of kind length_change
    where the lengths differ, at the length of the shorter: p.X12Y, p.12_ext3 or p.12_del3."""
    short = F.least(F.length(reference), F.length(personal))
    places = F.filter(F.sequence(F.lit(0), short), lambda i: (i > 0) & (F.substr(reference, i, F.lit(1)) != F.substr(personal, i, F.lit(1))))

    def told(i: Column) -> Column:
        a, b = F.substr(reference, i, F.lit(1)), F.substr(personal, i, F.lit(1))
        return F.struct(i.alias("position"), a.alias("reference"), b.alias("alternate"), effect(a, b).alias("kind"), F.concat(F.lit("p."), a, i.cast("string"), b).alias("notation"))

    longer = F.length(personal) - F.length(reference)
    notation = F.concat(F.lit("p."), short.cast("string"), F.when(longer > 0, "_ext").otherwise("_del"), F.abs(longer).cast("string"))
    none = F.lit(None).cast("string")
    last = F.struct(short.alias("position"), none.alias("reference"), none.alias("alternate"), F.lit("length_change").alias("kind"), notation.alias("notation"))
    single = F.transform(places, told)
    return F.when(longer == 0, single).otherwise(F.concat(single, F.array(last)))


def identity(a: Column, b: Column) -> Column:
    """Share of equal places over the longer length; null for two empty proteins."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: (i > 0) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))))
    return F.try_divide(same.cast("double"), F.greatest(F.length(a), F.length(b)).cast("double"))
