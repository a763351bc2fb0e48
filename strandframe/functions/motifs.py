"""Column functions over consensus strings, repeats of a unit and short strands. All stay in the JVM; nulls give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bases

# Fixed value: the base that stands for each ambiguity code where one is asked for.
MINIMAL = {"A": "A", "T": "T", "G": "G", "C": "C", "R": "A", "Y": "T", "S": "G", "W": "A", "K": "T", "M": "A", "B": "T", "D": "A", "H": "A", "V": "A", "N": "A"}


def consensus_entropy(seq: Column) -> Column:
    """Mean over the letters of p ln(1/p), p one over the bases of the code; N at the ends counts nothing but length.
    1 for an empty consensus."""
    inner = F.regexp_replace(seq, "^N+|N+$", "")
    total = F.lit(0.0)
    for code, of in bases.IUPAC.items():
        total = total + bases.count_of(inner, code) * (math.log(len(of)) / len(of))
    return F.when(F.length(seq) < 1, 1.0).otherwise(F.try_divide(total, F.length(seq)))


def consensus_logprob(seq: Column) -> Column:
    """Minus the sum of ln(4 - bases of the code); infinite with an N."""
    total = F.lit(0.0)
    for code, of in bases.IUPAC.items():
        if code != "N":
            total = total - bases.count_of(seq, code) * math.log(4 - len(of))
    return F.when(bases.count_of(seq, "N") > 0, F.lit(math.inf)).otherwise(total)


def consensus_likelihood(seq: Column) -> Column:
    return F.exp(consensus_logprob(seq))


def consensus_log_odds(seq: Column, seen: Column, samples: Column) -> Column:
    """Logarithm of the share of samples seen over the likelihood, as the likelihood of a long consensus is below any double."""
    return F.ln(F.try_divide(seen, samples)) - consensus_logprob(seq)


def consensus_minimal(seq: Column) -> Column:
    """One base for each ambiguity code."""
    return F.translate(seq, "".join(MINIMAL), "".join(MINIMAL.values()))


def consensus_sample(seq: Column, key: Column, seed: int = 0) -> Column:
    """A base for each code, drawn by the hash of seed, key and place, so that a task run again draws the same."""

    def draw(code: Column, i: Column) -> Column:
        picks = F.xxhash64(F.lit(seed), key, i)
        out = code
        for c, of in bases.IUPAC.items():
            if len(of) > 1:
                out = F.when(code == c, F.substr(F.lit(of), F.pmod(picks, F.lit(len(of))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(seq, ""), draw), "")


def repeat_score(seq: Column, unit: str) -> Column:
    """Places of the unit, and half of those of the unit with one letter free, over the length; found from the left, not overlapping."""
    total = F.regexp_count(seq, F.lit(unit)).cast("double")
    for i in range(len(unit)):
        total = total + F.regexp_count(seq, F.lit(f"{unit[:i]}.{unit[i + 1 :]}")) * 0.5
    return F.try_divide(total, F.length(seq))


def encode_symbols(seq: Column, symbols: dict[str, str], other: str = ".") -> Column:
    """From the left, the symbol of the longest motif that begins here, or ``other`` for one letter. Linear in the length."""
    longest_first = sorted(symbols, key=lambda m: (-len(m), m))
    table = F.create_map(*[F.lit(x) for m in longest_first for x in (m, symbols[m])])
    tokens = F.regexp_extract_all(seq, F.lit("|".join([*longest_first, "."])), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(other))), "")


def gc_bias(seq: Column) -> Column:
    """Struct (mean, sd) of the places of G and C as shares of the length; sd is the root of |sum of squares - mean squared|.
    Null parts without G and C."""
    at = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when(c.isin("G", "C"), i)), lambda x: x.isNotNull())
    total = F.aggregate(at, F.lit(0).cast("long"), lambda s, x: s + x)
    squares = F.aggregate(at, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    mean = F.try_divide(total.cast("double"), F.size(at))
    return F.struct(F.try_divide(mean, F.length(seq)).alias("mean"), F.try_divide(F.sqrt(F.abs(squares - mean * mean)), F.length(seq)).alias("sd"))


def guide_choice(seq: Column, other: Column) -> Column:
    """Struct (forward, reverse): which of two strands is the likelier guide, by its first letter and its G and C's mean place."""
    mean, other_mean = gc_bias(seq)["mean"], gc_bias(other)["mean"]
    weak, other_weak = F.substring(seq, 1, 1).isin("A", "T"), F.substring(other, 1, 1).isin("A", "T")
    by_letter = weak | other_weak
    forward = F.when(by_letter, weak & (mean >= 0.5)).otherwise(mean >= 0.5)
    reverse = F.when(by_letter, other_weak & (other_mean >= 0.5)).otherwise(~(mean >= 0.5) & (other_mean >= 0.5))
    compare = forward | ~reverse
    return F.struct(F.when(compare, mean - other_mean > 0).otherwise(forward).alias("forward"), F.when(compare, mean - other_mean <= 0).otherwise(reverse).alias("reverse"))
