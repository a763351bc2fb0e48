"""Where a sequence like a probe lies in the reference, from coarse to fine; distances between base profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import bases

from .scans import coded, kmer_codes, scan
from .sequences import interval_sequences
from .storage import materialize

OTHER_STRAND = 4 / 3  # fixed value: what a hit on the other strand counts for when hits are ranked


def _matches(text: str, probe: str) -> np.ndarray:
    """Equal bases of the probe laid at each start of a text at least as long."""
    x, p = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8), probe.encode()
    n = max(0, len(x) - len(p) + 1)
    same = np.zeros(n, dtype=np.int64)
    for i, letter in enumerate(p):
        same += x[i : i + n] == letter
    return same


def homology_search(chunks: DataFrame, probe: str, window: int, keep: int, k: int = 8) -> DataFrame:
    """The ``keep`` windows of the reference that share most words of ``k`` bases with a probe on either strand, and in each
    the place that fits it best: chrom, start (from 1), strand, share of equal bases, shared words. ``keep`` is the feature.

    Coarse step: every chunk (chrom, chunk_start, seq; they lie end to end) is read with the bases after it and its windows
    are counted in the row. Fine step: the probe is laid at every start of the windows kept. Ties go to the first place.
    """
    if len(probe) < k:
        raise ValueError("the probe is shorter than a word")
    other = probe[::-1].translate(str.maketrans(*bases.COMPLEMENT))
    own, mate = (np.unique(kmer_codes(coded(p), k)) for p in (probe, other))
    reach = len(probe) - 1
    end = F.col("chunk_start") + F.length("seq") - 1
    tails = chunks.select("chrom", "chunk_start", F.col("seq").alias("body"), (end + 1).alias("start_pos"), (end + reach).alias("end_pos"), F.lit("+").alias("strand"))
    rows = interval_sequences(tails, chunks).select(F.struct("chrom", "chunk_start", F.length("body").alias("size")).alias("at"), F.concat("body", F.coalesce("seq", F.lit(""))).alias("seq"))

    def count(text: str) -> list:
        words = kmer_codes(coded(text), k)
        starts = np.arange(0, len(text), window, dtype=np.int64)
        held = [np.unique(words[s : s + window + reach - k + 1]) for s in starts]
        return [starts, *[np.array([np.isin(p[p >= 0], h, assume_unique=True).sum() for h in held], dtype=np.int64) for p in (own, mate)]]

    found = scan(rows, "offset long, own long, mate long", ["offset", "own", "mate"], count, key="at").filter(F.col("offset") < F.col("at.size"))
    minus = F.col("mate") * OTHER_STRAND > F.col("own")
    ranked = found.select("at.chrom", (F.col("at.chunk_start") + F.col("offset")).alias("start_pos"), F.when(minus, "-").otherwise("+").alias("reads"), F.when(minus, F.col("mate")).otherwise(F.col("own")).alias("words"), F.greatest("own", F.col("mate") * OTHER_STRAND).alias("score"))
    best = materialize(ranked.filter("words > 0").orderBy(F.col("score").desc(), "chrom", "start_pos").limit(keep))
    near = interval_sequences(best.withColumn("end_pos", F.col("start_pos") + window + reach - 1).withColumn("strand", F.lit("+")), chunks)
    near = near.select(F.struct("chrom", "start_pos", "words", "reads").alias("at"), F.concat("reads", "seq").alias("seq"))

    def lay(text: str) -> list:
        same = _matches(text[1:], other if text[0] == "-" else probe)
        if not len(same):
            return [np.zeros(0, np.int64), np.zeros(0)]
        at = int(same.argmax())
        return [np.array([at], dtype=np.int64), np.array([same[at] / len(probe)])]

    laid = scan(near, "offset long, share double", ["offset", "share"], lay, key="at")
    return laid.select("at.chrom", (F.col("at.start_pos") + F.col("offset")).alias("start"), F.col("at.reads").alias("strand"), "share", F.col("at.words").alias("words"))


def profile_distances(profiles: DataFrame) -> DataFrame:
    """Distances of each pair a < b of profiles (name, pos, A, T, G, C as counts), summed over the positions both have: alias
    (bases in one alone, halved), mode (other commonest base), kl and js (natural logarithm; a base that one side alone has
    counts 1). One row a pair and position meets; profiles are few and short, their counts may be of any size."""
    total = F.col("A") + F.col("T") + F.col("G") + F.col("C")
    rows = profiles.filter(total > 0).select("name", "pos", F.array(*[F.col(b) / total for b in bases.BASES]).alias("p"))
    both = rows.select(F.col("name").alias("a"), "pos", F.col("p").alias("p")).join(rows.select(F.col("name").alias("b"), "pos", F.col("p").alias("q")), "pos").filter("a < b")

    def kl(p, q):
        def term(x, y):
            return F.when((x > 0) & (y > 0), x * F.ln(x / y)).when((x > 0) | (y > 0), 1.0).otherwise(0.0)

        return F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)

    p, q = F.col("p"), F.col("q")
    mixed = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    alone = F.aggregate(F.zip_with(p, q, lambda x, y: ((x > 0) != (y > 0)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    mode = (F.array_position(p, F.array_max(p)) != F.array_position(q, F.array_max(q))).cast("long")
    return both.groupBy("a", "b").agg(F.sum(alone / 2).alias("alias"), F.sum(mode).alias("mode"), F.sum(kl(p, q)).alias("kl"), F.sum((kl(p, mixed) + kl(q, mixed)) / 2).alias("js"))
