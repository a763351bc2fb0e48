"""Jobs over tables of sequences: lookups in chunked references, windows, k-mers, repeats, motif scans."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import bases

from .storage import materialize


PIECE = 4096


def pieces(chunks: DataFrame, size: int = PIECE) -> DataFrame:
    """Chunks (chrom, chunk_start, seq) cut where a position is a multiple of ``size``: chrom, bin, at, piece. Each base is
    in one row, whatever the length of its chunk."""
    head = (size - F.pmod(F.col("chunk_start"), F.lit(size))).cast("int")
    rest = F.regexp_extract_all(F.substr(F.col("seq"), head + 1), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = F.concat(F.array(F.substr(F.col("seq"), F.lit(1), head)), rest)
    rows = chunks.filter("length(seq) > 0").select("chrom", "chunk_start", F.posexplode(cut).alias("_i", "piece"))
    number = F.floor(F.col("chunk_start") / size) + F.col("_i")
    return rows.select("chrom", number.alias("bin"), F.greatest(number * size, F.col("chunk_start")).alias("at"), "piece")


def interval_sequences(intervals: DataFrame, chunks: DataFrame, upstream: int = 0, downstream: int = 0) -> DataFrame:
    """``intervals`` (chrom, start_pos, end_pos, strand) with seq: the reference between the ends and flanks, reverse
    complemented on strand '-'. Chunks (chrom, chunk_start, seq) lie end to end; what lies outside them is left out,
    an interval with no base inside has a null. The reference is shuffled once, in pieces; an interval's ends go to each
    piece that it meets."""
    rows = materialize(intervals.withColumn("_row", F.monotonically_increasing_id()))
    plus = F.col("strand") != "-"
    first = F.col("start_pos") - F.when(plus, upstream).otherwise(downstream)
    last = F.col("end_pos") + F.when(plus, downstream).otherwise(upstream)
    asked = rows.select("_row", "chrom", first.alias("_from"), last.alias("_to")).filter("_from <= _to")
    asked = asked.withColumn("bin", F.explode(F.sequence(F.floor(F.col("_from") / PIECE), F.floor(F.col("_to") / PIECE))))
    met = asked.join(pieces(chunks), ["chrom", "bin"]).filter((F.col("_from") < F.col("at") + F.length("piece")) & (F.col("_to") >= F.col("at")))
    low = F.greatest("_from", "at")
    part = F.substr("piece", (low - F.col("at") + 1).cast("int"), (F.col("_to") - low + 1).cast("int"))
    # parts are cut before they are dealt: the aggregate, which sorts what it reads, would else sort a piece for each interval
    cut = met.select("_row", low.alias("at"), part.alias("part")).repartition("_row")
    whole = cut.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    joined = whole.select("_row", F.array_join(F.col("parts.part"), "").alias("seq"))
    out = rows.join(joined, "_row", "left").drop("_row")
    return out.withColumn("seq", F.when(F.col("strand") == "-", bases.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))


def subfeature_sequences(subfeatures: DataFrame, chunks: DataFrame, without: tuple[str, ...] = ("intron", "variant"), kind: str = "kind") -> DataFrame:
    """Sequences in reading direction of sub-features of every kind but ``without``; those outside the reference go."""
    return interval_sequences(subfeatures.filter(~F.col(kind).isin(*without)), chunks).filter("seq is not null and seq <> ''")


def tiles(seqs: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Windows of ``size`` bases laid end to end over each sequence: win (from 0), piece; the last may be shorter."""
    cut = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return seqs.select(*[c for c in seqs.columns if c != seq], F.posexplode(cut).alias("win", "piece"))


def kmer_table(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """One row for each start of a k-mer: pos (from 0), kmer."""
    return seqs.select(*[c for c in seqs.columns if c != seq], F.inline(bases.kmers(F.col(seq), k)))


def _told_by_row(seqs: DataFrame, k: int, schema: str, tell: Callable, merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``tell`` gives of each sequence, one row or more of (seq_id, *schema), no k-mer being shuffled. Sequences that
    share a seq_id are one: those alone are counted by k-mer, and ``merged`` gives their rows from (seq_id, kmer, n)."""
    from .scans import scan

    own = materialize(scan(seqs, f"part int, {schema}", ["part", *[c.split()[0] for c in schema.split(", ")]], tell))
    heads = own.filter("part = 0").groupBy("seq_id").agg(F.count(F.lit(1)).alias("rows"))
    many = materialize(heads.filter("rows > 1").select(F.col("seq_id").alias("_many")))
    if many.isEmpty():
        return own.drop("part")
    shares = F.col("seq_id").eqNullSafe(F.col("_many"))
    again = kmer_counts(seqs.join(many, shares, "left_semi"), k, ["seq_id"]).select("seq_id", "kmer", "n")
    alone = own.join(many, shares, "left_anti").drop("part")
    return alone.unionByName(merged(again).select(*alone.columns))


def top_kmers(seqs: DataFrame, k: int, n: int = 3) -> DataFrame:
    """The n most frequent k-mers of each sequence; ties go to the lesser k-mer."""
    from .scans import top_words

    def tell(text: str) -> list:
        words, counts = top_words(text, k, n)
        ranks = np.arange(1, len(words) + 1, dtype=np.int32)
        return [ranks - 1, words, counts, ranks]

    def merged(counts: DataFrame) -> DataFrame:
        w = Window.partitionBy("seq_id").orderBy(F.col("n").desc(), "kmer")
        return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

    return _told_by_row(seqs, k, "kmer string, n long, rank int", tell, merged)


def kmer_counts(seqs: DataFrame, k: int, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(keys, kmer, n, n_seqs): how often each k-mer starts in the sequences, and how many of them hold it.

    Each Arrow batch is counted before a row leaves it: a k-mer of A, C, G and T is a number of 2 * k bits (k up to 31),
    so a batch sends one row for each k-mer and combination of ``keys`` that it has. K-mers with other letters are kept as
    they are spelled. Rows with a null sequence hold none."""
    from .scans import counted_kmers

    keys = keys or []

    def count(batches):
        for batch in batches:
            for rows, words, n, n_seqs in counted_kmers(batch.columns[: len(keys)], batch.column(len(keys)), k):
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[: len(keys)]), words, n, n_seqs], [*keys, "kmer", "n", "n_seqs"])

    kinds = dict(seqs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "kmer string, n long, n_seqs long"])
    parts = seqs.select(*keys, F.col(seq)).filter(F.col(seq).isNotNull()).mapInArrow(count, schema)
    return parts.groupBy(*keys, "kmer").agg(F.sum("n").alias("n"), F.sum("n_seqs").alias("n_seqs"))


def universal_motifs(seqs: DataFrame, k: int, least: float) -> DataFrame:
    """k-mers that at least that share of all sequences holds: n_seqs, n, prevalence."""
    total = max(1, seqs.count())
    out = kmer_counts(seqs, k).filter(F.col("n_seqs") >= least * total)
    return out.select("kmer", "n_seqs", "n", (F.col("n_seqs") / F.lit(total)).alias("prevalence")).filter(F.col("prevalence") >= least)


def transitions(seqs: DataFrame, k: int, ahead: int) -> DataFrame:
    """How often a k-mer is followed by another one that starts ``ahead`` bases later."""
    rows = kmer_counts(seqs, k + ahead)  # one word that holds both
    return rows.groupBy(F.substring("kmer", 1, k).alias("kmer"), F.substring("kmer", ahead + 1, k).alias("follower")).agg(F.sum("n").alias("n"))


def distinct_words(seqs: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers over all k-mers of each sequence: a linguistic complexity of one word length."""
    from .scans import word_counts

    def tell(text: str) -> list:
        n = word_counts(text, k)
        found = [[0], [len(n)], [int(n.sum())]] if len(n) else [[], [], []]
        return [np.array(x, dtype=t) for x, t in zip(found, (np.int32, np.int64, np.int64))]

    merged = lambda counts: counts.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_total"))
    return _told_by_row(seqs, k, "n_distinct long, n_total long", tell, merged)


def ngram_entropy(seqs: DataFrame, k: int) -> DataFrame:
    """Entropy in bits of each sequence's k-mers, all starts counted."""
    from .scans import word_counts

    def tell(text: str) -> list:
        n = word_counts(text, k)
        total = n.sum()
        found = [[0], [np.log2(total) - (n * np.log2(n)).sum() / total]] if len(n) else [[], []]
        return [np.array(x, dtype=t) for x, t in zip(found, (np.int32, np.float64))]

    total = F.sum("n")
    merged = lambda counts: counts.groupBy("seq_id").agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))
    return _told_by_row(seqs, k, "entropy double", tell, merged)


def motif_graph(motifs: DataFrame, motif: str = "motif") -> DataFrame:
    """Edges a < b between distinct motifs of edit distance 1 whose lengths differ by at most 1.

    Candidates share a variant with one letter deleted, so no pair of unlike motifs is ever compared.
    """
    m = motifs.select(F.col(motif).alias("m")).filter("m is not null").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("m")), lambda i: F.concat(F.substr(F.col("m"), F.lit(1), i - 1), F.substr(F.col("m"), i + 1)))
    keys = m.filter("length(m) > 0").select("m", F.explode(F.array_distinct(F.concat(cut, F.array("m")))).alias("key"))
    a, b = keys.select(F.col("m").alias("a"), "key"), keys.select(F.col("m").alias("b"), "key")
    return a.join(b, "key").filter("a < b and levenshtein(a, b) = 1").select("a", "b").distinct()


def _folded(regions: DataFrame, variants: DataFrame) -> DataFrame:
    """``regions`` with _ref and _own, the aligned parts of both sides, _at, the first base not yet used, and _moved, the
    (pos, delta) of each variant put in. One ordered fold per region."""
    from .intervals import point_join

    span = regions.withColumn("end_pos", F.col("start_pos") + F.length("seq") - 1)
    hits = point_join(variants, span.select("chrom", "start_pos", "end_pos", "seq_id"))
    lists = hits.groupBy(F.col("b_seq_id").alias("seq_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("a_pos") - F.col("b_start_pos")).cast("int").alias("at"), F.col("a_ref").alias("ref"), F.col("a_alt").alias("alt")))).alias("vs"))
    rows = regions.join(lists, "seq_id", "left")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("ref"), none.alias("own"), F.lit(0).alias("at"), F.array().cast("array<struct<pos:bigint,delta:int>>").alias("moved"))

    def step(acc: Column, v: Column) -> Column:
        fits = (v.at >= acc["at"]) & (F.substr(F.col("seq"), v.at + 1, F.length(v.ref)) == v.ref)
        before = F.substr(F.col("seq"), acc["at"] + 1, v.at - acc["at"])
        wide = F.greatest(F.length(v.ref), F.length(v.alt))
        moved = F.struct((F.col("start_pos") + v.at).cast("long").alias("pos"), (F.length(v.alt) - F.length(v.ref)).alias("delta"))
        put = F.struct(
            F.concat(acc["ref"], F.array(before, F.rpad(v.ref, wide, F.lit("-")))).alias("ref"), F.concat(acc["own"], F.array(before, F.rpad(v.alt, wide, F.lit("-")))).alias("own"),
            (v.at + F.length(v.ref)).alias("at"), F.concat(acc["moved"], F.array(moved)).alias("moved"),
        )
        return F.when(fits, put).otherwise(acc)

    done = F.aggregate(F.coalesce("vs", F.array().cast("array<struct<at:int,ref:string,alt:string>>")), start, step)
    rows = rows.withColumn("_d", done)
    rest = F.substr(F.col("seq"), F.col("_d.at") + 1)
    return rows.select(*regions.columns, F.concat(F.array_join("_d.ref", ""), rest).alias("_ref"), F.concat(F.array_join("_d.own", ""), rest).alias("_own"), F.col("_d.moved").alias("_moved"))


def apply_variants(regions: DataFrame, variants: DataFrame) -> DataFrame:
    """Regions (seq_id, chrom, start_pos, seq) with each variant that lies in them put in: personal, delta, n_applied.

    Variants (chrom, pos, ref, alt) replace ref by alt at their own position, in order; one that begins within the
    span of an earlier one, or whose ref is not there, is skipped. A '-' stands for no base. A region's variants are one row.
    """
    delta = F.aggregate("_moved", F.lit(0), lambda s, m: s + m["delta"])
    return _folded(regions, variants).select("seq_id", F.translate("_own", "-", "").alias("personal"), delta.alias("delta"), F.size("_moved").alias("n_applied"))


def aligned_variants(regions: DataFrame, variants: DataFrame) -> DataFrame:
    """Both sides of ``apply_variants`` with '-' where one has no base: seq_id, aligned_ref, aligned_personal, moved, an
    array of (pos, delta) of the variants put in."""
    return _folded(regions, variants).select("seq_id", F.col("_ref").alias("aligned_ref"), F.col("_own").alias("aligned_personal"), F.col("_moved").alias("moved"))


def hit_runs(hits: DataFrame, gap: int) -> DataFrame:
    """Runs of hits (seq_id, start, end) that follow each other at most ``gap`` apart: n, first start, last end."""
    w = Window.partitionBy("seq_id").orderBy("start", "end")
    new = F.coalesce((F.col("start") - F.lag("end").over(w) > gap).cast("int"), F.lit(1))
    runs = hits.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("seq_id", "_run").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def pwm_information(pwm: DataFrame, pseudocount: float = 0.1) -> DataFrame:
    """Per motif and place: the most frequent base (first in A, C, G, T of equals) and 2 - entropy in bits."""
    total = F.sum("cnt").over(Window.partitionBy("motif_id", "pos")) + 4 * pseudocount
    p = pwm.withColumn("p", (F.col("cnt") + pseudocount) / total)
    return p.groupBy("motif_id", "pos").agg((2 + F.sum(F.col("p") * F.log2("p"))).alias("information"), F.min_by("base", F.struct(-F.col("p"), F.col("base"))).alias("base"))


def codon_changes(variants: DataFrame, chunks: DataFrame) -> DataFrame:
    """Substitutions of one base in their codon, frames counted from each chunk's start: codon, changed, aa, new_aa and
    effect (silent, missense, nonsense, readthrough)."""
    from .intervals import point_join

    held = chunks.select("chrom", F.col("chunk_start").alias("start_pos"), (F.col("chunk_start") + F.length("seq") - 1).alias("end_pos"), "seq")
    hits = point_join(variants.filter("length(ref) = 1 and length(alt) = 1"), held)
    at = (F.col("a_pos") - F.col("b_start_pos")).cast("int")
    rows = hits.withColumn("at", at % 3).withColumn("codon", F.substr("b_seq", (at - at % 3 + 1).cast("int"), F.lit(3))).filter("length(codon) = 3")
    changed = F.concat(F.substr(F.col("codon"), F.lit(1), F.col("at")), F.col("a_alt"), F.substr(F.col("codon"), F.col("at") + 2, F.lit(3)))
    rows = rows.withColumn("changed", changed).withColumn("aa", bases.translate_codons(F.col("codon"))).withColumn("new_aa", bases.translate_codons(F.col("changed")))
    effect = F.when(F.col("aa") == F.col("new_aa"), "silent").when(F.col("new_aa") == "*", "nonsense").when(F.col("aa") == "*", "readthrough").otherwise("missense")
    return rows.select(F.col("a_chrom").alias("chrom"), F.col("a_pos").alias("pos"), F.col("a_alt").alias("alt"), "codon", "changed", "aa", "new_aa", effect.alias("effect"))
