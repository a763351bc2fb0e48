"""Coding sequences: segments joined over a piecewise map of places, translated, and what variants do to the protein.

Segments (transcript, chrom, strand, start_pos, end_pos) are the coding parts of a transcript; on strand '-' the one of
greatest position is read first. The map gives each segment the coding bases before it, so a place has one offset in the
transcript and a codon that a border cuts in two is one codon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import bases, proteins

from .intervals import infer_introns, point_join
from .sequences import apply_variants, interval_sequences
from .storage import materialize, tidy

KEYS = ["transcript", "chrom", "strand"]


def cds_features(features: DataFrame) -> DataFrame:
    """Rows of type CDS, and one more for each transcript with cds_start and cds_end, whose parent is its name: chrom,
    start_pos, end_pos, feature_type, source, strand, name, parent."""
    columns = {"cds_start": "bigint", "cds_end": "bigint", "parent": "string", "source": "string", "name": "string", "strand": "string"}
    rows = features.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in features.columns})
    names = ["chrom", "start_pos", "end_pos", "feature_type", "source", "strand", "name", "parent"]
    own = rows.filter("feature_type = 'CDS'").select(*names)
    made = rows.filter("feature_type = 'transcript' and cds_start is not null and cds_end is not null")
    made = made.select("chrom", F.col("cds_start").alias("start_pos"), F.col("cds_end").alias("end_pos"), F.lit("CDS").alias("feature_type"), "source", "strand", F.lit(None).cast("string").alias("name"), F.col("name").alias("parent"))
    return own.unionByName(made)


def gaps(exons: DataFrame) -> DataFrame:
    """Introns of genes (gene_name, chrom, strand) as sub-features of their own kind."""
    strands = exons.select("gene_name", "strand").distinct()
    return infer_introns(exons).join(strands, "gene_name").select("gene_name", "chrom", "strand", F.lit("intron").alias("kind"), "start_pos", "end_pos")


def coding_map(segments: DataFrame) -> DataFrame:
    """``segments`` with segment (from 1 in reading order) and before, the coding bases of the segments read earlier.
    Segments without a base go. A transcript's segments, some hundred at most, are ranked together."""
    size = F.col("end_pos") - F.col("start_pos") + 1
    reads = F.when(F.col("strand") == "-", -F.col("end_pos")).otherwise(F.col("start_pos"))
    w = Window.partitionBy(*KEYS).orderBy(reads, "start_pos", "end_pos")
    rows = segments.select(*KEYS, "start_pos", "end_pos").filter("end_pos >= start_pos")
    earlier = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"segment": F.row_number().over(w), "before": earlier})


def _placed_sequences(mapped: DataFrame, chunks: DataFrame) -> DataFrame:
    """``mapped`` with seq. Segments of many transcripts in one place are read once."""
    place = ["chrom", "start_pos", "end_pos", "strand"]
    return mapped.join(materialize(interval_sequences(mapped.select(*place).distinct(), chunks)), place)


def _read(parts: DataFrame, seq: Column) -> DataFrame:
    """One row a transcript from its segments' sequences, each in reading direction: n_segments, complete, first (the
    segment read first), coding, and places, the segments' map. A segment that lies outside the reference has no bases."""
    whole = parts.groupBy(*KEYS).agg(
        F.count(F.lit(1)).cast("long").alias("n_segments"),
        (F.sum(F.col("end_pos") - F.col("start_pos") + 1) == F.coalesce(F.sum(F.length("seq")), F.lit(0))).alias("complete"),
        F.array_sort(F.collect_list(F.struct("segment", "before", "start_pos", "end_pos", F.coalesce(seq, F.lit("")).alias("seq")))).alias("s"),
    )
    places = F.transform("s", lambda x: F.struct(x["before"].alias("before"), x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos")))
    return whole.select(*KEYS, "n_segments", "complete", F.element_at("s", 1)["seq"].alias("first"), F.array_join("s.seq", "").alias("joined"), places.alias("places"))


def _placed(offset: Column) -> Column:
    """The position on the chromosome of a coding offset (from 0) by the row's places; null beyond the last."""
    inside = F.filter("places", lambda x: (offset >= x["before"]) & (offset <= x["before"] + x["end_pos"] - x["start_pos"]))
    hit = F.try_element_at(inside, F.lit(1))
    return F.when(F.col("strand") == "-", hit["end_pos"] - (offset - hit["before"])).otherwise(hit["start_pos"] + (offset - hit["before"]))


def _translated(read: DataFrame, starts: list[str], within: int, verify: bool) -> DataFrame:
    at = proteins.first_start(F.col("first"), starts, within)
    at = at if verify else F.coalesce(at, F.lit(0))
    rows = read.filter("joined <> ''").withColumn("start_at", at)
    coding = F.substr(F.col("joined"), F.col("start_at") + 1)
    every = bases.translate_codons(coding)
    stop = F.nullif(F.locate("*", every), F.lit(0))  # the codon, from 1, of the first stop
    rows = rows.withColumns({"coding": coding, "_every": every}).withColumn("_stop", stop)
    protein = F.when(F.col("_stop").isNotNull(), F.substr(F.col("_every"), F.lit(1), F.col("_stop") - 1)).otherwise(F.col("_every")) if verify else F.col("_every")
    end = F.col("start_at") + 3 * F.col("_stop") - 1  # the last base of the stop codon
    warning = F.when(F.col("start_at").isNull(), "no start codon").when(F.col("_stop").isNull(), "no stop codon")
    return rows.select(
        *KEYS, "n_segments", "complete", "start_at", _placed(F.col("start_at")).alias("translation_start"), _placed(end).alias("translation_end"),
        "coding", protein.alias("protein"), warning.alias("warning"), "places",
    )


def coding_sequences(segments: DataFrame, chunks: DataFrame, starts: list[str] = proteins.START_CODONS, within: int = 100, verify: bool = True) -> DataFrame:
    """(transcript, chrom, strand, n_segments, complete, start_at, translation_start, translation_end, coding, protein,
    warning, places), one row for each transcript with a base inside the reference.

    Translation begins at the first codon of ``starts`` in the first ``within`` bases of the segment that is read first,
    codons counted from its first base, and ends before the first stop; a codon with an unknown base is X. start_at is
    that codon's offset (from 0), translation_start and translation_end are the first base and the last base of the stop on
    the chromosome. Without a start a transcript has no coding sequence and no protein. If not ``verify``, it is then
    read from its first base, and stops are '*' and end nothing. ``complete`` is false where segments lie outside the
    reference: offsets then count the bases that are there. Segments of one transcript on several chromosomes or strands
    are several transcripts; null names are one transcript.
    """
    parts = interval_sequences(coding_map(segments), chunks)
    return _translated(_read(parts, F.col("seq")), starts, within, verify)


def codon_changes_of(variants: DataFrame, segments: DataFrame, chunks: DataFrame, starts: list[str] = proteins.START_CODONS, within: int = 100) -> DataFrame:
    """Substitutions of one base in the codon of each transcript that they lie in, frames carried over segment borders:
    transcript, chrom, strand, pos, ref, alt, codon_number (from 1 at the start codon), codon, changed, aa, new_aa, effect
    (silent, missense, nonsense, readthrough), conservative, notation (p.X12Y).

    Variants (chrom, pos, ref, alt) are those of the plus strand. Those before the start codon or behind the first stop,
    in transcripts without a start or with bases outside the reference, whose ref is not there or whose codon is not whole,
    have no row. Only transcripts that a variant lies in are read; a transcript's sequence is sent to its variants once, and
    a variant keeps only its codon.
    """
    mapped = materialize(coding_map(segments))
    tidy(segments.sparkSession)
    hits = point_join(variants.filter("length(ref) = 1 and length(alt) = 1 and ref <> alt"), mapped)
    minus = F.col("b_strand") == "-"
    offset = F.col("b_before") + F.when(minus, F.col("b_end_pos") - F.col("a_pos")).otherwise(F.col("a_pos") - F.col("b_start_pos"))
    own = lambda c: F.when(minus, bases.complement(F.col(c))).otherwise(F.col(c))
    asked = materialize(hits.select(*[F.col(f"b_{k}").alias(k) for k in KEYS], F.col("a_pos").alias("pos"), F.col("a_ref").alias("ref"), F.col("a_alt").alias("alt"), offset.alias("offset"), own("a_ref").alias("_ref"), own("a_alt").alias("_alt")))
    met = materialize(mapped.join(asked.select(*KEYS).distinct(), KEYS, "left_semi"))
    tidy(segments.sparkSession)
    read = _translated(_read(_placed_sequences(met, chunks), F.col("seq")), starts, within, True)
    # the stop codon itself is coding too; what lies behind it is not
    used = F.when(F.col("translation_end").isNull(), F.length("coding")).otherwise(3 * (F.length("protein") + 1))
    read = read.filter("complete and start_at is not null").select(*KEYS, "start_at", F.substr(F.col("coding"), F.lit(1), used.cast("int")).alias("coding"))
    at = (F.col("offset") - F.col("start_at")).cast("int")
    found = asked.join(read, KEYS).filter(at >= 0).select(*KEYS, "pos", "ref", "alt", "_ref", "_alt", at.alias("_at"), F.substr(F.col("coding"), at - at % 3 + 1, F.lit(3)).alias("codon"))
    place = F.col("_at") % 3
    found = found.filter((F.length("codon") == 3) & (F.substr(F.col("codon"), place + 1, F.lit(1)) == F.col("_ref")))
    changed = F.concat(F.substr(F.col("codon"), F.lit(1), place), F.col("_alt"), F.substr(F.col("codon"), place + 2))
    found = found.withColumn("changed", changed).withColumns({"aa": bases.translate_codons(F.col("codon")), "new_aa": bases.translate_codons(F.col("changed"))})
    number = (F.floor(F.col("_at") / 3) + 1).alias("codon_number")
    effect = proteins.effect(F.col("aa"), F.col("new_aa"))
    return found.select(*KEYS, "pos", "ref", "alt", number, "codon", "changed", "aa", "new_aa", effect.alias("effect"), proteins.conservative(F.col("aa"), F.col("new_aa")).alias("conservative"), F.concat(F.lit("p."), "aa", number.cast("string"), "new_aa").alias("notation"))


def protein_changes(segments: DataFrame, variants: DataFrame, chunks: DataFrame, starts: list[str] = proteins.START_CODONS, within: int = 100, verify: bool = True) -> DataFrame:
    """Each transcript's own protein beside the reference's: transcript, chrom, strand, n_applied, protein, personal,
    changes (position, reference, alternate, kind, notation), summary and identity.

    Variants of all lengths are put into the segments where they begin (``apply_variants``), so an insertion moves the
    frame of what follows. A transcript without a start on either side has an empty protein there. A variant over a
    segment's border has no ref there and is left out."""
    mapped = materialize(coding_map(segments).dropna(subset=KEYS))
    tidy(segments.sparkSession)
    place = ["chrom", "start_pos", "end_pos"]
    places = mapped.select(*place).distinct().withColumns({"strand": F.lit("+"), "seg_id": F.monotonically_increasing_id()})  # read and changed once for all transcripts
    parts = materialize(interval_sequences(materialize(places), chunks).drop("strand"))
    put = apply_variants(parts.filter("seq is not null and seq <> ''").select(F.col("seg_id").alias("seq_id"), "chrom", "start_pos", "seq"), variants)
    told = materialize(parts.join(put, parts["seg_id"] == put["seq_id"], "left").select(*place, "seq", "personal", "n_applied"))
    tidy(segments.sparkSession)
    turned = lambda c: F.coalesce(F.when(F.col("strand") == "-", bases.reverse_complement(F.col(c))).otherwise(F.col(c)), F.lit(""))
    one = F.struct("segment", turned("seq").alias("seq"), turned("personal").alias("personal"))
    both = mapped.join(told, place).groupBy(*KEYS).agg(F.coalesce(F.sum("n_applied"), F.lit(0)).cast("long").alias("n_applied"), F.array_sort(F.collect_list(one)).alias("s"))
    rows = both.select(*KEYS, "n_applied", *[c for x in ("seq", "personal") for c in (F.element_at("s", 1)[x].alias(f"_first_{x}"), F.array_join(f"s.{x}", "").alias(f"_joined_{x}"))])
    rows = rows.filter("_joined_seq <> '' or _joined_personal <> ''")
    for x in ("seq", "personal"):
        at = proteins.first_start(F.col(f"_first_{x}"), starts, within)
        rows = rows.withColumn("_every", bases.translate_codons(F.substr(F.col(f"_joined_{x}"), (at if verify else F.coalesce(at, F.lit(0))) + 1)))
        rows = rows.withColumn("_stop", F.nullif(F.locate("*", F.col("_every")), F.lit(0)))
        whole = F.when(F.col("_stop").isNotNull(), F.substr(F.col("_every"), F.lit(1), F.col("_stop") - 1)).otherwise(F.col("_every")) if verify else F.col("_every")
        rows = rows.withColumn(f"_own_{x}", F.coalesce(whole, F.lit("")))
    rows = rows.select(*KEYS, "n_applied", F.col("_own_seq").alias("protein"), F.col("_own_personal").alias("personal"))
    rows = rows.withColumn("changes", proteins.changes(F.col("protein"), F.col("personal")))
    return rows.select(*KEYS, "n_applied", "protein", "personal", "changes", F.array_join("changes.notation", ", ").alias("summary"), proteins.identity(F.col("protein"), F.col("personal")).alias("identity"))
