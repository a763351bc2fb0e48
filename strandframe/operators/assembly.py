"""Windows of named quantities, transcripts put together from exons, and scans over chunks that lie end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import bases

from .scans import word_places
from .sequences import interval_sequences


@dataclass(frozen=True)
class Quantity:
    """A sum over the features that touch a window. ``value`` takes the bases that a feature and the window share and
    the window's length. Empty ``types`` or ``sources`` mean all of them; ``where`` asks for more of a feature."""

    value: Callable[[Column, int], Column]
    types: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    where: Callable[[], Column] | None = None

    def wants(self) -> Column:
        out = F.lit(True)
        if self.types:
            out = out & F.col("feature_type").isin(*self.types)
        if self.where:
            out = out & F.coalesce(self.where(), F.lit(False))
        return out & F.col("source").isin(*self.sources) if self.sources else out


def one(shared: Column, size: int) -> Column:
    return F.lit(1).cast("long")


def unit_count(unit: str) -> Quantity:
    """How often the motifs of features fit into them, of motifs that are a rotation of ``unit``, of its reverse complement,
    or a part of one."""
    other = unit[::-1].translate(str.maketrans(*bases.COMPLEMENT))

    def where() -> Column:
        motif = F.col("motif")
        return (F.length(motif) > 0) & (F.contains(F.lit(unit * 2), motif) | F.contains(F.lit(other * 2), motif))

    return Quantity(lambda shared, size: F.try_divide((F.col("end_pos") - F.col("start_pos")).cast("double"), F.length("motif")), where=where)


# Fixed value: the repeat units that are counted by name.
UNITS = ["TTCTT", "TATAAT", "TATATC", "TTGA", "AATTAAG", "ATGT", "GAGGAT", "CCCTGC"]
QUANTITIES = {
    "feats": Quantity(one),
    "genes": Quantity(one, ("gene",)),
    "exons": Quantity(one, ("exon",)),
    "repeats": Quantity(one, (), ("repeats",)),
    "motifs": Quantity(one, ("motif",)),
    "pseudogenes": Quantity(one, ("pseudogene",)),
    "lncrnas": Quantity(one, ("lncRNA",)),
    "ncrnas": Quantity(one, ("ncRNA",)),
    "mirnas": Quantity(one, ("miRNA",)),
    "nongenes": Quantity(one, ("lncRNA", "ncRNA", "pseudogene")),
    "simple_repeats": Quantity(one, ("repeat",), where=lambda: F.col("repeat_type") == "Simple_repeat"),
    **{f"units_{u.lower()}": unit_count(u) for u in UNITS},
    "cds_length": Quantity(lambda shared, size: shared, ("CDS",)),
    "cds_percent": Quantity(lambda shared, size: shared * 100.0 / size, ("CDS",)),
}


def quantity_windows(features: DataFrame, size: int, names: list[str], known: dict[str, Quantity] = QUANTITIES) -> DataFrame:
    """The named quantities of each window that a wanted feature touches, 0 where none counts: chrom, win, names.
    Only features that one of the names asks for are cut into windows; ``known`` may hold quantities of the caller's."""
    asked = [known[n] for n in names]
    any_ = F.lit(False)
    for q in asked:
        any_ = any_ | q.wants()
    win = F.explode(F.sequence(F.floor((F.col("start_pos") - 1) / size), F.floor((F.col("end_pos") - 1) / size)))
    rows = features.filter(any_ & (F.col("end_pos") >= F.col("start_pos"))).withColumn("win", win)
    shared = F.least("end_pos", (F.col("win") + 1) * size) - F.greatest("start_pos", F.col("win") * size + 1) + 1
    sums = [F.coalesce(F.sum(F.when(q.wants(), q.value(shared, size))), F.lit(0)).alias(n) for n, q in zip(names, asked)]
    return rows.groupBy("chrom", "win").agg(*sums)


def transcripts(exons: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exons (gene_name, chrom, strand, start_pos, end_pos) joined in reading order: n_exons, complete, cds, protein.

    ``complete`` is false where bases lie outside the reference; a gene with none inside goes. A gene's exons are one
    row, so a gene is bounded by what a row holds.
    """
    plus = exons.select("gene_name", "chrom", F.col("strand").alias("reads"), "start_pos", "end_pos", F.lit("+").alias("strand"))
    parts = interval_sequences(plus, chunks)
    whole = parts.groupBy("gene_name", "chrom", "reads").agg(
        F.count(F.lit(1)).alias("n_exons"),
        (F.sum(F.col("end_pos") - F.col("start_pos") + 1) == F.coalesce(F.sum(F.length("seq")), F.lit(0))).alias("complete"),
        F.array_join(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "seq")))["seq"], "").alias("joined"),
    )
    cds = F.when(F.col("reads") == "-", bases.reverse_complement(F.col("joined"))).otherwise(F.col("joined"))
    return whole.filter("joined <> ''").select("gene_name", "chrom", "n_exons", "complete", cds.alias("cds"), bases.translate_codons(cds).alias("protein"))


def chunked_hits(chunks: DataFrame, pattern: str, k: int) -> DataFrame:
    """Every start of a ``k``-letter word that matches a regular expression, once: chrom, pos (from 1), word.

    Chunks (chrom, chunk_start, seq) lie end to end; each is read with the k - 1 bases after it, so a hit over a border
    belongs to the chunk where it starts, however short the chunks after it are.
    """
    end = F.col("chunk_start") + F.length("seq") - 1
    tails = chunks.select("chrom", "chunk_start", F.col("seq").alias("body"), (end + 1).alias("start_pos"), (end + k - 1).alias("end_pos"), F.lit("+").alias("strand"))
    rows = interval_sequences(tails, chunks).withColumn("text", F.concat("body", F.coalesce("seq", F.lit(""))))
    found = word_places(rows.select(F.struct("chrom", "chunk_start").alias("at"), F.col("text").alias("seq")), pattern, k, "at")
    return found.select("at.chrom", (F.col("at.chunk_start") + F.col("pos")).alias("pos"), F.col("kmer").alias("word"))


def motif_around(features: DataFrame, chunks: DataFrame, pattern: str, k: int, flank: int) -> DataFrame:
    """Starts of a ``k``-letter pattern within ``flank`` bases of each feature, in its reading direction: ``relative``
    to its first base (from 0) and in_feature."""
    rows = interval_sequences(features, chunks, flank, flank).filter("seq is not null and seq <> ''")
    first = F.greatest(F.col("start_pos") - flank, F.lit(1))  # the reference begins at 1, so the window may begin late
    lead = F.when(F.col("strand") == "-", first + F.length("seq") - 1 - F.col("end_pos")).otherwise(F.col("start_pos") - first)
    found = word_places(rows.select(F.struct(*features.columns, lead.alias("lead")).alias("at"), "seq"), pattern, k, "at")
    hits = found.select("at.*", "pos", "kmer")
    relative = F.col("pos") - F.col("lead")
    return hits.select(*features.columns, relative.alias("relative"), F.col("kmer").alias("word"), relative.between(F.lit(0), F.col("end_pos") - F.col("start_pos")).alias("in_feature"))


def smoothed_grid(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Half of each cell and a quarter of each of its four neighbours; cells that lack a neighbour go. Cells are sent to
    their neighbours and summed, one shuffle."""
    moves = [(0, 0, 0.5), (1, 0, 0.25), (-1, 0, 0.25), (0, 1, 0.25), (0, -1, 0.25)]
    sent = F.array(*[F.struct((F.col(row) + i).alias("i"), (F.col(col) + j).alias("j"), (F.col(value) * w).alias("w")) for i, j, w in moves])
    sums = cells.select(F.inline(sent)).groupBy("i", "j").agg(F.sum("w").alias("smoothed"), F.count(F.lit(1)).alias("n")).filter("n = 5")
    return sums.select(F.col("i").alias(row), F.col("j").alias(col), "smoothed")


def attached_windows(chunks: DataFrame, features: DataFrame, variants: DataFrame, size: int) -> DataFrame:
    """Windows of ``size`` bases of the reference: chrom, win (from 0), seq, features (start_pos, end_pos, id) that touch it
    and variants (pos, ref, alt) in it, both sorted arrays, empty where there are none. A window's features are one row."""
    last = F.col("chunk_start") + F.length("seq") - 2
    wins = chunks.filter("length(seq) > 0").select("chrom", F.explode(F.sequence(F.floor((F.col("chunk_start") - 1) / size), F.floor(last / size))).alias("win")).distinct()
    asked = wins.select("chrom", "win", (F.col("win") * size + 1).alias("start_pos"), ((F.col("win") + 1) * size).alias("end_pos"), F.lit("+").alias("strand"))
    rows = interval_sequences(asked, chunks).select("chrom", "win", "seq")
    cut = F.explode(F.sequence(F.floor((F.col("start_pos") - 1) / size), F.floor((F.col("end_pos") - 1) / size))).alias("win")
    touch = features.filter("end_pos >= start_pos").select("chrom", cut, F.struct("start_pos", "end_pos", "id").alias("f")).groupBy("chrom", "win").agg(F.array_sort(F.collect_list("f")).alias("features"))
    inside = variants.select("chrom", F.floor((F.col("pos") - 1) / size).alias("win"), F.struct("pos", "ref", "alt").alias("x")).groupBy("chrom", "win").agg(F.array_sort(F.collect_list("x")).alias("variants"))
    out = rows.join(touch, ["chrom", "win"], "left").join(inside, ["chrom", "win"], "left")
    empty = {"features": "array<struct<start_pos:bigint,end_pos:bigint,id:string>>", "variants": "array<struct<pos:bigint,ref:string,alt:string>>"}
    return out.select("chrom", "win", "seq", *[F.coalesce(n, F.array().cast(t)).alias(n) for n, t in empty.items()])


def resampled(rows: DataFrame, keys: list[str], pos: str, size: int, values: dict[str, Column]) -> DataFrame:
    """``values``, aggregate columns of the caller's, over bins of ``size`` positions: keys, bin_id, values."""
    return rows.groupBy(*keys, F.floor((F.col(pos) - 1) / size).alias("bin_id")).agg(*[c.alias(n) for n, c in values.items()])


def drawn(key: Column, seed: str) -> Column:
    """A number below 2 ** 32 from a text and a seed; equal texts draw equal numbers, and a task run again does too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key).cast("binary")), 1, 8), 16, 10).cast("long")


def background_intervals(features: DataFrame, contigs: DataFrame, margin: int, seed: str = "", key: str = "id") -> DataFrame:
    """For each feature an interval of its length elsewhere: a chromosome by even chance, a start by even chance at least
    ``margin`` from its ends: key, chrom, start_pos, end_pos. Contigs (chrom, chrom_rank from 1, length); those that are too
    short take a start right behind the margin. Null keys go."""
    n = contigs.count()
    span = F.col("end_pos") - F.col("start_pos")
    picked = features.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), span.alias("span"), (F.pmod(drawn(F.col(key), seed + "c"), F.lit(max(n, 1))) + 1).alias("chrom_rank"), drawn(F.col(key), seed + "p").alias("draw"))
    held = picked.join(contigs.select("chrom", F.col("chrom_rank").cast("long").alias("chrom_rank"), "length"), "chrom_rank")
    start = 1 + margin + F.pmod("draw", F.greatest(F.col("length") - 2 * margin - F.col("span"), F.lit(1)))
    return held.select(F.col("_k").alias(key), "chrom", start.alias("start_pos"), (start + F.col("span")).alias("end_pos"))


def truncation(hits: DataFrame, models: DataFrame) -> DataFrame:
    """``hits`` (name, start_pos, end_pos, strand, start_hmm, end_hmm) of known models (name, model_length) with motif_start,
    motif_end, truncated_5p and truncated_3p, the shares of the model that lack; strand '-' swaps the model's ends."""
    minus = F.col("strand") == "-"
    first, last = F.when(minus, F.col("end_hmm")).otherwise(F.col("start_hmm")), F.when(minus, F.col("start_hmm")).otherwise(F.col("end_hmm"))
    return hits.join(models.select("name", "model_length"), "name").select(
        *hits.columns, "model_length", (F.col("start_pos") - first).alias("motif_start"), (F.col("end_pos") + last).alias("motif_end"),
        F.try_divide(first, F.col("model_length")).alias("truncated_5p"), (1 - F.try_divide(last, F.col("model_length"))).alias("truncated_3p"),
    )


def of_gene(features: DataFrame, gene: str, kind: str = "transcript", by: tuple[str, ...] = ("gene_name", "parent")) -> DataFrame:
    """Features of a kind that belong to a gene by any of the columns ``by`` that the table has."""
    belongs = F.lit(False)
    for column in by:
        if column in features.columns:
            belongs = belongs | F.coalesce(F.col(column) == gene, F.lit(False))
    return features.filter((F.col("feature_type") == kind) & belongs)
