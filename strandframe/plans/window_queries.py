"""Queries over windows, transcripts, chunk borders and shapes of sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import bases
from strandframe.operators import assembly, scans
from strandframe.operators import sequences as sq
from strandframe.operators.intervals import density, infer_introns
from strandframe.operators.storage import materialize

from .registry import query
from .sequence_queries import KMER

WHOLE = "g AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_id) AS whole FROM v_ref_chunks GROUP BY chrom)"
RC = "reverse(translate({s}, 'ATGC', 'TACG'))"


@query("agg_window_counts", """WITH f AS (SELECT *, unnest(range((start_pos - 1) // 1024, (end_pos - 1) // 1024 + 1)) AS win FROM v_features),
s AS (SELECT *, least(end_pos, (win + 1) * 1024) - greatest(start_pos, win * 1024 + 1) + 1 AS shared FROM f)
SELECT chrom, win, count(*) AS feats, count(*) FILTER (feature_type = 'gene') AS genes, count(*) FILTER (feature_type = 'exon') AS exons, count(*) FILTER (source = 'repeats') AS repeats,
CAST(coalesce(sum(shared) FILTER (feature_type = 'CDS'), 0) AS BIGINT) AS cds_length, round(coalesce(sum(shared) FILTER (feature_type = 'CDS'), 0) * 100.0 / 1024, 6)::DOUBLE AS cds_percent FROM s GROUP BY chrom, win""")
def agg_window_counts(v):
    names = ["feats", "genes", "exons", "repeats", "cds_length", "cds_percent"]
    return assembly.quantity_windows(v.features, 1024, names).withColumn("cds_percent", F.round(F.col("cds_percent").cast("double"), 6))


@query("seq_transcripts", f"""WITH {WHOLE}, e AS (SELECT x.*, substr(whole, start_pos, end_pos - start_pos + 1) AS s FROM v_exons x JOIN g ON x.chrom = g.chrom),
t AS (SELECT gene_name, chrom, strand, string_agg(s, '' ORDER BY start_pos) AS p, count(*) AS n_exons, sum(end_pos - start_pos + 1) = sum(length(s)) AS complete FROM e GROUP BY 1, 2, 3),
c AS (SELECT *, CASE WHEN strand = '-' THEN {RC.format(s='p')} ELSE p END AS cds FROM t WHERE p <> '')
SELECT gene_name, chrom, n_exons, complete, cds, coalesce(list_aggregate(list_transform(regexp_extract_all(cds, '.{{3}}'), lambda c: substr('{bases.CODE}', CAST((strpos('TCAG', c[1]) - 1) * 16 + (strpos('TCAG', c[2]) - 1) * 4 + strpos('TCAG', c[3]) AS INT), 1)), 'string_agg', ''), '') AS protein FROM c""")
def seq_transcripts(v):
    return assembly.transcripts(v.exons, v.ref_chunks)


@query("seq_subfeatures", f"""WITH {WHOLE}, i AS (SELECT gene_name, chrom, strand, lag(end_pos) OVER (PARTITION BY gene_name ORDER BY start_pos, end_pos) + 1 AS start_pos, start_pos - 1 AS end_pos FROM v_exons),
a AS (SELECT gene_name, chrom, strand, 'exon' AS kind, start_pos, end_pos FROM v_exons UNION ALL SELECT gene_name, chrom, strand, 'intron', start_pos, end_pos FROM i WHERE start_pos <= end_pos),
s AS (SELECT a.*, substr(whole, start_pos, end_pos - start_pos + 1) AS s FROM a JOIN g ON a.chrom = g.chrom)
SELECT gene_name, kind, start_pos, end_pos, CASE WHEN strand = '-' THEN {RC.format(s='s')} ELSE s END AS seq FROM s WHERE s <> ''""")
def seq_subfeatures(v):
    strands = v.exons.select("gene_name", "strand").distinct()
    introns = infer_introns(v.exons).join(strands, "gene_name").select("gene_name", "chrom", "strand", F.lit("intron").alias("kind"), "start_pos", "end_pos")
    rows = v.exons.select("gene_name", "chrom", "strand", F.lit("exon").alias("kind"), "start_pos", "end_pos").unionByName(introns)
    return sq.interval_sequences(rows, v.ref_chunks).filter("seq is not null").select("gene_name", "kind", "start_pos", "end_pos", "seq")


@query("rel_predicate_search", f"""WITH {WHOLE}, a AS (SELECT chrom, start_pos, end_pos, strand, id FROM v_features WHERE score > 20000 AND source = 'genes' AND end_pos - start_pos < 30),
s AS (SELECT a.*, substr(whole, greatest(start_pos - 5, 1), end_pos + 5 - greatest(start_pos - 5, 1) + 1) AS s FROM a LEFT JOIN g ON a.chrom = g.chrom)
SELECT chrom, start_pos, end_pos, id, CASE WHEN s = '' THEN NULL WHEN strand = '-' THEN {RC.format(s='s')} ELSE s END AS seq FROM s""")
def rel_predicate_search(v):
    wanted = (F.col("score") > 20000) & (F.col("source") == "genes") & (F.col("end_pos") - F.col("start_pos") < 30)
    return sq.interval_sequences(v.features.filter(wanted), v.ref_chunks, 5, 5).select("chrom", "start_pos", "end_pos", "id", "seq")


WORDS = f"""{WHOLE}, h AS (SELECT chrom, p + 1 AS pos, substr(whole, p + 1, 6) AS word FROM (SELECT *, unnest(range(length(whole) - 5)) AS p FROM g)),
w AS (SELECT * FROM h WHERE regexp_full_match(word, 'TATA[AT]A'))"""


@query("srch_chunked", f"WITH {WORDS} SELECT chrom, pos, word FROM w")
def srch_chunked(v):
    return assembly.chunked_hits(v.ref_chunks, bases.iupac_regex("TATAWA"), 6)


@query("set_features_and_hits", f"WITH {WORDS} SELECT chrom, start_pos, end_pos, feature_type, source FROM v_features UNION ALL SELECT chrom, pos, pos + 5, 'motif', word FROM w")
def set_features_and_hits(v):
    hits = assembly.chunked_hits(v.ref_chunks, bases.iupac_regex("TATAWA"), 6)
    hits = hits.select("chrom", F.col("pos").alias("start_pos"), (F.col("pos") + 5).alias("end_pos"), F.lit("motif").alias("feature_type"), F.col("word").alias("source"))
    return v.features.select("chrom", "start_pos", "end_pos", "feature_type", "source").unionByName(hits)


@query("srch_motif_around", f"""WITH {WHOLE}, f AS (SELECT chrom, start_pos, end_pos, strand, id, greatest(start_pos - 50, 1) AS first FROM v_features WHERE feature_type = 'gene'),
s AS (SELECT f.*, substr(whole, first, end_pos + 50 - first + 1) AS s FROM f JOIN g ON f.chrom = g.chrom),
r AS (SELECT *, CASE WHEN strand = '-' THEN {RC.format(s='s')} ELSE s END AS t, CASE WHEN strand = '-' THEN first + length(s) - 1 - end_pos ELSE start_pos - first END AS lead FROM s WHERE s <> ''),
h AS (SELECT *, unnest(range(length(t) - 3)) AS p FROM r)
SELECT id, p - lead AS relative, substr(t, p + 1, 4) AS word, p - lead BETWEEN 0 AND end_pos - start_pos AS in_feature FROM h WHERE regexp_full_match(substr(t, p + 1, 4), '[AG]AT[CT]')""")
def srch_motif_around(v):
    genes = v.features.filter("feature_type = 'gene'").select("chrom", "start_pos", "end_pos", "strand", "id")
    return assembly.motif_around(genes, v.ref_chunks, bases.iupac_regex("RATY"), 4, 50).select("id", F.col("relative").cast("long").alias("relative"), "word", "in_feature")


@query("win_grid_smooth", """WITH g AS (SELECT chrom_rank AS i, unnest(range((length - 1) // 16384 + 1)) AS j, chrom FROM v_contigs), f AS (SELECT chrom, unnest(range((start_pos - 1) // 16384, (end_pos - 1) // 16384 + 1)) AS j FROM v_features),
n AS (SELECT i, j, (SELECT count(*) FROM f WHERE f.chrom = g.chrom AND f.j = g.j) AS n FROM g)
SELECT a.i AS chrom_rank, a.j AS win, CAST(0.5 * a.n + 0.25 * (b.n + c.n + d.n + e.n) AS DOUBLE) AS smoothed FROM n a JOIN n b ON b.i = a.i - 1 AND b.j = a.j JOIN n c ON c.i = a.i + 1 AND c.j = a.j JOIN n d ON d.i = a.i AND d.j = a.j - 1 JOIN n e ON e.i = a.i AND e.j = a.j + 1""")
def win_grid_smooth(v):
    cells = density(v.features, v.contigs, 16384).join(F.broadcast(v.contigs.select("chrom", "chrom_rank")), "chrom")  # one row a chromosome
    return assembly.smoothed_grid(cells, "chrom_rank", "win", "n")


@query("agg_gap_spectrum", """WITH p AS (SELECT rpad(ref, CAST(greatest(length(ref), length(alt)) AS INT), '-') AS a, rpad(alt, CAST(greatest(length(ref), length(alt)) AS INT), '-') AS b FROM v_variants),
x AS (SELECT a, b, unnest(range(1, length(a) + 1)) AS k FROM p), l AS (SELECT substr(a, k, 1) AS a, substr(b, k, 1) AS b FROM x)
SELECT 'alt' AS side, b AS base, count(*) AS n FROM l WHERE a = '-' GROUP BY b UNION ALL SELECT 'ref', a, count(*) FROM l WHERE b = '-' GROUP BY a""")
def agg_gap_spectrum(v):
    """Bases of one side that stand opposite a gap of the other, alleles aligned at their first base."""
    wide = F.greatest(F.length("ref"), F.length("alt"))
    pairs = v.variants.select(F.rpad("ref", wide, F.lit("-")).alias("a"), F.rpad("alt", wide, F.lit("-")).alias("b"))
    letters = pairs.select(F.inline(F.arrays_zip(F.split("a", "").alias("a"), F.split("b", "").alias("b"))))
    gaps = letters.filter("(a = '-') <> (b = '-')").select(F.when(F.col("a") == "-", "alt").otherwise("ref").alias("side"), F.when(F.col("a") == "-", F.col("b")).otherwise(F.col("a")).alias("base"))
    return gaps.groupBy("side", "base").agg(F.count(F.lit(1)).alias("n"))


@query("fn_places", f"SELECT seq_id, count(*) AS n, count(*) FILTER (pos % 3 = 0) AS n_in_frame, min(pos) AS first FROM ({KMER.format(k=3)}) WHERE kmer = 'ATG' GROUP BY seq_id")
def fn_places(v):
    return scans.literal_places(v.sequences.select("seq_id", "seq"), "ATG")


@query("fn_shapes", """SELECT seq_id, md5(substr(seq, 4) || substr(seq, 1, 3)) AS rotated, CASE WHEN length(seq) < 40 THEN rpad(seq, 40, 'N') ELSE seq END = seq AS long_enough,
substr(repeat(seq, 40), 1, 40) AS tiled, substr(seq, greatest((length(seq) - 20) // 2, 0) + 1, 20) AS centre, translate(seq, 'ATGC', '0123')[1:20] AS vocabulary FROM v_sequences""")
def fn_shapes(v):
    seq = F.col("seq")
    return v.sequences.select(
        "seq_id", F.md5(bases.rotate(seq, 3).cast("binary")).alias("rotated"), (bases.pad(seq, 40) == seq).alias("long_enough"), bases.tile(seq, 40).alias("tiled"),
        bases.crop_centre(seq, 20).alias("centre"), F.substring(bases.convert(seq, bases.BASES, "0123"), 1, 20).alias("vocabulary"),
    )


@query("agg_mutual_information", f"""WITH n AS (SELECT grp, kmer[1] AS a, kmer[2] AS b, count(*) AS n FROM ({KMER.format(k=2)}) GROUP BY 1, 2, 3),
p AS (SELECT grp, n / sum(n) OVER (PARTITION BY grp) AS p, sum(n) OVER (PARTITION BY grp, a) / sum(n) OVER (PARTITION BY grp) AS pa, sum(n) OVER (PARTITION BY grp, b) / sum(n) OVER (PARTITION BY grp) AS pb FROM n)
SELECT grp, round(sum(p * log2(p / (pa * pb))), 9) AS bits FROM p GROUP BY grp""")
def agg_mutual_information(v):
    pairs = sq.kmer_counts(v.sequences, 2, ["grp"]).select("grp", F.substring("kmer", 1, 1).alias("a"), F.substring("kmer", 2, 1).alias("b"), "n")
    pairs = materialize(pairs)  # a few rows, met four times
    a, b = pairs.groupBy("grp", "a").agg(F.sum("n").alias("na")), pairs.groupBy("grp", "b").agg(F.sum("n").alias("nb"))
    rows = pairs.join(a, ["grp", "a"]).join(b, ["grp", "b"]).join(pairs.groupBy("grp").agg(F.sum("n").alias("all")), "grp")
    return rows.groupBy("grp").agg(F.round(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))), 9).alias("bits"))


@query("agg_repeat_phase", """WITH b AS (SELECT seq_id, substr(seq, p + 1, 1) AS c, p FROM (SELECT *, unnest(range(length(seq))) AS p FROM v_sequences)),
m AS (SELECT seq_id, o, count(*) FILTER (c = substr('ATC', (p + o) % 3 + 1, 1)) AS matches FROM b, (SELECT unnest(range(3)) AS o) GROUP BY 1, 2)
SELECT seq_id, o AS phase, matches FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY matches DESC, o) AS r FROM m) WHERE r = 1""")
def agg_repeat_phase(v):
    return scans.unit_phases(v.sequences.select("seq_id", "seq"), "ATC")


@query("sort_first_features", "SELECT chrom, start_pos, end_pos, feature_type, id FROM v_features WHERE strand = '-' ORDER BY start_pos, chrom, end_pos, feature_type, id LIMIT 100")
def sort_first_features(v):
    """The limit is the feature: the first hundred of a strand, taken from each partition's own first hundred."""
    return v.features.filter("strand = '-'").orderBy("start_pos", "chrom", "end_pos", "feature_type", "id").select("chrom", "start_pos", "end_pos", "feature_type", "id").limit(100)


SLOTS = {"family": 1, "number": 2, "rest": 3}
NAME = "^([A-Za-z]*)([0-9]*)(.*)$"


@query("te_slot_values", " UNION ALL ".join(f"SELECT '{slot}' AS slot, regexp_extract(name, '{NAME}', {k}) AS value, count(*) AS n FROM v_te_names GROUP BY 2" for slot, k in SLOTS.items()))
def te_slot_values(v):
    """Distinct values of each part of a name, with how often each occurs; one pass for all parts."""
    parts = F.array(*[F.struct(F.lit(slot).alias("slot"), F.regexp_extract("name", NAME, k).alias("value")) for slot, k in SLOTS.items()])
    return v.te_names.select(F.inline(parts)).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
