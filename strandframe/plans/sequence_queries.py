"""Queries over sequences: functions, k-mers, repeats, motifs, reference lookups, variants applied."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.functions import bases
from strandframe.operators import scans
from strandframe.operators import sequences as sq
from strandframe.operators import substrings
from strandframe.operators.storage import fresh_path
from strandframe.sources import readers, writers

from .registry import also, query

KMER = "SELECT seq_id, grp, p AS pos, substr(seq, CAST(p + 1 AS INT), {k}) AS kmer FROM (SELECT *, unnest(range(length(seq) - {k} + 1)) AS p FROM v_sequences)"


@query("fn_strands", "SELECT seq_id, md5(translate(seq, 'ATGC', 'TACG')) AS complement, md5(reverse(translate(seq, 'ATGC', 'TACG'))) AS reverse_complement, md5(translate(seq, 'AGCT', 'GATC')) AS transition, md5(translate(seq, 'ACGT', 'CATG')) AS transversion, md5(replace(seq, 'T', 'U')) AS rna FROM v_sequences")
def fn_strands(v):
    s = F.col("seq")
    f = {"complement": bases.complement, "reverse_complement": bases.reverse_complement, "transition": bases.transition, "transversion": bases.transversion, "rna": bases.to_rna}
    return v.sequences.select("seq_id", *[F.md5(g(s).cast("binary")).alias(k) for k, g in f.items()])


@query("fn_class_letters", "SELECT seq_id, md5(translate(seq, 'ATGC', 'WWSS')) AS sw, md5(translate(seq, 'AGCT', 'RRYY')) AS ry, md5(translate(seq, 'ACGT', 'MMKK')) AS mk FROM v_sequences")
def fn_class_letters(v):
    s = F.col("seq")
    return v.sequences.select("seq_id", F.md5(bases.strong_weak(s).cast("binary")).alias("sw"), F.md5(bases.purine_pyrimidine(s).cast("binary")).alias("ry"), F.md5(bases.amino_keto(s).cast("binary")).alias("mk"))


@query("fn_composition", """SELECT seq_id, length(seq) AS n, round((length(seq) - length(translate(seq, 'GC', ''))) / length(seq), 9) AS gc, round((length(seq) - length(translate(seq, 'AG', ''))) / length(seq), 9) AS ag,
(length(seq) - length(replace(seq, 'CG', ''))) // 2 AS cpg FROM v_sequences WHERE length(seq) > 0""")
def fn_composition(v):
    s = F.col("seq")
    return v.sequences.filter("length(seq) > 0").select("seq_id", F.length(s).cast("long").alias("n"), F.round(bases.gc_fraction(s), 9).alias("gc"), F.round(bases.fraction_of(s, "AG"), 9).alias("ag"), F.regexp_count(s, F.lit("CG")).cast("long").alias("cpg"))


@query("fn_entropy", """WITH c AS (SELECT seq_id, unnest(string_split(seq, '')) AS b FROM v_sequences WHERE length(seq) > 0), n AS (SELECT seq_id, b, count(*) AS n FROM c WHERE b <> '' GROUP BY 1, 2), t AS (SELECT seq_id, n, sum(n) OVER (PARTITION BY seq_id) AS s FROM n)
SELECT seq_id, abs(round(-sum(n / s * log2(n / s)), 7)) AS entropy FROM t GROUP BY seq_id""")
def fn_entropy(v):
    return v.sequences.filter("length(seq) > 0").select("seq_id", F.abs(F.round(bases.composition_entropy(F.col("seq")), 7)).alias("entropy"))


@query("fn_translate", """WITH c AS (SELECT seq_id, regexp_extract_all(seq, '.{3}') AS cs FROM v_sequences)
SELECT seq_id, md5(coalesce(list_aggregate(list_transform(cs, lambda c: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST((strpos('TCAG', c[1]) - 1) * 16 + (strpos('TCAG', c[2]) - 1) * 4 + strpos('TCAG', c[3]) AS INT), 1)), 'string_agg', ''), '')) AS protein, len(cs) AS n_codons FROM c""")
def fn_translate(v):
    protein = bases.translate_codons(F.col("seq"))
    return v.sequences.select("seq_id", F.md5(protein.cast("binary")).alias("protein"), F.size(bases.words(F.col("seq"), 3)).cast("long").alias("n_codons"))


@query("win_longest_run", "SELECT seq_id, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+'), lambda x: length(x))), 0) AS run_a, coalesce(list_max(list_transform(regexp_extract_all(seq, '[GC]+'), lambda x: length(x))), 0) AS run_gc FROM v_sequences")
def win_longest_run(v):
    s = F.col("seq")
    return v.sequences.select("seq_id", bases.longest_run(s, "A").cast("long").alias("run_a"), bases.longest_run(s, "GC").cast("long").alias("run_gc"))


@query("fn_canonical", """WITH t AS (SELECT DISTINCT piece FROM (SELECT unnest(regexp_extract_all(seq, '.{1,6}')) AS piece FROM v_sequences)),
b AS (SELECT piece, piece || piece AS d, reverse(translate(piece, 'ATGC', 'TACG')) || reverse(translate(piece, 'ATGC', 'TACG')) AS r FROM t)
SELECT piece, least(list_min(list_transform(range(1, length(piece) + 1), lambda i: substr(d, CAST(i AS INT), CAST(length(piece) AS INT)))), list_min(list_transform(range(1, length(piece) + 1), lambda i: substr(r, CAST(i AS INT), CAST(length(piece) AS INT))))) AS canonical FROM b""")
def fn_canonical(v):
    pieces = sq.tiles(v.sequences.select("seq"), 6).select("piece").distinct()
    return pieces.select("piece", bases.canonical(F.col("piece")).alias("canonical"))


@query("fn_index", "WITH t AS (SELECT DISTINCT piece FROM (SELECT unnest(regexp_extract_all(seq, '.{8}')) AS piece FROM v_sequences)) SELECT piece, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(translate(piece, 'ATGC', '0123'), ''), lambda x: CAST(x AS BIGINT))), lambda a, x: a * 4 + x) AS idx FROM t")
def fn_index(v):
    words = v.sequences.select(F.explode(bases.words(F.col("seq"), 8)).alias("piece")).distinct()
    return words.select("piece", bases.sequence_index(F.col("piece")).alias("idx"))


@query("seq_tiles_gc", """WITH t AS (SELECT seq_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS win FROM (SELECT seq_id, regexp_extract_all(seq, '.{1,100}') AS ps FROM v_sequences))
SELECT seq_id, win, length(piece) AS n, round((length(piece) - length(translate(piece, 'GC', ''))) / length(piece), 9) AS gc FROM t""")
def seq_tiles_gc(v):
    rows = sq.tiles(v.sequences.select("seq_id", "seq"), 100)
    return rows.select("seq_id", F.col("win").cast("long").alias("win"), F.length("piece").cast("long").alias("n"), F.round(bases.gc_fraction(F.col("piece")), 9).alias("gc"))


@query("agg_kmer_counts", f"SELECT grp, kmer, count(*) AS n FROM ({KMER.format(k=5)}) GROUP BY grp, kmer")
def agg_kmer_counts(v):
    return sq.kmer_counts(v.sequences, 5, ["grp"]).select("grp", "kmer", "n")


@query("agg_top_kmers", f"SELECT seq_id, kmer, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, kmer) AS r FROM (SELECT seq_id, kmer, count(*) AS n FROM ({KMER.format(k=4)}) GROUP BY 1, 2)) WHERE r <= 3")
def agg_top_kmers(v):
    return sq.top_kmers(v.sequences.select("seq_id", "seq"), 4)


@query("agg_universal_motifs", f"SELECT kmer, count(DISTINCT seq_id) AS n_seqs, count(*) AS n, round(count(DISTINCT seq_id) / (SELECT count(*) FROM v_sequences), 9) AS prevalence FROM ({KMER.format(k=6)}) GROUP BY kmer HAVING count(DISTINCT seq_id) >= 0.3 * (SELECT count(*) FROM v_sequences)")
def agg_universal_motifs(v):
    return sq.universal_motifs(v.sequences.select("seq_id", "seq"), 6, 0.3).withColumn("prevalence", F.round("prevalence", 9))


@query("agg_transitions", f"WITH k AS ({KMER.format(k=3)}) SELECT a.kmer, b.kmer AS follower, count(*) AS n FROM k a JOIN k b ON a.seq_id = b.seq_id AND b.pos = a.pos + 3 GROUP BY 1, 2")
def agg_transitions(v):
    return sq.transitions(v.sequences.select("seq_id", "seq"), 3, 3)


@query("agg_ngram_entropy", f"WITH c AS (SELECT seq_id, kmer, count(*) AS n FROM ({KMER.format(k=3)}) GROUP BY 1, 2) SELECT seq_id, abs(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6)) AS entropy FROM c GROUP BY seq_id")
def agg_ngram_entropy(v):
    return sq.ngram_entropy(v.sequences.select("seq_id", "seq"), 3).withColumn("entropy", F.abs(F.round("entropy", 6)))


@query("agg_distinct_words", f"SELECT seq_id, count(DISTINCT kmer) AS n_distinct, count(*) AS n_total FROM ({KMER.format(k=8)}) GROUP BY seq_id")
def agg_distinct_words(v):
    return sq.distinct_words(v.sequences.select("seq_id", "seq"), 8)


@query("src_fasta_chunks", """SELECT CAST(seq_id AS VARCHAR) AS name, CAST(c AS INT) AS chunk_id, CAST(c * 300 + 1 AS BIGINT) AS chunk_start, md5(substr(seq, CAST(c * 300 + 1 AS INT), 300)) AS seq
FROM (SELECT seq_id, upper(seq) AS seq, unnest(range((length(seq) + 299) // 300)) AS c FROM v_sequences)""")
def src_fasta_chunks(v):
    """All sequences written as FASTA and read again by byte ranges, in chunks of 300 bases."""
    path = fresh_path(v.spark)
    writers.write_fasta(v.sequences.select(F.col("seq_id").cast("string").alias("name"), "seq"), path)
    return readers.read_fasta(v.spark, path, 300).select("name", "chunk_id", "chunk_start", F.md5("seq").alias("seq"))


@query("agg_distinct_substrings")
def agg_distinct_substrings(v):
    return substrings.distinct_substrings(v.sequences)


@query("agg_substring_profile", " UNION ALL ".join(f"SELECT seq_id, CAST({k} AS BIGINT) AS length, count(DISTINCT kmer) AS n_distinct FROM ({KMER.format(k=k)}) GROUP BY seq_id" for k in range(1, 9)))
def agg_substring_profile(v):
    return substrings.substring_profile(v.sequences, 8)


HALVES = "SELECT seq_id, substr(seq, 1, length(seq) // 2) AS a, substr(seq, length(seq) // 2 + 1) AS b FROM v_sequences"
WORDS_OF = " UNION ".join("SELECT seq_id, substr({side}, CAST(p AS INT), %d) AS word FROM (SELECT *, unnest(range(1, length({side}) - %d + 2)) AS p FROM h)" % (k, k) for k in range(1, 9))


@query("agg_new_substrings", f"""WITH h AS ({HALVES}), n AS (SELECT seq_id, count(*) AS n FROM (({WORDS_OF.format(side="b")}) EXCEPT ({WORDS_OF.format(side="a")})) GROUP BY seq_id)
SELECT seq_id, coalesce(n, 0) AS n_distinct FROM h LEFT JOIN n USING (seq_id)""")
def agg_new_substrings(v):
    """Substrings of up to eight letters that a sequence's second half has and its first has not."""
    half = F.floor(F.length("seq") / 2).cast("int")
    halves = v.sequences.select("seq_id", F.substr("seq", F.lit(1), half).alias("a"), F.substr("seq", half + 1).alias("b"))
    return substrings.distinct_substrings(halves, 8, seq="b", beside="a")


@query("agg_base_profile", """WITH t AS (SELECT grp, unnest(ps) AS piece FROM (SELECT grp, regexp_extract_all(seq, '.{12}') AS ps FROM v_sequences)), b AS (SELECT grp, p, substr(piece, CAST(p + 1 AS INT), 1) AS base FROM (SELECT grp, piece, unnest(range(12)) AS p FROM t))
SELECT grp, p AS pos, base, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY grp, p), 9) AS share FROM b GROUP BY grp, p, base""")
def agg_base_profile(v):
    pieces = v.sequences.select("grp", F.explode(bases.words(F.col("seq"), 12)).alias("piece"))
    rows = pieces.select("grp", F.posexplode(F.regexp_extract_all("piece", F.lit("."), F.lit(0))).alias("pos", "base"))
    counts = rows.groupBy("grp", F.col("pos").cast("long").alias("pos"), "base").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("grp", "pos")), 9))


@query("agg_repeat_library", """WITH t AS (SELECT seq_id, unnest(regexp_extract_all(seq, '(?:AT){3,}|(?:GC){3,}|(?:AG){3,}|(?:CA){3,}')) AS m FROM v_sequences)
SELECT substr(m, 1, 2) AS unit, count(*) AS n, count(DISTINCT seq_id) AS n_seqs, max(length(m) // 2) AS most_copies FROM t GROUP BY 1""")
def agg_repeat_library(v):
    found = v.sequences.select("seq_id", F.explode(F.regexp_extract_all("seq", F.lit("(?:AT){3,}|(?:GC){3,}|(?:AG){3,}|(?:CA){3,}"), F.lit(0))).alias("m"))
    return found.groupBy(F.substring("m", 1, 2).alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq_id").alias("n_seqs"), F.floor(F.max(F.length("m")) / 2).alias("most_copies"))


@query("join_dyads", f"WITH k AS ({KMER.format(k=10)}) SELECT a.seq_id, a.pos, b.pos - a.pos - 10 AS loop, a.kmer AS stem FROM k a JOIN k b ON a.seq_id = b.seq_id AND a.kmer = reverse(translate(b.kmer, 'ATGC', 'TACG')) AND b.pos - a.pos - 10 BETWEEN 3 AND 20")
def join_dyads(v):
    return scans.dyads(v.sequences.select("seq_id", "seq"), 10, 3, 20).withColumn("pos", F.col("pos").cast("long")).withColumn("loop", F.col("loop").cast("long"))


@query("agg_stem_frequency", f"WITH k AS ({KMER.format(k=8)}) SELECT a.kmer AS stem, count(*) AS n FROM k a JOIN k b ON a.seq_id = b.seq_id AND a.kmer = reverse(translate(b.kmer, 'ATGC', 'TACG')) AND b.pos - a.pos - 8 BETWEEN 3 AND 10 GROUP BY 1")
def agg_stem_frequency(v):
    return scans.dyads(v.sequences.select("seq_id", "seq"), 8, 3, 10).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query("join_direct_repeats", f"WITH k AS ({KMER.format(k=12)}) SELECT a.seq_id, b.pos - a.pos AS shift, count(*) AS n FROM k a JOIN k b ON a.seq_id = b.seq_id AND a.kmer = b.kmer AND b.pos > a.pos AND b.pos - a.pos <= 60 GROUP BY 1, 2")
def join_direct_repeats(v):
    rows = scans.direct_repeats(v.sequences.select("seq_id", "seq"), 12, 60)
    return rows.groupBy("seq_id", F.col("shift").cast("long").alias("shift")).agg(F.count(F.lit(1)).alias("n"))


@query("srch_pwm", """WITH w AS (SELECT motif_id, pos, base, log2((cnt + 0.1) / (sum(cnt) OVER (PARTITION BY motif_id, pos) + 0.4) / 0.25) AS lo FROM v_pwm),
r AS (SELECT motif_id, max(pos) + 1 AS len, sum(lo_min) AS low, sum(lo_max) AS high FROM (SELECT motif_id, pos, min(lo) AS lo_min, max(lo) AS lo_max FROM w GROUP BY 1, 2) GROUP BY motif_id),
k AS (SELECT seq_id, p, motif_id, len, low, high, substr(seq, CAST(p + 1 AS INT), CAST(len AS INT)) AS kmer FROM (SELECT seq_id, seq, motif_id, len, low, high, unnest(range(length(seq) - len + 1)) AS p FROM v_sequences, r)),
s AS (SELECT seq_id, motif_id, p, len, kmer, low, high, (SELECT sum(lo) FROM w WHERE w.motif_id = k.motif_id AND substr(k.kmer, CAST(w.pos + 1 AS INT), 1) = w.base) AS raw FROM k)
SELECT seq_id, motif_id, p AS start, p + len AS "end", round((raw - low) / (high - low), 6) AS score, kmer FROM s WHERE (raw - low) / (high - low) >= 0.9""")
def srch_pwm(v):
    hits = scans.pwm_scan(v.sequences.select("seq_id", "seq"), v.pwm, 0.9)
    return hits.select("seq_id", "motif_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("score", 6).alias("score"), "kmer")


HIT_SQL = """SELECT seq_id, '{name}' AS name, list_sum(list_transform(gs[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS start, length(m) AS n, m AS match
FROM (SELECT seq_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i, ms, gs FROM (SELECT seq_id, regexp_extract_all(seq, '{p}') AS ms, string_split_regex(seq, '{p}') AS gs FROM v_sequences))"""


def _hits(v, patterns):
    hits = scans.regex_hits(v.sequences.select("seq_id", "seq"), patterns)
    return hits.select("seq_id", "name", F.col("start").cast("long").alias("start"), F.length("match").cast("long").alias("n"), "match")


@query("srch_literal", HIT_SQL.format(name="+", p="GATCAT") + " UNION ALL " + HIT_SQL.format(name="-", p="ATGATC"))
def srch_literal(v):
    return _hits(v, {"+": "GATCAT", "-": "ATGATC"})


@query("srch_iupac", HIT_SQL.format(name="TATAWR", p="TATA[AT][AG]"))
def srch_iupac(v):
    return _hits(v, {"TATAWR": bases.iupac_regex("TATAWR")})


PATTERNS = {"splice_donor": "GT[AG]AGT", "tata_box": "TATA[AT]A[AT]", "caat_box": "GGCCAATCT", "gc_box": "GGGCGG", "cpg": "(?:CG){3,}", "poly_a": "A{6,}", "kozak": "GCC[AG]CCATGG", "eco_ri": "GAATTC", "bam_hi": "GGATCC", "poly_a_signal": "AATAAA", "shine_dalgarno": "AGGAGG"}


@query("srch_pattern_library", " UNION ALL ".join(HIT_SQL.format(name=n, p=p) for n, p in PATTERNS.items()))
def srch_pattern_library(v):
    return _hits(v, PATTERNS)


@query("rel_consensus", "SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq, '.{6}')) AS piece FROM v_sequences) WHERE regexp_full_match(piece, '[AG]..[CT][AT][CG]') GROUP BY piece")
def rel_consensus(v):
    words = v.sequences.select(F.explode(bases.words(F.col("seq"), 6)).alias("piece"))
    return words.filter(F.col("piece").rlike("^" + bases.iupac_regex("RNNYWS") + "$")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


@query("join_interval_sequence", """WITH a AS (SELECT chrom, start_pos, end_pos, strand, id, score, name FROM v_features WHERE feature_type = 'gene'),
g AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_id) AS whole FROM v_ref_chunks GROUP BY chrom),
c AS (SELECT a.*, substr(whole, CAST(start_pos AS INT), CAST(end_pos - start_pos + 1 AS INT)) AS s FROM a JOIN g ON a.chrom = g.chrom)
SELECT chrom, start_pos, end_pos, name, CASE WHEN strand = '-' THEN reverse(translate(s, 'ATGC', 'TACG')) ELSE s END AS seq FROM c WHERE s <> ''""")
def join_interval_sequence(v):
    genes = v.features.filter("feature_type = 'gene'")
    return sq.interval_sequences(genes, v.ref_chunks).filter("seq is not null").select("chrom", "start_pos", "end_pos", "name", "seq")


@query("agg_quantity_map", """WITH t AS (SELECT chrom, chunk_start, unnest(range((chunk_start - 1) // 1024, (chunk_start + length(seq) - 2) // 1024 + 1)) AS win, seq FROM v_ref_chunks),
p AS (SELECT chrom, win, substr(seq, CAST(greatest(win * 1024 + 1, chunk_start) - chunk_start + 1 AS INT), CAST(least((win + 1) * 1024, chunk_start + length(seq) - 1) - greatest(win * 1024 + 1, chunk_start) + 1 AS INT)) AS s FROM t),
g AS (SELECT chrom, win, sum(length(s)) AS n_bases, round(sum(length(s) - length(translate(s, 'GC', ''))) / sum(length(s)), 9) AS gc FROM p GROUP BY 1, 2),
f AS (SELECT chrom, unnest(range((start_pos - 1) // 1024, (end_pos - 1) // 1024 + 1)) AS win, feature_type FROM v_features)
SELECT g.chrom, g.win, CAST(n_bases AS BIGINT) AS n_bases, gc, (SELECT count(*) FROM f WHERE f.chrom = g.chrom AND f.win = g.win AND feature_type = 'gene') AS genes, (SELECT count(*) FROM f WHERE f.chrom = g.chrom AND f.win = g.win AND feature_type = 'exon') AS exons FROM g""")
def agg_quantity_map(v):
    size = 1024
    shifted = v.ref_chunks.withColumn("chunk_start", F.col("chunk_start") - 1)  # windows are counted from the first base
    parts = sq.pieces(shifted, size).select("chrom", F.col("bin").alias("win"), F.col("piece").alias("s"))
    tracks = parts.groupBy("chrom", "win").agg(F.sum(F.length("s")).alias("n_bases"), F.round(F.sum(bases.count_of(F.col("s"), "GC")) / F.sum(F.length("s")), 9).alias("gc"))
    touched = v.features.withColumn("win", F.explode(F.sequence(F.floor((F.col("start_pos") - 1) / size), F.floor((F.col("end_pos") - 1) / size))))
    counts = touched.groupBy("chrom", "win").agg(F.count_if(F.col("feature_type") == "gene").alias("genes"), F.count_if(F.col("feature_type") == "exon").alias("exons"))
    return tracks.join(counts, ["chrom", "win"], "left").select("chrom", "win", "n_bases", "gc", F.coalesce("genes", F.lit(0)).alias("genes"), F.coalesce("exons", F.lit(0)).alias("exons"))


@query("seq_variant_context", """WITH g AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_id) AS whole FROM v_ref_chunks GROUP BY chrom)
SELECT v.chrom, v.pos, v.ref, v.alt, substr(whole, CAST(greatest(v.pos - 5, 1) AS INT), CAST(v.pos + 5 - greatest(v.pos - 5, 1) + 1 AS INT)) AS context FROM v_variants v JOIN g ON v.chrom = g.chrom WHERE v.pos - 5 <= length(whole)""")
def seq_variant_context(v):
    around = v.variants.select("chrom", "pos", "ref", "alt", (F.col("pos") - 5).alias("start_pos"), (F.col("pos") + 5).alias("end_pos"), F.lit("+").alias("strand"))
    return sq.interval_sequences(around, v.ref_chunks).filter("seq is not null").select("chrom", "pos", "ref", "alt", F.col("seq").alias("context"))


@query("seq_apply_variants", """WITH b AS (SELECT chunk_id, chrom, chunk_start + p AS pos, substr(seq, CAST(p + 1 AS INT), 1) AS c FROM (SELECT *, unnest(range(length(seq))) AS p FROM v_ref_chunks)),
x AS (SELECT b.*, v.alt FROM b LEFT JOIN v_variants v ON b.chrom = v.chrom AND b.pos = v.pos AND v.ref = b.c)
SELECT chunk_id AS seq_id, string_agg(coalesce(alt, c), '' ORDER BY pos) AS personal, CAST(coalesce(sum(length(alt) - 1), 0) AS INT) AS delta, CAST(count(alt) AS INT) AS n_applied FROM x GROUP BY chunk_id""")
def seq_apply_variants(v):
    regions = v.ref_chunks.select(F.col("chunk_id").alias("seq_id"), "chrom", F.col("chunk_start").alias("start_pos"), "seq")
    return sq.apply_variants(regions, v.variants)


@query("seq_orfs", """WITH k AS (SELECT seq_id, p AS pos, p % 3 AS frame, substr(seq, CAST(p + 1 AS INT), 3) AS c FROM (SELECT *, unnest(range(length(seq) - 2)) AS p FROM v_sequences)),
x AS (SELECT *, min(CASE WHEN c IN ('TAA', 'TAG', 'TGA') THEN pos END) OVER (PARTITION BY seq_id, frame ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM k WHERE c IN ('ATG', 'TAA', 'TAG', 'TGA'))
SELECT seq_id, frame, min(pos) AS start, stop FROM x WHERE c = 'ATG' AND stop IS NOT NULL GROUP BY seq_id, frame, stop HAVING stop - min(pos) >= 90""")
def seq_orfs(v):
    return scans.open_frames(v.sequences.select("seq_id", "seq"), 90)


@query("join_motif_graph", """WITH m AS (SELECT DISTINCT kmer AS m FROM (SELECT unnest(regexp_extract_all(seq, '.{5}')) AS kmer FROM v_sequences))
SELECT a.m AS a, b.m AS b FROM m a JOIN m b ON a.m < b.m AND levenshtein(a.m, b.m) = 1""")
def join_motif_graph(v):
    words = v.sequences.select(F.explode(bases.words(F.col("seq"), 5)).alias("motif"))
    return sq.motif_graph(words)


@query("fn_hamming", """WITH t AS (SELECT seq_id, unnest(ps) AS a, generate_subscripts(ps, 1) AS i, ps FROM (SELECT seq_id, regexp_extract_all(seq, '.{20}') AS ps FROM v_sequences)), p AS (SELECT seq_id, i, a, ps[i + 1] AS b FROM t WHERE i < len(ps))
SELECT seq_id, hamming(a, b) AS d, count(*) AS n FROM p GROUP BY 1, 2""")
def fn_hamming(v):
    words = bases.words(F.col("seq"), 20)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = v.sequences.filter("length(seq) >= 40").select("seq_id", F.inline(pairs))
    return rows.groupBy("seq_id", bases.hamming(F.col("a"), F.col("b")).cast("long").alias("d")).agg(F.count(F.lit(1)).alias("n"))


also("join_interval_sequence_whole", "join_interval_sequence")
also("join_motif_graph_whole", "join_motif_graph")
