"""Queries over runs, fuzzy matches, profiles, flanks and protein changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.functions import bases
from strandframe.functions.classes import pseudogene_acronym, rna_subclass
from strandframe.operators import scans
from strandframe.operators import sequences as sq

from .registry import query
from .sequence_queries import HIT_SQL, KMER


def _seqs(v):
    return v.sequences.select("seq_id", "seq")


@query("srch_tandem", """WITH b AS (SELECT seq_id, p, substr(seq, CAST(p + 1 AS INT), 1) AS c, substr(seq, CAST(p + 4 AS INT), 1) AS d FROM (SELECT *, unnest(range(length(seq))) AS p FROM v_sequences)),
s AS (SELECT seq_id, p, p - row_number() OVER (PARTITION BY seq_id ORDER BY p) AS isle FROM b WHERE c = d)
SELECT seq_id, min(p) AS start, count(*) AS length FROM s GROUP BY seq_id, isle HAVING count(*) >= 6""")
def srch_tandem(v):
    return scans.shift_runs(_seqs(v), 3, 6).select("seq_id", F.col("start").cast("long").alias("start"), "length")


@query("srch_fuzzy", f"SELECT seq_id, pos AS start, hamming(kmer, 'GATTACAGATTA') AS mismatches FROM ({KMER.format(k=12)}) WHERE hamming(kmer, 'GATTACAGATTA') <= 3")
def srch_fuzzy(v):
    return scans.fuzzy_hits(_seqs(v), "GATTACAGATTA", 3).select("seq_id", F.col("start").cast("long").alias("start"), F.col("mismatches").cast("long").alias("mismatches"))


@query("win_hit_runs", f"""WITH h AS (SELECT seq_id, start, start + n AS e FROM ({HIT_SQL.format(name='at', p='ATAT')})), l AS (SELECT *, lag(e) OVER (PARTITION BY seq_id ORDER BY start) AS prev FROM h),
r AS (SELECT *, sum(CASE WHEN prev IS NULL OR start - prev > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT seq_id, count(*) AS n, CAST(min(start) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM r GROUP BY seq_id, run HAVING count(*) >= 2""")
def win_hit_runs(v):
    hits = scans.regex_hits(_seqs(v), {"at": "ATAT"}).select("seq_id", "start", "end")
    return sq.hit_runs(hits, 10).filter("n >= 2").select("seq_id", "n", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("agg_pwm_information", """WITH t AS (SELECT source, unnest(regexp_extract_all(seq, '.{12}')) AS piece FROM v_sequences), m AS (SELECT source AS motif_id, k AS pos, substr(piece, CAST(k + 1 AS INT), 1) AS base, count(*) AS cnt FROM (SELECT source, piece, unnest(range(12)) AS k FROM t) GROUP BY 1, 2, 3),
p AS (SELECT motif_id, pos, base, (cnt + 0.1::DOUBLE) / (sum(cnt) OVER (PARTITION BY motif_id, pos) + 0.4::DOUBLE) AS p FROM m)
SELECT motif_id, pos, round(2 + sum(p * log2(p)), 8) AS information, arg_max(base, (p, -ascii(base))) AS base FROM p GROUP BY motif_id, pos""")
def agg_pwm_information(v):
    """Matrices of the twelve places of a word, by source."""
    words = v.sequences.select("source", F.explode(bases.words(F.col("seq"), 12)).alias("piece"))
    places = F.array(*[F.struct(F.lit(i).alias("pos"), F.substring("piece", i + 1, 1).alias("base")) for i in range(12)])
    counts = words.select(F.col("source").alias("motif_id"), F.inline(places)).groupBy("motif_id", "pos", "base").agg(F.count(F.lit(1)).alias("cnt"))
    return sq.pwm_information(counts).withColumn("information", F.round("information", 8))


@query("seq_codon_changes", """WITH h AS (SELECT x.chrom, x.pos, x.alt, c.seq, x.pos - c.chunk_start AS place FROM v_variants x JOIN v_ref_chunks c ON x.chrom = c.chrom AND x.pos BETWEEN c.chunk_start AND c.chunk_start + length(c.seq) - 1 WHERE length(ref) = 1 AND length(alt) = 1),
k AS (SELECT chrom, pos, alt, place % 3 AS o, substr(seq, CAST(place - place % 3 + 1 AS INT), 3) AS codon FROM h),
m AS (SELECT *, substr(codon, 1, CAST(o AS INT)) || alt || substr(codon, CAST(o + 2 AS INT), 3) AS changed FROM k WHERE length(codon) = 3),
t AS (SELECT *, substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST((strpos('TCAG', codon[1]) - 1) * 16 + (strpos('TCAG', codon[2]) - 1) * 4 + strpos('TCAG', codon[3]) AS INT), 1) AS aa,
 substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST((strpos('TCAG', changed[1]) - 1) * 16 + (strpos('TCAG', changed[2]) - 1) * 4 + strpos('TCAG', changed[3]) AS INT), 1) AS new_aa FROM m)
SELECT chrom, pos, alt, codon, changed, aa, new_aa, CASE WHEN aa = new_aa THEN 'silent' WHEN new_aa = '*' THEN 'nonsense' WHEN aa = '*' THEN 'readthrough' ELSE 'missense' END AS effect FROM t""")
def seq_codon_changes(v):
    return sq.codon_changes(v.variants, v.ref_chunks)


@query("seq_ml_windows", """WITH g AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_id) AS whole FROM v_ref_chunks GROUP BY chrom),
s AS (SELECT x.chrom, x.pos, substr(whole, CAST(greatest(x.pos - 8, 1) AS INT), CAST(x.pos + 8 - greatest(x.pos - 8, 1) + 1 AS INT)) AS s FROM v_variants x JOIN g ON x.chrom = g.chrom WHERE x.pos - 8 <= length(whole))
SELECT chrom, pos, translate(rpad(s, 20, 'N'), 'ATGCN', '01234') AS codes, round((length(s) - length(translate(s, 'GC', ''))) / length(s), 9) AS gc FROM s""")
def seq_ml_windows(v):
    around = v.variants.select("chrom", "pos", (F.col("pos") - 8).alias("start_pos"), (F.col("pos") + 8).alias("end_pos"), F.lit("+").alias("strand"))
    rows = sq.interval_sequences(around, v.ref_chunks).filter("seq is not null")
    codes = F.array_join(F.slice(bases.one_hot(F.rpad("seq", 20, "N")), 1, 20).cast("array<string>"), "")
    return rows.select("chrom", "pos", codes.alias("codes"), F.round(bases.gc_fraction(F.col("seq")), 9).alias("gc"))


@query("srch_motif_downstream", """WITH g AS (SELECT chrom, string_agg(seq, '' ORDER BY chunk_id) AS whole FROM v_ref_chunks GROUP BY chrom),
f AS (SELECT DISTINCT chrom, end_pos FROM v_features WHERE feature_type = 'gene'),
d AS (SELECT f.chrom, f.end_pos, substr(whole, CAST(f.end_pos + 1 AS INT), 100) AS s FROM f JOIN g ON f.chrom = g.chrom)
SELECT chrom, end_pos, strpos(s, 'AATA') AS distance FROM d WHERE s <> '' AND strpos(s, 'AATA') > 0""")
def srch_motif_downstream(v):
    ends = v.features.filter("feature_type = 'gene'").select("chrom", "end_pos").distinct()
    flank = ends.select("chrom", F.col("end_pos").alias("gene_end"), (F.col("end_pos") + 1).alias("start_pos"), (F.col("end_pos") + 100).alias("end_pos"), F.lit("+").alias("strand"))
    rows = sq.interval_sequences(flank, v.ref_chunks).filter("seq is not null").withColumn("distance", F.instr("seq", F.lit("AATA")).cast("long"))
    return rows.filter("distance > 0").select("chrom", F.col("gene_end").alias("end_pos"), "distance")


@query("agg_gc_scan", """WITH t AS (SELECT seq_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS win FROM (SELECT seq_id, regexp_extract_all(seq, '.{1,50}') AS ps FROM v_sequences)),
w AS (SELECT seq_id, win, piece || lead(piece) OVER (PARTITION BY seq_id ORDER BY win) AS s FROM t)
SELECT seq_id, win * 50 AS start, round((length(s) - length(translate(s, 'GC', ''))) / length(s), 9) AS gc FROM w WHERE length(s) = 100""")
def agg_gc_scan(v):
    rows = sq.tiles(_seqs(v), 50)
    two = rows.withColumn("s", F.concat("piece", F.lead("piece").over(Window.partitionBy("seq_id").orderBy("win")))).filter("length(s) = 100")
    return two.select("seq_id", (F.col("win") * 50).cast("long").alias("start"), F.round(bases.gc_fraction(F.col("s")), 9).alias("gc"))


@query("agg_divergence", """WITH c AS (SELECT grp, unnest(string_split(seq, '')) AS b FROM v_sequences), n AS (SELECT grp, b, count(*) AS n FROM c WHERE b <> '' GROUP BY 1, 2),
p AS (SELECT grp, b, n / sum(n) OVER (PARTITION BY grp) AS p FROM n), q AS (SELECT b, sum(n) / (SELECT sum(n) FROM n) AS q FROM n GROUP BY b)
SELECT grp, round(sum(p * log2(p / q)), 9) AS kl, round(sum((p - q) * log2(p / q)), 9) AS symmetric_kl FROM p JOIN q USING (b) GROUP BY grp""")
def agg_divergence(v):
    sums = v.sequences.groupBy("grp").agg(*[F.sum(bases.count_of(F.col("seq"), b)).alias(b) for b in bases.BASES])
    long_ = sums.select("grp", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.col(b).alias("n")) for b in bases.BASES])).alias("x")).select("grp", "x.*").filter("n > 0")
    p = long_.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))
    q = long_.groupBy("b").agg(F.sum("n").alias("m")).withColumn("q", F.col("m") / F.sum("m").over(Window.partitionBy()))
    ratio = F.log2(F.col("p") / F.col("q"))
    return p.join(F.broadcast(q), "b").groupBy("grp").agg(F.round(F.sum(F.col("p") * ratio), 9).alias("kl"), F.round(F.sum((F.col("p") - F.col("q")) * ratio), 9).alias("symmetric_kl"))


@query("agg_consensus", """WITH t AS (SELECT grp, unnest(regexp_extract_all(seq, '.{12}')) AS piece FROM v_sequences), b AS (SELECT grp, p AS pos, substr(piece, CAST(p + 1 AS INT), 1) AS base FROM (SELECT grp, piece, unnest(range(12)) AS p FROM t)),
c AS (SELECT grp, pos, base, count(*) AS n, sum(count(*)) OVER (PARTITION BY grp, pos) AS s FROM b GROUP BY 1, 2, 3)
SELECT grp, pos, substr('ACMGRSVTWYHKDBN', CAST(bit_or(CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END) AS INT), 1) AS code FROM c WHERE n >= 0.25 * s GROUP BY grp, pos""")
def agg_consensus(v):
    pieces = v.sequences.select("grp", F.explode(bases.words(F.col("seq"), 12)).alias("piece"))
    rows = pieces.select("grp", F.posexplode(F.regexp_extract_all("piece", F.lit("."), F.lit(0))).alias("pos", "base"))
    counts = rows.groupBy("grp", F.col("pos").cast("long").alias("pos"), "base").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.withColumn("s", F.sum("n").over(Window.partitionBy("grp", "pos"))).filter("n >= 0.25 * s")
    return kept.groupBy("grp", "pos").agg(bases.mask_code(F.bit_or(bases.base_mask(F.col("base")))).alias("code"))


@query("win_resample", """WITH t AS (SELECT chrom, (pos - 1) // 4096 AS b, avg(qual) AS x FROM v_variants GROUP BY 1, 2), r AS (SELECT chrom, x, row_number() OVER (PARTITION BY chrom ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM t),
g AS (SELECT chrom, k, k * (n - 1) / 7.0 AS at FROM (SELECT DISTINCT chrom, n FROM r), (SELECT unnest(range(8)) AS k))
SELECT g.chrom, g.k, round(a.x + (b.x - a.x) * (g.at - floor(g.at)), 6) AS value FROM g JOIN r a ON a.chrom = g.chrom AND a.i = floor(g.at) JOIN r b ON b.chrom = g.chrom AND b.i = ceil(g.at)""")
def win_resample(v):
    w = Window.partitionBy("chrom")
    track = v.variants.groupBy("chrom", F.floor((F.col("pos") - 1) / 4096).alias("b")).agg(F.avg("qual").alias("x"))
    r = track.withColumn("i", (F.row_number().over(w.orderBy("b")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("y", F.coalesce(F.lead("x").over(w.orderBy("b")), "x"))
    grid = r.select("chrom", "n").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).withColumn("at", F.col("k") * (F.col("n") - 1) / F.lit(7.0)).withColumn("i", F.floor("at"))
    return grid.drop("n").join(r.select("chrom", "i", "x", "y"), ["chrom", "i"]).select("chrom", "k", F.round(F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.col("i")), 6).alias("value"))


@query("seq_differences", """WITH p AS (SELECT c.chrom, x.pos, x.ref, substr(x.alt, 1, 1) AS alt, substr(c.seq, CAST(x.pos - c.chunk_start + 1 AS INT), 1) AS base FROM v_variants x JOIN v_ref_chunks c ON x.chrom = c.chrom AND x.pos BETWEEN c.chunk_start AND c.chunk_start + length(c.seq) - 1)
SELECT chrom, pos, base, alt, base = ref AS as_expected FROM p WHERE base <> alt""")
def seq_differences(v):
    at = v.variants.select("chrom", "pos", "ref", F.substring("alt", 1, 1).alias("alt"), F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"), F.lit("+").alias("strand"))
    rows = sq.interval_sequences(at, v.ref_chunks).filter("seq is not null and seq <> alt")
    return rows.select("chrom", "pos", F.col("seq").alias("base"), "alt", (F.col("seq") == F.col("ref")).alias("as_expected"))


@query("agg_frequency_rank", """WITH w AS (SELECT grp, kmer, count(*) AS n FROM (SELECT grp, unnest(regexp_extract_all(seq, '.{4}')) AS kmer FROM v_sequences) GROUP BY 1, 2), c AS (SELECT grp, least(kmer, reverse(translate(kmer, 'ATGC', 'TACG'))) AS word, sum(n) AS n FROM w GROUP BY 1, 2)
SELECT grp, word, CAST(n AS BIGINT) AS n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, word) AS r FROM c) WHERE r <= 10""")
def agg_frequency_rank(v):
    words = v.sequences.select("grp", F.explode(bases.words(F.col("seq"), 4)).alias("kmer"))
    counts = words.groupBy("grp", F.least("kmer", bases.reverse_complement(F.col("kmer"))).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("n").desc(), "word"))).filter("rank <= 10")


RNA_NAMES = """SELECT p_partkey AS gene_id, CASE p_partkey % 5 WHEN 0 THEN 'snRNA' WHEN 1 THEN 'lncRNA' WHEN 2 THEN 'snoRNA' WHEN 3 THEN 'miRNA' ELSE 'rRNA' END AS biotype,
concat(CASE p_partkey % 5 WHEN 0 THEN 'RNU' WHEN 1 THEN 'LINC' WHEN 2 THEN 'SNORD' WHEN 3 THEN 'MIR' ELSE 'RNA5SP' END, CAST(p_size AS STRING)) AS name FROM part"""
BIOTYPES = """SELECT p_partkey AS gene_id, concat(CASE p_size % 3 WHEN 0 THEN 'transcribed_' WHEN 1 THEN 'translated_' ELSE '' END,
CASE p_partkey % 4 WHEN 0 THEN 'processed' WHEN 1 THEN 'unprocessed' WHEN 2 THEN 'unitary' ELSE 'IG_V' END, '_pseudogene') AS biotype FROM part"""


@query("agg_rna_subclasses", f"""WITH r AS ({RNA_NAMES}), c AS (SELECT biotype, CASE biotype
WHEN 'snRNA' THEN CASE WHEN regexp_matches(name, '^RNU([12467]|5[A-F])-?([0-9]+)') THEN 'RNU' WHEN regexp_matches(name, '^U[12467]') THEN 'U' END
WHEN 'lncRNA' THEN CASE WHEN regexp_matches(name, '^TTTY[0-9]') THEN 'TTTY' WHEN regexp_matches(name, '^[A-Z0-9]+[PL][0-9]') THEN 'gene + LP{{n}}' WHEN regexp_matches(name, '^LINC[0-9]+') THEN 'long intergenic noncoding' END
WHEN 'snoRNA' THEN CASE WHEN regexp_matches(name, '^SNOR[AD][0-9]') THEN 'SNO' END WHEN 'miRNA' THEN CASE WHEN regexp_matches(name, '^MIR[0-9]+') THEN 'MIR' END
ELSE CASE WHEN regexp_matches(name, '^RNA5SP[0-9][0-9]+') THEN 'RNA5SP{{n}}' WHEN regexp_matches(name, '^RNA5S[0-9]+') THEN 'RNA5S{{n}}' END END AS subclass FROM r)
SELECT biotype, subclass, count(*) AS n FROM c GROUP BY biotype, subclass""")
def agg_rna_subclasses(v):
    rows = v.spark.sql(RNA_NAMES.replace("FROM part", "FROM {part}"), part=v.table("part"))
    return rows.groupBy("biotype", rna_subclass(F.col("biotype"), F.col("name")).alias("subclass")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_pseudogene_classes", f"""WITH r AS ({BIOTYPES}) SELECT concat_ws('_', CASE WHEN contains(biotype, 'transcribed') THEN 'TC' WHEN contains(biotype, 'translated') THEN 'TL' END,
CASE WHEN contains(biotype, 'unprocessed') THEN 'UP' WHEN contains(biotype, 'processed') THEN 'P' WHEN contains(biotype, 'unitary') THEN 'U' WHEN contains(biotype, 'IG') THEN 'IG' END, CASE WHEN contains(biotype, 'V') THEN 'V' END) AS class, count(*) AS n FROM r GROUP BY 1""")
def agg_pseudogene_classes(v):
    rows = v.spark.sql(BIOTYPES.replace("FROM part", "FROM {part}"), part=v.table("part"))
    return rows.groupBy(pseudogene_acronym(F.col("biotype")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# how many letters two strings of a length share from their first on
SHARED = "coalesce(nullif(list_position(list_transform(list_zip(string_split({a}, ''), string_split({b}, '')), lambda z: z[1] <> z[2]), true), 0) - 1, {n})"
DYADS_SQL = f"""k AS ({KMER.format(k=10)}), f AS (SELECT a.seq_id, 2 * a.pos + 20 + b.pos - a.pos - 10 AS c, min(a.pos) AS s FROM k a JOIN k b ON a.seq_id = b.seq_id AND a.kmer = reverse(translate(b.kmer, 'ATGC', 'TACG')) AND b.pos - a.pos - 10 BETWEEN 3 AND 20 GROUP BY 1, 2),
h AS (SELECT f.*, seq, least(s, length(seq) - (c - s)) AS n, (c - 2 * s - 23) // 2 AS m FROM f JOIN v_sequences v ON v.seq_id = f.seq_id),
d AS (SELECT seq_id, c, s - {SHARED.format(a='reverse(substr(seq, CAST(s - n + 1 AS INT), CAST(n AS INT)))', b="translate(substr(seq, CAST(c - s + 1 AS INT), CAST(n AS INT)), 'ATGC', 'TACG')", n='n')} AS s,
  s + 10 + {SHARED.format(a='substr(seq, CAST(s + 11 AS INT), CAST(m AS INT))', b="reverse(translate(substr(seq, CAST(c - s - 10 - m + 1 AS INT), CAST(m AS INT)), 'ATGC', 'TACG'))", n='m')} AS x FROM h)"""
DYAD_ROW = 'CAST(s AS BIGINT) AS start, CAST(c - s AS BIGINT) AS "end", CAST(x - s AS BIGINT) AS arm, CAST(c - 2 * x AS BIGINT) AS loop'


@query("srch_dyads_expanded", f"WITH {DYADS_SQL} SELECT seq_id, {DYAD_ROW} FROM d")
def srch_dyads_expanded(v):
    return scans.expanded_dyads(_seqs(v), 10, 3, 20)


@query("srch_dyads_maximal", f"WITH {DYADS_SQL} SELECT seq_id, {DYAD_ROW} FROM d WHERE NOT EXISTS (SELECT 1 FROM d w WHERE w.seq_id = d.seq_id AND w.c <> d.c AND w.s <= d.s AND w.c - w.s >= d.c - d.s)")
def srch_dyads_maximal(v):
    """Grown dyads that lie within no other one."""
    return scans.expanded_dyads(_seqs(v), 10, 3, 20, nested=False)


@query("srch_long_repeats")
def srch_long_repeats(v):
    return scans.long_repeats(_seqs(v), 60)


@query("srch_pwm_both")
def srch_pwm_both(v):
    return scans.pwm_scan(_seqs(v), v.pwm, 0.9, both_strands=True)
