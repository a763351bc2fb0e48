"""Queries over consensus strings, repeats of a unit, pairs and groups of sequences, and what lies in a window."""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from strandframe.functions import bases, motifs
from strandframe.operators import alignment, assembly, homology, pairs, scans
from strandframe.operators import sequences as sq
from strandframe.operators.intervals import overlap_join
from strandframe.operators.storage import discard, materialize, recorded, tidy

from .registry import query
from .window_queries import RC, WHOLE

LETTERS = "".join(bases.IUPAC)
CONSENSUS = f"c AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^{LETTERS}]', '', 'g') AS s FROM documents)"
INNER = "regexp_replace(s, '^N+|N+$', '', 'g')"
COUNT = "(length({s}) - length(replace({s}, '{c}', '')))"
ENTROPY = " + ".join(f"{COUNT.format(s='i', c=c)} * {math.log(len(of)) / len(of)!r}" for c, of in bases.IUPAC.items() if len(of) > 1)
LOGPROB = " - ".join(f"{COUNT.format(s='p', c=c)} * {math.log(4 - len(of))!r}" for c, of in bases.IUPAC.items() if len(of) < 3)


def _consensus(v):
    return v.table("documents").select("doc_id", F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), ascii_lowercase, ascii_uppercase), f"[^{LETTERS}]", "").alias("s"))


@query("fn_consensus_scores", f"""WITH {CONSENSUS}, i AS (SELECT doc_id, s, {INNER} AS i, replace(s, 'N', '') AS p FROM c)
SELECT doc_id, CASE WHEN length(s) < 1 THEN 1.0 ELSE round(({ENTROPY})::DOUBLE / length(s), 9) END::DOUBLE AS entropy, round((0 - {LOGPROB})::DOUBLE, 6) AS logprob, md5(translate(s, '{LETTERS}', '{''.join(motifs.MINIMAL[c] for c in LETTERS)}')) AS minimal FROM i""")
def fn_consensus_scores(v):
    rows = scans.consensus_scores(_consensus(v), "doc_id", "s")
    return rows.select("doc_id", F.round("entropy", 9).alias("entropy"), F.round("logprob", 6).alias("logprob"), "minimal")


@query("srch_repeat_score", """SELECT seq_id, round((len(regexp_extract_all(seq, 'GAT')) + 0.5 * (len(regexp_extract_all(seq, '.AT')) + len(regexp_extract_all(seq, 'G.T')) + len(regexp_extract_all(seq, 'GA.')))) / nullif(length(seq), 0), 9)::DOUBLE AS score FROM v_sequences""")
def srch_repeat_score(v):
    return v.sequences.select("seq_id", F.round(motifs.repeat_score(F.col("seq"), "GAT"), 9).alias("score"))


@query("srch_tandem_copies", """WITH m AS (SELECT seq_id, seq, p, substr(seq, CAST(p + 1 AS INT), 2) = 'TA' AS here FROM (SELECT *, unnest(range(length(seq))) AS p FROM v_sequences)),
t AS (SELECT seq_id, p, p - 2 * row_number() OVER (PARTITION BY seq_id, p % 2 ORDER BY p) AS isle FROM m WHERE here)
SELECT seq_id, min(p) AS start, max(p) + 2 AS "end", count(*)::DOUBLE AS copies FROM t GROUP BY seq_id, p % 2, isle HAVING count(*) >= 2""")
def srch_tandem_copies(v):
    hits = scans.regex_hits(v.sequences.select("seq_id", "seq"), {"unit": "(?:TA){2,}"})
    return hits.select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), ((F.col("end") - F.col("start")) / 2).cast("double").alias("copies"))


@query("srch_folded_copies", """WITH k AS (SELECT seq_id, p AS pos, substr(seq, CAST(p + 1 AS INT), 6) AS copy FROM (SELECT *, unnest(range(length(seq) - 6)) AS p FROM v_sequences WHERE length(seq) > 6)),
r AS (SELECT *, 6 - hamming(copy, 'GATTAC') AS matches FROM k) SELECT seq_id, pos, matches, copy FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY matches DESC, pos) AS r FROM r) WHERE r <= 5""")
def srch_folded_copies(v):
    """The number of copies is the feature: the five best places of each repeat."""
    return scans.folded_copies(v.sequences.select("seq_id", "seq"), "GATTAC", 5)


SYMBOLS = {"GATTACA": "A", "TATA": "B", "GAT": "C", "CCC": "D", "TA": "E"}


@query("seq_symbols", f"""SELECT seq_id, coalesce(list_aggregate(list_transform(regexp_extract_all(seq, 'GATTACA|TATA|GAT|CCC|TA|.'), lambda t: CASE {' '.join(f"WHEN t = '{m}' THEN '{s}'" for m, s in SYMBOLS.items())} ELSE '.' END), 'string_agg', ''), '') AS encoded FROM v_sequences""")
def seq_symbols(v):
    return v.sequences.select("seq_id", motifs.encode_symbols(F.col("seq"), SYMBOLS).alias("encoded"))


UNIT = "translate(name, '0123456789', 'ATGCATGCAT')"


def _with_motif(rows):
    return rows.withColumn("motif", F.translate("name", "0123456789", "ATGCATGCAT"))


UNIT_SQL = ", ".join(f"round(coalesce(sum((end_pos - start_pos) / length(motif)) FILTER (contains('{u * 2}', motif) OR contains('{(u * 2)[::-1].translate(str.maketrans('ATGC', 'TACG'))}', motif)), 0), 6)::DOUBLE AS units_{u.lower()}" for u in assembly.UNITS)


@query("agg_repeat_units", f"""WITH f AS (SELECT *, {UNIT} AS motif, unnest(range((start_pos - 1) // 16384, (end_pos - 1) // 16384 + 1)) AS win FROM v_features WHERE source = 'repeats'),
w AS (SELECT chrom, win, {UNIT_SQL}, count(*) FILTER ({' OR '.join(f"contains('{u * 2}', motif) OR contains('{(u * 2)[::-1].translate(str.maketrans('ATGC', 'TACG'))}', motif)" for u in assembly.UNITS)}) AS n FROM f WHERE length(motif) > 0 GROUP BY chrom, win)
SELECT * EXCLUDE (n) FROM w WHERE n > 0""")
def agg_repeat_units(v):
    names = [f"units_{u.lower()}" for u in assembly.UNITS]
    rows = assembly.quantity_windows(_with_motif(v.features.filter("source = 'repeats'")), 16384, names)
    return rows.select("chrom", "win", *[F.round(n, 6).alias(n) for n in names])


# Fixed value: the parts of names by which transposon hits are counted.
TE_NAMES = ["Alu", "AluJ", "AluY", "AluS", "L1", "L1HS", "L1PA", "L1P", "L1M", "L2", "LTR", "MIR", "SVA", "ALR", "MER"]


@query("te_all_name_counts", "SELECT " + ", ".join(f"count(*) FILTER (contains(name, '{x}')) AS {x.lower()}" for x in TE_NAMES) + " FROM v_te_names")
def te_all_name_counts(v):
    return v.te_names.agg(*[F.count_if(F.contains("name", F.lit(x))).alias(x.lower()) for x in TE_NAMES])


ALIGNED = "a AS (SELECT l_orderkey AS gene, l_linenumber AS line, l_partkey AS part, rpad(repeat('-', CAST(l_quantity AS INT) % 7) || repeat('A', CAST(l_quantity AS INT)), 60, '-') AS s FROM lineitem)"


@query("seq_trimmed_alignment", f"""WITH {ALIGNED}, c AS (SELECT gene, p, count(*) FILTER (substr(s, p, 1) <> '-') AS n FROM (SELECT *, unnest(range(1, 61)) AS p FROM a) GROUP BY gene, p),
e AS (SELECT gene, min(p) AS lo, max(p) AS hi FROM c WHERE n >= 2 GROUP BY gene) SELECT a.gene, a.line, a.part, coalesce(substr(s, lo, hi - lo + 1), '') AS trimmed FROM a LEFT JOIN e ON a.gene = e.gene""")
def seq_trimmed_alignment(v):
    n = F.col("l_quantity").cast("int")
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("gene"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.rpad(F.concat(F.repeat(F.lit("-"), n % 7), F.repeat(F.lit("A"), n)), 60, "-").alias("s"))
    return pairs.trimmed_alignment(rows, "gene", "s", 2).select("gene", "line", "part", "trimmed")


@query("agg_best_per_model", """WITH r AS (SELECT name, chrom, start_pos, end_pos, score, id, row_number() OVER (PARTITION BY name ORDER BY score DESC, name, chrom, start_pos, end_pos, score, id) AS r FROM v_features)
SELECT name, chrom, start_pos, end_pos, score, id FROM r WHERE r = 1 AND score >= 2000.0 * (end_pos - start_pos + 1)""")
def agg_best_per_model(v):
    hits = v.features.select("name", "chrom", "start_pos", "end_pos", "score", "id")
    return pairs.best_per_model(hits, "name", F.col("score"), F.col("end_pos") - F.col("start_pos") + 1, 2000.0)


@query("agg_containment_fold", f"""WITH w AS (SELECT {UNIT} AS w, count(*) AS n FROM v_features GROUP BY 1),
p AS (SELECT DISTINCT o.w AS outer_w, o.n AS outer_n, substr(o.w, i, k) AS w FROM w o, (SELECT unnest(range(1, 12)) AS k) x, (SELECT unnest(range(1, 12)) AS i) y WHERE k < length(o.w) AND i + k - 1 <= length(o.w)),
h AS (SELECT w, arg_min(outer_w, (-outer_n, outer_w)) AS host FROM p JOIN w USING (w) GROUP BY w)
SELECT coalesce(host, w.w) AS word, CAST(sum(n) AS BIGINT) AS n FROM w LEFT JOIN h ON w.w = h.w GROUP BY 1""")
def agg_containment_fold(v):
    counts = _with_motif(v.features.select("name")).groupBy(F.col("motif").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.contained_in_frequent(counts)


MODELS = "h AS (SELECT name, start_pos, end_pos, strand, start_pos % 20 AS start_hmm, start_pos % 20 + end_pos - start_pos AS end_hmm FROM v_features), m AS (SELECT name, max(end_hmm) + 1 AS model_length FROM h GROUP BY name), x AS (SELECT h.*, model_length, CASE WHEN strand = '-' THEN end_hmm ELSE start_hmm END AS f, CASE WHEN strand = '-' THEN start_hmm ELSE end_hmm END AS l FROM h JOIN m ON h.name = m.name)"


@query("srch_truncation", f"WITH {MODELS} SELECT name, start_pos, end_pos, strand, model_length, start_pos - f AS motif_start, end_pos + l AS motif_end, round(f / model_length, 9) AS truncated_5p, round(1 - l / model_length, 9) AS truncated_3p FROM x")
def srch_truncation(v):
    hits = v.features.select("name", "start_pos", "end_pos", "strand", (F.col("start_pos") % 20).alias("start_hmm"), (F.col("start_pos") % 20 + F.col("end_pos") - F.col("start_pos")).alias("end_hmm"))
    models = hits.groupBy("name").agg((F.max("end_hmm") + 1).alias("model_length"))
    out = assembly.truncation(hits, models).drop("start_hmm", "end_hmm")
    return out.withColumn("truncated_5p", F.round("truncated_5p", 9)).withColumn("truncated_3p", F.round("truncated_3p", 9))


@query("seq_attached_windows", f"""WITH {WHOLE}, w AS (SELECT chrom, unnest(range((length(whole) - 1) // 2048 + 1)) AS win, whole FROM g),
f AS (SELECT chrom, win, string_agg(id, ',' ORDER BY start_pos, end_pos, id) AS features FROM (SELECT *, unnest(range((start_pos - 1) // 2048, (end_pos - 1) // 2048 + 1)) AS win FROM v_features) GROUP BY 1, 2),
x AS (SELECT chrom, (pos - 1) // 2048 AS win, string_agg(pos || ref || '>' || alt, ',' ORDER BY pos, ref, alt) AS variants FROM v_variants GROUP BY 1, 2)
SELECT w.chrom, w.win, md5(substr(whole, w.win * 2048 + 1, 2048)) AS seq_md5, coalesce(features, '') AS features, coalesce(variants, '') AS variants FROM w LEFT JOIN f ON w.chrom = f.chrom AND w.win = f.win LEFT JOIN x ON w.chrom = x.chrom AND w.win = x.win""")
def seq_attached_windows(v):
    rows = assembly.attached_windows(v.ref_chunks, v.features.select("chrom", "start_pos", "end_pos", "id"), v.variants.select("chrom", "pos", "ref", "alt"), 2048)
    shown = F.transform("variants", lambda x: F.concat(x["pos"].cast("string"), x["ref"], F.lit(">"), x["alt"]))
    return rows.select("chrom", "win", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.array_join("features.id", ",").alias("features"), F.array_join(shown, ",").alias("variants"))


@query("seq_aligned_variants", """WITH b AS (SELECT chunk_id, chrom, chunk_start + p AS pos, substr(seq, CAST(p + 1 AS INT), 1) AS c FROM (SELECT *, unnest(range(length(seq))) AS p FROM v_ref_chunks)),
x AS (SELECT b.*, v.alt, v.alt IS NOT NULL AS hit FROM b LEFT JOIN v_variants v ON b.chrom = v.chrom AND b.pos = v.pos AND v.ref = b.c)
SELECT chunk_id, string_agg(CASE WHEN hit THEN rpad(c, CAST(length(alt) AS INT), '-') ELSE c END, '' ORDER BY pos) AS aligned_ref, string_agg(CASE WHEN hit THEN alt ELSE c END, '' ORDER BY pos) AS aligned_personal,
coalesce(string_agg(pos || ':' || (length(alt) - 1), ',' ORDER BY pos) FILTER (hit), '') AS moved FROM x GROUP BY chunk_id""")
def seq_aligned_variants(v):
    regions = v.ref_chunks.select(F.col("chunk_id").alias("seq_id"), "chrom", F.col("chunk_start").alias("start_pos"), "seq")
    rows = sq.aligned_variants(regions, v.variants.select("chrom", "pos", "ref", "alt"))
    shown = F.transform("moved", lambda m: F.concat_ws(":", m["pos"].cast("string"), m["delta"].cast("string")))
    return rows.select(F.col("seq_id").alias("chunk_id"), "aligned_ref", "aligned_personal", F.array_join(shown, ",").alias("moved"))


@query("sort_background_intervals", """WITH n AS (SELECT count(*) AS n FROM v_contigs), f AS (SELECT id, end_pos - start_pos AS span, ('0x' || substr(md5('c' || id), 1, 8))::BIGINT % n + 1 AS rank, ('0x' || substr(md5('p' || id), 1, 8))::BIGINT AS draw FROM v_features, n WHERE feature_type = 'gene')
SELECT f.id, c.chrom, 101 + draw % greatest(length - 200 - span, 1) AS start_pos, 101 + draw % greatest(length - 200 - span, 1) + span AS end_pos FROM f JOIN v_contigs c ON c.chrom_rank = f.rank""")
def sort_background_intervals(v):
    """One background interval for each gene, of its length."""
    return assembly.background_intervals(v.features.filter("feature_type = 'gene'"), v.contigs, 100)


@query("rel_gene_exons", "SELECT gene_name, chrom, exon_number, start_pos, end_pos FROM v_exons WHERE gene_name IN ('5', '6')")
def rel_gene_exons(v):
    rows = v.exons.withColumn("feature_type", F.lit("exon"))
    both = assembly.of_gene(rows, "5", "exon").unionByName(assembly.of_gene(rows, "6", "exon"))
    return both.select("gene_name", "chrom", "exon_number", "start_pos", "end_pos")


@query("agg_resampled", "SELECT chrom, (pos - 1) // 8192 AS bin_id, max(qual) AS top, count(*) AS n, round(avg(length(alt)), 9) AS mean_alt FROM v_variants GROUP BY 1, 2")
def agg_resampled(v):
    values = {"top": F.max("qual"), "n": F.count(F.lit(1)), "mean_alt": F.round(F.avg(F.length("alt")), 9)}
    return assembly.resampled(v.variants, ["chrom"], "pos", 8192, values)


@query("srch_repeats_in_context", f"""WITH {WHOLE}, r AS (SELECT id, chrom, start_pos, end_pos, strand, {UNIT} AS motif FROM v_features WHERE source = 'repeats' AND feature_type <> 'gene'),
h AS (SELECT r.id, r.start_pos, r.end_pos, r.strand, r.motif, r.chrom, gn.name AS gene FROM r JOIN v_features gn ON gn.feature_type = 'gene' AND gn.chrom = r.chrom AND gn.start_pos <= r.end_pos AND gn.end_pos >= r.start_pos),
s AS (SELECT h.*, substr(whole, greatest(start_pos - 128, 1), end_pos + 128 - greatest(start_pos - 128, 1) + 1) AS s FROM h JOIN g ON h.chrom = g.chrom)
SELECT id, gene, motif, round((end_pos - start_pos + 1) / length(motif), 6) AS copies, CASE WHEN strand = '-' THEN {RC.format(s='s')} ELSE s END AS context FROM s WHERE s <> ''""")
def srch_repeats_in_context(v):
    repeats = _with_motif(v.features.filter("source = 'repeats' AND feature_type <> 'gene'")).select("id", "chrom", "start_pos", "end_pos", "strand", "motif")
    genes = v.features.filter("feature_type = 'gene'").select("chrom", "start_pos", "end_pos", "name")
    kept = [F.col(f"a_{c}").alias(c) for c in ("id", "chrom", "start_pos", "end_pos", "strand", "motif")]
    hosted = overlap_join(repeats, genes).select(*kept, F.col("b_name").alias("gene"))
    rows = sq.interval_sequences(hosted, v.ref_chunks, 128, 128).filter("seq is not null and seq <> ''")
    return rows.select("id", "gene", "motif", F.round((F.col("end_pos") - F.col("start_pos") + 1) / F.length("motif"), 6).alias("copies"), F.col("seq").alias("context"))


def _genes_read(v, kind: str = "gene"):
    """Sequences of features, each distinct place and strand once."""
    rows = v.features.filter(F.col("feature_type") == kind).select("chrom", "start_pos", "end_pos", "strand").distinct()
    read = sq.interval_sequences(rows, v.ref_chunks).filter("seq is not null and seq <> ''")
    return read.select(F.concat_ws(":", "chrom", "start_pos", "end_pos", "strand").alias("place"), "seq")


GENES_SQL = f"{WHOLE}, d AS (SELECT DISTINCT chrom, start_pos, end_pos, strand FROM v_features WHERE feature_type = 'gene'), r AS (SELECT d.*, substr(whole, start_pos, end_pos - start_pos + 1) AS s FROM d JOIN g ON d.chrom = g.chrom), q AS (SELECT concat_ws(':', chrom, start_pos, end_pos, strand) AS place, CASE WHEN strand = '-' THEN {RC.format(s='s')} ELSE s END AS seq FROM r WHERE s <> '')"
GC_AT = "list_filter(range(length({s})), lambda i: substr({s}, CAST(i + 1 AS INT), 1) IN ('G', 'C'))"


@query("fn_strand_guide", f"""WITH {GENES_SQL}, t AS (SELECT place, seq, {RC.format(s='seq')} AS other FROM q), a AS (SELECT *, {GC_AT.format(s='seq')} AS x, {GC_AT.format(s='other')} AS y FROM t),
m AS (SELECT *, list_sum(x) / nullif(len(x), 0) AS mx, list_sum(y) / nullif(len(y), 0) AS my FROM a),
b AS (SELECT *, mx / length(seq) AS gx, my / length(seq) AS gy, sqrt(abs(list_sum(list_transform(x, lambda i: i * i)) - mx * mx)) / length(seq) AS sx, seq[1] IN ('A', 'T') AS wx, other[1] IN ('A', 'T') AS wy FROM m),
p AS (SELECT *, CASE WHEN wx OR wy THEN wx AND gx >= 0.5 ELSE gx >= 0.5 END AS f, CASE WHEN wx OR wy THEN wy AND gy >= 0.5 ELSE NOT (gx >= 0.5) AND gy >= 0.5 END AS r FROM b)
SELECT place, round(gx, 9) AS gc_mean, round(sx, 9) AS gc_sd, hamming(seq, other) AS n_unlike_mate, CASE WHEN f OR NOT r THEN gx - gy > 0 ELSE f END AS forward, CASE WHEN f OR NOT r THEN gx - gy <= 0 ELSE r END AS reverse FROM p""")
def fn_strand_guide(v):
    other = bases.reverse_complement(F.col("seq"))
    bias, guide = motifs.gc_bias(F.col("seq")), motifs.guide_choice(F.col("seq"), other)
    return _genes_read(v).select("place", F.round(bias["mean"], 9).alias("gc_mean"), F.round(bias["sd"], 9).alias("gc_sd"), bases.hamming(F.col("seq"), other).cast("long").alias("n_unlike_mate"), guide["forward"].alias("forward"), guide["reverse"].alias("reverse"))


def _numbered_genes(v):
    """seq_id and seq of genes, stored: they are read once, and what reading them has stored is let go."""
    with recorded() as paths:
        genes = materialize(_genes_read(v).select(F.xxhash64("place").alias("seq_id"), "seq"))
    discard(v.spark, paths[:-1])
    v.__dict__.pop("ref_chunks", None)
    tidy(v.spark)
    return genes


@query("join_sequence_pairs")
def join_sequence_pairs(v):
    """Genes whose sequences share a word of 16 bases, scored by alignment, best shift and longest run."""
    return pairs.score_pairs(pairs.shared_word_pairs(_numbered_genes(v), 16))


@query("srch_similar_clusters")
def srch_similar_clusters(v):
    """Genes with the first longer one whose alignment score is at least 0.8 of the longer length."""
    return pairs.similar_clusters(_numbered_genes(v), None, 0.8, greedy=True)


TEMPLATES = """t AS (SELECT s AS t, count(*) AS copies, min(seq_id) AS least FROM (SELECT seq_id * 100000 + i AS seq_id, substr(seq, CAST(i * 40 + 1 AS INT), 40) AS s FROM (SELECT *, unnest(range(length(seq) // 40)) AS i FROM v_sequences)) GROUP BY s)"""


@query("agg_template_groups", f"""WITH RECURSIVE {TEMPLATES}, h AS (SELECT least, t, i, substr(t, CAST(i * 8 + 1 AS INT), 8) AS part FROM t, (SELECT unnest(range(5)) AS i)),
e AS (SELECT DISTINCT x.least AS u, y.least AS v FROM h x JOIN h y ON x.i = y.i AND x.part = y.part AND x.least <> y.least WHERE hamming(x.t, y.t) <= 4),
w AS (SELECT u AS node, u AS seen FROM (SELECT DISTINCT u FROM e) UNION SELECT w.node, e.v FROM w JOIN e ON w.seen = e.u),
c AS (SELECT t.*, coalesce(k.c, least) AS centroid FROM t LEFT JOIN (SELECT node, min(seen) AS c FROM w GROUP BY node) k ON k.node = t.least),
m AS (SELECT centroid, p, bit_or(CASE substr(t, p, 1) WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END) AS mask FROM (SELECT centroid, t, unnest(range(1, 41)) AS p FROM c) GROUP BY 1, 2),
s AS (SELECT centroid, string_agg(substr('ACMGRSVTWYHKDBN', CAST(mask AS INT), 1), '' ORDER BY p) AS template FROM m GROUP BY centroid)
SELECT s.centroid, CAST(n AS BIGINT) AS n, template FROM s JOIN (SELECT centroid, sum(copies) AS n FROM c GROUP BY centroid) z ON z.centroid = s.centroid""")
def agg_template_groups(v):
    """Pieces of 40 bases of every sequence, grouped when within 4 mismatches."""
    pieces = v.sequences.select("seq_id", F.posexplode(bases.words(F.col("seq"), 40)).alias("i", "seq")).select((F.col("seq_id") * 100000 + F.col("i")).alias("seq_id"), "seq")
    return pairs.template_groups(pieces, 40)


@query("agg_template_centroids")
def agg_template_centroids(v):
    """The same pieces taken in order, each with those within 4 mismatches that have no group yet."""
    pieces = v.sequences.select("seq_id", F.posexplode(bases.words(F.col("seq"), 40)).alias("i", "seq")).select((F.col("seq_id") * 100000 + F.col("i")).alias("seq_id"), "seq")
    return pairs.template_groups(pieces, 40, greedy=True)


CLASS_SQL = "CASE WHEN x || y IN ('AG', 'GA') THEN 'R' WHEN x || y IN ('CT', 'TC') THEN 'Y' WHEN x || y IN ('CG', 'GC') THEN 'S' WHEN x || y IN ('AT', 'TA') THEN 'W' WHEN x || y IN ('GT', 'TG') THEN 'K' ELSE 'M' END"


@query("agg_aligned_spectrum", """WITH t AS (SELECT source, unnest(list_zip(ps[1:len(ps) - 1], ps[2:])) AS z FROM (SELECT source, regexp_extract_all(seq, '.{20}') AS ps FROM v_sequences)),
l AS (SELECT source, substr(z[1], i, 1) AS x, substr(z[2], i, 1) AS y FROM t, (SELECT unnest(range(1, 21)) AS i)), c AS (SELECT source, x || y AS change, count(*) AS n FROM l WHERE x <> y GROUP BY 1, 2)
SELECT source, change, n, round(n / sum(n) OVER (PARTITION BY source) - 1.0 / 12, 9) AS excess FROM c""")
def agg_aligned_spectrum(v):
    """Changes between words of 20 bases and the ones after them, laid on each other, by source."""
    last = F.floor(F.length("seq") / 20).cast("int") * 20 - 20  # words that have one after them, end to end, and the latter
    rows = v.sequences.filter("length(seq) >= 40").select("source", F.substr("seq", F.lit(1), last).alias("one"), F.substr("seq", F.lit(21), last).alias("two"))
    found = alignment.relative(alignment.spectrum(rows, "one", "two", ["source"]), ["source"], 12)
    return found.withColumn("excess", F.round("excess", 9))


@query("fn_strand_spectrum", f"""WITH {GENES_SQL}, l AS (SELECT place, substr(seq, i, 1) AS x, substr({RC.format(s='seq')}, i, 1) AS y FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM q))
SELECT place, {CLASS_SQL} AS change, count(*) AS n FROM l WHERE x <> y GROUP BY 1, 2""")
def fn_strand_spectrum(v):
    """Classes of change between each gene and its own other strand."""
    rows = _genes_read(v).withColumn("other", bases.reverse_complement(F.col("seq")))
    return alignment.spectrum(rows, "seq", "other", ["place"], by_class=True)


@query("join_aligned_pairs")
def join_aligned_pairs(v):
    """Genes that share a word of 16 bases, aligned, with both gapped strings."""
    return alignment.align_pairs(pairs.shared_word_pairs(_numbered_genes(v), 16))


KL = "sum(CASE WHEN {x} > 0 AND {y} > 0 THEN {x} * ln({x} / {y}) WHEN {x} > 0 OR {y} > 0 THEN 1.0 ELSE 0.0 END)"


@query("agg_profile_distances", f"""WITH t AS (SELECT source, unnest(regexp_extract_all(seq, '.{{12}}')) AS piece FROM v_sequences), n AS (SELECT source, p AS pos, substr(piece, CAST(p + 1 AS INT), 1) AS base, count(*) AS n FROM (SELECT source, piece, unnest(range(12)) AS p FROM t) GROUP BY 1, 2, 3),
z AS (SELECT d.source, d.pos, l.base, l.o, coalesce(n, 0) AS n FROM (SELECT DISTINCT source, pos FROM n) d, (SELECT unnest(['A', 'T', 'G', 'C']) AS base, unnest([1, 2, 3, 4]) AS o) l LEFT JOIN n ON n.source = d.source AND n.pos = d.pos AND n.base = l.base),
p AS (SELECT source, pos, base, n / sum(n) OVER (PARTITION BY source, pos) AS p, row_number() OVER (PARTITION BY source, pos ORDER BY n DESC, o) AS r FROM z),
b AS (SELECT x.source AS a, y.source AS b, x.p, y.p AS q, x.r AS i, y.r AS j FROM p x JOIN p y ON x.pos = y.pos AND x.base = y.base AND x.source < y.source)
SELECT a, b, count(*) FILTER ((p > 0) <> (q > 0)) / 2 AS alias, CAST(count(*) FILTER (i = 1 AND j <> 1) AS BIGINT) AS mode, round({KL.format(x='p', y='q')}, 9)::DOUBLE AS kl, round(({KL.format(x='p', y='((p + q) / 2)')} + {KL.format(x='q', y='((p + q) / 2)')}) / 2, 9)::DOUBLE AS js FROM b GROUP BY a, b""")
def agg_profile_distances(v):
    """Profiles of the twelve places of a word, by source, compared in pairs."""
    letters = v.sequences.select("source", F.explode(bases.words(F.col("seq"), 12)).alias("piece"))
    counts = [F.struct(F.lit(i).alias("pos"), F.substring("piece", i + 1, 1).alias("base")) for i in range(12)]
    sums = letters.select("source", F.inline(F.array(*counts))).groupBy(F.col("source").alias("name"), "pos").agg(*[F.count_if(F.col("base") == b).alias(b) for b in bases.BASES])
    out = homology.profile_distances(sums)
    return out.withColumn("kl", F.round("kl", 9)).withColumn("js", F.round("js", 9))


@query("fn_base_algebra", """WITH m AS (SELECT chrom, pos, CASE ref WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END AS a, (SELECT bit_or(CASE c WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END) FROM (SELECT unnest(string_split(alt, '')) AS c)) AS b FROM v_variants)
SELECT chrom, pos, substr('ACMGRSVTWYHKDBN', CAST(a | b AS INT), 1) AS either, nullif(substr('-ACMGRSVTWYHKDBN', CAST(a & b AS INT) + 1, 1), '-') AS shared, nullif(substr('-ACMGRSVTWYHKDBN', CAST(xor(a, b) AS INT) + 1, 1), '-') AS one_alone, CAST(bit_count(a | b) AS INT) AS n_bases FROM m""")
def fn_base_algebra(v):
    a = bases.base_mask(F.col("ref"))
    b = F.aggregate(F.split("alt", ""), F.lit(0), lambda s, c: s.bitwiseOR(bases.base_mask(c)))
    rows = v.variants.select("chrom", "pos", a.alias("a"), b.alias("b"))
    both = {"either": F.col("a").bitwiseOR(F.col("b")), "shared": F.col("a").bitwiseAND(F.col("b")), "one_alone": F.col("a").bitwiseXOR(F.col("b"))}
    return rows.select("chrom", "pos", *[bases.mask_code(m).alias(n) for n, m in both.items()], bases.multiplicity(both["either"]).alias("n_bases"))


@query("fn_index_back", """SELECT seq_id, i AS piece_id, piece, piece AS again FROM (SELECT seq_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS i FROM (SELECT seq_id, regexp_extract_all(seq, '.{20}') AS ps FROM v_sequences))""")
def fn_index_back(v):
    """Words of 20 bases to numbers and back."""
    words = v.sequences.select("seq_id", F.posexplode(bases.words(F.col("seq"), 20)).alias("piece_id", "piece"))
    return words.select("seq_id", F.col("piece_id").cast("long").alias("piece_id"), "piece", bases.index_sequence(bases.sequence_index(F.col("piece")), 20).alias("again"))


@query("srch_homology")
def srch_homology(v):
    """Places most like the bases that begin the first chunk; their number is the feature."""
    first = v.ref_chunks.filter("length(seq) >= 200").orderBy("chunk_id").select(F.substring("seq", 1, 200).alias("probe")).first()
    return homology.homology_search(v.ref_chunks, first["probe"] if first else "A" * 200, 1024, 20)
