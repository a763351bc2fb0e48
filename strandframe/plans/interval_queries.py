"""Queries over intervals: filters, joins, islands, neighbours, densities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.operators.coding import cds_features
from strandframe.operators import intervals as iv
from strandframe.operators.ordered import running

from .registry import query

COLS = "chrom, start_pos, end_pos, feature_type, source, name"


@query("rel_region", f"SELECT {COLS} FROM v_features WHERE chrom = '3' AND start_pos <= 90000 AND end_pos >= 20000")
def rel_region(v):
    return iv.region(v.features, "3", 20000, 90000).selectExpr(*COLS.split(", "))


@query("rel_region_open", f"SELECT {COLS} FROM v_features WHERE chrom = '7' AND end_pos >= 1000")
def rel_region_open(v):
    return iv.region(v.features, "7", 1000).selectExpr(*COLS.split(", "))


@query("rel_point", "SELECT DISTINCT chrom, start_pos, end_pos, feature_type FROM v_features WHERE chrom = '5' AND 40020 BETWEEN start_pos AND end_pos AND feature_type <> 'CDS'")
def rel_point(v):
    return iv.at_point(v.features, "5", 40020, exclude=["CDS"]).select("chrom", "start_pos", "end_pos", "feature_type")


@query("rel_types_sources", f"SELECT {COLS} FROM v_features WHERE feature_type IN ('gene', 'CDS') AND source IN ('genes')")
def rel_types_sources(v):
    return v.features.filter(F.col("feature_type").isin("gene", "CDS") & F.col("source").isin("genes")).selectExpr(*COLS.split(", "))


@query("rel_attribute_browse", f"SELECT {COLS} FROM v_features WHERE feature_type = 'exon' AND end_pos - start_pos BETWEEN 10 AND 20 AND contains(name, '17')")
def rel_attribute_browse(v):
    length = F.col("end_pos") - F.col("start_pos")
    return v.features.filter((F.col("feature_type") == "exon") & length.between(10, 20) & F.contains("name", F.lit("17"))).selectExpr(*COLS.split(", "))


@query("rel_free_text", f"SELECT {COLS} FROM v_features WHERE contains(lower(concat_ws(' ', chrom, feature_type, source, strand, name, id)), 'cds') AND contains(lower(concat_ws(' ', chrom, feature_type, source, strand, name, id)), '99')")
def rel_free_text(v):
    every = F.lower(F.concat_ws(" ", *[c for c, t in v.features.dtypes if t == "string"]))
    return v.features.withColumn("_t", F.lower(F.concat_ws(" ", "chrom", "feature_type", "source", "strand", "name", "id"))).filter(F.contains("_t", F.lit("cds")) & F.contains(every, F.lit("99"))).selectExpr(*COLS.split(", "))


@query("rel_quality", "SELECT chrom, pos, ref, alt, qual FROM v_variants WHERE qual >= 50")
def rel_quality(v):
    return v.variants.filter("qual >= 50").select("chrom", "pos", "ref", "alt", "qual")


@query("rel_distinct_names", "SELECT DISTINCT name, chrom FROM v_features WHERE feature_type = 'gene'")
def rel_distinct_names(v):
    return v.features.filter("feature_type = 'gene'").select("name", "chrom").distinct()


@query("rel_window_coordinates", """SELECT chrom, start_pos, end_pos, CASE WHEN end_pos < 5000 OR start_pos > 9999 THEN -1 ELSE greatest(start_pos - 5000, 0) END AS win_from,
  CASE WHEN end_pos < 5000 OR start_pos > 9999 THEN -1 ELSE least(end_pos - 5000, 4999) END AS win_to FROM v_features""")
def rel_window_coordinates(v):
    outside = (F.col("end_pos") < 5000) | (F.col("start_pos") > 9999)
    left, right = F.greatest(F.col("start_pos") - 5000, F.lit(0)), F.least(F.col("end_pos") - 5000, F.lit(4999))
    return v.features.select("chrom", "start_pos", "end_pos", F.when(outside, -1).otherwise(left).alias("win_from"), F.when(outside, -1).otherwise(right).alias("win_to"))


@query("rel_cds", f"SELECT {COLS} FROM v_features WHERE feature_type = 'CDS' UNION ALL SELECT chrom, start_pos + 1, end_pos - 1, 'CDS', source, name FROM v_features WHERE feature_type = 'gene' AND end_pos - start_pos > 30")
def rel_cds(v):
    """CDS rows, and those made for genes of more than 30 bases, whose coding part begins and ends one base within."""
    long_ = F.col("end_pos") - F.col("start_pos") > 30
    kind = F.when(F.col("feature_type") == "gene", "transcript").otherwise(F.col("feature_type"))
    rows = v.features.withColumns({"feature_type": kind, "cds_start": F.when(long_, F.col("start_pos") + 1), "cds_end": F.when(long_, F.col("end_pos") - 1)})
    return cds_features(rows).withColumn("name", F.coalesce("name", "parent")).selectExpr(*COLS.split(", "))


@query("join_overlap", """SELECT a.chrom, a.start_pos AS gene_start, a.end_pos AS gene_end, a.name AS gene, b.start_pos, b.end_pos, b.name
FROM v_features a JOIN v_features b ON a.chrom = b.chrom AND a.start_pos <= b.end_pos AND a.end_pos >= b.start_pos
WHERE a.feature_type = 'gene' AND b.feature_type = 'CDS'""")
def join_overlap(v):
    genes, cds = v.features.filter("feature_type = 'gene'"), v.features.filter("feature_type = 'CDS'")
    return iv.overlap_join(genes, cds).selectExpr("a_chrom as chrom", "a_start_pos as gene_start", "a_end_pos as gene_end", "a_name as gene", "b_start_pos as start_pos", "b_end_pos as end_pos", "b_name as name")


@query("join_overlap_left", """SELECT a.chrom, a.start_pos, a.end_pos, a.name, count(b.chrom) AS n FROM v_features a
LEFT JOIN v_features b ON a.chrom = b.chrom AND a.start_pos <= b.end_pos AND a.end_pos >= b.start_pos AND b.feature_type = 'exon' AND b.strand = '+'
WHERE a.feature_type = 'gene' GROUP BY a.chrom, a.start_pos, a.end_pos, a.name, a.id, a.score, a.source, a.strand""")
def join_overlap_left(v):
    genes = v.features.filter("feature_type = 'gene'")
    pairs = iv.overlap_join(genes, v.features.filter("feature_type = 'exon' and strand = '+'"), "left")
    keys = ["a_chrom", "a_start_pos", "a_end_pos", "a_name", "a_id", "a_score", "a_source", "a_strand"]
    return pairs.groupBy(*keys).agg(F.count("b_chrom").alias("n")).selectExpr("a_chrom as chrom", "a_start_pos as start_pos", "a_end_pos as end_pos", "a_name as name", "n")


@query("join_point", """SELECT a.chrom, a.pos, a.ref, a.alt, b.start_pos, b.end_pos, b.feature_type, b.name
FROM v_variants a JOIN v_features b ON a.chrom = b.chrom AND a.pos BETWEEN b.start_pos AND b.end_pos""")
def join_point(v):
    return iv.point_join(v.variants, v.features).selectExpr("a_chrom as chrom", "a_pos as pos", "a_ref as ref", "a_alt as alt", "b_start_pos as start_pos", "b_end_pos as end_pos", "b_feature_type as feature_type", "b_name as name")


@query("join_contains", """SELECT a.chrom, a.start_pos AS outer_start, a.end_pos AS outer_end, b.start_pos, b.end_pos FROM v_features a
JOIN v_features b ON a.chrom = b.chrom AND a.start_pos < b.start_pos AND a.end_pos > b.end_pos WHERE a.feature_type = 'gene' AND b.feature_type = 'exon'""")
def join_contains(v):
    pairs = iv.containment_join(v.features.filter("feature_type = 'gene'"), v.features.filter("feature_type = 'exon'"), strict=True)
    return pairs.selectExpr("a_chrom as chrom", "a_start_pos as outer_start", "a_end_pos as outer_end", "b_start_pos as start_pos", "b_end_pos as end_pos")


@query("join_nearest", """SELECT p.chrom, p.pos, (SELECT max(end_pos) FROM v_features f WHERE f.chrom = p.chrom AND f.end_pos < p.pos AND feature_type = 'gene') AS prev_end,
  (SELECT min(start_pos) FROM v_features f WHERE f.chrom = p.chrom AND f.start_pos > p.pos AND feature_type = 'gene') AS next_start
FROM (SELECT DISTINCT chrom, pos FROM v_variants) p""")
def join_nearest(v):
    points = v.variants.select("chrom", "pos").distinct()
    return iv.nearest(points, v.features.filter("feature_type = 'gene'")).select("chrom", "pos", "prev_end", "next_start")


@query("join_dimension", "SELECT f.chrom, f.start_pos, f.name, i.description, i.type_of_gene FROM v_features f LEFT JOIN v_gene_info i ON f.name = i.name")
def join_dimension(v):
    return v.features.join(v.gene_info, "name", "left").select("chrom", "start_pos", "name", "description", "type_of_gene")


@query("join_gene_rows", """SELECT gene_name, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_exons, string_agg(CAST(start_pos AS VARCHAR), ',' ORDER BY exon_number) AS starts
FROM v_exons WHERE gene_name IN (SELECT gene_name FROM v_exons GROUP BY gene_name HAVING count(*) >= 3) GROUP BY gene_name""")
def join_gene_rows(v):
    many = v.exons.groupBy("gene_name").count().filter("count >= 3").select("gene_name")
    rows = v.exons.join(many, "gene_name", "left_semi")
    starts = F.array_sort(F.collect_list(F.struct("exon_number", "start_pos")))
    out = rows.groupBy("gene_name").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n_exons"), starts.alias("s"))
    return out.withColumn("starts", F.array_join(F.transform("s", lambda x: x.start_pos.cast("string")), ",")).drop("s")


@query("join_host_gene", """WITH mi AS (SELECT DISTINCT chrom, start_pos, end_pos FROM v_features WHERE feature_type = 'CDS' AND end_pos - start_pos < 8),
hit AS (SELECT m.*, f.name, f.start_pos AS fs, f.feature_type AS ft FROM mi m LEFT JOIN v_features f ON m.chrom = f.chrom AND m.start_pos <= f.end_pos AND m.end_pos >= f.start_pos AND f.feature_type <> 'CDS')
SELECT chrom, start_pos, end_pos, min(CASE WHEN ft = 'gene' THEN lpad(CAST(fs AS VARCHAR), 12, '0') || ':' || name END) AS host, max(CASE WHEN ft = 'exon' THEN 1 ELSE 0 END) AS in_exon FROM hit GROUP BY chrom, start_pos, end_pos""")
def join_host_gene(v):
    small = v.features.filter("feature_type = 'CDS' and end_pos - start_pos < 8").select("chrom", "start_pos", "end_pos").distinct()
    pairs = iv.overlap_join(small, v.features.filter("feature_type <> 'CDS'"), "left")
    host = F.min(F.when(F.col("b_feature_type") == "gene", F.concat(F.lpad(F.col("b_start_pos").cast("string"), 12, "0"), F.lit(":"), F.col("b_name"))))
    return pairs.groupBy(F.col("a_chrom").alias("chrom"), F.col("a_start_pos").alias("start_pos"), F.col("a_end_pos").alias("end_pos")).agg(host.alias("host"), F.max(F.when(F.col("b_feature_type") == "exon", 1).otherwise(0)).alias("in_exon"))


@query("join_lift", """SELECT chrom, pos, ref, alt, CAST(pos + coalesce(sum(length(alt) - length(ref)) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS alt_pos,
  CAST(pos + coalesce(sum(abs(length(alt) - length(ref))) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS display_pos FROM v_variants""")
def join_lift(v):
    delta = F.length("alt") - F.length("ref")
    rows = running(v.variants, ["chrom"], ["pos"], {"d": ("sum", delta), "g": ("sum", F.abs(delta))})
    display = F.col("pos") + F.coalesce("g", F.lit(0)) + F.abs(delta)
    return rows.select("chrom", "pos", "ref", "alt", (F.col("pos") + F.coalesce("d", F.lit(0))).alias("alt_pos"), display.alias("display_pos"))


@query("win_islands", """WITH o AS (SELECT chrom, feature_type, start_pos, end_pos, max(end_pos) OVER (PARTITION BY chrom, feature_type ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_features),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, feature_type ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT chrom, feature_type, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n FROM n GROUP BY chrom, feature_type, island""")
def win_islands(v):
    return iv.coalesce_intervals(v.features, ["chrom", "feature_type"])


@query("win_introns", """WITH p AS (SELECT *, lag(end_pos) OVER (PARTITION BY gene_name ORDER BY start_pos, end_pos) AS prev FROM v_exons)
SELECT gene_name, chrom, CAST(row_number() OVER (PARTITION BY gene_name ORDER BY start_pos, end_pos) AS INT) AS intron_number, prev + 1 AS start_pos, start_pos - 1 AS end_pos FROM p WHERE start_pos - prev > 1""")
def win_introns(v):
    return iv.infer_introns(v.exons)


@query("win_running_delta", "SELECT chrom, pos, CAST(sum(length(alt) - length(ref)) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS delta FROM v_variants")
def win_running_delta(v):
    delta = F.length("alt") - F.length("ref")
    return running(v.variants, ["chrom"], ["pos"], {"d": ("sum", delta)}).select("chrom", "pos", (F.coalesce("d", F.lit(0)) + delta).alias("delta"))


@query("win_strand_order", """SELECT gene_name, start_pos, end_pos, strand, CAST(row_number() OVER (PARTITION BY gene_name ORDER BY CASE WHEN strand = '-' THEN -end_pos ELSE start_pos END) AS INT) AS nth,
CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS five_prime FROM v_exons""")
def win_strand_order(v):
    key = F.when(F.col("strand") == "-", -F.col("end_pos")).otherwise(F.col("start_pos"))
    return v.exons.select("gene_name", "start_pos", "end_pos", "strand", F.row_number().over(Window.partitionBy("gene_name").orderBy(key)).alias("nth"), F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos")).alias("five_prime"))


@query("win_greedy_non_overlap", """WITH RECURSIVE f AS (SELECT chrom, start_pos, end_pos, feature_type, name, CASE feature_type WHEN 'gene' THEN 0 WHEN 'exon' THEN 1 ELSE 2 END AS rank FROM v_features),
o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY rank, start_pos, end_pos, feature_type, name) AS k FROM f),
w AS (SELECT chrom, CAST(0 AS BIGINT) AS k, false AS keep, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS kept FROM (SELECT DISTINCT chrom FROM f)
  UNION ALL SELECT chrom, k, keep, CASE WHEN keep THEN list_append(kept, {'s': s, 'e': e}) ELSE kept END FROM (
    SELECT w.chrom, o.k, o.start_pos AS s, o.end_pos AS e, w.kept, len(list_filter(w.kept, lambda x: x.s <= o.end_pos AND x.e >= o.start_pos)) = 0 AS keep FROM w JOIN o ON o.chrom = w.chrom AND o.k = w.k + 1))
SELECT o.chrom, start_pos, end_pos, feature_type, name, rank FROM o JOIN w ON w.chrom = o.chrom AND w.k = o.k WHERE keep""")
def win_greedy_non_overlap(v):
    rank = F.when(F.col("feature_type") == "gene", 0).when(F.col("feature_type") == "exon", 1).otherwise(2)
    return iv.greedy_non_overlap(v.features, rank)


@query("win_smooth", """WITH c AS (SELECT chrom, (start_pos - 1) // 4096 AS win, count(*) AS n FROM v_features GROUP BY 1, 2),
s AS (SELECT chrom, win, lag(n) OVER w AS a, n AS b, lead(n) OVER w AS c FROM c WINDOW w AS (PARTITION BY chrom ORDER BY win))
SELECT chrom, win, CAST(round(0.25 * a + 0.5 * b + 0.25 * c, 6) AS DOUBLE) AS smooth FROM s WHERE a IS NOT NULL AND c IS NOT NULL""")
def win_smooth(v):
    counts = v.features.groupBy("chrom", F.floor((F.col("start_pos") - 1) / 4096).alias("win")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("chrom").orderBy("win")
    a, c = F.lag("n").over(w), F.lead("n").over(w)
    return counts.select("chrom", "win", F.round(0.25 * a + 0.5 * F.col("n") + 0.25 * c, 6).alias("smooth")).filter("smooth is not null")


@query("agg_density", """WITH g AS (SELECT chrom, unnest(range(CAST((length - 1) // 4096 AS BIGINT) + 1)) AS win FROM v_contigs),
t AS (SELECT chrom, unnest(range((start_pos - 1) // 4096, (end_pos - 1) // 4096 + 1)) AS win FROM v_features WHERE feature_type = 'gene'),
c AS (SELECT chrom, win, count(*) AS n FROM t GROUP BY chrom, win)
SELECT g.chrom, g.win, g.win * 4096 + 1 AS win_start, coalesce(n, 0) AS n, coalesce(n, 0) / 4096.0 AS density FROM g LEFT JOIN c ON g.chrom = c.chrom AND g.win = c.win""")
def agg_density(v):
    return iv.density(v.features.filter("feature_type = 'gene'"), v.contigs, 4096).withColumn("density", F.col("density").cast("double"))


@query("agg_summary", "SELECT source, feature_type, count(*) AS n FROM v_features WHERE chrom = '2' GROUP BY source, feature_type")
def agg_summary(v):
    return iv.region(v.features, "2").groupBy("source", "feature_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_gene_list", """SELECT g.chrom, g.start_pos, g.end_pos, g.name, g.end_pos - g.start_pos AS length, count(f.chrom) AS n FROM v_features g
JOIN v_features f ON g.chrom = f.chrom AND g.start_pos <= f.end_pos AND g.end_pos >= f.start_pos WHERE g.feature_type = 'gene' AND g.source = 'genes'
GROUP BY g.chrom, g.start_pos, g.end_pos, g.name""")
def agg_gene_list(v):
    pairs = iv.overlap_join(v.features.filter("feature_type = 'gene' and source = 'genes'"), v.features)
    out = pairs.groupBy("a_chrom", "a_start_pos", "a_end_pos", "a_name").agg(F.count(F.lit(1)).alias("n"))
    return out.selectExpr("a_chrom as chrom", "a_start_pos as start_pos", "a_end_pos as end_pos", "a_name as name", "a_end_pos - a_start_pos as length", "n")


@query("agg_by_type", "SELECT feature_type, count(*) AS n, min(start_pos) AS first_start, max(end_pos) AS last_end, round(avg(end_pos - start_pos), 6) AS mean_length FROM v_features GROUP BY feature_type")
def agg_by_type(v):
    return v.features.groupBy("feature_type").agg(F.count(F.lit(1)).alias("n"), F.min("start_pos").alias("first_start"), F.max("end_pos").alias("last_end"), F.round(F.avg(F.col("end_pos") - F.col("start_pos")), 6).alias("mean_length"))


@query("sort_natural_chrom", "SELECT f.chrom, chrom_rank, start_pos, end_pos, CAST(row_number() OVER (ORDER BY start_pos, end_pos, name, id, score) AS BIGINT) * 0 + chrom_rank AS k FROM v_features f JOIN v_contigs c ON f.chrom = c.chrom WHERE feature_type = 'gene'")
def sort_natural_chrom(v):
    rows = v.features.filter("feature_type = 'gene'").join(F.broadcast(v.contigs.select("chrom", "chrom_rank")), "chrom")
    return rows.select("chrom", "chrom_rank", "start_pos", "end_pos", F.col("chrom_rank").cast("long").alias("k")).orderBy("chrom_rank", "start_pos", "end_pos")


@query("sort_natural_chrom_whole", "SELECT f.chrom, chrom_rank, start_pos, end_pos FROM v_features f JOIN v_contigs c ON f.chrom = c.chrom WHERE feature_type = 'gene'")
def sort_natural_chrom_whole(v):
    rows = v.features.filter("feature_type = 'gene'").join(F.broadcast(v.contigs.select("chrom", "chrom_rank")), "chrom")
    return rows.select("chrom", "chrom_rank", "start_pos", "end_pos").orderBy("chrom_rank", "start_pos", "end_pos")


@query("sort_top_per_chrom", "SELECT chrom, start_pos, end_pos, name, score, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY score DESC, start_pos, end_pos, name, id) AS k FROM v_features) WHERE k <= 5")
def sort_top_per_chrom(v):
    w = Window.partitionBy("chrom").orderBy(F.col("score").desc(), "start_pos", "end_pos", "name", "id")
    return v.features.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("chrom", "start_pos", "end_pos", "name", "score", "k")


@query("set_ordered_union", "SELECT chrom, start_pos, end_pos, feature_type FROM v_features UNION ALL SELECT chrom, pos, pos, 'variant' FROM v_variants")
def set_ordered_union(v):
    marks = v.variants.selectExpr("chrom", "pos as start_pos", "pos as end_pos", "'variant' as feature_type", "ref", "alt")
    both = v.features.unionByName(marks, allowMissingColumns=True)
    return both.select("chrom", "start_pos", "end_pos", "feature_type").orderBy("chrom", "start_pos", "end_pos")


@query("set_names", "SELECT chrom, name FROM v_features WHERE feature_type = 'gene' UNION SELECT chrom, name FROM v_features WHERE source = 'repeats'")
def set_names(v):
    """Names of every chromosome that genes or repeats have, each once."""
    genes, repeats = (v.features.filter(c).select("chrom", "name") for c in ("feature_type = 'gene'", "source = 'repeats'"))
    return genes.union(repeats).distinct()


@query("join_novel_names", "SELECT DISTINCT name FROM v_features f WHERE feature_type = 'CDS' AND NOT EXISTS (SELECT 1 FROM v_features g WHERE g.feature_type = 'gene' AND g.name = f.name)")
def join_novel_names(v):
    genes = v.features.filter("feature_type = 'gene'").select("name").distinct()
    return v.features.filter("feature_type = 'CDS'").select("name").distinct().join(genes, "name", "left_anti")
