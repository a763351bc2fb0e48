"""Queries over variants, names and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import bases
from strandframe.functions.names import prefixes, te_parts
from strandframe.operators import intervals as iv
from strandframe.operators.ordered import running

from .registry import query


@query("agg_length_map", "SELECT length(ref) - 1 AS ref_extra, length(alt) - 1 AS alt_extra, count(*) AS n FROM v_indels GROUP BY 1, 2")
def agg_length_map(v):
    return v.indels.groupBy((F.length("ref") - 1).cast("long").alias("ref_extra"), (F.length("alt") - 1).cast("long").alias("alt_extra")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_quality", "SELECT chrom, count(*) AS n, round(avg(qual), 6) AS mean, round(stddev_pop(qual), 6) AS sd, round(median(qual), 6) AS median, min(qual) AS least, max(qual) AS most FROM v_variants GROUP BY chrom")
def agg_quality(v):
    return v.variants.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qual"), 6).alias("mean"), F.round(F.stddev_pop("qual"), 6).alias("sd"), F.round(F.median("qual"), 6).alias("median"), F.min("qual").alias("least"), F.max("qual").alias("most"))


@query("agg_long_variants", """WITH x AS (SELECT *, row_number() OVER () AS k FROM v_indels WHERE abs(length(alt) - length(ref)) > 1)
SELECT x.chrom, x.pos, x.ref, x.alt, length(alt) - length(ref) AS delta, count(f.chrom) AS n_features FROM x
LEFT JOIN v_features f ON x.chrom = f.chrom AND x.pos BETWEEN f.start_pos AND f.end_pos GROUP BY k, x.chrom, x.pos, x.ref, x.alt""")
def agg_long_variants(v):
    """Each variant that changes the length by more than one, with the features over its place; several may share one."""
    long_ = v.indels.filter("abs(length(alt) - length(ref)) > 1")
    counted = iv.covering_counts(long_, v.features)
    return counted.select("chrom", "pos", "ref", "alt", (F.length("alt") - F.length("ref")).cast("long").alias("delta"), "n_features")


@query("agg_substitutions", "SELECT ref || alt AS change, count(*) AS n, round(avg(qual), 6) AS mean_qual FROM v_variants WHERE length(ref) = length(alt) GROUP BY 1")
def agg_substitutions(v):
    return v.variants.filter("length(ref) = length(alt)").groupBy(F.concat("ref", "alt").alias("change")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qual"), 6).alias("mean_qual"))


@query("agg_inserted", "WITH i AS (SELECT substr(alt, 2) AS ins FROM v_variants WHERE length(alt) > 1) SELECT b AS base, count(*) AS n FROM (SELECT unnest(string_split(ins, '')) AS b FROM i) GROUP BY b")
def agg_inserted(v):
    inserted = v.variants.filter("length(alt) > 1").select(F.explode(F.split(F.expr("substr(alt, 2)"), "")).alias("base"))
    return inserted.filter("base <> ''").groupBy("base").agg(F.count(F.lit(1)).alias("n"))


@query("agg_mutation_types", """SELECT CASE WHEN ref || alt IN ('AG', 'GA', 'CT', 'TC') THEN 'transition' ELSE 'transversion' END AS kind, variant_class, count(*) AS n FROM v_variants WHERE length(alt) = 1 AND ref <> alt GROUP BY 1, 2""")
def agg_mutation_types(v):
    kind = F.when(bases.transition(F.col("ref")) == F.col("alt"), "transition").otherwise("transversion")
    return v.variants.filter("length(alt) = 1 and ref <> alt").groupBy(kind.alias("kind"), "variant_class").agg(F.count(F.lit(1)).alias("n"))


@query("agg_relative_spectrum", """WITH c AS (SELECT chrom, ref || substr(alt, 1, 1) AS change, count(*) AS n FROM v_variants GROUP BY 1, 2)
SELECT chrom, change, round(n / sum(n) OVER (PARTITION BY chrom) - 1.0 / count(*) OVER (PARTITION BY chrom), 9) AS excess FROM c""")
def agg_relative_spectrum(v):
    from pyspark.sql import Window

    counts = v.variants.groupBy("chrom", F.concat("ref", F.substring("alt", 1, 1)).alias("change")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("chrom")
    return counts.select("chrom", "change", F.round(F.col("n") / F.sum("n").over(w) - 1.0 / F.count(F.lit(1)).over(w), 9).alias("excess"))


@query("agg_merge_iupac", """WITH m AS (SELECT chrom, pos // 1000 AS win, bit_or(CASE ref WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END) AS mask FROM v_variants GROUP BY 1, 2)
SELECT chrom, win, CAST(mask AS INT) AS mask, substr('ACMGRSVTWYHKDBN', CAST(mask AS INT), 1) AS code FROM m""")
def agg_merge_iupac(v):
    masks = v.variants.groupBy("chrom", F.floor(F.col("pos") / 1000).alias("win")).agg(F.bit_or(bases.base_mask(F.col("ref"))).alias("mask"))
    return masks.withColumn("code", bases.mask_code(F.col("mask")))


@query("te_classes", r"""SELECT hit_id, name, CASE WHEN name LIKE 'Alu%' THEN 'Alu' WHEN name LIKE 'L1%' THEN 'L1' ELSE regexp_extract(name, '^([A-Za-z]+)', 1) END AS family,
nullif(regexp_extract(name, '^(?:Alu|L1|[A-Za-z]+_?)([A-Z]{1,2}[a-z]?|[A-Z]?[0-9]+)?', 1), '') AS subfamily, nullif(regexp_extract(name, '_([0-9]end)$', 1), '') AS suffix FROM v_te_names""")
def te_classes(v):
    return te_parts(v.te_names).select("hit_id", "name", "family", "subfamily", "suffix")


@query("te_index", r"""WITH t AS (SELECT name, CASE WHEN name LIKE 'Alu%' THEN 'Alu' WHEN name LIKE 'L1%' THEN 'L1' ELSE regexp_extract(name, '^([A-Za-z]+)', 1) END AS family FROM v_te_names)
SELECT family, name, count(*) AS n FROM t GROUP BY ROLLUP (family, name)""")
def te_index(v):
    return te_parts(v.te_names).rollup("family", "name").agg(F.count(F.lit(1)).alias("n"))


@query("te_prefix_support", """WITH p AS (SELECT substr(name, 1, k) AS prefix, substr(name, k + 1, 1) AS nxt FROM v_te_names, (SELECT unnest(range(1, 1 + (SELECT max(length(name)) FROM v_te_names))) AS k) WHERE k <= length(name)),
s AS (SELECT prefix, count(*) AS support, count(DISTINCT nullif(nxt, '')) AS branches FROM p GROUP BY prefix) SELECT * FROM s WHERE support >= 20 AND branches >= 2""")
def te_prefix_support(v):
    rows = prefixes(v.te_names.select("hit_id", "name"))
    out = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("support"), F.count_distinct(F.when(F.col("next") != "", F.col("next"))).alias("branches"))
    return out.filter("support >= 20 and branches >= 2")


@query("te_longest_prefix", """WITH p AS (SELECT DISTINCT name, substr(name, 1, k) AS prefix FROM v_te_names, (SELECT unnest(range(1, 1 + (SELECT max(length(name)) FROM v_te_names))) AS k) WHERE k <= length(name)),
s AS (SELECT prefix FROM p GROUP BY prefix HAVING count(*) >= 3) SELECT name, max(prefix) AS assigned, count(*) AS depth FROM p JOIN s USING (prefix) GROUP BY name""")
def te_longest_prefix(v):
    rows = prefixes(v.te_names.select("name").distinct()).select("name", "prefix").distinct()
    mined = rows.groupBy("prefix").count().filter("count >= 3").select("prefix")
    return rows.join(mined, "prefix").groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("assigned"), F.count(F.lit(1)).alias("depth"))


@query("te_name_counts", "SELECT sum(CASE WHEN contains(name, 'Alu') THEN 1 ELSE 0 END) AS alu, sum(CASE WHEN contains(name, 'L1') THEN 1 ELSE 0 END) AS l1, sum(CASE WHEN contains(name, 'MIR') THEN 1 ELSE 0 END) AS mir FROM v_te_names")
def te_name_counts(v):
    return v.te_names.agg(*[F.sum(F.contains("name", F.lit(x)).cast("long")).alias(x.lower()) for x in ("Alu", "L1", "MIR")])


REGIONS = "(VALUES ('1', 100, 5000), ('9', 20000, 60000), ('9', 50000, 50010), ('24', 1, 1000000000)) AS t(chrom, from_pos, to_pos)"


@query("fn_overlap_length", f"""SELECT f.chrom, start_pos, end_pos, from_pos, to_pos, greatest(least(end_pos, to_pos) - greatest(start_pos, from_pos), 0) AS shared FROM v_features f JOIN {REGIONS} ON f.chrom = t.chrom
UNION ALL SELECT chrom, start_pos, end_pos, NULL, NULL, 0 FROM v_features WHERE chrom NOT IN (SELECT chrom FROM {REGIONS})""")
def fn_overlap_length(v):
    """What every feature shares with each asked region of its chromosome; a feature without one shares nothing."""
    regions = v.spark.sql(f"SELECT chrom, CAST(from_pos AS LONG) AS from_pos, CAST(to_pos AS LONG) AS to_pos FROM {REGIONS}")
    rows = v.features.select("chrom", "start_pos", "end_pos").join(regions, "chrom", "left")
    shared = F.greatest(F.least("end_pos", "to_pos") - F.greatest("start_pos", "from_pos"), F.lit(0))
    return rows.withColumn("shared", F.when(F.col("from_pos").isNull(), F.lit(0)).otherwise(shared).cast("long"))


@query("fn_variant_kind", """SELECT chrom, pos, ref, alt, genotype, length(alt) - length(ref) AS delta, CASE WHEN length(alt) = length(ref) THEN 'SNV' WHEN length(alt) > length(ref) THEN 'insertion' ELSE 'deletion' END AS kind,
  CASE WHEN genotype IN ('0/0', '0|0') THEN 'absent' WHEN split_part(replace(genotype, '|', '/'), '/', 1) = split_part(replace(genotype, '|', '/'), '/', 2) THEN 'homozygous' ELSE 'heterozygous' END AS zygosity FROM v_indels""")
def fn_variant_kind(v):
    delta = (F.length("alt") - F.length("ref")).cast("long")
    kind = F.when(delta == 0, "SNV").when(delta > 0, "insertion").otherwise("deletion")
    return v.indels.select("chrom", "pos", "ref", "alt", "genotype", delta.alias("delta"), kind.alias("kind"), bases.zygosity(F.col("genotype")).alias("zygosity"))


@query("agg_track", "SELECT chrom, (pos - 1) // 4096 AS bin_id, CAST(avg(qual) AS FLOAT) AS value FROM v_variants GROUP BY 1, 2 HAVING abs(avg(qual)) > 1e-9")
def agg_track(v):
    tracks = v.variants.groupBy("chrom", F.floor((F.col("pos") - 1) / 4096).alias("bin_id")).agg(F.avg("qual").alias("m"))
    return tracks.filter("abs(m) > 1e-9").select("chrom", "bin_id", F.col("m").cast("float").alias("value"))


@query("agg_members_whole", "SELECT feature_type, chrom, row_number() OVER (PARTITION BY feature_type, chrom ORDER BY start_pos, end_pos, name) - 1 AS k, name FROM v_features")
def agg_members_whole(v):
    rows = running(v.features.select("feature_type", "chrom", "start_pos", "end_pos", "name"), ["feature_type", "chrom"], ["start_pos", "end_pos", "name"], {"k": ("sum", F.lit(1))})
    return rows.select("feature_type", "chrom", F.coalesce("k", F.lit(0)).cast("long").alias("k"), "name")


@query("agg_members", "SELECT feature_type, chrom, CAST(count(*) OVER (PARTITION BY feature_type, chrom) AS BIGINT) AS n, row_number() OVER (PARTITION BY feature_type, chrom ORDER BY start_pos, end_pos, name) - 1 AS k, name FROM v_features")
def agg_members(v):
    """Members one a row, numbered within their class: no list of a whole class."""
    sizes = v.features.groupBy("feature_type", "chrom").agg(F.count(F.lit(1)).alias("n"))
    rows = running(v.features.select("feature_type", "chrom", "start_pos", "end_pos", "name"), ["feature_type", "chrom"], ["start_pos", "end_pos", "name"], {"k": ("sum", F.lit(1))})
    return rows.join(F.broadcast(sizes), ["feature_type", "chrom"]).select("feature_type", "chrom", "n", F.coalesce("k", F.lit(0)).cast("long").alias("k"), "name")
