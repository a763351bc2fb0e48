"""Queries over coding sequences: the lines of an order are the coding segments of a transcript."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import bases, proteins
from strandframe.operators import coding
from strandframe.operators import sequences as sq

from .registry import query
from .window_queries import RC, WHOLE

STARTS = ", ".join(f"'{c}'" for c in proteins.START_CODONS)
AMINO = f"coalesce(list_aggregate(list_transform(regexp_extract_all({{s}}, '.{{{{3}}}}'), lambda c: substr('{bases.CODE}', CAST((strpos('TCAG', c[1]) - 1) * 16 + (strpos('TCAG', c[2]) - 1) * 4 + strpos('TCAG', c[3]) AS INT), 1)), 'string_agg', ''), '')"

# segments in reading order, x their bases as they are read
PARTS = """r AS (SELECT *, row_number() OVER w AS seg, coalesce(sum(end_pos - start_pos + 1) OVER (PARTITION BY transcript, chrom, strand ORDER BY CASE WHEN strand = '-' THEN -end_pos ELSE start_pos END, start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e WINDOW w AS (PARTITION BY transcript, chrom, strand ORDER BY CASE WHEN strand = '-' THEN -end_pos ELSE start_pos END, start_pos, end_pos))"""


def read_sql(name: str, source: str, seq: str) -> str:
    """A table of transcripts read and translated, from segments with their bases in a column."""
    return f"""{name}_t AS (SELECT transcript, chrom, strand, count(*) AS n_segments, sum(end_pos - start_pos + 1) = sum(length({seq})) AS complete, string_agg({seq}, '' ORDER BY seg) AS joined, max({seq}) FILTER (seg = 1) AS first FROM {source} GROUP BY 1, 2, 3),
{name}_p AS (SELECT *, list_position(list_transform(list_slice(regexp_extract_all(first, '.{{3}}'), 1, 34), lambda c: c IN ({STARTS})), true) AS p FROM {name}_t WHERE joined <> ''),
{name}_c AS (SELECT *, CASE WHEN p > 0 THEN CAST(3 * (p - 1) AS INT) END AS start_at, CASE WHEN p > 0 THEN substr(joined, CAST(3 * (p - 1) + 1 AS INT)) END AS coding FROM {name}_p),
{name}_a AS (SELECT *, CASE WHEN coding IS NOT NULL THEN {AMINO.format(s='coding')} END AS every FROM {name}_c),
{name} AS (SELECT *, CASE WHEN strpos(every, '*') > 0 THEN substr(every, 1, strpos(every, '*') - 1) ELSE every END AS protein, nullif(strpos(every, '*'), 0) AS stop FROM {name}_a)"""


SEGMENTS = f"{WHOLE}, e AS (SELECT transcript, x.chrom, strand, start_pos, end_pos, CASE WHEN strand = '-' THEN {RC.format(s='substr(whole, start_pos, end_pos - start_pos + 1)')} ELSE substr(whole, start_pos, end_pos - start_pos + 1) END AS x FROM v_segments x JOIN g ON x.chrom = g.chrom),\n{PARTS}"


@query("seq_coding", f"""WITH {SEGMENTS},
{read_sql('t', 'r', 'x')},
w AS (SELECT t.*, CASE WHEN r.strand = '-' THEN r.end_pos - (start_at - before) ELSE r.start_pos + start_at - before END AS translation_start FROM t
  LEFT JOIN r ON r.transcript = t.transcript AND r.chrom = t.chrom AND r.strand = t.strand AND start_at >= before AND start_at <= before + r.end_pos - r.start_pos)
SELECT transcript, chrom, strand, n_segments, complete, start_at, CAST(translation_start AS BIGINT) AS translation_start, coding, protein, CASE WHEN start_at IS NULL THEN 'no start codon' WHEN stop IS NULL THEN 'no stop codon' END AS warning FROM w""")
def seq_coding(v):
    """Transcripts from their start codon to the first stop."""
    return coding.coding_sequences(v.segments, v.ref_chunks).drop("translation_end", "places")


@query("seq_codon_effects", f"""WITH {SEGMENTS},
{read_sql('t', 'r', 'x')},
b AS (SELECT transcript, chrom, strand, before + i AS off, CASE WHEN strand = '-' THEN end_pos - i ELSE start_pos + i END AS pos FROM (SELECT *, unnest(range(end_pos - start_pos + 1)) AS i FROM r)),
h AS (SELECT t.transcript, t.chrom, t.strand, b.pos, v.ref, v.alt, off - start_at AS o, CASE WHEN t.strand = '-' THEN translate(v.ref, 'ATGC', 'TACG') ELSE v.ref END AS own_ref, CASE WHEN t.strand = '-' THEN translate(v.alt, 'ATGC', 'TACG') ELSE v.alt END AS own_alt, substr(coding, CAST((off - start_at) // 3 * 3 + 1 AS INT), 3) AS codon
  FROM t JOIN b ON t.transcript = b.transcript AND t.chrom = b.chrom AND t.strand = b.strand JOIN v_variants v ON v.chrom = b.chrom AND v.pos = b.pos
  WHERE complete AND start_at IS NOT NULL AND off >= start_at AND off - start_at < coalesce(3 * stop, length(coding)) AND length(alt) = 1 AND v.ref <> v.alt),
c AS (SELECT *, CAST(o // 3 + 1 AS BIGINT) AS codon_number, substr(codon, 1, CAST(o % 3 AS INT)) || own_alt || substr(codon, CAST(o % 3 + 2 AS INT)) AS changed FROM h WHERE length(codon) = 3 AND substr(codon, CAST(o % 3 + 1 AS INT), 1) = own_ref),
a AS (SELECT *, {AMINO.format(s='codon')} AS aa, {AMINO.format(s='changed')} AS new_aa FROM c)
SELECT transcript, chrom, strand, pos, ref, alt, codon_number, codon, changed, aa, new_aa, CASE WHEN aa = new_aa THEN 'silent' WHEN new_aa = '*' THEN 'nonsense' WHEN aa = '*' THEN 'readthrough' ELSE 'missense' END AS effect,
  len(list_filter(['AVLIM', 'FWY', 'STC', 'NQ', 'DE', 'KRH', 'G', 'P'], lambda x: contains(x, aa) AND contains(x, new_aa))) > 0 AS conservative, 'p.' || aa || codon_number || new_aa AS notation FROM a""")
def seq_codon_effects(v):
    """What each substitution does to the codon of its transcript, frames counted from the start codon over exon borders."""
    return coding.codon_changes_of(v.variants, v.segments, v.ref_chunks)


@query("seq_protein_changes", f"""WITH {SEGMENTS},
b AS (SELECT transcript, chrom, strand, seg, before, start_pos, end_pos, start_pos + i AS pos, substr(CASE WHEN strand = '-' THEN {RC.format(s='x')} ELSE x END, CAST(i + 1 AS INT), 1) AS c FROM (SELECT *, unnest(range(length(x))) AS i FROM r)),
m AS (SELECT transcript, b.chrom, strand, seg, string_agg(coalesce(v.alt, c), '' ORDER BY b.pos) AS y, count(v.alt) AS n FROM b LEFT JOIN v_variants v ON v.chrom = b.chrom AND v.pos = b.pos AND v.ref = c GROUP BY 1, 2, 3, 4),
o AS (SELECT r.*, CASE WHEN y IS NULL THEN '' WHEN r.strand = '-' THEN {RC.format(s='y')} ELSE y END AS y, coalesce(n, 0) AS n FROM r LEFT JOIN m ON m.transcript = r.transcript AND m.chrom = r.chrom AND m.strand = r.strand AND m.seg = r.seg),
{read_sql('t', 'r', 'x')},
{read_sql('u', 'o', 'y')},
s AS (SELECT transcript, chrom, strand, CAST(sum(n) AS BIGINT) AS n_applied FROM o GROUP BY 1, 2, 3),
p AS (SELECT t.transcript, t.chrom, t.strand, n_applied, coalesce(t.protein, '') AS protein, coalesce(u.protein, '') AS personal FROM t JOIN u ON t.transcript = u.transcript AND t.chrom = u.chrom AND t.strand = u.strand JOIN s ON s.transcript = t.transcript AND s.chrom = t.chrom AND s.strand = t.strand),
q AS (SELECT *, list_filter(range(1, least(length(protein), length(personal)) + 1), lambda i: protein[i] <> personal[i]) AS off FROM p)
SELECT transcript, chrom, strand, n_applied, protein, personal, concat_ws(', ', nullif(array_to_string(list_transform(off, lambda i: concat('p.', protein[i], i, personal[i])), ', '), ''),
  CASE WHEN length(personal) > length(protein) THEN concat('p.', length(protein), '_ext', length(personal) - length(protein)) WHEN length(personal) < length(protein) THEN concat('p.', length(personal), '_del', length(protein) - length(personal)) END) AS summary,
  round((least(length(protein), length(personal)) - len(off)) / nullif(greatest(length(protein), length(personal)), 0), 9) AS identity FROM q""")
def seq_protein_changes(v):
    """Each transcript's protein with the variants put in, beside the reference's."""
    return coding.protein_changes(v.segments, v.variants, v.ref_chunks).drop("changes").withColumn("identity", F.round("identity", 9))


@query("seq_subfeature_kinds", f"""WITH {WHOLE}, f AS (SELECT gene_name, chrom, strand, 'exon' AS kind, start_pos, end_pos FROM v_exons UNION ALL SELECT gene_name, chrom, strand, 'CDS', start_pos + 3, end_pos - 3 FROM v_exons WHERE end_pos - start_pos >= 6
  UNION ALL SELECT gene_name, chrom, strand, 'five_prime_utr', CASE WHEN strand = '-' THEN end_pos - 2 ELSE start_pos END, CASE WHEN strand = '-' THEN end_pos ELSE start_pos + 2 END FROM v_exons WHERE end_pos - start_pos >= 6),
s AS (SELECT f.*, substr(whole, start_pos, end_pos - start_pos + 1) AS s FROM f JOIN g ON f.chrom = g.chrom)
SELECT gene_name, kind, start_pos, end_pos, CASE WHEN strand = '-' THEN {RC.format(s='s')} ELSE s END AS seq FROM s WHERE s <> ''""")
def seq_subfeature_kinds(v):
    """Sequences of all that a gene has but introns and variants: exons, their coding parts, what lies before these."""
    plus = F.col("strand") != "-"
    rows = v.exons.select("gene_name", "chrom", "strand", F.lit("exon").alias("kind"), "start_pos", "end_pos")
    long_ = rows.filter("end_pos - start_pos >= 6")
    inner = long_.select("gene_name", "chrom", "strand", F.lit("CDS").alias("kind"), (F.col("start_pos") + 3).alias("start_pos"), (F.col("end_pos") - 3).alias("end_pos"))
    before = long_.select("gene_name", "chrom", "strand", F.lit("five_prime_utr").alias("kind"), F.when(plus, F.col("start_pos")).otherwise(F.col("end_pos") - 2).alias("start_pos"), F.when(plus, F.col("start_pos") + 2).otherwise(F.col("end_pos")).alias("end_pos"))
    introns = coding.gaps(v.exons)
    every = rows.unionByName(inner).unionByName(before).unionByName(introns)
    return sq.subfeature_sequences(every, v.ref_chunks).select("gene_name", "kind", "start_pos", "end_pos", "seq")
