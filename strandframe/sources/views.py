"""Genomic tables as views over the given star schema.

Each view is one SELECT that Spark and DuckDB both run, so that a query and its SQL read the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.ordered import running
from strandframe.operators.storage import materialize

VIEWS = {
    "v_contigs": """
SELECT CAST(n AS STRING) AS chrom, CAST(n AS INT) AS chrom_rank,
       CAST((SELECT max(o_orderkey) FROM orders) * 10 + 100 AS BIGINT) AS length
FROM (SELECT DISTINCT o_custkey % 24 + 1 AS n FROM orders) c""",
    "v_features": """
SELECT CAST(l_suppkey % 24 + 1 AS STRING) AS chrom, l_orderkey * 10 + l_linenumber * 7 AS start_pos,
       l_orderkey * 10 + l_linenumber * 7 + CAST(l_quantity AS BIGINT) AS end_pos,
       CASE l_returnflag WHEN 'A' THEN 'gene' WHEN 'N' THEN 'exon' ELSE 'CDS' END AS feature_type,
       CASE WHEN l_discount < 0.05 THEN 'genes' ELSE 'repeats' END AS source, l_extendedprice AS score,
       CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, CAST(l_partkey AS STRING) AS name,
       concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id
FROM lineitem""",
    "v_variants": """
SELECT CAST(user_id % 24 + 1 AS STRING) AS chrom, event_id * 15 + 1 AS pos,
       substr('ATGC', CAST(event_id % 4 AS INT) + 1, 1) AS ref,
       substr('GCATTA', CAST(event_id % 4 AS INT) + 1, CAST(user_id % 3 AS INT) + 1) AS alt,
       value AS qual, event_type AS variant_class
FROM events""",
    "v_indels": """
SELECT chrom, pos, substr(concat(ref, 'GATTACA'), 1, CAST(pos % 7 AS INT) + 1) AS ref, ref AS alt, qual, concat(pos % 2, '/', pos % 3 % 2) AS genotype
FROM v_variants WHERE pos % 7 > 0
UNION ALL
SELECT chrom, pos, ref, concat(alt, substr('CCGGTT', 1, CAST(pos % 4 AS INT))) AS alt, qual, '1|1' AS genotype FROM v_variants""",
    "v_sequences": """
SELECT doc_id AS seq_id, lang AS grp, source,
       translate(upper(regexp_replace(text, '[^A-Za-z]', ''{g})), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ATGCATGCATGCATGCATGCATGCAT') AS seq
FROM documents""",
    "v_ref_chunks": """
SELECT chrom, seq_id AS chunk_id, seq,
       CAST(1 + coalesce(sum(length(seq)) OVER (PARTITION BY chrom ORDER BY seq_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_start
FROM (SELECT CAST(seq_id % 24 + 1 AS STRING) AS chrom, seq_id, seq FROM v_sequences) s
WHERE length(seq) > 0""",  # Spark's side is Views.ref_chunks, which sorts lengths alone
    "v_exons": """
SELECT CAST(l_orderkey AS STRING) AS gene_name, CAST(l_orderkey % 24 + 1 AS STRING) AS chrom,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS exon_number,
       l_orderkey * 1000 + 60 * row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS start_pos,
       l_orderkey * 1000 + 60 * row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) + CAST(l_quantity AS BIGINT) - 1 AS end_pos,
       CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand
FROM lineitem""",
    "v_segments": """
SELECT CAST(l_orderkey AS STRING) AS transcript, CAST(l_orderkey % 24 + 1 AS STRING) AS chrom, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       (l_orderkey % 960 - l_orderkey % 24) * 12 + 60 * n AS start_pos, (l_orderkey % 960 - l_orderkey % 24) * 12 + 60 * n + CAST(l_quantity AS BIGINT) - 1 AS end_pos
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) x""",
    "v_gene_info": """
SELECT CAST(p_partkey AS STRING) AS name, p_name AS description, p_type AS type_of_gene, p_brand AS map_location FROM part""",
    "v_te_names": """
SELECT p_partkey AS hit_id, concat(
       CASE p_partkey % 8 WHEN 0 THEN 'AluY' WHEN 1 THEN 'AluSx' WHEN 2 THEN 'L1PA' WHEN 3 THEN 'L1HS'
            WHEN 4 THEN 'MIR' WHEN 5 THEN 'MER' WHEN 6 THEN 'SVA_' ELSE 'Tigger' END,
       CASE p_partkey % 8 WHEN 3 THEN '' WHEN 1 THEN '' WHEN 6 THEN substr('ABCDEF', CAST(p_size % 6 AS INT) + 1, 1)
            ELSE CAST(p_size % 9 + 1 AS STRING) END,
       CASE WHEN p_size % 10 = 0 AND p_partkey % 8 = 2 THEN '_3end' ELSE '' END) AS name
FROM part""",
    "v_pwm": """
SELECT motif_id, pos, base, CAST(cnt AS DOUBLE) AS cnt FROM (VALUES
 ('M1',0,'A',0),('M1',0,'C',0),('M1',0,'G',0),('M1',0,'T',20),('M1',1,'A',20),('M1',1,'C',0),('M1',1,'G',0),('M1',1,'T',0),
 ('M1',2,'A',0),('M1',2,'C',0),('M1',2,'G',0),('M1',2,'T',20),('M1',3,'A',18),('M1',3,'C',0),('M1',3,'G',0),('M1',3,'T',2),
 ('M2',0,'A',0),('M2',0,'C',20),('M2',0,'G',0),('M2',0,'T',0),('M2',1,'A',10),('M2',1,'C',0),('M2',1,'G',10),('M2',1,'T',0),
 ('M2',2,'A',0),('M2',2,'C',0),('M2',2,'G',20),('M2',2,'T',0)) AS t(motif_id, pos, base, cnt)""",
}
BASE = {"v_contigs": ["orders"], "v_features": ["lineitem"], "v_variants": ["events"], "v_indels": ["events"], "v_sequences": ["documents"], "v_ref_chunks": ["documents"], "v_exons": ["lineitem"], "v_segments": ["lineitem"], "v_gene_info": ["part"], "v_te_names": ["part"], "v_pwm": []}
NEEDS = {"v_indels": ["v_variants"], "v_ref_chunks": ["v_sequences"]}


def duck(sql: str) -> str:
    """``sql`` with the views that it names put before it as common table expressions."""
    used = [v for v in VIEWS if v in sql]
    order = [n for v in used for n in [*NEEDS.get(v, []), v]]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].replace('{g}', ", 'g'")})" for v in dict.fromkeys(order))
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


class Views:
    """The views of one data folder as DataFrames, each built from its own tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql, tables = VIEWS[name].replace("{g}", ""), {t: self.table(t) for t in BASE[name]}
        for v in NEEDS.get(name, []):
            sql, tables = sql.replace(v, "{" + v + "}"), {v: self.view(v)}
        for t in tables:
            sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
        return self.spark.sql(sql, **tables)

    @cached_property
    def contigs(self) -> DataFrame:
        return self.view("v_contigs")

    @cached_property
    def features(self) -> DataFrame:
        return self.view("v_features")

    @cached_property
    def variants(self) -> DataFrame:
        return self.view("v_variants")

    @cached_property
    def indels(self) -> DataFrame:
        return self.view("v_indels")

    @cached_property
    def sequences(self) -> DataFrame:
        return self.view("v_sequences")

    @cached_property
    def ref_chunks(self) -> DataFrame:
        """The rows of v_ref_chunks: texts are stored once with their lengths, which alone are summed up, over ranges."""
        held = self.sequences.selectExpr("CAST(seq_id % 24 + 1 AS STRING) AS chrom", "seq_id AS chunk_id", "seq").withColumn("n", F.length("seq"))
        held = materialize(held.filter("n > 0"))
        placed = running(held.select("chrom", "chunk_id", "n"), ["chrom"], ["chunk_id"], {"before": ("sum", F.col("n"))})
        placed = placed.select("chunk_id", (F.coalesce("before", F.lit(0)) + 1).cast("long").alias("chunk_start"))
        return held.join(placed.hint("shuffle_hash"), "chunk_id").select("chrom", "chunk_id", "seq", "chunk_start")

    @cached_property
    def exons(self) -> DataFrame:
        return self.view("v_exons")

    @cached_property
    def segments(self) -> DataFrame:
        return self.view("v_segments")

    @cached_property
    def gene_info(self) -> DataFrame:
        return self.view("v_gene_info")

    @cached_property
    def te_names(self) -> DataFrame:
        return self.view("v_te_names")

    @cached_property
    def pwm(self) -> DataFrame:
        return self.view("v_pwm")
