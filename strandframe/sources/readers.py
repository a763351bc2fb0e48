"""Readers of genomic text formats into feature tables.

All but the FASTA reader are column expressions over ``spark.read.text``: lines are split in the JVM, '.', '' and what
does not parse become the column's default. Positions come out 1-based with both ends included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.ordered import running
from strandframe.operators.storage import materialize


@dataclass(frozen=True)
class Field:
    """One column of a delimited file: its type as Spark names it, and what stands for a missing value."""

    name: str
    type: str = "string"
    default: Any = None


def parsed(raw: Column, field: Field) -> Column:
    value = F.when(raw.isin(".", ""), None).otherwise(raw)
    if field.type == "bigint":
        value = value.try_cast("double").try_cast("bigint")
    elif field.type != "string":
        value = value.try_cast(field.type)
    return value if field.default is None else F.coalesce(value, F.lit(field.default))


def tabular(spark: SparkSession, path: str, fields: list[Field | None], sep: str = "\t", comment: str | None = "#", skip_first: bool = False, derived: dict[str, Column] | None = None) -> DataFrame:
    """Delimited lines by position; None skips a column, comment lines and empty ones go. ``skip_first`` drops each
    file's header, told by its text: that of the first column's name. ``derived`` adds columns computed from the others."""
    lines = spark.read.text(path).filter(F.length("value") > 0)
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    cut = F.split("value", sep if len(sep) > 1 else f"[{sep}]" if sep == "|" else sep, -1)
    rows = lines.select(cut.alias("c"))
    out = rows.select(*[parsed(F.get("c", F.lit(i)), f).alias(f.name) for i, f in enumerate(fields) if f])
    if skip_first:
        first = next(f.name for f in fields if f)
        out = rows.filter(F.lower(F.ltrim(F.get("c", F.lit(0)), F.lit("#"))) != first.lower()).select(*[parsed(F.get("c", F.lit(i)), f).alias(f.name) for i, f in enumerate(fields) if f])
    return out.withColumns(derived) if derived else out


def plain_chrom(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def gtf_attributes(raw: Column) -> Column:
    """Map of key to all its values, in order, from ``key "value"; key value;``."""
    keys = F.regexp_extract_all(raw, F.lit(r'(\w+)\s+(?:"[^"]*"|[^;"]+)\s*(?:;|$)'), F.lit(1))
    values = F.transform(F.regexp_extract_all(raw, F.lit(r'\w+\s+("[^"]*"|[^;"]+)\s*(?:;|$)'), F.lit(1)), lambda v: F.trim(F.trim(v), F.lit('"')))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    entry = lambda key: F.struct(key.alias("key"), F.transform(F.filter(pairs, lambda p: p.k == key), lambda p: p.v).alias("value"))
    return F.map_from_entries(F.transform(F.array_distinct(keys), entry))


def _biotype_class(kind: Column, biotype: Column) -> Column:
    """Feature type with its gene's class; nonsense-mediated decay is marked by a suffix."""
    named = (
        F.when(F.contains(biotype, F.lit("pseudogene")), F.lit("pseudogene"))
        .when(biotype.isin("lncRNA", "lincRNA"), F.when(kind == "gene", F.lit("lncRNA")).otherwise(F.concat(F.lit("lncRNA_"), kind)))
        .when(biotype == "miRNA", F.when(kind == "gene", F.lit("miRNA")).otherwise(F.concat(F.lit("miRNA_"), kind)))
        .when(biotype.isin("snRNA", "snoRNA", "scaRNA", "rRNA", "misc_RNA", "vault_RNA", "scRNA", "sRNA"), F.lit("ncRNA"))
        .otherwise(kind)
    )
    return F.when(biotype == "nonsense_mediated_decay", F.concat(kind, F.lit("_NMD"))).otherwise(named)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF rows with gene and transcript columns, a feature type refined by biotype, and a readable name."""
    fields = [Field("chrom"), Field("source", "string", ""), Field("kind"), Field("start_pos", "bigint"), Field("end_pos", "bigint"), Field("score", "double"), Field("strand", "string", "."), Field("frame"), Field("raw")]
    rows = tabular(spark, path, fields).withColumn("attributes", gtf_attributes(F.coalesce("raw", F.lit(""))))
    one = lambda key: F.get(F.try_element_at("attributes", F.lit(key)), F.lit(0))
    biotype = F.coalesce(one("transcript_biotype"), one("gene_biotype"), F.lit(""))
    rows = rows.withColumns({"gene_name": one("gene_name"), "gene_id": one("gene_id"), "transcript_name": one("transcript_name"), "exon_number": one("exon_number").try_cast("int"), "biotype": biotype})
    base, n = F.coalesce("transcript_name", "gene_name", "gene_id"), F.col("exon_number").cast("string")
    suffix = F.when(F.col("kind") == "exon", F.concat(F.lit("-ex"), n)).when(F.col("kind") == "CDS", F.concat(F.lit("-CDS"), n)).when(F.col("kind") == "three_prime_utr", "-3pUTR").when(F.col("kind") == "five_prime_utr", "-5pUTR").when(F.col("kind") == "start_codon", "-start").when(F.col("kind") == "stop_codon", "-stop").otherwise("")
    return rows.withColumns({"chrom": plain_chrom(F.col("chrom")), "feature_type": _biotype_class(F.col("kind"), F.col("biotype")), "name": F.concat(base, F.coalesce(suffix, F.lit("")))}).drop("raw", "frame")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Single-sample variants: alts (longest first), info and sample maps, end, delta and the genotype in bases."""
    fields = [Field("chrom"), Field("pos", "bigint"), Field("id"), Field("ref"), Field("alt"), Field("qual", "double"), Field("filter"), Field("raw_info"), Field("format"), Field("sample")]
    rows = tabular(spark, path, fields)
    written = F.split("alt", ",")
    info = F.transform(F.split(F.coalesce("raw_info", F.lit("")), ";"), lambda x: F.struct(F.split(x, "=", 2)[0].alias("key"), F.get(F.split(x, "=", 2), F.lit(1)).alias("value")))
    sample = F.arrays_zip(F.split(F.coalesce("format", F.lit("")), ":").alias("key"), F.split(F.coalesce("sample", F.lit("")), ":").alias("value"))
    first = lambda pairs: F.map_from_entries(F.filter(pairs, lambda p: p.key.isNotNull() & (p.key != "")))
    rows = rows.withColumns({"info": first(info), "call": first(sample), "alts": F.array_sort(written, lambda a, b: F.length(b) - F.length(a))})
    alleles = F.concat(F.array("ref"), written)
    gt = F.try_element_at("call", F.lit("GT"))
    bases = F.transform(F.split(gt, "[/|]"), lambda i: F.coalesce(F.get(alleles, i.try_cast("int")), F.lit(".")))
    most = F.array_max(F.transform("alts", F.length))
    return rows.withColumns({"chrom": plain_chrom(F.col("chrom")), "end_pos": F.col("pos") + 1, "delta": most - F.length("ref"), "genotype": F.array_join(bases, "/")}).drop("raw_info", "format", "sample", "alt")


BED6 = [Field("chrom"), Field("start_pos", "bigint"), Field("end_pos", "bigint"), Field("name"), Field("score", "double"), Field("strand", "string", ".")]


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Six-column BED without track and browser lines; positions as they stand."""
    return tabular(spark, path, BED6).filter(~F.col("chrom").rlike("^(track|browser)\\b")).withColumn("chrom", plain_chrom(F.col("chrom")))


def read_repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    fields = [Field("chrom"), Field("start_pos", "bigint"), Field("end_pos", "bigint"), Field("name"), Field("repeat_type"), Field("strand")]
    return tabular(spark, path, fields).withColumn("strand", F.when(F.col("strand") == "C", "-").otherwise(F.col("strand"))).withColumn("chrom", plain_chrom(F.col("chrom")))


def simple_repeats(repeats: DataFrame) -> DataFrame:
    """Simple repeats with the motif inside ``(motif)n`` and how often it fits."""
    motif = F.regexp_extract("name", r"^\(([^)]*)\)n", 1)
    out = repeats.filter("repeat_type = 'Simple_repeat'").withColumn("motif", motif)
    return out.withColumn("repeat_count", F.try_divide(F.col("end_pos") - F.col("start_pos"), F.length("motif")))


def read_dfam(spark: SparkSession, path: str) -> DataFrame:
    names = {"chrom": "string", "start_pos": "bigint", "end_pos": "bigint", "name": "string", "bits": "double", "strand": "string", "id": "string", "e_value": "double", "bias": "double", "start_hmm": "bigint", "end_hmm": "bigint", "start_ali": "bigint", "end_ali": "bigint", "sq_len": "bigint", "kimura_div": "double"}
    return tabular(spark, path, [Field(n, t) for n, t in names.items()]).withColumn("chrom", plain_chrom(F.col("chrom")))


def read_clinvar(spark: SparkSession, path: str) -> DataFrame:
    names = ["id", "ref", "alt", "clnsig", "clndn", "loc", "clnvc", "af_esp", "af_exac", "af_tgp", "clndnincl", "mc"]
    rows = tabular(spark, path, [Field("chrom"), Field("start_pos", "bigint"), Field("end_pos", "bigint"), *[Field(n) for n in names]])
    share = lambda c: F.regexp_replace(c, "^[A-Z]+=", "").try_cast("double")
    return rows.withColumns({"gene_name": F.split("loc", ":")[0], "is_pathogenic": F.contains(F.lower(F.coalesce("clnsig", F.lit(""))), F.lit("pathogenic")), **{c: share(F.col(c)) for c in ("af_esp", "af_exac", "af_tgp")}})


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    fields = [Field("chrom"), Field("start_pos", "bigint"), Field("end_pos", "bigint"), Field("id"), Field("type"), Field("name"), Field("strand"), Field("mean_exp", "double"), Field("total_exp", "double"), Field("num_experiments", "bigint"), Field("num_expressed", "bigint")]
    return tabular(spark, path, fields, skip_first=True)


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peak calls: 0-based starts are moved to 1-based ones."""
    return read_bed(spark, path).withColumn("start_pos", F.col("start_pos") + 1)


def read_rmsk(spark: SparkSession, path: str) -> DataFrame:
    """The 17-column repeat dump with 0-based starts."""
    fields = [None] * 5 + [Field("chrom"), Field("start_pos", "bigint"), Field("end_pos", "bigint"), None, Field("strand"), Field("name"), Field("repeat_class"), Field("repeat_family")]
    return tabular(spark, path, fields).withColumn("start_pos", F.col("start_pos") + 1).withColumn("chrom", plain_chrom(F.col("chrom")))


def read_gene_info(spark: SparkSession, path: str) -> DataFrame:
    fields = [Field("tax_id", "bigint"), Field("gene_id", "bigint"), Field("name"), Field("locus_tag"), Field("synonyms")]
    return tabular(spark, path, fields).withColumn("synonyms", F.when(F.col("synonyms").isNotNull(), F.split("synonyms", "[|]")))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster assignment records: S starts a cluster, H joins one; C summaries go."""
    fields = [Field("record"), Field("cluster", "bigint"), Field("length", "bigint"), Field("identity", "double"), Field("strand"), None, None, None, Field("query"), Field("target")]
    rows = tabular(spark, path, fields).filter(F.col("record").isin("S", "H"))
    return rows.select("cluster", "query", "length", F.when(F.col("record") == "S", 100.0).otherwise(F.col("identity")).alias("identity"), "strand", F.when(F.col("record") == "S", F.col("query")).otherwise(F.col("target")).alias("centroid"))


def header_place(header: Column) -> list[Column]:
    """chrom, start_pos, end_pos and strand of ``name chrom:start-end(strand)`` or ``name|chrom|start|end|strand``."""
    pattern, pipe = r"(\S+):(\d+)-(\d+)(?:\(([+-])\))?", F.split(header, "[|]")
    found = header.rlike(pattern)
    part = lambda i: F.when(found, F.nullif(F.regexp_extract(header, pattern, i), F.lit(""))).otherwise(F.get(pipe, F.lit(i)))
    return [part(1).alias("chrom"), part(2).try_cast("bigint").alias("start_pos"), part(3).try_cast("bigint").alias("end_pos"), part(4).alias("strand")]


def _fragments(lines: DataFrame) -> DataFrame:
    """(file, block, line, header, seq): lines (file, block, line, value) of one record that a batch holds end to end, as
    one text. A fragment that begins with its record's header has it; in one that goes on from an earlier one it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, line, value = batch.columns
            texts = value.to_pylist()
            head = pc.starts_with(value, ">").to_numpy(zero_copy_only=False)
            other = file.dictionary_encode().indices.to_numpy(), block.to_numpy()
            new = head.copy()
            new[0] = True
            new[1:] |= (other[0][1:] != other[0][:-1]) | (other[1][1:] != other[1][:-1])
            starts = np.flatnonzero(new)
            headers, seqs = [], []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(texts)]):
                headers.append(texts[i][1:].strip() if head[i] else None)
                seqs.append("".join("".join(texts[i + int(head[i]) : j]).split()).upper())
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([file.take(at), block.take(at), line.take(at), pa.array(headers, pa.string()), pa.array(seqs, pa.string())], ["file", "block", "line", "header", "seq"])

    return lines.select("file", "block", "line", "value").mapInArrow(run, "file string, block long, line long, header string, seq string")


def read_fasta(spark: SparkSession, path: str, chunk: int = 65_536) -> DataFrame:
    """FASTA as (name, header, chunk_id, chunk_start, seq): upper-cased chunks of ``chunk`` bases.

    Files are read by byte ranges, so a record may lie over any number of tasks and be of any length; only a line must
    fit a row. What a batch holds of a record is one fragment, stored once; which record a fragment belongs to and where in
    it comes from running sums over fragments without their bases. Fragments are then cut at chunk borders and met by
    chunk. A header is a line that begins with '>'; white space within sequences goes, lines before a file's first header
    are of no record, a record without bases has no chunks. Records of one name in one or more files stay apart by header
    alone, as their chunks do not tell files.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    key = ["file", "block", "line"]
    stored = materialize(_fragments(lines).filter("header is not null or seq <> ''"))
    light = stored.select(*key, "header", F.length("seq").cast("long").alias("n"), F.col("header").isNotNull().cast("long").alias("_first"))
    sums = running(light, ["file"], ["block", "line"], {"_record": ("sum", F.col("_first")), "_before": ("sum", F.col("n"))})
    placed = sums.select(*key, "header", "n", (F.coalesce("_record", F.lit(0)) + F.col("_first")).alias("record"), F.coalesce("_before", F.lit(0)).alias("before"))
    heads = placed.filter("header is not null").select("file", "record", "header", F.col("before").alias("begin"))
    placed = placed.filter("n > 0").drop("header").join(heads, ["file", "record"]).select(*key, "record", "header", (F.col("before") - F.col("begin")).alias("at"))
    held = stored.select(*key, "seq").join(placed.hint("shuffle_hash"), key)
    of = lambda x: F.floor(x / chunk)
    skipped = lambda c: F.greatest(c * chunk - F.col("at"), F.lit(0))
    upto = lambda c: F.least((c + 1) * chunk - F.col("at"), F.length("seq").cast("long"))
    slices = F.transform(F.sequence(of(F.col("at")), of(F.col("at") + F.length("seq") - 1)), lambda c: F.struct(c.alias("chunk"), (F.col("at") + skipped(c)).alias("from"), F.substr(F.col("seq"), (skipped(c) + 1).cast("int"), (upto(c) - skipped(c)).cast("int")).alias("text")))
    cut = held.select("file", "record", "header", F.inline(slices))
    met = cut.groupBy("file", "record", "chunk").agg(F.first("header").alias("header"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from", "text"))), lambda p: p["text"]), "").alias("seq"))
    return met.select(F.split("header", r"\s|\|")[0].alias("name"), "header", F.col("chunk").cast("int").alias("chunk_id"), (F.col("chunk") * chunk + 1).alias("chunk_start"), "seq")


def fasta_references(chunks: DataFrame) -> DataFrame:
    """(name, header, length) of each record of ``read_fasta``; lengths are those up to the last chunk's end."""
    ends = F.col("chunk_start") + F.length("seq") - 1
    return chunks.groupBy("name", "header").agg(F.max(ends).cast("long").alias("length"))


def read_region(spark: SparkSession, path: str, name: str, start: int, end: int, chunk: int = 65_536) -> DataFrame:
    """One row (name, start_pos, end_pos, seq): bases ``start`` to ``end`` of a record that ``write_chunks`` stored in chunks of
    ``chunk``; less where the record ends, none where it has no base there. The filters on name and chunk_start
    reach the scan, and chunks lie in their order, so only row groups that hold the region are read. The region is one row."""
    near = spark.read.parquet(path).filter((F.col("name") == name) & (F.col("chunk_start") > start - chunk) & (F.col("chunk_start") <= end))
    low = F.greatest(F.lit(start) - F.col("chunk_start"), F.lit(0))
    bases = F.substr(F.col("seq"), (low + 1).cast("int"), (F.lit(end) - F.col("chunk_start") + 1 - low).cast("int"))
    parts = near.select("chunk_start", bases.alias("text")).filter("text <> ''")
    row = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_start", "text"))), lambda p: p["text"]), "").alias("seq"))
    first = F.lit(max(1, start)).cast("long")
    return row.filter("seq <> ''").select(F.lit(name).alias("name"), first.alias("start_pos"), (first + F.length("seq") - 1).alias("end_pos"), "seq")


def read_jaspar(spark: SparkSession, path: str, pseudocount: float = 0.0) -> DataFrame:
    """Count matrices in long form: motif_id, motif_name, pos, base, cnt. Records without all four bases go."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    head = F.split(F.split("value", "\n", 2)[0], r"\s+")
    lines = F.regexp_extract_all("value", F.lit(r"(?m)^\s*([ACGT])\s*\["), F.lit(1))
    rows = records.select(head[0].alias("motif_id"), F.get(head, F.lit(1)).alias("motif_name"), F.arrays_zip(lines.alias("base"), F.regexp_extract_all("value", F.lit(r"(?m)^\s*[ACGT]\s*\[([^\]]*)\]"), F.lit(1)).alias("counts")).alias("m"))
    rows = rows.filter(F.size("m") == 4).select("motif_id", "motif_name", F.inline("m"))
    return rows.select("motif_id", "motif_name", "base", F.posexplode(F.split(F.trim("counts"), r"\s+")).alias("pos", "c")).select("motif_id", "motif_name", "pos", "base", (F.col("c").try_cast("double") + pseudocount).alias("cnt"))


def read_lncrna(spark: SparkSession, path: str) -> DataFrame:
    """Long non-coding RNA table: name, name_tag, parent_feature and info from a '|' list, read_types from a comma list, data
    from two comma lists as pairs, with those left out where either is missing."""
    kinds = {"chrom": "string", "start_pos": "bigint", "end_pos": "bigint", "info1": "string", "number1": "bigint", "strand": "string", "match_start": "bigint", "match_end": "bigint", "read_types": "string", "num_records": "bigint", "data1": "string", "data2": "string"}
    part = lambda i: F.get(F.split("info1", "[|]", -1), F.lit(i))
    numbers = lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("bigint"))
    both = F.arrays_zip(numbers("data1").alias("a"), numbers("data2").alias("b"))
    derived = {
        "name": part(0), "name_tag": F.regexp_replace(part(0), "^hsa-lncRNA", ""), "parent_feature": F.when(part(1) != "-", part(1)).otherwise(""), "info": F.when(part(2) != "-", part(2)).otherwise(""),
        "data": F.filter(both, lambda p: p["a"].isNotNull() & p["b"].isNotNull()),
    }
    out = tabular(spark, path, [Field(n, t) for n, t in kinds.items()], derived=derived).drop("info1", "data1", "data2")
    return out.withColumn("read_types", numbers("read_types")).withColumn("chrom", plain_chrom(F.col("chrom")))


def read_pirna(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"chrom": "string", "start_pos": "bigint", "end_pos": "bigint", "name": "string", "num": "bigint", "strand": "string"}
    return tabular(spark, path, [Field(n, t) for n, t in kinds.items()], derived={"feature_type": F.lit("piRNA_hit")}).withColumn("chrom", plain_chrom(F.col("chrom")))


CORE_TYPES = {"chrom": "string", "start_pos": "bigint", "end_pos": "bigint", "score": "double"}


def read_dataset(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Feature table that ``write_features`` wrote as text, by its column list: core columns typed, all others strings."""
    return tabular(spark, path, [Field(n, CORE_TYPES.get(n, "string")) for n in columns], comment=None, skip_first=True)


def read_by_class(spark: SparkSession, path: str, by: str, classes: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """What ``write_by_class`` wrote; with ``classes`` only their folders are read."""
    rows = spark.read.format(fmt).load(path)
    return rows.filter(F.col(by).isin(classes)) if classes is not None else rows


def first_rows(features: DataFrame, n: int, chrom: str | None = None) -> DataFrame:
    """The first ``n`` features by place, of one chromosome if asked for; each partition keeps its own first ``n`` only."""
    rows = features.filter(F.col("chrom") == chrom) if chrom is not None else features
    return rows.orderBy("chrom", "start_pos", "end_pos").limit(n)
