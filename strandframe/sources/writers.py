"""Writers of feature tables and FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.sequences import apply_variants

CORE = ["chrom", "start_pos", "end_pos", "feature_type", "source", "score", "strand", "name", "id"]


def ordered_columns(df: DataFrame) -> list[str]:
    """Core columns first, then the others by name."""
    return [c for c in CORE if c in df.columns] + sorted(c for c in df.columns if c not in CORE)


def write_features(df: DataFrame, path: str, fmt: str = "parquet", partitions: int | None = None, overwrite: bool = False) -> None:
    """Features sorted by position over range partitions; text has '.' for null and six digits for numbers."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*ordered_columns(df)).repartitionByRange(n, "chrom", "start_pos").sortWithinPartitions("chrom", "start_pos", "end_pos")
    mode = "overwrite" if overwrite else "errorifexists"
    if fmt == "parquet":
        rows.write.mode(mode).parquet(path)
    else:
        text = [F.format_string("%.6g", F.col(c)).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) for c, t in rows.dtypes]
        rows.select(*[F.when(F.col(c).isNull(), F.lit(None)).otherwise(x).alias(c) for c, x in zip(rows.columns, text)]).write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", ".").csv(path)


def write_fasta(df: DataFrame, path: str, width: int = 80, overwrite: bool = False) -> None:
    """Rows with name and seq, and optionally chrom, start_pos, end_pos and strand, as FASTA records."""
    head = [F.col("name")]
    if "chrom" in df.columns:
        head.append(F.concat("chrom", F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string"), F.lit("("), F.coalesce("strand", F.lit(".")), F.lit(")")))
    body = F.array_join(F.regexp_extract_all("seq", F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")
    df.select(F.concat(F.lit(">"), F.concat_ws(" ", *head), F.lit("\n"), body).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_chunks(chunks: DataFrame, path: str, partitions: int | None = None, row_group: int = 1 << 20, overwrite: bool = False) -> None:
    """Chunks of ``read_fasta`` dealt by range over name and place and sorted, in small row groups, so that a read of one
    region opens the files that hold it alone and in them a few row groups."""
    n = partitions or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.repartitionByRange(n, "name", "chunk_start").sortWithinPartitions("name", "chunk_start")
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("parquet.block.size", row_group).parquet(path)


def write_by_class(df: DataFrame, path: str, by: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """One folder for each class, so that a reader of one class reads only its files."""
    df.repartition(by, F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(32))).write.partitionBy(by).mode("overwrite" if overwrite else "errorifexists").format(fmt).save(path)


def write_personal_fasta(regions: DataFrame, variants: DataFrame, path: str, include_reference: bool = True, overwrite: bool = False) -> None:
    """FASTA of regions (seq_id, name, chrom, start_pos, seq) with the variants in them put in, as name_personal, and as they
    stand as name_reference. Ids must be unique."""
    personal = apply_variants(regions.select("seq_id", "chrom", "start_pos", "seq"), variants).select("seq_id", "personal")
    rows = regions.join(personal, "seq_id").select(F.concat("name", F.lit("_personal")).alias("name"), F.col("personal").alias("seq"))
    if include_reference:
        rows = rows.unionByName(regions.select(F.concat("name", F.lit("_reference")).alias("name"), "seq"))
    write_fasta(rows, path, overwrite=overwrite)
