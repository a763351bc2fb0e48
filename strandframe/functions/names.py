"""Parsing of family names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def te_parts(rows: DataFrame, name: str = "name") -> DataFrame:
    """``rows`` with family, subfamily and suffix of a repeat's name; null where a part is missing."""
    n = F.col(name)
    family = F.when(n.startswith("Alu"), "Alu").when(n.startswith("L1"), "L1").otherwise(F.regexp_extract(n, "^([A-Za-z]+)", 1))
    sub = F.regexp_extract(n, "^(?:Alu|L1|[A-Za-z]+_?)([A-Z]{1,2}[a-z]?|[A-Z]?[0-9]+)?", 1)
    end = F.regexp_extract(n, "_([0-9]end)$", 1)
    return rows.withColumn("family", family).withColumn("subfamily", F.nullif(sub, F.lit(""))).withColumn("suffix", F.nullif(end, F.lit("")))


def prefixes(rows: DataFrame, name: str = "name") -> DataFrame:
    """One row for each prefix, with the letter that follows it ('' at the end)."""
    k = F.explode(F.sequence(F.lit(1), F.length(name))).alias("k")
    cut = rows.filter(F.length(name) > 0).select("*", k)
    return cut.withColumn("prefix", F.substr(F.col(name), F.lit(1), F.col("k"))).withColumn("next", F.substr(F.col(name), F.col("k") + 1, F.lit(1))).drop("k")
