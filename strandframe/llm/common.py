"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.operators.storage import materialize, materialize_bucketed, shared_dir, tidy

__all__ = ["ascii_lower", "byte_slices", "give_back", "materialize", "materialize_bucketed", "numbered", "shared_dir", "table", "tasks_for", "tidy", "with_lanes"]

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def ascii_lower(column):
    """A-Z become a-z; other letters stay."""
    return F.translate(column, UPPER, UPPER.lower())


def tasks_for(spark: SparkSession) -> int:
    """Partitions of the stages that deal rows out by hand: what the session uses for shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_lanes(df: DataFrame, lanes: int = 1024) -> DataFrame:
    """Store ``df`` with a column _lane that deals its rows evenly, whatever they hold."""
    return materialize(df.withColumn("_lane", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)).cast("int")))


def numbered(laned: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... without gaps within each combination of ``groups`` (no nulls in them).

    One combination may hold any share of the rows: rows are ranked within (groups, _lane) and shifted by the rows
    of the lanes before, so no task holds a combination. ``laned`` comes from ``with_lanes``; being stored, it
    gives the same ranks when a lost executor's work is done again. Order in a lane follows ``order``.
    """
    counts = laned.groupBy(*groups, "_lane").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*groups, "_lane").orderBy(*order)
    ranked = laned.withColumn("_rank", F.row_number().over(within))
    return ranked.join(starts, [*groups, "_lane"]).withColumn(name, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_lane", "_rank", "_start")


def give_back() -> None:
    """Return memory that Arrow and the allocator keep for later: a worker that waits for its next task, of whatever
    kind, should not hold what its last one needed."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def byte_slices(column, most: int = 8 << 20):
    """(start, length) of consecutive slices of an Arrow text column, each of one text or of at most ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield at, to - at
        at = to
