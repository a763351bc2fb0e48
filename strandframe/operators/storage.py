"""Tables that outlive a stage: written to the folder all executors share, then read back."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_SCRATCH = "/tmp/strandframe-scratch"
_written: list[list[str]] = []  # tables written within each ``recorded`` block that is open


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is named and all runs on
    one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is removed when the session ends."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that every executor can read, so a lost executor costs no recomputation, and
    fixes values such as monotonically_increasing_id(). Spark removes the files when its session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for block in _written:
        block.append(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``materialize`` as a table bucketed by ``key``: joins on it with as many partitions do not shuffle the table again."""
    return materialize_parts([df], key, buckets)


def materialize_parts(parts: Iterable[DataFrame], key: str, buckets: int) -> DataFrame:
    """``materialize_bucketed`` of one or more ``parts`` as one table. A part is written and its shuffle files let go before the next is asked for."""
    path = None
    for df in parts:
        if path is None:
            spark, name = df.sparkSession, uuid.uuid4().hex
            path = f"{shared_dir(spark)}/tables/{name}"
        df.write.option("path", path).mode("append").bucketBy(buckets, key).saveAsTable(f"strandframe_{name}")
        del df
        tidy(spark)
    for block in _written:
        block.append(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.table(f"strandframe_{name}")


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are written within the block."""
    paths: list[str] = []
    _written.append(paths)
    try:
        yield paths
    finally:
        _written[:] = [x for x in _written if x is not paths]  # an outer block may have written the same so far


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that nothing will read again."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files of DataFrames that are gone. Spark removes them when the driver's collector finds that,
    which on a driver with little garbage may be long after a large job."""
    gc.collect()
    spark._jvm.System.gc()
