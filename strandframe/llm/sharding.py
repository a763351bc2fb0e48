"""Sharding by jump consistent hashing.

A stable key goes to one of n shards without a ring table; with one more shard, only the 1 / (n + 1) of the keys
that the new shard takes move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, with_lanes


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key (Lamping and Veach, 2014)."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), dtype=np.int64)
    step = np.zeros(len(key), dtype=np.int64)
    going = np.arange(len(key))
    while len(going):
        shard[going] = step[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        step[going] = ((shard[going] + 1) * (float(1 << 31) / ((key[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        going = going[step[going] < shards]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of ``jump``. A null key goes to the shard of key 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.fillna(0).to_numpy(dtype=np.int64), shards).astype(np.int32))

    return place(F.coalesce(key, F.lit(0)))


def shard(rows: DataFrame, shards: int, key: str = "doc_id", order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with shard (0 to shards - 1), slot (gapless from 0 in its shard) and grown_shard (with one more).

    The key's 64-bit hash and the number of shards alone decide the shard, so equal keys, repeated rows and null
    keys (all one key) stay together and an empty table gives an empty one. Slots follow ``order`` within lanes of
    a shard; ties take any order. No task ever holds a whole shard. ``rows`` should be narrow: they are written
    once to the shared folder, to hold slots fixed if an executor is lost. Columns named as the new ones are
    replaced.
    """
    placed = rows.withColumn("_key", F.xxhash64(F.col(key)))
    placed = placed.withColumn("shard", jump_shard(F.col("_key"), shards)).withColumn("grown_shard", jump_shard(F.col("_key"), shards + 1)).drop("_key")
    return numbered(with_lanes(placed), ["shard"], list(order or (key,)), "slot")


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = shard(slim, 40, "doc_id", ("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
