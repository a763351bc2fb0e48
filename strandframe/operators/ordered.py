"""Running sums and maxima over ordered rows of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

KINDS = {"sum": F.sum, "max": F.max}


def dealt(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``rows`` dealt by range over (groups, order) and stored, with _range, the number of their range."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(rows.repartitionByRange(n, *groups, *order).withColumn("_range", F.spark_partition_id()))


def carried(stored: DataFrame, groups: list[str], order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``running`` over rows that ``dealt`` has placed by these groups, or by the first of them, and this order."""
    valued = stored.withColumns({f"_v_{k}": c for k, (_, c) in values.items()})
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = valued.groupBy(*groups, "_range").agg(*[KINDS[kind](f"_v_{k}").alias(f"_t_{k}") for k, (kind, _) in values.items()])
    totals = totals.withColumns({f"_t_{k}": KINDS[kind](f"_t_{k}").over(earlier) for k, (kind, _) in values.items()})
    before = Window.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = valued.withColumns({f"_b_{k}": KINDS[kind](f"_v_{k}").over(before) for k, (kind, _) in values.items()})
    joined = local.join(totals, [*groups, "_range"])

    def both(k: str, kind: str) -> Column:
        a, b = F.col(f"_b_{k}"), F.col(f"_t_{k}")
        return F.greatest(a, b) if kind == "max" else F.coalesce(a + b, a, b)

    out = joined.withColumns({k: both(k, kind) for k, (kind, _) in values.items()})
    return out.drop("_range", *[f"_{x}_{k}" for k in values for x in "vtb"])


def running(rows: DataFrame, groups: list[str], order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with each value's sum or max over the rows before it, within ``groups`` and by ``order``.

    ``values`` maps a new column to ("sum" or "max", expression). The first row of a group has null. A group may hold
    any share of the rows: rows are dealt by range over (groups, order) and stored; each range runs by itself, and the
    group's earlier ranges come in as one value each. ``order`` must tell the rows of a group apart.
    """
    named = rows.withColumns({f"_w_{k}": c for k, (_, c) in values.items()})
    stored = dealt(named, groups, order)
    return carried(stored, groups, order, {k: (kind, F.col(f"_w_{k}")) for k, (kind, _) in values.items()}).drop(*[f"_w_{k}" for k in values])
