"""Filters, joins and folds of closed intervals (1-based, both ends included) by chromosome.

Interval tables have chrom, start_pos and end_pos. Joins cut positions into bins, so that they are hash joins on
(chrom, bin); a pair is kept in the one bin where the later of the two starts lies.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running
from .storage import materialize

BIN = 4096
LEVELS = 64  # ranks taken one after the other
STRETCH = 1 << 16  # positions of a stretch whose whole islands are decided where they lie
CROWDED = 1 << 18  # rows of a stretch beyond which it is left to the general way


def region(features: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Features that overlap a closed region; an open end reaches to the chromosome's end."""
    out = features.filter(F.col("chrom") == chrom)
    if end is not None:
        out = out.filter(F.col("start_pos") <= end)
    return out.filter(F.col("end_pos") >= start) if start is not None else out


def at_point(features: DataFrame, chrom: str, pos: int, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Distinct features (by place and type) that cover a position; no ``include`` means every type."""
    out = region(features, chrom, pos, pos)
    if include:
        out = out.filter(F.col("feature_type").isin(include))
    if exclude:
        out = out.filter(~F.col("feature_type").isin(exclude))
    return out.dropDuplicates(["chrom", "start_pos", "end_pos", "feature_type"])


def _binned(rows: DataFrame, start: Column, end: Column, size: int) -> DataFrame:
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(start / size), F.floor(end / size))))


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", size: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals on one chromosome, columns prefixed a_ and b_. Rows with a null end or an end
    before the start match nothing. ``how``: inner, or left to keep what has no partner (by one more join)."""
    a, b = _prefixed(left, "a_"), _prefixed(right, "b_")
    if how == "left":
        a = materialize(a.withColumn("_row", F.monotonically_increasing_id()))
    x = _binned(a.filter("a_end_pos >= a_start_pos"), F.col("a_start_pos"), F.col("a_end_pos"), size)
    y = _binned(b.filter("b_end_pos >= b_start_pos"), F.col("b_start_pos"), F.col("b_end_pos"), size).withColumnRenamed("_bin", "_bin_b")
    on = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("_bin") == F.col("_bin_b")) & (F.col("a_start_pos") <= F.col("b_end_pos")) & (F.col("a_end_pos") >= F.col("b_start_pos"))
    once = F.col("_bin") == F.floor(F.greatest("a_start_pos", "b_start_pos") / size)
    pairs = x.join(y, on & once).drop("_bin", "_bin_b")
    if how == "inner":
        return pairs
    alone = a.join(pairs.select("_row"), "_row", "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True).drop("_row")


def point_join(points: DataFrame, features: DataFrame, pos: str = "pos", size: int = BIN) -> DataFrame:
    """Points (chrom, pos) with each feature that covers them; only the features are cut into bins."""
    a = _prefixed(points, "a_").withColumn("_bin", F.floor(F.col(f"a_{pos}") / size))
    b = _binned(_prefixed(features, "b_").filter("b_end_pos >= b_start_pos"), F.col("b_start_pos"), F.col("b_end_pos"), size).withColumnRenamed("_bin", "_bin_b")
    inside = F.col(f"a_{pos}").between(F.col("b_start_pos"), F.col("b_end_pos"))
    return a.join(b, (F.col("a_chrom") == F.col("b_chrom")) & (F.col("_bin") == F.col("_bin_b")) & inside).drop("_bin", "_bin_b")


def covering_counts(points: DataFrame, features: DataFrame, pos: str = "pos") -> DataFrame:
    """``points`` with n_features, how many features cover each. Points are told apart as rows, so equal ones keep theirs."""
    rows = materialize(points.withColumn("_row", F.monotonically_increasing_id()))
    hits = point_join(rows.select("chrom", pos, "_row"), features.select("chrom", "start_pos", "end_pos"), pos)
    counts = hits.groupBy(F.col("a__row").alias("_row")).agg(F.count(F.lit(1)).alias("n_features"))
    return rows.join(counts, "_row", "left").drop("_row").withColumn("n_features", F.coalesce("n_features", F.lit(0)))


def containment_join(outer: DataFrame, inner: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs where the first interval contains the second; ``strict`` asks for room at both ends."""
    pairs = overlap_join(outer, inner)
    if strict:
        return pairs.filter("a_start_pos < b_start_pos and a_end_pos > b_end_pos")
    return pairs.filter("a_start_pos <= b_start_pos and a_end_pos >= b_end_pos")


def nearest(points: DataFrame, features: DataFrame, max_distance: int | None = None) -> DataFrame:
    """Points (chrom, pos) with prev_end, the greatest end before them, and next_start, the least start after them,
    and the distances to both; null where there is none or it is farther than ``max_distance``.

    Points and features are one ordered table, of which running maxima are taken in both directions.
    """
    p = points.select("chrom", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("edge"))
    ends = features.select("chrom", F.col("end_pos").alias("at"), F.lit(2).alias("kind"), F.col("end_pos").alias("edge"))
    starts = features.select("chrom", F.col("start_pos").alias("at"), F.lit(2).alias("kind"), F.col("start_pos").alias("edge"))
    tie = F.monotonically_increasing_id()
    left = running(p.union(ends).withColumn("_tie", tie), ["chrom"], ["at", "kind", "_tie"], {"prev_end": ("max", F.col("edge"))})
    flipped = p.union(starts).withColumn("at", -F.col("at")).withColumn("_tie", tie)
    right = running(flipped, ["chrom"], ["at", "kind", "_tie"], {"next_start": ("max", -F.col("edge"))})
    before = left.filter("kind = 1").select("chrom", F.col("at").alias("pos"), "prev_end").distinct()
    after = right.filter("kind = 1").select("chrom", (-F.col("at")).alias("pos"), (-F.col("next_start")).alias("next_start")).distinct()
    out = points.join(before, ["chrom", "pos"], "left").join(after, ["chrom", "pos"], "left")
    if max_distance is not None:
        out = out.withColumn("prev_end", F.when(F.col("pos") - F.col("prev_end") <= max_distance, F.col("prev_end")))
        out = out.withColumn("next_start", F.when(F.col("next_start") - F.col("pos") <= max_distance, F.col("next_start")))
    return out.withColumn("prev_distance", F.col("pos") - F.col("prev_end")).withColumn("next_distance", F.col("next_start") - F.col("pos"))


def coalesce_intervals(features: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """Islands of intervals that overlap or lie at most ``gap`` apart, by ``keys``: start_pos, end_pos, n."""
    rows = features.select(*keys, "start_pos", "end_pos").withColumn("_tie", F.monotonically_increasing_id())
    order = ["start_pos", "end_pos", "_tie"]
    led = running(rows, keys, order, {"_reach": ("max", F.col("end_pos"))})
    led = led.withColumn("_new", F.coalesce((F.col("start_pos") > F.col("_reach") + gap).cast("int"), F.lit(1)))
    numbered = running(led, keys, order, {"_before": ("sum", F.col("_new"))})
    island = F.coalesce("_before", F.lit(0)) + F.col("_new")
    return numbered.groupBy(*keys, island.alias("_island")).agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n")).drop("_island")


def density(features: DataFrame, contigs: DataFrame, window: int) -> DataFrame:
    """Features that touch each window of each contig, over the window's length; empty windows included."""
    grid = contigs.withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / window))))
    touched = features.filter("end_pos >= start_pos").withColumn("win", F.explode(F.sequence(F.floor((F.col("start_pos") - 1) / window), F.floor((F.col("end_pos") - 1) / window))))
    counts = touched.groupBy("chrom", "win").agg(F.count(F.lit(1)).alias("n"))
    return grid.select("chrom", "win").join(counts, ["chrom", "win"], "left").select("chrom", "win", (F.col("win") * window + 1).alias("win_start"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.lit(float(window))).alias("density"))


def _general(features: DataFrame) -> DataFrame:
    """``greedy_non_overlap`` of islands of any size, from its rows.

    Ranks are few: each in turn loses what overlaps the kept ones before it, and a pass along the line chooses among the
    rest. With more than LEVELS ranks the choice is made in rounds over all overlapping pairs instead. No task holds an
    island.
    """
    from .priority import along_the_line, left_out

    cols, ties = ["chrom", "start_pos", "end_pos", "feature_type", "name", "rank"], ("feature_type", "name")
    rows = materialize(features.select(*cols).withColumn("_id", F.monotonically_increasing_id()))
    levels = [r[0] for r in rows.select("rank").distinct().limit(LEVELS + 1).collect()]
    if len(levels) > LEVELS:
        pairs = overlap_join(rows, rows).filter("a__id <> b__id")
        at = lambda s: F.struct(F.col(f"{s}_rank").isNull().alias("last"), *[F.col(f"{s}_{c}").alias(c) for c in ("rank", "start_pos", "end_pos", *ties, "_id")])
        ordered = pairs.filter(at("a") < at("b")).select(F.col("a__id").alias("first"), F.col("b__id").alias("then"))
        return rows.join(left_out(ordered).withColumnRenamed("node", "_id"), "_id", "left_anti").select(*cols)
    kept = None
    for level in sorted(levels, key=lambda x: (x is None, x)):
        own = rows.filter(F.col("rank").eqNullSafe(F.lit(level)))
        if kept is not None:
            hit = overlap_join(own.select("chrom", "start_pos", "end_pos", "_id"), kept.select("chrom", "start_pos", "end_pos")).select(F.col("a__id").alias("_id"))
            own = own.join(hit, "_id", "left_anti")
        chosen = along_the_line(own.select(*cols), ties=ties)
        kept = materialize(chosen if kept is None else kept.union(chosen.select(*cols)))
    return kept.select(*cols) if kept is not None else rows.select(*cols)


def _taken(rank: list, start: list, end: list) -> list[int]:
    """What a greedy pass takes of one island, whose rows come by (start, end, ties)."""
    begins, ends, out = [], [], []
    for i in sorted(range(len(rank)), key=lambda i: (rank[i] is None, rank[i] != rank[i], rank[i])):
        at = bisect_left(ends, start[i])  # the first one taken that does not end before this begins
        if at == len(ends) or begins[at] > end[i]:
            begins.insert(at, start[i])
            ends.insert(at, end[i])
            out.append(i)
    return out


def _decided(part: pa.Table, stretch: int) -> pa.Table:
    """The rows of whole stretches that are kept for certain or still open (_open). Each stretch has first its mark, whose
    end is how far the stretches before reach; an island is open if these reach it, or if it reaches the next stretch."""
    mark = part.column("_kind").to_numpy() == 0
    base = part.column("_stretch").to_numpy() * stretch
    begin, end = part.column("start_pos").to_numpy(), part.column("end_pos").to_numpy()
    width = stretch + 2
    shift = np.cumsum(mark) * width
    reach = np.maximum.accumulate(np.clip(end - base, -1, stretch) + shift)
    first = mark | np.r_[True, begin[1:] - base[1:] + shift[1:] > reach[:-1]]
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(first)])
    last = at + size - 1
    open_ = mark[at] | (reach[last] - shift[last] >= stretch)
    keep = np.repeat(open_, size) & ~mark
    keep[at[(size == 1) & ~open_]] = True
    undecided = np.repeat(open_, size)
    many = np.flatnonzero((size > 1) & ~open_)
    if len(many):
        rows = np.flatnonzero(np.repeat((size > 1) & ~open_, size))
        rank = part.column("rank").take(pa.array(rows)).to_pylist()
        starts, ends, k = begin[rows].tolist(), end[rows].tolist(), 0
        for i in many.tolist():
            n = int(size[i])
            keep[at[i] + np.array(_taken(rank[k : k + n], starts[k : k + n], ends[k : k + n]))] = True
            k += n
    out = part.append_column("_open", pa.array(undecided)).filter(pa.array(keep))
    return out.drop_columns(["_stretch", "_kind"])


def _settled(rows: DataFrame) -> DataFrame:
    """Rows (chrom, start_pos, end_pos, feature_type, name, rank) that a greedy pass keeps for certain, and those that must be
    looked at further (_open), stored. Chromosomes are cut into stretches; a stretch is streamed in order by one task and
    an island that lies in one, away from what reaches in or on, is decided there. Islands over borders and crowded
    stretches stay open as a whole."""
    cols, stretch = rows.columns, STRETCH
    placed = rows.withColumn("_stretch", F.floor(F.col("start_pos") / stretch))
    counted = placed.groupBy("chrom", "_stretch").agg(F.max("end_pos").alias("_reach"), F.count(F.lit(1)).alias("_n"))
    # one row a stretch, so a chromosome's are few
    before = Window.partitionBy("chrom").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    marks = materialize(counted.withColumn("_before", F.max("_reach").over(before)))
    crowded = marks.filter(F.col("_n") > CROWDED).select("chrom", "_stretch")
    aside = None
    if not crowded.isEmpty():
        aside = placed.join(F.broadcast(crowded), ["chrom", "_stretch"], "left_semi").select(*cols, F.lit(True).alias("_open"))
        placed = placed.join(F.broadcast(crowded), ["chrom", "_stretch"], "left_anti")
    marks = marks.filter(F.col("_n") <= CROWDED)
    kinds = dict(rows.dtypes)
    blank = {"start_pos": F.col("_stretch") * stretch, "end_pos": F.coalesce("_before", F.col("_stretch") * stretch - 1), "chrom": F.col("chrom")}
    marked = marks.select(*[blank.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in cols], "_stretch", F.lit(0).alias("_kind"))
    both = placed.select(*cols, "_stretch", F.lit(1).alias("_kind")).union(marked)
    order = ["chrom", "_stretch", "_kind", "start_pos", "end_pos", "feature_type", "name"]

    def decide(batches):
        held: list[pa.RecordBatch] = []  # from the last mark on; a stretch is at most CROWDED rows
        for batch in batches:
            marks_at = np.flatnonzero(batch.column(len(cols) + 1).to_numpy() == 0)
            if len(marks_at):
                cut = int(marks_at[-1])
                whole = [*held, batch.slice(0, cut)]
                if sum(b.num_rows for b in whole):
                    yield from _decided(pa.Table.from_batches(whole), stretch).to_batches()
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from _decided(pa.Table.from_batches(held), stretch).to_batches()

    dealt = both.repartition("chrom", "_stretch").sortWithinPartitions(*order)
    out = dealt.mapInArrow(decide, rows.schema.add("_open", "boolean"))
    return materialize(out.select(*cols, "_open") if aside is None else out.select(*cols, "_open").union(aside))


def greedy_non_overlap(features: DataFrame, rank: Column) -> DataFrame:
    """Features kept when taken by (rank, start, end, feature_type, name) unless they overlap one kept before, per
    chromosome; a null rank comes last.

    Islands that lie within a stretch of the line are decided there (``_settled``), those over borders or in crowded
    stretches by ``_general``. No task holds an island of any size. Features with a null end or an end before the start go.
    """
    cols = ["chrom", "start_pos", "end_pos", "feature_type", "name", "rank"]
    rows = features.select("chrom", "start_pos", "end_pos", "feature_type", "name", rank.alias("rank")).filter("end_pos >= start_pos and chrom is not null")
    settled = _settled(rows)
    still = settled.filter("_open").select(*cols)
    kept = settled.filter("not _open").select(*cols)
    return kept if still.isEmpty() else kept.union(_general(still).select(*cols))


def infer_introns(exons: DataFrame) -> DataFrame:
    """Gaps between a gene's exons in order of position: intron_number, start_pos, end_pos."""
    w = Window.partitionBy("gene_name").orderBy("start_pos", "end_pos")
    gaps = exons.withColumn("_prev", F.lag("end_pos").over(w)).filter("start_pos - _prev > 1")
    return gaps.select("gene_name", "chrom", F.row_number().over(w).alias("intron_number"), (F.col("_prev") + 1).alias("start_pos"), (F.col("start_pos") - 1).alias("end_pos"))
