"""All pairs of texts whose alignment scores a given share of the longer length, whatever words they share.

A match scores 1, a mismatch -0.9, a gap -1. A pair loses, of its longer length, 1.9 for a mismatch, 2 for a letter of the
longer text that stays alone and 1 for one of the shorter text; the share bounds the loss and so the number of such events.
Cut into one part more than there may be events, the longer text has a part i without any and with exactly i events before
it: it stands in the shorter text, at a place that these i events can have moved it to. Losses are whole tenths here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import aligned
from .storage import materialize, tidy

OFF, ALONE, MORE = 19, 20, 10  # tenths lost by a mismatch, by a letter of the longer text and by one of the shorter text
LONG = 100  # longer texts are scored in batches of mixed lengths
BLOCK = 1 << 16  # texts of a length that meet in one task, on either side
WAVE = 1 << 24  # rows that are dealt to tasks before their files are let go
CHUNK = 1 << 17  # pairs judged at once
TABLE = 1 << 20  # words of a part that are told by number


def _most(size: int, least: float) -> int:
    """The tenths that a pair whose longer text has ``size`` letters may lose, told as ``aligned`` scores are."""
    most = int((1 - least) * size * 10) + 2
    while (10 * size - most) * 100_000 / 1_000_000 < least * size:
        most -= 1
    return most


def _events(most: int, apart: int) -> int:
    """How many events a loss of ``most`` allows where lengths are ``apart``; -1 where none fits."""
    left = most - ALONE * apart
    return max((apart + 2 * g + (left - (ALONE + MORE) * g) // OFF for g in range(left // (ALONE + MORE) + 1)), default=-1)


def _parts(size: int, apart: int, most: int) -> list[tuple[int, int, list[int]]]:
    """(first, behind, shifts) of each part of the longer text: by how much its place there may be greater than in the
    shorter one, where as many events lie before it as there are parts."""
    events, forced = _events(most, apart), lambda d: ALONE * d if d > 0 else -MORE * d
    out = []
    for i in range(events + 1):
        before = lambda d: forced(d) + (i - abs(d)) // 2 * (ALONE + MORE) + (i - abs(d)) % 2 * OFF  # noqa: B023, E731
        shifts = [d for d in range(-i, i + 1) if abs(apart - d) <= events - i and before(d) + forced(apart - d) <= most]
        out.append((i * size // (events + 1), (i + 1) * size // (events + 1), shifts))
    return out


def _codes(*sides: list[str]) -> tuple[list[np.ndarray], int]:
    """Texts of one length a side as letters by place, numbered over both sides, and how many letters there are."""
    raw = [np.frombuffer("".join(s).encode("utf-32-le"), dtype=np.uint32) for s in sides]
    seen = np.flatnonzero(reduce(np.add, [np.bincount(r, minlength=0x110000) for r in raw]))
    number = np.zeros(0x110000, dtype=np.uint8 if len(seen) <= 256 else np.int32)
    number[seen] = np.arange(len(seen))
    return [np.ascontiguousarray(number[r].reshape(len(s), -1).T) for r, s in zip(raw, sides)], len(seen)


def _within(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of columns i of ``x`` and j of ``y``, the shorter, lose at most ``most``: rows of a band that holds every
    path as cheap, all pairs together; pairs that no path can save go on the way."""
    size, other = len(x), len(y)
    apart = size - other
    high, low = min((most + MORE * apart) // (ALONE + MORE), size), -min((most - ALONE * apart) // (ALONE + MORE), other)
    kind, far = (np.uint8 if most + 1 + ALONE <= 255 else np.int32), most + 1
    who, held = np.arange(len(i)), {}
    h = {d: np.full(len(i), min(-MORE * d, far), kind) for d in range(low, 1)}
    for row in range(1, size + 1):
        letter, new = x[row - 1][i], {}
        for d in range(high, low - 1, -1):
            at = row - d  # letters of the shorter text so far
            if not 0 <= at <= other:
                continue
            ways = []
            if at and d in h:
                if at not in held:
                    held[at] = y[at - 1][j]
                way = np.multiply((letter != held[at]).view(np.uint8), OFF, dtype=kind)
                ways.append(np.add(way, h[d], out=way))
            if d - 1 in h:
                ways.append(h[d - 1] + kind(ALONE))
            if d + 1 in new:
                ways.append(new[d + 1] + kind(MORE))
            if ways:
                best = ways[0]
                for way in ways[1:]:
                    np.minimum(best, way, out=best)
                new[d] = np.minimum(best, kind(far), out=best)
        h = new
        held = {at: c for at, c in held.items() if at > row - high}
        if row % 4 == 0 and row < size:
            rest = {d: most - (ALONE * (apart - d) if d < apart else MORE * (d - apart)) for d in h}
            alive = reduce(np.logical_or, [h[d] <= kind(rest[d]) for d in h if rest[d] >= 0], np.zeros(len(i), bool))
            keep = np.flatnonzero(alive)
            if not len(keep):
                return who[:0]
            if len(keep) < 0.8 * len(i):
                i, j, who = i[keep], j[keep], who[keep]
                h, held = {d: v[keep] for d, v in h.items()}, {at: c[keep] for at, c in held.items()}
    return who[h[apart] <= most]


def _met(x: np.ndarray, y: np.ndarray, letters: int, most: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns of ``x`` and ``y``, the shorter, of which a part says that they may be alike; some more than once.
    Where parts bring more than all pairs, all pairs."""
    size, other, n, m = len(x), len(y), x.shape[1], y.shape[1]
    base, total = letters | 1, 0  # odd, so that no letter is lost where numbers overflow
    key = lambda z, a, b: reduce(lambda k, c: k * base + c, z[a:b], np.zeros(z.shape[1], np.int64))
    for first, behind, shifts in _parts(size, size - other, most):
        own = key(x, first, behind)
        order = np.argsort(own, kind="stable")
        words = base ** (behind - first)
        own = np.r_[0, np.cumsum(np.bincount(own, minlength=words))] if words <= TABLE else own[order]
        for d in shifts:
            at = first - d
            if at < 0 or at + behind - first > other:
                continue
            asked = key(y, at, at + behind - first)
            low, high = (own[asked], own[asked + 1]) if words <= TABLE else (np.searchsorted(own, asked, s) for s in ("left", "right"))
            count = high - low
            total += int(count.sum())
            if total > n * m:
                break
            ends = np.cumsum(count)
            cuts = np.r_[0, np.searchsorted(ends, np.arange(CHUNK, int(count.sum()) + CHUNK, CHUNK), "left") + 1]
            for a, b in zip(cuts, cuts[1:]):
                some = count[a:b]
                if some.any():
                    place = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[a:b], some)
                    yield order[place], np.repeat(np.arange(a, a + len(some)), some)
        else:
            continue
        break
    else:
        return
    step = max(1, CHUNK // max(n, 1))
    for a in range(0, m, step):
        b = min(m, a + step)
        yield np.tile(np.arange(n), b - a), np.repeat(np.arange(a, b), n)


def _of_lengths(left: list[str], right: list[str] | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``left`` and in ``right`` of alike pairs; the texts of a side have one length, those of the right side are
    not longer. Without a right side, of pairs i < j of the left one."""
    most = _most(len(left[0]), least)
    (x, y), letters = _codes(left, left if right is None else right)
    found, ready, waiting = [np.zeros((2, 0), np.int64)], [], 0

    def judge() -> None:
        i, j = (np.concatenate(z) for z in zip(*ready))
        kept = _within(x, y, i, j, most)
        found.append(np.stack([i[kept], j[kept]]))
        ready.clear()

    for i, j in _met(x, y, letters, most, right is None):
        if right is None:
            once = np.flatnonzero(i < j)
            i, j = i[once], j[once]
        ready.append((i, j))
        waiting += len(i)
        if waiting >= CHUNK:
            judge()
            waiting = 0
    if ready:
        judge()
    i, j = np.concatenate(found, axis=1)
    once = np.unique(i * y.shape[1] + j)
    return once // y.shape[1], once % y.shape[1]


def _of_all(left: list[str], right: list[str] | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``_of_lengths`` of texts of mixed lengths: all pairs whose lengths and letters allow the score are scored."""
    both = left if right is None else right
    letters = {c: k for k, c in enumerate(sorted(set().union(*left, *both)))}
    counts = [np.array([np.bincount([letters[c] for c in t], minlength=len(letters)) for t in side], dtype=np.int64).reshape(len(side), -1) for side in (left, both)]
    size = [c.sum(axis=1) for c in counts]
    out, ready = [], []

    def judge() -> None:
        scores = aligned([left[i] for i, _ in ready], [both[j] for _, j in ready], strings=False)[0]
        out.extend(p for p, s in zip(ready, scores) if s >= least * max(len(left[p[0]]), len(both[p[1]])))
        ready.clear()

    for i in range(len(left)):
        start = i + 1 if right is None else 0
        low, high = np.minimum(size[0][i], size[1][start:]), np.maximum(size[0][i], size[1][start:])
        apart = np.abs(counts[0][i] - counts[1][start:]).sum(axis=1)  # each mismatch moves two counts, each gap one
        may = low - 0.95 * (apart - (high - low)) - (high - low) >= least * high - 1e-6
        ready.extend((i, int(j)) for j in np.flatnonzero(may) + start)
        if len(ready) >= 512:
            judge()
    if ready:
        judge()
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _tile(least: float, long: int) -> Callable[[pa.Table], pa.Table]:
    """The links of a tile: rows of its block of longer texts and, unless it is the same one, of its other block."""

    def run(table: pa.Table) -> pa.Table:
        mine = table.column("_long").to_numpy()
        nodes, texts = table.column("node").to_numpy(), np.array(table.column("t").to_pylist(), dtype=object)
        left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
        one, two = table.column("_x")[0].as_py(), table.column("_y")[0].as_py()
        alone = (one, table.column("_bx")[0].as_py()) == (two, table.column("_by")[0].as_py())
        i, j = right[:0], right[:0]
        if len(left) and (alone or len(right)):
            pick = _of_lengths if one <= long else _of_all
            i, j = pick(texts[left].tolist(), None if alone else texts[right].tolist(), least)
            i, j = left[i], (left if alone else right)[j]
        return pa.table({"a": nodes[i], "b": nodes[j]})

    return run


def alike_pairs(texts: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of ``texts`` (node, t), different and without nulls, whose best alignment scores at least ``least``
    of the longer length. Each pair once, in any direction.

    Texts are dealt by length to blocks; blocks whose lengths are near enough meet in tiles, a task each, and only links
    leave them. Tiles go in waves, so the files of a wave are all that is on disk at once. The work in tiles grows
    with the square of the texts of a length."""
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.length("t")
    kind = F.when(size <= LONG, size).otherwise(F.floor(F.log(size / LONG) / log(1.05)).cast("int") + LONG + 1)
    sized = texts.select("node", "t", kind.alias("_c"))
    held = {r["_c"]: r for r in sized.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi")).collect()}  # a row a length
    blocks = {c: ceil(r["n"] / BLOCK) for c, r in held.items()}

    def meet(x: int, y: int) -> bool:
        if y > x:
            return False
        if x > LONG:
            return held[y]["hi"] >= held[x]["lo"] * (1 + least) / 2 - 1e-9
        return _events(_most(x, least), x - y) > 0

    partners = {x: [y for y in held if meet(x, y)] for x in held}
    units = [(x, b, held[x]["n"] // blocks[x] * sum(blocks[y] for y in ys) + sum(held[y]["n"] for y in ys)) for x, ys in sorted(partners.items()) for b in range(blocks[x]) if ys]
    waves, rows = [], WAVE
    for x, b, n in units:
        if rows + n > WAVE:
            waves.append([])
            rows = 0
        waves[-1].append((x, b))
        rows += n
    schema = texts.select(F.col("node").alias("a"), F.col("node").alias("b")).schema
    found = []
    for wave in waves:
        xs = {x for x, _ in wave}
        roles = [(x, True, x, y, blocks[y]) for x in xs for y in partners[x]] + [(y, False, x, y, blocks[x]) for x in xs for y in partners[x]]
        named = spark.createDataFrame(roles, "_c int, _long boolean, _x int, _y int, _blocks int")
        mine = F.pmod(F.xxhash64("node"), F.element_at(F.create_map(*[F.lit(v) for c, n in blocks.items() for v in (c, n)]), F.col("_c"))).cast("int")
        dealt = sized.withColumn("_b", mine).join(F.broadcast(named), "_c")  # some rows a length
        within = F.col("_x") == F.col("_y")
        first, last = F.when(within & ~F.col("_long"), F.col("_b") + 1).otherwise(0), F.when(within & F.col("_long"), F.col("_b")).otherwise(F.col("_blocks") - 1)
        dealt = dealt.withColumn("_o", F.explode(F.when(first <= last, F.sequence(first, last))))
        own, other = F.col("_b"), F.col("_o")
        dealt = dealt.select("node", "t", "_long", "_x", F.when(F.col("_long"), own).otherwise(other).alias("_bx"), "_y", F.when(F.col("_long"), other).otherwise(own).alias("_by"))
        at, (lo, hi) = F.struct("_x", "_bx"), [F.struct(F.lit(x).alias("_x"), F.lit(b).alias("_bx")) for x, b in (wave[0], wave[-1])]
        tiles = sum(sum(blocks[y] for y in partners[x]) for x, _ in wave)
        keys = ["_x", "_bx", "_y", "_by"]
        dealt = dealt.filter(at.between(lo, hi)).repartition(max(tasks, min(tiles, 4 * tasks)), *keys)
        found.append(materialize(dealt.groupBy(*keys).applyInArrow(_tile(least, LONG), schema)))
        tidy(spark)
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)
