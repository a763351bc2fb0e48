"""Alignments of pairs with both gapped strings, and spectra of what differs in aligned pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 16  # diagonals on either side of what the lengths ask for, at first
CELLS = 1 << 22  # cells of the tables that are open at once, a byte each
UNIT = 1_000_000  # scores are whole numbers of this part
FAR = -(1 << 60)

# Ambiguity codes of two bases.
CLASSES = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC"}


def _letters(texts: list[str], before: int, height: int, fill: int) -> np.ndarray:
    """Code points by place, a column a text, after ``before`` rows of ``fill`` and filled up to ``height``."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((height, len(texts)), fill, dtype=np.int32)
    who = np.repeat(np.arange(len(texts)), size)
    out[before + np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size), who] = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.int32)
    return out


def _small(*sides: np.ndarray) -> list[np.ndarray]:
    """The same letters in a byte each where code points, -1 and -2 fit."""
    return [x.astype(np.uint8) for x in sides] if all(x.max(initial=0) < 254 for x in sides) else list(sides)


def _banded(left: list[str], right: list[str], low: int, high: int, match: int, mismatch: int, gap: int, strings: bool = True) -> tuple[np.ndarray, list[str], list[str]]:
    """Best alignments within the diagonals ``low`` to ``high`` (place in right less place in left), all pairs together, a
    row of the band at a time; equals go on along the diagonal first, then by a gap in the right one. Pairs lie side by
    side, so each step is a few operations over all of them; cells behind the end of the right one reach none before it."""
    na, nb = np.array([len(t) for t in left]), np.array([len(t) for t in right])
    rows, pairs, width = int(na.max(initial=0)), len(left), high - low + 1
    reach = (rows + int(nb.max(initial=0)) + 2 * width) * max(match, -mismatch, -gap)
    kind, far = (np.int16, -(1 << 14)) if reach < 1 << 13 else (np.int32, -(1 << 29)) if reach < 1 << 28 else (np.int64, FAR)
    points, ahead = _letters(left, 0, rows, -1), max(0, -low)
    others = _letters(right, ahead, ahead + max(int(nb.max(initial=0)), rows + high), -2)
    a, b = _small(points, others)
    moves = np.full((rows + 1 if strings else 1, width, pairs), 2, dtype=np.uint8)
    h = np.full((width, pairs), far, dtype=kind)
    h[-low:] = np.arange(high + 1, dtype=kind)[:, None] * gap
    score = np.where(na == 0, gap * nb, 0)
    down, one = np.full_like(h, far), np.zeros(pairs, dtype=kind)
    for i in range(1, rows + 1):
        straight = (b[ahead + i + low - 1 : ahead + i + high] == a[i - 1]).astype(kind)
        straight *= match - mismatch
        straight += mismatch
        straight += h
        np.add(h[1:], kind(gap), out=down[:-1])
        new = np.maximum(straight, down)
        new[: max(0, -i - low)] = far
        for d in range(1, width):
            np.add(new[d - 1], kind(gap), out=one)
            np.maximum(new[d], one, out=new[d])
        np.maximum(new, kind(far), out=new)
        if strings:
            other = new != straight
            np.add(other, other & (new != down), out=moves[i], dtype=np.uint8)
        h = new
        done = np.flatnonzero(na == i)
        score[done] = h[nb[done] - i - low, done]
    if not strings:
        return score, [], []
    i, j, who = na.copy(), nb.copy(), np.arange(pairs)
    taken, open_ = [], (i > 0) | (j > 0)
    while open_.any():
        move = np.where(i == 0, 2, moves[i, np.clip(j - i - low, 0, width - 1), who])
        up, back = open_ & (move != 2), open_ & (move != 1)
        taken.append((np.where(up, points[i - 1, who] if rows else 45, 45), np.where(back, others[ahead + j - 1, who] if len(others) else 45, 45), open_))
        i, j = i - up, j - back
        open_ = (i > 0) | (j > 0)
    if not taken:
        return score, [""] * pairs, [""] * pairs
    kept = np.array([t[2] for t in reversed(taken)]).T
    ends = np.cumsum(kept.sum(axis=1)).tolist()
    sides = []
    for side in (0, 1):
        text = np.array([t[side] for t in reversed(taken)], dtype=np.int32).T[kept].tobytes().decode("utf-32-le")
        sides.append([text[x:y] for x, y in zip([0, *ends], ends)])
    return score, *sides


def aligned(left: list[str], right: list[str], match: float = 1.0, mismatch: float = -0.9, gap: float = -1.0, strings: bool = True) -> tuple[list[float], list[str], list[str]]:
    """The best global alignment of each pair: score and, if ``strings``, both strings with '-' where the other one has more.

    A path that leaves the band has two more gaps for each diagonal beyond it, which bounds its score; where the best one
    in the band is no worse the alignment is the best of all, else the pair is done again with a band twice as wide. Open
    tables hold CELLS cells, or those of one pair: its length times its band."""
    if not (match >= 0 >= gap and match >= mismatch):
        raise ValueError("a match must not cost, a gap must not pay, a mismatch must not be better than a match")
    m, x, g = (round(v * UNIT) for v in (match, mismatch, gap))
    unit = math.gcd(m, x, g) or 1  # small whole numbers, so that scores take few bytes
    m, x, g, n = m // unit, x // unit, g // unit, len(left)
    score, one, two = [0.0] * n, [""] * n, [""] * n
    todo, band = sorted(range(n), key=lambda k: (len(right[k]) - len(left[k]), len(left[k]))), BAND
    while todo:
        again, at = [], 0
        while at < len(todo):
            to, low, high, longest = at, 0, 0, 0
            while to < len(todo):
                over, size = len(right[todo[to]]) - len(left[todo[to]]), len(left[todo[to]])
                new = min(low, over), max(high, over), max(longest, size)
                if to > at and (to + 1 - at) * (new[2] + 1) * (new[1] - new[0] + 2 * band + 1) > CELLS:
                    break
                (low, high, longest), to = new, to + 1
            part = todo[at:to]
            found = _banded([left[k] for k in part], [right[k] for k in part], low - band, high + band, m, x, g, strings)
            for k, s, p, q in zip(part, found[0].tolist(), *(found[1:] if strings else ([""] * len(part),) * 2)):
                total, apart = len(left[k]) + len(right[k]), abs(len(left[k]) - len(right[k]))
                gaps = apart + 2 * (band + 1)
                if gaps > total or 2 * s >= m * (total - gaps) + 2 * g * gaps:
                    score[k], one[k], two[k] = s * unit / UNIT, p, q
                else:
                    again.append(k)
            at = to
        todo, band = again, 2 * band
    return score, one, two


def align_pairs(pairs: DataFrame, match: float = 1.0, mismatch: float = -0.9, gap: float = -1.0) -> DataFrame:
    """``pairs`` (a, b, a_seq, b_seq) aligned: a, b, score, a_aligned, b_aligned. A pair with a null sequence goes."""
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, one, two = aligned(batch.column(2).to_pylist(), batch.column(3).to_pylist(), match, mismatch, gap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["a", "b", "score", "a_aligned", "b_aligned"])

    rows = pairs.select("a", "b", "a_seq", "b_seq").filter("a_seq is not null and b_seq is not null")
    return rows.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, score double, a_aligned string, b_aligned string")


def differences(one: Column, two: Column) -> Column:
    """The columns of two aligned strings that differ, as two letters each; columns beyond the shorter one do not count."""
    n = F.least(F.length(one), F.length(two))
    return F.filter(F.zip_with(F.split(F.substr(one, F.lit(1), n), ""), F.split(F.substr(two, F.lit(1), n), ""), lambda x, y: F.when(x != y, F.concat(x, y))), lambda c: c.isNotNull() & (F.length(c) == 2))


def spectrum(rows: DataFrame, one: str, two: str, keys: list[str], by_class: bool = False) -> DataFrame:
    """(keys, change, n): how often each base stands across from another one, as two letters, or by the ambiguity code of
    both (R, Y, S, W, K, M) whatever their order. Gaps and other letters do not count."""
    names = [x + y for x in "ATGC" for y in "ATGC"]
    if by_class:
        names = [next((c for c, of in CLASSES.items() if set(of) == {*n}), n) for n in names]
    kinds = sorted(set(names))
    number = np.array([kinds.index(n) for n in names])
    code = np.full(128, 4, dtype=np.int64)
    code[[ord(b) for b in "ATGC"]] = range(4)

    def letters(texts: pa.Array, most: np.ndarray) -> np.ndarray:
        x = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        size = pc.utf8_length(texts).to_numpy().astype(np.int64)
        place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
        x = x[place < np.repeat(most, size)]
        return code[np.where(x < 128, x, 0)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, int] = {}
            own = [groups.setdefault(k, i) for i, k in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:])))] if keys else [0] * batch.num_rows
            most = np.minimum(*(pc.utf8_length(batch.column(c)).to_numpy().astype(np.int64) for c in (0, 1)))
            x, y = (letters(batch.column(c), most) for c in (0, 1))
            at = np.flatnonzero((x != y) & (x < 4) & (y < 4))
            row = np.repeat(np.array(own, dtype=np.int64), most)[at]
            told, n = np.unique(row * len(kinds) + number[4 * x[at] + y[at]], return_counts=True)
            taken = [c.take(pa.array(told // len(kinds))) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*taken, pa.array([kinds[t] for t in (told % len(kinds)).tolist()], pa.string()), pa.array(n.astype(np.int64))], [*keys, "change", "n"])

    types = dict(rows.dtypes)
    read = rows.select(F.col(one).alias("_one"), F.col(two).alias("_two"), *keys).filter("_one is not null and _two is not null")
    parts = read.mapInArrow(count, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "change string, n long"]))
    return parts.groupBy(*keys, "change").agg(F.sum("n").alias("n"))


def relative(spectra: DataFrame, keys: list[str], kinds: int) -> DataFrame:
    """``spectra`` with excess: a change's share of its key's changes less an even share of ``kinds``. Keys are joined with
    their sums, so a key may have any number of rows."""
    sums = spectra.groupBy(*keys).agg(F.sum("n").alias("_all"))
    both = spectra.join(sums, keys) if keys else spectra.crossJoin(F.broadcast(sums))  # one row
    return both.withColumn("excess", F.col("n") / F.col("_all") - F.lit(1.0 / kinds)).drop("_all")


def gap_counts(rows: DataFrame, one: str, two: str, keys: list[str]) -> DataFrame:
    """(keys, base, in_one, in_two): how often each base stands across from a gap in the first and in the second string."""
    found = rows.select(*keys, F.explode(differences(F.col(one), F.col(two))).alias("change")).filter(F.col("change").rlike("^(-[ATGC]|[ATGC]-)$"))
    first = F.substring("change", 1, 1) == "-"
    base = F.when(first, F.substring("change", 2, 1)).otherwise(F.substring("change", 1, 1))
    return found.groupBy(*keys, base.alias("base")).agg(F.count_if(first).alias("in_one"), F.count_if(~first).alias("in_two"))
