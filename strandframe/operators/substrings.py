"""How many different substrings a sequence has, of all lengths, by length, and beside what another sequence has.

The suffixes of a row are sorted by ranks of pieces of 1, 2, 4 ... letters; a suffix has as many new substrings as it is
longer than what it shares with the one before it. A row of n letters takes n log n steps and as much memory, in its task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import scan

BORDER = 0x110000  # no letter: between two texts


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def new_lengths(letters: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in sorted order, where in the text it starts and how many letters it shares with the one before it,
    ``most`` at most."""
    n = len(letters)
    enough = n if most is None else min(n, most)
    levels, step = [np.unique(letters, return_inverse=True)[1].astype(np.int64) + 1], 1
    while step < enough and levels[-1].max() < n:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - step] = levels[-1][step:]
        levels.append(np.unique(levels[-1] * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1)
        step *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b, shared = order[:-1], order[1:], np.zeros(max(0, n - 1), dtype=np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < n) & (y < n)
        same = inside & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
        shared[same] += 1 << j
    return order, np.minimum(np.r_[0, shared], enough)


def counts_by_length(text: str, most: int | None = None, beside: str | None = None) -> np.ndarray:
    """Different substrings of each length from 1 on, up to ``most``; with ``beside`` those that it has not."""

    def count(letters: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        if not len(letters):
            return np.zeros(size, dtype=np.int64)
        order, shared = new_lengths(letters, size)
        reach = np.minimum(ends[order] - order, size)
        up = np.bincount(shared, minlength=size + 1) - np.bincount(np.maximum(reach, shared), minlength=size + 1)
        return np.cumsum(up)[:size]

    own = _letters(text)
    size = len(own) if most is None else min(most, len(own))
    if not beside:
        return count(own, np.full(len(own), len(own)), size)
    other = _letters(beside)
    both = np.r_[other, BORDER, own]
    ends = np.r_[np.full(len(other) + 1, len(other)), np.full(len(own), len(both))]
    return count(both, ends, size) - count(other, np.full(len(other), len(other)), size)


def distinct_substrings(seqs: DataFrame, most: int | None = None, key: str = "seq_id", seq: str = "seq", beside: str | None = None) -> DataFrame:
    """(key, n_distinct) for each row: different substrings of ``seq``, of all lengths or of up to ``most`` letters; with
    ``beside`` those alone that the text in that column has not. Null and empty texts have none; repeated rows each count."""
    mark = F.concat(F.length(F.coalesce(beside, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(beside, F.lit(""))) if beside else F.lit("0:")
    rows = seqs.select(key, F.concat(mark, F.coalesce(seq, F.lit(""))).alias("_both"))

    def find(both: str) -> list:
        size, _, texts = both.partition(":")
        return [np.array([counts_by_length(texts[int(size) :], most, texts[: int(size)]).sum()], dtype=np.int64)]

    return scan(rows, "n_distinct long", ["n_distinct"], find, key=key, seq="_both")


def substring_profile(seqs: DataFrame, most: int, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(key, length, n_distinct) for each length from 1 to ``most`` that the sequence has."""

    def find(text: str) -> list:
        counts = counts_by_length(text, most)
        return [np.arange(1, len(counts) + 1, dtype=np.int64), counts]

    return scan(seqs, "length long, n_distinct long", ["length", "n_distinct"], find, key=key, seq=seq)
