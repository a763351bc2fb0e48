"""Different substrings of a row against sets of all of them."""

import random
import time

import pytest

from strandframe.operators import substrings as sub


def brute(text, most=None):
    n = len(text)
    return {text[i:j] for i in range(n) for j in range(i + 1, min(n, i + (most or n)) + 1)}


@pytest.mark.parametrize("seed", range(40))
def test_counts_equal_sets(seed):
    pick = random.Random(seed)
    letters = ["A", "AB", "ACGT", "né漢😀"][seed % 4]
    text, other = ("".join(pick.choices(letters, k=pick.randrange(0, 60))) for _ in range(2))
    for most in (None, 1, 3, 8, 500):
        own = brute(text, most)
        counts = sub.counts_by_length(text, most)
        assert counts.tolist() == [sum(len(w) == k for w in own) for k in range(1, len(counts) + 1)] and counts.sum() == len(own)
        fresh = own - brute(other, most)
        found = sub.counts_by_length(text, most, other)
        assert found.tolist() == [sum(len(w) == k for w in fresh) for k in range(1, len(found) + 1)]


def test_long_repeats_and_long_rows():
    began = time.time()
    assert sub.counts_by_length("AT" * 100_000).sum() == 2 * 200_000 - 1
    text = "".join(random.Random(1).choices("ACGT", k=1_000_000))
    counts = sub.counts_by_length(text)
    assert counts[0] == 4 and counts[5] == 4**6 and counts[-1] == 1 and counts[99] == 1_000_000 - 99
    assert time.time() - began < 120


def test_rows(spark):
    rows = [(1, "ABAB", "BA"), (2, "", "A"), (3, None, None), (4, "AAAA", None), (4, "AAAA", "A:A"), (5, "1:B", "B")]
    df = spark.createDataFrame(rows, "seq_id long, seq string, n_distinct string")
    got = sorted(tuple(r) for r in sub.distinct_substrings(df).collect())
    assert got == [(1, 7), (2, 0), (3, 0), (4, 4), (4, 4), (5, 6)]
    beside = sorted(tuple(r) for r in sub.distinct_substrings(df, beside="n_distinct").collect())
    assert beside == [(1, 4), (2, 0), (3, 0), (4, 3), (4, 4), (5, 5)]
    assert sub.distinct_substrings(df.limit(0)).count() == 0
    profile = sorted(tuple(r) for r in sub.substring_profile(df.filter("seq_id < 4"), 3).collect())
    assert profile == [(1, 1, 2), (1, 2, 2), (1, 3, 2)]
