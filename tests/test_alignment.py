"""Alignments with both strings, and spectra, against plain Python."""

import random
import time
from collections import Counter

import pytest

from strandframe.operators import alignment


def best(a, b, match, mismatch, gap):
    row = [j * gap for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [(i + 1) * gap]
        for j, y in enumerate(b):
            new.append(max(row[j] + (match if x == y else mismatch), row[j + 1] + gap, new[j] + gap))
        row = new
    return row[-1]


def worth(p, q, match, mismatch, gap):
    assert len(p) == len(q) and all((x, y) != ("-", "-") for x, y in zip(p, q))
    return sum(gap if "-" in (x, y) else match if x == y else mismatch for x, y in zip(p, q))


def some_pairs(r):
    out = [("", ""), ("A", ""), ("", "ACG"), ("A", "A"), ("éA", "eA"), ("ACGT" * 5, "ACGT" * 5), ("A" * 60, "C" * 55), ("ACGTACGTAA" + "G" * 60, "G" * 60 + "ACGTACGTAA")]
    for _ in range(60):
        a = "".join(r.choice("ACGT") for _ in range(r.randrange(0, 80)))
        b = list(a)
        for _ in range(r.randrange(0, 12)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(0, 9)] = [r.choice("ACGT") for _ in range(r.randrange(0, 9))]
        out.append((a, "".join(b)))
    return out


@pytest.mark.parametrize("costs", [(1.0, -0.9, -1.0), (1.0, -3.0, -0.5), (2.0, 1.0, 0.0), (0.0, -1.0, -1.0)])
def test_alignments_are_the_best_and_give_their_strings(monkeypatch, costs):
    pairs = some_pairs(random.Random(3))
    for band, cells in ((1, 1), (16, 1 << 25)):
        monkeypatch.setattr(alignment, "BAND", band)
        monkeypatch.setattr(alignment, "CELLS", cells)
        score, one, two = alignment.aligned([a for a, _ in pairs], [b for _, b in pairs], *costs)
        for (a, b), s, p, q in zip(pairs, score, one, two):
            assert (p.replace("-", ""), q.replace("-", "")) == (a, b)
            assert abs(s - best(a, b, *costs)) < 1e-9 and abs(s - worth(p, q, *costs)) < 1e-9


def test_a_long_pair_takes_a_band():
    r = random.Random(8)
    a = "".join(r.choice("ACGT") for _ in range(10_000))
    b = a[:3000] + a[3020:7000] + "ACGTACG" + a[7000:]
    began = time.time()
    score, one, two = alignment.aligned([a], [b])
    assert score[0] == 10_000 - 20 - 27 and one[0].count("-") == 7 and two[0].count("-") == 20
    assert time.time() - began < 20


def test_costs_that_make_no_sense():
    with pytest.raises(ValueError):
        alignment.aligned(["A"], ["A"], 1.0, 2.0, -1.0)


def test_aligned_pairs_and_their_spectra(spark):
    r = random.Random(5)
    rows = [(i, i + 1, a, b) for i, (a, b) in enumerate(some_pairs(r)) if "é" not in a] + [(900, 901, None, "A"), (902, 903, "A", None)]
    df = spark.createDataFrame(rows, "a long, b long, a_seq string, b_seq string")
    got = alignment.align_pairs(df).collect()
    assert {x["a"] for x in got} == {x[0] for x in rows if None not in x}
    found = spark.createDataFrame(got)
    want, classes, gaps = Counter(), Counter(), Counter()
    code = {frozenset(v): k for k, v in alignment.CLASSES.items()}
    for x in got:
        for p, q in zip(x["a_aligned"], x["b_aligned"]):
            if "-" in (p, q):
                gaps[x["a"], q if p == "-" else p, p == "-"] += 1
            elif p != q:
                want[x["a"], p + q] += 1
                classes[code[frozenset((p, q))]] += 1
    assert {(x["a"], x["change"]): x["n"] for x in alignment.spectrum(found, "a_aligned", "b_aligned", ["a"]).collect()} == want
    whole = alignment.spectrum(found, "a_aligned", "b_aligned", [], by_class=True)
    assert {x["change"]: x["n"] for x in whole.collect()} == classes
    told = {x["change"]: x["excess"] for x in alignment.relative(whole, [], 6).collect()}
    assert all(abs(told[c] - (n / sum(classes.values()) - 1 / 6)) < 1e-12 for c, n in classes.items())
    counted = alignment.gap_counts(found, "a_aligned", "b_aligned", ["a"]).collect()
    assert {(x["a"], x["base"], f): n for x in counted for f, n in ((True, x["in_one"]), (False, x["in_two"])) if n} == gaps
    assert alignment.align_pairs(df.limit(0)).count() == 0
