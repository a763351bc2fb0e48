"""Alike texts are found whatever words they share."""

import os
import random

import pytest

from strandframe.operators import alike, pairs
from strandframe.operators.storage import recorded
from strandframe.plans import motif_queries
from strandframe.sources.views import Views


def score(a, b):
    row = [-j for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [-i - 1]
        for j, y in enumerate(b):
            new.append(max(row[j] + (1 if x == y else -0.9), row[j + 1] - 1, new[j] - 1))
        row = new
    return row[-1]


def worn(r, text, n, letters):
    out = list(text)
    for _ in range(n):
        p, what = r.randrange(len(out) + 1), r.randrange(3)
        if what == 0:
            out.insert(p, r.choice(letters))
        elif p < len(out):
            out[p : p + 1] = r.choice(letters) if what == 1 else ""
    return "".join(out)


def texts(seed, letters, n=10, copies=7, most=52):
    r = random.Random(seed)
    first = ["".join(r.choice(letters) for _ in range(r.randrange(1, most))) for _ in range(n)]
    return sorted({"", *first, *(worn(r, t, r.randrange(1, 8), letters) for t in first for _ in range(copies))})


@pytest.mark.parametrize("letters, least", [("ACGT", 0.8), ("AC", 0.8), ("ACGTN\u00e9", 0.7), ("A", 0.9), ("ACGT", 1.0)])
def test_alike_pairs_equal_plain_tables(spark, monkeypatch, letters, least):
    monkeypatch.setattr(alike, "BLOCK", 2)  # several blocks of a length, several waves
    monkeypatch.setattr(alike, "WAVE", 100)
    monkeypatch.setattr(alike, "LONG", 45)
    every = texts(3, letters)
    want = {(i, j) for i, a in enumerate(every) for j, b in enumerate(every[:i]) if score(a, b) >= least * max(len(a), len(b)) - 1e-9}
    got = [tuple(map(int, x)) for x in alike.alike_pairs(spark.createDataFrame(list(enumerate(every)), "node long, t string"), least).collect()]
    assert sorted((max(p), min(p)) for p in got) == sorted(want) and (want or least == 1.0)


def test_all_pairs_where_parts_are_short_or_common():
    few = ["A" * n + "C" + "A" * (30 - n) for n in range(31)]
    i, j = alike._of_lengths(few, None, 0.8)
    assert len(i) == 31 * 30 / 2  # two mismatches, or one gap on either side, between any two
    i, j = alike._of_lengths(["ACGT", "TTTT"], ["GGG", "ACG"], 0.3)
    assert [(0, 1)] == list(zip(i.tolist(), j.tolist()))


def test_genes_without_a_common_word_are_one_cluster(spark, monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("ACGT") for _ in range(50))
    other = "".join("ACGT"["ACGT".index(c) ^ 1] if i % 10 == 9 else c for i, c in enumerate(text))
    assert not any(text[i : i + 12] in other for i in range(39)) and score(text, other) >= 40
    genes = spark.createDataFrame([(1, text), (2, other), (3, other[:30])], "seq_id long, seq string")
    monkeypatch.setattr(motif_queries, "_numbered_genes", lambda v: genes)
    assert sorted(map(tuple, motif_queries.srch_similar_clusters(None).collect())) == [(1, 1), (2, 1), (3, 3)]
    assert sorted(map(tuple, pairs.similar_clusters(genes, 12, 0.8).collect())) == [(1, 1), (2, 2), (3, 3)]  # where a word is asked for


def test_genes_are_read_once_and_what_reading_stored_is_let_go(spark):
    views = Views(spark, "/root/testdata/sf0.001")
    with recorded() as paths:
        genes = motif_queries._numbered_genes(views)
    left = [p for p in paths if os.path.exists(p)]
    assert len(left) == 1 and all(left[0] in f for f in genes.inputFiles())
    assert "Exchange" not in genes._jdf.queryExecution().executedPlan().toString()
    assert views.ref_chunks.count() > 0  # still there for who asks again
