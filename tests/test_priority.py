"""Greedy choices in rounds and along a line against sequential passes."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import intervals as iv
from strandframe.operators import pairs
from strandframe.operators.priority import along_the_line, greedy_groups, left_out
from strandframe.operators.storage import recorded


def test_left_out_equals_a_sequential_pass(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = {tuple(sorted(r.sample(range(120), 2))) for _ in range(220)}
        out = set()
        for i in range(120):
            if any((j, i) in edges and j not in out for j in range(i)):
                out.add(i)
        df = spark.createDataFrame([*edges, *list(edges)[:9], (5, 5)], "first long, then long")
        assert {x["node"] for x in left_out(df).collect()} == out
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "first long, then long")
    assert {x["node"] for x in left_out(chain).collect()} == set(range(1, 13, 2))
    assert left_out(chain.limit(0)).count() == 0
    with pytest.raises(ValueError):
        left_out(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "first long, then long"))


def test_greedy_groups_take_the_first_centre(spark):
    r = random.Random(9)
    order = list(range(80))
    r.shuffle(order)
    place = {n: i for i, n in enumerate(order)}
    links = {tuple(r.sample(range(80), 2)) for _ in range(120)}
    near = {n: {b for a, b in links if a == n} | {a for a, b in links if b == n} for n in range(80)}
    centre = {}
    for n in order:
        before = [c for c in near[n] if centre.get(c) == c]
        centre[n] = min(before, key=place.get) if before else n
    nodes = spark.createDataFrame([(n, place[n]) for n in range(80)], "node long, place long")
    got = greedy_groups(nodes, spark.createDataFrame([*links, (3, 3)], "a long, b long"))
    assert dict(map(tuple, got.collect())) == centre


def pass_along(rows):
    kept, last = [], {}
    for c, s, e, k in sorted(rows, key=lambda x: (x[0], x[1], x[2], x[3])):
        if s > last.get(c, -1):
            kept.append((c, s, e, k))
            last[c] = e
    return sorted(kept)


def test_along_the_line_of_short_and_long_islands(spark):
    r = random.Random(3)
    rows = [("1", s, s + r.randrange(0, 30), i) for i, s in enumerate(r.choices(range(400), k=150))]
    rows += [("2", 3 * i, 3 * i + 3, i) for i in range(700)]  # one island: each overlaps the next
    rows += [("3", 5, 900, 0), ("3", 6, 7, 1), ("3", 901, 902, 2), ("4", 1, 1, 0), ("4", 1, 1, 0)]
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, k long")
    assert sorted(map(tuple, along_the_line(df, ties=("k",)).collect())) == pass_along(rows)
    assert along_the_line(df.limit(0)).count() == 0


@pytest.mark.parametrize("levels", [64, 2])
def test_greedy_non_overlap_equals_a_sequential_fold(spark, monkeypatch, levels):
    monkeypatch.setattr(iv, "LEVELS", levels)
    r = random.Random(7)
    rows = [(r.choice("12"), s, s + r.randrange(-2, 40), r.choice(["gene", "exon"]), f"n{i}", r.choice([0, 1, 1, 5, None])) for i, s in enumerate(r.choices(range(1, 900), k=160))]
    rows += [("1", None, 5, "gene", "x", 0), ("1", 5, None, "gene", "x", 0), (None, 1, 5, "gene", "x", 0)]
    kept = []
    for x in sorted((x for x in rows if None not in x[:3] and x[2] >= x[1]), key=lambda x: (x[5] is None, x[5] or 0, x[1], x[2], x[3], x[4])):
        if not any(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for y in kept):
            kept.append(x)
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, feature_type string, name string, p int")
    got = iv.greedy_non_overlap(df, F.col("p")).collect()
    assert sorted((x["chrom"], x["start_pos"], x["end_pos"], x["name"]) for x in got) == sorted((x[0], x[1], x[2], x[4]) for x in kept)


@pytest.mark.parametrize("crowded", [1000, 40])
def test_greedy_non_overlap_over_stretches(spark, monkeypatch, crowded):
    """Islands within stretches, over borders, below one long feature and in crowded stretches."""
    monkeypatch.setattr(iv, "STRETCH", 64)
    monkeypatch.setattr(iv, "CROWDED", crowded)
    r = random.Random(11)
    rows = [(c, s, s + r.choice([0, 1, 2, 3, 9]), "gene", f"n{i}", r.choice([0, 1, 1, None])) for i, (c, s) in enumerate((r.choice("12"), r.randrange(1, 1500)) for _ in range(300))]
    rows += [("1", s, s + 2, "gene", f"m{s}", 1) for s in range(200, 250)] + [("2", 130, 400, "gene", "long", 5), ("1", -70, -60, "gene", "low", 1), ("1", 63, 64, "gene", "edge", 0)]
    kept = []
    for x in sorted(rows, key=lambda x: (x[5] is None, x[5] or 0, x[1], x[2], x[3], x[4])):
        if not any(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for y in kept):
            kept.append(x)
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, feature_type string, name string, p int")
    assert sorted(x["name"] for x in iv.greedy_non_overlap(df, F.col("p")).collect()) == sorted(x[4] for x in kept)


def test_islands_away_from_borders_take_no_rounds(spark):
    df = spark.createDataFrame([("1", 100 * i, 100 * i + 150 * (i % 2), "gene", f"n{i}", i % 3) for i in range(1, 60)], "chrom string, start_pos long, end_pos long, feature_type string, name string, p int")
    with recorded() as paths:
        got = iv.greedy_non_overlap(df, F.col("p")).count()
    assert len(paths) <= 2 and 30 <= got < 59


def test_greedy_centroids_are_the_longest_first(spark):
    r = random.Random(2)
    base = ["".join(r.choice("ACGT") for _ in range(40)) for _ in range(4)]
    seqs = []
    for b in base:
        for _ in range(5):
            t = list(b)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(40)] = r.choice("ACGT")
            seqs.append("".join(t) + "ACGT"[: r.randrange(0, 4)])
    rows = [*enumerate(seqs), (90, None), (91, seqs[3]), (92, "")]

    def score(a, b):
        row = [-float(j) for j in range(len(b) + 1)]
        for i, x in enumerate(a):
            new = [-(i + 1.0)]
            for j, y in enumerate(b):
                new.append(max(row[j] + (1 if x == y else -0.9), row[j + 1] - 1, new[j] - 1))
            row = new
        return row[-1]

    words = lambda s: {s[i : i + 8] for i in range(len(s) - 7)}
    centre, kept = {}, []
    for i, s in sorted(((i, s) for i, s in rows if s is not None), key=lambda x: (-len(x[1]), x[0])):
        same = next((j for j, t in rows if t == s), i)
        if same != i:
            centre[i] = None
            continue
        like = [c for c in kept if words(seqs[c] if c < 90 else "") & words(s) and score(dict(rows)[c], s) >= 0.8 * max(len(dict(rows)[c]), len(s)) - 1e-9]
        centre[i] = like[0] if like else i
        if not like:
            kept.append(i)
    first = {}
    for i, s in rows:
        if s is not None:
            first.setdefault(s, i)
    want = {i: centre[first[s]] if s is not None else i for i, s in rows}
    got = pairs.similar_clusters(spark.createDataFrame(rows, "seq_id long, seq string"), 8, 0.8, greedy=True)
    assert dict(map(tuple, got.collect())) == want


def test_template_centres_in_the_order_of_keys(spark):
    r = random.Random(4)
    pool = ["".join(r.choice("AC") for _ in range(20)) for _ in range(40)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(pool)]
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    kept, members = [], {}
    for t, i in sorted(first.items(), key=lambda x: x[1]):
        near = [c for c in kept if sum(x != y for x, y in zip(t, dict(map(reversed, first.items()))[c])) <= 2]
        if near:
            members[near[0]].append(t)
        else:
            kept.append(i)
            members[i] = [t]
    got = {x["centroid"]: x["n"] for x in pairs.template_groups(spark.createDataFrame(rows, "seq_id long, seq string"), 20, greedy=True).collect()}
    assert got == {c: sum(sum(t == u for _, u in rows) for t in ts) for c, ts in members.items()}
