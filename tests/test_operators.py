"""Operators against plain Python on small tables, with nulls, ties, repeated rows and empty tables."""

import random

from strandframe.functions import bases
from strandframe.operators import intervals as iv
from strandframe.operators import sequences as sq
from strandframe.operators.graph import components
from strandframe.operators.ordered import running
from pyspark.sql import functions as F

SCHEMA = "chrom string, start_pos long, end_pos long, feature_type string, name string"


def some_intervals(n, seed):
    r = random.Random(seed)
    rows = [(r.choice("12"), s := r.randrange(1, 30_000), s + r.choice([0, 3, 50, 9000]), r.choice(["gene", "exon", "CDS"]), str(i)) for i in range(n)]
    return rows + rows[:3] + [(None, 1, 2, "gene", "x"), ("1", None, 5, "gene", "y"), ("1", 9, 4, "gene", "z")]


def overlaps(a, b):
    ok = lambda r: None not in r[:3] and r[2] >= r[1]
    return ok(a) and ok(b) and a[0] == b[0] and a[1] <= b[2] and a[2] >= b[1]


def test_overlap_join_finds_each_pair_once(spark):
    a, b = some_intervals(60, 1), some_intervals(60, 2)
    got = iv.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).select("a_name", "b_name").collect()
    assert sorted(map(tuple, got)) == sorted((x[4], y[4]) for x in a for y in b if overlaps(x, y))


def test_left_overlap_join_keeps_rows_without_partner(spark):
    a, b = some_intervals(20, 3), some_intervals(5, 4)
    got = iv.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "left").select("a_name", "b_name").collect()
    want = [(x[4], y[4]) for x in a for y in b if overlaps(x, y)] + [(x[4], None) for x in a if not any(overlaps(x, y) for y in b)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    empty = spark.createDataFrame([], SCHEMA)
    assert iv.overlap_join(empty, empty).count() == 0


def test_running_carries_over_ranges(spark):
    rows = [("a" if i % 3 else "b", i, i % 7) for i in range(200)]
    out = running(spark.createDataFrame(rows, "g string, i int, x int"), ["g"], ["i"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))})
    seen = {}
    got = {(r["g"], r["i"]): (r["s"], r["m"]) for r in out.collect()}
    for g, i, x in rows:
        before = seen.setdefault(g, [])
        assert got[g, i] == ((sum(before), max(before)) if before else (None, None))
        before.append(x)


def test_greedy_keeps_best_without_overlap(spark):
    rows = [r for r in some_intervals(40, 5) if overlaps(r, r)]
    rank = {"gene": 0, "exon": 1, "CDS": 2}
    kept = []
    for r in sorted(rows, key=lambda r: (rank[r[3]], r[1], r[2], r[3], r[4])):
        if not any(overlaps(r, k) for k in kept):
            kept.append(r)
    order = F.when(F.col("feature_type") == "gene", 0).when(F.col("feature_type") == "exon", 1).otherwise(2)
    got = iv.greedy_non_overlap(spark.createDataFrame(rows, SCHEMA), order).select("chrom", "start_pos", "end_pos").collect()
    assert sorted(map(tuple, got)) == sorted(r[:3] for r in kept)


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 499), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 140)} == {100} and got[500] == got[499] == 499


def test_sequence_functions(spark):
    row = spark.createDataFrame([("ATGGCCTAA", "RYN", "CAT", None)], "s string, c string, m string, n string").select(
        bases.reverse_complement(F.col("s")), bases.translate_codons(F.col("s")), bases.reverse_complement(F.col("c")),
        bases.canonical(F.col("m")), bases.sequence_index(F.lit("TA")), bases.gc_fraction(F.col("n")), bases.hamming(F.col("s"), F.lit("ATCGCC")),
        bases.one_hot(F.lit("ATGCN")),
    ).first()
    assert tuple(row)[:7] == ("TTAGGCCAT", "MA*", "NRY", "ATC", 4, None, 1)
    assert row[7][:5] == [0, 1, 2, 3, 4]
    assert bases.iupac_regex("TAWN") == "TA[AT][ACGT]"


def test_variants_applied_in_order(spark):
    regions = spark.createDataFrame([(1, "1", 101, "AACCGGTT"), (2, "1", 200, "ACGT")], "seq_id int, chrom string, start_pos long, seq string")
    variants = [("1", 102, "A", "AGG"), ("1", 103, "CCG", "C"), ("1", 104, "C", "T"), ("1", 108, "T", "A"), ("1", 107, "G", "A"), ("2", 101, "A", "C")]
    got = {r["seq_id"]: tuple(r)[1:] for r in sq.apply_variants(regions, spark.createDataFrame(variants, "chrom string, pos long, ref string, alt string")).collect()}
    assert got[1] == ("AAGGCGTA", 0, 3)
    assert got[2] == ("ACGT", 0, 0)
