"""Pairs, groups and consensus functions against plain Python."""

import math
import random

from pyspark.sql import functions as F

from strandframe.functions import bases, motifs
from strandframe.operators import assembly, homology, pairs, sequences

R = random.Random(5)
SEQS = ["".join(R.choice("ATGC") for _ in range(n)) for n in (30, 41, 25, 60, 8, 0)]
SEQS += [SEQS[0], SEQS[1][:20] + "A" + SEQS[1][20:], SEQS[3][5:50], SEQS[2][:12] + "T" + SEQS[2][13:], None]
ROWS = list(enumerate(SEQS))
OTHER = str.maketrans("ATGC", "TACG")


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "seq_id long, seq string")


def aligned(a, b, match=1.0, mismatch=-0.9, gap=-1.0):
    row = [j * gap for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [(i + 1) * gap]
        for j, y in enumerate(b):
            new.append(max(row[j] + (match if x == y else mismatch), row[j + 1] + gap, new[j] + gap))
        row = new
    return row[-1]


def shifted(a, b, errors):
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    share, run = (0.0, 0), (0, 0)
    for shift in range(-(n // 2), n // 2 + 1):
        same = [x == y for x, y in zip(a[max(shift, 0) :], b[max(-shift, 0) :])]
        if same and sum(same) / len(same) > share[0]:
            share = (sum(same) / len(same), shift)
        best = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i:j].count(False) <= errors), default=0)
        if best > run[0]:
            run = (best, shift)
    return share, run


def words(s, k):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def meets(k):
    return {(i, j) for i, a in ROWS for j, b in ROWS if i < j and a and b and words(a, k) & words(b, k)}


def test_pairs_share_a_word(spark):
    got = pairs.shared_word_pairs(frame(spark), 8).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(meets(8))
    assert all((r.a_seq, r.b_seq) == (SEQS[r.a], SEQS[r.b]) for r in got)


def test_scores_equal_plain_tables(spark):
    both = [(i, j, a, b) for i, a in ROWS for j, b in ROWS if i < j and a is not None and b is not None]
    table = spark.createDataFrame([*both, (0, 99, SEQS[0], None)], "a long, b long, a_seq string, b_seq string")
    got = {(r.a, r.b): r for r in pairs.score_pairs(table).collect()}
    assert set(got) == {p[:2] for p in both}
    for i, j, a, b in both:
        share, run = shifted(a, b, 1)
        r = got[i, j]
        assert math.isclose(r.score, aligned(a, b), abs_tol=1e-9)
        assert (round(r.share, 9), r.share_shift, r.run, r.run_shift) == (round(share[0], 9), share[1], *run)
        assert math.isclose(r.rc_share, shifted(a, b.translate(OTHER)[::-1], 1)[0][0])


def test_clusters_hold_every_row(spark):
    links = [(i, j) for i, j in meets(8) if aligned(SEQS[i], SEQS[j]) >= 0.8 * max(len(SEQS[i]), len(SEQS[j]))]
    want = {i: i for i, _ in ROWS}
    for _ in ROWS:
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    got = pairs.similar_clusters(frame(spark), 8, 0.8).collect()
    assert sorted(map(tuple, got)) == sorted(want.items()) and len(set(want.values())) < len(want)
    assert pairs.similar_clusters(frame(spark, []), 8, 0.8).count() == 0


def test_templates_do_not_depend_on_order(spark):
    base = SEQS[0][:20]
    near, chain = "C" + base[1:] if base[0] != "C" else "A" + base[1:], None
    chain = near[:10] + ("T" if near[10] != "T" else "G") + near[11:18] + ("GA" if near[18:] != "GA" else "CT")
    rows = [(5, base), (2, near), (9, chain), (7, base), (1, "ACGT" * 5), (3, "AC"), (4, None)]
    linked = sum(x != y for x, y in zip(near, chain)) <= 2
    got = {r.centroid: (r.n, r.template) for r in pairs.template_groups(frame(spark, rows), 20).collect()}
    members = [base, near] + [chain] * linked
    code = {frozenset(of): c for c, of in bases.IUPAC.items()}
    assert got[2] == (2 + 1 + linked, "".join(code[frozenset(m[i] for m in members)] for i in range(20)))
    assert got[1] == (1, "ACGT" * 5)
    again = {r.centroid: (r.n, r.template) for r in pairs.template_groups(frame(spark, rows[::-1]), 20).collect()}
    assert got == again


def test_counts_fold_into_the_most_frequent_container(spark):
    rows = [("A", 5), ("TA", 3), ("TAG", 3), ("CAC", 9), ("G", 1), ("", 2), ("TTT", 4), ("TT", 4)]
    got = dict(map(tuple, pairs.contained_in_frequent(spark.createDataFrame(rows, "word string, n long")).collect()))
    assert got == {"CAC": 14, "TAG": 3 + 3 + 1, "TTT": 8, "": 2}


def test_alignment_is_trimmed_from_both_ends(spark):
    rows = [("a", "--ATG-C--"), ("a", "-AA-GGC--"), ("a", "---TGGCA-"), ("b", "A-"), ("b", "-T"), (None, "AC"), (None, "AC"), ("c", "")]
    got = pairs.trimmed_alignment(spark.createDataFrame(rows, "g string, s string"), "g", "s", 2).collect()
    want = {"--ATG-C--": "ATG-C", "-AA-GGC--": "A-GGC", "---TGGCA-": "-TGGC", "A-": "", "-T": "", "": ""}
    assert all(r.trimmed == want[r.s] for r in got if r.s in want) and len(got) == len(rows)


def test_best_per_model(spark):
    rows = [("m", 5.0, 10), ("m", 7.0, 10), ("m", 7.0, 9), ("n", 1.0, 10), ("o", None, 1), (None, 9.0, 1)]
    got = pairs.best_per_model(spark.createDataFrame(rows, "model string, score double, size long"), "model", F.col("score"), F.col("size"), 0.5).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("m", 7.0, 9), (None, 9.0, 1)]))


def test_consensus_functions(spark):
    table = spark.createDataFrame([("NNARGN",), ("",), ("BBB",), (None,)], "s string")
    s = F.col("s")
    got = {r.s: r for r in table.select("s", motifs.consensus_entropy(s).alias("e"), motifs.consensus_logprob(s).alias("l"), motifs.consensus_minimal(s).alias("m"), motifs.consensus_sample(s, s).alias("x")).collect()}
    assert math.isclose(got["NNARGN"].e, math.log(2) / 2 / 6) and got["NNARGN"].l == math.inf and got["NNARGN"].m == "AAAAGA"
    assert got[""].e == 1.0 and got["BBB"].l == 0.0 and got["BBB"].m == "TTT" and got[None].m is None
    assert len(got["BBB"].x) == 3 and set(got["BBB"].x) <= set("CGT") and got["NNARGN"].x[2] == "A" and got["NNARGN"].x[3] in "AG"


def test_gene_parts_and_background(spark):
    rows = [("1", 5, 9, "transcript", "G", None), ("1", 5, 9, "transcript", None, "G"), ("1", 5, 9, "exon", "G", None), ("1", 5, 9, "transcript", "H", "I")]
    table = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, feature_type string, gene_name string, parent string")
    assert assembly.of_gene(table, "G").count() == 2
    contigs = spark.createDataFrame([("1", 1, 1000), ("2", 2, 50_000)], "chrom string, chrom_rank int, length long")
    many = spark.range(500).select(F.lit("9").alias("chrom"), F.col("id").cast("string").alias("id"), F.lit(10).alias("start_pos"), F.lit(40).alias("end_pos"))
    got = assembly.background_intervals(many, contigs, 100).collect()
    assert len(got) == 500 and 150 < sum(r.chrom == "1" for r in got) < 350
    assert all(r.end_pos - r.start_pos == 30 and r.start_pos > 100 and r.end_pos <= {"1": 900, "2": 49_900}[r.chrom] for r in got)


def test_both_sides_of_variants(spark):
    regions = spark.createDataFrame([(1, "1", 11, "ACGTACGT"), (2, "1", 100, "AAA")], "seq_id long, chrom string, start_pos long, seq string")
    calls = spark.createDataFrame([("1", 12, "CG", "C"), ("1", 13, "G", "T"), ("1", 15, "A", "ATT"), ("1", 17, "C", "G")], "chrom string, pos long, ref string, alt string")
    a, b = sorted(sequences.aligned_variants(regions, calls).collect())
    assert (a.aligned_ref, a.aligned_personal) == ("ACGTA--CGT", "AC-TATTCGT") and [tuple(m) for m in a.moved] == [(12, -1), (15, 2)]
    assert (b.aligned_ref, b.aligned_personal, b.moved) == ("AAA", "AAA", [])


def test_homology_finds_planted_places_on_both_strands(spark):
    text = "".join(R.choice("ATGC") for _ in range(9000))
    probe = "".join(R.choice("ATGC") for _ in range(120))
    worn = probe[:40] + "".join("T" if c != "T" else "A" for c in probe[40:46]) + probe[46:]
    text = text[:1990] + probe + text[2110:6000] + worn.translate(OTHER)[::-1] + text[6120:]
    for cuts in ([0, 9000], [0, 2000, 2040, 2050, 6010, 9000]):  # the first hit lies over borders
        chunks = spark.createDataFrame([("1", a + 1, text[a:b]) for a, b in zip(cuts, cuts[1:])], "chrom string, chunk_start long, seq string")
        got = {(r.start, r.strand): r for r in homology.homology_search(chunks, probe, 256, 4).collect()}
        assert got[1991, "+"].share == 1.0 and math.isclose(got[6001, "-"].share, 114 / 120)
    assert homology.homology_search(chunks.limit(0), probe, 256, 4).count() == 0


def test_profiles_equal_to_themselves_are_no_distance_apart(spark):
    rows = [("x", 0, 3, 1, 0, 0), ("x", 1, 0, 0, 5, 5), ("y", 0, 3, 1, 0, 0), ("y", 1, 0, 0, 5, 5), ("z", 0, 0, 0, 2, 2), ("z", 1, 0, 0, 0, 0)]
    got = {(r.a, r.b): r for r in homology.profile_distances(spark.createDataFrame(rows, "name string, pos int, A long, T long, G long, C long")).collect()}
    assert tuple(got["x", "y"])[2:] == (0.0, 0, 0.0, 0.0)
    assert tuple(got["x", "z"])[2:5] == (2.0, 1, 4.0)


def test_patterns_on_both_strands():
    assert bases.iupac_regex_both("RAT") == "(?:[AG]AT|AT[CT])" and bases.iupac_regex_both("ATAT") == "ATAT"


def test_a_word_that_many_hold_is_dealt_to_blocks(spark):
    rows = [(i, "w" if i < 300 else f"v{i % 7}", f"t{i}") for i in range(340)]
    df = spark.createDataFrame(rows, "node long, word string, t string")
    got = pairs.self_pairs(df, ["word"], "node", block=50).collect()
    want = {(i, j) for i, a, _ in rows for j, b, _ in rows if i < j and a == b}
    assert len(got) == len(want) and {tuple(sorted((x["x_node"], x["y_node"]))) for x in got} == want
    assert all(x["x_t"] == f"t{x['x_node']}" for x in got)


def test_shifts_of_long_and_odd_pairs():
    r = random.Random(3)
    a = "".join(r.choice("ACGT") for _ in range(3000))
    share, at, run, run_at = pairs.shift_scores([a, "éé", "", "ACGT"], [a[37:] + a[:37], "ee", "ACG", "ACGTACGT"], 1)
    assert at[0] == 37 and run_at[0] == 37 and run[0] >= 3000 - 37
    assert share.tolist()[1:] == [0.0, 0.0, 1.0] and run.tolist()[1:] == [1, 0, 4]


def test_shared_words_of_repeats_and_copies_are_stored_by_key(spark, monkeypatch):
    r = random.Random(8)
    run = "".join(r.choice("ATGC") for _ in range(60))
    texts = [run, "T" + run[3:], "A" * 30, "A" * 25 + "CC", run[20:50], run, "CAT" * 9, "G" + "CAT" * 8, run[:7], run[5:13], "A" * 30]
    stored = []
    monkeypatch.setattr(pairs, "materialize", lambda df, keep=pairs.materialize: stored.append(df.columns) or keep(df))
    got = sorted((x.a, x.b, x.a_seq, x.b_seq) for x in pairs.shared_word_pairs(frame(spark, list(enumerate(texts))), 8).collect())
    assert got == [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and words(a, 8) & words(b, 8)]
    assert ["p", "q"] in stored  # pairs come to their texts when each is there once, by keys


def test_near_templates_meet_by_two_spread_parts(spark, monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("ATGC") for _ in range(40)) for _ in range(12)]
    for t in texts[:8]:
        texts.append("".join(r.choice("ATGCNx") if i in r.sample(range(40), 5) else c for i, c in enumerate(t)))
    texts += [texts[0][:36] + "NNNN", texts[0][:35] + "NNNNN", texts[0][:36] + "xxxx"]
    texts += ["ACGTACGT" + "".join(r.choice("ATGC") for _ in range(32)) for _ in range(60)]
    met = []
    monkeypatch.setattr(pairs, "self_pairs", lambda rows, *a, keep=pairs.self_pairs: met.append(keep(rows, *a)) or met[-1])
    near = pairs._near_texts(spark.createDataFrame(list(enumerate(texts)), "least long, t string"), 40, 4)
    want = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and sum(x != y for x, y in zip(a, b)) <= 4]
    assert sorted(map(tuple, near.collect())) == want and len(want) > 3
    assert met[0].count() < 1000  # one common word of 8 letters would bring all pairs of 60 together
    got = {x.centroid: x.template for x in pairs.template_groups(frame(spark, [(0, "ACGTNACGTR"), (1, "xCGTNACYTA")]), 10).collect()}
    assert got == {0: "ACGTNACGTR", 1: "CGTNACYTA"}


def test_clusters_pair_no_lengths_too_far_apart(spark, monkeypatch):
    r = random.Random(6)
    word = "".join(r.choice("ATGC") for _ in range(12))
    texts = [word + "".join(r.choice("ATGC") for _ in range(3 * n)) for n in range(10)]
    texts += [t[:-1] + ("A" if t[-1] != "A" else "C") for t in texts[3:]]
    made = []
    monkeypatch.setattr(pairs, "shared_word_pairs", lambda *a, keep=pairs.shared_word_pairs, **k: made.append(keep(*a, **k)) or made[-1])
    got = dict(map(tuple, pairs.similar_clusters(frame(spark, list(enumerate(texts))), 10, 0.8).collect()))
    want = {i: i for i in range(len(texts))}
    for _ in texts:
        for i, a in enumerate(texts):
            for j, b in enumerate(texts[:i]):
                if aligned(a, b) >= 0.8 * max(len(a), len(b)) - 1e-9:
                    want[i] = want[j] = min(want[i], want[j])
    assert got == want
    assert all(min(len(x.a_seq), len(x.b_seq)) >= 0.89 * max(len(x.a_seq), len(x.b_seq)) for x in made[0].collect())
