"""Steps whose work must grow no faster than their input: what is exploded, sorted or shuffled, and the same results."""

import hashlib
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandframe.operators import alignment, pairs, scans
from strandframe.operators import sequences as sq

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = [(1, "GATTACAGATTACA"), (2, "ACGTNACGT"), (1, "GATTACC"), (3, ""), (None, "AAAA"), (None, "AAAT"), (4, None), (5, "AC"), (6, "ACGTTTé")]


def _words(k):
    out = {}
    for key, text in ROWS:
        for i in range(len(text or "") - k + 1):
            out.setdefault(key, Counter())[text[i : i + k]] += 1
    return out


def test_words_of_rows_that_share_an_id_are_counted_together(spark):
    seqs = spark.createDataFrame(ROWS, "seq_id long, seq string")
    want = _words(3)
    assert {r["seq_id"]: (r["n_distinct"], r["n_total"]) for r in sq.distinct_words(seqs, 3).collect()} == {k: (len(c), c.total()) for k, c in want.items()}
    got = {r["seq_id"]: r["entropy"] for r in sq.ngram_entropy(seqs, 3).collect()}
    assert got.keys() == want.keys()
    for k, c in want.items():
        assert got[k] == pytest.approx(-sum(n / c.total() * math.log2(n / c.total()) for n in c.values()), abs=1e-9)
    top = {(r["seq_id"], r["rank"]): (r["kmer"], r["n"]) for r in sq.top_kmers(seqs, 3, 2).collect()}
    assert top == {(k, i + 1): x for k, c in want.items() for i, x in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:2])}


@pytest.mark.parametrize("name", ["agg_distinct_words", "agg_ngram_entropy", "agg_top_kmers", "agg_transitions", "agg_mutual_information", "fn_places", "agg_repeat_phase", "agg_aligned_spectrum", "fn_consensus_scores"])
def test_no_letter_or_word_becomes_a_row(spark, name):
    plan = _plan(__spark_entry__.queries()[name](spark, SF))
    assert "Generate" not in plan and "lambda" not in plan and "translate(s#" not in plan


def test_pieces_are_cut_before_they_are_dealt(spark):
    """An interval's aggregate read, and sorted, a piece of 4096 bases for each interval."""
    intervals = spark.createDataFrame([("1", 3, 9, "-"), ("1", 8, 12, "+"), ("1", 90, 95, "+")], "chrom string, start_pos long, end_pos long, strand string")
    chunks = spark.createDataFrame([("1", 1, "GATTACAGAT"), ("1", 11, "CCGT")], "chrom string, chunk_start long, seq string")
    out = sq.interval_sequences(intervals, chunks)
    plan = _plan(out)
    assert "REPARTITION_BY_COL" in plan
    assert {r["start_pos"]: r["seq"] for r in out.collect()} == {3: "TCTGTAA", 8: "GATCC", 90: None}


def test_word_places_overlap_and_match_as_a_whole(spark):
    seqs = spark.createDataFrame([(1, "TATATAT"), (2, "TAT"), (3, None)], "seq_id long, seq string")
    assert sorted((r["seq_id"], r["pos"], r["kmer"]) for r in scans.word_places(seqs, "TA[TG]A|TAT", 4, "seq_id").collect()) == [(1, 0, "TATA"), (1, 2, "TATA")]


def test_spectrum_counts_equal_keys_together(spark):
    rows = spark.createDataFrame([("x", "ACGT-", "AGGTA"), ("x", "CC", "GCé"), (None, "A", "T"), ("y", None, "A"), ("y", "", "A"), ("y", "éA", "AG")], "k string, one string, two string")
    plan = _plan(alignment.spectrum(rows, "one", "two", ["k"]))
    assert "Generate" not in plan
    got = lambda *a: {tuple(r)[:-1]: r["n"] for r in alignment.spectrum(rows, "one", "two", *a).collect()}
    assert got(["k"]) == {("x", "CG"): 2, (None, "AT"): 1, ("y", "AG"): 1}
    assert got([], True) == {("S",): 2, ("W",): 1, ("R",): 1}


def test_consensus_scores_and_phases(spark):
    rows = spark.createDataFrame([(1, "NNARNCN"), (2, ""), (3, "NNN"), (4, "ACGT")], "doc_id long, s string")
    got = {r["doc_id"]: r for r in scans.consensus_scores(rows, "doc_id", "s").collect()}
    assert got[1]["entropy"] == pytest.approx((math.log(2) / 2 + math.log(4) / 4) / 7) and got[1]["logprob"] == pytest.approx(-2 * math.log(3) - math.log(2))
    assert got[2]["entropy"] == 1.0 and got[2]["logprob"] == 0.0 and got[3]["entropy"] == 0.0
    assert got[1]["minimal"] == hashlib.md5(b"AAAAACA").hexdigest()
    phases = scans.unit_phases(spark.createDataFrame([(1, "TCATCA"), (2, "GGG"), (3, "")], "seq_id long, seq string"), "ATC")
    assert {r["seq_id"]: (r["phase"], r["matches"]) for r in phases.collect()} == {1: (1, 6), 2: (0, 0)}


def test_letters_of_an_alignment_do_not_become_rows(spark):
    texts = ["-" * (i % 5) + "AC-G" * 20 + "é-T" for i in range(200)] + [None, "", "---", "-é"]
    df = spark.createDataFrame([(i % 7, s) for i, s in enumerate(texts)], "g long, s string")
    got = pairs.trimmed_alignment(df, "g", "s", 2)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    groups = {g: [s or "" for i, s in enumerate(texts) if i % 7 == g] for g in range(7)}
    full = {g: [p for p in range(90) if sum(s[p : p + 1] not in ("", "-") for s in own) >= 2] for g, own in groups.items()}
    want = [(i % 7, s, (s or "")[full[i % 7][0] : full[i % 7][-1] + 1]) for i, s in enumerate(texts)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_longest_runs_take_words_not_letters():
    """A million letters and 60 shifts in little time; before, each shift listed the ends of all its runs."""
    pick = random.Random(3)
    for _ in range(300):
        text = "".join(pick.choices("01", [1, pick.choice([1, 9])], k=pick.randrange(0, 70)))
        longest = max((len(r) for r in text.split("0")), default=0)
        assert scans._longest_run(int(text[::-1] or "0", 2)) == ((text.index("1" * longest), longest) if longest else (0, 0))
    bits = int.from_bytes(pick.randbytes(125_000), "little")
    began = time.process_time()
    for shift in range(1, 61):
        scans._longest_run(bits & (bits >> shift))
    assert time.process_time() - began < 1.5
