"""Scans of sequences against plain Python, with nulls, empty texts, odd letters and repeated ids."""

import random
import re
from collections import Counter

import numpy as np

from strandframe.operators import scans
from strandframe.streaming.detectors import sliding_windows

COMPLEMENT = str.maketrans("ACGT", "TGCA")
R = random.Random(11)
TEXTS = ["".join(R.choice("ACGT") for _ in range(n)) for n in (60, 200, 5, 0)] + ["ACGTTNACGTAANNACGT" * 3, "GATTACA" + "CCC" + "TGTAATC" + "A" * 9, "GGATATCC", None, "CATATCATATG"]
ROWS = [(min(i, 7), t) for i, t in enumerate(TEXTS)]  # the last rows share an id


def frame(spark):
    return spark.createDataFrame(ROWS, "seq_id long, seq string")


def same(df, want):
    assert Counter(map(tuple, df.collect())) == Counter(want)


def test_dyads_and_direct_repeats(spark):
    want, repeats = [], []
    for i, t in ROWS:
        t = t or ""
        for p in range(len(t) - 3):
            w = t[p : p + 4]
            if "N" in w:
                continue
            want += [(i, p, g, w) for g in range(3, 8) if t[p + 4 + g : p + 8 + g] == w.translate(COMPLEMENT)[::-1]]
            repeats += [(i, p, s) for s in range(1, 13) if t[p + s : p + s + 4] == w]
    same(scans.dyads(frame(spark), 4, 3, 7), want)
    same(scans.direct_repeats(frame(spark), 4, 12), repeats)


def test_expanded_dyads(spark):
    want = []
    for i, t in ROWS:
        t, best = t or "", {}
        for s in range(len(t)):
            for g in range(3, 8):
                if t[s : s + 4] and len(t[s : s + 4]) == 4 and "N" not in t[s : s + 4] and t[s + 4 + g : s + 8 + g] == t[s : s + 4].translate(COMPLEMENT)[::-1]:
                    a, e, x, y = s, s + 8 + g, s + 4, s + 4 + g
                    while a > 0 and e < len(t) and t[a - 1] != "N" and t[a - 1].translate(COMPLEMENT) == t[e]:
                        a, e = a - 1, e + 1
                    while y - x - 2 >= 3 and t[x] != "N" and t[x].translate(COMPLEMENT) == t[y - 1]:
                        x, y = x + 1, y - 1
                    if a + e not in best or best[a + e][1] < e:
                        best[a + e] = (a, e, x - a)
        want += [(i, a, e, m, e - a - 2 * m) for a, e, m in best.values()]
    same(scans.expanded_dyads(frame(spark), 4, 3, 7), want)


def test_long_repeats(spark):
    want = []
    for i, t in ROWS:
        t, rows = t or "", []
        for shift in range(1, min(20, len(t) - 1) + 1):
            best, run = (0, 0), 0
            for p in range(len(t) - shift + 1):
                if p < len(t) - shift and t[p] == t[p + shift] and t[p] != "N":
                    run += 1
                else:
                    best, run = max(best, (run, -(p - run))) if run else best, 0
            rows.append((shift, -best[1], best[0]))
        sizes = np.array([r[2] for r in rows] or [0])
        want += [(i, *r) for r in rows if r[2] > sizes.mean() + sizes.std() and r[2] >= 4]
    same(scans.long_repeats(frame(spark), 20, 1.0, 4), want)


def test_patterns_keep_rows_that_share_an_id_apart(spark):
    patterns = {"at": "AT", "any": "A[CG]?T"}
    want = [(i, name, m.start(), m.end(), m[0]) for i, t in ROWS for name, p in patterns.items() for m in re.finditer(p, t or "")]
    same(scans.regex_hits(frame(spark), patterns), want)


def test_matrices_on_both_strands(spark):
    pwm = spark.createDataFrame([("m", k, b, 20.0 if b == w else 1.0) for k, w in enumerate("GATT") for b in "ACGT"], "motif_id string, pos int, base string, cnt double")
    hits = scans.pwm_scan(frame(spark), pwm, 0.99, both_strands=True).select("seq_id", "strand", "start", "kmer")
    want = [(i, s, p, w) for i, t in ROWS for s, w in (("+", "GATT"), ("-", "AATC")) for p in range(len(t or "") - 3) if t[p : p + 4] == w]
    same(hits, want)
    assert want


def test_windows_farther_apart_than_they_are_long(spark, tmp_path):
    text = "ACGTTGCAACGGTTAACCGGATATCCGGAA"
    rows = [("1", 1 + k, text[k : k + 6]) for k in range(0, len(text), 6)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "chrom string, chunk_start long, seq string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("chrom string, chunk_start long, seq string").parquet(src)
    hits = sliding_windows(stream, 4, 10, lambda s: 1.0, 0.5)
    hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["start"] for r in spark.read.parquet(out).collect()) == [1, 11, 21]


def test_common_lengths_equal_walks():
    r = np.random.default_rng(3)
    for letters, n in ((2, 60), (4, 200), (1, 40)):
        x, y = r.integers(0, letters, n), r.integers(0, letters, n + 7)
        x[r.integers(0, n, 3)] = -1
        y[r.integers(0, n, 3)] = -1
        i, j = r.integers(0, n + 1, 300), r.integers(0, n + 8, 300)
        want = []
        for a, b in zip(i, j):
            k = 0
            while a + k < n and b + k < n + 7 and x[a + k] == y[b + k] >= 0:
                k += 1
            want.append(k)
        assert scans.common_lengths(x, y, i, j).tolist() == want


def test_dyads_that_lie_within_no_other(spark):
    every = [tuple(x) for x in scans.expanded_dyads(frame(spark), 4, 3, 7).collect()]
    want = [x for x in every if not any(x != y and x[0] == y[0] and y[1] <= x[1] and y[2] >= x[2] for y in every)]
    assert sorted(map(tuple, scans.expanded_dyads(frame(spark), 4, 3, 7, nested=False).collect())) == sorted(want)


def test_a_long_repeat_of_two_letters_is_quick(spark):
    import time

    df = spark.createDataFrame([(1, "AT" * 32_000)], "seq_id long, seq string")
    scans.expanded_dyads(spark.createDataFrame([(1, "AT" * 20)], "seq_id long, seq string"), 6, 3, 8).collect()
    began = time.time()
    assert [tuple(x)[1:3] for x in scans.expanded_dyads(df, 6, 3, 8, nested=False).collect()] == [(0, 64_000)]
    assert time.time() - began < 15
