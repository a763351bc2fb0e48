"""Coding sequences, codons over borders and protein changes against plain Python."""

import random

from pyspark.sql import functions as F

from strandframe.functions import bases, proteins
from strandframe.operators import coding

CODON = {a + b + c: bases.CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
OTHER = str.maketrans("ATGC", "TACG")


def reference(spark, seed=3, chroms=2, n=6000):
    r = random.Random(seed)
    whole = {str(c): "".join(r.choice("ACGT") for _ in range(n)) for c in range(chroms)}
    rows = []
    for c, text in whole.items():
        at = 0
        while at < n:
            size = r.choice([1, 7, 300, 2000])
            rows.append((c, at + 1, text[at : at + size]))
            at += size
    return whole, spark.createDataFrame(rows, "chrom string, chunk_start long, seq string")


def segments(r, whole, count=60):
    out = []
    for t in range(count):
        c, strand, at = r.choice(sorted(whole)), r.choice("+-"), r.randrange(1, 5000)
        for _ in range(r.randrange(1, 6)):
            end = at + r.randrange(0, 70)
            out.append((f"t{t}", c, strand, at, end))
            at = end + r.randrange(2, 60)
    out.append(("outside", "0", "+", 5990, 6050))
    out.append(("gone", "0", "-", 7000, 7050))
    return out


def read(segs, whole, changed=None):
    """{transcript: (segments in reading order, their sequences)}"""
    out = {}
    for t, c, s, a, b in segs:
        out.setdefault((t, c, s), []).append((a, b))
    done = {}
    for (t, c, s), parts in out.items():
        parts = sorted(parts, reverse=s == "-")
        texts = []
        for a, b in parts:
            text = whole[c][a - 1 : b]
            if changed:
                text = changed(c, a, text)
            texts.append(text.translate(OTHER)[::-1] if s == "-" else text)
        done[t, c, s] = (parts, texts)
    return done


def translated(texts, verify=True):
    first = texts[0]
    at = next((i for i in range(0, min(len(first) - 2, 100), 3) if first[i : i + 3] in proteins.START_CODONS), None)
    if at is None and not verify:
        at = 0
    if at is None:
        return None, "", ""
    text = "".join(texts)[at:]
    every = "".join(CODON[text[i : i + 3]] for i in range(0, len(text) - 2, 3))
    return at, text, every.split("*")[0] if verify else every


def test_coding_sequences_equal_plain_reading(spark):
    whole, chunks = reference(spark)
    segs = segments(random.Random(5), whole)
    df = spark.createDataFrame(segs, "transcript string, chrom string, strand string, start_pos long, end_pos long")
    for verify in (True, False):
        got = {r["transcript"]: r for r in coding.coding_sequences(df, chunks, verify=verify).collect()}
        want = read(segs, whole)
        assert set(got) == {t for (t, _, _), (_, x) in want.items() if "".join(x)}
        for (t, c, s), (parts, texts) in want.items():
            if t not in got:
                continue
            at, text, protein = translated(texts, verify)
            r = got[t]
            assert (r["start_at"], r["coding"] or "", r["protein"] or "") == (at, text, protein)
            assert r["complete"] == (sum(b - a + 1 for a, b in parts) == sum(map(len, texts)))
            if at is not None and r["complete"]:
                line = [p for a, b in parts for p in (range(b, a - 1, -1) if s == "-" else range(a, b + 1))]
                assert r["translation_start"] == line[at]
                stop = ("".join(CODON[text[i : i + 3]] for i in range(0, len(text) - 2, 3))).find("*")
                assert r["translation_end"] == (line[at + 3 * stop + 2] if stop >= 0 else None)
    assert coding.coding_sequences(df.limit(0), chunks).count() == 0


def test_codon_over_a_border_on_both_strands(spark):
    text = "CCATGA" + "GGGG" + "AACCC" + "TTTTT"  # segments 3-6 and 11-13: ATGA, AAC: ATG AAA C
    chunks = spark.createDataFrame([("1", 1, text[:5]), ("1", 6, text[5:]), ("2", 1, text.translate(OTHER)[::-1])], "chrom string, chunk_start long, seq string")
    segs = [("p", "1", "+", 3, 6), ("p", "1", "+", 11, 13), ("m", "2", "-", 15, 18), ("m", "2", "-", 8, 10)]
    df = spark.createDataFrame(segs, "transcript string, chrom string, strand string, start_pos long, end_pos long")
    seqs = {r["transcript"]: (r["coding"], r["protein"]) for r in coding.coding_sequences(df, chunks).collect()}
    assert seqs == {"p": ("ATGAAAC", "MK"), "m": ("ATGAAAC", "MK")}
    variants = spark.createDataFrame([("1", 6, "A", "T"), ("1", 11, "A", "G"), ("2", 15, "T", "A"), ("2", 10, "T", "C"), ("1", 12, "C", "A"), ("1", 8, "G", "A"), ("1", 3, "A", "AC")], "chrom string, pos long, ref string, alt string")
    got = sorted((r["transcript"], r["pos"], r["codon"], r["changed"], r["effect"], r["notation"]) for r in coding.codon_changes_of(variants, df, chunks).collect())
    assert got == [("m", 10, "AAA", "AGA", "missense", "p.K2R"), ("m", 15, "AAA", "TAA", "nonsense", "p.K2*"), ("p", 6, "AAA", "TAA", "nonsense", "p.K2*"), ("p", 11, "AAA", "AGA", "missense", "p.K2R")]


def test_codon_changes_equal_plain_translation(spark):
    whole, chunks = reference(spark, 7)
    r = random.Random(8)
    segs = segments(r, whole)
    variants = {(c, p): r.choice([b for b in "ACGT" if b != whole[c][p - 1]]) for c in whole for p in r.sample(range(1, 6000), 1500)}
    df = spark.createDataFrame(segs, "transcript string, chrom string, strand string, start_pos long, end_pos long")
    vs = spark.createDataFrame([(c, p, whole[c][p - 1], a) for (c, p), a in variants.items()] + [("0", 30, "N", "A"), ("0", 5, "AC", "A")], "chrom string, pos long, ref string, alt string")
    got = sorted((x["transcript"], x["pos"], x["codon_number"], x["codon"], x["changed"], x["effect"], x["notation"], x["conservative"]) for x in coding.codon_changes_of(vs, df, chunks).collect())
    want = []
    for (t, c, s), (parts, texts) in read(segs, whole).items():
        at, text, protein = translated(texts)
        if at is None or sum(b - a + 1 for a, b in parts) != sum(map(len, texts)):
            continue
        line = [p for a, b in parts for p in (range(b, a - 1, -1) if s == "-" else range(a, b + 1))][at:]
        for k in range(0, min(len(text) - 2, 3 * (len(protein) + 1)), 3):
            for i in range(3):
                if (c, line[k + i]) in variants:
                    alt = variants[c, line[k + i]]
                    alt = alt.translate(OTHER) if s == "-" else alt
                    codon = text[k : k + 3]
                    new = codon[:i] + alt + codon[i + 1 :]
                    x, y = CODON[codon], CODON[new]
                    kind = "silent" if x == y else "nonsense" if y == "*" else "readthrough" if x == "*" else "missense"
                    want.append((t, line[k + i], k // 3 + 1, codon, new, kind, f"p.{x}{k // 3 + 1}{y}", any(x in g and y in g for g in proteins.ALIKE)))
    assert got == sorted(want) and len({w[5] for w in want}) >= 3


def test_protein_changes_with_insertions_and_deletions(spark):
    whole, chunks = reference(spark, 11)
    r = random.Random(12)
    segs = segments(r, whole, 40)
    vs = []
    for c in whole:
        for p in range(20, 5900, 23):
            n = r.choice([1, 1, 1, 2, 4])
            vs.append((c, p, whole[c][p - 1 : p - 1 + n], r.choice(["A", "G", "ACG", "TT"])))
    at = {(c, p): (ref, alt) for c, p, ref, alt in vs}

    def changed(c, a, text):
        out, i = "", 0
        while i < len(text):
            ref, alt = at.get((c, a + i), ("", ""))
            if ref and text[i : i + len(ref)] == ref:
                out, i = out + alt, i + len(ref)
            else:
                out, i = out + text[i], i + 1
        return out

    df = spark.createDataFrame(segs, "transcript string, chrom string, strand string, start_pos long, end_pos long")
    frame = spark.createDataFrame(vs, "chrom string, pos long, ref string, alt string")
    for verify in (True, False):
        got = {x["transcript"]: x for x in coding.protein_changes(df, frame, chunks, verify=verify).collect()}
        plain, own = read(segs, whole), read(segs, whole, changed)
        kinds = set()
        for key, (_, texts) in plain.items():
            if not "".join(texts):
                assert key[0] not in got
                continue
            x, y = translated(texts, verify)[2], translated(own[key][1], verify)[2]
            want = [(i + 1, a, b, "nonsense" if b == "*" else "readthrough" if a == "*" else "missense", f"p.{a}{i + 1}{b}") for i, (a, b) in enumerate(zip(x, y)) if a != b]
            if len(x) != len(y):
                d = len(y) - len(x)
                want.append((min(len(x), len(y)), None, None, "length_change", f"p.{min(len(x), len(y))}_{'ext' if d > 0 else 'del'}{abs(d)}"))
            row = got[key[0]]
            assert (row["protein"], row["personal"], [tuple(c) for c in row["changes"]]) == (x, y, want)
            assert row["summary"] == ", ".join(w[4] for w in want)
            kinds |= {w[3] for w in want}
        assert kinds >= ({"missense", "length_change"} if verify else {"missense", "nonsense", "readthrough"})


def test_cds_of_transcripts(spark):
    rows = [("1", 5, 90, "transcript", "src", "+", "tx", None, 10, 60), ("1", 5, 90, "transcript", "src", "-", "none", None, None, None), ("1", 20, 30, "CDS", "src", "-", "c", "p", None, None), ("1", 20, 30, "exon", "src", "-", "c", "p", 1, 2)]
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, feature_type string, source string, strand string, name string, parent string, cds_start long, cds_end long")
    assert sorted(map(tuple, coding.cds_features(df).collect()), key=str) == sorted([("1", 20, 30, "CDS", "src", "-", "c", "p"), ("1", 10, 60, "CDS", "src", "+", None, "tx")], key=str)
    assert coding.cds_features(df.select("chrom", "start_pos", "end_pos", "feature_type")).count() == 1


def test_protein_functions(spark):
    row = spark.range(1).select(proteins.identity(F.lit("MKV"), F.lit("MRVA")).alias("i"), proteins.identity(F.lit(""), F.lit("")).alias("n"), proteins.changes(F.lit(""), F.lit("M")).alias("c"), proteins.first_start(F.lit("CCCATG")).alias("s"), proteins.first_start(F.lit("CCATG")).alias("t")).first()
    assert row["i"] == 0.5 and row["n"] is None and row["c"][0]["notation"] == "p.0_ext1" and row["s"] == 3 and row["t"] is None
