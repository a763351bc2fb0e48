"""Alignment, nearest neighbours and whitening on small tables with nulls, empties, ties and repeats, against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import annscan
from strandframe.llm.alignment import align_tokens, common_ends
from strandframe.llm.tokens import byte_alphabet
from strandframe.llm.whitening import above, leading, whiten

# --- alignment ---------------------------------------------------------------------------------------------------


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plainly_aligned(texts):
    """(ids of A, ids of B, groups, links) of each text, cut whole and compared place by place."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letters = byte_alphabet()
    bytes_a = {i: bytes(letters[c] for c in w) for w, i in a.get_vocab().items() if all(c in letters for c in w)}
    out = []
    for text in texts:
        x, y = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        part = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y}
        said = f" {text}".encode()
        if b"".join(bytes_a[i] for i in x) != said or b"".join(part[i] for i in y) != said:
            out.append(([], [], [], []))
            continue
        groups, links, p, q, i, j, at_a, at_b = [], [], 0, 0, 0, 0, 0, 0
        while i < len(x):
            at_a, i = at_a + len(bytes_a[x[i]]), i + 1
            while at_b < at_a:
                at_b, j = at_b + len(part[y[j]]), j + 1
            if at_a == at_b:
                groups.append((x[p:i], y[q:j]))
                links.append((x[i - 1], y[j - 1]))
                p, q = i, j
        out.append((x, y, groups, links))
    return out


TEXTS = [
    "", None, "a", " lead", "tail ", "two  blanks\n\n x", "tab\tz", "<|endoftext|> and </s> <s> <unk> <0x41>", "日本 語\nß é ﬁ", "held ▁ apart", "▁", "unbelievable tokenization",
    "a\x00b c", "naïve café ½ １", " ", "\n", "x" * 3000 + " " + "ab" * 900, "don't 's we've", "unbelievable tokenization", "emoji 👩‍👩‍👧 ́x  y",
]


def test_alignment_equals_plain_alignment_of_whole_texts(spark):
    texts = [*TEXTS, " ".join(t for t in TEXTS if t and "▁" not in t) * 40]
    rows = [(i if i != 6 else None, t, 1, "x") for i, t in enumerate(texts)] + [(3, "again", 2, "y"), (3, "again", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, groups string")
    got = align_tokens(df, *paths()).collect()
    plain = plainly_aligned([r[1] for r in rows])
    counts = Counter(x for p in plain for x in p[3])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = []
    for (i, *_), (a, b, groups, links) in zip(rows, plain):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if a else "", groups))
    seen = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"], [(g["a"], g["b"]) for g in r["groups"]]) for r in got]
    assert sorted(seen, key=str) == sorted(want, key=str)
    assert [p[0] for p, t in zip(plain, TEXTS) if t and "▁" in t] == [[], []]
    assert align_tokens(df.limit(0), *paths(), with_groups=False).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert align_tokens(df.limit(0), *paths()).count() == 0


def test_alignment_query_equals_plain_alignment(spark):
    from strandframe.llm.queries import QUERIES

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    plain = dict(zip((r["doc_id"] for r in docs), plainly_aligned([r["text"] for r in docs])))
    counts = Counter(x for p in plain.values() for x in p[3])
    for r in QUERIES["op11_tokenizer_alignment"](spark, data).collect():
        a, b, groups, links = plain[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["count_sum"]) == (len(a), len(b), len(groups), len(links), sum(counts[x] for x in links))


def test_ends_that_both_hold():
    a, b = common_ends(np.array([2, 5, 9, 12]), np.array([1, 5, 6, 12]))
    assert (a.tolist(), b.tolist()) == ([1, 3], [1, 3])


# --- nearest neighbours ------------------------------------------------------------------------------------------


def true_nearest(rows, k):
    """{query: its k nearest (id, cosine)} over all rows, equal rows once."""
    told = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    width = max(len(v) for _, v in told)
    ids, x = np.array([i for i, _ in told]), np.array([np.pad(v, (0, width - len(v))) for _, v in told])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    length = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        cos = (x @ x[q]) / (length * length[q])
        order = [j for j in np.lexsort((ids, -np.round(cos, 12))) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(cos[j])) for j in order]
    return out


def test_nearest_meets_its_recall_and_gives_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(annscan, "BLOCK", 40)
    monkeypatch.setattr(annscan, "PART", 3)
    monkeypatch.setattr(annscan, "LISTS", 12)
    monkeypatch.setattr(annscan, "COLUMNS", 5)
    monkeypatch.setattr(annscan, "PROBES", 2)
    monkeypatch.setattr(annscan, "SEED", 8)
    monkeypatch.setattr(annscan, "CHUNK", 16)
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 24))
    x = base[r.integers(0, 12, size=600)] + 0.4 * r.normal(size=(600, 24))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[50][1]) for i in range(200)]  # a group of copies that holds a quarter of all
    rows += [(2000, None), (2050, []), (2100, [0.0] * 24), (2150, [1.0, None] + [0.0] * 22), (2200, [math.nan] * 24), (2250, [math.inf] + [0.0] * 23), (None, rows[3][1]), rows[7], rows[7]]
    rows += [(2300, [3e200, 1e200]), (2350, [3e-200, 1e-200]), (2303, [float(2 * v) for v in x[100]])]
    df = spark.createDataFrame([(i, v, 9, "s") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = annscan.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()
    want = true_nearest(rows, 5)
    assert {g["query_id"] for g in got} == set(want)
    found = {(g["query_id"], g["vec_id"]): g["score"] for g in got}
    hit = 0
    for q, best in want.items():
        mine = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        hit += len({m[1] for m in mine} & {i for i, _ in best})
        for i, cos in best:
            assert (q, i) not in found or abs(found[q, i] - cos) < 1e-12
    assert hit >= 0.95 * 5 * len(want)
    assert got[0]["recall"] >= annscan.AIM
    # among equal vectors the smallest ids come first, a query's own left out
    assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 50] == [1000, 1001, 1002, 1003, 1004]
    assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 1050] == [50, 1000, 1001, 1002, 1003]
    assert annscan.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert annscan.nearest(df, F.lit(False)).columns == ["query_id", "rank", "vec_id", "score", "recall"]
    few = annscan.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((g["query_id"], g["rank"]) for g in few) == [(0, 1), (0, 2)]


def test_nearest_of_vectors_without_order_is_found_at_last(spark, monkeypatch):
    """Neighbours far apart: one audited query too few lists at first, and a test that drops too much."""
    monkeypatch.setattr(annscan, "STRICT", -1.5)
    r = np.random.default_rng(6)
    rows = [(i, list(map(float, v))) for i, v in enumerate(r.normal(size=(400, 32)))]
    got = annscan.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, aim=1.0).collect()
    want = {(q, i) for q, best in true_nearest(rows, 5).items() for i, _ in best}
    assert {(g["query_id"], g["vec_id"]) for g in got} == want


# --- whitening ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spectrum", [[5.0] * 7 + [3.0] * 4 + [1e-3] * 5, [1.0] * 20, [1.0] + [0.0] * 19, [4, 4 - 1e-14, 4 - 1e-10, 2, 2, 1, 0.5], list(range(1, 40))])
def test_leading_eigenpairs(spectrum):
    q = np.linalg.qr(np.random.default_rng(len(spectrum)).normal(size=(len(spectrum),) * 2))[0]
    v = (q * np.array(spectrum, dtype=float)) @ q.T
    v = (v + v.T) / 2
    values, axes = leading(v, 16)
    want = np.sort(np.array(spectrum, dtype=float))[::-1][:16]
    want = want[want > 1e-12]
    assert len(values) == len(want) and np.allclose(values, want, rtol=0, atol=1e-13 * len(v) * want[0])
    assert np.abs(v @ axes - axes * values).max() < 1e-13 * len(v) * want[0]
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-13
    for shift in np.linspace(-1, want[0] + 1, 9) + 0.0123:
        assert above(v, shift) == (np.array(spectrum) > shift).sum()


def test_inertia_without_a_diagonal_pivot():
    assert above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert above(np.zeros((3, 3)), 0.0) == 0


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 20)) * r.exponential(size=20)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(500 + i, list(map(float, x[5]))) for i in range(150)]
    rows += [(700, [0.5, -0.25]), (701, []), (None, list(map(float, x[9])))]
    out = [(800, None), (801, [1.0, None]), (802, [math.nan] * 20), (803, [math.inf] * 20), (804, [1e300] * 20)]
    df = spark.createDataFrame([(i, v, 3, "n") for i, v in rows + out], "vec_id long, embedding array<double>, component int, n string")
    got = whiten(df, 16).collect()
    whole = np.array([np.floor(64 * np.pad(v, (0, 20 - len(v)))).astype(np.int64) + 1_000_000 for _, v in rows])
    fit = np.unique(whole, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    assert len(got) == 16 * len(rows) and {g["n"] for g in got} == {n}
    mine = {}
    for g in got:
        mine.setdefault((g["vec_id"], g["component"]), []).append(g)
    sign = None
    for (i, _), row in zip(rows, whole):
        w = ((n * row - s) / n) @ u / np.sqrt(e)
        told = [mine[i, c + 1][0] for c in range(16)]
        near = np.array([t["whitened"] for t in told])
        sign = np.sign(near * w) if sign is None else sign
        assert np.allclose(near * sign, w, atol=1e-9)
        assert {t["deviation"] for t in told} == {int(((n * row - s) ** 2).sum())}
        assert np.allclose([t["explained"] for t in told], e / np.trace(cov), rtol=1e-10)
    assert max(g["identity_error"] for g in got) < 1e-9 and len({g["identity_error"] for g in got}) == 1
    assert all(len(v) == 1 for v in mine.values())


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    two = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (2, [3.0, 6.0])], schema)).collect()
    assert [(r["component"], r["n"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in two] == [(1, 2, 1.0, 1.0)] * 3
    far = whiten(spark.createDataFrame([(1, [2.0**53]), (2, [-(2.0**53)]), (3, [0.0])], schema)).collect()
    assert [r["deviation"] for r in far] == [None, None, 0]
