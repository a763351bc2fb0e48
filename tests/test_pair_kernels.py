"""Alignments and shifts of many pairs at once against plain tables, ties and odd letters included."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import alignment, pairs


def plain(a, b, match, mismatch, gap):
    table = [[gap * (i + j) if not i or not j else None for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(table[i - 1][j - 1] + (match if x == y else mismatch), table[i - 1][j] + gap, table[i][j - 1] + gap)
    i, j, one, two = len(a), len(b), "", ""
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j, one, two = i - 1, j - 1, a[i - 1] + one, b[j - 1] + two
        elif i and table[i][j] == table[i - 1][j] + gap:
            i, one, two = i - 1, a[i - 1] + one, "-" + two
        else:
            j, one, two = j - 1, "-" + one, b[j - 1] + two
    return table[-1][-1], one, two


def couples(seed, n=120):
    r, out = random.Random(seed), [("", ""), ("", "ACG"), ("ACG", ""), ("A", "A"), ("é" * 5, "e\U0001f9ec" * 2)]
    for _ in range(n):
        letters = r.choice(["AC", "ACGT", "ACGTé"])
        a = "".join(r.choice(letters) for _ in range(r.randrange(52)))
        b = [*a[r.randrange(len(a) + 1) :], *(r.choice(letters) for _ in range(r.randrange(20)))]
        for _ in range(r.randrange(4) if b else 0):
            b[r.randrange(len(b))] = r.choice(letters)
        out.append((a, "".join(b)))
    return out


@pytest.mark.parametrize("tenths", [(10, -9, -10), (20, -35, -1), (10, 0, 0)])
def test_alignments_and_scores_alone_equal_a_plain_table(tenths):
    left, right = zip(*couples(sum(tenths)))
    score, one, two = alignment.aligned(list(left), list(right), *[t / 10 for t in tenths])
    alone = alignment.aligned(list(left), list(right), *[t / 10 for t in tenths], strings=False)
    assert score == alone[0] and not any(alone[1]) and not any(alone[2])
    want = [plain(a, b, *tenths) for a, b in zip(left, right)]
    assert [(round(10 * s), p, q) for s, p, q in zip(score, one, two)] == want


def test_a_batch_of_alignments_takes_two_bytes_a_cell(monkeypatch):
    kinds = set()
    monkeypatch.setattr(alignment.np, "full_like", lambda h, *a, keep=alignment.np.full_like: kinds.add(h.dtype.name) or keep(h, *a))
    alignment.aligned(*map(list, zip(*couples(1))))
    alignment.aligned(["ACGT" * 1000], ["ACGA" * 1000])
    assert kinds == {"int16", "int32"}


@pytest.mark.parametrize("errors", [0, 1, 3])
def test_shifts_equal_plain_loops(errors):
    left, right = zip(*couples(errors + 5))
    got = pairs.shift_scores(list(left), list(right), errors)
    for k, (a, b) in enumerate(zip(left, right)):
        n = min(len(a), len(b))
        share, run = (0.0, 0), (0, 0)
        for shift in range(-(n // 2), n // 2 + 1):
            same = [x == y for x, y in zip(a[:n][max(shift, 0) :], b[:n][max(-shift, 0) :])]
            if same and sum(same) / len(same) > share[0]:
                share = (sum(same) / len(same), shift)
            best = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i:j].count(False) <= errors), default=0)
            run = max(run, (best, shift), key=lambda x: x[0])
        assert tuple(x[k] for x in got) == (*share, *run)


def test_near_templates_meet_in_waves_of_parts(spark, monkeypatch):
    r = random.Random(9)
    texts = ["".join(r.choice("ATGC") for _ in range(20)) for _ in range(30)]
    texts += ["".join(r.choice("ATGC") if i in r.sample(range(20), 3) else c for i, c in enumerate(t)) for t in texts]
    texts = sorted(set(texts))
    want = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and sum(x != y for x, y in zip(a, b)) <= 2]
    df, met, keep = spark.createDataFrame(list(enumerate(texts)), "least long, t string"), [], pairs.self_pairs
    monkeypatch.setattr(pairs, "self_pairs", lambda rows, *a: met.append(rows.groupBy("least").count().agg(F.max("count")).first()[0]) or keep(rows, *a))
    for wave, sizes in ((1, [1] * 6), (len(texts) * 4, [4, 2]), (1 << 23, [6])):
        monkeypatch.setattr(pairs, "WAVE", wave)
        met.clear()
        assert sorted(map(tuple, pairs._near_texts(df, 20, 2).collect())) == want and met == sizes and len(want) > 10


def test_template_centres_do_not_depend_on_waves(spark, monkeypatch):
    r = random.Random(7)
    df = spark.createDataFrame([(i, "".join(r.choice("AC") for _ in range(20))) for i in range(60)], "seq_id long, seq string")
    want = sorted(map(tuple, pairs.template_groups(df, 20, greedy=True).collect()))
    cells, keep = [], pairs.self_pairs
    monkeypatch.setattr(pairs, "self_pairs", lambda *a: cells.append(1) or keep(*a))
    monkeypatch.setattr(pairs, "WAVE", 130)
    assert sorted(map(tuple, pairs.template_groups(df, 20, greedy=True).collect())) == want and len(cells) == 3
