"""The pipeline against a plain-Python version of its five stages on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm.quality import HELD_OUT, ORDER, PRIOR, QUANTILE, START, STEPS, STOP
from strandframe.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"
TO_LOWER = {i: i + 32 for i in range(65, 91)}


def units(text):
    return "".join(map(chr, np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)))


class Model:
    """Interpolated modified Kneser-Ney, counted in dictionaries."""

    def __init__(self, texts):
        self.counts = [Counter()]
        for t in texts:
            s = START * (ORDER - 1) + units(t) + STOP
            self.counts[0].update(s[i : i + ORDER] for i in range(len(s) - ORDER + 1))
        for k in range(ORDER - 1, 0, -1):
            self.counts.append(Counter(g[-k:] for g in self.counts[-1]))
        self.d, self.total, self.spare = [], [], []
        for c in self.counts:
            n = Counter(c.values())
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                d = [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.01), k) for k in (1, 2, 3))]
            else:
                d = [0, 0.5, 1.0, 1.5]
            total, spare = Counter(), defaultdict(float)
            for g, v in c.items():
                total[g[:-1]] += v
                spare[g[:-1]] += d[min(v, 3)]
            self.d.append(d)
            self.total.append(total)
            self.spare.append(spare)

    def p(self, g, level=0):
        low = 1 / 65536 if level == ORDER - 1 else self.p(g[1:], level + 1)
        total = self.total[level][g[:-1]]
        if not total:
            return low
        n = self.counts[level][g]
        return (n - self.d[level][min(n, 3)] + self.spare[level][g[:-1]] * low) / total

    def nll(self, t):
        s = START * (ORDER - 1) + units(t) + STOP
        return -sum(math.log(self.p(s[i : i + ORDER])) for i in range(len(s) - ORDER + 1))


def quality(docs, trusted, held):
    kept = []
    for lang in {d["lang"] for d in docs}:
        own = [d for d in docs if d["lang"] == lang]
        model = Model([d["text"] for d in own if d["doc_id"] in trusted and d["doc_id"] not in held])
        told = [(d, model.nll(d["text"]), len(units(d["text"])) + 1) for d in own]
        out = [(n, k) for d, n, k in told if d["doc_id"] in held]
        if not out:
            kept += own
            continue
        mean = sum(n for n, _ in out) / sum(k for _, k in out)
        place = lambda n, k: math.floor((n + PRIOR * mean) / (k + PRIOR) * STEPS)
        bins = sorted(place(n, k) for n, k in out)
        cut = bins[math.ceil(QUANTILE * len(bins)) - 1]
        kept += [d for d, n, k in told if place(n, k) <= cut]
    return kept


def line_dedup(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(TO_LOWER)
    owner = {}
    for d in docs:
        for line in d["text"].split("\n"):
            owner[key(line)] = min(owner.get(key(line), d["doc_id"]), d["doc_id"])
    out = [d | {"text": "\n".join(x for x in d["text"].split("\n") if len(key(x)) < 10 or owner[key(x)] == d["doc_id"]), "was": d["text"]} for d in docs]
    return [d for d in out if d["text"] == d["was"] or d["text"].strip(" \t\n\x0b\x0c\r")]


def near_dedup(docs):
    """By the text and by the text before lines went."""
    sets = {}
    for d in docs:
        for k in ("text", "was"):
            w = re.findall("[^\x20\x09-\x0d]+", d[k].translate(TO_LOWER))
            sets[d["doc_id"], k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [d for d in docs if all(top((d["doc_id"], k))[0] == d["doc_id"] for k in ("text", "was"))]


def mixing(docs, seed=17, most=2.0):
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    size, n = Counter(), {}
    for d in docs:
        n[d["doc_id"]] = len(re.findall("[^\x20\x09-\x0d]+", d["text"]))
        size[d["source"]] += n[d["doc_id"]]
    full = [s for s in size.values() if s]
    a = 0.0 if max(full) == min(full) else min(1.0, max(0.0, math.ceil((1 - math.log(most) / math.log(max(full) / min(full))) * 1e6 - 1e-3) / 1e6))
    out = []
    for source in size:
        own = [d for d in docs if d["source"] == source]
        if not size[source]:
            out += own
            continue
        budget = max(math.floor(size[source] * (max(full) / size[source]) ** (1 - a)), size[source])
        whole, rest = divmod(budget, size[source])
        order = sorted(own, key=lambda d: (md5(seed, whole, source, md5(seed, d["doc_id"])[:3]), md5(seed, whole, d["doc_id"])))
        used, part = 0, []
        for d in order:
            used += n[d["doc_id"]]
            if used > rest:
                break
            part.append(d)
        out += own * whole + (part if len(part) < len(own) else [])
    return out


def test_pipeline_equals_plain_python(spark):
    import public_tokenizers

    docs = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").select("doc_id")
    held = {r[0] for r in labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HELD_OUT)) == 0).collect()}
    trusted = {r[0] for r in labels.collect()}
    docs = mixing(near_dedup(line_dedup(quality(docs, trusted, held))))
    e, want = Encoder(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for d in docs:
        ids = [*e.encode(d["text"]).tolist(), 0]
        first = len(ids) % 2048 or 2048
        bounds = [0, len(ids)] if len(ids) <= 2048 else [0, *range(first, len(ids) + 1, 2048)]
        want.update((d["doc_id"], p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for p, (a, b) in enumerate(zip(bounds, bounds[1:])))
    out = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out) == want
    places = defaultdict(list)
    for x in out:
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for each in places.values():
        at = 0
        for offset, k in sorted(each):
            assert offset == at
            at += k
        assert at <= 2048


def test_planted_copies_go_and_clean_documents_stay(spark, tmp_path):
    """Near copies that differ in a few words of some lines lose their other lines first, and are still found."""
    import random

    r = random.Random(5)
    sentence = lambda: " ".join("w%d" % r.randrange(5000) for _ in range(12))
    clean = [(i, "\n".join(sentence() for _ in range(r.randrange(8, 20)))) for i in range(120)]
    near, full, rows = [], [], list(clean)
    for i in range(60):
        words = clean[i][1].split(" ")
        for at in r.sample([k for k, w in enumerate(words) if "\n" not in w], max(1, len(words) // 100)):
            words[at] = "z%d" % r.randrange(10**6)
        near.append(1000 + i)
        rows.append((1000 + i, " ".join(words)))
    for i in range(60, 80):
        full.append(2000 + i)
        rows.append((2000 + i, clean[i][1]))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lined = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert {x["doc_id"] for x in lined.collect()} == {i for i, _ in rows} - set(full)
    lined.write.parquet(f"{tmp_path}/lined.parquet")
    left = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{tmp_path}/lined.parquet"), str(tmp_path)).collect()}
    assert left >= {i for i, _ in clean}
    assert len(set(near) - left) >= 0.9 * len(near)
    nothing = corpus_pipeline.near_dedup(spark, docs.limit(0), str(tmp_path))
    assert nothing.count() == 0 and nothing.columns == corpus_pipeline.COLUMNS
