"""Scans of sequences in Arrow batches: each row is read where it lies, and no base or k-mer is shuffled."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import bases, motifs

CODES = np.full(256, 4, dtype=np.int8)
for _k, _b in enumerate(b"ACGT"):
    CODES[_b] = _k


def coded(seq: str | None) -> np.ndarray:
    """A, C, G and T as 0 to 3, so that 3 - x is the complement; anything else as 4."""
    return CODES[np.frombuffer((seq or "").encode("ascii", "replace"), dtype=np.uint8)]


def kmer_codes(code: np.ndarray, k: int, mates: bool = False) -> np.ndarray:
    """The number of the k-mer (k <= 31) at each start, or of its reverse complement; -1 where it has another letter."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out, bad = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for i in range(k):
        part = code[i : i + n].astype(np.int64)
        bad |= part == 4
        out |= (3 - part) << (2 * i) if mates else part << (2 * (k - 1 - i))
    out[bad] = -1
    return out


def distinct_codes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-mer numbers of an array in their order, but for -1, and how often each comes; counted without a sort
    where there are few numbers."""
    codes = codes[codes >= 0]
    if 4**k <= max(4096, len(codes)):
        n = np.bincount(codes, minlength=1)
        own = np.flatnonzero(n)
        return own, n[own]
    return np.unique(codes, return_counts=True)


def counted_kmers(keys: list[pa.Array], texts: pa.Array, k: int, most: int = 1 << 20):
    """(row with the keys, k-mer, how often it starts, rows that hold it) for the texts of a batch, summed over rows of
    equal keys; in several parts where more than about ``most`` k-mers are open."""
    numbers: dict[tuple, int] = {}
    first, held, size = [], [], 0
    odd: dict[tuple[int, str], list[int]] = {}

    def told():
        group, code, n = (np.concatenate([h[c] for h in held] or [np.zeros(0, np.int64)]) for c in range(3))
        order = np.lexsort((code, group))
        group, code, n = group[order], code[order], n[order]
        new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (code[1:] != code[:-1])]) if len(code) else np.zeros(0, np.int64)
        sums = np.add.reduceat(n, new) if len(new) else n
        letters = np.frombuffer(b"ACGT", dtype="S1")[(code[new, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
        words = [w.decode() for w in np.ascontiguousarray(letters).view(f"S{k}").ravel().tolist()] + [w for _, w in odd]
        rows = np.r_[np.array(first, dtype=np.int64)[group[new]], np.array([first[g] for g, _ in odd], dtype=np.int64)]
        rest = np.array([*odd.values()], dtype=np.int64).reshape(-1, 2)
        return pa.array(rows), pa.array(words, pa.string()), pa.array(np.r_[sums, rest[:, 0]]), pa.array(np.r_[np.diff(np.r_[new, len(code)]), rest[:, 1]])

    for i, text in enumerate(texts.to_pylist()):
        at = tuple(c[i].as_py() for c in keys)
        if at not in numbers:
            numbers[at] = len(first)
            first.append(i)
        codes = kmer_codes(coded(text), k)
        code, n = distinct_codes(codes, k)
        held.append((np.full(len(code), numbers[at]), code, n))
        size += len(code)
        seen = set()
        for p in np.flatnonzero(codes < 0).tolist():
            both = odd.setdefault((numbers[at], text[p : p + k]), [0, 0])
            both[0] += 1
            both[1] += text[p : p + k] not in seen
            seen.add(text[p : p + k])
        if size > most:
            yield told()
            numbers, first, held, size, odd = {}, [], [], 0, {}
    if size or odd:
        yield told()


def _words(text: str, k: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """The distinct k-mers of A, C, G and T of a text as numbers in their order, how often each starts, and those with
    other letters as they are spelled with how often they start."""
    codes = kmer_codes(coded(text), k)
    own, n = distinct_codes(codes, k)
    odd: dict[str, int] = {}
    for p in np.flatnonzero(codes < 0).tolist():
        odd[text[p : p + k]] = odd.get(text[p : p + k], 0) + 1
    return own, n, odd


def word_counts(text: str, k: int) -> np.ndarray:
    """How often each distinct k-mer of a text starts in it, in no order that means anything."""
    _, n, odd = _words(text, k)
    return np.r_[n, np.array([*odd.values()], dtype=np.int64)]


def top_words(text: str, k: int, n: int) -> tuple[list[str], np.ndarray]:
    """The n most frequent k-mers of a text with their counts; ties go to the lesser k-mer."""
    own, counts, odd = _words(text, k)
    first = np.argsort(-counts, kind="stable")[:n]
    spelled = [("".join("ACGT"[(c >> 2 * (k - 1 - i)) & 3] for i in range(k)), m) for c, m in zip(own[first].tolist(), counts[first].tolist())]
    best = sorted([*spelled, *odd.items()], key=lambda x: (-x[1], x[0].encode()))[:n]
    return [w for w, _ in best], np.array([m for _, m in best], dtype=np.int64)


def scan(seqs: DataFrame, schema: str, names: list[str], find: Callable[[str], list[np.ndarray]], key: str = "seq_id", seq: str = "seq", most: int = 1 << 14) -> DataFrame:
    """Rows (key, *names) of what ``find`` gives for each sequence: one array a name, of equal lengths. About ``most`` rows
    are sent on together."""
    kind = dict(seqs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, size = [], [], 0
            for i in range(batch.num_rows):
                found = [pa.array(a) for a in find(batch.column(1)[i].as_py() or "")]
                if len(found[0]):
                    rows.append(np.full(len(found[0]), i))
                    held.append(found)
                    size += len(found[0])
                if held and (size >= most or i + 1 == batch.num_rows):
                    columns = [pa.concat_arrays([h[c] for h in held]) for c in range(len(names))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *columns], [key, *names])
                    rows, held, size = [], [], 0

    return seqs.select(key, seq).mapInArrow(run, f"{key} {kind}, {schema}")


def dyads(seqs: DataFrame, arm: int, least_loop: int, most_loop: int) -> DataFrame:
    """Pairs of places where an arm meets its own reverse complement after a loop: pos, loop, stem (arm <= 31).

    For each loop length the k-mers and the reverse complements further on are compared in the row.
    """

    def find(text: str) -> list:
        code = coded(text)
        left, right = kmer_codes(code, arm), kmer_codes(code, arm, mates=True)
        at, loops = [], []
        for loop in range(least_loop, most_loop + 1):
            a, b = left[: max(0, len(left) - arm - loop)], right[arm + loop :]
            hit = np.flatnonzero((a == b) & (a >= 0))
            at.append(hit)
            loops.append(np.full(len(hit), loop))
        at, loops = np.concatenate(at), np.concatenate(loops)
        return [at.astype(np.int64), loops.astype(np.int64), [text[i : i + arm] for i in at]]

    return scan(seqs, "pos long, loop long, stem string", ["pos", "loop", "stem"], find)


def common_lengths(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far x[i:] and y[j:] are equal, for each pair of places; values below 0 equal nothing.

    Places are ranked by the 1, 2, 4, 8 ... letters from them on, each rank from two of the one before, so equal ranks
    are equal pieces for certain. Ranks are made as long as some pair still matches; then each pair goes on by ever
    shorter pieces. Work grows with the length times the logarithm of the longest match, not with the matches."""
    both = np.concatenate([np.where(x < 0, -1 - np.arange(len(x)), x), [-1], np.where(y < 0, -1 - len(x) - 1 - np.arange(len(y)), y), [-2 - len(x) - len(y)]])
    p, q = i.astype(np.int64), j + len(x) + 1
    done, open_ = np.zeros(len(p), dtype=np.int64), np.arange(len(p))
    ranks, size = [np.unique(both, return_inverse=True)[1].astype(np.int64)], 1
    ends = np.r_[np.arange(len(x), -1, -1), np.arange(len(y), -1, -1)]  # letters before the side's end
    while len(open_):
        rank = ranks[-1]
        a, b = p[open_] + done[open_], q[open_] + done[open_]
        same = (ends[a] >= size) & (ends[b] >= size) & (rank[a] == rank[b])
        open_ = open_[same]
        done[open_] += size
        if len(open_):
            n, far = len(rank), np.minimum(np.arange(len(rank)) + size, len(rank) - 1)
            ranks.append(np.unique(rank * n + rank[far], return_inverse=True)[1].astype(np.int64))
            size *= 2
    for level in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << level, ranks[level]
        a, b = p + done, q + done
        same = (ends[a] >= size) & (ends[b] >= size) & (rank[a] == rank[b])
        done[same] += size
    return done


def expanded_dyads(seqs: DataFrame, arm: int, least_loop: int, most_loop: int, nested: bool = True) -> DataFrame:
    """Dyads grown to their full arms: start, end (half-open), arm, loop. Those of one centre are one, with the longest arm;
    one within the arms of another of the same centre goes, and if not ``nested`` one that lies within any other. A loop may
    close to ``least_loop`` as arms grow inwards. A centre's outermost arms alone are grown, all of a row together."""

    def find(text: str) -> list:
        code = coded(text).astype(np.int64)
        n = len(code)
        left, right = kmer_codes(code, arm), kmer_codes(code, arm, mates=True)
        at, loops = [], []
        for loop in range(most_loop, least_loop - 1, -1):
            a, b = left[: max(0, len(left) - arm - loop)], right[arm + loop :]
            hit = np.flatnonzero((a == b) & (a >= 0))
            at.append(hit)
            loops.append(np.full(len(hit), loop))
        s, loop = np.concatenate(at).astype(np.int64), np.concatenate(loops).astype(np.int64)
        e = s + 2 * arm + loop
        one = np.unique(s + e, return_index=True)[1]  # the first of a centre has the longest loop: its outermost arms
        s, e, loop = s[one], e[one], loop[one]
        inner = s + arm
        back, mates = np.where(code < 4, code, -1)[::-1], np.where(code < 4, 3 - code, -1)
        out = common_lengths(back, mates, n - s, e)
        deep = common_lengths(np.where(code < 4, code, -1), mates[::-1], inner, n - (inner + loop))
        deep = np.minimum(deep, np.maximum(loop - least_loop, 0) // 2)
        s, e, inner = s - out, e + out, inner + deep
        order = np.lexsort((-e, s))
        s, e, inner = s[order], e[order], inner[order]
        if not nested and len(s):
            keep = np.r_[True, e[1:] > np.maximum.accumulate(e)[:-1]]
            s, e, inner = s[keep], e[keep], inner[keep]
        return [s, e, inner - s, e - s - 2 * (inner - s)]

    return scan(seqs, "start long, end long, arm long, loop long", ["start", "end", "arm", "loop"], find)


def direct_repeats(seqs: DataFrame, k: int, reach: int) -> DataFrame:
    """Starts whose k-mer comes again at most ``reach`` further on in the same sequence: pos, shift (k <= 31)."""

    def find(text: str) -> list:
        word = kmer_codes(coded(text), k)
        at, shifts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for shift in range(1, min(reach, len(word) - 1) + 1):
            hit = np.flatnonzero((word[:-shift] == word[shift:]) & (word[:-shift] >= 0))
            at.append(hit)
            shifts.append(np.full(len(hit), shift))
        return [np.concatenate(at).astype(np.int64), np.concatenate(shifts).astype(np.int64)]

    return scan(seqs, "pos long, shift long", ["pos", "shift"], find)


def shift_runs(seqs: DataFrame, shift: int, least: int) -> DataFrame:
    """Runs of at least ``least`` bases that equal the base ``shift`` further on: start (from 0), length."""

    def find(text: str) -> list:
        x = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
        same = np.r_[False, x[:-shift] == x[shift:], False] if len(x) > shift else np.zeros(2, bool)
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, size = edge[::2], edge[1::2] - edge[::2]
        return [start[size >= least].astype(np.int64), size[size >= least].astype(np.int64)]

    return scan(seqs, "start long, length long", ["start", "length"], find)


def _longest_run(bits: int) -> tuple[int, int]:
    """(place, length) of the first of the longest runs of ones, (0, 0) without one: starts of runs of 1, 2, 4 ... ones, put
    together from the longest down."""
    if not bits:
        return 0, 0
    starts, size = [bits], 1
    while more := starts[-1] & (starts[-1] >> size):
        starts.append(more)
        size *= 2
    at = starts.pop()
    for k in reversed(range(len(starts))):
        if longer := at & (starts[k] >> size):
            at, size = longer, size + (1 << k)
    return (at & -at).bit_length() - 1, size


def long_repeats(seqs: DataFrame, reach: int, z: float = 2.0, least: int = 8) -> DataFrame:
    """Runs that a sequence shares with itself shifted by 1 to ``reach``, if longer than the mean of the shifts' longest
    runs by ``z`` of their deviations and than ``least``: shift, start, length. One run a shift, the first of its longest.

    Letters are two bits, each of all letters one number, so a shift is compared a machine word at a time."""

    def number(of: np.ndarray) -> int:
        return int.from_bytes(np.packbits(of, bitorder="little").tobytes(), "little")

    def find(text: str) -> list:
        x = coded(text)
        low, high, known = number(x & 1), number(x & 2), number(x < 4)
        runs = []
        for shift in range(1, min(reach, len(x) - 1) + 1):
            both = known & (known >> shift)
            other = (low ^ (low >> shift)) | (high ^ (high >> shift))
            runs.append((shift, *_longest_run(both ^ (both & other))))
        if not runs:
            return [np.zeros(0, np.int64)] * 3
        rows = np.array(runs, dtype=np.int64)
        size = rows[:, 2]
        keep = (size > size.mean() + z * size.std()) & (size >= least)
        return [rows[keep, k] for k in range(3)]

    return scan(seqs, "shift long, start long, length long", ["shift", "start", "length"], find)


def open_frames(seqs: DataFrame, least: int) -> DataFrame:
    """Open reading frames: the first ATG after a stop in a frame, and the next stop at least ``least`` on: frame, start, stop."""
    starts, stops = kmer_codes(coded("ATG"), 3), np.concatenate([kmer_codes(coded(c), 3) for c in ("TAA", "TAG", "TGA")])

    def find(text: str) -> list:
        word = kmer_codes(coded(text), 3)
        out = []
        for frame in range(3):
            at = word[frame::3]
            atg, end = np.flatnonzero(at == starts[0]), np.flatnonzero(np.isin(at, stops))
            to = np.searchsorted(end, atg)
            one = np.unique(to, return_index=True)[1]
            a, b = atg[one], to[one]
            a, b = a[b < len(end)], b[b < len(end)]
            out.append(np.stack([np.full(len(a), frame), a * 3 + frame, end[b] * 3 + frame], axis=1))
        rows = np.concatenate(out).astype(np.int64)
        rows = rows[rows[:, 2] - rows[:, 1] >= least]
        return [rows[:, k] for k in range(3)]

    return scan(seqs, "frame long, start long, stop long", ["frame", "start", "stop"], find)


def literal_places(seqs: DataFrame, word: str) -> DataFrame:
    """Of every start of a word of A, C, G and T in each sequence that has one: n, n_in_frame (starts divisible by 3), first."""
    wanted = kmer_codes(coded(word), len(word))[0]

    def find(text: str) -> list:
        at = np.flatnonzero(kmer_codes(coded(text), len(word)) == wanted).astype(np.int64)
        return [np.array(x, dtype=np.int64) for x in ([len(at)], [int((at % 3 == 0).sum())], at[:1])] if len(at) else [at] * 3

    return scan(seqs, "n long, n_in_frame long, first long", ["n", "n_in_frame", "first"], find)


def word_places(seqs: DataFrame, pattern: str, k: int, key: str) -> DataFrame:
    """Every start of a ``k``-letter word that a regular expression matches as a whole, overlapping ones too: pos (from 0), kmer."""
    ahead, whole = re.compile(f"(?={pattern})", re.DOTALL), re.compile(pattern, re.DOTALL)

    def find(text: str) -> list:
        at = [i for i in (m.start() for m in ahead.finditer(text)) if i + k <= len(text) and whole.fullmatch(text, i, i + k)]
        return [np.array(at, dtype=np.int64), [text[i : i + k] for i in at]]

    return scan(seqs, "pos long, kmer string", ["pos", "kmer"], find, key=key)


def unit_phases(seqs: DataFrame, unit: str) -> DataFrame:
    """Of each sequence with a letter (phase, matches): the shift of the repeated unit that agrees with most letters; the
    least of equals."""

    def find(text: str) -> list:
        if not text:
            return [np.zeros(0, np.int64)] * 2
        x = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
        place = np.arange(len(x)) % len(unit)
        seen = np.array([np.bincount(place[x == ord(c)], minlength=len(unit)) for c in unit])  # by letter of the unit and place
        shifts = np.arange(len(unit))
        matches = np.array([seen[(shifts + o) % len(unit), shifts].sum() for o in shifts], dtype=np.int64)
        best = int(matches.argmax())
        return [np.array([best], dtype=np.int64), matches[best : best + 1]]

    return scan(seqs, "phase long, matches long", ["phase", "matches"], find)


def consensus_scores(seqs: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each consensus in ambiguity codes (key, entropy, logprob, minimal): mean over its letters of p ln(1/p), N at the ends
    counting nothing but length (1 for an empty one); minus the sum of ln(4 - bases of the code), N left out; the MD5 of
    the consensus with one base for each code. Letters are counted once."""
    weight, odds = ([f(len(of)) for of in bases.IUPAC.values()] for f in (lambda n: math.log(n) / n, lambda n: -math.log(4 - n) if n < 4 else 0.0))
    minimal = str.maketrans(motifs.MINIMAL)

    def find(text: str) -> list:
        ends = len(text) - len(text.strip("N"))
        n = [text.count(c) for c in bases.IUPAC]
        inner = [m - ends * (c == "N") for c, m in zip(bases.IUPAC, n)]
        entropy = sum(m * w for m, w in zip(inner, weight)) / len(text) if text else 1.0
        return [np.array([entropy]), np.array([sum(m * o for m, o in zip(n, odds))]), [hashlib.md5(text.translate(minimal).encode()).hexdigest()]]

    return scan(seqs, "entropy double, logprob double, minimal string", ["entropy", "logprob", "minimal"], find, key=key, seq=seq)


def fuzzy_hits(seqs: DataFrame, pattern: str, errors: int) -> DataFrame:
    """Starts where a pattern fits with at most ``errors`` mismatches: start, mismatches."""

    def find(text: str) -> list:
        x, p = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8), pattern.encode()
        n = len(x) - len(p) + 1
        off = np.zeros(max(0, n), dtype=np.int64)
        for i, letter in enumerate(p):
            off += x[i : i + n] != letter if n > 0 else 0
        at = np.flatnonzero(off <= errors)
        return [at.astype(np.int64), off[at]]

    return scan(seqs, "start long, mismatches long", ["start", "mismatches"], find)


def folded_copies(seqs: DataFrame, unit: str, n: int) -> DataFrame:
    """The ``n`` places of each repeat that agree most with a unit, the first of equals: pos, matches, copy. The place that
    ends the repeat is not tried."""

    def find(text: str) -> list:
        x, p = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8), unit.encode()
        tried = max(0, len(x) - len(p))
        same = np.zeros(tried, dtype=np.int64)
        for i, letter in enumerate(p):
            same += x[i : i + tried] == letter
        at = np.argsort(-same, kind="stable")[:n]
        return [at.astype(np.int64), same[at], [text[i : i + len(p)] for i in at]]

    return scan(seqs, "pos long, matches long, copy string", ["pos", "matches", "copy"], find)


def pwm_scan(seqs: DataFrame, pwm: DataFrame, least: float, pseudocount: float = 0.1, background: float = 0.25, both_strands: bool = False) -> DataFrame:
    """Hits of matrix motifs: start, end (half-open), score normalised to 0..1, from ``least`` on; other letters score zero.

    One pass over the sequences scores every motif of the library, which is sent to the tasks: its rows are counted
    first, and more than a million are refused. With ``both_strands`` hits of the reverse complement have strand '-'.
    """
    size = pwm.count()
    if size > 1_000_000:
        raise ValueError(f"{size} rows are more than a motif library to be sent to every task")
    table: dict[str, dict[int, dict[str, float]]] = {}
    for r in pwm.collect():
        table.setdefault(r["motif_id"], {}).setdefault(r["pos"], {})[r["base"]] = r["cnt"]
    motifs = []
    for motif, columns in sorted(table.items()):
        logs = np.zeros((len(columns), 5))
        for i, pos in enumerate(sorted(columns)):
            total = sum(columns[pos].values()) + 4 * pseudocount
            logs[i, :4] = [np.log2((columns[pos].get(b, 0) + pseudocount) / total / background) for b in "ACGT"]
        low, high = logs[:, :4].min(axis=1).sum(), logs[:, :4].max(axis=1).sum()
        motifs.append((motif, "+", logs, low, high))
        if both_strands:
            motifs.append((motif, "-", np.concatenate([logs[::-1, 3::-1], logs[::-1, 4:]], axis=1), low, high))

    def find(text: str) -> list:
        code = coded(text)
        parts = []
        for motif, strand, logs, low, high in motifs:
            n = len(code) - len(logs) + 1
            if n <= 0:
                continue
            raw = np.zeros(n)
            for i, column in enumerate(logs):
                raw += column[code[i : i + n]]
            score = (raw - low) / (high - low) if high > low else np.ones(n)
            at = np.flatnonzero(score >= least)
            parts += [(motif, strand, s, s + len(logs), score[s], text[s : s + len(logs)]) for s in at.tolist()]
        kinds = (str, str, np.int64, np.int64, np.float64, str)
        return [np.array([p[k] for p in parts], dtype=kind) if kind is not str else [p[k] for p in parts] for k, kind in enumerate(kinds)]

    return scan(seqs, "motif_id string, strand string, start long, end long, score double, kmer string", ["motif_id", "strand", "start", "end", "score", "kmer"], find)


def places(text: Column, pattern: str) -> Column:
    """Array of (start, match) of the leftmost hits of a pattern that do not overlap, in the row and in the JVM."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)
    empty = F.array().cast("array<struct<start:int,match:string>>")
    start = F.struct(empty.alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, z: Column) -> Column:
        hit = F.struct((acc["at"] + z["gap"]).alias("start"), z["match"].alias("match"))
        return F.struct(F.concat(acc["out"], F.array(hit)).alias("out"), (acc["at"] + z["gap"] + F.length(z["match"])).alias("at"))

    zipped = F.filter(F.arrays_zip(found.alias("match"), gaps.alias("gap")), lambda z: z["match"].isNotNull())
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def regex_hits(seqs: DataFrame, patterns: dict[str, str], seq: str = "seq") -> DataFrame:
    """Leftmost hits of named patterns that do not overlap: name, start (from 0), end, match, with the other columns of
    ``seqs``. One pass in the JVM: places are taken in the row, so rows that share every key stay apart."""
    keep = [c for c in seqs.columns if c != seq]
    told = [F.struct(F.lit(n).alias("name"), places(F.col(seq), p).alias("hits")) for n, p in patterns.items()]
    rows = seqs.select(*keep, F.inline(F.array(*told))).select(*keep, "name", F.inline("hits"))
    return rows.select(*keep, "name", "start", (F.col("start") + F.length("match")).alias("end"), "match")
