"""Alignment of two tokenizers' ids by the bytes that their tokens cover.

A cuts a blank and the text by a byte-level vocabulary, B the text by a piece vocabulary, which puts the blank there itself.
Both tokens' ends are counted in bytes. Dictionaries tell the token that ends at each place; the places that both know,
sorted, slice both id lists into groups, and the tokens that end together there are linked.

No token of either vocabulary goes over the border before a blank that follows no white space, so each distinct word of a
batch is cut and aligned once, with the dictionaries over all of them, and its groups are laid out wherever it occurs. Texts
where that is not certain are cut and aligned whole.

Of two tokens that end together one is a suffix of the other, so the vocabularies alone tell all pairs that can be linked,
some hundred thousand. A pair's number in that list is what documents store; corpus-wide counts are one number a pair.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, give_back, materialize, table
from .tokens import encoder

SLICE = 8 << 20  # bytes of text aligned at once, unless one text has more
BLANK = "▁"
_open: dict[tuple[str, str], Aligner] = {}


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in both lists the ends lie that both hold, in rising order."""
    place_a = dict(zip(ends_a.tolist(), range(len(ends_a))))
    place_b = dict(zip(ends_b.tolist(), range(len(ends_b))))
    both = sorted(place_a.keys() & place_b.keys())
    return np.array([place_a[e] for e in both], dtype=np.int64), np.array([place_b[e] for e in both], dtype=np.int64)


@dataclass
class Aligned:
    """Groups of one text: group g has the ids up to a_stop[g] and b_stop[g], from where the group before it stops;
    links has the pair's number for the tokens that end it."""

    a: np.ndarray
    b: np.ndarray
    a_stop: np.ndarray
    b_stop: np.ndarray
    links: np.ndarray

    def groups(self) -> list[tuple[list[int], list[int]]]:
        a, b, s, t = self.a.tolist(), self.b.tolist(), [0, *self.a_stop.tolist()], [0, *self.b_stop.tolist()]
        return [(a[i:j], b[k:m]) for i, j, k, m in zip(s, s[1:], t, t[1:])]


EMPTY = Aligned(*(np.zeros(0, dtype=np.int64) for _ in range(5)))


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.path_a, self.a = path_a, encoder(path_a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        one = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [b"" if self.pieces.is_control(i) else bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(one)]
        self.bytes_a = {i: self.a.words.decode_single_token_bytes(i) for i in range(len(self.a.width)) if self.a.width[i]}
        self.width_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.name_a, self.name_b = [str(i) for i in range(len(self.a.width) + 1)], [str(i) for i in range(len(one))]
        # a piece that goes on with a blank would cross a word's border
        self.crosses = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in one)
        self.unsure = f"{self.a.unsure}|{BLANK}"

    @cached_property
    def whole_a(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_file(self.path_a)
        whole.encode_special_tokens = True
        return whole

    @cached_property
    def pairs(self) -> np.ndarray:
        """All pairs of ids of which one's bytes end with the other's, as a << 32 | b, rising."""
        of_a = {x: i for i, x in self.bytes_a.items()}
        of_b: dict[bytes, list[int]] = {}
        for i, x in enumerate(self.bytes_b):
            if x:
                of_b.setdefault(x, []).append(i)
        found = {i << 32 | j for i, x in self.bytes_a.items() for s in range(len(x)) for j in of_b.get(x[s:], ())}
        found |= {of_a[x[s:]] << 32 | j for j, x in enumerate(self.bytes_b) for s in range(len(x)) if x[s:] in of_a}
        return np.array(sorted(found), dtype=np.int64)

    def _numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, a.astype(np.int64) << 32 | b.astype(np.int64)).astype(np.int32)

    def align(self, text: str | None) -> Aligned:
        """One text, cut whole; nothing where there is none or a tokenizer does not give its bytes back."""
        if not text:
            return EMPTY
        a = np.array(self.whole_a.encode(f" {text}", add_special_tokens=False).ids, dtype=np.int64)
        b = np.array(self.pieces.encode(text), dtype=np.int64)
        said = f" {text}".encode()
        if b"".join(self.bytes_a.get(i, b"") for i in a.tolist()) != said or b"".join(self.bytes_b[i] for i in b.tolist()) != said:
            return EMPTY
        at_a, at_b = common_ends(np.cumsum(self.a.width[a]), np.cumsum(self.width_b[b]))
        return Aligned(a, b, at_a + 1, at_b + 1, self._numbers(a[at_a], b[at_b]))

    def align_words(self, words: list[str]) -> tuple[Aligned, np.ndarray] | None:
        """The words, each with a blank before it, aligned at once, and the number of groups up to each word's end; None
        if they can't be cut together."""
        said = " " + " ".join(words)
        b = np.array(self.pieces.encode(said[1:]), dtype=np.int64)
        if b"".join([self.bytes_b[i] for i in b.tolist()]) != said.encode():
            return None
        a = self.a.words.encode_to_numpy(said).astype(np.int64)
        ends_a = np.cumsum(self.a.width[a])
        at_a, at_b = common_ends(ends_a, np.cumsum(self.width_b[b]))
        borders = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy() + 1)
        last = np.searchsorted(ends_a[at_a], borders)
        if last[-1] >= len(at_a) or (ends_a[at_a][last] != borders).any():
            return None
        return Aligned(a, b, at_a + 1, at_b + 1, self._numbers(a[at_a], b[at_b])), last + 1

    def spelled(self, one: Aligned) -> list[str]:
        """Each group as ``a1,a2|b1``: decimal ids in order."""
        a, b = [self.name_a[i] for i in one.a.tolist()], [self.name_b[i] for i in one.b.tolist()]
        s, t = [0, *one.a_stop.tolist()], [0, *one.b_stop.tolist()]
        return [f"{a[i]}|{b[k]}" if j - i == 1 == m - k else f"{','.join(a[i:j])}|{','.join(b[k:m])}" for i, j, k, m in zip(s, s[1:], t, t[1:])]

    def rows(self, texts: pa.Array, with_groups: bool):
        """For each text: (ids of A, ids of B, groups, links, sha256 of the spelled groups, the groups if asked for)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.unsure).to_numpy(zero_copy_only=False) | self.crosses
        out: list = [None] * len(texts)
        filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        sure = np.flatnonzero(filled & ~odd)
        if len(sure):
            lists = pc.split_pattern(texts.take(pa.array(sure)), " ")
            first, encoded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
            code = encoded.indices.to_numpy().astype(np.int64)
            cut = self.align_words(encoded.dictionary.to_pylist())
            if cut is not None:
                every, stop = cut[0], np.r_[0, cut[1]]
                names, to = self.spelled(every), stop.tolist()
                spelled = [";".join(names[g:h]) for g, h in zip(to, to[1:])]
                sizes = np.diff(np.column_stack([np.r_[0, every.a_stop][stop], np.r_[0, every.b_stop][stop], stop]), axis=0)
                groups = every.groups() if with_groups else []
                totals = np.add.reduceat(sizes[code], first[:-1], axis=0)
                for k, i in enumerate(sure.tolist()):
                    own = code[first[k] : first[k + 1]]
                    n = sizes[own, 2]
                    links = every.links[np.repeat(stop[own] - np.cumsum(n) + n, n) + np.arange(totals[k, 2])]
                    told = ";".join([spelled[w] for w in own.tolist()])
                    whole = [g for w in own.tolist() for g in groups[to[w] : to[w + 1]]] if with_groups else None
                    out[i] = (*totals[k].tolist(), links, hashlib.sha256(told.encode()).hexdigest(), whole)
        for i, row in enumerate(out):
            if row is None:
                one = self.align(texts[i].as_py())
                digest = hashlib.sha256(";".join(self.spelled(one)).encode()).hexdigest() if len(one.a) else ""
                out[i] = (len(one.a), len(one.b), len(one.links), one.links, digest, one.groups() if with_groups else None)
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's own aligner, kept from one task to the next."""
    if (path_a, path_b) not in _open:
        _open[path_a, path_b] = Aligner(path_a, path_b)
    return _open[path_a, path_b]


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """One row for each row of ``docs``: the id, n_a, n_b (ids of both), n_groups, n_links, n_best, count_sum,
    groups_sha256 and, if asked for, groups: an array of the ids of A and B in each.

    A link is a pair of an A and a B token that end at one byte; a pair's count is how many links of the whole table hold
    it. n_best are the links whose count is the highest of their B id, ties included, count_sum is the sum of all. A
    null or empty text, or one that a tokenizer does not give back byte for byte, has no tokens: zeros, groups_sha256 ''
    and no groups. Special tokens in a text are text. Null and repeated ids keep their rows, an empty table gives an empty
    one, other columns are left out. Texts are cut whole, however long. ``path_a`` (byte-level, tokenizers) and
    ``path_b`` (sentencepiece) are files that every executor finds there.

    Texts are cut once and stay where they are; what is shuffled is one count a pair and task. Counts of all possible pairs,
    which the vocabularies bound, come to the driver and go to every task.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    groups = ", groups array<struct<a: array<int>, b: array<int>>>" * with_groups
    told = "n_a long, n_b long, n_groups long"

    def cut(batches):
        a = aligner(path_a, path_b)
        for batch in batches:
            for at, n in byte_slices(batch.column(1), SLICE):
                rows = a.rows(batch.column(1).slice(at, n), with_groups)
                columns = [batch.column(0).slice(at, n), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(3))]
                columns += [pa.array([r[3].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.string())]
                names = [id_col, "n_a", "n_b", "n_groups", "links", "groups_sha256"]
                if with_groups:
                    columns.append(pa.array([[{"a": x, "b": y} for x, y in r[5]] for r in rows], pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    stored = materialize(docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(cut, f"{id_col} {kind}, {told}, links binary, groups_sha256 string{groups}"))

    def tally(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at, n in byte_slices(batch.column(0), 16 << 20):
                new = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, n).to_pylist()), dtype=np.int32), minlength=len(total))
                new[: len(total)] += total
                total = new
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["pair", "n"])

    counted = stored.select("links").mapInArrow(tally, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = aligner(path_a, path_b).pairs
    counts = np.zeros(len(pairs), dtype=np.int64)
    counts[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    of_b = pairs & 0xFFFFFFFF
    highest = np.zeros(int(of_b.max()) + 1, dtype=np.int64)
    np.maximum.at(highest, of_b, counts)
    known = spark.sparkContext.broadcast((counts, (counts == highest[of_b]) & (counts > 0)))

    def weigh(batches):
        counts, best = known.value
        for batch in batches:
            links = batch.column("links").to_pylist()
            numbers = [np.frombuffer(x, dtype=np.int32) for x in links]
            added = [pa.array([len(x) for x in numbers], pa.int64()), pa.array([int(best[x].sum()) for x in numbers], pa.int64()), pa.array([int(counts[x].sum()) for x in numbers], pa.int64())]
            first = [batch.column(c) for c in (id_col, "n_a", "n_b", "n_groups")]
            last = [batch.column(c) for c in ("groups_sha256", *["groups"] * with_groups)]
            yield pa.RecordBatch.from_arrays([*first, *added, *last], [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups])

    return stored.mapInArrow(weigh, f"{id_col} {kind}, {told}, n_links long, n_best long, count_sum long, groups_sha256 string{groups}")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align_tokens(table(spark, sf_dir, "documents"), *paths, with_groups=False)
