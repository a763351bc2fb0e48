"""Token ids by a public byte-level vocabulary, for a whole Arrow batch of texts at once.

The vocabulary is a JSON file of the ``tokenizers`` library. Its split pattern never joins a character that is no
white space with white space after it, so a text may be cut there and the words encoded one by one. Arrow gathers
the distinct words of a batch, ``tiktoken`` encodes them with the same vocabulary, and numpy lays their ids out
again. Texts where that cut is not certain (unusual white space, special tokens) go to ``tokenizers`` whole. The ids
are equal in every case.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_slices

UNSURE = "  |\n |^ | $|[\t\x0b\x0c\r\x1c-\x1f\u0085   -     　]"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_open: dict[str, Encoder] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        special, vocabulary = [t["content"] for t in read["added_tokens"]], read["model"]["vocab"]
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word not in special}
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for word, i in ranks.items():
            self.width[i] = len(word)
        self.words = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.unsure = "|".join([UNSURE, *map(re.escape, special)])

    @cached_property
    def whole(self):
        """The tokenizer itself, loaded by the few workers that meet a text they can't cut."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many(pa.array([text], pa.string()))[0]

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers; null: none."""
        return [ids for at, n in byte_slices(texts, 4 << 20) for ids in self._encode_slice(texts.slice(at, n))]

    def _encode_slice(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        out = [np.zeros(0, dtype="<u4")] * len(texts)
        filled = pc.greater(pc.binary_length(texts), 0)
        odd = pc.match_substring_regex(texts, self.unsure)
        for i in np.flatnonzero(pc.and_(filled, odd).to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.asarray(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4")
        sure = np.flatnonzero(pc.and_(filled, pc.invert(odd)).to_numpy(zero_copy_only=False))
        if not len(sure):
            return out
        lists = pc.split_pattern(texts.take(pa.array(sure)), " ")
        first = lists.offsets.to_numpy()
        encoded = lists.flatten().dictionary_encode()
        code = encoded.indices.to_numpy().astype(np.int64)
        words = encoded.dictionary.to_pylist()
        ids = self.words.encode_to_numpy(" " + " ".join(words)).astype("<u4")
        word_bytes = np.asarray(pc.binary_length(encoded.dictionary).to_numpy(zero_copy_only=False), dtype=np.int64) + 1
        last = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(word_bytes)) + 1
        start = np.concatenate([[0], last[:-1]])
        count = (last - start)[code]
        count[first[:-1]] = 0  # a text's first word has no blank before it
        after = np.cumsum(count)
        flat = ids[np.repeat(start[code] - after + count, count) + np.arange(after[-1])]
        bounds = np.concatenate([[0], after])[first]
        for k, i in enumerate(sure.tolist()):
            head = np.asarray(self.words.encode_ordinary(words[code[first[k]]]), dtype="<u4")
            out[i] = np.concatenate([head, flat[bounds[k] : bounds[k + 1]]])
        return out


def encoder(path: str) -> Encoder:
    """The worker's own encoder, kept from one task to the next."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
