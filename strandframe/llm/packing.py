"""Best-fit packing of token pieces into sequences by exact-complement hashing.

The plan works on how many pieces of each length there are, never on the pieces: at most ``capacity`` counts, however
large the corpus. Filling one sequence after the other from the longest length left, it looks up whether one, two or
three available lengths fill the gap exactly; if not, the longest length that fits goes in and the gap is looked up
again (best fit). A filling is repeated as often as its lengths last. Pieces then find their place by their rank
among the pieces of equal length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, numbered, table, with_lanes
from .tokens import encoder

CAPACITY = 2048


def _pair(have: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Lengths a >= b with a + b = total and a <= most; the largest such a."""
    if total < 2:
        return None
    a = np.arange((total + 1) // 2, min(most, total - 1) + 1)
    if not len(a):
        return None
    b = total - a
    fits = np.flatnonzero((have[a] > 0) & (have[b] > 0) & ((a != b) | (have[a] > 1)))
    return (int(a[fits[-1]]), int(b[fits[-1]])) if len(fits) else None


def _complement(have: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths whose sum is ``gap``, the longest first; None if there are none."""
    if have[gap]:
        return [gap]
    if pair := _pair(have, gap, gap - 1):
        return list(pair)
    for a in np.flatnonzero(have[: max(0, gap - 1)])[::-1].tolist():
        if 3 * a < gap:
            break
        have[a] -= 1
        pair = _pair(have, gap - a, a)
        have[a] += 1
        if pair:
            return [a, *pair]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used; together they use every piece. Lengths are 1 to ``capacity``."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    out = []
    while (left := np.flatnonzero(have)).size:
        filling, gap = [int(left[-1])], capacity - int(left[-1])
        have[filling[0]] -= 1
        while gap:
            found = _complement(have, gap)
            if found is None:
                below = np.flatnonzero(have[: gap + 1])
                if not below.size:
                    break
                found = [int(below[-1])]
            for length in found:
                have[length] -= 1
                gap -= length
            filling += found
        more = min(int(have[length]) // n for length, n in Counter(filling).items())
        for length in filling:
            have[length] -= more
        out.append((filling, more + 1))
    return out


def _slots(fillings: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Arrays by (length, rank of the first piece): where it starts, its filling's number of that length, first
    sequence, and where that filling's offsets begin in the last array."""
    used, rows, offsets, sequence = Counter(), [], [], 0
    for filling, times in fillings:
        at, places = 0, {}
        for length in filling:
            places.setdefault(length, []).append(at)
            at += length
        for length, where in places.items():
            rows.append((length, used[length], len(where), sequence, len(offsets)))
            offsets += where
            used[length] += len(where) * times
        sequence += times
    rows.sort()
    length, start, each, first, at = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
    base = np.zeros(capacity + 2, dtype=np.int64)
    for n, k in used.items():
        base[n + 1] = k
    base = np.cumsum(base)
    return base, base[length] + start, each, first, at, np.array(offsets or [0], dtype=np.int64)


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset, both long; each sequence is filled from 0 without gaps.

    Lengths must be 1 to ``capacity``; others, nulls included, raise an error when the plan is made. Ties go by rank,
    repeated rows are pieces of their own, an empty table gives an empty one. Counts of at most ``capacity`` lengths
    come to the driver. Columns named as the new ones are replaced.
    """
    stored = with_lanes(pieces.drop("sequence_id", "offset"))
    counts = {r[0]: r[1] for r in stored.groupBy(length).count().collect()}
    if wrong := [n for n in counts if n is None or not 0 < n <= capacity]:
        raise ValueError(f"lengths must be 1 to {capacity}: {wrong[:5]}")
    base, starts, each, first, at, offsets = _slots(plan(counts, capacity), capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        slot = base[lengths.to_numpy(dtype=np.int64)] + ranks.to_numpy(dtype=np.int64)
        row = np.searchsorted(starts, slot, side="right") - 1
        k = slot - starts[row]
        return pd.DataFrame({"sequence_id": first[row] + k // each[row], "offset": offsets[at[row] + k % each[row]]})

    ranked = numbered(stored, [length], stored.drop("_lane").columns[:1], "_rank_of_length")
    return ranked.withColumn("_place", place(F.col(length), F.col("_rank_of_length"))).select(*[c for c in stored.columns if c != "_lane"], "_place.sequence_id", "_place.offset")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", separator: int = 0, with_ids: bool = True) -> DataFrame:
    """Token pieces of every document: id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids end with ``separator``; a null text is an empty one, so it has that id alone. Only documents of
    more than ``capacity`` ids are cut, into pieces of ``capacity``, of which the first may be shorter. Texts are
    encoded whole, however long. ``tokenizer`` is a file that every executor finds at that path.
    """
    import zlib

    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        encode = encoder(tokenizer).encode_many
        for batch in batches:
            keys, out = batch.column(0), ([], [], [], [], [], [])
            for row, ids in enumerate(encode(batch.column(1))):
                ids = np.append(ids, np.uint32(separator)).astype("<u4")
                end = len(ids) % capacity or capacity
                bounds = [0, len(ids)] if len(ids) <= capacity else [0, *range(end, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[a:b]
                    for column, value in zip(out, (row, piece, a, b - a, zlib.crc32(part.tobytes()), part.astype(np.int32))):
                        column.append(value)
            columns = [keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(out[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(cut, schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return pack(cut)
