"""Structured Streaming: windowed detectors over streams of chunks, counts over arriving features."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WAITING = 100_000  # chunks of a chromosome that may wait for an earlier one


def _next_parts(waiting: dict[int, str], end: int) -> Iterator[str]:
    """The bases that follow place ``end`` (the first not yet read), from chunks in any order; used and stale chunks go.
    Chunks may come twice or overlap: of each only what is new is read."""
    while waiting:
        start = min(waiting)
        if start > end:
            return
        seq = waiting.pop(start)
        if start + len(seq) > end:
            yield seq[end - start :]
            end = start + len(seq)


def _detected(chunks: DataFrame, find: Callable[[str, int], tuple[list[tuple[int, float]], int]]) -> DataFrame:
    """(chrom, start, score) of what ``find`` tells of a text and the place of its first base: (place, score) of hits, and
    how many bases later hits no longer need (more than there are: so many to come lie before the next one).

    A chromosome's state is the text that is still needed, its place, the bases to be left out, and the chunks that wait for
    one before them. More than WAITING of these are an error: then the gap is no delay."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, at, skip, held = state.get if state.exists else ("", 1, 0, "[]")
        waiting = {s: t for s, t in json.loads(held)}
        for frame in frames:
            for start, seq in zip(frame["chunk_start"], frame["seq"]):
                if seq and len(seq) > len(waiting.get(int(start), "")):
                    waiting[int(start)] = seq
        hits = []
        for seq in _next_parts(waiting, at + len(tail) - skip):
            tail += seq[skip:]
            skip = max(0, skip - len(seq))
            found, used = find(tail, at)
            hits += found
            skip += max(0, used - len(tail))
            tail, at = tail[used:], at + used
        if len(waiting) > WAITING:
            raise ValueError(f"{len(waiting)} chunks of {key[0]} wait for the one at {at + len(tail) - skip}")
        state.update((tail, at, skip, json.dumps(sorted(waiting.items()))))
        yield pd.DataFrame([(key[0], p, float(s)) for p, s in hits], columns=["chrom", "start", "score"])

    return chunks.groupBy("chrom").applyInPandasWithState(step, "chrom string, start long, score double", "tail string, at long, skip long, waiting string", "append", GroupStateTimeout.NoTimeout)


def sliding_windows(chunks: DataFrame, window: int, stride: int, score: Callable[[str], float], least: float) -> DataFrame:
    """Windows of a stream of chunks (chrom, chunk_start, seq) whose score is at least ``least``: chrom, start, score.

    Chunks of a chromosome may arrive in any order and more than once; a window comes out, once, when all bases up to its end
    have come. Null and empty chunks say nothing.
    """

    def find(text: str, at: int) -> tuple[list[tuple[int, float]], int]:
        last = max(0, (len(text) - window) // stride + 1) if len(text) >= window else 0
        scores = [(at + k, score(text[k : k + window])) for k in range(0, last * stride, stride)]
        return [(p, s) for p, s in scores if s >= least], last * stride

    return _detected(chunks, find)


def streamed_hits(chunks: DataFrame, pattern: str, k: int) -> DataFrame:
    """Every start of a ``k``-letter word that matches a regular expression in a stream of chunks, once: chrom, start. A
    chromosome's state is its last k - 1 bases and the chunks that came too early, so hits over chunk ends are found when
    the next chunk comes. The text is searched as a whole, not word by word."""
    near, fits = re.compile(f"(?=(?:{pattern}))"), re.compile(pattern)

    def find(text: str, at: int) -> tuple[list[tuple[int, float]], int]:
        done = max(0, len(text) - k + 1)
        return [(at + m.start(), 1.0) for m in near.finditer(text) if m.start() < done and fits.fullmatch(text, m.start(), m.start() + k)], done

    return _detected(chunks, find).select("chrom", "start")


def windowed_counts(features: DataFrame, window: int) -> DataFrame:
    """Features of a stream by chromosome and window of their start; partial counts are kept as state."""
    return features.groupBy("chrom", F.floor((F.col("start_pos") - 1) / window).alias("win")).agg(F.count(F.lit(1)).alias("n"))
