"""Line dedup over the whole corpus, with keep bitmaps as its result.

Every line's key is hashed to 128 bits. Hashes are dealt to tasks by range and sorted by (hash, document, position);
a task streams them, keeps each key's first document and emits the lines of the others. What goes to the shuffle is
pre-aggregated: of the documents in one slice of a partition that hold a key, all but the smallest lose the line at
once, so even a line that a third of all documents hold sends one row for each slice.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, byte_slices, materialize, table, tasks_for

LEAST = 10
NO_DOC = np.iinfo(np.int64).max
_HITS = "hi long, lo long, doc long, copy long, n_lines int, positions array<int>"


def _slice_hits(docs: np.ndarray, copies: np.ndarray, texts: pa.Array, least: int):
    """(hash, doc, copy, n_lines, positions) of the keys to compare elsewhere; those with hash None are lost here."""
    import xxhash

    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    first = lists.offsets.to_numpy().astype(np.int64)
    keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=WHITE))
    long_enough = pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False)
    line = np.flatnonzero(long_enough)
    if not len(line):
        return []
    encoded = keys.take(pa.array(line)).dictionary_encode()
    code = encoded.indices.to_numpy().astype(np.int64)
    row = np.searchsorted(first, line, side="right") - 1
    order = np.lexsort((line, row, copies[row], docs[row], code))
    code, row, line = code[order], row[order], line[order]
    new_code = np.r_[True, code[1:] != code[:-1]]
    doc = docs[row]
    least_doc = doc[np.flatnonzero(new_code)][np.cumsum(new_code) - 1]
    new_set = new_code | np.r_[True, row[1:] != row[:-1]]
    starts = np.flatnonzero(new_set)
    # a row repeated within the slice (same document, same text) says nothing new
    fresh = new_code[starts] | np.r_[True, (doc[starts][1:] != doc[starts][:-1]) | (copies[row[starts]][1:] != copies[row[starts]][:-1])]
    positions, n_lines = line - first[row], np.diff(first)
    digests = [xxhash.xxh3_128_digest(k) for k in encoded.dictionary.cast(pa.binary()).to_pylist()]
    hashes = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)
    ends = np.r_[starts[1:], len(code)]
    keep = fresh
    starts, ends = starts[keep], ends[keep]
    here = doc[starts] == least_doc[starts]
    sizes = ends - starts
    flat = positions[np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    at = np.r_[0, np.cumsum(sizes)]
    return [hashes[code[starts]], here, doc[starts], copies[row[starts]], n_lines[row[starts]], at, flat]


def line_hits(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Per slice of a partition: one row for each key and its smallest document, to be compared with other slices,
    and one for each document that already loses lines (null hash)."""

    def hits(batches):
        for batch in batches:
            ids = pc.fill_null(batch.column(0), NO_DOC).to_numpy(zero_copy_only=False).astype(np.int64)
            copies = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, n in byte_slices(batch.column(2)):
                got = _slice_hits(ids[at : at + n], copies[at : at + n], batch.column(2).slice(at, n), least)
                if not got:
                    continue
                hashes, here, doc, copy, n_lines, bounds, flat = got
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                columns = [pa.array(hashes[:, 0], mask=~here), pa.array(hashes[:, 1], mask=~here), pa.array(doc), pa.array(copy), pa.array(n_lines, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["hi", "lo", "doc", "copy", "n_lines", "positions"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text).mapInArrow(hits, _HITS)


def _losers(batches):
    """Rows sorted by (hash, document): all but those of the hash's first document."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc = (batch.column(i).to_numpy() for i in range(3))
        new = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        if carry and (hi[0], lo[0]) == carry[:2]:
            new[0] = False
        owners = np.r_[carry[2] if carry else 0, doc[new]]
        owner = owners[np.cumsum(new)]
        carry = (hi[-1], lo[-1], owner[-1])
        yield batch.filter(pa.array(doc != owner)).select(["doc", "copy", "n_lines", "positions"])


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, positions: pd.Series) -> pd.Series:
    out = []
    for n, lost in zip(n_lines, positions):
        bits = np.ones(n, dtype=np.uint8)
        bits[np.asarray(lost, dtype=np.int64)] = 0
        out.append(zlib.compress(np.packbits(bits).tobytes()))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def kept_lines(n_lines: pd.Series, bitmap: pd.Series) -> pd.Series:
    """The bitmap as one boolean for each line."""
    return pd.Series([np.unpackbits(np.frombuffer(zlib.decompress(b), dtype=np.uint8), count=n).astype(bool) for n, b in zip(n_lines, bitmap)])


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, copy, n_lines, n_dropped, keep_bitmap) of every document that loses a line; others keep all of theirs.

    ``copy`` is the 64-bit hash of the text, which tells apart texts that share a document id. ``keep_bitmap`` has one
    bit for each line from the first on, most significant bit first, compressed with zlib. A key of ``least`` code
    points or more stays in the smallest document that holds it, as often as it stands there. Documents without an
    id come after all others and count as one. Null and empty texts have one empty line; shorter keys never go.
    """
    spark = docs.sparkSession
    hits = materialize(line_hits(docs, id_col, text_col, least))
    dealt = hits.filter("hi is not null").repartitionByRange(tasks_for(spark), "hi").sortWithinPartitions("hi", "lo", "doc", F.col("positions")[0])
    lost = dealt.mapInArrow(_losers, "doc long, copy long, n_lines int, positions array<int>")
    lost = lost.union(hits.filter("hi is null").select("doc", "copy", "n_lines", "positions"))
    by_doc = lost.groupBy("doc", "copy").agg(F.first("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("positions"))).alias("lost"))
    return by_doc.select("doc", "copy", "n_lines", F.size("lost").alias("n_dropped"), _bitmap("n_lines", "lost").alias("keep_bitmap"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that ``bitmaps`` drops taken out of the text, and n_lines and n_dropped added.

    Null texts stay null. The text goes through one shuffle and stays in the JVM.
    """
    lost = bitmaps.select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), "n_dropped", kept_lines("n_lines", "keep_bitmap").alias("_keep"))
    text = F.col(text_col).cast("string")
    keyed = docs.drop("n_lines", "n_dropped").withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_DOC)))).withColumn("_hash", F.xxhash64(text))
    joined = keyed.join(lost.hint("shuffle_hash"), (F.col("_id") == F.col("_doc")) & (F.col("_hash") == F.col("_copy")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: F.get(F.col("_keep"), i)), "\n")
    out = joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(1)).cast("long"))
    out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(1)).otherwise(F.col("n_lines")).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("_keep").isNull(), text).otherwise(kept)).withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long"))
    return out.drop("_id", "_hash", "_doc", "_copy", "_keep")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_lines(docs, line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH numbered AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM numbered
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), owned AS (
  SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS lost FROM keyed
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM owned GROUP BY doc_id
"""
