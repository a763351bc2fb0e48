"""Documents to packed training sequences: the stages of the corpus pipeline, in order.

Each stage takes what the one before kept, written as Parquet and read again, and all but the last return the columns
of ``documents``. Null ids pass every stage: they are rejected by no classifier and linked with no other document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import materialize, table
from strandframe.llm.linededup import drop_lines, line_bitmaps
from strandframe.llm.minhash import near_duplicates
from strandframe.llm.mixing import mix
from strandframe.llm.packing import pack, pieces
from strandframe.llm.quality import classify, score, trusted_ids
from strandframe.operators.storage import discard, recorded, tidy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_left: dict[str, list[str]] = {}  # what the last stage of an application has stored on its way


def _stage(f: Callable) -> Callable:
    """A stage that first removes what the one before stored on its way: a stage's result is written before the next begins,
    so only the tables of one stage take up disk at a time. What the last stage stores stays, as its result is lazy."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left.pop(spark.sparkContext.applicationId, []))
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        if f.__name__ != "packing":
            _left[spark.sparkContext.applicationId] = paths
        return out

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for those whose id is in ``ids``; the ids are hashed, so the texts are never sorted."""
    return docs.join(ids.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold. Where rows
    share an id, one rejected row rejects them."""
    verdict = classify(score(docs, trusted_ids(table(spark, sf_dir, "labels"))))
    return _without(docs, materialize(verdict.filter("not keep").select(F.col("doc").alias("doc_id"))))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds; n_chars follows the text. A document that loses
    every line that says anything is a copy of others and goes; one that was blank before stays."""
    kept = drop_lines(docs, line_bitmaps(docs))
    kept = kept.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates: five words, similarity of 0.8 or more.

    A document is compared by its text and, where an earlier stage changed that, by its text in ``documents`` too: a near
    copy that lost most lines to the document it was made from is still told by what it was. It stays if it is the
    smallest of its group by either. The text before is read once and shuffled by id, for all kept documents; only
    changed ones go on."""
    kept = docs.select("doc_id", F.xxhash64("text").alias("_hash"))
    whole = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = whole.join(kept.hint("shuffle_hash"), "doc_id").filter(F.xxhash64("text") != F.col("_hash")).select("doc_id", "text")
    before = materialize(before)
    tidy(spark)
    found = near_duplicates(docs.select("doc_id", "text").union(before), words=5, percent=80)
    return _without(docs, found.filter("not kept").select(F.col("doc").alias("doc_id")))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks: each at least once, none more than twice."""
    return mix(docs, max_passes=2.0).select(*COLUMNS)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with the sequence and the place that each has."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing sources", mixing), ("best-fit packing", packing)]
ORACLE_SQL = None  # hashing, model and packing are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
