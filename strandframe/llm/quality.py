"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each character (UTF-16 unit) from the three before it, by language. Counts cover all trusted documents but a
held-out fifth, whose perplexities give each language's threshold as a quantile. Scoring joins counts, not text:

1. One pass over the texts gives, for each cell (a run of rows of a file, by language and size of text), its distinct n-grams and how
   often trusted documents in it hold them.
2. These meet in count tables, sharded by n-gram, that every order's discounts and back-off weights are joined from.
3. Each cell asks for the log-probabilities of its own n-grams, and meets its documents' texts in one cogroup.

So the shuffle carries each text once, compressed, and each n-gram once a cell; no table goes to the driver or to every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, table

ORDER, BITS = 4, 16  # so that an n-gram of UTF-16 units is one 64-bit number
CELLS = ((1 << 18, 4096), (1 << 22, 64))  # rows of a cell for texts of fewer characters; longer ones are cells of their own
HELD_CHARS = 12_000_000  # of text that a task holds before it gives out its cells
START, STOP = "\x02", "\x03"
HELD_OUT, QUANTILE, PRIOR, STEPS = 5, 0.995, 200.0, 10_000
UNKNOWN = "(none)"
LEAST = 0.01  # of a discount, so that no probability is zero


def _mask(n: int) -> int:
    return (1 << (BITS * n)) - 1


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of each text (its end mark included) as a 64-bit key, and where texts end."""
    head, tail = (START * (ORDER - 1)).encode("utf-16-le"), STOP.encode("utf-16-le")
    parts = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    symbol = np.frombuffer(b"".join(x for t in parts for x in (head, t, tail)), dtype=np.uint16).astype(np.int64)
    key = np.zeros(len(symbol), dtype=np.int64)
    for back in range(ORDER):
        key[back:] |= symbol[: len(symbol) - back] << (BITS * back)
    lengths = np.array([len(t) // 2 for t in parts], dtype=np.int64)
    ends = np.cumsum(lengths + ORDER) if len(texts) else np.zeros(0, np.int64)
    keep = np.ones(len(key), dtype=bool)
    starts = ends - lengths - ORDER
    for k in range(ORDER - 1):
        keep[starts + k] = False
    return key[keep], np.cumsum(lengths + 1)


def _celled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(cell, lang, doc, text): cells follow the rows of the files that ``docs`` is read from. A cell has at most 2 ** 30
    characters, held compressed, or is one text."""

    def select(d: DataFrame) -> DataFrame:
        lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
        text, row = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col("_metadata.row_index")
        rows = F.when(F.length(text) < CELLS[0][0], CELLS[0][1]).when(F.length(text) < CELLS[1][0], CELLS[1][1]).otherwise(1)
        place = F.xxhash64(F.col("_metadata.file_path"), F.floor(row / rows), rows, lang)
        return d.select(place.alias("cell"), lang.alias("lang"), F.col(id_col).cast("long").alias("doc"), text.alias("text"))

    try:
        out = select(docs)
    except AnalysisException:  # not read from files: give it files
        out = select(materialize(docs.select(id_col, text_col, lang_col)))
    return out


def _cells_of(batches):
    """Rows of (cell, lang, ...) by cell, a few million characters at a time: ((cell, lang), lists of the others)."""
    held, chars = {}, 0
    for batch in batches:
        names = batch.schema.names
        text = names.index("text") - 2
        for cell, lang, *rest in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
            lists = held.setdefault((cell, lang), [[] for _ in rest])
            for into, value in zip(lists, rest):
                into.append(value)
            chars += len(rest[text])
            if chars > HELD_CHARS:
                yield from held.items()
                held, chars = {}, 0
    yield from held.items()


def _runs(sizes: np.ndarray, most: int = 1_000_000):
    """(start, end) of consecutive runs of texts, each of one text or of at most that many characters."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield at, to
        at = to


def _cell_counts(batches):
    """(cell, lang, gram, n) for runs of rows of the same cell; n counts trusted documents' text only."""
    for (cell, lang), (texts, trusted) in _cells_of(batches):
        every, counted = [], []
        for at, to in _runs(np.array([len(t) for t in texts])):
            keys, ends = grams(texts[at:to])
            every.append(np.unique(keys))
            flag = np.repeat(np.array(trusted[at:to], dtype=bool), np.diff(np.r_[0, ends]))
            counted.append(np.unique(keys[flag], return_counts=True))
        found = np.unique(np.concatenate(every))
        counts = np.zeros(len(found), dtype=np.int64)
        for seen, n in counted:
            counts[np.searchsorted(found, seen)] += n
        size = len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, cell)), pa.array([lang] * size, pa.string()), pa.array(found), pa.array(counts)], ["cell", "lang", "gram", "n"])
    give_back()


def _packed(batches):
    """(cell, lang, payload): the texts of a cell's rows with their ids and marks, compressed for the shuffle."""
    import pickle

    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for (cell, lang), lists in _cells_of(batches):
        payload = press.compress(pickle.dumps(lists, protocol=5))
        yield pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([lang]), pa.array([payload], pa.binary())], ["cell", "lang", "payload"])
    give_back()


def _join_small(rows: DataFrame, small: DataFrame, how: str = "inner", lanes: int = 64) -> DataFrame:
    """Join on lang with a table of a few rows for each language, without sending a language to one task."""
    spread = small.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    laned = rows.withColumn("_lane", F.pmod(F.xxhash64(*rows.columns), F.lit(lanes)).cast("int"))
    return laned.join(spread, ["lang", "_lane"], how).drop("_lane")


def _discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the three discounts of a level's counts, LEAST at least; where counts of counts are too few,
    fixed ones."""
    c = [F.sum((F.col("n") == k).cast("long")).alias(f"c{k}") for k in range(1, 5)]
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    enough = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("c3") > 0)
    d = [F.when(enough, F.least(F.greatest(k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}"), F.lit(LEAST)), F.lit(float(k)))).otherwise(F.lit(0.5 * k)).alias(f"d{k}") for k in (1, 2, 3)]
    return level.groupBy("lang").agg(*c).select("lang", *d)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, logp): the natural logarithm of P(last symbol | those before) for every row of ``counts``.

    ``counts`` has (lang, gram, n), n = 0 for n-grams to be scored that training text lacks. Orders below the highest
    count the distinct symbols before an n-gram. A context never seen backs off whole; below the first order all 65536
    symbols are as likely.
    """
    levels = [counts]
    for n in range(ORDER - 1, 0, -1):
        below = levels[-1].withColumn("gram", F.col("gram").bitwiseAND(F.lit(_mask(n)))).groupBy("lang", "gram").agg(F.sum((F.col("n") > 0).cast("long")).alias("n"))
        levels.append(materialize(below))
    lower = None
    for level in reversed(levels):
        d = F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).when(F.col("n") == 1, F.col("d1")).otherwise(0.0)
        ctx = F.shiftright(F.col("gram"), BITS)
        seen = _join_small(level, _discounts(level)).withColumn("d", d).withColumn("context", ctx)
        whole = seen.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("spare"))
        if lower is None:
            base = seen.withColumn("p_low", F.lit(1.0 / (1 << BITS)))
        else:
            base = seen.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_mask(lower[1])))).join(lower[0].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_low")), ["lang", "suffix"])
        p = F.when(F.col("total") > 0, (F.col("n") - F.col("d") + F.col("spare") * F.col("p_low")) / F.col("total")).otherwise(F.col("p_low"))
        scored = materialize(base.join(whole, ["lang", "context"]).select("lang", "gram", p.alias("p")))
        lower = (scored, 1 if lower is None else lower[1] + 1)
    return lower[0].select("lang", "gram", F.log("p").alias("logp"))


def _score(key, packed, asked):
    """Per document: symbols, and the sum of -log P over them, in the order of the text."""
    import pickle

    import zstandard

    gram, logp = asked.column("gram").to_numpy(), asked.column("logp").to_numpy()
    order = np.argsort(gram, kind="stable")
    gram, logp = gram[order], logp[order]
    out = []
    for lang, payload in zip(packed.column("lang").to_pylist(), packed.column("payload")):
        doc, texts, held = pickle.loads(zstandard.ZstdDecompressor().decompress(payload.as_py()))
        size, nll = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        for at, to in _runs(np.array([len(t) for t in texts])):
            keys, ends = grams(texts[at:to])
            size[at:to] = np.diff(ends, prepend=0)
            nll[at:to] = -np.add.reduceat(logp[np.searchsorted(gram, keys)], np.r_[0, ends[:-1]])
        out.append(pa.table([pa.array(doc, pa.int64()), pa.array([lang] * len(doc), pa.string()), pa.array(held, pa.bool_()), pa.array(size), pa.array(nll)], names=["doc", "lang", "held", "n_symbols", "nll"]))
    empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.bool_()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["doc", "lang", "held", "n_symbols", "nll"])
    return pa.concat_tables(out or [empty])


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc, lang, held, n_symbols, nll) of every row of ``docs``; ``trusted`` has the ids of trusted documents.

    ``held`` marks trusted documents that the counts leave out (a fifth, by their id's hash). Null texts are empty and
    have one symbol, their end. A null language is a language of its own. Rows without an id are scored, too. Equal rows
    are rows of their own; an empty table gives an empty one; other columns are left out.
    """
    ids = trusted.select(F.col(id_col).cast("long").alias("doc")).filter("doc is not null").distinct().withColumn("good", F.lit(True))
    held = F.pmod(F.xxhash64("doc", F.lit(11)), F.lit(HELD_OUT)) == 0
    rows = _celled(docs, id_col, text_col, lang_col).join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "doc", "left")
    good = F.coalesce("good", F.lit(False))
    rows = rows.select("cell", "lang", "doc", "text", (good & ~held).alias("train"), (good & held).alias("held"))
    wanted = materialize(rows.select("cell", "lang", "text", "train").mapInArrow(_cell_counts, "cell long, lang string, gram long, n long"))
    counts = materialize(wanted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    asked = wanted.select("cell", "lang", "gram").distinct().join(kneser_ney(counts), ["lang", "gram"]).select("cell", "gram", "logp")
    texts = rows.select("cell", "lang", "doc", "text", "held").mapInArrow(_packed, "cell long, lang string, payload binary")
    return texts.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(_score, "doc long, lang string, held boolean, n_symbols long, nll double")


def classify(scored: DataFrame, quantile: float = QUANTILE, prior: float = PRIOR) -> DataFrame:
    """(doc, lang, n_symbols, perplexity, threshold, keep) from ``score``.

    A document's mean is drawn to its language's held-out mean as by ``prior`` symbols of it, so that short texts are
    judged by what they show. The threshold is the ``quantile`` of the held-out documents' perplexities, exact to one
    part in STEPS of a nat; its bins are few for each language (their number is bounded by STEPS times the range of a
    mean), so one task may hold those of a language. Languages without held-out trusted text have none, and keep all.
    """
    scored = materialize(scored)
    mean = scored.filter("held").groupBy("lang").agg((F.sum("nll") / F.sum("n_symbols")).alias("mean"))
    drawn = _join_small(scored, mean, "left").withColumn("bin", F.floor((F.col("nll") + prior * F.col("mean")) / (F.col("n_symbols") + prior) * STEPS))
    drawn = materialize(drawn)
    bins = drawn.filter("held").groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")
    cut = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    cut = cut.filter(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(F.min("bin").alias("cut"))
    out = _join_small(drawn, cut, "left")
    perplexity = F.coalesce(F.exp(F.col("bin") / STEPS), F.exp(F.col("nll") / F.col("n_symbols")))
    return out.select("doc", "lang", "n_symbols", F.round(perplexity, 6).alias("perplexity"), F.round(F.exp((F.col("cut") + 1) / STEPS), 6).alias("threshold"), F.coalesce(F.col("bin") <= F.col("cut"), F.lit(True)).alias("keep"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1").select("doc_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
    return classify(scored).withColumnRenamed("doc", "doc_id")
