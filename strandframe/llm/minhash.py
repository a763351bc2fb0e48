"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document is the set of its word shingles' 64-bit hashes. Documents with equal sets form a class, one node of the graph. One hash function deals the set over bins; a bin's value is the smallest hash in it, and an empty bin
takes the value of a filled one picked by its own random walk (Shrivastava, 2017). Bands of bins give bucket keys.
Within a bucket only a star of edges is a candidate: from the member that shares the most buckets with others, in a
family of copies the one they were made from, to each of the rest. Candidates are confirmed on the full sets. Only
buckets whose members are then still in different components are looked at again, block by block: all pairs from
different components are sifted by their signatures and their 1024 lowest hashes, and of those that may be links as many
are confirmed as join the block's components. Where one of them turns out not to be a link, all other pairs of its bucket
are confirmed, so a star that misses loses nothing. Small sets, whose signatures say little, also meet by an exact prefix
filter. Buckets of the same members are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.graph import joined_further, joined_to
from strandframe.operators.storage import discard, materialize_parts, recorded

from .common import byte_slices, give_back, materialize, materialize_bucketed, table, tasks_for, tidy

BIN_BITS = 7
ROWS, BANDS = 5, 25
WALK = 256
BLOCK = 1024
SMALL = 96  # sets up to this size also get the keys of an exact prefix filter
PACKED = 6  # bytes of a hash that are compared: two sets of 1000 have a false match once in some 10 ** 8 pairs
WAVES = 4  # parts in which texts and sets are shuffled, one after the other, so that only one part's files take up disk
WAVE_ROWS = 16384  # sets that one more wave is worth
CELL_ROWS = 1 << 17  # rows with their lowest hashes that one more wave is worth
LOWEST = 1024  # smallest hashes by which pairs are sifted before they are confirmed
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_walks = (mix(np.arange(1 << BIN_BITS, dtype=np.uint64)[:, None] * A + np.arange(1, WALK + 1, dtype=np.uint64) * B) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
_bounds = np.arange(1 << BIN_BITS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty for a text without words.

    Words are runs of anything but blank and \\t to \\r, with A-Z lower-cased. A text of fewer than ``words`` words has
    its whole sequence as its one shingle.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    encoded = flat.dictionary_encode()
    code = encoded.indices.to_numpy().astype(np.int64)
    spelled = encoded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in spelled], dtype=np.uint64)
    real = np.array([w != "" for w in spelled], dtype=bool)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    filled = real[code]
    value = hashes[code][filled]
    offsets = np.r_[0, np.cumsum(filled)][offsets]
    shingles = np.zeros(max(0, len(value) - words + 1), dtype=np.uint64)
    for k in range(words):
        shingles = mix(shingles * A + value[k : k + len(shingles)] + B)
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = end - start
        if n >= words:
            out.append(np.unique(shingles[start : end - words + 1]))
        elif n:
            whole = np.array([n], dtype=np.uint64)
            for x in value[start:end]:
                whole = mix(whole * A + x + B)
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin of a sorted, non-empty set; empty bins filled by optimal densification."""
    at = np.searchsorted(shingles, _bounds)
    value = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & (value >> np.uint64(64 - BIN_BITS) == np.arange(len(_bounds), dtype=np.uint64))
    empty = np.flatnonzero(~filled)
    if len(empty):
        picks = _walks[empty]
        found = filled[picks]
        step = found.argmax(axis=1)
        source = np.where(found.any(axis=1), picks[np.arange(len(empty)), step], np.flatnonzero(filled)[0])
        value[empty] = value[source]
    return value


def _bands(value: np.ndarray) -> np.ndarray:
    rows = value[: ROWS * BANDS].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * B + np.uint64(1)
    for k in range(ROWS):
        key = mix(key * A + rows[:, k])
    return key


def _keys(shingles: np.ndarray, value: np.ndarray, percent: int) -> np.ndarray:
    """Bucket keys of a set: its bands, and for a small one the prefix of its sorted hashes that every linked set hits."""
    bands = _bands(value)
    if len(shingles) > SMALL:
        return bands
    prefix = len(shingles) - -(-percent * len(shingles) // 100) + 1
    return np.r_[bands, mix(shingles[:prefix] + A)]


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc, n_shingles, hi, lo, prints, bands): hi and lo identify the set, prints has one byte for each bin."""

    def sketch(batches):
        import xxhash

        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(at, n), words)
                ids = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=">i8") for s in sets]
                values = [signature(s) if len(s) else None for s in sets]
                columns = [
                    batch.column(0).slice(at, n),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(i[0]) for i in ids], pa.int64()),
                    pa.array([int(i[1]) for i in ids], pa.int64()),
                    pa.array([None if v is None else (v & np.uint64(255)).astype(np.uint8).tobytes() for v in values], pa.binary()),
                    pa.array([None if v is None else _keys(s, v, percent).view(np.int64) for s, v in zip(sets, values)], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n_shingles", "hi", "lo", "prints", "bands"])
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(sketch, "doc long, n_shingles long, hi long, lo long, prints binary, bands array<long>")


def _packed(shingles: np.ndarray) -> bytes:
    """The upper PACKED bytes of each hash, in order: what is stored and sent of a set."""
    return np.ascontiguousarray(shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :PACKED]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // PACKED, 8), dtype=np.uint8)
    out[:, :PACKED] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, PACKED)
    return out.view(">u8").ravel().astype(np.uint64)


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int, of: int = WAVES) -> DataFrame:
    """(least_id, node, shingles) of the wanted nodes (node, least_id, hi, lo), from the whole texts of the rows with their
    least id; of texts that share that id only the one whose set is the node's. Stored by least_id, as texts meet, in ``of`` parts."""

    def sets(batches):
        import xxhash

        for batch in batches:
            for at, n in byte_slices(batch.column(2)):
                part = batch.slice(at, n)
                got = shingle_sets(part.column(2), words)
                marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in got), dtype=">i8").reshape(-1, 2)
                own = np.flatnonzero((marks[:, 0] == part.column(3).to_numpy()) & (marks[:, 1] == part.column(4).to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array([_packed(got[i]) for i in own], pa.binary())], ["least_id", "node", "shingles"])

    own = docs.select(F.col(id_col).cast("long").alias("least_id"), F.col(text_col).cast("string").alias("text"))

    def part(wave: int) -> DataFrame:
        met = _wave(own, "least_id", wave, of).join(_wave(wanted, "least_id", wave, of).hint("shuffle_hash"), "least_id").withColumn("_mark", F.xxhash64("text"))
        # repeated rows are one; they are together already
        once = met.groupBy("least_id", "node", "_mark").agg(F.first("text").alias("text"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
        return once.select("least_id", "node", "text", "hi", "lo").mapInArrow(sets, "least_id long, node long, shingles binary")

    return materialize_parts((part(k) for k in range(of)), "least_id", tasks_for(docs.sparkSession))


def _wave(rows: DataFrame, key: str, wave: int, of: int) -> DataFrame:
    """One of so many parts of ``rows`` by ``key``."""
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(of)) == wave)


def _wave_count(rows: DataFrame, each: int | None = None) -> int:
    return min(WAVES, 1 + rows.count() // (each or WAVE_ROWS))


def _waves(rows: DataFrame, key: str, each: int | None = None) -> Iterator[DataFrame]:
    """Stored ``rows`` in up to WAVES parts, by how many they are."""
    of = _wave_count(rows, each)
    return (_wave(rows, key, k, of) for k in range(of))


def _fetched(sets: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with the shingles of their nodes, brought to where the sets lie: these are not shuffled.

    A plain node = _node would become a key of the join, for which the table's buckets do not serve."""
    asked = rows.join(classes.select("node", "least_id"), "node").hint("shuffle_hash")
    return asked.join(sets.withColumnRenamed("node", "_node"), "least_id").filter("node - _node = 0").drop("_node", "least_id")


def _lowest(sets: DataFrame) -> DataFrame:
    """(node, low): the upper halves of the LOWEST lowest hashes."""

    def lowest(batches):
        for batch in batches:
            low = [(_unpacked(x[: PACKED * LOWEST]) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], ["node", "low"])

    return sets.select("node", "shingles").mapInArrow(lowest, "node long, low binary")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that may be links by their sizes and signatures, within four deviations."""
    share = percent / 100

    def test(batches):
        for batch in batches:
            small, large = (np.asarray(f(batch.column(2).to_numpy(), batch.column(3).to_numpy()), dtype=np.int64) for f in (np.minimum, np.maximum))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in (4, 5))
            slack = 4 * np.sqrt(share * (1 - share) / np.clip(small / 2, 1, 1 << BIN_BITS))
            yield batch.filter(pa.array((100 * small >= percent * large) & ((x == y).mean(axis=1) >= share - slack))).select(["u", "v"])

    told = nodes.select("node", "n_shingles", "prints")
    side = lambda k: told.toDF(k, f"n_{k}", f"p_{k}")
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "p_u", "p_v").mapInArrow(test, "u long, v long")


def _confirm(sets: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union.

    Sets lie by least_id and are not shuffled as they lie: v's are fetched where they are and sent on with their pairs, u's,
    the centres of stars, once each; a centre of very many pairs is a skewed key of a plain join."""

    def check(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b):
                both = np.concatenate([_unpacked(x), _unpacked(y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    right = _fetched(sets, classes, pairs.withColumnRenamed("v", "node")).select("u", F.col("node").alias("v"), F.col("shingles").alias("b"))
    left = _fetched(sets, classes, pairs.select(F.col("u").alias("node")).distinct()).select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    return right.join(left, "u").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def _confirmed(sets: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``_confirm`` of stored pairs, all of them, stored; in waves by u, each of which lets go of the sets that it has sent."""
    links = []
    for part in _waves(pairs, "u"):
        links.append(materialize(_confirm(sets, classes, part, percent)))
        tidy(pairs.sparkSession)
    return reduce(DataFrame.union, links)


def _sifted(low: list[np.ndarray], size: np.ndarray, i: int, to: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``to`` may be linked with i by their lowest hashes, which of them are for certain (whole sets), and how alike they seem."""
    mine, lengths = low[i], np.array([len(low[t]) for t in to])
    flat, who = np.concatenate([low[t] for t in to]), np.repeat(np.arange(len(to)), lengths)
    whole = (size[to] <= LOWEST) & (size[i] <= LOWEST)
    # where one set is cut off, only hashes up to the lower of both ends can be compared
    ends = np.minimum(np.array([low[t][-1] if size[t] > LOWEST else 0xFFFFFFFF for t in to]), mine[-1] if size[i] > LOWEST else 0xFFFFFFFF)
    shared = (mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat) & (flat <= ends[who])
    both = np.bincount(who, weights=shared, minlength=len(to))
    union = np.bincount(who, weights=flat <= ends[who], minlength=len(to)) + np.searchsorted(mine, ends, side="right") - both
    share = percent / 100
    slack = np.where(whole, 1e-9, 4 * np.sqrt(share * (1 - share) / np.maximum(union, 1)))
    return both >= (share - slack) * union, whole, both / np.maximum(union, 1)


def _across(percent: int, every: bool):
    """(u, v, band, rest): pairs of a cell's members in different components that may be linked by their sketches.

    Each pair has a member outside the cell's largest component and comes in the first bucket that both are in. ``every``
    gives all of them. Else pairs come as long as they join components, certain ones first and then the most similar;
    rest tells that others were left out that matter only if this one is no link. Bounds are four deviations.
    """
    share = percent / 100

    def pairs(key, cell):
        node, comp, size = (cell.column(c).to_numpy() for c in ("node", "comp", "n_shingles"))
        sides = (cell.column("a").to_numpy(), cell.column("b").to_numpy())
        prints = np.frombuffer(b"".join(cell.column("prints").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        band = key[0].as_py()
        bands = np.array([np.array(x[:BANDS], dtype=np.int64) for x in cell.column("bands").to_pylist()])
        low = [np.frombuffer(x, dtype=np.uint32) for x in cell.column("low").to_pylist()]
        names, number = np.unique(comp, return_inverse=True)
        largest = names[np.bincount(number).argmax()]
        # components that the certain pairs so far have joined, and those that all pairs given have
        sure, tried = number.copy(), number.copy()
        u, v, known = [], [], []
        withheld = False

        def give(i: int, to: np.ndarray, certain: bool) -> None:
            u.extend([node[i]] * len(to))
            v.extend(node[to].tolist())
            known.extend([certain] * len(to))

        for i in np.flatnonzero(comp != largest).tolist():
            other = (sides[0][i] & sides[1]) | (sides[1][i] & sides[0])
            fits = other & (sure != sure[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            to = np.flatnonzero(fits & ((comp == largest) | (node > node[i])))
            if not len(to):
                continue
            agree = (prints[to] == prints[i]).mean(axis=1)
            sampled = np.clip(np.minimum(size[to], size[i]) / 2, 1, 1 << BIN_BITS)
            to = to[agree >= share - 4 * np.sqrt(share * (1 - share) / sampled)]
            same = bands[to] == bands[i]
            to = to[np.where(same.any(axis=1), bands[i][same.argmax(axis=1)], band) == band]
            if not len(to):
                continue
            ok, certain, alike = _sifted(low, size, i, to, percent)
            to, certain, alike = to[ok], certain[ok], alike[ok]
            if every:
                give(i, to, True)
                continue
            _, one = np.unique(sure[to[certain]], return_index=True)
            chosen = to[certain][one]
            give(i, chosen, True)
            for label in (sure, tried):
                label[np.isin(label, label[chosen])] = label[i]
            to, alike = to[~certain], alike[~certain]
            there = sure[to] != sure[i]
            to, alike = to[there], alike[there]
            order = np.argsort(-alike, kind="stable")
            best = to[order][np.sort(np.unique(tried[to[order]], return_index=True)[1])]
            best = best[tried[best] != tried[i]]
            withheld |= len(best) < len(to)
            give(i, best, False)
            tried[np.isin(tried, tried[best])] = tried[i]
        u, v = np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)
        rest = np.array(known, dtype=bool) | withheld
        return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v)), "band": pa.array(np.full(len(u), band, dtype=np.int64)), "rest": pa.array(rest)})

    return pairs


def _different(entries: DataFrame) -> DataFrame:
    """(band, n, weight): buckets of several members, of those with the same members only one: the one by the first band of
    all, so that no pair loses the first bucket that both are in. weight is n for each bucket that it stands for."""
    mark = lambda *seed: F.bit_xor(F.xxhash64("node", *map(F.lit, seed)))
    held = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n"), mark().alias("x"), mark(1).alias("y"), F.min(F.least("place", F.lit(BANDS))).alias("place")).filter("n > 1")
    one = held.groupBy("n", "x", "y").agg(F.min(F.struct("place", "band")).alias("first"), F.sum("n").alias("weight"))
    return one.select(F.col("first.band").alias("band"), "n", "weight")


def _met(apart: DataFrame, nodes: DataFrame, sets: DataFrame, classes: DataFrame, percent: int, every: bool) -> DataFrame:
    """The pairs (u, v, band, rest) of the cells of ``apart``, stored."""
    met = []
    for part in _waves(apart, "band", CELL_ROWS):
        cells = _cells(part, nodes, lambda met: _lowest(_fetched(sets, classes, met)))
        met.append(materialize(cells.groupBy("band", "i", "j").applyInArrow(_across(percent, every), "u long, v long, band long, rest boolean")))
        del cells
        tidy(apart.sparkSession)
    return reduce(DataFrame.union, met)


def _apart(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of those buckets whose members are in several components, stored, with what ``_cells`` deals them by."""
    member = _with_component(entries, comps)
    sizes = materialize(member.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("own")))
    largest = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.sum("own").alias("n"), F.max(F.struct("own", "comp")).alias("top")).filter("comps > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = largest.select("band", (F.col("n") <= BLOCK).alias("whole"), F.col("top.comp").alias("largest"), blocks(F.col("top.own")).alias("many"), blocks(F.col("n") - F.col("top.own")).alias("few"))
    return materialize(member.drop("n").join(mixed, "band"))


def _still_apart(entries: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """The cells of all buckets whose members are in several components."""
    return _cells(_apart(entries, comps), nodes)


def _cells(apart: DataFrame, nodes: DataFrame, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Cells of at most two blocks of the members of whole buckets, from ``_apart``.

    A bucket of one block is one cell. In larger ones only pairs with a member outside the bucket's largest component
    matter: members of that component are sent once for each block of the others, the others to all blocks, so a stray
    member costs one row a block. ``also`` gives more columns of the nodes (node) that are in such a bucket; no other
    node is sent.
    """
    met = apart.select("node").distinct()
    told = nodes.join(met, "node", "left_semi")
    rest = apart.join(told.join(also(met), "node") if also else told, "node")
    inside = F.col("comp") == F.col("largest")
    mine = F.pmod(F.xxhash64("node"), F.when(inside, F.col("many")).otherwise(F.col("few"))).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j, a, b: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(a).alias("a") if isinstance(a, bool) else a.alias("a"), F.lit(b).alias("b") if isinstance(b, bool) else b.alias("b"))
    # i < 0: block -1 - i of the largest component meets block j of the others; else two blocks of the others meet
    of_largest = F.transform(numbers(F.col("few")), lambda r: cell(-1 - F.col("mine"), r, True, False))
    across = F.transform(numbers(F.col("many")), lambda m: cell(-1 - m, F.col("mine"), False, True))
    among = F.transform(numbers(F.col("few")), lambda r: cell(F.least(F.col("mine"), r), F.greatest(F.col("mine"), r), F.col("mine") <= r, F.col("mine") >= r))
    one = F.array(cell(F.lit(0), F.lit(0), True, True))
    dealt = rest.withColumn("mine", mine).withColumn("cell", F.explode(F.when(F.col("whole"), one).when(inside, of_largest).otherwise(F.concat(across, among))))
    return dealt.select("band", "cell.i", "cell.j", "comp", *[c for c in rest.columns if c not in {*apart.columns} - {"node"}], "cell.a", "cell.b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc, n_shingles, component_id, kept), one row for each row of ``docs``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. component_id is the
    smallest id reachable by links. Documents without words, with a null text or a null id are linked with nothing;
    a null id has a null component and is kept. Repeated rows are one node, and each keeps its row. Rows that share an id
    but differ are compared each by its own set, and component_id is that of the row. A link between
    different sets of more than 96 shingles is found with probability of about 0.9999 or more at 85 percent (25 bands
    of 5), one of smaller sets always.
    """
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    with recorded() as wide:
        sketch = materialize(sketches(keyed, "_id", "_text", words, percent))
    tidy(docs.sparkSession)
    full = sketch.filter("n_shingles > 0 and doc is not null")
    # nodes are numbered in the order of their smallest ids, so the smallest node of a component has its smallest id
    least = full.groupBy("hi", "lo").agg(F.min("doc").alias("least_id"))
    dealt = least.repartitionByRange(tasks_for(docs.sparkSession), "least_id", "hi", "lo").sortWithinPartitions("least_id", "hi", "lo")
    classes = materialize(dealt.withColumn("node", F.monotonically_increasing_id()))
    nodes = full.join(classes, ["hi", "lo"]).filter("doc = least_id").select("node", "n_shingles", "prints", "bands").dropDuplicates(["node"])
    with recorded() as whole:
        nodes = materialize(nodes)
    # from here on a row of docs is its set's identity alone; the sketches are those of the nodes
    sketch = materialize(sketch.select("doc", "n_shingles", "hi", "lo"))
    discard(docs.sparkSession, wide)
    tidy(docs.sparkSession)
    entries = nodes.select("node", F.posexplode("bands").alias("place", "band"))
    entries = materialize(entries.join(_different(entries), "band").drop("place"))
    tidy(docs.sparkSession)
    popular = entries.groupBy("node").agg(F.sum("weight").alias("weight"))
    entries = entries.drop("weight")
    weighed = entries.join(popular, "node")
    centers = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")).select("band", (-F.col("top.minus")).alias("center"))
    stars = entries.join(centers, "band").filter("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    stars = materialize(_likely(stars, nodes, percent))

    touched = entries.select("node").distinct()
    sketched = materialize(nodes.join(touched, "node", "left_semi").select("node", "n_shingles", "prints", "bands"))
    discard(docs.sparkSession, whole)
    tidy(docs.sparkSession)
    sets = _sets_of(keyed, classes.join(touched, "node", "left_semi"), "_id", "_text", words, _wave_count(sketched))
    links = _confirmed(sets, classes, stars, percent)

    comps = joined_to(links)
    given = _met(_apart(entries, comps), sketched, sets, classes, percent, every=False)
    pairs = materialize(given.select("u", "v").distinct())
    found = _confirmed(sets, classes, pairs, percent)
    comps = joined_further(comps, found)
    # where a pair that stood for others was no link and nothing else has joined its components, these others are asked
    side = lambda k: comps.toDF(k, f"_{k}")
    doubtful = given.filter("rest").join(found, ["u", "v"], "left_anti").join(side("u"), "u", "left").join(side("v"), "v", "left")
    doubtful = materialize(doubtful.filter(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("band").distinct())
    if not doubtful.isEmpty():
        again = _apart(entries.join(doubtful, "band", "left_semi"), comps)
        tried = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(pairs)
        more = materialize(_met(again, sketched, sets, classes, percent, every=True).select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"))
        comps = joined_further(comps, _confirmed(sets, classes, more, percent))

    smallest = classes.select(F.col("node").alias("comp"), F.col("least_id").alias("component_id"))
    labelled = _with_component(classes, comps).join(smallest, "comp").select("hi", "lo", "component_id")
    out = sketch.select("doc", "n_shingles", "hi", "lo").join(labelled, ["hi", "lo"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc")).otherwise(F.col("component_id")))
    return out.select("doc", "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def _with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` with comp, the component of their node: itself if it has no link."""
    return rows.join(comps.select("node", F.col("component").alias("_c")), "node", "left").withColumn("comp", F.coalesce("_c", "node")).drop("_c")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).withColumnRenamed("doc", "doc_id")
