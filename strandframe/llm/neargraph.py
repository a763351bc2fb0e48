"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors of a label form one node. A label is cut, by centres fitted on a bounded sample, into overlapping regions
that a task can hold, and each region into overlapping small shards:

1. Build. In each shard a node's nearest neighbours are thinned so that none is much closer to a kept one than to the
   node (robust pruning); the lists are made mutual, and the node nearest to the shard's mean is its medoid.
2. Unite. The adjacency lists of a region's shards become one graph.
3. Search. Each node walks the united graph of its region greedily from the nearest medoids, fetching the vectors of
   the neighbours it meets and no others, and then widens over everything within the threshold.
4. Verify. Every link is a cosine in double precision.
5. Audit. Some nodes of each label are compared with the whole label; while too few of their links were found, all is
   done again with twice the overlap. Their true numbers of links are returned beside those found.

A shard whose nodes have more links than a list holds, or whose centres are all within the threshold of one another (a
group of near copies, however large), compares all its pairs in cells of two blocks. A pair of nodes that meet in such
shards is counted in the smallest of them alone, and by no walk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.graph import components

from .common import materialize, table

SAMPLE = 16_384  # nodes that the centres of one split are fitted on, at most about
SPLIT = 512  # centres of one split, at most; what is still too large is split again
REGION, LEAF, BLOCK = 32_768, 2000, 2000  # nodes of a region, a shard, a block of a dense shard, at most
LANE = 16_384  # nodes whose walks one task does, at most about
OVERLAP, WIDEST, DEPTH = 3, 12, 5
NEAREST, DEGREE, FAR, ALPHA = 48, 16, 2, 1.2
BEAM, WIDTH, BATCH = 24, 4, 256
AUDIT_NODES, AIM = 256, 0.99
MANY_LABELS = 65_536


def _can_link(id_col: str, vec_col: str, label_col: str) -> Column:
    """Whether a row has an id, a label and a vector of finite components that are not all zero."""
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(F.col(vec_col), lambda x: x != 0)
    return F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite & some, F.lit(False))


def _marked_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, hi, lo, v): the vector as doubles; hi and lo identify it. Rows that can't link are left out."""

    def convert(batches):
        import xxhash

        for batch in batches:
            rows = [(np.asarray(values, dtype=np.float64) + 0.0).tobytes() for values in batch.column(2).to_pylist()]
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in rows), dtype=">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(rows, pa.binary())], ["vec_id", "label", "hi", "lo", "v"])

    chosen = vectors.filter(_can_link(id_col, vec_col, label_col)).select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vec_col).cast("array<double>"))
    return chosen.mapInArrow(convert, "vec_id long, label string, hi long, lo long, v binary")


def _units(column) -> np.ndarray:
    """Vectors of length one; shorter ones count as zero where longer ones go on."""
    raw = column.to_pylist()
    width = max((len(r) for r in raw), default=8)
    x = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), dtype=np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# --- cutting labels into regions and regions into shards ---------------------------------------------------------


def _apart(centres: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """The centres of the largest clusters, without those of cosine >= least to a larger one that stays."""
    kept = np.zeros(0, dtype=int)
    for c in np.argsort(-sizes, kind="stable"):
        if not len(kept) or (centres[kept] @ centres[c]).max() < least:
            kept = np.append(kept, c)
    return centres[np.sort(kept)]


def _fit(least: float):
    """Spherical k-means on the sample of one shard that is to be split."""

    def fit(key, sample):
        sample = sample.take(pa.array(np.argsort(sample.column("node").to_numpy())))
        x = _units(sample.column("v"))
        k = min(int(sample.column("k")[0].as_py()), len(x))
        centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(6):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            size = np.sqrt((sums * sums).sum(axis=1))
            centres[size > 0] = sums[size > 0] / size[size > 0, None]
        centres = _apart(centres, np.bincount(near, minlength=k), least)
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([len(centres)], pa.int64()), pa.array([centres.tobytes()], pa.binary())], names=["label", "shard", "k", "centres"])

    return fit


def _assign(overlap: int, least: float):
    """Each node of a lane with its ``overlap`` nearest centres and those of cosine >= least, the nearest marked."""

    def assign(key, lane, fitted):
        rows = child = first = np.zeros(0, dtype=np.int64)
        if lane.num_rows and fitted.num_rows:
            x = _units(lane.column("v"))
            centres = np.frombuffer(fitted.column("centres")[0].as_py()).reshape(fitted.column("k")[0].as_py(), -1)
            width = min(centres.shape[1], x.shape[1])
            cos = x[:, :width] @ centres[:, :width].T
            best = np.argsort(-cos, axis=1, kind="stable")[:, : min(overlap, max(1, len(centres) // 3))]  # so that each split shrinks
            chosen = cos >= least
            np.put_along_axis(chosen, best, True, axis=1)
            rows, child = np.nonzero(chosen)
            first = child == best[rows, 0]
        kept = lane.select(["label", "region", "node", "copies", "v", "home"]).take(pa.array(rows))
        return kept.append_column("shard", lane.column("shard").take(pa.array(rows))).append_column("child", pa.array(child, pa.int64())).append_column("first", pa.array(first.astype(bool), pa.bool_()))

    return assign


PLACED = "label string, region long, node long, copies long, v binary, home boolean, shard long"


def _cut(placed: DataFrame, most: int, overlap: int, least: float, homes: bool) -> tuple[DataFrame, int]:
    """``placed`` with shards split until none has more than ``most`` nodes, and the most centres of a split.

    A new column whole marks shards that can't be split: their centres are within the threshold of one another, or
    DEPTH splits did not do. ``homes`` keeps home true only where a node is with its nearest centre.
    """
    done, open_, most_centres = [], placed, 1
    at = ["label", "shard"]
    for level in range(DEPTH):
        sizes = materialize(open_.groupBy(*at).agg(F.count(F.lit(1)).alias("n")))
        big = sizes.filter(F.col("n") > most)
        if big.isEmpty():
            break
        done.append(open_.join(big, at, "left_anti").withColumn("whole", F.lit(False)))
        part = open_.join(big, at)
        share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
        k = F.greatest(F.lit(2), F.least(F.lit(SPLIT), F.ceil(F.col("n") * overlap * 2 / most)))
        sample = part.filter(F.pmod(F.xxhash64("node", F.lit(7 + level)), F.lit(1_000_000)) < share * 1_000_000).select(*at, "node", "v", k.alias("k"))
        centres = materialize(sample.groupBy(*at).applyInArrow(_fit(least), "label string, shard long, k long, centres binary"))
        most_centres = max(most_centres, centres.agg(F.max("k")).first()[0] or 1)
        done.append(part.join(centres.filter("k > 1").select(*at), at, "left_anti").drop("n").withColumn("whole", F.lit(True)))
        lanes = F.ceil(F.col("n") / LANE).cast("int")
        laned = part.withColumn("lane", F.pmod(F.xxhash64("node", F.lit(3)), lanes).cast("int")).drop("n")
        fitted = centres.filter("k > 1").join(big, at).select(*at, "k", "centres", F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"))
        cells = laned.groupBy(*at, "lane").cogroup(fitted.groupBy(*at, "lane"))
        assigned = cells.applyInArrow(_assign(overlap, least), f"{PLACED}, child long, first boolean")
        home = F.col("home") & F.col("first") if homes else F.col("home")
        open_ = materialize(assigned.select("label", "region", "node", "copies", "v", home.alias("home"), F.xxhash64("shard", "child", F.lit(level)).alias("shard")))
    else:
        sizes = open_.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
        open_ = open_.join(sizes, at).withColumn("whole", F.col("n") > most).drop("n")
        sizes = None
    if sizes is not None:
        open_ = open_.withColumn("whole", F.lit(False))
    out = open_
    for d in done:
        out = out.unionByName(d)
    return materialize(out), most_centres


# --- building ----------------------------------------------------------------------------------------------------


def _build(least: float):
    """Mutual adjacency lists of one shard, its medoid, and whether it is dense."""

    def build(key, cell):
        cell = cell.take(pa.array(np.argsort(cell.column("node").to_numpy())))
        x, node = _units(cell.column("v")), cell.column("node").to_numpy()
        n = len(node)
        a = b = np.zeros(0, dtype=np.int64)
        dense = cell.column("whole")[0].as_py()
        if n > 1:
            dist = 1.0 - (x @ x.T).astype(np.float32)
            np.fill_diagonal(dist, np.inf)
            dense = bool(dense or (dist[:: max(1, n // 64)] <= 1.0 - least).sum(axis=1).mean() > NEAREST)
            m = min(NEAREST, n - 1)
            cand = np.argpartition(dist, m - 1, axis=1)[:, :m]
            far = np.take_along_axis(dist, cand, 1)
            by = np.argsort(far, axis=1, kind="stable")
            cand, far = np.take_along_axis(cand, by, 1), np.take_along_axis(far, by, 1)
            open_, picked, rows = np.ones(cand.shape, dtype=bool), [], np.arange(n)
            for _ in range(min(DEGREE, m)):
                first = open_.argmax(axis=1)
                some = open_[rows, first]
                if not some.any():
                    break
                pick = cand[rows, first]
                picked.append(np.where(some, pick, -1))
                open_ &= ~((ALPHA * dist[pick[:, None], cand] <= far) & some[:, None])
                open_[rows, first] = False
            step = np.random.default_rng(n).integers(1, n, size=(n, min(FAR, n - 1)))
            lists = np.concatenate([np.stack(picked, axis=1), (rows[:, None] + step) % n], axis=1)
            a, b = np.repeat(rows, lists.shape[1]), lists.ravel()
            a, b = a[b >= 0], b[b >= 0]
            both = np.unique(np.concatenate([a * n + b, b * n + a]))
            a, b = both // n, both % n
        starts = np.searchsorted(a, np.arange(n + 1))
        medoid = np.arange(n) == (x @ x.mean(axis=0)).argmax()
        near = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(node[b], pa.int64()))
        return cell.select(["label", "region", "shard", "node", "copies", "v"]).append_column("near", near).append_column("medoid", pa.array(medoid)).append_column("dense", pa.array([dense] * n, pa.bool_()))

    return build


# --- searching ---------------------------------------------------------------------------------------------------


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows a and b, a few at a time."""
    parts = [np.einsum("ij,ij->i", x[a[s : s + 32768]], x[b[s : s + 32768]]) for s in range(0, len(a), 32768)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _neighbours(starts: np.ndarray, near: np.ndarray, who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = starts[at + 1] - starts[at]
    to = near[np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    return np.repeat(who, sizes), to


def _unseen(seen: np.ndarray, mark: np.ndarray, who: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs not met before, each once and in the order given, marked as met; ``mark`` is room for a number a pair."""
    new = ~seen[who, to]
    who, to = who[new], to[new]
    place = np.arange(len(who), dtype=np.int32)
    mark[who, to] = place
    one = mark[who, to] == place
    who, to = who[one], to[one]
    seen[who, to] = True
    return who, to


def _walk(x: np.ndarray, starts: np.ndarray, near: np.ndarray, queries: np.ndarray, medoids: np.ndarray, least: float, beam: int = BEAM, passable=None) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, node) pairs of cosine >= least that the walks of ``queries`` reach, and the inner products taken.

    ``passable`` tells which pairs the widening goes on from; all by default.
    """
    q, n = len(queries), len(x)
    seen, spent, mark = np.zeros((q, n), dtype=bool), np.zeros((q, n), dtype=bool), np.empty((q, n), dtype=np.int32)
    gate = x[queries] @ x[medoids].T
    enter = medoids[np.argsort(-gate, axis=1, kind="stable")[:, :WIDTH]]
    front = np.full((q, beam), -1)
    score = np.full((q, beam), -np.inf)
    fresh = np.repeat(np.arange(q), enter.shape[1]), enter.ravel()
    hits, live, taken = [], np.arange(q), q * len(medoids)
    who, to = _unseen(seen, mark, *fresh)
    while len(who):
        cos = _dots(x, queries[who], to)
        taken += len(who)
        ok = cos >= least
        hits.append((who[ok], to[ok]))
        # the best of the beam and what was met now
        width = int(np.bincount(who).max())
        met, value = np.full((q, width), -1), np.full((q, width), -np.inf)
        place = np.arange(len(who)) - np.searchsorted(who, who)
        met[who, place], value[who, place] = to, cos
        every, rank = np.concatenate([front[live], met[live]], axis=1), np.concatenate([score[live], value[live]], axis=1)
        keep = np.argsort(-rank, axis=1, kind="stable")[:, :beam]
        front[live], score[live] = np.take_along_axis(every, keep, 1), np.take_along_axis(rank, keep, 1)
        open_ = (front[live] >= 0) & ~spent[live[:, None], front[live]]
        live, open_ = live[open_.any(axis=1)], open_[open_.any(axis=1)]
        if not len(live):
            break
        turn = np.argsort(~open_, axis=1, kind="stable")[:, :WIDTH]
        ready = np.take_along_axis(open_, turn, 1)
        by, at = np.repeat(live, turn.shape[1])[ready.ravel()], np.take_along_axis(front[live], turn, 1)[ready]
        spent[by, at] = True
        who, to = _unseen(seen, mark, *_neighbours(starts, near, by, at))
        while not len(who) and len(live):  # everything around was met before: go on with the rest of the beam
            open_ = (front[live] >= 0) & ~spent[live[:, None], front[live]]
            live, open_ = live[open_.any(axis=1)], open_[open_.any(axis=1)]
            by, at = np.repeat(live, beam)[open_.ravel()], front[live][open_]
            spent[by, at] = True
            who, to = _unseen(seen, mark, *_neighbours(starts, near, by, at))
    found = [np.concatenate([h[k] for h in hits] or [np.zeros(0, np.int64)]) for k in (0, 1)]
    by, at = found
    while len(by):  # widen over everything within the threshold
        go = ~spent[by, at] if passable is None else ~spent[by, at] & passable(by, at)
        by, at = by[go], at[go]
        spent[by, at] = True
        who, to = _unseen(seen, mark, *_neighbours(starts, near, by, at))
        ok = _dots(x, queries[who], to) >= least
        taken += len(who)
        by, at = who[ok], to[ok]
        found = [np.concatenate([found[0], by]), np.concatenate([found[1], at])]
    return found[0], found[1], taken


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _padded(column) -> np.ndarray:
    lists = [v or [] for v in column.to_pylist()]
    out = np.full((len(lists), max([1, *map(len, lists)])), -1, dtype=np.int64)
    filled = np.arange(out.shape[1]) < np.array([len(v) for v in lists], dtype=int)[:, None]
    out[filled] = np.array([s for v in lists for s in v], dtype=np.int64)
    return out, filled


FOUND = "node long, links long, root long"


def _told(node: np.ndarray, links: np.ndarray, trees: list) -> pa.Table:
    some = np.flatnonzero(links)
    root = _local_roots(len(node), np.concatenate([np.zeros(0, np.int64), *(a for a, _ in trees)]), np.concatenate([np.zeros(0, np.int64), *(b for _, b in trees)]))
    return pa.table({"node": pa.array(node[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(node[root[some]], pa.int64())})


def _tree(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = _local_roots(n, a, b)
    joined = np.flatnonzero(root != np.arange(n))
    return joined, root[joined]


def _matrix_tree(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of a matrix of links between two lists of nodes, which may share nodes."""
    left, right, most = rows.copy(), columns.copy(), np.iinfo(np.int64).max
    while True:
        low = np.minimum(left, np.where(linked, right, most).min(axis=1, initial=most))
        lower = np.minimum(right, np.where(linked, low[:, None], most).min(axis=0, initial=most))
        if (low == left).all() and (lower == right).all():
            return np.concatenate([rows, columns]), np.concatenate([left, right])
        left, right = low, lower


def _search(least: float):
    """Links of a region's nodes of one lane, by walks over the region's united graph."""

    def search(key, region):
        region = region.take(pa.array(np.argsort(region.column("node").to_numpy())))
        x, node, copies = _units(region.column("v")), region.column("node").to_numpy(), region.column("copies").to_numpy()
        n, lane = len(node), key[2].as_py()
        lists = region.column("near").combine_chunks()
        to = np.concatenate([np.zeros(0, np.int64), lists.flatten().to_numpy()]).astype(np.int64)
        sizes = np.array([0 if v is None else len(v) for v in lists], dtype=np.int64)
        near, starts = np.searchsorted(node, to), np.r_[0, np.cumsum(sizes)]
        medoids = np.flatnonzero(region.column("medoid").to_numpy(zero_copy_only=False))
        dense, filled = _padded(region.column("dense"))
        queries = np.flatnonzero(region.column("home").to_numpy(zero_copy_only=False) & (region.column("mine").to_numpy() == lane))
        links, trees = np.zeros(n, dtype=np.int64), []
        for s in range(0, len(queries), BATCH):
            asked = queries[s : s + BATCH]

            def share(by, at):
                """Whether two nodes meet in a dense shard, which counts their link."""
                out = np.zeros(len(by), dtype=bool)
                for p in range(dense.shape[1]):
                    for r in range(dense.shape[1]):
                        out |= (dense[asked[by], p] == dense[at, r]) & filled[asked[by], p] & filled[at, r]
                return out

            by, at, _ = _walk(x, starts, near, asked, medoids, least, passable=lambda by, at: ~share(by, at))
            counted = (asked[by] != at) & ~share(by, at)
            by, at = asked[by[counted]], at[counted]
            links += np.bincount(by, copies[at], minlength=n).astype(np.int64)
            trees.append(_tree(n, by, at))
        return _told(node, links, trees)

    return search


def _all_pairs(least: float):
    """Links of one cell of a dense shard, but for pairs that a smaller dense shard holds as well."""

    def pairs(key, cell):
        cell = cell.take(pa.array(np.argsort(cell.column("node").to_numpy())))
        x, node, copies, block = _units(cell.column("v")), cell.column("node").to_numpy(), cell.column("copies").to_numpy(), cell.column("block").to_numpy()
        shard, i, j = (key[k].as_py() for k in (1, 2, 3))
        n, (dense, filled) = len(node), _padded(cell.column("dense"))
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, trees = np.zeros(n, dtype=np.int64), []
        for s in range(0, len(first), 512):
            rows = first[s : s + 512]
            linked = x[rows] @ x[second].T >= least
            if i == j:
                linked &= rows[:, None] < second
            trees.append(_matrix_tree(linked, rows, second))
            for p in range(dense.shape[1]):
                for r in range(dense.shape[1]):
                    mine = dense[rows, p, None]
                    linked &= ~((mine == dense[second, r]) & (mine < shard) & filled[rows, p, None] & filled[second, r])
            links[rows] += np.where(linked, copies[second], 0).sum(axis=1)
            links[second] += np.where(linked, copies[rows, None], 0).sum(axis=0)
        return _told(node, links, trees)

    return pairs


def _found(nodes: DataFrame, overlap: int, least: float) -> tuple[DataFrame, int]:
    """(node, links, root) of each task: links that it counts and the component they give the node there; and the
    most centres of a split, beyond which more overlap changes nothing."""
    start = nodes.select("label", F.lit(0).cast("long").alias("region"), "node", "copies", "v", F.lit(True).alias("home"), F.lit(0).cast("long").alias("shard"))
    regions, k = _cut(start, REGION, overlap, least, homes=True)
    regions = regions.withColumn("region", F.col("shard"))
    walked = regions.filter("not whole").drop("whole")
    leaves, m = _cut(walked, LEAF, overlap, least, homes=False)
    sizes = leaves.groupBy("label", "shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocked = leaves.join(sizes, ["label", "shard"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    built = blocked.groupBy("label", "shard", "block").applyInArrow(_build(least), "label string, region long, shard long, node long, copies long, v binary, near array<long>, medoid boolean, dense boolean")
    built = materialize(built)
    crowded = built.filter("dense").select("label", "shard").distinct()
    members = built.join(crowded, ["label", "shard"], "left_semi").select("label", "shard", "node", "copies", "v")
    members = materialize(members.union(regions.filter("whole").select("label", "shard", "node", "copies", "v")))
    dense = members.groupBy("node").agg(F.array_sort(F.collect_set("shard")).alias("dense"))

    united = built.groupBy("label", "region", "node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))
    lanes = walked.groupBy("label", "region").agg(F.greatest(F.lit(1), F.ceil(F.count_if("home") / LANE)).cast("int").alias("lanes"))
    graph = walked.drop("shard").join(united, ["label", "region", "node"]).join(lanes, ["label", "region"]).join(dense, "node", "left")
    graph = graph.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(9)), F.col("lanes")).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    walks = graph.groupBy("label", "region", "lane").applyInArrow(_search(least), FOUND)

    return materialize(walks.union(_in_cells(members, dense, least))), max(k, m)


def _in_cells(members: DataFrame, dense: DataFrame, least: float) -> DataFrame:
    """Links of dense shards (label, shard, node, copies, v), all pairs of a shard in cells of two blocks."""
    blocks = members.groupBy("label", "shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, ["label", "shard"]).join(dense, "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.groupBy("label", "shard", "i", "j").applyInArrow(_all_pairs(least), FOUND)


def _every_pair(nodes: DataFrame, least: float) -> DataFrame:
    """All links, each label being one dense shard; for when walks miss too many."""
    members = nodes.select("label", F.lit(0).cast("long").alias("shard"), "node", "copies", "v")
    return materialize(_in_cells(members, nodes.select("node", F.array(F.lit(0).cast("long")).alias("dense")), least))


# --- auditing ----------------------------------------------------------------------------------------------------


def _true_links(least: float):
    """(node, truth): links of audited nodes with the vectors of one lane of their label."""

    def count(key, lane, asked):
        if not lane.num_rows or not asked.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "truth": pa.array([], pa.int64())})
        x, node, copies = _units(lane.column("v")), lane.column("node").to_numpy(), lane.column("copies").to_numpy()
        q, ids = _units(asked.column("v")), asked.column("node").to_numpy()
        width = min(q.shape[1], x.shape[1])
        hit = (q[:, :width] @ x[:, :width].T >= least) & (ids[:, None] != node)
        return pa.table({"node": pa.array(ids, pa.int64()), "truth": pa.array((hit * copies).sum(axis=1), pa.int64())})

    return count


def _audited(nodes: DataFrame, least: float) -> DataFrame:
    """(node, truth): about AUDIT_NODES nodes of each label and their links among all vectors of it."""
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.count() <= MANY_LABELS  # one row a label goes to every task, so that no label meets in one
    sized = nodes.join(F.broadcast(sizes) if few else sizes, "label")
    lanes = F.ceil(F.col("n") / LANE).cast("int")
    share = F.least(F.lit(1.0), F.lit(float(AUDIT_NODES)) / F.col("n"))
    some = sized.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000)
    laned = sized.select("label", F.pmod(F.xxhash64("node", F.lit(3)), lanes).cast("int").alias("lane"), "node", "copies", "v")
    asked = some.select(F.col("label").alias("label"), F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"), F.col("node").alias("node"), F.col("v").alias("v"))
    cells = laned.groupBy("label", "lane").cogroup(asked.groupBy("label", "lane"))
    return materialize(cells.applyInArrow(_true_links(least), "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth")))


def _recall(truth: DataFrame, found: DataFrame) -> float:
    """Share of the audited links that were found: of all of them or the mean of the nodes, whichever is less."""
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    both = truth.filter("truth > 0").join(links, "node", "left").withColumn("links", F.least(F.coalesce("links", F.lit(0)), "truth"))
    row = both.agg(F.sum("links") / F.sum("truth"), F.avg(F.col("links") / F.col("truth"))).first()
    return 1.0 if row[0] is None else min(row)


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_links), one row for each row of ``vectors``.

    Vectors are linked if their labels are equal and not null and their cosine is at least ``least``. A vector that is
    null, empty, zero or holds null or non-finite components, or has a null id or label, is linked with nothing. Equal
    vectors of a label are one node and all linked with each other; rows that share an id are rows of their own. Shorter
    vectors count as zero where longer ones go on. Other columns are left out; an empty table gives an empty one.

    Recall is that of the walks; no link is wrong. About AUDIT_NODES nodes of each label are compared with all of it:
    audited_links is their true number of links (null elsewhere), so that the sum of n_links over that of audited_links
    is the recall. Where it is below AIM, the overlap doubles, up to WIDEST; where it is too low even then,
    all pairs of each label are compared in cells, and the recall is 1. A split is fitted on about SAMPLE nodes; all are assigned
    and searched. A task holds REGION nodes with their lists, or two blocks of a dense shard.
    """
    rows = materialize(_marked_rows(vectors, id_col, vec_col, label_col))
    classes = materialize(rows.groupBy("label", "hi", "lo").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    # a class is told by its smallest row; an id that stands for several vectors of a label gives several nodes
    nodes = rows.join(classes, ["label", "hi", "lo"]).filter("vec_id = node").dropDuplicates(["label", "hi", "lo"])
    nodes = materialize(nodes.select(F.xxhash64("label", "hi", "lo").alias("node"), "label", "copies", "v"))
    truth, overlap = _audited(nodes, least), OVERLAP
    while True:
        found, most = _found(nodes, overlap, least)
        if _recall(truth, found) >= AIM:
            break
        if overlap >= min(WIDEST, max(1, most // 3)):  # a node is in a third of the centres at most
            found = _every_pair(nodes, least)
            break
        overlap *= 2

    comps = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.withColumnRenamed("node", "least_id").withColumn("node", F.xxhash64("label", "hi", "lo"))
    for more in (comps, links, truth):
        named = named.join(more, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = named.join(smallest, "component").select("label", "hi", "lo", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", (F.col("truth") + F.col("copies") - 1).alias("audited_links"))
    linked = rows.select("vec_id", "label", "hi", "lo").join(told, ["label", "hi", "lo"]).select("vec_id", "n_links", "component_id", "audited_links")
    alone = vectors.filter(~_can_link(id_col, vec_col, label_col)).select(F.col(id_col).cast("long").alias("vec_id"))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("long").alias("audited_links"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return linked.union(alone).select("vec_id", "n_links", "component_id", kept.alias("kept"), "audited_links")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), named AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT n.vec_id, (SELECT count(*) FROM links l WHERE l.a = n.vec_id) AS n_links, component_id, n.vec_id = component_id AS kept,
  CASE WHEN n.vec_id IN (SELECT vec_id FROM v) THEN (SELECT count(*) FROM links l WHERE l.a = n.vec_id) END AS audited_links FROM named n
"""  # where a label has no more than AUDIT_NODES rows, all of them are audited
