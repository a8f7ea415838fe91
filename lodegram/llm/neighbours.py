"""Approximate nearest neighbours: a forest of random-projection trees, searched best first."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegram.llm.common import FILE, ROW, mapped, new_path, saved, with_row_key

K, TREES, LEAF, SEED = 10, 8, 256, 17
#: Bytes of the vectors that the forest is fitted to, at most (those of the rows with the least hashes), and of those that a
#: task compares with the queries at once; queries that it compares them with at once.
SAMPLE, HELD, ASKING = 32 << 20, 16 << 20, 4096
#: Vectors of the sample that each query is compared with first, so that it knows what it need not keep.
FIRST = 1024
#: The number of leaves to search is the least that finds this share of the true neighbours of the
#: queries that it is set on: those with the least hashes, of a bounded number.
TARGET, CALIBRATION = 0.94, 256
BLOCK = 4096

_VECTOR = f"{FILE} long, {ROW} long, e binary"
_FOUND = "f long, r long, nf long, nr long, sim double"


def directions(depth: int, size: int) -> np.ndarray:
    """(TREES, depth, size): all nodes of a tree's level are split along one direction."""
    r = np.random.RandomState(SEED).standard_normal((TREES, max(depth, 1), size))
    return (r / np.linalg.norm(r, axis=2, keepdims=True)).astype(np.float32)[:, :depth]


class Forest:
    """The nodes' thresholds by tree and level, each the median of the node's vectors in x."""

    def __init__(self, x: np.ndarray, depth: int) -> None:
        self.depth, self.way = depth, directions(depth, x.shape[1])
        self.cut = [np.zeros((TREES, 1 << level), np.float32) for level in range(depth)]
        for t in range(TREES):
            p, node = x @ self.way[t].T, np.zeros(len(x), np.int64)
            for level in range(depth):
                order = np.lexsort((p[:, level], node))
                ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
                some = np.flatnonzero(np.diff(ends))
                self.cut[level][t, some] = p[order[(ends[some] + ends[some + 1] - 1) // 2], level]
                node = 2 * node + (p[:, level] > self.cut[level][t, node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(vectors, TREES): the leaf of each."""
        out = np.zeros((len(x), TREES), np.int64)
        for t in range(TREES):
            p = x @ self.way[t].T
            for level in range(self.depth):
                out[:, t] = 2 * out[:, t] + (p[:, level] > self.cut[level][t, out[:, t]])
        return out

    def search(self, p: list[list[float]]):
        """Leaves (tree, leaf) of a query with the projections p, nearest first: one queue holds the unvisited
        branches of all trees by the sum of the squared margins on the way to them."""
        queue = [(0.0, t, 0, 0) for t in range(TREES)]
        while queue:
            far, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = p[t][level] - float(self.cut[level][t, node])
                right = margin > 0
                heapq.heappush(queue, (far + margin * margin, t, level + 1, 2 * node + (not right)))
                level, node = level + 1, 2 * node + right
            yield t, node

    def projections(self, x: np.ndarray) -> list[list[list[float]]]:
        return np.stack([x @ self.way[t].T for t in range(TREES)], 1).tolist()


def unit(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("e").to_pylist()), np.float32).reshape(batch.num_rows, -1)


def _unit_rows(size: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("embedding").cast(pa.list_(pa.float64()))
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max(1, keepdims=True)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            good = np.flatnonzero(np.isfinite(x).all(1))
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (FILE, ROW, "asks")), pa.array([r.tobytes() for r in x[good]], pa.binary())], [FILE, ROW, "asks", "e"])

    return run


def _read(path: str, columns: list[str], rows: int):
    """Batches of a table in the shared folder."""
    fs, base = pafs.FileSystem.from_uri(path)
    if any(x.extension == "parquet" for x in fs.get_file_info(pafs.FileSelector(base))):
        yield from pads.dataset(base, filesystem=fs, format="parquet").to_batches(columns=columns, batch_size=rows)


def sampled(path: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of the sample, in the order of their hashes."""
    got = [b for b in _read(path, [FILE, ROW, "e", "hash"], 1 << 16) if b.num_rows]
    if not got:
        return np.empty((0, 2), np.int64), np.empty((0, size), np.float32)
    t = pa.Table.from_batches(got).sort_by([("hash", "ascending"), (FILE, "ascending"), (ROW, "ascending")])
    return np.stack([t.column(FILE).to_numpy(), t.column(ROW).to_numpy()], 1), unit(t)


def merged_top(own: np.ndarray, sims: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest sims of each owner: (own, sims, at), by owner, then sim, then at."""
    order = np.lexsort((at, -sims, own))
    own = own[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    order = order[rank < k]
    return own[rank < k], sims[order], at[order]


def block_top(q: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of q its k nearest of m, by blocks: owner, similarity, position."""
    found = (np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64))
    for a in range(0, len(m), BLOCK):
        s = q @ m[a : a + BLOCK].T
        n = min(k, s.shape[1])
        best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(q), 1))
        own = np.repeat(np.arange(len(q)), n)
        new = (own, np.take_along_axis(s, best, 1).ravel(), best.ravel() + a)
        found = merged_top(*(np.concatenate(x) for x in zip(found, new)), k) if a else new
    return found


def _exact(q: np.ndarray, m: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    part = [np.einsum("ij,ij->i", q[own[a : a + BLOCK]].astype(np.float64), m[at[a : a + BLOCK]].astype(np.float64)) for a in range(0, len(own), BLOCK)]
    return np.round(np.concatenate(part or [np.empty(0)]), 6)


def _truth(queries: np.ndarray, k: int):
    """Nearest of a task's vectors for the calibration's queries."""

    def run(batches):
        best: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch)
            own, _, at = block_top(queries, x, k + 1)
            new = [own, _exact(queries, x, own, at), batch.column(FILE).to_numpy()[at], batch.column(ROW).to_numpy()[at], x[at]]
            best = [np.concatenate(c) for c in zip(best, new)] if best else new
            order = np.lexsort((best[3], best[2], -best[1], best[0]))
            best = [c[order] for c in best]
            rank = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            best = [c[rank <= k] for c in best]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), *map(pa.array, best[1:4]), pa.array([r.tobytes() for r in best[4]], pa.binary())], ["q", "sim", FILE, ROW, "e"])

    return run


def calibrated(vectors: DataFrame, forest: Forest, size: int, k: int) -> int:
    """How many leaves a query searches, so that TARGET of the true neighbours are found for the
    CALIBRATION rows that it is set on; these are compared with all vectors."""
    sample = vectors.where("asks").orderBy(F.xxhash64(FILE, ROW), FILE, ROW).limit(CALIBRATION).collect()
    q = np.frombuffer(b"".join(r.e for r in sample), np.float32).reshape(len(sample), size)
    own = F.struct((-F.col("sim")).alias("s"), FILE, ROW, "e")
    near = vectors.drop("asks").transform(mapped, _truth(q, k), f"q int, sim double, {_VECTOR}").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(own)), 1, k + 1).alias("near")).collect()
    ways, ranks = forest.projections(q), []
    for r in near:
        me = (sample[r.q][FILE], sample[r.q][ROW])
        true = [x.e for x in r.near if (x[FILE], x[ROW]) != me][:k]
        if not true:
            continue
        home: dict[tuple[int, int], list[int]] = {}
        for i, row in enumerate(forest.leaves(np.frombuffer(b"".join(true), np.float32).reshape(len(true), size)).tolist()):
            for t, leaf in enumerate(row):
                home.setdefault((t, leaf), []).append(i)
        missing = set(range(len(true)))
        for n, leaf in enumerate(forest.search(ways[r.q]), 1):
            hit = missing.intersection(home.get(leaf, ()))
            ranks += [n] * len(hit)
            missing -= hit
            if not missing:
                break
    return sorted(ranks)[math.ceil(TARGET * len(ranks)) - 1] if ranks else TREES


def _best(own: np.ndarray, at: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each owner, each once: (own, at, sim), by owner, then sim, then at."""
    order = np.lexsort((at, -sim, own))
    own, at, sim = own[order], at[order], sim[order]
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1])
    own, at, sim = own[keep], at[keep], sim[keep]
    keep = np.arange(len(own)) - np.searchsorted(own, own) < k
    return own[keep], at[keep], sim[keep]


def _asked(forest: Forest, sample: str, size: int, visits: int, k: int):
    """For each query the leaves that it searches, as bits, and its nearest of FIRST vectors of the sample: what is
    farther than the last of these needn't be kept."""

    def run(batches):
        keys, first = (x[:FIRST] for x in sampled(sample, size))
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, first = keys[order], first[order]
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                q, mine = unit(batch), np.stack([batch.column(FILE).to_numpy(), batch.column(ROW).to_numpy()], 1)
                bits = np.zeros((len(q), TREES << forest.depth), bool)
                for i, p in enumerate(forest.projections(q)):
                    for n, (t, leaf) in enumerate(forest.search(p), 1):
                        bits[i, (t << forest.depth) + leaf] = True
                        if n == visits:
                            break
                own, _, at = block_top(q, first, k + 1)
                other = (mine[own] != keys[at]).any(1)
                own, at = own[other], at[other]
                own, at, sim = _best(own, at, _exact(q, first, own, at), k)
                ends = np.searchsorted(own, np.arange(len(q) + 1))
                floor = np.full(len(q), -2.0)
                full = np.flatnonzero(np.diff(ends) == k)
                floor[full] = sim[ends[full + 1] - 1]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c)) for c in (keys[at, 0], keys[at, 1], sim)]
                leaves = pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (FILE, ROW, "e")), leaves, pa.array(floor), *lists], [FILE, ROW, "e", "leaves", "floor", "nf", "nr", "sim"])

    return run


def _compared(forest: Forest, asked: str, size: int, k: int):
    """Each query's best k of a task's vectors that are in leaves which it searches. The queries are read from the
    shared folder, so that no vector is shuffled."""

    def near(x: np.ndarray, homes: list, keys: np.ndarray, batch: pa.RecordBatch):
        q, mine = unit(batch), np.stack([batch.column(FILE).to_numpy(), batch.column(ROW).to_numpy()], 1)
        floor = batch.column("floor").to_numpy()
        packed = np.frombuffer(b"".join(batch.column("leaves").to_pylist()), np.uint8).reshape(len(q), -1)
        asks = np.ascontiguousarray(np.unpackbits(packed, axis=1)[:, : TREES << forest.depth].T).view(bool)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

        def merged(best, wait, floor):
            own, at = (np.concatenate(c) for c in zip(*wait))
            other = (mine[own] != keys[at]).any(1)
            own, at = own[other], at[other]
            best = _best(*(np.concatenate(c) for c in zip(best, (own, at, _exact(q, x, own, at)))), k)
            last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
            floor = floor.copy()
            floor[best[0][last]] = np.maximum(floor[best[0][last]], best[2][last])
            return best, floor

        for t, (order, some, ends) in enumerate(homes):
            wait, waiting = [], 0
            for leaf, lo, hi in zip(some.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                who = np.flatnonzero(asks[(t << forest.depth) + leaf])
                for a in range(0, len(who), 1024):
                    own = who[a : a + 1024]
                    for b in range(lo, hi, 1024):
                        have = order[b : min(b + 1024, hi)]
                        # products in 32 bits may be lower than the rounded similarity
                        i, j = np.nonzero(q[own] @ x[have].T >= (floor[own] - 2e-6).astype(np.float32)[:, None])
                        wait.append((own[i], have[j]))
                        waiting += len(i)
                        if waiting > 200_000:
                            best, floor = merged(best, wait, floor)
                            wait, waiting = [], 0
            if waiting:
                best, floor = merged(best, wait, floor)
        own, at, sim = best
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*mine[own].T, *keys[at].T, sim)], ["f", "r", "nf", "nr", "sim"])

    def block(wait: list[pa.RecordBatch]):
        t = pa.Table.from_batches(wait).sort_by([(FILE, "ascending"), (ROW, "ascending")])
        x, keys = unit(t), np.stack([t.column(FILE).to_numpy(), t.column(ROW).to_numpy()], 1)
        leaf, homes = forest.leaves(x), []
        for i in range(TREES):
            order = np.argsort(leaf[:, i], kind="stable")
            some, first = np.unique(leaf[order, i], return_index=True)
            homes.append((order, some, np.append(first, len(x))))
        for batch in _read(asked, [FILE, ROW, "e", "leaves", "floor"], ASKING):
            if batch.num_rows:
                yield near(x, homes, keys, batch)

    def run(batches):
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                wait.append(batch)
            if sum(x.num_rows for x in wait) * 4 * size >= HELD:
                yield from block(wait)
                wait = []
        if wait:
            yield from block(wait)

    return run


def nearest(spark: SparkSession, table: DataFrame, k: int = K, every: int = 1) -> DataFrame:
    """vec_id, neighbor_id, rank (from 1), similarity (cosine, 6 decimals): up to k rows for each query of the table.

    Queries are the rows whose vec_id is divisible by every, against all rows; with 1 all rows, of null ids too. TREES
    trees are split along random directions at the median of a node's vectors in the sample (those with the least hashes,
    SAMPLE bytes at most, all of a small table), to leaves of about LEAF vectors of it; all vectors are in the leaves. A query
    searches the leaves in the order of a queue that all trees
    share, as many as calibrated() says, and the members of those leaves are compared exactly. Ties
    go by file and row. A row is no neighbour of its own, but equal and repeated rows are of each other. Null,
    empty, zero or not finite embeddings, ones with null or infinite entries, and ones of another length
    than the most common (the shorter if two are as common) are left out; so is a row alone. A null vec_id stays null. Other
    columns aren't read; an empty table gives no row.
    """
    rows = with_row_key(table, ["vec_id", "embedding"]).where("embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)")
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = sizes["n"] if sizes else 1
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False)) if every != 1 else F.lit(True)
    kept = rows.where(F.size("embedding") == size).select(FILE, ROW, asks.alias("asks"), "embedding")
    vectors = saved(kept.transform(mapped, _unit_rows(size), f"{FILE} long, {ROW} long, asks boolean, e binary"), "vectors")
    share = math.ceil((1 << 20) * min(1.0, SAMPLE / (4 * size) / max(1, vectors.count())))
    few, asked = new_path(spark, "sample"), new_path(spark, "asked")
    hashed = vectors.select(FILE, ROW, "e", F.shiftrightunsigned(F.xxhash64(FILE, ROW), 1).alias("hash"))
    saved(hashed.where(F.shiftright("hash", 43) < share), "sample", few)
    x = sampled(few, size)[1]
    depth = max(0, math.ceil(math.log2(max(1, len(x)) / LEAF)))
    forest = Forest(x, depth)
    visits = calibrated(vectors, forest, size, k) if depth else TREES
    queries = vectors.where("asks").drop("asks").repartition(spark.sparkContext.defaultParallelism)
    lists = "nf array<long>, nr array<long>, sim array<double>"
    first = saved(queries.transform(mapped, _asked(forest, few, size, visits, k), f"{_VECTOR}, leaves binary, floor double, {lists}"), "asked", asked)
    first = first.select(F.col(FILE).alias("f"), F.col(ROW).alias("r"), F.explode(F.arrays_zip("nf", "nr", "sim")).alias("x")).select("f", "r", "x.nf", "x.nr", "x.sim")
    found = saved(vectors.drop("asks").transform(mapped, _compared(forest, asked, size, k), _FOUND), "near").unionByName(first)
    own = F.struct((-F.col("sim")).alias("s"), "nf", "nr")
    top = found.groupBy("f", "r").agg(F.slice(F.array_sort(F.collect_set(own)), 1, k).alias("top"))
    flat = top.select("f", "r", F.posexplode("top").alias("i", "x")).select("f", "r", (F.col("i") + 1).alias("rank"), (-F.col("x.s")).alias("similarity"), F.col("x.nf").alias("nf"), F.col("x.nr").alias("nr"))
    return _named(flat, rows.select("vec_id", FILE, ROW))


def _named(flat: DataFrame, ids: DataFrame) -> DataFrame:
    own = ids.select("vec_id", F.col(FILE).alias("f"), F.col(ROW).alias("r"))
    other = ids.select(F.col("vec_id").alias("neighbor_id"), F.col(FILE).alias("nf"), F.col(ROW).alias("nr"))
    return flat.join(own, ["f", "r"]).join(other, ["nf", "nr"]).select("vec_id", "neighbor_id", "rank", "similarity")
