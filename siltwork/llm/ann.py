"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search.

The tree is grown level by level: the vectors of a node are split by k-means (Lloyd's iterations over all vectors, summed
in the partitions) into up to ``BRANCH`` children, until leaves hold about ``LEAF`` vectors. A query goes down the tree by
a priority queue of nodes, nearest centroid first, and visits leaves in the order in which they leave the queue.

How many leaves are visited is calibrated: for a sample of queries the exact neighbours are found among all vectors, and
the visits are doubled, then refined, until the sample's recall reaches the target. Visits are shuffled to the leaves'
parents, where queries and members meet in matrix products.

Of equal vectors only the k + 1 with the least ids can be among anyone's k nearest, so no more are held as members, and
equal queries are asked once. A parent with many members, or many visits, is met in several parts: each member is in one
part for each share of the visits. What is broadcast is the tree, of at most ``TREE_BYTES``: with more vectors than fill so
many leaves, leaves are larger, which changes the cost, not what is found.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BRANCH, LEAF, TREE_BYTES, ITERATIONS = 16, 256, 64 << 20, 4
K, RECALL, CALIBRATION, PART = 10, 0.95, 256, 20_000


class Tree:
    """Centroids by level; node n of a level has the children n*branch .. n*branch+branch-1 in the next; NaN: no node."""

    def __init__(self, dim: int, branch: int):
        self.branch, self.levels = branch, [np.zeros((1, dim), np.float32)]

    def assign(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each vector ``levels`` below the root, nearest centroid by nearest centroid."""
        at = np.zeros(len(x), np.int64)
        for c in self.levels[1 : None if levels is None else levels + 1]:
            kids = at[:, None] * self.branch + np.arange(self.branch)
            for lo in range(0, len(x), 4096):
                k = kids[lo : lo + 4096]
                d = ((c[k] - x[lo : lo + 4096, None, :]) ** 2).sum(axis=2)
                at[lo : lo + 4096] = k[np.arange(len(k)), np.argmin(np.where(np.isnan(d), np.inf, d), axis=1)]
        return at

    def visits(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves of a best-bin-first search."""
        out: list[int] = []
        queue = [(0.0, 0, 0)]
        last = len(self.levels) - 1
        while queue and len(out) < leaves:
            _, level, node = heapq.heappop(queue)
            if level == last:
                out.append(node)
                continue
            at = node * self.branch
            c = self.levels[level + 1][at : at + self.branch]
            diff = c - q
            for j, d in enumerate(np.einsum("ij,ij->i", diff, diff).tolist()):
                if d == d:
                    heapq.heappush(queue, (d, level + 1, at + j))
        return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dim)


def _lists(x: np.ndarray, kind=np.float32) -> pa.Array:
    n, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(np.ascontiguousarray(x, kind).ravel()))


def clean(embeddings: DataFrame, id_col: str, vector_col: str, dim: int = 0) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that can be compared, one for each id, and their dimension, the usual one if none is given (0: no row)."""
    vec = F.col(vector_col).cast("array<float>")
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))
    good = F.col("id").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = cut(rows.where(good), "vectors")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = cut(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors-once")
    if not dim:
        usual = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = usual["d"] if usual else 0
    return rows.where(F.size("vec") == dim), dim


def shape(n: int, dim: int, branch: int, leaf: int, tree_bytes: int) -> tuple[int, int]:
    """(depth, children of a node): as many leaves as hold ``leaf`` of n vectors each, within the tree's bytes."""
    leaves = max(2, min(math.ceil(n / leaf), tree_bytes // (8 * dim)))
    depth = max(1, math.ceil(math.log(leaves) / math.log(branch) - 1e-9))
    return depth, min(branch, max(2, math.ceil(leaves ** (1 / depth) - 1e-9)))


def grow(vectors: DataFrame, n: int, dim: int, branch: int = BRANCH, leaf: int = LEAF, iterations: int = ITERATIONS, tree_bytes: int = TREE_BYTES) -> Tree:
    """The tree over all of ``vectors``; each pass brings one row per node to the driver, in columns."""
    spark = vectors.sparkSession
    depth, branch = shape(n, dim, branch, leaf, tree_bytes)
    tree = Tree(dim, branch)
    for level in range(depth):
        shared = spark.sparkContext.broadcast(tree)

        def first(batches, shared=shared):
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy()
                node = shared.value.assign(_vectors(b.column(1), dim))
                h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64)
                order = np.lexsort((h, node))
                nth = np.arange(len(order)) - np.searchsorted(node[order], node[order])
                keep = order[nth < branch * 2]
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(h[keep]), b.column(1).take(pa.array(keep))], ["node", "h", "vec"])

        seeds = vectors.mapInArrow(first, "node bigint, h bigint, vec array<float>")
        nth = F.row_number().over(Window.partitionBy("node").orderBy("h"))
        c = np.full((branch ** (level + 1), dim), np.nan, np.float32)
        got = seeds.withColumn("n", nth).where(F.col("n") <= branch * 2).select("node", "n", "vec").toArrow().sort_by([("node", "ascending"), ("n", "ascending")]).combine_chunks()
        filled = np.zeros(branch**level, np.int64)
        for node, v in zip(got.column("node").to_pylist(), _vectors(pa.concat_arrays(got.column("vec").chunks), dim) if len(got) else ()):
            k, at = filled[node], node * branch
            if k < branch and not (c[at : at + k] == v).all(axis=1).any():
                c[at + k] = v
                filled[node] += 1
        tree.levels.append(c)
        for _ in range(iterations):
            shared = spark.sparkContext.broadcast(tree)

            def partial(batches, shared=shared):
                sums: dict[int, np.ndarray] = {}
                for b in batches:
                    if not b.num_rows:
                        continue
                    x = _vectors(b.column(1), dim)
                    at = shared.value.assign(x)
                    order = np.argsort(at, kind="stable")
                    nodes, begin = np.unique(at[order], return_index=True)
                    total = np.add.reduceat(np.hstack([x, np.ones((len(x), 1))])[order].astype(np.float64), begin)
                    for node, row in zip(nodes.tolist(), total):
                        sums[node] = sums[node] + row if node in sums else row
                if sums:
                    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), _lists(np.stack(list(sums.values())), np.float64)], ["node", "total"])

            def add(pdf: pd.DataFrame) -> pd.DataFrame:
                nodes, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
                t = np.zeros((len(nodes), dim + 1))
                np.add.at(t, at, np.stack(pdf["total"].to_numpy()))
                return pd.DataFrame({"node": nodes, "vec": (t[:, :-1] / t[:, -1:]).astype(np.float32).tolist()})

            new = c.copy()
            sums = vectors.mapInArrow(partial, "node bigint, total array<double>")
            means = sums.groupBy(F.floor(F.col("node") / 256)).applyInPandas(add, "node bigint, vec array<float>").toArrow().combine_chunks()
            if len(means):
                new[means.column("node").to_numpy()] = _vectors(pa.concat_arrays(means.column("vec").chunks), dim)
            tree.levels[-1] = c = new
    return tree


def _nearest(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row-wise places of the k least (distance, id)."""
    if dist.shape[1] > 4 * k:
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
        width = int((dist <= kth).sum(axis=1).max())
        some = np.argpartition(dist, min(width, dist.shape[1]) - 1, axis=1)[:, :width]
    else:
        some = np.broadcast_to(np.arange(dist.shape[1]), dist.shape)
    d = np.take_along_axis(dist, some, axis=1)
    order = np.lexsort((ids[some], d), axis=1)[:, :k]
    return np.take_along_axis(some, order, axis=1)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
    return np.maximum(d, 0)


def exact(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(q, id, d2, vec): the exact neighbours of a bounded set of queries, by a pass over all vectors."""
    dim = queries.shape[1]

    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, mine = _vectors(b.column(1), dim), b.column(0).to_numpy()
            d = _distances(queries.astype(np.float64), x.astype(np.float64))
            d[ids[:, None] == mine[None, :]] = np.inf
            best = _nearest(d, mine, min(k, len(mine)))
            rows, cols = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
            ok = np.isfinite(d[rows, cols])
            rows, cols = rows[ok], cols[ok]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(mine[cols]), pa.array(d[rows, cols]), b.column(1).take(pa.array(cols))], ["q", "id", "d2", "vec"])

    found = vectors.mapInArrow(scan, "q bigint, id bigint, d2 double, vec array<float>")
    nth = F.row_number().over(Window.partitionBy("q").orderBy("d2", "id"))
    return found.withColumn("n", nth).where(F.col("n") <= k).drop("n")


def calibrate(vectors: DataFrame, tree: Tree, dim: int, k: int, recall: float, sample: int) -> int:
    """The number of leaves to visit: doubled from 1 until the sample's recall reaches the target, then bisected."""
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    ids, queries = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float32).reshape(len(got), dim)
    leaves = int((~np.isnan(tree.levels[-1][:, 0])).sum())
    true = exact(vectors, ids, queries, k).select("q", "vec").collect()
    if not true:
        return leaves
    leaf, asked = tree.assign(np.array([r[1] for r in true], np.float32)), [r[0] for r in true]
    n = 1
    while True:
        order = {q: {x: i for i, x in enumerate(tree.visits(v, n))} for q, v in zip(ids.tolist(), queries)}
        rank = np.array([order[q].get(x, leaves) for q, x in zip(asked, leaf.tolist())])
        if n >= leaves or (rank < n).mean() >= recall:
            break
        n *= 2
    lo, hi = n // 2, min(n, leaves)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if (rank < mid).mean() >= recall else (mid, hi)
    return hi


def neighbours(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: DataFrame | None = None, k: int = K, recall: float = RECALL, branch: int = BRANCH, leaf: int = LEAF, calibration: int = CALIBRATION, tree_bytes: int = TREE_BYTES, part: int = PART) -> DataFrame:
    """``vec_id, neighbour_id, rank, distance``: about the ``k`` nearest others of every query, by Euclidean distance.

    ``queries`` has the columns of ``embeddings``; without it every vector is a query. A vector with the query's id isn't its
    neighbour. Equal distances are ordered by id. Equal vectors with different ids are neighbours at distance 0. Rows that
    repeat an id are one vector, the least. A vector that is null or empty, has null, NaN or infinite elements, or another
    dimension than most vectors, is neither query nor neighbour. Fewer than k others give fewer rows. Ids are integers, or
    are cast to such; null ids are left out. Empty in, empty out.
    """
    spark = embeddings.sparkSession
    vectors, dim = clean(embeddings, id_col, vector_col)
    out = "vec_id bigint, neighbour_id bigint, rank int, distance double"
    if not dim:
        return spark.createDataFrame([], out)
    asking = vectors if queries is None else clean(queries, id_col, vector_col, dim)[0]
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    members = cut(vectors.withColumn("n", nth).where(F.col("n") <= k + 1).drop("n"), "members")
    asked = cut(asking.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "asked")
    tree = grow(members, members.count(), dim, branch, leaf, tree_bytes=tree_bytes)
    visit = calibrate(members, tree, dim, k, recall, calibration)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        t = shared.value
        for b in batches:
            if b.num_rows:
                at = t.assign(_vectors(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([pa.array(at // t.branch), pa.array(at), b.column(0), b.column(1)], ["parent", "leaf", "id", "vec"])

    def ask(batches):
        t = shared.value
        for b in batches:
            parent, q, lists, take = [], [], [], []
            for i, (qid, v) in enumerate(zip(b.column(0).to_pylist(), _vectors(b.column(1), dim))):
                mine: dict[int, list[int]] = {}
                for x in t.visits(v, visit):
                    mine.setdefault(x // t.branch, []).append(x)
                for p, ls in mine.items():
                    parent.append(p)
                    q.append(qid)
                    lists.append(ls)
                    take.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(parent, pa.int64()), pa.array(q, pa.int64()), pa.array(lists, pa.list_(pa.int64())), b.column(1).take(pa.array(take, pa.int64()))], ["parent", "q", "leaves", "vec"])

    held = cut(members.mapInArrow(place, "parent bigint, leaf bigint, id bigint, vec array<float>"), "held")
    visits = cut(asked.mapInArrow(ask, "parent bigint, q bigint, leaves array<bigint>, vec array<float>"), "visits")
    # One row for each parent, of which the tree has few: into how many parts its members and its visits go.
    shares = lambda df, name: df.groupBy("parent").agg(F.ceil(F.count("*") / part).alias(name))
    parts = F.broadcast(shares(held, "m").join(shares(visits, "v"), "parent"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    here = held.join(parts, "parent").select("parent", F.pmod(F.xxhash64("id"), "m").alias("mp"), every("v").alias("vp"), "leaf", "id", "vec")
    there = visits.join(parts, "parent").select("parent", every("m").alias("mp"), F.pmod(F.xxhash64("q"), "v").alias("vp"), "q", "leaves", "vec")
    near = there.groupBy("parent", "mp", "vp").cogroup(here.groupBy("parent", "mp", "vp")).applyInPandas(_meet(k + 1), "q bigint, id bigint, d2 double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy("d2", "id"))
    best = cut(near.withColumn("n", nth).where(F.col("n") <= k + 1).select("q", "id", "d2"), "nearest")
    # The answer to a vector is that of every query that is equal to it, less the query itself.
    same = asking.join(asked.select(F.col("id").alias("q"), "vec"), "vec").select(F.col("id").alias("vec_id"), "q")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d2", "id"))
    found = same.join(best, "q").where("id <> vec_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("vec_id", F.col("id").alias("neighbour_id"), F.col("rank").cast("int").alias("rank"), F.round(F.sqrt("d2"), 6).alias("distance"))


def _meet(k: int):
    """The k nearest members of the leaves that each query visits, in one part of one parent."""

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(held):
            x, ids = np.stack(held["vec"].to_numpy()).astype(np.float64), held["id"].to_numpy()
            y, q = np.stack(asked["vec"].to_numpy()).astype(np.float64), asked["q"].to_numpy()
            leaf_of = held["leaf"].to_numpy()
            wants = np.concatenate([np.asarray(v, np.int64) for v in asked["leaves"]])
            who = np.repeat(np.arange(len(q)), asked["leaves"].map(len).to_numpy())
            for one in np.unique(wants):
                m = np.flatnonzero(leaf_of == one)
                if not len(m):
                    continue
                asking = who[wants == one]
                step = max(1, (1 << 22) // len(m))
                for lo in range(0, len(asking), step):
                    a = asking[lo : lo + step]
                    d = _distances(y[a], x[m]).round(10)  # so that equal vectors tie, in whatever order they are multiplied
                    best = _nearest(d, ids[m], min(k, len(m)))
                    r = np.repeat(np.arange(len(a)), best.shape[1])
                    found.append(pd.DataFrame({"q": q[a][r], "id": ids[m][best.ravel()], "d2": d[r, best.ravel()]}))
        if not found:
            return pd.DataFrame({"q": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "d2": pd.Series([], dtype="float64")})
        got = pd.concat(found).sort_values(["q", "d2", "id"])
        return got[got.groupby("q").cumcount() < k]

    return meet
