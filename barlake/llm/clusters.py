"""Lloyd's algorithm with two trees: a cover tree over each block of vectors, another over the centroids of a round.

Vectors are cut into blocks of at most ``BLOCK`` rows. Each block's tree is grown once and written to the shared folder with
its integer vectors, a row a block. A round walks both trees together, from the roots down: a pair of a vector node and a
centroid node is dropped when no centroid below can be nearest to any vector below, by the distance of the two centres, both
radii, and the least distance known for the vector node. What is left at the leaves is compared exactly, in integers.
Every task adds up its own vectors by cluster; the ``k`` sums reach the driver, which makes the next centroids of them.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out. Vectors
that repeat count each. A null id is kept in the result but starts no centroid; starts with equal hashes (ids that repeat)
are taken in the order of their components. With fewer than ``k`` vectors there are fewer centroids. Scaled components
beyond 2 ** 27 either way count as that, so that distances stay exact 64-bit integers; sums beyond 64 bits are the largest
64-bit integer. An empty table gives an empty table; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

BLOCK, LEAF, MOST = 1024, 16, 1 << 27
#: Pairs of a vector and a centroid compared at once; only memory depends on it.
AT_ONCE = 1 << 15
#: Bounds are floats: they are widened by this share before a pair is dropped.
SLACK = 1e-9
_TREE = ("centre", "child_from", "child_to", "from", "to")


@dataclass
class Tree:
    """Nodes in breadth-first order: centre (a point), radius, its children (a range of nodes, none for a leaf) and its
    points (a range of ``order``)."""

    order: np.ndarray
    radius: np.ndarray
    nodes: dict[str, np.ndarray]

    def below(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``at``, node) of the children of ``at``; leaves stand for themselves."""
        first, n = self.nodes["child_from"][at], self.nodes["child_to"][at] - self.nodes["child_from"][at]
        first, n = np.where(n == 0, at, first), np.maximum(n, 1)
        return spread(first, n)

    def leaf(self, at: np.ndarray) -> np.ndarray:
        return self.nodes["child_from"][at] == self.nodes["child_to"][at]


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, first[i] + j) for every j below n[i]."""
    i = np.repeat(np.arange(len(n)), n)
    return i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a.astype(np.float64) - b
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree: the children of a node are centres apart by more than half its radius, its own centre the first, each
    with what lies within half the radius and within none before. A node of few points, or one that half of its
    points would not cover so, is a leaf."""
    order = np.arange(len(points))
    spans, centre, radius, child_from, child_to = [(0, len(points))], [0], [], [], []
    at = 0
    while at < len(spans):
        lo, hi = spans[at]
        own = order[lo:hi]
        far = distance(points[own], points[centre[at]]) if len(own) else np.zeros(1)
        radius.append(float(far.max()))
        child_from.append(len(spans))
        if hi - lo > leaf and radius[-1] > 0:
            groups, rest, c, near = [], own, centre[at], far <= radius[-1] / 2
            while len(groups) <= len(own) // 2:
                groups.append((c, rest[near]))
                rest = rest[~near]
                if not len(rest):
                    break
                c = int(rest[0])
                near = distance(points[rest], points[c]) <= radius[-1] / 2
            if not len(rest):
                order[lo:hi] = np.concatenate([g for _, g in groups])
                for c, g in groups:
                    spans.append((lo, lo + len(g)))
                    centre.append(c)
                    lo += len(g)
        child_to.append(len(spans))
        at += 1
    ends = np.array(spans, np.int64).reshape(-1, 2)
    made = dict(zip(_TREE, (np.array(centre, np.int64), np.array(child_from, np.int64), np.array(child_to, np.int64), ends[:, 0], ends[:, 1]), strict=True))
    return Tree(order, np.array(radius), made)


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, top: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the least of equally near ones; squared distance) of each point."""
    q = r = np.zeros(1, np.int64)
    bound = np.full(len(tree.radius), np.inf)
    while True:
        apart = distance(points[tree.nodes["centre"][q]], centroids[top.nodes["centre"][r]])
        np.minimum.at(bound, q, apart + tree.radius[q])
        keep = apart - tree.radius[q] - top.radius[r] <= bound[q] * (1 + SLACK) + SLACK
        q, r = q[keep], r[keep]
        if tree.leaf(q).all() and top.leaf(r).all():
            break
        i, child = tree.below(q)
        np.minimum.at(bound, child, bound[q[i]])
        j, r = top.below(r[i])
        q = child[j]
    best = np.full((len(points), len(centroids)), np.iinfo(np.int64).max)
    size = (tree.nodes["to"] - tree.nodes["from"])[q] * (top.nodes["to"] - top.nodes["from"])[r]
    for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE)) + 1):
        i, place = spread(tree.nodes["from"][q[part]], (tree.nodes["to"] - tree.nodes["from"])[q[part]])
        node = r[part][i]
        j, other = spread(top.nodes["from"][node], (top.nodes["to"] - top.nodes["from"])[node])
        p, c = tree.order[place[j]], top.order[other]
        apart = points[p] - centroids[c]
        best[p, c] = np.einsum("ij,ij->i", apart, apart)
    found = best.argmin(axis=1)
    return found, best[np.arange(len(points)), found]


BLOCKS = "ids array<long>, points binary, radius array<double>, places array<long>, " + ", ".join(f"`{k}` array<long>" for k in _TREE)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            ids, vectors = b.column(0).slice(lo, BLOCK), b.column(1).slice(lo, BLOCK)
            points = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            tree = grow(points)
            row = [ids.to_pylist(), points.astype("<i4").tobytes(), tree.radius, tree.order, *tree.nodes.values()]
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), *[pa.list_(pa.int64())] * (1 + len(_TREE))]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["ids", "points", "radius", "places", *_TREE])


def _of_block(row: dict) -> tuple[list, np.ndarray, Tree]:
    whole = np.frombuffer(row["points"], "<i4").astype(np.int64).reshape(len(row["ids"]), -1)
    return row["ids"], whole, Tree(np.array(row["places"]), np.array(row["radius"]), {k: np.array(row[k]) for k in _TREE})


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count and sums of the vectors of each cluster, one row a cluster and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, count, sums = grow(centroids, 1), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for row in b.to_pylist():
                _, points, tree = _of_block(row)
                found, _ = nearest(points, tree, centroids, top)
                count += np.bincount(found, minlength=len(centroids))
                np.add.at(sums, found, points)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = grow(centroids, 1)
        for b in batches:
            for row in b.to_pylist():
                ids, points, tree = _of_block(row)
                found, apart = nearest(points, tree, centroids, top)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found.astype(np.int32)), pa.array(apart)], ["vec_id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors kept, in integers floor(scale * x)."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v.cast("double") * scale))))
    return vectors.where((F.size(x) == dim) & ~odd).select(F.col(id_col).cast("long").alias("vec_id"), whole.cast("array<long>").alias("v"))




def lloyd(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector kept."""
    spark = vectors.sparkSession
    frames.small_batches(spark, BLOCK)
    scratch = frames.Scratch(spark, "clusters")
    kept = whole_vectors(vectors, id_col, vector_col, dim, scale)
    start = kept.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v").orderBy("hash", "v").limit(k).collect()
    result = "vec_id long, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], result + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in start], np.int64)
    blocks = scratch.write(kept.mapInArrow(_blocks, BLOCKS))
    for _ in range(rounds):
        each = blocks.mapInArrow(_sums(centroids), "cluster long, n long, sums array<long>")
        split = each.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in split.collect():  # at most k * dim rows
            centroids[r.cluster, r["at"]] = int(r.x) // r.n
    found = scratch.write(blocks.mapInArrow(_assigned(centroids), result))
    scratch.free(blocks)
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    told = [(c, min(d, 2**63 - 1), min(sum(sums.values()), 2**63 - 1), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    totals = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
