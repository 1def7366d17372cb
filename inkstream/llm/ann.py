"""Approximate nearest neighbours: a forest of random-projection trees, one shared queue, exact reranking.

``trees`` trees split the space on hyperplanes between two random vectors, at the median, down to leaves. They
are fitted on a bounded sample of the vectors (``fit_rows``, those with the smallest hashes of their ids);
every vector is indexed: it is routed to its leaf in each tree. A query walks all trees through one priority queue,
ordered by the squared distance by which a branch was missed (summed along the path), so the most promising
leaf of any tree comes next, until the leaves taken hold ``search_mass`` of all vectors (a vector in leaves of two
trees counts twice). The vectors in these leaves are ranked by their exact distances in double precision.

Scale: the trees are all that is broadcast, and bounded by the sample: ``fit_rows / least_leaf`` leaves each. Vectors
travel once for each tree, to bundles of neighbouring leaves; a bundle that holds more than ``shard_rows`` is dealt to
several tasks (expected sizes come from the sample, so a very common vector or a dense region spreads). Queries
travel, with the list of their leaves, only to the bundles that hold one of them, and are read there as a stream after the vectors: nothing
of queries or vectors reaches the driver, and each task holds ``shard_rows`` vectors and a block of queries. Work is
queries x ``search_mass`` x vectors: the stated query set against all rows. Equal vectors of a shard are one
point with its k + 1 smallest ids (no other can be among the k nearest), so a very common vector costs one distance.

Recall depends on the data: on vectors without structure (uniform on a sphere of 64 dimensions) the nearest are
hardly nearer than the rest, and leaves of most of the space have to be seen; ``search_mass`` is set for a recall of
over 0.9 there and can be far lower on data with clusters.

Edge cases: null ids, and vectors that are null, empty, zero or hold null or
non-finite components, take no part; vectors meet only those of equal length (a length that the sample
lacks is one leaf); rows that repeat an id are one candidate for a query (that nearest to it), and never meet a query
with that id; for queries of one id, the smallest vector counts; ties go to the
smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstream.llm.common import tidy

FOUND = "query_id long, vec_id long, score double"
ROUTED = "n int, tree int, bundle int, salt int, kind int, id long, v binary, leaves array<int>"
NAMES = ["n", "tree", "bundle", "salt", "kind", "id", "v", "leaves"]
QUERY_BLOCK = 128


class Tree:
    """One random-projection tree, as tables: ``child`` holds inner nodes, or -1 - leaf; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        normals: list[np.ndarray] = []
        cuts: list[float] = []
        child: list[list[int]] = []
        weights: list[int] = []
        root = [0]
        todo: list[tuple[np.ndarray, list, int]] = [(np.arange(len(sample)), root, 0)]
        while todo:  # left branches first
            own, parent, side = todo.pop()
            found = self._split(sample, own, rng) if len(own) > leaf else None
            if found is None:
                parent[side] = -1 - len(weights)
                weights.append(len(own))
                continue
            w, cut, low = found
            parent[side] = len(child)
            here = [0, 0]
            child.append(here)
            normals.append(w)
            cuts.append(cut)
            todo += [(own[~low], here, 1), (own[low], here, 0)]
        self.root = root[0]
        self.normals = np.array(normals).reshape(len(normals), sample.shape[1])
        self.cuts, self.child = np.array(cuts), np.array(child, np.int64).reshape(len(child), 2)
        self.weights = np.array(weights) / max(1, len(sample))

    @staticmethod
    def _split(sample: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
        for _ in range(4):  # two equal vectors give no direction
            a, b = sample[rng.choice(own, 2, replace=False)]
            size = np.linalg.norm(a - b)
            if not 0 < size < np.inf:
                continue
            w = (a - b) / size
            p = sample[own] @ w
            cut = float(np.median(p))
            low = p < cut
            if low.any() and not low.all():
                return w, cut, low
        return None

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), self.root)
        while True:
            live = np.flatnonzero(at >= 0)
            if not len(live):
                return -1 - at
            node = at[live]
            right = np.einsum("ij,ij->i", vectors[live], self.normals[node]) >= self.cuts[node]
            at[live] = self.child[node, right.astype(np.int64)]


class Router:
    """The trees for vectors of one length, and how their leaves are dealt."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf_rows: int, least_leaf: int, bundle_rows: int, shard_rows: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        leaf = max(least_leaf, int(leaf_rows * len(sample) / max(1, rows)))
        self.trees = [Tree(sample, leaf, rng) for _ in range(trees)]
        self.bundle: list[np.ndarray] = []  # of each leaf
        self.salts: list[np.ndarray] = []  # of each bundle
        for t in self.trees:
            before = np.cumsum(t.weights) - t.weights
            _, bundle = np.unique((before * rows / bundle_rows).astype(np.int64), return_inverse=True)
            self.bundle.append(bundle)
            self.salts.append(np.maximum(1, np.ceil(np.bincount(bundle, t.weights) * rows / shard_rows)).astype(np.int64))

    def visits(self, query: np.ndarray, mass: float) -> list[list[int]]:
        """By tree, the leaves that the shared queue yields until they hold ``mass`` of all vectors; the first leaf is always taken."""
        with np.errstate(over="ignore", invalid="ignore"):
            missed = [((t.normals @ query - t.cuts)).tolist() for t in self.trees]
        child = [t.child.tolist() for t in self.trees]
        weights = [t.weights.tolist() for t in self.trees]
        queue = [(0.0, k, k, t.root) for k, t in enumerate(self.trees)]
        serial, left = len(queue), mass
        out: list[list[int]] = [[] for _ in self.trees]
        push, pop = heapq.heappush, heapq.heappop
        while queue and left > 0:
            cost, _, t, node = pop(queue)
            margins, kids = missed[t], child[t]
            while node >= 0:
                d = margins[node]
                serial += 1
                push(queue, (cost + d * d, serial, t, kids[node][d < 0]))
                node = kids[node][d >= 0]
            out[t].append(-1 - node)
            left -= weights[t][-1 - node]
        return out


def distinct_points(ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct vectors, their leaf, and the ``keep`` smallest ids of each; equal vectors have one leaf."""
    vectors = vectors + 0.0  # -0.0 equals 0.0
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors, leaves = ids[order], vectors[order], leaves[order]
    starts = np.flatnonzero(np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1))))
    ends = np.append(starts[1:], len(ids))
    return vectors[starts], leaves[starts], [np.unique(ids[a:z])[:keep] for a, z in zip(starts, ends, strict=True)]


class Shard:
    """Vectors of one bundle, ready to be ranked."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray, k: int) -> None:
        self.points, self.leaf, self.owners = distinct_points(ids, vectors, leaves, k + 1)
        self.k, self.norms = k, (self.points * self.points).sum(1)

    def nearest(self, q_ids: list[int], queries: np.ndarray, leaves: list[list[int]]) -> tuple[list, list, list]:
        """The k best of each query among the vectors in its leaves: query ids, vector ids, distances."""
        out: tuple[list, list, list] = ([], [], [])
        rough = self.norms[None, :] + (queries * queries).sum(1)[:, None] - 2.0 * (queries @ self.points.T)
        slack = 1e-9 * (self.norms.max() + (queries * queries).sum(1))  # over the error of the product
        for i, q_id in enumerate(q_ids):
            at = np.flatnonzero(np.isin(self.leaf, leaves[i]))
            near = rough[i, at]
            if len(at) > self.k + 1:  # all that can be among the k nearest besides the query itself
                at = at[near <= np.partition(near, self.k)[self.k] + slack[i]]
            d = self.points[at] - queries[i]
            dist = np.sqrt((d * d).sum(1))
            best: dict[int, float] = {}
            for score, v in sorted((float(s), int(v)) for s, j in zip(dist, at, strict=True) for v in self.owners[j] if v != q_id):
                best.setdefault(v, score)
                if len(best) == self.k:
                    break
            out[0].extend([q_id] * len(best))
            out[1].extend(best)
            out[2].extend(best.values())
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def fit(index: DataFrame, fit_rows: int, options: dict) -> dict[int, Router]:
    """Routers by length of vector, from a sample of about ``fit_rows`` rows, twice that at most."""
    counts = {r.n: r["count"] for r in index.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count")).limit(1000).collect()}
    total = sum(counts.values())
    if not total:
        return {}
    h = F.xxhash64(F.lit(41), "vec_id")
    near = index.where(h.cast("double") < F.lit((min(1.0, 1.2 * fit_rows / total) * 2 - 1) * 2.0**63)).limit(2 * fit_rows) if total > fit_rows else index
    by: dict[int, list] = {}
    for r in near.toLocalIterator():
        by.setdefault(len(r.v), []).append((r.vec_id, r.v))
    return {n: Router(np.array([v for _, v in sorted(rows)], np.float64), counts.get(n, len(rows)), seed=n, **options) for n, rows in by.items()}


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = column.value_lengths().to_numpy()
    return lengths, np.concatenate(([0], np.cumsum(lengths)[:-1])), column.flatten().to_numpy()


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = 4, search_mass: float = 1.1, leaf_rows: int = 12, fit_rows: int = 20_000, least_leaf: int = 8, bundle_rows: int = 2048, shard_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per query and rank: ``query_id, rank, vec_id, score`` (Euclidean distance)."""
    spark = vectors.sparkSession
    index = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    routers = fit(index, fit_rows, {"trees": trees, "leaf_rows": leaf_rows, "least_leaf": least_leaf, "bundle_rows": bundle_rows, "shard_rows": shard_rows})
    shared = spark.sparkContext.broadcast(routers)
    small = dict(vectors.dtypes)[vector_col] == dict(queries.dtypes)[vector_col] == "array<float>"
    kind = np.float32 if small else np.float64  # single precision travels as it is and is widened exactly

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            lengths, starts, flat = _vectors(b.column(1))
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                rows = flat[starts[at][:, None] + np.arange(n)]
                raw = pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary())
                r = shared.value.get(int(n))
                for t in range(len(r.trees) if r else 1):
                    leaf = r.trees[t].leaves_of(rows) if r else np.zeros(len(at), np.int64)
                    bundle = r.bundle[t][leaf] if r else leaf
                    salt = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % (r.salts[t][bundle] if r else 1)
                    whole = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), len(at)), pa.int32())  # noqa: B023, E731
                    leaves = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), whole(leaf))
                    yield pa.record_batch([whole(n), whole(t), whole(bundle), whole(salt), whole(0), pa.array(ids[at]), raw, leaves], NAMES)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, starts, flat = _vectors(b.column(1))
            for i, q_id in enumerate(b.column(0).to_pylist()):
                n = int(lengths[i])
                q, r = flat[starts[i] : starts[i] + n], shared.value.get(n)
                out = []
                for t, leaves in enumerate(r.visits(q, search_mass) if r else [[0]]):
                    by: dict[int, list[int]] = {}
                    for leaf in leaves:
                        by.setdefault(int(r.bundle[t][leaf]) if r else 0, []).append(leaf)
                    out += [(n, t, bundle, salt, 1, q_id, own) for bundle, own in by.items() for salt in range(int(r.salts[t][bundle]) if r else 1)]
                cols = [pa.array([x[c] for x in out], pa.int64() if c == 5 else pa.int32()) for c in range(6)]
                yield pa.record_batch([*cols, pa.array([q.astype(kind).tobytes()] * len(out), pa.binary()), pa.array([x[6] for x in out], pa.list_(pa.int32()))], NAMES)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple[np.ndarray, list, np.ndarray]] = []
        shard: Shard | None = None
        waiting: list[tuple] = []

        def answer() -> pa.RecordBatch:
            got = shard.nearest([w[0] for w in waiting], np.stack([np.frombuffer(w[1], kind).astype(np.float64) for w in waiting]), [w[2] for w in waiting])
            waiting.clear()
            return pa.record_batch([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], ["query_id", "vec_id", "score"])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True))
            kinds, ids, raws, leaves = (b.column(c).to_pylist() for c in range(4, 8))
            for i in range(b.num_rows):
                if keys[i] != key:
                    if waiting:
                        yield answer()
                    key, held, shard = keys[i], [], None
                if kinds[i] == 0:
                    held.append((ids[i], raws[i], leaves[i][0]))
                elif held:
                    if shard is None:
                        shard = Shard(np.array([h[0] for h in held], np.int64), np.frombuffer(b"".join(h[1] for h in held), kind).reshape(len(held), -1).astype(np.float64), np.array([h[2] for h in held]), k)
                    waiting.append((ids[i], raws[i], leaves[i]))
                    if len(waiting) == QUERY_BLOCK:
                        yield answer()
        if waiting:
            yield answer()

    routed = index.mapInArrow(tidy(route), ROUTED).unionByName(asked.mapInArrow(tidy(visit), ROUTED))
    place = ["n", "tree", "bundle", "salt"]
    found = routed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *place).sortWithinPartitions(*place, "kind").mapInArrow(tidy(rank), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place_of = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place_of).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
