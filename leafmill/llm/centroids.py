"""Exact k-means over integer vectors with Drake's adaptive bounds.

Each vector keeps an upper bound of the distance to its own centroid, lower bounds of those to its ``b`` next nearest
ones, and one lower bound for all the rest. After the centroids have moved, bounds are widened by how far they went. A
vector whose upper bound lies below all others stays without a distance; else its own distance is worked out, then those of
the listed centroids, and only where even these do not lie below the remainder bound, all of them. Distances are exact
integers; bounds carry a margin for rounding, so ties are never decided by them. ``b`` starts at a quarter of the centroids
and follows how deep the lists had to be read, an eighth at least.

Centroids (k of them) are all that goes through the driver; vectors and bounds are written between the rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.storage import stored

#: Components of 64-fold size beyond this have squared distances that a long may not hold.
LARGEST = 1 << 27
STATE = "id long, v array<int>, cluster int, upper double, near array<int>, lower array<double>, rest double, distance long, depth int"


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        gap = vectors - centre
        np.einsum("ij,ij->i", gap, gap, out=out[:, c])
    return out


def _below(x: np.ndarray) -> np.ndarray:
    return np.where(np.isinf(x), x, x - 1e-9 * (1 + np.minimum(np.abs(x), 1e300)))


def _above(x: np.ndarray) -> np.ndarray:
    return x + 1e-9 * (1 + np.abs(x))


class Bounds:
    """Clusters and bounds of a block of vectors. near: numbers of the listed centroids, -1 where a list is shorter."""

    def __init__(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.vectors, self.cluster, self.upper, self.near, self.lower, self.rest = vectors, cluster, upper, near, lower, rest
        #: how far down a vector's list this round went: -1 nothing worked out, 0 its own distance, then places in the list, b + 1 all
        self.depth = np.full(len(vectors), -1, np.int64)

    @classmethod
    def new(cls, vectors: np.ndarray, centroids: np.ndarray, b: int) -> Bounds:
        n = len(vectors)
        out = cls(vectors, np.zeros(n, np.int64), np.zeros(n), np.full((n, b), -1), np.full((n, b), np.inf), np.full(n, np.inf))
        out.scan(np.arange(n), centroids)
        return out

    def scan(self, rows: np.ndarray, centroids: np.ndarray) -> None:
        """All distances of these rows; lists as long as ``near`` has room."""
        b = self.near.shape[1]
        d = squared(self.vectors[rows], centroids)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        self.cluster[rows], self.upper[rows] = order[:, 0], _above(root[:, 0])
        listed = min(b, len(centroids) - 1)
        self.near[rows, :listed], self.lower[rows, :listed] = order[:, 1 : 1 + listed], _below(root[:, 1 : 1 + listed])
        self.rest[rows] = _below(root[:, 1 + listed]) if len(centroids) > 1 + listed else np.inf
        self.depth[rows] = b + 1

    def moved(self, steps: np.ndarray) -> None:
        """Bounds for centroids that went up to ``steps`` far."""
        self.upper = _above(self.upper + steps[self.cluster])
        self.lower = np.where(self.near >= 0, _below(self.lower - steps[self.near]), np.inf)
        self.rest = _below(self.rest - steps.max(initial=0.0))

    def settle(self, centroids: np.ndarray) -> None:
        """Every vector with its nearest centroid, by as few distances as the bounds allow."""
        floor = np.minimum(self.lower.min(axis=1, initial=np.inf), self.rest)
        open_ = np.flatnonzero(self.upper >= floor)
        if not len(open_):
            return
        gap = self.vectors[open_] - centroids[self.cluster[open_]]
        own = np.einsum("ij,ij->i", gap, gap)
        self.upper[open_] = _above(np.sqrt(own.astype(np.float64)))
        self.depth[open_] = 0
        still = self.upper[open_] >= floor[open_]
        open_, own = open_[still], own[still]
        if not len(open_):
            return
        # own and listed centroids exactly, in order of distance, then number
        numbers = np.concatenate([self.cluster[open_][:, None], self.near[open_]], axis=1)
        exact = np.full(numbers.shape, np.iinfo(np.int64).max)
        exact[:, 0] = own
        for k in range(1, numbers.shape[1]):
            have = np.flatnonzero(numbers[:, k] >= 0)
            gap = self.vectors[open_[have]] - centroids[numbers[have, k]]
            exact[have, k] = np.einsum("ij,ij->i", gap, gap)
        order = np.lexsort((numbers, exact), axis=1)
        before = self.upper[open_]
        self.depth[open_] = np.maximum((self.lower[open_] <= before[:, None]).sum(axis=1), 1)
        numbers, exact = np.take_along_axis(numbers, order, axis=1), np.take_along_axis(exact, order, axis=1)
        root = np.sqrt(exact.astype(np.float64))
        sure = _above(root[:, 0]) < self.rest[open_]
        rows = open_[sure]
        self.cluster[rows], self.upper[rows] = numbers[sure, 0], _above(root[sure, 0])
        self.near[rows] = numbers[sure, 1:]
        self.lower[rows] = np.where(numbers[sure, 1:] >= 0, _below(root[sure, 1:]), np.inf)
        if not sure.all():
            self.scan(open_[~sure], centroids)

    def narrowed(self, b: int) -> None:
        """Lists of ``b`` at most; what goes joins the remainder bound."""
        if b < self.near.shape[1]:
            order = np.argsort(self.lower, axis=1, kind="stable")
            near, lower = np.take_along_axis(self.near, order, axis=1), np.take_along_axis(self.lower, order, axis=1)
            self.rest = np.minimum(self.rest, lower[:, b:].min(axis=1))
            self.near, self.lower = near[:, :b], lower[:, :b]


def kept(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``(id, v)``: vectors of ``dims`` components, all finite, as integers floor(scale * x)."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    own = own.filter((F.size("x") == dims) & F.forall("x", lambda x: F.coalesce(F.abs(x * scale) <= LARGEST, F.lit(False)) & ~F.isnan(x)))
    return own.select("id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _round(table: DataFrame, centroids: np.ndarray, steps: np.ndarray | None, b: int, name: str) -> DataFrame:
    """One assignment of all vectors, written. steps: how far the centroids have moved since the table's bounds; None: it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1), centroids.shape[1], np.int64)
            if steps is None:
                own = Bounds.new(vectors, centroids, b)
            else:
                had = batch.column(4).value_lengths()[0].as_py()
                own = Bounds(vectors, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().copy(), _matrix(batch.column(4), had, np.int64), _matrix(batch.column(5), had, np.float64), batch.column(6).to_numpy().copy())
                own.narrowed(b)
                own.moved(steps)
                own.settle(centroids)
            gap = vectors - centroids[own.cluster]
            at = pa.array(np.arange(len(vectors) + 1) * own.near.shape[1], pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (own.near.astype(np.int32), own.lower)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own.cluster.astype(np.int32)), pa.array(own.upper), *lists, pa.array(own.rest), pa.array(np.einsum("ij,ij->i", gap, gap)), pa.array(own.depth.astype(np.int32))],
                names=["id", "v", "cluster", "upper", "near", "lower", "rest", "distance", "depth"],
            )

    return stored(table.mapInArrow(run, STATE), name)


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, bounds: int | None = None) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every vector that is kept.

    Kept are vectors of exactly ``dims`` components, none null, NaN, infinite or so large that a squared distance may not fit a long.
    Centroids start as the kept vectors of the smallest sha256 of ``seed:id`` (null ids last, ties by the vector), fewer than ``k`` if
    there are fewer vectors; repeated rows count each; ties between centroids go to the smaller number; a centroid without vectors
    stays. Null ids come back null. No vectors kept: an empty result. Other columns are not looked at.
    """
    table = stored(kept(vectors, id_col, vector_col, dims, scale), "centroid-vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = table.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()
    schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return table.sparkSession.createDataFrame([], schema)
    centroids = np.array([r.v for r in first], np.int64)
    quarter, eighth = max(1, -(-len(centroids) // 4)), max(1, -(-len(centroids) // 8))
    b, steps, state = bounds or quarter, None, table
    for done in range(rounds + 1):
        state = _round(state, centroids, steps, b, f"centroid-round-{done}")
        if done == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.array(*(F.sum(F.get("v", F.lit(d)).cast("long")) for d in range(dims))).alias("sums")).collect()
        before = centroids.copy()
        for r in sums:
            centroids[r.cluster] = [s // r.n for s in r.sums]
        steps = _above(np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64)))
        if done:
            b = min(b, max(eighth, max(r.depth for r in sums)))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by_cluster = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    whole = sum(r.cluster_inertia for r in by_cluster)
    facts = state.sparkSession.createDataFrame([(r.cluster, r.cluster_inertia, whole, digests[r.cluster]) for r in by_cluster], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def _sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """All distances in every round."""
    parts = [
        f"v as (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})",
        f"c0 as (select row_number() over (order by sha256('1:' || vec_id), v) - 1 c, v from v qualify c < {k})",
    ]
    for r in range(rounds + 1):
        distance = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.v[cast(i as int)] - c.v[cast(i as int)]) * (v.v[cast(i as int)] - c.v[cast(i as int)])))"
        parts.append(f"a{r} as materialized (select rid, vec_id, v, m.c c, cast(m.d as bigint) d from (select rid, any_value(vec_id) vec_id, any_value(v.v) v, min({{'d': {distance}, 'c': c}}) m from v, c{r} c group by rid))")
        if r < rounds:
            parts.append(f"s{r} as (select c, i, sum(x) s, count(*) n from (select c, unnest(v) x, generate_subscripts(v, 1) i from a{r}) group by c, i)")
            parts.append(f"m{r} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) v from s{r} group by c)")
            parts.append(f"c{r + 1} as materialized (select c{r}.c, coalesce(m{r}.v, c{r}.v) v from c{r} left join m{r} using (c))")
    return f"with {', '.join(parts)} select vec_id, cast(a{rounds}.c as int) as cluster, d as distance, cast(sum(d) over (partition by a{rounds}.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(z.v, ',')) as centroid_sha256 from a{rounds} join c{rounds} z on z.c = a{rounds}.c"


SQL = _sql()
