"""Centroid clustering of integer vectors: Lloyd's rounds whose nearest centroids are found by exponion search.

A vector has an upper bound of the distance to its own centroid and a lower one of that to all others; both follow the
centroids' moves. Where they don't settle it, the vector scans the centroids in a ball around its own, of twice the
distance to its own plus its own's to the next: both its nearest centroids lie in it. Lists of centroids by
distance give the ball as a prefix. Bounds are widened by more than floating point errs and the radius is inclusive, so ties are kept and
settled by whole numbers: distances are exact.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import dropped, staged

#: Components beyond this bound (131,072 before scaling) could have distances that a long doesn't hold.
LARGEST = 1 << 27
#: By how much bounds are widened; the errors of square roots and sums are below 1e-14 each.
WIDER = 1e-9


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<int>): vectors of `dim` finite components, each as floor(scale * x). Others are left out, and so are
    vectors with a component beyond LARGEST. Ids may be null or repeated."""
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.floor(x * scale))
    whole = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim)
    fine = F.forall(F.col(vec_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) <= LARGEST))
    return vectors.where(whole & fine).select(F.col(id_col).alias("vec_id"), v.cast("array<int>").alias("v"))


def seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids, hashed with the salt, come first (ties by vector); vectors without an id are none."""
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in rows.where("vec_id is not null").select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v to c (one centroid, or one for each row)."""
    apart = v - c
    return np.einsum("ij,ij->i", apart, apart)


class Centroids:
    """Centroids of a round: for each one the others in order of distance, and how far each has moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.now = now
        apart = np.sqrt(np.stack([squared(now, c) for c in now]).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, : len(now) - 1]
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.next = self.apart[:, 0] if len(now) > 1 else np.full(1, np.inf)
        moved = np.zeros(len(now)) if before is None else np.sqrt(squared(now, before).astype(np.float64)) * (1 + WIDER)
        most = np.argsort(moved)
        self.moved, self.others = moved, np.full(len(now), moved[most[-1]])  # others: the largest move of any other one
        self.others[most[-1]] = moved[most[-2]] if len(now) > 1 else 0.0

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(own, upper, lower, scanned): each row's nearest centroid (the first of equally near ones), its bounds, and how many
        distances were computed. A row that has no centroid yet comes with own 0 and the bounds inf and 0."""
        upper, lower = upper + self.moved[own], np.maximum(0.0, lower - self.others[own])
        own, least = own.copy(), np.maximum(lower, self.next[own] / 2 * (1 - WIDER))
        todo = np.flatnonzero(~(upper < least))
        exact = squared(v[todo], self.now[own[todo]])
        upper[todo] = np.sqrt(exact.astype(np.float64)) * (1 + WIDER)
        open_ = ~(upper[todo] < least[todo])
        scanned = len(todo)
        todo, exact = todo[open_], exact[open_]
        were = own[todo]
        for a in np.unique(were).tolist():
            mine = were == a
            rows, best = todo[mine], exact[mine]
            ball = 2 * upper[rows] + self.next[a] * (1 + WIDER) + WIDER
            reach = np.searchsorted(self.apart[a], ball, side="right")
            number, second = np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
            for k in range(int(reach.max(initial=0))):
                at = np.flatnonzero(reach > k)
                j = int(self.order[a, k])
                d = squared(v[rows[at]], self.now[j])
                scanned += len(at)
                closer = (d < best[at]) | ((d == best[at]) & (j < number[at]))
                second[at] = np.where(closer, best[at], np.minimum(second[at], d))
                best[at], number[at] = np.where(closer, d, best[at]), np.where(closer, j, number[at])
            own[rows] = number
            upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + WIDER)
            lower[rows] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(np.float64)) * (1 - WIDER))
        return own, upper, lower, scanned


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1)


def _assigned(rows: DataFrame, now: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """rows(vec_id, v, cluster, upper, lower) after a round: the same, and the cluster that each had (null at first)."""

    def round_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(now, before)
        for batch in batches:
            if not len(batch):
                continue
            had, *bounds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            own, upper, lower, _ = centroids.assign(_matrix(batch.column(1)), np.maximum(had, 0).astype(np.int64), *bounds)
            yield pa.record_batch([*batch.columns[:2], pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), batch.column(2)], ["vec_id", "v", "cluster", "upper", "lower", "was"])

    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, v array<int>, cluster int, upper double, lower double, was int"
    return rows.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(round_, schema)


def _changes(rows: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) that the clusters gained by the rows that changed theirs, as Python integers: k * (dim + 1) numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0)) if len(batch) else np.zeros((0, dim), np.int64)
            one = np.column_stack([v, np.ones(len(v), np.int64)])
            now, was = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for j in range(k):
                total[j] += one[now == j].sum(0) - one[was == j].sum(0)
        yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "gained"])

    found = rows.where("cluster <> was").select("v", "cluster", "was").mapInArrow(sums, "cluster int, gained array<long>")
    table = np.zeros((k, dim + 1), object)
    added = found.select("cluster", F.posexplode("gained")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("n"))
    for r in added.collect():
        table[r["cluster"], r["pos"]] = int(r["n"])
    return table[:, :dim], table[:, dim]


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that scaled() keeps.

    Every round writes the vectors with their bounds to a new table and drops the one before; the driver holds the
    centroids' sums alone, to which changed vectors are added. Rounds end early once no centroid moves, as all later ones
    would change nothing. Fewer than k vectors make fewer centroids; without any, there are no rows."""
    spark, old = vectors.sparkSession, []
    rows = staged(scaled(vectors, dim=dim, scale=scale).withColumns({"cluster": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}), old)
    now, before = seeds(rows, k, salt), None
    if not len(now):
        empty = rows.select("vec_id", "cluster", *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return empty.where("false")
    sums, counts = np.zeros((len(now), dim), object), np.zeros(len(now), object)
    for turn in range(rounds + 1):
        new: list[str] = []
        rows = staged(_assigned(rows, now, before), new)
        dropped(spark, old)
        old = new
        if turn == rounds:
            break
        gained, more = _changes(rows, len(now), dim)
        sums, counts = sums + gained, counts + more
        before, now = now, np.array([[int(s) // int(n) for s in sums[j]] if (n := counts[j]) else list(now[j]) for j in range(len(now))], np.int64)
        if (before == now).all():
            break

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy()
            d = squared(_matrix(batch.column(1)), now[own]) if len(batch) else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(d)], ["vec_id", "cluster", "distance"])

    kind = dict(rows.dtypes)["vec_id"]
    found = staged(rows.select("vec_id", "v", "cluster").mapInArrow(distances, f"vec_id {kind}, cluster int, distance long"))
    dropped(spark, old)
    inertia = {r["cluster"]: int(r["n"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    known = [(j, inertia.get(j, 0), sum(inertia.values()), digests[j]) for j in range(len(now))]
    return found.join(F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
