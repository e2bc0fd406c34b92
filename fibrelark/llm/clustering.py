"""Centroid clustering of integer vectors by annulus search.

The centroids stand in the order of their norms. The distance of a vector to any centroid is an
upper bound u of the distance to its nearest one, and by the triangle inequality every centroid
within u of the vector has a norm within u of the vector's. Those lie side by side in the order:
their ends are found by binary search, and only they are compared, exactly, in whole numbers.
The first bound is the centroid next in norm. A wide annulus is compared from its middle in
steps of twice the size, each of which may lower u and so move the ends inwards. The ends are
widened by more than the rounding of the norms, so that ties on the edge are compared too.

A round is one pass over the written table of whole-number vectors. Tasks send sums and counts
of their clusters only; k rows of totals by component make the next centroids on the driver,
with sums in decimals, so that they are exact at any number of vectors. No state is kept
between rounds but the centroids: a lost executor costs its tasks of one round.

Bounds, both raised when broken: ``CENTROIDS`` values of all centroids together, which are
broadcast; ``LARGEST`` for a component, within which every distance fits a long.

Defined results: vectors of another length, with a null or a component that is not finite, and
null vectors are left out. Of fewer vectors than k each starts a cluster. Repeated rows are
vectors each; a vec_id that starts a cluster twice does so with the smaller vector first. A null
vec_id comes last in the choice of starts. Ties of distance go to the smaller cluster number. An
empty table gives an empty result, and so does one without a valid vector. An inertia beyond a
long is null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibrelark.llm.common import Scratch, batches, own_columns

CENTROIDS = 1 << 22
LARGEST = 1 << 27
# Numbers in the differences that a task holds at once.
HELD = 1 << 20


class Annulus:
    """Centroids in the order of their norms, for exact searches."""

    def __init__(self, centroids: np.ndarray) -> None:
        norms = np.sqrt((centroids * centroids).sum(1).astype(float))
        order = np.argsort(norms, kind="stable")
        self.number, self.norms, self.centroids = order, norms[order], centroids[order]
        self.compared = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster number and squared distance of each vector, both exact."""
        n, k = len(vectors), len(self.norms)
        number, distance = np.full(n, k), np.full(n, np.iinfo(np.int64).max)
        norms = np.sqrt((vectors * vectors).sum(1).astype(float))
        left = np.searchsorted(self.norms, norms)  # compared so far: places from left up to right
        right, low, high = left.copy(), np.zeros(n, np.int64), np.full(n, k)
        live, more = np.arange(n), 1
        while len(live):
            begin, end = np.minimum(left[live], np.maximum(low[live], left[live] - more)), np.maximum(right[live], np.minimum(high[live], right[live] + more))
            for first, last in ((begin, left[live]), (right[live], end)):
                self._compare(vectors, live, first, last, number, distance)
            left[live], right[live] = begin, end
            bound = np.sqrt(distance[live].astype(float))
            slack = (norms[live] + bound) * 2.0**-40
            low[live] = np.searchsorted(self.norms, norms[live] - bound - slack, "left")
            high[live] = np.searchsorted(self.norms, norms[live] + bound + slack, "right")
            live = live[(low[live] < left[live]) | (high[live] > right[live])]
            more *= 2
        return number, distance

    def _compare(self, vectors: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray, number: np.ndarray, distance: np.ndarray) -> None:
        """Lowers number and distance of the rows by the centroids at the places from first up to last."""
        some = last > first
        rows, first, counts = rows[some], first[some], (last - first)[some]
        ends = np.cumsum(counts)
        self.compared += int(ends[-1]) if len(ends) else 0
        step, k = max(1, HELD // vectors.shape[1]), 0
        while k < len(rows):
            # As many rows as have about ``step`` candidates; one at least, whose candidates the centroids bound.
            until = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + step, "right")))
            row, n = rows[k:until], counts[k:until]
            begins = np.cumsum(n) - n
            places = np.arange(int(n.sum())) + np.repeat(first[k:until] - begins, n)
            apart = vectors[np.repeat(row, n)] - self.centroids[places]
            squares = (apart * apart).sum(1)
            least = np.minimum.reduceat(squares, begins)
            least_number = np.minimum.reduceat(np.where(squares == np.repeat(least, n), self.number[places], len(self.number)), begins)
            better = (least < distance[row]) | ((least == distance[row]) & (least_number < number[row]))
            distance[row[better]], number[row[better]] = least[better], least_number[better]
            k = until


def whole_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the vectors that count with components floor(scale * x)."""
    own = own_columns(vectors, "vec_id", "embedding")
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == dim) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    component = lambda c: F.when(F.abs(c * scale) < LARGEST, F.floor(c * scale)).otherwise(F.raise_error(F.lit(f"component beyond {LARGEST // scale}")).cast("long")).cast("int")
    return own.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, component).alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose seeded hash of the id is least, in its order: a top-k, k rows on the driver."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = rows.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), F.col("v").asc()).limit(k).collect()
    return np.array([r["v"] for r in starts], np.int64)


def next_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of each cluster's mean; an empty cluster stays."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids.shape[1]

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(shared.value)
        total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches(parts):
            vectors = _matrix(batch, dim)
            cluster, _ = search.nearest(vectors)
            order = np.argsort(cluster, kind="stable")
            held, begins = np.unique(cluster[order], return_index=True)
            total[held] += np.add.reduceat(vectors[order], begins, axis=0)
            count += np.bincount(cluster, minlength=len(count))
        held = np.flatnonzero(count)
        columns = [np.repeat(held, dim), np.tile(np.arange(dim), len(held)), total[held].ravel(), np.repeat(count[held], dim)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "component", "total", "n"])

    partial = rows.select("v").mapInArrow(sums, "cluster long, component long, total long, n long")
    found = partial.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in found.collect():  # at most a row for each value of a centroid
        out[r["cluster"], r["component"]] = int(r["total"]) // r["n"]
    return out


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its whole numbers) of every vector that counts.

    ``vectors`` has vec_id and embedding, an array of numbers.
    """
    if k * dim > CENTROIDS:
        raise ValueError(f"{k} centroids of {dim} components are more than {CENTROIDS} values")
    scratch = Scratch(spark, "clustering")
    rows = scratch.write(whole_vectors(vectors, dim, scale), "vectors")
    schema = "vec_id long, cluster int, distance long"
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(shared.value)
        for batch in batches(parts):
            found, distance = search.nearest(_matrix(batch, dim))
            columns = [batch.column(0), pa.array(found.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    assigned = scratch.write(rows.mapInArrow(assign, schema), "assigned")
    scratch.drop("vectors")
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()  # k rows at most
    inertia = sum(int(r["total"]) for r in by_cluster)
    fits = lambda n: n if n < 1 << 63 else None
    table = [(r["cluster"], fits(int(r["total"])), fits(inertia), centroids[r["cluster"]].tolist()) for r in by_cluster]
    totals = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

