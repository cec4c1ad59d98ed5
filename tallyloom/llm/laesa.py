"""Centroid clustering with a pivot table (LAESA).

Vectors become integers once, and the distances of each to a few fixed pivots are
stored with it. In a round, |d(v, p) - d(c, p)| for a pivot p is a lower bound of
the distance of vector v and centroid c. The centroid of smallest bound gets an
exact distance first; of the others only those whose bound isn't beyond it survive
and get exact distances too, in integers. Bounds are lowered by more than their
rounding error, so the nearest centroid, ties included, is that of a full search.

Scale: the table (integers and pivot distances) is written once and read in each
round by a map-only pass that keeps sums of its own for each centroid, so a round
shuffles and returns a row for each task and centroid and no cluster is gathered,
whatever its share of the vectors. Centroids and pivots are a few rows.

Rows kept: vectors with exactly ``dims`` components, none null, NaN or infinite;
a null vector isn't kept. Repeated rows, and rows of equal or null ids, are vectors
of their own; a null id hashes as an empty one, and rows of one id that tie for a
first centroid are taken by their components. With fewer vectors than clusters
each starts one. No vector kept: empty output. A component of 2**27 or more after
scaling raises an error: its squared distance wouldn't fit a long integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import Scratch

DIMS, SCALE = 64, 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
PIVOTS, PIVOT_SAMPLE = 16, 1024
LARGEST = 1 << 27
SLACK = 1e-6  # by which a lower bound is reduced, relative and absolute


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, v, place): the kept vectors as integers, and the hash that orders them."""
    x = F.col("embedding")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    kept = vectors.where(x.isNotNull() & (F.size(x) == dims)).select(
        "vec_id", F.transform(x, lambda c: c.cast("double")).alias("x")).where(F.forall("x", fine))
    scaled = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))))
    large = F.exists("x", lambda c: F.abs(c * F.lit(float(scale))) >= LARGEST)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return kept.select(
        "vec_id", F.when(large, F.raise_error(F.lit(f"a component of {LARGEST} or more after scaling")).cast("array<bigint>"))
        .otherwise(scaled).alias("v"), F.sha2(name, 256).alias("place"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: each the vector of the sample that is farthest from those before it."""
    chosen = [0] if len(sample) else []
    while chosen and len(chosen) < min(count, len(sample)):
        gap = np.min([((sample - sample[i]) ** 2).sum(1) for i in chosen], axis=0)
        if not gap.max():
            break
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def distances(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Square roots of the exact squared distances, a column for each row of ``to``."""
    return np.sqrt(np.stack([((v - t) ** 2).sum(1) for t in to], 1).astype(np.float64))


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, gaps): gaps are the vector's distances to the pivots."""
    kind, dims = kept.schema["vec_id"].dataType.simpleString(), pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = distances(matrix(batch.column(1), dims), pivots)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.ListArray.from_arrays(
                    np.arange(len(gaps) + 1, dtype=np.int32) * len(pivots), gaps.ravel())], names=["vec_id", "v", "gaps"])

    return kept.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, v array<bigint>, gaps array<double>")


def nearest(v: np.ndarray, gaps: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), its exact squared distance, and how many distances were computed."""
    bound = np.abs(gaps[:, None, :] - distances(centroids, pivots)[None, :, :]).max(2)
    bound -= SLACK * (1 + bound)
    best = bound.argmin(1)
    least = ((v - centroids[best]) ** 2).sum(1)
    count = np.ones(len(v), np.int32)
    first = best.copy()
    for c in range(len(centroids)):
        alive = np.flatnonzero((first != c) & (bound[:, c] <= np.sqrt(least.astype(np.float64))))
        exact = ((v[alive] - centroids[c]) ** 2).sum(1)
        count[alive] += 1
        better = (exact < least[alive]) | (exact == least[alive]) & (c < best[alive])
        best[alive[better]], least[alive[better]] = c, exact[better]
    return best, least, count


def round_sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """One round: for each centroid with vectors their number and componentwise sums."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for batch in batches:
            v, gaps = matrix(batch.column(0), dims), matrix(batch.column(1), len(pivots))
            best, _, _ = nearest(v, gaps, centroids, pivots)
            count += np.bincount(best, minlength=len(centroids))
            for c in range(len(centroids)):
                sums[c] += v[best == c].sum(0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.ListArray.from_arrays(
            np.arange(len(some) + 1, dtype=np.int32) * dims, sums[some].ravel())], names=["cluster", "n", "sums"])

    parts = table.select("v", "gaps").mapInArrow(run, "cluster long, n long, sums array<bigint>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
    return {r["cluster"]: (r["n"], r["sums"]) for r in rows.collect()}  # a row for each centroid


def assign(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, n_exact): the nearest centroid and its squared distance."""
    kind, dims = table.schema["vec_id"].dataType.simpleString(), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, least, count = nearest(matrix(batch.column(1), dims), matrix(batch.column(2), len(pivots)), centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(least), pa.array(count)],
                                             names=["vec_id", "cluster", "distance", "n_exact"])

    return table.select("vec_id", "v", "gaps").mapInArrow(run, f"vec_id {kind}, cluster int, distance long, n_exact int")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS,
            scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, n_exact.

    The first centroids are the vectors whose id has the smallest hash; each round
    replaces those that have vectors by the floor of their componentwise mean. Pivots
    are chosen far apart from each other among the ``PIVOT_SAMPLE`` vectors of
    smallest hash; which ones they are changes the work, not the result.
    """
    scratch = Scratch(vectors.sparkSession, "laesa")
    kept = whole_vectors(vectors, dims, scale, seed)
    sample = np.array([r["v"] for r in kept.orderBy("place", "v").limit(max(PIVOT_SAMPLE, clusters)).collect()], np.int64).reshape(-1, dims)
    centroids, chosen = sample[:clusters].copy(), far_apart(sample, pivots)
    if not len(sample):
        return (kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")],
                            F.lit("").alias("centroid_sha256"), F.lit(0).alias("n_exact")).where(F.lit(False)))
    table = scratch.write(pivot_table(kept, chosen), "pivots")
    for _ in range(rounds):
        for c, (n, sums) in round_sums(table, centroids, chosen).items():
            centroids[c] = [s // n for s in sums]
    placed = scratch.write(assign(table, centroids, chosen), "placed")
    inertia = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)
    own: Column = by_cluster([inertia.get(c, 0) for c in range(len(centroids))], "long")
    return placed.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"),
                         F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                         by_cluster(digest, "string").alias("centroid_sha256"), "n_exact")
