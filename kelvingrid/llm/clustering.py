"""Centroid clustering with lower bounds that are loosened geometrically; results equal a full scan.

Every vector keeps a lower bound of its distance to each centroid.  When centroids move, the bound to centroid j would
have to give way by the whole drift of j.  But the vectors of cluster i all lie in a sphere around centroid i, and in
the plane through that centre and the two ends of j's move, the sphere's points approach j by less: with D the distance
from the middle of the move to the centre, t the angle between the move and the centre, and r the radius, by at most

    drift * max(0, cos(max(0, t - asin(r / D))))

(the median of the triangle over the move is at most the mean of its sides, so a point at angle t from the middle comes
nearer by at most drift * cos t; no point of the sphere has a smaller angle than t - asin(r / D)).  Nothing is gained
where the sphere holds the middle.  A vector whose bounds all exceed its exact distance to its own centroid stays;
others are ambiguous and are scanned exactly, in whole numbers, over the centroids that the bounds do not rule out.

Vectors and their bounds are one table per round in the shared folder.  What leaves the tasks are sums per cluster and
component, added up in Spark; centroids, radii and these sums (k x components numbers) are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from kelvingrid.session import written

#: Components of magnitude up to this keep every squared distance of 64 of them within a long.
WEIGHT_MOST = 1 << 27
#: Components of magnitude up to this give products whose sums are exact in doubles.
EXACT_DOUBLE = 1 << 22
#: Rounding slack of the bounds, relative and absolute.
SLACK = 1e-9

STATE = "vec_id long, w array<int>, cluster int, distance long, bounds binary, scanned int"
_STATE = pa.schema([("vec_id", pa.int64()), ("w", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("bounds", pa.binary()), ("scanned", pa.int32())])


def whole_components(vectors: DataFrame, vec: str, scale: int, size: int) -> DataFrame:
    """(vec_id, w) of the vectors with exactly ``size`` components, none null or non-finite."""
    x = F.col(vec)
    plain = F.when(F.size(x) == size, F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    small = F.forall(scaled, lambda c: F.abs(c) <= WEIGHT_MOST)
    checked = F.when(small, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for whole squared distances")).cast("array<int>"))
    return vectors.filter(plain).select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("w"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the k least digests of ``seed:vec_id``; fewer, if there are fewer vectors."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    ordered = vectors.select(digest.alias("h"), "w").orderBy(F.asc_nulls_last("h"), "w").limit(k)
    return [list(r["w"]) for r in ordered.collect()]


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole numbers, vectors by centroids."""
    small = not len(x) or max(np.abs(x).max(), np.abs(centroids).max()) <= EXACT_DOUBLE
    kind = np.float64 if small else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def drift_bounds(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Entry (i, j): how much nearer centroid j can have come to any vector within ``radius[i]`` of the old centroid i."""
    old, new = old.astype(float), new.astype(float)
    move = new - old
    drift = np.sqrt((move * move).sum(1))
    middle = (old + new) / 2
    gap = old[:, None, :] - middle[None, :, :]
    distance = np.sqrt((gap * gap).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.clip((gap * move[None, :, :]).sum(2) / (distance * drift[None, :]), -1.0, 1.0)
        angle = np.arccos(cosine) - np.arcsin(np.clip(radius[:, None] / distance, 0.0, 1.0))
    near = np.where(radius[:, None] >= distance, 1.0, np.maximum(np.cos(np.maximum(angle, 0.0)), 0.0))
    out = np.where(drift[None, :] > 0, drift[None, :] * np.nan_to_num(near, nan=1.0), 0.0)
    return out * (1 + SLACK) + np.where(drift[None, :] > 0, SLACK * (1 + distance), 0.0)


def _lists(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _state(ids: pa.Array, w: pa.Array, cluster: np.ndarray, distance: np.ndarray, bounds: np.ndarray, scanned: np.ndarray) -> pa.RecordBatch:
    raw, step = bounds.astype("<f8").tobytes(), 8 * bounds.shape[1]
    blobs = pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())
    return pa.RecordBatch.from_arrays([ids, w, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), blobs, pa.array(scanned, pa.int32())], schema=_STATE)


def assigned_in_full(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """State of the first assignment: every distance is computed, the bounds are exact."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d2 = squared_distances(_lists(b.column(1)), centroids)
                best = d2.argmin(1)  # the first of equal ones
                yield _state(b.column(0), b.column(1), best, d2[np.arange(len(d2)), best], np.sqrt(d2) * (1 - SLACK), np.full(len(d2), d2.shape[1]))

    return vectors.mapInArrow(run, STATE)


def assigned_by_bounds(state: DataFrame, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> DataFrame:
    """State after the centroids moved; only ambiguous vectors are scanned, over the centroids their bounds do not exclude."""
    loosened = drift_bounds(old, new, radius)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(new)
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _lists(b.column("w")), b.column("cluster").to_numpy()
            rows = np.arange(len(x))
            bounds = np.frombuffer(b"".join(b.column("bounds").to_pylist()), "<f8").reshape(-1, k) - loosened[own]
            step = x - new[own]
            best, d2 = own.astype(np.int64), (step * step).sum(1)
            near = np.sqrt(d2)
            bounds[rows, own] = near * (1 - SLACK)
            open_ = bounds <= (near * (1 + SLACK) + SLACK)[:, None]
            open_[rows, own] = False
            ambiguous = np.flatnonzero(open_.any(1))
            scanned = np.ones(len(x), np.int64)
            if len(ambiguous):
                exact = squared_distances(x[ambiguous], new)
                held = open_[ambiguous]
                held[np.arange(len(held)), own[ambiguous]] = True
                seen = np.where(held, exact, np.iinfo(np.int64).max)
                best[ambiguous] = seen.argmin(1)
                d2[ambiguous] = seen.min(1)
                bounds[ambiguous] = np.where(held, np.sqrt(exact) * (1 - SLACK), bounds[ambiguous])
                scanned[ambiguous] = held.sum(1)
            yield _state(b.column("vec_id"), b.column("w"), best, d2, bounds, scanned)

    return state.mapInArrow(run, STATE)


def cluster_sums(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """(counts, component sums in whole numbers, radii) per cluster: k rows per task, added in Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, widest = np.zeros((k, size), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                own = b.column(1).to_numpy()
                np.add.at(sums, own, _lists(b.column(0)))
                n += np.bincount(own, minlength=k)
                np.maximum.at(widest, own, b.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(widest)], names=["c", "n", "s", "far"])

    parts = state.select("w", "cluster", "distance").mapInArrow(run, "c int, n long, s array<long>, far long")
    per = parts.select("c", "n", "far", F.posexplode("s").alias("p", "x")).groupBy("c", "p").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.max("far").alias("far"))
    counts, sums, far = np.zeros(k, np.int64), [[0] * size for _ in range(k)], np.zeros(k)
    for r in per.collect():  # k times size rows
        counts[r["c"]], sums[r["c"]][r["p"]], far[r["c"]] = r["n"], r["x"], r["far"]
    return counts, sums, np.sqrt(far) * (1 + SLACK)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, size: int = 64, vec: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(state, centroids): Lloyd's rounds over the kept vectors, then a last assignment.

    State rows are (vec_id, w, cluster, distance, bounds, scanned); ``scanned`` is the number of distances the last
    assignment computed for the vector.  A vector takes part when it has exactly ``size`` components, none null or
    non-finite; its components count as floor(scale * x), and one beyond ``WEIGHT_MOST`` raises.  The first centroids are the
    vectors with the least digests of their ids (a null id has none and comes last, equal digests are ordered by components);
    with fewer than k vectors there are fewer clusters.  Rows that share an id are vectors of their own.  Equal distances go
    to the smaller cluster, empty clusters keep their centroid.  Other columns are ignored; an empty table gives no rows.
    """
    kept = written(whole_components(vectors, vec, scale, size), "vectors")
    centroids = np.array(first_centroids(kept, k, seed), np.int64).reshape(-1, size)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], STATE), centroids
    state = written(assigned_in_full(kept, centroids), "state")
    for _ in range(rounds):
        counts, sums, radius = cluster_sums(state, len(centroids), size)
        moved = np.array([[s // int(n) for s in row] if n else c.tolist() for row, n, c in zip(sums, counts, centroids)], np.int64)
        state = written(assigned_by_bounds(state, centroids, moved, radius), "state")
        centroids = moved
    return state, centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def cluster_report(vectors: DataFrame, **settings) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned) per kept vector.

    ``inertia`` sums are exact; one that does not fit a long raises.
    """
    state, centroids = cluster_vectors(vectors, **settings)
    spark = vectors.sparkSession
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = state.groupBy("cluster").agg(exact.alias("total"))
    digests = spark.createDataFrame([(i, centroid_digest(c)) for i, c in enumerate(centroids)], T.StructType().add("cluster", T.IntegerType()).add("centroid_sha256", T.StringType()))
    fits: Column = F.col("total").cast("long")
    named = per.join(digests, "cluster").select("cluster", fits.alias("cluster_inertia"), "centroid_sha256")
    whole = state.agg(exact.cast("long").alias("inertia")).scalar()
    # k rows
    return state.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", whole.alias("inertia"), "centroid_sha256", "scanned")
