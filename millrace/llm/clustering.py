"""Exact k-means by rounds: lower bounds loosened by the geometry of cluster spheres, vectors they cannot decide scanned."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.shared import importable_on_workers, keep_caches, short_batches, written
from millrace.sources.scratch import discard

MOST = 2**27  # absolute value of a component: squared distances of 64 of them fit into 63 bits
_SLACK = 1e-9  # relative, for bounds in floating point
_ANGLE = 1e-7  # for angles near 0 and a right one, which their cosine or sine tells to half the digits


def squared_distances(table: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as int64: by matrix product in doubles where all its sums are below 2^53."""
    most = max(np.abs(table).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if 4 * table.shape[1] * float(most) ** 2 < 2**53 else np.int64
    t, c = table.astype(kind), centroids.astype(kind)
    return ((t * t).sum(1)[:, None] - 2 * (t @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def own_distances(table: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each integer row to its own centroid."""
    gap = table - centroids[cluster]
    return (gap * gap).sum(1)


def loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer the closest other centroid may have come to any vector of each cluster.

    All vectors of cluster a lie in the sphere of radius ``radius[a]`` around its centroid ``before``. A centroid j that
    moves by d comes nearer by s or more only inside a branch of a hyperbola around its new place; that branch lies in the
    cone of its asymptotes, with the apex half-way between both places and an angle of cosine s / d about the move. In the
    plane of the move and the sphere's centre, the sphere reaches down to the centre's angle less that under which it is
    seen from the apex; the cosine of this least angle, times d, is the loosening: d itself only where the sphere meets
    the move's own line, 0 where all of it lies on the old place's side. The result is the greatest over j other than a.
    """
    before, after = before.astype(np.float64), after.astype(np.float64)
    move = after - before
    drift = np.linalg.norm(move, axis=1)
    line = before[:, None, :] - (before + after)[None, :, :] / 2  # from the apex of j to the centre of a
    away = np.linalg.norm(line, axis=2)
    share = radius[:, None] * (1 + _SLACK) / np.maximum(away, 1e-300)
    seen = np.where(share < 1, np.arcsin(np.minimum(1.0, share)), np.pi)  # an apex within the sphere sees it all around
    cosine = np.einsum("ajd,jd->aj", line, move) / np.maximum(away * drift[None, :], 1e-300)
    angle = np.maximum(0.0, np.arccos(np.clip(cosine, -1, 1)) - seen - _ANGLE)
    out = drift[None, :] * np.maximum(0.0, np.cos(angle))
    np.fill_diagonal(out, 0.0)
    return out.max(axis=1, initial=0.0)


def reassign(
    table: np.ndarray, cluster: np.ndarray, lower: np.ndarray, centroids: np.ndarray, loosened: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters, squared distances, lower bounds of the distance to all other centroids, and the number of rows scanned.

    A row whose distance to its own centroid is below its bound, less its cluster's loosening, stays; all others are
    compared with every centroid, ties going to the smaller number. A negative cluster stands for none yet.
    """
    known = cluster >= 0
    at = np.maximum(cluster, 0)
    distance = own_distances(table, centroids, at)
    bound = np.where(known, lower - loosened[at] - _SLACK * (np.abs(lower) + loosened[at]), -1.0)
    scan = np.flatnonzero(np.sqrt(distance.astype(np.float64)) * (1 + _SLACK) >= bound)
    cluster, bound = at.astype(np.int32), bound.copy()
    if len(scan):
        every = squared_distances(table[scan], centroids)
        best = every.argmin(axis=1)
        cluster[scan], distance[scan] = best, every[np.arange(len(scan)), best]
        every[np.arange(len(scan)), best] = np.iinfo(np.int64).max
        second = every.min(axis=1) if len(centroids) > 1 else np.full(len(scan), np.iinfo(np.int64).max)
        bound[scan] = np.sqrt(second.astype(np.float64)) * (1 - _SLACK)
    return cluster, distance, bound, len(scan)


_BLOCKS = "ids binary, nulls binary, vectors binary, cluster binary, distance binary, lower binary"
_STATS = "stats array<struct<cluster: int, n: long, radius: long, scanned: long, sums: array<long>>>"
_ASSIGNED = f"{_BLOCKS}, {_STATS}"


def scaled_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, v)``: rows of ``dims`` finite components, none null, as floor(scale * x), x in double precision.

    Others are left out, as are rows with a scaled component beyond 2^27 either way, whose squared distances need not fit
    into 63 bits.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    sound = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= MOST))
    kept = rows.where(F.coalesce(sound, F.lit(False)))
    return kept.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def starting_centroids(scaled: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``seed:id`` (ties by vector, null ids last), all if there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = scaled.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster_vectors(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: list | None = None,
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector with ``dims`` components.

    Vectors are scaled and some left out as :func:`scaled_vectors` says; ids may repeat or be null. Centroids start as
    :func:`starting_centroids`; ``rounds`` times all vectors are assigned to the nearest centroid (exact squared distances
    of whole numbers, ties to the smaller number) and every centroid with vectors becomes the floor of their mean; then
    vectors are assigned once more. No vectors give no rows. An inertia beyond 63 bits is null.

    Vectors go in packed blocks with their cluster and a lower bound of the distance to all other centroids. A round
    streams the blocks once: :func:`loosening` tells from the clusters' spheres how far each bound may have fallen, and only
    vectors that it leaves undecided meet all centroids (:func:`reassign`). Tasks add counts, sums and radii per cluster to
    the rows they write; the ``k`` totals are all that the driver gets. Each round is a written table, which replaces that
    of the round before. ``report`` receives (vectors, vectors scanned) of each round.
    """
    spark = vectors.sparkSession
    importable_on_workers(spark)
    short_batches(spark)
    scaled = scaled_vectors(vectors, dims, scale, id_col, vector_col)
    centroids = starting_centroids(scaled, k, seed)
    names = [c.split()[0] for c in _BLOCKS.split(", ")]
    result = f"`{id_col}` long, cluster int, distance long"
    final = f"{result}, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], final)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                ids, n = part.column(0), part.num_rows
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                columns = [
                    ids.fill_null(0).to_numpy(zero_copy_only=False),
                    ids.is_null().to_numpy(zero_copy_only=False),
                    flat,
                    np.full(n, -1, np.int32),
                    np.zeros(n, np.int64),
                    np.zeros(n),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names)

    blocks = written(scaled.mapInArrow(pack, _BLOCKS), "vectors")
    loosened = np.zeros(len(centroids))
    for number in range(rounds + 1):
        assigned = written(blocks.select(names).mapInArrow(_round(centroids, loosened, dims), _ASSIGNED), "assigned")
        discard(blocks)
        blocks = assigned
        s = F.col("s")
        totals = blocks.select(F.explode("stats").alias("s")).groupBy(s["cluster"].alias("cluster")).agg(
            F.sum(s["n"]).alias("n"),
            F.max(s["radius"]).alias("radius"),
            F.sum(s["scanned"]).alias("scanned"),
            *[F.sum(s["sums"][i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)],
        )
        rows = totals.collect()  # one for each cluster
        if report is not None:
            report.append((sum(r.n for r in rows), sum(r.scanned for r in rows)))
        if number < rounds:
            moved, radius = centroids.copy(), np.zeros(len(centroids))
            for r in rows:
                moved[r.cluster] = [int(x) // r.n for x in r[4:]]
                radius[r.cluster] = np.sqrt(float(r.radius))
            loosened, centroids = loosening(centroids, moved, radius), moved

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))
                cluster, distance = np.frombuffer(row["cluster"], np.int32), np.frombuffer(row["distance"], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], [id_col, "cluster", "distance"])

    found = written(blocks.select("ids", "nulls", "cluster", "distance").mapInArrow(unpack, result), "clusters")
    discard(blocks)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    digests = spark.createDataFrame([*enumerate(digests)], "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).join(digests, "cluster")
    whole = inertia.agg(F.sum("own").alias("all"))
    inertia = inertia.join(whole, F.lit(True)).select(  # one row
        "cluster", F.expr("try_cast(own AS long)").alias("cluster_inertia"), F.expr("try_cast(all AS long)").alias("inertia"), "centroid_sha256"
    )
    inertia = written(inertia, "inertia")  # a row for each cluster
    return found.join(F.broadcast(inertia), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round(centroids: np.ndarray, loosened: np.ndarray, dims: int):
    schema = to_arrow_schema(StructType.fromDDL(_ASSIGNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches("")
        for batch in batches:
            for row in batch.to_pylist():
                table = np.frombuffer(row["vectors"], np.int32).reshape(-1, dims).astype(np.int64)
                before, lower = np.frombuffer(row["cluster"], np.int32), np.frombuffer(row["lower"])
                cluster, distance, lower, scanned = reassign(table, before, lower, centroids, loosened)
                order = np.argsort(cluster, kind="stable")
                present, starts, counts = np.unique(cluster[order], return_index=True, return_counts=True)
                sums, radius = np.add.reduceat(table[order], starts), np.maximum.reduceat(distance[order], starts)
                stats = [
                    {"cluster": int(c), "n": int(n), "radius": int(r), "scanned": scanned if i == 0 else 0, "sums": s.tolist()}
                    for i, (c, n, r, s) in enumerate(zip(present, counts, radius, sums, strict=True))
                ]
                state = {"cluster": cluster.tobytes(), "distance": distance.tobytes(), "lower": lower.tobytes(), "stats": stats}
                yield pa.RecordBatch.from_pylist([row | state], schema)

    return run
