"""Dense search by cells: spherical k-means, vectors stored by cell, and only the cells near a query read."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.retrieval import dense_topk, nearest, top_k
from millrace.sources.scratch import discard, importable_on_workers, written

MOST_CELLS = 4096


def _unit(table: np.ndarray) -> np.ndarray:
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)


def _sound(vectors: DataFrame, vec_id: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(finite & F.exists("embedding", lambda x: x != 0) & F.col(vec_id).isNotNull())
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def cells_for(vectors: int) -> int:
    """The square root of the number of vectors, from 1 to 4096, so that cells and centroids cost about the same to look at."""
    return int(min(MOST_CELLS, max(1, round(vectors**0.5))))


def train_cells(vectors: DataFrame, cells: int, rounds: int = 8, per_cell: int = 256, seed: int = 1) -> np.ndarray:
    """Unit centroids of spherical k-means over at most ``cells`` * ``per_cell`` vectors, those of least seeded hash of id.

    Starts from the first of them by that hash. A round assigns the sample by greatest cosine and sums each cell; the
    driver gets one sum for each cell, and writes the centroids that the next round reads. A cell that loses all its
    vectors keeps its place.
    """
    spark = vectors.sparkSession
    importable_on_workers(spark)
    sample = vectors.withColumn("h", F.xxhash64("id", F.lit(seed))).orderBy("h", "id").limit(cells * per_cell)
    sample = written(sample, "sample")
    first = sample.orderBy("h", "id").limit(cells).select("v").collect()
    centroids = _unit(np.array([r.v for r in first], np.float64).reshape(len(first), len(first[0].v) if first else 0))
    for _ in range(rounds if len(centroids) > 1 else 0):

        def assign(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    table = _unit(np.stack(batch.column(0).slice(low, 1024).to_pylist()))
                    cell = (table @ centroids.T).argmax(axis=1)
                    order = np.argsort(cell, kind="stable")
                    present, starts = np.unique(cell[order], return_index=True)
                    sums = np.add.reduceat(table[order], starts)
                    yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array(list(sums))], ["cell", "sums"])

        partial = sample.select("v").mapInArrow(assign, "cell int, sums array<double>")
        totals = partial.groupBy("cell").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(centroids.shape[1])])
        centroids = centroids.copy()
        for r in written(totals, "centroids").collect():
            centroids[r.cell] = r[1:]
        centroids = _unit(centroids)
    discard(sample)
    return centroids


def build_cells(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = 8, vec_id: str = "vec_id") -> None:
    """Write ``<path>/centroids`` and ``<path>/vectors``, partitioned by cell; see :func:`train_cells`.

    Every vector that is not null or zero is stored in the cell of greatest cosine. Vectors meet by cell in one shuffle, in
    which adaptive execution splits a cell that is too large for a file.
    """
    spark = vectors.sparkSession
    rows = _sound(vectors, vec_id)
    centroids = train_cells(rows, cells or cells_for(rows.count()), rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                cell = (_unit(np.stack(part.column(1).to_pylist())) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    placed = rows.mapInArrow(assign, "id long, v array<double>, cell int")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    listed = [(i, c) for i, c in enumerate(centroids.tolist())]
    spark.createDataFrame(listed, "cell int, v array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def calibrate(spark: SparkSession, path: str, k: int, target: float = 0.97, sample: int = 200, seed: int = 2) -> int:
    """The least number of cells to probe that hold ``target`` of the ``k`` nearest of a sample of stored vectors.

    At most ``sample`` vectors, those of least seeded hash of id, are searched for exactly; how many cells one must read to
    meet a neighbour depends on the data (few where they are clustered, most where they are not), so it is measured.
    The number is written to ``<path>/probes``, where :func:`cells_topk` finds it.
    """
    stored = _stored(spark, path).select(F.col("id").alias("vec_id"), F.col("v").alias("embedding"), "cell")
    asked = stored.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = written(asked, "asked")
    centroids = _centroids(spark, path)
    found = dense_topk(asked, stored, k).join(stored.select("vec_id", "cell"), "vec_id").select("query_id", "cell").collect()
    queries = {r.query_id: np.argsort(-(_unit(np.array([r.embedding])) @ centroids.T)[0], kind="stable") for r in asked.collect()}
    places = sorted(int(np.flatnonzero(queries[r.query_id] == r.cell)[0]) + 1 for r in found)
    probes = places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)] if places else 1
    row = spark.createDataFrame([(k, target, probes)], "k int, target double, probes int")
    row.write.mode("overwrite").parquet(f"{path}/probes")
    discard(asked)
    return probes


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/vectors")


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    listed = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r.cell)  # at most 4096
    return np.array([r.v for r in listed], np.float64)


def cells_topk(
    queries: DataFrame, path: str, k: int, probes: int | None = None, query_id: str = "query_id", vec_id: str = "vec_id", block: int = 4096, report: list | None = None
) -> DataFrame:
    """``(query_id, vec_id, rank, score)``: the ``k`` nearest vectors of the ``probes`` cells nearest to each query.

    Without ``probes`` it is the number that :func:`calibrate` has found.

    Queries are taken in blocks of at most ``block``; a block reads only the partitions of the cells that one of its queries
    probes, and a vector is compared only with the queries that probe its cell. With ``probes`` the number of cells the
    result is that of :func:`~millrace.operators.retrieval.dense_topk`, else some of the k may be missed: measure
    :func:`recall`. ``report`` receives (cells read, cells) of each block.
    """
    spark = queries.sparkSession
    importable_on_workers(spark)
    centroids = _centroids(spark, path)
    probes = probes or spark.read.parquet(f"{path}/probes").first().probes
    asked = _sound(queries, query_id)
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    parts = []
    for number in range(blocks if len(centroids) else 0):
        rows = asked.where(F.col("block") == number).select("id", "v").toArrow()  # a block, of bounded size
        ids = rows.column("id").to_numpy()
        if not len(ids):
            continue
        table = _unit(np.stack(rows.column("v").to_pylist()))
        near = np.argsort(-(table @ centroids.T), axis=1, kind="stable")[:, :probes]
        of_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        if report is not None:
            report.append((len(of_cell), len(centroids)))
        sent = spark.sparkContext.broadcast((ids, table, of_cell))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, table, of_cell = sent.value
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                for cell in np.unique(cells):
                    at = np.flatnonzero(cells == cell)
                    own, who = batch.column("id").take(pa.array(at)).to_numpy(), of_cell[int(cell)]
                    best, found = nearest(table[who], batch.column("v").take(pa.array(at)), own, k)
                    columns = [np.repeat(ids[who], best.shape[1]), own[found].ravel(), best.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "id", "score"])

        stored = _stored(spark, path).where(F.col("cell").isin(sorted(of_cell)))
        parts.append(stored.select("id", "v", "cell").mapInArrow(search, "query long, id long, score double"))
    if not parts:
        return spark.createDataFrame([], f"{query_id} long, {vec_id} long, rank long, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = top_k(out, "query", [F.desc("score"), F.asc("id")], k)
    return best.select(F.col("query").alias(query_id), F.col("id").alias(vec_id), "rank", "score")


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", vec_id: str = "vec_id") -> DataFrame:
    """One row ``(queries, wanted, hits, recall)``: the share of the exact result's rows that ``found`` has."""
    hit = exact.join(found.select(query_id, vec_id, F.lit(1).alias("hit")), [query_id, vec_id], "left")
    counted = hit.agg(F.countDistinct(query_id).alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    return counted.withColumn("recall", F.round(F.col("hits") / F.col("wanted"), 6))
