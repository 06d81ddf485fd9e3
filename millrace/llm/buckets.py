"""Work on buckets of rows: splitting large buckets into pairs of blocks, and maps over sorted groups."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import importable_on_workers, keep_caches, short_batches


def block_pairs(members: DataFrame, size: Column, node: Column, block: int) -> DataFrame:
    """Add ``(p, q, side)``: the units of work in which each member takes part.

    A bucket of ``size`` up to ``block`` is one unit (0, 0). A larger one is cut into blocks by a hash of the node,
    and every pair of blocks p <= q is a unit of its own, so that each pair of members meets in exactly one unit and
    no unit holds more than about two blocks, whatever the bucket's size. ``side`` is the member's block.
    """
    blocks = F.ceil(size / block).cast("int")
    side = F.pmod(F.xxhash64(node, F.lit(17)), blocks).cast("int")
    rows = members.withColumn("_blocks", blocks).withColumn("side", side)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("p", F.least("side", "_other")).withColumn("q", F.greatest("side", "_other"))
    return rows.drop("_blocks", "_other")


def map_units(rows: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each distinct value of the integer columns ``keys``, which come first in ``rows``.

    The rows are dealt by the keys and sorted within partitions; a task holds one batch and one group.
    """
    importable_on_workers(rows.sparkSession)
    short_batches(rows.sparkSession)
    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches("")
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(len(keys))):
                yield from _some(fn(pa.Table.from_batches(held)))
                held = []
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                if held and start:
                    yield from _some(fn(pa.Table.from_batches(held)))
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield from _some(fn(pa.Table.from_batches(held)))
        held.clear()
        pa.default_memory_pool().release_unused()

    return dealt.mapInArrow(run, schema)


def _some(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    if batch is not None and batch.num_rows:
        yield batch


def least_linked(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the least row number that its links lead to, itself included."""
    label = np.arange(len(linked))
    with_self = linked | np.eye(len(linked), dtype=bool)
    while True:
        found = np.where(with_self, label[None, :], len(label)).min(axis=1)
        found = np.minimum(found, found[found])
        if (found == label).all():
            return label
        label = found
