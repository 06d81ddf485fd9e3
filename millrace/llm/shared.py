"""What the operators of this package share: the shared folder, written tables and Arrow batch maps."""

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import importable_on_workers, shared_dir, written

__all__ = ["BoundedCache", "BoundedTable", "cache_of", "keep_caches", "importable_on_workers", "map_texts", "shared_dir", "short_batches", "slices", "written"]


def short_batches(spark: SparkSession, most: str = "8m") -> None:
    """Lower the session's default of 64 MB for an Arrow batch; a session with a setting of its own keeps that.

    The JVM and the worker each hold a batch several times over while they convert it, for each task of an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:  # nobody has set it
        spark.conf.set(name, most)


def map_texts(
    docs: DataFrame,
    fn: Callable[[Iterator[tuple[pa.Array, list[str | None]]]], Iterator[pa.RecordBatch]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry_row: bool = False,
    uses: str = "",
) -> DataFrame:
    """Apply ``fn`` to batches of (id column, texts); it yields record batches of the columns in ``schema``.

    ``fn`` receives one iterator per task and yields one batch for each batch it takes. With ``carry_row`` the
    first array is the whole input row as a struct, which lets a caller keep every input column whatever its name.
    Both forms need no shuffle. ``uses`` names the group of worker caches that ``fn`` needs; all others are emptied.
    """
    importable_on_workers(docs.sparkSession)
    short_batches(docs.sparkSession)
    if carry_row:
        narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("key"))
        where = docs.columns.index(text_col)
    else:
        narrow = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
        where = None
    key_type = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches(uses)

        def pairs() -> Iterator[tuple[pa.Array, list[str | None]]]:
            for batch in batches:
                for part in slices(batch):
                    key = part.column(0)
                    texts = part.column(1) if where is None else key.field(where)
                    yield key, texts.to_pylist()
                del batch, part, key, texts
                pa.default_memory_pool().release_unused()

        yield from fn(pairs())
        pa.default_memory_pool().release_unused()  # the worker stays, its buffers need not

    return narrow.mapInArrow(run, f"key {key_type}, {schema}")


def slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Short slices of a batch, so that intermediate arrays stay small whatever the batch size is."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


_CACHES: dict[tuple[str, str], dict] = {}


def cache_of(group: str, name: str, cache: dict) -> dict:
    """Register a cache that lives as long as the worker process, in place of an earlier one of that group and name.

    Functions that Spark sends to workers get copies of the module-level objects they mention, so a cache must be
    reached through a function or class of its module, which workers import.
    """
    old = _CACHES.pop((group, name), None)
    if old is not None:
        old.clear()
    _CACHES[group, name] = cache
    return cache


def keep_caches(group: str) -> None:
    """Empty the caches of all other groups: a worker that serves one operator after another holds one's at a time."""
    for (owner, _), cache in _CACHES.items():
        if owner != group:
            cache.clear()


PLACE = 100  # bytes that a pair takes in a dictionary and in the memory manager, besides its objects


class BoundedCache(dict):
    """A dictionary that fills itself with ``make(key)`` and starts afresh when it holds about ``megabytes``.

    Keys and values are counted with their objects' sizes and a dictionary place each. The results never depend on
    what is cached; the bound keeps a worker's memory fixed on any vocabulary and any length of words.
    """

    def __init__(self, make: Callable, megabytes: float = 48):
        super().__init__()
        self.make, self.limit, self.held = make, int(megabytes * 2**20), 0

    def __missing__(self, key):
        value = self.make(key)
        cost = PLACE + sys.getsizeof(key) + sys.getsizeof(value)
        if self.held + cost > self.limit:
            self.clear()
        self.held += cost
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.held = 0


class BoundedTable(dict):
    """A dictionary that is filled slice by slice and holds about ``megabytes``, or one slice's entries if that is more.

    When it would hold more, it keeps the entries that the present slice uses, so frequent ones stay.
    """

    def __init__(self, megabytes: float = 64):
        super().__init__()
        self.limit, self.held = int(megabytes * 2**20), 0

    def add(self, new: dict, used: Callable[[], set]) -> None:
        """Add entries; ``used`` gives the keys of the present slice, if they are needed."""
        cost = self._size(new)
        if self.held + cost > self.limit:
            kept = {key: self[key] for key in used() if key in self}
            self.clear()
            self.update(kept)
            self.held = self._size(kept)
        self.held += cost
        self.update(new)

    @staticmethod
    def _size(pairs: dict) -> int:
        return sum(map(sys.getsizeof, pairs)) + sum(map(sys.getsizeof, pairs.values())) + PLACE * len(pairs)

    def clear(self) -> None:
        super().clear()
        self.held = 0
