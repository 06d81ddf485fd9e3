"""Near-duplicate embeddings: spherical-cap filters from random product codes, a join on filters, verification."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.buckets import block_pairs, least_linked, map_units
from millrace.llm.components import connected_components
from millrace.llm.shared import importable_on_workers, short_batches, written


class CapFilters:
    """Filter directions (c_i, d_j) / sqrt 2 of two random codebooks, in ``tables`` independent rotations.

    A vector belongs to every filter whose cap holds it (inner product at least the cap's height), and to its
    ``least`` best filters where fewer do. The height is set so that a random vector exceeds ``expected`` filters of
    a table on average, whatever the size of the codebooks. Listing them looks only at codes that reach the height with
    the other block's best one.
    """

    def __init__(self, dims: int, codes: int, tables: int = 2, expected: float = 10.0, least: int = 6, seed: int = 5):
        rng = np.random.default_rng([seed, dims, codes])
        self.codes, self.tables, self.least = codes, tables, min(least, codes)
        self.half = dims // 2
        self.rotations, self.books = [], []
        for _ in range(tables):
            self.rotations.append(np.linalg.qr(rng.normal(size=(dims, dims)))[0])
            books = [rng.normal(size=(codes, d)) for d in (self.half, dims - self.half)]
            self.books.append([b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12) for b in books])
        probe = rng.normal(size=(512, dims))
        self.height = self._height(probe / np.linalg.norm(probe, axis=1, keepdims=True), expected)

    def _height(self, probe: np.ndarray, expected: float, products: int = 1 << 21) -> float:
        """The height that ``expected`` sums of a probe's two products reach on average, by bisection over counts of all sums.

        Of each block the 1024 greatest products are kept, more than such sums can come from.
        """
        rows, kept = max(1, products // self.codes), min(1024, self.codes)
        pairs = (self._products(probe[low : low + rows], 0) for low in range(0, len(probe), rows))
        parts = [[np.sort(np.partition(x, -kept, axis=1)[:, -kept:], axis=1) for x in pair] for pair in pairs]
        first, order = (np.concatenate(x) for x in zip(*parts, strict=True))
        least, most = 0.0, float(first.max() + order.max())
        for _ in range(40):
            middle = (least + most) / 2
            reaching = 0
            for one, two in zip(first, order, strict=True):
                lead = one[one >= middle - two[-1]]  # others reach it with no second product
                reaching += len(lead) * len(two) - int(np.searchsorted(two, middle - lead).sum())
            least, most = (middle, most) if reaching > expected * len(first) else (least, middle)
        return most

    def _products(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotations[table]
        one, two = self.books[table]
        return turned[:, : self.half] @ one.T, turned[:, self.half :] @ two.T

    def decode(self, unit: np.ndarray, products: int = 1 << 21) -> list[np.ndarray]:
        """Sorted filter numbers of each row of unit vectors; slices of rows keep to about ``products`` products at a time."""
        rows = max(1, products // self.codes)
        if len(unit) > rows:
            return [f for low in range(0, len(unit), rows) for f in self.decode(unit[low : low + rows], products)]
        out: list[list[np.ndarray]] = [[] for _ in unit]
        for table in range(self.tables):
            first, second = self._products(unit, table)
            best = [-np.sort(-np.partition(x, -self.least, axis=1)[:, -self.least :], axis=1) for x in (first, second)]
            for r, (one, two) in enumerate(zip(first, second, strict=True)):
                top = best[0][r][:, None] + best[1][r][None, :]
                height = min(self.height, np.partition(top, -self.least, axis=None)[-self.least]) - 1e-12  # for differences rounded up
                i = np.flatnonzero(one >= height - best[1][r][0])  # no other code reaches the height
                j = np.flatnonzero(two >= height - best[0][r][0])
                j = j[np.argsort(-two[j])]
                ends = np.searchsorted(-two[j], -(height - one[i]), side="right")
                codes = j[np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)]
                out[r].append(np.sort((table * self.codes + np.repeat(i, ends)) * self.codes + codes))
        return [np.concatenate(x) for x in out]


@lru_cache(maxsize=4)
def cap_filters(dims: int, codes: int) -> CapFilters:
    """The filters of one size, made once in a worker process."""
    return CapFilters(dims, codes)


def codes_for(rows: int, expected: float = 10.0, bucket: int = 64) -> int:
    """Codebook size under which a group of ``rows`` random vectors has about ``bucket`` of them in each filter."""
    return int(min(32_000, max(16, np.ceil(np.sqrt(rows * expected / bucket)))))


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    block: int = 512,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    codes: int | None = None,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row for each input row.

    Two vectors are linked if their labels are equal and not null and their cosine, in double precision, is at least
    ``threshold``. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that links
    lead to and ``kept`` says whether that is the row's own id.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with a
    null label; they have 0 links and are their own component. Vectors of different lengths never link. Rows with a
    null id have 0 links, a null component and are kept. Rows that repeat an id share one verdict by vector.

    Equal vectors of a label fall together first (pre-aggregated), so copies make no pairs. Each remaining vector is
    sent once to every filter it belongs to; a filter's bucket of any size is cut into pairs of blocks, all of which
    are compared, and a pair that shares several filters counts in the smallest of them only. A unit emits one
    count and at most one link for each of its vectors, never its pairs.
    """
    importable_on_workers(vectors.sparkSession)
    short_batches(vectors.sparkSession)
    # Vectors travel in their own precision and are computed with in double.
    packing = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
    )
    sound = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = sound & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec").isNotNull()
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keyed = rows.withColumn("class", F.when(F.col("sound"), F.sha2(F.to_json(F.struct("label", "v")), 256)))
    classes = (
        keyed.where("sound")
        .groupBy("class")
        .agg(F.min("vec").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    )
    classes = written(classes, "classes")
    shapes = classes.groupBy("label", F.size("v").alias("dims")).agg(F.count("*").alias("n"))
    most = shapes.agg(F.max("n")).first()[0] or 0
    n_codes = codes or codes_for(most)

    def list_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column("v").to_pylist(), {}
            filters: list = [None] * len(lists)
            packed = [np.array(v, packing).tobytes() for v in lists]
            for i, v in enumerate(lists):
                sizes.setdefault(len(v), []).append(i)
            for dims, at in sizes.items():
                table = _unit(np.array([lists[i] for i in at]))
                found = cap_filters(dims, n_codes).decode(table) if dims > 1 else [np.zeros(1, np.int64)] * len(at)
                for i, f in zip(at, found, strict=True):
                    filters[i] = f
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("label"),
                    batch.column("copies"),
                    pa.array(packed, pa.binary()),
                    pa.array(filters, pa.list_(pa.int32())),
                ],
                ["node", "label", "copies", "vector", "filters"],
            )

    schema = "node long, label string, copies long, vector binary, filters array<int>"
    listed = written(classes.select("node", "label", "copies", "v").mapInArrow(list_filters, schema), "filters")
    exploded = listed.withColumn("filter", F.explode("filters"))
    bucket = F.xxhash64("label", F.length("vector"), "filter")
    sizes = exploded.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where("n > 1")
    members = exploded.withColumn("bucket", bucket).join(written(sizes, "sizes"), "bucket")
    units = block_pairs(members, F.col("n"), F.col("node"), block)
    names = ["bucket", "p", "q", "side", "filter", "node", "label", "copies", "vector", "filters"]

    def compare(unit: pa.Table) -> pa.RecordBatch | None:
        column = {n: unit.column(n) for n in ("node", "side", "filter", "copies", "label")}
        node, side, here, copies = (column[n].to_numpy() for n in ("node", "side", "filter", "copies"))
        if len(node) < 2:
            return None
        order = np.argsort(node, kind="stable")
        node, side, here, copies = node[order], side[order], here[order], copies[order].astype(np.float64)
        label = np.unique(column["label"].to_numpy()[order], return_inverse=True)[1]
        raw = unit.column("vector").to_pylist()
        table = _unit(np.stack([np.frombuffer(raw[i], packing) for i in order]).astype(np.float64))
        lists = unit.column("filters").to_pylist()
        linked = table @ table.T >= threshold
        np.fill_diagonal(linked, False)
        linked &= (label[:, None] == label[None, :]) & (here[:, None] == here[None, :])  # should bucket hashes collide
        if unit.column("p")[0] != unit.column("q")[0]:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return None
        first = linked & ~_share_earlier([lists[i] for i in order], here)
        count = first.astype(np.float64) @ copies
        root = node[least_linked(linked)]
        return pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(count.astype(np.int64)), pa.array(root)], ["node", "links", "root"]
        )

    found = map_units(units.select(*names), ["bucket", "p", "q"], compare, "node long, links long, root long")
    found = written(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    verdicts = classes.select("class", "node", "copies").join(counts, "node", "left").join(grouped, "node", "left")
    verdicts = verdicts.select(
        "class",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    out = keyed.select("vec", "class").join(written(verdicts, "verdicts"), "class", "left")
    return out.select(
        F.col("vec").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _unit(table: np.ndarray) -> np.ndarray:
    """Rows of length 1; dividing by the largest component first keeps the squares of extreme values finite."""
    table = table / np.abs(table).max(axis=1, keepdims=True)
    return table / np.linalg.norm(table, axis=1, keepdims=True)


def _share_earlier(lists: list[list[int]], here: np.ndarray) -> np.ndarray:
    """Whether two members share a filter smaller than the one they meet in."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate([np.array(x, np.int64) for x in lists])
    keep = flat < here[owner]
    owner, flat = owner[keep], flat[keep]
    if not len(flat):
        return np.zeros((len(lists), len(lists)), bool)
    column = np.unique(flat, return_inverse=True)[1]
    member = np.zeros((len(lists), column.max() + 1), np.float32)
    member[owner, column] = 1
    return member @ member.T > 0
