"""Near-duplicate texts: ProbMinHash signatures of weighted shingles, banding, and exact verification."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.buckets import block_pairs, least_linked, map_units
from millrace.llm.components import connected_components
from millrace.llm.shared import BoundedCache, cache_of, map_texts, written

_word_hash = cache_of("text_dedup", "words", BoundedCache(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8")), 48))
_ODD = [np.uint64((0xD6E8FEB86659FD93 * (2 * i + 3)) & (2**64 - 1) | 1) for i in range(16)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers by shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of ``width`` words (lower case, split at white space) and how often each occurs.

    A text of fewer words has one shingle of all of them; a text without words has none.
    """
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total += hashes[i : i + len(total)] * _ODD[i % 16]
    return np.unique(mix(total), return_counts=True)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (n x m, unsigned 64-bit) of n weighted sets, given as flat arrays.

    Every element is a Poisson process of rate ``weight``: its arrivals (exponential gaps) and the signature place
    that each arrival falls on come from hashes of the element and the arrival's number. A place keeps the element
    of the earliest arrival. All processes advance one arrival a round, and one ends for good as soon as it is later
    than every place of its set. Two sets agree in a place with the probability Jaccard similarity.
    """
    earliest = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    alive, time, arrival = np.arange(len(elements)), np.zeros(len(elements)), 0
    while len(alive):
        arrival += 1
        draw = mix(elements[alive] + np.uint64(arrival * int(_STEP) & (2**64 - 1)))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time = time + gap / weights[alive]
        place = (mix(draw ^ _ODD[7]) % np.uint64(m)).astype(np.int64) + owner[alive] * m
        np.minimum.at(earliest, place, time)
        won = earliest[place] == time
        winner[place[won]] = elements[alive[won]]
        latest = earliest.reshape(n, m).max(axis=1)
        still = time < latest[owner[alive]]
        alive, time = alive[still], time[still]
    return winner.reshape(n, m)


def text_features(
    docs: DataFrame, width: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, digest, bands array<long>, shingles binary)``; digest is null for texts without words.

    The digest stands for the set of shingles; ``shingles`` holds them as sorted unsigned 32-bit hashes, which
    verification compares. ``bands`` has the keys of two signatures, each once: one of equal weights, whose places agree
    with the Jaccard similarity of the distinct shingles, and one of weights 1 + ln(occurrences). The two are the same
    for a text that repeats no shingle.
    """

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches:
            digests, band_lists, sets = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            for found in _blocks((i, *shingles(t, width)) for i, t in enumerate(texts)):
                owner = np.repeat(np.arange(len(found)), [len(s) for _, s, _ in found])
                counts = np.concatenate([c for *_, c in found])
                elements = np.concatenate([s for _, s, _ in found])
                sketch = prob_minhash(elements, np.ones(len(elements)), owner, len(found), bands * rows)
                keyed = _band_keys(sketch, bands, rows)
                repeats = np.array([c.max() > 1 for *_, c in found])
                weighted = keyed.copy()
                if repeats.any():
                    some, number = repeats[owner], np.cumsum(repeats) - 1
                    weights = 1 + np.log(counts[some])
                    sketch = prob_minhash(elements[some], weights, number[owner[some]], int(repeats.sum()), bands * rows)
                    weighted[repeats] = _band_keys(sketch, bands, rows)
                for (i, s, _), equal, other in zip(found, keyed, weighted, strict=True):
                    short = np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes()
                    digests[i] = xxhash.xxh3_128_digest(short)
                    band_lists[i], sets[i] = np.unique(np.concatenate([equal, other])), short
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(digests, pa.binary()),
                    pa.array(band_lists, pa.list_(pa.int64())),
                    pa.array(sets, pa.binary()),
                ],
                ["key", "digest", "bands", "shingles"],
            )

    out = map_texts(docs, run, "digest binary, bands array<long>, shingles binary", id_col, text_col, uses="text_dedup")
    return out.withColumnRenamed("key", "doc_id")


def _band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keyed = np.zeros((len(sketch), bands), np.uint64)
    for r in range(rows):
        keyed += sketch[:, r::rows] * _ODD[r]
    return mix(keyed + np.arange(1, bands + 1, dtype=np.uint64) * _STEP).view(np.int64)


def _blocks(rows: Iterator, texts: int = 256, elements: int = 300_000) -> Iterator[list]:
    """Lists of rows (number, shingles, counts) with shingles, short enough to sketch together."""
    held, size = [], 0
    for row in rows:
        if not len(row[1]):
            continue
        held.append(row)
        size += len(row[1])
        if len(held) >= texts or size >= elements:
            yield held
            held, size = [], 0
    if held:
        yield held


def similar_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sorted distinct arrays have a Jaccard similarity of ``threshold`` or more, as a matrix."""
    sizes = np.array([len(s) for s in sets], np.float64)
    if len(sets) == 2:
        common = np.zeros((2, 2))
        common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = seen > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], number[column[keep]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for low in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            table = np.zeros((len(sets), 4096), np.float32)
            table[owner[a:b], column[a:b] - low] = 1
            common += table @ table.T
    return common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6


def near_duplicate_texts(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    bands: int = 24,
    rows: int = 5,
    block: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """``(doc_id, class_id, component_id, kept)``: one row for each input row.

    ``class_id`` is the smallest id with the same set of shingles, ``component_id`` the smallest id that links of
    Jaccard similarity ``threshold`` or more (distinct shingles of ``width`` words) lead to, and ``kept`` is true for
    one row of each component, the first by id. Signatures of ``bands`` x ``rows`` places propose pairs: those of equal
    weights propose a link of similarity s with probability 1 - (1 - s^rows)^bands, 0.9999 at 0.8, however often
    shingles repeat; those weighted by occurrences add to that, and a component often has many links.

    Rows: ids are integers (others raise a TypeError). Texts without words (null, empty) stay alone and are kept.
    Nothing is decided by id alone: rows that repeat an id stand for their own texts, and of rows that repeat id and
    text one is kept. A null id comes last in its component; classes and components of null ids only have null numbers.
    ``row_col`` names a column of distinct long numbers, which the result then has too, to find input rows again.

    Scale: copies fall together by digest, with pre-aggregation, before any pair is made; one row of each class has its
    shingles sent on. Bands with the same members count once. A bucket of any size is cut into pairs of blocks, all of
    which are verified, so there is no cap; each unit emits at most one link for each of its texts. Features, classes,
    buckets and links are written tables.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    number = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    keyed = docs.select(F.struct(F.col(f"`{id_col}`").alias("doc_id"), number.alias("row")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    features = text_features(keyed, width, bands, rows, "key", "text").withColumnRenamed("doc_id", "key")
    features = written(features.select("key.*", "digest", "bands", "shingles"), "features")

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    variants = features.where("digest is not null").groupBy("digest", "bands").agg(F.min(order).alias("first"))
    variants = written(variants, "variants")
    classes = variants.groupBy("digest").agg(
        F.min("first").alias("first"), F.count("*").alias("n"), F.min_by("bands", "first").alias("bands")
    )
    classes = written(classes.select("digest", F.col("first.row").alias("node"), F.col("first.doc_id").alias("class_id"), "n", "bands"), "classes")
    # Texts of one shingle set that repeat shingles differently have different weighted bands: all of them count.
    several = variants.select("digest", "bands").join(classes.where("n > 1").select("digest", "node"), "digest")
    several = several.select("node", F.explode("bands").alias("band")).distinct()
    banded = classes.where("n = 1").select("node", F.explode("bands").alias("band")).unionByName(several)
    found = banded.groupBy("band").agg(
        F.count("*").alias("n"),
        F.min("node").alias("least"),
        F.max("node").alias("most"),
        F.sum(F.pmod(F.xxhash64("node"), F.lit(2**40))).alias("mark"),
    )
    same = ["n", "least", "most", "mark"]
    buckets = written(found.where("n > 1").groupBy(*same).agg(F.min("band").alias("band")), "buckets")
    members = banded.join(buckets.select("band", "n"), "band")
    members = members.join(features.select(F.col("row").alias("node"), "shingles"), "node")
    units = block_pairs(members, F.col("n"), F.col("node"), block)

    def verify(unit: pa.Table) -> pa.RecordBatch | None:
        nodes = unit.column("node").to_pylist()
        sets = [np.frombuffer(s, np.uint32) for s in unit.column("shingles").to_pylist()]
        if len(nodes) < 2:
            return None
        at = sorted(range(len(nodes)), key=nodes.__getitem__)
        nodes, sets = [nodes[i] for i in at], [sets[i] for i in at]
        root = least_linked(similar_pairs(sets, threshold))
        links = [(nodes[i], nodes[r]) for i, r in enumerate(root.tolist()) if i != r]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    links = map_units(units.select("band", "p", "q", "node", "shingles"), ["band", "p", "q"], verify, "a long, b long")
    grouped = connected_components(links)
    verdicts = classes.select("digest", "node", "class_id").join(grouped, "node", "left")
    verdicts = written(verdicts.withColumn("component", F.coalesce("component", "node")), "verdicts")
    order = F.struct(F.col("class_id").isNull().alias("none"), "class_id", "node")
    # Written, so that the join has plain exchanges and a component of very many classes can be split.
    first = written(verdicts.groupBy("component").agg(F.min(order).alias("first")), "firsts")
    verdicts = verdicts.join(first, "component").select("digest", "class_id", "first")
    out = features.select("doc_id", "row", "digest").join(written(verdicts, "verdicts"), "digest", "left")
    alone = F.col("digest").isNull()
    return out.select(
        F.col("doc_id").alias(id_col),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.class_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("first.node"))).alias("kept"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )
