"""Context-triggered piecewise hashing: text fingerprints from pieces that a rolling hash cuts, compared by edit distance."""

import hashlib
import string
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.shared import importable_on_workers, keep_caches, map_texts, short_batches, slices, written

WINDOW = 7  # bytes that the rolling hash sees
LEAST = 2  # the smallest block size is 2^2 bytes
PIECES = 64  # in a signature, at most
_BASE = 0x01000193
_SIGNS = string.ascii_letters + string.digits + "+/"
_BLOCK = 1 << 20


def boundaries(data: bytes, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places behind which a piece of block size 2^``least`` ends, and the greatest exponent for which each is one.

    The hash of the last 7 bytes (zeros before the text), mixed, ends a piece of block size 2^k where its k low bits are all
    ones; so pieces of a larger block size are unions of smaller ones. The text is taken in blocks of 1 MB.
    """
    for low in range(0, len(data), _BLOCK):
        lead = min(low, WINDOW - 1)
        part = np.frombuffer(data, np.uint8, min(_BLOCK + lead, len(data) - low + lead), low - lead).astype(np.uint32)
        rolled, factor = part.copy(), 1
        for back in range(1, WINDOW):
            factor = factor * _BASE & 0xFFFFFFFF
            rolled[back:] += part[:-back] * np.uint32(factor)
        rolled = rolled[lead:]
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(0x2C1B3C6D)
        rolled ^= rolled >> np.uint32(12)
        ones = np.uint32((1 << least) - 1)
        at = np.flatnonzero(rolled & ones == ones)
        zero_bits = ~rolled[at].astype(np.int64) & 0xFFFFFFFF
        lowest = zero_bits & -zero_bits  # 0 if all 32 bits are ones
        yield at + low + 1, np.where(lowest > 0, np.frexp(lowest.astype(np.float64))[1] - 1, 32)


def fingerprints(texts: list[str]) -> list[str]:
    """``k:signature:signature`` of each text: one sign for each piece of block size 2^k, and of 2^(k + 1).

    k is the smallest exponent, 2 at least, under which the text has at most 64 pieces, the last one included even if no
    boundary ends it. A sign is six bits of the piece's checksum. Only the text decides, all of it, in UTF-8; the empty one
    has ``2::``. Short texts are hashed together, apart by zeros; of a long one the boundaries are counted first and only
    those of its block sizes are kept.
    """
    out, held, size = [], [], 0
    for text in texts:
        data = text.encode("utf-8")
        if held and size + len(data) > _BLOCK:
            out += _together(held)
            held, size = [], 0
        held.append(data)
        size += len(data) + WINDOW
    return out + _together(held)


def _together(held: list[bytes]) -> list[str]:
    if len(held) == 1 and len(held[0]) > _BLOCK:
        data = held[0]
        counts = sum(np.bincount(levels[places < len(data)], minlength=33) for places, levels in boundaries(data))
        k = _exponent(counts)
        places, levels = (np.concatenate(x) for x in zip(*boundaries(data, k), strict=True))
        return [_signed(data, k, places, levels)]
    found = [*boundaries(bytes(WINDOW - 1).join(held))]
    places, levels = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    starts = np.cumsum([0, *(len(data) + WINDOW - 1 for data in held)])[:-1]
    low = np.searchsorted(places, starts, side="right")
    high = np.searchsorted(places, starts + [len(data) for data in held], side="right")
    out = []
    for data, start, a, b in zip(held, starts.tolist(), low.tolist(), high.tolist(), strict=True):
        ends, own = places[a:b] - start, levels[a:b]
        k = _exponent(np.bincount(own[ends < len(data)], minlength=33))
        out.append(_signed(data, k, ends, own))
    return out


def _exponent(counts: np.ndarray) -> int:
    """The smallest exponent under which at most 63 boundaries lie within, from their number by greatest exponent."""
    k, left = LEAST, int(counts[LEAST:].sum())
    while left > PIECES - 1:
        left -= int(counts[k])
        k += 1
    return k


def _signed(data: bytes, k: int, ends: np.ndarray, levels: np.ndarray) -> str:
    return f"{k}:{_signature(data, ends[levels >= k])}:{_signature(data, ends[levels >= k + 1])}"


def _signature(data: bytes, ends: np.ndarray) -> str:
    cuts = [0, *ends.tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    view = memoryview(data)
    return "".join([_SIGNS[(zlib.crc32(view[a:b]) * 0x9E3779B1 >> 26) & 63] for a, b in pairwise(cuts)])


def likeness(one: str, two: str) -> float:
    """Likeness of two fingerprints, 0 to 1: the best over their signatures of equal block size; 1 for equal fingerprints.

    Of signatures with lengths m and n and least number d of insertions and deletions that turn one into the other it is
    1 - d / (m + n), but 0 if they have no run of four signs (half the shorter one if that is less, two at least) in
    common, which signatures of unrelated texts seldom have. Block sizes that differ more than twofold give 0.
    """
    if one == two:
        return 1.0
    (k, a, a2), (m, b, b2) = one.split(":"), two.split(":")
    first, second = {int(k): a, int(k) + 1: a2}, {int(m): b, int(m) + 1: b2}
    return max((_alike(first[x], second[x]) for x in first.keys() & second.keys()), default=0.0)


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    short = min(len(a), len(b))
    run = min(short, max(2, min(4, short // 2)))
    if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * longest_common(a, b) / (len(a) + len(b))


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence; m + n less twice that is the insertion and deletion distance.

    One bit for each sign of ``a``; a bit is cleared where the row of the usual table steps up.
    """
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, fingerprint)``: the fingerprint of every whole text; a narrow map.

    Null texts have a null fingerprint; ids of any type, null or repeated, come back as they are as ``key``. An empty table
    gives no rows.
    """

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches:
            found = pa.array(fingerprints([t or "" for t in texts]), pa.string(), mask=np.array([t is None for t in texts], bool))
            yield pa.RecordBatch.from_arrays([keys, found], ["key", "fingerprint"])

    return map_texts(docs, run, "fingerprint string", id_col, text_col)


_COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
_WALKED = f"part int, side int, text string, {_COMPARED}"


def spliced(text: str, following: str) -> str:
    """``text``, its last half (rounded down) replaced by the first as many characters, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, a row for each document.

    The edited text of a document is :func:`spliced` of it and the next one's, in ascending order of id (null ids first,
    rows of equal id in order of a hash of their texts and then the texts; after the last comes the first, which is the
    document itself if there is but one). ``near_edited`` and ``near_next`` are the :func:`likeness` of its fingerprint to
    those of its edited text and of the next document. Null texts count as empty, of fingerprint ``2::``.

    Texts are dealt by ranges of id and hash in one shuffle, so repeated or null ids spread too, and stream in order
    through the tasks, which hold a document and the next. Each range gives out its first and last text besides; only
    those of neighbouring ranges are joined.
    """
    spark = docs.sparkSession
    importable_on_workers(spark)
    short_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    ranged = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").withColumn("part", F.spark_partition_id())

    schema = to_arrow_schema(StructType.fromDDL(_WALKED))

    def compared(pairs: list[tuple]) -> list[dict]:
        """Results of (part, id, text, fingerprint, next text, its fingerprint)."""
        edited = [spliced(one, two) for _, _, one, _, two, _ in pairs]
        return [
            {
                "part": part,
                "side": 0,
                "doc_id": key,
                "n_chars": len(one),
                "edited_sha256": hashlib.sha256(text.encode("utf-8")).hexdigest(),
                "fingerprint": mark,
                "edited_fingerprint": changed,
                "near_edited": likeness(mark, changed),
                "near_next": likeness(mark, mark_two),
            }
            for (part, key, one, mark, _, mark_two), text, changed in zip(pairs, edited, fingerprints(edited), strict=True)
        ]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of side 0 for each document but the range's last; its first text with side 1 and its last with side 2."""
        keep_caches("")
        held = []
        for batch in batches:
            for piece in slices(batch, 256):
                keys, texts, parts = (piece.column(c).to_pylist() for c in ("id", "text", "part"))
                rows = [*held, *zip(parts, keys, texts, fingerprints(texts), strict=True)]
                out = compared([(*row, *after[2:]) for row, after in pairwise(rows)])
                if not held:
                    part, key, text, mark = rows[0]
                    out.append({"part": part, "side": 1, "doc_id": key, "text": text, "fingerprint": mark})
                held = rows[-1:]
                yield pa.RecordBatch.from_pylist(out, schema)
            pa.default_memory_pool().release_unused()
        for part, key, text, mark in held:
            yield pa.RecordBatch.from_pylist([{"part": part, "side": 2, "doc_id": key, "text": text, "fingerprint": mark}], schema)

    found = written(ranged.select("id", "text", "part").mapInArrow(walk, _WALKED), "fingerprints")
    parts = sorted(r.part for r in found.where("side = 1").select("part").collect())  # a number for each range
    follows = spark.createDataFrame([*zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next int")
    last = found.where("side = 2").select("part", F.col("doc_id").alias("id"), F.col("text").alias("one"), F.col("fingerprint").alias("mark"))
    first = found.where("side = 1").select(F.col("part").alias("next"), F.col("text").alias("two"), F.col("fingerprint").alias("mark_two"))
    borders = last.join(follows, "part").join(first, "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 16):
                yield pa.RecordBatch.from_pylist(compared([tuple(row.values()) for row in piece.to_pylist()]), schema)

    closed = borders.select("part", "id", "one", "mark", "two", "mark_two").mapInArrow(close, _WALKED)
    names = [c.split()[0] for c in _COMPARED.split(", ")]
    return found.where("side = 0").select(names).unionByName(closed.select(names))
