"""Token ids as flat unsigned integer files with 64-bit document offsets, read by memory map."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import importable_on_workers, keep_caches, shared_dir, short_batches, slices, written
from millrace.llm.word_ids import WordIds


_MANIFEST = pa.schema(
    [("part", pa.int32()), ("stem", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("nulls", pa.int64())]
)


def _width(tokenizer_path: str, end_id: int) -> str:
    size = WordIds.load(tokenizer_path).vocabulary_size
    return "<u2" if max(size - 1, end_id) < 2**16 else "<u4"


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None
) -> list[dict]:
    """Encode every text, ``end_id`` behind it, and write the ids in ascending order of id; returns the list of files.

    Each has three flat files: ``.bin`` the ids, 16 bits wide if the vocabulary allows, ``.off`` 64-bit document offsets
    within the file (one more than documents) and ``.doc`` the 64-bit ids of documents. Ids are cast to whole numbers (what is
    none is an error in ANSI mode, else null); null ids come first and their number is listed. Rows of equal id lie in order of
    a hash of their texts and then the texts; null texts count as empty.

    Texts are dealt by ranges of id and hash in one shuffle, in as many files as that has partitions (or ``files``, at
    most), so files do not grow with the table and rows that repeat an id, or have none, spread over them. A task encodes and
    streams its range to temporary names, closes and renames them, so a retried task replaces its own files. ``base``, the ids
    in all files before, is the prefix sum of the files' counts, a row for each file.
    """
    spark = docs.sparkSession
    importable_on_workers(spark)
    short_batches(spark)
    folder, kind = shared_dir(spark, "tokens"), _width(tokenizer_path, end_id)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    dealt = rows.repartitionByRange("id", "h") if files is None else rows.repartitionByRange(files, "id", "h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_caches("word_ids")
        encoder = WordIds.load(tokenizer_path)
        task = TaskContext.get()
        part = task.partitionId()
        store, root = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        stem = f"{root}/part-{part:06d}"
        suffix = f".{task.taskAttemptId()}.tmp"
        end = np.array([end_id], kind).tobytes()
        docs, ids, nulls = 0, 0, 0
        streams = {x: store.open_output_stream(f"{stem}{x}{suffix}") for x in (".bin", ".off", ".doc")}
        streams[".off"].write(np.zeros(1, "<i8").tobytes())
        for batch in batches:
            for piece in slices(batch, 512):
                keys, lengths = piece.column(0), []
                for found in encoder.encode(piece.column(1).to_pylist()):
                    streams[".bin"].write(np.frombuffer(found, "<u4").astype(kind).tobytes() + end)
                    lengths.append(len(found) // 4 + 1)
                streams[".off"].write((ids + np.cumsum(np.array(lengths, np.int64))).astype("<i8").tobytes())
                streams[".doc"].write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                docs, ids, nulls = docs + len(keys), ids + sum(lengths), nulls + keys.null_count
            pa.default_memory_pool().release_unused()
        for x, stream in streams.items():
            stream.close()
            if store.get_file_info(stem + x).type != arrow_fs.FileType.NotFound:  # of an attempt that was lost
                store.delete_file(stem + x)
            store.move(f"{stem}{x}{suffix}", stem + x)
        if docs:
            row = {"part": part, "stem": stem, "docs": docs, "ids": ids, "nulls": nulls}
            yield pa.RecordBatch.from_pylist([row], _MANIFEST)

    ordered = dealt.sortWithinPartitions("id", "h", "text").select("id", "text")
    listed = written(ordered.mapInArrow(write, "part int, stem string, docs long, ids long, nulls long"), "manifest")
    manifest, base = [], 0
    for row in sorted(listed.collect(), key=lambda r: r.part):
        manifest.append(row.asDict() | {"base": base, "folder": folder, "kind": kind})
        base += row.ids
    return manifest


def read_token_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files, by memory map; ids as little-endian unsigned 32-bit integers.

    One task for each file; it emits bounded batches, so only the pages in use are in memory.
    """
    importable_on_workers(spark)
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                yield from _read(manifest[at])

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(read, schema)


def _mapped(store: arrow_fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the store is a mounted one, else read."""
    if isinstance(store, arrow_fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    return np.frombuffer(store.open_input_file(path).readall(), kind)


def _read(entry: dict) -> Iterator[pa.RecordBatch]:
    store, _ = arrow_fs.FileSystem.from_uri(entry["folder"])
    ids = _mapped(store, entry["stem"] + ".bin", entry["kind"])
    offsets = _mapped(store, entry["stem"] + ".off", "<i8")
    docs = _mapped(store, entry["stem"] + ".doc", "<i8")
    for low in range(0, len(docs), 512):
        high = min(low + 512, len(docs))
        ends = np.asarray(offsets[low : high + 1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.asarray(docs[low:high]), pa.int64(), mask=np.arange(low, high) < entry["nulls"]),
                pa.array(entry["base"] + ends[:-1]),
                pa.array(np.diff(ends)),
                pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
            ],
            ["doc_id", "start", "n_tokens", "ids"],
        )


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write and read back: see the two functions. An empty table gives no rows."""
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer_path, end_id))
