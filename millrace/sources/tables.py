"""Document registry, chunk table and point table: dedupe, upsert, delete, incremental skip."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.scratch import written


def min_text_gate(docs: DataFrame, least: int = 100) -> DataFrame:
    """Rows whose text is not null and has ``least`` characters or more."""
    return docs.where(F.length("text") >= least)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def register_documents(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """New registry rows: for each content hash the smallest id, unless the registry has the hash already.

    The smallest id per hash is a pre-aggregated minimum, so copies of any number meet in one row before the shuffle.
    """
    hashed = docs.withColumn("content_hash", content_hash(F.col("text")))
    first = hashed.groupBy("content_hash").agg(F.min_by(F.struct("doc_id", "source", "n_chars"), "doc_id").alias("row"))
    new = first.join(registry.select("content_hash"), "content_hash", "left_anti")
    return new.select("row.*", "content_hash")


def write_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk rows with a stable id and their metadata as JSON, ready for a Parquet sink."""
    meta = [c for c in chunks.columns if c not in ("doc_id", "chunk_order", "chunk_text")]
    return chunks.select(
        F.xxhash64("doc_id", "chunk_order").alias("chunk_id"),
        "doc_id",
        "chunk_order",
        "chunk_text",
        F.to_json(F.struct(*meta)).alias("metadata_json"),
    )


def sanitize_payload(rows: DataFrame, scalars: list[str], others: list[str], text: str) -> DataFrame:
    """Nulls as empty strings, nested values as JSON strings, the chunk text added."""
    flat = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in scalars]
    nested = [F.coalesce(F.to_json(c), F.lit("")).alias(c) for c in others]
    return rows.select(*flat, *nested, F.coalesce(F.col(text), F.lit("")).alias("chunk_text"))


def upsert_points(points: DataFrame, fresh: DataFrame, key: str = "vec_id", order: str | None = None) -> DataFrame:
    """``fresh`` rows replace those of equal key; idempotent.

    Of a repeated key in ``fresh`` the row of greatest ``order`` stays, of equal ones (or without ``order``) the greatest
    row, so that runs and retries agree. ``order`` is a column of ``fresh`` that need not be one of ``points``.
    """
    rest = [c for c in points.columns if c != key]
    row = F.struct(*([F.col(order).alias("_order")] if order else []), *rest)
    once = fresh.groupBy(key).agg(F.max(row).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    once = once.select(points.columns)
    return points.join(once.select(key), key, "left_anti").unionByName(once)


def delete_points(points: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return points.join(ids.select(key), key, "left_anti")


def revectorize(points: DataFrame, chunks: DataFrame, documents: DataFrame, embed, key: str = "vec_id") -> DataFrame:
    """Rebuild the points of all chunks of the given documents with ``embed``, a chunks to points function."""
    chosen = chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return upsert_points(points, embed(chosen), key)


def update_vectors(points: DataFrame, chunks: DataFrame, ids: DataFrame, embed, key: str = "vec_id") -> DataFrame:
    """Rebuild the points of the chunks whose ids are given."""
    return upsert_points(points, embed(chunks.join(ids.select(key).distinct(), key, "left_semi")), key)


def likely_in(rows: DataFrame, keys: DataFrame, columns: list[str], bits: int = 24, made: list | None = None) -> DataFrame:
    """The rows whose ``columns`` occur in ``keys``, and a few others, so that a join with ``keys`` shuffles little else.

    A written bitmap of the keys' hashes, of 2^``bits`` bits in at most 262,144 words of 64, is sent to the scan of ``rows``.
    ``made`` receives it, for a caller that discards it.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    at = {"_word": F.shiftright(place, 6), "_bit": (place % 64).cast("int")}
    words = keys.select(*[c.alias(n) for n, c in at.items()]).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    words = written(words, "bitmap")
    if made is not None:
        made.append(words)
    tested = rows.withColumns(at).join(F.broadcast(words), "_word")  # 4 MB at most
    return tested.where(F.getbit("_bits", F.col("_bit")) == 1).select(rows.columns)


def reset(points: DataFrame) -> DataFrame:
    """An empty table of the same schema, to overwrite the stored one with."""
    return points.limit(0)


def incremental_skip(chunks: DataFrame, points: DataFrame, force: bool = False, key: str = "vec_id") -> DataFrame:
    """Chunks that still need a point; all of them when forced."""
    return chunks if force else chunks.join(points.select(key), key, "left_anti")


def ingest_stats(docs: DataFrame, chunk, triplets: DataFrame, least: int = 100) -> DataFrame:
    """One row: documents processed, skipped and failed, the chunks of those processed, and their triplets.

    ``chunk`` maps documents to chunks, ``triplets(doc_id)`` are what the model replies held. A null text is an error
    of its document only, too short a text is skipped; neither has chunks, nor do its triplets count.
    """
    failed = F.col("text").isNull()
    short = ~failed & (F.length("text") < least)
    good = docs.where(~failed & ~short)
    counted = docs.agg(
        F.count_if(~failed & ~short).alias("processed"), F.count_if(short).alias("skipped"), F.count_if(failed).alias("errors")
    )
    chunks = chunk(good).agg(F.count("*").alias("chunks"))
    found = triplets.join(good.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("triplets"))
    return counted.join(chunks, F.lit(True)).join(found, F.lit(True))  # one row each


def append_query_log(rows: DataFrame, path: str, batch: int) -> None:
    """Append one numbered batch of log rows; the same batch again, as after a failure, replaces itself."""
    out = rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("batch").parquet(path)


def query_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The log's rows, of all batches."""
    return spark.read.schema(schema).parquet(path).select(schema.fieldNames())


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Add the place of each row, from 1, among those of equal ``keys`` (of all rows without keys) in the given order.

    Rows are dealt by ranges of keys and order and written; each range numbers its own, and the counts of the ranges
    before, one row for each range and key, are added. So no task gets a whole key, whatever share of the rows it has.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    counts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    gone = counts.select(
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_gone"), *[F.col(k).alias(f"_of_{k}") for k in ["_range", *keys]]
    )
    inside = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in ["_range", *keys]]
    place = (F.col("_own") + F.col("_gone")).cast("long")
    return inside.join(gone, same).select(*rows.columns, place.alias(name))


def newest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
