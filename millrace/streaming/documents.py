"""Documents that arrive, change and are withdrawn, as a stream into versioned tables that retrieval reads."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.scratch import discard, written
from millrace.sources.tables import content_hash, likely_in

VERSIONS = "doc_id long, content_hash string, version long, bucket string, batch long"
CONTENTS = "content_hash string, bucket string, batch long"
_PREFIX = 2  # hexadecimal digits: 256 buckets


def _bucket(hashed: Column) -> Column:
    return F.substring(hashed, 1, _PREFIX)


def _doc_bucket(doc_id: str) -> Column:
    return _bucket(F.lpad(F.hex(F.pmod(F.xxhash64(doc_id), F.lit(16**_PREFIX))), _PREFIX, "0"))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, an empty one where nothing has been written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def touched(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The partitions of ``table`` whose ``bucket`` occurs in ``rows``; at most 256 names are asked for, and pruned by."""
    names = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
    return table.where(F.col("bucket").isin(names))


def _replace(rows: DataFrame, path: str) -> None:
    """Write a batch's own partitions in place of what an earlier attempt of the same batch left there.

    Rows meet by bucket, so that a bucket is one file, unless adaptive execution finds it too large.
    """
    out = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.option("compression", "zstd").partitionBy("bucket", "batch").parquet(path)


def add_documents(arrived: DataFrame, number: int, registry: str, chunks: str, chunk: Callable[[DataFrame], DataFrame], order: str | None = None) -> None:
    """Take in one batch of ``(doc_id, text)``: new, changed, withdrawn (null text) and unchanged documents, and copies.

    Three tables grow. ``<registry>/versions`` says which content a document has had since which batch, null for withdrawn;
    ``<registry>/contents`` lists the contents that have been chunked; ``chunks`` has the chunks of each content once,
    whichever documents hold it. All are partitioned by a prefix of a hash, so a batch reads only the partitions that
    its rows fall into, and by batch. A document of a batch that is there several times has the row of greatest
    ``order`` (of equal ones, or without it, that of greatest content hash). Rows with a null id are left out.

    Which texts are new is found by hashes alone. Only the new ones are shuffled, once, to leave one of each, and
    ``chunk`` gets them by content, with the hash as their ``doc_id``, so that its chunks meet no other table.

    A document whose content is as it was adds nothing. Versions come last and make the rest visible; a batch that is
    replayed after a failure ignores and replaces what it wrote under its number, so it changes nothing.
    """
    spark = arrived.sparkSession
    hashed = arrived.where("doc_id IS NOT NULL").withColumn("content_hash", content_hash(F.col("text")))
    newest = F.struct(*([F.col(order)] if order else []), "content_hash")
    once = hashed.groupBy("doc_id").agg(F.max(newest).alias("d")).select("doc_id", "d.content_hash")
    once = written(once.withColumn("bucket", _doc_bucket("doc_id")), "arrived")

    before = touched(stored(spark, f"{registry}/versions", VERSIONS), once).where(F.col("batch") != number)
    held = before.groupBy("doc_id").agg(F.max(F.struct("version", "content_hash")).alias("v")).select("doc_id", F.col("v.content_hash").alias("was"), F.lit(True).alias("known"))
    known = F.coalesce("known", F.lit(False))
    changed = ~F.col("was").eqNullSafe(F.col("content_hash")) | (~known & F.col("content_hash").isNotNull())
    versions = once.join(held, "doc_id", "left").where(changed)
    versions = written(versions.select("doc_id", "content_hash", F.lit(number).cast("long").alias("version"), "bucket"), "versions")

    wanted = once.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    wanted = wanted.withColumn("bucket", _bucket(F.col("content_hash")))
    done = touched(stored(spark, f"{registry}/contents", CONTENTS), wanted).where(F.col("batch") != number)
    wanted = written(wanted.join(done, "content_hash", "left_anti"), "wanted")
    key, made = ["doc_id", "content_hash"], []
    texts = likely_in(hashed.select(*key, "text"), wanted, key, made=made).dropDuplicates(key)
    fresh = written(texts.join(wanted, key, "left_semi").select("content_hash", "text"), "fresh", packed=True)
    pieces = chunk(fresh.select(F.col("content_hash").alias("doc_id"), "text")).withColumnRenamed("doc_id", "content_hash")
    pieces = pieces.withColumn("bucket", _bucket(F.col("content_hash")))

    batch = F.lit(number).cast("long")
    _replace(pieces.withColumn("batch", batch), chunks)
    _replace(wanted.select("content_hash", "bucket").withColumn("batch", batch), f"{registry}/contents")
    _replace(versions.withColumn("batch", batch), f"{registry}/versions")
    for table in (once, versions, wanted, fresh, *made):
        discard(table)


def stream_new_documents(
    spark: SparkSession,
    folder: str,
    schema: str,
    registry: str,
    chunks: str,
    checkpoint: str,
    chunk: Callable[[DataFrame], DataFrame],
    order: str | None = None,
) -> StreamingQuery:
    """:func:`add_documents` for the Parquet files that arrive in ``folder``, a micro-batch at a time."""
    arriving = spark.readStream.schema(schema).parquet(folder)

    def take(batch: DataFrame, number: int) -> None:
        add_documents(batch, number, registry, chunks, chunk, order)

    return arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_documents(spark: SparkSession, registry: str) -> DataFrame:
    """``(doc_id, content_hash)`` of every document that is not withdrawn, as its last version has it."""
    rows = stored(spark, f"{registry}/versions", VERSIONS).groupBy("doc_id").agg(F.max(F.struct("version", "content_hash")).alias("v"))
    return rows.select("doc_id", "v.content_hash").where("content_hash IS NOT NULL")


def current_contents(spark: SparkSession, registry: str) -> DataFrame:
    """``(content_hash, doc_id, holders)``: contents in use, the smallest document that has each, and how many have it."""
    return current_documents(spark, registry).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("holders"))


def current_chunks(spark: SparkSession, registry: str, chunks: str) -> DataFrame:
    """The chunks of :func:`current_contents`: nothing of a text that no document holds any more."""
    rows = spark.read.parquet(chunks).drop("bucket", "batch")
    return rows.join(current_contents(spark, registry).drop("holders"), "content_hash")


def compact(spark: SparkSession, registry: str, chunks: str, new_registry: str, new_chunks: str) -> None:
    """Write current versions, contents and chunks as single batches (number -1) of new tables, without what is withdrawn."""
    batch = F.lit(-1).cast("long")
    live = current_documents(spark, registry)
    versions = live.select("doc_id", "content_hash", batch.alias("version"), _doc_bucket("doc_id").alias("bucket"))
    contents = live.select("content_hash", _bucket(F.col("content_hash")).alias("bucket")).distinct()
    kept = spark.read.parquet(chunks).join(contents.select("content_hash"), "content_hash", "left_semi")
    for rows, path in ((kept, new_chunks), (contents, f"{new_registry}/contents"), (versions, f"{new_registry}/versions")):
        _replace(rows.withColumn("batch", batch), path)
