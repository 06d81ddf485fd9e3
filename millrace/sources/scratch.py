"""Tables written in the folder that the driver and all executors share, to cut lineage; the workers' Python path."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable_on_workers(spark: SparkSession) -> None:
    """Put this library on the Python path of the workers, where it is not installed there."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _PACKAGE_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_PACKAGE_ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which the driver and all executors share.

    Where the setting is absent (a local session, as in tests), a local temporary folder is set in its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.millrace.sharedDir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.millrace.sharedDir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``packed`` takes zstd in place of the session's codec, for tables that are as large as the input.
    """
    path = shared_dir(df.sparkSession, name)
    (df.write.option("compression", "zstd") if packed else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Deal the rows of a scan anew where it has fewer splits than the session has cores, as a table in one small file has.

    Tables of more splits, where a shuffle would cost and gain nothing, are as they were. ``scan`` has the splits to look at.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if (df if scan is None else scan).rdd.getNumPartitions() < cores else df


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`written` gave and a later one has replaced; what still reads it then fails."""
    files = df.inputFiles()
    if not files:
        return
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
