"""Session settings and the shared working folder."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the work per row is heavy: rather small tasks than idle cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
    # top-k frequent tokens keeps up to 3000 ranks per language
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # long texts: keep the Arrow batches of vocabulary lookups small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app="duolex", master=None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="duolex-")
        atexit.register(shutil.rmtree, path, True)
        context.setCheckpointDir(path)
    return path


_WRITTEN = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def drop_stage_tables(spark: SparkSession) -> int:
    """Delete what this process wrote below the shared folder.  Call it when the
    results are saved: tables that read from there are lost."""
    hadoop, deleted = spark._jvm.org.apache.hadoop.fs, 0
    while _WRITTEN:
        path = hadoop.Path(_WRITTEN.pop())
        deleted += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return deleted


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage,
    survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` if it proves to have at most ``max_rows`` rows, else
    return it as it is, so that the join shuffles."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


BATCH_BYTES = 1 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, for a Python function to read: from now on its session sends Python at most
    about ``BATCH_BYTES`` at a time, or what is set if that is less.

    The rows of a batch are counted as well, but texts differ in length; a worker holds
    several copies of its batch, one worker a core.
    """
    spark = df.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_LIMIT))
    if size > BATCH_BYTES:
        spark.conf.set(_BATCH_LIMIT, BATCH_BYTES)
    return df


_CODEC = "spark.sql.parquet.compression.codec"


def zstd_files(df: DataFrame) -> DataFrame:
    """``df``, of cells that are mostly padding: from now on its session writes Parquet with
    zstd, unless it was told a codec.

    Spark's default, snappy, spends three bytes on every 64 that repeat; a table padded to
    its longest row is then many times its input on disk.
    """
    conf = df.sparkSession.conf
    if _CODEC not in conf.getAll:
        conf.set(_CODEC, "zstd")
    return df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when the input is too small to fill the cluster.

    Below one full split per core, files and row groups decide how many tasks
    hold rows, often a single one.  Larger inputs come back unchanged.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df
