"""Tables written between stages, so that a lost executor never costs the lineage behind them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where none is (tests, local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: nothing left to reach the file system with
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back with its own schema.

    Cuts the lineage without a local copy: every executor can read the table again after another is lost.
    The table is removed when the process ends, or before by dropped.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes the table that written gave, as a round of an iteration does with that of the round before once it has its own."""
    _remove(df.sparkSession, df._written_at)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table in one small file would otherwise be one task.
    Tables with that many partitions, as all large ones, are left as they are and not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def partitions_for(spark: SparkSession, size: int) -> int:
    """Shuffle partitions for `size` bytes at the advised size of the session, at least those of the session."""
    advised = spark._jsparkSession.sessionState().conf().getConf(spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // int(advised)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
