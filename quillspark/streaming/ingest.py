"""Streams: new records once each, and event-time windows (the windows go beyond batch harvesting)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.incremental import commit
from quillspark.storage import shared_folder


def _has_rows(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def ingest(stream: DataFrame, key: list[str], version: str, sink: str, ledger: str, checkpoint: str) -> None:
    """Appends to `sink` every record of the stream whose (key, version) the ledger lacks; stops when the source is drained.

    A batch writes its own partitions of sink and ledger and overwrites them if it runs again, and leaves its own
    partition of the ledger out of the comparison: a batch repeated after a failure, at whichever step, gives the
    same rows, none twice and none lost.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates([*key, version])
        if _has_rows(spark, ledger):
            done = spark.read.option("basePath", ledger).parquet(ledger).where(F.col("run_id").cast("string") != str(number))
            fresh = fresh.join(done.select(*key, version).distinct(), [*key, version], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        commit(spark.read.parquet(f"{sink}/batch={number}").select(*key, version), ledger, str(number))

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of tumbling or sliding windows over `ts`; events later than `late` are dropped in a stream."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream when all that its source holds has been read, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
