"""Versioned, append-only relevance judgements."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.schemas import QREL_SCHEMA

KEY = ["query_id", "doc_id", "char_start", "char_end"]


def latest_version(qrels: DataFrame) -> DataFrame:
    return qrels.agg(F.max("qrels_version").alias("latest_version"), F.count_distinct("qrels_version").alias("n_versions"))


def duplicates(batch: DataFrame) -> DataFrame:
    """Keys that occur more than once in a batch; it must have none to be appended."""
    return batch.groupBy("qrels_version", *KEY).agg(F.count("*").alias("n")).where("n > 1")


def meta(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("qrels_version").agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_judgements"), F.array_join(F.array_sort(F.collect_set("judge")), ",").alias("judges"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each key of either version with its change: added, removed, regraded or unchanged."""
    side = lambda df, name: df.groupBy(*KEY).agg(F.max("grade").alias(name))
    both = side(old, "old_grade").join(side(new, "new_grade"), KEY, "full_outer")
    change = F.when(F.col("old_grade").isNull(), "added").when(F.col("new_grade").isNull(), "removed").when(F.col("old_grade") != F.col("new_grade"), "regraded").otherwise("unchanged")
    return both.withColumn("change", change)


def append(spark: SparkSession, root: str, batch: DataFrame, note: str = "", judges: list[str] | None = None) -> int:
    """Writes a batch as the next version, its metadata beside it, and returns its number. An empty batch, one with repeated
    keys and an existing version are errors; earlier versions are never touched. Readers prune by the partition column."""
    if batch.isEmpty() or not duplicates(batch.withColumn("qrels_version", F.lit(0))).isEmpty():
        raise ValueError("a batch must have rows and no repeated keys")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [int(str(s.getPath().getName()).split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName()] if fs.exists(path) else []
    version = max(there, default=0) + 1
    batch.drop("qrels_version").write.mode("errorifexists").parquet(f"{root}/qrels_version={version}")
    told = meta(load(spark, root, version)).first()
    record = {
        "version": version, "created_at": datetime.now(timezone.utc).isoformat(), "note": note, "judges": sorted(judges if judges is not None else filter(None, told["judges"].split(","))),
        "n_queries": told["n_queries"], "n_judgements": told["n_judgements"], "parent_version": version - 1 if there else None,
    }
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(_meta_path(root, version)), False)
    out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    out.close()
    return version


def _meta_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}.meta/{version}.json"


def load_meta(spark: SparkSession, root: str, version: int) -> dict:
    """The metadata of a version: note, judges, counts, parent. A version without it is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_meta_path(root, version))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"version {version} of {root} has no metadata")
    return json.loads("".join(r[0] for r in spark.read.text(_meta_path(root, version)).collect()))


def load(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(QREL_SCHEMA).parquet(root).where(F.col("qrels_version") == version)
