"""The corpus manifest: which documents a corpus has, how far each has come, and why one failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "doc_id string, version long, source_url string, content_hash string, acquired_at timestamp_ntz, parser_used string, status string, failure_reason string"
#: The states of a document; those of DONE need no acquisition, those of LIVE are in the corpus.
STATES = ("pending", "acquired", "parsed", "failed", "tombstoned")
DONE, LIVE = ("acquired", "parsed", "tombstoned"), ("acquired", "parsed")


def needs_acquisition(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, needs of each different target: it is not in the manifest, or pending or failed there."""
    known = manifest.select("doc_id", "status")
    return targets.select("doc_id").where("doc_id is not null").distinct().join(known, "doc_id", "left").select("doc_id", (~F.coalesce(F.col("status").isin(*DONE), F.lit(False))).alias("needs"))


def seeded(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """The manifest with a pending row for each target (doc_id, and version and source_url where it has them) that it lacks; no
    row that is there changes."""
    at = lambda c, kind, other: (F.max(c) if c in targets.columns else F.lit(other)).cast(kind).alias(c)
    new = targets.where("doc_id is not null").groupBy("doc_id").agg(at("version", "long", None), at("source_url", "string", "")).join(manifest.select("doc_id"), "doc_id", "left_anti")
    return manifest.unionByName(new.withColumn("status", F.lit("pending")), allowMissingColumns=True).select(*manifest.columns)


def marked(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """The manifest after changes (doc_id, status, and content_hash, source_url, version, acquired_at, parser_used,
    failure_reason where they have them); of several changes of a document that of the latest state counts.

    acquired takes the new source and keeps the parser; parsed takes the parser; a failure keeps all else, and makes a row where there
    is none; the reason stands only with a failure. Another state of a document that the manifest lacks fails the query.
    """
    names = [c for c in manifest.columns if c != "doc_id"]
    order = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))
    full = changes.select("doc_id", *[F.col(c).alias(c) if c in changes.columns else F.lit(None).cast(dict(manifest.dtypes)[c]).alias(c) for c in names])
    one = full.groupBy("doc_id").agg(F.max_by(F.struct(*names), order).alias("n"))
    both = manifest.select("doc_id", F.struct(*names).alias("o")).join(one, "doc_id", "full_outer")
    lost = F.col("o").isNull() & F.col("n.status").isin("parsed", "tombstoned")
    status = F.when(lost, F.raise_error(F.concat(F.col("n.status"), F.lit(" before it was acquired: "), "doc_id"))).otherwise(F.coalesce("n.status", "o.status"))
    out = {c: F.coalesce(f"n.{c}", f"o.{c}") for c in names} | {"status": status}
    out["failure_reason"] = F.when(F.col("n.status").isNull(), F.col("o.failure_reason")).when(F.col("n.status") == "failed", F.col("n.failure_reason"))
    return both.select("doc_id", *[out[c].alias(c) for c in names]).select(*manifest.columns)


def live(manifest: DataFrame) -> DataFrame:
    """What a snapshot is of: the documents that are in the corpus, not those queued, failed or removed."""
    return manifest.where(F.col("status").isin(*LIVE)).select("content_hash", "doc_id", "version")
