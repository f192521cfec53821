"""The whole ingest, set at a time: parse what the manifest lacks, freeze, measure, chunk, find duplicates, keep, report."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalized
from quillspark.operators import dedup, tables
from quillspark.operators import manifest as mf
from quillspark.operators.chunking import REGISTRY, fixed_chunks, span_mismatches
from quillspark.operators.latex import parse_trees
from quillspark.operators.structure import quality_report
from quillspark.schemas import ChunkerConfig
from quillspark.sources.archives import files_hash, main_files
from quillspark.storage import written


@dataclass(frozen=True)
class IngestConfig:
    chunk: ChunkerConfig = ChunkerConfig()
    shingle: int = 5
    threshold: float = 0.85
    dedup: bool = True


_FROZEN = "doc_id string, text string, title string, sha string, normal boolean, sections array<struct<section_path:string,char_start:int,char_end:int>>"
_CHUNKS = "chunk_uid string, doc_id string, chunker_config_id string, char_start int, char_end int, text string, raw_text_sha256 string, dup_of string, tombstoned_at timestamp_ntz"
_QUALITY = (
    "doc_id string, n_chars int, n_spans long, header_footer_contamination_rate double, broken_math_span_rate double, unexpanded_macro_rate double, reference_only_span_rate double, "
    "mean_span_length_chars double, short_span_rate double, mean_section_label_coverage double, parser_id string"
)
_FAILURES = "doc_id string, stage string, reason string"
PARSER = "latex"


def ingest(files: DataFrame, root: str, how: IngestConfig = IngestConfig(), source: str = "files") -> DataFrame:
    """files: doc_id, path, content (text). Kept under `root`: manifest, canonical, quality, chunks, failures (of the last run),
    errors (of all runs) and ingest_runs.

    A document that the manifest has as parsed from the same files, or as tombstoned, is skipped; all others are parsed,
    failed ones again at each run. A failure is a row and stops nothing. Frozen text is never replaced: the same text again is no
    change, another text a failure. Only documents frozen in this run are measured and chunked; duplicates are sought
    again only if there are new chunks, over all of them, as a new chunk may come first. A chunk that is not the slice of
    its document that its span names fails the run. Returns one row of counters.
    """
    spark = files.sparkSession
    keep = lambda name, schema: tables.kept(spark, f"{root}/{name}", schema)
    now, run_id = F.current_timestamp().cast("timestamp_ntz"), f"ingest-{uuid.uuid4().hex[:16]}"
    started = spark.range(1).select(F.lit(run_id).alias("ingest_run_id"), now.alias("started_at"), F.lit(source).alias("source"))
    tables.swap(tables.ingest_recorded(keep("ingest_runs", tables.LEDGER["ingest_runs"]), started), f"{root}/ingest_runs")

    hashes = files_hash(files.select("doc_id", "path", F.coalesce("content", F.lit("")).alias("content"))).withColumnRenamed("sha", "content_hash")
    seen = written(hashes, "seen")
    before = mf.seeded(keep("manifest", mf.MANIFEST), seen.select("doc_id"))
    state = written(seen.join(before.select("doc_id", "status", F.col("content_hash").alias("was")), "doc_id"), "state")
    done = (F.col("status") == "tombstoned") | (F.col("status") == "parsed") & (F.col("was") == F.col("content_hash"))
    todo = state.where(~done).select("doc_id", "content_hash", "status")
    wanted = files.join(todo.select("doc_id"), "doc_id", "left_semi")
    mains = written(main_files(wanted).where("main is not null"), "mains")
    trees = wanted.where("content is not null").join(mains, "doc_id").groupBy("doc_id", "main").agg(F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("files"))
    parsed = written(parse_trees(trees), "parsed")
    failed = parsed.where("error is not null").select("doc_id", F.lit("parse").alias("stage"), F.col("error").alias("reason"))
    failed = failed.unionByName(todo.join(mains, "doc_id", "left_anti").select("doc_id", F.lit("acquire").alias("stage"), F.lit("no main file").alias("reason")))
    failed = failed.unionByName(parsed.where("error is null and length(text) = 0").select("doc_id", F.lit("chunk").alias("stage"), F.lit("canonical text is empty").alias("reason")))
    good = parsed.where("error is null and length(text) > 0").select("doc_id", "text", "title", F.sha2("text", 256).alias("sha"), (normalized(F.col("text")) == F.col("text")).alias("normal"), "sections")
    good = written(good, "good")
    canonical = keep("canonical", _FROZEN)
    actions = written(tables.frozen(good, canonical), "actions")
    reason = F.when(F.col("action") == "conflict", "another text is frozen").otherwise("text is not normalised")
    failed = written(failed.unionByName(actions.where("action in ('conflict', 'not_normalised')").select("doc_id", F.lit("freeze").alias("stage"), reason.alias("reason"))), "failures")
    fresh = written(good.join(actions.where("action = 'insert'"), "doc_id", "left_semi"), "fresh")
    n_new = fresh.count()
    if n_new:
        tables.swap(canonical.unionByName(fresh), f"{root}/canonical")

    # a run that stopped after freezing has left documents without chunks: those are taken up here
    canonical, label = keep("canonical", _FROZEN), REGISTRY.get("chunker", "fixed").config_id(size=how.chunk.size, overlap=how.chunk.overlap)
    quality, old = keep("quality", _QUALITY), keep("chunks", _CHUNKS)
    length = F.aggregate("sections", F.lit(0), lambda n, x: n + x["char_end"] - x["char_start"])
    unmeasured = written(canonical.join(quality.select("doc_id"), "doc_id", "left_anti"), "unmeasured")
    if not unmeasured.isEmpty():
        report = quality_report(unmeasured, unmeasured.select("doc_id", length.alias("section_chars")), parser=PARSER)
        tables.swap(quality.unionByName(report.select(*quality.columns)), f"{root}/quality")
    unchunked = canonical.join(old.where(F.col("chunker_config_id") == label).select("doc_id").distinct(), "doc_id", "left_anti")
    chunks = written(fixed_chunks(unchunked, how.chunk, config_id=label), "chunks")
    n_chunks_new = chunks.count()
    if n_chunks_new:
        if not span_mismatches(chunks, canonical).isEmpty():
            raise RuntimeError("a chunk is not the slice of its document that its span names")
        new = chunks.withColumns({"tombstoned_at": F.lit(None).cast("timestamp_ntz"), "dup_of": F.lit(None).cast("string")}).select(*old.columns)
        every = written(old.unionByName(new), "every")
        if how.dedup:
            alike = dedup.near_duplicates(every, "chunk_uid", "text", how.shingle, how.threshold)
            roots = dedup.roots(dedup.direct_parents(alike, dedup.in_document_order(every))).select(F.col("key").alias("chunk_uid"), "root")
            every = every.join(roots, "chunk_uid", "left").withColumn("dup_of", F.col("root")).select(*old.columns)
        tables.swap(every, f"{root}/chunks")

    tables.swap(failed.select("doc_id", "stage", "reason"), f"{root}/failures")
    tables.swap(tables.errors_recorded(keep("errors", tables.LEDGER["errors"]), failed.select(F.lit(None).cast("string").alias("run_id"), "stage", F.concat_ws(": ", "doc_id", "reason").alias("message"), now.alias("ts"))), f"{root}/errors")
    outcome = todo.select("doc_id", "content_hash").join(failed.groupBy("doc_id").agg(F.min(F.concat_ws(": ", "stage", "reason")).alias("failure_reason")), "doc_id", "left")
    changes = outcome.select("doc_id", "content_hash", now.alias("acquired_at"), F.when(F.col("failure_reason").isNull(), "parsed").otherwise("failed").alias("status"), F.when(F.col("failure_reason").isNull(), PARSER).alias("parser_used"), "failure_reason")
    tables.swap(mf.marked(before, changes), f"{root}/manifest")
    counts = state.agg(F.count("*").alias("n_seen"), F.count_if(done).alias("n_skipped"), F.count_if(~done & (F.col("status") != "acquired")).alias("n_tried")).first()
    n_failed = failed.select("doc_id").distinct().count()
    no_main = failed.where("stage = 'acquire'").count()
    ended = spark.range(1).select(F.lit(run_id).alias("ingest_run_id"), now.alias("finished_at"), F.lit(n_new).alias("n_documents"), F.lit(n_failed).alias("n_errors"), F.lit("").alias("notes"))
    tables.swap(tables.ingest_finished(keep("ingest_runs", tables.LEDGER["ingest_runs"]), ended), f"{root}/ingest_runs")
    total = keep("chunks", _CHUNKS).agg(F.count("*").alias("n"), F.count("dup_of").alias("dups")).first()
    snapshot = tables.snapshot_id(mf.live(keep("manifest", mf.MANIFEST))).first()["corpus_snapshot"]
    row = (run_id, snapshot, counts["n_seen"], counts["n_tried"] - no_main, actions.where("action in ('insert', 'noop')").count(), n_failed, counts["n_skipped"], n_new, total["n"], n_chunks_new, total["dups"])
    return spark.createDataFrame([row], "ingest_run_id string, corpus_snapshot string, n_seen long, n_acquired long, n_parsed long, n_failed long, n_skipped long, n_new_documents long, n_chunks long, n_new_chunks long, n_duplicates long")
