"""Tables kept by whole snapshots: upsert, tombstones, write-once freezing, manifests, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(existing: DataFrame, batch: DataFrame, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """`existing` with the rows of `batch` in place of those of equal key. Columns in `kept` keep the existing value where
    there is a row (so a re-ingested row never loses its tombstone)."""
    if not kept:
        return existing.join(batch.select(key), key, "left_anti").unionByName(batch)
    there = F.col(f"_new_{key}").isNotNull()
    both = existing.select(key, *[F.col(c).alias(f"_old_{c}") for c in existing.columns if c != key], F.lit(True).alias("_was")).join(
        batch.select(key, F.col(key).alias(f"_new_{key}"), *[F.col(c).alias(f"_new_{c}") for c in batch.columns if c != key]), key, "full_outer"
    )
    out: list[Column | str] = [key]
    for c in existing.columns:
        if c == key:
            continue
        fresh = F.col(f"_new_{c}") if c in batch.columns else F.lit(None)
        out.append((F.when(F.col("_was"), F.col(f"_old_{c}")).otherwise(fresh) if c in kept else F.when(there, fresh).otherwise(F.col(f"_old_{c}"))).alias(c))
    return both.select(*out)


def tombstoned(table: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """`table` with tombstoned_at set for the keys in `dead` (key, at); a later mark replaces an earlier one. Rows are never removed."""
    marks = dead.groupBy(key).agg(F.max("at").alias("_at"))
    return table.join(marks, key, "left").withColumn("tombstoned_at", F.coalesce("_at", "tombstoned_at")).drop("_at")


def frozen(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """doc_id, action: insert, noop (same hash frozen), conflict (another), or not_normalised (normal is false). Both have doc_id, sha."""
    was = existing.select("doc_id", F.col("sha").alias("was"))
    action = F.when(~F.col("normal"), "not_normalised").when(F.col("was").isNull(), "insert").when(F.col("was") == F.col("sha"), "noop").otherwise("conflict")
    return incoming.join(was, "doc_id", "left").select("doc_id", action.alias("action"))


def snapshot_id(entries: DataFrame) -> DataFrame:
    """corpus_snapshot: 16 digits of a hash of (content_hash, doc_id, version) of the entries, in whatever order.

    Entries' hashes are folded with two order-free sums and a count, by an aggregate with map-side combine, so that
    no task gathers the corpus.
    """
    h = F.sha2(F.to_json(F.struct("content_hash", "doc_id", "version"), {"ignoreNullFields": "false"}), 256)
    word = lambda k: F.conv(F.substring(h, k, 15), 16, 10).cast("decimal(38,0)")
    folded = entries.agg(F.count("*").alias("n"), F.sum(word(1)).alias("x"), F.sum(word(16)).alias("y"))
    return folded.select(F.substring(F.sha2(F.concat_ws(":", "n", F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))), 256), 1, 16).alias("corpus_snapshot"), F.col("n").alias("n_documents"))


def zero_filled(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """column, n: the number of rows of each of `values`, 0 where there are none."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return listed.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def violations(df: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """key, name, most, actual of every value above its limit; a null value is within it."""
    checks = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(x)).alias("most"), F.col(c).alias("actual")) for c, x in limits.items()])
    return df.select(key, F.explode(checks).alias("c")).select(key, "c.*").where("actual > most")


def new_keys(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return batch.join(known.select(key), key, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """only_a, only_b: numbers of keys that one snapshot has alone; both 0 for equal sets."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.withColumn("side", F.lit(1)).unionByName(y.withColumn("side", F.lit(2))).groupBy(key).agg(F.sum("side").alias("s")).agg(F.count_if(F.col("s") == 1).alias("only_a"), F.count_if(F.col("s") == 2).alias("only_b"))


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """(complete, all) snapshot numbers under `path`, in order. A snapshot is complete once its marker is there, which is made last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {str(f.getPath().getName()) for f in fs.listStatus(at)} if fs.exists(at) else set()
    every = sorted(int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-") and not n.endswith(".done"))
    return [n for n in every if f"snapshot-{n}.done" in names], every


def swap(df: DataFrame, path: str, keep: int = 2) -> None:
    """Writes the next snapshot of the table kept under `path`. Nothing is renamed: readers see the last complete snapshot
    until the new one's marker is made, whenever a writer stops. The last `keep` complete ones stay, for readers that
    still use them; snapshots that were never completed go."""
    spark = df.sparkSession
    complete, every = _versions(spark, path)
    number = max(every, default=0) + 1
    df.write.parquet(f"{path}/snapshot-{number}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(hadoop(f"{path}/snapshot-{number}.done"), False).close()
    stay = [*complete, number][-keep:]
    for old in every:
        if old not in stay:
            fs.delete(hadoop(f"{path}/snapshot-{old}.done"), False)
            fs.delete(hadoop(f"{path}/snapshot-{old}"), True)


def kept(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The last complete snapshot of the table under `path`; empty where there is none and a schema is given."""
    complete, _ = _versions(spark, path)
    if complete:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(f"{path}/snapshot-{complete[-1]}")
    if schema is None:
        raise FileNotFoundError(f"no complete snapshot under {path}")
    return spark.createDataFrame([], schema)


LEDGER = {
    "documents": "doc_id string, namespace string, source_url string, title string, doc_text_sha256 string, parser_id string, char_len int, acl_key string, ingest_run_id string, tombstoned_at timestamp_ntz",
    "chunks": "chunk_uid string, doc_id string, chunker_config_id string, char_start int, char_end int, raw_text_sha256 string, dup_of string",
    "runs": "run_id string, manifest string, git_sha string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, metrics string, cost_usd double, p50_ms double, p95_ms double, peak_rss_mb double, notes string",
    "run_metrics": "run_id string, query_id string, metric string, value double",
    "ingest_runs": "ingest_run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, source string, n_documents int, n_errors int, notes string",
    "errors": "run_id string, stage string, message string, ts timestamp_ntz",
    "schema_version": "version int",
}


def create_ledger(spark: SparkSession, database: str) -> None:
    """Empty tables of the first schema version, where they are missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in LEDGER.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    if spark.table(f"{database}.schema_version").isEmpty():
        spark.sql(f"INSERT INTO {database}.schema_version VALUES (1)")


def migrate(spark: SparkSession, database: str) -> int:
    """Forward only: version 2 adds chunks.tombstoned_at. Returns the version reached."""
    at = spark.table(f"{database}.schema_version").agg(F.max("version")).first()[0]
    if at < 2:
        if "tombstoned_at" not in spark.table(f"{database}.chunks").columns:
            spark.sql(f"ALTER TABLE {database}.chunks ADD COLUMNS (tombstoned_at timestamp_ntz)")
        spark.sql(f"INSERT INTO {database}.schema_version VALUES (2)")
    return 2


def tidy_metrics(nested: DataFrame) -> DataFrame:
    """run_id, query_id, metric, value of rows (run_id, per_query map of map); null values are left out."""
    return nested.select("run_id", F.explode("per_query").alias("query_id", "values")).select("run_id", "query_id", F.explode("values").alias("metric", "value")).where("value is not null")


def recorded(runs: DataFrame, new: DataFrame) -> DataFrame:
    """run_id, action of recording runs: insert, noop (same manifest) or conflict."""
    was = runs.select("run_id", F.col("manifest").alias("was"))
    return new.join(was, "run_id", "left").select("run_id", F.when(F.col("was").isNull(), "insert").when(F.col("was") == F.col("manifest"), "noop").otherwise("conflict").alias("action"))


def run_finished(runs: DataFrame, run_metrics: DataFrame, outcomes: DataFrame, per_query: DataFrame, latencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, run_metrics) after runs have ended: outcomes has run_id, status, finished_at, metrics (JSON), cost_usd, peak_rss_mb;
    per_query run_id, query_id, metric, value; latencies run_id, ms.

    A run that ends again replaces what it had, its rows of run_metrics included. The percentiles are linear between
    neighbours, null without latencies. An outcome of a run that was never recorded fails the query.
    """
    ms = latencies.groupBy("run_id").agg(F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.95).alias("p95_ms"))
    given = outcomes.join(ms, "run_id", "left").select("run_id", F.struct("status", "finished_at", "metrics", "cost_usd", "p50_ms", "p95_ms", "peak_rss_mb").alias("n"))
    both = runs.withColumn("_known", F.lit(True)).join(given, "run_id", "full_outer")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown run "), "run_id"))).otherwise(F.col("n").isNotNull())
    fresh = ("status", "finished_at", "metrics", "cost_usd", "p50_ms", "p95_ms", "peak_rss_mb")
    ended = both.select(*[F.when(known, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) if c in fresh else c for c in runs.columns])
    told = run_metrics.join(outcomes.select("run_id"), "run_id", "left_anti").unionByName(per_query.select(*run_metrics.columns))
    return ended, told


def ingest_recorded(ingest_runs: DataFrame, new: DataFrame) -> DataFrame:
    """ingest_runs with a row for each new id (ingest_run_id, started_at, source); an id that is there stays as it is."""
    fresh = new.dropDuplicates(["ingest_run_id"]).join(ingest_runs.select("ingest_run_id"), "ingest_run_id", "left_anti")
    fresh = fresh.withColumns({"finished_at": F.lit(None).cast("timestamp_ntz"), "n_documents": F.lit(0), "n_errors": F.lit(0), "notes": F.lit("")})
    return ingest_runs.unionByName(fresh.select(*ingest_runs.columns))


def ingest_finished(ingest_runs: DataFrame, ended: DataFrame) -> DataFrame:
    """ingest_runs with the counts of runs that ended (ingest_run_id, finished_at, n_documents, n_errors, notes); one that ends
    again replaces them, an unknown one fails the query."""
    given = ended.select("ingest_run_id", F.struct("finished_at", "n_documents", "n_errors", "notes").alias("n"))
    both = ingest_runs.withColumn("_known", F.lit(True)).join(given, "ingest_run_id", "full_outer")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown ingest run "), "ingest_run_id"))).otherwise(F.col("n").isNotNull())
    return both.select(*[F.when(known, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) if c in ("finished_at", "n_documents", "n_errors", "notes") else c for c in ingest_runs.columns])


def errors_recorded(errors: DataFrame, new: DataFrame) -> DataFrame:
    """errors with more rows (run_id, stage, message, ts); nothing is ever replaced."""
    return errors.unionByName(new.select(*errors.columns))


def documents_tombstoned(documents: DataFrame, chunks: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) with tombstoned_at set for the documents in `dead` (doc_id, at) that are known, and for all of
    their chunks. No row is removed."""
    known = dead.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return tombstoned(documents, known, "doc_id"), tombstoned(chunks, known, "doc_id")


#: Columns that runs may be listed by, and the limits of a run with the column each bounds.
ORDERABLE = ("started_at", "finished_at", "status", "cost_usd", "p50_ms", "p95_ms", "peak_rss_mb")
LIMITS = {"max_p95_latency_ms": ("p95_ms", 800.0), "max_peak_rss_mb": ("peak_rss_mb", 2560.0), "max_cost_per_query_usd": ("cost_usd", 0.02)}


def listed_runs(runs: DataFrame, by: str = "started_at", descending: bool = True, limit: int = 20) -> DataFrame:
    """The first `limit` runs by one of ORDERABLE, runs without it last, of equal ones the smaller id."""
    if by not in ORDERABLE or limit <= 0:
        raise ValueError(f"runs are listed by one of {', '.join(ORDERABLE)}, and at least one of them")
    return runs.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), "run_id").limit(limit)


def run_violations(runs: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """run_id, name, most, actual of every limit that a run exceeds; a value that was not measured exceeds none."""
    renamed = runs.select("run_id", *[F.col(column).alias(name) for name, (column, _) in LIMITS.items()])
    return violations(renamed, "run_id", {name: most for name, (_, most) in LIMITS.items()} | (limits or {}))
