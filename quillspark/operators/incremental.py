"""Processing only new or changed records of a feed.

A run rereads the feed from the oldest transaction that may have been open when the last run ended, keeps the last row of
each key, and removes by an anti-join every (key, content version) pair that the ledger of processed records holds.
Rereading makes sure that nothing is skipped, the ledger that nothing is repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compared columns of a harvested record; in those of SPACED, white space counts as one space and not at the ends.
COMPARED = ("status", "version", "title", "abstract", "authors", "categories", "license", "doi")
SPACED = ("title", "abstract")


def content_version(columns: tuple[str, ...] = COMPARED, spaced: tuple[str, ...] = SPACED) -> Column:
    """A hash that is equal exactly for rows whose compared columns are; null differs from every value."""
    def shown(c: str) -> Column:
        x = F.col(c)
        return (F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "") if c in spaced else x).alias(c)

    return F.sha2(F.to_json(F.struct(*[shown(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class Feed:
    """Names of a feed's columns: scope is what a saved state must share with the feed to count."""

    feed: str = "harvest_id"
    key: str = "base_id"
    position: str = "feed_pos"
    scope: tuple[str, ...] = ("set_spec", "metadata_prefix")
    written_rows: str = "rows_written"
    saved_at: str = "saved_at"
    state_id: str = "state_id"


def resume_points(records: DataFrame, states: DataFrame, how: Feed = Feed()) -> DataFrame:
    """For each feed and scope of `records`: done (rows known written) and reread_from (where a run starts reading).

    done is that of the state saved last among those of the same scope whose row count is not null; 0 without one.
    Of equal save times the higher state id counts. reread_from is the count of the state before it: what was
    written between the two is the oldest transaction that can have been open at the last run.
    """
    on = [how.feed, *how.scope]
    scopes = records.select(*on).distinct()
    # Maxima of structs, in which null is smallest: a feed with very many states is combined before it is shuffled.
    state = F.struct(F.col(how.saved_at).alias("saved_at"), F.col(how.state_id).alias("state_id"), F.col(how.written_rows).cast("bigint").alias("done"))
    known = states.where(F.col(how.written_rows).isNotNull()).select(*on, state.alias("state"))
    last = known.groupBy(*on).agg(F.max("state").alias("last"))
    to_last = F.lit(True)
    for c in on:
        to_last &= F.col(c).eqNullSafe(F.col(f"l_{c}"))
    earlier = known.join(last.select(*[F.col(c).alias(f"l_{c}") for c in on], "last"), to_last).groupBy(*[f"l_{c}" for c in on]).agg(F.max("last").alias("last"), F.max(F.when(F.col("state") < F.col("last"), F.col("state"))).alias("before"))
    saved = earlier.select(*[F.col(f"l_{c}").alias(f"s_{c}") for c in on], F.col("last.done").alias("done"), F.col("before.done").alias("before"))
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return scopes.join(saved, same, "left").select(*on, F.coalesce("done", F.lit(0)).alias("done"), F.least(F.coalesce("before", F.lit(0)), F.coalesce("done", F.lit(0))).alias("reread_from"))


def changed_records(records: DataFrame, states: DataFrame, how: Feed = Feed(), version: Column | None = None) -> DataFrame:
    """(feed, key, position, content_version) of each key that the next run must process.

    These are keys whose last row not yet written differs from their last written row, or that have no written row.
    A row delivered again at its position counts once. Rows of a null feed, key or position are left out; a feed
    without rows, or empty tables, give nothing. Last rows are found by an aggregate with map-side combine, never by
    sorting a feed in one task, so a feed that holds a third of all rows is no hot spot.
    """
    on = [how.feed, *how.scope]
    points = resume_points(records, states, how).select(*[F.col(c).alias(f"p_{c}") for c in on], "done", "reread_from")
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"p_{c}"))
    rows = (
        records.where(F.col(how.feed).isNotNull() & F.col(how.key).isNotNull() & F.col(how.position).isNotNull())
        .select(*on, F.col(how.key).alias("_key"), F.col(how.position).alias("_pos"), (content_version() if version is None else version).alias("content_version"))
        .join(points, same)
    )
    last = lambda x: x.groupBy(F.col(how.feed).alias("_feed"), "_key").agg(F.max(F.struct("_pos", "content_version")).alias("last")).select("_feed", "_key", F.col("last._pos").alias("_pos"), F.col("last.content_version").alias("content_version"))
    # what a feed itself tells of its written rows stands for the ledger here; harvest_run keeps one and reads no row twice
    ledger = last(rows.where("_pos <= done"))
    reread = last(rows.where("_pos > reread_from"))
    return reread.join(ledger.select("_feed", "_key", "content_version"), ["_feed", "_key", "content_version"], "left_anti").select(
        F.col("_feed").alias(how.feed), F.col("_key").alias(how.key), F.col("_pos").alias(how.position), "content_version"
    )


STATE = "feed string, scope string, from_date string, until_date string, resumption_token string, rows_written long, parts_written int, completed boolean, attempt int, saved_at timestamp_ntz"


def states_at(spark: SparkSession, path: str) -> DataFrame:
    """Saved states, those whose save was broken off left out; empty where none was saved."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(STATE).parquet(path) if there else spark.createDataFrame([], STATE)


def last_state(states: DataFrame, feed: str, scope: str) -> dict:
    """The state of a feed that was saved last in this scope; without one, the start. A feed that has states of another scope
    only is an error: its rows would be taken for these."""
    own = states.where((F.col("feed") == feed) & F.col("rows_written").isNotNull())
    found = own.where(F.col("scope") == scope).groupBy("feed").agg(F.max_by(F.struct(*[F.col(c) for c in states.columns]), F.struct("saved_at", "rows_written")).alias("s")).select("s.*").first()
    if found is None:
        if not own.isEmpty():
            raise ValueError(f"the states of {feed} are of another scope than {scope}")
        return {"feed": feed, "scope": scope, "rows_written": 0, "parts_written": 0, "completed": False, "attempt": 0, "resumption_token": None}
    return found.asDict()


def harvest_run(records: DataFrame, folder: str, feed: str, scope: str, token: str | None = None, completed: bool = False, parts: int = 50_000, stop: Callable[[str], None] = lambda step: None) -> int:
    """Takes what is new of one feed (columns of Feed, and those compared) into `folder`, and returns the rows written.

    Only positions after the saved state are read (the comparison is pushed into the scan); their last row of each key is
    anti-joined with the ledger, which has the key and content version of the last row written of each key. Rows go to a part of
    the run's own, the ledger to the run's own partition, and the state is saved last. A run that stopped at any step is repeated
    under the same number: it overwrites its own part and ledger entries, so nothing is skipped and nothing is twice. A run
    over a feed whose state is completed, and that has nothing after it, changes nothing. stop is called after each step.
    """
    spark, how = records.sparkSession, Feed()
    state = last_state(states_at(spark, f"{folder}/states"), feed, scope)
    run = state["attempt"] + 1
    pending = records.where((F.col(how.feed) == feed) & (F.col(how.position) > state["rows_written"]) & F.col(how.key).isNotNull())
    pending = pending.withColumn("content_version", content_version())
    end = pending.agg(F.max(how.position)).first()[0]
    if end is None and (state["completed"] or not completed):
        return 0
    names = [c for c in pending.columns if c != how.key]
    last = pending.groupBy(how.key).agg(F.max_by(F.struct(*names), F.struct(how.position, "content_version")).alias("r")).select(how.key, "r.*")
    # of the ledger that of earlier runs: a part of a run that stopped is not done
    ledger = _ledger(spark, f"{folder}/ledger", how.key)
    known = ledger.where((F.col("feed") == feed) & (F.col("run") < run)).groupBy(how.key).agg(F.max_by("content_version", "run").alias("content_version"))
    fresh = last.join(known, [how.key, "content_version"], "left_anti")
    fresh.write.mode("overwrite").option("maxRecordsPerFile", parts).parquet(f"{folder}/records/feed={quote(feed, safe='')}/run={run}")
    stop("records")
    written_rows = spark.read.schema(fresh.schema).parquet(f"{folder}/records/feed={quote(feed, safe='')}/run={run}")
    entries = written_rows.select(how.key, "content_version", F.lit(feed).alias("feed"), F.lit(run).alias("run"))
    entries.write.mode("overwrite").parquet(f"{folder}/ledger/part={quote(feed, safe='')}-{run}")
    stop("ledger")
    row = (feed, scope, None, None, token, int(end if end is not None else state["rows_written"]), state["parts_written"] + 1, completed, run)
    saved = spark.createDataFrame([row], ", ".join(STATE.split(", ")[:-1])).withColumn("saved_at", F.current_timestamp().cast("timestamp_ntz"))
    saved.select(*[c.split()[0] for c in STATE.split(", ")]).coalesce(1).write.mode("append").parquet(f"{folder}/states")
    return written_rows.count()


def _ledger(spark: SparkSession, path: str, key: str) -> DataFrame:
    hadoop, schema = spark._jvm.org.apache.hadoop.fs.Path(path), f"{key} string, content_version string, feed string, run int"
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if there else spark.createDataFrame([], schema)


def commit(processed: DataFrame, ledger: str, run_id: str) -> None:
    """Adds what a run processed to the ledger, in the run's own partition: a run repeated after a failure replaces its
    entries and never doubles them."""
    processed.write.mode("overwrite").parquet(f"{ledger}/run_id={run_id}")


def unprocessed(records: DataFrame, ledger: DataFrame, key: list[str], version: str = "content_version") -> DataFrame:
    """Rows of `records` whose (key, version) pair is not in the ledger."""
    return records.join(ledger.select(*key, version).distinct(), [*key, version], "left_anti")
