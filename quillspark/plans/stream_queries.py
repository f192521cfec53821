"""Queries that run as streams until their source is drained; beyond the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators.incremental import content_version
from quillspark.storage import shared_folder, table
from quillspark.streaming.ingest import drained, event_windows, ingest


def _stream(s, d, name):
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # as a glob: the table may be one file or a folder


def stream_event_windows(s, d):
    # a batch frame has the same plan without the watermark; complete mode keeps every window
    return drained(event_windows(_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), late="365 days")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_ingest(s, d):
    folder = f"{shared_folder(s)}/ingest-{uuid.uuid4().hex}"
    rows = _stream(s, d, "harvest_records").withColumn("content_version", content_version())
    for _ in range(2):  # the second run finds nothing new
        ingest(rows, ["harvest_id", "base_id"], "content_version", f"{folder}/sink", f"{folder}/ledger", f"{folder}/checkpoint")
    return s.read.parquet(f"{folder}/sink").groupBy("harvest_id").agg(F.count("*").alias("n"), F.count_distinct("base_id").alias("n_papers"))


QUERIES = {"stream_event_windows": stream_event_windows, "stream_ingest": stream_ingest}

SQL = {
    "stream_event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_ingest": """SELECT harvest_id, count(*) AS n, count(DISTINCT base_id) AS n_papers FROM (
  SELECT DISTINCT harvest_id, base_id, status, version, trim(regexp_replace(title, '\\s+', ' ', 'g')), trim(regexp_replace(abstract, '\\s+', ' ', 'g')), authors, categories, license, doi FROM harvest_records) GROUP BY harvest_id""",
}
