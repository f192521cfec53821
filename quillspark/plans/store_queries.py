"""Kept tables, manifests, harvest pages and archives."""

from __future__ import annotations

import gzip
import io
import tarfile

from pyspark.sql import functions as F

from quillspark.functions.text import normalized
from quillspark.operators import corpus
from quillspark.operators import manifest as mf
from quillspark.operators import tables as tb
from quillspark.sources import archives as ar
from quillspark.sources import harvest as hv
from quillspark.plans.corpus_queries import _NORMAL, _trees
from quillspark.storage import shared_folder, table, written

QUERIES, SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_COLUMNS = ["doc_id", "namespace", "title", "doc_text_sha256", "char_len", "tombstoned_at"]


def _papers(s, d):
    """One row for each paper: its latest ingest."""
    order = F.struct("ingest_run_id", "updated_at", "char_len", "title")
    return table(s, d, "papers").groupBy("doc_id").agg(F.max_by(F.struct(*_COLUMNS[1:]), order).alias("r")).select("doc_id", "r.*")


_PAPERS = "one AS (SELECT doc_id, namespace, title, doc_text_sha256, char_len, tombstoned_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingest_run_id DESC NULLS LAST, updated_at DESC NULLS LAST, char_len DESC NULLS LAST, title DESC NULLS LAST) AS k FROM papers) WHERE k = 1)"
_add("live_documents", lambda s, d: table(s, d, "papers").where("tombstoned_at is null").select("doc_id").orderBy("doc_id"), "SELECT doc_id FROM papers WHERE tombstoned_at IS NULL ORDER BY doc_id")
_add("document_lookup", lambda s, d: table(s, d, "papers").where("doc_id = 'math.GT/9201001'").select("doc_id", "title", "license"), "SELECT doc_id, title, license FROM papers WHERE doc_id = 'math.GT/9201001'")
_add("chunk_ids_by_doc", lambda s, d: table(s, d, "chunks").where("doc_id = '1501.00001'").select("chunk_uid").distinct(), "SELECT DISTINCT chunk_uid FROM chunks WHERE doc_id = '1501.00001'")
_add("count_chunks", lambda s, d: table(s, d, "chunks").agg(F.count_distinct("chunk_uid").alias("n")), "SELECT count(DISTINCT chunk_uid) AS n FROM chunks")


def _finished_runs(s, d):
    """Runs made of the events: a run has the values of its users' events as latencies."""
    e = table(s, d, "events").select(F.concat(F.lit("run-"), F.lpad((F.col("user_id") % 40).cast("string"), 2, "0")).alias("run_id"), "ts", "value")
    names = {c.split()[0]: c.split()[1] for c in tb.LEDGER["runs"].split(", ")}
    started = e.groupBy("run_id").agg(F.min("ts").alias("started_at")).withColumn("manifest", F.lit("{}"))
    started = started.select(*[F.col(c) if c in started.columns else F.lit(None).cast(kind).alias(c) for c, kind in names.items()])
    done = e.groupBy("run_id").agg(F.lit("finished").alias("status"), F.max("ts").alias("finished_at"), F.lit("{}").alias("metrics"), (F.avg("value") / 5000).alias("cost_usd"), (F.max("value") * 5).alias("peak_rss_mb"))
    none = s.createDataFrame([], tb.LEDGER["run_metrics"])
    return written(tb.run_finished(started, none, done, none, e.select("run_id", F.col("value").alias("ms")))[0], "runs")


_RUNS = "runs AS (SELECT 'run-' || lpad(CAST(user_id % 40 AS VARCHAR), 2, '0') AS run_id, min(ts) AS started_at, 'finished' AS status, max(ts) AS finished_at, avg(value) / 5000 AS cost_usd, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms, max(value) * 5 AS peak_rss_mb FROM events GROUP BY 1)"
_NUMBERS = ("cost_usd", "p50_ms", "p95_ms", "peak_rss_mb")
_rounded = lambda df: df.select("run_id", "started_at", "status", "finished_at", *[F.round(c, 6).alias(c) for c in _NUMBERS])
_ROUNDED = f"SELECT run_id, started_at, status, finished_at, {', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)}"
_add("ledger_run_outcomes", lambda s, d: _rounded(_finished_runs(s, d)), f"WITH {_RUNS} {_ROUNDED} FROM runs")
_add("list_runs", lambda s, d: _rounded(tb.listed_runs(_finished_runs(s, d), "p95_ms")), f"WITH {_RUNS} {_ROUNDED} FROM runs ORDER BY p95_ms DESC NULLS LAST, run_id LIMIT 20")
_add("run_constraint_violations", lambda s, d: tb.run_violations(_finished_runs(s, d)).withColumn("actual", F.round("actual", 6)), f"WITH {_RUNS} " + " UNION ALL ".join(f"SELECT run_id, '{name}' AS name, {most}::DOUBLE AS most, round({c}, 6) AS actual FROM runs WHERE {c} > {most}" for name, (c, most) in tb.LIMITS.items()))
_add("get_run", lambda s, d: _rounded(_finished_runs(s, d).where("run_id = 'run-07'")), f"WITH {_RUNS} {_ROUNDED} FROM runs WHERE run_id = 'run-07'")


# The manifest: papers with a hash are parsed, those without have failed, papers of chunks alone are pending, deleted ones are removed
def _manifest(s, d):
    papers = table(s, d, "papers").groupBy("doc_id").agg(F.max("doc_text_sha256").alias("content_hash"), F.max("parser_id").alias("parser_used"), F.max("source_url").alias("source_url"))
    targets = papers.select("doc_id").unionByName(table(s, d, "chunks").select("doc_id"))
    at = mf.seeded(s.createDataFrame([], mf.MANIFEST), targets)
    got = F.col("content_hash").isNotNull()
    at = mf.marked(at, papers.select("doc_id", "source_url", "content_hash", F.when(got, "acquired").otherwise("failed").alias("status"), F.when(~got, "no text").alias("failure_reason")))
    at = mf.marked(at, papers.where(got).select("doc_id", "parser_used", F.lit("parsed").alias("status")))
    dead = _dead(s, d).select("doc_id").distinct().join(at.select("doc_id"), "doc_id", "left_semi")
    return written(mf.marked(at, dead.withColumn("status", F.lit("tombstoned"))), "manifest")


_MANIFEST = """p AS (SELECT doc_id, max(doc_text_sha256) AS h FROM papers WHERE doc_id IS NOT NULL GROUP BY doc_id),
manifest AS (SELECT t.doc_id, h AS content_hash, CASE WHEN t.doc_id IN (SELECT base_id FROM harvest_records WHERE status = 'deleted' AND base_id IS NOT NULL) THEN 'tombstoned' WHEN h IS NOT NULL THEN 'parsed' WHEN p.doc_id IS NOT NULL THEN 'failed' ELSE 'pending' END AS status
  FROM (SELECT doc_id FROM p UNION SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL) t LEFT JOIN p USING (doc_id))"""
_add("manifest_states", lambda s, d: _manifest(s, d).select("doc_id", "content_hash", "status", F.col("failure_reason").alias("reason")), f"WITH {_MANIFEST} SELECT doc_id, content_hash, status, CASE WHEN status = 'failed' THEN 'no text' END AS reason FROM manifest")
_add(
    "needs_acquisition", lambda s, d: mf.needs_acquisition(table(s, d, "harvest_records").select(F.col("base_id").alias("doc_id")).unionByName(table(s, d, "papers").select("doc_id")), _manifest(s, d)),
    f"WITH {_MANIFEST} SELECT t.doc_id, coalesce(status, '') NOT IN ('acquired', 'parsed', 'tombstoned') AS needs FROM (SELECT base_id AS doc_id FROM harvest_records WHERE base_id IS NOT NULL UNION SELECT doc_id FROM papers WHERE doc_id IS NOT NULL) t LEFT JOIN manifest m ON t.doc_id = m.doc_id",
)
_add("manifest_scan", lambda s, d: _manifest(s, d).where("status = 'parsed'").select("doc_id", "content_hash"), f"WITH {_MANIFEST} SELECT doc_id, content_hash FROM manifest WHERE status = 'parsed'")
_add("canonical_lookup", lambda s, d: table(s, d, "documents").where("doc_id = 101").select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents WHERE doc_id = 101")


def _upserted(s, d, kept=()):
    one = _papers(s, d)
    old = one.where("doc_id < '2000'")
    new = one.where("doc_id >= '1800'").withColumn("title", F.upper("title")).withColumn("tombstoned_at", F.lit(None).cast("timestamp_ntz"))
    return tb.upserted(old, new, "doc_id", kept).select("doc_id", "title", F.col("tombstoned_at").isNotNull().alias("dead"))


_add("ledger_upsert_documents", lambda s, d: _upserted(s, d), f"WITH {_PAPERS} SELECT doc_id, CASE WHEN doc_id >= '1800' THEN upper(title) ELSE title END AS title, doc_id < '1800' AND tombstoned_at IS NOT NULL AS dead FROM one WHERE doc_id < '2000' OR doc_id >= '1800'")
_add("ledger_upsert_chunks", lambda s, d: _upserted(s, d, ("tombstoned_at",)), f"WITH {_PAPERS} SELECT doc_id, CASE WHEN doc_id >= '1800' THEN upper(title) ELSE title END AS title, doc_id < '2000' AND tombstoned_at IS NOT NULL AS dead FROM one")


def _dead(s, d):
    return table(s, d, "harvest_records").where("status = 'deleted'").select(F.col("base_id").alias("doc_id"), F.lit("2030-01-01").cast("timestamp_ntz").alias("at"))


_DEAD = "dead AS (SELECT DISTINCT base_id FROM harvest_records WHERE status = 'deleted')"


def _cascaded(s, d):
    one = _papers(s, d).select("doc_id", "tombstoned_at")
    chunks = table(s, d, "chunks").groupBy("chunk_uid", "doc_id").agg(F.max("tombstoned_at").alias("tombstoned_at"))
    documents, chunks = tb.documents_tombstoned(one, chunks, _dead(s, d))
    return documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "doc_id", "tombstoned_at").unionByName(chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_uid").alias("id"), "doc_id", "tombstoned_at"))


_add(
    "ledger_tombstone", _cascaded,
    f"""WITH {_DEAD}, {_PAPERS}, known AS (SELECT doc_id AS base_id FROM one WHERE doc_id IN (SELECT base_id FROM dead)),
every AS (SELECT 'document' AS kind, doc_id AS id, doc_id, tombstoned_at AS t FROM one UNION ALL SELECT 'chunk', chunk_uid, doc_id, max(tombstoned_at) FROM chunks GROUP BY chunk_uid, doc_id)
SELECT kind, id, doc_id, CASE WHEN base_id IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE t END AS tombstoned_at FROM every LEFT JOIN known ON doc_id = base_id""",
)


def _frozen(s, d):
    """Texts of the chunks frozen as documents: what was ingested before 2025 is there already."""
    texts = table(s, d, "chunks").where("text is not null").select(F.col("chunk_uid").alias("doc_id"), "text", "ingested_at")
    new = texts.groupBy("doc_id").agg(F.max("text").alias("text")).select("doc_id", F.sha2("text", 256).alias("sha"), (normalized(F.col("text")) == F.col("text")).alias("normal"))
    was = texts.where("ingested_at < '2025-01-01'").groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", F.sha2("text", 256).alias("sha"))
    return tb.frozen(new, was)


_add(
    "canonical_freeze", _frozen,
    f"""WITH a AS (SELECT chunk_uid AS doc_id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_uid), b AS (SELECT chunk_uid AS doc_id, sha256(min(text)) AS was FROM chunks WHERE text IS NOT NULL AND ingested_at < '2025-01-01' GROUP BY chunk_uid)
SELECT doc_id, CASE WHEN {_NORMAL} <> text THEN 'not_normalised' WHEN was IS NULL THEN 'insert' WHEN was = sha256(text) THEN 'noop' ELSE 'conflict' END AS action FROM a LEFT JOIN b USING (doc_id)""",
)
_add("corpus_snapshot", lambda s, d: tb.snapshot_id(table(s, d, "papers").select(F.col("doc_text_sha256").alias("content_hash"), "doc_id", F.col("latest_version").alias("version")).distinct()))
_add("new_chunks", lambda s, d: tb.new_keys(table(s, d, "chunks").select("chunk_uid", "ingested_at").where("ingested_at >= '2025-01-01'"), table(s, d, "chunks").where("ingested_at < '2025-01-01'"), "chunk_uid").select("chunk_uid").distinct(), "SELECT DISTINCT chunk_uid FROM chunks WHERE ingested_at >= '2025-01-01' AND chunk_uid NOT IN (SELECT chunk_uid FROM chunks WHERE ingested_at < '2025-01-01')")
_add("ingest_idempotency", lambda s, d: tb.same_keys(tb.upserted(_papers(s, d), _papers(s, d), "doc_id"), _papers(s, d), "doc_id"), "SELECT CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b")
# the first 20 papers in the order in which they were listed, then by id: the limit comes before the order of processing
_add("ingest_limit", lambda s, d: table(s, d, "harvest_records").where("base_id is not null").groupBy(F.col("base_id").alias("doc_id")).agg(F.min("rec_seq").alias("listed")).orderBy("listed", "doc_id").limit(20).select("doc_id").orderBy("doc_id"), "SELECT doc_id FROM (SELECT base_id AS doc_id, min(rec_seq) AS listed FROM harvest_records WHERE base_id IS NOT NULL GROUP BY base_id ORDER BY listed, doc_id LIMIT 20) ORDER BY doc_id")
_add(
    "manifest_seed", lambda s, d: (lambda known: known.withColumn("seeded", F.lit(False)).unionByName(tb.new_keys(table(s, d, "versioned_records").select(F.col("origin").alias("doc_id")).unionByName(table(s, d, "chunks").select("doc_id")).where("doc_id is not null").distinct(), known, "doc_id").withColumn("seeded", F.lit(True))))(table(s, d, "papers").select("doc_id").distinct()),
    "WITH k AS (SELECT DISTINCT doc_id FROM papers), t AS (SELECT origin AS doc_id FROM versioned_records UNION SELECT doc_id FROM chunks) SELECT doc_id, FALSE AS seeded FROM k UNION ALL SELECT doc_id, TRUE FROM t WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM k)",
)
_add("ingest_report", lambda s, d: table(s, d, "chunks").agg(F.count("*").alias("n_rows"), F.count_distinct("chunk_uid").alias("n_chunks"), F.count_if(F.col("dup_of").isNotNull()).alias("n_dups"), F.count_if(F.col("tombstoned_at").isNotNull()).alias("n_dead")), "SELECT count(*) AS n_rows, count(DISTINCT chunk_uid) AS n_chunks, count(dup_of) AS n_dups, count(tombstoned_at) AS n_dead FROM chunks")


def _finished(s, d):
    nested = table(s, d, "parse_quality").select(F.lit("run-q").alias("run_id"), F.create_map(F.col("doc_id"), F.create_map(F.lit("macro"), F.col("unexpanded_macro_rate"), F.lit("math"), F.col("broken_math_span_rate"))).alias("per_query"))
    return tb.tidy_metrics(nested)


_add("ledger_finish_run", _finished, "SELECT 'run-q' AS run_id, doc_id AS query_id, 'macro' AS metric, unexpanded_macro_rate AS value FROM parse_quality WHERE unexpanded_macro_rate IS NOT NULL UNION ALL SELECT 'run-q', doc_id, 'math', broken_math_span_rate FROM parse_quality WHERE broken_math_span_rate IS NOT NULL")
_add(
    "ledger_record_run", lambda s, d: tb.recorded(table(s, d, "papers").groupBy("ingest_run_id").agg(F.min("parser_id").alias("m")).select(F.col("ingest_run_id").alias("run_id"), F.col("m").alias("manifest")), table(s, d, "papers").groupBy("ingest_run_id").agg(F.max("parser_id").alias("m")).select(F.col("ingest_run_id").alias("run_id"), F.col("m").alias("manifest"))),
    "SELECT ingest_run_id AS run_id, CASE WHEN min(parser_id) IS NULL THEN 'insert' WHEN min(parser_id) = max(parser_id) THEN 'noop' ELSE 'conflict' END AS action FROM papers GROUP BY ingest_run_id",
)

_add("manifest_status_counts", lambda s, d: tb.zero_filled(_manifest(s, d), "status", mf.STATES), f"WITH {_MANIFEST} SELECT v AS status, count(status) AS n FROM (VALUES {', '.join(f'({x!r})' for x in mf.STATES)}) t(v) LEFT JOIN manifest ON status = v GROUP BY v")


def _ingested(s, d):
    """The whole ingest over the papers as LaTeX trees, twice: the second run skips what the first has parsed."""
    import uuid

    root = f"{shared_folder(s)}/corpus-{uuid.uuid4().hex}"
    files = _trees(s, d).select("doc_id", F.explode("files").alias("path", "content"))
    both = [corpus.ingest(files, root).withColumn("run", F.lit(k)) for k in (1, 2)]
    return both[0].unionByName(both[1]).select("run", "n_seen", "n_parsed", "n_failed", "n_skipped", "n_new_documents", "n_chunks", "n_new_chunks", "n_duplicates")


_add("ingest_pipeline", _ingested)
_LIMITS = {"unexpanded_macro_rate": 0.1, "broken_math_span_rate": 0.05, "short_span_rate": 0.2}
_add("constraint_violations", lambda s, d: tb.violations(table(s, d, "parse_quality").select("doc_id", *_LIMITS), "doc_id", _LIMITS), " UNION ALL ".join(f"SELECT doc_id, '{c}' AS name, {x}::DOUBLE AS most, {c} AS actual FROM parse_quality WHERE {c} > {x}" for c, x in _LIMITS.items()))


def _migrated(s, d):
    import uuid

    name = "ledger_" + uuid.uuid4().hex
    tb.create_ledger(s, name)
    tb.migrate(s, name)
    out = s.createDataFrame([(t, len(s.table(f"{name}.{t}").columns)) for t in sorted(tb.LEDGER)], "name string, n_columns long")
    s.sql(f"DROP DATABASE {name} CASCADE")
    return out


_add("ledger_migrate", _migrated, "SELECT * FROM (VALUES ('chunks', 8::BIGINT), ('documents', 10), ('errors', 4), ('ingest_runs', 7), ('run_metrics', 4), ('runs', 12), ('schema_version', 1)) t(name, n_columns)")

# Harvest
_add("harvest_summary", lambda s, d: hv.summary(table(s, d, "harvest_records")), "SELECT harvest_id, count(*) AS n_records, count(*) FILTER (WHERE status = 'deleted') AS n_tombstones, count(DISTINCT base_id) AS n_papers FROM harvest_records GROUP BY harvest_id")


def _pages(s, d):
    """The harvest's records written out as the pages they came in."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    r = table(s, d, "harvest_records")
    meta = F.concat(F.lit("<metadata><arXiv><id>"), esc("base_id"), F.when(F.col("version").isNotNull(), F.concat(F.lit("v"), "version")).otherwise(""), F.lit("</id><title>"), esc("title"), F.lit("</title><license>"), esc("license"), F.lit("</license></arXiv></metadata>"))
    record = F.concat(F.lit("<record><header"), F.when(F.col("status") == "deleted", ' status="deleted"').otherwise(""), F.lit("><identifier>"), esc("oai_identifier"), F.lit("</identifier><datestamp>"), esc("datestamp"), F.lit("</datestamp></header>"), F.when(F.col("status") == "deleted", "").otherwise(meta), F.lit("</record>"))
    rows = r.select("harvest_id", F.coalesce("page_token", F.lit("")).alias("token"), F.struct("feed_pos", "rec_seq", record.alias("x")).alias("x")).distinct()
    return rows.groupBy("harvest_id", "token").agg(F.concat(F.lit("<OAI-PMH><ListRecords>"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["x"]), ""), F.lit("</ListRecords></OAI-PMH>")).alias("page"))


_add(
    "oai_parse_records", lambda s, d: hv.parsed_records(_pages(s, d)).groupBy("oai_identifier", "status").agg(F.count("*").alias("n"), F.max("version").alias("version"), F.max("title").alias("title")),
    """SELECT oai_identifier, status, count(*) AS n, max(CASE WHEN status = 'live' THEN version END) AS version, max(CASE WHEN status = 'live' THEN trim(regexp_replace(title, '\\s+', ' ', 'g')) END) AS title
FROM (SELECT DISTINCT harvest_id, coalesce(page_token, '') AS token, feed_pos, rec_seq, base_id, version, oai_identifier, status, coalesce(title, '') AS title, license, datestamp FROM harvest_records) GROUP BY ALL""",
)


def _error_pages(s, d):
    return hv.page_errors(s.createDataFrame([(1, '<OAI-PMH><error code="noRecordsMatch">none</error></OAI-PMH>'), (2, '<OAI-PMH><error code="badResumptionToken">old</error></OAI-PMH>'), (3, "<OAI-PMH></OAI-PMH>")], "page_no long, page string"))


_add("oai_error_page", _error_pages, "SELECT * FROM (VALUES (1::BIGINT, 'noRecordsMatch', TRUE), (2, 'badResumptionToken', FALSE)) t(page_no, code, is_empty_result)")


def _parts(s, d):
    import uuid

    path = f"{shared_folder(s)}/parts-{uuid.uuid4().hex}"
    hv.harvest_parts(table(s, d, "harvest_records"), path, 500)
    files = s.read.parquet(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n"))
    return files.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 500).alias("within"))


_add("harvest_parts", _parts, "SELECT count(*) AS n_rows, TRUE AS within FROM harvest_records")


# Archives
def _tar(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, x in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(x)
            t.addfile(info, io.BytesIO(x))
    return out.getvalue()


def _archives(s):
    main = b"\\documentclass{article}\\begin{document}\\input{part}\\end{document}"
    return s.createDataFrame(
        [
            ("a", bytearray(_tar({"main.tex": main, "part.tex": b"\\section{P}"}))), ("b", bytearray(gzip.compress(main))), ("c", bytearray(b"%PDF-1.5")), ("d", bytearray(b"plain")),
            ("e", bytearray(_tar({"../up.tex": main}))), ("f", bytearray(gzip.compress(b"no markup here"))), ("g", bytearray(_tar({"one.tex": main, "two.tex": main.replace(b"part", b"one")}))),
            ("h", bytearray(_tar({"src/main.tex": main, "supplement.tex": main}))), ("i", bytearray(_tar({"one.tex": main, "two.tex": main}))), ("j", bytearray(_tar({"a.tex": main.replace(b"\\input{part}", b""), "b.tex": b"\\section{B}"}))),
        ],
        "doc_id string, content binary",
    )


def _texts(s):
    return ar.extracted(_archives(s).where(ar.archive_kind(F.col("content")) == "gzip")).where("error is null").select("doc_id", "path", F.col("content").cast("string").alias("content"))


_add("eprint_classify", lambda s, d: _archives(s).select("doc_id", ar.archive_kind(F.col("content")).alias("kind")), "SELECT * FROM (VALUES ('a', 'gzip'), ('b', 'gzip'), ('c', 'pdf'), ('d', 'unknown'), ('e', 'gzip'), ('f', 'gzip'), ('g', 'gzip'), ('h', 'gzip'), ('i', 'gzip'), ('j', 'gzip')) t(doc_id, kind)")
_add("eprint_extract", lambda s, d: ar.extracted(_archives(s).where(ar.archive_kind(F.col("content")) == "gzip")).select("doc_id", "path", F.col("error").isNotNull().alias("refused")), "SELECT * FROM (VALUES ('a', 'main.tex', FALSE), ('a', 'part.tex', FALSE), ('b', 'main.tex', FALSE), ('e', NULL, TRUE), ('f', 'main.txt', FALSE), ('g', 'one.tex', FALSE), ('g', 'two.tex', FALSE), ('h', 'src/main.tex', FALSE), ('h', 'supplement.tex', FALSE), ('i', 'one.tex', FALSE), ('i', 'two.tex', FALSE), ('j', 'a.tex', FALSE), ('j', 'b.tex', FALSE)) t(doc_id, path, refused)")
_add("main_tex_pick", lambda s, d: ar.first_main(_texts(s)), "SELECT * FROM (VALUES ('a', 'main.tex'), ('b', 'main.tex'), ('g', 'one.tex'), ('h', 'src/main.tex'), ('i', 'one.tex'), ('j', 'a.tex')) t(doc_id, main)")
_add("main_tex_resolve", lambda s, d: ar.main_files(_texts(s)).select("doc_id", "main", F.col("rule").cast("bigint").alias("rule")), "SELECT * FROM (VALUES ('a', 'main.tex', 2::BIGINT), ('b', 'main.tex', 1), ('g', 'two.tex', 4), ('h', 'src/main.tex', 2), ('i', NULL, NULL), ('j', 'a.tex', 3)) t(doc_id, main, rule)")
_add("files_hash", lambda s, d: ar.files_hash(table(s, d, "chunks").where("text is not null").select("doc_id", F.col("chunk_uid").alias("path"), F.col("text").alias("content")).distinct()), "SELECT doc_id, sha256(string_agg(x, E'\\n' ORDER BY slot, x)) AS sha FROM (SELECT doc_id, substr(md5(chunk_uid), 1, 3) AS slot, sha256(string_agg(sha256(text), E'\\n' ORDER BY chunk_uid, sha256(text))) AS x FROM (SELECT DISTINCT doc_id, chunk_uid, text FROM chunks WHERE text IS NOT NULL) GROUP BY doc_id, substr(md5(chunk_uid), 1, 3)) GROUP BY doc_id")
_add("resume_locate", lambda s, d: table(s, d, "papers").select("doc_id").distinct().join(table(s, d, "chunks").groupBy("doc_id").agg(F.min("chunk_uid").alias("first_file")), "doc_id", "left"), "SELECT p.doc_id, f.first_file FROM (SELECT DISTINCT doc_id FROM papers) p LEFT JOIN (SELECT doc_id, min(chunk_uid) AS first_file FROM chunks GROUP BY doc_id) f ON p.doc_id = f.doc_id")
