import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus, runs, tables
from quillspark.operators import manifest as mf
from quillspark.operators.latex import parse
from quillspark.schemas import ChunkerConfig
from quillspark.sources.client import FetchError, PoliteClient, Spacing

SHARED = " ".join(f"shared{i}" for i in range(60))
DOC = "\\documentclass{{article}}\\begin{{document}}\\section{{One}} {0} {1}\\end{{document}}"


def files(spark, extra=()):
    rows = [("a", "main.tex", DOC.format(SHARED, "first ending words differ here")), ("b", "main.tex", DOC.format(SHARED, "second tail is of another kind")), ("c", "x.tex", "no class"), ("c", "y.tex", "none"), ("d", "m.tex", "\\documentclass{a}\\input{m}"), *extra]
    return spark.createDataFrame(rows, "doc_id string, path string, content string")


def test_three_runs_change_nothing(spark, tmp_path):
    root = str(tmp_path / "corpus")
    how = corpus.IngestConfig(ChunkerConfig(100, 0))
    first = corpus.ingest(files(spark), root, how).first()
    assert (first.n_seen, first.n_new_documents, first.n_failed) == (4, 2, 2) and first.n_new_chunks == first.n_chunks > 0 and first.n_duplicates > 0
    chunks = tables.kept(spark, f"{root}/chunks")
    before = {tuple(r) for r in chunks.select("chunk_uid", "dup_of").collect()}
    for _ in range(2):
        again = corpus.ingest(files(spark), root, how).first()
        assert (again.n_new_documents, again.n_new_chunks, again.n_chunks, again.n_failed) == (0, 0, first.n_chunks, 2)
        assert (again.n_skipped, again.n_parsed) == (2, 0) and again.corpus_snapshot == first.corpus_snapshot
    states = {r.doc_id: (r.status, r.failure_reason) for r in tables.kept(spark, f"{root}/manifest").collect()}
    assert states["a"] == ("parsed", None) and states["c"] == ("failed", "acquire: no main file") and states["d"][0] == "failed" and "cycle" in states["d"][1]
    assert tables.kept(spark, f"{root}/errors").count() == 6 and tables.kept(spark, f"{root}/ingest_runs").where("finished_at is not null and n_errors = 2").count() == 3
    assert {tuple(r) for r in tables.kept(spark, f"{root}/chunks").select("chunk_uid", "dup_of").collect()} == before
    changed = files(spark).withColumn("content", F.when(F.col("doc_id") == "a", F.concat("content", F.lit(""))).otherwise(F.replace("content", F.lit("second"), F.lit("third"))))
    assert corpus.ingest(changed, root, how).first().n_failed == 3
    text = tables.kept(spark, f"{root}/canonical").where("doc_id = 'a'").first().text
    assert text == parse({"main.tex": DOC.format(SHARED, "first ending words differ here")}, "main.tex").text


def test_a_stopped_run_is_taken_up(spark, tmp_path, monkeypatch):
    """Stops after each write of the first run; the next run ends with what a whole run gives."""
    how = corpus.IngestConfig(ChunkerConfig(100, 0), dedup=False)
    whole = str(tmp_path / "whole")
    corpus.ingest(files(spark), whole, how)
    shown = lambda root, name, *c: sorted(map(tuple, tables.kept(spark, f"{root}/{name}").select(*c).collect()))
    for stop in ("canonical", "chunks", "manifest"):
        root, real = str(tmp_path / stop), tables.swap

        def stopping(df, path, keep=2, stop=stop, real=real):
            real(df, path, keep)
            if path.endswith("/" + stop):
                raise KeyboardInterrupt

        monkeypatch.setattr(tables, "swap", stopping)
        with pytest.raises(KeyboardInterrupt):
            corpus.ingest(files(spark), root, how)
        monkeypatch.setattr(tables, "swap", real)
        corpus.ingest(files(spark), root, how)
        assert shown(root, "chunks", "chunk_uid") == shown(whole, "chunks", "chunk_uid") and shown(root, "manifest", "doc_id", "status") == shown(whole, "manifest", "doc_id", "status")
        assert shown(root, "quality", "doc_id") == shown(whole, "quality", "doc_id")


def test_snapshots_are_whole_or_not_there(spark, tmp_path):
    path, one, two = str(tmp_path / "t"), spark.range(1), spark.range(2)
    with pytest.raises(FileNotFoundError):
        tables.kept(spark, path)
    assert tables.kept(spark, path, "id long").count() == 0
    tables.swap(one, path)
    two.write.parquet(f"{path}/snapshot-2")  # a writer that stopped before its marker
    assert tables.kept(spark, path).count() == 1
    tables.swap(spark.range(3), path)
    assert tables.kept(spark, path).count() == 3 and not (tmp_path / "t" / "snapshot-2").exists() and (tmp_path / "t" / "snapshot-1").exists()
    tables.swap(two, path)
    assert tables.kept(spark, path).count() == 2 and not (tmp_path / "t" / "snapshot-1").exists()


def test_manifest(spark):
    empty = spark.createDataFrame([], mf.MANIFEST)
    at = mf.seeded(empty, spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "doc_id string"))
    assert sorted((r.doc_id, r.status) for r in at.collect()) == [("a", "pending"), ("b", "pending")]
    at = mf.marked(at, spark.createDataFrame([("a", "acquired", "h1"), ("c", "failed", None)], "doc_id string, status string, content_hash string").withColumn("failure_reason", F.when(F.col("doc_id") == "c", "gone")))
    assert mf.seeded(at, spark.createDataFrame([("a",)], "doc_id string")).where("doc_id = 'a'").first().status == "acquired"
    at = mf.marked(at, spark.createDataFrame([("a", "parsed", "latex")], "doc_id string, status string, parser_used string"))
    got = {r.doc_id: (r.status, r.content_hash, r.parser_used, r.failure_reason) for r in at.collect()}
    assert got == {"a": ("parsed", "h1", "latex", None), "b": ("pending", None, None, None), "c": ("failed", None, None, "gone")}
    needs = {r.doc_id: r.needs for r in mf.needs_acquisition(spark.createDataFrame([(x,) for x in "abcd"], "doc_id string"), at).collect()}
    assert needs == {"a": False, "b": True, "c": True, "d": True} and [r.doc_id for r in mf.live(at).collect()] == ["a"]
    with pytest.raises(Exception, match="before it was acquired"):
        mf.marked(at, spark.createDataFrame([("z", "tombstoned")], "doc_id string, status string")).collect()


def test_ledger(spark):
    runs_ = spark.createDataFrame([("r1", "{}"), ("r2", "{}")], "run_id string, manifest string")
    runs_ = runs_.select("run_id", "manifest", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in tables.LEDGER["runs"].split(", ")[2:]])
    metrics = spark.createDataFrame([("r1", "q", "old", 0.5), ("r2", "q", "m", 0.1)], tables.LEDGER["run_metrics"])
    out = spark.createDataFrame([("r1", "finished", None, "{}", 0.5, 100.0)], "run_id string, status string, finished_at timestamp_ntz, metrics string, cost_usd double, peak_rss_mb double")
    per = spark.createDataFrame([("r1", "q", "m", 0.9)], tables.LEDGER["run_metrics"])
    ms = spark.createDataFrame([("r1", float(x)) for x in (1, 2, 3, 4, 1000)], "run_id string, ms double")
    for _ in range(2):
        runs_, metrics = tables.run_finished(runs_, metrics, out, per, ms)
    got = {r.run_id: (r.status, r.p50_ms, round(r.p95_ms or 0, 6)) for r in runs_.collect()}
    assert got == {"r1": ("finished", 3.0, 800.8), "r2": (None, None, 0)} and sorted(map(tuple, metrics.collect())) == [("r1", "q", "m", 0.9), ("r2", "q", "m", 0.1)]
    assert {(r.name, round(r.actual, 6)) for r in tables.run_violations(runs_).collect()} == {("max_p95_latency_ms", 800.8), ("max_cost_per_query_usd", 0.5)}
    assert [r.run_id for r in tables.listed_runs(runs_, "cost_usd", limit=1).collect()] == ["r1"]
    with pytest.raises(ValueError):
        tables.listed_runs(runs_, "manifest")
    with pytest.raises(Exception, match="unknown run"):
        tables.run_finished(runs_, metrics, out.withColumn("run_id", F.lit("r9")), per, ms)[0].collect()
    docs = spark.createDataFrame([("a", None), ("b", None)], "doc_id string, tombstoned_at timestamp_ntz")
    chunks = spark.createDataFrame([("1", "a", None), ("2", "b", None), ("3", "z", None)], "chunk_uid string, doc_id string, tombstoned_at timestamp_ntz")
    dead = spark.sql("select * from values ('a', timestamp_ntz '2024-01-01'), ('z', timestamp_ntz '2024-01-01') t(doc_id, at)")
    d, c = tables.documents_tombstoned(docs, chunks, dead)
    assert {r.doc_id for r in d.where("tombstoned_at is not null").collect()} == {"a"} and {r.chunk_uid for r in c.where("tombstoned_at is not null").collect()} == {"1"}


def test_run_files(spark, tmp_path):
    m = runs.RunManifest("snap", "fixed.v1", "none", "latex.v1", "none", 2, "dev", index_params={"k": 2.0})
    rows = spark.createDataFrame([("q", "d", "c", 0, 5, 1, 0.5)], "query_id string, doc_id string, chunk_uid string, char_start long, char_end long, rank long, score double")
    path = str(tmp_path / "run")
    runs.write_run(rows, path, m)
    df, back = runs.read_run(spark, path)
    assert back.run_id() == m.run_id() and df.first().run_id == m.run_id()
    with pytest.raises(Exception, match="(?i)exist"):
        runs.write_run(rows, path, m)
    with pytest.raises(ValueError):
        runs.write_run(rows.withColumn("rank", F.lit(0)), path + "2", m)
    rows.write.parquet(path + "3")
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, path + "3")


def test_configuration():
    assert runs.configured(ChunkerConfig, "size: 100\noverlap: 10") == ChunkerConfig(100, 10)
    for bad in ("width: 3", "size: 0"):
        with pytest.raises(ValueError):
            runs.configured(ChunkerConfig, bad)


def test_polite_client():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    answers = [(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b"ok")]
    client = PoliteClient(lambda url, params: answers.pop(0), Spacing(3.0, lambda: now[0], sleep))
    assert client.get("u") == b"ok" and 7.0 in slept and now[0] >= 9
    client.transport = lambda url, params: (404, {}, b"")
    with pytest.raises(FetchError, match="404"):
        client.get("u")
    calls = []

    def broken(url, params):
        calls.append(url)
        raise OSError("down")

    client.transport = broken
    with pytest.raises(FetchError, match="down"):
        client.get("u")
    assert len(calls) == 5
