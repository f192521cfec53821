"""Work that grows with the tables is done in full and without a row for each step of it."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import plans
from quillspark.functions import digests
from quillspark.functions import statistics as st
from quillspark.operators import dedup, evaluation
from quillspark.plans import inputs

DATA = "/root/testdata/sf0.001"
QUERIES = plans.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_minima_are_those_of_every_shingle(spark):
    sets = spark.createDataFrame([("a", [5, -7, 2**62]), ("b", [-(2**63)]), ("a", [11]), ("c", []), ("d", list(range(-20_000, 20_000)))], "key string, shingles array<long>")
    rows = sets.select("key", F.explode("shingles").alias("h"))
    want = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(9)])
    got = dedup.minhash(sets, 9)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 3
    assert "Generate" not in plan(QUERIES["minhash_signature"](spark, DATA))


def test_signatures_have_all_128_minima(spark):
    assert QUERIES["minhash_signature"](spark, DATA).columns == ["key", "n", *[f"m{k}" for k in range(128)]]


def test_lowest_digests_of_texts_of_any_length():
    r = random.Random(3)
    heads = [b"", b"a:", *[b"a:q%d:" % r.randrange(10**k) for k in (1, 3, 7, 7, 7, 8, 40)], b"x" * 70]
    texts = [b"", *[bytes(r.choices(range(256), k=n)) for n in (4, 5, 46, 47, 54, 55, 56, 57, 64, 64, 100, 119, 120, 200) for _ in range(9)]]
    for most in (7, len(texts), 500):
        found = {(h, t) for some in digests.lowest(heads, texts, most) for h, t in zip(*(x.tolist() for x in some), strict=True)}
        assert found == {(h, t) for h in range(len(heads)) for t in sorted(range(len(texts)), key=lambda t: hashlib.md5(heads[h] + texts[t]).digest())[:most]}


def test_a_run_hashes_every_chunk_of_a_long_document(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "_HEADS", 2)
    monkeypatch.setattr(evaluation, "_TEXTS", 700)
    chunks = [(f"{'é' * (k % 3)}c{k}", "long" if k < 2500 else f"d{k % 40}", k, k + 5) for k in range(3000)]
    asked = [*[(f"q{k}", "long") for k in range(7)], *[(f"q{k}", f"d{k}") for k in range(5, 20)], ("q0", "none"), (None, "long"), ("q0", None)]
    pairs = spark.createDataFrame(asked, "query_id string, doc_id string")
    got = {}
    for x in evaluation.hashed_run(pairs, spark.createDataFrame(chunks, "chunk_uid string, doc_id string, char_start long, char_end long"), "s", 20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.chunk_uid, x.doc_id, x.char_start, x.char_end))
    want = {}
    for q in {q for q, _ in asked}:
        own = [c for c in chunks if (q, c[1]) in asked]
        first = sorted(own, key=lambda c: (hashlib.md5(f"s:{q}:{c[0]}".encode()).hexdigest() if q is not None else "", c[0]))[:20]
        want[q] = [(k, *c) for k, c in enumerate(first, 1)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_pairs_of_a_long_document_become_no_rows(spark):
    """paired_align and all that reads a run: of a document's pairs only those of lowest digests leave the Python workers."""
    chunks = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("chunk_uid"), F.lit("long").alias("doc_id"), F.col("id").alias("char_start"), (F.col("id") + 5).alias("char_end"))
    pairs = spark.range(30).select(F.concat(F.lit("q"), "id").alias("query_id"), F.lit("long").alias("doc_id"))
    df = evaluation.hashed_run(pairs, chunks, "s", 20)
    assert df.count() == 600 and "MapInArrow" in plan(df)


def test_draws_by_arrays_are_those_of_the_expression(spark):
    t, i = [0, 1, 77, 9_999], [0, 1, 5_000, 999_999, 2_147_483_646, 2_147_483_647]
    grid = spark.createDataFrame([(x, y) for x in t for y in i], "t long, i long").select(st.draw(F.col("t"), F.col("i")).alias("x"))
    assert st.draws(np.array(t), np.array(i)).ravel().tolist() == [r.x for r in grid.collect()]


@pytest.mark.parametrize("n", [1, 300, 40_000])
def test_resamples_take_no_row_a_draw(spark, monkeypatch, n):
    """paired_bootstrap: arrays of draws give what rows of draws give."""
    pairs = spark.range(n).select(F.format_string("q%07d", "id").alias("query_id"), F.lit(0.5).alias("a"), (F.xxhash64("id") / 2.0**63).alias("b"))
    own = {r.t: r.mean for r in st.resampled_means(pairs, 30).collect()}
    assert "Generate" not in plan(st.resampled_means(pairs, 30))
    monkeypatch.setattr(st, "_NEAR", 0)
    assert own == pytest.approx({r.t: r.mean for r in st.resampled_means(pairs, 30).collect()}, abs=1e-12)


def test_a_run_file_is_scanned_whole(spark):
    write, scan = (QUERIES[f"run_file_{x}"](spark, DATA) for x in ("write", "scan"))
    assert scan.columns == write.columns and sorted(scan.collect()) == sorted(write.collect()) and scan.where("rank > 3").count() > 0


@pytest.fixture(scope="module")
def long_document(tmp_path_factory):
    """Tables with a document of 2,500 chunks that 12 queries judge, one of them without an id, beside short ones."""
    folder = tmp_path_factory.mktemp("long")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE chunks AS SELECT 'c' || md5(k::VARCHAR) AS chunk_uid, CASE WHEN k < 2500 THEN 'long' ELSE 'd' || k % 40 END AS doc_id, (k % 50 * 10)::INT AS char_start, (k % 50 * 10 + 25)::INT AS char_end FROM range(2900) t(k)")
    duck.execute("CREATE TABLE qrels AS SELECT 1 + k % 2 AS qrels_version, CASE WHEN k % 13 < 12 THEN 'q' || k % 13 END AS query_id, CASE WHEN k < 26 THEN 'long' ELSE 'd' || k % 40 END AS doc_id, k * 7 % 400 AS char_start, k * 7 % 400 + 30 AS char_end, k % 4 AS grade FROM range(200) t(k)")
    for t in ("chunks", "qrels"):
        duck.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder), duck


#: Queries that read a run, with the runs that each reads.
_READ_RUNS = {
    "paired_verdict": 2,
    "randomization_test": 2,
    "rescore_midpoint": 1,
    "run_file_scan": 1,
    "metric_ndcg_at_k": 1,
    "metric_success_at_k": 1,
    "rank_assign": 1,
    "rescore_wide": 1,
    "run_file_write": 1,
    "span_relevance": 1,
    "min_detectable_effect": 2,
    "paired_checks": 2,
    "required_n": 2,
    "paired_align": 2,
    "paired_bootstrap": 2,
}


@pytest.mark.parametrize("name", _READ_RUNS)
def test_over_a_long_document(spark, monkeypatch, long_document, name):
    """A query takes its runs from hashed_run, which makes no row of a long document's pairs, and gives what its SQL gives."""
    folder, duck = long_document
    made = []
    monkeypatch.setattr(inputs, "hashed_run", lambda *a: made.append(a) or evaluation.hashed_run(*a))
    df = QUERIES[name](spark, folder)
    columns, cursor = sorted(df.columns), duck.execute(plans.sql()[name])
    names = [x[0] for x in cursor.description]
    plain = lambda v: round(v, 8) if isinstance(v, float) else v
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect()) == want and len(made) == _READ_RUNS[name]
