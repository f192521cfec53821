"""What the registered queries that have no SQL do in full."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillspark import plans
from quillspark.functions import statistics as st
from quillspark.operators import corpus, dedup, structure, tables
from quillspark.operators.latex import parse


def test_whole_comparison_draws_ten_thousand(spark):
    queries = plans.queries()
    d = np.array([r.b - r.a for r in queries["paired_align"](spark, DATA).orderBy("query_id").collect()])
    grid = spark.range(10_000).select(F.col("id").alias("t")).select("t", F.explode(F.sequence(F.lit(0), F.lit(len(d) - 1))).alias("i"))
    draws = np.array(grid.orderBy("t", "i").select(st.draw(F.col("t"), F.col("i")).alias("x")).toPandas()["x"]).reshape(10_000, len(d))
    means = d[draws % len(d)].mean(axis=1)
    boot = queries["paired_bootstrap"](spark, DATA).first()
    assert [boot.n, boot.low, boot.high] == pytest.approx([len(d), *np.quantile(means, [0.025, 0.975])], abs=1e-8)
    assert boot.above == pytest.approx((means > 0).mean(), abs=0.02)  # means of 0 but for rounding
    flips = (d * np.where(draws % 2 == 0, 1, -1)).mean(axis=1)
    p = ((np.abs(flips) >= abs(d.mean()) - 1e-12).sum() + 1) / 10_001
    assert queries["randomization_test"](spark, DATA).first().p == pytest.approx(p, abs=1e-8)
    won = "indistinguishable" if boot.low <= 0 <= boot.high or abs(d.mean()) < 0.02 else "b_better" if d.mean() > 0 else "a_better"
    assert queries["paired_verdict"](spark, DATA).first().verdict == won
    own = st.bootstrap([0.0] * len(d), list(d))
    assert [boot.low, boot.high] == pytest.approx([own["low"], own["high"]], abs=0.02)


def test_crowded_sets_with_few_rare_shingles(spark):
    """Mostly common sets that are alike only by their rare shingles, without any key in common."""
    t, hot = 0.7, 20
    sets = {k: set(range(100)) | {1000 + 10 * k + j for j in range(5)} for k in range(2, 30)}
    sets[0] = set(range(75)) | set(range(200, 215))
    sets[1] = set(range(64)) | set(range(200, 236))
    rng = np.random.default_rng(4)
    for k in range(30, 90):
        sets[k] = set(rng.choice(100, rng.integers(50, 90), replace=False).tolist()) | set((300 + rng.choice(60, rng.integers(5, 30), replace=False)).tolist())
    df = {x: sum(x in s for s in sets.values()) for x in set().union(*sets.values())}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
    want = {(a, b) for a, b in alike if any(df[x] <= hot for x in sets[a] & sets[b])}
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "klass long, shingles array<long>")
    keyless = spark.createDataFrame([], "klass long, bucket long")
    keyed = spark.createDataFrame([(k, 7) for k in sets], "klass long, bucket long")
    pairs = lambda buckets: {tuple(r) for r in dedup.crowded_pairs(rows, buckets, t, hot).collect()}
    assert (0, 1) in want and want <= pairs(keyless)
    assert alike - want and alike <= pairs(keyed)


def test_coverage_by_sections(spark):
    df = spark.createDataFrame([("a", "x" * 10), ("b", "y" * 8), ("c", ""), ("d", "z" * 5), ("e", None), ("f", "u")], "doc_id string, text string")
    sections = spark.createDataFrame([("a", 2, 4), ("a", 4, 7), ("b", 0, 6), ("b", 3, 8), ("c", 0, 1)], "doc_id string, char_start int, char_end int")
    covered = structure.section_chars(sections).unionByName(spark.createDataFrame([("f", None)], "doc_id string, section_chars long"))
    want = {"a": 0.5, "b": 1.0, "c": 0.0, "d": 0.0, "f": None}
    assert {r.doc_id: r.mean_section_label_coverage for r in structure.section_coverage(df, covered).collect()} == want
    assert {r.doc_id: r.mean_section_label_coverage for r in structure.quality_report(df, covered).collect()} == want


def test_quality_queries_cover_every_document(spark):
    queries = plans.queries()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").collect()}
    chars = dict.fromkeys(texts, 0)
    for r in queries["section_offsets"](spark, DATA).collect():
        chars[r.doc_id] += r.char_end - r.char_start
    want = {k: round(min(1.0, n / len(texts[k])), 9) if texts[k] else 0.0 for k, n in chars.items()}
    assert {r.doc_id: r.coverage for r in queries["quality_coverage"](spark, DATA).collect()} == want
    assert {r.doc_id: r.mean_section_label_coverage for r in queries["quality_report"](spark, DATA).collect()} == want


def test_ingest_keeps_sections_and_their_coverage(spark, tmp_path):
    body = "\\documentclass{article}\\begin{document}before it \\section{One} text of one \\section{Two} text of two\\end{document}"
    trees = {"a": body, "b": "\\documentclass{article}\\begin{document}no heading at all\\end{document}"}
    files = spark.createDataFrame([(k, "main.tex", x) for k, x in trees.items()], "doc_id string, path string, content string")
    root = str(tmp_path / "corpus")
    want = {}
    for k, x in trees.items():
        p = parse({"main.tex": x}, "main.tex")
        want[k] = round(min(1.0, sum(end - start for _, start, end in p.sections) / len(p.text)), 9)
    rates = lambda: {r.doc_id: r.mean_section_label_coverage for r in tables.kept(spark, f"{root}/quality").collect()}
    corpus.ingest(files, root)
    assert 0 < want["a"] < 1 and want["b"] == 0 and rates() == want
