"""Judgements, ranked runs and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import statistics as st
from quillspark.operators import evaluation as ev
from quillspark.operators import qrels as qr
from quillspark.plans.inputs import GOLD, SPANS, SPECS, gold, hits_cte, overlap_sql, rescore_sql, run, run_cte
from quillspark.storage import shared_folder, table, written

QUERIES, SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_T = 0.1  # overlap from which a chunk counts
_add(
    "rescore_wide", lambda s, d: ev.with_provenance(ev.rescore(run(s, d), gold(s, d), SPECS, "iou", _T), "run-a", table(s, d, "qrels").agg(F.max("qrels_version")), "iou", _T),
    f"SELECT r.*, 'run-a' AS run_id, (SELECT max(qrels_version) FROM qrels) AS qrels_version, 'iou' AS overlap_rule, {_T}::DOUBLE AS overlap_threshold FROM ({rescore_sql(SPECS)}) r",
)
_add("rescore_midpoint", lambda s, d: ev.rescore(run(s, d), gold(s, d), SPECS, "midpoint"), rescore_sql(SPECS, rule="midpoint"))
for _name, _k in (("recall", 10), ("precision", 10), ("mrr", 10), ("ndcg", 10), ("success", 10)):
    _add(f"metric_{_name}_at_k", lambda s, d, x=f"{_name}@{_k}": ev.rescore(run(s, d), gold(s, d), [x], "iou", _T), rescore_sql([f"{_name}@{_k}"]))
for _rule in ("iou", "midpoint"):
    _add(
        f"span_overlap_{_rule}", lambda s, d, r=_rule: ev.matches(run(s, d), gold(s, d), r, _T).select("query_id", "chunk_uid", "gs", "ge", "grade"),
        f"WITH {SPANS}, {GOLD}, {run_cte()}, {hits_cte(_rule, _T)} SELECT query_id, chunk_uid, gs, ge, grade FROM hits",
    )
_add(
    "span_relevance", lambda s, d: ev.relevance(run(s, d), gold(s, d), "iou", _T).select("query_id", F.col("pos").cast("bigint").alias("pos"), "chunk_uid", "rel"),
    f"WITH {SPANS}, {GOLD}, {run_cte()} SELECT r.query_id, r.rank AS pos, r.chunk_uid, coalesce(max(CASE WHEN g.grade > 0 AND {overlap_sql('iou', _T)} THEN g.grade END), 0) AS rel FROM run r LEFT JOIN gold g ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY r.query_id, r.rank, r.chunk_uid",
)
_add("rank_assign", lambda s, d: ev.rank_assigned(run(s, d, "a").select("query_id", "chunk_uid", F.round(F.col("score"), 1).alias("score"))).select("query_id", "chunk_uid", F.col("rank").cast("bigint").alias("rank")), f"WITH {SPANS}, {run_cte()} SELECT query_id, chunk_uid, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, chunk_uid) AS rank FROM run")
_add("group_by_query", lambda s, d: run(s, d).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_uid"))), lambda x: x["chunk_uid"]), ",").alias("chunks")), f"WITH {SPANS}, {run_cte()} SELECT query_id, string_agg(chunk_uid, ',' ORDER BY rank) AS chunks FROM run GROUP BY query_id")
_add("run_query_ids", lambda s, d: run(s, d).select("query_id").distinct().orderBy("query_id"), f"WITH {SPANS}, {run_cte()} SELECT DISTINCT query_id FROM run ORDER BY query_id")


def _written_run(s, d):
    import uuid

    path = f"{shared_folder(s)}/run-{uuid.uuid4().hex}"
    run(s, d).write.mode("errorifexists").parquet(path)
    return s.read.parquet(path)


_RUN_COLUMNS = "query_id, doc_id, chunk_uid, char_start, char_end, rank, score, run_id"
_add("run_file_write", _written_run, f"WITH {SPANS}, {run_cte()} SELECT {_RUN_COLUMNS} FROM run")
_add("run_file_scan", _written_run, f"WITH {SPANS}, {run_cte()} SELECT {_RUN_COLUMNS} FROM run")
_add(
    "run_file_validate", lambda s, d: ev.run_rejects(table(s, d, "chunks").select("chunk_uid", "char_start", "char_end", F.lit(1).alias("rank"))).select("chunk_uid", "char_start", "char_end"),
    "SELECT chunk_uid, char_start, char_end FROM chunks WHERE coalesce(char_start < 0 OR char_end <= char_start, TRUE)",
)

# Judgements
_QRELS = "SELECT qrels_version, query_id, doc_id, char_start, char_end, grade, judge, judged_at FROM qrels"
_add("qrels_load", lambda s, d: table(s, d, "qrels").where("qrels_version = 2"), f"{_QRELS} WHERE qrels_version = 2")
_add("qrels_latest_version", lambda s, d: qr.latest_version(table(s, d, "qrels")), "SELECT max(qrels_version) AS latest_version, count(DISTINCT qrels_version) AS n_versions FROM qrels")
_add("qrels_dup_check", lambda s, d: qr.duplicates(table(s, d, "qrels")), "SELECT qrels_version, query_id, doc_id, char_start, char_end, count(*) AS n FROM qrels GROUP BY ALL HAVING count(*) > 1")
_add("qrels_meta", lambda s, d: qr.meta(table(s, d, "qrels")), "SELECT qrels_version, count(DISTINCT query_id) AS n_queries, count(*) AS n_judgements, string_agg(DISTINCT judge, ',' ORDER BY judge) AS judges FROM qrels GROUP BY qrels_version")
_add(
    "qrels_diff", lambda s, d: qr.diff(table(s, d, "qrels").where("qrels_version = 1"), table(s, d, "qrels").where("qrels_version = 2")),
    """WITH a AS (SELECT query_id, doc_id, char_start, char_end, max(grade) AS old_grade FROM qrels WHERE qrels_version = 1 GROUP BY ALL), b AS (SELECT query_id, doc_id, char_start, char_end, max(grade) AS new_grade FROM qrels WHERE qrels_version = 2 GROUP BY ALL)
SELECT *, CASE WHEN old_grade IS NULL THEN 'added' WHEN new_grade IS NULL THEN 'removed' WHEN old_grade <> new_grade THEN 'regraded' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (query_id, doc_id, char_start, char_end)""",
)
_add("qrels_for_query", lambda s, d: table(s, d, "qrels").join(table(s, d, "qrels").agg(F.min("query_id").alias("query_id")), "query_id", "left_semi"), f"{_QRELS} WHERE query_id = (SELECT min(query_id) FROM qrels)")
_add("qrels_queries", lambda s, d: table(s, d, "qrels").where("grade > 0").select("query_id").distinct(), "SELECT DISTINCT query_id FROM qrels WHERE grade > 0")


def _appended(s, d):
    import uuid

    root = f"{shared_folder(s)}/qrels-{uuid.uuid4().hex}"
    first = gold(s, d).select("query_id", "doc_id", "char_start", "char_end", "grade", F.lit("merged").alias("judge"), F.lit(None).cast("string").alias("judged_at"))
    qr.append(s, root, first)
    qr.append(s, root, first.withColumn("grade", F.least(F.lit(3), F.col("grade") + 1)))
    return qr.load(s, root, 2).select("query_id", "doc_id", "char_start", "char_end", "grade")


_add("qrels_append", _appended, f"WITH {GOLD} SELECT query_id, doc_id, char_start, char_end, least(3, grade + 1) AS grade FROM gold")


# Paired comparison of two runs
def _metrics(s, d):
    both = [ev.rescore(run(s, d, x), gold(s, d), ["ndcg@10"], "iou", _T).select(F.lit(f"run-{x}").alias("run_id"), "query_id", F.lit("ndcg@10").alias("metric"), F.col("ndcg_at_10").alias("value")) for x in ("a", "b")]
    return both[0].unionByName(both[1])


def _pairs(s, d):
    return written(ev.paired(_metrics(s, d), "run-a", "run-b", "ndcg@10"), "pairs")


_PAIRS = f"pairs AS (SELECT x.query_id, x.ndcg_at_10 AS a, y.ndcg_at_10 AS b FROM ({rescore_sql(['ndcg@10'], 'a')}) x JOIN ({rescore_sql(['ndcg@10'], 'b')}) y ON x.query_id = y.query_id WHERE x.ndcg_at_10 IS NOT NULL AND y.ndcg_at_10 IS NOT NULL)"
_NUMBERED = f"WITH {_PAIRS}, rows AS (SELECT b - a AS d, row_number() OVER (ORDER BY query_id) - 1 AS i, count(*) OVER () AS n FROM pairs)"
_TIMES = 10_000
_DRAWS = f"draws AS (SELECT t, i, d, n, {st.draw_sql('t', 'i')} AS draw FROM rows, range({_TIMES}) x(t))"
_MEANS = f"{_DRAWS}, means AS (SELECT t, avg(r.d) AS mean FROM draws p JOIN rows r ON r.i = p.draw % p.n GROUP BY t)"
_add("paired_align", _pairs, f"WITH {_PAIRS} SELECT query_id, a, b FROM pairs")
_add("paired_checks", lambda s, d: _pairs(s, d).agg(F.count("*").alias("n"), F.count_if(F.isnan("a") | F.isnan("b")).alias("n_nan"), F.count_distinct("query_id").alias("n_queries")), f"WITH {_PAIRS} SELECT count(*) AS n, count(*) FILTER (WHERE isnan(a) OR isnan(b)) AS n_nan, count(DISTINCT query_id) AS n_queries FROM pairs")


def _verdict(boot):
    return boot.select(F.when((F.col("low") <= 0) & (F.col("high") >= 0) | (F.abs("delta") < 0.02), "indistinguishable").when(F.col("delta") > 0, "b_better").otherwise("a_better").alias("verdict"))


def _rounded(df, *names):
    return df.select(*[F.round(c, 8).alias(c) if c in names else c for c in df.columns])


_BOOT = f"{_NUMBERED}, {_MEANS} SELECT (SELECT count(*) FROM rows) AS n, round((SELECT avg(d) FROM rows), 8) AS delta, round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high, round(avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END), 8) AS above FROM means"
_add("paired_bootstrap", lambda s, d: _rounded(st.bootstrap_table(_pairs(s, d), _TIMES), "delta", "low", "high", "above"), _BOOT)
_RAND = f"""{_NUMBERED}, {_DRAWS}, flips AS (SELECT t, avg(CASE WHEN draw % 2 = 0 THEN d ELSE -d END) AS mean FROM draws GROUP BY t), seen AS (SELECT avg(d) AS delta FROM rows)
SELECT round(max(delta), 8) AS delta, round((count(*) FILTER (WHERE abs(mean) >= abs(delta) - 1e-12) + 1) / (count(*) + 1), 8) AS p FROM flips, seen"""
_add("randomization_test", lambda s, d: _rounded(st.randomization_table(_pairs(s, d), _TIMES), "delta", "p"), _RAND)
_add(
    "paired_verdict", lambda s, d: _verdict(st.bootstrap_table(_pairs(s, d), _TIMES)),
    f"SELECT CASE WHEN (low <= 0 AND high >= 0) OR abs(delta) < 0.02 THEN 'indistinguishable' WHEN delta > 0 THEN 'b_better' ELSE 'a_better' END AS verdict FROM ({_BOOT})",
)
_Z = st.norm_ppf(0.975) + st.norm_ppf(0.8)
_add("min_detectable_effect", lambda s, d: _pairs(s, d).agg(F.round(st.min_detectable_effect(F.stddev_samp(F.col("b") - F.col("a")), F.count("*")), 8).alias("mde")), f"WITH {_PAIRS} SELECT round({_Z!r} * stddev_samp(b - a) / sqrt(count(*)), 8) AS mde FROM pairs")
_add("required_n", lambda s, d: _pairs(s, d).agg(st.required_n(F.stddev_samp(F.col("b") - F.col("a")), 0.02).alias("n")), f"WITH {_PAIRS} SELECT CAST(greatest(1, ceil(pow({_Z!r} * stddev_samp(b - a) / 0.02, 2))) AS BIGINT) AS n FROM pairs")
_add("norm_ppf", lambda s, d: s.createDataFrame([(p, round(st.norm_ppf(p), 6)) for p in (0.025, 0.5, 0.8, 0.975)], "p double, z double"), "SELECT * FROM (VALUES (0.025::DOUBLE, -1.959964::DOUBLE), (0.5, 0.0), (0.8, 0.841621), (0.975, 1.959964)) t(p, z)")
_add("latency_percentiles", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95")), "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
