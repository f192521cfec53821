"""Inputs that several queries share, built the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.evaluation import hashed_run
from quillspark.storage import table, written

#: Metrics of the flagship query.
SPECS = ["recall@5", "recall@10", "precision@10", "mrr@10", "ndcg@10", "success@5"]


def spans(spark, d) -> DataFrame:
    """One row for each chunk id with a proper span. The number of partitions is given, so that adaptive execution does
    not join them into few before the rows multiply in the join with judgements."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = table(spark, d, "chunks").where("char_end > char_start and char_start >= 0").select("chunk_uid", "doc_id", "char_start", "char_end").repartition(n, "chunk_uid")
    return c.groupBy("chunk_uid").agg(F.min("doc_id").alias("doc_id"), F.min("char_start").cast("bigint").alias("char_start"), F.max("char_end").cast("bigint").alias("char_end")).where("doc_id is not null")


def gold(spark, d) -> DataFrame:
    """The grade of each judged span: that of its latest version, of equal ones the highest."""
    q = table(spark, d, "qrels").where("char_end > char_start and char_start >= 0")
    return q.groupBy("query_id", "doc_id", "char_start", "char_end").agg(F.max(F.struct("qrels_version", "grade"))["grade"].alias("grade"))


def run(spark, d, salt: str = "a", depth: int = 20) -> DataFrame:
    """A run over every judged (query, document): its chunks in order of a salted hash, `depth` for each query.

    As any run it is a written file, which is read as often as needed.
    """
    ranked = hashed_run(table(spark, d, "qrels").select("query_id", "doc_id").distinct(), spans(spark, d), salt, depth)
    out = ranked.select("query_id", "doc_id", "chunk_uid", "char_start", "char_end", F.col("rank").cast("bigint").alias("rank"), (1.0 / F.col("rank")).alias("score"), F.lit(f"run-{salt}").alias("run_id"))
    return written(out, "run")


SPANS = "spans AS (SELECT chunk_uid, min(doc_id) AS doc_id, CAST(min(char_start) AS BIGINT) AS char_start, CAST(max(char_end) AS BIGINT) AS char_end FROM chunks WHERE char_end > char_start AND char_start >= 0 GROUP BY chunk_uid HAVING min(doc_id) IS NOT NULL)"
GOLD = "gold AS (SELECT query_id, doc_id, char_start, char_end, grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, char_start, char_end ORDER BY qrels_version DESC, grade DESC) AS k FROM qrels WHERE char_end > char_start AND char_start >= 0) WHERE k = 1)"


def run_cte(salt: str = "a", name: str = "run", depth: int = 20) -> str:
    return f"""{name} AS (SELECT query_id, doc_id, chunk_uid, char_start, char_end, rank, 1.0::DOUBLE / rank AS score, 'run-{salt}' AS run_id FROM (
  SELECT q.query_id, s.*, row_number() OVER (PARTITION BY q.query_id ORDER BY md5('{salt}' || ':' || q.query_id || ':' || s.chunk_uid), s.chunk_uid) AS rank
  FROM (SELECT DISTINCT query_id, doc_id FROM qrels) q JOIN spans s ON q.doc_id = s.doc_id) WHERE rank <= {depth})"""


def overlap_sql(rule: str, threshold: float = 0.1) -> str:
    if rule == "iou":
        inter = "(least(r.char_end, g.char_end) - greatest(r.char_start, g.char_start))"
        return f"{inter} > 0 AND {inter} >= {threshold} * (greatest(r.char_end, g.char_end) - least(r.char_start, g.char_start))"
    return "(g.char_start + g.char_end) / 2.0 >= r.char_start AND (g.char_start + g.char_end) / 2.0 < r.char_end"


def hits_cte(rule: str = "iou", threshold: float = 0.1, run_name: str = "run", name: str = "hits") -> str:
    return f"{name} AS (SELECT r.query_id, r.chunk_uid, r.rank AS pos, r.doc_id, g.char_start AS gs, g.char_end AS ge, g.grade FROM {run_name} r JOIN gold g ON r.query_id = g.query_id AND r.doc_id = g.doc_id WHERE g.grade > 0 AND {overlap_sql(rule, threshold)})"


def rescore_sql(specs: list[str], salt: str = "a", rule: str = "iou", threshold: float = 0.1) -> str:
    """Metrics by joins of small aggregates, one for each spec."""
    columns, joins = [], []
    for n, spec in enumerate(specs):
        name, k = spec.split("@")
        one = {
            "recall": f"SELECT query_id, count(DISTINCT (doc_id, gs, ge)) AS v FROM hits WHERE pos <= {k} GROUP BY query_id",
            "precision": f"SELECT query_id, count(*) / {k} AS v FROM items WHERE pos <= {k} GROUP BY query_id",
            "mrr": f"SELECT query_id, 1.0 / min(pos) AS v FROM items WHERE pos <= {k} GROUP BY query_id",
            "ndcg": f"SELECT i.query_id, sum(rel / log2(pos + 1)) AS v FROM items i WHERE pos <= {k} GROUP BY i.query_id",
            "success": f"SELECT DISTINCT query_id, 1.0 AS v FROM items WHERE pos <= {k}",
        }[name]
        joins.append(f"LEFT JOIN ({one}) m{n} ON q.query_id = m{n}.query_id")
        value = f"coalesce(m{n}.v, 0)"
        if name == "recall":
            value += " / n_gold"
        if name == "ndcg":
            joins.append(f"LEFT JOIN (SELECT query_id, sum(grade / log2(place + 1)) AS v FROM ideal WHERE place <= {k} GROUP BY query_id) d{n} ON q.query_id = d{n}.query_id")
            value += f" / d{n}.v"
        columns.append(f"CASE WHEN n_gold > 0 THEN round(CAST({value} AS DOUBLE), 9) END AS {name}_at_{k}")
    return f"""WITH {SPANS}, {GOLD}, {run_cte(salt)}, {hits_cte(rule, threshold)},
items AS (SELECT query_id, pos, max(grade) AS rel FROM hits GROUP BY query_id, pos),
ideal AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM gold WHERE grade > 0),
n AS (SELECT query_id, count(*) AS n_gold FROM gold WHERE grade > 0 GROUP BY query_id),
q AS (SELECT r.query_id, n.n_gold FROM (SELECT DISTINCT query_id FROM run) r LEFT JOIN n ON r.query_id = n.query_id)
SELECT q.query_id, {', '.join(columns)} FROM q {' '.join(joins)}"""
