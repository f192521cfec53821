"""Ranked runs against judged spans: overlap join, relevance, metrics, rescoring in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions import digests
from quillspark.storage import written

METRICS = ("recall", "precision", "mrr", "ndcg", "success")


def overlaps(rule: str, threshold: float = 0.5) -> Column:
    """Whether chunk [cs, ce) meets gold [gs, ge): 'iou' from a threshold in (0, 1] on, or 'midpoint' of the gold inside."""
    if rule == "iou":
        if not 0 < threshold <= 1:
            raise ValueError("an iou threshold lies in (0, 1]")
        inter = F.least("ce", "ge") - F.greatest("cs", "gs")
        return (inter > 0) & (inter >= F.lit(threshold) * (F.greatest("ce", "ge") - F.least("cs", "gs")))
    if rule == "midpoint":
        middle = (F.col("gs") + F.col("ge")) / 2.0
        return (middle >= F.col("cs")) & (middle < F.col("ce"))
    raise ValueError(f"no overlap rule {rule}")


def metric_specs(names: list[str]) -> list[tuple[str, int]]:
    """('ndcg@10', ...) as (metric, k); k is mandatory and at least 1."""
    out = []
    for n in names:
        m = re.fullmatch(r"([a-z]+)@([1-9]\d*)", n)
        if not m or m[1] not in METRICS:
            raise ValueError(f"{n} is no metric@k with a metric of {', '.join(METRICS)}")
        out.append((m[1], int(m[2])))
    return out


def ranked(run: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_uid, cs, ce, pos: positions from 1 by rank, then chunk_uid; gaps of rank do not matter."""
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_uid")
    return run.select("query_id", "doc_id", "chunk_uid", F.col("char_start").alias("cs"), F.col("char_end").alias("ce"), F.row_number().over(w).alias("pos"))


def golds(qrels: DataFrame) -> DataFrame:
    """Judgements that count: grade above 0."""
    return qrels.where("grade > 0").select("query_id", "doc_id", F.col("char_start").alias("gs"), F.col("char_end").alias("ge"), "grade")


def matches(run: DataFrame, qrels: DataFrame, rule: str = "iou", threshold: float = 0.5) -> DataFrame:
    """Every (ranked item, gold) that overlap: an equi-join on query and document with the overlap as residual, so no
    nested loop, and the hot document is split by adaptive execution."""
    return ranked(run).join(golds(qrels), ["query_id", "doc_id"]).where(overlaps(rule, threshold))


def relevance(run: DataFrame, qrels: DataFrame, rule: str = "iou", threshold: float = 0.5) -> DataFrame:
    """query_id, pos, chunk_uid, rel: the largest grade of the golds an item overlaps, 0 without one."""
    hit = matches(run, qrels, rule, threshold).groupBy("query_id", "pos").agg(F.max("grade").alias("rel"))
    return ranked(run).select("query_id", "pos", "chunk_uid").join(hit, ["query_id", "pos"], "left").select("query_id", "pos", "chunk_uid", F.coalesce("rel", F.lit(0)).alias("rel"))


def rescore(run: DataFrame, qrels: DataFrame, specs: list[str], rule: str = "iou", threshold: float = 0.5) -> DataFrame:
    """One row for each query of the run, one column for each metric@k; null where a query has no gold.

    recall counts golds, precision items over k; ndcg has linear gains and may exceed 1, as several items can earn one
    gold's grade. Queries that only the judgements have are not scored. One overlap join feeds all metrics.
    """
    parsed = metric_specs(specs)
    hits = matches(run, qrels, rule, threshold)
    items = hits.groupBy("query_id", "pos").agg(F.max("grade").alias("rel"))
    item_aggs, gold_aggs, ideal_aggs = [], [], []
    for name, k in parsed:
        top, at = F.col("pos") <= k, f"{name}@{k}"
        if name == "precision":
            item_aggs.append((F.count_if(top) / F.lit(k)).alias(at))
        elif name == "mrr":
            item_aggs.append((1.0 / F.min(F.when(top, F.col("pos")))).alias(at))
        elif name == "success":
            item_aggs.append(F.max(top.cast("double")).alias(at))
        elif name == "ndcg":
            item_aggs.append(F.sum(F.when(top, F.col("rel") / F.log2(F.col("pos") + 1.0))).alias(f"dcg@{k}"))
            ideal_aggs.append(F.sum(F.when(F.col("place") <= k, F.col("grade") / F.log2(F.col("place") + 1.0))).alias(f"idcg@{k}"))
        else:
            gold_aggs.append(F.count_if(F.col("first") <= k).alias(f"covered@{k}"))
    by_item = items.groupBy("query_id").agg(F.count("*").alias("_items"), *item_aggs)
    covered = hits.groupBy("query_id", "doc_id", "gs", "ge").agg(F.min("pos").alias("first")).groupBy("query_id").agg(F.count("*").alias("_covered"), *gold_aggs)
    place = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id", "gs", "ge")
    ideal = golds(qrels).withColumn("place", F.row_number().over(place)).groupBy("query_id").agg(F.count("*").alias("n_gold"), *ideal_aggs)
    out = run.select("query_id").distinct().join(ideal, "query_id", "left").join(by_item, "query_id", "left").join(covered, "query_id", "left")
    columns = []
    for name, k in parsed:
        at = F.col(f"`{name}@{k}`")
        value = {"recall": lambda k=k: F.coalesce(F.col(f"`covered@{k}`"), F.lit(0)) / F.col("n_gold"), "ndcg": lambda k=k: F.coalesce(F.col(f"`dcg@{k}`"), F.lit(0.0)) / F.col(f"`idcg@{k}`")}.get(name, lambda at=at: F.coalesce(at, F.lit(0.0)))()
        columns.append(F.when(F.col("n_gold") > 0, F.round(value, 9)).alias(f"{name}_at_{k}"))
    return out.select("query_id", *columns)


def with_provenance(scores: DataFrame, run_id: str, qrels_version: DataFrame, rule: str = "iou", threshold: float = 0.5) -> DataFrame:
    """Scores with what made them: run_id, qrels_version (a frame of one row), overlap_rule and overlap_threshold."""
    made = qrels_version.select(F.lit(run_id).alias("run_id"), F.col(qrels_version.columns[0]).alias("qrels_version"), F.lit(rule).alias("overlap_rule"), F.lit(float(threshold)).alias("overlap_threshold"))
    return scores.crossJoin(F.broadcast(made))  # one row beside each query


#: Queries and chunks of a document that are looked at together; pairs up to which a tile is not thinned.
_HEADS, _TEXTS, _FEW = 256, digests.SLAB, 2_000


def _thinned(salt: str, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            queries, chunks = b.column("queries").flatten(), b.column("chunks").flatten()
            uids = chunks.field("chunk_uid")
            n_queries, n_chunks = (np.diff(b.column(c).offsets.to_numpy()) for c in ("queries", "chunks"))
            tiles, heads, texts = [], [], []
            for tile, (nq, nc, q0, c0) in enumerate(zip(n_queries, n_chunks, np.cumsum(n_queries) - n_queries, np.cumsum(n_chunks) - n_chunks, strict=True)):
                if nc <= depth or nq * nc <= _FEW:
                    found = [(np.repeat(np.arange(nq), nc), np.tile(np.arange(nc), nq))]
                else:
                    ids, names = queries.slice(q0, nq).to_pylist(), [u.encode() for u in uids.slice(c0, nc).to_pylist()]
                    known = np.array([k for k, x in enumerate(ids) if x is not None], int)
                    found = [(known[h], t) for h, t in digests.lowest([f"{salt}:{ids[k]}:".encode() for k in known], names, depth)]
                    first = np.array(sorted(range(nc), key=names.__getitem__)[:depth])  # those of a query without an id come in order of their own
                    found += [(np.full(len(first), k), first) for k, x in enumerate(ids) if x is None]
                for h, t in found:
                    tiles.append(np.full(len(h), tile))
                    heads.append(q0 + h)
                    texts.append(c0 + t)
            tile, head, text = (pa.array(np.concatenate(x)) for x in (tiles, heads, texts))
            taken = chunks.take(text)
            yield pa.RecordBatch.from_arrays([queries.take(head), b.column("doc_id").take(tile), *(taken.field(c) for c in ("chunk_uid", "char_start", "char_end"))], ["query_id", "doc_id", "chunk_uid", "char_start", "char_end"])

    return run


def hashed_run(pairs: DataFrame, spans: DataFrame, salt: str, depth: int) -> DataFrame:
    """The `depth` chunks of each query that come first by the MD5 of salt:query_id:chunk_uid, then by chunk_uid, with h and rank.

    pairs: distinct query_id, doc_id. spans: chunk_uid, doc_id, char_start, char_end. Every pair of a query and a chunk of its documents
    counts. A document of many chunks is cut into blocks of chunks and of queries, and each tile of two blocks hashes all of its pairs by arrays
    and keeps `depth` chunks a query, so that neither all pairs become rows nor one task has a long document.
    """
    n = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * pairs.sparkSession.sparkContext.defaultParallelism)
    many = lambda df, by: df.groupBy("doc_id").agg(F.ceil(F.count("*") / F.lit(by)).cast("int").alias("n"))
    blocks = written(many(pairs, _HEADS).withColumnRenamed("n", "qs").join(many(spans, _TEXTS).withColumnRenamed("n", "cs"), "doc_id"), "blocks")
    split = lambda df, key, parts: df.join(blocks, "doc_id").withColumn("part", F.pmod(F.xxhash64(key), F.col(parts)).cast("int"))
    by_query = split(pairs, "query_id", "qs").groupBy("doc_id", F.col("part").alias("q"), "cs").agg(F.collect_list(F.struct("query_id")).alias("queries"))
    by_chunk = split(spans, "chunk_uid", "cs").groupBy("doc_id", F.col("part").alias("c"), "qs").agg(F.collect_list(F.struct("chunk_uid", "char_start", "char_end")).alias("chunks"))
    each = lambda df, parts, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts).repartition(n, "doc_id", "q", "c")
    tiles = each(by_query, "cs", "c").join(each(by_chunk, "qs", "q"), ["doc_id", "q", "c"]).select("doc_id", "queries.query_id", "chunks").withColumnRenamed("query_id", "queries")
    shape = StructType([pairs.schema["query_id"], *[spans.schema[c] for c in ("doc_id", "chunk_uid", "char_start", "char_end")]])
    kept = tiles.mapInArrow(_thinned(salt, depth), shape)
    hashed = kept.withColumn("h", F.md5(F.concat(F.lit(f"{salt}:"), "query_id", F.lit(":"), "chunk_uid").cast("binary")))
    return hashed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("h", "chunk_uid"))).where(F.col("rank") <= depth)


def rank_assigned(scored: DataFrame) -> DataFrame:
    """rank 1..n of each query by score, highest first; of equal scores the smaller chunk_uid."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_uid")))


def run_rejects(run: DataFrame) -> DataFrame:
    """Rows no run file may hold: bad span or rank below 1."""
    bad = (F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start")) | (F.col("rank") < 1)
    return run.where(F.coalesce(bad, F.lit(True)))


def paired(metrics: DataFrame, run_a: str, run_b: str, metric: str) -> DataFrame:
    """query_id, a, b of the queries for which both runs have a value."""
    side = lambda run, name: metrics.where((F.col("run_id") == run) & (F.col("metric") == metric) & F.col("value").isNotNull()).select("query_id", F.col("value").alias(name))
    return side(run_a, "a").join(side(run_b, "b"), "query_id")
