"""Queries of the operators for training data, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.ids import base_id_sql, version_sql
from quillspark.llm.group_splits import group_splits, related
from quillspark.llm.languages import detect, fit
from quillspark.llm.leaks import leaks
from quillspark.llm.markup import clean_texts, labelled_blocks, learned_weights
from quillspark.llm.near_duplicates import Banding, found_pairs, near_duplicates
from quillspark.llm.splitting import split_oversized
from quillspark.llm.survivors import survivors
from quillspark.llm.tokenizing import token_ids
from quillspark.operators.components import components
from quillspark.storage import spread, table, written

#: Production parameters of problem 1: sets of three words, 0.7; recall at 0.7 is 0.96 by formula, at 0.8 0.996.
P1 = Banding(shingle=3, threshold=0.7, bands_a=6, rows_a=2, bands_b=9, rows_b=3)


def p1_found(spark, d):
    pairs = found_pairs(near_duplicates(spread(table(spark, d, "chunks").select("chunk_uid", "text")), "chunk_uid", "text", P1))
    return pairs.select(F.col("key_a").alias("chunk_uid_a"), F.col("key_b").alias("chunk_uid_b"))


def p1_groups(spark, d):
    """One row for each chunk that has three words: its class of equal shingle sets, the group of classes that links
    join, and the number of other classes its own is linked to."""
    found = near_duplicates(spread(table(spark, d, "chunks").select("chunk_uid", "text")), "chunk_uid", "text", P1)
    links = written(found.links, "links")
    groups = components(links, "klass_a", "klass_b")
    degree = links.select(F.explode(F.array("klass_a", "klass_b")).alias("klass")).groupBy("klass").agg(F.count("*").alias("n_links"))
    return (
        found.members.join(groups, F.col("klass") == F.col("node"), "left").join(degree, "klass", "left")
        .select(F.col("key").alias("chunk_uid"), F.col("klass").alias("class_id"), F.coalesce("component", "klass").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def p3_found(spark, d):
    return survivors(table(spark, d, "versioned_records")).select("base_id", "rec_id")


def p3_survivors(spark, d):
    return survivors(table(spark, d, "versioned_records"))


def p4_found(spark, d):
    return split_oversized(table(spark, d, "chunks")).select("chunk_uid").distinct()


def p4_pieces(spark, d):
    return split_oversized(table(spark, d, "chunks"))


def p5_found(spark, d):
    splits = p5_splits(spark, d)
    return splits.join(splits.groupBy("group_id").count().where("count > 1").select("group_id"), "group_id", "left_semi").select("query_id", "group_id")


def p5_splits(spark, d):
    queries = table(spark, d, "queries")
    label = queries.select("query_id", F.startswith("stratum", F.lit("unanswerable_")).cast("int").alias("label"))
    return written(group_splits(written(related(queries), "groups"), "query_id", label), "splits")


def _cleaned(spark, d):
    papers, chunks = table(spark, d, "papers"), table(spark, d, "chunks")
    weights = learned_weights(labelled_blocks(spread(chunks), table(spark, d, "parse_quality")))
    keyed = lambda df, kind, key, text: df.select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_key"), F.col(text).alias("raw"))
    return clean_texts(spread(keyed(papers, "paper", "doc_id", "abstract")).unionByName(spread(keyed(chunks, "chunk", "chunk_uid", "text"))), ["record_kind", "record_key"], "raw", weights)


def p6_found(spark, d):
    """Texts in which the scan for the content region meets a token that scores negative."""
    return _cleaned(spark, d).where("residue < 0").select("record_kind", "record_key").distinct()


def p6_clean(spark, d):
    return _cleaned(spark, d).select("record_kind", "record_key", "clean_text", "n_constructs", "residue", "content_start", "content_end")


def p7_ids(spark, d):
    return token_ids(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_leaks(spark, d):
    return leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return p8_leaks(spark, d).where("kind = 'verbatim'").select("doc_id", "item_id").distinct()


def _languages(spark, d):
    documents = table(spark, d, "documents")
    return detect(spread(documents.select("doc_id", "lang", "text")), fit(table(spark, d, "lang_samples"), documents))


def p9_found(spark, d):
    cases = _languages(spark, d).where("label_missing or label_wrong or is_mixed")
    return cases.select("doc_id", F.explode("languages.lang").alias("lang")).distinct()


def p9_segments(spark, d):
    """Each document's languages and segments, with their confidence."""
    return _languages(spark, d).select("doc_id", "label", F.explode("segments").alias("s")).select("doc_id", "label", "s.*")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p3_found": p3_found, "p3_survivors": p3_survivors, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_splits": p5_splits, "p6_found": p6_found, "p6_clean": p6_clean, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_segments": p9_segments}

_FILLED = lambda c: f"(CASE WHEN {c} IS NOT NULL AND lower(trim({c})) NOT IN ('', '-', '--', 'n/a', 'na', 'none', 'null', 'nil', 'nan', 'unknown', 'undefined', 'tbd', '?', '??') THEN 1 ELSE 0 END)"

SQL = {
    "p3_found": f"""
WITH r AS (
  SELECT {base_id_sql('raw_id')} AS base_id, {version_sql('raw_id')} AS v, rec_id, fetched_at,
    {_FILLED('title')} + {_FILLED('abstract')} + {_FILLED('license')} + {_FILLED('doi')} + (CASE WHEN updated_at IS NULL THEN 0 ELSE 1 END)
    + (CASE WHEN len(list_filter(authors, lambda x: {_FILLED('x')} = 1)) > 0 THEN 1 ELSE 0 END) AS n
  FROM versioned_records),
k AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY v DESC NULLS LAST, n DESC, fetched_at DESC NULLS LAST, rec_id) AS k FROM r WHERE base_id IS NOT NULL),
g AS (SELECT base_id FROM k GROUP BY base_id HAVING count(DISTINCT rec_id) > 1)
SELECT base_id, rec_id FROM k JOIN g USING (base_id) WHERE k = 1
""",
    "p4_found": "SELECT DISTINCT chunk_uid FROM chunks WHERE length(text) > 1800",
    "p5_found": f"""
WITH RECURSIVE q AS (SELECT query_id AS k, lower(trim(query_id, E' \\t\\n\\r')) AS name, lower(trim(paired_query_id, E' \\t\\n\\r')) AS p, {base_id_sql('removed_doc_id')} AS paper FROM queries WHERE query_id IS NOT NULL),
m AS (SELECT paper, min(k) AS low FROM q WHERE paper IS NOT NULL GROUP BY paper),
l AS (SELECT a.k AS x, b.k AS y FROM q a JOIN q b ON a.p = b.name UNION SELECT q.k, m.low FROM q JOIN m USING (paper)),
e AS (SELECT x, y FROM l WHERE x <> y UNION SELECT y, x FROM l WHERE x <> y),
reach AS (SELECT DISTINCT k AS node, k AS low FROM q UNION SELECT e.y, r.low FROM reach r JOIN e ON r.node = e.x WHERE r.low < e.y),
g AS (SELECT node AS query_id, min(low) AS group_id FROM reach GROUP BY node)
SELECT query_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g GROUP BY group_id HAVING count(*) > 1)
""",
}
