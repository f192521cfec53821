"""Declared schemas and value lists; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

QREL_SCHEMA = "qrels_version long, query_id string, doc_id string, char_start long, char_end long, grade long, judge string, judged_at string"
RUN_SCHEMA = "query_id string, doc_id string, chunk_uid string, char_start long, char_end long, rank long, score double, run_id string"
HARVEST_SCHEMA = (
    "base_id string, version int, oai_identifier string, status string, title string, abstract string, authors array<string>, categories array<string>, "
    "created_at string, updated_at string, license string, doi string, datestamp string, harvested_at string"
)
DOCUMENT_SCHEMA = "doc_id string, namespace string, source_url string, title string, doc_text_sha256 string, parser_id string, char_len int, acl_key string, ingest_run_id string, tombstoned_at timestamp_ntz"
CHUNK_SCHEMA = "chunk_uid string, doc_id string, chunker_config_id string, char_start int, char_end int, raw_text_sha256 string, dup_of string, tombstoned_at timestamp_ntz"
SECTION = T.StructType([T.StructField("section_path", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])

#: Fixed values of the data model.
STRATA = (
    "single_hop", "multi_hop", "comparative", "definitional", "negation", "unanswerable_off_topic", "unanswerable_counterfactual",
    "unanswerable_false_premise", "unanswerable_temporal",
)
OVERLAP_RULES = ("iou", "midpoint")


@dataclass(frozen=True)
class ChunkerConfig:
    size: int = 512
    overlap: int = 64

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("need size > 0 and 0 <= overlap < size")
