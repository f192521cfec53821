"""Chunks of fixed width, their ids, and slices of frozen text."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.registry import Component, Registry
from quillspark.schemas import ChunkerConfig

UNIT_SEPARATOR = "\x1f"


def chunk_uid(doc_id: Column, config_id: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, doc_id, config_id, start.cast("string"), end.cast("string")), 256)


def fixed_chunks(df: DataFrame, how: ChunkerConfig = ChunkerConfig(), doc: str = "doc_id", text: str = "text", config_id: str | None = None) -> DataFrame:
    """doc, chunker_config_id, char_start, char_end, text, chunk_uid, raw_text_sha256 of windows of `how.size` code points
    that overlap by how.overlap; the last is cut at the end. Null and empty texts give none. Narrow: no shuffle."""
    n, stride = F.length(text), how.size - how.overlap
    count = F.lit(1) + F.greatest(F.lit(0), F.ceil((n - how.size) / F.lit(stride))).cast("int")
    label = F.lit(config_id or REGISTRY.get("chunker", "fixed").config_id(size=how.size, overlap=how.overlap))
    start = F.col("k") * stride
    return (
        df.where(n > 0).select(F.col(doc).alias("doc_id"), F.col(text).alias("whole"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
        .select("doc_id", label.alias("chunker_config_id"), start.alias("char_start"), F.least(start + how.size, F.length("whole")).alias("char_end"), F.col("whole").substr(start + 1, F.lit(how.size)).alias("text"))
        .withColumn("chunk_uid", chunk_uid(F.col("doc_id").cast("string"), F.col("chunker_config_id"), F.col("char_start"), F.col("char_end")))
        .withColumn("raw_text_sha256", F.sha2("text", 256))
    )


def span(text: Column, start: Column, end: Column, strict: bool = False) -> Column:
    """text[start:end), never clamped: bounds outside the text fail the query where strict, else give null."""
    inside = (start >= 0) & (end > start) & (end <= F.length(text))
    other = F.raise_error(F.lit("span outside of its text")) if strict else F.lit(None)
    return F.when(inside, text.substr(start + 1, end - start)).otherwise(other)


def span_mismatches(chunks: DataFrame, texts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks whose text is not the slice of their document's text that their span names (or whose document is missing)."""
    joined = chunks.alias("c").join(texts.select(doc, F.col("text").alias("canonical")), doc, "left")
    return joined.where(~span(F.col("canonical"), F.col("char_start"), F.col("char_end")).eqNullSafe(F.col("c.text"))).drop("canonical")


def passthrough(queries: DataFrame) -> DataFrame:
    """Each query's one variant: itself."""
    return queries.select("query_id", F.posexplode(F.array("text")).alias("variant", "text"))


REGISTRY = Registry()
REGISTRY.add(Component("chunker", "fixed", 1, ChunkerConfig, lambda how: lambda df: fixed_chunks(df, how)))


REGISTRY.add(Component("query_transform", "passthrough", 1, dataclasses.make_dataclass("PassthroughConfig", [], frozen=True), lambda how: passthrough))
