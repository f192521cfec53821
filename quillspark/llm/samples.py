"""Bounded samples of labelled rows, which models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """The `most` rows of smallest hash of `by` (all where there are fewer): the same rows however the table is laid out.

    A threshold on the hash, from the row count, leaves about twice as many rows before they are ordered, so what
    reaches one task does not grow with the table.
    """
    n = df.count()
    rows = df.withColumn("_h", F.xxhash64(*by))
    if n > 4 * most:
        rows = rows.where(F.col("_h") <= F.lit(int(-(2**63) + (2 * most / n) * 2**64)))
    return rows.orderBy("_h", *by).limit(most).drop("_h")
