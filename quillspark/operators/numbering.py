"""Dense numbers of rows in order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import written


def numbered(df: DataFrame, by: str, name: str = "i") -> DataFrame:
    """df with `name`, each row's place from 0 in order of `by` (ties in any order).

    Rows are put into ranges of `by`; a row's number is the rows of earlier ranges plus its place in its own. Only the
    ranges' counts are added up in one task.
    """
    ranged = written(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return ranged.withColumn("_place", place).join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_before")
