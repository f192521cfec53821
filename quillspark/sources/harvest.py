"""Harvest pages (XML) to records, page by page as a source, and parts as a sink."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_AUTHOR = "STRUCT<keyname: STRING, forenames: STRING>"
RECORD = (
    "header STRUCT<_status: STRING, identifier: STRING, datestamp: STRING, setSpec: STRING>, "
    f"metadata STRUCT<arXiv: STRUCT<id: STRING, created: STRING, updated: STRING, title: STRING, abstract: STRING, categories: STRING, license: STRING, doi: STRING, authors: STRUCT<author: ARRAY<{_AUTHOR}>>>>"
)
ERROR = re.compile(r'<error\s+code="([^"]*)"[^>]*>([^<]*)</error>')
TOKEN = re.compile(r"<resumptionToken[^>]*>([^<]+)</resumptionToken>")
RECORDS = re.compile(r"<record>.*?</record>", re.S)


def _collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def parsed_records(pages: DataFrame, page: str = "page") -> DataFrame:
    """One row for each record element of harvest pages, deleted ones with their header only.

    A page with the error noRecordsMatch has none; any other error code fails the query.
    """
    code = F.regexp_extract(page, r'<error\s+code="([^"]*)"', 1)
    checked = F.when(code.isin("", "noRecordsMatch"), F.col(page)).otherwise(F.raise_error(F.concat(F.lit("harvest error "), code)))
    records = pages.select(F.explode(F.regexp_extract_all(checked, F.lit(r"(?s)<record>.*?</record>"), F.lit(0))).alias("xml")).select(F.from_xml("xml", RECORD).alias("r"))
    m = F.col("r.metadata.arXiv")
    author = lambda a: F.trim(F.concat_ws(" ", a["forenames"], a["keyname"]))
    raw = F.coalesce(m["id"], F.substring_index("r.header.identifier", ":", -1))
    return records.select(
        F.regexp_replace(raw, r"v\d+$", "").alias("base_id"), F.regexp_extract(raw, r"v(\d+)$", 1).try_cast("int").alias("version"), F.col("r.header.identifier").alias("oai_identifier"),
        F.when(F.col("r.header._status") == "deleted", "deleted").otherwise("live").alias("status"), _collapsed(m["title"]).alias("title"), F.trim(m["abstract"]).alias("abstract"),
        F.transform(m["authors"]["author"], author).alias("authors"), F.split(F.trim(m["categories"]), r"\s+").alias("categories"), m["created"].alias("created_at"), m["updated"].alias("updated_at"),
        m["license"].alias("license"), m["doi"].alias("doi"), F.col("r.header.datestamp").alias("datestamp"),
    )


def page_errors(pages: DataFrame, page: str = "page") -> DataFrame:
    """page_no, code, is_empty_result of pages that carry an error."""
    code = F.regexp_extract(page, r'<error\s+code="([^"]*)"', 1)
    return pages.select("page_no", code.alias("code")).where("code <> ''").withColumn("is_empty_result", F.col("code") == "noRecordsMatch")


class _Page(InputPartition):
    pass


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Page(0)]  # one reader: pages follow each other by token, and a server is asked by one client

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import os

        folder, token, number = self.options["folder"], self.options.get("resumption_token") or "first", 0
        while token:
            path = os.path.join(folder, re.sub(r"[^\w.-]", "_", token) + ".xml")
            with open(path, encoding="utf-8") as f:
                page = f.read()
            if (e := ERROR.search(page)) and e[1] != "noRecordsMatch":
                raise RuntimeError(f"harvest error {e[1]}: {e[2]}")
            after = TOKEN.search(page)
            yield (number, None if token == "first" else token, after[1].strip() if after else None, page)
            token, number = after[1].strip() if after else None, number + 1


class HarvestPages(DataSource):
    """spark.read.format('harvest_pages'): saved pages of a feed in `folder`, one file a token (the first is first.xml),
    read in order from `resumption_token` on. A client that fetches over the network replaces the file read."""

    @classmethod
    def name(cls) -> str:
        return "harvest_pages"

    def schema(self) -> str:
        return "page_no int, page_token string, next_token string, page string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


def harvest_parts(records: DataFrame, path: str, rows: int = 50_000) -> None:
    """Records as parts of at most `rows` rows."""
    records.write.mode("errorifexists").option("maxRecordsPerFile", rows).parquet(path)


def summary(records: DataFrame) -> DataFrame:
    return records.groupBy("harvest_id").agg(F.count("*").alias("n_records"), F.count_if(F.col("status") == "deleted").alias("n_tombstones"), F.count_distinct("base_id").alias("n_papers"))
