"""Source archives in binary columns: kinds by magic bytes, members in memory, main files."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.latex import INCLUDE, resolved


def archive_kind(content: Column) -> Column:
    """pdf, gzip or unknown, by the first bytes."""
    return F.when(F.startswith(content, F.unhex(F.lit("25504446"))), "pdf").when(F.startswith(content, F.unhex(F.lit("1F8B"))), "gzip").otherwise("unknown")


def _looks_like_tex(x: bytes) -> bool:
    head = x[:4096]
    return b"\\documentclass" in head or b"\\begin{" in head or b"\\section" in head


def members(content: bytes, most: int) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of a gzipped archive's files, or of the one text in it. Every member is checked before any comes out."""
    if len(content) > most:
        raise ValueError("archive is larger than allowed")
    try:
        plain = zlib.decompressobj(31).decompress(content, most + 1)
    except zlib.error as e:
        raise ValueError(f"no gzip data: {e}") from e
    if len(plain) > most:
        raise ValueError("content is larger than allowed")
    try:
        tar = tarfile.open(fileobj=io.BytesIO(plain))
    except tarfile.TarError:
        yield ("main.tex" if _looks_like_tex(plain) else "main.txt"), plain
        return
    with tar:
        inside = tar.getmembers()
        for m in inside:
            for path in (m.name, *([posixpath.join(posixpath.dirname(m.name) if m.issym() else "", m.linkname)] if m.issym() or m.islnk() else [])):
                if path.startswith("/") or posixpath.normpath(path).startswith(".."):
                    raise ValueError(f"member leaves the archive: {path}")
        if sum(m.size for m in inside) > most:
            raise ValueError("members are larger than allowed")
        for m in inside:
            if m.isfile():
                yield posixpath.normpath(m.name), tar.extractfile(m).read()


def extracted(df: DataFrame, most: int = 200 << 20) -> DataFrame:
    """doc_id, path, content, error: the files of each (doc_id, content); a refused archive is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows += [(doc, path, x, None) for path, x in members(bytes(content), most)]
                except (ValueError, EOFError, OSError, gzip.BadGzipFile) as e:
                    rows.append((doc, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "content", "error"])

    return df.where(F.col("content").isNotNull()).select("doc_id", "content").mapInPandas(run, "doc_id string, path string, content binary, error string")


@F.pandas_udf(T.StructType([T.StructField("main", T.StringType()), T.StructField("rule", T.IntegerType())]))
def _main_of(files: pd.Series) -> pd.DataFrame:
    """The main file of each list of (path, classed, includes)."""
    rows = []
    for group in files:
        paths = {f["path"] for f in group}
        included = {resolved(paths, f["path"], t) for f in group for t in f["includes"]}
        rules = (paths, {p for p in paths if posixpath.basename(p) == "main.tex"}, {f["path"] for f in group if f["classed"]}, paths - included)
        rows.append(next(((min(left), k) for k, left in enumerate(rules, 1) if len(left) == 1), (None, None)))
    return pd.DataFrame(rows, columns=["main", "rule"]).astype({"rule": "Int32"})


def main_files(files: DataFrame) -> DataFrame:
    """doc_id, main, rule: files has doc_id, path, content (text). The first rule that leaves exactly one file decides:
    1 the only .tex file, 2 the only one named main.tex, 3 the only one with a document class, 4 the only one that no file of the
    tree includes; no rule gives main null. Only paths and includes of a document are gathered, not its texts."""
    tex = files.where(F.endswith("path", F.lit(".tex")))
    told = tex.select("doc_id", F.struct("path", F.coalesce(F.contains("content", F.lit("\\documentclass")), F.lit(False)).alias("classed"), F.coalesce(F.regexp_extract_all("content", F.lit(INCLUDE.pattern), F.lit(1)), F.array().cast("array<string>")).alias("includes")).alias("f"))
    return told.groupBy("doc_id").agg(F.collect_list("f").alias("files")).select("doc_id", _main_of("files").alias("m")).select("doc_id", "m.*")


def first_main(files: DataFrame) -> DataFrame:
    """doc_id, main: the first .tex file by path that has a document class."""
    return files.where(F.lower("path").endswith(".tex") & F.contains("content", F.lit("\\documentclass"))).groupBy("doc_id").agg(F.min("path").alias("main"))


def files_hash(files: DataFrame) -> DataFrame:
    """doc_id, sha: hash over a document's files, in order of (slot, path); a slot is three digits of the path's own hash.

    Files are hashed by slot first, so that no task gathers all files of a document that has very many.
    """
    folded = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col(value).alias("h")))), lambda x: x["h"]), "\n"), 256)
    rows = files.select("doc_id", "path", F.substring(F.md5(F.col("path").cast("binary")), 1, 3).alias("slot"), F.sha2(F.col("content").cast("binary"), 256).alias("one"))
    return rows.groupBy("doc_id", "slot").agg(folded("path", "one").alias("some")).groupBy("doc_id").agg(folded("slot", "some").alias("sha"))
