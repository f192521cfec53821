"""Headings to numbered section paths, section offsets, and parse quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import STAMP, has_macro, is_references, math_is_broken, paragraphs

HEADING = r"^(?:\\((?:sub)*)section(\*?)\{([^{}]*)\}|(#{1,6}) +([^\n]*))\z"


def headings(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos (offset), size, level, numbered, title of every LaTeX or Markdown heading that has a line of its own.

    Offsets are running sums of line lengths, so a text is exploded once and never searched again.
    """
    lines = df.where(F.length(text) > 0).select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("pos", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    part = lambda k: F.regexp_extract("line", HEADING, k)
    found = placed.where(F.rlike("line", F.lit(HEADING)))
    latex = part(4) == ""
    return found.select(
        "doc_id", "pos", F.length("line").alias("size"), F.when(latex, F.length(part(1)) / 3 + 1).otherwise(F.length(part(4))).cast("int").alias("level"),
        (part(2) == "").alias("numbered"), F.trim(F.when(latex, part(3)).otherwise(part(5))).alias("title"),
    )


def section_paths(heads: DataFrame, deepest: int = 3) -> DataFrame:
    """Adds section_path: numbers and titles of the heading and of those it stands under, joined by ' > '.

    A heading's number at a level counts the numbered headings there since the last numbered one above; starred and
    deeper headings neither show nor advance numbers. All by windows over one document.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    counts = F.col("numbered") & (F.col("level") <= deepest)
    out = heads.withColumn("counts", counts)
    for level in range(1, deepest + 1):
        out = out.withColumn(f"g{level}", F.sum(F.when(F.col("counts") & (F.col("level") < level), 1).otherwise(0)).over(so_far))
    for level in range(1, deepest + 1):
        within = Window.partitionBy("doc_id", f"g{level}").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"c{level}", F.sum(F.when(F.col("counts") & (F.col("level") == level), 1).otherwise(0)).over(within))
    numbers = F.array(*[F.col(f"c{level}").cast("string") for level in range(1, deepest + 1)])
    number = F.when(F.col("counts"), F.array_join(F.slice(numbers, 1, F.least("level", F.lit(deepest))), "."))
    out = out.withColumn("display", F.trim(F.concat_ws(" ", number, "title")))
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    for level in range(1, 7):
        out = out.withColumn(f"a{level}", F.last(F.when(F.col("level") == level, F.struct("pos", "display")), ignorenulls=True).over(before))
    path = []
    for level in range(1, 7):
        above = F.col(f"a{level}")
        newer = [F.coalesce(above["pos"] > F.col(f"a{k}")["pos"], F.lit(True)) for k in range(1, level)]
        valid = (F.col("level") >= level) & above.isNotNull()
        for n in newer:
            valid &= n
        path.append(F.when(valid, above["display"]))
    return out.withColumn("section_path", F.array_join(F.filter(F.array(*path), lambda x: x.isNotNull()), " > ")).select("doc_id", "pos", "size", "level", "numbered", "title", "section_path")


def sections(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """doc_id, section_path, char_start, char_end: from a heading, which is part of it, to the next one or the text's end. lengths: doc_id, n."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    out = paths.join(lengths, "doc_id").select("doc_id", "section_path", F.col("pos").cast("int").alias("char_start"), F.coalesce(F.lead("pos").over(w), F.col("n")).cast("int").alias("char_end"))
    return out.where("char_end > char_start")


def quality_spans(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, k, span: paragraphs of each text."""
    return df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.posexplode(paragraphs(F.col(text))).alias("k", "span"))


def header_rates(df: DataFrame, doc: str = "doc_id", text: str = "text", short: int = 80, repeats: int = 3) -> DataFrame:
    """Share of a document's filled lines that are stamps, page numbers, or short and repeated."""
    lines = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.explode(F.split(text, "\n")).alias("line")).select("doc_id", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")).where("line <> ''")
    counted = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    bad = F.rlike("line", F.lit(STAMP)) | ((F.length("line") <= short) & (F.col("n") >= repeats))
    return counted.groupBy("doc_id").agg((F.sum(F.when(bad, F.col("n")).otherwise(0)) / F.sum("n")).alias("header_footer_contamination_rate"))


def section_chars(sections: DataFrame) -> DataFrame:
    """doc_id, section_chars: the summed lengths of each document's sections."""
    return sections.groupBy("doc_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("section_chars"))


def _with_coverage(lengths: DataFrame, covered: DataFrame) -> DataFrame:
    """lengths (doc_id, n_chars, ...) with mean_section_label_coverage: 1 at most, 0 for a document without sections or
    characters, null where section_chars is null (sections not known)."""
    out = lengths.join(covered.select("doc_id", "section_chars", F.lit(True).alias("_listed")), "doc_id", "left")
    share = F.when(F.col("_listed").isNull() | (F.col("n_chars") == 0), 0.0).when(F.col("section_chars").isNotNull(), F.least(F.lit(1.0), F.col("section_chars") / F.col("n_chars")))
    return out.withColumn("mean_section_label_coverage", share).drop("_listed")


def section_coverage(df: DataFrame, covered: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mean_section_label_coverage of every document with a text. covered: doc_id, section_chars."""
    return _with_coverage(df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.length(text).alias("n_chars")), covered).select("doc_id", "mean_section_label_coverage")


def quality_report(df: DataFrame, covered: DataFrame | None = None, doc: str = "doc_id", text: str = "text", parser: str | None = None) -> DataFrame:
    """One row for each document with a text; without spans every rate is 0. covered: doc_id, section_chars. `parser` is the
    parser_id of all rows."""
    texts = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.length(text).alias("n_chars"))
    rate = lambda x: F.avg(x.cast("double"))
    span = F.col("span")
    by = quality_spans(df, doc, text).groupBy("doc_id").agg(
        F.count("*").alias("n_spans"), rate(math_is_broken(span)).alias("broken_math_span_rate"), rate(has_macro(span)).alias("unexpanded_macro_rate"),
        rate(is_references(span)).alias("reference_only_span_rate"), rate(F.length(span)).alias("mean_span_length_chars"), rate(F.length(span) < 40).alias("short_span_rate"),
    )
    out = texts.join(by, "doc_id", "left").join(header_rates(df, doc, text), "doc_id", "left")
    rates = ("header_footer_contamination_rate", "broken_math_span_rate", "unexpanded_macro_rate", "reference_only_span_rate", "mean_span_length_chars", "short_span_rate")
    columns = [F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in rates]
    if covered is not None:
        out = _with_coverage(out, covered)
        columns.append(F.round("mean_section_label_coverage", 9).alias("mean_section_label_coverage"))
    if parser is not None:
        columns.append(F.lit(parser).alias("parser_id"))
    return out.select("doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), *columns)


