"""Normalisation, LaTeX and Markdown passes, parse quality: column expressions, with Python only where none exists.

Patterns use neither look-around nor possessive parts, so that other engines can run them too; CAPTION_SPARK alone is Spark's own.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form; Spark has no built-in for it."""
    return text.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def normalized(text: Column) -> Column:
    """Composed form, line feeds only, tabs as spaces, no white space at the ends of lines."""
    lf = F.replace(F.regexp_replace(nfc(text), "\r\n?", "\n"), F.lit("\t"), F.lit(" "))
    return F.regexp_replace(lf, r"(?U)[\s\x1c-\x1f&&[^\n]]+(\n|\z)", "$1")


#: Wrappers of one argument that stand for their argument.
UNARY = ("emph", "textbf", "textit", "underline", "texttt", "textsc", "text", "mathbf", "mathrm", "mathcal", "mathbb", "mathsf", "mathtt", "operatorname", "ensuremath", "tiny", "small")
#: Environments of display math and of floats, each also starred.
DISPLAY = ("equation", "align", "gather", "multline", "eqnarray")
FLOATS = ("figure", "table")


def environments(names: tuple[str, ...]) -> str:
    """A pattern of whole environments of these names, plain or starred; an end fits its begin."""
    return "(?s)" + "|".join(rf"\\begin\{{{n}{star}\}}.*?\\end\{{{n}{star}\}}" for n in names for star in ("", r"\*"))


#: An argument in braces that may hold braces of one level.
ARGUMENT = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
#: (pattern, replacement) of single passes; $1 stands for the first group.
PASSES = {
    "latex_strip_comments": [(r"(^|[^\\])((?:\\\\)*)%[^\n]*", "$1$2")],
    "latex_typography": [(r"\\\\", "\n"), (r"~", " ")],
    "latex_empty_braces": [(r"([\p{L}\p{N}_}])(?:\{\})+", "$1")],
    "latex_refs": [(r"\\(?:eqref|pageref|autoref|[Cc]ref|ref)\{([^}]*)\}", "[$1]"), (r"\\label\{[^}]*\}", "")],
    "latex_display_math": [(environments(DISPLAY), "\n\n[DISPLAY_MATH]\n\n"), (r"(?s)\\\[.*?\\\]", "\n\n[DISPLAY_MATH]\n\n"), (r"(?s)\$\$.*?\$\$", "\n\n[DISPLAY_MATH]\n\n")],
    "latex_wrappers": [(rf"\\(?:{'|'.join(UNARY)})\s*\{{([^{{}}]*)\}}", "$1")] * 5,
    "markdown_images": [(r"!\[[^\]]*\]\([^)]*\)", "")],
}


def passed(text: Column, name: str) -> Column:
    for pattern, to in PASSES[name]:
        text = F.regexp_replace(text, pattern, to)
    return text


def passed_sql(text: str, name: str) -> str:
    for pattern, to in PASSES[name]:
        to = to.replace("$", "\\")
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')" if "\n" not in to else f"regexp_replace({text}, '{pattern}', E'{to.encode('unicode_escape').decode()}', 'g')"
    return text


CITE = r"\\(?:cite[a-zA-Z]*|parencite|textcite|autocite)\*?(?:\[[^\]]*\]){0,2}\{([^}]*)\}"
CAPTION = r"\\caption\s*(?:\[[^\]]*\])?\s*" + ARGUMENT
#: CAPTION for Spark alone: white space is that of the SQL's engine (no vertical tab), and as nothing is tried twice, a long caption
#: does not overflow the stack of Java's.
CAPTION_SPARK = r"\\caption[ \t\n\f\r]*+(?:\[[^\]]*+\][ \t\n\f\r]*+)?+\{((?:[^{}]++|\{[^{}]*+\})*+)\}"
#: What the SQL's trim takes: every space separator.
SPACES = " \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def floats_captioned(text: Column) -> Column:
    """Every float as its caption, "Figure: ..." or "Table: ..." between blank lines; one without a caption goes."""
    floats, between = F.regexp_extract_all(text, F.lit(environments(FLOATS)), F.lit(0)), F.split(text, environments(FLOATS))
    kind = lambda x: F.when(F.startswith(x, F.lit(r"\begin{figure")), "Figure: ").otherwise("Table: ")
    caption = lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, CAPTION_SPARK, 1), r"[ \t\n\f\r]+", " "), F.lit(SPACES))
    shown = F.transform(floats, lambda x: F.when(F.rlike(x, F.lit(CAPTION_SPARK)), F.concat(F.lit("\n\n"), kind(x), caption(x), F.lit("\n\n"))).otherwise(""))
    return F.array_join(F.transform(F.arrays_zip(between.alias("b"), shown.alias("f")), lambda z: F.concat(z["b"], F.coalesce(z["f"], F.lit("")))), "")


def floats_captioned_sql(text: str) -> str:
    env = environments(FLOATS)
    one = f"CASE WHEN regexp_matches(x, '{CAPTION}') THEN E'\\n\\n' || CASE WHEN starts_with(x, '\\begin{{figure') THEN 'Figure: ' ELSE 'Table: ' END || trim(regexp_replace(regexp_extract(x, '{CAPTION}', 1), '\\s+', ' ', 'g')) || E'\\n\\n' ELSE '' END"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '{env}'), list_transform(regexp_extract_all({text}, '{env}'), lambda x: {one})), lambda z: z[1] || coalesce(z[2], '')), '')"


def citation_keys(text: Column) -> Column:
    """Distinct keys in order of first mention."""
    groups = F.regexp_extract_all(text, F.lit(CITE), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda k: F.trim(k)), lambda k: k != ""))


def first_only(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's value in the first match; null without one."""
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


TITLE = r"\\title\s*(?:\[[^\]]*\])?\s*" + ARGUMENT
BODY = r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\z)"
ABSTRACT = r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}"
ABSTRACT_COMMAND = r"\\abstract\s*" + ARGUMENT
BIBLIOGRAPHY = r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}"


def paragraphs(text: Column) -> Column:
    """Spans between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def math_is_broken(span: Column) -> Column:
    count = lambda x: F.length(span) - F.length(F.replace(span, F.lit(x), F.lit("")))
    return (count("$") % 2 == 1) | (count("{") != count("}")) | (count("\\(") != count("\\)")) | (count("\\[") != count("\\]"))


#: What a parser should have removed: definitions, wrappers that still stand, and empty braces after a word. Any other command
#: is kept on purpose and no residue.
MACRO = rf"\\(?:newcommand|renewcommand|providecommand|DeclareMathOperator)\b|\\(?:{'|'.join(UNARY)})(?:[^A-Za-z]|\z)|[\p{{L}}\p{{N}}_}}]\{{\}}"
NUMBERED_LINE = r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)])\s"
STAMP = r"(?i)arxiv:\d{4}\.\d{4,5}|^\d{1,4}$"


def has_macro(span: Column) -> Column:
    return F.rlike(span, F.lit(MACRO))


def is_references(span: Column) -> Column:
    """At least half of the lines that are not blank begin as items of a list of references do."""
    lines = F.filter(F.split(span, "\n"), lambda x: F.rlike(x, F.lit(r"\S")))
    return F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(NUMBERED_LINE)))) * 2 >= F.greatest(F.lit(1), F.size(lines))
