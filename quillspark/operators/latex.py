"""The few LaTeX passes that need brace matching or recursion, and the whole parser, for batches of source trees."""

from __future__ import annotations

import functools
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import ABSTRACT, ABSTRACT_COMMAND, ARGUMENT, BIBLIOGRAPHY, BODY, CAPTION, CITE, FLOATS, PASSES, TITLE, UNARY, environments

INCLUDE = re.compile(r"\\(?:input|include)\{([^}]*)\}")
MARK = "\ue000"


class LatexError(ValueError):
    """A source tree that cannot be parsed; the reason goes to the row's error column."""


def _here(pattern: str) -> str:
    return pattern.replace(r"\p{L}\p{N}_", r"\w").replace(r"\z", r"\Z")


def _applied(text: str, name: str) -> str:
    for pattern, to in PASSES[name]:
        text = re.sub(_here(pattern), to.replace("$", "\\"), text)
    return text


def closing(text: str, at: int) -> int:
    """The place after the brace that closes the one at `at`; -1 where none does. An escaped brace counts for nothing."""
    depth, k = 0, at
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
            continue
        depth += (c == "{") - (c == "}")
        k += 1
        if not depth:
            return k
    return -1


def resolved(files: dict[str, str] | set[str], current: str, target: str) -> str | None:
    """The file that `current` includes as `target`: from the root of the tree, else from the including file's folder."""
    name = target.strip()
    name = name if posixpath.splitext(name)[1] else name + ".tex"
    places = (posixpath.normpath(posixpath.join(at, name)) for at in ("", posixpath.dirname(current)))
    return next((p for p in places if p in files), None)


def expanded(files: dict[str, str], main: str, open_files: tuple[str, ...] = ()) -> str:
    """`main` with every include replaced, comments stripped in each file; one file may be included twice, but not by itself.
    An include that names no file is an error: its text must not be lost in silence."""
    if main in open_files:
        raise LatexError("include cycle: " + " > ".join([*open_files, main]))

    def one(m: re.Match) -> str:
        path = resolved(files, main, m[1])
        if path is None:
            raise LatexError(f"{main} includes {m[1].strip()}, which is no file of the tree")
        return expanded(files, path, (*open_files, main))

    return INCLUDE.sub(one, _applied(files[main], "latex_strip_comments"))


_DEFINITION = re.compile(r"\\(?:(?:new|renew|provide)command\*?\s*\{?\\([A-Za-z]+)\}?\s*(?:\[(\d+)\])?\s*(?:\[[^\]]*\])?|DeclareMathOperator\*?\s*\{?\\([A-Za-z]+)\}?)\s*")


def macros(text: str) -> tuple[str, dict[str, tuple[int, str]]]:
    """(text without definitions, name to (arity, body)) of macros with no argument or one; others are only removed. A
    definition without a body in closed braces stays."""
    out, found, at, look = [], {}, 0, 0
    while m := _DEFINITION.search(text, look):
        look = m.end()
        end = closing(text, m.end()) if text[m.end() : m.end() + 1] == "{" else -1
        if end < 0:
            continue
        arity = int(m[2] or 0)
        if arity <= 1:
            found[m[1] or m[3]] = (arity, text[m.end() + 1 : end - 1])
        out.append(text[at : m.start()])
        at = look = end
    return "".join(out) + text[at:], found


def applied_macros(text: str, known: dict[str, tuple[int, str]], passes: int = 5) -> str:
    """Plain wrappers and macros replaced by their bodies, one after the other, until nothing changes or for `passes` rounds.
    An argument that holds braces waits until they are gone."""
    rules = []
    for name, (arity, body) in ({name: (1, "#1") for name in UNARY} | known).items():
        argument = r"\s*\{([^{}]*)\}" if arity else "()"
        rules.append((re.compile(rf"\\{name}(?![A-Za-z]){argument}"), lambda m, body=body, arity=arity: body.replace("#1", m[1]) if arity else body))
    for _ in range(passes):
        new = functools.reduce(lambda t, rule: rule[0].sub(rule[1], t), rules, text)
        if new == text:
            break
        text = new
    return text


@dataclass
class Parsed:
    text: str = ""
    title: str = ""
    abstract: str = ""
    sections: list[tuple[str, int, int]] = field(default_factory=list)
    citations: list[str] = field(default_factory=list)
    bibliography_char_start: int | None = None
    error: str | None = None


_HEADING = re.compile(r"\\((?:sub){0,2}section|paragraph)(\*?)\s*(?:\[[^\]]*\])?\s*" + ARGUMENT)


def _marked_headings(text: str, labels: list[tuple[int, bool, str]]) -> str:
    """Headings as a mark with their number among `labels`, which they are added to; what is shown follows in shown_headings."""

    def one(m: re.Match) -> str:
        level = m[1].count("sub") + (1 if m[1].endswith("section") else 4)
        labels.append((level, not m[2] and level <= 3, " ".join(m[3].split())))
        return f"\n\n{MARK}{len(labels) - 1}{MARK}\n\n"

    return _HEADING.sub(one, text)


def path_stack(labels: list[tuple[int, bool, str]]) -> list[list[str]]:
    """The parts of the section path of each heading (level, numbered, title); the last is what the text shows."""
    counters, stack, out = [0] * 7, [], []
    for level, numbered, title in labels:
        shown = title
        if numbered:
            counters[level] += 1
            counters[level + 1 :] = [0] * (6 - level)
            shown = (".".join(map(str, counters[1 : level + 1])) + " " + title).strip()
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, shown))
        out.append([s for _, s in stack])
    return out


def normal(text: str) -> str:
    import unicodedata

    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
    return "\n".join(line.rstrip() for line in text.split("\n"))


def _clean_title(text: str) -> str:
    text = re.sub(CITE, lambda m: _bracketed(m[1]), re.sub(PASSES["latex_refs"][1][0], "", text))
    return " ".join(re.sub(PASSES["latex_refs"][0][0], r"[\1]", text).split())


def _keys(inside: str) -> list[str]:
    return [k for x in inside.split(",") if (k := x.strip())]


def _bracketed(inside: str) -> str:
    return "[" + ", ".join(_keys(inside)) + "]"


def _captioned(m: re.Match) -> str:
    caption = re.search(CAPTION, m[0])
    return f"\n\n{'Figure' if m[0].startswith(chr(92) + 'begin{figure') else 'Table'}: {' '.join(caption[1].split())}\n\n" if caption else ""


def _placed(text: str, out: Parsed, paths: list[list[str]]) -> None:
    """Takes the marks out of a normalised text and gives `out` its text and sections: from a mark to the next one."""
    parts = re.split(f"{MARK}(\\d+|[ab]){MARK}", text)
    pieces, starts, size = [parts[0]], [], len(parts[0])
    for mark, part in zip(parts[1::2], parts[2::2]):
        starts.append((mark, size))
        pieces.append(part)
        size += len(part)
    out.text = "".join(pieces)
    for (mark, at), end in zip(starts, [*[x for _, x in starts[1:]], size]):
        if mark == "b":
            out.bibliography_char_start = at
        elif end > at:
            out.sections.append(("Abstract" if mark == "a" else normal(_applied(" > ".join(paths[int(mark)]), "latex_empty_braces")), at, end))


def _shown(text: str, paths: list[list[str]]) -> str:
    """What each heading shows, after its mark."""
    return re.sub(f"{MARK}(\\d+){MARK}", lambda m: m[0] + paths[int(m[1])][-1], text)


def parse(files: dict[str, str], main: str) -> Parsed:
    """Text, title, abstract, sections with offsets, and citations of a source tree; offsets come from marks that are
    taken out after the last edit, so no edit moves them. The text is normalised once, after all passes."""
    if any(MARK in x for x in files.values()):
        raise LatexError("the source holds the reserved mark")
    text, known = macros(_applied(expanded(files, main), "latex_typography"))
    text = applied_macros(text, known)
    out = Parsed()
    if m := re.search(TITLE, text):
        out.title, text = _clean_title(m[1]), text[: m.start()] + text[m.end() :]
    if m := re.search(_here(BODY), text):
        text = m[1]
    labels: list[tuple[int, bool, str]] = []
    text = re.sub(BIBLIOGRAPHY, f"\n\n{MARK}b{MARK}", text, count=1)
    text = re.sub(environments(FLOATS), _captioned, text)
    out.citations = list(dict.fromkeys(k for m in re.finditer(CITE, text) for k in _keys(m[1])))
    text = re.sub(CITE, lambda m: _bracketed(m[1]), text)
    text = _applied(_applied(text, "latex_refs"), "latex_display_math")
    if m := re.search(ABSTRACT, text) or re.search(ABSTRACT_COMMAND, text):
        out.abstract = m[1].strip()
        text = f"{text[: m.start()]}\n\n{MARK}a{MARK}Abstract\n{out.abstract}\n\n{text[m.end() :]}"
    text = _marked_headings(text, labels)
    paths = path_stack(labels)
    _placed(normal(_applied(_shown(text, paths), "latex_empty_braces")), out, paths)
    return out


def parse_markdown(text: str) -> Parsed:
    """The same for Markdown text: images dropped, headings of one to six hashes numbered to the third level; the first heading
    is the title if it is of level one, a section named abstract the abstract."""
    out, labels = Parsed(), []

    def one(m: re.Match) -> str:
        labels.append((len(m[1]), len(m[1]) <= 3, " ".join(m[2].split())))
        return f"\n\n{MARK}{len(labels) - 1}{MARK}"

    text = re.sub(r"(?m)^(#{1,6})[ \t]+(.*)$", one, re.sub(PASSES["markdown_images"][0][0], "", text.replace(MARK, "")))
    out.title = labels[0][2] if labels and labels[0][0] == 1 else ""
    paths = path_stack(labels)
    _placed(normal(_shown(text, paths)), out, paths)
    for path, at, end in out.sections:
        if re.sub(r"^[\d.]+\s+", "", path.rsplit(" > ", 1)[-1]).strip().lower() == "abstract":
            out.abstract = out.text[at:end].strip()
            break
    return out


PARSED = "doc_id string, text string, title string, abstract string, sections array<struct<section_path:string,char_start:int,char_end:int>>, citations array<string>, bibliography_char_start int, error string"


def _row(doc: str, p: Parsed) -> dict:
    names = ("section_path", "char_start", "char_end")
    return {"doc_id": doc, "text": p.text, "title": p.title, "abstract": p.abstract, "sections": [dict(zip(names, s)) for s in p.sections], "citations": p.citations, "bibliography_char_start": p.bibliography_char_start, "error": p.error}


def parse_trees(trees: DataFrame) -> DataFrame:
    """trees: doc_id, main, files (map of path to content). One row for each; a tree that cannot be parsed has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, main, files in zip(batch["doc_id"], batch["main"], batch["files"]):
                try:
                    rows.append(_row(doc, parse(dict(files), main)))
                except (LatexError, KeyError, RecursionError) as e:
                    rows.append(_row(doc, Parsed(error=str(e) if isinstance(e, LatexError) else f"{type(e).__name__}: {e}")))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in re.split(r", (?=[a-z_]+ )", PARSED)])

    return trees.select("doc_id", "main", "files").mapInPandas(run, PARSED)


def parse_markdown_texts(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_row(d, parse_markdown(t)) for d, t in zip(batch["doc_id"], batch["text"])], columns=[x.split(" ")[0] for x in re.split(r", (?=[a-z_]+ )", PARSED)])

    return df.where(F.col(text).isNotNull()).select(F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, PARSED)


def selected(latex: DataFrame, other: DataFrame) -> DataFrame:
    """The LaTeX result where it has no error, else the other parser's, else the error of the first."""
    names = [c for c in latex.columns if c != "doc_id"]
    a, b = latex.select("doc_id", F.struct(*names).alias("a")), other.select("doc_id", F.struct(*names).alias("b"))
    ok = lambda c: F.when(F.col(c).isNotNull() & F.col(f"{c}.error").isNull(), F.col(c))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(ok("a").isNotNull(), "latex").when(ok("b").isNotNull(), "markdown").alias("parser"), F.coalesce(ok("a"), ok("b"), "a", "b").alias("r")).select("doc_id", "parser", "r.*")
