"""Markup residue (HTML, Markdown, wiki, LaTeX) turned into clean text that keeps headings, lists, code and formulas.

One pass over a text rewrites its constructs to plain structure and notes, for every character left, where it stood in the
stored text. The text is then a row of blocks (lines; lines that one construct spans are one block) of tokens: words
score positive, constructs and the words of links negative, with weights learned from blocks of labelled pages. A linear scan
finds the contiguous blocks of largest score, the content region; the clean text is what the pass left of that region. A text
holds residue where the scan meets a token that scores negative. A heading is a line between blank lines, a list item a line
"- ", code is indented by four spaces, formulas stay as they are.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.samples import bounded_sample
from quillspark.storage import written

#: Names of HTML elements, beside any name with a namespace (as in jats:italic).
TAGS = (
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data "
    "datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "i iframe img input ins kbd label legend li link main map mark math menu meta meter nav nowiki noframes noscript object ol optgroup option output p param picture "
    "pre progress q ref references rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr syntaxhighlight gallery"
).split()

#: A text without any of these holds no construct; the test runs in the JVM (there with Unicode classes, as here) before a text reaches Python.
SUSPECT = (
    r"(?m)[<\\`{|$]|&[#A-Za-z]|\*\S|~~|\S~\S|__|(?<!\w)_\w|''|-->|\]\]>|\[\[|\[\^|\]\(|\[(?i:https?|ftp):|^[ \t]*[#>%=]"
    r"|^[ \t]*(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$|^-{3,}[ \t]*$"
)

_NAME = "|".join(sorted(TAGS, key=len, reverse=True))
_LONG = "|".join(sorted((t for t in TAGS if len(t) > 2), key=len, reverse=True))
_VALUE = r"""(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+)"""
_ATTR = rf"(?:\s+[A-Za-z_:][-\w:.]*\s*=\s*{_VALUE})"
_WORDS = re.compile(r"(?<![\\\w])[A-Za-z]{2,} [A-Za-z]{2,} [A-Za-z]{2,}(?![\w}])|[A-Za-z]{2,}[.!?] [A-Z]")

#: Closed formulas: no constructs by themselves, kept as they are. None has a bound on its length: each stops at the next mark of
#: its own kind (a formula in single marks at a blank line too), so many marks that never close cost one pass in all.
_FORMULAS = (
    re.compile(r"(?<!\\)\$\$(?:[^$\\]++|\\.)++\$\$", re.S), re.compile(r"\\\[(?:[^\\]++|\\(?![\[\]]))++\\\]", re.S), re.compile(r"\\\((?:[^\\]++|\\(?![()]))++\\\)", re.S),
    re.compile(r"(?<![\\$])\$(?!\$)(?:[^$\\\n]++|\\[^\n]|\n(?!\s*\n))++(?<!\\)\$(?!\$)"),
)

_TAG = re.compile(rf"</?(?:{_NAME}|[A-Za-z][\w-]*:[A-Za-z][\w-]*){_ATTR}*\s*/?>|<(?:{_LONG})(?:\s+[A-Za-z-]+|{_ATTR})*\s*/?>|<!DOCTYPE[^>]*>|<!\[CDATA\[|\]\]>|<\?xml[^>]*>|</(?:{_NAME})(?![\w>])|<(?:{_LONG})\s+[a-z-]+=[^<>]*(?=<|$|\n)", re.I)
_ENTITY = re.compile(r"&(?:amp;)*(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]+));")
_COMMENT = re.compile(r"<!--.*?(?:-->|$(?![\s\S])|(?=\n\n))|-->", re.S)


def _numeric(x: str) -> bool:
    return bool(re.fullmatch(r"[\s\d.,;:+\-*/=]*", x))


def _entity(m: re.Match) -> str | None:
    if m[1] and m[1] + ";" not in html5:
        return None
    out = m[0]
    for _ in range(4):
        if (new := html.unescape(out)) == out:
            break
        out = new
    return out.replace("\xa0", " ")


@dataclass
class Converted:
    """Clean text of the content region, constructs by kind, the region in the stored text, and the sum of negative scores."""

    text: str
    kinds: Counter = field(default_factory=Counter)
    start: int = 0
    end: int = 0
    residue: float = 0.0


#: Inline LaTeX commands whose argument is the text itself, and accents with their combining marks.
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}


class _Converter:
    def __init__(self, text: str):
        self.stored, self.text, self.kept = text, text, []
        #: For every character of the text (and its end) its place in the stored text; never falls.
        self.origin = np.arange(len(text) + 1)
        #: Constructs as (start, end, kind) in the stored text, and the stored spans of links.
        self.constructs: list[tuple[int, int, str]] = []
        self.links: list[tuple[int, int]] = []

    @property
    def kinds(self) -> Counter:
        return Counter(k for _, _, k in self.constructs)

    def keep(self, x: str) -> str:
        """x behind a private-use mark: no later rule sees it."""
        self.kept.append(x)
        return f"\ue000{len(self.kept) - 1}\ue001"

    def stored_span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.origin[start]), int(self.origin[end - 1]) + 1 if end > start else int(self.origin[start])

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [start, end) of each edit, which are in order and do not overlap."""
        if not edits:
            return
        texts, places, at = [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            places.append(self.origin[at:a])
            if new:
                places.append(self.origin[a + np.minimum(np.arange(len(new)), max(b - a - 1, 0))])
            at = b
        texts.append(self.text[at:])
        places.append(self.origin[at:])
        self.text, self.origin = "".join(texts), np.concatenate(places)

    def found(self, kind: str | None, start: int, end: int) -> None:
        if kind:
            self.constructs.append((*self.stored_span(start, end), kind))

    def sub(self, kind: str | None, pattern: re.Pattern, to) -> None:
        edits = []
        for m in pattern.finditer(self.text):
            new = m.expand(to) if isinstance(to, str) else to(m)
            if new is not None:
                self.found(kind, m.start(), m.end())
                edits.append((m.start(), m.end(), new))
        self.edit(edits)

    def between(self, kind: str, opener: re.Pattern, closer: Callable[[re.Match], str], to: Callable[[re.Match, str], str]) -> None:
        """Constructs from an opener to the first closer after it. Once a closer is found no more, none is looked for again."""
        edits, at, gone = [], 0, set()
        while m := opener.search(self.text, at):
            end = closer(m)
            c = None if end in gone else re.compile(end, re.I).search(self.text, m.end())
            if c is None:
                gone.add(end)
                at = m.end()
                continue
            self.found(kind, m.start(), c.end())
            edits.append((m.start(), c.end(), to(m, self.text[m.end() : c.start()])))
            at = c.end()
        self.edit(edits)

    def paired(self, kind: str, opener: str, closer: str) -> None:
        """Takes away marks around a span of one line: an opener and the first closer after it, with something between."""
        ends, breaks = [m.start() for m in re.finditer(closer, self.text)], [m.start() for m in re.finditer("\n", self.text)]
        edits, at = [], 0
        for m in re.finditer(opener, self.text):
            if m.start() < at:
                continue
            k = bisect_left(ends, m.end() + 1)
            line = bisect_left(breaks, m.end())
            if k == len(ends) or line < len(breaks) and breaks[line] < ends[k]:
                continue
            at = ends[k] + len(m[0])
            self.found(kind, m.start(), at)
            edits += [(m.start(), m.end(), ""), (ends[k], at, "")]
        self.edit(edits)

    def nested(self, kind: str, opening: str, closing: str, inner: str, to: Callable[[str], str | None]) -> None:
        """Constructs in double brackets, of any depth, innermost first, in one pass with a stack. What `inner` matches (a
        single bracket) keeps the construct it stands in from being one; so does a construct within it that is none."""
        stack: list[list] = []  # start in the text, place in out, still clean
        out: list[tuple[str, int, int]] = []  # piece, start, end
        at, changed = 0, []
        for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}|{inner}", self.text):
            out.append((self.text[at : m.start()], at, m.start()))
            at = m.end()
            if m[0] == opening:
                stack.append([m.start(), len(out), True])
            elif m[0] == closing and stack:
                start, place, clean = stack.pop()
                body = "".join(x for x, _, _ in out[place + 1 :]) if clean else ""
                if clean and (new := to(body)) is not None:
                    del out[place:]
                    out.append((new, start, m.end()))
                    changed.append((start, m.end()))
                    continue
                if stack:
                    stack[-1][2] = False
            elif stack:
                stack[-1][2] = False
            out.append((m[0], m.start(), m.end()))
        out.append((self.text[at:], at, len(self.text)))
        for a, b in changed:
            self.found(kind, a, b)
        self.edit([(a, b, new) for new, a, b in out if self.text[a:b] != new])

    def braces(self) -> dict[int, int]:
        """Place of each opening brace to that of the one that closes it; escaped braces count for nothing."""
        stack, out = [], {}
        for m in re.finditer(r"\\.|[{}]", self.text, re.S):
            if m[0] == "{":
                stack.append(m.start())
            elif m[0] == "}" and stack:
                out[stack.pop()] = m.start()
        return out

    def arguments(self, kind: str, heads: re.Pattern, to: tuple[str, str] | None, brace: Callable[[re.Match], int] = lambda m: m.end() - 1, bare: bool = False) -> None:
        """Commands with an argument in braces of any depth: the head and the brace become the two texts of `to`, or all of it
        goes where `to` is None. A head without a closed brace is left, or goes by itself where `bare`."""
        ends, edits, at = self.braces(), [], 0
        for m in heads.finditer(self.text):
            if m.start() < at:
                continue
            close = ends.get(brace(m), -1)
            if close < 0 and not bare:
                continue
            if to is None:
                at = max(close + 1, m.end())
                edits.append((m.start(), at, ""))
                self.found(kind, m.start(), at)
                continue
            edits += [(m.start(), m.end(), to[0]), (close, close + 1, to[1])]
            self.found(kind, m.start(), close + 1)
        self.edit(sorted(edits))

    def formulas(self) -> None:
        for pattern in _FORMULAS:
            at, edits = 0, []
            while m := pattern.search(self.text, at):
                if _WORDS.search(re.sub(r"\\(?:text|mbox|mathrm)\s*\{[^{}]*\}", "", m[0])):  # prose between two unclosed marks
                    at = m.start() + 1
                    continue
                edits.append((m.start(), m.end(), self.keep(m[0])))
                at = m.end()
            self.edit(edits)

    def run(self) -> None:
        code = lambda body: "\n\n" + self.keep("\n".join("    " + x for x in body.strip("\n").split("\n"))) + "\n\n"
        inline = lambda m: self.keep(m[1].strip())
        self.sub(None, re.compile("[\ue000\ue001]"), "")
        self.sub("markdown_code", re.compile(r"[ \t]*```[^\n`]*\n(.*?)(?:\n[ \t]*```|\Z)", re.S), lambda m: code(m[1]))
        self.sub("markdown_code", re.compile(r"```"), "\n")
        self.between("html_code", re.compile(r"<pre\b[^>]*>\s*(?:<code\b[^>]*>)?", re.I), lambda m: r"(?:</code>\s*)?</pre>", lambda m, body: code(html.unescape(body)))
        self.between("latex_code", re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?\n?"), lambda m: rf"\\end\{{{m[1]}\*?\}}", lambda m, body: code(body))
        self.formulas()
        self.sub("html_comment", _COMMENT, "")
        before = len(self.constructs)
        self.sub("html_entity", _ENTITY, _entity)
        if len(self.constructs) > before:  # tags that were written with entities
            self.sub("html_comment", _COMMENT, "")
        self.html()
        self.wiki()
        self.latex()
        self.markdown(inline)
        # a sum of money is no formula
        self.sub("unclosed_formula", re.compile(r"(?<!\\)\$\$?(?!\d[\d,.]*(?:\s?(?:k|m|bn|million|billion|thousand|USD))?(?:[.,;:!?)]?(?:\s+[A-Za-z(]|\s*$)))|\\[()\[\]]"), "")
        while "\ue000" in self.text:
            self.sub(None, re.compile("\ue000(\\d+)\ue001"), lambda m: self.kept[int(m[1])])
        if self.constructs:
            for pattern, to in ((r"(?m)(^- [^\n]*)\n{2,}(?=- )", "\\1\n"), (r"(?<=\S)[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"[ \t]+\n", "\n"), (r"\A\n+|\n+\Z", "")):
                self.sub(None, re.compile(pattern), to)

    def html(self) -> None:
        opened: list[int] = []

        def tag(m: re.Match) -> str:
            name = re.sub(r"[^a-z0-9:].*", "", m[0].lstrip("</").lower(), flags=re.S)
            closing = m[0].startswith("</")
            if name == "a":
                if closing and opened:
                    self.links.append((opened.pop(), int(self.origin[m.start()])))
                elif not closing:
                    opened.append(int(self.origin[m.start()]))
            if re.fullmatch(r"h[1-6]", name) or name in ("title", "caption", "section", "table", "ul", "ol", "dl", "div", "blockquote", "p", "header", "footer", "article"):
                return "\n\n"
            if name in ("li", "dd", "dt"):
                return "" if closing else "\n- "
            if name in ("br", "hr", "tr", "thead", "tbody"):
                return "\n"
            if name in ("td", "th"):
                return "" if closing else "\t"
            return ""

        self.between("html_tag", re.compile(r"<(script|style)\b[^>]*>", re.I), lambda m: f"</{m[1].lower()}>", lambda m, body: "")
        self.sub("html_tag", re.compile(r"<ref\b[^<>/]*>[^<>]*</ref>", re.I), "")
        for kind, names in (("html_heading", "h[1-6]|title|caption"), ("html_list", "ul|ol|dl|li|dd|dt"), ("html_table", "table|thead|tbody|tr|td|th")):
            self.sub(kind, re.compile(rf"</?(?:{names})(?![\w:-])(?:{_ATTR}|\s+[A-Za-z-]+)*\s*/?>", re.I), tag)
        self.sub("html_tag", _TAG, tag)

    def wiki(self) -> None:
        def cells(m: re.Match) -> str:
            rows = []
            for line in m[0].split("\n"):
                line = line.strip()
                if line.startswith(("{|", "|}", "|-")):
                    continue
                rows.append("\t".join(c.strip() for c in re.split(r"\|\||!!", line.lstrip("|!+"))))
            return "\n\n" + "\n".join(r for r in rows if r) + "\n\n"

        self.sub("wiki_table", re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.S | re.M), cells)
        self.sub("wiki_table", re.compile(r"^(?:\{\||\|\}|\|-).*$", re.M), "")
        self.sub("wiki_heading", re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M), "\n\n\\2\n\n")
        self.nested("wiki_template", "{{", "}}", r"[{}]", lambda body: None if _numeric(body) else "")
        before = len(self.constructs)
        self.nested("wiki_link", "[[", "]]", r"[\[\]\n]", lambda body: None if _numeric(body) else body.rpartition("|")[2])
        self.sub("wiki_link", re.compile(r"\[(?:https?|ftp)://[^\s\]]+[ \t]*([^\]\n]*)\]", re.I), "\\1")
        self.links += [(x, y) for x, y, _ in self.constructs[before:]]
        for k in (5, 4, 3, 2):
            self.paired("wiki_quotes", rf"(?<![\w'’`])'{{{k}}}(?=[^\s'])", rf"(?<=[^\s'])'{{{k}}}(?!')")
        self.sub("wiki_magic", re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__"), "")

    def latex(self) -> None:
        if "\\" in self.text:
            self.arguments(
                "latex_macro", re.compile(r"\\(?:(?:re)?newcommand|providecommand)\*?\{?\\[A-Za-z]+\}?(?:\[\d\])*|\\def\\[A-Za-z]+(?:#\d)*(?=\{)"), None, brace=lambda m: m.end(), bare=True
            )
            self.arguments("latex_heading", re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?(?:\[[^\]]*\])?\{"), ("\n\n", "\n\n"))
            self.between("latex_math", re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}"), lambda m: rf"\\end\{{{m[1]}{re.escape(m[2])}\}}", lambda m, body: "\n\n" + self.keep("$$" + body.strip() + "$$") + "\n\n")
            self.sub("latex_list", re.compile(r"[ \t]*\\item\b(?:\[([^\]]*)\])?[ \t]*"), lambda m: f"\n- {m[1] + ' ' if m[1] else ''}")
            self.sub("latex_environment", re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?"), "\n")
            self.sub("latex_reference", re.compile(r"[ \t]*~?\\(?:[cC]ite[a-zA-Z]*|ref|eqref|autoref|cref|pageref|label)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}"), "")
            self.arguments("latex_note", re.compile(r"\\(?:footnote|thanks|marginpar|footnotetext)(?:\[[^\]]*\])?\{"), None)
            self.sub("latex_accent", re.compile(r"\\(?:(['`^\"~=.])|([cvuHkr])(?=\s*\{|\s+[A-Za-z]))\s*(?:\{\\?([A-Za-z]?)\}|\\?([A-Za-z]))"), lambda m: (m[3] or m[4] or "") + (_ACCENTS[m[1] or m[2]] if m[3] or m[4] else ""))
            self.sub("latex_space", re.compile(r"\\\\(?:\[[^\]\n]*\])?|\\(?:newline|par|linebreak|newpage|clearpage)\b[ ]?"), "\n")
            self.arguments("latex_command", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"), ("", ""))
            self.arguments("latex_command", re.compile(r"\{\\[A-Za-z]+\*?(?![A-Za-z*])[ ]?"), ("", ""), brace=lambda m: m.start())
            self.sub("latex_command", re.compile(r"\\[A-Za-z]+\*?[ ]?(?!\w)|\\[A-Za-z]+\*?"), "")
            self.sub("latex_escape", re.compile(r"\\([%&_#{}\$])"), "\\1")
            self.sub("latex_escape", re.compile(r"\\[ ,;:!/@\-|>]"), lambda m: "" if m[0] in ("\\/", "\\-", "\\!", "\\@") else " ")
        self.sub("latex_braces", re.compile(r"\{\}"), "")
        self.sub("latex_quotes", re.compile(r"``([^`\n]*(?:\n(?!\n)[^`\n]*)*)''"), "“\\1”")
        self.sub("latex_tie", re.compile(r"(?<=[A-Za-z.])~(?=[A-Za-z0-9\ue000\[(])"), " ")
        self.sub("latex_comment", re.compile(r"^[ \t]*%.*\n?", re.M), "")

    def markdown(self, inline) -> None:
        self.sub("markdown_heading", re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M), "\n\n\\1\n\n")
        self.sub("markdown_heading", re.compile(r"^(?=\S)([^\n]+)\n(?:={3,}|-{3,})[ \t]*$", re.M), "\n\n\\1\n\n")
        before = len(self.constructs)
        self.sub("markdown_image", re.compile(r"!\[([^\]\n]*)\]\([^()\n]*\)"), "\\1")
        self.sub("markdown_link", re.compile(r"(?<!\w)\[([^\[\]\n]+)\]\((?:[a-z]+:|[/#.]|\w+[./])[^()\s]*(?:[ ]\"[^\"\n]*\")?\)", re.I), "\\1")
        self.links += [(x, y) for x, y, _ in self.constructs[before:]]
        self.sub("markdown_footnote", re.compile(r"\[\^[\w-]+\]:?"), "")
        self.sub("markdown_table", re.compile(r"^[ \t]*\|.*\|[ \t]*\n[ \t]*\|?[ \t]*:?-{3,}.*(?:\n[ \t]*\|.*)*|^[ \t]*\|[ \t:|-]*-{3,}[ \t:|-]*\|?.*$|^[ \t]*\|(?:[^|\n]*\|){2,}[ \t]*$", re.M), lambda m: "\n\n" + "\n".join("\t".join(c.strip() for c in line.strip().strip("|").split("|")) for line in m[0].split("\n") if not re.fullmatch(r"[\s|:-]*", line)) + "\n\n")
        self.sub("markdown_rule", re.compile(r"^[ \t]*(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M), "")
        self.sub("markdown_quote", re.compile(r"^[ \t]{0,3}>[ \t]?(?=\S)", re.M), "")
        self.sub("markdown_code", re.compile(r"(?<![`\w])`([^`\n]+)`(?![`\w])"), inline)
        self.sub("markdown_bold", re.compile(r"(?<![\w*])(\*{2,3})(?=[^\s*])([^*\n]*(?:\n(?!\n)[^*\n]*)*)(?<=[^\s*])\1(?![\w*])"), "\\2")
        self.paired("markdown_bold", r"(?<![\w_])__(?=[^\s_])", r"(?<=[^\s_])__(?![\w_])")
        self.paired("markdown_strike", r"~~(?=\S)", r"(?<=\S)~~")
        self.sub("markdown_emphasis", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+)(?<=[^\s*])\*(?![\w*])"), "\\1")
        self.sub("markdown_emphasis", re.compile(r"(?<![\w_\\])_(?=[^\s_])([^_\n]+)(?<=[^\s_])_(?![\w_])"), "\\1")


#: Kinds that stand for structure: a block that holds one besides a word of its own scores at least as that word.
_STRUCTURE = ("code", "heading", "list", "table", "math")
LINK_WORD = "link_word"
#: Weights of a word of the text, and of constructs and words of links where none is learned.
WORD, OTHER, LINKED = 1.0, -0.25, -0.5
#: Learned weights lie between these: every construct is negative, and a word in a pair of marks still counts for itself.
LEAST, MOST = -0.05, -0.45


@dataclass
class Blocks:
    """The blocks of a text: ends in the stored text, words of their own, words of links, constructs by kind, structure."""

    ends: list[int]
    words: list[int]
    link_words: list[int]
    constructs: list[Counter]
    structure: list[bool]

    def scores(self, weights: dict[str, float]) -> list[float]:
        out = []
        for own, linked, constructs, structure in zip(self.words, self.link_words, self.constructs, self.structure):
            score = WORD * own + weights.get(LINK_WORD, LINKED) * linked + sum(weights.get(k, OTHER) * n for k, n in constructs.items())
            out.append(max(score, WORD) if structure and own else score)
        return out


def blocks_of(c: _Converter) -> Blocks:
    """The blocks of a text that has been converted: its lines, those under one construct as one block."""
    n = len(c.stored)
    ends = [m.end() for m in re.finditer(r"\n+", c.stored)]
    if not ends or ends[-1] < n:
        ends.append(n)
    joined = np.zeros(len(ends) + 1, dtype=np.int64)
    for a, b, _ in c.constructs:  # an end strictly inside a construct is none
        lo, hi = bisect_left(ends, a + 1), bisect_left(ends, b)
        joined[lo] += 1
        joined[hi] -= 1
    kept = [e for e, j in zip(ends, np.cumsum(joined)) if not j or e == n]
    size = len(kept)
    out = Blocks(kept, [0] * size, [0] * size, [Counter() for _ in range(size)], [False] * size)
    linked = np.zeros(n + 2, dtype=np.int32)
    for a, b in c.links:
        linked[a] += 1
        linked[b] -= 1
    linked = np.cumsum(linked) > 0
    at = c.origin[[m.start() for m in re.finditer(r"\w+", c.text)]] if c.text else np.zeros(0, dtype=np.int64)
    block = np.searchsorted(kept, at, side="right")
    for k, is_link in zip(np.minimum(block, size - 1).tolist(), linked[at].tolist()):
        (out.link_words if is_link else out.words)[k] += 1
    for a, _, kind in c.constructs:
        k = min(int(np.searchsorted(kept, a, side="right")), size - 1)
        out.constructs[k][kind] += 1
        out.structure[k] |= kind.endswith(_STRUCTURE)
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """[first, last) of the contiguous run with the largest sum; of equal sums the first, and of those the longest. All of
    it where no sum is positive."""
    best, at, total, start = 0.0, (0, len(scores)), 0.0, 0
    for k, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += score
        if total > best or total == best > 0 and at[0] == start:
            best, at = total, (start, k + 1)
    return at


def converted(text: str | None, weights: dict[str, float] | None = None) -> Converted:
    """The clean text of the content region, the constructs of the whole text by kind, and the region in the stored text."""
    if not text or not re.search(SUSPECT, text):
        return Converted(text or "", Counter(), 0, len(text or ""))
    c = _Converter(text)
    c.run()
    if not c.constructs:
        return Converted(text, Counter(), 0, len(text))
    weights, blocks = weights or {}, blocks_of(c)
    first, last = best_run(blocks.scores(weights))
    start, end = blocks.ends[first - 1] if first else 0, blocks.ends[last - 1]
    kinds = c.kinds
    residue = sum(weights.get(k, OTHER) * n for k, n in kinds.items())
    if (start, end) == (0, len(text)):
        return Converted(c.text, kinds, start, end, residue)
    a, b = np.searchsorted(c.origin[:-1], [start, end]).tolist()
    return Converted(c.text[a:b].strip("\n"), kinds, start, end, residue)


def learned_weights(blocks: list[tuple[bool, dict[str, int], int]], rounds: int = 10) -> dict[str, float]:
    """Weights of constructs and of the words of links, from blocks as (its page is labelled residue, tokens by kind, times).

    A page's label says that some of its blocks are residue, not which. So each block of such a page has a chance of being
    residue (at first its share of tokens that are no words), blocks of the other pages have none, and both kinds' rates of
    tokens and the chances are fitted in turn. A weight is the log of the ratio of a kind's rates in content and in residue,
    brought to [MOST, LEAST] by the kind of the largest; the words of links count double.
    """
    kinds = sorted({k for _, tokens, _ in blocks for k in tokens} | {"word"})
    if not blocks or len(kinds) < 2:
        return {}
    counts = np.array([[tokens.get(k, 0) for k in kinds] for _, tokens, _ in blocks], dtype=float)
    times = np.array([n for _, _, n in blocks], dtype=float)
    labelled = np.array([r for r, _, _ in blocks])
    word = kinds.index("word")
    chance = np.where(labelled, 1 - counts[:, word] / np.maximum(counts.sum(axis=1), 1), 0.0)
    for _ in range(rounds):
        residue, content = ((counts * (w * times)[:, None]).sum(axis=0) + 1 for w in (chance, 1 - chance))
        ratio = np.log(content / content.sum()) - np.log(residue / residue.sum())
        share = np.clip((chance * times)[labelled].sum() / max(times[labelled].sum(), 1), 0.01, 0.99) if labelled.any() else 0.01
        chance = np.where(labelled, 1 / (1 + np.exp(np.clip(counts @ ratio - math.log(share / (1 - share)), -50, 50))), 0.0)
    lowest = min(float(ratio.min()), -1e-9)
    out = {k: LEAST + (MOST - LEAST) * min(float(x), 0.0) / lowest for k, x in zip(kinds, ratio) if k != "word"}
    return out | ({LINK_WORD: 2 * out[LINK_WORD]} if LINK_WORD in out else {})


def block_tokens(text: str) -> list[dict[str, int]]:
    """Tokens by kind of each block of a text that holds any."""
    c = _Converter(text)
    if re.search(SUSPECT, text):
        c.run()
    b = blocks_of(c)
    rows = [{"word": w, LINK_WORD: x} | dict(k) for w, x, k in zip(b.words, b.link_words, b.constructs)]
    return [kept for r in rows if (kept := {k: n for k, n in r.items() if n})]


def clean_texts(df: DataFrame, keys: list[str], text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """keys, clean_text, kinds (map of construct kind to number), n_constructs, residue, content_start, content_end.

    clean_text is what is left of the content region [content_start, content_end) of the stored text; kinds, their number
    and the residue (the sum of the scores below zero) are of the whole text. A null text stays null, without constructs;
    empty and plain texts come out as they are. One row for each row of `df`; other columns are not read.
    """
    rows = df.select(*keys, F.col(text).alias("text"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [converted(t, weights) for t in batch.column(n).to_pylist()]
            columns = [
                pa.array([c.text for c in out], pa.string()), pa.array([list(c.kinds.items()) for c in out], pa.map_(pa.string(), pa.int32())), pa.array([sum(c.kinds.values()) for c in out], pa.int32()),
                pa.array([c.residue for c in out], pa.float64()), pa.array([c.start for c in out], pa.int32()), pa.array([c.end for c in out], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[*keys, "clean_text", "kinds", "n_constructs", "residue", "content_start", "content_end"])

    suspect = F.coalesce(F.rlike("text", F.lit("(?U)" + SUSPECT)), F.lit(False))
    plain = rows.where(~suspect).select(
        *keys, F.col("text").alias("clean_text"), F.lit(None).cast("map<string,int>").alias("kinds"), F.lit(0).alias("n_constructs"), F.lit(0.0).alias("residue"), F.lit(0).alias("content_start"), F.length("text").alias("content_end")
    )
    return rows.where(suspect).mapInArrow(run, f"{names}, clean_text string, kinds map<string,int>, n_constructs int, residue double, content_start int, content_end int").unionByName(plain)


def labelled_blocks(texts: DataFrame, quality: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4_000) -> list[tuple[bool, dict[str, int], int]]:
    """Blocks of a bounded sample (the `most` texts of smallest hash), for learned_weights: the label of the page, tokens by
    kind, and how often such a block occurs.

    A page is residue where one of its parse reports has an unexpanded macro or a broken math span; pages without a possible
    report are left out. Only counts of alike blocks reach the driver, no text; the broadcast sides have at most `most` rows.
    """
    rate = lambda c: F.when(F.col(c).between(0, 1), F.col(c))
    sample = bounded_sample(texts.where(F.length(text) > 0).select(key, F.col(text).alias("t")), ["t", key], most)
    sample = written(sample, "sample")
    wanted = quality.join(F.broadcast(sample.select(key).distinct()), key, "left_semi")
    labels = wanted.groupBy(key).agg(F.max(F.greatest(rate("unexpanded_macro_rate"), rate("broken_math_span_rate"))).alias("rate")).where("rate is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for residue, t in zip(batch.column("residue").to_pylist(), batch.column("t").to_pylist()):
                seen.update((residue, tuple(sorted(tokens.items()))) for tokens in block_tokens(t))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in seen]), pa.array([list(t) for _, t in seen], pa.map_(pa.string(), pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["residue", "tokens", "n"])

    blocks = sample.join(F.broadcast(labels), key).select((F.col("rate") > 0).alias("residue"), "t").mapInArrow(run, "residue boolean, tokens map<string,int>, n long")
    alike = blocks.groupBy("residue", F.array_sort(F.map_entries("tokens")).alias("tokens")).agg(F.sum("n").alias("n")).orderBy("residue", "tokens")
    return [(r["residue"], {k: n for k, n in r["tokens"]}, r["n"]) for r in alike.collect()]
