"""Parser and quality rules on small texts, with the values that are due written out."""

import pytest
from pyspark.sql import functions as F

from quillspark import plans
from quillspark.functions import text as tx
from quillspark.operators import latex, structure
from quillspark.sources import archives


def parsed(body, **files):
    return latex.parse({"main.tex": body, **{k + ".tex": v for k, v in files.items()}}, "main.tex")


@pytest.mark.parametrize(
    "source,text",
    [
        (r"\mathcal{L} and \operatorname{argmax} and \tiny{y}", "L and argmax and y"),
        (r"\textbf{a \emph{b \texttt{c}}}", "a b c"),
        (r"\mbox{kept} \textrm{kept} \foo{kept}", r"\mbox{kept} \textrm{kept} \foo{kept}"),
        (r"\newcommand{\docs}{\ensuremath{\mathbf{z}}}the \docs{} set", "the z set"),
        (r"\newcommand{\eng}[1]{<#1>}\eng{x} \eng{\emph{y}}", "<x> <y>"),
        (r"\newcommand{\two}[2]{#1#2}\two{a}{b}", r"\two{a}{b}"),
        (r"\DeclareMathOperator{\rank}{rank}\rank A", "rank A"),
        (r"\newcommand{\broken} no body", r"\newcommand{\broken} no body"),
        (r"\newcommand{\loop}{\loop}\loop", r"\loop"),
        (r"x{}{} y }{} { {}", "x y } { {}"),
        (r"50\% of \\% not this", "50\\% of\n"),
        (r"a~b \\ c", "a b\n c"),
        (r"\parencite{a} \textcite{b, c} \autocite[p. 3]{d} \citep*[see][2]{a,e} \Citet{f}", "[a] [b, c] [d] [a, e] \\Citet{f}"),
        (r"\cref{x} \Cref{y} \eqref{z} \pageref{p} \autoref{q} \ref{r}\label{gone}", "[x] [y] [z] [p] [q] [r]"),
        (r"\begin{align*}x\end{align}still\end{align*}", "\n\n[DISPLAY_MATH]\n\n"),
        (r"\[ a \] and $$ b $$", "\n\n[DISPLAY_MATH]\n\n and\n\n[DISPLAY_MATH]\n\n"),
        (r"\begin{figure*}\includegraphics{a}\caption[short]{A \emph{fine} {plot}  of x}\end{figure*}", "\n\nFigure: A fine {plot} of x\n\n"),
        (r"\begin{table}no caption\end{table}t", "t"),
        (r"\begin{table}\caption{T}\begin{figure}\caption{F}\end{figure}\end{table}", "\n\nTable: T\n\n"),
        (r"\bibliography{refs} stays", r"\bibliography{refs} stays"),
        ("pre \\begin{document}in\\end{document} post", "in"),
        ("pre \\begin{document}to the end", "to the end"),
    ],
)
def test_passes(source, text):
    assert parsed(source).text == latex.normal(text)


def test_titles_and_abstracts():
    assert parsed(r"\title[Short]{On {\bf x} and \cite{k}, \ref{a}\label{b}  here}\begin{document}t").title == r"On {\bf x} and [k], [a] here"
    assert parsed("no title").title == "" and parsed("none").abstract == ""
    for source in (r"\begin{abstract} A {b} c. \end{abstract}tail", r"\abstract{ A {b} c. }tail"):
        p = parsed(source)
        assert p.abstract == "A {b} c." and p.text == "\n\nAbstract\nA {b} c.\n\ntail" and p.sections[0] == ("Abstract", 2, len(p.text))


def test_headings_show_their_numbers():
    p = parsed("front\\section[s]{One {x}}a\\subsection{Two}b\\subsection*{Star}c\\paragraph{P}d\\paragraph{Q}e\\section{}f\\subparagraph{kept}")
    assert [s[0] for s in p.sections] == ["1 One {x}", "1 One {x} > 1.1 Two", "1 One {x} > Star", "1 One {x} > Star > P", "1 One {x} > Star > Q", "2"]
    shown = [p.text[a:b] for _, a, b in p.sections]
    assert shown[0] == "1 One {x}\n\na\n\n" and shown[1].startswith("1.1 Two\n\nb") and shown[5] == "2\n\nf\\subparagraph{kept}" and p.text.startswith("front\n\n1 One {x}")
    assert all(a == b for (_, _, a), (_, b, _) in zip(p.sections, p.sections[1:]))


def test_bibliography_is_a_place():
    p = parsed("\\section{A}x\n  \\begin{thebibliography}{9}\\bibitem{k} X\\end{thebibliography} tail \\begin{thebibliography}{1}y\\end{thebibliography}")
    assert p.bibliography_char_start == p.sections[0][2] and "bibitem" not in p.text and "tail" in p.text and latex.normal(p.text) == p.text and "y" in p.text


def test_includes():
    assert parsed("\\input{sec/a}", **{"sec/a": "A\\input{b}", "sec/b": "B"}).text == "AB"
    assert parsed("\\input{b}", **{"sec/b": "no", "b": "root"}).text == "root"
    assert parsed("%\\input{gone}\n\\include{ b }\\input{b.tex}", b="B").text == "\nBB"
    with pytest.raises(latex.LatexError, match="gone"):
        parsed("\\input{gone}")
    with pytest.raises(latex.LatexError, match="cycle"):
        parsed("\\input{main}")


def test_missing_include_is_an_error_row(spark):
    rows = [("gone", "main.tex", {"main.tex": r"\input{missing}"}), ("ok", "main.tex", {"main.tex": "x"})]
    got = {r.doc_id: (r.text, r.error) for r in latex.parse_trees(spark.createDataFrame(rows, "doc_id string, main string, files map<string,string>")).collect()}
    assert got["ok"] == ("x", None) and "missing" in got["gone"][1]


def test_markdown():
    p = latex.parse_markdown("intro\n# The  Title\n![i](x.png)a\n## Abstract\nShort.\n\n## 2 Body\n#### deep\nx\n#no heading")
    assert p.title == "The Title" and p.abstract == "1.1 Abstract\nShort."
    assert [s[0] for s in p.sections] == ["1 The Title", "1 The Title > 1.1 Abstract", "1 The Title > 1.2 2 Body", "1 The Title > 1.2 2 Body > deep"]
    assert p.text.startswith("intro\n\n\n1 The Title\na\n") and latex.parse_markdown("## Not level one\n# Late").title == ""


def rates(spark, text, sections=()):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    covered = structure.section_chars(spark.createDataFrame([(1, a, b) for a, b in sections], "doc_id int, char_start int, char_end int"))
    return structure.quality_report(df, covered).first()


def test_macro_residue_is_only_what_should_be_gone(spark):
    assert rates(spark, "Keep \\unknown{x} and \\LaTeX and 5\\% here").unexpanded_macro_rate == 0
    for bad in (r"\newcommand{\x}{y}", r"\DeclareMathOperator{\r}{r}", r"an \emph{x", r"\ensuremath", r"RAG{} noise", r"a}{} b"):
        assert rates(spark, f"{bad}\n\nclean one").unexpanded_macro_rate == 0.5, bad
    assert rates(spark, r"\emphasis \smaller \textual {} alone").unexpanded_macro_rate == 0


def test_headers_and_footers(spark):
    stamps = "arXiv:2101.00001v2 [cs.CL] 3 Jan 2021\nARXIV:2101.12345\nbody text\n12\n12345\n\nRunning head\nRunning head\nRunning head\n" + "x" * 81 + "\n" + "\n".join(["y" * 81] * 3)
    assert rates(spark, stamps).header_footer_contamination_rate == round(6 / 12, 9)


def test_reference_lines(spark):
    good = "[1] A.\n(12) B.\n\t12) C.\n2021. D.\n3. E."
    assert rates(spark, good).reference_only_span_rate == 1
    assert rates(spark, "12.5 metres\n1.x\n[a] b\n(1)c").reference_only_span_rate == 0
    assert rates(spark, "1. a\n plain\n\nnext span").reference_only_span_rate == 0.5


def test_coverage(spark):
    assert rates(spark, "x" * 10, [(0, 4), (4, 6)]).mean_section_label_coverage == 0.6
    assert rates(spark, "x" * 10, [(0, 10), (0, 9)]).mean_section_label_coverage == 1 and rates(spark, "x" * 10).mean_section_label_coverage == 0


def test_columns_give_what_the_parser_gives(spark):
    texts = [r"a \begin{figure}\caption{One {x}}\end{figure} b \begin{table*}y\end{table*} c", r"\begin{figure}\caption{a}\end{figure*} open", "", None, r"\cite{a}\parencite{b,a}", r"\begin{figure}x\end{figure}"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: (r.f, r.c) for r in df.select("k", tx.floats_captioned(F.col("t")).alias("f"), tx.citation_keys(F.col("t")).alias("c")).collect()}
    assert got[0][0] == "a \n\nFigure: One {x}\n\n b  c" and got[1][0] == texts[1] and got[2][0] == "" and got[3][0] is None and got[4][1] == ["a", "b"] and got[5][0] == ""


def test_floats_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    spaces = "\x0b\x0c\r\x1c\x85\xa0\u2003\u2028\u3000"
    texts = [None, "", *(rf"\begin{{figure}}\caption{c}{{{c}a{c} b {c}}}\end{{figure}}" for c in spaces), *(rf"x\begin{{table}}\caption[s]{{{w * 20000}}}\end{{table}}" for w in ("w ", "{w}"))]
    spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "chunk_uid string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW chunks AS SELECT * FROM read_parquet('{tmp_path}/chunks.parquet/*.parquet')")
    got = {r.chunk_uid: r.sha for r in plans.queries()["latex_floats"](spark, str(tmp_path)).collect()}
    assert got == dict(duck.execute(plans.sql()["latex_floats"]).fetchall()) and len(got) == len(texts)


def test_main_files(spark):
    cls = "\\documentclass{a}"
    trees = {
        "one": {"x.tex": ""}, "name": {"src/main.tex": "", "supplement.tex": cls, "z.tex": cls}, "class": {"a.tex": cls, "b.tex": ""}, "root": {"a.tex": cls + "\\input{s/b}", "s/b.tex": cls + "\\input{c}", "s/c.tex": ""},
        "two": {"a.tex": cls, "b.tex": cls}, "none": {"a.txt": cls}, "names": {"p/main.tex": "", "q/main.tex": cls},
    }
    rows = [(d, p, x) for d, t in trees.items() for p, x in t.items()] + [("one", "y.txt", None)]
    got = {r.doc_id: (r.main, r.rule) for r in archives.main_files(spark.createDataFrame(rows, "doc_id string, path string, content string")).collect()}
    assert got == {"one": ("x.tex", 1), "name": ("src/main.tex", 2), "class": ("a.tex", 3), "root": ("a.tex", 4), "two": (None, None), "names": ("q/main.tex", 3)}
