import hashlib
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import statistics as st
from quillspark.functions.ids import base_id, base_id_strict, version
from quillspark.functions.text import citation_keys, nfc, normalized
from quillspark.operators import chunking, dedup, evaluation, incremental, latex, qrels, structure, tables
from quillspark.operators.components import components
from quillspark.registry import canonical_json
from quillspark.schemas import ChunkerConfig
from quillspark.sources import archives, harvest
from quillspark.streaming.ingest import ingest


def test_ids(spark):
    cases = {
        "1803.01234": ("1803.01234", None), "arXiv:1803.01234v10": ("1803.01234", 10), " https://x.example/abs/1803.01234v2\n": ("1803.01234", 2), "x.example/pdf/1803.0123.PDF": ("1803.0123", None),
        "cs.IR/0301012v3": ("cs.IR/0301012", 3), "CS.ir/0301012": ("cs.IR/0301012", None), "hep-th/9901001": ("hep-th/9901001", None), "v9": (None, None), "9999.99": (None, None), "": (None, None), "18O3.01234": (None, None), None: (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", base_id(F.col("raw")).alias("b"), version(F.col("raw")).alias("v")).collect()
    assert {r.raw: (r.b, r.v) for r in rows} == cases
    with pytest.raises(Exception, match="not a paper id"):
        spark.createDataFrame([("tbd",)], "raw string").select(base_id_strict(F.col("raw"))).collect()


def test_canonical_json_ignores_order_and_whole_floats():
    assert canonical_json({"b": 1.0, "a": [2.5, {"z": 3.0}]}) == canonical_json({"a": [2.5, {"z": 3}], "b": 1})
    reg = chunking.REGISTRY
    assert reg.get("chunker", "fixed").config_id(size=512) == reg.get("chunker", "fixed").config_id()
    with pytest.raises(KeyError, match="there are"):
        reg.get("chunker", "none")
    with pytest.raises(ValueError):
        ChunkerConfig(10, 10)


@pytest.mark.parametrize("size,overlap", [(5, 0), (5, 2), (7, 6), (512, 64)])
def test_fixed_chunks_equal_the_loop(spark, size, overlap):
    texts = {n: "".join(chr(97 + i % 26) for i in range(n)) for n in (0, 1, 4, 5, 6, 13, 40)}
    df = spark.createDataFrame([(str(k), v) for k, v in texts.items()] + [("null", None)], "doc_id string, text string")
    got = {(r.doc_id, r.char_start, r.char_end): r for r in chunking.fixed_chunks(df, ChunkerConfig(size, overlap)).collect()}
    want = set()
    for k, t in texts.items():
        at = 0
        while t:
            want.add((str(k), at, min(len(t), at + size)))
            if at + size >= len(t):
                break
            at += size - overlap
    assert set(got) == want
    for (doc, a, b), r in got.items():
        assert r.text == texts[int(doc)][a:b]
        assert r.chunk_uid == hashlib.sha256(f"{doc}\x1f{r.chunker_config_id}\x1f{a}\x1f{b}".encode()).hexdigest()


def test_span_is_never_clamped(spark):
    df = spark.createDataFrame([("héllo😀",)], "t string")
    part = lambda a, b, **k: chunking.span(F.col("t"), F.lit(a), F.lit(b), **k)
    assert df.select(part(1, 6)).first()[0] == "éllo😀"
    assert df.select(part(1, 7)).first()[0] is None
    with pytest.raises(Exception, match="outside"):
        df.select(part(1, 7, strict=True)).collect()


def test_overlap_geometry(spark):
    def hit(cs, ce, gs, ge, rule, t=0.5):
        return spark.createDataFrame([(cs, ce, gs, ge)], "cs long, ce long, gs long, ge long").select(evaluation.overlaps(rule, t)).first()[0]

    assert hit(0, 100, 50, 150, "iou", 1 / 3) and not hit(0, 100, 50, 150, "iou", 1 / 3 + 1e-9)
    assert not hit(0, 50, 50, 100, "iou", 0.001)
    assert hit(140, 160, 100, 200, "midpoint") and not hit(0, 100, 100, 200, "midpoint") and hit(150, 300, 100, 200, "midpoint")
    with pytest.raises(ValueError):
        evaluation.metric_specs(["ndcg"])


def test_rescore_against_a_plain_model(spark):
    rng = random.Random(1)
    run, gold = [], []
    for q in range(30):
        for k in range(rng.randrange(1, 8)):
            a = rng.randrange(0, 80)
            run.append((f"q{q}", rng.choice("de"), f"c{q}-{k}", a, a + rng.randrange(5, 40), 2 * k + 1, 1.0, "r"))
        for a in rng.sample(range(80), rng.randrange(0, 4)):
            gold.append((f"q{q}", rng.choice("de"), a, a + 20, rng.randrange(0, 4)))
    got = evaluation.rescore(
        spark.createDataFrame(run, "query_id string, doc_id string, chunk_uid string, char_start long, char_end long, rank long, score double, run_id string"),
        spark.createDataFrame(gold, "query_id string, doc_id string, char_start long, char_end long, grade long"), ["recall@3", "precision@3", "mrr@3", "ndcg@3", "success@3"], "iou", 0.2,
    )
    def meets(c, g):
        inter = min(c[4], g[3]) - max(c[3], g[2])
        return c[1] == g[1] and inter > 0 and inter / (max(c[4], g[3]) - min(c[3], g[2])) >= 0.2

    for r in got.collect():
        items = sorted((c for c in run if c[0] == r.query_id), key=lambda c: c[5])[:3]
        golds = [g for g in gold if g[0] == r.query_id and g[4] > 0]
        if not golds:
            assert r.recall_at_3 is None and r.ndcg_at_3 is None
            continue
        rel = [max([g[4] for g in golds if meets(c, g)], default=0) for c in items]
        ideal = sum(x / np.log2(i + 2) for i, x in enumerate(sorted((g[4] for g in golds), reverse=True)[:3]))
        first = next((i + 1 for i, x in enumerate(rel) if x), None)
        assert r.recall_at_3 == pytest.approx(sum(any(meets(c, g) for c in items) for g in golds) / len(golds), abs=1e-8)
        assert r.precision_at_3 == pytest.approx(sum(x > 0 for x in rel) / 3, abs=1e-8)
        assert r.mrr_at_3 == pytest.approx(1 / first if first else 0, abs=1e-8)
        assert r.ndcg_at_3 == pytest.approx(sum(x / np.log2(i + 2) for i, x in enumerate(rel)) / ideal, abs=1e-8)
        assert r.success_at_3 == float(any(rel))


def test_qrels_append_and_diff(spark, tmp_path):
    root = str(tmp_path / "qrels")
    rows = [("q1", "d1", 0, 50, 1, "human", None), ("q1", "d1", 60, 90, 2, "human", None)]
    schema = "query_id string, doc_id string, char_start long, char_end long, grade long, judge string, judged_at string"
    assert qrels.append(spark, root, spark.createDataFrame(rows, schema)) == 1
    assert qrels.append(spark, root, spark.createDataFrame([rows[0][:4] + (3, "human", None), ("q2", "d9", 1, 2, 0, "x", None)], schema)) == 2
    for bad in ([], [rows[0], rows[0]]):
        with pytest.raises(ValueError):
            qrels.append(spark, root, spark.createDataFrame(bad, schema))
    change = {(r.query_id, r.char_start): r.change for r in qrels.diff(qrels.load(spark, root, 1), qrels.load(spark, root, 2)).collect()}
    assert change == {("q1", 0): "regraded", ("q1", 60): "removed", ("q2", 1): "added"}
    second = qrels.load_meta(spark, root, 2)
    assert (second["judges"], second["n_queries"], second["n_judgements"], second["parent_version"]) == (["human", "x"], 2, 2, 1) and qrels.load_meta(spark, root, 1)["parent_version"] is None
    with pytest.raises(FileNotFoundError):
        qrels.load_meta(spark, root, 3)


def test_statistics():
    same = [0.1, 0.5, 0.9]
    assert st.bootstrap(same, same)["delta"] == 0 and st.randomization(same, same) == 1
    b = st.bootstrap(same, [x + 0.3 for x in same])
    assert b["low"] == pytest.approx(0.3) and b["above"] == 1
    assert st.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    for bad in (([], []), ([1.0], [1.0, 2.0]), ([float("nan")], [1.0])):
        with pytest.raises(ValueError):
            st.checked(*bad)


def test_resamples_are_reproducible(spark):
    pairs = spark.createDataFrame([(f"q{i}", i / 10, i / 10 + 0.2) for i in range(10)], "query_id string, a double, b double")
    r = st.bootstrap_table(pairs, 50).first()
    assert (r.n, round(r.delta, 9), round(r.low, 9)) == (10, 0.2, 0.2)
    assert st.randomization_table(pairs, 99).first().p <= 0.05


def test_near_duplicates_follow_one_pointer(spark):
    words = lambda *ranges: " ".join(f"tok{i}" for a, b in ranges for i in range(a, b))
    rows = [("a", words((0, 20))), ("b", words((4, 24))), ("c", words((8, 28))), ("x", words((100, 120))), ("y", words((100, 120))), ("s", "two"), ("n", None), ("e", "")]
    df = spark.createDataFrame(rows, "k string, text string")
    alike = dedup.near_duplicates(df, "k", "text", size=1, threshold=0.6, rows=2)
    assert {(r.a, r.b): round(r.jaccard, 6) for r in alike.links.collect()} == {("a", "b"): round(16 / 24, 6), ("b", "c"): round(16 / 24, 6)}
    assert {r.key: r.klass for r in alike.members.collect()} == {"a": "a", "b": "b", "c": "c", "x": "x", "y": "x", "s": "s"}
    parents = dedup.direct_parents(alike, df.select(F.col("k").alias("key"), F.col("k").alias("pos")))
    assert {r.key: r.root for r in dedup.roots(parents).collect()} == {"b": "a", "c": "a", "y": "x"}


def test_parents_of_classes_equal_those_of_pairs(spark):
    rng = random.Random(6)
    texts = {}
    for k in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(30)]
        for e in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(30)] = f"e{rng.randrange(99)}"
            texts[f"{rng.randrange(10_000):05d}"] = words
    sets = {k: set(w) for k, w in texts.items()}
    near = {k: [j for j in sets if j != k and len(sets[j] & sets[k]) / len(sets[j] | sets[k]) >= 0.6] for k in sets}
    pos = {k: rng.random() for k in sets}
    want = {k: min((j for j in js if pos[j] < pos[k]), key=pos.get) for k, js in near.items() if any(pos[j] < pos[k] for j in js)}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()] + [(k, " ".join(w).upper()) for k, w in list(texts.items())[:5]], "k string, text string")
    alike = dedup.near_duplicates(df.unionByName(df.limit(3)), "k", "text", size=1, threshold=0.6, rows=1)
    got = dedup.direct_parents(alike, spark.createDataFrame(list(pos.items()), "key string, pos double"))
    assert len(want) > 30 and {r.key: r.parent for r in got.collect()} == want


def test_copies_cost_one_row_each(spark):
    n = 50_000
    df = spark.range(n).select(F.format_string("%06d", "id").alias("k"), F.lit("one text of a few words that all of the rows share").alias("text"))
    alike = dedup.near_duplicates(df, "k", "text")
    assert alike.links.isEmpty() and alike.members.where("klass = '000000'").count() == n
    parents = dedup.direct_parents(alike, df.select(F.col("k").alias("key"), F.col("k").alias("pos")))
    assert parents.count() == n - 1 and parents.select("parent").distinct().count() == 1


def test_version_resolution(spark):
    rows = [(1, "1803.01234v9", "x"), (2, "1803.01234v10", "y"), (3, "1803.01234", "z"), (4, "weird", "w"), (5, "1803.01234v10", "late")]
    got = dedup.resolved_versions(spark.createDataFrame(rows, "pos long, raw string, p string"), "raw", "pos", "p").orderBy("first_pos").collect()
    assert [(r.base_id, r.version, r.payload, r.versions_seen) for r in got] == [("1803.01234", 10, "y", [9, 10]), ("weird", None, "w", [])]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def _feed(spark, rows):
    cols = "harvest_id string, set_spec string, metadata_prefix string, feed_pos long, base_id string, status string, version int, title string, abstract string, authors array<string>, categories array<string>, license string, doi string, note string"
    return spark.createDataFrame([("h", None, "p", pos, key, "live", 1, title, None, ["A"], None, None, None, "extra") for pos, key, title in rows], cols)


def test_changed_records(spark):
    states = "harvest_id string, set_spec string, metadata_prefix string, rows_written long, saved_at timestamp_ntz, state_id long"
    feed = _feed(spark, [(1, "a", "x"), (2, "b", "y"), (3, "a", " x "), (4, "c", None), (4, "c", None), (5, "b", "z"), (6, "b", "y"), (7, "d", "q")])
    at = lambda n: datetime(2024, 1, n)
    saved = spark.createDataFrame([("h", None, "p", 2, at(2), 1), ("h", None, "p", 1, at(1), 9), ("h", "other", "p", 7, at(9), 3), ("h", None, "p", None, at(8), 4)], states)
    got = lambda s: {r.base_id for r in incremental.changed_records(feed, s).collect()}
    assert got(saved) == {"c", "d"}  # a differs in white space only, b is back at what was written
    assert got(saved.limit(0)) == {"a", "b", "c", "d"}
    assert incremental.changed_records(feed.limit(0), saved).count() == 0
    point = incremental.resume_points(feed, saved).first()
    assert (point.done, point.reread_from) == (2, 1)


def feed_rows(spark, rows):
    """(position, key, title) as records of one feed."""
    df = spark.createDataFrame(rows, "feed_pos long, base_id string, title string").withColumn("harvest_id", F.lit("h/1"))
    other = {"status": "string", "version": "int", "abstract": "string", "authors": "array<string>", "categories": "array<string>", "license": "string", "doi": "string"}
    return df.withColumns({c: F.lit(None).cast(k) for c, k in other.items()})


@pytest.mark.parametrize("at", ["records", "ledger", None])
def test_harvest_runs_skip_and_repeat_nothing(spark, tmp_path, at):
    folder = str(tmp_path / "harvest")
    batches = [[(1, "a", "x"), (2, "b", "x"), (3, "a", "y")], [(4, "b", "x "), (5, "c", "x"), (6, "a", "z")], [(7, "a", "y")]]
    every, shown = [], lambda: sorted((r.base_id, r.title.strip()) for r in spark.read.parquet(f"{folder}/records").collect())

    def stopping(step):
        if step == at:
            raise KeyboardInterrupt

    for k, batch in enumerate(batches):
        every += batch
        rows = feed_rows(spark, every)
        if at and k:
            with pytest.raises(KeyboardInterrupt):
                incremental.harvest_run(rows, folder, "h/1", "s", stop=stopping)
        incremental.harvest_run(rows, folder, "h/1", "s", completed=k == 2)
    # the last row of each key a run sees; b came again unchanged, a went back to y
    assert shown() == [("a", "y"), ("a", "y"), ("a", "z"), ("b", "x"), ("c", "x")]
    state = incremental.last_state(incremental.states_at(spark, f"{folder}/states"), "h/1", "s")
    assert (state["rows_written"], state["attempt"], state["completed"]) == (7, 3, True)
    assert incremental.harvest_run(feed_rows(spark, every), folder, "h/1", "s", completed=True) == 0 and incremental.states_at(spark, f"{folder}/states").count() == 3
    with pytest.raises(ValueError, match="scope"):
        incremental.harvest_run(feed_rows(spark, every), folder, "h/1", "other")


def test_ledger_is_replaced_by_a_repeated_run(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, content_version string")
    for _ in range(2):
        incremental.commit(rows, ledger, "r1")
    assert spark.read.parquet(ledger).count() == 2
    fresh = incremental.unprocessed(rows.union(spark.createDataFrame([("a", "2")], rows.schema)), spark.read.parquet(ledger), ["k"])
    assert [tuple(r) for r in fresh.collect()] == [("a", "2")]


def test_stream_ingest_repeats_nothing(spark, tmp_path):
    src, sink, ledger = (str(tmp_path / x) for x in ("src", "sink", "ledger"))
    rows = [("a", "1"), ("a", "1"), ("b", "1")]
    for k, part in enumerate([rows, [("b", "1"), ("b", "2"), ("c", "1")]]):
        spark.createDataFrame(part, "k string, v string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("k string, v string").parquet(src)
        ingest(stream, ["k"], "v", sink, ledger, str(tmp_path / "cp"))
    assert sorted((r.k, r.v) for r in spark.read.parquet(sink).collect()) == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")]
    # a batch run again over its own ledger entries gives the same rows
    ingest(spark.readStream.schema("k string, v string").parquet(src), ["k"], "v", sink, ledger, str(tmp_path / "cp2"))
    assert spark.read.parquet(sink).select("k", "v").distinct().count() == 4


def test_upsert_keeps_tombstones(spark):
    old = spark.createDataFrame([("a", "t1", datetime(2024, 1, 1)), ("b", "t2", None)], "id string, title string, tombstoned_at timestamp_ntz")
    new = spark.createDataFrame([("a", "n1", None), ("c", "n3", None)], old.schema)
    got = {r.id: (r.title, r.tombstoned_at is not None) for r in tables.upserted(old, new, "id", ("tombstoned_at",)).collect()}
    assert got == {"a": ("n1", True), "b": ("t2", False), "c": ("n3", False)}
    assert {r.id: r.tombstoned_at for r in tables.upserted(old, new, "id").collect()}["a"] is None


def test_swap_and_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("h1", "d1", 1), ("h2", "d2", None)], "content_hash string, doc_id string, version int")
    for df in (rows.limit(1), rows):
        tables.swap(df, path)
    assert tables.kept(spark, path).count() == 2
    same = tables.snapshot_id(rows.orderBy(F.desc("doc_id"))).first()
    assert same == tables.snapshot_id(rows.repartition(3)).first() and len(same.corpus_snapshot) == 16
    assert same != tables.snapshot_id(rows.withColumn("version", F.lit(2))).first()


def test_ledger_migration(spark):
    tables.create_ledger(spark, "ledger_test")
    assert tables.migrate(spark, "ledger_test") == 2 == tables.migrate(spark, "ledger_test")
    assert "tombstoned_at" in spark.table("ledger_test.chunks").columns
    spark.sql("DROP DATABASE ledger_test CASCADE")


def test_normalisation(spark):
    import unicodedata

    raw = ["e\u0301 x \t\r\ny\u00a0\r z", "", "plain", "a\u2003\n\n b "]
    df = spark.createDataFrame([(x,) for x in raw] + [(None,)], "t string")
    got = {r.t: r.n for r in df.select("t", normalized(F.col("t")).alias("n")).collect()}
    for x in raw:
        lf = unicodedata.normalize("NFC", x).replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
        assert got[x] == "\n".join(line.rstrip() for line in lf.split("\n"))
    assert got[None] is None and df.select(nfc("t")).count() == 5


FILES = {
    "main.tex": r"""\documentclass{article}
\newcommand{\eng}[1]{<#1>}\newcommand{\two}[2]{#1#2}
\title{A \emph{fine} title}
\begin{document}
\begin{abstract}Short.\end{abstract}
\section{Intro \eng{x}} % not shown
Text 50\% done~\cite{k1, k2}, see \ref{sec:m}.
\input{part}
\section*{Thanks}
\begin{figure}\includegraphics{a}\caption{Plot}\end{figure}
\begin{equation}x = 1\end{equation}
\begin{thebibliography}{9}\bibitem{k1} X\end{thebibliography}
\end{document}""",
    "part.tex": r"\subsection{Method}\label{sec:m} Deep\two{}{}.",
}


def test_latex_parser():
    p = latex.parse(FILES, "main.tex")
    assert (p.title, p.abstract, p.citations) == ("A fine title", "Short.", ["k1", "k2"])
    assert [s[0] for s in p.sections] == ["Abstract", "1 Intro <x>", "1 Intro <x> > 1.1 Method", "Thanks"]
    assert "[k1, k2]" in p.text and "[sec:m]" in p.text and "Figure: Plot" in p.text and "[DISPLAY_MATH]" in p.text and "bibitem" not in p.text and "50\\%" in p.text and "not shown" not in p.text
    assert latex.normal(p.text) == p.text and p.bibliography_char_start is not None
    ends = [0]
    for _, a, b in p.sections:
        assert ends[-1] <= a < b <= len(p.text)
        ends.append(b)


def test_latex_errors_are_rows(spark):
    rows = [("ok", "main.tex", FILES), ("loop", "a.tex", {"a.tex": r"\input{b}", "b.tex": r"\input{a}"}), ("gone", "x.tex", {"y.tex": ""}), ("twice", "a.tex", {"a.tex": r"\input{b}\input{b}", "b.tex": "B"})]
    got = {r.doc_id: r for r in latex.parse_trees(spark.createDataFrame(rows, "doc_id string, main string, files map<string,string>")).collect()}
    assert got["ok"].error is None and "cycle" in got["loop"].error and got["gone"].error and got["twice"].text == "BB"


def test_markdown_parser():
    p = latex.parse_markdown("# Title\n![i](x.png)intro\n## Abstract\nShort.\n## Body\n### Deep\nx")
    assert (p.title, p.abstract) == ("Title", "1.1 Abstract\nShort.") and [s[0] for s in p.sections] == ["1 Title", "1 Title > 1.1 Abstract", "1 Title > 1.2 Body", "1 Title > 1.2 Body > 1.2.1 Deep"]


def test_section_windows_equal_the_stack(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(25):
        labels = [(rng.randrange(1, 7), rng.random() < 0.7, rng.choice(["", "A", "B c"])) for _ in range(rng.randrange(1, 14))]
        rows += [(doc, 10 * k, 1, lv, num, title) for k, (lv, num, title) in enumerate(labels)]
        want |= {(doc, 10 * k): p for k, p in enumerate(" > ".join(parts) for parts in latex.path_stack([(lv, num and lv <= 3, t) for lv, num, t in labels]))}
    got = structure.section_paths(spark.createDataFrame(rows, "doc_id int, pos int, size int, level int, numbered boolean, title string"))
    assert {(r.doc_id, r.pos): r.section_path for r in got.collect()} == want


def test_quality_of_texts_without_spans(spark):
    df = spark.createDataFrame([(1, "  \n\n "), (2, None), (3, "$x \\emph{\n\n1. ref\n2. ref")], "doc_id int, text string")
    got = {r.doc_id: r for r in structure.quality_report(df).collect()}
    assert set(got) == {1, 3} and got[1].n_spans == 0 and got[1].short_span_rate == 0
    assert got[3].broken_math_span_rate == 0.5 and got[3].unexpanded_macro_rate == 0.5 and got[3].reference_only_span_rate == 0.5


def test_harvest_pages(spark, tmp_path):
    rec = '<record><header{0}><identifier>oai:x:{1}</identifier><datestamp>2024-01-01</datestamp></header>{2}</record>'
    meta = "<metadata><arXiv><id>1803.01234v2</id><title>A\n  b</title><categories>cs.IR math.ST</categories><authors><author><keyname>Doe</keyname><forenames>J.</forenames></author><author><keyname>Solo</keyname></author></authors></arXiv></metadata>"
    pages = {"first": f"<p>{rec.format('', '1803.01234', meta)}<resumptionToken>t|2</resumptionToken></p>", "t_2": "<p>" + rec.format(' status="deleted"', "1803.09999", "") + "</p>"}
    for name, x in pages.items():
        (tmp_path / f"{name}.xml").write_text(x)
    spark.dataSource.register(harvest.HarvestPages)
    read = spark.read.format("harvest_pages").option("folder", str(tmp_path))
    got = {r.base_id: r for r in harvest.parsed_records(read.load()).collect()}
    assert got["1803.01234"].title == "A b" and got["1803.01234"].authors == ["J. Doe", "Solo"] and got["1803.01234"].version == 2 and got["1803.01234"].categories == ["cs.IR", "math.ST"]
    assert got["1803.09999"].status == "deleted" and got["1803.09999"].title is None
    assert spark.read.format("harvest_pages").option("folder", str(tmp_path)).option("resumption_token", "t|2").load().count() == 1
    error = spark.createDataFrame([('<error code="badArgument">x</error>',)], "page string")
    with pytest.raises(Exception, match="badArgument"):
        harvest.parsed_records(error).collect()
    assert harvest.parsed_records(spark.createDataFrame([('<error code="noRecordsMatch">x</error>',)], "page string")).count() == 0


def test_archive_limits():
    import gzip

    with pytest.raises(ValueError, match="larger"):
        list(archives.members(gzip.compress(b"x" * 1000), 500))
    with pytest.raises(ValueError, match="no gzip"):
        list(archives.members(b"\x1f\x8bbroken", 500))


def test_citations_keep_first_order(spark):
    df = spark.createDataFrame([(r"\cite{b, a}\citep[p. 3]{a,c,}",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(citation_keys(F.col("t"))).collect()] == [["b", "a", "c"], [], None]


def test_crowded_buckets_are_joined_exactly(spark):
    rng = random.Random(8)
    boiler, texts = [f"b{i}" for i in range(60)], {}
    for k in range(120):
        own = [f"o{k}x{i}" for i in range(30)]
        texts[f"{k:03d}a"] = boiler + own
        if k % 5 == 0:
            own[rng.randrange(30)] = "changed"
            texts[f"{k:03d}b"] = boiler + own
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "k string, text string")
    got = {(r.a, r.b) for r in dedup.near_duplicates(df, "k", "text", 3, 0.8, hot=20).links.collect()}
    assert len(want) >= 24 and got == want
