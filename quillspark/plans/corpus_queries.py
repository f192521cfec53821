"""Ids, chunks, versions, near-duplicates, text passes, structure and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.ids import base_id, base_id_lenient, base_id_sql, version, version_sql
from quillspark.operators import chunking as ch
from quillspark.operators import dedup as dd
from quillspark.operators import latex as lx
from quillspark.operators import structure as sc
from quillspark.storage import spread, table, written

QUERIES, SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text").where("text is not null")


# Ids and versions
_add("arxiv_id_parse", lambda s, d: table(s, d, "versioned_records").select("rec_id", base_id(F.col("raw_id")).alias("base_id"), version(F.col("raw_id")).alias("version")), f"SELECT rec_id, {base_id_sql('raw_id')} AS base_id, {version_sql('raw_id')} AS version FROM versioned_records")
_LENIENT = f"coalesce({base_id_sql('raw_id')}, trim(raw_id, E' \\t\\n\\r'))"
_add("arxiv_id_lenient", lambda s, d: table(s, d, "versioned_records").select("rec_id", base_id_lenient(F.col("raw_id")).alias("base_id"), version(F.col("raw_id")).alias("version")), f"SELECT rec_id, {_LENIENT} AS base_id, {version_sql('raw_id')} AS version FROM versioned_records")
_add("id_to_base", lambda s, d: table(s, d, "versioned_records").select("raw_id", base_id_lenient(F.col("raw_id")).alias("base_id")).where("raw_id is not null").distinct(), f"SELECT DISTINCT raw_id, {_LENIENT} AS base_id FROM versioned_records WHERE raw_id IS NOT NULL")
_add(
    "version_resolve",
    lambda s, d: dd.resolved_versions(table(s, d, "versioned_records"), "raw_id", "rec_id", "title").select("base_id", "version", F.array_join(F.transform("versions_seen", lambda v: v.cast("string")), ",").alias("versions_seen"), "raw_id", "payload", "first_pos"),
    f"""WITH r AS (SELECT {_LENIENT} AS base_id, {version_sql('raw_id')} AS version, raw_id, title, rec_id FROM versioned_records WHERE raw_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY version DESC NULLS LAST, rec_id) AS k FROM r),
g AS (SELECT base_id, coalesce(string_agg(DISTINCT version::VARCHAR, ',' ORDER BY version), '') AS versions_seen, min(rec_id) AS first_pos FROM (SELECT * FROM r) GROUP BY base_id)
SELECT k.base_id, version, versions_seen, raw_id, title AS payload, first_pos FROM k JOIN g USING (base_id) WHERE k = 1""".replace("string_agg(DISTINCT version::VARCHAR, ',' ORDER BY version)", "array_to_string(list_sort(list_distinct(list(version) FILTER (WHERE version IS NOT NULL))), ',')"),
)

# Chunks
_CONFIG = ch.REGISTRY.get("chunker", "fixed").config_id()
_FIXED = f"""fixed AS (SELECT doc_id, k * 448 AS char_start, least(k * 448 + 512, length(text)) AS char_end, substr(text, k * 448 + 1, 512) AS text
  FROM documents, LATERAL (SELECT unnest(range(1 + greatest(0, CAST(ceil((length(text) - 512) / 448.0) AS BIGINT)))) AS k) WHERE length(text) > 0)"""
_UID = f"sha256(doc_id || chr(31) || '{_CONFIG}' || chr(31) || char_start || chr(31) || char_end)"
_add("chunk_fixed", lambda s, d: ch.fixed_chunks(_docs(s, d)).select("doc_id", F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"), "text"), f"WITH {_FIXED} SELECT doc_id, char_start, char_end, text FROM fixed")
_add("chunk_uid", lambda s, d: ch.fixed_chunks(_docs(s, d)).select("doc_id", "chunker_config_id", "chunk_uid"), f"WITH {_FIXED} SELECT doc_id, '{_CONFIG}' AS chunker_config_id, {_UID} AS chunk_uid FROM fixed")
_add("chunk_content_hash", lambda s, d: table(s, d, "chunks").select("chunk_uid", (F.sha2("text", 256) == F.col("raw_text_sha256")).alias("hash_fits")), "SELECT chunk_uid, sha256(text) = raw_text_sha256 AS hash_fits FROM chunks")
_add("content_hash", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), "SELECT doc_id, sha256(text) AS sha FROM documents")
_add("embedding_text", lambda s, d: table(s, d, "chunks").select("chunk_uid", F.sha2(F.when(F.length("section_path") > 0, F.concat("section_path", F.lit("\n\n"), "text")).otherwise(F.col("text")), 256).alias("sha")), "SELECT chunk_uid, sha256(CASE WHEN length(section_path) > 0 THEN section_path || E'\\n\\n' || text ELSE text END) AS sha FROM chunks")
_add("query_passthrough", lambda s, d: ch.passthrough(table(s, d, "queries")).select("query_id", F.col("variant").cast("bigint").alias("variant"), "text"), "SELECT query_id, CAST(0 AS BIGINT) AS variant, text FROM queries")
_add("query_strata", lambda s, d: table(s, d, "queries").groupBy("stratum", F.startswith("stratum", F.lit("unanswerable_")).alias("is_unanswerable")).agg(F.count("*").alias("n")), "SELECT stratum, starts_with(stratum, 'unanswerable_') AS is_unanswerable, count(*) AS n FROM queries GROUP BY ALL")
_add("span_validate", lambda s, d: table(s, d, "qrels").where("not (char_start >= 0 and char_end > char_start and grade between 0 and 3)").select("query_id", "doc_id", "char_start", "char_end", "grade"), "SELECT query_id, doc_id, char_start, char_end, grade FROM qrels WHERE NOT (char_start >= 0 AND char_end > char_start AND grade BETWEEN 0 AND 3)")
_add("get_span", lambda s, d: table(s, d, "chunks").select("chunk_uid", ch.span(F.col("text"), F.lit(10), F.least(F.lit(60), F.col("token_count"))).alias("part")), "SELECT chunk_uid, CASE WHEN least(60, token_count) > 10 AND least(60, token_count) <= length(text) THEN substr(text, 11, least(60, token_count) - 10) END AS part FROM (SELECT chunk_uid, text, token_count FROM chunks) WHERE TRUE".replace("least(60, token_count)", "(CASE WHEN token_count IS NULL THEN 60 ELSE least(60, token_count) END)"))
_add(
    "span_integrity", lambda s, d: ch.span_mismatches(ch.fixed_chunks(_docs(s, d)), _docs(s, d)).agg(F.count("*").alias("n_mismatches")),
    f"WITH {_FIXED} SELECT count(*) AS n_mismatches FROM fixed f JOIN documents d ON f.doc_id = d.doc_id WHERE substr(d.text, f.char_start + 1, f.char_end - f.char_start) IS DISTINCT FROM f.text",
)

# Near-duplicates
_FOLD = "replace(lower(text), 'ß', 'ss')"
_WORDS = f"regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+')"
_SHINGLED = f"""w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5))"""
_KLASS_SQL = f"""{_SHINGLED}, sets AS (SELECT doc_id, count(*) AS n, string_agg(s, chr(31) ORDER BY s) AS x FROM s GROUP BY doc_id),
klass AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(x)) AS klass, n FROM sets)"""
_PAIRS_SQL = f"""{_KLASS_SQL}, n AS (SELECT doc_id, n FROM klass WHERE doc_id = klass), one AS (SELECT s.* FROM s JOIN n USING (doc_id)),
links AS (SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM one p JOIN one q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL) t JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.85)"""


def _alike(s, d):
    return dd.near_duplicates(table(s, d, "documents"), "doc_id", "text")


def _positions(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("pos"))


def _parents(s, d):
    return dd.direct_parents(_alike(s, d), _positions(s, d))


_PARENTS = """pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM klass x JOIN klass y ON x.klass = y.klass AND x.doc_id < y.doc_id
  UNION ALL SELECT least(x.doc_id, y.doc_id), greatest(x.doc_id, y.doc_id) FROM links l JOIN klass x ON x.klass = l.a JOIN klass y ON y.klass = l.b),
parents AS (SELECT b AS key, min(a) AS parent FROM pairs GROUP BY b)"""
_ROOTS = "roots AS (SELECT key, parent AS root, 1 AS depth FROM parents UNION ALL SELECT r.key, p.parent, depth + 1 FROM roots r JOIN parents p ON r.root = p.key)"
_LAST = "(SELECT key, min(root) AS root FROM roots GROUP BY key)"
_add("dedup_tokens", lambda s, d: _docs(s, d).select("doc_id", F.size(dd.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(dd.tokens(F.col("text")), " "), 256).alias("sha")), f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_tokens, sha256(array_to_string({_WORDS}, ' ')) AS sha FROM documents WHERE text IS NOT NULL")
_add("dedup_shingles", lambda s, d: _docs(s, d).select("doc_id", dd.tokens(F.col("text")).alias("w")).select("doc_id", F.explode(dd.shingles(F.col("w"), 5)).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")), f"WITH {_SHINGLED} SELECT doc_id, count(*) AS n, min(s) AS low, max(s) AS high FROM s GROUP BY doc_id")
_add("minhash_signature", lambda s, d: dd.minhash(dd.shingle_sets(spread(_docs(s, d)), "doc_id", "text", 5)))
_add("lsh_candidates", lambda s, d: dd.candidates(written(dd.shingle_sets(_docs(s, d), "doc_id", "text", 5), "sets")))
_add("near_dup_pairs", lambda s, d: _alike(s, d).links.select("a", "b", F.round("jaccard", 9).alias("jaccard")), f"WITH {_PAIRS_SQL} SELECT a, b, round(jaccard, 9) AS jaccard FROM links")
_add("near_dup_classes", lambda s, d: _alike(s, d).members.select(F.col("key").alias("doc_id"), "klass"), f"WITH {_KLASS_SQL} SELECT doc_id, klass FROM klass")
_add("dup_direct_parent", _parents, f"WITH {_PAIRS_SQL}, {_PARENTS} SELECT key, parent FROM parents")
_add("dup_roots", lambda s, d: dd.roots(_parents(s, d)), f"WITH RECURSIVE {_PAIRS_SQL}, {_PARENTS}, {_ROOTS} SELECT key, root FROM {_LAST}")
_add("dup_count", lambda s, d: _parents(s, d).agg(F.count("*").alias("n_duplicates")), f"WITH {_PAIRS_SQL}, {_PARENTS} SELECT count(*) AS n_duplicates FROM parents")
_add("chunks_with_dup", lambda s, d: table(s, d, "documents").select("doc_id").join(dd.roots(_parents(s, d)), F.col("doc_id") == F.col("key"), "left").select("doc_id", F.col("root").alias("dup_of")), f"WITH RECURSIVE {_PAIRS_SQL}, {_PARENTS}, {_ROOTS} SELECT doc_id, root AS dup_of FROM documents LEFT JOIN {_LAST} ON key = doc_id")
_add("dup_short_text", lambda s, d: _docs(s, d).where(F.size(dd.tokens(F.col("text"))) < 5).select("doc_id"), f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND len({_WORDS}) < 5")
_add("dup_disabled", lambda s, d: table(s, d, "chunks").select("chunk_uid", F.lit(None).cast("string").alias("dup_of")).distinct(), "SELECT DISTINCT chunk_uid, CAST(NULL AS VARCHAR) AS dup_of FROM chunks")
_add("dedup_unique_uid", lambda s, d: dd.unique_keys(table(s, d, "chunks"), "chunk_uid"), "SELECT chunk_uid, count(DISTINCT text) AS n_texts, count(*) AS n FROM chunks GROUP BY chunk_uid HAVING count(*) > 1")

# Text
_PY_SPACE = r"[\t\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORMAL = rf"regexp_replace(regexp_replace(replace(regexp_replace(nfc_normalize(text), '\r\n?', E'\n', 'g'), E'\t', ' '), '{_PY_SPACE}+\n', E'\n', 'g'), '{_PY_SPACE}+\z', '')"
_add("normalize_text", lambda s, d: _docs(s, d).select("doc_id", F.sha2(tx.normalized(F.col("text")), 256).alias("sha")), f"SELECT doc_id, sha256({_NORMAL}) AS sha FROM documents WHERE text IS NOT NULL")
_add("normalize_fixed_point", lambda s, d: _docs(s, d).select("doc_id", (tx.normalized(F.col("text")) == F.col("text")).alias("is_normal")), f"SELECT doc_id, {_NORMAL} = text AS is_normal FROM documents WHERE text IS NOT NULL")
for _name in ("latex_strip_comments", "latex_typography", "latex_empty_braces", "latex_refs", "latex_display_math", "latex_wrappers", "markdown_images"):
    _add(_name, lambda s, d, n=_name: table(s, d, "chunks").select("chunk_uid", F.sha2(tx.passed(F.col("text"), n), 256).alias("sha")), f"SELECT chunk_uid, sha256({tx.passed_sql('text', _name)}) AS sha FROM chunks")
_add("latex_floats", lambda s, d: table(s, d, "chunks").select("chunk_uid", F.sha2(F.coalesce(tx.floats_captioned(F.col("text")), F.lit("")), 256).alias("sha")), f"SELECT chunk_uid, sha256({tx.floats_captioned_sql('text')}) AS sha FROM chunks")
_add("latex_citations", lambda s, d: table(s, d, "chunks").where("text is not null").select("chunk_uid", F.array_join(tx.citation_keys(F.col("text")), ",").alias("keys")), f"SELECT chunk_uid, array_to_string(list_transform(regexp_extract_all(text, '{tx.CITE}', 1), lambda g: array_to_string(list_filter(list_transform(string_split(g, ','), lambda k: trim(k)), lambda k: k <> ''), ',')), ',') AS keys FROM chunks WHERE text IS NOT NULL")
_LATEX = r"'\title{T ' || doc_id || '}\begin{document}\begin{abstract}' || coalesce(title, '') || '\end{abstract}' || coalesce(abstract, '') || '\begin{thebibliography}{9}\bibitem{k} X\end{thebibliography} tail\end{document}'"


def _latex(s, d):
    """A LaTeX source made of each paper's title and abstract."""
    return table(s, d, "papers").select("doc_id", F.concat(F.lit(r"\title{T "), "doc_id", F.lit(r"}\begin{document}\begin{abstract}"), F.coalesce("title", F.lit("")), F.lit(r"\end{abstract}"), F.coalesce("abstract", F.lit("")), F.lit(r"\begin{thebibliography}{9}\bibitem{k} X\end{thebibliography} tail\end{document}")).alias("text"))


for _name, _pattern in (("latex_title", tx.TITLE), ("latex_body", tx.BODY), ("latex_abstract", tx.ABSTRACT)):
    _add(_name, lambda s, d, p=_pattern: _latex(s, d).select("doc_id", F.sha2(tx.first_only(F.col("text"), p), 256).alias("sha")), f"SELECT doc_id, sha256(regexp_extract({_LATEX}, '{_pattern}', 1)) AS sha FROM papers")
_add("latex_bibliography", lambda s, d: _latex(s, d).select("doc_id", F.regexp_instr("text", F.lit(tx.BIBLIOGRAPHY)).cast("bigint").alias("at")), f"SELECT doc_id, CAST(strpos({_LATEX}, '\\begin{{thebibliography}}') AS BIGINT) AS at FROM papers")


def _trees(s, d):
    return _latex(s, d).dropDuplicates(["doc_id"]).select("doc_id", F.lit("main.tex").alias("main"), F.create_map(F.lit("main.tex"), F.concat(F.lit(r"\newcommand{\eng}[1]{<#1>}\section{Intro \eng{x}}\input{more}"), "text"), F.lit("more.tex"), F.lit("\\subsection{More} included % note\n\\cite{k1, k2}")).alias("files"))


_add("latex_parse", lambda s, d: lx.parse_trees(_trees(s, d)))
_add("latex_includes", lambda s, d: lx.parse_trees(_trees(s, d).withColumn("files", F.map_concat("files", F.create_map(F.lit("loop.tex"), F.lit(r"\input{loop}"))))).select("doc_id", F.length("text").alias("n"), "error"))
_add("latex_macros", lambda s, d: lx.parse_trees(_trees(s, d)).select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*"))
_add("markdown_parse", lambda s, d: lx.parse_markdown_texts(_docs(s, d)))
_add("parse_select", lambda s, d: lx.selected(lx.parse_trees(_trees(s, d)), lx.parse_markdown_texts(table(s, d, "papers").dropDuplicates(["doc_id"]), "doc_id", "abstract")).select("doc_id", "parser", "error"))

# Structure
_LINES = "lines AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS line_no FROM (SELECT doc_id, k, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS k FROM documents WHERE length(text) > 0)))"
_HEADS = f"""{_LINES}, heads AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, length(line) AS size, CASE WHEN h4 = '' THEN length(h1) // 3 + 1 ELSE length(h4) END AS level, h2 = '' AS numbered, trim(CASE WHEN h4 = '' THEN h3 ELSE h5 END) AS title
  FROM (SELECT *, {', '.join(f"regexp_extract(line, '{sc.HEADING}', {k}) AS h{k}" for k in range(1, 6))} FROM lines WHERE regexp_matches(line, '{sc.HEADING}')))"""
_COUNTED = f"""{_HEADS}, c0 AS (SELECT *, numbered AND level <= 3 AS counts FROM heads),
g AS (SELECT *, {', '.join(f"sum(CASE WHEN counts AND level < {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g{k}" for k in (1, 2, 3))} FROM c0),
c AS (SELECT *, {', '.join(f"sum(CASE WHEN counts AND level = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g{k} ORDER BY pos) AS c{k}" for k in (1, 2, 3))} FROM g),
shown AS (SELECT doc_id, pos, size, level, trim(CASE WHEN counts THEN CASE level WHEN 1 THEN c1::VARCHAR WHEN 2 THEN c1 || '.' || c2 ELSE c1 || '.' || c2 || '.' || c3 END || ' ' ELSE '' END || title) AS display FROM c),
up AS (SELECT x.doc_id, x.pos, x.size, y.level, y.display, row_number() OVER (PARTITION BY x.doc_id, x.pos, y.level ORDER BY y.pos DESC) AS k, y.pos AS ypos, x.level AS xlevel FROM shown x JOIN shown y ON x.doc_id = y.doc_id AND y.pos <= x.pos AND y.level <= x.level),
paths AS (SELECT u.doc_id, u.pos, u.size, string_agg(u.display, ' > ' ORDER BY u.level) AS section_path FROM (SELECT * FROM up WHERE k = 1) u WHERE NOT EXISTS (SELECT 1 FROM shown z WHERE z.doc_id = u.doc_id AND z.pos <= u.pos AND z.pos > u.ypos AND z.level < u.level) GROUP BY u.doc_id, u.pos, u.size)"""


def _paths(s, d):
    return sc.section_paths(sc.headings(_docs(s, d)))


def _sections(s, d):
    return sc.sections(_paths(s, d), _docs(s, d).select("doc_id", F.length("text").alias("n")))


_SECTIONS = f"{_COUNTED}, sections AS (SELECT p.doc_id, section_path, p.pos AS char_start, coalesce(lead(p.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos), length(t.text)) AS char_end FROM paths p JOIN documents t ON p.doc_id = t.doc_id)"
_add("section_paths", lambda s, d: _paths(s, d).select("doc_id", "pos", "section_path"), f"WITH {_COUNTED} SELECT doc_id, pos, section_path FROM paths")
_add("section_offsets", lambda s, d: _sections(s, d).select("doc_id", "section_path", F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end")), f"WITH {_SECTIONS} SELECT doc_id, section_path, char_start, char_end FROM sections WHERE char_end > char_start")

# Quality
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SPANS = rf"spans AS (SELECT doc_id, k, span FROM (SELECT doc_id, {_STRIP.format('x')} AS span, k FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS x, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS k FROM documents WHERE text IS NOT NULL)) WHERE span <> '')"
_BROKEN = " OR ".join(["(length(span) - length(replace(span, '$', ''))) % 2 = 1", *[f"length(replace(span, '{a}', '')) <> length(replace(span, '{b}', ''))" for a, b in (("{", "}"), (r"\(", r"\)"), (r"\[", r"\]"))]])
_MACRO = f"regexp_matches(span, '{tx.MACRO}')"
_LISTED = "list_filter(string_split(span, E'\\n'), lambda x: regexp_matches(x, '\\S'))"
_REFS = f"len(list_filter({_LISTED}, lambda x: regexp_matches(x, '{tx.NUMBERED_LINE}'))) * 2 >= greatest(1, len({_LISTED}))"
_RATE = lambda x: f"avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END)"
_HEADER = rf"header AS (SELECT doc_id, sum(CASE WHEN regexp_matches(line, '{tx.STAMP}') OR (length(line) <= 80 AND n >= 3) THEN n ELSE 0 END) / sum(n) AS h FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, {_STRIP.format('l')} AS line FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS l FROM documents WHERE text IS NOT NULL)) WHERE line <> '' GROUP BY ALL) GROUP BY doc_id)"


def _spans(s, d):
    return sc.quality_spans(_docs(s, d))


def _rate_of(s, d, name, x):
    return _spans(s, d).groupBy("doc_id").agg(F.round(F.avg(x.cast("double")), 9).alias(name))


_add("quality_spans", lambda s, d: _spans(s, d).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sha2(F.min("span"), 256).alias("low")), f"WITH {_SPANS} SELECT doc_id, count(*) AS n_spans, sha256(min(span)) AS low FROM spans GROUP BY doc_id")
_add("quality_broken_math", lambda s, d: _rate_of(s, d, "rate", tx.math_is_broken(F.col("span"))), f"WITH {_SPANS} SELECT doc_id, round({_RATE(_BROKEN)}, 9) AS rate FROM spans GROUP BY doc_id")
_add("quality_macro_residue", lambda s, d: _rate_of(s, d, "rate", tx.has_macro(F.col("span"))), f"WITH {_SPANS} SELECT doc_id, round({_RATE(_MACRO)}, 9) AS rate FROM spans GROUP BY doc_id")
_add("quality_reference_only", lambda s, d: _rate_of(s, d, "rate", tx.is_references(F.col("span"))), f"WITH {_SPANS} SELECT doc_id, round({_RATE(_REFS)}, 9) AS rate FROM spans GROUP BY doc_id")
_add("quality_span_length", lambda s, d: _spans(s, d).groupBy("doc_id").agg(F.round(F.avg(F.length("span")), 6).alias("mean_length"), F.round(F.avg((F.length("span") < 40).cast("double")), 9).alias("short_rate")), f"WITH {_SPANS} SELECT doc_id, round(avg(length(span)), 6) AS mean_length, round({_RATE('length(span) < 40')}, 9) AS short_rate FROM spans GROUP BY doc_id")
_add("quality_header_footer", lambda s, d: sc.header_rates(_docs(s, d)).select("doc_id", F.round("header_footer_contamination_rate", 9).alias("rate")), f"WITH {_HEADER} SELECT doc_id, round(h, 9) AS rate FROM header")
_COVERED = f"{_SECTIONS}, covered AS (SELECT doc_id, sum(char_end - char_start) AS c FROM sections WHERE char_end > char_start GROUP BY doc_id)"
_COVERAGE = "CASE WHEN length(text) = 0 OR c IS NULL THEN 0.0 ELSE least(1.0, c / length(text)) END"
_add("quality_coverage", lambda s, d: sc.section_coverage(_docs(s, d), sc.section_chars(_sections(s, d))).select("doc_id", F.round("mean_section_label_coverage", 9).alias("coverage")), f"WITH {_COVERED} SELECT d.doc_id, round({_COVERAGE}, 9) AS coverage FROM documents d LEFT JOIN covered c ON d.doc_id = c.doc_id WHERE text IS NOT NULL")
_add(
    "quality_report", lambda s, d: sc.quality_report(_docs(s, d), sc.section_chars(_sections(s, d)), parser="text.v1").withColumn("n_chars", F.col("n_chars").cast("bigint")),
    f"""WITH {_COVERED}, {_SPANS}, {_HEADER}, r AS (SELECT doc_id, count(*) AS n_spans, {_RATE(_BROKEN)} AS b, {_RATE(_MACRO)} AS m, {_RATE(_REFS)} AS f, avg(length(span)) AS l, {_RATE('length(span) < 40')} AS s FROM spans GROUP BY doc_id)
SELECT d.doc_id, length(text) AS n_chars, coalesce(n_spans, 0) AS n_spans, round(coalesce(h, 0.0), 9) AS header_footer_contamination_rate, round(coalesce(b, 0.0), 9) AS broken_math_span_rate, round(coalesce(m, 0.0), 9) AS unexpanded_macro_rate, round(coalesce(f, 0.0), 9) AS reference_only_span_rate, round(coalesce(l, 0.0), 9) AS mean_span_length_chars, round(coalesce(s, 0.0), 9) AS short_span_rate,
round({_COVERAGE}, 9) AS mean_section_label_coverage, 'text.v1' AS parser_id
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN header h ON d.doc_id = h.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id WHERE text IS NOT NULL""",
)
_SEVEN = ("header_footer_contamination_rate", "broken_math_span_rate", "unexpanded_macro_rate", "reference_only_span_rate", "mean_section_label_coverage", "mean_span_length_chars", "short_span_rate")
_add("quality_aggregate", lambda s, d: table(s, d, "parse_quality").groupBy("parser_id").agg(*[F.round(F.avg(c), 9).alias(c) for c in _SEVEN]), f"SELECT parser_id, {', '.join(f'round(avg({c}), 9) AS {c}' for c in _SEVEN)} FROM parse_quality GROUP BY parser_id")
_add("quality_by_parser", lambda s, d: table(s, d, "parse_quality").where("parser_id = 'latex.v3'").agg(F.count("*").alias("n"), F.round(F.avg("mean_section_label_coverage"), 9).alias("coverage")), "SELECT count(*) AS n, round(avg(mean_section_label_coverage), 9) AS coverage FROM parse_quality WHERE parser_id = 'latex.v3'")
