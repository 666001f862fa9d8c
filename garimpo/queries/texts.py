"""Text functions, blocks, legal structure, hashes: over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from garimpo.functions import numbers as N
from garimpo.functions import text as X
from garimpo.operators import blocks as B
from garimpo.queries import values as V
from garimpo.queries.registry import Registry, sql_bare, sql_compact, sql_match, sql_norm
from garimpo.session import table

R = Registry()
_STOP = "['" + "','".join(V.STOP_WORDS) + "']"


def docs(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", "text")


def _scalar(name, column, sql, source="documents", key="doc_id", text="text", out="value"):
    """A query that applies a Column function to a text column."""

    def f(spark, sf):
        return table(spark, sf, source).filter(F.col(text).isNotNull()).select(key, column(F.col(text)).alias(out)).distinct()

    f.__name__ = name
    R.add(f"SELECT DISTINCT {key}, {sql.replace('@', text)} AS {out} FROM {source} WHERE {text} IS NOT NULL" if sql else None)(f)


_scalar("txt_identifier", X.identifier, f"CASE WHEN i = '' THEN 'coluna' WHEN regexp_matches(i, '^[0-9]') THEN 'c_' || i ELSE i END".replace("i ", f"lower(regexp_replace(regexp_replace({sql_bare('@')}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) ").replace("(i,", f"(lower(regexp_replace(regexp_replace({sql_bare('@')}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')),"), text="title")
_scalar("txt_normalize", X.norm_text, sql_norm("@"))
_scalar("txt_match", X.norm_match, sql_match("@"), source="legal_chunks", key="chunk_key")
_scalar("txt_compact", X.compact, sql_compact("@"))
_scalar("txt_excerpt", X.excerpt, f"CASE WHEN length({sql_compact('@')}) > 240 THEN trim(left({sql_compact('@')}, 240)) || '...' ELSE {sql_compact('@')} END")
_scalar("txt_token_estimate", X.token_estimate, "floor(length(@) / 3.5)::INT")
_PII_SQL = "@"
for _p, _l in V.PII:
    _PII_SQL = f"regexp_replace({_PII_SQL}, '{_p}', '{_l}', 'g')"
_scalar("txt_pii_mask", X.mask_pii, _PII_SQL, source="pdf_blocks", key="block_key")
_scalar("txt_inject_detect", X.has_injection, "regexp_matches(" + sql_match("@") + ", '" + "|".join(f"(?:{p})" for p in V.INJECTION) + "')", source="messages", key="message_id", text="content")
_SAN = "@"
for _p in V.CONTEXT_MARKS:
    _SAN = f"regexp_replace({_SAN}, '{_p}', '{V.REMOVED}', 'g')"
_scalar("txt_context_sanitize", X.sanitize_context, _SAN, source="legal_chunks", key="chunk_key")
_MARKS = "@"
for _p in V.PAGE_MARKS:
    _MARKS = f"regexp_replace({_MARKS}, '(?im){_p}', '', 'g')"
_scalar("txt_strip_headers", X.strip_page_marks, f"trim(regexp_replace({_MARKS}, '\\n{{3,}}', chr(10) || chr(10), 'g'))", source="pipeline_results", key="result_id", text="clean_text")
_scalar("txt_orphan_lines", X.drop_number_lines, "array_to_string(list_filter(string_split(@, chr(10)), lambda x: NOT regexp_full_match(x, '\\s*\\d{1,4}\\s*')), chr(10))", source="pipeline_results", key="result_id", text="clean_text")
_scalar("txt_whitespace", X.tidy, "trim(regexp_replace(regexp_replace(@, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t\\r\\f]+', ' ', 'g'))", source="pipeline_results", key="result_id", text="clean_text")
_KEYS = "list_transform(string_split(@, chr(10) || chr(10)), lambda b: CASE WHEN length(trim(b)) >= 40 THEN lower(" + sql_compact("b") + ") END)"
_scalar("txt_dedup_paragraphs", X.unique_blocks, f"array_to_string(list_filter(string_split(@, chr(10) || chr(10)), lambda b, i: length(trim(b)) < 40 OR list_position({_KEYS}, lower({sql_compact('b')})) = i), chr(10) || chr(10))", source="pipeline_results", key="result_id", text="clean_text")
_scalar("txt_deep_clean", X.deep_clean, None, source="pipeline_results", key="result_id", text="clean_text")
_scalar("txt_strip_markdown", X.strip_headings, "regexp_replace(@, '(?m)^#{1,6}[ \\t]+', '', 'g')")
_scalar("txt_unwrap_headings", X.unwrap_headings, None, source="legal_chunks", key="chunk_key")
_scalar("txt_slug", X.slug, f"regexp_replace(regexp_replace({sql_match('@')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')", text="title")
_scalar("hash_content", lambda c: F.sha2(c, 256), "sha256(@)")


@R.add(f"SELECT doc_id, unnest(list_filter(string_split({sql_norm('text')}, ' '), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))) AS token FROM documents WHERE text IS NOT NULL")
def txt_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))


@R.add(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_filter(string_split({sql_norm('text')}, ' '), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))) AS token FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def txt_vocabulary(spark, sf):
    per_doc = docs(spark, sf).select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@R.add(f"SELECT DISTINCT doc_id, unnest(list_filter(string_split({sql_norm('title')}, ' '), lambda w: regexp_matches(w, '^\\d+$|^[ivxlcdm]{{1,8}}$') OR (length(w) >= 3 AND NOT list_contains({_STOP}, w)))) AS keyword FROM documents WHERE title IS NOT NULL")
def txt_keywords(spark, sf):
    return table(spark, sf, "documents").filter("title is not null").select("doc_id", F.explode(X.keywords(F.col("title"))).alias("keyword"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(?i)(^|[^\\p{L}\\p{N}_])(Art|Inc|Sr|Sra|Dr|Dra|Prof|Ltda|S\\.A|Jr|n|p|fl|fls|vol|ed|etc|ex)\\.', '\\1\\2' || chr(1), 'g'), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"


@R.add(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENT} AS s FROM documents WHERE text IS NOT NULL)")
def txt_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@R.add("SELECT DISTINCT chunk_key, unnest(list_distinct(list_transform(regexp_extract_all(lower(text), 'art(?:igo)?\\.?\\s*(\\d+)', 1), lambda n: 'Art. ' || n))) AS ref FROM legal_chunks WHERE text IS NOT NULL")
def txt_refs(spark, sf):
    return table(spark, sf, "legal_chunks").filter("text is not null").select("chunk_key", F.explode(X.article_refs(F.col("text"))).alias("ref")).distinct()


@R.add("SELECT DISTINCT node_key, unnest(list_concat(" + ", ".join(f"list_transform(regexp_extract_all({sql_match('text')}, '\\b{k}\\s+([ivxlcdm]+|\\d{{1,4}})\\b', 1), lambda v: '{k} ' || v)" for k in V.STRUCTURES) + ")) AS ref FROM legal_nodes WHERE text IS NOT NULL")
def txt_structural_refs(spark, sf):
    return table(spark, sf, "legal_nodes").filter("text is not null").select("node_key", F.explode(X.structural_refs(F.col("text"))).alias("ref")).distinct()


_ROMAN_SQL = "list_reduce(list_prepend({'t': 0, 'p': 0}, list_transform(list_reverse(string_split(lower(numeral), '')), lambda c: {'t': 0, 'p': map {'i': 1, 'v': 5, 'x': 10, 'l': 50, 'c': 100, 'd': 500, 'm': 1000}[c]})), lambda a, x: {'t': CASE WHEN x.p < a.p THEN a.t - x.p ELSE a.t + x.p END, 'p': x.p}).t"


@R.add(f"SELECT DISTINCT numeral, CASE WHEN regexp_full_match(lower(numeral), '[ivxlcdm]+') THEN {_ROMAN_SQL} ELSE 0 END AS n FROM legal_nodes WHERE numeral IS NOT NULL")
def txt_numeral_roman(spark, sf):
    return table(spark, sf, "legal_nodes").filter("numeral is not null").select("numeral", N.roman_to_int(F.col("numeral")).alias("n")).distinct()


_PLACE = ["['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX']", "['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC']", "['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM']", "['', 'M', 'MM', 'MMM']"]


@R.add("SELECT DISTINCT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 3999 THEN " + " || ".join(f"{_PLACE[k]}[(p_partkey // {10 ** k} % 10)::INT + 1]" for k in (3, 2, 1, 0)) + " ELSE p_partkey::VARCHAR END AS roman FROM part")
def txt_int_to_roman(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.int_to_roman(F.col("p_partkey")).alias("roman")).distinct()


@R.add("SELECT DISTINCT sha256(concat_ws(':', collection, doc_id::VARCHAR, '0')) AS chunk_id, doc_id FROM documents WHERE collection IS NOT NULL")
def hash_chunk_id(spark, sf):
    return table(spark, sf, "documents").filter("collection is not null").select(N.chunk_id(F.col("collection"), F.col("doc_id"), F.lit(0)).alias("chunk_id"), "doc_id").distinct()


@R.add("SELECT DISTINCT node_key, left(sha256(concat_ws('::', pdf_doc_id, node_type, label)), 16) AS id FROM legal_nodes")
def hash_node_id(spark, sf):
    return table(spark, sf, "legal_nodes").select("node_key", N.node_id(F.col("pdf_doc_id"), F.col("node_type"), F.col("label")).alias("id")).distinct()


# ---------------------------------------------------------------- documents

_LEGAL = r"(?im)^\s*art\.?\s*\d+|^\s*capitulo\s+[ivxlcdm\d]+|^\s*secao\s+[ivxlcdm\d]+|^\s*titulo\s+[ivxlcdm\d]+"
_MARK = r"(?i)capitulo|secao|titulo"
_ART = r"(?im)^\s*art\.?\s*\d+"
_CODE = r"(?im)^\s*(?:[a-z]{0,4}[-_/]?)?\d{4,}\b"
_WORDS = ("procedimento", "codigo", "descri", "cobertura", "autoriz", "prazo", "segmentacao", "ans")


def document_class(text):
    """doc_class, confidence: legal, tabular, mixed or narrative, by counts of patterns over the whole text."""
    n = X.norm_match(text)
    legal = F.size(F.regexp_extract_all(n, F.lit(_LEGAL), F.lit(0)))
    marks = F.size(F.regexp_extract_all(n, F.lit(_ART), F.lit(0))) + F.size(F.regexp_extract_all(n, F.lit(_MARK), F.lit(0)))
    codes = F.size(F.regexp_extract_all(n, F.lit(_CODE), F.lit(0)))
    words = sum((F.contains(n, F.lit(w)).cast("int") for w in _WORDS), F.lit(0))
    is_legal, tabular, mixed = (marks >= 3) & (legal >= 3), codes >= 8, (words >= 2) & (codes >= 3)
    return F.when(is_legal, "legal").when(tabular, "tabular").when(mixed, "mixed").otherwise("narrative"), F.when(is_legal, 0.9).when(tabular, 0.82).when(mixed, 0.78).otherwise(0.8)


_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_N = sql_match("text")


@R.add(f"""SELECT doc_id, CASE WHEN m >= 3 AND l >= 3 THEN 'legal' WHEN c >= 8 THEN 'tabular' WHEN w >= 2 AND c >= 3 THEN 'mixed' ELSE 'narrative' END AS doc_class,
CASE WHEN m >= 3 AND l >= 3 THEN 0.9 WHEN c >= 8 THEN 0.82 WHEN w >= 2 AND c >= 3 THEN 0.78 ELSE 0.8 END AS confidence FROM (
SELECT doc_id, {_COUNT.format('n', _LEGAL)} AS l, {_COUNT.format('n', _ART)} + {_COUNT.format('n', _MARK)} AS m, {_COUNT.format('n', _CODE)} AS c, {" + ".join(f"contains(n, '{w}')::INT" for w in _WORDS)} AS w
FROM (SELECT doc_id, {_N} AS n FROM documents WHERE text IS NOT NULL))""")
def doc_classify(spark, sf):
    kind, confidence = document_class(F.col("text"))
    return docs(spark, sf).select("doc_id", kind.alias("doc_class"), confidence.alias("confidence"))


# ---------------------------------------------------------------- blocks

def _rows(spark, sf):
    return B.rows_of(table(spark, sf, "pdf_blocks")).withColumn("kind", B.kind(F.col("text"), F.col("y")))


_BN = sql_match("t")
_KIND = f"""CASE WHEN length(t) < 3 OR regexp_matches(n, '^<!--\\s*image\\s*-->$|^\\*{{3,}}$|^[-_=]{{10,}}$|^\\d{{1,4}}$') THEN 'noise'
WHEN y < 101.04 AND hd THEN 'header' WHEN y > 740.96 AND ft THEN 'footer' WHEN regexp_matches(n, '^(titulo\\s+[ivxlcdm\\d]+|estatuto\\s+social|regulamento|regimento)\\b') THEN 'title'
WHEN regexp_matches(n, '^(capitulo|secao|parte)\\s+[ivxlcdm\\d]+') THEN 'section_header' WHEN regexp_matches(n, '^anexo\\s+[ivxlcdm\\d]+') THEN 'annex'
WHEN regexp_matches(n, '\\|[^\\n]*\\||\\+[-=]+\\+') THEN 'table' WHEN y = 0 AND ft THEN 'footer' WHEN y = 0 AND hd THEN 'header' ELSE 'body' END"""
_BLOCKS = f"""SELECT *, {_KIND} AS kind FROM (SELECT *, regexp_matches(n, 'pagina\\s+\\d+\\s+de\\s+\\d+|classificacao da informacao|\\(baixado por\\s+') AS ft, regexp_matches(n, 'n[°º]/rev\\.?:|este documento faz parte') AS hd
FROM (SELECT *, {_BN} AS n, lower({sql_compact('text')}) AS norm FROM (SELECT DISTINCT ON (block_key) block_key, pdf_doc_id AS doc, page_number AS page, block_seq AS seq, coalesce(text, '') AS text, trim(coalesce(text, '')) AS t, coalesce(bbox[2], 0) AS y, block_type AS given FROM pdf_blocks)))"""


@R.add(f"SELECT block_key, kind FROM ({_BLOCKS})")
def blk_classify(spark, sf):
    return _rows(spark, sf).select("block_key", "kind")


def _repeated(least):
    return f"""SELECT doc, norm FROM (SELECT doc, norm, count(DISTINCT page) AS n FROM b WHERE length(norm) >= 10 GROUP BY 1, 2) JOIN (SELECT doc, count(DISTINCT page) AS pages FROM b GROUP BY 1) USING (doc) WHERE n >= least({least}, greatest(2, pages // 3))"""


@R.add(f"WITH b AS ({_BLOCKS}) {_repeated(3)}")
def blk_repeated(spark, sf):
    return B.repeated(_rows(spark, sf))


@R.add(f"WITH b AS ({_BLOCKS}), r AS ({_repeated(3)}) SELECT block_key, CASE WHEN kind = 'body' AND r.doc IS NOT NULL THEN 'header' ELSE kind END AS kind FROM b LEFT JOIN r USING (doc, norm)")
def blk_relabelled(spark, sf):
    return B.relabelled(_rows(spark, sf)).select("block_key", "kind")


@R.add(f"WITH b AS ({_BLOCKS}) SELECT block_key, CASE WHEN kind = 'body' THEN last_value(CASE WHEN kind IN ('title', 'section_header') THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq, block_key ROWS UNBOUNDED PRECEDING) END AS hint FROM b")
def blk_hint_ffill(spark, sf):
    return B.with_hints(_rows(spark, sf)).select("block_key", "hint")


@R.add(f"""WITH b AS ({_BLOCKS}), m AS (SELECT *, CASE WHEN kind = 'body' AND lag(kind) OVER w = 'body' AND regexp_matches(rtrim(lag(text) OVER w), '[a-zA-ZÀ-ÿ,]$') AND regexp_matches(ltrim(text), '^[a-zA-ZÀ-ÿ]') THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY doc, page ORDER BY seq, block_key)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY seq, block_key ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT min(block_key) AS block_key, count(*) AS parts, string_agg(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), ' ' ORDER BY seq, block_key) AS text FROM i GROUP BY doc, page, island""")
def blk_recompose(spark, sf):
    return B.paragraphs(_rows(spark, sf)).select("block_key", "parts", "text")


_QUALITY = f"""WITH b AS ({_BLOCKS}), r AS ({_repeated(2)}), p AS (SELECT doc, count(*) AS n FROM b GROUP BY doc, page),
c AS (SELECT doc, CASE WHEN count(*) > 1 THEN greatest(0.0, 1 - stddev_samp(n) / (avg(n) + 1)) ELSE 1.0 END AS coherence FROM p GROUP BY 1),
s AS (SELECT b.doc, count(*) AS total, avg((kind = 'noise')::INT) AS noise_ratio, avg((r.doc IS NOT NULL)::INT) AS repetition_ratio, bool_or(kind IN ('title', 'section_header')) AS structured,
 coalesce(sum((kind = 'body' AND length(trim(text)) < 20)::INT) / nullif(sum((kind = 'body')::INT), 0), 0.0) AS broken_ratio, avg((length(trim(text)) < 5)::INT) AS empty_ratio FROM b LEFT JOIN r USING (doc, norm) GROUP BY 1),
q AS (SELECT *, greatest(0.0, least(1.0, (1 - noise_ratio) * 0.25 + (1 - repetition_ratio) * 0.15 + (CASE WHEN structured THEN 1.0 ELSE 0.3 END) * 0.2 + (1 - broken_ratio) * 0.15 + (1 - empty_ratio) * 0.1 + coherence * 0.15)) AS score,
 list_filter([CASE WHEN noise_ratio > 0.3 THEN 'high_noise' END, CASE WHEN repetition_ratio > 0.2 THEN 'high_repetition' END, CASE WHEN NOT structured THEN 'no_structure' END, CASE WHEN broken_ratio > 0.4 THEN 'many_broken_lines' END,
 CASE WHEN empty_ratio > 0.3 THEN 'many_empty_blocks' END, CASE WHEN coherence < 0.5 THEN 'inconsistent_pages' END], lambda x: x IS NOT NULL) AS flags FROM s JOIN c USING (doc))"""


@R.add(_QUALITY + " SELECT doc, total, round(score, 4) AS score, array_to_string(flags, '|') AS flags, round(coherence, 4) AS coherence FROM q")
def blk_quality(spark, sf):
    return B.quality(_rows(spark, sf)).select("doc", "total", F.round("score", 4).alias("score"), F.array_join("flags", "|").alias("flags"), F.round("coherence", 4).alias("coherence"))


@R.add(_QUALITY + " SELECT doc, CASE WHEN round(score, 3) < 0.4 THEN 'failed_parse' WHEN round(score, 3) < 0.55 OR len(flags) > 0 THEN 'needs_review' ELSE 'success' END AS gate FROM q")
def blk_gate(spark, sf):
    return B.quality(_rows(spark, sf)).select("doc", B.gate(F.col("score"), F.col("flags")).alias("gate"))


@R.add(f"WITH b AS ({_BLOCKS}), c AS (SELECT doc, page, kind, count(*) AS n FROM b GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY n DESC, kind) AS r FROM c QUALIFY r <= 4) SELECT doc, page, string_agg(kind, '|' ORDER BY r) AS kinds FROM t GROUP BY 1, 2")
def join_page_context(spark, sf):
    return B.page_context(_rows(spark, sf))


@R.add()
def blk_clean_text(spark, sf):
    """Content blocks of each page as text; pages can be concatenated in order."""
    rows = B.relabelled(_rows(spark, sf)).filter(F.col("kind").isin(*B.CONTENT))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_key", "text"))), lambda x: F.trim(x["text"]))
    return rows.groupBy("doc", "page").agg(F.array_join(ordered, "\n\n").alias("text"))


# ---------------------------------------------------------------- legal structure

_LINE = "SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)"
_HEAD = f"SELECT doc_id, line, CASE WHEN regexp_matches(n, '^titulo\\s+([ivxlcdm]+|\\d+)\\b') THEN 1 WHEN regexp_matches(n, '^capitulo\\s+([ivxlcdm]+|\\d+)\\b') THEN 2 WHEN regexp_matches(n, '^secao\\s+([ivxlcdm]+|\\d+)\\b') THEN 3 WHEN regexp_matches(n, '^art\\.?\\s*\\d+') THEN 4 END AS level, trim(raw) AS label FROM (SELECT *, lower(trim({sql_bare('raw')})) AS n FROM ({_LINE}))"


def markers(df):
    """doc_id, line, level, label: headings (title 1, chapter 2, section 3) and articles (4) in order."""
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    n = X.norm_match(F.trim("raw"))
    level = F.when(n.rlike(r"^titulo\s+([ivxlcdm]+|\d+)\b"), 1).when(n.rlike(r"^capitulo\s+([ivxlcdm]+|\d+)\b"), 2).when(n.rlike(r"^secao\s+([ivxlcdm]+|\d+)\b"), 3).when(n.rlike(r"^art\.?\s*\d+"), 4)
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), level.alias("level"), F.trim("raw").alias("label")).filter("level is not null")


@R.add(f"SELECT * FROM ({_HEAD}) WHERE level IS NOT NULL")
def legal_markers(spark, sf):
    return markers(docs(spark, sf))


def nested(marks):
    """Parent: the last marker before with a smaller level. End: the line of the next with the same or a smaller one."""
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    last = [F.max(F.when(F.col("level") == k, F.col("line"))).over(before) for k in (1, 2, 3)]
    nxt = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in (1, 2, 3, 4)]
    up = {k: F.greatest(*last[: k - 1]) if k > 2 else (last[0] if k == 2 else F.lit(None).cast("long")) for k in (1, 2, 3, 4)}
    pick = lambda options: F.coalesce(*[F.when(F.col("level") == k, v) for k, v in options.items()])
    return marks.withColumn("parent", pick(up)).withColumn("end", pick({k: nxt[k - 1] for k in (1, 2, 3, 4)}))


@R.add(f"WITH m AS (SELECT * FROM ({_HEAD}) WHERE level IS NOT NULL) SELECT a.doc_id, a.line, coalesce((SELECT max(b.line) FROM m b WHERE b.doc_id = a.doc_id AND b.line < a.line AND b.level < a.level), 0) AS parent, coalesce((SELECT min(b.line) FROM m b WHERE b.doc_id = a.doc_id AND b.line > a.line AND b.level <= a.level), 0) AS \"end\" FROM m a")
def legal_spans(spark, sf):
    return nested(markers(docs(spark, sf))).select("doc_id", "line", F.coalesce("parent", F.lit(0)).alias("parent"), F.coalesce("end", F.lit(0)).alias("end"))


@R.add("SELECT node_type, count(*) AS n, count(DISTINCT pdf_doc_id) AS docs, count(*) FILTER (coalesce(parent_id, '') = '') AS roots FROM (SELECT DISTINCT ON (node_key) * FROM legal_nodes) GROUP BY 1")
def legal_node_counts(spark, sf):
    n = table(spark, sf, "legal_nodes").dropDuplicates(["node_key"])
    return n.groupBy("node_type").agg(F.count("*").alias("n"), F.countDistinct("pdf_doc_id").alias("docs"), F.sum((F.coalesce("parent_id", F.lit("")) == "").cast("long")).alias("roots"))


@R.add("SELECT DISTINCT c.node_key, p.node_key AS parent_key FROM legal_nodes c JOIN legal_nodes p ON c.parent_id = p.node_id AND c.pdf_doc_id = p.pdf_doc_id")
def legal_parents(spark, sf):
    n = table(spark, sf, "legal_nodes")
    p = n.select(F.col("node_id").alias("parent_id"), "pdf_doc_id", F.col("node_key").alias("parent_key")).distinct()
    return n.select("node_key", "parent_id", "pdf_doc_id").distinct().join(p, ["parent_id", "pdf_doc_id"]).select("node_key", "parent_key").distinct()


@R.add(f"SELECT DISTINCT node_key, label FROM legal_nodes WHERE node_type = 'capitulo' AND contains({sql_match('label')}, 'fiscalizacao')")
def legal_label_search(spark, sf):
    return table(spark, sf, "legal_nodes").filter((F.col("node_type") == "capitulo") & F.contains(X.norm_match(F.col("label")), F.lit("fiscalizacao"))).select("node_key", "label").distinct()


_SUM = "list_filter(list_transform(string_split(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' '), '([.;:])[ \\t\\r\\n]+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(s)), lambda s: s <> '')"


@R.add(f"SELECT DISTINCT node_key, array_to_string(s[1:2], ' ') AS executive, array_to_string(s[1:4], ' ') AS legal, array_to_string(list_transform(s[1:5], lambda x: left(x, 220)), chr(10)) AS points FROM (SELECT node_key, {_SUM} AS s FROM legal_nodes WHERE text IS NOT NULL)")
def sum_extractive(spark, sf):
    one = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    s = F.filter(F.transform(F.split(one, r"(?<=[.;:])[ \t\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf, "legal_nodes").filter("text is not null").select("node_key", s.alias("s"))
    return rows.select("node_key", F.array_join(F.slice("s", 1, 2), " ").alias("executive"), F.array_join(F.slice("s", 1, 4), " ").alias("legal"), F.array_join(F.transform(F.slice("s", 1, 5), lambda x: F.left(x, F.lit(220))), "\n").alias("points")).distinct()
