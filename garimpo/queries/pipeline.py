"""Ingestion, structures, catalogs, summaries and column semantics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from garimpo.operators import blocks as B
from garimpo.operators import catalog as C
from garimpo.operators import evaluation as E
from garimpo.operators import ingest as I
from garimpo.operators import store as T
from garimpo.operators import summaries as S
from garimpo.plans import semantics
from garimpo.queries.registry import Registry, sql_match, sql_norm
from garimpo.session import table

R = Registry()


def _rows(spark, sf):
    return B.rows_of(table(spark, sf, "pdf_blocks")).withColumn("kind", B.kind(F.col("text"), F.col("y")))


_BLK = f"SELECT *, {sql_match('text')} AS n FROM (SELECT DISTINCT ON (block_key) block_key, pdf_doc_id AS doc, page_number AS page, block_seq AS seq, coalesce(text, '') AS text FROM pdf_blocks)"
_NUM = "\\b{0}\\s+([ivxlcdm]+|\\d{{1,4}})\\b"
_HEADS = f"SELECT *, CASE WHEN regexp_matches(n, '{_NUM.format('titulo')}') THEN 1 WHEN regexp_matches(n, '{_NUM.format('capitulo')}') THEN 2 WHEN regexp_matches(n, '{_NUM.format('secao')}') THEN 3 END AS level, trim(split_part(trim(text), chr(10), 1)) AS label FROM ({_BLK})"


@R.add(f"WITH h AS (SELECT * FROM ({_HEADS}) WHERE level IS NOT NULL) SELECT doc, seq AS start, block_key, ['titulo', 'capitulo', 'secao'][level] AS kind, label, (SELECT min(b.seq) FROM h b WHERE b.doc = a.doc AND (b.seq, b.block_key) > (a.seq, a.block_key) AND b.level <= a.level) AS \"end\" FROM h a")
def ing_structures(spark, sf):
    """Titles, chapters and sections out of blocks, each to the next of its level or above."""
    return I.structures(_rows(spark, sf)).select("doc", "start", "block_key", "kind", "label", "end")


@R.add(f"""WITH b AS (SELECT *, regexp_extract(text, '(?i)\\bart\\.?\\s*(\\d{{1,4}})', 1) AS art FROM ({_HEADS}) WHERE trim(text) <> ''),
m AS (SELECT *, last_value(CASE WHEN art <> '' OR level IS NOT NULL THEN block_key END IGNORE NULLS) OVER w AS g, last_value(CASE WHEN level = 2 THEN label END IGNORE NULLS) OVER w AS capitulo FROM b WINDOW w AS (PARTITION BY doc ORDER BY seq, block_key ROWS UNBOUNDED PRECEDING))
SELECT doc, min(seq) AS start, max(seq) + 1 AS "end", arg_min(art, (seq, block_key)) AS article, coalesce(arg_min(capitulo, (seq, block_key)), '') AS capitulo, count(*) AS blocks FROM m WHERE g IS NOT NULL GROUP BY doc, g HAVING arg_min(art, (seq, block_key)) <> ''""")
def ing_articles(spark, sf):
    """Articles out of blocks, each to the next article or heading."""
    found = I.articles(_rows(spark, sf))
    return found.select("doc", "start", "end", "article", "capitulo", F.col("blocks").cast("long").alias("blocks"))


@R.add(f"WITH h AS ({_HEADS}) SELECT doc, ['titulo', 'capitulo', 'secao'][level] AS kind, count(*) AS n FROM h WHERE level IS NOT NULL GROUP BY 1, 2")
def ing_structure_counts(spark, sf):
    return I.structure_counts(I.structures(_rows(spark, sf)))


@R.add("SELECT node_key, '[' || upper(node_type) || ': ' || coalesce(label, '') || ']' || chr(10) || left(coalesce(text, ''), 2000) AS embed_text, array_to_string(articles[1:30], ', ') AS articles, length(coalesce(text, '')) AS text_length FROM (SELECT DISTINCT ON (node_key) * FROM legal_nodes) WHERE node_type IN ('titulo', 'capitulo', 'secao')")
def ing_macro_chunks(spark, sf):
    """Texts of whole structures for an index."""
    return I.macro_chunks(table(spark, sf, "legal_nodes").dropDuplicates(["node_key"])).select("node_key", "embed_text", "articles", "text_length")


@R.add("SELECT DISTINCT chunk_key, concat_ws(chr(10), CASE WHEN pdf_doc_id <> '' THEN '[Documento: ' || pdf_doc_id || ']' END, CASE WHEN caminho_hierarquico <> '' THEN '[Caminho: ' || caminho_hierarquico || ']' END, CASE WHEN inciso <> '' THEN '[Inciso: ' || inciso || ']' END, text) AS text FROM legal_chunks WHERE text IS NOT NULL")
def ing_context_text(spark, sf):
    c = table(spark, sf, "legal_chunks").filter("text is not null")
    return c.select("chunk_key", I.contextual(F.col("pdf_doc_id"), F.col("caminho_hierarquico"), F.col("inciso"), F.col("text")).alias("text")).distinct()


@R.add()
def ing_process(spark, sf):
    """Page texts of the documents that passed the whole chain."""
    return I.process(table(spark, sf, "pdf_blocks"))["texts"]


@R.add()
def ing_markdown(spark, sf):
    return I.markdown(_rows(spark, sf))


@R.add()
def cat_normalize(spark, sf):
    """Extracted tables of one family under canonical names, as records."""
    config = C.Config(aliases={"codigo": ("cod", "codigo_procedimento"), "descricao": ("procedimento", "nome_item", "titulo")}, columns=("codigo", "descricao", "cobertura", "prazo"), searched=("codigo", "descricao", "cobertura"))
    files = table(spark, sf, "table_extractions").filter("family = 'rol_procedimentos'").dropDuplicates(["extraction_id"]).select(F.col("extraction_id").alias("source"), "column_names", F.explode("records").alias("r"))
    raw = files.select("source", F.col("r.row_index").alias("row_no"), F.transform("column_names", lambda c: F.try_element_at("r.fields", c)).alias("cells"))
    heads = files.select("source", F.col("column_names").alias("names")).distinct()
    return C.records(C.normalised(raw, config, heads), config).select("source", "row_no", "codigo", "descricao", "searchable")


_PART = "SELECT p_partkey, " + sql_norm("concat_ws(' ', 'nome ' || p_name, 'marca ' || p_brand)") + " AS t FROM part"


@R.add(f"SELECT codigo, score FROM (SELECT p_partkey::VARCHAR AS codigo, (CASE WHEN contains(t, 'steel brushed') THEN 3.0 ELSE 0.0 END) + contains(t, 'steel')::INT + contains(t, 'brushed')::INT AS score FROM ({_PART})) WHERE score > 0 ORDER BY score DESC, codigo LIMIT 20")
def cat_ask(spark, sf):
    """Catalog search by the words of a question in plain form."""
    config = C.Config(columns=("codigo", "nome", "marca"), description="nome", searched=("nome", "marca"), filters=())
    p = table(spark, sf, "part")
    fields = p.select(F.lit("part").alias("source"), F.col("p_partkey").alias("row_no"), F.create_map(F.lit("codigo"), F.col("p_partkey").cast("string"), F.lit("nome"), "p_name", F.lit("marca"), "p_brand").alias("fields"))
    return C.ask(C.records(fields, config), "steel brushed", config, limit=20).select("codigo", "score")


@R.add()
def sum_nodes(spark, sf):
    """Summaries of all nodes by rule, and the parts that a model would read."""
    n = table(spark, sf, "legal_nodes").dropDuplicates(["node_key"])
    return S.summarise(n, least=50).select("node_key", "status", "parts", "executive", "legal")


@R.add("SELECT c AS column_name, sum(n) AS filled, round(sum(CASE WHEN regexp_matches(trim(v), '^-?(?:\\d+|\\d{1,3}(?:\\.\\d{3})+)(?:[.,]\\d+)?(?:[eE][-+]?\\d+)?$') THEN n ELSE 0 END) / sum(n), 6) AS numeric_share FROM (SELECT c, v, count(*) AS n FROM (SELECT unnest([{'c': 'raw_text', 'v': raw_text}, {'c': 'unit', 'v': unit}, {'c': 'origin', 'v': origin}, {'c': 'faixa', 'v': faixa}, {'c': 'procedimento', 'v': procedimento}, {'c': 'urgency', 'v': urgency}], recursive := true) FROM deadlines) WHERE trim(v) <> '' GROUP BY 1, 2) GROUP BY 1")
def prof_numeric_text(spark, sf):
    """Share of numbers in the text columns, over all rows."""
    d = table(spark, sf, "deadlines").select("raw_text", "unit", "origin", "faixa", "procedimento", "urgency")
    shares = semantics.numeric_shares(d)
    filled = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in d.columns])).alias("x")).filter(F.trim("x.v") != "").groupBy("x.c").agg(F.count("*").alias("filled"))
    known = spark.createDataFrame(list(shares.items()), "c string, numeric_share double")
    return filled.join(known, "c").select(F.col("c").alias("column_name"), "filled", F.round("numeric_share", 6).alias("numeric_share"))


@R.add("SELECT count(*) AS n FROM deadlines WHERE contains(lower(procedimento), '10') AND contains(lower(raw_text), 'dias')")
def flt_lookup(spark, sf):
    """Rows by contains-filters whose names are resolved against the columns; unknown names do not count. Here all rows are counted."""
    d = table(spark, sf, "deadlines")
    profiles = semantics.profile(d)
    for key, v in {"procedimento": "10", "raw_text": "Dias", "nada_disso": "x"}.items():
        if column := semantics.filter_column(key, profiles):
            d = d.filter(F.contains(F.lower(F.col(column).cast("string")), F.lit(v.lower())))
    return d.agg(F.count("*").alias("n"))


@R.add("SELECT prazo_faixa, count(*) AS n FROM (SELECT DISTINCT deadline_id, CASE WHEN contains(x, 'sem cobertura') THEN 'Sem Cobertura' WHEN contains(x, 'nao autoriza') THEN 'Nao autoriza' WHEN contains(x, 'imediato') THEN 'Imediato' ELSE 'outro' END AS prazo_faixa FROM (SELECT deadline_id, " + sql_match("coalesce(raw_text, '')") + " AS x FROM deadlines)) GROUP BY 1")
def cp_upsert_deadlines(spark, sf):
    """Derived deadline columns on insert, old rows of the same key replaced."""
    d = table(spark, sf, "deadlines").select("deadline_id", F.coalesce("raw_text", F.lit("")).alias("prazo_autorizacao")).distinct()
    rows = T.upsert_records(d.select("deadline_id"), d, "deadline_id", "prazo_autorizacao")
    band = F.when(F.col("prazo_faixa").isin("Sem Cobertura", "Nao autoriza", "Imediato"), F.col("prazo_faixa")).otherwise("outro")
    return rows.groupBy(band.alias("prazo_faixa")).agg(F.count("*").alias("n"))


@R.add()
def eval_structural(spark, sf):
    """Rates of summaries against the nodes they stand for, one target a type and number."""
    n = table(spark, sf, "legal_nodes").dropDuplicates(["node_key"]).filter("node_type in ('titulo', 'capitulo', 'secao') and numeral is not null")
    made = S.summarise(n, least=50).join(n.select("node_key", "node_type", "numeral", "label"), "node_key")
    gold = n.groupBy("node_type", "numeral").agg(F.min("node_key").alias("query_id"), F.min_by("articles", "label").alias("articles")).select("query_id", F.col("node_type").alias("target_type"), F.col("numeral").alias("target_numeral"), F.transform("articles", lambda a: F.concat(F.lit("Art. "), a)).alias("expected"))
    return E.structural_suite(made, gold)


@R.add("SELECT DISTINCT lower(regexp_extract(source_file, '([^/]+)$', 1)) AS name, left(sha256(concat_ws('::', total_pages::VARCHAR, source_file)), 16) AS id FROM table_extractions WHERE source_file IS NOT NULL")
def hash_block_id(spark, sf):
    t = table(spark, sf, "table_extractions").filter("source_file is not null")
    return t.select(F.lower(F.regexp_extract("source_file", r"([^/]+)$", 1)).alias("name"), I.block_id(F.col("total_pages"), F.col("source_file")).alias("id")).distinct()
