"""Structural questions, citations, neighbours, merged lists and name checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from garimpo.functions import numbers as N
from garimpo.queries.registry import Registry
from garimpo.session import table

R = Registry()
_NODES = "(SELECT DISTINCT ON (node_key) * FROM legal_nodes)"


def _nodes(spark, sf):
    return table(spark, sf, "legal_nodes").dropDuplicates(["node_key"])


@R.add(f"SELECT pdf_doc_id, count(*) FILTER (node_type = 'capitulo') AS chapters, count(*) FILTER (node_type = 'secao') AS sections, count(*) FILTER (node_type = 'titulo') AS titles FROM {_NODES} GROUP BY 1")
def legal_count_structures(spark, sf):
    """How many chapters, sections and titles each document has."""
    n = lambda k: F.sum((F.col("node_type") == k).cast("long"))
    return _nodes(spark, sf).groupBy("pdf_doc_id").agg(n("capitulo").alias("chapters"), n("secao").alias("sections"), n("titulo").alias("titles"))


@R.add(f"SELECT pdf_doc_id, arg_min(label, (page_start, node_key)) AS first_label, arg_max(label, (page_start, node_key)) AS last_label FROM {_NODES} WHERE node_type = 'capitulo' AND page_start IS NOT NULL AND label IS NOT NULL GROUP BY 1")
def legal_locate_ends(spark, sf):
    """First and last chapter of each document."""
    c = _nodes(spark, sf).filter("node_type = 'capitulo' and page_start is not null and label is not null")
    order = F.struct("page_start", "node_key")
    return c.groupBy("pdf_doc_id").agg(F.min_by("label", order).alias("first_label"), F.max_by("label", order).alias("last_label"))


@R.add(f"SELECT pdf_doc_id, node_key, a AS article FROM (SELECT pdf_doc_id, node_key, unnest(articles) AS a FROM {_NODES}) WHERE a IS NOT NULL")
def legal_articles(spark, sf):
    return _nodes(spark, sf).select("pdf_doc_id", "node_key", F.explode("articles").alias("article")).filter("article is not null")


@R.add("SELECT DISTINCT chunk_key, concat_ws(' | ', pdf_doc_id, nullif(capitulo, ''), nullif(artigo, ''), 'p. ' || page_number) AS citation FROM legal_chunks")
def txt_citation(spark, sf):
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return table(spark, sf, "legal_chunks").select("chunk_key", F.concat_ws(" | ", "pdf_doc_id", some("capitulo"), some("artigo"), F.concat(F.lit("p. "), F.col("page_number").cast("string"))).alias("citation")).distinct()


@R.add("SELECT chunk_key, greatest(0, chunk_index - 1) AS prev_index, least(max(chunk_index) OVER (PARTITION BY pdf_doc_id), chunk_index + 1) AS next_index FROM (SELECT DISTINCT ON (chunk_key) * FROM legal_chunks)")
def win_prev_next(spark, sf):
    """Index of the chunk before and after, within the document; the last index comes from an aggregate, not a window over the document."""
    c = table(spark, sf, "legal_chunks").dropDuplicates(["chunk_key"])
    last = c.groupBy("pdf_doc_id").agg(F.max("chunk_index").alias("last"))
    return c.join(last, "pdf_doc_id").select("chunk_key", F.greatest(F.lit(0), F.col("chunk_index") - 1).alias("prev_index"), F.least("last", F.col("chunk_index") + 1).alias("next_index"))


@R.add("""SELECT pdf_doc_id, lower(trim(ref)) AS item, min(node_key) AS first_node FROM (SELECT pdf_doc_id, node_key, unnest(internal_refs) AS ref FROM (SELECT DISTINCT ON (node_key) * FROM legal_nodes)) WHERE trim(ref) <> '' GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY pdf_doc_id ORDER BY first_node, item) <= 20""")
def agg_merge_lists(spark, sf):
    """Lists of a document's parts merged: first seen counts, case does not matter, up to twenty."""
    each = _nodes(spark, sf).select("pdf_doc_id", "node_key", F.explode("internal_refs").alias("ref")).filter("trim(ref) <> ''")
    firsts = each.groupBy("pdf_doc_id", F.lower(F.trim("ref")).alias("item")).agg(F.min("node_key").alias("first_node"))
    w = Window.partitionBy("pdf_doc_id").orderBy("first_node", "item")
    return firsts.withColumn("r", F.row_number().over(w)).filter("r <= 20").drop("r")


@R.add("SELECT DISTINCT collection, regexp_full_match(trim(collection), '[A-Za-z0-9_\\-]{1,64}') AS valid FROM documents WHERE collection IS NOT NULL")
def ops_collection_names(spark, sf):
    return table(spark, sf, "documents").filter("collection is not null").select("collection", F.trim("collection").rlike(r"^[A-Za-z0-9_\-]{1,64}$").alias("valid")).distinct()


@R.add("SELECT DISTINCT node_key, concat_ws(' ', label, CASE WHEN n > 0 THEN n::VARCHAR END) AS expanded FROM (SELECT node_key, label, CASE upper(numeral) " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate("I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split(), 1)) + " ELSE 0 END AS n FROM legal_nodes WHERE label IS NOT NULL)")
def txt_expand_numerals(spark, sf):
    """Labels with the Arabic form of their Roman numeral (up to XX) behind, for search."""
    n = N.roman_to_int(F.coalesce("numeral", F.lit("")))
    extra = F.when((n > 0) & (n <= 20), n.cast("string"))
    return table(spark, sf, "legal_nodes").filter("label is not null").select("node_key", F.concat_ws(" ", "label", extra).alias("expanded")).distinct()


@R.add("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


@R.add("SELECT DISTINCT pdf_doc_id FROM pipeline_results EXCEPT SELECT pdf_doc_id FROM legal_nodes")
def set_except(spark, sf):
    return table(spark, sf, "pipeline_results").select("pdf_doc_id").subtract(table(spark, sf, "legal_nodes").select("pdf_doc_id"))
