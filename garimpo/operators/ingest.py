"""From scanned blocks to chunks ready for search: the parsing chain, structures and articles, chunk texts.

Blocks are rows as ``blocks.rows_of`` gives them (doc, page, seq, block_key, text, kind). A document may hold a
third of all blocks: what reaches back or ahead in a document is carried over stretches of it (``blocks.carried``),
and texts are gathered by article, page or paragraph only.

Defined cases: null and blank texts hold nothing; documents without headers have no structures; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.operators import blocks as B
from garimpo.session import settle

LEVELS = {"titulo": 1, "capitulo": 2, "secao": 3}
ARTICLE = r"(?i)\bart\.?\s*(\d{1,4})"
PAGE_BREAK = "<!-- PAGE_BREAK -->"


# ---------------------------------------------------------------- texts of rows and chunks


def row_text(names: Column, cells: Column) -> Column:
    """'name: value; ...' of the filled cells."""
    pairs = F.filter(F.arrays_zip(names.alias("n"), cells.alias("c")), lambda x: F.coalesce(F.trim(x["c"]), F.lit("")) != "")
    return F.array_join(F.transform(pairs, lambda x: F.concat_ws(": ", x["n"], F.trim(x["c"]))), "; ")


def raw_row(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")


def flat_fields(fields: Column, key_size: int = 40, value_size: int = 500) -> Column:
    """Fields as metadata f_<name>, with bounded names and values; of names that become equal the first counts."""
    named = F.transform(F.map_entries(fields), lambda e: F.struct(F.left(X.slug_of(e["key"]), F.lit(key_size)).alias("k"), F.left(F.coalesce(e["value"], F.lit("")), F.lit(value_size)).alias("v")))
    named = F.filter(named, lambda e: e["k"] != "")
    keys = F.array_distinct(F.transform(named, lambda e: e["k"]))
    return F.map_from_arrays(F.transform(keys, lambda k: F.concat(F.lit("f_"), k)), F.transform(keys, lambda k: F.get(F.filter(named, lambda e: e["k"] == k), F.lit(0))["v"]))


def with_breadcrumb(path: Column, text: Column) -> Column:
    """[a > b] before a text, for an array of headings."""
    filled = F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(filled) > 0, F.concat(F.lit("["), F.array_join(filled, " > "), F.lit("]\n"), text)).otherwise(text)


def contextual(doc: Column, path: Column, item: Column, text: Column) -> Column:
    """The text of a chunk for an encoder: with its document, path and item."""
    tag = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{name}: "), c, F.lit("]")))
    return F.concat_ws("\n", tag("Documento", doc), tag("Caminho", path), tag("Inciso", item), text)


def document_type(forced: Column, suffix: Column, found: Column) -> Column:
    """A forced profile, else the type that the file's suffix tells, else what the classifier found."""
    f = F.lower(F.trim(F.coalesce(forced, F.lit(""))))
    return F.when(f.isin("legal", "tabular", "mixed", "narrative"), f).when(F.lower(suffix).isin(".csv", ".xlsx", ".xls"), "tabular").otherwise(found)


def upload_mode(name: Column) -> Column:
    """The mode that a file's name suggests."""
    n = F.lower(name)
    return F.when(n.rlike(r"\.(csv|xlsx?|ods)$"), "tabular").when(X.norm_match(name).rlike("lei|estatuto|regimento|regulamento|norma|contrato"), "legal").otherwise("geral")


def macro_chunks(nodes: DataFrame, embed: int = 2000, store: int = 4000, articles: int = 30) -> DataFrame:
    """node_key, chunk_index, embed_text, text, articles of titles, chapters and sections. The sizes are the index's."""
    w = Window.partitionBy("pdf_doc_id").orderBy("page_start", "node_key")
    macro = nodes.filter(F.col("node_type").isin("titulo", "capitulo", "secao"))
    head = F.concat(F.lit("["), F.upper("node_type"), F.lit(": "), F.coalesce("label", F.lit("")), F.lit("]\n"))
    body = F.coalesce("text", F.lit(""))
    return macro.select(
        "node_key", "pdf_doc_id", (F.row_number().over(w) - 1).alias("chunk_index"), F.concat(head, F.left(body, F.lit(embed))).alias("embed_text"),
        F.concat(F.lit("["), F.coalesce("label", F.lit("")), F.lit("]\n"), F.left(body, F.lit(store))).alias("text"), F.array_join(F.slice(F.coalesce("articles", F.array().cast("array<string>")), 1, articles), ", ").alias("articles"), F.length(body).alias("text_length"),
    )


def mixed(rows: DataFrame, prose: DataFrame, key: str) -> DataFrame:
    """Chunks of table rows and of prose of the same texts, numbered through: key, chunk_index, chunk_type, text.

    rows and prose: key, nth, text. Pieces of one text follow each other, rows first.
    """
    both = rows.select(key, F.lit(0).alias("o"), "nth", "text", F.lit("mixed_tabular").alias("chunk_type")).unionByName(prose.select(key, F.lit(1).alias("o"), "nth", "text", F.lit("mixed_narrative").alias("chunk_type")))
    return both.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("o", "nth")) - 1).alias("chunk_index"), "chunk_type", "text")


def without_tables(text: Column) -> Column:
    """The lines of a text that are no table rows."""
    return F.trim(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.contains(x, F.lit("|"))), "\n"), F.lit("\n"))


# ---------------------------------------------------------------- structures and articles out of blocks


def header(text: Column) -> Column:
    """level, kind, numeral of a block that names a title, chapter or section; null for others."""
    n = X.norm_match(text)
    out = F.lit(None)
    for kind, level in reversed(LEVELS.items()):
        number = F.regexp_extract(n, rf"\b{kind}\s+([ivxlcdm]+|\d{{1,4}})\b", 1)
        out = F.when(number != "", F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.upper(number).alias("numeral"))).otherwise(out)
    return out


def numeral_of(label: Column) -> Column:
    """The numeral of a heading."""
    n = F.upper(F.regexp_extract(X.norm_match(label), r"\b(?:titulo|capitulo|secao|subsecao|anexo|parte)\s+([ivxlcdm]+|\d{1,4})\b", 1))
    return F.nullif(n, F.lit(""))


def _marked(rows: DataFrame) -> DataFrame:
    first = F.trim(F.substring_index(F.trim("text"), "\n", 1))
    return rows.withColumn("h", header(F.col("text"))).withColumn("first_line", first).withColumn("art", F.regexp_extract("text", ARTICLE, 1))


def articles(rows: DataFrame) -> DataFrame:
    """doc, start, end, article, label, page_start, page_end, titulo, capitulo, secao, text, blocks of each article.

    An article goes from its block to the next block that names an article or a heading.
    """
    m = _marked(rows.filter(F.trim("text") != ""))
    order = ["seq", "block_key"]
    begins = F.when(F.col("art") != "", F.struct(F.col("seq").alias("start"), F.col("block_key").alias("key"), F.col("art").alias("article"))).when(F.col("h").isNotNull(), F.struct(F.col("seq").alias("start"), F.col("block_key").alias("key"), F.lit(None).cast("string").alias("article")))
    line = F.col("first_line")
    marks = {"a": begins, "titulo": F.when(F.col("h.kind") == "titulo", line), "capitulo": F.when(F.col("h.kind") == "capitulo", line), "secao": F.when(F.col("h.kind") == "secao", line).when(F.col("h").isNotNull(), F.lit(""))}
    m = B.carried(m, "doc", "seq", order, marks)
    inside = m.filter("a.article is not null")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "block_key", F.trim("text").alias("t"), "page", "titulo", "capitulo", "secao")))
    made = inside.groupBy("doc", F.col("a.start").alias("start"), F.col("a.key").alias("key"), F.col("a.article").alias("article")).agg(ordered.alias("x"))
    head, last = F.get("x", F.lit(0)), F.element_at("x", -1)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return made.select("doc", "start", (last["seq"] + 1).alias("end"), "article", F.concat(F.lit("Art. "), "article").alias("label"), head["page"].alias("page_start"), last["page"].alias("page_end"), blank(head["titulo"]).alias("titulo"), blank(head["capitulo"]).alias("capitulo"), blank(head["secao"]).alias("secao"), F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("text"), F.size("x").alias("blocks"))


def structures(rows: DataFrame) -> DataFrame:
    """doc, start, end, kind, numeral, label, page_start, articles of each heading; end is the place of the next one of its level or above (null at the end)."""
    m = _marked(rows)
    here = lambda k: F.when(F.col("h.level") <= k, F.struct(F.col("h.level").alias("l"), F.col("seq").alias("s"), F.col("block_key").alias("b")))
    m = B.carried(m, "doc", "seq", ["seq", "block_key"], {f"in{k}": here(k) for k in (1, 2, 3)})
    heads = _marked(rows).filter("h is not null")
    heads = B.carried(heads, "doc", -F.col("seq"), [-F.col("seq"), -F.col("block_key")], {f"next{k}": F.when(F.col("h.level") <= k, F.col("seq")) for k in (1, 2, 3)}, strict=True)
    end = F.coalesce(*[F.when(F.col("h.level") == k, F.col(f"next{k}")) for k in (1, 2, 3)])
    heads = heads.select("doc", F.col("seq").alias("start"), "block_key", end.alias("end"), "h.kind", "h.numeral", F.col("first_line").alias("label"), F.col("page").alias("page_start"))
    each = m.select("doc", "seq", F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)Art\.?\s*(\d+)"), F.lit(1))).alias("ns"), F.array(*[F.when(F.col(f"in{k}.l") == k, F.col(f"in{k}.b")) for k in (1, 2, 3)]).alias("i"))
    each = each.select("doc", "seq", F.explode("ns").alias("n"), "i").select("doc", "seq", "n", F.explode(F.filter("i", lambda x: x.isNotNull())).alias("block_key"))
    # Distinct articles first: a structure then gathers its article numbers, not its blocks.
    arts = each.groupBy("doc", "block_key", "n").agg(F.min("seq").alias("seq")).groupBy("doc", "block_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("n").cast("int").alias("v"), "n"))), lambda x: F.concat(F.lit("Art. "), x["n"])).alias("articles"))
    return heads.join(arts, ["doc", "block_key"], "left").withColumn("articles", F.coalesce("articles", F.array().cast("array<string>")))


def structure_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc", "kind").agg(F.count("*").alias("n"))


def structure_list(found: DataFrame, kind: str) -> DataFrame:
    """doc, labels of a kind in order."""
    return found.filter(F.col("kind") == kind).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "label"))), lambda x: x["label"]).alias("labels"))


def located(found: DataFrame, kind: str, last: bool = False) -> DataFrame:
    """The first or last of a kind in each document, with its page."""
    pick = F.max_by if last else F.min_by
    return found.filter(F.col("kind") == kind).groupBy("doc").agg(pick(F.struct("label", "numeral", "page_start"), "start").alias("x")).select("doc", "x.*")


def containing(found: DataFrame, kind: str, numeral: str, article: str) -> DataFrame:
    """doc, holds: whether the unit of each document holds the article."""
    from garimpo.operators.scope import same_numeral

    own = found.filter((F.col("kind") == kind) & same_numeral(F.col("numeral"), F.lit(numeral)))
    return own.groupBy("doc").agg(F.max(F.array_contains("articles", f"Art. {article}")).alias("holds"))


def exact_article(found: DataFrame, article: str) -> DataFrame:
    """The first text of an article in each document."""
    return found.filter(F.col("article") == article).groupBy("doc").agg(F.min_by(F.struct("label", "page_start", "capitulo", "secao", "text"), "start").alias("x")).select("doc", "x.*")


# ---------------------------------------------------------------- the chain


def page_texts(rows: DataFrame) -> DataFrame:
    """doc, page, text of the content blocks; a page's text ends with a page break unless it is the last."""
    kept = rows.filter(F.col("kind").isin(*B.CONTENT))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_key", "text"))), lambda x: F.trim(x["text"]))
    pages = kept.groupBy("doc", "page").agg(F.array_join(ordered, "\n\n").alias("text"))
    last = pages.groupBy("doc").agg(F.max("page").alias("last"))
    return pages.join(last, "doc").select("doc", "page", F.when(F.col("page") < F.col("last"), F.concat("text", F.lit(f"\n\n{PAGE_BREAK}"))).otherwise(F.col("text")).alias("text"))


def markdown(rows: DataFrame) -> DataFrame:
    """doc, page, markdown: titles and section headers as headings, tables as they are."""
    line = F.when(F.col("kind") == "title", F.concat(F.lit("# "), F.trim("text"))).when(F.col("kind").isin("section_header", "annex"), F.concat(F.lit("## "), F.trim("text"))).otherwise(F.trim("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_key", line.alias("t")))), lambda x: x["t"])
    return rows.filter(F.col("kind").isin(*B.CONTENT)).groupBy("doc", "page").agg(F.array_join(ordered, "\n\n").alias("markdown"))


def block_json(rows: DataFrame) -> DataFrame:
    """doc, page, json of each page's blocks in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "block_key", F.struct("kind", "text", "hint").alias("b"))))
    return rows.groupBy("doc", "page").agg(F.to_json(F.transform(ordered, lambda x: x["b"])).alias("json"))


def block_id(page: Column, text: Column) -> Column:
    """The hash of a block's page and text."""
    return F.left(F.sha2(F.concat_ws("::", page.cast("string"), text), 256), F.lit(16))


def process(blocks: DataFrame, least: float = 0.4) -> dict[str, DataFrame]:
    """The whole chain of scanned blocks: classified and relabelled blocks with hints, quality with its gate, texts, structures and articles of documents that passed."""
    rows = B.rows_of(blocks)
    rows = settle(B.with_hints(B.relabelled(rows.withColumn("kind", B.kind(F.col("text"), F.col("y"))))))
    quality = settle(B.quality(rows).withColumn("gate", B.gate(F.col("score"), F.col("flags"), least)))
    passed = rows.join(quality.filter("gate <> 'failed_parse'").select("doc"), "doc", "left_semi")
    return {"blocks": rows, "quality": quality, "texts": page_texts(passed), "markdown": markdown(passed), "json": block_json(passed), "paragraphs": B.paragraphs(passed), "structures": structures(passed), "articles": articles(passed)}
