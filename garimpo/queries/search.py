"""Vectors, retrieval and ranking measures. Queries are the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from garimpo.functions import numbers as N
from garimpo.functions import text as X
from garimpo.operators import evaluation as E
from garimpo.operators import retrieval as V
from garimpo.operators import routing as Q
from garimpo.operators import scope as S
from garimpo.queries import values as W
from garimpo.queries.registry import Registry, sql_match, sql_norm
from garimpo.session import table

R = Registry()
_STOP = "['" + "','".join(W.STOP_WORDS) + "']"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _hits(spark, sf, k=15):
    vs = _vectors(spark, sf)
    qs = vs.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return V.vector_topk(qs, vs, k, 64)


_ALL = "SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, q.label AS q_label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id"


def _top(k):
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_ALL}) QUALIFY rank <= {k}"


@R.add(f"SELECT query_id, id, round(score, 6) AS score, rank FROM ({_top(10)})")
def vec_topk(spark, sf):
    return _hits(spark, sf, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@R.add(f"SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_ALL}) WHERE label = 1) WHERE rank <= 5")
def vec_topk_filtered(spark, sf):
    vs = _vectors(spark, sf)
    qs = vs.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return V.vector_topk(qs, vs.filter("label = 1"), 5, 64).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@R.add(f"WITH h AS ({_top(45)}), b AS (SELECT *, score + CASE WHEN label = q_label THEN 0.1 ELSE 0.0 END AS boosted FROM h) SELECT query_id, id, round(boosted, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id) <= 15")
def vec_overfetch(spark, sf):
    """Three times the wanted hits are fetched, rescored and cut."""
    vs = _vectors(spark, sf)
    labels = vs.select("id", "label")
    h = _hits(spark, sf, 45).join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    boosted = h.withColumn("score", F.col("score") + F.when(F.col("label") == F.col("q_label"), 0.1).otherwise(0.0))
    return V.top(boosted.select("query_id", "id", "score"), 15).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@R.add("SELECT vec_id, document FROM (SELECT DISTINCT vec_id, document, metadata['doc_id'] AS d, metadata['chunk_type'] AS c FROM vector_items) WHERE d = 'pdf-0000000' AND c = 'general'")
def flt_metadata_where(spark, sf):
    v = table(spark, sf, "vector_items")
    return v.filter(V.where(F.col("metadata"), {"$and": [{"doc_id": "pdf-0000000"}, {"chunk_type": {"$eq": "general"}}]})).select("vec_id", "document").distinct()


@R.add(f"SELECT query_id, id, round(score, 6) AS score FROM ({_top(15)}) WHERE score >= 0.6 OR rank = 1")
def flt_threshold_keep1(spark, sf):
    return V.over_threshold(_hits(spark, sf).select("query_id", "id", "score"), 0.6).select("query_id", "id", F.round("score", 6).alias("score"))


@R.add("WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS l FROM embeddings), x AS (SELECT vec_id, label, unnest(list_transform(e, lambda x: x / l)) AS x, generate_subscripts(e, 1) AS i FROM n WHERE l > 0), c AS (SELECT label AS c, i, avg(x) AS m FROM x GROUP BY 1, 2), d AS (SELECT vec_id, c, sum(x * m) AS s FROM x JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, c AS intent FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, c) = 1")
def vec_intent_centroid(spark, sf):
    """The class whose examples have the highest average cosine."""
    e = table(spark, sf, "embeddings")
    found = Q.intent_by_examples(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), e.select(F.col("label").alias("intent"), F.col("embedding").alias("v")))
    return found.select(F.col("query_id").alias("vec_id"), "intent")


@R.add("SELECT vec_id, collection FROM (SELECT DISTINCT vec_id, collection, added_at FROM vector_items) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY added_at DESC, collection) = 1")
def vec_upsert(spark, sf):
    """Last write of each id."""
    return table(spark, sf, "vector_items").groupBy("vec_id").agg(F.max_by("collection", F.struct("added_at")).alias("collection"))


@R.add("SELECT DISTINCT vec_id FROM vector_items WHERE coalesce(metadata['doc_id'], '') NOT IN (SELECT pdf_doc_id FROM pipeline_results WHERE status = 'failed_parse')")
def vec_delete(spark, sf):
    """Vectors that stay when the documents that failed to parse are deleted."""
    v = table(spark, sf, "vector_items").select("vec_id", F.coalesce(F.try_element_at("metadata", F.lit("doc_id")), F.lit("")).alias("pdf_doc_id"))
    gone = table(spark, sf, "pipeline_results").filter("status = 'failed_parse'").select("pdf_doc_id").distinct()
    return v.join(gone, "pdf_doc_id", "left_anti").select("vec_id").distinct()


@R.add(f"WITH a AS ({_top(10)}), b AS (SELECT query_id, id, greatest(0.5, 1 - 0.03 * (row_number() OVER (PARTITION BY query_id ORDER BY id) - 1)) AS score FROM (SELECT DISTINCT query_id, id FROM ({_ALL}) WHERE label = q_label)) SELECT * FROM (SELECT query_id, id, round(max(score), 6) AS score FROM (SELECT query_id, id, score FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 15")
def set_merge_sources(spark, sf):
    """Structured rows (rank decay) and vector hits in one list, the higher score counts."""
    vs = _vectors(spark, sf)
    q = vs.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "label")
    # Places over the fifteenth can no longer be among the best: the sixteen lowest ids of a label are enough.
    first = vs.select("id", "label").withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("id"))).filter("nth <= 16").drop("nth")
    rows = q.join(first, "label").filter("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id")) - 1
    structured = rows.select("query_id", "id", V.rank_decay(place).alias("score"))
    both = V.best_of(_hits(spark, sf, 10).select("query_id", "id", "score").unionByName(structured)).withColumn("score", F.round("score", 6))
    return V.top(both, 15).select("query_id", "id", "score")


@R.add("SELECT DISTINCT split_part(collection, '__', 1) AS workspace, split_part(collection, '__', 2) AS name, split_part(collection, '__', 3) AS model FROM vector_items WHERE collection IS NOT NULL")
def set_distinct_pairs(spark, sf):
    parts = F.split("collection", "__")
    return table(spark, sf, "vector_items").filter("collection is not null").select(F.get(parts, F.lit(0)).alias("workspace"), F.get(parts, F.lit(1)).alias("name"), F.get(parts, F.lit(2)).alias("model")).distinct()


# ---------------------------------------------------------------- chunks of legal texts as hits
# The queries are the vectors whose id is divisible by 100; each asks for the chapter and article of its own chunk.


def _chunks(spark, sf):
    columns = ["chunk_type", "parent_key", *S.PLACE, "page_number"]
    return table(spark, sf, "legal_chunks").select(F.col("chunk_key").alias("id"), F.col("pdf_doc_id").alias("doc"), F.col("chunk_index").alias("place"), *columns, F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id"])


def _items(spark, sf):
    return table(spark, sf, "vector_items").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("chunk_key").alias("chunk"))


def _questions(spark, sf):
    own = _items(spark, sf).filter("id % 100 = 0 and chunk is not null").join(_chunks(spark, sf).select(F.col("id").alias("chunk"), "capitulo", "artigo"), "chunk")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return own.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.concat(F.lit("Resuma o "), blank("capitulo"), F.lit(" e o "), blank("artigo")).alias("question")).dropDuplicates(["query_id"])


def _chunk_hits(spark, sf):
    """chunks, questions and the hits: the 45 best of all vectors, by chunk."""
    c, q, v = _chunks(spark, sf), _questions(spark, sf), _items(spark, sf)
    near = V.vector_topk(q.select("query_id", "q"), v, 45, 64).join(v.select("id", "chunk").distinct(), "id")
    hits = V.best_of(near.select("query_id", F.col("chunk").alias("id"), "score")).join(c, "id")
    return c, q, hits


_VALUE = "CASE WHEN regexp_full_match({0}, '\\d+') THEN {0}::INT ELSE list_reduce(list_prepend({{'t': 0, 'p': 0}}, list_transform(list_reverse(string_split({0}, '')), lambda c: {{'t': 0, 'p': map {{'i': 1, 'v': 5, 'x': 10, 'l': 50, 'c': 100, 'd': 500, 'm': 1000}}[c]}})), lambda a, x: {{'t': CASE WHEN x.p < a.p THEN a.t - x.p ELSE a.t + x.p END, 'p': x.p}}).t END"


def _values(text, pattern, group=1):
    return f"list_distinct(list_transform(regexp_extract_all({sql_match(f'coalesce({text}, {chr(39) * 2})')}, '{pattern}', {group}), lambda z: {_VALUE.format('z')}))"


def _unit(text, unit):
    return _values(text, f"\\b{unit}\\s+([ivxlcdm]+|\\d{{1,4}})\\b")


_NUMERALS = "\\b(?:[ivxlcdm]+|\\d{1,4})\\b"
_STRUCT = "array_to_string(list_filter([" + ", ".join(f"trim(coalesce({c}, ''))" for c in ("titulo", "capitulo", "secao", "artigo", "paragrafo", "inciso", "caminho_hierarquico")) + "], lambda x: x <> ''), ' | ')"
_HINT = "array_to_string(list_filter([" + ", ".join(f"trim(coalesce({c}, ''))" for c in ("titulo", "capitulo", "secao", "caminho_hierarquico", "artigo")) + "], lambda x: x <> ''), ' | ')"
_WORDS = "list_distinct(list_filter(string_split(" + sql_norm("question") + ", ' '), lambda w: w <> '' AND NOT list_contains(string_split('dos das para com sem que uma por art artigo secao capitulo titulo sobre quais qual sao sua', ' '), w) AND (regexp_full_match(w, '\\d+|[ivxlcdm]{1,8}') OR length(w) >= 3)))"


def _overlap(text):
    n = sql_match(text)
    return f"len(list_filter(words, lambda w: CASE WHEN regexp_full_match(w, '\\d+|[ivxlcdm]{{1,8}}') THEN contains(' ' || regexp_replace({n}, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || w || ' ') ELSE contains({n}, w) END))"


_H = f"""WITH ch AS (SELECT DISTINCT ON (chunk_key) chunk_key AS id, pdf_doc_id AS doc, chunk_index AS place, chunk_type, parent_key, titulo, capitulo, secao, artigo, paragrafo, inciso, caminho_hierarquico, page_number, coalesce(text, '') AS text FROM legal_chunks),
v AS (SELECT DISTINCT ON (vec_id) vec_id, chunk_key AS chunk, embedding::DOUBLE[] AS e FROM vector_items WHERE len(embedding) = 64 AND isfinite(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
q0 AS (SELECT vec_id AS query_id, e AS qe, 'Resuma o ' || coalesce(capitulo, '') || ' e o ' || coalesce(artigo, '') AS question FROM v JOIN ch ON ch.id = v.chunk WHERE vec_id % 100 = 0),
q AS (SELECT query_id, qe, question, {_WORDS} AS words, {_unit('question', 'capitulo')} AS t_cap, {_values('question', '\\bart(?:igo)?\\.?\\s*([0-9]{1,4})')} AS t_art FROM q0),
near AS (SELECT query_id, vec_id, chunk, round(list_cosine_similarity(qe, e), 9) AS score FROM q JOIN v ON vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 45),
best AS (SELECT query_id, chunk AS id, max(score) AS score FROM near WHERE chunk IS NOT NULL GROUP BY 1, 2),
chm AS (SELECT *, {_STRUCT} AS struct, {_unit(_STRUCT, 'capitulo')} AS any_cap FROM ch),
h AS (SELECT best.query_id, best.score, chm.* FROM best JOIN chm USING (id))"""
_IN_CHAPTER = "list_has_any(any_cap, t_cap)"
_IN_TARGET = f"(list_has_any(any_cap, t_cap) OR list_has_any(any_cap, t_art) OR list_has_any(list_concat({_unit('capitulo', 'capitulo')}, {_values('capitulo', _NUMERALS, 0)}), t_cap) OR list_has_any({_values('artigo', '\\d{1,4}', 0)}, t_art))"
_DOCS = "docs AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY first) AS nth, doc_score FROM (SELECT query_id, doc, min(r) AS first, max(score) AS doc_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM {0} WHERE coalesce(doc, '') <> '') GROUP BY 1, 2) QUALIFY nth <= 3)"


@R.add(_H + " SELECT query_id, id, round(score, 6) AS score FROM h")
def ret_hits(spark, sf):
    """Hits of chunks through their vectors."""
    return _chunk_hits(spark, sf)[2].select("query_id", "id", F.round("score", 6).alias("score"))


@R.add(_H + ", b AS (SELECT query_id, parent_key, max(score) AS score FROM h WHERE chunk_type = 'child' AND parent_key IS NOT NULL GROUP BY 1, 2) SELECT query_id, id, round(score, 6) AS score FROM (SELECT b.query_id, ch.id, b.score FROM b JOIN ch ON ch.parent_key = b.parent_key AND ch.chunk_type = 'parent' WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = b.query_id AND h.id = ch.id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5")
def join_parent_expand(spark, sf):
    c, _, h = _chunk_hits(spark, sf)
    return V.expand_parents(h, c).select("query_id", "id", F.round("score", 6).alias("score"))


@R.add(_H + " SELECT query_id, id, round(max(s), 6) AS score FROM (SELECT h.query_id, ch.id, h.score * 0.92 AS s FROM h JOIN ch ON h.doc = ch.doc AND ch.place BETWEEN h.place - 1 AND h.place + 1) x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = x.query_id AND h.id = x.id) GROUP BY 1, 2")
def join_adjacent_range(spark, sf):
    c, _, h = _chunk_hits(spark, sf)
    return V.expand_neighbours(h, c).select("query_id", "id", F.round("score", 6).alias("score"))


@R.add(_H + f", s AS (SELECT h.*, {_overlap('struct')} AS strength, count(*) OVER (PARTITION BY query_id, parent_key) AS shared FROM h JOIN q USING (query_id)) SELECT query_id, id, strength, round(score + least(strength, 3) * 0.12 + CASE WHEN coalesce(parent_key, '') <> '' AND shared > 1 THEN 0.072 ELSE 0 END + CASE WHEN chunk_type = 'parent' THEN 0.042 ELSE 0 END, 6) AS score FROM s")
def ret_continuity(spark, sf):
    """Bonus for words of the question in a hit's headings, for siblings and for parents."""
    _, q, h = _chunk_hits(spark, sf)
    return V.continuity(S.strength(h, q), 0.12).select("query_id", "id", F.col("strength").cast("long").alias("strength"), F.round("score", 6).alias("score"))


@R.add(_H + ", r AS (SELECT query_id, id, score, floor(length(text) / 3.5)::BIGINT AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h), g AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id) AS total, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY (rank = 1)::INT, score, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM r) SELECT query_id, id, tokens FROM g WHERE rank = 1 OR total - gone <= 600")
def ret_trim_budget(spark, sf):
    _, _, h = _chunk_hits(spark, sf)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = h.select("query_id", "id", "score", X.token_estimate(F.col("text")).cast("long").alias("tokens")).withColumn("rank", F.row_number().over(w))
    return V.trim_to_budget(ranked, 600).select("query_id", "id", "tokens")


@R.add(_H + ", w AS (SELECT query_id, id, score, list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]{3,}')) AS a, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{3,}') AS b FROM h JOIN q USING (query_id)) SELECT query_id, id, round(0.65 * score + 0.35 / (1 + exp(-(CASE WHEN len(a) > 0 THEN 8.0 * len(list_filter(a, lambda x: list_contains(b, x))) / len(a) - 4.0 ELSE -4.0 END))), 6) AS score FROM w")
def ret_blend(spark, sf):
    """Base score and a pair scorer's through a sigmoid."""
    _, q, h = _chunk_hits(spark, sf)
    return V.rerank(h.join(q.select("query_id", "question"), "query_id"), V.overlap_logit).select("query_id", "id", F.round("score", 6).alias("score"))


@R.add(_H + f", m AS (SELECT h.query_id, id, {_IN_CHAPTER} AS hit, score + CASE WHEN {_IN_CHAPTER} THEN 0.32 + CASE WHEN chunk_type = 'parent' THEN 0.08 ELSE 0 END ELSE 0 END AS score FROM h JOIN q USING (query_id)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, round(score, 9) DESC, id) AS rank FROM m")
def ret_prioritize(spark, sf):
    """The chapter asked for first."""
    _, q, h = _chunk_hits(spark, sf)
    return S.prioritise(h, q).select("query_id", "id", "rank")


@R.add(_H + f" SELECT query_id, id, round(score + CASE WHEN {_IN_CHAPTER} THEN 0.28 ELSE 0 END + least(CASE WHEN {_HINT} <> '' THEN {_overlap(_HINT)} ELSE 0 END, 3) * 0.063, 6) AS score FROM h JOIN q USING (query_id)")
def ret_hint_boost(spark, sf):
    """Headings that match the question."""
    _, q, h = _chunk_hits(spark, sf)
    return S.boost_hints(h, q).select("query_id", "id", F.round("score", 6).alias("score"))


@R.add(_H + f", m AS (SELECT h.query_id, id, {_IN_TARGET} AS hit FROM h JOIN q USING (query_id)) SELECT query_id, id FROM m QUALIFY hit OR sum(hit::INT) OVER (PARTITION BY query_id) < 1")
def ret_scope_filter(spark, sf):
    """Only hits in the units asked for, where there are any."""
    _, q, h = _chunk_hits(spark, sf)
    return S.in_scope(h, q).select("query_id", "id")


@R.add(_H + ", " + _DOCS.format("h") + f", c AS (SELECT d.query_id, d.nth, chm.* FROM docs d JOIN q USING (query_id) JOIN chm USING (doc) WHERE {_IN_CHAPTER} AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = d.query_id AND h.id = chm.id)) SELECT query_id, id, round((SELECT max(score) FROM h WHERE h.query_id = c.query_id) + 0.08, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY nth, place, id) <= 8")
def join_supplement(spark, sf):
    """Further chunks of the chapter from the first documents."""
    c, q, h = _chunk_hits(spark, sf)
    return S.supplement(h, q, c).select("query_id", "id", F.round("score", 6).alias("score"))


@R.add(_H + f", an AS (SELECT h.* FROM h JOIN q USING (query_id) WHERE {_IN_CHAPTER}), " + _DOCS.format("an") + f", c AS (SELECT d.query_id, d.nth, chm.* FROM docs d JOIN q USING (query_id) JOIN chm USING (doc) WHERE {_IN_CHAPTER} AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = d.query_id AND h.id = chm.id)) SELECT query_id, id, round((SELECT max(score) FROM an WHERE an.query_id = c.query_id) * 0.97, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY nth, place, id) <= 24")
def join_expand_chapter(spark, sf):
    """The rest of the chapter in the documents of hits that lie in it."""
    c, q, h = _chunk_hits(spark, sf)
    return S.expand_chapter(h, q, c).select("query_id", "id", F.round("score", 6).alias("score"))


@R.add(_H + ", " + _DOCS.format("h") + f", c AS (SELECT d.query_id, d.nth, d.doc_score, chm.* FROM docs d JOIN q USING (query_id) JOIN chm USING (doc) WHERE {_IN_TARGET} QUALIFY row_number() OVER (PARTITION BY d.query_id ORDER BY nth, place, id) <= 80) SELECT query_id, id, round(doc_score + 0.4, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(page_number, 1000000000), coalesce(place, 1000000000), id) AS place_no FROM c")
def join_scope(spark, sf):
    """All chunks of the units asked for in the seeds' documents, in reading order."""
    c, q, h = _chunk_hits(spark, sf)
    return S.scope_of_seeds(h, q, c).select("query_id", "id", F.round("score", 6).alias("score"), F.col("place_no").cast("long").alias("place_no"))


@R.add()
def ret_pipeline(spark, sf):
    """Search, union, rerank, scope, expansion and trimming of all questions in one plan."""
    return V.retrieve(_questions(spark, sf), _items(spark, sf), _chunks(spark, sf), score=V.overlap_logit).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "tokens")


@R.add()
def ret_context(spark, sf):
    """The context text of each question."""
    return V.context(V.retrieve(_questions(spark, sf), _items(spark, sf), _chunks(spark, sf)))


_TOK = f"list_filter(string_split({sql_norm('@')}, ' '), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"


@R.add(f"""WITH q AS (SELECT example_id AS query_id, list_distinct({_TOK.replace('@', 'text')}) AS t FROM subject_examples), qt AS (SELECT query_id, unnest(t) AS token FROM q),
ct AS (SELECT DISTINCT node_key AS id, len(t) AS n, unnest(t) AS token FROM (SELECT node_key, list_distinct({_TOK.replace('@', 'text')}) AS t FROM legal_nodes WHERE text IS NOT NULL))
SELECT query_id, id, round(score, 6) AS score FROM (SELECT query_id, id, count(*) / first(n) AS score FROM qt JOIN ct USING (token) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def ret_token_overlap(spark, sf):
    q = table(spark, sf, "subject_examples").select(F.col("example_id").alias("query_id"), X.tokens(F.col("text")).alias("tokens"))
    c = table(spark, sf, "legal_nodes").filter("text is not null").select(F.col("node_key").alias("id"), X.tokens(F.col("text")).alias("tokens")).dropDuplicates(["id"])
    return V.token_overlap(q, c).select("query_id", "id", F.round("score", 6).alias("score"))


@R.add()
def ret_compress(spark, sf):
    """Of each legal chunk the three sentences that share most words with the question, in their order; parents stay whole."""
    question = X.tokens(F.lit("Qual a vigencia e a cobertura do contrato da unidade solicitante?"))
    c = _chunks(spark, sf).withColumn("s", X.sentences(F.col("text")))
    scored = F.transform("s", lambda x, i: F.struct((-F.size(F.array_intersect(X.tokens(x), question))).alias("far"), i.alias("i"), x.alias("x")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, 3), lambda x: F.struct(x["i"], x["x"])))
    return c.select("id", F.when((F.col("chunk_type") == "parent") | (F.size("s") <= 3), F.col("text")).otherwise(F.array_join(F.transform(best, lambda x: x["x"]), " ")).alias("text"))


def _graded(spark, sf, hits):
    """Measures of hits by labels: the same label is grade 2, the next one 1. Only hits are paired; totals come from counts."""
    vs = _vectors(spark, sf).select("id", "label")
    q = vs.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("label").alias("q_label"))
    n = vs.groupBy("label").agg(F.count("*").alias("n"))
    same = q.join(n.withColumnRenamed("label", "q_label"), "q_label").select("query_id", F.lit(2).alias("grade"), (F.col("n") - 1).alias("n"))
    near = q.join(n.select((F.col("label") - 1).alias("q_label"), "n"), "q_label").select("query_id", F.lit(1).alias("grade"), "n")
    counts = same.unionByName(near)
    grade = F.when(F.col("label") == F.col("q_label"), 2).when(F.col("label") == F.col("q_label") + 1, 1).otherwise(0)
    told = hits.filter("rank <= 10").join(vs, "id").join(q, "query_id").select("query_id", "id", "rank", grade.alias("grade"))
    judged = counts.filter("n > 0").select("query_id").distinct()
    return E.scored(told, E.totals_by_grade(counts, 10).join(judged, "query_id", "left_semi"))


_JUDGED = "SELECT q.vec_id AS query_id, v.vec_id AS id, CASE WHEN q.label = v.label THEN 2 ELSE 1 END AS grade FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND ((q.label = v.label AND q.vec_id <> v.vec_id) OR v.label = q.label + 1)"
_MEASURES = f"""h AS (SELECT t.query_id, t.id, t.rank, coalesce(j.grade, 0) AS grade FROM ({_top(10)}) t LEFT JOIN j USING (query_id, id)),
u AS (SELECT *, (grade > 0)::INT AS rel, sum((grade > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM h),
s AS (SELECT query_id, count(*) AS n, sum(rel) AS hit, sum(grade / log2(rank + 1)) AS dcg, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel * upto / rank) AS cum FROM u GROUP BY 1),
t AS (SELECT query_id, count(*) AS relevant FROM j GROUP BY 1), i AS (SELECT query_id, sum(grade / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS place FROM j) WHERE place <= 10 GROUP BY 1),
m AS (SELECT query_id, coalesce(hit / n, 0.0) AS precision, coalesce(hit / relevant, 0.0) AS recall, coalesce(dcg / ideal, 0.0) AS ndcg, coalesce(1.0 / first, 0.0) AS mrr, coalesce(cum / relevant, 0.0) AS ap FROM t LEFT JOIN s USING (query_id) LEFT JOIN i USING (query_id))"""


@R.add(f"WITH j AS ({_JUDGED}), {_MEASURES} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(ap, 6) AS ap FROM m")
def eval_measures(spark, sf):
    m = _graded(spark, sf, _hits(spark, sf, 10))
    return m.select("query_id", *[F.round(n, 6).alias(n) for n in E.NAMES])


@R.add(f"WITH j AS ({_JUDGED}), {_MEASURES} SELECT " + ", ".join(f"round(avg({n}), 4) AS {n}" for n in E.NAMES) + ", count(*) AS queries FROM m")
def eval_averages(spark, sf):
    return E.averages(_graded(spark, sf, _hits(spark, sf, 10)))


@R.add()
def eval_ab(spark, sf):
    """Plain hits against hits after the label boost."""
    return E.compare(_graded(spark, sf, _hits(spark, sf, 10)), _graded(spark, sf, vec_overfetch(spark, sf)))
