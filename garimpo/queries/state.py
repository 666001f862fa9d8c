"""Stored tables, history, events, chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from garimpo.operators import blocks as B
from garimpo.operators import chunking as C
from garimpo.operators import store as S
from garimpo.queries.registry import Registry, sql_match
from garimpo.functions import text as X
from garimpo.session import table
from garimpo.streaming import stateful as W

R = Registry()


@R.add("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def cp_upsert_lww(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return S.last_write(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@R.add("WITH o AS (SELECT doc_id, title AS hint FROM documents), n AS (SELECT doc_id, collection AS hint FROM documents WHERE text IS NOT NULL) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN coalesce(trim(n.hint), '') <> '' THEN n.hint ELSE o.hint END AS hint FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def cp_upsert_hint(spark, sf):
    """Titles, then collections of the documents with a text, as hints; an empty new hint keeps the old one."""
    d = table(spark, sf, "documents")
    old = d.select("doc_id", F.col("title").alias("hint"))
    new = d.filter("text is not null").select("doc_id", F.col("collection").alias("hint"))
    return S.upsert_keeping(old, new, "doc_id", "hint")


@R.add("SELECT pdf_doc_id, count(*) AS rows, max(version) AS version FROM (SELECT pdf_doc_id, 1 AS version FROM legal_chunks WHERE pdf_doc_id NOT IN (SELECT pdf_doc_id FROM legal_nodes) UNION ALL SELECT pdf_doc_id, 2 FROM legal_nodes) GROUP BY 1")
def cp_replace_documents(spark, sf):
    """Rows of documents that come anew replace all their old rows."""
    old = table(spark, sf, "legal_chunks").select("pdf_doc_id", F.lit(1).alias("version"))
    new = table(spark, sf, "legal_nodes").select("pdf_doc_id", F.lit(2).alias("version"))
    return S.replace_documents(old, new, "pdf_doc_id").groupBy("pdf_doc_id").agg(F.count("*").alias("rows"), F.max("version").alias("version"))


@R.add("SELECT workspace_id, count(*) AS documents, sum(page_to - page_from + 1) AS pages, max(quality_score) AS best FROM (SELECT DISTINCT ON (result_id) * FROM pipeline_results) WHERE status = 'success' GROUP BY 1")
def cp_stats(spark, sf):
    r = table(spark, sf, "pipeline_results").filter("status = 'success'").dropDuplicates(["result_id"])
    return r.groupBy("workspace_id").agg(F.count("*").alias("documents"), F.sum(F.col("page_to") - F.col("page_from") + 1).alias("pages"), F.max("quality_score").alias("best"))


@R.add("SELECT count(*) AS purged FROM messages WHERE created_at < (SELECT max(created_at) FROM messages) - INTERVAL 90 DAY")
def cp_purge(spark, sf):
    return S.purge(table(spark, sf, "messages"), "created_at", 90)[1]


@R.add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS changes FROM events GROUP BY 1")
def cp_latest_status(spark, sf):
    return S.latest(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")


@R.add("SELECT event_type, count(value) AS n, round(sum(value), 3) AS total, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1")
def obs_timers(spark, sf):
    return S.timers(table(spark, sf, "events"), "event_type", "value").withColumn("total", F.round("total", 3)).withColumn("mean", F.round("mean", 6))


@R.add("SELECT event_id, (props::JSON ->> '$.k') AS k, json_keys(props::JSON)[1] AS first_key FROM events WHERE props IS NOT NULL")
def json_props(spark, sf):
    e = table(spark, sf, "events").filter("props is not null")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get(F.json_object_keys("props"), F.lit(0)).alias("first_key"))


_ROLE = "CASE WHEN lower(trim(role)) IN ('user', 'assistant') THEN lower(trim(role)) END"


@R.add(f"SELECT conversation_id, message_id FROM (SELECT DISTINCT ON (message_id) conversation_id, message_id, created_at, {_ROLE} AS r FROM messages WHERE content <> '') WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, message_id DESC) <= 20")
def hist_last20(spark, sf):
    """The last twenty messages of either speaker in each conversation."""
    m = table(spark, sf, "messages").filter("content <> ''").dropDuplicates(["message_id"]).filter(F.lower(F.trim("role")).isin("user", "assistant"))
    w = Window.partitionBy("conversation_id").orderBy(F.desc_nulls_last("created_at"), F.desc("message_id"))
    return m.withColumn("r", F.row_number().over(w)).filter("r <= 20").select("conversation_id", "message_id")


@R.add(f"SELECT conversation_id, max(created_at)::VARCHAR AS updated FROM messages WHERE conversation_id IN (SELECT conversation_id FROM messages WHERE contains({sql_match('content')}, 'prazo')) GROUP BY 1 HAVING max(created_at) IS NOT NULL ORDER BY max(created_at) DESC, conversation_id LIMIT 50")
def join_history_search(spark, sf):
    """Conversations with the word in any message, newest first."""
    m = table(spark, sf, "messages")
    hit = m.filter(F.contains(X.norm_match(F.col("content")), F.lit("prazo"))).select("conversation_id").distinct()
    found = m.join(hit, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.max("created_at").alias("u")).filter("u is not null")
    return found.orderBy(F.desc("u"), "conversation_id").limit(50).select("conversation_id", F.regexp_replace(F.date_format("u", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "").alias("updated"))


@R.add("""WITH s AS (SELECT DISTINCT pdf_doc_id AS doc, block_seq AS seq, trim(text) AS label FROM pdf_blocks WHERE block_type = 'section_header'), b AS (SELECT DISTINCT ON (block_key) block_key, pdf_doc_id AS doc, block_seq AS seq FROM pdf_blocks)
SELECT block_key, label FROM b ASOF JOIN s ON b.doc = s.doc AND b.seq >= s.seq""")
def join_asof_section(spark, sf):
    """The last section header at or before each block: one pass over the union, no range join."""
    b = table(spark, sf, "pdf_blocks").dropDuplicates(["block_key"])
    marks = b.filter("block_type = 'section_header'").select(F.col("pdf_doc_id").alias("doc"), F.col("block_seq").alias("seq"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("block_key"), F.trim("text").alias("label"))
    rows = b.select(F.col("pdf_doc_id").alias("doc"), F.col("block_seq").alias("seq"), F.lit(1).alias("o"), "block_key", F.lit(None).cast("string").alias("label"))
    both = B.carried(marks.unionByName(rows), "doc", "seq", ["seq", "o"], {"m": F.when(F.col("o") == 0, F.struct("label"))})
    return both.filter("o = 1 and m is not null").select("block_key", F.col("m.label").alias("label"))


@R.add()
def ev_rate_limit(spark, sf):
    """At most 3 events in 600 seconds of each user; refused ones are not counted."""
    return W.rate_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", most=3, window=600.0)


@R.add()
def ev_circuit_breaker(spark, sf):
    e = table(spark, sf, "events").withColumn("ok", F.col("value") > 50)
    return W.breaker_states(e, "event_type", "ts", "event_id", "ok")


@R.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def ev_tumbling(spark, sf):
    return W.windowed(table(spark, sf, "events"), "ts", "event_type", "value", "1 hour").withColumn("total", F.round("total", 3)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("SELECT start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type, value FROM events) GROUP BY 1, 2")
def ev_sliding(spark, sf):
    return W.windowed(table(spark, sf, "events"), "ts", "event_type", "value", "1 hour", "30 minutes").withColumn("total", F.round("total", 3)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def ev_session(spark, sf):
    return W.sessions(table(spark, sf, "events"), "ts", "user_id", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add()
def chunk_general(spark, sf):
    return C.general(table(spark, sf, "documents"), "doc_id", "text")


@R.add()
def chunk_tabular(spark, sf):
    return C.tabular(table(spark, sf, "table_extractions"), whole=True)


@R.add()
def chunk_legal(spark, sf):
    return C.legal(table(spark, sf, "documents"), "doc_id", "text")


_CELLS = "list_transform(string_split(trim(trim(x), '|'), '|'), lambda c: trim(c))"


@R.add(f"""WITH l AS (SELECT block_key, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_CELLS}), lambda c: len(c) > 1) AS l FROM (SELECT DISTINCT ON (block_key) block_key, text FROM pdf_blocks) WHERE contains(text, '|')),
e AS (SELECT block_key, l[1] AS header, unnest(l[2:]) AS cells FROM l WHERE len(l) > 1)
SELECT block_key, array_to_string(cells, '|') AS row FROM e WHERE lower(array_to_string(cells, '|')) <> lower(array_to_string(header, '|')) AND NOT list_bool_and(list_transform(cells, lambda c: regexp_matches(c, '^:?-{{2,}}:?$')))
AND len(list_filter(cells, lambda c: c <> '')) >= greatest(2, least(len(header), 3)) AND (list_bool_or(list_transform(cells, lambda c: regexp_matches(c, '^\\d{{5,}}$'))) OR regexp_matches(cells[1], '^[A-Za-z]*\\d+[A-Za-z0-9]*$') OR len(list_filter(cells, lambda c: regexp_matches(c, '\\d'))) >= 2 OR len(list_filter(cells, lambda c: c <> '')) >= greatest(3, least(len(header), 4)))""")
def src_pipe_tables(spark, sf):
    b = table(spark, sf, "pdf_blocks").dropDuplicates(["block_key"])
    return C.table_rows(b, "block_key", "text").select("block_key", F.array_join("cells", "|").alias("row"))
