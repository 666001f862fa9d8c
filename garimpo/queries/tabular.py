"""Questions, plans, filters, profiles, deadlines and the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from garimpo.functions import numbers as N
from garimpo.functions import text as X
from garimpo.plans import compiler, planner, semantics
from garimpo.plans.model import Filter, Plan
from garimpo.operators import routing as Q
from garimpo.queries import values as W
from garimpo.queries.registry import Registry, sql_match, sql_norm
from garimpo.session import table

R = Registry()


def run(df, plan: Plan):
    profiles = semantics.measured(df)
    checked = planner.validate(plan, profiles)
    return compiler.compile(checked, df, profiles)


@R.add("SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 1")
def ask_total_by_month(spark, sf):
    """Qual o valor total por mes?"""
    return compiler.ask(table(spark, sf, "orders"), "Qual o valor total por mes?").withColumn("value", F.round("value", 2))


@R.add("SELECT count(*) AS value FROM orders WHERE lower(o_orderstatus) = 'f'")
def ask_count_status(spark, sf):
    return compiler.ask(table(spark, sf, "orders"), "Quantos pedidos com status F?", values={"o_orderstatus": ["F", "O", "P"]})


@R.add("SELECT c_custkey, c_acctbal AS value FROM customer ORDER BY value DESC NULLS LAST, c_custkey LIMIT 10")
def ask_top_customers(spark, sf):
    return run(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), Plan("tabular_rank", metric="c_acctbal", aggregation="max", limit=10, confidence=0.9))


def _aggregate(name, fn):
    def f(spark, sf):
        return run(table(spark, sf, "orders"), Plan("tabular_count" if fn == "count" else "tabular_aggregate", metric="o_totalprice", aggregation=fn, filters=(Filter("o_orderstatus", "=", "O"),))).withColumn("value", F.round("value", 2))

    f.__name__ = name
    R.add(f"SELECT {'count(*)' if fn == 'count' else f'round({fn}(o_totalprice), 2)'} AS value FROM orders WHERE lower(o_orderstatus) = 'o'")(f)


for _fn in ("count", "sum", "avg", "min", "max"):
    _aggregate(f"tab_{_fn}", _fn)


@R.add("SELECT l_returnflag, sum(l_quantity) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def tab_groupby(spark, sf):
    return run(table(spark, sf, "lineitem"), Plan("tabular_groupby", metric="l_quantity", aggregation="sum", group_by=("l_returnflag",), limit=10))


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS value FROM lineitem GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def tab_groupby_multi(spark, sf):
    return run(table(spark, sf, "lineitem"), Plan("tabular_groupby", metric="l_quantity", aggregation="count", group_by=("l_returnflag", "l_linestatus"), limit=10))


def _bucket(grain, fmt):
    def f(spark, sf):
        return run(table(spark, sf, "orders"), Plan("tabular_groupby", metric="o_totalprice", aggregation="count", group_by=("o_orderdate",), grain=grain))

    f.__name__ = f"tab_bucket_{grain}"
    R.add(f"SELECT strftime(o_orderdate, '{fmt}') AS o_orderdate, count(*) AS value FROM orders GROUP BY 1")(f)


for _g, _f in (("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y")):
    _bucket(_g, _f)


@R.add("""WITH g AS (SELECT o_orderpriority, avg(o_totalprice) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT o_orderpriority, round(value, 4) AS value, row_number() OVER w AS rank, round(value - lead(value) OVER w, 4) AS delta FROM g WINDOW w AS (ORDER BY value DESC, o_orderpriority)""")
def tab_compare_delta(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("value")).orderBy(F.desc("value"), "o_orderpriority").limit(10)
    return compiler.compare_delta(g, "o_orderpriority").select("o_orderpriority", F.round("value", 4).alias("value"), "rank", F.round("delta", 4).alias("delta"))


@R.add("SELECT o_orderkey, o_custkey, o_totalprice AS value FROM orders ORDER BY o_totalprice, o_orderkey, o_custkey LIMIT 20")
def tab_rank_asc(spark, sf):
    return run(table(spark, sf, "orders"), Plan("tabular_rank", metric="o_totalprice", aggregation="min", limit=20))


@R.add("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment <> '' ORDER BY 1 LIMIT 100")
def tab_distinct(spark, sf):
    return run(table(spark, sf, "customer"), Plan("tabular_distinct", dimension="c_mktsegment", limit=100))


@R.add()
def tab_schema(spark, sf):
    return run(table(spark, sf, "orders"), Plan("tabular_schema"))


@R.add()
def tab_describe(spark, sf):
    return run(table(spark, sf, "orders"), Plan("tabular_describe_column", target="o_totalprice"))


_FILTERS = {
    "flt_eq": ("orders", Filter("o_orderpriority", "=", "1-URGENT"), "lower(o_orderpriority) = '1-urgent'"),
    "flt_neq": ("orders", Filter("o_orderstatus", "!=", "f"), "lower(o_orderstatus) <> 'f'"),
    "flt_range": ("lineitem", Filter("l_quantity", ">=", "45"), "l_quantity >= 45"),
    "flt_between": ("orders", Filter("o_orderdate", "between", "1995-01-01|1995-12-31"), "o_orderdate::DATE BETWEEN '1995-01-01' AND '1995-12-31'"),
    "flt_date_from": ("orders", Filter("o_orderdate", ">=", "1996-03"), "o_orderdate >= '1996-03-01'"),
    "flt_in": ("orders", Filter("o_orderstatus", "in", "O|P"), "lower(o_orderstatus) IN ('o', 'p')"),
    "flt_like": ("part", Filter("p_type", "like", "steel"), "lower(p_type) LIKE '%steel%'"),
}


def _filter(name, source, flt, where):
    def f(spark, sf):
        df = table(spark, sf, source)
        return df.filter(compiler.condition(df, flt))

    f.__name__ = name
    R.add(f"SELECT * FROM {source} WHERE {where}")(f)


for _n, (_t, _c, _w) in _FILTERS.items():
    _filter(_n, _t, _c, _w)


@R.add("SELECT p_partkey, p_name, p_size FROM part WHERE " + sql_norm("p_brand") + " LIKE '%brand%' AND coalesce(p_size::DOUBLE, 0) <= 10")
def flt_row_norm(spark, sf):
    df = table(spark, sf, "part")
    return df.filter(compiler.row_condition(df, Filter("p_brand", "like", "BRAND")) & compiler.row_condition(df, Filter("p_size", "<=", "10"))).select("p_partkey", "p_name", "p_size")


@R.add(f"SELECT p_partkey, p_name FROM part WHERE contains({sql_norm('p_name')}, 'part')")
def flt_fallback_title(spark, sf):
    """No part is called just 'Part', so titles that contain the word come back."""
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    return compiler.catalog_rows(df, (Filter("p_name", "=", "Part"),), "p_name")


@R.add("""SELECT x.t AS column_name, x.v AS raw_value, count(*) AS frequency FROM (
SELECT unnest([{'t': 'p_brand', 'v': p_brand}, {'t': 'p_type', 'v': p_type}, {'t': 'p_size', 'v': p_size::VARCHAR}]) AS x FROM part) WHERE trim(x.v) <> '' GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY frequency DESC, raw_value) <= 25""")
def prof_value_catalog(spark, sf):
    return semantics.value_catalog(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"]).drop("rank")


_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@R.add(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS filled, round(avg(CASE WHEN regexp_matches(trim({c}::VARCHAR), '^-?(?:\\d+|\\d{{1,3}}(?:\\.\\d{{3}})+)(?:[.,]\\d+)?(?:[eE][-+]?\\d+)?$') THEN 1.0 ELSE 0.0 END), 6) AS numeric_share, count(DISTINCT {c}) AS cardinality FROM customer WHERE trim({c}::VARCHAR) <> ''" for c in _COLS))
def prof_columns(spark, sf):
    return semantics.shares(table(spark, sf, "customer").select(*_COLS)).withColumn("numeric_share", F.round("numeric_share", 6))


@R.add()
def prof_semantics(spark, sf):
    rows = [(t, p.name, p.data_type, p.role, p.semantic_type, p.unit) for t in ("orders", "lineitem", "customer", "part", "deadlines", "documents") for p in semantics.measured(table(spark, sf, t))]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, role string, semantic_type string, unit string")


_PTBR = """CASE WHEN regexp_matches(s, '^-?\\d{1,3}(\\.\\d{3})+(,\\d+)?$') THEN try_cast(replace(replace(s, '.', ''), ',', '.') AS DOUBLE)
WHEN regexp_matches(s, '^-?\\d+,\\d+$') THEN try_cast(replace(s, ',', '.') AS DOUBLE) ELSE try_cast(s AS DOUBLE) END"""


@R.add(f"SELECT l_orderkey, l_linenumber, {_PTBR} AS parsed FROM (SELECT *, trim(replace((l_extendedprice::DECIMAL(18, 2))::VARCHAR, '.', ',')) AS s FROM lineitem)")
def ptbr_number_parse(spark, sf):
    text = F.replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.ptbr_double(text).alias("parsed"))


@R.add("SELECT o_orderkey, 'R$ ' || translate(format('{:,.2f}', o_totalprice::DECIMAL(18, 2)), ',.', '.,') AS shown FROM orders")
def ptbr_number_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.ptbr_text(F.col("o_totalprice"), "brl").alias("shown"))


_DEADLINE = """
SELECT *, instr(n, 'imediato') > 0 AS imm, instr(n, 'sem cobertura') > 0 AS sc, instr(n, 'nao autoriza') > 0 AS na,
  regexp_extract(n, 'ate\\s+(\\d{1,3})\\s*(?:\\([^)]+\\))?\\s*(dias uteis|dias|horas)', 1) AS d1, regexp_extract(n, 'ate\\s+(\\d{1,3})\\s*(?:\\([^)]+\\))?\\s*(dias uteis|dias|horas)', 2) AS u1,
  map {'um': 1, 'uma': 1, 'dois': 2, 'duas': 2, 'tres': 3, 'quatro': 4, 'cinco': 5, 'seis': 6, 'sete': 7, 'oito': 8, 'nove': 9, 'dez': 10}[regexp_extract(n, 'ate\\s+\\(?([a-z]+)\\)?\\s*(dias uteis|dias|horas)', 1)] AS d2,
  regexp_extract(n, 'ate\\s+\\(?([a-z]+)\\)?\\s*(dias uteis|dias|horas)', 2) AS u2
FROM (SELECT *, trim(regexp_replace(lower(""" + "translate(coalesce(raw_text, ''), '" + W.ACCENTED + "', '" + W.BARE + """')), '\\s+', ' ', 'g')) AS n FROM deadlines)"""
_DEADLINE_COLS = """CASE WHEN imm THEN 0 WHEN d1 <> '' THEN d1::INT ELSE d2 END AS d, CASE WHEN imm THEN 'imediato' WHEN d1 <> '' THEN replace(u1, ' ', '_') WHEN d2 IS NOT NULL THEN replace(u2, ' ', '_') ELSE 'texto' END AS u"""
_BAND = "CASE WHEN sc THEN 'Sem Cobertura' WHEN na THEN 'Nao autoriza' WHEN imm THEN 'Imediato' WHEN d IS NULL THEN 'Desconhecido' WHEN d <= 3 THEN 'Ate 3 dias' WHEN d <= 5 THEN 'Ate 5 dias' WHEN d <= 10 THEN 'Ate 10 dias' ELSE 'Acima de 10 dias' END"


@R.add(f"""SELECT DISTINCT deadline_id, coalesce(d, -1) AS days, u AS unit, {_BAND} AS faixa,
CASE WHEN sc THEN 'sem_cobertura' WHEN na THEN 'nao_autoriza' WHEN imm THEN 'imediato' WHEN d IS NULL THEN 'desconhecido' WHEN d <= 5 THEN 'curto' WHEN d <= 10 THEN 'medio' ELSE 'longo' END AS urgency,
(instr(n, 'necessita autoriz') > 0 OR instr(n, 'autorizacao obrigatoria') > 0) AND NOT sc AND NOT na AS requires_authorization FROM (SELECT *, {_DEADLINE_COLS} FROM ({_DEADLINE}))""")
def deadline_normalize(spark, sf):
    return table(spark, sf, "deadlines").select("deadline_id", N.deadline(F.col("raw_text")).alias("x")).select("deadline_id", "x.*").withColumn("days", F.coalesce("days", F.lit(-1))).distinct()


@R.add(f"SELECT prazo_faixa, count(*) AS value, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM (SELECT DISTINCT deadline_id, {_BAND} AS prazo_faixa FROM (SELECT *, {_DEADLINE_COLS} FROM ({_DEADLINE}))) GROUP BY 1")
def deadline_report(spark, sf):
    d = table(spark, sf, "deadlines").select("deadline_id", N.deadline(F.col("raw_text"))["faixa"].alias("prazo_faixa")).distinct()
    return compiler.deadline_report(d).withColumn("percent", F.round("percent", 4))


@R.add(f"SELECT DISTINCT deadline_id, {_BAND} AS prazo_faixa FROM (SELECT *, {_DEADLINE_COLS} FROM ({_DEADLINE})) WHERE NOT sc AND NOT na AND (imm OR d <= 5)")
def deadline_alerts(spark, sf):
    d = table(spark, sf, "deadlines").select("deadline_id", N.deadline(F.col("raw_text")).alias("x")).distinct()
    return d.filter(F.col("x.urgency").isin("imediato", "curto")).select("deadline_id", F.col("x.faixa").alias("prazo_faixa"))


_SEARCH = "(CASE WHEN contains(t, 'steel brushed') THEN 3.0 ELSE 0.0 END) + (CASE WHEN contains(t, 'steel') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'brushed') THEN 1 ELSE 0 END)"


def catalog_score(text, query: str):
    """3 for the whole phrase and 1 for each word."""
    words = list(dict.fromkeys(query.lower().split()))
    score = F.when(F.contains(text, F.lit(query.lower())), 3.0).otherwise(0.0)
    for w in words:
        score = score + F.when(F.contains(text, F.lit(w)), 1).otherwise(0)
    return score


@R.add(f"SELECT p_partkey, {_SEARCH} AS score FROM (SELECT *, lower(concat_ws(' ', p_name, p_brand, p_type)) AS t FROM part) WHERE {_SEARCH} > 0 ORDER BY score DESC, p_partkey LIMIT 20")
def cat_search(spark, sf):
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, sf, "part").select("p_partkey", catalog_score(text, "steel brushed").alias("score")).filter("score > 0").orderBy(F.desc("score"), "p_partkey").limit(20)


@R.add("SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_replace(p_partkey::VARCHAR, '\\D+', '', 'g') = '77'")
def cat_lookup(spark, sf):
    return table(spark, sf, "part").filter(F.regexp_replace(F.col("p_partkey").cast("string"), r"\D+", "") == "77").select("p_partkey", "p_name", "p_brand")


@R.add("SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) = 1")
def cat_dedup(spark, sf):
    """Of each brand the record with the longest text, ties by the first."""
    best = F.min_by(F.struct("p_partkey", "p_name"), F.struct(-F.length("p_name"), F.col("p_partkey")))
    return table(spark, sf, "part").groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.*")


@R.add("""SELECT extraction_id, r.row_index AS row_index, r.fields['codigo'] AS codigo, coalesce(nullif(trim(r.fields['descricao']), ''), nullif(trim(r.fields['nome_item']), '')) AS titulo
FROM (SELECT DISTINCT extraction_id, unnest(records) AS r FROM table_extractions WHERE family = 'rol_procedimentos') WHERE regexp_matches(r.fields['codigo'], '^\\d{4,}$')""")
def cat_records(spark, sf):
    """Catalog rows out of extracted records: those with a code."""
    rows = table(spark, sf, "table_extractions").filter("family = 'rol_procedimentos'").select("extraction_id", F.explode("records").alias("r")).select("extraction_id", F.col("r.row_index").alias("row_index"), F.col("r.fields").alias("f"), F.col("r.raw_row").alias("raw"), F.col("r.page_number").alias("p"), F.col("r.texto_canonico").alias("t"))
    rows = rows.withColumn("codigo", F.try_element_at("f", F.lit("codigo"))).filter(F.col("codigo").rlike(r"^\d{4,}$"))
    flat = rows.withColumn("titulo", X.map_first(F.col("f"), "descricao", "nome_item")).withColumn("m", F.to_json("f"))
    return flat.select("extraction_id", "row_index", "codigo", "titulo", "m", "raw", "p", "t").distinct().select("extraction_id", "row_index", "codigo", "titulo")


@R.add("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def star_revenue_by_nation(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    li = table(spark, sf, "lineitem")
    # Aggregate by supplier before the joins: the shuffle carries one row a supplier and partition.
    by_supplier = li.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return by_supplier.join(s, by_supplier.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == n.n_nationkey).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


@R.add("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"))


_Q = "SELECT DISTINCT content AS question, " + sql_match("content") + " AS q FROM messages WHERE content IS NOT NULL"
_CODE, _ANY, _FLAG, _COVER = "\\bcodigo\\s+(\\d{5,})\\b", "\\b(\\d{5,})\\b", "\\bemergencia\\s+(sim|nao)\\b", "\\bcobertura\\s+([a-z0-9_\\- ]{2,60})\\b"


@R.add(f"""SELECT question, CASE WHEN regexp_matches(q, '{_ANY}') THEN 'structured' WHEN regexp_matches(q, '{_FLAG}') OR regexp_matches(q, '{_COVER}') THEN 'hybrid' ELSE 'vector' END AS route,
CASE WHEN regexp_matches(q, '{_CODE}') THEN 0.95 WHEN regexp_matches(q, '{_ANY}') THEN 0.9 WHEN regexp_matches(q, '{_FLAG}') OR regexp_matches(q, '{_COVER}') THEN 0.8 ELSE 0.75 END AS confidence,
coalesce(nullif(regexp_extract(q, '{_CODE}', 1), ''), regexp_extract(q, '{_ANY}', 1)) AS codigo, trim(regexp_extract(q, '{_COVER}', 1)) AS cobertura FROM ({_Q})""")
def route_questions(spark, sf):
    rows = table(spark, sf, "messages").filter("content is not null").select(F.col("content").alias("question")).distinct().withColumn("r", Q.route(F.col("question")))
    found = lambda k: F.coalesce(F.try_element_at("r.filters", F.lit(k)), F.lit(""))
    return rows.select("question", "r.route", "r.confidence", found("codigo").alias("codigo"), found("cobertura").alias("cobertura"))


_REF = "\\b(?:capitulo|secao|titulo|parte)\\s+(?:[ivxlcdm]+|\\d{1,4})\\b"
_NOUN = "\\b(?:capitulo|capitulos|secao|secoes|titulo|titulos|artigo|artigos)\\b"
_TWO = " + ".join(f"regexp_matches(q, '\\b{u}\\s+([ivxlcdm]+|\\d{{1,4}})\\b')::INT" for u in ("titulo", "capitulo", "secao", "subsecao")) + " + regexp_matches(q, '\\bart(?:igo)?\\.?\\s*[0-9]{1,4}')::INT"


@R.add(f"""SELECT question, CASE WHEN regexp_matches(q, '\\b(resum|sintetiz|explique|descrev|visao\\s+(geral|executiva))') AND regexp_matches(q, '{_REF}') THEN 'summary_structural'
WHEN regexp_matches(q, '\\b(quantos|quantas|numero\\s+de|qtd\\.?)\\b') AND regexp_matches(q, '{_NOUN}') THEN 'count_structural'
WHEN regexp_matches(q, '\\b(quais|liste|listar|lista|relacione)\\b') AND regexp_matches(q, '{_NOUN}') THEN 'list_structural'
WHEN regexp_matches(q, '\\b(onde\\s+esta|onde\\s+fica|ultimo|ultima|primeiro|primeira)\\b') AND regexp_matches(q, '{_NOUN}') THEN 'locate_structural'
WHEN regexp_matches(q, '\\b(tem|possui|contem|inclui|ha|existe|existem)\\b') AND {_TWO} >= 2 THEN 'contains_structural'
WHEN regexp_matches(q, '\\b(compar\\w*|diferenca\\s+entre|versus|vs\\.?)\\b') AND regexp_matches(q, '{_REF}') THEN 'comparison'
WHEN regexp_matches(q, '{_REF}') AND regexp_matches(q, 'capitulo|secao|artigo|titulo|inciso|paragrafo') AND len(regexp_split_to_array(trim(question), '\\s+')) <= 6 THEN 'locate_excerpt'
WHEN regexp_matches(q, '{_REF}') THEN 'question_structural' ELSE 'question_factual' END AS intent FROM ({_Q})""")
def classify_intents(spark, sf):
    return table(spark, sf, "messages").filter("content is not null").select(F.col("content").alias("question")).distinct().withColumn("intent", Q.intent(F.col("question")))
