"""Where a question goes: structured, vector or hybrid retrieval, and its intent. Columns for batches of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.operators import scope as S

# Patterns of the router.
CODE, ANY_CODE = r"\bcodigo\s+(\d{5,})\b", r"\b(\d{5,})\b"
EMERGENCY, COVERAGE = r"\bemergencia\s+(sim|nao)\b", r"\bcobertura\s+([a-z0-9_\- ]{2,60})\b"

# Signs of the intents.
SUMMARY = r"\b(?:resum|sintetiz|explique|descrev|visao\s+(?:geral|executiva))"
COUNT, LIST = r"\b(?:quantos|quantas|numero\s+de|qtd\.?)\b", r"\b(?:quais|liste|listar|lista|relacione)\b"
LOCATE = r"\b(?:onde\s+esta|onde\s+fica|ultimo|ultima|primeiro|primeira)\b"
CONTAINS = r"\b(?:tem|possui|contem|inclui|ha|existe|existem)\b"
COMPARE = r"\b(?:compar\w*|diferenca\s+entre|versus|vs\.?)\b"
REFERENCE = r"\b(?:capitulo|secao|titulo|parte)\s+(?:[ivxlcdm]+|\d{1,4})\b"
NOUN = r"\b(?:capitulos?|secao|secoes|titulos?|artigos?)\b"


def route(question: Column, explicit: Column | None = None) -> Column:
    """Struct of route, confidence and filters. explicit: filters given with the question (map), which settle the route."""
    q = X.norm_match(F.coalesce(question, F.lit("")))
    code = F.nullif(F.regexp_extract(q, CODE, 1), F.lit(""))
    any_code = F.nullif(F.regexp_extract(q, ANY_CODE, 1), F.lit(""))
    flag = F.nullif(F.regexp_extract(q, EMERGENCY, 1), F.lit(""))
    cover = F.nullif(F.trim(F.regexp_extract(q, COVERAGE, 1)), F.lit(""))
    given = F.coalesce(F.size(explicit) > 0, F.lit(False)) if explicit is not None else F.lit(False)
    pairs = F.array(F.struct(F.lit("codigo").alias("k"), F.coalesce(code, any_code).alias("v")), F.struct(F.lit("emergencia").alias("k"), flag.alias("v")), F.struct(F.lit("cobertura").alias("k"), cover.alias("v")))
    found = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    exact = code.isNotNull() | any_code.isNotNull()
    kind = F.when(given | exact, "structured").when(flag.isNotNull() | cover.isNotNull(), "hybrid").otherwise("vector")
    confidence = F.when(given, 1.0).when(code.isNotNull(), 0.95).when(exact, 0.9).when(flag.isNotNull() | cover.isNotNull(), 0.8).otherwise(0.75)
    filters = F.when(given, explicit).otherwise(found) if explicit is not None else found
    return F.struct(kind.alias("route"), confidence.alias("confidence"), filters.alias("filters"))


def intent(question: Column) -> Column:
    """One of nine intents, by rules in order."""
    q = X.norm_match(F.trim(F.coalesce(question, F.lit(""))))
    t = S.targets(question)
    two = reduce(lambda a, b: a + b, [(F.size(t[u]) > 0).cast("int") for u in (*S.UNITS, "artigo")]) >= 2
    ref, noun = q.rlike(REFERENCE), q.rlike(NOUN)
    short = q.rlike("capitulo|secao|artigo|titulo|inciso|paragrafo") & (F.size(F.split(F.trim(question), r"\s+")) <= 6)
    return (
        F.when(q.rlike(SUMMARY) & ref, "summary_structural").when(q.rlike(COUNT) & noun, "count_structural").when(q.rlike(LIST) & noun, "list_structural")
        .when(q.rlike(LOCATE) & noun, "locate_structural").when(q.rlike(CONTAINS) & two, "contains_structural").when(q.rlike(COMPARE) & ref, "comparison")
        .when(ref & short, "locate_excerpt").when(ref, "question_structural").otherwise("question_factual")
    )


def intent_by_examples(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """query_id, intent, score: the class whose examples are most similar on average.

    questions: query_id, v; examples: intent, v. The average cosine to a class is the product of the unit
    question with the mean of the unit examples, so one mean vector a class is collected (as many as classes).
    """
    unit = lambda df: df.withColumn("v", F.col("v").cast("array<double>")).withColumn("_n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).filter(F.col("_n") > 0)
    parts = unit(examples).select("intent", "_n", F.posexplode("v")).groupBy("intent", "pos").agg(F.avg(F.col("col") / F.col("_n")).alias("m"))
    means = parts.groupBy("intent").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("m"))
    classes = sorted((r["intent"], r["m"]) for r in means.collect())
    dot = lambda m: F.aggregate(F.zip_with("v", F.array(*map(F.lit, m)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.col("_n")
    scored = F.array(*[F.struct((-F.round(dot(m), 9)).alias("far"), F.lit(name).alias("intent")) for name, m in classes])
    best = F.array_min(scored)
    return unit(questions).select("query_id", best["intent"].alias("intent"), (-best["far"]).alias("score"))
