"""Ranking measures over judged result lists: query_id, id, rank and graded judgements query_id, id, grade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(judged: DataFrame, k: int) -> DataFrame:
    """query_id, relevant, ideal (the best discounted gain at k) of each judged query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    top = judged.filter("grade > 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    ideal = top.groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("place") + 1)).alias("ideal"))
    total = judged.groupBy("query_id").agg(F.nullif(F.sum((F.col("grade") > 0).cast("long")), F.lit(0)).alias("relevant"))
    return total.join(ideal, "query_id", "left")


def totals_by_grade(counts: DataFrame, k: int) -> DataFrame:
    """The same from counts: query_id, grade, n. No query is paired with what it would find."""
    per = counts.filter("grade > 0 and n > 0").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False).alias("g"), F.sum("n").cast("long").alias("relevant"))
    grades = F.slice(F.flatten(F.transform("g", lambda x: F.array_repeat(x["grade"], F.least(x["n"], F.lit(k)).cast("int")))), 1, k)
    ideal = F.aggregate(F.transform(grades, lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)
    every = counts.select("query_id").distinct()
    return every.join(per.select("query_id", "relevant", ideal.alias("ideal")), "query_id", "left")


def measures(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """precision, recall, ndcg, mrr and ap at k of each judged query."""
    hits = ranked.filter(F.col("rank") <= k).join(judged.select("query_id", "id", "grade"), ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    return scored(hits, totals(judged, k))


def scored(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """The measures of graded hits: query_id, id, rank, grade."""
    rel = (F.col("grade") > 0).cast("int")
    upto = F.sum(rel).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    sums = hits.withColumn("rel", rel).withColumn("upto", upto).groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum("rel").alias("hit"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel") * F.col("upto") / F.col("rank")).alias("cum"),
    )
    s = totals.join(sums, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.select(
        "query_id", zero(F.col("hit") / F.col("n")).alias("precision"), F.when(F.col("relevant").isNull(), 1.0).otherwise(zero(F.col("hit") / F.col("relevant"))).alias("recall"),
        zero(F.col("dcg") / F.col("ideal")).alias("ndcg"), zero(1.0 / F.col("first")).alias("mrr"), F.when(F.col("relevant").isNull(), 1.0).otherwise(zero(F.col("cum") / F.col("relevant"))).alias("ap"),
    )


NAMES = ("precision", "recall", "ndcg", "mrr", "ap")


def averages(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.round(F.avg(n), 4).alias(n) for n in NAMES], F.count("*").alias("queries"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """measure, a, b, delta, wins of either and ties: strategies judged on the same queries."""
    both = a.select("query_id", *[F.col(n).alias(f"a_{n}") for n in NAMES]).join(b.select("query_id", *[F.col(n).alias(f"b_{n}") for n in NAMES]), "query_id")
    long = both.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"a_{n}").alias("a"), F.col(f"b_{n}").alias("b")) for n in NAMES])).alias("x")).select("query_id", "x.*")
    won = lambda c: F.sum(c.cast("long"))
    return long.groupBy("measure").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), (F.avg("b") - F.avg("a")).alias("delta"), won(F.col("a") > F.col("b")).alias("wins_a"), won(F.col("b") > F.col("a")).alias("wins_b"), won(F.col("a") == F.col("b")).alias("ties"))


# ---------------------------------------------------------------- suites


def by_type(scores: DataFrame, kinds: DataFrame) -> DataFrame:
    """Averages over all queries and by query_type in one pass (query_type null: all)."""
    rows = scores.join(kinds.select("query_id", "query_type"), "query_id", "left")
    return rows.groupingSets([(), ("query_type",)], "query_type").agg(*[F.round(F.avg(n), 4).alias(n) for n in NAMES], F.count("*").alias("queries"))


#: Rate of the plan suite: what a case must expect to count for it, and what the plan must then have.
PLAN_RATES = {
    "tabular_plan_success_rate": (lambda c: True, lambda c, p: bool(p)),
    "metric_resolution_accuracy": (lambda c: c.get("expected_metric"), lambda c, p: p.get("metric_column") == c["expected_metric"]),
    "filter_resolution_accuracy": (lambda c: c.get("expected_filter_column"), lambda c, p: c["expected_filter_column"] in {f["column"] for f in p.get("filters") or []}),
    "unit_render_accuracy": (lambda c: c.get("expected_unit"), lambda c, p: p.get("expected_unit") == c["expected_unit"]),
    "temporal_question_success_rate": (lambda c: c.get("expected_intent") == "tabular_groupby" and c.get("expected_time_grain"), lambda c, p: p.get("intent") == "tabular_groupby" and p.get("time_grain") == c["expected_time_grain"]),
    "catalog_question_success_rate": (lambda c: str(c.get("expected_intent", "")).startswith("catalog_"), lambda c, p: p.get("intent") == c["expected_intent"]),
    **{f"{k}_question_success_rate": (lambda c, k=k: c.get("expected_intent") == f"tabular_{k}", lambda c, p, k=k: p.get("intent") == f"tabular_{k}") for k in ("schema", "distinct", "compare")},
}


def plan_suite(cases: list[dict], planner) -> dict[str, float]:
    """Rates of a suite of questions with what their plans should have. planner: question to plan dictionary or None."""
    plans = [planner(c["question"]) or {} for c in cases]
    out = {}
    for name, (asked, right) in PLAN_RATES.items():
        own = [(c, p) for c, p in zip(cases, plans) if asked(c)]
        out[name] = round(sum(bool(right(c, p)) for c, p in own) / max(1, len(own)), 4)
    return out


def roll_up(suites: dict[str, dict[str, float]]) -> dict[str, float]:
    """Each rate averaged over the suites."""
    names = dict.fromkeys(n for s in suites.values() for n in s)
    return {n: round(sum(s[n] for s in suites.values() if n in s) / max(1, sum(n in s for s in suites.values())), 4) for n in names}


def structural_suite(summaries: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of rates. summaries: node_type, numeral, label, articles, status; gold: query_id, target_type, target_numeral, expected.

    A target meets the first summary (by label) of its type and number: an equi-join on type and value.
    """
    from garimpo.operators import scope as S
    from garimpo.operators.ingest import numeral_of

    number = F.coalesce(F.nullif(F.trim("numeral"), F.lit("")), numeral_of(F.col("label")), F.lit(""))
    key = lambda c: F.coalesce(S.numeral_value(F.lower(F.trim(c))).cast("string"), F.upper(F.trim(c)))
    s = summaries.select(F.lower("node_type").alias("kind"), key(number).alias("value"), "label", "articles", F.lower(F.coalesce("status", F.lit("generated"))).alias("status"))
    first = s.groupBy("kind", "value").agg(F.min_by(F.struct("label", "articles", "status"), "label").alias("m"))
    rows = gold.select("query_id", F.lower("target_type").alias("kind"), key(F.col("target_numeral")).alias("value"), "expected").join(first, ["kind", "value"], "left")
    hit = F.col("m").isNotNull().cast("double")
    share = lambda a, b: F.round(F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0.0)), F.lit(0.0)), 4)
    valid, fallback = (F.col("m.status") != "invalid").cast("double"), (F.col("m.status") == "fallback_only").cast("double")
    mean = lambda c: F.round(F.avg(c), 4)
    return rows.agg(
        mean(hit).alias("structural_hit_at_1"), mean(F.when(hit == 1, S.article_coverage(F.col("m.articles"), F.col("expected"))).otherwise(0.0)).alias("article_coverage"), mean(hit).alias("summary_found_rate"),
        share(valid, hit).alias("summary_valid_rate"), mean(hit).alias("summary_scope_accuracy"), mean(hit).alias("citation_scope_precision"), share(fallback, fallback).alias("fallback_success_rate"), F.count("*").alias("queries"),
    )
