"""A valid plan becomes a lazy DataFrame; Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions.numbers import deadline, ptbr_double
from garimpo.functions.text import norm_text
from garimpo.plans import planner, semantics
from garimpo.plans.model import Filter, Plan, Profile

GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def _type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def number(df: DataFrame, column: str) -> Column:
    """Numeric columns as they are, text by the tolerant parse."""
    return F.col(column).cast("double") if isinstance(_type(df, column), T.NumericType) else ptbr_double(F.col(column).cast("string"))


def day(df: DataFrame, column: str) -> Column:
    kind = _type(df, column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(column).cast("date")
    return F.when(F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(F.col(column), F.lit(10)).try_cast("date"))


def condition(df: DataFrame, f: Filter) -> Column:
    text, value = F.lower(F.col(f.column).cast("string")), f.value.strip().lower()
    if f.operator in (">", "<", ">=", "<="):
        if isinstance(_type(df, f.column), (T.TimestampType, T.TimestampNTZType, T.DateType)):
            left, right = F.date_format(F.col(f.column), "yyyy-MM-dd"), F.lit(f.value + ("-12-31"[len(f.value) - 4 :] if f.operator in ("<=", ">") and len(f.value) < 10 else "-01-01"[len(f.value) - 4 :] if len(f.value) < 10 else ""))
        else:
            left, right = number(df, f.column), F.lit(float(f.value))
        return {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[f.operator]
    if f.operator == "between":
        lo, hi = f.value.split("|")
        return day(df, f.column).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    if f.operator == "in":
        return text.isin([v.strip() for v in value.split("|")])
    return {"=": text == value, "!=": text != value, "like": text.like(f"%{value}%")}[f.operator]


def filtered(df: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
    for f in filters:
        df = df.filter(condition(df, f))
    return df


def with_deadlines(df: DataFrame, profiles: list[Profile]) -> DataFrame:
    """The derived deadline columns, from the first column that holds deadlines."""
    source = next((p.name for p in profiles if p.semantic_type == "deadline_rule" and p.name not in planner.DERIVED), None)
    if source is None or "prazo_faixa" in df.columns:
        return df
    d = deadline(F.col(source).cast("string"))
    return df.withColumn("_d", d).select("*", F.col("_d.days").alias("prazo_dias"), F.col("_d.faixa").alias("prazo_faixa"), F.col("_d.urgency").alias("prazo_urgencia"), F.col("_d.requires_authorization").cast("string").alias("requer_autorizacao")).drop("_d")


def compile(plan: Plan, df: DataFrame, profiles: list[Profile]) -> DataFrame:
    if plan.errors:
        raise ValueError("; ".join(plan.errors))
    names = {p.name: p for p in profiles}
    if plan.intent == "tabular_schema":
        rows = [(p.name, p.data_type, p.role, p.semantic_type, p.unit) for p in profiles]
        return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, role string, semantic_type string, unit string")
    if plan.intent == "tabular_describe_column":
        p = names[plan.target]
        return df.sparkSession.createDataFrame([(p.name, p.semantic_type, p.unit, p.description, list(p.aliases))], "column_name string, semantic_type string, unit string, description string, aliases array<string>")
    if plan.intent.startswith("catalog_"):
        return catalog(plan, with_deadlines(df, profiles), profiles)
    rows = filtered(df, plan.filters)
    if plan.intent == "tabular_distinct":
        v = F.col(plan.dimension).cast("string").alias("value")
        return rows.select(v).filter("value <> ''").distinct().orderBy("value").limit(plan.limit)
    measure = F.count("*") if plan.aggregation == "count" or not plan.metric else getattr(F, plan.aggregation)(number(df, plan.metric))
    if plan.intent in ("tabular_count", "tabular_aggregate"):
        return rows.agg(measure.alias("value"))
    if plan.intent in ("tabular_groupby", "tabular_compare"):
        keys = [F.date_format(day(df, c), GRAINS[plan.grain]).alias(c) if plan.grain and names[c].role == "date" else F.col(c) for c in plan.group_by]
        sums = rows.groupBy(*keys).agg(measure.alias("value"))
        if plan.grain:
            # A series is whole: the limit of rankings would cut it.
            return sums.orderBy(*plan.group_by)
        return sums.orderBy(F.desc_nulls_last("value"), *plan.group_by).limit(plan.limit)
    if plan.intent == "tabular_rank":
        show = [p.name for p in profiles if p.role == "identifier" or p.semantic_type == "dimension_person"] or [profiles[0].name]
        value = number(df, plan.metric).alias("value")
        order = F.asc_nulls_last("value") if plan.aggregation == "min" else F.desc_nulls_last("value")
        return rows.select(*show, value).orderBy(order, *show).limit(plan.limit)
    raise ValueError(f"intent desconhecida: {plan.intent}")


def row_condition(df: DataFrame, f: Filter) -> Column:
    """Catalog rows are compared by normalised text; unknown numbers count as 0."""
    text, value = norm_text(F.col(f.column).cast("string")), norm_text(F.lit(f.value))
    if f.operator in (">", "<", ">=", "<="):
        left, right = F.coalesce(F.col(f.column).try_cast("double"), F.lit(0.0)), F.lit(float(f.value))
        return {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[f.operator]
    if f.operator == "in":
        return F.array_contains(F.array(*[norm_text(F.lit(v)) for v in f.value.split("|")]), text)
    if f.operator == "between":
        lo, hi = f.value.split("|")
        return F.coalesce(F.col(f.column).try_cast("double"), F.lit(0.0)).between(float(lo), float(hi))
    return {"=": text == value, "!=": text != value, "like": F.contains(text, value)}[f.operator]


def catalog_rows(df: DataFrame, filters: tuple[Filter, ...], title: str | None) -> DataFrame:
    """Rows that match; if none does and a title is asked for, rows whose title contains it.

    Both tests run in one pass; a global flag (one row) decides between them.
    """
    exact, near = F.lit(True), None
    for f in filters:
        exact = exact & row_condition(df, f)
        if f.column == title and f.operator == "=":
            near = F.contains(norm_text(F.col(title)), norm_text(F.lit(f.value)))
    if near is None:
        return df.filter(exact)
    flags = df.filter(exact).agg((F.count("*") > 0).alias("_any"))
    return df.crossJoin(F.broadcast(flags)).filter(F.when(F.col("_any"), exact).otherwise(near)).drop("_any")


def catalog(plan: Plan, df: DataFrame, profiles: list[Profile]) -> DataFrame:
    title = next((p.name for p in profiles if p.semantic_type == "catalog_title"), None)
    key = next((p.name for p in profiles if p.role == "identifier"), df.columns[0])
    rows = catalog_rows(df, plan.filters, title)
    if plan.intent == "catalog_deadline_report":
        return deadline_report(rows)
    if plan.intent == "catalog_field_lookup":
        rows = rows.select(*dict.fromkeys([key, *([title] if title else []), plan.target]))
    return rows.orderBy(key).limit(plan.limit)


def deadline_report(rows: DataFrame, band: str = "prazo_faixa") -> DataFrame:
    """Count and per cent of each band, largest first."""
    counts = rows.groupBy(band).agg(F.count("*").alias("value"))
    whole = Window.partitionBy()  # over the few bands
    return counts.withColumn("percent", F.col("value") * 100.0 / F.sum("value").over(whole)).orderBy(F.desc("value"), band)


def compare_delta(groups: DataFrame, key: str) -> DataFrame:
    """Leader, runner-up and their difference of compared groups (at most ten rows)."""
    w = Window.orderBy(F.desc_nulls_last("value"), key)
    return groups.withColumn("rank", F.row_number().over(w)).withColumn("next_value", F.lead("value").over(w)).withColumn("delta", F.col("value") - F.col("next_value"))


def ask(df: DataFrame, question: str, hint: str = "", values: dict[str, list[str]] | None = None) -> DataFrame:
    """Question to DataFrame. values: see planner; None looks the question's words up in all values of dimension and text columns."""
    profiles = semantics.measured(df)
    if values is None:
        values = semantics.named_values(df, question, [p.name for p in profiles if p.role in ("dimension", "text")])
    made = planner.plan(question, profiles, values, hint)
    if made is None:
        raise ValueError("pergunta sem plano")
    return compile(planner.validate(made, profiles), df, profiles)
