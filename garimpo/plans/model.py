"""The typed plan between a question and a DataFrame."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

INTENTS = (
    "tabular_aggregate", "tabular_count", "tabular_groupby", "tabular_rank", "tabular_distinct", "tabular_schema", "tabular_describe_column", "tabular_compare",
    "catalog_lookup_by_id", "catalog_lookup_by_title", "catalog_field_lookup", "catalog_record_summary", "catalog_compare", "catalog_filter", "catalog_deadline_report", "catalog_sla_alert",
)
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "like", "in", "between")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: str


@dataclass(frozen=True)
class Profile:
    """What is known of a column."""

    name: str
    data_type: str
    role: str
    semantic_type: str
    unit: str
    aliases: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Plan:
    intent: str
    metric: str | None = None
    target: str | None = None
    dimension: str | None = None
    aggregation: str | None = None
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    limit: int = 1
    grain: str | None = None
    unit: str = ""
    confidence: float = 0.0
    assumptions: tuple[str, ...] = ()
    source: str = "heuristic"
    mode: str = "analytic"
    errors: tuple[str, ...] = field(default=())

    def json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    def but(self, **kw) -> Plan:
        return replace(self, **kw)


#: Intent of a plan that names only an operation.
BY_OPERATION = {
    "count": "tabular_count", "aggregate": "tabular_aggregate", "sum": "tabular_aggregate", "avg": "tabular_aggregate", "min": "tabular_aggregate", "max": "tabular_aggregate",
    "groupby": "tabular_groupby", "group_by": "tabular_groupby", "rank": "tabular_rank", "distinct": "tabular_distinct", "schema": "tabular_schema", "compare": "tabular_compare", "describe_column": "tabular_describe_column",
}


def plan_from(data: dict) -> Plan:
    """A plan from a plain dictionary; the intent may follow from an operation."""
    intent = data.get("intent") or BY_OPERATION.get(data.get("operation", ""), "")
    aggregation = data.get("aggregation") or (data.get("operation") if data.get("operation") in ("sum", "avg", "min", "max", "count") else None)
    return Plan(
        intent=intent, metric=data.get("metric_column"), target=data.get("target_column"), dimension=data.get("dimension_column"), aggregation=aggregation,
        filters=tuple(Filter(f["column"], f.get("operator", "="), str(f["value"])) for f in data.get("filters") or []), group_by=tuple(data.get("group_by") or []),
        limit=int(data.get("limit") or 10), grain=data.get("time_grain"), unit=data.get("expected_unit", ""), confidence=float(data.get("confidence") or 0),
    )
