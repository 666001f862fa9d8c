"""Answers in Portuguese from the few rows of a result."""

from __future__ import annotations

from garimpo.plans.model import Plan, Profile

LEADS = {"count": "A quantidade{s} e", "sum": "A {m} total{s} e", "avg": "A {m} media{s} e", "max": "O maior valor de {m}{s} e", "min": "O menor valor de {m}{s} e"}
DRESS = {"brl": "R$ {}", "anos": "{} anos", "pontos": "{} pontos", "percent": "{}%"}


def value_text(value, unit: str) -> str:
    if value is None:
        return "sem resultado"
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    if unit == "count":
        return str(round(number))
    text = f"{number:,.2f}".translate(str.maketrans(",.", ".,"))
    return DRESS.get(unit, "{}").format(text)


def scope_text(plan: Plan) -> str:
    words = {"=": "", "!=": "diferente de ", ">": "acima de ", "<": "abaixo de ", ">=": "a partir de ", "<=": "ate ", "like": "contendo ", "in": "em ", "between": "entre "}
    parts = [f"{f.column} {words[f.operator]}{f.value.replace('|', ' e ')}" for f in plan.filters]
    return " com " + ", ".join(parts) if parts else ""


KINDS = {"codigo": "identifier", "titulo": "catalog_title", "cobertura": "coverage_rule", "prazo": "deadline_rule", "autorizacao": "authorization_rule"}
GRAINS = {"day": "dia", "month": "mes", "year": "ano"}


def field_of(record: dict, profiles: list[Profile], what: str) -> str:
    """The filled value of a record for a catalog field, by the columns' meaning, else by their names."""
    meant = [p.name for p in profiles if p.semantic_type == KINDS.get(what)] + [k for k in record if what in k.lower()]
    return next((str(record[k]) for k in meant if record.get(k) not in (None, "")), "")


def record_text(record: dict, profiles: list[Profile]) -> str:
    """Code, title and rules of a catalog record."""
    code, title = field_of(record, profiles, "codigo"), field_of(record, profiles, "titulo") or field_of(record, profiles, "descricao")
    rules = [f"{k.capitalize()}: {v}." for k in ("cobertura", "segmentacao", "emergencia", "prazo", "autorizacao") if (v := field_of(record, profiles, k))]
    return " ".join([f"{' - '.join(x for x in (code, title) if x)}.", *rules])


def compare_text(left: dict, right: dict, profiles: list[Profile]) -> str:
    """Where two catalog records differ in their rules."""
    pairs = [(k, field_of(left, profiles, k), field_of(right, profiles, k)) for k in ("cobertura", "prazo", "autorizacao")]
    apart = [f"{k}: {a} / {b}" for k, a, b in pairs if a and b and a != b]
    return "Diferem em " + "; ".join(apart) + "." if apart else "As regras preenchidas de ambos coincidem."


def query_text(plan: Plan) -> str:
    """What the plan computes, in one line."""
    parts = [plan.intent, f"{plan.aggregation}({plan.metric or '*'})" if plan.aggregation else "", f"por {', '.join(plan.group_by)}" if plan.group_by else "", scope_text(plan).strip(), f"limite {plan.limit}" if plan.limit > 1 else ""]
    return " | ".join(p for p in parts if p)


def preview(rows: list[dict], most: int = 5) -> str:
    """The first rows in one line."""
    return "; ".join(", ".join(f"{k}={v}" for k, v in r.items() if v is not None) for r in rows[:most])


def answer(plan: Plan, rows: list[dict], profiles: list[Profile] = ()) -> str:
    """rows: the collected result, which is at most the plan's limit."""
    if not rows:
        return "Nao encontrei registros para esta pergunta."
    said = _answer(plan, rows, list(profiles))
    return said + (f" Criterio: {'; '.join(plan.assumptions)}." if plan.assumptions else "")


def _answer(plan: Plan, rows: list[dict], profiles: list[Profile]) -> str:
    metric = (plan.metric or "registros").replace("_", " ")
    if plan.intent in ("tabular_count", "tabular_aggregate"):
        lead = LEADS.get(plan.aggregation or "", "O resultado de {m}{s} e").format(m=metric, s=scope_text(plan))
        return f"{lead} {value_text(rows[0]['value'], plan.unit)}."
    if plan.intent in ("tabular_groupby", "tabular_compare"):
        lines = [f"- {' / '.join(str(r[c]) for c in plan.group_by)}: {value_text(r['value'], plan.unit)}" for r in rows]
        if plan.intent == "tabular_compare" and len(rows) > 1 and None not in (rows[0]["value"], rows[1]["value"]):
            lines.append(f"Diferenca entre os dois primeiros: {value_text(rows[0]['value'] - rows[1]['value'], plan.unit)}")
        head = f"{metric} por {GRAINS[plan.grain]}" if plan.grain in GRAINS else f"{metric} por {', '.join(plan.group_by)}"
        return "\n".join([f"{head}{scope_text(plan)}:", *lines])
    if plan.intent == "tabular_distinct":
        return f"Valores de {plan.dimension}: " + ", ".join(str(r["value"]) for r in rows)
    if plan.intent == "tabular_schema":
        return "Colunas: " + ", ".join(f"{r['column_name']} ({r['semantic_type']})" for r in rows)
    if plan.intent == "tabular_describe_column":
        return f"{rows[0]['column_name']}: {rows[0]['description']}"
    if plan.intent == "tabular_rank":
        return "\n".join(f"{i}. " + ", ".join(str(v) for k, v in r.items() if k != "value") + f": {value_text(r['value'], plan.unit)}" for i, r in enumerate(rows, 1))
    if plan.intent == "catalog_deadline_report":
        return "\n".join([*(f"- {r['prazo_faixa']}: {r['value']} ({r['percent']:.1f}%)" for r in rows), f"Total: {sum(r['value'] for r in rows)}"])
    if plan.intent == "catalog_field_lookup":
        value = rows[0].get(plan.target)
        return f"{record_text(rows[0], profiles).split('.')[0]}, {(plan.target or '').replace('_', ' ')}: {value}." if profiles and value else str(value or "sem informacao")
    if plan.intent == "catalog_compare" and len(rows) > 1:
        return f"{record_text(rows[0], profiles)} | {record_text(rows[1], profiles)} {compare_text(rows[0], rows[1], profiles)}"
    if plan.intent in ("catalog_lookup_by_id", "catalog_lookup_by_title", "catalog_record_summary") and profiles:
        return record_text(rows[0], profiles)
    if plan.intent in ("catalog_filter", "catalog_sla_alert") and profiles:
        return f"{len(rows)} registros: " + "; ".join(" - ".join(x for x in (field_of(r, profiles, "codigo"), field_of(r, profiles, "titulo"), field_of(r, profiles, "prazo")) if x) for r in rows[:7])
    return "\n".join("; ".join(f"{k}: {v}" for k, v in r.items() if v not in (None, "")) for r in rows)
