"""What a column means: ordered name rules, one pass of profiling over all columns, the kind of table."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions.ptbr import plain
from garimpo.functions.text import ACCENTED, BARE
from garimpo.plans.model import Profile

# Name rules in order: pattern, type, unit, description.
RULES = (
    (r"^id$|^id_|_id$|codigo|code|chave|key|procedimento|matricula|registro", "identifier", "text", "Identificador da linha ou entidade."),
    (r"data|date", "date", "date", "Data ou referencia temporal."),
    (r"hora|timestamp|criado_em", "datetime", "datetime", "Data e hora do evento ou atualizacao."),
    (r"descricao|descr|titulo|title|nome_item|nome_produto|produto_nome|item_nome|servico|service|sku_name", "catalog_title", "text", "Titulo ou descricao principal do registro."),
    (r"cobertura", "coverage_rule", "text", "Regra de cobertura do item ou procedimento."),
    (r"prazo|deadline", "deadline_rule", "text", "Prazo ou janela operacional associada ao registro."),
    (r"autoriz", "authorization_rule", "text", "Regra ou orientacao de autorizacao."),
    (r"estado|(?:^|_)uf(?:$|_)", "dimension_geo_state", "text", "Dimensao geografica de unidade federativa."),
    (r"cidade|municipio", "dimension_geo_city", "text", "Dimensao geografica de cidade."),
    (r"cliente|pessoa|usuario|paciente|beneficiario|cooperado|aluno|funcionario|colaborador|nome", "dimension_person", "text", "Entidade ou pessoa identificada na tabela."),
    (r"empresa|fornecedor|prestador|hospital|clinica|organizacao|instituicao", "dimension_organization", "text", "Organizacao ou entidade de negocio."),
    (r"status|situacao", "dimension_status", "text", "Dimensao de status ou situacao."),
    (r"segmento|segmentacao|categoria|tipo|canal|departamento", "dimension_category", "text", "Dimensao categorica de negocio."),
    (r"percent|taxa|aliquota|pct", "measure_percentage", "percent", "Medida percentual."),
    (r"emergencia|urgencia|ativo|flag|boolean|is_|tem_|possui_", "flag_boolean", "boolean", "Indicador booleano."),
    (r"(?:^|_)(?:idade|age)(?:$|_)", "measure_age_years", "anos", "Medida de idade em anos."),
    (r"renda|salario|faturamento|receita|valor|preco|price|amount|custo", "measure_currency", "brl", "Medida monetaria."),
    (r"score|nota|pontuacao", "measure_score", "pontos", "Score ou pontuacao."),
)
LATE_RULE = (r"observacao|orientacao|regra|campo", "catalog_attribute", "text", "Atributo textual do registro.")
NUMERIC_SHARE = 0.8

SUMS = frozenset({"sum", "avg", "min", "max"})
#: Aggregations of each type besides count.
ALLOWED = {"measure_currency": SUMS, "measure_number": SUMS, "measure_age_years": SUMS - {"sum"}, "measure_score": SUMS - {"sum"}, "measure_percentage": SUMS - {"sum"}}

# Portuguese words for the English column names of the demonstration tables.
ALIASES = {"totalprice": ("valor", "receita", "faturamento"), "extendedprice": ("valor", "receita"), "orderdate": ("data",), "shipdate": ("data",), "orderstatus": ("status", "situacao"), "mktsegment": ("segmento",), "orderpriority": ("prioridade",), "quantity": ("quantidade",), "discount": ("desconto",), "acctbal": ("saldo",), "retailprice": ("preco",), "name": ("nome",), "type": ("tipo",), "brand": ("marca",)}


def name_of(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", plain(text)).strip("_")


def infer(name: str, numeric_share: float) -> tuple[str, str, str]:
    """(semantic type, unit, description) of a column."""
    n = name_of(name)
    for pattern, kind, unit, text in RULES:
        if re.search(pattern, n):
            return kind, unit, text
    if numeric_share >= NUMERIC_SHARE:
        return "measure_number", "number", "Medida numerica generica."
    if re.search(LATE_RULE[0], n):
        return LATE_RULE[1:]
    return "text", "text", "Campo textual generico."


def role_of(kind: str) -> str:
    if kind == "identifier":
        return "identifier"
    if kind in ("date", "datetime"):
        return "date"
    if kind.startswith("dimension_") or kind == "flag_boolean":
        return "dimension"
    return "metric" if kind.startswith("measure_") else "text"


def aliases_of(name: str) -> tuple[str, ...]:
    """The name, its spaced and joined forms, its parts of three letters or more, and translations."""
    n = name_of(name)
    parts = n.split("_")
    short = "_".join(parts[1:]) if len(parts) > 1 and len(parts[0]) <= 2 else n
    found = [n, n.replace("_", " "), n.replace("_", ""), short, *parts, *ALIASES.get(short, ())]
    return tuple(dict.fromkeys(a for a in found if len(a) >= 3))


def numeric_like(c) -> F.Column:
    return F.trim(c.cast("string")).rlike(r"^-?(?:\d+|\d{1,3}(?:\.\d{3})+)(?:[.,]\d+)?(?:[eE][-+]?\d+)?$")


def shares(df: DataFrame) -> DataFrame:
    """column_name, filled, numeric_share, cardinality of every column, in one pass."""
    cols = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])).alias("x")).select("x.*").filter(F.trim("v") != "")
    # Values first: the distinct count is then a count of groups, with partial sums before the shuffle.
    by_value = long.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    sums = by_value.groupBy("column_name").agg(F.sum("n").alias("filled"), (F.sum(F.when(numeric_like(F.col("v")), F.col("n")).otherwise(0)) / F.sum("n")).alias("numeric_share"), F.count("*").alias("cardinality"))
    return sums


def numeric_shares(df: DataFrame) -> dict[str, float]:
    """Share of numbers among the filled values of each text column: one aggregation over all rows, no values shuffled."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return {}
    filled = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != ""
    sums = [x for i, c in enumerate(names) for x in (F.sum(filled(c).cast("long")).alias(f"n{i}"), F.sum((filled(c) & numeric_like(F.col(f"`{c}`"))).cast("long")).alias(f"k{i}"))]
    row = df.agg(*sums).first()
    return {c: (row[f"k{i}"] or 0) / row[f"n{i}"] for i, c in enumerate(names) if row[f"n{i}"]}


def measured(df: DataFrame, examples: int = 0) -> list[Profile]:
    """Profiles of the columns with the numeric shares of their values; examples: so many of the first fifty rows' values each."""
    found = profile(df, numeric_shares(df))
    if not examples:
        return found
    rows = df.select(*[F.col(f"`{p.name}`").cast("string") for p in found]).limit(50).collect()
    shown = {p.name: tuple(dict.fromkeys(v for r in rows if (v := r[i]) and v.strip()))[:examples] for i, p in enumerate(found)}
    return [replace(p, examples=shown[p.name]) for p in found]


def of_records(records: DataFrame, fields: str = "fields") -> list[Profile]:
    """Profiles of records that hold their columns in a map: its distinct names become columns."""
    names = sorted(r[0] for r in records.select(F.explode(F.map_keys(fields))).distinct().collect())  # a table's columns
    return measured(records.select(*[F.try_element_at(fields, F.lit(n)).alias(n) for n in names]))


def named_values(df: DataFrame, question: str, columns: list[str], longest: int = 8) -> dict[str, list[str]]:
    """The values of the columns that the question names, looked up among all rows.

    The question's runs of up to ``longest`` words are the keys; at most their spellings come back.
    """
    words = plain(question).replace("?", " ").split()
    keys = {" ".join(words[i : i + n]).strip(" .,;:!?") for n in range(1, longest + 1) for i in range(len(words) - n + 1)}
    if not columns or not keys:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    # Plain form as the keys have it: accents off, lower case.
    form = F.lower(F.translate(F.trim("v"), ACCENTED, BARE))
    fits = F.length(F.trim("v")) <= max(map(len, keys))
    out: dict[str, list[str]] = {}
    for c, v in sorted(((r["c"], r["v"]) for r in long.filter(fits & form.isin(sorted(keys))).distinct().collect()), key=lambda x: (x[0], -len(x[1]), x[1])):
        out.setdefault(c, []).append(v)
    return out


#: What a filter's name may mean.
MEANINGS = {
    "codigo": "identifier", "code": "identifier", "id": "identifier", "cobertura": "coverage_rule", "autorizacao": "authorization_rule", "prazo": "deadline_rule", "descricao": "catalog_title", "titulo": "catalog_title",
}


def filter_column(key: str, profiles: list[Profile]) -> str | None:
    """The column that a filter's name means: by name, by meaning, else by an alias (either within the other)."""
    name = name_of(key)
    by_name = {name_of(p.name): p.name for p in profiles}
    if name in by_name:
        return by_name[name]
    meant = next((p.name for p in profiles if p.semantic_type == MEANINGS.get(name)), None)
    return meant or next((p.name for p in profiles if any(a and (name in a or a in name) for a in p.aliases)), None)


def lookup(df: DataFrame, filters: dict[str, str], limit: int = 20, profiles: list[Profile] | None = None) -> DataFrame:
    """Rows whose columns contain all the given texts; names that mean no column are left out of account."""
    known = profiles or measured(df)
    for key, v in filters.items():
        if column := filter_column(key, known):
            df = df.filter(F.contains(F.lower(F.col(f"`{column}`").cast("string")), F.lit(str(v).strip().lower())))
    return df.limit(max(1, limit))


def value_catalog(df: DataFrame, columns: list[str], most: int = 25) -> DataFrame:
    """column_name, raw_value, frequency: the most frequent values of each column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("raw_value")) for c in columns])).alias("x")).select("x.*").filter(F.trim("raw_value") != "")
    counts = long.groupBy("column_name", "raw_value").agg(F.count("*").alias("frequency"))
    w = Window.partitionBy("column_name").orderBy(F.desc("frequency"), "raw_value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def profile(df: DataFrame, numeric: dict[str, float] | None = None) -> list[Profile]:
    """Profiles of the columns. Numeric shares come from the types where these tell, else from ``shares``."""
    out = []
    for f in df.schema:
        share = (numeric or {}).get(f.name)
        if share is None:
            share = 1.0 if isinstance(f.dataType, T.NumericType) else 0.0
        kind, unit, text = infer(f.name, share)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) and kind == "text":
            kind, unit, text = "datetime", "datetime", "Data e hora do evento ou atualizacao."
        physical = "date" if role_of(kind) == "date" else "text" if kind == "identifier" else "numeric" if share >= NUMERIC_SHARE else "text"
        out.append(Profile(f.name, physical, role_of(kind), kind, unit, aliases_of(f.name), (), text))
    return out


CATALOG_WORDS = ("procedimento", "descricao", "cobertura", "autorizacao", "prazo", "segmentacao", "rol", "codigo")


def table_kind(profiles: list[Profile], hint: str = "") -> str:
    kinds = [p.semantic_type for p in profiles]
    ids, titles = kinds.count("identifier"), kinds.count("catalog_title")
    attributes = sum(k in ("catalog_attribute", "coverage_rule", "authorization_rule", "deadline_rule") for k in kinds)
    metrics, dates = sum(k.startswith("measure_") for k in kinds), sum(k in ("date", "datetime") for k in kinds)
    dims = sum(k.startswith("dimension_") or k == "flag_boolean" for k in kinds)
    if ids and (titles or attributes >= 2) and (attributes >= 2 or metrics <= 1):
        return "catalog"
    named = sum(any(w in name_of(p.name) for w in CATALOG_WORDS) for p in profiles)
    if ids and named >= 2 and any(w in name_of(hint).replace("_", " ") for w in CATALOG_WORDS):
        return "catalog"
    if dates and metrics:
        return "transactional" if dims else "time_series"
    return "mixed" if dates and dims >= 2 else "analytic"


# Nouns that name the rows, first match counts.
SUBJECTS = ("clientes", "colaboradores", "funcionarios", "pedidos", "vendas", "transacoes", "atendimentos", "procedimentos", "codigos", "itens")
SINGULAR = {"transacoes": "transacao", "itens": "item", "colaboradores": "colaborador"}


def subject_label(question: str, hint: str = "") -> str:
    text = plain(f"{question} {hint}")
    for plural in SUBJECTS:
        if re.search(rf"\b(?:{plural}|{SINGULAR.get(plural, plural[:-1])})\b", text):
            return plural
    return "registros"
