import pytest

from garimpo.plans import compiler, planner, render, semantics
from garimpo.plans.model import Filter, Plan, plan_from


def _profiles(spark, **columns):
    df = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in columns.items()))
    return semantics.profile(df)


def _clients(spark):
    rows = [(1, "Ana", 35, "1500,50", "Sao Paulo", "SP"), (2, "Bia", 28, "2.500,75", "Campinas", "SP"), (3, "Caio", 51, "2000", "Niteroi", "RJ")]
    return spark.createDataFrame(rows, "id_cliente int, nome string, idade int, renda_mensal string, cidade string, estado string")


@pytest.mark.parametrize("name,share,kind", [("idade", 1, "measure_age_years"), ("quantidade", 1, "measure_number"), ("prazo_autorizacao", 0, "deadline_rule"), ("renda_mensal", 0, "measure_currency"), ("estado", 0, "dimension_geo_state"), ("cod", 1, "measure_number"), ("codigo", 1, "identifier"), ("data_venda", 0, "date"), ("observacao", 0, "catalog_attribute"), ("x", 0, "text")])
def test_semantics(name, share, kind):
    assert semantics.infer(name, share)[0] == kind


@pytest.mark.parametrize("question,intent,extra", [
    ("Qual a media de renda em Sao Paulo com pessoas acima de 30 anos?", "tabular_aggregate", {"aggregation": "avg", "metric": "renda_mensal"}),
    ("Quantos clientes no estado de Sao Paulo?", "tabular_count", {"aggregation": "count"}),
    ("Quais estados existem?", "tabular_distinct", {"dimension": "estado"}),
    ("Quais colunas a tabela tem?", "tabular_schema", {}),
    ("O que significa a coluna renda mensal?", "tabular_describe_column", {"target": "renda_mensal"}),
    ("Top 2 clientes por renda", "tabular_rank", {"limit": 2, "metric": "renda_mensal"}),
    ("Compare a renda por estado", "tabular_compare", {"group_by": ("estado",)}),
    ("Soma da renda por cidade", "tabular_groupby", {"group_by": ("cidade",), "aggregation": "sum"}),
])
def test_questions(spark, question, intent, extra):
    df = _clients(spark)
    made = planner.plan(question, semantics.profile(df), {"cidade": ["Sao Paulo", "Campinas"], "estado": ["SP", "RJ"]})
    assert made.intent == intent
    for k, v in extra.items():
        assert getattr(made, k) == v
    assert not planner.validate(made, semantics.profile(df)).errors


def test_filters_and_answer(spark):
    df = _clients(spark)
    profiles = semantics.profile(df)
    made = planner.plan("Qual a media de renda em Sao Paulo com pessoas acima de 30 anos?", profiles, {"cidade": ["Sao Paulo"]})
    assert set(made.filters) == {Filter("estado", "=", "SP"), Filter("idade", ">", "30")}
    checked = planner.validate(made, profiles)
    rows = [r.asDict() for r in compiler.compile(checked, df, profiles).collect()]
    assert rows == [{"value": 1500.5}] and "1.500,50" in render.answer(checked, rows)
    compared = planner.validate(planner.plan("Compare a renda por estado", profiles), profiles)
    rows = [r.asDict() for r in compiler.compile(compared, df, profiles).collect()]
    assert "Diferenca" in render.answer(compared, rows)


def test_preposition_is_no_state(spark):
    profiles = semantics.profile(_clients(spark))
    assert planner.state_filter("prazo para liberar", profiles) is None
    assert planner.state_filter("clientes do mato grosso do sul", profiles).value == "MS"


def test_validation(spark):
    profiles = _profiles(spark, idade="int", valor="double", nome="string", data_venda="date")
    bad = lambda p: planner.validate(p, profiles).errors
    assert bad(Plan("tabular_aggregate", metric="idade", aggregation="sum"))
    assert not bad(Plan("tabular_aggregate", metric="valor", aggregation="sum"))
    assert bad(Plan("tabular_groupby", metric="valor", aggregation="sum", group_by=("nome",), grain="month"))
    assert bad(Plan("tabular_distinct")) and bad(Plan("catalog_lookup_by_id")) and bad(Plan("tabular_count", filters=(Filter("nao_ha", "=", "1"),)))
    assert plan_from({"operation": "count"}).intent == "tabular_count"
    with pytest.raises(ValueError):
        compiler.compile(planner.validate(Plan("tabular_distinct"), profiles), spark.createDataFrame([], "nome string"), profiles)


def test_catalog(spark):
    rows = [("10101039", "Exame A", "imediato", "sim"), ("20017", "Visita Domiciliar", "ate 10 (dez) dias uteis", "nao"), ("30001", "Parto", "Sem Cobertura", "sim")]
    df = spark.createDataFrame(rows, "codigo string, descricao string, prazo_autorizacao string, emergencia string")
    ask = lambda q: [r.asDict() for r in compiler.ask(df, q, values={}).collect()]
    assert ask("Qual o prazo do codigo 20017?")[0]["prazo_autorizacao"] == "ate 10 (dez) dias uteis"
    assert ask("Mostre o codigo 10101039")[0]["descricao"] == "Exame A"
    report = ask("Gere um relatorio agrupado por faixa de prazo")
    assert {r["prazo_faixa"]: r["value"] for r in report} == {"Imediato": 1, "Ate 10 dias": 1, "Sem Cobertura": 1}
    assert [r["codigo"] for r in ask("Alerta de sla apertado")] == ["10101039"]
    assert len(ask("Compare 10101039 versus 20017")) == 2
    assert [r["codigo"] for r in compiler.catalog_rows(df, (Filter("descricao", "=", "visita"),), "descricao").collect()] == ["20017"]


def test_plans_stay_narrow(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    from garimpo.queries import core_queries

    text = lambda name: core_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text("tab_rank_asc")
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text("tab_groupby")
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text("pricing_summary")
