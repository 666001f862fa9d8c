"""Units and schema drift."""

import pytest

from garimpo.operators import schema_drift as D
from garimpo.operators import units as U

CASES = [
    ("até 10 (dez) dias úteis", None, None, ("uteis", 14400)), ("Urgência - imediato", None, None, ("corridos", 0)), ("Em até 3 (três) meses", 3, "horas", ("corridos", 129600)),
    ("entre 5 e 10 du", 240, None, ("uteis", 14400)), ("1,5 semana", None, None, ("corridos", 15120)), ("2 dias e 6 horas", 2, "dias", ("corridos", 3240)), ("uma hora e meia", None, None, ("corridos", 90)),
    ("meio dia corrido", None, None, ("corridos", 720)), ("1 1/2 hora", 1, None, ("corridos", 90)), ("2x24h", None, None, ("corridos", 2880)), ("Item 6.16: obs.: ATÉ 5 dias uteis", None, None, ("uteis", 7200)),
    ("Para menores de 18 anos: 4 d.u.", None, None, ("uteis", 5760)), ("até 4 sessões por ano civil", None, None, None), ("Norma 296/2021: 30 DIAS ÚTEIS", None, None, ("uteis", 43200)), ("prazo em dias úteis", 15, None, ("uteis", 21600)),
    ("até 9", 9, "mes", ("corridos", 388800)), ("ver tabela", 29, "?", None), (None, 7, "dias", ("corridos", 10080)), ("", None, "imediato", ("corridos", 0)), ("conforme contrato", 48, "HORAS", ("corridos", 2880)),
    ("de 48 a 96 h", 48, "dias", ("corridos", 5760)), ("3-7 D", None, None, ("corridos", 10080)), ("vinte e um dias", None, None, ("corridos", 30240)), ("5 diass corridos", None, None, ("corridos", 7200)), ("10 dais uteis", None, None, ("uteis", 14400)),
    ("até 24 autorizacao obrigatoria", 24, "hs", ("corridos", 1440)), ("somente maiores de 60 anos", None, None, None), ("1 trimestre", None, None, ("corridos", 129600)), ("x" * 50_000 + " 2 dias", None, None, ("corridos", 2880)),
]


def test_units(spark):
    rows = [(i, t, d, u, "b") for i, (t, d, u, _) in enumerate(CASES)] + [(0, *CASES[0][:3], "b"), (None, "2 dias", None, None, "b")]
    df = spark.createDataFrame(rows, "deadline_id long, raw_text string, days int, unit string, basis string")
    got = {r.deadline_id: (r.basis, r.minutes) for r in U.to_minutes(df).collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES) if c[3]}
    assert U.to_minutes(df.limit(0)).count() == 0


def test_salted_dictionary(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"{i % 9 + 1} dias", None, None) for i in range(200)], "deadline_id long, raw_text string, days int, unit string")
    want = U.to_minutes(df).collect()
    monkeypatch.setattr(U, "DICTIONARY_ROWS", 0)
    assert sorted(U.to_minutes(df).collect()) == sorted(want)


@pytest.mark.parametrize("values,kind", [(["1", "2", "3.000"], "integer"), (["1,5", "2"], "decimal"), (["7721.99"], "decimal"), (["2024-01-02", "03/04/2020", "25.12.2023"], "date"), (["sim", "NÃO", "s", "false"], "boolean"), (["1"] * 9 + ["x"], "integer"), (["1"] * 8 + ["x"] * 2, "text"), ([], None)])
def test_types(values, kind):
    assert D.narrowest(values) == kind


FIELDS = "extraction_id long, series_id string, family string, reference_month string, column_names array<string>, records array<struct<row_index int, fields map<string,string>>>, fingerprint string"


def _file(i, month, names, rows, series="s1"):
    return (i, series, "f", month, names, [(k, dict(zip(names, r))) for k, r in enumerate(rows)], "x")


def test_schema_drift(spark):
    ids = [str(1000 + i) for i in range(12)]
    a = [(x, f"{i},50", ["sim", "não"][i % 2], f"t{i}") for i, x in enumerate(ids)]
    b = [(x, f"{i}.50", ["true", "false"][i % 2], f"t{i}") for i, x in enumerate(ids)][::-1]
    c = [(x, str(i), f"z{i}") for i, x in enumerate(ids)]
    files = [
        _file(1, "2024-01", ["Id Venda", "Valor Total ", "Ativo", "obs"], a), _file(2, "2024-02", ["id_venda", "preço", "ATIVO", "obs"], b), _file(3, "2024-04", ["pedido", "preco", "nota"], c),
        _file(2, "2024-02", ["id_venda", "preço", "ATIVO", "obs"], b), _file(4, "2024-05", [], []), _file(5, None, ["q"], []), _file(6, "2024-01", ["a"], [("1",)], "s2"),
    ]
    df = spark.createDataFrame(files, FIELDS)
    got = {(r.extraction_id, r.change_kind, r.old_name, r.new_name) for r in D.found_changes(df).collect()}
    assert got == {
        (2, "renamed", "valor_total", "preco"), (3, "renamed", "id_venda", "pedido"), (3, "removed", "ativo", ""), (3, "removed", "obs", ""), (3, "added", "", "nota"), (3, "type_changed", "preco", "preco"),
        (4, "removed", "pedido", ""), (4, "removed", "preco", ""), (4, "removed", "nota", ""),
    }
    rows = D.unified(df).filter("series_id = 's1'").collect()
    assert len(rows) == 36 and {k for r in rows for k, v in r.fields.items() if v is not None} == {"id_venda", "valor_total", "ativo", "obs", "nota"}
    assert all("a" in r.fields for r in rows)  # a column of the family that the series lacks
    assert {r.fields["id_venda"] for r in rows if r.extraction_id == 3} == set(ids)
    history = {r.extraction_id: r.version for r in D.versions(df).filter("series_id = 's1'").collect()}
    assert history == {1: 1, 2: 2, 3: 3, 4: 4}
    assert D.found_changes(df.limit(0)).count() == 0
    wide = D.family_table(df, "f").filter("extraction_id = 2")
    assert dict(wide.dtypes)["valor_total"] == "double" and wide.agg({"valor_total": "max"}).first()[0] == 11.5


def test_family_over_series(spark):
    """Series that begin with different spellings of a column come into one; a name used anew does not."""
    ids = [str(7000 + i) for i in range(12)]
    x = [(i, str(100 + k)) for k, i in enumerate(ids)]
    y = [(i, f"{100 + k},5", "a") for k, i in enumerate(ids)]
    files = [
        _file(1, "2024-01", ["id", "preco"], x), _file(2, "2024-02", ["id", "valor"], x),  # preco becomes valor
        _file(3, "2024-01", ["id", "valor", "nota"], y, "s2"),  # begins as valor
        _file(4, "2024-03", ["id", "nota", "obs"], [(i, "t", "x-1") for i in ids], "s3"), _file(5, "2024-04", ["id", "nota"], [(i, "t") for i in ids], "s3"),
    ]
    df = spark.createDataFrame(files, FIELDS)
    wide = D.family_table(df, "f", {"nota": "sem"})
    assert set(wide.columns) - {"series_id", "reference_month", "extraction_id", "row_index", "version"} in ({"id", "preco", "nota", "obs"}, {"id", "valor", "nota", "obs"})
    price = "valor" if "valor" in wide.columns else "preco"
    kinds = dict(wide.dtypes)
    assert kinds["id"] == "bigint" and kinds[price] == "double"
    rows = wide.collect()
    assert len(rows) == 60 and sum(r[price] is not None for r in rows) == 36 and {r.nota for r in rows if r.extraction_id == 1} == {"sem"}
    rules = {r.version: r for r in D.version_rules(df).collect()}
    assert len(rules) == 5 and all(r.casts["id"] == "integer" for r in rules.values())
    bad = spark.createDataFrame([_file(1, "2024-01", ["id", "n"], [(i, str(k)) for k, i in enumerate(ids[:11])] + [("7011", "n/a x")])], FIELDS)
    assert [r.misfits for r in D.unified(bad).collect() if r.misfits] == [{"n": "n/a x"}]
    assert D.unified(df.limit(0)).count() == 0
