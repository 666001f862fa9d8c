"""Ingestion, catalogs, summaries, suites, semantics, stored tables."""

import json

import pytest
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.operators import blocks as B
from garimpo.operators import catalog as C
from garimpo.operators import chunking as K
from garimpo.operators import evaluation as E
from garimpo.operators import ingest as I
from garimpo.operators import store as T
from garimpo.operators import summaries as S
from garimpo.plans import compiler, planner, render, semantics
from garimpo.plans.model import Filter, Plan, Profile

BLOCK = "doc string, page int, seq int, block_key long, text string, kind string"


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def law(spark):
    texts = ["TÍTULO I", "CAPÍTULO I - DO OBJETO", "Art. 1 O objeto.", "segue o texto", "Art. 2 Outra regra.", "CAPÍTULO II", "SEÇÃO I - DAS PARTES", "Art. 3 As partes, conforme Art. 1.", "TÍTULO II", "solto", "Art. 4 Fim.", None]
    rows = [("d", i // 4 + 1, i, 100 + i, t, "body") for i, t in enumerate(texts)] + [("leer", 1, 0, 500, "nada", "body"), (None, None, None, 501, "Art. 9", "body")]
    return spark.createDataFrame(rows, BLOCK)


@pytest.mark.parametrize("stretch", [2, 512])
def test_structures_and_articles(spark, law, monkeypatch, stretch):
    monkeypatch.setattr(B, "STRETCH", stretch)
    got = {(r.kind, r.numeral): (r.start, r.end, sorted(r.articles)) for r in I.structures(law).filter("doc = 'd'").collect()}
    assert got == {
        ("titulo", "I"): (0, 8, ["Art. 1", "Art. 2", "Art. 3"]), ("capitulo", "I"): (1, 5, ["Art. 1", "Art. 2"]), ("capitulo", "II"): (5, 8, ["Art. 1", "Art. 3"]),
        ("secao", "I"): (6, 8, ["Art. 1", "Art. 3"]), ("titulo", "II"): (8, None, ["Art. 4"]),
    }
    arts = {r.article: (r.start, r.end, r.titulo, r.capitulo, r.secao, r.text) for r in I.articles(law).filter("doc = 'd'").collect()}
    assert arts["1"] == (2, 4, "TÍTULO I", "CAPÍTULO I - DO OBJETO", "", "Art. 1 O objeto.\n\nsegue o texto")
    assert arts["3"][3:5] == ("CAPÍTULO II", "SEÇÃO I - DAS PARTES") and arts["4"][2:5] == ("TÍTULO II", "CAPÍTULO II", "") and set(arts) == {"1", "2", "3", "4"}
    found = I.structures(law)
    assert I.containing(found, "capitulo", "2", "3").first().holds is True and I.containing(found, "capitulo", "1", "3").first().holds is False
    assert I.located(found, "capitulo", last=True).first().numeral == "II" and I.structure_list(found, "titulo").first().labels == ["TÍTULO I", "TÍTULO II"]
    assert I.exact_article(I.articles(law), "2").first().text == "Art. 2 Outra regra."
    assert I.structures(law.limit(0)).count() == 0 and I.articles(law.limit(0)).count() == 0


def test_chunk_texts(spark):
    lit = F.lit
    assert _one(spark, I.contextual(lit("d1"), lit("A > B"), lit(""), lit("corpo")))[0] == "[Documento: d1]\n[Caminho: A > B]\ncorpo"
    assert _one(spark, I.with_breadcrumb(F.array(lit("A"), lit(""), lit("B")), lit("t")))[0] == "[A > B]\nt"
    assert _one(spark, I.row_text(F.array(lit("a"), lit("b")), F.array(lit("1"), lit(" "))))[0] == "a: 1"
    assert _one(spark, I.flat_fields(F.create_map(lit("Código X"), lit("1"), lit("--"), lit("2"))))[0] == {"f_c_digo_x": "1"}
    assert [_one(spark, I.document_type(lit(f), lit(s), lit("narrative")))[0] for f, s in (("legal", ".csv"), (None, ".XLSX"), (" Mixed", ".pdf"), ("", ".pdf"))] == ["legal", "tabular", "mixed", "narrative"]
    assert _one(spark, I.without_tables(lit("a\n| x |\nb")))[0] == "a\nb"
    rows = spark.createDataFrame([(1, 0, "r1"), (1, 1, "r2")], "k long, nth int, text string")
    prose = spark.createDataFrame([(1, 0, "p"), (2, 0, "q")], "k long, nth int, text string")
    assert [tuple(r) for r in I.mixed(rows, prose, "k").orderBy("k", "chunk_index").collect()] == [(1, 0, "mixed_tabular", "r1"), (1, 1, "mixed_tabular", "r2"), (1, 2, "mixed_narrative", "p"), (2, 0, "mixed_narrative", "q")]


def test_row_chunks_keep_whole_rows(spark):
    files = spark.createDataFrame([(1, ["a", "b"], [(0, "x" * 700), (1, "y" * 20)])], "extraction_id long, column_names array<string>, records array<struct<row_index int, texto_canonico string>>")
    cut = K.tabular(files).collect()
    assert [len(r.text) for r in cut] == [512, 20]
    whole = K.tabular(files, header=True, whole=True).orderBy("row_start").collect()
    assert sum(r.text.count("x") for r in whole) == 700 and max(len(r.text) for r in whole) <= 512 and all(r.text.startswith("colunas: a | b\n") for r in whole)


def test_text_values(spark):
    marks = "Nº/Rev.: 3 - Este documento faz parte do acervo\nCorpo (Baixado por Ana) fim"
    assert _one(spark, X.strip_page_marks(F.lit(marks)))[0] == "Corpo fim"
    assert _one(spark, X.sentences(F.lit("A Casa S.A. paga. Ver Art. 5. Fim")))[0] == ["A Casa S.A. paga.", "Ver Art. 5.", "Fim"]
    block = "Um parágrafo repetido com mais de quarenta letras."
    assert _one(spark, X.unique_blocks(F.lit("\n\n".join([block, "curto", "curto", block.upper(), "Outro parágrafo com mais de quarenta letras!"]))))[0] == "\n\n".join([block, "curto", "curto", "Outro parágrafo com mais de quarenta letras!"])


CONFIG = C.Config(aliases={"codigo": ("Cód.",), "descricao": ("procedimento",)}, start_after="inicio da tabela", stop_after="fim da tabela")


def test_catalog(spark):
    raw = spark.createDataFrame(
        [("a", 0, ["Cód. ", "Procedimento", "Emergência"]), ("a", 1, ["10101039", " Exame  A", "sim"]), ("a", 2, [None, "", ""]), ("a", 3, ["", "sem codigo", "x"]), ("b", 0, ["9", "8", "7"]), ("a", 4, ["10101040", "Exame B de sangue", "nao"]), ("a", 5, ["10101039", "Exame A longo", "sim"])],
        "source string, row_no int, cells array<string>",
    )
    fields = C.normalised(raw, CONFIG)
    made = C.records(fields, CONFIG)
    assert {(r.codigo, r.descricao, r.fields["emergencia"], r.fields["precisa_autorizacao"]) for r in made.collect()} == {("10101039", "Exame A", "sim", ""), ("10101040", "Exame B de sangue", "nao", ""), ("10101039", "Exame A longo", "sim", "")}
    kept = C.unique(made)
    assert {r.codigo: r.descricao for r in kept.collect()} == {"10101039": "Exame A longo", "10101040": "Exame B de sangue"}
    assert [r.codigo for r in C.ask(kept, "o codigo 10101040?", CONFIG).collect()] == ["10101040"]
    assert [r.codigo for r in C.ask(kept, "exame em emergencia", CONFIG).collect()] == ["10101039"]
    assert [r.codigo for r in C.ask(kept, "Sangue", CONFIG).collect()] == ["10101040"] and C.search(kept, "nada disto").count() == 0
    assert C.answer([]) == C.NOTHING and "10101040" in C.answer(C.lookup(kept, "1010.1040").collect())
    assert {tuple(r) for r in C.report(raw, made, kept).collect()} == {("a", 6, 3, 2), ("b", 1, 0, 0)}
    assert C.records(C.normalised(raw.limit(0), CONFIG), CONFIG).count() == 0


def test_catalog_lines(spark):
    lines = ["capa", "Início da Tabela", "código", "descricao", "emergencia", "precisa autorizacao", "1001", "Exame", "sim", "nao", "1002", "Exame longo", "em duas linhas", "nao", "sim", "Fim da tabela", "1003"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "source string, line_no int, line string")
    kept = C.trimmed_lines(df, CONFIG)
    assert [r.line for r in kept.orderBy("line_no").collect()] == lines[6:15]
    rows = C.stitched_rows(kept.filter("line_no > 5"), 4, r"^\d{4}$").orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["1001", "Exame", "sim", "nao"], ["1002", "Exame longo em duas linhas", "nao", "sim"]]
    scores = [_one(spark, C.code_match(F.lit(t), F.lit("123")))[0] for t in ("123", "123 - x", "o 123 y", "1234", "")]
    assert scores == [100, 80, 50, 0, 0]


def test_summaries(spark):
    text = "\n\n".join(f"Parágrafo {i}. " + "a" * 400 for i in range(10))
    assert all(len(p) <= 1000 for p in S.parts(text, 1000)) and "\n\n".join(S.parts(text, 1000)) == text and S.parts("x", 10) == ["x"] and S.parts(None) == [""]
    assert S.read_json('```json\n{"a": 1}\n```') == {"a": 1} and S.read_json('veja: {"a": 2} fim') == {"a": 2} and S.read_json("nada") == {}
    assert S.checked({"points": "x"})[1] and S.checked({"executive": " e ", "points": [" a ", ""]})[0]["points"] == ["a"]
    nodes = spark.createDataFrame([(1, "L", "P", ["1", "Art. 2"], "Um. Dois; Três: Quatro. Cinco. Seis."), (2, "M", None, None, None), (3, "N", "P", [], text)], "node_key long, label string, path string, articles array<string>, text string")
    rows = {r.node_key: r for r in S.summarise(nodes, size=1000).collect()}
    assert (rows[1].executive, rows[1].legal, rows[1].articles) == ("Um. Dois;", "Um. Dois; Três: Quatro.", ["Art. 1", "Art. 2"]) and rows[2].executive == "" and rows[3].parts == 5
    model = lambda label, path, part: json.dumps({"executive": f"{label}{len(part)}", "points": ["P", "p"]}) if label != "L" else "?"
    told = {r.node_key: r for r in S.summarise(nodes, model=model, least=1, size=1000).collect()}
    assert told[1].status == "invalid" and told[3].status == "generated" and told[3].points == ["P"] and told[3].executive.count("N") == 5 and 2 not in told
    full = S.summarise(nodes).join(nodes.select("node_key", "label", "path"), "node_key").select("node_key", S.context().alias("c"))
    assert full.filter("node_key = 1").first().c.startswith("=== L ===\nCaminho: P\n\nResumo executivo:\nUm. Dois;")


def test_suites(spark):
    cases = [{"question": "a", "expected_metric": "m", "expected_unit": "brl"}, {"question": "b", "expected_intent": "tabular_schema"}, {"question": "c", "expected_intent": "catalog_filter", "expected_filter_column": "x"}]
    plans = {"a": {"metric_column": "m", "expected_unit": "anos"}, "c": {"intent": "catalog_filter", "filters": [{"column": "x"}]}}
    rates = E.plan_suite(cases, plans.get)
    assert rates["tabular_plan_success_rate"] == pytest.approx(0.6667) and rates["metric_resolution_accuracy"] == 1 and rates["unit_render_accuracy"] == 0 and rates["schema_question_success_rate"] == 0 and rates["catalog_question_success_rate"] == 1
    assert E.roll_up({"x": {"r": 1.0}, "y": {"r": 0.5, "s": 1.0}}) == {"r": 0.75, "s": 1.0}
    made = spark.createDataFrame([("capitulo", "II", "CAPÍTULO II", ["Art. 1"], "generated"), ("secao", "", "Seção 3", None, "fallback_only"), ("titulo", "I", "TÍTULO I", [], "invalid")], "node_type string, numeral string, label string, articles array<string>, status string")
    gold = spark.createDataFrame([(1, "capitulo", "2", ["Art. 1", "Art. 2"]), (2, "Secao", "III", []), (3, "titulo", "1", []), (4, "capitulo", "9", [])], "query_id long, target_type string, target_numeral string, expected array<string>")
    r = E.structural_suite(made, gold).first()
    assert (r.structural_hit_at_1, r.article_coverage, r.summary_valid_rate, r.fallback_success_rate) == (0.75, 0.625, 0.6667, 1.0)


def test_measures_from_counts(spark):
    judged = spark.createDataFrame([(1, i, g) for i, g in enumerate([2, 2, 1, 1, 1])] + [(2, 9, 0)], "query_id long, id long, grade int")
    counts = judged.groupBy("query_id", "grade").agg(F.count("*").alias("n"))
    for k in (1, 3, 10):
        a, b = ({r.query_id: (r.relevant, None if r.ideal is None else round(r.ideal, 9)) for r in t.collect()} for t in (E.totals(judged, k), E.totals_by_grade(counts, k)))
        assert a == b


def test_numbers_in_text_columns(spark):
    df = spark.createDataFrame([(f"c{i}", f"1.{i:03d},50", "Sao Paulo" if i % 2 else "Campinas", f"texto {i}") for i in range(40)], "id_venda string, total_geral string, cidade string, obs string")
    kinds = {p.name: (p.semantic_type, p.data_type, p.role) for p in semantics.measured(df)}
    assert kinds["total_geral"] == ("measure_number", "numeric", "metric") and kinds["obs"][0] in ("text", "catalog_attribute")
    got = compiler.ask(df, "qual a soma de total geral em Sao Paulo?").first()
    assert got["value"] == pytest.approx(sum(1000 + i + 0.5 for i in range(40) if i % 2))
    assert semantics.named_values(df, "vendas em campinas?", ["cidade", "obs"]) == {"cidade": ["Campinas"]}
    assert semantics.measured(df, examples=2)[2].examples == ("Campinas", "Sao Paulo")
    recs = spark.createDataFrame([({"a": "1", "b": "x"},), ({"a": "2"},)], "fields map<string,string>")
    assert {p.name: p.data_type for p in semantics.of_records(recs)} == {"a": "numeric", "b": "text"}


def test_rare_values_are_found(spark):
    """A value that is not among the frequent ones filters as well."""
    df = spark.createDataFrame([(i, f"cidade{i % 200}", 1.0) for i in range(400)], "id_linha long, cidade string, valor_total double")
    assert compiler.ask(df, "soma de valor total em cidade199").first()["value"] == 2.0


def test_lookup_by_meaning(spark):
    rows = [("20017", "Visita Domiciliar", "Hospitalar"), ("20018", "Outro", "Ambulatorial")]
    df = spark.createDataFrame(rows, "procedimento string, descricao_local string, cobertura_local string")
    assert [r.procedimento for r in semantics.lookup(df, {"codigo": "20017"}).collect()] == ["20017"]
    assert [r.procedimento for r in semantics.lookup(df, {"cobertura": "HOSP", "desconhecido": "x"}).collect()] == ["20017"]
    assert semantics.lookup(df, {}, limit=0).count() == 1


def test_stored_tables(spark, tmp_path):
    new = spark.createDataFrame([("d1", "ate 10 (dez) dias uteis", "Necessita autorizacao da Unidade"), ("d2", "imediato", "")], "doc_id string, prazo_autorizacao string, orientacao string")
    old = spark.createDataFrame([("d1", "x", 1), ("d3", "y", 2)], "doc_id string, prazo_autorizacao string, extra int")
    got = {r.doc_id: r for r in T.upsert_records(old, new, deadline="prazo_autorizacao", advice="orientacao").collect()}
    assert (got["d1"].prazo_dias, got["d1"].prazo_faixa, got["d1"].urgencia, got["d1"].requer_autorizacao) == (10, "Ate 10 dias", "medio", "true") and got["d3"].extra == 2 and got["d2"].prazo_faixa == "Imediato"
    assert T.ensure_columns(old, {"novo": "double"}).columns[-1] == "novo"
    both = T.changed(old, spark.createDataFrame([("d1", None, 7)], "doc_id string, prazo_autorizacao string, extra int"), "doc_id")
    assert {tuple(r) for r in both.collect()} == {("d1", "x", 7), ("d3", "y", 2)}
    path = str(tmp_path / "t")
    for _ in range(2):
        T.append(old.withColumn("collection", F.lit("a")), path, F.lit("2024-01-01"))
    assert spark.read.parquet(path).count() == 4 and T.exists(spark, path) and not T.exists(spark, path + "x")
    root = str(tmp_path / "c")
    old.withColumn("collection", F.col("doc_id")).write.partitionBy("collection").parquet(root)
    assert T.drop_collection(spark, root, "d1") and spark.read.parquet(root).count() == 1 and not T.drop_collection(spark, root, "d1")
    files = spark.createDataFrame([("/x/A.pdf",), ("/x/b.TXT",)], "path string")
    docs = spark.createDataFrame([("a.PDF",), ("B.pdf",), ("c.pdf",)], "document string")
    assert {tuple(r) for r in T.resolved_files(docs, files).collect()} == {("a.PDF", "/x/A.pdf"), ("B.pdf", "/x/b.TXT"), ("c.pdf", None)}
    tries = spark.createDataFrame([("p", "t", None), ("p", "", None), (None, None, None), ("p", "t", "erro")], "path string, text string, error string")
    assert {tuple(r) for r in T.reindex_report(tries).collect()} == {("indexed", 1), ("skipped", 2), ("failed", 1), ("attempted", 4)}
    jobs = spark.createDataFrame([("j", i, s) for i, s in enumerate(["queued", "bronze_received", "gold_indexing", "failed"])], "job string, at int, status string")
    assert [r.valid for r in T.transitions(jobs, "job", "status", "at").orderBy("at").collect()] == [True, True, False, True]
    vec = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 2)], "id long, v array<double>, order int")
    kept = T.vectors_upsert(spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>"), vec, 2)
    assert {r.id: r.v for r in kept.collect()} == {1: [3.0, 4.0], 2: [0.0, 1.0]}
    with pytest.raises(Exception, match="expected 3"):
        T.vectors_upsert(kept, vec, 3).collect()


PROFILES = [Profile("procedimento", "text", "identifier", "identifier", "text"), Profile("descricao", "text", "text", "catalog_title", "text"), Profile("cobertura", "text", "text", "coverage_rule", "text"), Profile("prazo", "text", "text", "deadline_rule", "text")]


def test_answers():
    total = Plan("tabular_aggregate", metric="renda_mensal", aggregation="sum", unit="", filters=(Filter("estado", "=", "RJ"),))
    assert "3.500,00" in render.answer(total, [{"value": 3500}]) and "estado RJ" in render.answer(total, [{"value": 3500}])
    assert "2.500,25" in render.answer(total.but(aggregation="avg"), [{"value": 2500.25}])
    groups = Plan("tabular_groupby", metric="renda", aggregation="avg", unit="brl", group_by=("estado",), assumptions=("media simples",))
    said = render.answer(groups, [{"estado": "sp", "value": 5000.0}])
    assert "sp: r$ 5.000,00" in said.lower() and said.endswith("Criterio: media simples.")
    left, right = {"procedimento": "1", "descricao": "A", "cobertura": "total", "prazo": ""}, {"procedimento": "2", "descricao": "B", "cobertura": "parcial", "prazo": "5 dias"}
    assert render.answer(Plan("catalog_lookup_by_id"), [left], PROFILES) == "1 - A. Cobertura: total."
    assert "cobertura: total / parcial" in render.answer(Plan("catalog_compare"), [left, right], PROFILES)
    assert render.query_text(total) == "tabular_aggregate | sum(renda_mensal) | com estado RJ" and render.preview([left]) == "procedimento=1, descricao=A, cobertura=total, prazo="
    assert render.answer(total, []).startswith("Nao encontrei") and planner is not None
